"""The read-only gate: a closed list of what a query may consist of."""

import pytest

from orebody.plans import sqlgate

REFUSED = [
    "EXECUTE IMMEDIATE 'CREATE TEMP VIEW hacked AS SELECT 1'",
    "EXECUTE IMMEDIATE 'SELECT 1'",
    "CALL system.do()",
    "SET VAR x = 1",
    "DECLARE x INT",
    "ANALYZE TABLE t COMPUTE STATISTICS",
    "MSCK REPAIR TABLE t",
    "LOAD DATA INPATH '/x' INTO TABLE t",
    "CACHE TABLE t",
    "UNCACHE TABLE t",
    "CLEAR CACHE",
    "REFRESH TABLE t",
    "COMMENT ON TABLE t IS 'x'",
    "ALTER TABLE t RENAME TO u",
    "ALTER TABLE t ADD COLUMN x INT",
    "CREATE TABLE t AS SELECT 1",
    "CREATE OR REPLACE TEMP VIEW t AS SELECT 1",
    "CREATE FUNCTION f AS 'x'",
    "DROP VIEW t",
    "TRUNCATE TABLE t",
    "DELETE FROM t WHERE 1 = 1",
    "UPDATE t SET a = 1",
    "MERGE INTO t USING u ON t.a = u.a WHEN MATCHED THEN DELETE",
    "INSERT OVERWRITE DIRECTORY '/tmp/x' USING csv SELECT 1",
    "FROM t INSERT INTO u SELECT *",
    "ADD JAR '/x.jar'",
    "USE other",
    "RESET",
    "SHOW FUNCTIONS",
    "DESCRIBE QUERY SELECT 1",
    "EXPLAIN EXTENDED SELECT 1",
    "BEGIN SELECT 1; END",
    "SELECT * FROM IDENTIFIER('parquet.`/etc`')",
    "SELECT IDENTIFIER('reflect')('java.lang.System', 'lineSeparator')",
    "SELECT reflect('java.lang.System', 'lineSeparator')",
    "SELECT builtin.reflect('java.lang.System', 'lineSeparator')",
    "SELECT a FROM t LATERAL VIEW explode(array(java_method('java.lang.System', 'lineSeparator'))) x AS y",
    "SELECT * FROM t ORDER BY (SELECT reflect('java.lang.System', 'lineSeparator'))",
    "WITH q AS (SELECT raise_error('x')) SELECT * FROM q",
    "SELECT input_file_name() FROM t",
    "SELECT unknown_function(1)",
    "SELECT own_function(1)",
    "SELECT * FROM STREAM t",
    "SELECT * FROM own_table_function(TABLE(SELECT * FROM csv.`/etc/passwd`))",
]
READ = [
    "SELECT 1",
    "VALUES (1, 2), (3, 4)",
    "TABLE t",
    "FROM t SELECT a",
    "WITH a AS (SELECT 1 AS x), b AS (SELECT x FROM a) SELECT * FROM a JOIN b USING (x)",
    "WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r WHERE n < 5) SELECT * FROM r",
    "SELECT a FROM t UNION ALL SELECT b FROM u EXCEPT SELECT c FROM v INTERSECT SELECT d FROM w",
    "SELECT DISTINCT a, COUNT(*) OVER w AS n, SUM(b) OVER (PARTITION BY a ORDER BY c ROWS UNBOUNDED PRECEDING) FROM t WINDOW w AS (PARTITION BY a) ORDER BY 1 LIMIT 10 OFFSET 2",
    "SELECT a, SUM(b) AS total FROM t WHERE c LIKE '%x%' AND d ILIKE 'y_' AND e BETWEEN 1 AND 2 GROUP BY GROUPING SETS ((a), ()) HAVING SUM(b) > 1",
    "SELECT a FROM t WHERE EXISTS (SELECT 1 FROM u WHERE u.a = t.a) AND b IN (SELECT b FROM v) AND c > (SELECT MAX(c) FROM w)",
    "SELECT * FROM t LEFT JOIN LATERAL (SELECT * FROM u WHERE u.a = t.a) x ON TRUE",
    "SELECT k, v FROM t LATERAL VIEW OUTER explode(m) x AS k, v",
    "SELECT * FROM range(10), explode(array(1, 2))",
    "SELECT * FROM t PIVOT (SUM(v) FOR y IN (2023, 2024))",
    "SELECT * FROM t UNPIVOT (v FOR n IN (a, b))",
    "SELECT * FROM t TABLESAMPLE (10 PERCENT)",
    "SELECT /*+ BROADCAST(u) */ t.* FROM t JOIN u ON t.a = u.a",
    "SELECT CASE WHEN a IS NULL THEN 'x' ELSE CAST(b AS STRING) END, a::INT, c[0], d.e, -f, NOT g, h || 'i', DATE '2024-01-01', INTERVAL 1 DAY FROM t",
    "SELECT transform(a, x -> x + 1), aggregate(a, 0, (s, x) -> s + x), filter(a, x -> x > 1), named_struct('k', 1), try_cast('1' AS INT), EXTRACT(YEAR FROM b) FROM t",
    "SELECT percentile_approx(a, 0.5), count(DISTINCT b), max_by(c, d), collect_list(e), regexp_extract(f, 'x', 0), date_trunc('month', g), sha2(h, 256), coalesce(i, j), a % 2, round(k, 2) FROM t",
    "SELECT a FROM t |> WHERE a > 1",
    "SELECT 'EXECUTE IMMEDIATE' AS `drop`, \"reflect(\" AS x",
]


@pytest.mark.parametrize("text", REFUSED)
def test_refused(spark, text):
    spark.udf.register("own_function", lambda x: x)
    assert not sqlgate.reads_only(text, spark)
    with pytest.raises(ValueError):
        sqlgate.run_sql(spark, text)


@pytest.mark.parametrize("text", READ)
def test_let_through(spark, text):
    assert sqlgate.refusal(spark, text) is None
