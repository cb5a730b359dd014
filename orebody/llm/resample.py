"""Importance resampling towards a target distribution, over distinct lines.

Features are runs of 1 to ``runs`` consecutive words, hashed into buckets.  Newlines
separate words, so a text is its lines: each distinct line of the corpus is cut into words
and hashed once, its counts are multiplied by how often it occurs, and runs that reach over
the end of a line are counted for each document beside them.  The log ratio of a bucket's
share in the target to its share in the corpus is the bucket's gain; a document's weight is
the mean gain of its features; Gumbel noise from a hash of the id turns the weights into a
draw without replacement, the highest scores first.

Only lines, counts and one number a document are shuffled.  Lines that make up more than a
1,024th of all lines (no more than 1,024 can) are dealt over several tasks when documents
meet their lines.

Defined results: a null text, or one without words, has no features, weight 0, and is never
drawn unless no words are asked for; rows that repeat an id are documents of their own with
one draw; a null id is drawn by the word ``null`` and ordered last; an empty table gives an
empty result; without a target all gains follow from the smoothing alone.  Columns other
than doc_id and text are ignored by :func:`weigh` and kept by :func:`resample`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orebody.operators.running import running

from .shared import columns, settle, spread_join, table

#: Fixed values of the contract: words after A-Z are lower-cased, buckets, draw.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: A line is hot with more than this share of all lines.
HOT_SHARE = 1 / 1024


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def bucket(feature: Column) -> Column:
    return (F.crc32(feature.cast("binary")) % BUCKETS).cast("int")


def _run(own: Column, first: Column, size: Column) -> Column:
    return bucket(F.array_join(F.slice(own, first, size), " "))


def line_buckets(own: Column, runs: int) -> Column:
    """The buckets of all runs of an array of words."""
    if runs == 1:
        return F.transform(own, bucket)
    every = F.transform(F.sequence(F.lit(1), F.lit(runs)), lambda k: F.when(F.size(own) >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.size(own) - k + 1, F.lit(1))), lambda i: _run(own, i, k))).otherwise(F.array().cast("array<int>")))
    return F.flatten(every)


def cross_buckets(text: Column, runs: int) -> Column:
    """The buckets of the runs that begin in one line and end in a later one."""
    lines = F.filter(F.transform(F.split(text, "\n"), words), lambda w: F.size(w) > 0)
    whole = F.flatten(lines)
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1))), lambda k: F.aggregate(F.slice(lines, F.lit(1), k), F.lit(0), lambda s, w: s + F.size(w)))
    # a run over the end of a line counts where it begins, within the last words of that line
    sizes = F.transform(lines, F.size)

    def begun(end: Column, own: Column) -> Column:
        starts = F.sequence(F.greatest(end - F.least(own, F.lit(runs - 1)) + 1, F.lit(1)), F.greatest(end, F.lit(1)))
        every = F.transform(starts, lambda a: F.transform(F.filter(F.sequence(F.lit(2), F.lit(runs)), lambda k: (a + k - 1 > end) & (a + k - 1 <= F.size(whole))), lambda k: _run(whole, a, k)))
        return F.flatten(every)

    found = F.flatten(F.transform(F.arrays_zip(ends.alias("end"), sizes.alias("own")), lambda r: F.when(r["own"] > 0, begun(r["end"], r["own"])).otherwise(F.array().cast("array<int>"))))
    return F.when(F.size(lines) > 1, found).otherwise(F.array().cast("array<int>"))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, place, line): the lines of each row that hold a word; a row without any has one null line."""
    own = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"))
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), F.posexplode_outer(own).alias("place", "line"))


def keyed(lines: DataFrame) -> DataFrame:
    """Lines known by 128 bits of hashes."""
    return lines.withColumn("k1", F.xxhash64("line")).withColumn("k2", F.xxhash64(F.lit(SEED), "line"))


def distinct_lines(docs: DataFrame, runs: int) -> DataFrame:
    """(k1, k2, often, buckets): each distinct line, how often it occurs and its features, computed once."""
    often = lines_of(docs).where("line IS NOT NULL").groupBy("line").agg(F.count("*").alias("often"))
    return keyed(often).select("k1", "k2", "often", line_buckets(words(F.col("line")), runs).alias("buckets"))


def cross_lines(docs: DataFrame, runs: int) -> DataFrame:
    """(doc_id, mark, buckets) of the runs over line ends."""
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), cross_buckets(F.col("text"), runs).alias("buckets")).where(F.size("buckets") > 0)


def bucket_counts(lines: DataFrame, cross: DataFrame | None) -> DataFrame:
    """(bucket, n) over distinct lines times their occurrences, and runs over line ends."""
    rows = lines.select(F.explode("buckets").alias("bucket"), "often")
    if cross is not None:
        rows = rows.unionByName(cross.select(F.explode("buckets").alias("bucket"), F.lit(1).cast("long").alias("often")))
    return rows.groupBy("bucket").agg(F.sum("often").alias("n"))


def gains(corpus: DataFrame, target: DataFrame) -> DataFrame:
    """One row with the gains of all buckets, from two frames of (bucket, n)."""
    spark = corpus.sparkSession
    sums = corpus.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("s_all")).crossJoin(target.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t_all")))
    every = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    # BUCKETS rows at most on either side
    both = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["s", "t"]).crossJoin(F.broadcast(sums))
    ratio = ((F.col("t") + 1).cast("double") * (F.col("s_all") + BUCKETS).cast("double")) / ((F.col("s") + 1).cast("double") * (F.col("t_all") + BUCKETS).cast("double"))
    rows = both.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).cast("long").alias("gain"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "gain"))), lambda r: r["gain"]).alias("gains"))


def noise(doc_id: Column) -> Column:
    """Gumbel noise in thousandths, from a hash of the id."""
    key = F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def weigh(docs: DataFrame, target: DataFrame, runs: int = 1) -> DataFrame:
    """(doc_id, mark, copies, n_features, weight, score) of each distinct row (doc_id, text); copies counts the rows alike."""
    docs, target = columns(docs, doc_id="long", text="string"), columns(target, text="string").withColumn("doc_id", F.lit(0).cast("long"))
    lines = settle(distinct_lines(docs, runs), "lines")
    cross = settle(cross_lines(docs, runs), "cross-lines") if runs > 1 else None
    wanted = bucket_counts(distinct_lines(target, runs), cross_lines(target, runs) if runs > 1 else None)
    gain = F.broadcast(settle(gains(bucket_counts(lines, cross), wanted), "gains"))

    def summed(own: DataFrame) -> DataFrame:
        total = F.aggregate("buckets", F.lit(0).cast("long"), lambda s, b: s + F.get("gains", b))
        return own.crossJoin(gain).withColumn("total", total).withColumn("n", F.size("buckets").cast("long")).drop("buckets", "gains")

    all_lines = lines.agg(F.sum("often").alias("n")).first()["n"] or 0
    hot = lines.where(F.col("often") > all_lines * HOT_SHARE).select("k1", "k2")
    placed = keyed(lines_of(docs)).select("doc_id", "mark", "place", "k1", "k2", F.col("line").isNull().alias("bare"))
    zero = F.lit(0).cast("long")
    parts = spread_join(placed.where("NOT bare"), summed(lines).select("k1", "k2", "n", "total"), ["k1", "k2"], hot)
    parts = parts.select("doc_id", "mark", (F.col("place") == 0).cast("long").alias("copies"), "n", "total")
    # a row without words stands for itself
    parts = parts.unionByName(placed.where("bare").select("doc_id", "mark", F.lit(1).cast("long").alias("copies"), zero.alias("n"), zero.alias("total")))
    if cross is not None:
        parts = parts.unionByName(summed(cross).select("doc_id", "mark", zero.alias("copies"), "n", "total"))
    own = parts.groupBy("doc_id", "mark").agg(F.sum("copies").alias("copies"), F.sum("n").alias("n"), F.sum("total").alias("total"))
    each = own.select("doc_id", "mark", "copies", F.expr("n div copies").alias("n_features"), F.expr("total div copies").alias("total"))
    weight = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(zero)
    return each.select("doc_id", "mark", "copies", "n_features", weight.alias("weight"), (weight + noise(F.col("doc_id"))).alias("score"))


def ranked(docs: DataFrame, target: DataFrame, runs: int = 1, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, mark, copy, n_features, weight, score, rank) of every row; rank is null where a row is not drawn.

    ``percent`` of the rows with ``least_words`` words or more are drawn.
    """
    weighed = weigh(docs, target, runs)
    rows = weighed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")
    rows = settle(rows, "weighed")
    # with runs of several words a feature count does not say the words: n words make at most runs * n features
    if runs == 1:
        enough = rows.where(F.col("n_features") >= least_words)
        fewer = rows.where(F.col("n_features") < least_words)
    else:
        n_words = columns(docs, doc_id="long", text="string").select("doc_id", F.xxhash64("text").alias("mark"), F.size(words(F.col("text"))).alias("__n")).dropDuplicates(["doc_id", "mark"]).withColumnRenamed("doc_id", "__id").withColumnRenamed("mark", "__mark")
        counted = rows.join(n_words, rows["doc_id"].eqNullSafe(n_words["__id"]) & (rows["mark"] == n_words["__mark"])).drop("__id", "__mark")
        counted = settle(counted, "counted")
        enough, fewer = counted.where(F.col("__n") >= least_words).drop("__n"), counted.where(F.coalesce("__n", F.lit(0)) < least_words).drop("__n")
    drawn = enough.count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("mark").asc(), F.col("copy").asc()]
    placed = running(enough, order, number="place")
    placed = placed.withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1).cast("long")).drop("place")
    return placed.unionByName(fewer.withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, runs: int = 1, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """The drawn documents themselves, with all their columns; of rows alike in id and text as many as were drawn."""
    chosen = ranked(docs, target, runs, percent, least_words).where("rank IS NOT NULL").groupBy("doc_id", "mark").agg(F.count("*").alias("__times"))
    chosen = settle(chosen.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), "__times"), "drawn")
    names = {c.lower(): c for c in docs.columns}
    own_id, own_mark = docs[names["doc_id"]].cast("long"), F.xxhash64(docs[names["text"]].cast("string"))
    taken = docs.join(chosen, own_id.eqNullSafe(F.col("__id")) & (own_mark == F.col("__mark")))
    once = taken.where("__times = 1").select(*docs.columns)
    # a draw may end among rows alike in id and text: of those no more than were drawn stay
    many = taken.where("__times > 1")
    several = many.withColumn("__n", F.row_number().over(Window.partitionBy("__id", "__mark").orderBy(F.lit(1)))).where("__n <= __times").select(*docs.columns)
    return once.unionByName(several)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


_LOW = f"translate(COALESCE(text, ''), '{UPPER}', '{LOWER}')"
#: CRC-32 over a word's bytes by its table, which is made of eight shifts.
ORACLE = rf"""
WITH RECURSIVE bits AS (
  SELECT i AS entry, i::BIGINT AS value, 0 AS step FROM range(256) t(i)
  UNION ALL SELECT entry, CASE WHEN value % 2 = 1 THEN xor(value // 2, 3988292384) ELSE value // 2 END, step + 1 FROM bits WHERE step < 8),
crc AS MATERIALIZED (SELECT list(value ORDER BY entry) AS entries FROM bits WHERE step = 8),
d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{WORD}') AS w FROM documents),
b AS (SELECT regexp_extract_all({_LOW}, '{WORD}') AS w FROM benchmark),
dw AS MATERIALIZED (SELECT doc_id, unnest(w) AS word FROM d),
bw AS MATERIALIZED (SELECT unnest(w) AS word FROM b),
vocabulary AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
coded AS MATERIALIZED (
  SELECT word, xor(list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
      lambda c, x: xor(c // 256, entries[xor(c % 256, x) + 1]), 4294967295::BIGINT), 4294967295) % {BUCKETS} AS bucket
  FROM vocabulary, crc),
s AS (SELECT bucket, COUNT(*) AS s FROM dw JOIN coded USING (word) GROUP BY bucket),
t AS (SELECT bucket, COUNT(*) AS t FROM bw JOIN coded USING (word) GROUP BY bucket),
gain AS MATERIALIZED (
  SELECT i AS bucket, floor(1000 * ln(((COALESCE(t, 0) + 1)::DOUBLE * ((SELECT COUNT(*) FROM dw) + {BUCKETS})::DOUBLE) / ((COALESCE(s, 0) + 1)::DOUBLE * ((SELECT COUNT(*) FROM bw) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM range({BUCKETS}) r(i) LEFT JOIN s ON s.bucket = i LEFT JOIN t ON t.bucket = i),
summed AS (SELECT doc_id, SUM(gain)::BIGINT AS total FROM dw JOIN coded USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
weighed AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, CASE WHEN len(w) > 0 THEN floor(total / len(w)::DOUBLE)::BIGINT ELSE 0 END AS weight,
         ('0x' || substr(sha256('{SEED}:' || COALESCE(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS h
  FROM d LEFT JOIN summed USING (doc_id)),
scored AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= ({PERCENT} * (SELECT COUNT(*) FROM placed)) // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""
