"""Sources and sinks of the two base tables and of results."""

from __future__ import annotations

from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orebody.functions.vocabulary import series_schema, snapshot_schema

MAX_ROWS, MAX_CHARS = 50, 10_000


def source_url(base: str, table: str, report_year: int | None, api: str = "v2", verbose: int = 3, kind: str = "csv") -> str:
    """Where a table can be fetched; series exist for one published year only."""
    year = 2024 if table == "project_timeseries" else report_year
    query = f"verbose={verbose}&output={kind}" + (f"&report-year={year}" if year else "")
    return f"{base.rstrip('/')}/{api}/{table.replace('_', '-')}?{query}"


def _typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns by name and type; a column the input lacks is null, one that is no number is null, one too many falls away."""
    have = {c.lower(): c for c in df.columns}

    def column(f: T.StructField) -> Column:
        if f.name.lower() not in have:
            return F.lit(None).cast(f.dataType).alias(f.name)
        own = F.col(f"`{have[f.name.lower()]}`")
        if isinstance(f.dataType, T.StringType):
            return own.cast("string").alias(f.name)
        return F.nullif(F.trim(own.cast("string")), F.lit("")).try_cast(f.dataType).alias(f.name)

    return df.select(*[column(f) for f in schema.fields])


#: Column of a reader in which a row is kept that is no row of the table.
BROKEN = "__broken"


def raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """The cells of a file as text, by the header's names; rows with more or fewer cells than the header in BROKEN as well."""
    options = {"sep": ";", "header": True, "quote": '"', "escape": '"', "multiLine": True}
    names = spark.read.options(**options).csv(path).columns
    text = T.StructType([T.StructField(n, T.StringType()) for n in [*names, BROKEN]])
    return spark.read.options(**options, columnNameOfCorruptRecord=BROKEN).schema(text).csv(path)


def raw_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The values of an array of flat objects as text, by name; what is no object in BROKEN."""
    text = T.StructType([T.StructField(n, T.StringType()) for n in [*schema.fieldNames(), BROKEN]])
    return spark.read.schema(text).option("multiLine", True).option("columnNameOfCorruptRecord", BROKEN).json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Semicolons, double quotes doubled inside, a header row; cells may hold line breaks."""
    return _typed(raw_csv(spark, path), schema)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """An array of flat objects, by name."""
    return _typed(raw_json(spark, path, schema), schema)


def raw_table(spark: SparkSession, folder: str, name: str, kind: str, schema: T.StructType) -> DataFrame:
    path = str(PurePosixPath(folder) / f"{name}.{kind}") if "://" not in folder else f"{folder}/{name}.{kind}"
    if kind == "csv":
        return raw_csv(spark, path)
    if kind == "json":
        return raw_json(spark, path, schema)
    raise ValueError(f"no reader for {kind!r}")


def read_table(spark: SparkSession, folder: str, name: str, kind: str, schema: T.StructType) -> DataFrame:
    return _typed(raw_table(spark, folder, name, kind, schema), schema)


def faults(raw: DataFrame, schema: T.StructType) -> Column:
    """Array of (column, value, reason): cells that are not of their column's type, and rows that are not of the table's shape."""
    have = {c.lower(): c for c in raw.columns}
    reason = T.StructType([T.StructField(n, T.StringType()) for n in ("column", "value", "reason")])
    found = [F.when(F.col(BROKEN).isNotNull(), F.struct(F.lit(None).cast("string").alias("column"), F.col(BROKEN).alias("value"), F.lit("broken row").alias("reason")))]
    for f in schema.fields:
        if f.name.lower() in have and not isinstance(f.dataType, T.StringType):
            own = F.nullif(F.trim(F.col(f"`{have[f.name.lower()]}`")), F.lit(""))
            kind = f.dataType.simpleString()
            found.append(F.when(own.isNotNull() & own.try_cast(f.dataType).isNull(), F.struct(F.lit(f.name).alias("column"), own.alias("value"), F.lit(f"not {kind}").alias("reason"))))
    return F.array_compact(F.array(*found)).cast(T.ArrayType(reason))


def rejects(raw: DataFrame, schema: T.StructType, table: str) -> DataFrame:
    """(table_name, file, row, column, value, reason): a row for each bad cell and each broken row; ``row`` is the row's cells as JSON."""
    cells = F.to_json(F.struct(*[F.col(f"`{c}`") for c in raw.columns if c != BROKEN]))
    rows = raw.select(F.lit(table).alias("table_name"), F.input_file_name().alias("file"), cells.alias("row"), F.explode(faults(raw, schema)).alias("r"))
    return rows.select("table_name", "file", "row", "r.column", "r.value", "r.reason")


def derive(df: DataFrame) -> DataFrame:
    """Ids, discovery flag and stage that follow from a row's own columns; a series has no stage."""
    kind = F.substring("project_class", 1, 1)
    key = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("project_id", "report_year", "uncert_level", "year", "project_class", "project_level") if c in df.columns]
    out = df.withColumn("uuid", F.sha2(F.concat_ws("|", *key), 256)).withColumn("project_uuid", F.sha2(F.coalesce(F.col("project_id"), F.lit("")), 256))
    if "project_stage" not in df.columns:
        return out
    stage = F.substring("project_stage", 1, 1)
    out = out.withColumn("is_discovered", F.when(kind.isin("1", "2"), 1).when(kind == "3", 0))
    return out.withColumn("project_stage", F.when(stage == "1", "Exploitation").when(stage == "2", "Exploration").when(stage == "3", "Abandoned").otherwise(F.col("project_stage")))


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("report_year").parquet(path)


#: The base tables and their schemas.
BASE_TABLES = {"project_resources": snapshot_schema, "project_timeseries": series_schema}


class Loaded(dict):
    """Tables by name; ``rejects`` has what of the files is in none of them, ``counts`` rows, bad cells and broken rows by table."""

    rejects: DataFrame
    counts: dict[str, dict[str, int]]


def load(spark: SparkSession, folder: str, out: str, kind: str = "csv") -> Loaded:
    """Read every base table of a folder, derive its columns and write it below ``out`` by report year.

    Each table replaces what was there; the tables as written come back by name.  A cell that
    is not of its column's type is null, a row with too few cells ends in nulls and one with
    too many loses them; each of these is a row of ``rejects``.  They are counted in the pass
    that writes the table, and looked up in a second one only where there are any.
    """
    loaded, parts = Loaded(), []
    loaded.counts = {}
    for name, schema in BASE_TABLES.items():
        raw = raw_table(spark, folder, name, kind, schema())
        bad = faults(raw, schema())
        broken = F.col(BROKEN).isNotNull().cast("long")
        seen = Observation(f"load-{name}")
        watched = raw.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size(bad) - broken), F.lit(0)).cast("long").alias("bad_cells"), F.coalesce(F.sum(broken), F.lit(0)).alias("broken_rows"))
        write_table(derive(_typed(watched, schema())), f"{out.rstrip('/')}/{name}")
        loaded[name] = spark.read.parquet(f"{out.rstrip('/')}/{name}")
        loaded.counts[name] = dict(seen.get)
        own = rejects(raw, schema(), name)
        parts.append(own if seen.get["bad_cells"] or seen.get["broken_rows"] else spark.createDataFrame([], own.schema))
    loaded.rejects = reduce(DataFrame.unionByName, parts)
    return loaded


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """New rows replace old ones of the same key; of equal new ones the first by ``order``."""
    last = Window.partitionBy(*keys).orderBy(F.col("__new").desc(), *[F.col(c).asc_nulls_last() for c in order])
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "__new")


def piped_text(df: DataFrame, limit: int = MAX_ROWS) -> str:
    """The first rows as lines of ``a | b`` with a count behind; no more than ``limit`` rows leave the cluster."""
    rows = df.limit(limit + 1).collect()
    lines = [" | ".join(df.columns)] + [" | ".join("NULL" if v is None else str(v) for v in r) for r in rows[:limit]]
    more = f"(first {limit} rows)" if len(rows) > limit else f"({len(rows)} rows returned)"
    return "\n".join([*lines, more])[:MAX_CHARS]


def grid_text(df: DataFrame, limit: int = MAX_ROWS) -> str:
    """The first rows as a ruled table; fractions with two places and thousands marked."""
    shown = [F.format_number(f.name, 2).alias(f.name) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(f"`{f.name}`").cast("string").alias(f.name) for f in df.schema.fields]
    rows = [["" if v is None else v for v in r] for r in df.select(*shown).limit(limit).collect()]
    widths = [max(len(x) for x in column) for column in zip(df.columns, *rows)]
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    body = ["|" + "|".join(f" {v:<{w}} " for v, w in zip(r, widths)) + "|" for r in [df.columns, *rows]]
    return "\n".join([rule, body[0], rule, *body[1:], rule])


def table_columns(spark: SparkSession, name: str) -> list[tuple[str, str]]:
    return [(c.name, c.dataType) for c in spark.catalog.listColumns(name)]


def table_sizes(spark: SparkSession) -> DataFrame:
    """(table, rows) of every table and view the session knows."""
    out = None
    for t in spark.catalog.listTables():
        own = spark.table(t.name).agg(F.count("*").alias("n_rows")).select(F.lit(t.name).alias("table_name"), "n_rows")
        out = own if out is None else out.unionByName(own)
    return out if out is not None else spark.createDataFrame([], "table_name string, n_rows long")
