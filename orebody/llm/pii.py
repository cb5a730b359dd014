"""Personal data: base patterns as seeds, bootstrapped contextual extraction for the rest.

Base spans are found by four regular expressions and their tests; they are the seeds.  Every
other run of signs that could be an identifier is a candidate.  A lexical pattern is what
stands around an occurrence: its two words on the left, or the word on either side, of the
same line.  Patterns and instances (the texts of occurrences) are a bipartite graph of
distinct edges.  A pattern's confidence for a kind is the mean belief of its instances, with
every instance of another kind against it; an instance's belief is one minus the chance that
all its confident patterns are wrong.  Spark repeats the two sums a fixed number of rounds;
patterns with enough distinct seeds and confidence at the end name their unseen instances,
and every occurrence of such an instance becomes a span.

DataFrame functions only.  Texts are read once; what is shuffled are occurrences and edges.
Only patterns that have enough distinct seeds are kept, edges are distinct and counted before
they meet, and patterns that hold more than a 1,024th of the edges (no more than 1,024 can)
are dealt over several tasks.

Offsets are code points, ends exclusive.  Defined results: a null or empty text has no span;
rows that repeat an id are judged row by row; an added span never overlaps a base span or
another added one, as candidates are what lies outside base spans; an empty table gives an
empty result.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import columns, settle, spread_join, table

#: Fixed values of the contract, leftmost matches without overlap: the same languages, written so that no run is read twice.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
IP_PARTS = rf"^{_PART}(?:\.{_PART}){{3}}$"
CARD_DIGITS, PHONE_DIGITS = (12, 19), (9, 15)
#: What could be an identifier: signs of addresses and numbers with a digit or an at sign inside, and groups of digits behind single blanks.
CANDIDATE = r"(?<![A-Za-z0-9._%+@()\[\]/=-])(?=[A-Za-z._%+()\[\]/=-]*+[0-9@])[A-Za-z0-9._%+@()\[\]/=-]++(?:\x20[0-9(][0-9().-]*+)*+"
#: Shapes that an instance of a kind must have, and so many digits at least.
SHAPES = {
    "email": (r"^[a-z0-9._%+-]+(?:@|\(at\)|\[at\])[a-z0-9.()\[\]-]+$", 0),
    "ip": (r"^[0-9]{1,3}(?:[.-][0-9]{1,3}){3}(?:/[0-9]{1,2})?$", 4),
    "card": (r"^[0-9][0-9 ./-]*$", 12),
    "phone": (r"^[+(]?[0-9][0-9 ().-]*$", 7),
}
#: Distinct seeds of a pattern at least, confidences at least, rounds.
SEEDS, PATTERN_LEAST, INSTANCE_LEAST, ROUNDS = 4, 0.8, 0.8, 3
#: Characters of context that are looked at on either side.
REACH = 48
HOT_SHARE = 1 / 1024


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of decimal digits has a valid last digit modulo 10."""
    values = F.transform(F.filter(F.split(F.reverse(number), ""), lambda d: d != ""), lambda d: d.cast("int"))
    weighed = F.transform(values, lambda d, k: F.when(k % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(weighed, F.lit(0), lambda s, d: s + d) % 10 == 0


def valid(kind: str, found: Column) -> Column:
    n = F.length(digits(found))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return found.rlike(IP_PARTS)
    if kind == "card":
        return n.between(*CARD_DIGITS) & luhn(digits(found))
    return n.between(*PHONE_DIGITS)


def matches(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, found): of each row the matches of every kind and the candidates, as (kind, place, gap, value, before, after).

    ``gap`` is what lies between the match before and this one; texts stay behind.
    """
    worth = F.col("text").rlike("[0-9@]")
    kinds = PATTERNS | {"": CANDIDATE}
    cut = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.when(worth, F.col("text")).alias("text"))
    cut = cut.select("doc_id", "mark", *[x for k, p in kinds.items() for x in (F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"values_{k}"), F.split("text", p, -1).alias(f"pieces_{k}"))])

    def rows(kind: str) -> Column:
        pieces = F.col(f"pieces_{kind}")
        zipped = F.arrays_zip(F.col(f"values_{kind}").alias("value"), pieces.alias("before"), F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))).alias("after"))
        made = F.transform(zipped, lambda r, k: F.struct(F.lit(kind).alias("kind"), k.alias("place"), F.length(r["before"]).alias("gap"), r["value"].alias("value"), F.right(r["before"], F.lit(REACH)).alias("before"), F.substring(r["after"], 1, REACH).alias("after")))
        return F.filter(made, lambda r: r["value"].isNotNull())

    return cut.select("doc_id", "mark", F.concat(*[rows(k) for k in kinds]).alias("found"))


def occurrences(found: DataFrame) -> DataFrame:
    """(doc_id, mark, kind, start, end, value, lexical): base spans, and under the kind null the candidates outside them.

    Rows alike in id and text are one here; ``lexical`` holds the patterns around an occurrence.
    """
    rows = found.select("doc_id", "mark", F.explode("found").alias("r")).select("doc_id", "mark", "r.*")
    rows = rows.repartition("doc_id", "mark").dropDuplicates(["doc_id", "mark", "kind", "place"])
    before = Window.partitionBy("doc_id", "mark", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    own = F.length("value")
    rows = rows.withColumn("end", F.sum(F.col("gap") + own).over(before)).withColumn("start", F.col("end") - own)
    test = reduce(lambda out, k: out.when(F.col("kind") == k, valid(k, F.col("value"))), KINDS, F.when(F.lit(False), False)).otherwise(True)
    rows = rows.where(test)
    # a candidate loses the marks around it that are no part of an identifier
    trimmed = F.regexp_extract("value", r"^[^A-Za-z0-9+(]*+(.*?)[^A-Za-z0-9]*$", 1)
    lead = F.length(F.regexp_extract("value", r"^[^A-Za-z0-9+(]*+", 0))
    bare = F.col("kind") == ""
    rows = rows.withColumn("start", F.when(bare, F.col("start") + lead).otherwise(F.col("start"))).withColumn("value", F.when(bare, trimmed).otherwise(F.col("value")))
    rows = rows.withColumn("end", F.col("start") + F.length("value")).where(F.length("value") > 0)
    within = Window.partitionBy("doc_id", "mark").orderBy("start", F.col("kind") == "", "kind")
    is_base = F.col("kind") != ""
    ahead = F.max(F.when(is_base, F.col("end"))).over(within.rowsBetween(Window.unboundedPreceding, -1))
    behind = F.min(F.when(is_base, F.col("start"))).over(within.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("clear", (F.coalesce(ahead, F.lit(-1)) <= F.col("start")) & (F.coalesce(behind, F.col("end")) >= F.col("end")))
    rows = rows.where(is_base | F.col("clear"))
    line = F.lower(F.regexp_extract("before", "([^\n]*)$", 1))
    two = F.regexp_extract(line, r"(\p{L}++[^\p{L}]{1,3}\p{L}++)[^\p{L}0-9]{0,3}$", 1)
    one = F.regexp_extract(line, r"(\p{L}++)[^\p{L}0-9]{0,3}$", 1)
    right = F.lower(F.regexp_extract("after", r"^[^\p{L}0-9\n]{0,3}(\p{L}++)", 1))
    left_two = F.when(two != "", F.concat(F.lit("2 "), F.regexp_replace(two, r"[^\p{L}]+", " ")))
    both = F.when((one != "") & (right != ""), F.concat(F.lit("1 "), one, F.lit(" _ "), right))
    value = F.when(F.coalesce(F.col("kind"), F.lit("")) == "email", F.lower("value")).otherwise(F.col("value"))
    return rows.select("doc_id", "mark", F.nullif("kind", F.lit("")).alias("kind"), "start", "end", value.alias("value"), F.array_compact(F.array(left_two, both)).alias("lexical"))


def hot(df: DataFrame, key: str, label: str) -> DataFrame:
    """The keys with more than a 1,024th of the rows."""
    counts = settle(df.groupBy(key).agg(F.count("*").alias("n")), label)
    n = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    return counts.where(F.col("n") > n * HOT_SHARE).select(key)


def shaped(kind: Column, value: Column) -> Column:
    """Whether a value has the shape of its kind."""
    test = F.when(F.lit(False), False)
    for name, (shape, least) in SHAPES.items():
        test = test.when(kind == name, F.lower(value).rlike(shape) & (F.length(digits(value)) >= least))
    return F.coalesce(test, F.lit(False))


def discovered(own: DataFrame, seeds: int = SEEDS, rounds: int = ROUNDS) -> DataFrame:
    """(value, kind, belief) of the unseen instances that confident patterns name."""
    edges = own.select(F.explode("lexical").alias("pattern"), "value", "kind").groupBy("pattern", "value").agg(F.min("kind").alias("kind"))
    edges = settle(edges, "edges")
    anchors = edges.where("kind IS NOT NULL").groupBy("pattern", "kind").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= seeds)
    anchors = settle(anchors, "anchors")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("total"))
    anchors = settle(anchors.join(sizes, "pattern").select("pattern", "kind", "seeds", "total"), "patterns")
    edges = settle(edges.join(anchors.select("pattern").distinct(), "pattern", "left_semi"), "kept-edges")
    busy_patterns, busy_values = hot(edges, "pattern", "busy-patterns"), hot(edges, "value", "busy-values")
    # what each seed gives its patterns is the same in every round
    unseen = edges.where("kind IS NULL").select("pattern", "value")
    beliefs: DataFrame | None = None
    for k in range(rounds):
        scored = anchors.withColumn("believed", F.lit(0.0))
        if beliefs is not None:
            given = spread_join(unseen, beliefs, ["value"], busy_values).groupBy("pattern", "kind").agg(F.sum("belief").alias("more"))
            scored = scored.join(given, ["pattern", "kind"], "left").withColumn("believed", F.coalesce("more", F.lit(0.0)))
        confident = scored.withColumn("confidence", (F.col("seeds") + F.col("believed")) / F.col("total")).where(F.col("confidence") >= PATTERN_LEAST).select("pattern", F.col("kind"), "confidence")
        named = spread_join(unseen, confident, ["pattern"], busy_patterns)
        doubt = F.sum(F.log(1 - F.least("confidence", F.lit(0.999))))
        found = named.where(shaped(F.col("kind"), F.col("value"))).groupBy("value", "kind").agg((1 - F.exp(doubt)).alias("belief"))
        beliefs = settle(found, f"beliefs-{k}")
    # a value that two kinds claim goes to the likelier, then the first by name
    first = Window.partitionBy("value").orderBy(F.col("belief").desc(), "kind")
    return beliefs.where(F.col("belief") >= INSTANCE_LEAST).withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def extract(docs: DataFrame, seeds: int = SEEDS, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows (doc_id, mark) of ``docs``; spans (doc_id, mark, kind, start, end, value, base) of distinct rows."""
    found = settle(matches(columns(docs, doc_id="long", text="string")), "matches")
    own = settle(occurrences(found), "occurrences")
    named = settle(discovered(own, seeds, rounds), "discovered")
    unseen = own.where("kind IS NULL").select("doc_id", "mark", "start", "end", "value")
    # a value that is named stands in as many rows as it likes; names alone are repeated
    counted = unseen.join(named.select("value"), "value", "left_semi")
    added = spread_join(unseen, named.select("value", "kind"), ["value"], hot(counted, "value", "busy-names"))
    spans = own.where("kind IS NOT NULL").select("doc_id", "mark", "kind", "start", "end", "value", F.lit(True).alias("base"))
    return found.select("doc_id", "mark"), spans.unionByName(added.select("doc_id", "mark", "kind", "start", "end", "value", F.lit(False).alias("base")))


def digest(spans: Column) -> Column:
    """kind:start:end of an array of (start, order, end), by start and then kind as listed."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda r: F.concat_ws(":", F.get(names, r["order"]), r["start"], r["end"])), ",")


def annotate(docs: DataFrame, seeds: int = SEEDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row of ``docs``; the counts are of base spans."""
    rows, spans = extract(docs, seeds, rounds)
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    # a document's own spans, no more
    per = spans.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", order.alias("order"), "end", "base")).alias("all"))
    per = per.withColumnsRenamed({"doc_id": "own_id", "mark": "own_mark"})
    joined = rows.join(per, rows["doc_id"].eqNullSafe(F.col("own_id")) & rows["mark"].eqNullSafe(F.col("own_mark")), "left")
    every = F.coalesce("all", F.expr("cast(array() as array<struct<start: bigint, order: int, end: bigint, base: boolean>>)"))
    joined = joined.select("doc_id", every.alias("every")).withColumn("base", F.filter("every", lambda r: r["base"]))

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda r: r["order"] == k)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return joined.select("doc_id", *counts, F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("every")).alias("spans"), (F.size("every") - F.size("base")).cast("long").alias("n_added"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate(table(spark, sf_dir, "documents"))
