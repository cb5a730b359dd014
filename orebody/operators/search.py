"""Text, code and vector search."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orebody.functions.expressions import contains_text, cosine, problem_codes
from orebody.functions.vocabulary import PROBLEM_WORDS, PROBLEMS, problem_category
from orebody.sources.files import upsert
from orebody.sources.scratch import settle

#: Accented letters and their plain ones.
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
K1, B = 1.2, 0.75


def folded(text: Column) -> Column:
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), *ACCENTS)


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits without accents."""
    return F.array_remove(F.split(folded(text), "[^a-z0-9]+"), "")


def query_terms(query: list[str]) -> list[str]:
    """The words of a query, folded and cut like the texts."""
    folded = (text.lower().translate(str.maketrans(*ACCENTS)) for text in query)
    return list(dict.fromkeys(w for text in folded for w in re.findall("[a-z0-9]+", text)))


def _weight(tf: Column, df: Column, n: Column, length: Column, mean: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def bm25(docs: DataFrame, key: str, text: str, query: list[str], k: int) -> DataFrame:
    """(key, score) of the k best documents; documents without a term have no row.

    Query terms are folded like the texts, and cut where the texts are.  One pass counts
    them in each document's words, so nothing is exploded: a few numbers a document, one row
    of corpus statistics beside them.  A corpus that is asked often is indexed once
    (:func:`postings`) and asked by :func:`bm25_of_index`.
    """
    terms = query_terms(query)
    words = docs.select(key, F.array_remove(F.split(folded(F.col(text)), "[^a-z0-9]+"), "").alias("__words"))
    counts = [(F.size("__words") - F.size(F.array_remove("__words", t))).alias(f"tf{i}") for i, t in enumerate(terms)]
    # the texts are read once: statistics and scores both come from the counts
    counted = settle(words.select(key, F.size("__words").alias("length"), *counts), "term-counts")
    stats = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        score = score + _weight(F.col(f"tf{i}"), F.col(f"df{i}"), F.col("n"), F.col("length"), F.col("mean"))
    if not terms:
        return counted.select(key, score.alias("score")).limit(0)
    any_term = F.greatest(F.lit(0), F.lit(0), *[F.col(f"tf{i}") for i in range(len(terms))]) > 0
    # the statistics are a single row
    scored = counted.where(any_term).crossJoin(F.broadcast(stats)).select(key, score.alias("score"))
    return scored.orderBy(F.col("score").desc(), key).limit(k)


def bm25_of_index(index: DataFrame, lengths: DataFrame, key: str, query: list[str], k: int) -> DataFrame:
    """(key, score) of the k best documents from ``postings`` and ``lengths``; only the query's terms are read."""
    own = index.where(F.col("term").isin(*query_terms(query)))
    stats = lengths.agg(F.sum("n").alias("n"), (F.sum("words") / F.sum("n")).alias("mean"))
    frequency = own.groupBy("term").agg(F.count("*").alias("df"))
    # a row for each term of the query, and a single row
    joined = own.join(F.broadcast(frequency), "term").crossJoin(F.broadcast(stats))
    weight = _weight(F.col("tf"), F.col("df"), F.col("n"), F.col("length"), F.col("mean"))
    return joined.groupBy(key).agg(F.sum(weight).alias("score")).orderBy(F.col("score").desc(), key).limit(k)


def lengths(docs: DataFrame, text: str) -> DataFrame:
    """(length, n, words): documents and words by length, a small table beside the index."""
    return docs.select(F.size(tokens(F.col(text))).alias("length")).groupBy("length").agg(F.count("*").alias("n"), F.sum("length").alias("words"))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, tf, length): the inverted index, to be written once and searched often."""
    words = docs.select(F.col(key), tokens(F.col(text)).alias("words"))
    return words.select(key, F.size("words").alias("length"), F.explode("words").alias("term")).groupBy("term", key, "length").agg(F.count("*").alias("tf"))


def code_rows(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, code, name): each known code of a row's texts once."""
    found = F.array_distinct(F.concat(*[problem_codes(F.col(c)) for c in columns]))
    names = F.create_map(*[F.lit(x) for pair in PROBLEMS.items() for x in pair])
    return df.select(key, F.explode(found).alias("code")).withColumn("name", names[F.col("code")])


def code_histogram(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return code_rows(df, key, columns).groupBy("code").agg(F.count("*").alias("n"))


def snippet(text: Column, code: Column, around: int = 50) -> Column:
    """A code with up to ``around`` characters on either side."""
    at = F.position(code, text)
    start = F.greatest(F.lit(1), at - around)
    return F.when(at > 0, F.trim(F.substring(text, start, at - start + F.length(code) + around)))


def code_table(spark: SparkSession) -> DataFrame:
    """(code, name, category, words) of the problem codes."""
    rows = [(code, name, problem_category(code), list(PROBLEM_WORDS[code])) for code, name in PROBLEMS.items()]
    return spark.createDataFrame(rows, "code string, name string, category string, words array<string>")


def code_search(asked: DataFrame, key: str, text: str, limit: int = 3) -> DataFrame:
    """(key, code, name, score) of the ``limit`` best codes for each asked text; equal scores by code.

    100 for the code itself, 90 for a part of it, 50 more for a name and 30 more for a
    word that holds the text, case aside.  The codes are a fixed table beside each row.
    """
    codes = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(n).alias("name"), F.array(*[F.lit(w.lower()) for w in PROBLEM_WORDS[c]]).alias("words")) for c, n in PROBLEMS.items()])
    whole = F.col(text)
    low = F.trim(F.lower(whole))

    def score(c: Column) -> Column:
        by_code = F.when(c["code"] == whole, 100).when(F.contains(c["code"], whole), 90).otherwise(0)
        by_name = F.when(F.contains(F.lower(c["name"]), low), 50).otherwise(0)
        by_word = F.when(F.exists(c["words"], lambda w: F.contains(w, low)), 30).otherwise(0)
        return by_code + by_name + by_word

    scored = F.transform(codes, lambda c: F.struct((-score(c)).alias("less"), c["code"].alias("code"), c["name"].alias("name")))
    best = F.slice(F.array_sort(F.filter(scored, lambda r: r["less"] < 0)), 1, limit)
    found = asked.where(whole.isNotNull()).select(key, F.explode(best).alias("r"))
    return found.select(key, "r.code", "r.name", (-F.col("r.less")).alias("score"))


def codes_in_category(spark: SparkSession, category: str) -> DataFrame:
    """(code, name, category, words) of the codes whose category holds a text, case aside."""
    return code_table(spark).where(contains_text(F.col("category"), category))


#: Columns that a contextual filter may name, each a part of the text in it.
CONTEXT = ("field_name", "pod_name", "wk_name", "province", "basin128", "project_class", "project_stage", "project_level", "operator_name", "operator_group", "wk_subgroup", "wk_regionisasi_ngi", "wk_area_perwakilan_skkmigas")


def contextual(df: DataFrame, filters: dict[str, object]) -> Column:
    """All of the filters at once: report_year by equality, the columns of CONTEXT by a part of their text."""
    unknown = [c for c in filters if c not in (*CONTEXT, "report_year") or c not in df.columns]
    if unknown:
        raise ValueError(f"no such filter: {unknown}")
    out = F.lit(True)
    for name, value in filters.items():
        out = out & (F.col(name) == F.lit(value) if name == "report_year" else contains_text(F.col(name), str(value)))
    return out


def refresh_embeddings(kept: DataFrame | None, docs: DataFrame, keys: list[str], text: str, order: list[str], embed: Callable[[pd.Series], np.ndarray]) -> DataFrame:
    """The table of embeddings after ``docs``: one vector for each key, new ones in place of old ones.

    Of rows that repeat a key the first by ``order`` is embedded; rows without a text are not.
    """
    first = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    once = docs.where(F.length(text) > 0).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    fresh = embed_column(once, text, "embedding", embed)
    return fresh if kept is None else upsert(kept, fresh, keys, order)


def top_similar(vectors: DataFrame, key: str, column: str, query: list[float], k: int, where: Column | None = None) -> DataFrame:
    """(key, similarity) of the k most similar vectors, similarity to four places."""
    chosen = vectors if where is None else vectors.where(where)
    wanted = F.array(*[F.lit(float(x)) for x in query])
    scored = chosen.where(F.size(column) == len(query)).select(key, F.round(cosine(F.col(column), wanted), 4).alias("similarity"))
    return scored.where("similarity IS NOT NULL").orderBy(F.col("similarity").desc(), key).limit(k)


def hashing_embedder(size: int) -> Callable[[pd.Series], np.ndarray]:
    """Signed counts of hashed words, of unit length: an embedder that needs no model, where a function of texts is asked for."""

    def embed(texts: pd.Series) -> np.ndarray:
        out = np.zeros((len(texts), size), np.float32)
        for i, text in enumerate(texts):
            for word in (text or "").lower().split():
                code = zlib.crc32(word.encode())
                out[i, code % size] += 1 if code >> 31 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return embed


def hashed_vector(text: Column, size: int) -> Column:
    """The vector of :func:`hashing_embedder` as an expression, in double precision: words are runs without white space; a text without any is the zero vector."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), "")
    codes = F.transform(words, lambda w: F.crc32(w.cast("binary")))

    def counted(own: Column) -> Column:
        sign = lambda c: F.when(c >= 1 << 31, 1).otherwise(-1)
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(own, F.lit(0), lambda s, c: s + F.when(c % size == i, sign(c)).otherwise(0)))

    def scaled(own: Column) -> Column:
        norm = F.greatest(F.sqrt(F.aggregate(own, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-9))
        return F.element_at(F.transform(F.array(norm), lambda n: F.transform(own, lambda x: x / n)), 1)

    # what a lambda is given is computed once, not once for each number
    return F.element_at(F.transform(F.transform(F.array(codes), counted), scaled), 1)


def embed_column(df: DataFrame, text: str, name: str, embed: Callable[[pd.Series], np.ndarray]) -> DataFrame:
    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(list(embed(part)))

    return df.withColumn(name, run(F.col(text)))
