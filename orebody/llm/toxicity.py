"""Toxicity: a linear-chain conditional random field over the tokens of a document.

Tokens are runs of bytes without blanks and ASCII marks, with A-Z folded.  A token's
features are hashes of the whole token and of its first and last bytes.  Labels are per
document, so the tokens of toxic training documents that are labelled toxic are those
with a feature that clean documents practically never have (a binomial test); the field is
then fitted to the tokens' states by its likelihood.  Forward-backward marginals give
spans of offending tokens, and a logistic curve over a document's marginals gives its score.

Defined results: null, empty and blank texts have no token and get the score of a text
without a toxic one; without labels of both kinds the score is the labels' smoothed rate;
rows that repeat an id are scored each; a null doc_id is kept and is not held out; an
empty table gives an empty result.  Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chain import logistic, marginals, messages, observed_pairs, pair_marginals, sigmoid
from .labelled import pieces, remainder, sample
from .near_join import COMPARED, STEP, THRESHOLD, TOLERANCE, forest, least_matches, linked_pairs, sets_of
from .shared import columns
from .textnp import SPACES, as_bytes, prefix_hash, rows_of, slices, span_hash, spans

FOLDS, HELD_OUT = 5, 0
#: Features are hashed into so many weights.
WEIGHTS = 1 << 20
#: Bytes of a token's beginning and end that are features.
HEADS, TAILS = (3, 4, 5, 6), (4, 5)
#: A feature marks toxic tokens if chance would place it in toxic documents alone less often than this.
CHANCE = 1e-5
#: Spans cover neighbouring tokens whose marginal is at least this.
SPAN_LEVEL = 0.5

GAP = np.zeros(256, bool)
GAP[list(SPACES) + [c for c in range(33, 127) if not chr(c).isalnum()]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32


@dataclass
class Tokens:
    features: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    offsets: np.ndarray


def tokens_of(column: pa.Array) -> Tokens:
    data, offsets = as_bytes(column)
    data = FOLD[data]
    starts, ends = spans(data, offsets, GAP)
    prefix = prefix_hash(data)
    size = ends - starts
    kinds = [span_hash(prefix, starts, ends)]
    whole = kinds[0]
    for k, n in enumerate(HEADS, 1):
        kinds.append(np.where(size > n, span_hash(prefix, starts, np.minimum(starts + n, ends)) + np.uint64(k), whole + np.uint64(k)))
    for k, n in enumerate(TAILS, 11):
        kinds.append(np.where(size > n, span_hash(prefix, np.maximum(ends - n, starts), ends) + np.uint64(k), whole + np.uint64(k)))
    shift = np.uint64(64 - 20)
    features = np.stack([((x * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int32) for x in kinds], axis=1)
    row = rows_of(starts, offsets)
    return Tokens(features, starts, ends, np.searchsorted(row, np.arange(len(offsets))), offsets)


@dataclass
class Model:
    weights: np.ndarray | None
    bias: float
    edges: np.ndarray
    curve: np.ndarray
    rate: float


def near_copies(table: pa.Table) -> np.ndarray:
    """Each row's group of copies and near copies: texts of one label with a Jaccard of 0.8 on five-word shingles.

    Pairs are pruned on MinHash values as in the near join and verified on the exact sets.
    """
    own: list[np.ndarray] = []
    for part in pieces(table):
        shingles, bounds = sets_of(part)
        own += [shingles[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    label = np.array(table.column("label").to_pylist(), np.int64)
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    limits = least_matches(THRESHOLD[0] / THRESHOLD[1], TOLERANCE, STEP, COMPARED)
    for value in np.unique(label):
        rows = np.flatnonzero((label == value) & np.array([len(x) > 0 for x in own], bool))
        if len(rows):
            every = np.arange(len(rows))
            ends += [(rows[i], rows[j]) for i, j in linked_pairs([own[r] for r in rows], every, every, limits)]
    if not ends:
        return np.arange(len(table))
    return forest(len(table), *(np.concatenate(x) for x in zip(*ends)))


def training_tokens(table: pa.Table) -> Tokens:
    """The tokens of all the table's texts, made a slice at a time; places are not kept."""
    parts = [tokens_of(part.column("text")) for part in pieces(table)]
    sizes = np.concatenate([np.diff(t.bounds) for t in parts])
    none = np.zeros(0, np.int64)
    return Tokens(np.concatenate([t.features for t in parts]), none, none, np.concatenate([[0], np.cumsum(sizes)]), none)


def token_states(tokens: Tokens, toxic: np.ndarray, group: np.ndarray) -> np.ndarray:
    """1 for tokens of toxic texts with a feature that clean texts practically never have.

    A feature counts once for each ``group`` of near copies, whose common words would pass
    for toxic ones; the texts of a group have one label.
    """
    row = np.repeat(np.arange(len(toxic)), np.diff(tokens.bounds))
    marked = np.zeros(len(row), bool)
    rate = np.clip(toxic[np.unique(group)].mean(), 0.02, 0.98)
    for k in range(tokens.features.shape[1]):
        own = tokens.features[:, k].astype(np.int64)
        pairs = np.unique(own * len(toxic) + group[row])
        feature, text = pairs // len(toxic), pairs % len(toxic)
        bad = np.bincount(feature[toxic[text] == 1], minlength=WEIGHTS)
        good = np.bincount(feature[toxic[text] == 0], minlength=WEIGHTS)
        # toxic texts that have it, less those that its clean ones would explain many times over
        sure = np.maximum(bad - 40 * good * rate / (1 - rate), 0) * np.log(1 / rate) >= np.log(1 / CHANCE)
        marked |= sure[own]
    return (marked & (toxic[row] == 1)).astype(np.int64)


def token_scores(features: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    scores = np.full(len(features), bias)
    for k in range(features.shape[1]):
        scores += weights[features[:, k]]
    return scores


def fit_field(tokens: Tokens, states: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, float, np.ndarray]:
    """Maximum likelihood of the states, by gradient steps scaled by their own history."""
    weights, edges = np.zeros(WEIGHTS), np.zeros((2, 2))
    total = max(1, len(states))
    rate = np.clip(states.mean(), 1e-6, 0.5)
    bias = float(np.log(rate / (1 - rate)))
    memory_w, memory_e, memory_b = np.full(WEIGHTS, 1e-12), np.full((2, 2), 1e-8), 1e-8
    seen = observed_pairs(states, tokens.bounds)
    for _ in range(rounds):
        e, f, b = messages(token_scores(tokens.features, weights, bias), tokens.bounds, edges)
        p = f * b / (1 + f * b)
        t = np.exp(edges - edges.max())
        miss = (states - p) / total
        grad_w = -1e-7 * weights
        for k in range(tokens.features.shape[1]):
            grad_w += np.bincount(tokens.features[:, k], weights=miss, minlength=WEIGHTS)
        grad_e = (seen - pair_marginals(e, f, b, tokens.bounds, t)) / total - 1e-5 * edges
        memory_w += grad_w**2
        memory_e += grad_e**2
        memory_b += miss.sum() ** 2
        weights += 0.4 * grad_w / np.sqrt(memory_w)
        edges += 0.1 * grad_e / np.sqrt(memory_e)
        bias += 0.1 * miss.sum() / np.sqrt(memory_b)
    return weights.astype(np.float32), bias, edges


def token_marginals(model: Model, tokens: Tokens) -> np.ndarray:
    return marginals(token_scores(tokens.features, model.weights, model.bias), tokens.bounds, model.edges)


def evidence(tokens: Tokens, p: np.ndarray) -> np.ndarray:
    """Per text: the most toxic token, the (log) number of toxic tokens, and the constant."""
    n = len(tokens.bounds) - 1
    row = np.repeat(np.arange(n), np.diff(tokens.bounds))
    worst = np.zeros(n)
    np.maximum.at(worst, row, p)
    sure = np.bincount(row, weights=np.where(p >= 0.2, p, 0), minlength=n)
    return np.stack([worst, np.log1p(sure), np.ones(n)], axis=1)


def fit(table: pa.Table) -> Model:
    """The model of labelled texts (text, label: 1 is toxic)."""
    toxic = np.array(table.column("label").to_pylist(), np.int64)
    rate = (toxic.sum() + 1) / (len(toxic) + 2)
    if len(set(toxic.tolist())) < 2:
        return Model(None, 0.0, np.zeros((2, 2)), np.zeros(3), rate)
    tokens = training_tokens(table)
    weights, bias, edges = fit_field(tokens, token_states(tokens, toxic, near_copies(table)))
    model = Model(weights, bias, edges, np.zeros(3), rate)
    model.curve = logistic(evidence(tokens, token_marginals(model, tokens)), toxic.astype(float), ridge=0.05)
    return model


SPAN_DDL = "array<struct<start: int, end: int, marginal: double>>"


def spans_of(tokens: Tokens, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end, largest marginal) of maximal runs of toxic tokens, in bytes of the text."""
    row = np.repeat(np.arange(len(tokens.bounds) - 1), np.diff(tokens.bounds))
    on = np.flatnonzero(p >= SPAN_LEVEL)
    if not len(on):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
    cut = np.ones(len(on), bool)
    cut[1:] = (on[1:] != on[:-1] + 1) | (row[on[1:]] != row[on[:-1]])
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(on)) - 1
    text = row[on[first]]
    return text, tokens.starts[on[first]] - tokens.offsets[text], tokens.ends[on[last]] - tokens.offsets[text], np.maximum.reduceat(p[on], first)


def tag(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, spans) of every row; spans are offsets in the text's UTF-8 bytes."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a table of WEIGHTS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))
        for batch in batches:
            for part in slices(batch):
                found: list[list] = [[] for _ in range(part.num_rows)]
                if model.weights is None:
                    score = np.full(part.num_rows, model.rate)
                else:
                    tokens = tokens_of(part.column("text"))
                    p = token_marginals(model, tokens)
                    score = sigmoid(evidence(tokens, p) @ model.curve)
                    for text, a, b, m in zip(*spans_of(tokens, p)):
                        found[text].append({"start": int(a), "end": int(b), "marginal": float(m)})
                yield pa.record_batch({"doc_id": part.column("doc_id"), "score": pa.array(score, pa.float64()), "spans": pa.array(found, kind)})

    return columns(docs, doc_id="long", text="string").mapInArrow(run, f"doc_id long, score double, spans {SPAN_DDL}")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(sample(docs, labels, "toxic", remainder(F.col("doc_id"), FOLDS) != HELD_OUT))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = tag(docs, train(docs, labels))
    held = F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
