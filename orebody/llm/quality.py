"""Quality: a linear-chain conditional random field over the lines of a document.

Every line is good or bad.  Its features describe the line and its neighbours; neighbouring
states are linked.  The field is trained on labelled documents: a line classifier learned
from the documents' labels first picks the bad lines of the bad documents, then the field
is fitted to those states by its likelihood.  Forward-backward marginals, weighted by the
lines' lengths, add up to the document's share of bad text, and a logistic curve fitted to
the labels turns that share into a score.

Defined results: null, empty and blank texts have no line and get the score of a document
without bad text; without labels of both kinds the score is the labels' smoothed rate;
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

from .chain import Field, logistic, marginals, messages, observed_pairs, pair_marginals, sigmoid
from .labelled import pieces, remainder, sample
from .shared import columns
from .textnp import SPACE, as_bytes, prefix_hash, rows_of, slices, span_hash, spans

FOLDS, HELD_OUT = 3, 1
NEWLINE = np.zeros(256, bool)
NEWLINE[ord("\n")] = True


def _table(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


#: Kinds of bytes whose share of a line is a feature.
KINDS = [
    _table(bytes(range(ord("A"), ord("Z") + 1))),
    _table(bytes(range(ord("a"), ord("z") + 1))),
    _table(b"0123456789"),
    _table(b".,"),
    _table(b"!?"),
    _table(b"|"),
    _table(b"#$%&*@^~=+<>{}[]\\/_"),
    _table(b":;()\"'-"),
    _table(bytes(range(128, 256))),
    SPACE,
]


@dataclass
class Lines:
    """The lines of a run of texts: features, lengths, and each text's first line."""

    features: np.ndarray
    lengths: np.ndarray
    bounds: np.ndarray


def lines_of(column: pa.Array) -> Lines:
    data, offsets = as_bytes(column)
    starts, ends = spans(data, offsets, NEWLINE)
    word_starts, word_ends = spans(data, offsets, SPACE)
    first_word = np.searchsorted(word_starts, starts)
    last_word = np.searchsorted(word_starts, ends)
    on = last_word > first_word  # a blank line is none
    starts, ends, first_word, last_word = starts[on], ends[on], first_word[on], last_word[on]
    row = rows_of(starts, offsets)
    bounds = np.searchsorted(row, np.arange(len(offsets)))
    length = (ends - starts).astype(float)
    columns_ = []
    for kind in KINDS:
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(kind[data], out=total[1:])
        columns_.append((total[ends] - total[starts]) / np.maximum(length, 1))
    words = (last_word - first_word).astype(float)
    hashes = span_hash(prefix_hash(data), word_starts, word_ends)

    def share(flags: np.ndarray, below: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return (total[last_word] - total[np.minimum(first_word, last_word)]) / np.maximum(below, 1)

    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    skip = np.zeros(len(hashes), bool)
    skip[2:] = hashes[2:] == hashes[:-2]
    size = (word_ends - word_starts).astype(float)
    # a word that stands earlier in the same line
    line = np.repeat(np.arange(len(starts)), last_word - first_word)
    flat = hashes[np.repeat(first_word - np.concatenate([[0], np.cumsum(words[:-1])]).astype(int), words.astype(int)) + np.arange(len(line))] if len(line) else hashes[:0]
    order = np.lexsort((flat, line))
    again = np.zeros(len(order), bool)
    again[1:] = (flat[order][1:] == flat[order][:-1]) & (line[order][1:] == line[order][:-1])
    repeats = np.bincount(line[order], weights=again, minlength=len(starts)) / np.maximum(words, 1)
    columns_ += [
        share(same, words),
        share(skip, words),
        repeats,
        share(size, words) / 10,
        share(size <= 1, words),
        np.log1p(words) / 5,
        np.log1p(length) / 8,
        (data[np.maximum(ends - 1, 0)] == ord(".")).astype(float) if len(ends) else np.zeros(0),
        (words <= 3).astype(float),
    ]
    own = np.stack(columns_, axis=1) if len(starts) else np.zeros((0, len(KINDS) + 9))
    # neighbours within the text; none is all zeros with a flag
    before, after = np.zeros_like(own), np.zeros_like(own)
    if len(own) > 1:
        before[1:], after[:-1] = own[:-1], own[1:]
    edge = np.zeros((len(own), 2))
    inner = bounds[:-1][bounds[:-1] < bounds[1:]]
    before[inner], edge[inner, 0] = 0, 1
    ends_at = bounds[1:][bounds[:-1] < bounds[1:]] - 1
    after[ends_at], edge[ends_at, 1] = 0, 1
    near = [0, 4, 5, 6, len(KINDS), len(KINDS) + 2]
    features = np.concatenate([own, own[:, : len(KINDS) + 5] ** 2, before[:, near], after[:, near], edge, np.ones((len(own), 1))], axis=1)
    return Lines(features, length, bounds)


@dataclass
class Model:
    field: Field | None
    curve: np.ndarray
    rate: float


def evidence(model: Model, lines: Lines) -> np.ndarray:
    """Per text: length-weighted share of bad text, its root, the worst line, and the constant."""
    n = len(lines.bounds) - 1
    bad = marginals(lines.features @ model.field.weights, lines.bounds, model.field.edges) if len(lines.features) else np.zeros(0)
    row = np.repeat(np.arange(n), np.diff(lines.bounds))
    weight = np.bincount(row, weights=lines.lengths, minlength=n)
    share = np.bincount(row, weights=lines.lengths * bad, minlength=n) / np.maximum(weight, 1)
    worst = np.zeros(n)
    np.maximum.at(worst, row, bad)
    return np.stack([share, np.sqrt(share), worst, np.ones(n)], axis=1)


def fit_field(lines: Lines, states: np.ndarray, start: np.ndarray, rounds: int = 60) -> Field:
    """Maximum likelihood of the states, by gradient steps scaled by their own history."""
    weights, edges = start.copy(), np.zeros((2, 2))
    memory_w, memory_e = np.full(len(weights), 1e-8), np.full((2, 2), 1e-8)
    seen = observed_pairs(states, lines.bounds)
    total = max(1, len(states))
    for _ in range(rounds):
        e, f, b = messages(lines.features @ weights, lines.bounds, edges)
        p = f * b / (1 + f * b)
        t = np.exp(edges - edges.max())
        grad_w = lines.features.T @ (states - p) / total - 1e-4 * weights
        grad_e = (seen - pair_marginals(e, f, b, lines.bounds, t)) / total - 1e-4 * edges
        memory_w += grad_w**2
        memory_e += grad_e**2
        weights += 0.3 * grad_w / np.sqrt(memory_w)
        edges += 0.1 * grad_e / np.sqrt(memory_e)
    return Field(weights, edges)


def fit(table: pa.Table) -> Model:
    """The model of labelled texts (text, label: 1 is good)."""
    good = np.array(table.column("label").to_pylist(), float)
    rate = (good.sum() + 1) / (len(good) + 2)
    if len(set(good)) < 2:
        return Model(None, np.zeros(4), rate)
    parts = [lines_of(part.column("text")) for part in pieces(table)]
    sizes = np.concatenate([np.diff(p.bounds) for p in parts])
    lines = Lines(np.concatenate([p.features for p in parts]), np.concatenate([p.lengths for p in parts]), np.concatenate([[0], np.cumsum(sizes)]))
    row = np.repeat(np.arange(len(good)), np.diff(lines.bounds))
    y = 1 - good[row]
    # twice: once the documents' labels, once the lines that those already tell apart
    weights = logistic(lines.features, y, ridge=0.5)
    for _ in range(2):
        p = sigmoid(lines.features @ weights)
        worst = np.zeros(len(good))
        np.maximum.at(worst, row, p)
        states = ((p >= 0.5) | (p >= worst[row])) & (y > 0)
        weights = logistic(lines.features, states.astype(float), ridge=0.5)
    field = fit_field(lines, states.astype(np.int64), weights)
    model = Model(field, np.zeros(4), rate)
    model.curve = logistic(evidence(model, lines), good, ridge=0.05)
    return model


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row, 1 for good."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                if model.field is None:
                    score = np.full(part.num_rows, model.rate)
                else:
                    score = sigmoid(evidence(model, lines_of(part.column("text"))) @ model.curve)
                yield pa.record_batch({"doc_id": part.column("doc_id"), "score": pa.array(score, pa.float64())})

    return columns(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, score double")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(sample(docs, labels, "quality", remainder(F.col("doc_id"), FOLDS) != HELD_OUT))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_texts(docs, train(docs, labels))
    held = F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with all their columns: those that :func:`classify` predicts as 1.

    Without labels of both kinds that is all documents or none, by the labels' smoothed rate.
    """
    model = train(docs, labels)
    names = list(docs.columns)
    text_at = [c.lower() for c in names].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, names[text_at]):
                if model.field is None:
                    score = np.full(part.num_rows, model.rate)
                else:
                    score = sigmoid(evidence(model, lines_of(part.column(text_at))) @ model.curve)
                yield part.filter(pa.array(score >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
