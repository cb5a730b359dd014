"""Cases in which an operator did less than its whole job."""

import random

import numpy as np
import pyarrow as pa

from orebody.llm import decontaminate, near_vectors, toxicity


def test_slack_without_a_linked_vector_covers_the_threshold(spark):
    """Where no sampled vector has a link, pairs at cosine 0.951 are still found from either end."""
    r = np.random.default_rng(5)
    x = r.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = near_vectors.k_means(x[:, :32], 64), near_vectors.k_means(x[:, 32:], 64)

    def home(y):
        return near_vectors.squared(y[:, :32], books[0]).argmin(axis=1) * len(books[1]) + near_vectors.squared(y[:, 32:], books[1]).argmin(axis=1)

    rows = [(int(c), i, bytearray(v.tobytes())) for i, (c, v) in enumerate(zip(home(x), x))]
    slack = near_vectors.calibrate(spark.createDataFrame(rows, "cell long, cls long, raw binary"), "<f8", books)
    x = x[:1000]
    u = r.normal(size=x.shape)
    u -= (u * x).sum(axis=1, keepdims=True) * x
    y = 0.951 * x + np.sqrt(1 - 0.951**2) * u / np.linalg.norm(u, axis=1, keepdims=True)
    needed = [np.diagonal(near_vectors.beyond_first(a, books, home(b))) for a, b in ((x, y), (y, x))]
    assert (np.minimum(*needed) <= slack).mean() >= 0.99


def test_toxic_texts_with_a_shared_footer_are_learned_from():
    """Texts of both labels that share a footer are no copies; copies of one text count once."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    footer = " ".join(words[:60])
    clean = [" ".join(r.choices(words, k=80)) + " " + footer for _ in range(150)]
    toxic = [" ".join(r.choices(words, k=40) + ["zzorkz"] + r.choices(words, k=40)) + " " + footer for _ in range(50)]
    copies = [" ".join(words[100:200]) + f" mmildm x{k}" for k in range(30)]
    table = pa.table({"text": clean + toxic + copies, "label": pa.array([0] * 150 + [1] * 80, pa.int32())})
    model = toxicity.fit(table)
    tokens = toxicity.tokens_of(pa.array(["zzorkz", "mmildm"]))
    p = toxicity.token_marginals(model, tokens)
    assert p[0] > 0.5 > p[1]


def test_items_that_repeat_themselves_are_found(spark):
    """Items of 1,000 words with about ten distinct shingles each lie whole in long documents."""
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(5000)]
    items = [(k, " ".join(r.sample(words, 10) * 100)) for k in range(30)]
    docs = [(k, " ".join(r.choices(words, k=1500)) + " " + text + " " + " ".join(r.choices(words, k=1500))) for k, text in items]
    docs += [(100 + k, " ".join(text.split(" ")[:14]) + " " + " ".join(r.choices(words, k=2000))) for k, text in items]
    got = decontaminate.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(g.doc_id, g.item_id): g.containment for g in got} == {(k + n, k): 1.0 for k in range(30) for n in (0, 100)}
