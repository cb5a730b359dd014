"""The pure parts of the operators against plain definitions."""

import random
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orebody.llm import chain, html_extract, near_join, near_vectors, quality, repeats, textnp, tokens, toxicity


def test_words_and_shingles():
    texts = ["a b c d e f", "", None, "  x\ty\n", "é\x0bß  z w q r"]
    data, offsets = textnp.as_bytes(pa.array(texts))
    hashes, row, bounds = textnp.word_hashes(data, offsets)
    assert np.diff(bounds).tolist() == [6, 0, 0, 2, 6]
    again = textnp.word_hashes(*textnp.as_bytes(pa.array(["q r z x a"])))[0]
    assert again[3] == hashes[6] and again[4] == hashes[0] and again[0] == hashes[12]
    runs, run_bounds = textnp.shingle_hashes(hashes, bounds)
    assert np.diff(run_bounds).tolist() == [2, 0, 0, 1, 2]
    assert textnp.shingle_hashes(*(lambda h: (h[0], h[2]))(textnp.word_hashes(*textnp.as_bytes(pa.array(["x y"])))))[0][0] == runs[2]


def test_slices_keep_every_row():
    texts = ["a" * n for n in (5, 0, 30, 3, 3)] + [None]
    batch = pa.record_batch({"text": pa.array(texts)})
    got = [t for part in textnp.slices(batch, limit=8) for t in part.column("text").to_pylist()]
    assert got == texts
    assert list(textnp.slices(batch.slice(0, 0))) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**17 - 1), max_size=300), st.integers(17, 32))
def test_packing_round_trip(ids, bits):
    packed = tokens.pack(np.array(ids, np.uint32), bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    assert tokens.unpack(packed, bits, len(ids)).tolist() == ids
    a = len(ids) // 3
    assert tokens.unpack(packed, bits, len(ids) - a, a).tolist() == ids[a:]


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    path = tokens.default_tokenizer()
    whole, encode = Tokenizer.from_file(path), tokens.encoder(path)
    r = random.Random(1)
    letters = list("aAbßÉé'’.,!|#$&*%<>\n \t\x0b\x0c\x1c\x1d\x85\xa0 Σσςİıńń̇Ǆǆ12½三字ก็‍’stͅͅΆ") + ["<|endoftext|>", "'s", "'ll", "..."]
    for _ in range(4000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 14)))
        assert np.frombuffer(encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, unicodedata.normalize("NFD", text)


@pytest.mark.parametrize("n", [1, 2, 130, 300, 700])
def test_chain_marginals_are_exact(n):
    r = np.random.default_rng(n)
    s, edges = r.normal(size=n) * 2, r.normal(size=(2, 2))
    node = np.stack([np.zeros(n), s], 1)
    a, b = np.zeros((n, 2)), np.zeros((n, 2))
    a[0] = node[0]
    for t in range(1, n):
        a[t] = node[t] + np.logaddexp(a[t - 1, 0] + edges[0], a[t - 1, 1] + edges[1])
    for t in range(n - 2, -1, -1):
        b[t] = np.logaddexp(edges[:, 0] + node[t + 1, 0] + b[t + 1, 0], edges[:, 1] + node[t + 1, 1] + b[t + 1, 1])
    z = a + b
    want = 1 / (1 + np.exp(z[:, 0] - z[:, 1]))
    scores = np.concatenate([r.normal(size=77), s, r.normal(size=400)])
    got = chain.marginals(scores, np.array([0, 77, 77, 77 + n, 477 + n]), edges)[77 : 77 + n]
    assert np.abs(got - want).max() < 1e-9


@pytest.mark.parametrize("n,letters", [(1500, 2), (2500, 26), (900, 1)])
def test_suffix_array_and_common_prefixes(n, letters):
    r = np.random.default_rng(letters)
    data = r.integers(97, 97 + letters, n).astype(np.uint8)
    data[n // 2 : n // 2 + 300] = data[50:350]
    raw = data.tobytes()
    order = repeats.suffix_array(data)
    assert order.tolist() == sorted(range(n), key=lambda i: raw[i:])

    def common(i, j):
        k = 0
        while k < 400 and max(i, j) + k < n and raw[i + k] == raw[j + k]:
            k += 1
        return k

    got = repeats.common_prefixes(data, order, 400, lane=100)
    assert all(got[k] == common(order[k - 1], order[k]) for k in range(1, n))


def test_pruning_keeps_pairs_at_the_threshold():
    limits = near_join.least_matches(0.8, 1e-6, 16, 64)
    assert limits[64] < 0.8 * 64 and limits[64] > 20
    r = np.random.default_rng(0)
    base = np.unique(r.integers(0, 2**63, 900).astype(np.uint64))
    sets = [base[:800], base[:640], base[:639], base[100:900]]
    found = {(i, j) for a, b in near_join.linked_pairs(sets, *(lambda x: (x, x))(np.arange(4)), limits) for i, j in zip(a.tolist(), b.tolist())}
    jac = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert found == {(i, j) for i in range(4) for j in range(i + 1, 4) if jac(sets[i], sets[j]) >= 0.8 - 1e-12}


def test_exact_shared_both_ways():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, 40).astype(np.uint64)) for _ in range(20)]
    i, j = map(np.array, zip(*[(a, b) for a in range(20) for b in range(a + 1, 20)]))
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)]
    assert near_join.exact_shared(sets, i, j).tolist() == want
    assert near_join.exact_shared(sets, i[:5], j[:5]).tolist() == want[:5]


def test_traversal_visits_in_order_of_distance():
    r = np.random.default_rng(2)
    x = r.normal(size=(30, 8))
    books = (r.normal(size=(6, 4)), r.normal(size=(5, 4)))
    q, c = near_vectors.visits(x, books, 1.5)
    beyond = near_vectors.beyond_first(x, books, np.arange(30))
    assert {(a, b) for a, b in zip(q.tolist(), c.tolist())} == {(a, b) for a in range(30) for b in range(30) if beyond[a, b] <= 1.5}


@pytest.mark.parametrize(
    "html,text",
    [
        ("", ""),
        ("plain text only", "plain text only"),
        ("<script>x<p>y</script", ""),
        ("<article><p>a &lt;b&gt; &amp;amp; c&nbsp;d</p><form>Name <input> <button>Send</button></form></article>", "a <b> &amp; c d"),
        ('<html><body><nav><ul><li><a href="/">Home</a></li></ul></nav><article><h1>Title</h1><p>One <b>two</b>\n three<br>four.<p>Next one.</article><footer>&copy; x</footer></body></html>', "Title\nOne two three four.\nNext one."),
        ("<body><article><p>Text of the article, long enough to stand.</p></article><div class='comments'><p>I like it.</p></div></body>", "Text of the article, long enough to stand."),
    ],
)
def test_page_text(html, text):
    assert html_extract.extract_texts([html], html_extract.default_model()) == [text]


def test_tree_marginals_are_exact():
    r = np.random.default_rng(4)
    parent = np.array([-1, 0, 0, 1, 1, 2, 5, 5])
    depth = np.array([0, 1, 1, 2, 2, 2, 3, 3])
    score, t = r.normal(size=8), np.exp(r.normal(size=(2, 2)))
    inside, _, down = html_extract.tree_messages(score, parent, depth, t)
    got = 1 / (1 + np.exp(-(inside + down)))
    total, one = 0.0, np.zeros(8)
    for code in range(256):
        y = [(code >> k) & 1 for k in range(8)]
        w = np.exp(sum(score[k] * y[k] for k in range(8))) * np.prod([t[y[parent[k]], y[k]] for k in range(1, 8)])
        total += w
        one += w * np.array(y)
    assert np.abs(got - one / total).max() < 1e-12


def test_labelled_pages_held_out():
    from orebody.llm.html_pages import labelled_pages

    model, right, total = html_extract.default_model(), 0, 0
    for html in labelled_pages(80, seed=1234):
        page = html_extract.parse(html, labelled=True)
        p, _ = model.marginals([page])
        right += sum((p[k] >= 0.5) == (page.labels[k] == 1) for k, _, _ in page.blocks)
        total += len(page.blocks)
    assert right / total > 0.97


def test_classifiers_without_labels():
    none = pa.table({"text": pa.array([], pa.string()), "label": pa.array([], pa.int32())})
    one = pa.table({"text": ["a", "b"], "label": pa.array([1, 1], pa.int32())})
    assert quality.fit(none).rate == 0.5 and quality.fit(one).rate == 0.75
    assert toxicity.fit(none).rate == 0.5 and toxicity.fit(one).weights is None


def test_crc_of_ids_is_little_endian():
    assert zlib.crc32(np.array([2], "<u4").tobytes()) == zlib.crc32(b"\x02\x00\x00\x00")


def test_words_encode_like_whole_texts():
    import random

    from tokenizers import Tokenizer

    whole, encode = Tokenizer.from_file(tokens.default_tokenizer()), tokens.encoder(tokens.default_tokenizer())
    r = random.Random(3)
    letters = [chr(c) for c in range(0x61, 0x24F) if chr(c).isalpha()] + list("αβγσςжщ中文ßŉǆᾴİıΣ")
    texts = [" ".join("".join(r.choice(letters) for _ in range(r.randint(1, 9))) + r.choice(["", ",", ".", "!?", "'s", "7x"]) for _ in range(40)) for _ in range(300)]
    texts += ["été café", "ÉTÉ Été", "a b c\x85d", "x\x1cy"]
    assert all(np.frombuffer(encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids for t in texts)
