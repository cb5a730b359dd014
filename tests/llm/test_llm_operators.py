"""Operators on Spark against brute force, with nulls, empties, ties, repeats and odd columns."""

import base64
import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orebody.llm import decontaminate, html_extract, mixing, near_join, near_vectors, passages, quality, repeats, shared, tokens, toxicity, warc

R = random.Random(11)
WORDS = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 6))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(text, every, seed):
    r, words = random.Random(seed), text.split(" ")
    for k in range(every, len(words), every):
        words[k] = r.choice(WORDS) + "q"
    return " ".join(words)


def corpus():
    """Ids and texts: copies, near copies, shared passages, short, blank, null and very long texts."""
    base, passage = prose(200, 1), prose(120, 2)
    texts = [base, base, edited(base, 60, 3), edited(base, 70, 4), edited(base, 9, 5), prose(150, 6) + " " + passage, passage + " " + prose(30, 7), prose(40, 8) + " " + passage + " tail", passage[: len(passage) // 2]]
    texts += ["", None, "   \n\t ", "one two three", "one two three", "one two three four five", "one two three four five six", "é" * 900, "xyz " * 300, prose(6000, 9), prose(6000, 9) + " more"]
    texts += [prose(60 + k, 100 + k) for k in range(12)]
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, count int, rep string, row string, bands int, `key` string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", None if (i or 0) % 5 == 0 else f"s{(i or 0) % 3}", len(t or ""), 1, "x", "y", 2, "z") for i, t in rows], SCHEMA)


def shingles(text):
    w = [x for x in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components_of(ids, edges):
    label = {i: i for i in ids}
    while True:
        new = dict(label)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            return label
        label = new


def near_truth(rows):
    sets = {i: shingles(t) for i, t in rows}
    edges = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    links = {i: sum(i in e for e in edges) for i in sets}
    return links, components_of(sets, edges)


def check_near(spark, rows):
    got = {r.doc_id: r for r in near_join.annotate(documents(spark, rows)).collect()}
    links, component = near_truth(rows)
    assert {i: r.n_links for i, r in got.items()} == links
    assert {i: r.component_id for i, r in got.items()} == component
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_join_brute_force(spark):
    check_near(spark, corpus())


def test_near_join_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_join, "BLOCK_ROWS", 3)
    base = prose(120, 40)
    check_near(spark, [(i, edited(base, 45 + i, i)) for i in range(14)] + [(50 + i, base) for i in range(3)])


@pytest.mark.parametrize("rows", [2, 5, 30])
def test_near_join_by_buckets(spark, monkeypatch, rows):
    """Every pair of a bucket is compared once, at the first band that it shares, also where buckets are cut."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(near_join, "BLOCK_ROWS", rows)
    monkeypatch.setattr(near_join, "by_buckets", lambda whole, buckets: F.lit(True))
    base, words = prose(120, 40), prose(300, 41).split()
    chain = [(100 + k, " ".join(words[: 100 + 12 * k])) for k in range(16)]
    check_near(spark, [(i, edited(base, 45 + i, i)) for i in range(14)] + [(50 + i, base) for i in range(3)] + chain + [(200 + i, prose(50, 90 + i)) for i in range(9)])


def test_near_join_edges(spark):
    empty = documents(spark, [])
    assert near_join.annotate(empty).count() == 0 and near_join.deduplicate(empty).count() == 0
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, None)]
    got = near_join.annotate(documents(spark, rows)).collect()
    assert sorted((r.doc_id or -1, r.n_links) for r in got) == [(-1, 0), (-1, 0), (7, 1), (7, 1)]
    kept = near_join.deduplicate(documents(spark, corpus()))
    _, component = near_truth(corpus())
    assert {r.doc_id for r in kept.collect()} == set(component.values()) and kept.columns == documents(spark, []).columns


def test_near_join_of_rows_that_repeat_an_id(spark):
    a, b = prose(60, 70), prose(60, 71)
    rows = [(1, a), (1, b), (2, a + " two more"), (3, b + " two more"), (4, prose(50, 72)), (3, b + " two more"), (1, a)]
    got = sorted((r.doc_id, r.class_id, r.component_id, r.n_links) for r in near_join.annotate(documents(spark, rows)).collect())
    # each text is compared, whatever other texts stand under its id
    assert got == [(1, 1, 1, 2), (1, 1, 1, 2), (1, 1, 1, 2), (2, 1 + 1, 1, 2), (3, 3, 1, 2), (3, 3, 1, 2), (4, 4, 4, 0)]
    kept = near_join.deduplicate(documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, a), (1, b), (4, rows[4][1])])
    again = near_join.deduplicate(documents(spark, rows[::-1])).collect()
    assert sorted((r.doc_id, r.text) for r in again) == sorted((r.doc_id, r.text) for r in kept)


def test_near_join_in_levels_of_sizes(spark, monkeypatch):
    monkeypatch.setattr(near_join, "BLOCK_ROWS", 2)
    words = prose(400, 41).split()
    # one chain of texts from 100 to 400 words: neighbours are near, ends are not
    check_near(spark, [(k, " ".join(words[: 100 + 12 * k])) for k in range(25)])


def removal_truth(rows):
    raw = [(t or "").encode() for _, t in rows]
    seen = {}
    for i, b in enumerate(raw):
        for p in range(len(b) - 399):
            seen.setdefault(b[p : p + 400], []).append((i, p))
    mark = [bytearray(len(b)) for b in raw]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                mark[i][p : p + 400] = b"\1" * 400
    out = {}
    for (i, _), b, m in zip(rows, raw, mark):
        kept = bytes(x for x, y in zip(b, m) if not y)
        runs = sum(1 for k in range(len(m)) if m[k] and (k == 0 or not m[k - 1]))
        out[i] = (len(b), sum(m), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("crowd,part", [(4096, 1 << 22), (2, 1 << 22), (5, 1000)])
def test_repeats_brute_force(spark, monkeypatch, crowd, part):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats, "RANGE_BYTES", 20_000)
    monkeypatch.setattr(repeats, "PART", part)  # texts beyond it are scanned in parts
    rows = [r for r in corpus() if len(r[1] or "") < 20_000]
    passage = prose(110, 77)
    rows += [(900 + k, prose(12 + k, 300 + k) + " " + passage[k * 3 :] + prose(9, k)) for k in range(8)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(documents(spark, rows)).collect()}
    assert got == removal_truth(rows)


def test_repeats_edges(spark):
    assert repeats.remove_repeats(documents(spark, [])).count() == 0
    got = repeats.remove_repeats(documents(spark, [(1, "a" * 399), (2, None), (None, prose(90, 5)), (None, prose(90, 5)), (3, "ab" * 300)])).collect()
    by = sorted(((r.doc_id or -1), r.n_removed == r.n_bytes, r.n_removed > 0) for r in got)
    assert by == [(-1, True, True), (-1, True, True), (1, False, False), (2, True, False), (3, True, True)]
    cut = repeats.remove_repeats(documents(spark, [(1, prose(90, 5) + " end"), (2, prose(90, 5))]), with_text=True)
    assert {r.doc_id: r.text for r in cut.collect()} == {1: " end", 2: ""}


def passage_truth(rows, length=50):
    words = [re.findall(rb"[0-9A-Za-z\x80-\xff]+", (t or "").encode()) for _, t in rows]
    runs = [{tuple(x.lower() for x in w[k : k + length]) for k in range(len(w) - length + 1)} for w in words]
    seen = collections.Counter(r for own in runs for r in own)
    return sorted(((i or -1, t or "", any(seen[r] > 1 for r in own)) for (i, t), own in zip(rows, runs)), key=repr)


@pytest.mark.parametrize("part,floor", [(1 << 22, 1024), (100, 10**9)])
def test_passages_of_words_shared_by_documents(spark, monkeypatch, part, floor):
    """Passages of 50 words and more are told, also below 400 bytes, which stay; 49 words and repeats inside one text are not."""
    monkeypatch.setattr(passages, "PART", part)
    monkeypatch.setattr(passages, "HOT_KEYS", floor)
    passage = prose(51, 501).split()
    assert len(" ".join(passage)) < 400
    rows = [r for r in corpus() if len(r[1] or "") < 20_000]
    rows += [(900 + k, prose(40 + k, 600 + k) + " " + " ".join(passage[:n]) + " " + prose(30, 650 + k)) for k, n in enumerate((51, 51, 50, 49, 48))]
    rows += [(910, prose(45, 700) + ", " + ",\n".join(passage).upper() + "; " + prose(20, 701)), (911, prose(45, 702) + "x"), (None, prose(55, 703)), (None, prose(55, 703))]
    own = prose(110, 801)
    rows += [(920, own + " q " + own + " z " + own), (921, "de " * 49), (922, "de " * 80), (923, "la " * 51), (924, "w " + "la " * 51)]
    got = repeats.remove_repeats(documents(spark, rows), with_passages=True).collect()
    texts = collections.defaultdict(list)
    for i, t in rows:
        texts[i].append(t or "")
    told = sorted(((r.doc_id or -1, texts[r.doc_id].pop(), r.shares_passage) for r in got), key=repr)
    assert told == passage_truth(rows)
    by = {r.doc_id: (r.shares_passage, r.n_removed) for r in got}
    assert [by[k] for k in (900, 902, 903, 910)] == [(True, 0), (True, 0), (False, 0), (True, 0)]
    assert by[920][0] is False and by[920][1] > 0
    assert repeats.remove_repeats(documents(spark, []), with_passages=True).count() == 0


def vectors(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(120, 16)).astype(np.float32)
    x[60:80] = x[0] + r.normal(size=(20, 16)).astype(np.float32) * 0.1
    x[80:90] = x[1]
    x[90:95] = x[2] * np.arange(2, 7)[:, None]
    rows = [(i * 2, [float(v) for v in x[i]]) for i in range(120)]
    odd = [(1001, None), (1003, []), (1005, [0.0] * 16), (1007, [float("nan")] + [1.0] * 15), (1009, [float("inf")] + [1.0] * 15), (1011, [None] + [1.0] * 15), (1013, rows[0][1][:8]), (1015, rows[0][1][:8])]
    return rows, odd


def test_vectors_brute_force(spark):
    rows, odd = vectors(spark)
    df = spark.createDataFrame([(i, v, 3, "x") for i, v in rows + odd], "vec_id long, embedding array<float>, label int, rep string")
    got = {r.vec_id: r for r in near_vectors.near_vectors(df).collect()}
    unit = {i: np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) for i, v in rows + odd[-2:]}
    edges = [(a, b) for a, b in itertools.combinations(unit, 2) if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    label = components_of([i for i, _ in rows + odd], edges)
    assert {i: r.n_links for i, r in got.items()} == {i: sum(i in e for e in edges) for i in label}
    assert {i: r.component_id for i, r in got.items()} == label
    assert near_vectors.near_vectors(df.where("false")).count() == 0


def test_vectors_of_any_norm_and_repeated_ids(spark):
    tiny, huge = [3e-320, 4e-320, 0.0], [3e307, 4e307, 1e300]
    rows = [(1, [3.0, 4.0, 0.0]), (2, tiny), (3, huge), (4, [0.0, 0.0, 1.0]), (4, [0.0, 1e-3, 1.0]), (4, [0.0, 0.0, 1.0]), (5, [0.0, 0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors.near_vectors(df).collect())
    assert got == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 3, 4), (4, 3, 4), (4, 3, 4), (5, 3, 4)]


@pytest.mark.parametrize("fitted", [256, 4])
def test_vectors_recall_on_many_links(spark, monkeypatch, fitted):
    monkeypatch.setattr(near_vectors, "FITTED", fitted)  # with 4, books are sums of two
    r = np.random.default_rng(fitted)
    x = r.normal(size=(10_000, 32))
    # pairs at cosines from 0.93 to 1, and one dense group
    for k, c in enumerate(np.linspace(0.93, 0.9999, 2_000)):
        u = x[k] / np.linalg.norm(x[k])
        w = r.normal(size=32)
        w -= (w @ u) * u
        x[5_000 + k] = c * u + np.sqrt(1 - c * c) * w / np.linalg.norm(w)
    x[8_000:8_400] = x[9_000] + 0.1 * r.normal(size=(400, 32))
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {v.vec_id: v.n_links for v in near_vectors.near_vectors(df).collect()}
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = np.concatenate([(unit[s : s + 1000] @ unit.T >= 0.95).sum(axis=1) - 1 for s in range(0, len(x), 1000)])
    assert want.sum() > 100_000 and all(got[i] <= want[i] for i in got)
    pairs = np.flatnonzero(want == 1)
    assert sum(got.values()) >= 0.98 * want.sum() and sum(got[i] for i in pairs) >= 0.98 * len(pairs)


def test_warc_round_trip(spark):
    rows = [(1, "http://a", "<p>x"), (2, "http://b", "<p>x"), (3, None, None), (4, "u", ""), (5, "é", "<é>"), (None, "n", "<p>x"), (None, "m", "only"), (5, "é", "<é>")]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "page_id long, url string, html string, address int, payload string")
    path = shared.scratch(spark, "t")
    warc.write_archive(df, path)
    back = warc.read_archive(spark, path).collect()
    assert len(back) == len(rows) and all(r.sound and r.found_digest == r.payload_digest for r in back)
    want = sorted(((i or -1), u or "", (h or "").encode()) for i, u, h in rows)
    assert sorted(((r.page_id or -1), r.url or "", bytes(r.payload)) for r in back) == want
    assert all(r.payload_digest == base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode() for r in back)
    kinds = {(r.page_id or -1, r.url or ""): (r.record_type, r.refers_to) for r in back}
    assert kinds[1, "http://a"] == ("revisit", 2) and kinds[2, "http://b"] == ("response", None)
    assert kinds[3, ""] == ("revisit", 4) and kinds[-1, "n"] == ("revisit", 2) and kinds[-1, "m"] == ("response", None)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    by_id = {r.record_id: r for r in back}
    assert len(by_id) == len(rows)
    for r in back:
        raw = bytes(r.record)
        head, http, rest = raw.split(b"\r\n\r\n", 2)
        lines = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and lines["WARC-Record-ID"] == r.record_id and len(lines["WARC-Date"]) == 20
        assert rest == bytes(r.payload) + b"\r\n\r\n"
        if r.record_type == "revisit":
            assert by_id[lines["WARC-Refers-To"]].page_id == r.refers_to and by_id[lines["WARC-Refers-To"]].record_type == "response"
            assert lines["WARC-Profile"].endswith("identical-payload-digest") and int(lines["Content-Length"]) == len(http) + 4
        else:
            assert "WARC-Refers-To" not in lines and int(lines["Content-Length"]) == len(http) + 4 + len(r.payload)
    empty = shared.scratch(spark, "t")
    warc.write_archive(df.where("false"), empty)
    assert warc.read_archive(spark, empty).count() == 0


def test_warc_of_odd_urls_and_lost_payloads(spark):
    rows = [(1, "http://a/\r\nWARC-Type: request", "x" * 3_000_000), (2, "b", "lost")]
    path = shared.scratch(spark, "t")
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path, captured="2020-01-02T03:04:05Z")
    first = {r.page_id: r for r in warc.read_archive(spark, path).collect()}
    assert "http://a/%0D%0AWARC-Type: request" in first[1].header and first[1].header.count("WARC-Type: r") == 2
    assert "WARC-Date: 2020-01-02T03:04:05Z" in first[1].header and first[1].sound and len(first[1].payload) == 3_000_000
    gone = spark.read.parquet(f"{path}/payloads").where("length(payload) > 100")
    gone.write.parquet(f"{path}/rest")
    import os
    import shutil

    at = path.removeprefix("file://")
    shutil.rmtree(f"{at}/payloads")
    os.rename(f"{at}/rest", f"{at}/payloads")
    assert {r.page_id: r.sound for r in warc.read_archive(spark, path).collect()} == {1: True, 2: False}


def test_tokens_round_trip(spark):
    from tokenizers import Tokenizer

    rows = corpus() + [(4, "again")]
    got = tokens.tokenize(spark, documents(spark, rows)).orderBy("start").collect()
    whole = Tokenizer.from_file(tokens.default_tokenizer())
    ids = {}
    for i, t in rows:
        code = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        ids.setdefault(i, []).append((len(code), zlib.crc32(code.tobytes())))
    assert [r.doc_id for r in got] == sorted(i for i, _ in rows)
    at = 0
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in ids[r.doc_id]
        at += r.n_tokens
    assert tokens.tokenize(spark, documents(spark, [])).count() == 0


def test_mixing(spark):
    rows = [(i, prose(1 + i % 7, i)) for i in range(1, 200)] + [(500, None), (None, "x y"), (500, "again and again")]
    got = mixing.plan_mix(documents(spark, rows)).collect()
    total = sum(r.size for r in got)
    per = {}
    for r in got:
        per.setdefault(r.source, r)
    assert len(got) == len(rows) and sum(p.target for p in per.values()) == pytest.approx(1.5 * total)
    assert all(r.target <= 2 * r.source_size + 1e-9 and 0 <= r.n_copies <= 2 for r in got)
    names = sorted((s for s in per if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    free = [per[s].target / weight[s] for s in names if per[s].target < 2 * per[s].source_size - 1e-9]
    assert max(free) == pytest.approx(min(free))
    mixed = mixing.mix(documents(spark, rows))
    assert mixed.columns == documents(spark, []).columns and mixed.count() == sum(r.n_copies for r in got)
    assert mixing.plan_mix(documents(spark, [])).count() == 0


def test_mixing_of_clashing_columns_and_many_sources(spark):
    r = random.Random(9)
    rows = [(i, prose(r.randint(0, 9), i), f"s{r.randint(0, 60)}" if i % 11 else None, 1, 2, 3) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Source string, goal_source_0 int, goal_rate_0 int, number int")
    size = {}
    for _, t, s, *_ in rows:
        size[s] = size.get(s, 0) + len(t.split())
    # water under a ceiling, source by source
    names = sorted(n for n in size if n is not None) + [None]
    weight = {n: (3, 1, 2)[k % 3] for k, n in enumerate(names)}
    budget, open_, want = 1.5 * sum(size.values()), set(names), {}
    while open_:
        level = budget / sum(weight[n] for n in open_)
        full = {n for n in open_ if level * weight[n] >= 2 * size[n]}
        if not full:
            want |= {n: level * weight[n] for n in open_}
            break
        want |= {n: 2.0 * size[n] for n in full}
        budget -= sum(2 * size[n] for n in full)
        open_ -= full
    got = {r.source: r.target for r in mixing.plan_mix(docs).select("source", "target").distinct().collect()}
    assert got.keys() == want.keys() and all(got[n] == pytest.approx(want[n]) for n in want)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and 0 < mixed.count() <= 1200


def test_decontamination_brute_force(spark):
    items = [(1, prose(20, 60)), (2, prose(45, 61)), (3, "one two three four"), (4, None), (5, " "), (None, prose(30, 62)), (6, "w w w w w w w w w w")]
    docs = corpus() + [(700, prose(3000, 70) + " " + items[0][1] + " " + prose(50, 71)), (701, edited(items[1][1], 22, 1)), (702, edited(items[1][1], 5, 1)), (703, "w " * 50), (704, prose(5, 72) + " " + items[5][1]), (705, "one two three four")]
    bench = spark.createDataFrame([(*i, 2) for i in items], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): r.containment for r in decontaminate.search(documents(spark, docs), bench).collect()}
    want = {}
    for d, t in docs:
        have = shingles(t)
        for i, text in items:
            own = shingles(text)
            if own and len(own & have) >= 0.8 * len(own):
                want[d, i] = len(own & have) / len(own)
    assert got == want and (703, 6) in want
    kept = decontaminate.decontaminate(documents(spark, docs), bench)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.search(documents(spark, docs), bench.where("false")).count() == 0
    assert decontaminate.search(documents(spark, []), bench).count() == 0


def test_decontamination_of_items_beyond_a_broadcast(spark, monkeypatch):
    """The join gives what the broadcast gives: short, repetitive, null and repeated items, ids that repeat, an item in most documents."""
    common = prose(40, 500)
    items = [(k, prose(8 + 20 * k, 400 + k)) for k in range(30)] + [(50, common), (50, common), (51, edited(common, 20, 1)), (None, prose(30, 501)), (52, None), (53, ""), (54, "one two three"), (55, "w v " * 300), (56, " ".join(prose(9, 502).split()[:9] * 60))]
    docs = [(k, prose(30, k) + " " + t) for k, t in items if t] + [(k, prose(900, 600)) for k in (900, 900, None)] + [(901, None), (902, "")]
    docs += [(1000 + k, prose(25, 700 + k) + " " + common) for k in range(90)] + [(2000, " ".join(t for _, t in items if t)), (2001, "one two three"), (2001, "w v " * 40)] + [(2002, docs[0][1])] * 30
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, row string")
    frame = spark.createDataFrame([(*d, "y") for d in docs], "doc_id long, text string, keys string")
    want = {(r.doc_id, r.item_id): r.containment for r in decontaminate.search(frame, bench).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 4_000)
    monkeypatch.setattr(decontaminate, "FILTER_BITS", 1 << 16)
    rows = decontaminate.search(frame, bench).collect()
    got = {(r.doc_id, r.item_id): r.containment for r in rows}
    assert len(rows) == len(got) and got == want and len(got) > 150
    assert (2001, 55) in got and (2001, 54) in got and (2000, 29) in got and (None, None) in got
    assert decontaminate.search(frame.where("false"), bench).count() == 0


def test_one_pass_over_the_documents_at_any_number_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 0)
    passes = []
    keys = decontaminate.doc_keys
    monkeypatch.setattr(decontaminate, "doc_keys", lambda *a: passes.append(1) or keys(*a))
    items = [(k, prose(20 + k, 400 + k)) for k in range(40)]
    docs = spark.createDataFrame([(k, prose(30, k) + " " + t) for k, t in items], "doc_id long, text string")
    got = decontaminate.search(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(k, k) for k in range(40)] and passes == [1]


def accuracy(spark, query, label, modulus, out):
    sf = "/root/testdata/sf0.1"
    scored = query(spark, sf).where("held_out")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = scored.join(labels, "doc_id").select(label, "predicted", "score", "doc_id").collect()
    assert rows and all(zlib.crc32(str(r.doc_id).encode()) % modulus == out and 0 <= r.score <= 1 for r in rows)
    return np.mean([r[label] == r.predicted for r in rows])


def test_quality_held_out(spark):
    assert accuracy(spark, quality.query, "quality", 3, 1) > 0.98


def test_toxicity_held_out(spark):
    assert accuracy(spark, toxicity.query, "toxic", 5, 0) > 0.97


def test_classifier_edges(spark):
    docs = documents(spark, [(1, None), (2, ""), (None, "a b"), (3, "x"), (3, "x")])
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (9, 0, 1)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        got = module.classify(docs, labels).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
        assert module.classify(documents(spark, []), labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def by_enumeration(scores, edges):
    """Marginals of state 1 of a short chain, from all of its state sequences in log space."""
    n = len(scores)
    total = np.zeros(n + 1)
    for states in itertools.product((0, 1), repeat=n):
        w = np.exp(sum(x for x, y in zip(scores, states) if y) + sum(edges[a, b] for a, b in zip(states, states[1:])))
        total[n] += w
        total[:n] += w * np.array(states)
    return total[:n] / total[n]


def labelled_texts():
    """Good and bad lines, clean and toxic words."""
    r = random.Random(4)
    junk = lambda: " ".join(r.choice(["CLICK", "!!!", "$$$", "buy", "NOW", "||", "99"]) for _ in range(7))
    rows, labels = [], []
    for i in range(120):
        good, toxic = i % 2, i % 3 == 0
        lines = [prose(9, i * 10 + k).capitalize() + "." for k in range(3)]
        if not good:
            lines[1:] = [junk(), junk()]
        if toxic:
            lines.insert(1, f"you {r.choice(['grumbold', 'snarkwit'])} {prose(3, i)}")
        rows.append((i, "\n".join(lines)))
        labels.append((i, good, int(toxic)))
    return rows, labels


def test_quality_by_enumeration(spark):
    rows, labels = labelled_texts()
    rows += [(500, None), (501, ""), (None, "A line of its own."), (7, "Another text of a known id.\nBUY NOW !!!"), (502, " \n ")]
    docs, labels = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = sorted((str(r.doc_id), round(r.score, 9), r.predicted, r.held_out) for r in quality.classify(docs, labels).collect())
    want = []
    for i, text in rows:
        import pyarrow as pa

        lines = quality.lines_of(pa.array([text]))
        bad = by_enumeration(lines.features @ model.field.weights, model.field.edges) if len(lines.features) else np.zeros(0)
        share = (bad * lines.lengths).sum() / max(lines.lengths.sum(), 1)
        score = 1 / (1 + np.exp(-(np.array([share, share**0.5, bad.max(initial=0), 1]) @ model.curve)))
        want.append((str(i), round(float(score), 9), int(score >= 0.5), i is not None and zlib.crc32(str(i).encode()) % 3 == 1))
    assert got == sorted(want) and len({g[2] for g in got}) == 2
    kept = quality.keep_good(docs, labels).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(w[0] for w in want if w[2])


def test_toxicity_by_enumeration(spark):
    import pyarrow as pa

    rows, labels = labelled_texts()
    rows = [(i, " ".join(t.split()[:14]) if t else t) for i, t in rows] + [(500, None), (501, ""), (None, "you grumbold"), (7, "plain words")]
    docs, labels = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = sorted((str(r.doc_id), round(r.score, 6), r.predicted) for r in toxicity.classify(docs, labels).collect())
    want = []
    for i, text in rows:
        tokens = toxicity.tokens_of(pa.array([text]))
        p = by_enumeration(toxicity.token_scores(tokens.features, model.weights, model.bias), model.edges) if len(tokens.features) else np.zeros(0)
        score = 1 / (1 + np.exp(-(np.array([p.max(initial=0), np.log1p(p[p >= 0.2].sum()), 1]) @ model.curve)))
        want.append((str(i), round(float(score), 6), int(score >= 0.5)))
    assert got == sorted(want) and len({g[2] for g in got}) == 2


def test_spans_stand_on_the_offending_words(spark):
    rows, labels = labelled_texts()
    docs, labels = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    fresh = [(1, "é words before the grumbold here"), (2, prose(40, 3)), (3, prose(20_000, 5) + " snarkwit " + prose(20_000, 6)), (4, "snarkwit"), (4, "nothing of it")]
    found = toxicity.tag(documents(spark, fresh), model).collect()
    texts = [t for _, t in fresh]
    for r in found:
        own = [t for i, t in fresh if i == r.doc_id]
        words = {raw[s.start : s.end].decode() for raw in (t.encode() for t in own) for s in r.spans}
        if r.spans:
            assert any(w in ("grumbold", "snarkwit") or "grumbold" in w or "snarkwit" in w for w in words)
    tagged = [r.doc_id for r in found if r.spans]
    assert sorted(tagged) == [1, 3, 4] and len(texts) == len(found)


def test_classifiers_read_very_long_texts(spark):
    rows, labels = labelled_texts()
    long = "\n".join(t for _, t in rows) * 60
    docs, labels = documents(spark, rows + [(900, long)]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        assert [0 <= r.score <= 1 for r in module.classify(docs, labels).where("doc_id = 900").collect()] == [True]


def test_toxic_spans(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.classify(docs, labels).where("size(spans) > 0").join(docs.select("doc_id", "text"), "doc_id").limit(20).collect()
    assert rows
    for r in rows:
        raw = r.text.encode()
        assert all(0 <= s.start < s.end <= len(raw) and raw[s.start : s.end].decode() for s in r.spans)


def test_page_extraction_edges(spark):
    df = spark.createDataFrame([(1, "u", None, 3), (None, None, "", 3), (2, "u", "<article><p>Some text of a page. It is here.</p></article>", 3), (2, "u", "<article><p>Some text of a page. It is here.</p></article>", 3)], "page_id long, url string, html string, text int")
    got = sorted(((r.page_id or -1), r.text, r.n_chars) for r in html_extract.extract(df).collect())
    text = "Some text of a page. It is here."
    assert got == [(-1, "", 0), (1, "", 0), (2, text, len(text)), (2, text, len(text))]
    assert html_extract.extract(df.where("false")).count() == 0


STORY = "The first paragraph of a story has a handful of words in it, and ends here."
MORE = "A second one follows it with some more of them, as such stories have."


@pytest.mark.parametrize(
    "page,text",
    [
        # layouts without an article element
        (f"<body><nav><a href=/>Home</a></nav><div><div><p>{STORY}</p></div></div><footer>c 2024</footer></body>", STORY),
        (f"<body><div><div><div><p>{STORY}</p></div></div></div></body>", STORY),
        (f"<body><main><h1>Title of it</h1><p>{STORY}<p>{MORE}</main><aside><ul><li><a href=/>x</a></li></ul></aside></body>", f"Title of it\n{STORY}\n{MORE}"),
        (f"<body><header><h2>Site</h2></header><div class='entry-content'><p>{STORY}</p><p>{MORE}</p></div><div class='sidebar'><ul><li><a href=/>one</a></li><li><a href=/>two</a></li></ul></div></body>", f"{STORY}\n{MORE}"),
        (f"<table><tr><td class='menu'><ul><li><a href=/>a</a></li></ul></td><td class='content'><p>{STORY}</p><p>{MORE}</p></td></tr></table>", f"{STORY}\n{MORE}"),
        (f"<body><section class='content'><p>{STORY}</p><p>{MORE}</p></section><div class='cookie-notice'>We use cookies. <button>Fine</button></div></body>", f"{STORY}\n{MORE}"),
        # silent elements that nobody closes end before the next block
        (f"<body><div><svg><path d='x'><p>{STORY}</p></div></body>", STORY),
        (f"<body><div><object data=x><p>{STORY}</p><p>{MORE}</p></div></body>", f"{STORY}\n{MORE}"),
        (f"<body><canvas><div><p>{STORY}</p></div></body>", STORY),
        (f"<div><button>Press<p>{STORY}</p></div>", STORY),
        (f"<div><select><option>a<option>b</select><p>{STORY}</p></div>", STORY),
        # closed ones are silent as a whole
        (f"<body><div><object data=x><p>fallback</p></object><p>{STORY}</p></div></body>", STORY),
        (f"<body><article><video><p>no video here</p></video><p>{STORY}</p></article></body>", STORY),
    ],
)
def test_pages_of_other_layouts(page, text):
    assert html_extract.extract_texts([page], html_extract.default_model()) == [text]


def test_very_long_pages(spark):
    blocks = [f"{prose(30, k)}." for k in range(4_000)]
    page = "<body><nav><a href=/>Home</a></nav><article>" + "".join(f"<p>{b}</p>" for b in blocks) + "</article></body>"
    deep = "<div>" * 3_000 + f"<p>{STORY}</p>"
    open_ = "<article>" + "<canvas>" * 3_000 + f"<p>{STORY}</p>"
    df = spark.createDataFrame([(1, "u", page), (2, "u", deep), (3, "u", open_)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert got[1] == "\n".join(blocks) and got[2] in ("", STORY) and got[3] == STORY


def test_page_extraction_on_pages(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in html_extract.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article))
        want = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", b))).strip() for b in blocks]
        assert r.text == "\n".join(b for b in want if b) and r.n_chars == len(r.text)


@pytest.mark.parametrize("name", ["op3_warc", "op4_near_join", "op6_mixing", "op7_near_vectors", "op8_decontaminate"])
def test_query_matches_sql(spark, name):
    import duckdb

    from orebody.llm import registry

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    result = con.execute(registry.ORACLES[name])
    places = [[d[0] for d in result.description].index(c) for c in names]
    assert sorted(tuple(plain(r[c]) for c in names) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in places) for r in result.fetchall())


def test_pipeline_brute_force(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels).where("predicted = 1").collect()}
    rows = [(i, docs[i].text) for i in sorted(good)]
    _, component = near_truth(rows)
    kept = [(i, t) for i, t in rows if component[i] == i]
    items = [shingles(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = [(i, t) for i, t in kept if not any(s and len(s & shingles(t)) >= 0.8 * len(s) for s in items)]
    left = spark.createDataFrame([(i, t, docs[i].source) for i, t in clean], "doc_id long, text string, source string")
    times = {r.doc_id: r.n_copies for r in mixing.plan_mix(left).collect()}
    whole = Tokenizer.from_file(tokens.default_tokenizer())
    want, at = [], 0
    for i, t in clean:
        code = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        for _ in range(times[i]):
            want.append((i, at, len(code), zlib.crc32(code.tobytes())))
            at += len(code)
    got = corpus_pipeline.run(spark, sf).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want
    assert len(clean) < len(kept) < len(rows) < len(docs)


def test_pipeline_edges(spark, tmp_path):
    import corpus_pipeline

    sf = str(tmp_path)
    rows = [(1, prose(40, 1)), (2, None), (3, ""), (None, prose(40, 2)), (4, prose(40, 1)), (5, prose(40, 3)), (5, prose(40, 3)), (5, prose(40, 4)), (6, "x" * 100_000)]
    documents(spark, rows).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, None), (None, prose(6, 3))], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        seen[name] = docs = shared.settle(docs, "edge")
    names = documents(spark, []).columns
    assert all(seen[n].columns == names for n in ("quality", "near_copies", "decontaminate", "mix"))
    # no labels: all stay; copies and repeated rows go; the item is in document 5; rows without an id or words stay
    assert seen["quality"].count() == len(rows)
    assert sorted(str(r.doc_id) for r in seen["near_copies"].collect()) == ["1", "2", "3", "5", "5", "6", "None"]
    assert sorted(str(r.doc_id) for r in seen["decontaminate"].collect()) == ["1", "2", "3", "6", "None"]
    assert corpus_pipeline.run(spark, sf).count() == seen["mix"].count()
    documents(spark, []).write.mode("overwrite").parquet(f"{sf}/documents.parquet")
    assert corpus_pipeline.run(spark, sf).count() == 0
