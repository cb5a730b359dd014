"""Ranked search, contextual identifiers and importance resampling against plain definitions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from orebody.llm import html_extract, lexical, pii, resample

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    total = 0
    for k, d in enumerate(reversed([int(c) for c in s if "0" <= c <= "9"])):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text):
    tests = {
        "email": lambda m: True,
        "ip": lambda m: all(int(x) <= 255 for x in m.split(".")),
        "card": lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(m),
        "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    found = [(m.start(), k, m.end()) for k, p in enumerate(BASE.values()) for m in re.finditer(p, text or "") if tests[list(BASE)[k]](m.group())]
    return sorted(found)


def written(spans):
    return ",".join(f"{list(BASE)[k]}:{a}:{b}" for a, k, b in spans)


def row_of(doc_id, text):
    spans = base_spans(text)
    counts = [sum(k == n for _, k, _ in spans) for n in range(4)]
    return (doc_id, *counts, hashlib.sha256(written(spans).encode()).hexdigest(), written(spans))


NASTY = [
    None,
    "",
    "a@b.c@d.e a@b.c_x@d.e %@-.- x@y @a.b a@b..c a@b.c.",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.255 1.2.3.4.",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111",
    "+1 (499) 555-6503. +1-2 +12345678901234567 ++4420 7946 0958 (+44)20",
    "😀 mail😀a.b@c.de 😀+1 499 555 6503😀 4111111111111111",
    "0" * 3000 + " " + "a" * 5000 + "@" + "b.c" * 50,
    "+1 4111 1111 1111 1111 8.8.8.8.8",
]


def test_base_spans_equal_the_plain_patterns(spark):
    r = random.Random(3)
    texts = NASTY + ["".join(r.choice("ab@..-- +()012345678990\n😀_%") for _ in range(r.randint(0, 90))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(1, NASTY[1]), (None, "x@y.z")], "doc_id long, text string")
    got = sorted(tuple(x)[:7] for x in pii.annotate(docs, seeds=10**6).collect() if x["doc_id"] is not None)
    assert got == sorted(row_of(i, t) for i, t in list(enumerate(texts)) + [(1, NASTY[1])])


def test_confident_patterns_find_unseen_identifiers(spark):
    r = random.Random(5)
    phone = lambda: f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}"
    texts = [f"Please ring me at {phone()} after lunch, Tom" for _ in range(12)]
    texts += ["Please ring me at 499 555 7788 after lunch, Ann", "Nothing here 2024 and 499 555 000", "my old number 499 555 7788."]
    # the same words around numbers of another kind: no confidence
    texts += [f"order of the {r.randint(10**6, 10**7)} is late" for _ in range(12)] + [f"order of the {phone()} is late" for _ in range(4)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {x["doc_id"]: x for x in pii.annotate(docs).collect()}
    for i, t in enumerate(texts):
        assert tuple(rows[i])[:6] == row_of(i, t)[:6]
        extra = set(rows[i]["spans"].split(",")) - set(row_of(i, t)[6].split(",")) - {""}
        at = t.find("499 555 7788")
        assert extra == ({f"phone:{at}:{at + 12}"} if at >= 0 else set())


def test_a_third_of_all_rows_in_one_pattern_and_value(spark):
    texts = [f"call me at +1 499 555 {k:04d} now" for k in range(30)] + ["call me at 499 555 1234 now"] * 40 + ["plain 77"] * 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.annotate(docs).collect()
    assert sum(x["n_added"] for x in rows) == 40 and sum(x["n_phone"] for x in rows) == 30 and len(rows) == 110


def test_identifiers_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, spans int, kind string")
    assert pii.annotate(docs).collect() == []
    one = spark.createDataFrame([(1, "a@b.cd", 5, "x")], "doc_id long, text string, spans int, kind string")
    assert pii.annotate(one).collect()[0]["spans"] == "email:0:6"


# ------------------------------------------------------------------ ranked search

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def plain_search(docs, items, k):
    terms = [(d, Counter(re.findall(TERM, lowered(t)))) for d, t in docs]
    terms = [(d, c, sum(c.values())) for d, c in terms if c]
    n_all, total = len(terms), sum(n for _, _, n in terms)
    df = Counter(t for _, c, _ in terms for t in c)
    out = []
    for item, text in items:
        asked = Counter(re.findall(TERM, lowered(text)))
        scored = []
        for d, c, n in terms:
            m = 75 + (25 * n * n_all) // total
            s = sum(o * math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, o in asked.items() if c[t])
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def test_search_equals_plain_scores(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 16)
    monkeypatch.setattr(lexical, "ITEM_BYTES", 400)
    monkeypatch.setattr(lexical, "TERMS_HELD", 10)
    r = random.Random(7)
    words = [f"w{k}" for k in range(300)] + ["Été", "ÉTÉ", "été", "naïve", "日本語", "A1", "a1"]
    weights = [1 / (k + 1) for k in range(len(words))]
    texts = [" ".join(r.choices(words, weights, k=int(r.expovariate(1 / 60)))) for _ in range(300)]
    texts += [texts[5]] * 60 + [None, "", "--- !!", "w1 " * 3000, "x" * 20000]
    docs = list(enumerate(texts)) + [(7, "w299 w298 extra"), (7, texts[7]), (None, "w299 w299")]
    items = [(k, " ".join(r.choices(words, weights, k=r.randint(1, 40)))) for k in range(25)] + [(90, None), (91, "nowhere else"), (92, texts[5]), (93, "w299 W299 w298")]
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, rank string, term int").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    index = lexical.build(frame)
    got = sorted((tuple(x) for x in lexical.search(index, frame, asked, 10).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == plain_search(docs, items, 10)
    df = Counter(t for _, x in docs for t in set(re.findall(TERM, lowered(x))))
    assert sorted(x["df"] for x in index.frequencies.collect()) == sorted(df.values())


def test_bounds_are_never_below_scores(spark):
    r = random.Random(9)
    words = [f"w{k}" for k in range(80)]
    texts = [" ".join(r.choices(words, k=r.randint(1, 400))) for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = lexical.build(docs)
    blocks = index.blocks.toArrow().to_batches()
    asked = lexical.Items([1], ["w1 w2 w3 w4 w5 w1"])
    asked.weigh(100, sum(len(t.split()) for t in texts), {x["term"]: x["df"] for x in index.frequencies.collect()})
    score = lambda doc_id: asked.score(0, len(texts[doc_id].split()), Counter(w.encode() for w in texts[doc_id].split()))
    seen = set()
    for bits, ids, _, sizes, packed in lexical._blocks(iter(blocks)):
        for item, bound in asked.bounds(bits, sizes, packed):
            for doc_id, b in zip(ids.tolist(), bound):
                assert b >= score(doc_id)
                seen.add(doc_id)
    assert len(seen) > 90 and all(score(d) == 0 for d in range(100) if d not in seen)


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(lexical.build(none), none, items).collect() == []
    assert lexical.search(lexical.build(some), some, items.limit(0)).collect() == []
    assert [tuple(x)[:3] for x in lexical.search(lexical.build(some), some, items).collect()] == [(1, 1, 1)]


# ------------------------------------------------------------------ importance resampling

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_ranks(docs, target, runs, percent, least):
    def features(text):
        w = re.findall(WORD, lowered(text))
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in range(1, runs + 1) for i in range(len(w) - k + 1)]

    own, goal = [features(t) for _, t in docs], [x for t in target for x in features(t)]
    s, t = Counter(x for f in own for x in f), Counter(goal)
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in s}
    rows = []
    for (d, text), f in zip(docs, own):
        h = int(hashlib.sha256(f"2024:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(re.findall(WORD, lowered(text)))])
    enough = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {id(r): k + 1 for k, r in enumerate(enough[: percent * len(enough) // 100])}
    return sorted(((*r[:4], drawn.get(id(r))) for r in rows), key=str)


@pytest.mark.parametrize("runs", [1, 2, 3])
def test_ranks_equal_plain_ones(spark, runs):
    r = random.Random(11)
    words = [f"w{k}" for k in range(60)] + ["Été", "été", "B", "b", "日本"]
    line = lambda: " ".join(r.choices(words, k=r.randint(0, 9)))
    shared = [line() for _ in range(6)]
    texts = ["\n".join(r.choice(shared) if r.random() < 0.5 else line() for _ in range(r.randint(0, 12))) for _ in range(150)]
    docs = list(enumerate(texts)) + [(200, None), (201, ""), (202, "\n\n--\n"), (203, "W1-w2!w3\nw4"), (204, "a\nb\nc\nd"), (205, "Footer words\n" * 300), (3, texts[4]), (4, texts[4]), (None, texts[9])]
    target = [" ".join(r.choices(words[:20], k=30)) for _ in range(5)] + [None]
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, line int").repartition(3)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    ranked = resample.ranked(frame, goal, runs, 30, 20)
    got = sorted((tuple(x) for x in ranked.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)
    assert got == plain_ranks(docs, target, runs, 30, 20)
    kept = resample.resample(frame, goal, runs, 30, 20)
    assert kept.columns == frame.columns
    assert sorted((x["doc_id"] for x in kept.collect()), key=str) == sorted((g[0] for g in got if g[4] is not None), key=str)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    goal = spark.createDataFrame([("a b",)], "text string")
    assert resample.ranked(none, goal).collect() == []
    some = spark.createDataFrame([(1, "a b c " * 10)], "doc_id long, text string")
    assert [x["n_features"] for x in resample.ranked(some, goal.limit(0)).collect()] == [30]


# ------------------------------------------------------------------ pages that nobody wrote for this

ARTICLE = "<article><p>The text of an article, which is long enough. It has two sentences.</p></article>"
TEXT = "The text of an article, which is long enough. It has two sentences."


@pytest.mark.parametrize(
    "page",
    [
        f'<body><div data-y="left">{ARTICLE}</div></body>',
        f'<body><div data-y="12.5" data-y="" DATA-Y=x data-y=0>{ARTICLE}</div></body>',
        f"<body><div data-y='0'>{ARTICLE}</div></body>",
        f"<body><select><option>a{ARTICLE}</body>",
        f"<body><select><option>a</option><option>b<option>c{ARTICLE}</body>",
        f"<body><select><option>a<option>b</select>{ARTICLE}</body>",
        f"<body><option>a{ARTICLE}</body>",
        f"<body><button>press{ARTICLE}</body>",
        f"<body><div title='a > b' onclick=\"x('<p>')\">{ARTICLE}</div></body>",
        f"<body>\x00{ARTICLE}\x00</body>",
        f"<body><div class={'x' * 5000}>{ARTICLE}</div></body>",
        f"<body>{'<div>' * 3000}{ARTICLE}</body>",
    ],
)
def test_hostile_pages_keep_their_article(spark, page):
    assert html_extract.extract_texts([page], html_extract.default_model())[0].strip("\x00\n") == TEXT


def test_an_unclosed_quote_is_no_error(spark):
    pages = [(k, "u", h) for k, h in enumerate([f'<div class="x>{ARTICLE}', f"<div data-y='{ARTICLE}", "<", "<a", "</", "<!--", "<![CDATA[", '<p x="', "&#xFFFFFFFF; &#0; &bogus"])]
    assert len(html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()) == len(pages)


def test_pages_without_names(spark):
    """All class and id names stripped: what shape and tags alone say."""
    from orebody.llm.html_pages import labelled_pages

    right = total = 0
    for html in labelled_pages(120, seed=77):
        page = html_extract.parse(re.sub(r"\s(class|id|role|itemprop)=(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", html), labelled=True)
        p, _ = html_extract.default_model().marginals([page])
        right += sum((p[k] >= 0.5) == (page.labels[k] == 1) for k, _, _ in page.blocks)
        total += len(page.blocks)
    print("accuracy of blocks without names", right / total)
    assert right / total > 0.9
