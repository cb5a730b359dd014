"""Main text of web pages by a tree-structured graphical model over the DOM.

Block elements are nodes; each is part of the article or not.  A node's potential comes
from its tag, its names and the shape of its text; an edge's potential couples a node with
its parent.  Messages pass from the leaves up and from the root down (sum-product), which
gives every node's marginal exactly; the weights maximise the likelihood of labelled
pages.  The text of nodes whose marginal is at least one half is the result.

Text: character references are decoded, white space inside a block becomes one space, ends
are trimmed, and blocks are joined by one line feed in page order.

Defined results: a null, empty or text-free page gives an empty text; broken markup is read
as far as it goes (an unclosed element ends with its parent, an unclosed silent one before
the next block); a null page_id or url is
kept; rows that repeat are extracted each; an empty table gives an empty result.  Columns
other than page_id, url and html are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .html_pages import labelled_pages
from .shared import columns
from .textnp import slices

#: Elements of HTML by how they break text.
BLOCKS = frozenset(
    "html body div p section article main aside nav header footer h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre form fieldset figure figcaption address hr details summary dialog center menu search hgroup".split()
)
#: Elements whose text is never shown as such, or is a control of a form.
SILENT = frozenset("script style noscript template title textarea select option button iframe svg math object audio video canvas head legend datalist".split())
#: Elements whose content is raw text up to their own end tag.
RAW = frozenset("script style title textarea iframe noscript".split())
#: Silent elements in which a block cannot stand.
FOREIGN = frozenset("svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening element ends these open ones, up to the element that holds them.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
}

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SPACE = re.compile(r"\s+")


@dataclass
class Page:
    """Block nodes in page order (a parent before its children) and blocks of text."""

    tags: list[str] = field(default_factory=list)
    names: list[tuple[str, ...]] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    labels: list[int] = field(default_factory=list)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # node, text, letters inside links


def parse(html: str, labelled: bool = False) -> Page:
    """The nodes and blocks of a page; only pages written for training say by ``data-y`` what their nodes are."""
    page = Page(["#root"], [()], [-1], [1], [])
    stack: list[tuple[str, int]] = [("#root", 0)]  # open blocks and silent elements
    silent = links = linked = 0
    held: list[str] = []
    lower = None

    def flush() -> None:
        nonlocal held, linked
        if held:
            text = SPACE.sub(" ", "".join(held)).strip()
            if text:
                page.blocks.append((stack[-1][1], text, min(linked, len(text))))
        held, linked = [], 0

    def close(upto: int) -> None:
        nonlocal silent
        while len(stack) > upto:
            name, _ = stack[-1]
            if name in SILENT:
                silent -= 1
            else:
                flush()
            stack.pop()

    def text(raw: str) -> None:
        nonlocal linked
        if raw and not silent:
            piece = unescape(raw)
            held.append(piece)
            if links:
                linked += len(piece)

    endless: set[str] = set()  # silent elements without a further end tag
    loose: list[int] = []  # open silent elements that end before the next block, by their place in the stack

    def forget() -> None:
        while loose and loose[-1] >= len(stack):  # closed meanwhile
            loose.pop()

    def lowered() -> str:
        nonlocal lower
        if lower is None:
            lower = html.lower()
            if len(lower) != len(html):  # a letter whose lower case is longer
                lower = re.sub(r"[A-Z]+", lambda x: x[0].lower(), html)
        return lower

    def unclosed(name: str) -> bool:
        """Whether a silent element just opened has no end tag before the next one opens, or holds no blocks by its kind."""
        if name in FOREIGN or name in endless:
            return True
        if name == "option" and any(x == "select" for x, _ in stack):  # ends with its select
            return any(stack[k][0] == "select" for k in loose)
        stop = lowered().find("</" + name, at)
        if stop < 0:
            endless.add(name)
            return True
        again = lowered().find("<" + name, at, stop)
        return again >= 0 and name != "object"

    at = 0
    while True:
        m = MARKUP.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        end, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if end:
            if name == "a":
                links = max(0, links - 1)
            elif name in BLOCKS or name in SILENT:
                found = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name), 0)
                # an end tag does not reach out of a cell, nor out of silence it is not part of
                if found:
                    close(found)
                elif not silent:
                    flush()
            continue
        if name in RAW and not rest.endswith("/"):
            stop = lowered().find("</" + name, at)
            at = len(html) if stop < 0 else stop
            if stop >= 0:
                at = html.find(">", stop) + 1 or len(html)
            continue
        if name == "br":
            text(" ")
        if name in VOID and name != "hr":
            continue
        if name == "a":
            links += 1
            continue
        if name in SILENT:
            if not rest.endswith("/"):
                forget()
                if name != "head" and unclosed(name):
                    loose.append(len(stack))
                stack.append((name, stack[-1][1]))
                silent += 1
            continue
        if name not in BLOCKS:
            continue
        forget()
        if silent and len(loose) == silent:
            close(loose[0])
            loose.clear()
        if silent and name != "body":
            continue
        if name == "body":
            found = next((k for k in range(1, len(stack)) if stack[k][0] == "head"), 0)
            if found:
                close(found)
            if silent:
                continue
        flush()
        if name == "hr":
            continue
        if name in CLOSES:
            ends, holders = CLOSES[name]
            k = len(stack) - 1
            last = 0
            while k > 0 and stack[k][0] not in holders:
                if stack[k][0] in ends:
                    last = k
                k -= 1
            if last:
                close(last)
        elif stack[-1][0] == "p":
            close(len(stack) - 1)
        words: list[str] = []
        label = -1
        if rest:
            for key, value in ATTRIBUTE.findall(rest):
                key = key.lower()
                if key in ("class", "id", "role", "itemprop"):
                    words += [w.lower() for w in NAME_PART.findall(value)]
                elif labelled and key == "data-y":
                    label = int(value.strip("\"'"))
        parent = stack[-1][1]
        page.tags.append(name)
        page.names.append(tuple(dict.fromkeys(words)))
        page.parents.append(parent)
        page.labels.append(page.labels[parent] if label < 0 else label)
        stack.append((name, len(page.tags) - 1))
        links = 0
    close(1)
    flush()
    return page


def node_words(page: Page, k: int) -> tuple[str, ...]:
    """What is said of a node in words: its tag, its names, and that it has none."""
    tag = f"<{page.tags[k]}>"
    return (tag, *page.names[k]) if page.names[k] else (tag, f"{tag} bare")


NUMBERS = ("text", "long", "links", "all-links", "many-blocks", "ends", "short")


def features(pages: list[Page], known: dict[str, int]) -> tuple[np.ndarray, ...]:
    """(node, feature, value, parent, depth, first node of each page) of all pages' nodes."""
    node, feat, value, parent, depth, first = [], [], [], [], [], []
    base = 0
    for page in pages:
        first.append(base)
        n = len(page.tags)
        size, linked, blocks, ends = [0] * n, [0] * n, [0] * n, [0] * n
        for k, text, inside in page.blocks:
            size[k] += len(text)
            linked[k] += inside
            blocks[k] += 1
            ends[k] += text[-1] in ".!?:"
        for k in range(n - 1, 0, -1):
            p = page.parents[k]
            size[p] += size[k]
            linked[p] += linked[k]
            blocks[p] += blocks[k]
            ends[p] += ends[k]
        level = [0] * n
        for k in range(n):
            p = page.parents[k]
            if p >= 0:
                level[k] = level[p] + 1
            for w in node_words(page, k):
                f = known.get(w)
                if f is not None:
                    node.append(base + k)
                    feat.append(f)
                    value.append(1.0)
            share = linked[k] / size[k] if size[k] else 0.0
            numbers = (1.0 if size[k] else 0.0, min(size[k], 2000) ** 0.5 / 20, share, 1.0 if share > 0.8 else 0.0, min(blocks[k], 20) / 10, ends[k] / max(1, blocks[k]), 1.0 if size[k] < 40 else 0.0)
            for f, v in enumerate(numbers):
                if v:
                    node.append(base + k)
                    feat.append(f)
                    value.append(v)
            parent.append(base + p if p >= 0 else -1)
            depth.append(level[k])
        base += n
    first.append(base)
    return np.array(node, np.int64), np.array(feat, np.int64), np.array(value), np.array(parent, np.int64), np.array(depth, np.int64), np.array(first, np.int64)


def tree_messages(score: np.ndarray, parent: np.ndarray, depth: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log ratios (inside, up, down) by sum-product: of a subtree, of its message to its parent, and from it."""
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(depth.max() + 2)) if len(depth) else np.zeros(1, int)
    inside, up, down = score.copy(), np.zeros(len(score)), np.zeros(len(score))
    for level in range(len(cuts) - 2, 0, -1):
        k = order[cuts[level] : cuts[level + 1]]
        e = np.exp(np.clip(inside[k], -30, 30))
        up[k] = np.log((t[1, 0] + t[1, 1] * e) / (t[0, 0] + t[0, 1] * e))
        np.add.at(inside, parent[k], up[k])
    for level in range(1, len(cuts) - 1):
        k = order[cuts[level] : cuts[level + 1]]
        p = parent[k]
        e = np.exp(np.clip(inside[p] + down[p] - up[k], -30, 30))  # the parent without this child
        down[k] = np.log((t[0, 1] + t[1, 1] * e) / (t[0, 0] + t[1, 0] * e))
    return inside, up, down


@dataclass
class Model:
    known: dict[str, int]
    weights: np.ndarray
    edges: np.ndarray

    def marginals(self, pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
        node, feat, value, parent, depth, first = features(pages, self.known)
        score = np.bincount(node, weights=value * self.weights[feat], minlength=first[-1])
        inside, _, down = tree_messages(score, parent, depth, np.exp(self.edges))
        return 1 / (1 + np.exp(-np.clip(inside + down, -30, 30))), first


def train(pages: list[str], rounds: int = 150) -> Model:
    """Weights that maximise the likelihood of the pages' labels, less a ridge."""
    parsed = [parse(p, labelled=True) for p in pages]
    words = sorted({w for p in parsed for k in range(len(p.tags)) for w in node_words(p, k)})
    known = {w: i + len(NUMBERS) for i, w in enumerate(words)}
    node, feat, value, parent, depth, first = features(parsed, known)
    y = np.concatenate([p.labels for p in parsed]).astype(float)
    size = len(NUMBERS) + len(words)
    weights, edges = np.zeros(size), np.zeros((2, 2))
    memory_w, memory_e = np.full(size, 1e-8), np.full((2, 2), 1e-8)
    inner = np.flatnonzero(parent >= 0)
    seen = np.bincount((y[parent[inner]] * 2 + y[inner]).astype(int), minlength=4).reshape(2, 2)
    n = len(y)
    for _ in range(rounds):
        score = np.bincount(node, weights=value * weights[feat], minlength=n)
        t = np.exp(edges)
        inside, up, down = tree_messages(score, parent, depth, t)
        p = 1 / (1 + np.exp(-np.clip(inside + down, -30, 30)))
        above = np.exp(np.clip(inside[parent[inner]] + down[parent[inner]] - up[inner], -30, 30))
        below = np.exp(np.clip(inside[inner], -30, 30))
        cells = np.stack([t[0, 0] * np.ones(len(inner)), t[0, 1] * below, t[1, 0] * above, t[1, 1] * above * below])
        expected = (cells / cells.sum(axis=0)).sum(axis=1).reshape(2, 2)
        grad_w = np.bincount(feat, weights=value * (y - p)[node], minlength=size) / n - 2e-4 * weights
        grad_e = (seen - expected) / n - 2e-4 * edges
        memory_w += grad_w**2
        memory_e += grad_e**2
        weights += 0.5 * grad_w / np.sqrt(memory_w)
        edges += 0.3 * grad_e / np.sqrt(memory_e)
    return Model(known, weights, edges)


@lru_cache(maxsize=1)
def default_model() -> Model:
    return train(labelled_pages())


def extract_texts(htmls: list[str], model: Model) -> list[str]:
    pages = [parse(h) for h in htmls]
    p, first = model.marginals(pages)
    return ["\n".join(text for k, text, _ in page.blocks if p[first[i] + k] >= 0.5) for i, page in enumerate(pages)]


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = extract_texts([h or "" for h in part.column("html").to_pylist()], model)
                yield pa.record_batch({"page_id": part.column("page_id"), "url": part.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return columns(pages, page_id="long", url="string", html="string").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
