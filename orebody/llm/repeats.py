"""Removal of long repeated strings by suffix arrays.

Every byte under a string of ``LENGTH`` bytes that also starts anywhere else goes.

Any such string holds ``LENGTH - GRAM + 1`` grams of ``GRAM`` bytes, and the least of their
hashes (the leftmost, where equal) stands at the same place in all its copies: an anchor.
Anchors whose gram is unique in the corpus are dropped.  An anchor's context is the bytes
of all strings that can be anchored there; equal contexts are one, and repeated as a whole.

The places of strings around an anchor are cut into ``TESTS`` ranges of ``STRIDE``.  All
strings of a range hold the same ``CORE`` bytes, so contexts that share one agree on that
core and meet in the shard of its key; there they differ in no more than the ``STRIDE``
bytes on either side.  A shard builds a suffix array of those sides (Larsson-Sadakane: ranks
double, sorted groups are left alone) with common prefixes (Kasai's, along many lanes at
once), and finds the strings that stand at the same place of several contexts.  The
strings that a context shares all hold its gram, so what they cover is one run of bytes and
the least and the greatest place say it all.

A core with very many contexts is spread over several shards.  Each of them publishes its
distinct strings in sorted order, cut by binary search at the bounds of the ranges in which
the runs of all shards are merged.

Grams, cores and published strings are compared by 64-bit hashes (gram and core together
are a key of 128 bits, as are a row's id and hash), the sides in a shard byte by byte.

Defined results: a null text is empty; a text below ``LENGTH`` bytes loses nothing; rows
that repeat both doc_id and text are documents that repeat each other; a null doc_id is
kept as null; an empty table gives an empty result.  Columns other than doc_id and text are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .passages import sharing
from .shared import HOT_KEYS, ROW, batch_rows, columns, settle, spread_join
from .textnp import as_bytes, least_of_runs, mix, prefix_hash, slices, span_hash

LENGTH = 400
GRAM = 128
REACH = LENGTH - GRAM
#: Ranges of places around an anchor, the places of each, and the bytes that all strings of one hold.
TESTS = 4
STRIDE = REACH // TESTS
CORE = LENGTH - STRIDE
#: Rows of a core that one shard takes, and rows at which a shard is closed.
CROWD = 4096
SHARD_ROWS = 16_384
#: Bytes of published strings in a range, and crowded cores that are broadcast (beyond, they are joined by a shuffle).
RANGE_BYTES = 8_000_000
BROADCAST_CORES = 100_000
#: A text beyond this is scanned in overlapping parts.
PART = 1 << 22


def least_places(hashes: np.ndarray) -> np.ndarray:
    """Places of the leftmost least hash of every run of REACH + 1 hashes."""
    least = least_of_runs(hashes, REACH)
    change = np.ones(len(least), bool)
    change[1:] = least[1:] != least[:-1]
    return np.unique(least[change])


def anchors_of(docs: DataFrame) -> DataFrame:
    """(gram, context, *ROW, pos, left, right) of every anchor of rows (*ROW, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = as_bytes(part.column("text"))
                doc, row = (part.column(c).to_numpy() for c in ROW)
                prefix = prefix_hash(data)
                if len(data) < LENGTH:
                    continue
                at = np.arange(len(data) - GRAM + 1)
                grams = span_hash(prefix, at, at + GRAM)
                places, owner = [], []
                for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
                    found = [least_places(grams[s : min(s + PART + REACH, b - GRAM + 1)]) + s for s in range(a, b - LENGTH + 1, PART)]
                    if found:
                        found = np.unique(np.concatenate(found)) if len(found) > 1 else found[0]
                        places.append(found)
                        owner.append(np.full(len(found), i))
                if not places:
                    continue
                pos, owner = np.concatenate(places), np.concatenate(owner)
                left = np.minimum(pos - offsets[owner], REACH)
                right = np.minimum(offsets[owner + 1] - pos, LENGTH)
                context = mix(span_hash(prefix, pos - left, pos + right) ^ (left * 1024 + right).astype(np.uint64))
                yield pa.record_batch(
                    {
                        "gram": pa.array(grams[pos].view(np.int64)),
                        "context": pa.array(context.view(np.int64)),
                        "doc": pa.array(doc[owner]),
                        "row": pa.array(row[owner]),
                        "pos": pa.array((pos - offsets[owner]).astype(np.int64)),
                        "left": pa.array(left.astype(np.int32)),
                        "right": pa.array(right.astype(np.int32)),
                    }
                )

    return docs.mapInArrow(run, "gram long, context long, doc long, row long, pos long, left int, right int")


def words_at(data: np.ndarray, order: str) -> np.ndarray:
    """The eight bytes from every place on as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data)]).view(f"{order}u8").ravel().astype(np.uint64)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Places in the order of their suffixes, in full: the scan for common prefixes relies on it."""
    n = len(data)
    keys = words_at(data, ">")
    order = np.argsort(keys, kind="stable")
    sorted_keys = keys[order]
    fresh = np.ones(n, bool)
    fresh[1:] = sorted_keys[1:] != sorted_keys[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    h = 8
    while h < n:
        last = np.ones(n, bool)
        last[:-1] = fresh[1:]
        at = np.flatnonzero(~(fresh & last))  # members of groups that are not yet single
        if not len(at):
            break
        own = order[at]
        ahead = own + h
        key = rank[own] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        sort = np.argsort(key, kind="stable")
        key, own = key[sort], own[sort]
        order[at] = own
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        fresh[at] = new
        rank[own] = np.maximum.accumulate(np.where(new, at, 0))
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, cap: int, lane: int = 128) -> np.ndarray:
    """For each rank, bytes shared with the suffix before it, up to ``cap``.

    Kasai's scan in text order, where each value is at least the one before less one; the
    text is cut into lanes that are scanned side by side.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    words = np.concatenate([words_at(data, "<"), np.zeros(cap + 8, np.uint64)])
    start = np.arange(0, n, lane)
    held = np.zeros(len(start), np.int64)
    out = np.zeros(n, np.int64)
    for s in range(min(lane, n)):
        if s and start[-1] + s >= n:
            start, held = start[:-1], held[:-1]
            if not len(start):
                break
        here = start + s
        there = before[here]
        h = np.maximum(held - 1, 0)
        h[there < 0] = 0
        live = np.flatnonzero((there >= 0) & (h < cap))
        while len(live):
            a, b, g = here[live], there[live], h[live]
            differ = words[a + g] ^ words[b + g]
            whole = differ == 0
            low = differ & (~differ + np.uint64(1))
            # the number of equal low bytes: the place of the lowest bit set, in bytes
            gain = np.where(whole, 8, (np.frexp(low.astype(np.float64))[1] - 1) // 8)
            g = np.minimum(g + gain, np.minimum(cap, n - np.maximum(a, b)))
            h[live] = g
            live = live[whole & (g < np.minimum(cap, n - np.maximum(a, b)))]
        held = h
        out[here] = h
    return out[order]


def shared_places(data: np.ndarray, sizes: np.ndarray, group: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, place, shared) of every string of STRIDE bytes of the texts that ``data`` holds end to end.

    A text's places count back from its ``left`` bytes; a string is shared where another
    text of its group has it at that place.
    """
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    order = suffix_array(data)
    shared = common_prefixes(data, order, STRIDE)
    same = np.empty(len(data), np.int64)
    same[order] = np.cumsum(shared < STRIDE)  # equal where STRIDE bytes are
    count = np.maximum(sizes - STRIDE + 1, 0)
    owner = np.repeat(np.arange(len(sizes)), count)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    place = left[owner] - inner
    key = (same[first[owner] + inner] * (group.max(initial=0) + 1) + group[owner]) * (STRIDE + 1) + place
    order = np.argsort(key, kind="stable")
    equal = key[order][1:] == key[order][:-1]
    on = np.zeros(len(key), bool)
    on[order[1:][equal]] = True
    on[order[:-1][equal]] = True
    return owner, place, on


#: A string as a shard publishes it: its hash, whose it is, its place, and whether its owner asks for others.
STRING = np.dtype([("hash", "<u8"), ("gram", "<i8"), ("context", "<i8"), ("place", "<i2"), ("asks", "u1")])
FOUND = "gram long, context long, a int, b int"


def least_and_greatest(gram: np.ndarray, context: np.ndarray, a: np.ndarray, b: np.ndarray) -> dict:
    """One row for each context, with the least ``a`` and the greatest ``b``."""
    order = np.lexsort((context, gram))
    gram, context, a, b = gram[order], context[order], a[order], b[order]
    cut = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])])) if len(gram) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(a, cut) if len(cut) else a
    greatest = np.maximum.reduceat(b, cut) if len(cut) else b
    return {"gram": pa.array(gram[cut], pa.int64()), "context": pa.array(context[cut], pa.int64()), "a": pa.array(least.astype(np.int32)), "b": pa.array(greatest.astype(np.int32))}


def resolve(rows: pa.RecordBatch, ranges: int) -> Iterator[pa.RecordBatch]:
    """What whole groups of rows (gram, core, salt, crowded, hull, context, j, nl, nr, alone, bytes) share, and what is published of crowded ones."""
    gram, core, hull, context = (rows.column(c).to_numpy() for c in ("gram", "core", "hull", "context"))
    salt, j, nl, nr = (rows.column(c).to_numpy().astype(np.int64) for c in ("salt", "j", "nl", "nr"))
    alone, crowded = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("alone", "crowded"))
    data, offsets = as_bytes(rows.column("bytes"))
    change = np.ones(len(gram), bool)
    change[1:] = (gram[1:] != gram[:-1]) | (core[1:] != core[:-1]) | (salt[1:] != salt[:-1])
    group = np.cumsum(change) - 1
    # a row of documents that repeat id and text comes as often as they do
    order = np.lexsort((context, group))
    once = np.ones(len(order), bool)
    once[1:] = (group[order][1:] != group[order][:-1]) | (context[order][1:] != context[order][:-1])
    on = np.sort(order[once])
    on = on[(np.bincount(group[on], minlength=group[-1] + 1)[group[on]] > 1) | crowded[on]]
    if not len(on):
        return
    # equal hulls share all their strings; the first of them stands for the others
    order = on[np.lexsort((hull[on], group[on]))]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (group[order][1:] != group[order][:-1]) | (hull[order][1:] != hull[order][:-1])
    kind = np.cumsum(fresh) - 1
    rep = order[fresh]
    often = np.bincount(kind) > 1
    low, high = np.where(often, STRIDE - nr[rep], STRIDE + 1), np.where(often, nl[rep], -1)
    kinds = np.bincount(group[rep], minlength=group[-1] + 1)[group[rep]]
    tried = np.flatnonzero((kinds > 1) | crowded[rep])
    if len(tried):
        own = rep[tried]
        size = nl[own] + nr[own]
        ends = np.cumsum(size)
        text = data[np.repeat(offsets[own] - (ends - size), size) + np.arange(ends[-1])]
        owner, place, shared = shared_places(text, size, group[own], nl[own])
        np.minimum.at(low, tried[owner[shared]], place[shared])
        np.maximum.at(high, tried[owner[shared]], place[shared])
        public = crowded[own][owner]
        if public.any():
            yield from published(text, own, owner[public], place[public], (ends - size), low[tried], high[tried], group, gram, core, context, j, nl, alone, ranges)
    # the least place starts farthest before the anchor
    told = np.flatnonzero(alone[order] & (high[kind] >= low[kind]))
    who, what = order[told], kind[told]
    if len(who):
        found = least_and_greatest(gram[who], context[who], -(STRIDE * j[who] + high[what]), -(STRIDE * j[who] + low[what]))
        yield pa.record_batch(found | {"range": pa.nulls(len(found["gram"]), pa.int32()), "strings": pa.nulls(len(found["gram"]), pa.binary())})


def published(text, own, owner, place, start, low, high, group, gram, core, context, j, nl, alone, ranges: int) -> Iterator[pa.RecordBatch]:
    """The distinct strings of a shard's crowded cores as sorted runs, a row for each range of hashes."""
    row = own[owner]
    at = start[owner] + nl[row] - place
    seed = mix(gram[row].view(np.uint64) ^ mix(core[row].view(np.uint64))) + place.astype(np.uint64)
    hashes = mix(span_hash(prefix_hash(text), at, at + STRIDE) ^ seed)
    out = np.empty(len(row), STRING)
    out["hash"], out["gram"], out["context"] = hashes, gram[row], context[row]
    out["place"] = -(STRIDE * j[row] + place)
    # places between two that are known to be shared say nothing new
    out["asks"] = alone[row] & ((place < low[owner]) | (place > high[owner]))
    # one of the equal strings of a group; those of two groups of one core are for the merge to find
    order = np.lexsort((group[row], hashes))
    out, owned = out[order], group[row][order]
    once = np.ones(len(out), bool)
    once[1:] = (out["hash"][1:] != out["hash"][:-1]) | (owned[1:] != owned[:-1])
    out = out[once]
    bounds = (np.arange(ranges + 1, dtype=np.float64) / ranges * 2.0**64)[1:-1].astype(np.uint64)
    cuts = np.concatenate([[0], np.searchsorted(out["hash"], bounds), [len(out)]])
    full = np.flatnonzero(np.diff(cuts))
    none = pa.nulls(len(full), pa.int64())
    raw = pa.array([out[cuts[k] : cuts[k + 1]].tobytes() for k in full], pa.binary())
    yield pa.record_batch({"gram": none, "context": none, "a": none.cast(pa.int32()), "b": none.cast(pa.int32()), "range": pa.array(full.astype(np.int32)), "strings": raw})


def shards(work: DataFrame, ranges: int) -> DataFrame:
    """(gram, context, a, b) of places shared within a shard, and (range, strings) for what is merged across shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < SHARD_ROWS:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            keys = [whole.column(c).to_numpy() for c in ("gram", "core", "salt")]
            last = size - 1
            ends = np.flatnonzero(np.logical_or.reduce([k[:-1] != k[last] for k in keys]))
            cut = int(ends[-1]) + 1 if len(ends) else 0  # the last group may go on
            if cut:
                yield from resolve(whole.slice(0, cut), ranges)
            held, size = [whole.slice(cut)], whole.num_rows - cut
        if size:
            yield from resolve(pa.Table.from_batches(held).combine_chunks().to_batches()[0], ranges)

    return work.mapInArrow(run, f"{FOUND}, range int, strings binary")


def merged(runs: DataFrame) -> DataFrame:
    """(gram, context, a, b): places of asking strings that several shards have published; rows stand range by range."""

    def merge(parts: list[bytes]) -> pa.RecordBatch:
        strings = np.concatenate([np.frombuffer(p, STRING) for p in parts])
        order = np.argsort(strings["hash"], kind="stable")
        sorted_ = strings["hash"][order]
        equal = sorted_[1:] == sorted_[:-1]
        on = np.zeros(len(strings), bool)
        on[order[1:][equal]] = True
        on[order[:-1][equal]] = True
        asked = strings[on & (strings["asks"] > 0)]
        place = asked["place"].astype(np.int32)
        return pa.record_batch(least_and_greatest(asked["gram"].copy(), asked["context"].copy(), place, place))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        at = None
        for batch in batches:
            for key, strings in zip(batch.column("range").to_pylist(), batch.column("strings").to_pylist()):
                if held and key != at:
                    yield merge(held)
                    held = []
                at = key
                held.append(strings)
        if held:
            yield merge(held)

    return runs.mapInArrow(run, FOUND)


def sides(texts: DataFrame) -> DataFrame:
    """A row for each range of places of each wanted context of ``texts`` (text, wants).

    gram, core: the key; hull: hash of all bytes under the range's strings; j: the range;
    nl, nr: bytes beside the core, which ``bytes`` holds; alone: whether the context stands once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = as_bytes(part.column("text"))
                wants = part.column("wants")
                owner = np.repeat(np.arange(part.num_rows), wants.value_lengths().to_numpy())
                want = wants.flatten()
                gram, context, n, pos, left, right = (want.field(c).to_numpy().astype(np.int64) for c in ("gram", "context", "n", "pos", "left", "right"))
                at = offsets[owner] + pos
                prefix = prefix_hash(data)
                for j in range(TESTS):
                    before, behind = STRIDE * j, CORE - STRIDE * j
                    nl, nr = np.minimum(left - before, STRIDE), np.minimum(right - behind, STRIDE)
                    on = np.flatnonzero((nl >= 0) & (nr >= 0) & (nl + nr >= STRIDE))
                    nl, nr, start = nl[on], nr[on], at[on] - before
                    core = mix(span_hash(prefix, start, start + CORE) ^ np.uint64(j))
                    hull = mix(span_hash(prefix, start - nl, start + CORE + nr) ^ (nl * 1024 + nr).astype(np.uint64))
                    size = nl + nr
                    ends = np.cumsum(size)
                    inner = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
                    source = np.repeat(start - nl, size) + inner + np.where(inner < np.repeat(nl, size), 0, CORE)
                    raw = pa.Array.from_buffers(pa.binary(), len(on), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes()), pa.py_buffer(data[source].tobytes())])
                    yield pa.record_batch(
                        {
                            "gram": pa.array(gram[on]),
                            "core": pa.array(core.view(np.int64)),
                            "hull": pa.array(hull.view(np.int64)),
                            "context": pa.array(context[on]),
                            "j": pa.array(np.full(len(on), j, np.int16)),
                            "nl": pa.array(nl.astype(np.int16)),
                            "nr": pa.array(nr.astype(np.int16)),
                            "alone": pa.array(n[on] == 1),
                            "bytes": raw,
                        }
                    )

    return texts.mapInArrow(run, "gram long, core long, hull long, context long, j short, nl short, nr short, alone boolean, bytes binary")


def shared_runs(rows: DataFrame) -> DataFrame:
    """(gram, context, a, b): of each context alone that shares a string, the least and the greatest place of those it shares."""
    spark = rows.sparkSession
    total = rows.count()
    crowds = settle(rows.groupBy("gram", "core").agg(F.count("*").alias("n")).where(F.col("n") > CROWD), "crowds")
    size = crowds.agg(F.count("*").alias("cores"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    known = F.broadcast(crowds) if size["cores"] <= BROADCAST_CORES else crowds
    salt = F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("context"), F.ceil(F.col("n") * 2 / CROWD)))
    dealt = rows.join(known, ["gram", "core"], "left").withColumn("salt", salt.cast("int")).withColumn("crowded", F.col("n").isNotNull()).drop("n")
    # a count of its own, so that no task is merged with others because its bytes are few
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 200_000))
    key = ["gram", "core", "salt"]
    ranges = max(1, -(-size["n"] * (STRIDE + 1) * STRING.itemsize // RANGE_BYTES))
    done = settle(shards(dealt.repartition(parts, *key).sortWithinPartitions(*key), ranges), "shards")
    runs = done.where("range IS NOT NULL").select("range", "strings").repartition(min(ranges, parts), "range").sortWithinPartitions("range")
    found = done.where("range IS NULL").select("gram", "context", "a", "b").unionByName(merged(runs))
    return settle(found.groupBy("gram", "context").agg(F.min("a").alias("a"), F.max("b").alias("b")), "covered")


def repeats(docs: DataFrame) -> DataFrame:
    """(*ROW, spans): byte ranges to remove of every text of rows (*ROW, text) that loses any."""
    anchors = settle(anchors_of(docs.where(F.octet_length("text") >= LENGTH)), "anchors")
    floor = anchors.count() // HOT_KEYS
    grams = anchors.groupBy("gram").agg(F.count("*").alias("n"), F.min("context").alias("low"), F.max("context").alias("high")).where("n > 1")
    grams = settle(grams.select("gram", "n", (F.col("low") != F.col("high")).alias("mixed")), "grams")
    hot = grams.where(F.col("n") > floor).select("gram")
    shared = settle(spread_join(anchors, grams.drop("n"), ["gram"], hot), "shared-anchors")
    mixed = shared.where("mixed")
    contexts = mixed.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct(*ROW, "pos", "left", "right")).alias("first"))
    contexts = settle(contexts, "contexts")

    want = F.struct("gram", "context", "n", "first.pos", "first.left", "first.right").alias("want")
    wanted = contexts.where(f"first.left + first.right >= {LENGTH}").select("first.doc", "first.row", want)
    wanted = wanted.groupBy(*ROW).agg(F.collect_list("want").alias("wants"))  # a text's own anchors
    covered = shared_runs(settle(sides(docs.select(*ROW, "text").join(wanted, ROW)), "sides"))

    alone = contexts.where("n = 1").select("gram", "context", "first.doc", "first.row", "first.pos")
    spans = alone.join(covered, ["gram", "context"]).select(*ROW, (F.col("pos") + F.col("a")).alias("a"), (F.col("pos") + F.col("b") + LENGTH).alias("b"))
    many = contexts.where("n > 1")
    equal = spread_join(mixed, many.select("gram", "context"), ["gram", "context"], many.where(F.col("n") > floor).select("gram", "context"))
    equal = shared.where("NOT mixed").unionByName(equal).where(f"left + right >= {LENGTH}")
    spans = spans.unionByName(equal.select(*ROW, (F.col("pos") - F.col("left")).alias("a"), (F.col("pos") + F.col("right")).alias("b")))
    return spans.groupBy(*ROW).agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans"))  # a text's own ranges


def remove_repeats(docs: DataFrame, with_text: bool = False, with_passages: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeated[, text][, shares_passage]) of every row of ``docs``.

    repeated: whether the text loses any byte; shares_passage: whether a passage of words (``passages``) also stands in another row,
    which may be shorter than ``LENGTH`` and then stays; text: what is left, decoded; where a cut falls inside a character its bytes are replaced.
    """
    docs = columns(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    # a null id counts as the least one; rows of that id are told apart by their text
    docs = docs.withColumn("doc", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("row", F.xxhash64("doc_id", "text"))
    with batch_rows(docs.sparkSession, 1000):
        spans = settle(repeats(docs), "spans")
        passages = settle(sharing(docs.select(*ROW, "text")), "passage-rows") if with_passages else None

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            ids, sizes, gone, runs, sums, texts = [], [], [], [], [], []
            for doc_id, text, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
                raw = text.encode()
                kept, at, removed, count = [], 0, 0, 0
                end = -1
                for span in own or ():
                    a, b = span["a"], span["b"]
                    if a > end:
                        count += 1
                        kept.append(raw[at:a])
                        removed += b - a
                    else:
                        removed += max(0, b - end)
                    end = max(end, b)
                    at = end
                kept.append(raw[at:])
                rest = b"".join(kept)
                ids.append(doc_id)
                sizes.append(len(raw))
                gone.append(removed)
                runs.append(count)
                sums.append(hashlib.sha256(rest).hexdigest())
                # a cut may fall inside a character of the text
                texts.append(rest.decode("utf-8", "replace") if with_text else None)
            out = {"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array(sums), "repeated": pa.array([n > 0 for n in gone], pa.bool_())}
            if with_text:
                out["text"] = pa.array(texts)
            if with_passages:
                out["shares_passage"] = batch.column("shares_passage")
            yield pa.record_batch(out)

    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, repeated boolean" + (", text string" if with_text else "") + (", shares_passage boolean" if with_passages else "")
    found = docs.join(spans, ROW, "left")
    if with_passages:
        found = found.join(passages.withColumn("shares", F.lit(True)), ROW, "left").withColumn("shares_passage", F.coalesce("shares", F.lit(False)))
    return found.select("doc_id", "text", "spans", *["shares_passage"] * with_passages).mapInArrow(drop, ddl)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=True, with_passages=True)
