"""Texts of an Arrow column as one byte array: words, word hashes and shingles without a loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words are runs without these bytes.
SPACES = b" \t\n\x0b\x0c\r"
SPACE = np.zeros(256, bool)
SPACE[list(SPACES)] = True
#: Bytes of text worked on at once (a longer text is worked on alone).
SLICE_BYTES = 1_000_000
SHINGLE = 5
LOW = np.uint64((1 << 24) - 1)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


#: A random number for each byte value, from a rule.
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] the polynomial of data[i:j], times base**i."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * powers(len(data))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte runs that depend on their bytes alone."""
    inverse = powers(len(prefix))[1]
    return mix((prefix[ends] - prefix[starts]) * inverse[starts])


def least_of_runs(hashes: np.ndarray, reach: int) -> np.ndarray:
    """The place of the leftmost least hash of every run of ``reach`` + 1 hashes."""
    w = reach + 1
    n = len(hashes)
    if n < w:
        return np.zeros(0, np.int64)
    values = (hashes & ~LOW) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // w) * w, np.uint64(2**64 - 1))
    padded[:n] = values
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[: n - w + 1], ahead[w - 1 : n]) & LOW).astype(np.int64)


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and len(raw) else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - (offsets[0] if len(offsets) else 0)


def slices(batch: pa.RecordBatch, name: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows that hold up to ``limit`` bytes of the named column."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start, base = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        base, start = int(ends[stop - 1]), stop


def spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes outside ``gap`` (a table by byte), cut at the offsets."""
    inside = ~gap[data]
    before = np.ones(len(data), bool)
    before[1:] = ~inside[:-1]
    after = np.ones(len(data), bool)
    after[:-1] = ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts] = True
    after[cuts - 1] = True
    return np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first word of each row and the end) for all words."""
    starts, ends = spans(data, offsets, SPACE)
    hashes = span_hash(prefix_hash(data), starts, ends)
    row = rows_of(starts, offsets)
    return hashes, row, np.searchsorted(row, np.arange(len(offsets)))


def shingle_hashes(hashes: np.ndarray, bounds: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, bounds) of each row's runs of ``size`` words; a shorter row that has words is one run."""
    n = np.diff(bounds)
    counts = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    out_bounds = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out_bounds[1:])
    out = np.empty(out_bounds[-1], np.uint64)
    factors = np.multiply.accumulate(np.full(size, _STEP, np.uint64))
    if len(hashes) >= size:
        run = np.zeros(len(hashes) - size + 1, np.uint64)
        for t in range(size):
            run += hashes[t : t + len(run)] * factors[t]
        run = mix(run)
        long = np.flatnonzero(n >= size)
        take = np.repeat(bounds[:-1][long] - out_bounds[:-1][long], counts[long])
        where = np.repeat(n >= size, counts)
        at = np.flatnonzero(where)
        out[at] = run[at + take]
    for i in np.flatnonzero((n > 0) & (n < size)):
        own = hashes[bounds[i] : bounds[i + 1]]
        out[out_bounds[i]] = mix((own * factors[: len(own)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own)))[0]
    return out, out_bounds
