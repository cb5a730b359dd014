"""Token ids as fixed-width bit-packed files.

Texts are dealt out by ranges of doc_id, so that the files in order are the corpus in
order; each task encodes its texts, appends the end id and writes blocks of whole
documents.  A block's row holds its ids in the least bits that the vocabulary needs, most
significant bit first, and the offsets of its documents: numpy unpacks it as a whole, and
one document is read from its block alone.

A word between ASCII blanks encodes the same wherever it stands (the vocabulary's own
pattern never crosses white space), so a worker has the library encode a distinct word once.

Defined results: a null or empty text is the end id alone; a null doc_id sorts first;
rows that repeat an id follow one another, ordered by a hash of their text; an empty
table writes no block and reads back empty.  Columns other than doc_id and text are
ignored.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import batch_rows, columns, scratch
from .textnp import slices

END_ID = 2
#: A block closes at this many ids; a longer document is a block of its own.
BLOCK_IDS = 1 << 16
#: Distinct words, and parts of words, that a worker remembers at least.
REMEMBERED_WORDS, REMEMBERED_PARTS = 250_000, 500_000
#: Texts in an Arrow batch.
BATCH_TEXTS = 500
#: The normalizer and pattern of a vocabulary whose words can be encoded apart.
WORD_RULES = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
]
#: ASCII marks, which the vocabulary's pattern takes as one run behind letters.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

#: Letters below this are Latin.
LATIN_END = "\u0250"
#: The letters that stand for bytes: printable ones for themselves, the others by rising numbers from 256 on.
PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LETTERS = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in PRINTED)}

BLOCKS = pa.schema(
    [
        ("shard", pa.int32()),
        ("block", pa.int32()),
        ("first", pa.int64()),
        ("bits", pa.int32()),
        ("doc_ids", pa.list_(pa.int64())),
        ("doc_sizes", pa.list_(pa.int64())),
        ("packed", pa.binary()),
    ]
)
BLOCKS_DDL = "shard int, block int, first long, bits int, doc_ids array<long>, doc_sizes array<long>, packed binary"


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as ``bits`` bits each, most significant first; the last byte is filled with zeros."""
    ids = np.asarray(ids, np.uint32)
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    places = np.arange(bits - 1, -1, -1, dtype=np.uint32)
    return np.packbits(((ids[:, None] >> places) & 1).astype(np.uint8).ravel()).tobytes()


def unpack(packed: bytes, bits: int, count: int, start: int = 0) -> np.ndarray:
    """``count`` ids from the ``start``-th on; only their own bytes are touched."""
    if bits in (8, 16, 32):
        return np.frombuffer(packed, f">u{bits // 8}", count, start * bits // 8).astype(np.uint32)
    low, high = start * bits // 8, -(-(start + count) * bits // 8)
    flat = np.unpackbits(np.frombuffer(packed, np.uint8, high - low, low))[start * bits - low * 8 :][: count * bits]
    return flat.reshape(count, bits) @ (np.uint32(1) << np.arange(bits - 1, -1, -1, dtype=np.uint32))


class Memo(dict):
    """What ``make`` gives for a key, remembered for one to two times ``limit`` keys, those asked for last."""

    def __init__(self, make: Callable[[str], bytes], limit: int):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.older = self.copy()
            self.clear()
        self[key] = value
        return value


_encoders: dict[str, Callable[[str], bytes]] = {}


def encoder(path: str) -> Callable[[str], bytes]:
    """A function from a text to its ids as little-endian 32-bit bytes.

    Where the vocabulary's own normalizer composes (NFC) and lower-cases, and its pattern
    takes letters and runs of marks apart, a composed text may be lower-cased at once, and
    a word of letters with marks behind it is the ids of its letters and those of its
    marks; a worker then has the library's model encode each such part once (Latin words in
    their byte letters, others as texts) for as long as it remembers it.  Sigma, whose lower case depends on its place in Python alone, is left to
    the library.  Any other vocabulary encodes whole texts.
    """
    if path in _encoders:
        return _encoders[path]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def whole(text: str) -> bytes:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    rules = json.loads(tokenizer.to_str())
    if [rules.get(k) for k in ("normalizer", "pre_tokenizer")] != WORD_RULES:
        _encoders[path] = whole
        return whole
    split = tokenizer.model.tokenize

    def part_ids(part: str) -> bytes:
        if part.isalpha() and part.islower() and (part.isascii() or max(part) < LATIN_END and unicodedata.is_normalized("NFC", part)):
            # one word of the pattern, which no normalizer changes
            ids = [t.id for t in split(part if part.isascii() else part.encode().decode("latin-1").translate(BYTE_LETTERS))]
        else:
            ids = tokenizer.encode(part, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    parts = Memo(part_ids, REMEMBERED_PARTS)

    def word_ids(word: str) -> bytes:
        core = word.rstrip(MARKS)
        if core.isalpha() and core.lower().isalpha():
            return parts[core] if len(core) == len(word) else parts[core] + parts[word[len(core) :]]
        return parts[word] if word else b""

    words = Memo(word_ids, REMEMBERED_WORDS)

    def encode(text: str) -> bytes:
        if text.isascii():
            text = text.lower()
        elif "\u03a3" not in text and unicodedata.is_normalized("NFC", text):
            small = text.lower()
            text = small if unicodedata.is_normalized("NFC", small) else text
        return b"".join(map(words.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))

    _encoders[path] = encode
    return encode


def vocabulary_bits(path: str) -> int:
    from tokenizers import Tokenizer

    return max(1, int(Tokenizer.from_file(path).get_vocab_size(True) - 1).bit_length())


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str) -> None:
    bits = vocabulary_bits(tokenizer_path)
    end = np.array([END_ID], "<u4").tobytes()
    if END_ID >= 1 << bits:
        raise ValueError(f"the end id {END_ID} does not fit {bits} bits")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        ids: list[bytes] = []
        names: list[int | None] = []
        sizes: list[int] = []

        def close() -> pa.RecordBatch:
            nonlocal block, first, ids, names, sizes
            packed = pack(np.frombuffer(b"".join(ids), "<u4"), bits)
            row = [[shard], [block], [first], [bits], [names], [sizes], [packed]]
            out = pa.record_batch([pa.array(v, t) for v, t in zip(row, BLOCKS.types)], schema=BLOCKS)
            block, first, ids, names, sizes = block + 1, first + sum(sizes), [], [], []
            return out

        held = 0
        for batch in batches:
            for part in slices(batch):
                for name, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    code = encode(text or "") + end
                    names.append(name)
                    sizes.append(len(code) // 4)
                    ids.append(code)
                    held += len(code) // 4
                    if held >= BLOCK_IDS:
                        held = 0
                        yield close()
        if names:
            yield close()

    rows = columns(docs, doc_id="long", text="string")
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)
    with batch_rows(docs.sparkSession, BATCH_TEXTS):
        ordered.mapInArrow(blocks, BLOCKS_DDL).write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    files = spark.read.parquet(path)
    # one row for each file of the set, so this window sees as many rows as there were tasks
    sizes = files.groupBy("shard").agg(F.sum(F.aggregate("doc_sizes", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["doc_sizes"], np.int64)
                starts = np.concatenate([[0], np.cumsum(sizes)])
                ids = unpack(row["packed"], row["bits"], int(starts[-1])).astype("<u4")
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts[:-1], starts[1:])]
                yield pa.record_batch(
                    {
                        "shard": pa.array([row["shard"]] * len(sizes), pa.int32()),
                        "doc_id": pa.array(row["doc_ids"], pa.int64()),
                        "at": pa.array(row["first"] + starts[:-1], pa.int64()),
                        "n_tokens": pa.array(sizes, pa.int64()),
                        "ids_crc32": pa.array(sums, pa.int64()),
                    }
                )

    read = files.mapInArrow(documents, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    # bases has a row for each task that wrote, which bounds what is broadcast
    return read.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenize(spark: SparkSession, docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    path = scratch(spark, "tokens")
    write_tokens(docs, path, tokenizer_path or default_tokenizer())
    return read_tokens(spark, path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
