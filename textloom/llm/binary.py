"""Token-id blocks with Elias-Fano document boundaries.

Documents in ascending doc_id order become one long id array (each document's ids, then an end id), stored in blocks
of bounded size. A block is a byte string:

    magic "TLB1", id width in bytes, documents, ids, null doc_ids (the first rows), smallest doc_id
    Elias-Fano list of the documents' ends (ids from the block's start)
    Elias-Fano list of doc_ids less the smallest
    the ids, 2 bytes each if all fit, else 4

An Elias-Fano list of n ascending values below u keeps the low floor(log2(u/n)) bits of each packed, the high parts in
unary, and the position of every 256th one bit, so ``select(i)`` reads one sample and a few words. It takes about
2 + log2(u/n) bits a value instead of 64.

Blocks are rows of a Parquet table (columns shard, block, n_docs, n_tokens, payload), so any store Spark can write to
will do and a lost task writes its blocks anew. ``write`` ranges the documents by doc_id and sorts within a range.

Defined results: null text is empty; null doc_ids come first; rows with equal doc_id are ordered by text; an empty table
has no blocks; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions
from .tokens import ENCODE_BYTES, crc32, encoder
from .vectext import text_slices

MAGIC = b"TLB1"
_HEAD = struct.Struct("<4sBQQQq")
_LIST = struct.Struct("<QBQ")
SAMPLE = 256
BLOCK_IDS = 1 << 20
BLOCK_SCHEMA = "shard int, block int, n_docs long, n_tokens long, payload binary"


class EliasFano:
    """A list of ascending non-negative integers in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        v = values.astype(np.uint64)
        bits = max(0, int(int(v[-1]) + 1).bit_length() - int(n).bit_length())
        low = np.packbits((v[:, None] >> np.arange(bits, dtype=np.uint64)).astype(np.uint8) & 1, bitorder="little") if bits else np.zeros(0, np.uint8)
        ones = ((v >> np.uint64(bits)) + np.arange(n, dtype=np.uint64)).astype(np.int64)
        unary = np.zeros(int(ones[-1]) + 1, np.uint8)
        unary[ones] = 1
        return cls(n, bits, low, np.packbits(unary, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return _LIST.pack(self.n, self.low_bits, len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, bits, n_high = _LIST.unpack_from(data, at)
        at += _LIST.size
        parts = []
        for kind, count in ((np.uint8, (n * bits + 7) // 8), (np.uint8, n_high), ("<u4", -(-n // SAMPLE))):
            parts.append(np.frombuffer(data, kind, count, at))
            at += parts[-1].nbytes
        return cls(n, bits, *parts), at

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        bits = np.unpackbits(self.low[first // 8 : (first + self.low_bits + 7) // 8], bitorder="little")[first % 8 : first % 8 + self.low_bits]
        return int(sum(int(b) << k for k, b in enumerate(bits)))

    def select(self, i: int) -> int:
        """The i-th value, from the sample before it."""
        at = int(self.samples[i // SAMPLE])
        todo = i % SAMPLE
        byte = at // 8
        window = np.unpackbits(self.high[byte : byte + 64], bitorder="little")
        window[: at % 8] = 0
        while True:
            ones = np.flatnonzero(window)
            if todo < len(ones):
                return int(byte * 8 + ones[todo] - i) << self.low_bits | self._low(i)
            todo -= len(ones)
            byte += 64
            window = np.unpackbits(self.high[byte : byte + 64], bitorder="little")

    def select_all(self) -> np.ndarray:
        """All values at once."""
        if not self.n:
            return np.zeros(0, np.int64)
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        if not self.low_bits:
            return high
        bits = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits)
        return high << self.low_bits | bits @ (1 << np.arange(self.low_bits, dtype=np.int64))


class Block:
    """A decoded block; documents are read by position through select."""

    def __init__(self, payload: bytes):
        magic, width, n_docs, n_tokens, self.nulls, self.base = _HEAD.unpack_from(payload, 0)
        if magic != MAGIC:
            raise ValueError("not a token block")
        view = memoryview(payload)
        self.ends, at = EliasFano.from_bytes(view, _HEAD.size)
        self.names, at = EliasFano.from_bytes(view, at)
        self.n_docs = n_docs
        self.ids = np.frombuffer(view, "<u2" if width == 2 else "<u4", n_tokens, at)

    @staticmethod
    def pack(names: list[int | None], ids: np.ndarray, ends: np.ndarray) -> bytes:
        known = [x for x in names if x is not None]
        base = known[0] if known else 0
        width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
        head = _HEAD.pack(MAGIC, width, len(names), len(ids), len(names) - len(known), base)
        offsets = np.array([x - base for x in known], object).astype(np.uint64) if known else np.zeros(0, np.uint64)
        return b"".join([head, EliasFano.encode(ends).to_bytes(), EliasFano.encode(offsets).to_bytes(), ids.astype("<u2" if width == 2 else "<u4").tobytes()])

    def doc(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + (self.names.select_all() + self.base).tolist()


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Writes the blocks to a new table at ``path`` and returns it."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer).encode, TaskContext.get().partitionId()
        names: list[int | None] = []
        parts: list[np.ndarray] = []
        ends: list[int] = []
        number = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            cols = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(names)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([Block.pack(names, ids, np.array(ends, np.int64))], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["shard", "block", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            for i, j, text in text_slices(batch.column(1), ENCODE_BYTES):
                ids, before = encode(text)
                for d, name in enumerate(batch.column(0).slice(i, j - i).to_pylist()):
                    own = ids[before[d] : before[d + 1]]
                    if names and ends[-1] + len(own) + 1 > block_ids:
                        yield flush()
                        number += 1
                        names, parts, ends = [], [], []
                    names.append(name)
                    parts += [own, np.array([end_id], np.uint32)]
                    ends.append((ends[-1] if ends else 0) + len(own) + 1)
        if names:
            yield flush()

    n = partitions(docs)
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)
    return read(spark, path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK_SCHEMA).parquet(path)


def documents(blocks: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row a document, read from the blocks: doc_id, start, n_tokens, ids_crc32[, ids].

    Starts need the ids of all blocks before: sums of shards (one row each) are accumulated, then those of blocks within
    their shard; the payloads take no part in that.
    """
    sizes = blocks.select("shard", "block", "n_tokens")
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    past = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("ahead"))
    inner = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).join(shards, "shard").select("shard", "block", (F.col("inner") + F.col("ahead")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                block = Block(payload.as_py())
                ends = block.ends.select_all()
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                ids = block.ids
                cols = [pa.array(block.doc_ids(), pa.int64()), pa.array(begins + first), pa.array(ends - begins), pa.array([crc32(ids[a:b]) for a, b in zip(begins, ends)], pa.int64())]
                if with_ids:
                    cols.append(pa.array([ids[a:b].astype(np.int32) for a, b in zip(begins, ends)], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    joined = blocks.join(starts, ["shard", "block"]).select("first", "payload")
    return joined.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
