"""Document fingerprints by threshold-scaled sketches.

A sketch retains every hash of the text's distinct word shingles that lies below a fixed fraction of the hash range, so
its size follows the document, sketches of the same fraction merge by union, and the share of one sketch found in
another estimates containment even between very unequal documents. Retained hashes are below 2^32 * fraction and are
written as eight hex digits each, ascending, after the number of distinct shingles and a hash of their whole set:
``"12:<16 digits>:0a3f..."``. A text of at most ``WHOLE`` distinct shingles retains all its hashes. Two fingerprints are
compared in full if both do, else at the fixed fraction; ``edited_comparison`` has the texts and takes a short one's
share in a longer one from their full sets.

Defined results: null text is empty, its fingerprint has 0 shingles and no hash; a text of fewer words than a shingle has its whole
word sequence as one; rows with equal doc_id are ordered by text, null doc_ids come last; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import partitions
from .vectext import mix, shingle_sets, text_slices

_U = np.uint64
WHOLE = 256


def retained(values: np.ndarray, fraction: float) -> np.ndarray:
    """The upper 32 bits of those hashes that lie below the fraction; ascending."""
    top = values >> _U(32)
    return np.unique(top[top < _U(int(fraction * (1 << 32)))]).astype(np.uint32)


def encode(values: np.ndarray, fraction: float) -> str:
    """Fingerprint of a set of shingle hashes."""
    whole = int(mix(values ^ _U(WHOLE)).sum(dtype=_U))
    return f"{len(values)}:{whole:016x}:{retained(values, 1.0 if len(values) <= WHOLE else fraction).astype('>u4').tobytes().hex()}"


def decode(fingerprint: str) -> tuple[int, np.ndarray]:
    n, _, kept = fingerprint.split(":")
    return int(n), np.frombuffer(bytes.fromhex(kept), ">u4").astype(np.uint32)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of both texts' shingles together."""
    return np.union1d(a, b)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 0.0


def likeness(a: str, b: str, fraction: float) -> float:
    if a == b:
        return 1.0
    (n, x), (m, y) = decode(a), decode(b)
    if max(n, m) > WHOLE:
        x, y = (v[v < int(fraction * (1 << 32))] for v in (x, y))
    return containment(x, y)


def likenesses(pairs: list[tuple[str, str]], fraction: float = 0.125) -> list[float]:
    """Containment of each first fingerprint in the second, estimated unless both are whole; equal sets are alike (1)."""
    return [likeness(a, b, fraction) for a, b in pairs]


def compared_in_full(texts: list[str], others: list[str], pairs: list[tuple[str, str]], shingle: int, fraction: float) -> list[float]:
    """likenesses of the pairs; those of a whole fingerprint in one that isn't are taken from the texts."""
    out = likenesses(pairs, fraction)
    sizes = [[int(f.partition(":")[0]) for f in p] for p in pairs]
    at = [k for k, (n, m) in enumerate(sizes) if 0 < n <= WHOLE < m]
    sets = [[v for _, _, t in text_slices(pa.array([side[k] for k in at], pa.large_string())) for v in shingle_sets(t, shingle, lower=False)] for side in (texts, others)]
    for k, x, y in zip(at, *sets):
        out[k] = containment(x, y)
    return out


def fingerprints(column: pa.Array, shingle: int = 5, fraction: float = 0.125) -> list[str]:
    """Fingerprint of each text of an Arrow string array."""
    out: list[str] = []
    for _, _, text in text_slices(column):
        out += [encode(v, fraction) for v in shingle_sets(text, shingle, lower=False)]
    return out


def with_fingerprint(docs: DataFrame, shingle: int = 5, fraction: float = 0.125) -> DataFrame:
    """docs with a ``fingerprint`` column, in place of one of that name."""
    docs = docs.drop("fingerprint")
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fingerprints(batch.column(at), shingle, fraction), pa.string())], [*names, "fingerprint"])

    return docs.mapInArrow(run, StructType([*docs.schema, StructField("fingerprint", StringType())]))


def chained(docs: DataFrame, runs_per_partition: int = 4) -> DataFrame:
    """doc_id, text and a run number; each partition holds whole runs of consecutive documents in descending order,
    and behind each run the first document of the next one (``extra``), so that every document meets its successor.

    Runs are ranges of doc_id between quantiles. Only doc_ids are read to find them; the one document a run that stands
    behind another is fetched by its id. No text is sent to the driver and texts are shuffled once.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    parts = partitions(docs)
    wanted = max(1, runs_per_partition * parts)
    ids = docs.select("doc_id")
    found = ids.where("doc_id is not null").agg(F.percentile_approx("doc_id", F.lit([k / wanted for k in range(1, wanted)]) if wanted > 1 else F.lit([0.5]), 10 * wanted)).first()[0]
    cuts = sorted({int(x) for x in found or []})  # at most one value a run

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Run 0 has the largest ids; null ids are in a last run of their own."""
        edges = np.array(cuts, np.int64)
        for batch in batches:
            name = batch.column(0)
            run = len(edges) - np.searchsorted(edges, np.asarray(name.fill_null(0)), side="left")
            run = np.where(np.asarray(name.is_null()), len(edges) + 1, run)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(run.astype(np.int32))], [*batch.schema.names, "run"])

    runs = docs.mapInArrow(number, "doc_id long, text string, run int")
    firsts = ids.mapInArrow(number, "doc_id long, run int")
    tops = sorted((r["run"], r["doc_id"]) for r in firsts.groupBy("run").agg(F.max("doc_id").alias("doc_id")).collect())  # one row a run
    after = [(tops[(k + 1) % len(tops)][1], tops[k][0]) for k in range(len(tops))]
    heads = spark.createDataFrame(after, "doc_id long, run int")
    named = F.broadcast(heads.withColumnRenamed("doc_id", "head"))  # one row a run
    behind = docs.join(named, docs["doc_id"].eqNullSafe(named["head"])).groupBy("run", "head").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    both = runs.select("run", F.lit(0).alias("extra"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).unionByName(behind.select("run", F.lit(1).alias("extra"), F.col("head").alias("doc_id"), "text"))
    return both.repartition(parts, "run").sortWithinPartitions("run", "extra", F.col("doc_id").desc_nulls_last(), "text")


def edited_comparison(docs: DataFrame, shingle: int = 5, fraction: float = 0.125) -> DataFrame:
    """Each document against an edited version of itself and against the next document in descending doc_id order:
    the share of its shingles that the other text has.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (run, doc_id, text, fingerprint) that waits for its successor
        for batch in batches:
            at, sizes = 0, np.cumsum(np.asarray(pc.binary_length(batch.column(3)), np.int64))
            while at < batch.num_rows:  # some MB of text at a time
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + (1 << 22), side="right")))
                part = batch.slice(at, end - at)
                at = end
                mine: list[tuple] = []
                nexts: list[tuple] = []
                for r, extra, name, text, own in zip(*(c.to_pylist() for c in part.columns), fingerprints(part.column(3), shingle, fraction)):
                    if held is not None and held[0] == r:
                        mine.append(held)
                        nexts.append((text, own))
                    held = None if extra else (r, name, text, own)
                if mine:
                    yield compared(mine, nexts)

    def compared(mine: list[tuple], nexts: list[tuple]) -> pa.RecordBatch:
        texts, own, other = [m[2] for m in mine], [m[3] for m in mine], [n[1] for n in nexts]
        edited = [t[: len(t) - len(t) // 2] + n[0][: len(t) // 2] for t, n in zip(texts, nexts)]
        changed = fingerprints(pa.array(edited, pa.large_string()), shingle, fraction)
        hashes = [hashlib.sha256(t.encode()).hexdigest() for t in edited]
        cols = [pa.array([m[1] for m in mine], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(hashes, pa.string()), pa.array(own, pa.string()), pa.array(changed, pa.string()), pa.array(compared_in_full(texts, edited, list(zip(own, changed)), shingle, fraction)), pa.array(compared_in_full(texts, [n[0] for n in nexts], list(zip(own, other)), shingle, fraction))]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return chained(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
