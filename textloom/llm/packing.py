"""Vector best-fit packing of token sequences.

Every document becomes ids plus an end id and is cut only where it is longer than a sequence (the first piece takes
the remainder). A piece demands three resources: its tokens, one document and the square of its length (attention
cost). Pieces of one length are interchangeable, so the planner works on the histogram of lengths, which has at most
``capacity`` rows whatever the corpus: lengths in descending order, each placed in the open bins that score best, by
the weighted norm of the residual left behind or by the weighted dot product of demand and residual, among those
where every constraint holds. Bins with equal residuals are one group, so a step places thousands of pieces. The plan
is a list of rank ranges; pieces learn their rank within their length from per-partition counts, without a shuffle of
the pieces, and look their range up.

Defined results: null text is empty (one end id); rows with equal doc_id are packed each on their own; other columns
are dropped, null doc_ids stay null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .tokens import ENCODE_BYTES, crc32, encoder
from .vectext import text_slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
SENT_SEGMENTS = 1_000_000  # of the plan, sent to the executors at once (40 bytes each)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all full but the first."""
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """One row a piece, with its partition and its rank among the partition's pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for i, j, text in text_slices(batch.column(1), ENCODE_BYTES):
                ids, before = encode(text)
                names = batch.column(0).slice(i, j - i).to_pylist()
                rows, kept = [], []
                for d, name in enumerate(names):
                    own = np.append(ids[before[d] : before[d + 1]], np.uint32(end_id))
                    for k, (s, n) in enumerate(cut(len(own), capacity)):
                        rows.append((name, k, s, n, crc32(own[s : s + n]), part, int(seen[n])))
                        seen[n] += 1
                        if with_ids:
                            kept.append(own[s : s + n])
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))]
                names_ = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
                if with_ids:
                    cols.append(pa.array(kept, pa.list_(pa.int32())))
                    names_.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names_)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def plan(histogram: dict[int, int], capacity: int, max_docs: int, max_cost: int, weights: tuple[float, float, float], rule: str) -> tuple[np.ndarray, int]:
    """Segments (length, first rank, pieces, first bin, offset) in order, and the number of bins."""
    size = np.array([capacity, max_docs, max_cost], float)
    w = np.array(weights, float)
    left = np.zeros((0, 3), np.int64)  # residuals of the open groups
    spans: list[list[tuple[int, int]]] = []  # bins (first, number) of each group
    groups: dict[tuple[int, ...], int] = {}
    segments: list[tuple[int, int, int, int, int]] = []
    bins = 0
    used = 0  # rows of left in use

    def put(state: tuple[int, ...], span: tuple[int, int]) -> None:
        nonlocal left, used
        if state[0] <= 0 or state[1] <= 0 or state[2] <= 0:
            return
        if state not in groups:
            if used == len(left):
                left = np.concatenate([left, np.zeros((max(64, used), 3), np.int64)])
            groups[state] = used
            left[used] = state
            spans.append([])
            used += 1
        spans[groups[state]].append(span)

    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        need = np.array([length, 1, length * length])
        if (need > size).any():
            raise ValueError(f"a piece of {length} tokens meets no empty bin's limits")
        rank, todo = 0, histogram[length]
        if used > 512 and used > 4 * len(groups):  # forget the groups that are used up
            keep = sorted(groups.values())
            left, spans = left[keep].copy(), [spans[g] for g in keep]
            groups = {tuple(int(x) for x in s): g for g, s in enumerate(left)}
            used = len(keep)
        while todo:
            live = left[:used]
            fits = (live >= need).all(axis=1)
            at = np.flatnonzero(fits)
            if not len(at):
                each = int((size // need).min())  # of this length in an empty bin
                n = -(-todo // each)
                full = todo // each
                for slot in range(each):
                    here = n if slot < todo - full * each or full == n else full
                    if here:
                        segments.append((length, rank, here, bins, slot * length))
                        rank += here
                if full:
                    put(tuple(int(x) for x in size - need * each), (bins, full))
                if n > full:
                    put(tuple(int(x) for x in size - need * (todo - full * each)), (bins + full, 1))
                bins += n
                break
            r = live[at] / size
            d = need / size
            score = -(w * d * r).sum(axis=1) if rule == "dot" else (w * (r - d) ** 2).sum(axis=1)
            g = int(at[np.lexsort((at, score))[0]])
            first, n = spans[g].pop()
            take = min(n, todo)
            state = tuple(int(x) for x in live[g])
            if n > take:
                spans[g].append((first + take, n - take))
            segments.append((length, rank, take, first, capacity - state[0]))
            if not spans[g]:
                del groups[state]
                left[g] = 0
            put(tuple(int(x) for x in np.array(state) - need), (first, take))
            rank += take
            todo -= take
    return np.array(segments, np.int64).reshape(-1, 5), bins


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, max_docs: int | None = None, max_cost: int | None = None, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), rule: str = "norm", with_ids: bool = False) -> DataFrame:
    """Pieces with sequence_id and offset: doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids].

    ``max_docs`` and ``max_cost`` limit the pieces and the summed squared lengths of a sequence; by default neither
    binds. ``rule`` is "norm" (smallest residual norm) or "dot" (largest dot product).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    pieces = scratch.save(token_pieces(docs, tokenizer, end_id, capacity, with_ids), "pieces")
    counts = scratch.save(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    segments, _ = plan(histogram, capacity, max_docs or capacity, max_cost or capacity * capacity, weights, rule)
    segments = segments[np.lexsort((segments[:, 1], segments[:, 0]))]
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    ranked = pieces.join(offsets, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("ahead") + F.col("nth")).alias("rank"), *["ids"] * with_ids)

    def placed(rows: DataFrame, some: np.ndarray) -> DataFrame:
        sent = spark.sparkContext.broadcast(some)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = sent.value
            key = s[:, 0] << 44 | s[:, 1]
            for batch in batches:
                length, rank = np.asarray(batch.column(3)), np.asarray(batch.column(5))
                g = np.searchsorted(key, length << 44 | rank, side="right") - 1
                cols = [*batch.columns[:5], pa.array(s[g, 3] + rank - s[g, 1]), pa.array(s[g, 4]), *batch.columns[6:]]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids])

        return rows.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * with_ids)

    out, at = None, 0
    while out is None or at < len(segments):  # mostly once; a longer plan is applied a range of lengths and ranks at a time
        end = min(len(segments), at + SENT_SEGMENTS)
        here = ranked
        if end - at < len(segments):
            low, high = (f"(length > {n} or length = {n} and rank >= {r})" for n, r in (segments[at, :2], segments[end, :2] if end < len(segments) else (capacity + 1, 0)))
            here = ranked.where(f"{low} and not {high}")
        part = placed(here, segments[at:end])
        out, at = part if out is None else out.unionByName(part), end
    return out


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces with ids: sequence_id, ids and the piece of each position."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("p"))
    return rows.select("sequence_id", F.flatten("p.ids").alias("ids"), F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["offset"].alias("offset"))).alias("pieces"))
