"""Mixing sources to target weights by subset-sum budget fitting.

Targets share the size of all documents in proportion to the sources' weights, but no target exceeds ``max_repeat``
times its source; the excess goes to the others by weight. A source is taken whole as often as its target allows; the
rest of its budget is a subset-sum problem over its histogram of exact document sizes: a proportional share of every
size first, then whole documents from the largest down until the gap fits ``window`` words, then a bounded-knapsack
dynamic programme over the sizes that are left, which finds the sum nearest below the gap. Only counts of each size
are decided there; which documents of a size are taken follows a seeded order.

One source's histogram has at most as many rows as there are distinct sizes, so the fitting task is small however many
documents the source holds. Ranks within a size are found in two levels (counts of 1,024 hash ranges, then ranks
inside the one range that the limit cuts), so a size shared by very many documents is no single task.

Working columns have names of their own beginning with ``__mix_``; columns that docs brings are only passed through.

Defined results: null text has size 0; a null source is a source, last in order; size-0 documents take 0; repeated
rows are separate documents, ordered by doc_id and text, and equal ones are interchangeable; other columns are passed
through, but for ``text`` and columns of the results' names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, seeded
from .vectext import text_slices

RANGES = 1024


P = "__mix_"  # of working columns
SOURCE, SIZE, HASH, RANGE, TEXT = (P + x for x in ("source", "size", "hash", "range", "text"))


def word_sizes(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, the words of the whole text (``__mix_size``) and a hash of the text."""
    given = docs.select(*keep, F.xxhash64("text").alias(TEXT), "text")
    schema = given.drop("text").schema.add(SIZE, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.zeros(batch.num_rows, np.int64)
            for i, j, text in text_slices(batch.column(len(keep) + 1)):
                sizes[i:j] = np.bincount(text.words()[2], minlength=j - i)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep) + 1], pa.array(sizes)], [*keep, TEXT, SIZE])

    return given.mapInArrow(run, schema)


def targets(sizes: list[int], weights: list[float], max_repeat: int) -> list[float]:
    """Shares of sum(sizes) by weight, capped at max_repeat * size, the excess reshared until none is above."""
    out = [0.0] * len(sizes)
    open_, left = list(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        above = [i for i in open_ if left * weights[i] / total > max_repeat * sizes[i]]
        if not above:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in above:
            out[i] = float(max_repeat * sizes[i])
            left -= out[i]
        gone = set(above)
        open_ = [i for i in open_ if i not in gone]
    return out


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int, window: int) -> np.ndarray:
    """How many documents of each size to take, at most ``counts``, for a sum as near below ``budget`` as found.

    The sum is exact whenever the dynamic programme can reach the gap that the first two steps leave.
    """
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.copy()
    take = (counts * (budget / total)).astype(np.int64)
    gap = budget - int((sizes * take).sum())
    while gap < 0:  # rounding of very large numbers
        i = int(np.argmax(take))
        take[i] -= 1
        gap += int(sizes[i])
    order = np.argsort(-sizes)
    for i in order:
        if gap <= window:
            break
        n = min(int(counts[i] - take[i]), (gap - window) // int(sizes[i]) + ((gap - window) % int(sizes[i]) > 0))
        n = min(n, gap // int(sizes[i]))
        take[i] += n
        gap -= n * int(sizes[i])
    # Bounded knapsack over sums 0..gap: the step at which each sum was first reached, and with how many documents.
    limit = int(min(gap, 2 * window))
    by = np.full(limit + 1, -1, np.int64)
    used = np.zeros(limit + 1, np.int64)
    by[0] = len(sizes)
    for i in order[::-1]:
        size, left = int(sizes[i]), int(counts[i] - take[i])
        if size <= 0 or left <= 0 or size > limit:
            continue
        if by[limit] >= 0:
            break
        for k in range(1, min(left, limit // size) + 1):
            new = by[size:] < 0
            source = (by[: limit + 1 - size] >= 0) & ((by[: limit + 1 - size] != i) if k == 1 else (by[: limit + 1 - size] == i) & (used[: limit + 1 - size] == k - 1))
            grown = np.flatnonzero(new & source) + size
            if not len(grown):
                break
            by[grown], used[grown] = i, k
    at = int(np.flatnonzero(by >= 0).max())
    while at:
        i, n = int(by[at]), int(used[at])
        take[i] += n
        at -= n * int(sizes[i])
    return take


def mix(docs: DataFrame, weight: Callable[[int], float] = lambda i: float(i % 3 + 1), max_repeat: int = 3, seed: int = 7, window: int = 20_000) -> DataFrame:
    """docs' columns but text, plus size, source_size, target and taken (words, repeats counted).

    ``weight`` gives the weight of the i-th source in code point order. The driver holds three numbers a source.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    clash = ("text", "size", "source_size", "target", "taken")
    keep = [c for c in docs.columns if c.lower() not in clash]
    sized = scratch.save(word_sizes(docs, keep).withColumn(SOURCE, F.col("source").cast("string")), "sizes")
    histogram = scratch.save(sized.groupBy(F.col(SOURCE).alias("source"), F.col(SIZE).alias("size")).agg(F.count("*").alias("n")), "histogram")
    totals = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("total")).collect()  # one row a source
    totals.sort(key=lambda r: (r["source"] is None, r["source"]))
    aims = targets([r["total"] for r in totals], [weight(i) for i in range(len(totals))], max_repeat)
    plan = spark.createDataFrame([(r["source"], r["total"], t) for r, t in zip(totals, aims)], "source string, source_size long, target double")

    def solve(key: tuple, t: pa.Table) -> pa.Table:
        d = {c: np.asarray(t.column(c).combine_chunks()) for c in ("size", "n", "source_size", "target")}
        order = np.argsort(d["size"])
        sizes, counts = d["size"][order], d["n"][order]
        total, target = int(d["source_size"][0]), float(d["target"][0])
        whole = min(max_repeat, int(target // total)) if total else 0
        extra = fit(sizes, np.where(sizes > 0, counts, 0), int(round(target)) - whole * total, window) if 0 < total and whole < max_repeat else np.zeros(len(sizes), np.int64)
        n = len(sizes)
        source = t.column("source").combine_chunks().take(pa.array(order))
        return pa.table({"source": source, "size": sizes, "source_size": np.full(n, total), "target": np.full(n, target), "whole": np.full(n, whole), "extra": extra, "n": counts})

    asked = histogram.join(plan, histogram["source"].eqNullSafe(plan["source"])).select(histogram["source"], "size", "n", "source_size", "target")
    solved = scratch.save(asked.groupBy("source").applyInArrow(solve, "source string, size long, source_size long, target double, whole long, extra long, n long"), "solved")
    return choose(sized, solved, seed, scratch).select(*keep, "size", "source_size", "target", "taken")


def choose(sized: DataFrame, solved: DataFrame, seed: int, scratch: Scratch) -> DataFrame:
    """Marks the ``extra`` documents of each (source, size) that come first in the seeded order.

    Every (source, size) is dealt over hash ranges of doc_id and text before it is joined, so that one that very many documents
    share is spread over many tasks. A range is taken whole or not at all but for the one in which the limit falls.
    """
    docs = sized.withColumn(HASH, seeded(F.col("doc_id"), F.col(TEXT), seed=seed)).withColumn(RANGE, F.pmod(F.col(HASH), F.lit(RANGES)).cast("int"))
    group = [SOURCE, SIZE]
    ranges = docs.groupBy(*group, RANGE).agg(F.count("*").alias("m"))
    before = Window.partitionBy(*group).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("ahead", F.coalesce(F.sum("m").over(before), F.lit(0)))  # at most RANGES rows a window
    named = solved.select(F.col("source").alias("s"), F.col("size").alias("z"), "source_size", "target", "whole", "extra")
    limits = ranges.join(named, F.col(SOURCE).eqNullSafe(F.col("s")) & (F.col(SIZE) == F.col("z"))).drop("s", "z")
    limits = limits.withColumn("rest", F.least(F.greatest(F.col("extra") - F.col("ahead"), F.lit(0)), F.col("m")))
    limits = scratch.save(limits.select(F.col(SOURCE).alias(P + "s"), F.col(SIZE).alias(P + "z"), F.col(RANGE).alias(P + "r"), *[F.col(c).alias(P + c) for c in ("source_size", "target", "whole", "rest", "m")]), "limits")
    same = docs[SOURCE].eqNullSafe(limits[P + "s"]) & (docs[SIZE] == limits[P + "z"]) & (docs[RANGE] == limits[P + "r"])
    met = docs.join(limits, same)
    inside = F.col(P + "rest").between(1, F.col(P + "m") - 1)
    rank = Window.partitionBy(*group, RANGE).orderBy(HASH, "doc_id", TEXT)
    rest = met.where(~inside).withColumn(P + "one", (F.col(P + "rest") > 0).cast("int"))
    edge = met.where(inside).withColumn(P + "one", (F.row_number().over(rank) <= F.col(P + "rest")).cast("int"))
    both = rest.unionByName(edge)
    return both.withColumns({"size": F.col(SIZE), "source_size": F.col(P + "source_size"), "target": F.col(P + "target"), "taken": F.col(SIZE) * (F.col(P + "whole") + F.col(P + "one"))})


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; rows equal in doc_id, source and text are taken alike, in all as often."""
    given = docs.select(F.col("doc_id"), "source", "text", F.xxhash64("text").alias(P + "t"))
    taken = mix(given, **settings)
    often = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    group = taken.groupBy(F.col("doc_id").alias(P + "d"), F.col("source").alias(P + "s"), F.col(P + "t").alias(P + "h")).agg(F.sum(often).alias(P + "times"), F.count("*").alias(P + "rows")).where(F.col(P + "times") > 0)
    marked = docs.withColumn(P + "t", F.xxhash64("text"))
    rows = marked.join(group, marked["doc_id"].eqNullSafe(group[P + "d"]) & marked["source"].eqNullSafe(group[P + "s"]) & (marked[P + "t"] == group[P + "h"]))
    # Equal rows share their copies: each takes the quotient, and as many of them as the rest says one more.
    nth = F.when(F.col(P + "rows") == 1, F.lit(1)).otherwise(F.row_number().over(Window.partitionBy(P + "d", P + "s", P + "h").orderBy(P + "t")))
    single = rows.where(F.col(P + "rows") == 1).withColumn(P + "mine", F.col(P + "times"))
    several = rows.where(F.col(P + "rows") > 1).withColumn(P + "mine", F.floor(F.col(P + "times") / F.col(P + "rows")) + (nth <= F.col(P + "times") % F.col(P + "rows")).cast("int"))
    rows = single.unionByName(several).where(F.col(P + "mine") > 0)
    return rows.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(P + "mine").cast("int"))).alias(P + "copy")).drop(P + "copy")
