"""Quality rules: base statistics of each text and cross-document line frequency.

The method hashes normalised lines (white space stripped at both ends, A-Z lower-cased), counts in how many distinct
documents of a host (the ``source``) each line occurs, takes the lines above the limit away and rejects a document
that is depleted: fewer than ``min_words`` words are left and less than ``min_share`` of what it had. ``judge`` gives the
verdicts, ``accepted`` the documents that stay, without those lines.

Copies must not turn clean text into boilerplate, so exact copies count as one document: those of one host whose sets of
normalised lines are equal. A line is boilerplate if it exceeds ``max_docs`` documents by that count. Copies with edited
lines are documents of their own here. Deduplication proper is left to the later stages.

Defined results: null text has no words and fails; rows with equal doc_id are judged each on its own text; a null
source is a host of its own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Scratch
from .vectext import Text, list_array, mix, shingles, signed, text_slices

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
WINDOW = 8


def base_stats(text: Text) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each document."""
    n = len(text)
    s, e, d = text.words()
    points = text.code_points_before()
    hashes = text.hash_ranges(s, e)
    sums = lambda values, at: np.bincount(at, weights=values, minlength=n).astype(np.int64)
    # A line equals an earlier one of its document.
    ls, le, ld = text.lines()
    lh = text.hash_ranges(ls, le)
    inner_s, inner_e = text.stripped(ls, le)
    worded = np.flatnonzero(inner_e > inner_s)
    order = worded[np.lexsort((worded, lh[worded], ld[worded]))]
    again = np.zeros(len(order), bool)
    again[1:] = (lh[order][1:] == lh[order][:-1]) & (ld[order][1:] == ld[order][:-1])
    # Words inside windows that occur twice or more in the document.
    repeat = np.zeros(len(s) + 1, np.int64)
    if len(s) >= WINDOW:
        first = np.flatnonzero(d[: len(s) - WINDOW + 1] == d[WINDOW - 1 :])
        h, owner = shingles(hashes, d, n, WINDOW)
        full = np.bincount(d, minlength=n) >= WINDOW
        h = h[full[owner]]
        o = np.lexsort((h, d[first]))
        same = (h[o][1:] == h[o][:-1]) & (d[first][o][1:] == d[first][o][:-1])
        twice = np.zeros(len(o), bool)
        twice[1:] |= same
        twice[:-1] |= same
        at = first[o[twice]]
        np.add.at(repeat, at, 1)
        np.add.at(repeat, at + WINDOW, -1)
    covered = np.cumsum(repeat[:-1]) > 0
    return {
        "n_words": np.bincount(d, minlength=n),
        "word_chars": sums(points[e] - points[s], d),
        "n_symbols": np.bincount(text.owner(np.flatnonzero(_SYMBOL[text.data])), minlength=n),
        "n_dup_lines": np.bincount(ld[order[again]], minlength=n),
        "n_repeat_words": np.bincount(d[covered], minlength=n),
    }


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def profiles(docs: DataFrame) -> DataFrame:
    """Base statistics, a hash of the text and, of each distinct worded line, its hash and words; ``line_set`` is a hash of the set of lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, text in text_slices(batch.column(3)):
                stats = base_stats(text)
                ls, le, ld = text.lines()
                s, e = text.stripped(ls, le)
                h = signed(text.hash_ranges(s, e, lower=True))
                ws, _, _ = text.words()
                words = np.searchsorted(ws, le) - np.searchsorted(ws, ls)
                full = words > 0
                h, words, ld = h[full], words[full], ld[full]
                order = np.lexsort((h, ld))
                h, words, ld = h[order], words[order], ld[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (ld[1:] != ld[:-1])
                at = np.flatnonzero(new)
                total = np.add.reduceat(words, at) if len(at) else words[:0]
                cuts = np.searchsorted(ld[at], np.arange(1, j - i))
                hs, ws_ = np.split(h[at], cuts), np.split(total, cuts)
                with np.errstate(over="ignore"):
                    sets = signed(np.array([mix(x.view(np.uint64)).sum(dtype=np.uint64) for x in hs], np.uint64))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(3)), *(pa.array(stats[k].astype(np.int64)) for k in STATS), pa.array(sets), list_array(hs, pa.int64()), list_array(ws_, pa.int64())], ["doc_id", "source", "text_hash", *STATS, "line_set", "lines", "line_words"])

    schema = "doc_id long, source string, text_hash long, " + ", ".join(f"{k} long" for k in STATS) + ", line_set long, lines array<long>, line_words array<long>"
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text").mapInArrow(run, schema)


def judge(docs: DataFrame, max_docs: int = 20, min_words: int = 20, min_share: float = 0.2, max_repeat_percent: int = 30, with_lines: bool = False) -> DataFrame:
    """One row a document: doc_id, the base statistics, n_lost_words, base_failed, kept; ``with_lines`` adds source, text_hash and lost_lines."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.save(profiles(docs).withColumn("row", F.monotonically_increasing_id()), "profiles")
    lines = found.select("row", F.coalesce("source", F.lit("")).alias("host"), F.col("source").isNull().alias("nohost"), "line_set", F.explode(F.arrays_zip("lines", "line_words")).alias("l"))
    lines = lines.select("row", "host", "nohost", "line_set", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
    key = ["host", "nohost", "line"]
    frequent = lines.select(*key, "line_set").distinct().groupBy(*key).agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > max_docs)
    lost = lines.join(frequent.select(*key), key).groupBy("row").agg(F.sum("words").alias("n_lost_words"), *[F.collect_list("line").alias("lost_lines")] * with_lines)
    out = found.drop("lines", "line_words", "line_set", *[] if with_lines else ["source", "text_hash"]).join(lost, "row", "left").drop("row").withColumn("n_lost_words", F.coalesce("n_lost_words", F.lit(0)))
    out = out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    rest = F.col("n_words") - F.col("n_lost_words")
    depleted = (F.col("n_lost_words") > 0) & (rest < min_words) & (rest < min_share * F.col("n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def without_lines(rows: DataFrame) -> DataFrame:
    """rows with the lines whose hashes are in ``lost_lines`` taken out of ``text``; the column ``lost_lines`` goes."""
    names = [c for c in rows.columns if c != "lost_lines"]
    schema = StructType([f for f in rows.schema if f.name != "lost_lines"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lost, column = batch.column("lost_lines"), batch.column("text")
            hit = np.flatnonzero(np.asarray(lost.is_valid()))
            if len(hit):
                cleaned, gone = column.to_pylist(), lost.take(pa.array(hit)).to_pylist()
                for i, j, text in text_slices(column.take(pa.array(hit))):
                    ls, le, ld = text.lines()
                    s, e = text.stripped(ls, le)
                    h = signed(text.hash_ranges(s, e, lower=True))
                    cuts = np.searchsorted(ld, np.arange(j - i + 1))
                    for k in range(j - i):
                        own = np.arange(cuts[k], cuts[k + 1])
                        stay = own[~(np.isin(h[own], gone[i + k]) & (e[own] > s[own]))]
                        cleaned[hit[i + k]] = b"\n".join(text.data[ls[x] : le[x]].tobytes() for x in stay).decode()
                column = pa.array(cleaned, column.type)
            yield pa.RecordBatch.from_arrays([column if c == "text" else batch.column(c) for c in names], names)

    return rows.mapInArrow(run, schema)


def accepted(docs: DataFrame, **limits) -> DataFrame:
    """The rows of docs that are kept, without the lines above the limit; all other columns are unchanged."""
    key = {"__id": F.col("doc_id").cast("long"), "__host": F.col("source").cast("string"), "__text": F.xxhash64(F.coalesce("text", F.lit("")))}
    verdicts = judge(docs, with_lines=True, **limits).where("not kept or lost_lines is not null")
    # Rows equal in all three have one verdict.
    changed = verdicts.groupBy("doc_id", F.col("source").alias("host"), "text_hash").agg(F.first("kept").alias("__kept"), F.first("lost_lines").alias("lost_lines"))
    marked = docs.withColumns(key)
    same = marked["__id"].eqNullSafe(changed["doc_id"]) & marked["__host"].eqNullSafe(changed["host"]) & (marked["__text"] == changed["text_hash"])
    stay = marked.join(changed, same, "left").where(F.coalesce("__kept", F.lit(True)))
    return without_lines(stay.select(*[marked[c] for c in docs.columns], "lost_lines"))
