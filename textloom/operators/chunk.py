"""Text chunks: trimmed line segments, with runs of short ones merged."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.plans.schemas import SHORT_CHUNK

# How chunks are made and what a scope and a walk cover, as the status tells it.
CHUNK_MODE = "line+short-merge"
POLICIES = {"scope": "the path and what is below it", "walk": "no hidden names, no links, ignore files respected"}


def segments(files: DataFrame) -> DataFrame:
    """Non-empty segments of each line, split at the inline marker, trimmed, without decoration."""
    lines = files.select("rel_path", F.posexplode(T.lines(F.col("body"))).alias("p", "line"))
    parts = lines.select("rel_path", (F.col("p") + 1).alias("line"), F.posexplode(F.split("line", T.CHUNK_MARKER)).alias("seg", "x"))
    return parts.select("rel_path", "line", "seg", T.undecorated(T.trimmed(F.col("x"))).alias("raw")).where("raw <> ''")


# Unicode White_Space, which is what ``(?U)\s`` means; ``str.split`` takes four control characters more for it.
WHITE = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
WHITE_RUN, OTHER_SPACE = re.compile(f"[{WHITE}]+"), re.compile("[\x1c-\x1f]")
DECORATION = re.compile(f"(?:[-*+>] |#+ )[{WHITE}]*")
MADE = "rel_path string, chunk_index int, line_start int, line_end int, raw_text string, spaced string"
ROWS_AT_ONCE, CHARS_AT_ONCE = 256, 4_000_000


def split_body(body: str) -> list[tuple[int, int, str]]:
    """(first line, last line, raw text) of the chunks of a body."""
    out, short = [], False
    for number, line in enumerate(body.split("\n"), 1):  # a carriage return at the end is white space
        for part in line.split(T.CHUNK_MARKER):
            part = part.strip(WHITE)
            if part[:1] in "-*+>#" and (mark := DECORATION.match(part)):
                part = part[mark.end() :]
            if not part:
                continue
            if short and len(part) < SHORT_CHUNK:
                out[-1][1] = number
                out[-1][2].append(part)
            else:
                out.append([number, number, [part]])
            short = len(part) < SHORT_CHUNK
    return [(first, last, "\n".join(parts)) for first, last, parts in out]


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
    names = [c.split(" ")[0] for c in MADE.split(", ")]
    rows, chars = [], 0
    whole = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            for path, raw in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                body = (raw or b"").decode("utf-8", "replace")
                odd = OTHER_SPACE.search(body) is not None
                for i, (first, last, text) in enumerate(split_body(body)):
                    rows.append((path, i, first, last, text, WHITE_RUN.sub(" ", text) if odd else " ".join(text.split())))
                chars += len(body)
                if chars >= CHARS_AT_ONCE and rows:
                    yield whole()
                    rows, chars = [], 0
    if rows:
        yield whole()


def text_chunks(files: DataFrame) -> DataFrame:
    """rel_path, chunk_index, line_start, line_end, raw_text, normalized_text.

    A long segment is a chunk; consecutive short ones are one. A file is split where it is read, so nothing is shuffled; only
    files that share a path (found by a hash of it, which may name more of them) are put together by ``joint_chunks``.
    """
    key = F.xxhash64("rel_path")
    twice = F.broadcast(files.groupBy(key.alias("__path")).agg(F.count("*").alias("__n")).where("__n > 1").select("__path"))  # paths of several files
    rows = files.select("rel_path", "body")
    made = rows.join(twice, key == F.col("__path"), "left_anti").mapInArrow(_split, MADE)
    alone = made.select("rel_path", "chunk_index", "line_start", "line_end", "raw_text", F.lower("spaced").alias("normalized_text"))
    return alone.unionByName(joint_chunks(rows.join(twice, key == F.col("__path"), "left_semi")))


def joint_chunks(files: DataFrame) -> DataFrame:
    """The same by a shuffle: files of the same path are one, their lines in order of their numbers."""
    w = Window.partitionBy("rel_path").orderBy("line", "seg")
    long = F.length("raw") >= SHORT_CHUNK
    starts = segments(files).withColumn("long", long).withColumn("start", (F.col("long") | F.coalesce(F.lag("long").over(w), F.lit(True))).cast("int"))
    numbered = starts.withColumn("chunk_index", (F.sum("start").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    rows = F.array_sort(F.collect_list(F.struct("line", "seg", "raw")))
    out = numbered.groupBy("rel_path", "chunk_index").agg(F.min("line").alias("line_start"), F.max("line").alias("line_end"), F.array_join(F.transform(rows, lambda x: x["raw"]), "\n").alias("raw_text"))
    return out.withColumn("normalized_text", T.normalized(F.col("raw_text")))


def estimate(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Exact counts: candidate_files, indexable_files, chunk_count."""
    made = chunks.agg(F.count_distinct("rel_path").alias("indexable_files"), F.count("*").alias("chunk_count"))
    return files.agg(F.count("*").alias("candidate_files")).crossJoin(made)  # one row each


def shared_chunks(chunks: DataFrame) -> DataFrame:
    """One row a distinct normalized text, identified by hash and text, with its number of references."""
    return chunks.groupBy(F.sha2("normalized_text", 256).alias("normalized_text_hash"), "normalized_text").agg(F.count("*").alias("ref_count"))
