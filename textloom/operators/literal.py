"""Literal recall: matching lines mapped to their smallest enclosing chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import scan
from textloom.sources.corpus import line_rows


def line_to_chunk(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """rel_path, line_number, line, chunk_index: of the chunks that span the line the shortest, then the first.

    An equi-join on the path with a range on lines; ties are settled by an aggregate, so nothing is sorted.
    """
    spans = chunks.select("rel_path", "chunk_index", "line_start", "line_end")
    inside = hits.join(spans, "rel_path").where(F.col("line_number").between(F.col("line_start"), F.col("line_end")))
    best = F.min(F.struct((F.col("line_end") - F.col("line_start")).alias("span"), "chunk_index", "line"))
    return inside.groupBy("rel_path", "line_number").agg(best.alias("b")).select("rel_path", "line_number", "b.line", "b.chunk_index")


def first_lines(files: DataFrame, chunks: DataFrame, query: str, scope: str | None = None, kind: str = "dir", scanner: scan.Scanner = scan) -> DataFrame:
    """rel_path, chunk_index, literal_line_number, literal_preview: chunks that hold a line with the literal, and the first such line. No limit."""
    lines = scanner.literal_scan(line_rows(files.where(T.in_scope(F.col("rel_path"), scope, kind))), query)
    first = line_to_chunk(lines, chunks).groupBy("rel_path", "chunk_index").agg(F.min(F.struct("line_number", "line")).alias("l"))
    return first.select("rel_path", "chunk_index", F.col("l.line_number").alias("literal_line_number"), T.trimmed(F.col("l.line")).alias("literal_preview"))


def candidates(files: DataFrame, chunks: DataFrame, query: str, scope: str | None = None, kind: str = "dir", scanner: scan.Scanner = scan) -> DataFrame:
    """The same with all columns of the chunks."""
    return first_lines(files, chunks, query, scope, kind, scanner).join(chunks, ["rel_path", "chunk_index"])


def ranked(found: DataFrame) -> DataFrame:
    """0-based rank by (path components, line). The window has no key: it ranks matching chunks of one query only."""
    w = Window.orderBy(F.split("rel_path", "/"), "literal_line_number")
    return found.withColumn("rank", F.row_number().over(w) - 1)
