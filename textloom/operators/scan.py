"""Line scans: regular expressions and literals, with context lines."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.router import java_pattern


class Scanner(Protocol):
    """What finds lines for a search; this module is the default one."""

    def regex_scan(self, lines: DataFrame, pattern: str) -> DataFrame: ...

    def literal_scan(self, lines: DataFrame, literal: str) -> DataFrame: ...

    def with_context(self, lines: DataFrame, pattern: str, before: int, after: int) -> DataFrame: ...


def regex_scan(lines: DataFrame, pattern: str) -> DataFrame:
    return lines.where(F.col("line").rlike(java_pattern(pattern)))


def literal_scan(lines: DataFrame, literal: str) -> DataFrame:
    return lines.where(F.contains(F.lower("line"), F.lit(literal.strip().lower())))


def with_context(lines: DataFrame, pattern: str, before: int, after: int) -> DataFrame:
    """Matching lines and the lines around them, each once."""
    w = Window.partitionBy("rel_path").orderBy("line_number").rowsBetween(-after, before)
    hit = F.col("line").rlike(java_pattern(pattern))
    return lines.withColumn("near", F.max(hit).over(w)).where("near").drop("near")


def ordered(hits: DataFrame) -> DataFrame:
    """By path component, line number, line."""
    return hits.orderBy(F.split("rel_path", "/"), "line_number", "line")


def context(before: int | None, after: int | None, both: int | None) -> tuple[int, int]:
    return before if before is not None else both or 0, after if after is not None else both or 0


EVENT = "type string, data struct<path:struct<text:string,bytes:string>,lines:struct<text:string,bytes:string>,line_number:int>"


def parse_events(rows: DataFrame) -> DataFrame:
    """Scanner events in JSON lines (column ``value``) as path, line_number, line."""
    e = rows.select(F.from_json("value", EVENT).alias("e")).where("e.type in ('match', 'context')")
    text = lambda c: F.coalesce(F.col(f"{c}.text"), F.expr(f"make_valid_utf8(cast(unbase64({c}.bytes) as string))"))
    return e.select(text("e.data.path").alias("path"), F.coalesce("e.data.line_number", F.lit(1)).alias("line_number"), F.regexp_replace(text("e.data.lines"), r"\r?\n\z", "").alias("line"))
