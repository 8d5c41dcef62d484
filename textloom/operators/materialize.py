"""Snippets of hits, joined last so that ranking moves no text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T


def snippets(hits: DataFrame, chunks: DataFrame, before: int = 0, after: int = 0, few: bool = False) -> DataFrame:
    """hits with snippet, line_start, line_end. Hits whose chunk is gone are dropped unless a literal line speaks for them.

    Without context a literal hit shows its line; with context the chunks around each hit are joined, by path and number. With
    ``few`` the hits, all of which have their chunk, are sent to the chunks, so that no text is moved.
    """
    texts = chunks.select("rel_path", F.col("chunk_index").alias("__at"), F.col("line_start").alias("__s"), F.col("line_end").alias("__e"), (F.col("raw_text") if few else T.snippet(F.col("raw_text"))).alias("__t"))
    around = hits.withColumn("__at", F.explode(F.sequence(F.col("chunk_index") - before, F.col("chunk_index") + after)))
    near = texts.join(F.broadcast(around), ["rel_path", "__at"]) if few else around.join(texts, ["rel_path", "__at"], "left")
    inside = F.col("__s").isNotNull()
    rows = F.array_sort(F.collect_list(F.when(inside, F.struct("__at", (T.snippet(F.col("__t")) if few else F.col("__t")).alias("__t")))))
    grouped = near.groupBy(*hits.columns).agg(F.array_join(F.transform(rows, lambda x: x["__t"]), "\n").alias("text"), F.min("__s").alias("s"), F.max("__e").alias("e"), F.bool_or(inside & (F.col("__at") == F.col("chunk_index"))).alias("live"))
    alone = F.col("literal_line_number").isNotNull() & (F.lit(before == 0 and after == 0) | ~F.coalesce("live", F.lit(False)))
    pick = lambda a, b: F.when(alone, a).otherwise(b)
    out = grouped.where(F.coalesce("live", F.lit(False)) | F.col("literal_line_number").isNotNull())
    return out.select(*hits.columns, pick(F.col("literal_preview"), F.col("text")).alias("snippet"), pick(F.col("literal_line_number"), F.col("s")).cast("int").alias("line_start"), pick(F.col("literal_line_number"), F.col("e")).cast("int").alias("line_end"))
