"""Fusion of recall channels by reciprocal ranks and source priority."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.plans.schemas import RRF_K, SEMANTIC_ONLY_LIMIT

KEY = ("rel_path", "chunk_index")
ROW = "channel string, rank long, rel_path string, chunk_index int, lexical_score double, vector_score double, literal_line_number int, literal_preview string"


def channel(rows: DataFrame, name: str) -> DataFrame:
    """Rows of one channel in the common form; the literal channel scores 1."""
    have = set(rows.columns)
    pick = lambda c, kind: F.col(c).cast(kind).alias(c) if c in have else F.lit(None).cast(kind).alias(c)
    lexical = F.lit(1.0) if name == "literal" else F.coalesce(pick("lexical_score", "double"), F.lit(0.0))
    return rows.select(F.lit(name).alias("channel"), pick("rank", "long"), *KEY, lexical.alias("lexical_score"), F.coalesce(pick("vector_score", "double"), F.lit(0.0)).alias("vector_score"), pick("literal_line_number", "int"), pick("literal_preview", "string"))


def fuse(channels: DataFrame) -> DataFrame:
    """One row a chunk: score, the channels' scores and flags, the literal line; rows without evidence go.

    One aggregation by chunk instead of outer joins between channels.
    """
    of = lambda name: F.col("channel") == name
    out = channels.groupBy(*KEY).agg(
        F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"),
        F.max("lexical_score").alias("lexical_score"),
        F.max(F.when(of("vector"), F.col("vector_score")).otherwise(0.0)).alias("vector_score"),
        F.bool_or(of("lexical")).alias("indexed_text_match"),
        F.bool_or(of("literal")).alias("partial_text_match"),
        F.min(F.when(of("literal"), F.struct("literal_line_number", "literal_preview"))).alias("first"),
    )
    out = out.select("*", "first.*").drop("first")
    return out.where("lexical_score > 0 or vector_score > 0")


def priority() -> list:
    """Sort order of hits: literal first, then the number of sources, lexical, semantic, score; ends in a unique key."""
    semantic = (F.col("vector_score") > 0).cast("int")
    lexical, literal = F.col("indexed_text_match").cast("int"), F.col("partial_text_match").cast("int")
    return [literal.desc(), (semantic + lexical + literal).desc(), lexical.desc(), semantic.desc(), F.round("score", 9).desc(), F.round("lexical_score", 6).desc(), F.col("rel_path"), F.col("chunk_index")]


def cap_semantic(hits: DataFrame, limit: int = SEMANTIC_ONLY_LIMIT, by: tuple[str, ...] = ()) -> DataFrame:
    """At most ``limit`` purely semantic hits in rank order, if any hit is lexical; of each query, where ``by`` names its columns."""
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    w = group.orderBy(*priority()).rowsBetween(Window.unboundedPreceding, 0)
    semantic = F.col("lexical_score") <= 0
    marked = hits.withColumn("__n", F.sum(semantic.cast("int")).over(w)).withColumn("__any", F.max(~semantic).over(group))
    return marked.where(~F.col("__any") | ~semantic | (F.col("__n") <= limit)).drop("__n", "__any")
