"""Search-quality evaluation: expectations and golden results against observed hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expectations(expected: DataFrame, hits: DataFrame) -> DataFrame:
    """case_id, path, passed: the first hit of the path is within the top and holds the text.

    expected: case_id, path, within_top, snippet_contains; hits: case_id, rank, rel_path, snippet.
    """
    first = hits.groupBy("case_id", F.col("rel_path").alias("path")).agg(F.min(F.struct("rank", "snippet")).alias("h"))
    both = expected.join(first, ["case_id", "path"], "left")
    ok = (F.col("h.rank") <= F.col("within_top")) & (F.col("snippet_contains").isNull() | F.contains("h.snippet", "snippet_contains"))
    return both.select("case_id", "path", F.coalesce(ok, F.lit(False)).alias("passed"))


def golden(golden_hits: DataFrame, hits: DataFrame, columns: list[str]) -> DataFrame:
    """case_id, rank, same: observed against golden hits by position."""
    a = golden_hits.select("case_id", "rank", F.struct(*columns).alias("want"))
    b = hits.select("case_id", "rank", F.struct(*columns).alias("got"))
    return a.join(b, ["case_id", "rank"], "full_outer").select("case_id", "rank", F.col("want").eqNullSafe(F.col("got")).alias("same"))


def totals(cases: DataFrame, expected: DataFrame, compared: DataFrame) -> DataFrame:
    """cases, passed, failed_expectations, failed_golden; failures count cases, not messages."""
    e = expected.groupBy("case_id").agg((~F.bool_and("passed")).alias("bad_e"))
    g = compared.groupBy("case_id").agg((~F.bool_and("same")).alias("bad_g"))
    rows = cases.select("case_id").join(e, "case_id", "left").join(g, "case_id", "left").na.fill(False)
    return rows.agg(F.count("*").alias("cases"), F.count_if(~F.col("bad_e") & ~F.col("bad_g")).alias("passed"), F.count_if("bad_e").alias("failed_expectations"), F.count_if("bad_g").alias("failed_golden"))
