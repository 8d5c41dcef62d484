"""Index state: snapshots compared, reference counts, settings, run log, status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.plans.schemas import SCHEMA_VERSION


def diff(indexed: DataFrame, found: DataFrame) -> DataFrame:
    """rel_path and status (new, changed, unchanged, deleted) by size and modification time, in one full outer join."""
    old = indexed.select("rel_path", F.col("size_bytes").alias("s0"), F.col("modified_unix_ms").alias("m0"), F.lit(True).alias("had"))
    new = found.select("rel_path", F.col("size_bytes").alias("s1"), F.col("modified_unix_ms").alias("m1"), F.lit(True).alias("has"))
    same = F.col("s0").eqNullSafe(F.col("s1")) & F.col("m0").eqNullSafe(F.col("m1"))
    status = F.when(F.col("had").isNull(), "new").when(F.col("has").isNull(), "deleted").when(same, "unchanged").otherwise("changed")
    return old.join(new, "rel_path", "full_outer").select("rel_path", status.alias("status"))


def replaced(table: DataFrame, changes: DataFrame, rows: DataFrame) -> DataFrame:
    """The table after an upsert: rows of changed and deleted paths go, the new rows come."""
    gone = changes.where("status in ('changed', 'deleted')").select("rel_path")
    return table.join(gone, "rel_path", "left_anti").unionByName(rows)


def count_deltas(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, delta, touched: change of reference counts between two sets of references."""
    a = old.groupBy(key).agg(F.count("*").alias("was"))
    b = new.groupBy(key).agg(F.count("*").alias("now"))
    delta = F.coalesce("now", F.lit(0)) - F.coalesce("was", F.lit(0))
    return a.join(b, key, "full_outer").select(key, delta.alias("delta"), (delta > 0).alias("touched")).where("delta <> 0")


def counted(shared: DataFrame, deltas: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """Shared rows (key, text, ref_count) after the deltas: counts move, new keys come with their text, keys without a reference go."""
    both = shared.join(deltas.select(key, "delta"), key, "full_outer").join(texts.select(key, F.col(text).alias("__new")).distinct(), key, "left")
    now = F.coalesce("ref_count", F.lit(0)) + F.coalesce("delta", F.lit(0))
    return both.select(key, F.coalesce(text, "__new").alias(text), now.alias("ref_count")).where("ref_count > 0")


def collected(shared: DataFrame, refs: DataFrame, key: str) -> DataFrame:
    """Shared rows that some reference still uses."""
    return shared.join(refs.select(key), key, "left_semi")


def count_mismatches(shared: DataFrame, refs: DataFrame, key: str) -> DataFrame:
    """Stored against recomputed reference counts; empty if the invariant holds."""
    real = refs.groupBy(key).agg(F.count("*").alias("real"))
    both = shared.select(key, "ref_count").join(real, key, "full_outer")
    return both.na.fill(0, ["ref_count", "real"]).where("ref_count <> real")


def unreferenced(shared: DataFrame, refs: DataFrame, key: str) -> DataFrame:
    return shared.join(refs.select(key), key, "left_anti")


def upserted(settings: DataFrame, changes: DataFrame) -> DataFrame:
    """Key-value settings, the changes win."""
    both = settings.withColumn("__o", F.lit(0)).unionByName(changes.withColumn("__o", F.lit(1)))
    return both.groupBy("key").agg(F.max_by("value", "__o").alias("value"))


def next_state(last: DataFrame, dirty: bool, reason: str | None, synced: int | None) -> DataFrame:
    """The one-row state; a missing sync time keeps the last one."""
    return last.select(F.lit(dirty).alias("dirty"), F.lit(reason).cast("string").alias("dirty_reason"), F.coalesce(F.lit(synced).cast("long"), "last_sync_unix_ms").alias("last_sync_unix_ms"))


def latest_run(runs: DataFrame) -> DataFrame:
    """The run with the largest id, and how long it took."""
    row = runs.groupBy().agg(F.max_by(F.struct(*runs.columns), "run_id").alias("r")).select("r.*")
    return row.withColumn("duration_ms", F.greatest(F.col("finished_unix_ms") - F.col("started_unix_ms"), F.lit(0)))


def status(files: DataFrame, refs: DataFrame, shared: DataFrame, fts_rows: DataFrame, vectors: DataFrame | None) -> DataFrame:
    """Counts and readiness in one row; each side is a one-row aggregate."""
    out = files.agg(F.count("*").alias("files")).crossJoin(refs.agg(F.count("*").alias("chunks"))).crossJoin(shared.agg(F.count("*").alias("shared")))
    out = out.crossJoin(fts_rows.agg(F.count("*").alias("fts"))).crossJoin((vectors if vectors is not None else shared.limit(0)).agg(F.count("*").alias("vectors")))
    return out.select("files", "chunks", "shared", "vectors", (F.col("fts") == F.col("chunks")).alias("fts_ready"), (F.lit(vectors is not None) & (F.col("vectors") == F.col("shared"))).alias("vector_ready"))


def key_counts(refs: DataFrame, column: str) -> DataFrame:
    k = F.coalesce(F.col(column), F.lit("<none>"))
    return refs.groupBy(k.alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key")


def validated(settings: dict[str, str]) -> dict[str, str]:
    if settings.get("schema_version") != str(SCHEMA_VERSION):
        raise ValueError("the index has another schema version; rebuild it")
    return settings


def nearest_rank(values: DataFrame, group: list[str], value: str) -> DataFrame:
    """total, mean (integer division), p50 and p95 by nearest rank: the value at index round((n - 1) * q)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*group).orderBy(value)
    n = F.count("*").over(Window.partitionBy(*group))
    at = lambda q: F.floor((F.col("__n") - 1) * q + 0.5)
    ranked = values.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", n)
    pick = lambda q: F.max(F.when(F.col("__i") == at(q), F.col(value)))
    return ranked.groupBy(*group).agg(F.sum(value).alias("total"), F.expr(f"sum({value}) div count(*)").alias("mean"), pick(0.5).alias("p50"), pick(0.95).alias("p95"))
