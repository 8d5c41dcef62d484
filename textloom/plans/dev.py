"""Tools of a developer: search-quality suites, benchmark of a tree, probes of chunks and of a stored index."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import quality, state
from textloom.plans import schemas as S
from textloom.plans.engine import SHARED, Engine, chunks_of
from textloom.sources import corpus

HIT = "rank int, rel_path string, line_start int, line_end int, snippet string, score double, lexical_score double, vector_score double, channel_label string"
FIXTURE = "suite_id string, sample_vault_manifest string, default_limit int, cases array<struct<id string, query string, scope string, notes string, limit int, expectations struct<must_include array<struct<path string, within_top int, snippet_contains string>>>>>"
GOLDEN = "suite_id string, sample_vault_manifest string, cases array<struct<id string, query string, scope string, limit int, hits array<struct<rank int, rel_path string, line_start int, line_end int, snippet string>>>>"
MANIFEST = "id string, description string, repository string, tag string, commit string, checkout_dir string"
SHOWN = ["rel_path", "line_start", "line_end", "snippet"]


def load_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def cases(fixture: DataFrame) -> DataFrame:
    """case_id, query, scope, notes, limit: the suite's own limit where a case has none."""
    rows = fixture.select("default_limit", F.explode("cases").alias("c"))
    return rows.select(F.col("c.id").alias("case_id"), "c.query", "c.scope", "c.notes", F.coalesce("c.limit", "default_limit").alias("limit"))


def expected(fixture: DataFrame) -> DataFrame:
    """case_id, path, within_top, snippet_contains."""
    rows = fixture.select(F.explode("cases").alias("c")).select(F.col("c.id").alias("case_id"), F.explode("c.expectations.must_include").alias("e"))
    return rows.select("case_id", "e.*")


def golden_hits(golden: DataFrame) -> DataFrame:
    """case_id, rank (by position, from 1) and what is shown of the hits."""
    rows = golden.select(F.explode("cases").alias("c")).select(F.col("c.id").alias("case_id"), F.posexplode("c.hits").alias("p", "h"))
    return rows.select("case_id", (F.col("p") + 1).alias("rank"), *[f"h.{c}" for c in SHOWN])


def write_json(path: str, value: dict | list) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, ensure_ascii=False)
        f.write("\n")


def copy_tree(source: str, target: str, without: tuple[str, ...] = (".git", ".textloom")) -> None:
    """Folders and regular files; links and the named entries stay behind."""
    shutil.copytree(source, target, dirs_exist_ok=True, ignore=lambda folder, names: [n for n in names if n in without or os.path.islink(os.path.join(folder, n))])


def ensure_vault(manifest: dict, base: str, checkout: str | None = None, force: bool = False) -> str:
    """The folder of a manifest's corpus below ``base``; if it is not there (or by force), filled from a local checkout."""
    target = os.path.join(base, manifest["checkout_dir"])
    if os.path.isdir(target) and not force:
        return target
    if checkout is None:
        raise FileNotFoundError(f"{target} is missing; give a checkout of {manifest['repository']} at {manifest['commit']}")
    shutil.rmtree(target, ignore_errors=True)
    copy_tree(checkout, target)
    return target


def observed(engine: Engine, suite: DataFrame) -> DataFrame:
    """case_id and its hits; each case is one search with a limit, so what comes to the driver is bounded by the suite."""
    rows, index = [], engine.index()
    for c in cases(suite).collect():
        kind = "file" if c["scope"] and os.path.isfile(os.path.join(engine.root, c["scope"])) else "dir"
        found = index.search(c["query"], c["scope"], kind, c["limit"]).collect()
        rows += [(c["case_id"], i, *[h[n] for n in (*SHOWN, "score", "lexical_score", "vector_score", "channel_label")]) for i, h in enumerate(found, 1)]
    return engine.spark.createDataFrame(rows, f"case_id string, {HIT}")


def evaluate(engine: Engine, fixture_path: str, golden_path: str | None = None) -> dict:
    """Report of a suite: every case with its hits, failed expectations and differences from the golden results."""
    spark = engine.spark
    suite = load_json(spark, fixture_path, FIXTURE)
    hits, all_cases, want = observed(engine, suite), cases(suite), expected(suite)
    checked = quality.expectations(want, hits)
    golden = golden_hits(load_json(spark, golden_path, GOLDEN)) if golden_path else None
    compared = quality.golden(golden, hits, SHOWN) if golden is not None else spark.createDataFrame([], "case_id string, rank int, same boolean")
    bad = checked.where(~F.col("passed")).groupBy("case_id").agg(F.array_sort(F.collect_list("path")).alias("missed"))
    moved = compared.where(~F.col("same")).groupBy("case_id").agg(F.array_sort(F.collect_list("rank")).alias("differs"))
    shown = hits.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in hits.columns if c != "case_id"]))).alias("hits"))
    rows = all_cases.join(bad, "case_id", "left").join(moved, "case_id", "left").join(shown, "case_id", "left").orderBy("case_id").collect()
    out = [r.asDict(True) | {k: r[k] or [] for k in ("missed", "differs")} | {"hits": [h.asDict() for h in r["hits"] or []]} for r in rows]
    head = suite.first()
    return {"suite_id": head["suite_id"], "fixture": fixture_path, "golden": golden_path, "vault": engine.root, **quality.totals(all_cases, checked, compared).first().asDict(), "results": out}


def golden_of(report: dict) -> dict:
    """The observed hits of a report as golden results."""
    keep = ("rank", *SHOWN)
    return {"suite_id": report["suite_id"], "sample_vault_manifest": None, "cases": [{"id": c["case_id"], "query": c["query"], "scope": c["scope"], "limit": c["limit"], "hits": [{k: h[k] for k in keep} for h in c["hits"]]} for c in report["results"]]}


def benchmark(spark: SparkSession, fixture_path: str, source: str, repeat: int = 1, out: str | None = None, keep: bool = False) -> dict:
    """Times building and the suite's searches on a scratch copy of the tree, at both levels."""
    suite, scratch, levels = load_json(spark, fixture_path, FIXTURE), tempfile.mkdtemp(prefix="textloom-bench-"), []
    try:
        for level in S.LEVELS:
            root = os.path.join(scratch, level.replace("+", "-"))
            copy_tree(source, root)
            engine, began = Engine(spark, root), time.perf_counter()
            engine.rebuild(level, "init")
            took, runs, index = int(1000 * (time.perf_counter() - began)), [], engine.index()
            for c in cases(suite).collect():
                for i in range(max(repeat, 1)):
                    began = time.perf_counter()
                    n = len(index.search(c["query"], c["scope"], limit=c["limit"]).collect())
                    runs.append((c["case_id"], i + 1, int(1000 * (time.perf_counter() - began)), n))
            times = state.nearest_rank(spark.createDataFrame(runs, "case_id string, run int, ms long, lines int").withColumn("level", F.lit(level)), ["level"], "ms").first()
            s = engine.status()
            levels.append({"level": level, "init_ms": took, "files": s["files"], "chunks": s["chunks"], **{k: times[k] for k in ("total", "mean", "p50", "p95")}, "runs": [dict(zip(("case_id", "run", "ms", "lines"), r, strict=True)) for r in runs]})
    finally:
        if not keep:
            shutil.rmtree(scratch)
    report = {"fixture": fixture_path, "source": source, "scratch": scratch if keep else None, "repeat": max(repeat, 1), "levels": levels}
    if out:
        write_json(out, report)
    return report


def probe_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of one file as an index would hold them; a file that is not admitted is an error."""
    folder, name = os.path.split(os.path.abspath(path))
    body = corpus.load(corpus.read_files(spark, folder, [name])).select("rel_path", "body")
    if body.isEmpty():
        raise ValueError(f"{path} is not indexable")
    return chunks_of(body).orderBy("chunk_index")


def top_files(refs: DataFrame, limit: int) -> DataFrame:
    return refs.groupBy("rel_path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rel_path").limit(limit)


def top_shared(shared: DataFrame, text: str, limit: int) -> DataFrame:
    return shared.select(F.col(text).alias("normalized_text"), "ref_count").orderBy(F.desc("ref_count"), "normalized_text").limit(limit)


def probe_index(engine: Engine, limit: int = 10) -> dict:
    """Status, counts by kind, the largest files and most shared texts of a stored index."""
    refs, shared = engine.store.read("chunks"), engine.store.read("shared")
    rows = lambda df: [r.asDict() for r in df.collect()]
    # at most one row a kind or language, and ``limit`` rows
    counts = {name: rows(state.key_counts(refs, c)) for name, c in (("chunk_kinds", "chunk_kind"), ("symbol_languages", "language"), ("symbol_kinds", "symbol_kind"))}
    return {"root": engine.root, "status": engine.status(), **counts, "top_files": rows(top_files(refs, limit)), "top_shared": rows(top_shared(shared, SHARED[1], limit))}
