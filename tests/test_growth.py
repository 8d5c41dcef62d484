"""Steps whose data grew faster than the input: what they move now, and that their results are those of the longer way."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import chunk, fuse, lexical, materialize, vector
from textloom.plans import registry
from textloom.plans.engine import Index

PIECES = ["a", "é", "Σ", "- ", "# ", "##  ", "> ", "* ", " :: ", " ::", "\n", "\r\n", "\r", " ", "\t", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", "᠎", " ", "　", "​", "x" * 20, "y" * 47, "z" * 48, "\U0001f600" * 24]


def bodies(spark, n=1500, seed=7):
    r = random.Random(seed)
    rows = [(f"p{i}", "".join(r.choice(PIECES) for _ in range(r.randint(0, 40)))) for i in range(n)]
    return spark.createDataFrame(rows + [("twice", "a\nb\n" + "c" * 50)] * 2 + [(None, "no path"), ("none", None)], "rel_path string, body string")


@pytest.fixture(scope="module")
def words(spark):
    """Chunks of few words, many of them alike, so that scores tie."""
    r = random.Random(3)
    rows = [(f"f{i // 9}", i % 9, " ".join(r.choice("the license of a text é x1".split()) for _ in range(r.randint(0, 6)))) for i in range(2000)]
    return spark.createDataFrame(rows, "rel_path string, chunk_index int, normalized_text string").repartition(5)


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chunks_as_by_lines_in_order(spark):
    files = bodies(spark).persist()
    made, joint = chunk.text_chunks(files), chunk.joint_chunks(files)
    assert made.columns == joint.columns
    assert sorted(made.collect(), key=repr) == sorted(joint.collect(), key=repr)


def test_chunks_are_made_where_files_are_read(spark, tmp_path):
    bodies(spark).where("rel_path <> 'twice'").write.parquet(f"{tmp_path}/files")
    made = chunk.text_chunks(spark.read.parquet(f"{tmp_path}/files"))
    assert made.count() > 0
    made.collect()
    final = executed(made).split("Initial Plan")[0]
    assert "Window" not in final and "body" not in "".join(x for x in final.splitlines() if "Exchange" in x)


def test_batch_scores_equal_the_join(spark, words):
    queries = spark.createDataFrame([(1, "the license"), (2, "of of text"), (3, "É"), (4, "nowhere"), (5, "")], "query_id int, text string")
    plain = lambda df: [(r.query_id, r.rel_path, r.chunk_index, round(r.bm25, 9), r["rank"]) for r in df.orderBy("query_id", "rank").collect()]
    near = lexical.batch_candidates(words, queries, 7)
    assert plain(near) == plain(lexical.batch_candidates(words, queries, 7, pairs=0))
    assert plain(lexical.batch_candidates(words, queries.limit(0), 7)) == []


def test_batch_moves_the_best_rows_only(spark, words):
    queries = spark.createDataFrame([(i, "the license of a text") for i in range(20)], "query_id int, text string")
    asked = queries.select("query_id", F.explode(F.split("text", " ")).alias("token")).withColumn("times", F.lit(1).cast("long")).toArrow()
    found = lexical.best_scores(words, asked, "int", 7)
    assert found.count() <= 7 * 20 * words.rdd.getNumPartitions()


def test_frequencies_group_no_chunk(spark, words):
    got = lexical.document_frequencies(words)
    assert "chunk_index" not in "".join(x for x in executed(got).splitlines() if "Exchange" in x)
    rows = words.select(F.explode(F.split("normalized_text", " ")).alias("token"), "rel_path", "chunk_index").where("token <> ''").withColumn("token", F.regexp_replace("token", "é", "e"))
    want = rows.groupBy("token").agg(F.count_distinct("rel_path", "chunk_index").alias("df"), F.count("*").alias("tf"))
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


def moved(df):
    """Columns of the shuffles of a plan that has not run."""
    return "".join(x.split("Exchange", 1)[1] for x in executed(df).split("Initial Plan")[0].splitlines() if "Exchange " in x)


@pytest.fixture(scope="module")
def corpus_files(spark):
    r = random.Random(11)
    text = lambda: "\n".join(r.choice(["licensed under the terms of a public license, as it is said here and elsewhere too", "under the tree", "é the licensed", "the the the"]) for _ in range(r.randint(1, 8)))
    return spark.createDataFrame([(f"d{i % 3}/{i}.md", text()) for i in range(120)], "rel_path string, body string")


def test_counts_of_phrases(spark):
    rows = spark.createDataFrame([("p", 0, "c++ and c plus a-b"), ("p", 1, "a b a b"), ("p", 2, "b a"), ("q", 0, "zzz")], "rel_path string, chunk_index int, normalized_text string")
    got = lexical.counts(rows, "a-b c++").collect()
    assert sorted((r.rel_path, r.chunk_index, r.dl, r.cover, r.f0, r.f1) for r in got if r.chunk_index >= 0) == [("p", 0, 6, 1.0, 1, 2), ("p", 1, 4, 0.0, 2, 0)]
    assert (sum(r.docs for r in got), sum(r.total for r in got)) == (4, 13)


def test_search_moves_and_holds_no_texts(spark, corpus_files):
    index = Index.build(corpus_files, "fts+vector").kept()
    found = index.search("licensed under the")
    assert all(set(h.columns).isdisjoint({"raw_text", "normalized_text", "vector"}) for h in index.held) and index.held
    assert "raw_text" not in moved(found) and "vector#" not in moved(found)
    assert found.count() == 20
    index.close()


def test_cut_before_or_after_snippets(spark, corpus_files):
    index = Index.build(corpus_files, "fts+vector")
    hits = fuse.cap_semantic(fuse.fuse(index.channels("under the tree")))
    want = materialize.snippets(hits, index.chunks, 1, 1).orderBy(*fuse.priority()).limit(12)
    got = index.search("under the tree", limit=12, before=1, after=1)
    assert [(r.rel_path, r.chunk_index, r.snippet, r.line_start, r.line_end) for r in got.collect()] == [(r.rel_path, r.chunk_index, r.snippet, r.line_start, r.line_end) for r in want.collect()]


def test_embedding_by_rows():
    texts = ["", "é" * 10_000, "plain", "\x00"]
    assert vector.embed_rows(texts, "passage").tolist() == [vector.embed_text(t, "passage") for t in texts]


def test_context_is_joined_by_number(spark, corpus_files):
    made = chunk.text_chunks(corpus_files)
    hits = made.where("chunk_index % 2 = 0").select("rel_path", "chunk_index", F.lit(None).cast("int").alias("literal_line_number"), F.lit(None).cast("string").alias("literal_preview"))
    got = materialize.snippets(hits, made, 1, 1)
    joins = [x for x in executed(got).splitlines() if "Join" in x and "LeftOuter" in x]
    assert joins and all("__at" in x.split("LeftOuter")[0] for x in joins)
    rows = {(r.rel_path, r.chunk_index): r for r in made.collect()}
    for r in got.collect():
        near = [rows[k] for k in ((r.rel_path, r.chunk_index + i) for i in (-1, 0, 1)) if k in rows]
        assert (r.snippet, r.line_start, r.line_end) == ("\n".join(x.raw_text for x in near), near[0].line_start, near[-1].line_end)


@pytest.mark.parametrize("name", ["status_counts", "gc_orphans", "search_fts", "fuse_fts"])
def test_lines_are_not_sorted(spark, small, name):
    """What ran has no window over the lines of files: those of no path in common are chunked where they are read."""
    found = registry.QUERIES[name](spark, small)
    found.collect()
    assert "line#" not in "".join(x for x in executed(found).split("Initial Plan")[0].splitlines() if "Exchange " in x or "Sort " in x)
