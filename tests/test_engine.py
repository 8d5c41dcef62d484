"""Behaviour of text functions, chunks, fusion, code symbols and the index on small inputs."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from textloom.functions import router
from textloom.functions import text as T
from textloom.operators import chunk, code, fuse, lexical, scan, vector
from textloom.plans import render
from textloom.plans.engine import Engine, Index, Query, chunks_of, reconcile_covering
from textloom.sources import corpus
from textloom.sources.store import Store, retry_delay_ms
from textloom.streaming.refresh import stream_chunks

LONG = "a line of text that is surely long enough to stand alone as one chunk"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def files(spark, rows):
    return spark.createDataFrame(rows, "rel_path string, body string")


@pytest.mark.parametrize("raw,want", [("  Foo\tbar\nBAZ  ", "foo bar baz"), ("", ""), ("\u00a0x\u2003Y ", "x y")])
def test_normalized(spark, raw, want):
    assert one(spark, T.normalized(F.lit(raw))) == want


def test_terms_and_matching(spark):
    assert one(spark, T.terms(F.lit("  tool   Search "))) == ["tool", "search"]
    assert one(spark, T.terms(F.lit(" "))) == []
    for query, text, want in [("   ", "x", True), ("tool rust", "Building TOOL kits with Rust nightly", True), ("tool rust", "Building tool kits with Python", False), ("mini grep", "A tiny mini GREP-like utility", True)]:
        assert one(spark, T.matches_all(F.lit(text), F.lit(query))) is want
        assert Query(query).matches(text) is want


@pytest.mark.parametrize("raw,want", [("- a", "a"), ("* b", "b"), ("> - c", "- c"), ("### d", "d"), ("#e", "#e"), ("-f", "-f"), ("+  g", "g"), ("####  h", "h")])
def test_undecorated(spark, raw, want):
    assert one(spark, T.undecorated(F.lit(raw))) == want


@pytest.mark.parametrize("text", ["a" * 200, "a" * 201, "é" * 100, "é" * 101, "a" + "é" * 100, "ab" + "中" * 80, "x" * 199 + "𝄞y", ""])
def test_snippet_cuts_whole_characters(spark, text):
    raw = text.encode()
    want = text if len(raw) <= 200 else raw[:200].decode(errors="ignore") + "..."
    assert one(spark, T.snippet(F.lit(text))) == want


@pytest.mark.parametrize("term,want", [("parseQuery", ["parsequery", "parse", "query"]), ("HTTPServer", ["httpserver"]), ("a1B2", ["a1b2", "a1", "b2"]), ("retry_backoff_ms", ["retry_backoff_ms", "retry", "backoff", "ms"])])
def test_identifier_expansion(spark, term, want):
    assert one(spark, T.expand_identifier(F.lit(term))) == want
    assert code.expand(term) == want


@pytest.mark.parametrize("query,want", [("TODO|FIXME", True), ("C++", False), ("v1.2.3", False), ("colou?r{1,2}", True), ("a\\b", True), ("plain words", False), ("{x", True), ("foo(", True), ("f.*o", True)])
def test_router(query, want):
    assert router.is_regex(query) is want


def test_java_pattern_refuses_lookaround():
    with pytest.raises(ValueError):
        router.java_pattern("(?=x)")


@pytest.mark.parametrize(
    "body,want",
    [
        ("- alpha\nbeta :: gamma\n", ["alpha\nbeta\ngamma"]),
        (f"{LONG} 1\n{LONG} 2\n", [f"{LONG} 1", f"{LONG} 2"]),
        (f"a\n\nb\n{LONG}\nc", ["a\nb", LONG, "c"]),
        ("", []),
        ("\r\n \r\n", []),
    ],
)
def test_chunks(spark, body, want):
    rows = chunk.text_chunks(files(spark, [("x.md", body)])).orderBy("chunk_index").collect()
    assert [r["raw_text"] for r in rows] == want
    assert [r["chunk_index"] for r in rows] == list(range(len(want)))


def test_admission(spark):
    rows = [("notes.md", 3), ("journal.rst", 3), ("code.rs", 3), ("config.toml", 3), ("README", 3), ("big.md", 1 << 22), ("empty.md", 0), ("X.MD", 1), ("x.RS", 1), (".textloom/a.md", 1)]
    df = spark.createDataFrame(rows, "p string, n long")
    kept = {r["p"] for r in df.where(corpus.admitted(F.col("p"), F.col("n"))).collect()}
    assert kept == {"notes.md", "journal.rst", "code.rs", "README", "X.MD"}
    assert one(spark, corpus.plain_text(F.lit("tab\tok\x85")))
    assert not one(spark, corpus.plain_text(F.lit("a\x01")))


def test_scan_context_and_order(spark):
    f = files(spark, [("b.md", "needle second\nneedle third"), ("a.md", "needle first"), ("a/x.md", "alpha\nTODO item\nomega\nz")])
    rows = corpus.line_rows(f)
    assert [(r["rel_path"], r["line_number"]) for r in scan.ordered(scan.regex_scan(rows, "needle")).collect()] == [("a.md", 1), ("b.md", 1), ("b.md", 2)]
    assert [r["line_number"] for r in scan.ordered(scan.with_context(rows, "TODO", 1, 1)).collect()] == [1, 2, 3]
    assert scan.context(None, 2, 1) == (1, 2)


def test_phrases_and_tokenless_terms(spark):
    c = chunk.text_chunks(files(spark, [("a.md", "escape_os here"), ("b.md", "os escape there"), ("c.md", "nothing")]))
    assert [r["rel_path"] for r in lexical.candidates(c, "escape_os").collect()] == ["a.md"]
    assert lexical.candidates(c, "::").collect() == []


def test_fusion_order(spark):
    def ch(name, rows):
        return fuse.channel(spark.createDataFrame(rows, "rank long, rel_path string, chunk_index int, lexical_score double, vector_score double"), name)

    both = ch("lexical", [(0, "alpha", 0, 1.8, 0.0)]).unionByName(ch("literal", [(0, "beta", 0, 0.0, 0.0)])).unionByName(ch("vector", [(0, "gamma", 0, 0.0, 0.9)]))
    assert [r["rel_path"] for r in fuse.fuse(both).orderBy(*fuse.priority()).collect()] == ["beta", "alpha", "gamma"]
    two = ch("lexical", [(0, "alpha", 0, 1.5, 0.0), (1, "beta", 0, 1.4, 0.0)]).unionByName(ch("vector", [(0, "alpha", 0, 0.0, 0.8), (1, "gamma", 0, 0.0, 0.7)]))
    top = fuse.fuse(two).orderBy(*fuse.priority()).first()
    assert top["rel_path"] == "alpha" and abs(top["score"] - 0.1) < 1e-12


@pytest.mark.parametrize(
    "text,query,want",
    [
        ("sqlite vector adapter", "sqlite adapter", "alpha.md:[f] 1: sqlite vector adapter"),
        ("alpha :: beta", "::", "alpha.md:[r] 1: alpha :: beta"),
        ("see Docs/R0_Some_Guide.md for source", "docs/r0_some_guide.md", "alpha.md:[rf] 1: see Docs/R0_Some_Guide.md for source"),
    ],
)
def test_search_output(spark, text, query, want):
    rows = Index.build(files(spark, [("alpha.md", text), ("other.md", "nothing like that at all")])).search(query).collect()
    assert render.hits([r.asDict() for r in rows]) == want


def test_search_with_context_and_scope(spark):
    body = "\n".join(f"{LONG} {x}" for x in ("one", "needle context", "three"))
    index = Index.build(files(spark, [("notes/alpha.md", body), ("other/alpha.md", body)]))
    rows = index.search("needle context", "notes", before=1, after=1).collect()
    assert [(r["rel_path"], r["line_start"], r["line_end"]) for r in rows if r["partial_text_match"]] == [("notes/alpha.md", 1, 3)]
    assert {r["rel_path"] for r in rows} == {"notes/alpha.md"}


def test_vector_channel(spark):
    rows = Index.build(files(spark, [("a.md", "updated sqlite recall"), ("b.md", "zzzz")]), "fts+vector").search("sqlite recall").collect()
    assert rows[0]["rel_path"] == "a.md" and rows[0]["channel_label"] == "rfv"
    assert len(vector.embed_text("né", "passage")) == 384


def test_code_symbols():
    js = "// docs\nclass Parser {}\n\nfunction parseQuery(input) { return input; }\nconst makeParser = (input) => input;\nconst DEFAULT_LIMIT = 20;\n"
    kinds = [s["symbol_kind"] for s in code.symbols("parser.js", js)]
    assert kinds == ["class", "function", "function", "constant"]
    py = code.symbols("parser.py", 'class A:\n    def parse_query(input):\n        """query parser docs"""\n        return input\n')
    assert [s["container"] for s in py] == [None, "A"] and "query parser docs" in py[1]["normalized_text"]
    rs = code.symbols("src/lib.rs", "impl Foo {\n    fn bar(&self) { let retry_backoff_ms = 1; }\n}\n")
    assert rs[0]["container"] == "Foo" and "retry backoff ms" in rs[0]["shared_normalized_text"]
    assert code.symbols("x.py", "def (") == [] and code.symbols("x.md", "class A") == []


RUST = """pub trait Shape<const N: usize> { type Out; fn area(&self) -> f64; fn twice(&self) -> f64 { 2.0 * self.area() } }
impl<'a, T: Into<f64>> Shape<2> for Square<'a, T> where T: Copy { type Out = T; fn area(&self) -> f64 { 1.0 } }
unsafe impl Send for Pair<A, B> {}
mod inner { pub(crate) const fn one() -> *const u8 { 1 } static LIMIT: &'static str = "fn not()"; }
fn takes<T, const M: usize>(f: fn(u8)) -> impl Fn(u8) -> u8 { make!{ fn hidden() {} } }
macro_rules! make { ($x:item) => { fn inside() {} } }
#[derive(Debug)] struct Last;
"""


def test_rust_symbols_by_place():
    got = [(s["symbol_kind"], s["raw_text"].split()[1], s["line_start"], s["container"]) for s in code.symbols("a.rs", RUST)]
    assert got == [("trait", "Shape", 1, None), ("function", "twice", 1, "Shape"), ("type", "Out", 2, "Square<'a, T>"), ("function", "area", 2, "Square<'a, T>"), ("module", "inner", 4, None), ("function", "one", 4, "inner"), ("constant", "LIMIT", 4, "inner"), ("function", "takes", 5, None), ("struct", "Last", 7, None)]


def test_script_symbols_by_place():
    ts = "const A = class Named { run(x) { return function inner() {}; } };\nexport default async function main() {}\nfunction* gen() {}\nfunction over(a: string): void;\nconst f = function g() {};\nadd(function h() {});\n"
    got = [(s["symbol_kind"], s["raw_text"].split()[1], s["line_start"]) for s in code.symbols("a.ts", ts)]
    calls = "class A {\n  get size(): number { return 1; }\n  run(): void {\n    this.go();\n    go(1);\n  }\n  abstract stop(): void;\n}\n"
    assert [(s["symbol_kind"], s["raw_text"].split()[1], s["container"]) for s in code.symbols("a.ts", calls)] == [("class", "A", None), ("method", "size", "A"), ("method", "run", "A"), ("method", "stop", "A")]
    assert got == [("constant", "A", 1), ("class", "Named", 1), ("method", "run", 1), ("function", "main", 2), ("function", "over", 4), ("function", "f", 5)]


def test_walk_respects_ignore_files(tmp_path):
    (tmp_path / "child").mkdir()
    (tmp_path / ".ignore").write_text("*.md")
    (tmp_path / "child" / ".textloomignore").write_text("!keep.md")
    for n in ("keep.md", "blocked.md", ".hidden.md"):
        (tmp_path / "child" / n).write_text("x")
    assert corpus.walk(str(tmp_path)) == ["child/keep.md"]


def test_engine_lifecycle(spark, tmp_path):
    root = tmp_path / "vault"
    root.mkdir()
    (root / "a.md").write_text("- Shared Note")
    (root / "b.md").write_text("# shared note")
    engine = Engine(spark, str(root), f"file://{tmp_path}/index")
    assert engine.rebuild("fts+vector", "init") == {"scanned_files": 2, "indexed_files": 2, "chunks_indexed": 2}
    s = engine.status()
    assert (s["shared"], s["vectors"], s["fts_ready"], s["vector_ready"]) == (1, 1, True, True)
    assert engine.reconcile() == {"unchanged": 2}
    (root / "a.md").unlink()
    (root / "c.md").write_text("fresh words")
    assert engine.reconcile() == {"unchanged": 1, "deleted": 1, "new": 1}
    assert {r["rel_path"] for r in engine.index().search("fresh").collect()} >= {"c.md"}
    assert engine.delete() and not engine.delete()


def test_store_refuses_other_schema(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.commit({"t": spark.range(1).toDF("x")}, {})
    os.remove(tmp_path / "s" / ".CURRENT.crc") if (tmp_path / "s" / ".CURRENT.crc").exists() else None
    p = tmp_path / "s" / "CURRENT"
    p.write_text(p.read_text().replace('"10"', '"9"'))
    with pytest.raises(ValueError):
        store.read("t")
    assert [retry_delay_ms(i) for i in (0, 1, 9)] == [200, 400, 5000]


def test_streamed_chunks(spark, small, tmp_path):
    source = tmp_path / "in"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    docs.limit(20).write.parquet(str(source))
    q = stream_chunks(spark, str(source), docs.schema, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    want = chunks_of(corpus.from_documents(spark.read.parquet(str(source)))).count()
    assert spark.read.parquet(str(tmp_path / "out")).count() == want


def test_paths_are_taken_literally(spark, tmp_path):
    root = tmp_path / "tr+ee [x]"
    root.mkdir()
    names = ["a+b.md", "100%25.md", "sp ace.md", "q[1].md", "c{d}.md", "star*.md"]
    for n in names:
        (root / n).write_text("x")
    assert sorted(r["rel_path"] for r in corpus.read_tree(spark, str(root)).collect()) == sorted(names)


@pytest.mark.parametrize(
    "rules,hidden",
    [
        ("/build", {"build/a.md"}),
        ("build", {"build/a.md", "sub/build/b.md"}),
        ("sub/*.md", {"sub/c.md"}),
        ("**/build", {"build/a.md", "sub/build/b.md"}),
        ("sub/**", {"sub/c.md", "sub/build/b.md", "sub/deep/d/e.md"}),
        ("sub/**/e.md", {"sub/deep/d/e.md"}),
        ("*.md\n!c.md", {"build/a.md", "sub/build/b.md", "sub/deep/d/e.md", "top.md"}),
        ("[bt]*.md", {"sub/build/b.md", "top.md"}),
        ("top.md/", set()),
        ("# top.md\n\n", set()),
    ],
)
def test_ignore_patterns(tmp_path, rules, hidden):
    every = {"build/a.md", "sub/build/b.md", "sub/c.md", "sub/deep/d/e.md", "top.md"}
    for p in every:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    (tmp_path / ".gitignore").write_text(rules)
    assert set(corpus.walk(str(tmp_path))) == every - hidden


def test_ignore_files_of_the_repository_above(tmp_path):
    (tmp_path / ".git" / "info").mkdir(parents=True)
    (tmp_path / ".git" / "info" / "exclude").write_text("private.md")
    (tmp_path / ".gitignore").write_text("/docs/old")
    for p in ("docs/old/a.md", "docs/new/b.md", "docs/private.md"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    assert corpus.walk(str(tmp_path / "docs")) == ["new/b.md"]
    assert corpus.walk(str(tmp_path / "docs"), "old") == []


def test_reconcile_equals_rebuild(spark, tmp_path):
    root = tmp_path / "vault"
    root.mkdir()
    for i in range(6):
        (root / f"f{i}.md").write_text(f"shared note for all\nown {LONG} {i}\n")
    engine = Engine(spark, str(root), f"file://{tmp_path}/index")
    engine.rebuild("fts+vector")
    (root / "f0.md").unlink()
    (root / "f1.md").write_text("quite new words of the file")
    (root / "f9.md").write_text("shared note for all")
    assert engine.reconcile() == {"deleted": 1, "changed": 1, "new": 1, "unchanged": 4}
    keys = {"files": ["rel_path", "content_hash"], "chunks": ["rel_path", "chunk_index", "normalized_text"], "shared": ["shared_normalized_text", "ref_count"], "postings": ["token", "rel_path", "chunk_index", "dl", "tf"], "stats": ["n_chunks", "total_tokens"], "vectors": ["shared_normalized_text_hash"]}
    held = lambda: {t: sorted(map(tuple, engine.store.read(t).select(*c).collect())) for t, c in keys.items()}
    updated = held()
    run = engine.status()["latest_run"]
    assert (run["mode"], run["indexed_files"], run["chunks_indexed"]) == ("reconcile", 2, 2) and run["finished_unix_ms"] >= run["started_unix_ms"]
    engine.rebuild()
    assert held() == updated
    assert len([p for p in (tmp_path / "index").iterdir() if p.name.startswith("snapshot=")]) == 2
    assert engine.file_counts("f9.md") == {"chunks": 1, "shared": 1}


def test_stored_postings_answer_as_the_scan_does(spark, small):
    c = chunks_of(corpus.from_documents(spark.read.parquet(f"{small}/documents.parquet")))
    for query, scope in (("licensed under the", None), ("Licensed", "src1"), ("the the zzz", None), ("two-part words", None), ("!!", None)):
        found = [lexical.candidates(c, query, scope), lexical.stored_candidates(lexical.by_token(lexical.postings(c)), lexical.corpus_stats(c), c, query, scope)]
        a, b = ({(r["rel_path"], r["chunk_index"]): (round(r["bm25"], 6), round(r["lexical_score"], 6)) for r in x.collect()} for x in found)
        assert a == b


def test_state_and_lost_tables(spark, tmp_path):
    root = tmp_path / "v"
    root.mkdir()
    (root / "a.md").write_text("some words")
    engine = Engine(spark, str(root), f"file://{tmp_path}/index")
    engine.rebuild()
    assert engine.status()["dirty"] is False
    synced = engine.status()["last_sync_unix_ms"]
    engine.mark_dirty("files changed")
    assert engine.status()["dirty_reason"] == "files changed" and engine.status()["last_sync_unix_ms"] == synced
    engine.reconcile()
    assert engine.status()["dirty"] is False
    shutil.rmtree(tmp_path / "index" / engine.store.pointer()["snapshot"] / "postings")
    with pytest.raises(ValueError):
        engine.index()
    assert engine.status()["dirty"] and "postings" in engine.status()["dirty_reason"]


def test_lock_of_a_dead_writer_is_taken_over(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "LOCK").write_text("")
    os.utime(tmp_path / "s" / "LOCK", (1, 1))
    with store.locked():
        assert (tmp_path / "s" / "LOCK").exists()
    assert not (tmp_path / "s" / "LOCK").exists()


def test_covering_roots(spark, tmp_path):
    for p in ("a/.textloom", "a/b/c/.textloom", "a/b/x"):
        (tmp_path / p).mkdir(parents=True)
    at = str(tmp_path)
    assert corpus.covering_roots(f"{at}/a/b") == {"ancestors": [f"{at}/a"], "descendants": [f"{at}/a/b/c"]}
    (tmp_path / "a" / "n.md").write_text("words in a")
    (tmp_path / "a" / "b" / "c" / "m.md").write_text("words in c")
    for p in ("a", "a/b/c"):
        Engine(spark, f"{at}/{p}").rebuild()
    (tmp_path / "a" / "b" / "x" / "new.md").write_text("fresh")
    assert reconcile_covering(spark, f"{at}/a/b") == {f"{at}/a": {"new": 1, "unchanged": 1}, f"{at}/a/b/c": {"unchanged": 1}}


def test_vector_bytes(spark):
    df = spark.createDataFrame([(1, [1.0, 2.5])], "k int, v array<float>").withColumn("b", vector.to_bytes(F.col("v")))
    assert bytes(df.first()["b"]) == b"\x00\x00\x80?\x00\x00 @"
    assert df.select(vector.from_bytes(F.col("b"), 2).alias("v")).first()["v"] == [1.0, 2.5]
    with pytest.raises(Exception, match="8 bytes, 12 are expected"):
        df.select(vector.from_bytes(F.col("b"), 3)).collect()


def test_semantic_cap_of_many_queries(spark):
    rows = [(q, f"{i:03}", 0, 0.1, float(q == 0 and i == 3), 0.5, q == 0 and i == 3, False) for q in (0, 1) for i in range(9)]
    df = spark.createDataFrame(rows, "q int, rel_path string, chunk_index int, score double, lexical_score double, vector_score double, indexed_text_match boolean, partial_text_match boolean")
    out = fuse.cap_semantic(df, by=("q",)).groupBy("q").count().collect()
    assert {r["q"]: r["count"] for r in out} == {0: 6, 1: 9}


@pytest.mark.parametrize("query,want", [("a]b}", False), ("a.b", False), ("(ab", True), ("x{2}", True), ("x{a}", True), ("^ab", True), ("plain words", False)])
def test_router_decisions(query, want):
    assert router.is_regex(query) == want
