"""Suites, probes, live snippets, messages, rendering and the command line."""

import json
import os

import pytest
from pyspark.sql import functions as F

import textloom
from textloom.__main__ import main
from textloom.functions import text as T
from textloom.operators import vector
from textloom.plans import dev, messages, render
from textloom.plans import schemas as S
from textloom.plans.engine import Engine, Index, chunks_of
from textloom.sources import corpus


@pytest.fixture(scope="module")
def vault(tmp_path_factory):
    root = tmp_path_factory.mktemp("v") / "vault"
    (root / "src").mkdir(parents=True)
    (root / "a.md").write_text("Retry with exponential backoff after a failure of the remote side.\n\nSecond paragraph, long enough to be a chunk of its own here.\n")
    (root / "b.md").write_text("Nothing about it, but a line that is long enough to stand on its own.\n")
    (root / "src" / "lib.py").write_text("def retry_backoff(n):\n    return n\n")
    return root


FIXTURE = {"suite_id": "s", "sample_vault_manifest": "m.json", "default_limit": 5, "cases": [{"id": "one", "query": "exponential backoff", "expectations": {"must_include": [{"path": "a.md", "within_top": 1, "snippet_contains": "Retry"}]}}, {"id": "two", "query": "stand", "limit": 3, "notes": "fails", "expectations": {"must_include": [{"path": "a.md", "within_top": 1}]}}]}


def test_suite_probes_and_commands(spark, vault, tmp_path, capsys):
    root, fixture, golden = str(vault), str(tmp_path / "f.json"), str(tmp_path / "g.json")
    dev.write_json(fixture, FIXTURE)
    assert main(["x", root + "x"]) == 1 and "does not exist" in capsys.readouterr().err
    assert main(["backoff", root]) == 1
    assert "estimated chunks: 4" in (err := capsys.readouterr().err) and "--level fts+vector" in err
    assert main(["index", "status", root]) == 0 and "indexed: no" in capsys.readouterr().out
    assert main(["index", "init", root]) == 0
    said = capsys.readouterr()
    assert "[3 indexed / 3 scanned / 4 chunks]" in said.out and "finds by meaning" in said.err
    assert main(["dev", "eval", root, "--fixture", fixture, "--write-golden", golden]) == 1  # one case fails
    out = capsys.readouterr().out
    assert "cases=1/2" in out and "[pass] one" in out and "[fail] two" in out and "missed: a.md" in out
    assert [c["id"] for c in json.load(open(golden))["cases"]] == ["one", "two"]
    report = dev.evaluate(Engine(spark, root), fixture, golden)
    assert (report["cases"], report["passed"], report["failed_expectations"], report["failed_golden"]) == (2, 1, 1, 0)
    moved = json.load(open(golden))
    moved["cases"][0]["hits"][0]["line_start"] = 9
    dev.write_json(golden, moved)
    assert dev.evaluate(Engine(spark, root), fixture, golden)["failed_golden"] == 1
    assert main(["dev", "index", root]) == 0
    out = capsys.readouterr().out
    assert "chunk kinds:\n  text 3\n  symbol 1" in out and "top files by chunks:\n  2 a.md" in out
    assert main(["dev", "chunks", str(vault / "src" / "lib.py"), "--json"]) == 0
    rows = json.loads(capsys.readouterr().out)
    assert [(r["chunk_kind"], r["symbol_kind"], r["line_start"]) for r in rows] == [("symbol", "function", 1)]
    assert main(["backoff", str(vault / "a.md")]) == 0
    assert capsys.readouterr().out.startswith("a.md:[rf] 1: Retry with")
    assert main(["grep", "s[t]and", str(vault / "b.md")]) == 0
    assert capsys.readouterr().out.startswith("b.md:1:Nothing")
    assert main(["index", "status", str(vault / "src")]) == 0
    out = capsys.readouterr().out
    assert f"index root: {root}" in out and "fts ready: yes" in out and "upgrade: " in out
    assert main(["index", "delete", root]) == 0 and main(["index", "delete", root]) == 0
    assert capsys.readouterr().out.splitlines() == [f"deleted the index of {root}", f"{root} has no index"]


def test_live_snippets(spark, tmp_path):
    root = tmp_path / "v"
    root.mkdir()
    for name in "abc":
        (root / f"{name}.md").write_text(f"the needle in {name} is in a line of more than forty-eight letters\n")
    engine = Engine(spark, str(root))
    engine.rebuild()
    (root / "a.md").write_text("needle: now quite another line of more than forty-eight letters\n")
    (root / "b.md").unlink()
    (root / "c.md").write_bytes(b"\xff\xfe needle")
    lexical = {r["rel_path"]: r["snippet"] for r in engine.search("letters needle")}  # the words don't stand in a row
    assert lexical == {"a.md": "needle: now quite another line of more than forty-eight letters"}
    stored = {r["rel_path"] for r in engine.index().search("letters needle").collect()}
    assert stored == {"a.md", "b.md", "c.md"}


def test_unreadable_files_are_told(spark, tmp_path, monkeypatch):
    root = tmp_path / "v"
    root.mkdir()
    for name in "ab":
        (root / f"{name}.md").write_text(f"words of {name}")
    engine = Engine(spark, str(root))
    engine.rebuild()
    real = os.access
    monkeypatch.setattr(os, "access", lambda p, m: not str(p).endswith("a.md") and real(p, m))
    assert engine.reconcile() == {"unchanged": 1}  # what is stored of the other stays
    assert (engine.status()["dirty_reason"], engine.status()["files"]) == ("a.md cannot be read", 2)
    assert engine.rebuild() == {"scanned_files": 2, "indexed_files": 1, "chunks_indexed": 1, "warnings": 1, "first_warning": "a.md cannot be read"}
    assert engine.status()["latest_run"]["error"] == "a.md cannot be read"
    monkeypatch.undo()
    assert engine.reconcile() == {"unchanged": 1, "new": 1} and not engine.status()["dirty"]


def test_own_scanner(spark):
    class Exact:
        def literal_scan(self, lines, literal):
            return lines.where(F.col("line") == literal)

        def regex_scan(self, lines, pattern):
            return lines.limit(0)

    f = spark.createDataFrame([("a.md", "needle"), ("b.md", "the needle")], "rel_path string, body string")
    chunks = chunks_of(f)
    found = {r["rel_path"]: r["channel_label"] for r in Index(f, chunks, scanner=Exact()).search("needle").collect()}
    assert found == {"a.md": "rf", "b.md": "f"} and Index(f, chunks, scanner=Exact()).grep("x").count() == 0


def test_benchmark(spark, vault, tmp_path):
    fixture, out = str(tmp_path / "f.json"), str(tmp_path / "o" / "r.json")
    dev.write_json(fixture, FIXTURE | {"cases": FIXTURE["cases"][:1]})
    report = dev.benchmark(spark, fixture, str(vault), 2, out)
    assert [(b["level"], b["files"], b["chunks"], len(b["runs"])) for b in report["levels"]] == [("fts", 3, 4, 2), ("fts+vector", 3, 4, 2)]
    assert json.load(open(out)) == report and "[fts+vector]" in render.bench_report(report)


def test_vault_from_a_checkout(vault, tmp_path):
    manifest = {"id": "x", "repository": "r", "commit": "c", "checkout_dir": "x-1"}
    with pytest.raises(FileNotFoundError, match="checkout of r at c"):
        dev.ensure_vault(manifest, str(tmp_path))
    (vault / ".git").mkdir()
    at = dev.ensure_vault(manifest, str(tmp_path), str(vault))
    (vault / ".git").rmdir()
    assert corpus.walk(at) == ["a.md", "b.md", "src/lib.py"] and not (tmp_path / "x-1" / ".git").exists()
    assert dev.ensure_vault(manifest, str(tmp_path)) == at


@pytest.mark.parametrize("raw,want", [("Ǖber naïve Ắ", "uber naive a"), ("ẹ́ e\u0301 İ", "e e i"), ("ø ß и", "ø ß и"), ("PLAIN", "plain"), ("ř ş ț ž", "r s t z")])
def test_folding(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "x string").select(T.folded(F.col("x"))).first()[0] == want


def test_messages_and_levels():
    assert S.parse_level("fts") == "fts"
    with pytest.raises(ValueError, match="fts and fts\\+vector"):
        S.parse_level("full")
    assert "--level" not in messages.index_required("/r", 5_000) and messages.index_required("/r", 2_000).count("--level") == 1
    assert messages.follow_up("/r", "fts", 1_025) is None and messages.level_hint("/r", "fts+vector", 3_000).startswith("downgrade")
    assert "--level fts+vector --force" in messages.force_required("/r", "fts+vector", {"estimated_chunks": 1, "recommended": 2, "force_threshold": 3})
    assert len(messages.overlaps({"ancestors": ["/r", "/"], "descendants": ["/r/x"]}, "/r")) == 2


def test_style_and_colour():
    class Out:
        def __init__(self, tty):
            self.isatty = lambda: tty

    assert render.style(Out(True), {}) == {"headings": True, "colour": True}
    assert render.style(Out(True), {"NO_COLOR": ""}) == {"headings": True, "colour": False}
    assert render.style(Out(False), {"CLICOLOR_FORCE": "1"}) == {"headings": False, "colour": True}
    assert render.style(Out(True), {"TERM": "dumb"}) == {"headings": False, "colour": False}
    row = {"rel_path": "a.md", "snippet": "x", "line_start": 1, "line_end": 2, "channel_label": "f"}
    assert render.hits([row], colour=True) == "\x1b[1;35ma.md\x1b[0m:\x1b[2;33m[f]\x1b[0m \x1b[32m1-2\x1b[0m: x"


def test_scope_kind(vault):
    assert corpus.scope_kind(str(vault), str(vault)) == (None, "dir")
    assert corpus.scope_kind(str(vault), str(vault / "src")) == ("src", "dir")
    assert corpus.scope_kind(str(vault), str(vault / "src" / "lib.py")) == ("src/lib.py", "file")
    with pytest.raises(ValueError, match="not below"):
        corpus.scope_kind(str(vault / "src"), str(vault))


class Batched:
    def many(self, texts, prefix, dims):
        return [[float(len(texts))] * dims for _ in texts]


def test_embedding_in_batches(spark):
    spark.conf.set("textloom.embed.batchSize", "2")
    rows = vector.embed(spark.createDataFrame([(x,) for x in "abc"], "t string").coalesce(1), "t", dims=1, embedder=Batched()).collect()
    spark.conf.unset("textloom.embed.batchSize")
    assert [r["vector"] for r in rows] == [[2.0], [2.0], [1.0]]


def test_exports():
    assert textloom.matches_query("A tiny mini GREP-like utility", "mini grep") and textloom.Engine is Engine
    with pytest.raises(AttributeError):
        textloom.nothing  # noqa: B018
