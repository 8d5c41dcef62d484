"""Command line: search, grep, index (init, status, rebuild, delete), dev (eval, bench, chunks, index)."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from textloom.functions.router import is_regex
from textloom.operators.scan import context
from textloom.plans import dev, messages, render
from textloom.plans import schemas as S
from textloom.plans.engine import Engine, Index, reconcile_covering
from textloom.sources import corpus

COMMANDS = ("search", "grep", "index", "dev")


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("search", "grep"):
        s = sub.add_parser(name)
        s.add_argument("query")
        s.add_argument("path", nargs="?", default=".")
        for flag in ("-A", "-B", "-C"):
            s.add_argument(flag, type=int)
        s.add_argument("--headings", action="store_true")
    s = sub.add_parser("index")
    s.add_argument("action", choices=("init", "status", "rebuild", "delete"))
    s.add_argument("path", nargs="?", default=".")
    s.add_argument("--level", type=S.parse_level)
    s.add_argument("--force", action="store_true")
    s = sub.add_parser("dev")
    s.add_argument("action", choices=("eval", "bench", "chunks", "index"))
    s.add_argument("path", nargs="?", default=".")
    for flag in ("--fixture", "--golden", "--write-golden", "--out"):
        s.add_argument(flag)
    s.add_argument("--repeat", type=int, default=1)
    s.add_argument("--limit", type=int, default=10)
    for flag in ("--json", "--keep"):
        s.add_argument(flag, action="store_true")
    return p


def _say(*lines: str | None) -> None:
    print("\n".join(x for x in lines if x), file=sys.stderr)


def _index(spark: SparkSession, a: argparse.Namespace, path: str) -> int:
    if a.action == "status":
        root = corpus.find_root(path)
        print(render.status(path, Engine(spark, root).status() if root else None))
        return 0
    engine = Engine(spark, path)
    if a.action == "delete":
        print(messages.deleted(path, engine.delete()))
        return 0
    level = a.level or ("fts" if a.action == "init" else engine.level())
    if a.action == "init":
        check = engine.preflight(level)
        if check["requires_force"] and not a.force:
            _say(messages.force_required(path, level, check))
            return 1
        _say(*messages.overlaps(corpus.covering_roots(path), path))
    if level == "fts+vector":
        _say(messages.vector_notice(path, a.action))
    s = engine.rebuild(level, a.action)
    print((messages.initialized if a.action == "init" else messages.rebuilt)(path, level, s))
    _say(messages.follow_up(path, level, s["chunks_indexed"]), messages.delete_note(path) if a.action == "init" else None)
    return 0


def _dev(spark: SparkSession, a: argparse.Namespace, path: str) -> int:
    if a.action == "chunks":
        result = [r.asDict() for r in dev.probe_chunks(spark, path).collect()]
        text = render.chunk_report(path, result)
    elif a.action == "bench":
        result = dev.benchmark(spark, a.fixture, path, a.repeat, a.out, a.keep)
        text = render.bench_report(result)
    else:
        root = corpus.find_root(path)
        if root is None:
            _say(f"no index covers {path}")
            return 1
        if a.action == "index":
            result = dev.probe_index(Engine(spark, root), a.limit)
            text = render.index_report(path, result)
        else:
            result = dev.evaluate(Engine(spark, root), a.fixture, a.golden)
            text = render.quality_report(result)
            if a.write_golden:
                dev.write_json(a.write_golden, dev.golden_of(result))
    print(json.dumps(result, indent=2, ensure_ascii=False) if a.json else text)
    return int(a.action == "eval" and result["passed"] < result["cases"])


def _grep(spark: SparkSession, a: argparse.Namespace, path: str) -> int:
    before, after = context(a.B, a.A, a.C)
    root, names = (os.path.dirname(path), [os.path.basename(path)]) if os.path.isfile(path) else (path, corpus.walk(path))
    files = corpus.load(corpus.read_files(spark, root, names)).select("rel_path", "body")
    print(render.lines([r.asDict() for r in Index(files, files).grep(a.query, before=before, after=after).collect()]))
    return 0


def _search(spark: SparkSession, a: argparse.Namespace, path: str) -> int:
    root = corpus.find_root(path)
    if root is None:
        at = path if os.path.isdir(path) else os.path.dirname(path)
        _say(messages.index_required(at, Engine(spark, at).preflight("fts")["estimated_chunks"]))
        return 1
    reconcile_covering(spark, path, root)
    (scope, kind), (before, after) = corpus.scope_kind(root, path), context(a.B, a.A, a.C)
    rows = Engine(spark, root).search(a.query, scope, kind, before=before, after=after)
    how = render.style()
    print(render.hits([r.asDict() for r in rows], bool(before or after), a.headings or how["headings"], how["colour"]))
    return 0


def main(argv: list[str] | None = None) -> int:
    """Without a command the words are a search."""
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv and argv[0] not in COMMANDS and argv[0] not in ("-h", "--help"):
        argv = ["search", *argv]
    a = arguments().parse_args(argv)
    path = os.path.abspath(a.path)
    if not os.path.exists(path):
        _say(f"{path} does not exist")
        return 1
    spark = SparkSession.builder.appName("textloom").getOrCreate()
    if a.command in ("index", "dev"):
        return (_index if a.command == "index" else _dev)(spark, a, path)
    return (_grep if a.command == "grep" or is_regex(a.query) else _search)(spark, a, path)


if __name__ == "__main__":
    sys.exit(main())
