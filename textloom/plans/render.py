"""Text output of hits and status."""

from __future__ import annotations

import os
import re
import sys

from textloom.operators.chunk import CHUNK_MODE, POLICIES
from textloom.plans import messages
from textloom.functions.text import CHUNK_MARKER

# Terminal colours of paths, channels and line numbers.
PATH, CHANNEL, LINE, PLAIN = "\x1b[1;35m", "\x1b[2;33m", "\x1b[32m", "\x1b[0m"


def style(out=sys.stdout, env=os.environ) -> dict[str, bool]:
    """Headings and colour suit a terminal; NO_COLOR and CLICOLOR_FORCE decide on colour, the former first."""
    terminal = out.isatty() and env.get("TERM") != "dumb"
    colour = "NO_COLOR" not in env and (terminal or env.get("CLICOLOR_FORCE", "0") != "0")
    return {"headings": terminal, "colour": colour}


def preview(text: str, multiline: bool) -> str:
    if not multiline:
        return re.sub(r"\s+", " ", text).strip()
    return "\n".join(x.strip() for x in text.splitlines() if x.strip())


def label(start: int, end: int) -> str:
    return str(start) if start == end else f"{start}-{end}"


def hits(rows: list[dict], context: bool = False, headings: bool = False, colour: bool = False) -> str:
    """Hits as ``path:[label] lines: text``; with headings, consecutive hits of a path share one heading."""
    paint = lambda s, code: f"{code}{s}{PLAIN}" if colour else s
    out, last = [], None
    for r in rows:
        body = preview(r["snippet"], context)
        lines = label(r["line_start"], r["line_end"])
        gap = "\n" if context and "\n" in body else " "
        mark = f"{paint('[' + r['channel_label'] + ']', CHANNEL)} {paint(lines, LINE)}:{gap}{body}"
        if headings:
            if r["rel_path"] != last:
                out += ([""] if last is not None else []) + [paint(r["rel_path"], PATH)]
            out.append(mark)
        else:
            out.append(f"{paint(r['rel_path'], PATH)}:{mark}")
        last = r["rel_path"]
    return "\n".join(out)


def lines(rows: list[dict]) -> str:
    return "\n".join(f"{r['rel_path']}:{r['line_number']}:{r['line']}" for r in rows)


def yes(v) -> str:
    return "yes" if v else "no"


def status(path: str, s: dict) -> str:
    """What ``Engine.status`` gives, or that there is no index (None)."""
    head = [f"requested path: {path}"]
    if s is None:
        return "\n".join([*head, "index root: none", "indexed: no", "index level: -"])
    level, run, around = s.get("index_level", "unknown"), s.get("latest_run"), s.get("overlapping_roots", [])
    out = [*head, f"index root: {s['root']}", "indexed: yes", f"index level: {level}", f"chunking: {CHUNK_MODE}", f"marker: {CHUNK_MARKER.strip()}", *[f"{k} policy: {v}" for k, v in POLICIES.items()]]
    out += [f"dirty: {yes(s['dirty'])}", f"dirty reason: {s['dirty_reason'] or 'none'}"]
    out += [f"{name}: {s[key]}" for name, key in (("files", "files"), ("chunks", "chunks"), ("shared chunks", "shared"), ("vectors", "vectors")) if key in s]
    out += [f"{name} ready: {yes(s.get(name + '_ready'))}" for name in ("fts", "vector")]
    if run:
        out += [f"last index run status: {'failed' if run['error'] else 'ok'}", f"last index run duration ms: {run['duration_ms']}"]
    hint = messages.level_hint(s["root"], level, s["chunks"]) if run else None
    out += [hint] * bool(hint)
    out.append(f"last sync unix ms: {s['last_sync_unix_ms'] if s['last_sync_unix_ms'] is not None else 'never'}")
    return "\n".join(out + [f"also indexed at: {r}" for r in around])


def quality_report(r: dict) -> str:
    out = [f"suite: {r['suite_id']}  cases={r['passed']}/{r['cases']}  vault={r['vault']}", f"fixture: {r['fixture']}"]
    out += [f"golden: {r['golden']}"] * bool(r["golden"])
    out.append(f"expectation failures: {r['failed_expectations']}  golden failures: {r['failed_golden']}")
    for c in r["results"]:
        out += ["", f"[{'fail' if c['missed'] or c['differs'] else 'pass'}] {c['case_id']}  {c['query']}"]
        out += [f"{k}: {c[k]}" for k in ("scope", "notes") if c[k]]
        out += [f"missed: {p}" for p in c["missed"]] + [f"differs from golden at #{n}" for n in c["differs"]]
        out += [f"#{h['rank']:02} {h['rel_path']}:{h['line_start']}-{h['line_end']} score={h['score']:.3f} lexical={h['lexical_score'] or 0:.3f} vector={h['vector_score'] or 0:.3f} {preview(h['snippet'], False)}" for h in c["hits"]]
    return "\n".join(out)


def bench_report(r: dict) -> str:
    out = [f"fixture: {r['fixture']}", f"source: {r['source']}", f"repeat: {r['repeat']}"] + [f"scratch: {r['scratch']}"] * bool(r["scratch"])
    for b in r["levels"]:
        out += ["", f"[{b['level']}]", f"init ms: {b['init_ms']}", f"files={b['files']} chunks={b['chunks']}", f"queries: total={b['total']}ms mean={b['mean']}ms p50={b['p50']}ms p95={b['p95']}ms"]
        out += [f"  {x['case_id']}#{x['run']} {x['ms']}ms lines={x['lines']}" for x in b["runs"]]
    return "\n".join(out)


def chunk_report(path: str, rows: list[dict]) -> str:
    out = [f"path: {path}", f"chunks: {len(rows)}"]
    for c in rows:
        out += ["", f"#{c['chunk_index']} {c['chunk_kind']} {c['line_start']}-{c['line_end']}"]
        out += [f"{k.replace('_', ' ')}: {c[k]}" for k in ("language", "symbol_kind", "container") if c[k]]
        out += [f"{k.replace('_', ' ')}: {c[k]!r}" for k in ("raw_text", "normalized_text", "shared_normalized_text")] + [f"shared hash: {c['shared_normalized_text_hash']}"]
    return "\n".join(out)


def index_report(path: str, r: dict) -> str:
    s = r["status"]
    out = [status(path, s)]
    for title in ("chunk_kinds", "symbol_languages", "symbol_kinds"):
        out += [title.replace("_", " ") + ":"] + [f"  {x['key']} {x['n']}" for x in r[title]]
    out += ["top files by chunks:"] + [f"  {x['n']} {x['rel_path']}" for x in r["top_files"]]
    return "\n".join(out + ["top shared chunks:"] + [f"  ref_count={x['ref_count']} {x['normalized_text']!r}" for x in r["top_shared"]])
