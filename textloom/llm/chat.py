"""Chat formatting with a grammar round trip.

The template marks every turn: an opening mark that names the role, the text, a closing mark; a conversation stands
between ``<s>`` and ``</s>``. A deterministic parser reads the rendered text back. Each turn is rendered raw first; where
the parser does not return the very same turn or the text holds a mark, the turn is rendered again with its text
escaped, and its opening mark says so. Escaping writes a backslash, ``[`` and ``<`` as two characters that hold
neither ``[`` nor ``<``, so an escaped text has no control string at all and the second rendering always parses back.

``loss`` lists the (start, end) spans of assistant texts in the rendered text, in code points; escaped spans are
listed with their turn's flag, so that the text under the mask can be unescaped.

Defined results: turns are ordered by turn, then role, then text (nulls first); null text or role is empty; rows of a
null conv_id form one conversation; repeated rows are repeated turns; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGIN, END, CLOSE = "<s>", "</s>", "[/INST]"
_OPEN = re.compile(r"\[INST ([^\s\]]*)( esc)?\]")
_SPECIAL = re.compile(r"[\\\[<]")
_ESCAPED = re.compile(r"\\([\\la])")
_CODES = {"\\": "\\\\", "[": "\\l", "<": "\\a"}
_PLAIN = {"\\": "\\", "l": "[", "a": "<"}
SCHEMA = "conv_id long, formatted string, loss array<struct<start:long,end:long,escaped:boolean>>"


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: _CODES[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN[m[1]], text)


def parse_turn(s: str, at: int) -> tuple[str, str, int] | None:
    """Role, text and end of the turn that begins at ``at``; None if none does."""
    m = _OPEN.match(s, at)
    if not m:
        return None
    end = s.find(CLOSE, m.end())
    if end < 0:
        return None
    body = s[m.end() : end]
    return unquote(m[1]), unescape(body) if m[2] else body, end + len(CLOSE)


def parse(s: str) -> list[tuple[str, str]] | None:
    """The turns of a rendered conversation; None if it isn't one."""
    if not s.startswith(BEGIN):
        return None
    at, turns = len(BEGIN), []
    while not s.startswith(END, at):
        turn = parse_turn(s, at)
        if turn is None:
            return None
        turns.append(turn[:2])
        at = turn[2]
    return turns if at + len(END) == len(s) else None


def render_turn(role: str, text: str, escaped: bool) -> tuple[str, str]:
    """Opening mark and body."""
    return f"[INST {quote(role, safe='')}{' esc' * escaped}]", escape(text) if escaped else text


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, bool]]]:
    """The rendered conversation and the loss spans of its assistant turns."""
    flags = [False] * len(turns)
    parts: list[str] = []
    for k, (role, text) in enumerate(turns):
        head, body = render_turn(role, text, False)
        whole = head + body + CLOSE
        conflict = parse_turn(whole, 0) != (role, text, len(whole)) or BEGIN in body or END in body or _OPEN.search(body) is not None
        if conflict:
            flags[k] = True
            head, body = render_turn(role, text, True)
        parts += [head, body, CLOSE]
    s = "".join([BEGIN, *parts, END])
    if parse(s) != turns:
        raise ValueError("the rendered conversation does not parse back to its turns")
    spans, at = [], len(BEGIN)
    for k, (role, _) in enumerate(turns):
        head, body = parts[3 * k : 3 * k + 2]
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body), flags[k]))
        at += len(head) + len(body) + len(CLOSE)
    return s, spans


def format_chats(rows: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, formatted, loss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [render([(t["role"], t["text"]) for t in turns]) for turns in batch.column(1).to_pylist()]
            loss = [[{"start": a, "end": b, "escaped": e} for a, b, e in spans] for _, spans in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in out], pa.string()), pa.array(loss, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("escaped", pa.bool_())])))], ["conv_id", "formatted", "loss"])

    text = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chats = rows.select(F.col("conv_id").cast("long"), text.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return chats.mapInArrow(run, SCHEMA)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the rendered text and its loss mask hold: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, s, loss in zip(*(c.to_pylist() for c in batch.columns)):
                turns = parse(s)
                learned = "".join(unescape(s[x["start"] : x["end"]]) if x["escaped"] else s[x["start"] : x["end"]] for x in loss)
                whole = "".join(f"{role}\n{text}\n" for role, text in turns)
                rows.append((name, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(s)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
