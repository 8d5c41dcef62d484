"""Code symbols: functions, types and constants of source files, as chunks.

No grammar library is assumed: Python is parsed by ``ast``; Rust, JavaScript and TypeScript by a tolerant scanner that
blanks strings, comments and the arguments of macros, matches declarations by pattern and place, and pairs braces.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.plans.schemas import CHUNKS, CODE_LANGUAGES

MAX_TERMS = 64
_WORD = re.compile(r"[^\W\d]\w*")
_SCRIPT = [
    ("class", r"\b(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"),
    ("interface", r"\binterface\s+([A-Za-z_$][\w$]*)"),
    ("module", r"\bmodule\s+([A-Za-z_$][\w$.]*)"),
    ("function", r"\b(?:async\s+)?function\s+([A-Za-z_$][\w$]*)"),
    ("binding", r"^(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)"),
    ("method", r"(?:^|(?<=[{};]))[ \t]*(?:(?:public|private|protected|static|async|get|set|abstract|readonly)\s+)*\*?([A-Za-z_$][\w$]*)\s*(?:<[^>\n]*>)?\([^;{}]*\)\s*(?::[^;{}\n]+)?[;{]"),
]
_RUST = [("function", "fn"), ("struct", "struct"), ("enum", "enum"), ("trait", "trait"), ("type", "type"), ("module", "mod"), ("constant", "const"), ("constant", "static")]
_MACRO = re.compile(r"(?<![\w])[A-Za-z_]\w*!\s*(?:[A-Za-z_]\w*\s*)?[(\[{]")
_OPERAND = re.compile(r"\b(?:return|new|typeof|void|await|yield|throw|in|of|case)\s*$")
_NOT_METHODS = {"if", "for", "while", "switch", "catch", "function", "return", "with", "else", "do", "super", "constructor_"}
# Words that are no identifiers to the grammars.
_KEYWORDS = {
    "rust": set("as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn".split()) | set("u8 u16 u32 u64 u128 usize i8 i16 i32 i64 i128 isize f32 f64 bool char str".split()),
    "script": set("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof let new return super switch this throw try typeof var void while with yield async await of static interface type enum implements namespace module declare abstract readonly true false null undefined public private protected string number boolean any never unknown".split()),
}


def fold(text: str) -> str:
    return " ".join(re.split(r"[\t-\r \x85\xa0  -     　]+", text)).strip().lower()


def expand(term: str) -> list[str]:
    spaced = re.sub(r"(?<=[^\W_A-Z])(?=[A-Z])", " ", term)
    return list(dict.fromkeys(t for t in [term.strip().lower(), *re.split(r"[\W_]+", spaced.lower())] if t))


def blanked(body: str, line_comment: str) -> str:
    """The body with strings and comments as spaces; positions and line breaks stay."""
    out, i, n = list(body), 0, len(body)

    def blank(a: int, b: int) -> None:
        for k in range(a, min(b, n)):
            if out[k] != "\n":
                out[k] = " "

    while i < n:
        two = body[i : i + 2]
        if two == line_comment:
            j = body.find("\n", i)
            j = n if j < 0 else j
        elif two == "/*":
            j = body.find("*/", i + 2)
            j = n if j < 0 else j + 2
        elif body[i] in "\"`" or body[i] == "'" and not re.match(r"'\w+\b(?!')", body[i : i + 40]):
            j = i + 1
            while j < n and body[j] != body[i]:
                j += 2 if body[j] == "\\" else 1
            j += 1
        else:
            i += 1
            continue
        blank(i, j)
        i = j
    return "".join(out)


def block_end(code: str, at: int) -> int:
    """End of the declaration at ``at``: its closing brace, or the semicolon before any brace."""
    depth = parens = 0
    for k in range(at, len(code)):
        c = code[k]
        if c in "([":
            parens += 1
        elif c in ")]":
            parens -= 1
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return k + 1
        elif c == ";" and not depth and parens <= 0:
            return k + 1
    return len(code)


def without_macros(code: str) -> str:
    """Rust code with what macros are given as spaces: it is no code of its own."""
    out, at = code, 0
    while m := _MACRO.search(out, at):
        opened, end = 0, len(out)
        for k in range(m.end() - 1, len(out)):
            opened += (out[k] in "([{") - (out[k] in ")]}")
            if not opened:
                end = k
                break
        out, at = out[: m.end()] + re.sub(r"[^\n]", " ", out[m.end() : end]) + out[end:], end
    return out


def before(code: str, at: int) -> str:
    """The last character before a place that is no space; empty at the beginning."""
    at -= 1
    while at >= 0 and code[at].isspace():
        at -= 1
    return code[at] if at >= 0 else ""


def implemented(code: str, body: str, at: int) -> str:
    """The type that the ``impl`` at a place is for, as written with its arguments."""
    stop = code.find("{", at)
    head, depth, cuts = code[at : stop if stop >= 0 else len(code)], 0, []
    for m in re.finditer(r"->|[<>(\[)\]]|\bfor\b(?!\s*<)|\bwhere\b", head):
        depth += (m[0] in "<([") - (m[0] in ">)]")
        if not depth and m[0] in (">", "for", "where"):
            cuts.append((m[0], m.start(), m.end()))
    generic = re.match(r"impl\s*<", head)
    begin = next((e for c, _, e in cuts if c == ">"), len(head)) if generic else len("impl")
    begin = next((e for c, _, e in cuts if c == "for"), begin)
    return body[at + begin : at + next((b for c, b, _ in cuts if c == "where"), len(head))].strip()


def scanned(body: str, language: str) -> list[tuple[str, str, int, int, str | None]]:
    """(kind, name, start, end, container) of each declaration, in order."""
    code = blanked(body, "//")
    found: list[tuple[str, str, int, int]] = []
    scopes: list[tuple[str, int, int]] = []
    if language == "rust":
        code = without_macros(code)
        for kind, word in _RUST:
            for m in re.finditer(rf"(?<![\w'])((?:pub\b(?:\([^)]*\))?\s+)?(?:(?:default|async|unsafe|extern)\s+)*(?:const\s+(?=fn|unsafe|async|extern))?{word}\s+(?:mut\s+)?([A-Za-z_]\w*))", code):
                end = block_end(code, m.start(1))
                if before(code, m.start(1)) not in ("", *"{};]") or m[2] in ("fn", "unsafe", "async", "extern"):
                    continue  # a parameter, a pointer, a bound
                if kind == "function" and code[end - 1] != "}" or kind == "type" and "=" not in code[m.end() : end]:
                    continue  # declared only
                found.append((kind, m[2], m.start(1), end))
        for m in re.finditer(r"(?<![\w'])impl\b", code):
            word = re.compile(r"\b(?:unsafe|default)\s+$").search(code, max(0, m.start() - 16), m.start())
            if before(code, word.start() if word else m.start()) in ("", *"{};]"):
                scopes.append((implemented(code, body, m.start()), m.start(), block_end(code, m.start())))
        holders = {"struct", "enum", "trait", "type", "module"}
    else:
        for kind, pattern in _SCRIPT:
            for m in re.finditer(pattern, code, re.M):
                start = m.start() + len(m[0]) - len(m[0].lstrip())
                end = block_end(code, start)
                if kind == "binding":
                    value = code[m.end() : end]
                    real = "function" if re.match(r"[^=;]*=\s*(?:async\s*)?(?:function\b|\([^;{}]*\)\s*(?::[^=;]+)?=>|[\w$]+\s*=>)", value) else "constant"
                    start = m.start(1)
                    found.append((real, m[1], start, end))
                elif kind == "function" and (before(code, start) in tuple("=(,:?[&|!+-.>") or _OPERAND.search(code, max(0, start - 16), start)):
                    continue  # a named function as a value
                elif kind != "method" or m[1] not in _NOT_METHODS:
                    found.append((kind, m[1], start, end))
        types = [(s, e) for k, _, s, e in found if k in ("class", "interface")]
        # A method stands in the braces of a type, not deeper: there the same words are a call.
        found = [f for f in found if f[0] != "method" or any(s < f[2] < e and code.count("{", s, f[2]) - code.count("}", s, f[2]) == 1 for s, e in types)]
        holders = {"class", "interface", "module", "function"}
    scopes += [(name, s, e) for kind, name, s, e in found if kind in holders]
    found = sorted(set(found), key=lambda f: (f[2], -f[3]))
    return [(k, n, s, e, "::".join(x for x, a, b in sorted(scopes, key=lambda q: q[1]) if a < s and e <= b) or None) for k, n, s, e in found]


def preceding_doc(lines: list[str], row: int, language: str) -> str:
    """Comment lines right above a row; blank lines in between are skipped once before any comment."""
    marks = ["#"] if language == "python" else ["///", "//!", "//", "/**", "/*", "*"]
    out: list[str] = []
    for line in (x.strip() for x in reversed(lines[:row])):
        if not line:
            if out:
                break
            continue
        mark = next((m for m in marks if line.startswith(m)), None)
        if mark is None:
            break
        out.append(line[len(mark) :].strip())
    return "\n".join(reversed(out)).strip()


def python_symbols(body: str) -> list[dict]:
    try:
        tree = ast.parse(body)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: list[dict] = []

    def names(node: ast.AST) -> list[str]:
        found: list[tuple[int, int, str]] = []
        stack = list(ast.iter_child_nodes(node))
        while stack:
            x = stack.pop()
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            for text in (getattr(x, "id", None), getattr(x, "arg", None), getattr(x, "attr", None)):
                if isinstance(text, str):
                    found.append((getattr(x, "lineno", 0), getattr(x, "end_col_offset", 0), text))
            stack += list(ast.iter_child_nodes(x))
        return [t for _, _, t in sorted(found)]

    def visit(node: ast.AST, above: list[str], top: bool) -> None:
        for x in ast.iter_child_nodes(node):
            named = isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))
            if named:
                kind, doc = ("class" if isinstance(x, ast.ClassDef) else "function"), ast.get_docstring(x) or ""
                out.append({"kind": kind, "name": x.name, "row": x.lineno - 1, "last": x.end_lineno, "container": "::".join(above) or None, "doc": doc, "words": [x.name, *names(x)]})
            elif top and isinstance(x, (ast.Assign, ast.AnnAssign)):
                target = x.targets[0] if isinstance(x, ast.Assign) else x.target
                if isinstance(target, ast.Name):
                    out.append({"kind": "constant", "name": target.id, "row": x.lineno - 1, "last": x.end_lineno, "container": None, "doc": "", "words": names(x)})
            visit(x, [*above, x.name] if named else above, False)

    visit(tree, [], True)
    return out


def symbols(path: str, body: str) -> list[dict]:
    """Symbol chunks of a file, in order; none for other files."""
    language = CODE_LANGUAGES.get(path.rpartition(".")[2])
    lines = body.split("\n")
    if language == "python":
        found = python_symbols(body)
    elif language:
        code = blanked(body, "//")
        declared = scanned(body, language)
        skip = _KEYWORDS["rust" if language == "rust" else "script"]
        found = []
        for kind, name, s, e, container in declared:
            inner = list(code[s:e])
            for _, _, a, b, _ in declared:
                if s < a and b <= e:
                    inner[a - s : b - s] = " " * (b - a)
            row = body.count("\n", 0, s)
            found.append({"kind": kind, "name": name, "row": row, "last": body.count("\n", 0, max(s, e - 1)) + 1, "container": container, "doc": "", "words": [w for w in _WORD.findall("".join(inner)) if w not in skip]})
    else:
        return []
    out = []
    for f in found:
        terms = list(dict.fromkeys(t for w in f["words"] for t in expand(w)))[:MAX_TERMS]
        doc = preceding_doc(lines, f["row"], language) or f["doc"]
        shared = fold(" ".join(terms))
        if not shared:
            continue
        first = lines[f["row"]].strip()
        text = fold(f"name: {f['name']}\nsignature: {first}\ndoc: {doc}\ncontainer: {f['container'] or ''}\npath: {path}\nidentifiers: {' '.join(terms)}")
        out.append({"rel_path": path, "chunk_index": len(out), "line_start": f["row"] + 1, "line_end": f["last"], "raw_text": f"{f['kind']} {f['name']} in {path}", "normalized_text": text, "shared_normalized_text": shared, "shared_normalized_text_hash": hashlib.sha256(shared.encode()).hexdigest(), "chunk_kind": "symbol", "language": language, "symbol_kind": f["kind"], "container": f["container"]})
    return out


def symbol_chunks(files: DataFrame) -> DataFrame:
    """Symbol chunks of code files (rel_path, body)."""
    columns = [c.split()[0] for c in CHUNKS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [s for path, body in zip(frame["rel_path"], frame["body"]) for s in symbols(path, body)]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("rel_path", "body").where(F.regexp_extract("rel_path", r"\.([^./]+)$", 1).isin(*CODE_LANGUAGES)).mapInPandas(run, CHUNKS)
