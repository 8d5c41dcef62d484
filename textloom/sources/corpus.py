"""Corpora: a walk over a directory tree, admission rules, tables of documents, and lines."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.plans import schemas as S


def from_documents(docs: DataFrame) -> DataFrame:
    """Documents as files: rel_path ``source/doc_id.md``, the text as body."""
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return docs.select(path.alias("rel_path"), F.coalesce("text", F.lit("")).alias("body"))


def _pattern(line: str) -> tuple[re.Pattern, bool, bool] | None:
    """(pattern of paths below the folder, ignored, folders only) of a line of an ignore file; None for blanks and comments.

    A slash at the start or inside ties the pattern to the file's own folder; ``*`` and ``?`` stay within a name, ``**``
    spans folders.
    """
    line = re.sub(r"(?<!\\)\s+$", "", line)
    if not line or line.startswith("#"):
        return None
    ignored = not line.startswith("!")
    line = line if ignored else line[1:]
    line = line[1:] if line.startswith(("\\#", "\\!")) else line
    folders = line.endswith("/")
    tied = "/" in line.rstrip("/")
    line = line.strip("/")
    out, i = "" if tied else "(?:.*/)?", 0
    while i < len(line):
        if line.startswith("**/", i) and (i == 0 or line[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif line[i:] == "**" and i and line[i - 1] == "/":
            out, i = out + ".+", i + 2
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and "]" in line[i + 2 :]:
            end = line.index("]", i + 2)
            inner = line[i + 1 : end]
            out, i = out + "(?!/)[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]", end + 1
        elif line[i] == "\\" and i + 1 < len(line):
            out, i = out + re.escape(line[i + 1]), i + 2
        else:
            out, i = out + re.escape(line[i]), i + 1
    return re.compile(out + r"\Z", re.DOTALL), ignored, folders


def _rules(folder: str, names: tuple[str, ...] = (".gitignore", ".ignore", ".textloomignore")) -> list[tuple[re.Pattern, bool, bool]]:
    """The patterns of a folder's ignore files in order, the last match decides."""
    out = []
    for name in names:
        path = os.path.join(folder, name)
        if os.path.isfile(path):
            with open(path, encoding="utf-8", errors="replace") as f:
                out += [p for p in map(_pattern, f.read().splitlines()) if p]
    return out


def _rules_above(root: str) -> list[tuple[str, list]]:
    """Rules of the repository's folders above the root (up to the one that holds ``.git``) and of its ``info/exclude``, outermost first.

    Their patterns are tied to those folders, so each comes with the path from there to the root.
    """
    out, at, below = [], os.path.abspath(root), ""
    while True:
        if os.path.isdir(os.path.join(at, ".git")):
            out.append((below, _rules(os.path.join(at, ".git", "info"), ("exclude",))))
            return out[::-1]
        up = os.path.dirname(at)
        if up == at:
            return []  # no repository: folders above have no say
        below = f"{os.path.basename(at)}/{below}" if below else os.path.basename(at)
        at = up
        out.append((below, _rules(at)))


def _ignored(rel: str, is_dir: bool, chain: list[tuple[str, list]], above: list[tuple[str, list]]) -> bool:
    verdict = False
    named = [(f"{below}/{rel}" if below else rel, rules) for below, rules in above] + [(rel[len(base) :].lstrip("/"), rules) for base, rules in chain]
    for inner, rules in named:
        for pattern, ignored, folders in rules:
            if (is_dir or not folders) and pattern.match(inner):
                verdict = ignored
    return verdict


def walk(root: str, scope: str = "") -> list[str]:
    """Candidate files below a local root: no hidden names, no links, ignore files respected; sorted."""
    found: list[str] = []
    above = _rules_above(root)

    def visit(rel: str, chain: list) -> None:
        folder = os.path.join(root, rel)
        chain = [*chain, (rel, _rules(folder))]
        for name in sorted(os.listdir(folder)):
            if scope and not (inside := f"{rel}/{name}" if rel else name).startswith(scope.rstrip("/") + "/") and not (scope.rstrip("/") + "/").startswith(inside + "/"):
                continue  # neither in the scope nor above it
            path = f"{rel}/{name}" if rel else name
            full = os.path.join(root, path)
            if name.startswith(".") or os.path.islink(full) or _ignored(path, os.path.isdir(full), chain, above):
                continue
            if os.path.isdir(full):
                visit(path, chain)
            else:
                found.append(path)

    visit("", [])
    return [p for p in found if not scope or p == scope or p.startswith(scope.rstrip("/") + "/")]


def unreadable(root: str, names: list[str]) -> list[str]:
    """The names of a root that may not be read."""
    return [n for n in names if not os.access(os.path.join(root, n), os.R_OK)]


def read_tree(spark: SparkSession, root: str, scope: str = "") -> DataFrame:
    """rel_path, size_bytes, modified_unix_ms, content of the candidates; the bytes are read by the executors."""
    return read_files(spark, root, walk(root, scope))


def read_files(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """The named files of a root, as ``read_tree`` gives them."""
    paths = [os.path.join(root, p) for p in names]
    if not paths:
        return spark.createDataFrame([], "rel_path string, size_bytes long, modified_unix_ms long, content binary")
    base = os.path.abspath(root).rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("ignoreMissingFiles", True).load([_escaped(f"file://{os.path.abspath(p)}") for p in paths])
    whole = F.regexp_replace("path", r"^file:/+", "/")  # a plain path, not an encoded address
    rel = F.substring(whole, F.lit(len(base) + 1), F.length(whole))
    return files.select(rel.alias("rel_path"), F.col("length").alias("size_bytes"), F.unix_millis("modificationTime").alias("modified_unix_ms"), "content")


def reread(paths: DataFrame, root: str) -> DataFrame:
    """rel_path, body of the files as they are now, one at a time on the executors; those that are gone or no UTF-8 are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                try:
                    with open(os.path.join(root, name), "rb") as f:
                        body = f.read().decode()
                except (OSError, UnicodeDecodeError):
                    continue
                yield pa.RecordBatch.from_pydict({"rel_path": [name], "body": [body]})

    return paths.select("rel_path").distinct().mapInArrow(run, "rel_path string, body string")


def _escaped(path: str) -> str:
    """The path with the characters that a reader would take for a pattern escaped."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def language(path: Column) -> Column:
    """By extension, case-sensitive."""
    ext, out = extension(path), F.lit(None).cast("string")
    for e, name in S.CODE_LANGUAGES.items():
        out = F.when(ext == e, name).otherwise(out)
    return out


def admitted(path: Column, size: Column) -> Column:
    """Extension, base name and size rules."""
    base = F.lower(F.element_at(F.split(path, "/"), -1))
    known = F.lower(extension(path)).isin(*S.TEXT_EXTENSIONS) | extension(path).isin(*S.CODE_LANGUAGES) | base.isin(*[b.lower() for b in S.TEXT_BASENAMES])
    return size.between(1, S.MAX_FILE_BYTES) & known & ~F.array_contains(F.split(path, "/"), ".textloom")


def plain_text(body: Column) -> Column:
    """No control characters but white space."""
    return ~body.rlike(r"(?U)[\p{Cc}&&[^\s]]")


def within_lines(body: Column) -> Column:
    return F.size(T.lines(body)) <= S.MAX_LINES


def load(tree: DataFrame) -> DataFrame:
    """Admitted text files of a tree: rel_path, body, size_bytes, modified_unix_ms, content_hash."""
    ok = tree.where(admitted(F.col("rel_path"), F.col("size_bytes")) & F.expr("is_valid_utf8(cast(content as string))"))
    body = ok.withColumn("body", F.col("content").cast("string")).where(plain_text(F.col("body")) & within_lines(F.col("body")))
    return body.select("rel_path", "body", "size_bytes", "modified_unix_ms", F.sha2("content", 256).alias("content_hash"))


def line_rows(files: DataFrame) -> DataFrame:
    """rel_path, line_number, line."""
    return files.select("rel_path", F.posexplode(T.lines(F.col("body"))).alias("p", "line")).select("rel_path", (F.col("p") + 1).alias("line_number"), "line")


def _above(column: str) -> Column:
    """The absolute path itself and every folder above it."""
    parts = F.split(column, "/")
    return F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def root_of(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """The nearest index root that is the path or above it: path, root (null if none). Joined on equal folder names."""
    up = paths.select("path", F.explode(_above("path")).alias("root")).join(roots.distinct(), "root")
    near = up.groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return paths.distinct().join(near, "path", "left")


def roots_around(paths: DataFrame, roots: DataFrame, depth: int = 8) -> DataFrame:
    """path, root, relation: every root that is the path or above it (ancestor), and those at most ``depth`` folders below (descendant)."""
    paths, roots = paths.distinct(), roots.distinct()
    up = paths.select("path", F.explode(_above("path")).alias("root")).join(roots, "root").select("path", "root", F.lit("ancestor").alias("relation"))
    near = F.size(F.split("root", "/")) - F.size(F.split("path", "/"))
    below = roots.select("root", F.explode(_above("root")).alias("path")).where(near.between(1, depth)).join(paths, "path")
    return up.unionByName(below.select("path", "root", F.lit("descendant").alias("relation")))


def scope_kind(root: str, path: str) -> tuple[str | None, str]:
    """Scope (None: the whole root) and kind (dir or file) of a path at or below an index root."""
    at = os.path.relpath(os.path.abspath(path), os.path.abspath(root))
    if at == ".." or at.startswith("../"):
        raise ValueError(f"{path} is not below {root}")
    return (None if at == "." else at.replace(os.sep, "/")), "file" if os.path.isfile(path) else "dir"


def find_root(path: str, marker: str = ".textloom") -> str | None:
    """Nearest ancestor folder that holds an index."""
    at = os.path.abspath(path)
    while True:
        if os.path.isdir(os.path.join(at, marker)):
            return at
        up = os.path.dirname(at)
        if up == at:
            return None
        at = up


def covering_roots(path: str, marker: str = ".textloom", depth: int = 8) -> dict[str, list[str]]:
    """Index roots around a path: the folder itself and those above it (nearest first), and those at most ``depth`` below."""
    at = os.path.abspath(path)
    above, up = [], at
    while True:
        if os.path.isdir(os.path.join(up, marker)):
            above.append(up)
        if os.path.dirname(up) == up:
            break
        up = os.path.dirname(up)
    below = []
    for folder, names, _ in os.walk(at):
        level = 0 if folder == at else os.path.relpath(folder, at).count(os.sep) + 1
        if level and marker in names:
            below.append(folder)
        names[:] = sorted(n for n in names if not n.startswith(".")) if level < depth else []
    return {"ancestors": above, "descendants": below}
