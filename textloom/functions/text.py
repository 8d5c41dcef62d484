"""Text functions as Column builders; everything stays inside JVM expressions.

White space is Unicode White_Space, so patterns carry ``(?U)``.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The inline split marker, the length of snippets.
CHUNK_MARKER = " :: "
SNIPPET_BYTES = 200


def _folding() -> tuple[str, str]:
    """Arguments of ``translate``: Latin lower-case letters whose canonical decomposition is a plain letter and marks, and those letters;
    then the marks that occur in them, which stand for nothing."""
    plain, marks = {}, set()
    for letter in map(chr, (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00))):
        base, *rest = unicodedata.normalize("NFD", letter)
        if rest and base.isascii() and base.isalpha():
            marks.update(rest)
            if letter == letter.lower():
                plain[letter] = base
    return "".join(plain) + "".join(sorted(marks)), "".join(plain.values())


ACCENTED, UNACCENTED = _folding()


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalized(c: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.lower(F.regexp_replace(trimmed(c), r"(?U)\s+", " "))


def terms(c: Column) -> Column:
    n = normalized(c)
    return F.when(n == "", F.array().cast("array<string>")).otherwise(F.split(n, " "))


def matches_all(candidate: Column, query: Column) -> Column:
    """Does the normalized candidate contain every term of the query? An empty query matches."""
    n = normalized(candidate)
    return F.forall(terms(query), lambda t: F.contains(n, t))


def folded(c: Column) -> Column:
    """Lower case without diacritics; a text of single-byte characters has none and is not looked through."""
    low = F.lower(c)
    return F.when(F.octet_length(low) == F.char_length(low), low).otherwise(F.translate(low, ACCENTED, UNACCENTED))


def tokens(c: Column) -> Column:
    """Search tokens: folded runs of letters, digits and private-use characters."""
    return F.filter(F.split(folded(c), r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")


def undecorated(c: Column) -> Column:
    """One leading list, quote or heading mark removed."""
    return F.regexp_replace(c, r"(?U)^(?:[-*+>] |#+ )\s*", "")


def lines(c: Column) -> Column:
    """Lines without their ends; a final line break opens no further line."""
    return F.split(F.regexp_replace(c, r"\r?\n\z", ""), r"\r?\n")


def coverage(text: Column, query_terms: Column) -> Column:
    """Share of query terms that occur in the text, as substrings, duplicates counted."""
    hit = F.size(F.filter(query_terms, lambda t: F.contains(text, t)))
    return hit / F.greatest(F.size(query_terms), F.lit(1))


def cut_bytes(c: Column, limit: int) -> Column:
    """The longest prefix of whole characters within ``limit`` bytes."""
    raw = F.encode(c, "UTF-8")
    # A cut inside a character leaves 1 to 3 trailing bytes; those are the bytes from the last lead byte on.
    lead = lambda at: F.conv(F.hex(F.substring(raw, at, 1)), 16, 10).cast("int")
    boundary = lambda n: (F.octet_length(c) <= n) | ~lead(n + 1).between(128, 191)
    out = F.lit(limit - 3)
    for n in (limit - 2, limit - 1, limit):
        out = F.when(boundary(n), n).otherwise(out)
    return F.decode(F.substring(raw, F.lit(1), out), "UTF-8")


def snippet(c: Column, limit: int = SNIPPET_BYTES) -> Column:
    t = trimmed(c)
    return F.when(F.octet_length(t) <= limit, t).otherwise(F.concat(cut_bytes(t, limit), F.lit("...")))


def preview(c: Column, limit: int) -> Column:
    """Tested in characters, cut in bytes."""
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(cut_bytes(c, limit), F.lit("...")))


def inline_preview(c: Column) -> Column:
    return F.regexp_replace(trimmed(c), r"(?U)\s+", " ")


def multiline_preview(c: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.split(c, r"\r?\n"), trimmed), lambda x: x != ""), "\n")


def expand_identifier(c: Column) -> Column:
    """The whole term in lower case, then its snake- and camel-case parts, first occurrences only."""
    parts = F.split(F.regexp_replace(trimmed(c), r"(\p{Ll}|[0-9])(\p{Lu})", "$1 $2"), r"[^\p{L}\p{N}]+")
    every = F.concat(F.array(F.lower(trimmed(c))), F.transform(parts, F.lower))
    return F.array_distinct(F.filter(every, lambda x: x != ""))


def channel_label(literal: Column, lexical: Column, vector_score: Column) -> Column:
    label = F.concat(F.when(literal, "r").otherwise(""), F.when(lexical, "f").otherwise(""), F.when(vector_score > 2.220446049250313e-16, "v").otherwise(""))
    return F.when(label == "", "?").otherwise(label)


def line_label(start: Column, end: Column) -> Column:
    return F.when(start == end, start.cast("string")).otherwise(F.concat_ws("-", start.cast("string"), end.cast("string")))


def scrubbed(c: Column, root: str) -> Column:
    return F.replace(c, F.lit(root), F.lit("<VAULT_ROOT>"))


def yes_no(c: Column) -> Column:
    return F.when(c, "yes").otherwise("no")


def quoted_phrase(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))


def in_scope(path: Column, scope: str | None, kind: str = "dir") -> Column:
    """Predicate of a scope: everything, one file, or a directory and what is below it."""
    if not scope:
        return F.lit(True)
    return path == scope if kind == "file" else (path == scope) | path.startswith(scope.rstrip("/") + "/")
