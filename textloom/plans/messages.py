"""What the command line says besides results."""

from __future__ import annotations

from textloom.plans import schemas as S


def command(action: str, root: str, *flags: str) -> str:
    return "`" + " ".join(["textloom index", action, *flags, f'"{root}"']) + "`"


def initialized(root: str, level: str, s: dict) -> str:
    return f"initialized {root} (level={level}) [{s['indexed_files']} indexed / {s['scanned_files']} scanned / {s['chunks_indexed']} chunks]"


def rebuilt(root: str, level: str, s: dict) -> str:
    return f"rebuilt {root} (level={level}) [{s['indexed_files']} indexed / {s['scanned_files']} scanned]"


def deleted(root: str, was: bool) -> str:
    return f"deleted the index of {root}" if was else f"{root} has no index"


def index_required(root: str, chunks: int) -> str:
    """No index covers the root: what building one would take, and the levels that suit its size."""
    out = [f"no index covers {root}", f"    estimated chunks: {chunks}"]
    notes = {"fts": "words and identifiers, quick to build", "fts+vector": "also finds what is worded otherwise, slower"}
    fitting = [level for level in S.LEVELS if chunks <= S.RECOMMENDED_CHUNKS[level]]
    out += [f"    {command('init', root, '--level', level)}  ({notes[level]})" for level in fitting]
    return "\n".join(out if fitting else [*out, f"    {command('init', root)} builds one of words"])


def force_required(root: str, level: str, check: dict) -> str:
    flags = ("--force",) if level == S.LEVELS[0] else ("--level", level, "--force")
    return "\n".join([f"{root} has about {check['estimated_chunks']} chunks", f"    level {level} is meant for {check['recommended']}; more than {check['force_threshold']} need `--force`", f"    if that is intended: {command('init', root, *flags)}"])


def follow_up(root: str, level: str, chunks: int) -> str | None:
    """After building: the richer level, where the index is small enough for it."""
    if level == "fts" and chunks <= S.RECOMMENDED_CHUNKS["fts+vector"]:
        return f"next: {command('rebuild', root, '--level', 'fts+vector')} finds by meaning, too"
    return None


def level_hint(root: str, level: str, chunks: int) -> str | None:
    """In the status: the other level, where the index is small enough for it."""
    other = {"fts": ("upgrade", "fts+vector"), "fts+vector": ("downgrade", "fts")}[level]
    return f"{other[0]}: {command('rebuild', root, '--level', other[1])}" if chunks <= S.RECOMMENDED_CHUNKS[other[1]] else None


def vector_notice(root: str, operation: str) -> str:
    return f"note: {operation} of the vectors of {root} begins; embedding may take a while"


def delete_note(root: str) -> str:
    return f"note: the index can go at any time: {command('delete', root)}"


def overlaps(around: dict[str, list[str]], root: str) -> list[str]:
    """One note an index above or below the root."""
    cost = "both are stored and refreshed, and neither finds more for it"
    above = [f"note: the index of {r} covers this folder, too; {cost}" for r in around["ancestors"] if r != root]
    return above + [f"note: {r} below has an index of its own; {cost}" for r in around["descendants"] if r != root]


def schema_mismatch(root: str) -> str:
    return f"the index of {root} has another schema version\n    {command('rebuild', root)} makes it anew"
