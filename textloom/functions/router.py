"""Is a query a regular expression or plain text?"""

from __future__ import annotations

import re

STRUCTURAL = set("[](){}|^$\\")


def _translated(pattern: str) -> str | None:
    """None if the pattern has a brace that opens no repetition, which stricter dialects refuse."""
    return None if re.search(r"\{(?!\d+(,\d*)?\})", pattern) else pattern


def is_regex(query: str) -> bool:
    signal = any(c in STRUCTURAL for c in query)
    if not signal and not any(s in query for s in (".*", ".+", ".?")):
        return False
    if "\\" in query:
        return True
    if _translated(query) is None:
        return signal
    try:
        re.compile(query)
    except (re.error, OverflowError, RecursionError):
        return signal
    return any(c in ".^$*+?()[|{" for c in query)  # it compiles and holds no escape, so any of these is an operator


def java_pattern(pattern: str) -> str:
    """The pattern for the JVM: Unicode classes, named groups in its spelling. Lookaround and back-references are refused."""
    if re.search(r"\(\?(<?[=!])|\\[1-9]|\(\?P=", pattern):
        raise ValueError("look-around and back-references are not supported")
    return "(?U)" + pattern.replace("(?P<", "(?<")
