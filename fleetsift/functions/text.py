"""Column functions over configuration text: terminators, lines, hashes, printable ratio."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# The ingestion limits and thresholds.
MAX_FILE_BYTES = 10 * 1024 * 1024
MAX_BATCH_FILES = 500
MIN_PRINTABLE = 0.90

LINE_BREAK = r"\r\n|\r|\n"

# Characters that are not printable: categories C* and Z*, except the ASCII space and
# the five text controls tab, newline, carriage return, form feed and vertical tab.
NOT_PRINTABLE = r"[\p{C}\p{Z}&&[^ \t\n\r\f\x0B]]"
ONLY_SPACE = r"(?U)^\s*$"


def normalise_terminators(text: Column) -> Column:
    return F.regexp_replace(text, LINE_BREAK, "\n")


def split_lines(text: Column) -> Column:
    """Physical lines; a final terminator adds no line, form feed and VT are text."""
    parts = F.split(text, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_hash(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def printable_ratio(text: Column) -> Column:
    kept = F.length(F.regexp_replace(text, NOT_PRINTABLE, ""))
    return F.when(F.length(text) == 0, F.lit(1.0)).otherwise(kept / F.length(text))


def is_blank(text: Column) -> Column:
    return text.rlike(ONLY_SPACE)


def sniff_format(text: Column) -> Column:
    """First non-space character: ``<`` xml, ``{`` or ``[`` json, anything else cli."""
    head = F.regexp_extract(text, r"(?U)^\s*(\S)", 1)
    return F.when(head == "<", "xml").when(head.isin("{", "["), "json").otherwise("cli")


def json_parses(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def bom_encoding(content: Column) -> Column:
    """Encoding named by the byte-order mark, NULL when there is none."""
    head = F.hex(F.substring(content, 1, 4))
    return (
        F.when(head == "0000FEFF", "utf-32-be")
        .when(head == "FFFE0000", "utf-32-le")
        .when(head.startswith("EFBBBF"), "utf-8-sig")
        .when(head.startswith("FFFE"), "utf-16-le")
        .when(head.startswith("FEFF"), "utf-16-be")
    )


def py_strip(text: Column) -> Column:
    """Trim Unicode white space on both sides."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """White-space separated tokens; an empty array for a blank line."""
    stripped = py_strip(text)
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(
        F.split(stripped, r"(?U)\s+", -1)
    )


# Back references and named groups keep their own regex: joining would renumber their groups.
_OWN_GROUPS = re.compile(r"\\[1-9]|\\k<|\(\?P?<[A-Za-z]")


def _anchored(pattern: str) -> bool:
    """Starts at the line start in every branch: a leading ``^`` and no ``|`` outside a group."""
    bare = re.sub(r"\\.|\[[^\]]*\]", "", pattern)
    while (inner := re.sub(r"\([^()]*\)", "", bare)) != bare:
        bare = inner
    return bare.startswith("^") and "|" not in bare


def matches_any(text: Column, patterns: Sequence[str], prefix: str = "") -> Column:
    """True when any pattern is found, tested with one joined regex where that is safe.

    Patterns that are anchored are joined behind one ``^``, so the search gives up at once on
    every position but the first.
    """
    groups: dict[str, list[str]] = {}
    for p in dict.fromkeys(patterns):
        own = bool(_OWN_GROUPS.search(p))
        groups.setdefault(p if own else ("^" if prefix or _anchored(p) else ""), []).append(p)
    found = F.lit(False)
    for key, members in groups.items():
        start = "^" if key == "^" else prefix
        found = found | text.rlike(f"{start}(?:{'|'.join(f'(?:{p})' for p in members)})")
    return found
