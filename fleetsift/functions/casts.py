"""Casts of captured text.  Every cast gives NULL for a value it cannot read."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fleetsift.functions.netaddr import cidr_text
from fleetsift.functions.text import py_strip, tokens

# The boolean tokens.
TRUE_TOKENS = ("true", "yes", "on", "enable", "enabled", "1")
FALSE_TOKENS = ("false", "no", "off", "disable", "disabled", "0")


def cast_int(raw: Column) -> Column:
    """Whole numbers only; underscores between digits are accepted, as in int()."""
    body = py_strip(raw)
    plain = F.when(body.rlike(r"^[+-]?\d+(_\d+)*$"), F.regexp_replace(body, "_", ""))
    return plain.try_cast("bigint")


def cast_bool(raw: Column) -> Column:
    token = F.lower(py_strip(raw))
    return F.when(token.isin(*TRUE_TOKENS), F.lit(True)).when(token.isin(*FALSE_TOKENS), F.lit(False))


def cast_str(raw: Column) -> Column:
    return py_strip(raw)


def cast_cidr(raw: Column) -> Column:
    return cidr_text(py_strip(raw))


def cast_duration(raw: Column) -> Column:
    """``<seconds>`` or ``<minutes> <seconds>`` as seconds; negative totals are refused."""
    parts = tokens(raw)
    total = F.when(F.size(parts) == 1, cast_int(parts[0])).when(
        F.size(parts) == 2, cast_int(parts[0]) * 60 + cast_int(parts[1])
    )
    return F.when(total >= 0, total)


def cast_duration_minutes(raw: Column) -> Column:
    minutes = cast_int(raw)
    return F.when(minutes >= 0, minutes * 60)


# cast name -> (typed column it fills, function)
CASTS = {
    "int": ("v_long", cast_int),
    "bool": ("v_bool", cast_bool),
    "str": ("v_str", cast_str),
    "list": ("v_str", cast_str),
    "cidr": ("v_str", cast_cidr),
    "duration": ("v_long", cast_duration),
    "duration_minutes": ("v_long", cast_duration_minutes),
}
