"""Tri-state logic.  Two different conjunctions exist and must not be mixed.

``all_true`` is SQL AND (false beats NULL beats true) and is used for access-list
coverage.  ``strict_all`` gives NULL as soon as one part is NULL, even beside a
false one, and is used for rule conditions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F


def all_true(*parts: Column) -> Column:
    return reduce(lambda a, b: a & b, parts)


def strict_all(outcomes: Column) -> Column:
    """Outcome of an array of nullable booleans: any NULL gives NULL."""
    return F.transform(
        F.array(outcomes),
        lambda all_: F.when(F.exists(all_, lambda o: o.isNull()), F.lit(None).cast("boolean")).otherwise(F.forall(all_, lambda o: o)),
    )[0]


def rate(part: Column, whole: Column) -> Column:
    """A share that is NULL, never zero, when the population is empty."""
    return F.when(whole != 0, part / whole)
