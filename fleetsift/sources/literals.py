"""Small dimension tables written as SQL ``VALUES``.

Catalyst sees a ``LocalRelation`` whose exact size is known, so it broadcasts the
table because the size is proven, not because of a hint.  ``as_sql`` gives the same
rows to another SQL engine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# A dimension above this many rows is data, not a literal.
MAX_LITERAL_ROWS = 20_000


def _cell(value: object, spark: bool) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int | float):
        return repr(value)
    if isinstance(value, list | tuple):
        inner = ", ".join(_cell(v, spark) for v in value)
        return f"array({inner})" if spark else f"[{inner}]"
    text = str(value)
    if spark:
        text = text.replace("\\", "\\\\").replace("'", "\\'")
    else:
        text = text.replace("'", "''")
    return f"'{text}'"


_DUCK_TYPES = {
    "string": "VARCHAR",
    "array<string>": "VARCHAR[]",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


def as_sql(columns: Sequence[tuple[str, str]], rows: Sequence[Sequence[object]], *, spark: bool) -> str:
    """``SELECT`` over ``VALUES`` with every column cast to its declared type."""
    names = ", ".join(f"c{i}" for i in range(len(columns)))
    body = ", ".join("(" + ", ".join(_cell(v, spark) for v in row) + ")" for row in rows)
    picks = ", ".join(
        f"CAST(c{i} AS {kind if spark else _DUCK_TYPES.get(kind, kind)}) AS {name}"
        for i, (name, kind) in enumerate(columns)
    )
    return f"SELECT {picks} FROM (VALUES {body}) AS v({names})"


class Literal:
    """A named literal table usable from both engines."""

    def __init__(self, name: str, columns: str, rows: Sequence[Sequence[object]]) -> None:
        if len(rows) > MAX_LITERAL_ROWS:
            raise ValueError(f"{name}: {len(rows)} rows is above the literal bound {MAX_LITERAL_ROWS}")
        self.name = name
        self.columns = [tuple(c.strip().split(" ", 1)) for c in columns.split(",")]
        self.rows = [tuple(r) for r in rows]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.sql(as_sql(self.columns, self.rows, spark=True))

    def cte(self) -> str:
        """``name AS (SELECT …)`` for the other engine."""
        return f"{self.name} AS ({as_sql(self.columns, self.rows, spark=False)})"
