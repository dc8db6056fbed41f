"""Rule conditions as columns: twelve operators, each true, false or NULL on a type mismatch.

A condition is a struct ``(op, kind, b, n, s, l, ln)``: operator, operand kind and the operand in
the slot of its kind.  A value is ``(value_type, v_bool, v_num, v_str, v_list)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

OPERATORS = (
    "equals", "not_equals", "gt", "gte", "lt", "lte", "in", "not_in", "contains", "is_true", "is_false", "non_empty",
)
CONDITION = "struct<op:string,kind:string,b:boolean,n:double,s:string,l:array<string>,ln:array<double>>"


def condition(op: str, operand: object = None) -> Column:
    """Literal condition struct of a Python operand."""
    if isinstance(operand, bool):
        kind = "bool"
    elif isinstance(operand, int | float):
        kind = "num"
    elif isinstance(operand, str):
        kind = "str"
    elif isinstance(operand, list | tuple):
        kind = "numlist" if operand and all(isinstance(x, int | float) for x in operand) else "strlist"
    else:
        kind = "none"
    items = list(operand) if kind in ("strlist", "numlist") else []
    return F.struct(
        F.lit(op).alias("op"),
        F.lit(kind).alias("kind"),
        F.lit(operand if kind == "bool" else None).cast("boolean").alias("b"),
        F.lit(float(operand) if kind == "num" else None).cast("double").alias("n"),
        F.lit(operand if kind == "str" else None).cast("string").alias("s"),
        F.array(*[F.lit(str(x)) for x in items]).cast("array<string>").alias("l"),
        F.array(*[F.lit(float(x)) for x in (items if kind == "numlist" else [])]).cast("array<double>").alias("ln"),
    )


def outcome(c: Column, vt: Column, v_bool: Column, v_num: Column, v_str: Column, v_list: Column) -> Column:
    """Outcome of one condition on one value."""
    kind, op = c["kind"], c["op"]
    equal = (
        F.when((vt == "bool") & (kind == "bool"), v_bool == c["b"])
        .when((vt == "num") & (kind == "num"), v_num == c["n"])
        .when((vt == "str") & (kind == "str"), v_str == c["s"])
        .when((vt == "list") & (kind == "strlist"), v_list == c["l"])
        .when((vt == "list") & (kind == "numlist"), F.lit(False))
    )
    numeric = (vt == "num") & (kind == "num")
    as_num = F.coalesce(v_num, v_bool.cast("int").cast("double"))
    member = F.when(
        kind.isin("strlist", "numlist") & vt.isin("bool", "num", "str"),
        F.when((kind == "strlist") & (vt == "str"), F.array_contains(c["l"], v_str))
        .when((kind == "numlist") & (vt != "str"), F.array_contains(c["ln"], as_num))
        .otherwise(F.lit(False)),
    )
    contains = F.when(vt == "list", F.when(kind == "str", F.array_contains(v_list, c["s"])).otherwise(F.lit(False))).when(
        vt == "str", F.when(kind == "str", v_str.contains(c["s"])).otherwise(F.lit(False))
    )
    return (
        F.when(op == "equals", equal)
        .when(op == "not_equals", ~equal)
        .when(op == "gt", F.when(numeric, v_num > c["n"]))
        .when(op == "gte", F.when(numeric, v_num >= c["n"]))
        .when(op == "lt", F.when(numeric, v_num < c["n"]))
        .when(op == "lte", F.when(numeric, v_num <= c["n"]))
        .when(op == "in", member)
        .when(op == "not_in", ~member)
        .when(op == "contains", contains)
        .when(op == "is_true", F.when(vt == "bool", v_bool))
        .when(op == "is_false", F.when(vt == "bool", ~v_bool))
        .when(op == "non_empty", F.when(vt == "list", F.size(v_list) > 0).when(vt == "str", F.length(v_str) > 0))
    )


def outcomes(conditions: Column, prefix: str = "") -> Column:
    """Outcomes of a condition array on the row's value columns."""
    cols = [F.col(prefix + n) for n in ("value_type", "v_bool", "v_num", "v_str", "v_list")]
    return F.transform(conditions, lambda c: outcome(c, *cols))


def expected_text(c: Column) -> Column:
    """Readable form of a condition struct."""
    plain = lambda n: F.regexp_replace(n.cast("string"), r"\.0$", "")
    shown = (
        F.when(c["kind"] == "num", plain(c["n"]))
        .when(c["kind"] == "str", F.concat(F.lit("'"), c["s"], F.lit("'")))
        .when(c["kind"] == "bool", F.when(c["b"], "True").otherwise("False"))
        .when(c["kind"] == "strlist", F.when(F.size(c["l"]) > 0, F.concat(F.lit("['"), F.array_join(c["l"], "', '"), F.lit("']"))).otherwise("[]"))
        .when(c["kind"] == "numlist", F.concat(F.lit("["), F.array_join(F.transform(c["ln"], plain), ", "), F.lit("]")))
        .otherwise("None")
    )
    return (
        F.when(c["op"] == "is_true", "enabled")
        .when(c["op"] == "is_false", "disabled")
        .when(c["op"] == "non_empty", "at least one value configured")
        .otherwise(F.concat_ws(" ", F.replace(c["op"], F.lit("_"), F.lit(" ")), shown))
    )


def describe(op: str, operand: object = None) -> str:
    """Readable form of one condition, as ``expected_text`` has it."""
    fixed = {"is_true": "enabled", "is_false": "disabled", "non_empty": "at least one value configured"}
    return fixed.get(op) or f"{op.replace('_', ' ')} {operand!r}"


def describe_all(conditions: Sequence[tuple]) -> str:
    return " and ".join(describe(*c) for c in conditions)
