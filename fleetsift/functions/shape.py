"""Token shapes, line signatures, and patterns generalised from a confirmed line."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fleetsift.functions.netaddr import let
from fleetsift.functions.text import tokens

# Shape tests in order, and the token limit.
SHAPES = [
    ("<IP>", r"^\d{1,3}(?:\.\d{1,3}){3}(?:/\d{1,2})?$"),
    ("<IP>", r"^[0-9a-fA-F]{0,4}(?::[0-9a-fA-F]{0,4}){2,}(?:/\d{1,3})?$"),
    ("<VER>", r"^\d+\.\d+$"),
    ("<VER>", r"^[vV]\d+(?:\.\d+)*$"),
    ("<N>", r"^\d+$"),
    ("<STR>", r"""^".*"$|^'.*'$"""),
    ("<IF>", r"^[A-Za-z][A-Za-z-]*\d[\d/.:]*$"),
]
MAX_TOKENS = 24
ESCAPED = r"([()\[\]{}?*+\-|^$\\.&~#])"
UNSAFE = [r"\.\*", r"\.\+", r"\([^)]*[*+][^)]*\)\s*[*+]"]


def token_shape(token: Column) -> Column:
    out = token
    for name, pattern in reversed(SHAPES):
        out = F.when(token.rlike(pattern), name).otherwise(out)
    return out


def signature(line: Column) -> Column:
    def build(ts: Column) -> Column:
        shaped = F.array_join(F.transform(F.slice(ts, 1, MAX_TOKENS), token_shape), " ")
        return F.when(F.size(ts) > MAX_TOKENS, F.concat(shaped, F.lit(" ..."))).otherwise(shaped)

    return let(tokens(line), build)


def is_generic(sig: Column) -> Column:
    return F.forall(F.split(sig, " "), lambda t: (t == "") | (t == "...") | t.rlike("^<.*>$"))


def cluster_id(sig: Column) -> Column:
    return F.left(F.sha2(F.encode(sig, "UTF-8"), 256), F.lit(16))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, r"\\$1")


def build_regex(line: Column, value_token: Column) -> Column:
    """Anchored pattern with one captured token (0-based), or NULL when the line is refused."""

    def build(ts: Column) -> Column:
        parts = F.transform(ts, lambda t, i: F.when(i == value_token, F.lit(r"(\S+)")).otherwise(escape(t)))
        whole = F.concat(F.lit("^"), F.array_join(parts, r"\s+"), F.lit("$"))
        ok = (F.size(ts) > 0) & (F.size(ts) <= MAX_TOKENS)
        picked = value_token.isNull() | ((value_token >= 0) & (value_token < F.size(ts)) & (F.size(ts) > 1))
        return F.when(ok & picked, whole)

    return let(tokens(line), build)


def build_scope(block_path: Column, generalise: bool) -> Column:
    def one(header: Column) -> Column:
        text = escape(header)
        return F.concat(F.lit("^"), F.regexp_replace(text, r"\d+", r"\\d+") if generalise else text, F.lit("$"))

    return F.transform(block_path, one)


def pattern_refusal(pattern: Column, line: Column) -> Column:
    """Why a pattern may not enter a pack, NULL when it may.  Patterns are compiled by Spark,
    so call this only on patterns that are known to compile."""
    unsafe = F.lit(False)
    for construct in UNSAFE:
        unsafe = unsafe | pattern.rlike(construct)
    return (
        F.when(~pattern.startswith("^"), "not_anchored").when(unsafe, "unsafe_construct").when(~F.regexp(line, pattern), "does_not_match_own_line")
    )
