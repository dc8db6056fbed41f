"""Configuration trees: indent, brace and flat syntax to one node table.

A file is bounded by the ingestion size gate, so its tree is built inside its own row by a
small Arrow function; nothing is shuffled and parallelism is across files.  Each node carries
its ancestors' texts and line numbers, which turns parent and descendant lookups into array
reads instead of self-joins.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fleetsift.functions import text as tx
from fleetsift.sources import packs

NODE = (
    "struct<line_number:int,raw_line:string,placed:boolean,reason:string,text:string,depth:int,"
    "parent_line:int,block_path:array<string>,path_lines:array<int>>"
)
_NODE_TYPES = [
    ("line_number", pa.int32()), ("raw_line", pa.string()), ("placed", pa.bool_()), ("reason", pa.string()), ("text", pa.string()),
    ("depth", pa.int32()), ("parent_line", pa.int32()), ("block_path", pa.list_(pa.string())), ("path_lines", pa.list_(pa.int32())),
]
#: What a line classifier says of a line: why it is no node, or its text and how far in it stands.
Verdict = tuple[str | None, str, int]


def classify_indent(lines: list[str], marks: tuple[str, ...], openers: list[tuple[re.Pattern, int]]) -> list[Verdict]:
    """Indentation is the depth; a literal block runs to the line that its opener names, or swallows the rest of the file."""
    found: list[Verdict] = []
    while len(found) < len(lines):
        raw = lines[len(found)]
        text = raw.strip()
        if not text:
            found.append(("blank line", "", 0))
        elif marks and text.startswith(marks):
            found.append(("comment", "", 0))
        else:
            found.append((None, text, len(raw) - len(raw.lstrip())))
            stop = next((m.group(g) for rx, g in openers if (m := rx.match(text))), None)
            if stop is not None:
                end = next((i for i in range(len(found), len(lines)) if lines[i].strip() == stop), None)
                inside = len(lines) - len(found) if end is None else end + 1 - len(found)
                found += [("unterminated literal block" if end is None else "literal block body", "", 0)] * inside
    return found


def classify_brace(lines: list[str], marks: tuple[str, ...], openers: list) -> list[Verdict]:
    """Open blocks are the depth; a line that opens one counts itself out."""
    found: list[Verdict] = []
    depth, commented = 0, False
    for raw in lines:
        line = raw.strip()
        if commented or line.startswith("/*"):
            commented = "*/" not in (line if commented else line[2:])
            found.append(("block comment", "", 0))
        elif marks and line.startswith(marks):
            found.append(("comment", "", 0))
        elif line in ("}", "};"):
            found.append(("block terminator" if depth else "unmatched closing brace", "", 0))
            depth = max(0, depth - 1)
        else:
            text = re.sub(r"\s*[{;]$", "", line.partition("##")[0].rstrip())
            found.append((None, text, depth) if text else ("blank line", "", 0))
            depth += bool(text) and line.endswith("{")
    return found


def classify_flat(lines: list[str], marks: tuple[str, ...], openers: list) -> list[Verdict]:
    """Every line that says something is a root."""
    texts = [raw.strip() for raw in lines]
    return [("blank line", "", 0) if not t else ("comment", "", 0) if marks and t.startswith(marks) else (None, t, 0) for t in texts]


CLASSIFIERS = {"indent": classify_indent, "brace": classify_brace, "set_path": classify_flat}


def stack_walk(lines: list[str], verdicts: list[Verdict]) -> Iterator[tuple]:
    """Node rows of a file: a line hangs from the nearest line above it that stands less far in."""
    texts: list[str] = []
    numbers: list[int] = []
    places: list[int] = []
    for number, (raw, (reason, text, place)) in enumerate(zip(lines, verdicts, strict=True), 1):
        if reason is not None:
            yield number, raw, False, reason, None, None, None, None, None
            continue
        keep = bisect_left(places, place)  # places rise along the stack
        del texts[keep:], numbers[keep:], places[keep:]
        yield number, raw, True, None, text, keep, numbers[-1] if numbers else None, texts.copy(), numbers.copy()
        texts.append(text)
        numbers.append(number)
        places.append(place)


def walk_files(files: DataFrame, keys: list[str]) -> DataFrame:
    """One row per file: ``keys``, ``os_family`` and ``nodes``, an array with every source line exactly once, placed in the tree or with the reason why not.

    ``files`` needs ``keys``, ``os_family``, ``syntax_mode`` and ``lines``; an unknown mode is read as indented.
    """
    marks = {k: tuple(v) for k, v in packs.COMMENT_PREFIXES.items()}
    literals = packs.LITERAL_BLOCKS
    carried = list(dict.fromkeys([*keys, "os_family"]))
    wide = files.select(*carried, "syntax_mode", "lines")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wide.select(*carried).schema.fields) + f", nodes array<{NODE}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        openers = {k: [(re.compile(p), g) for p, g in v] for k, v in literals.items()}
        for batch in batches:
            families, modes = batch.column("os_family").to_pylist(), batch.column("syntax_mode").to_pylist()
            rows, ends, begun = [], [0], 0
            for i, (family, mode, lines) in enumerate(zip(families, modes, batch.column("lines"), strict=True)):
                said = lines.as_py()
                rows.extend(stack_walk(said, CLASSIFIERS.get(mode, classify_indent)(said, marks.get(family, ()), openers.get(family, []))))
                ends.append(len(rows))
                # Keep the emitted batch bounded whatever the batch of files holds.
                if len(rows) > 100_000 or i == batch.num_rows - 1:
                    columns = zip(*rows, strict=True) if rows else [()] * len(_NODE_TYPES)
                    made = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _NODE_TYPES, strict=True)], names=[n for n, _ in _NODE_TYPES])
                    kept = [batch.column(c).slice(begun, i + 1 - begun) for c in carried]
                    yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made)], names=[*carried, "nodes"])
                    rows, ends, begun = [], [0], i + 1

    return wide.mapInArrow(run, schema)


def build_tree(files: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes and unplaced lines of every file, a row each."""
    return walk_files(files, keys).select(*keys, *(["os_family"] if "os_family" not in keys else []), F.inline("nodes"))


def flat_nodes(files: DataFrame, keys: list[str]) -> DataFrame:
    """Set-path syntax without Python: every line that is neither blank nor comment is a root."""
    lines = files.select(*keys, "os_family", F.posexplode_outer("lines").alias("p", "raw_line")).where(F.col("p").isNotNull())
    reason = line_reason(F.col("raw_line"), F.col("os_family"))
    return lines.select(
        *keys,
        "os_family",
        (F.col("p") + 1).alias("line_number"),
        "raw_line",
        reason.isNull().alias("placed"),
        reason.alias("reason"),
        F.when(reason.isNull(), tx.py_strip(F.col("raw_line"))).alias("text"),
    )


def line_reason(raw: Column, os_family: Column) -> Column:
    """``blank line`` or ``comment`` by the platform's prefixes, else NULL."""
    marks = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*[F.lit(v) for v in x]).cast("array<string>") for kv in packs.COMMENT_PREFIXES.items() for x in kv])
    stripped = tx.py_strip(raw)
    is_comment = F.exists(F.coalesce(F.try_element_at(marks, os_family), F.array().cast("array<string>")), lambda m: stripped.startswith(m))
    return F.when(stripped == "", "blank line").when(is_comment, "comment")


def tree_errors(tree: DataFrame, keys: list[str]) -> DataFrame:
    """Files whose literal block never ends, with the first line of the open block."""
    return (
        tree.where(F.col("reason") == "unterminated literal block")
        .groupBy(*keys)
        .agg(F.min("line_number").alias("opened_after"), F.count("*").alias("lines_swallowed"))
    )


def totality(tree: DataFrame, keys: list[str]) -> DataFrame:
    """Every source line exactly once: counts per file and whether they agree."""
    return (
        tree.groupBy(*keys)
        .agg(
            F.count("*").alias("rows_out"),
            F.countDistinct("line_number").alias("distinct_lines"),
            F.max("line_number").cast("bigint").alias("last_line"),
            F.count_if("placed").alias("nodes"),
        )
        .withColumn(
            "total", (F.col("rows_out") == F.col("distinct_lines")) & (F.col("rows_out") == F.col("last_line"))
        )
    )


def reconstruct(tree: DataFrame, keys: list[str]) -> DataFrame:
    """Whole text of each file back from its rows, joined by newlines."""
    parts = F.array_sort(F.collect_list(F.struct("line_number", "raw_line")))
    return tree.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["raw_line"]), "\n").alias("rebuilt"))


def in_block(prefix: list[str]) -> Column:
    """Nodes whose path starts with the given headers."""
    want = F.array(*[F.lit(p) for p in prefix])
    return F.slice("block_path", 1, len(prefix)) == want
