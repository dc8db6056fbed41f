"""Files of records: plain ``key: value`` lines, maps one level in, and lists of such maps.

    split: eval                     # a value of the head
    provenance:                     # a section of one map
      labelled_by: someone
    fields:                         # a section of several maps
      - field: ssh_version
        expected_value: ["a", "b"]  # a list, in brackets or with a dash a line
        rationale: >-
          folded text

Files are read by Spark's own text source, a row each, so that any file system and any number of files will do.  A file is bounded by the size
gate; its lines are told apart in its own row and nothing shuffles.  Deeper nesting, anchors and tags are not records: the file is refused.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A value: its kind (``null``, ``bool``, ``int``, ``str`` or ``list``), its text (list elements joined by commas) and the elements of a list.
VALUE = "struct<kind:string,text:string,items:array<string>>"
RECORDS = f"struct<head:map<string,{VALUE}>,sections:map<string,array<map<string,{VALUE}>>>,problem:string>"
#: Characters of text whose records are held at once.
SLICE = 1 << 20

_KEY = re.compile(r"([A-Za-z_][\w.-]*):(?:\s+(.*))?$")
_COMMENT = re.compile(r"(?:^|\s)#.*$")
_QUOTED = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*')\s*(?:#.*)?$""")
_ELEMENT = re.compile(r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,"'\s][^,]*)\s*(?:,|$)""")
_TEXT_BLOCK = re.compile(r"([>|])[+-]?\s*(?:#.*)?$")


def _bare(quoted: str) -> str:
    return json.loads(quoted, strict=False) if quoted[0] == '"' else quoted[1:-1].replace("''", "'")


def _scalar(text: str) -> dict:
    """The value that stands behind a key or a dash; ValueError if it is none."""
    if quoted := _QUOTED.match(text):
        return {"kind": "str", "text": _bare(quoted[1]), "items": None}
    text = _COMMENT.sub("", text).strip()
    if text.startswith("["):
        if not text.endswith("]"):
            raise ValueError("open list")
        items, at, inner = [], 0, text[1:-1].strip()
        while at < len(inner):
            if not (found := _ELEMENT.match(inner, at)):
                raise ValueError("bad list")
            items.append(_bare(found[1]) if found[1][0] in "\"'" else found[1].strip())
            at = found.end()
        return {"kind": "list", "text": ",".join(items), "items": items}
    if text[:1] in "{&*!@`" and text:
        raise ValueError("no record")
    if text in ("", "~", "null"):
        return {"kind": "null", "text": None, "items": None}
    if text in ("true", "false"):
        return {"kind": "bool", "text": text, "items": None}
    return {"kind": "int" if re.fullmatch(r"[+-]?\d+", text) else "str", "text": str(int(text)) if re.fullmatch(r"[+-]?\d{1,18}", text) else text, "items": None}


class _Reader:
    """One pass over the lines of a file."""

    def __init__(self) -> None:
        self.head: dict[str, dict] = {}
        self.sections: dict[str, list[dict[str, dict]]] = {}
        self.section: str | None = None
        self.dash: int | None = None  # how far the dashes of the section stand in
        self.column: int | None = None  # how far the keys of the map stand in
        self.value: dict | None = None  # the value that later lines may continue
        self.indent = 0  # how far its key stands in
        self.joiner: str | None = None  # set while a text block is open

    def _continue(self, bare: str, indent: int) -> bool:
        """Whether the line belongs to the value before it."""
        v = self.value
        if v is None or indent <= self.indent:
            return False
        if self.joiner is not None:
            v["text"] = bare if v["text"] is None else v["text"] + self.joiner + bare
        elif bare.startswith("- ") and v["kind"] in ("null", "list") and (v["kind"] == "null" or v["items"] is not None):
            items = (v["items"] or []) + [_scalar(bare[2:].strip())["text"]]
            v.update(kind="list", items=items, text=",".join(x or "" for x in items))
        elif v["kind"] == "null" and not _KEY.match(bare):
            v.update(_scalar(bare))
        elif v["kind"] in ("str", "int", "bool") and not bare.startswith("- "):
            v.update(kind="str", text=f"{v['text']} {bare}")
        else:
            return False
        return True

    def line(self, line: str) -> None:
        bare, indent = line.strip(), len(line) - len(line.lstrip(" "))
        if not bare or (bare.startswith("#") and self.joiner is None) or self._continue(bare, indent):
            return
        if bare.startswith("#"):
            return
        self.value = self.joiner = None
        if indent == 0 and not bare.startswith("-"):
            self._key(bare, 0, self.head)
            return
        if self.section is None:
            raise ValueError("outside any section")
        maps = self.sections[self.section]
        if bare.startswith("- "):
            if self.dash is not None and indent != self.dash:
                raise ValueError("dash out of line")
            self.dash = indent
            maps.append({})
            bare = bare[2:]
            indent += 2 + len(bare) - len(bare.lstrip(" "))
            bare, self.column = bare.strip(), indent
            if not _KEY.match(bare):
                maps[-1][""] = self.value = _scalar(bare)
                self.indent = indent
                return
        elif not maps:
            maps.append({})
            self.column = indent
        elif indent != self.column:
            raise ValueError("key out of line")
        self._key(bare, indent, maps[-1])

    def _key(self, bare: str, indent: int, into: dict[str, dict]) -> None:
        if not (found := _KEY.match(bare)):
            raise ValueError("no key")
        name, rest = found[1], (found[2] or "").strip()
        if name in into or (into is self.head and name in self.sections):
            raise ValueError("repeated key")
        if into is self.head:
            self.section = self.dash = None
            if not _COMMENT.sub("", rest).strip():
                self.section, self.sections[name] = name, []
                return
        block = _TEXT_BLOCK.fullmatch(rest)
        self.joiner = (" " if block[1] == ">" else "\n") if block else None
        self.value = {"kind": "str", "text": None, "items": None} if block else _scalar(rest)
        self.indent, into[name] = indent, self.value


def parse(text: str | None) -> dict:
    """``head``, ``sections`` and, if the file is no file of records, ``problem`` with the number of the line that is none."""
    reader = _Reader()
    for number, line in enumerate(re.split(r"\r\n|\r|\n", text or ""), 1):
        try:
            reader.line(line)
        except ValueError:
            return {"head": {}, "sections": {}, "problem": f"unreadable_line_{number}"}
    return {"head": reader.head, "sections": reader.sections, "problem": None}


def slices(texts: list[str | None], size: int = SLICE) -> Iterator[list[str | None]]:
    """``texts`` in order, cut wherever more than ``size`` characters have come together."""
    begun = held = 0
    for i, text in enumerate(texts, 1):
        held += len(text or "")
        if held > size or i == len(texts):
            yield texts[begun:i]
            begun, held = i, 0


def records(text: Column) -> Column:
    """The records of a file; a null text is an empty file.

    Told apart, a file takes many times its size, so a worker holds the records of ``SLICE`` characters of text, or of one file, and not of a batch.
    """

    @F.pandas_udf(RECORDS)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            for some in slices(texts.tolist()):
                yield pd.DataFrame([parse(t) for t in some], columns=["head", "sections", "problem"])

    return read(text)


def read_files(spark: SparkSession, path: str, glob: str = "*.yaml") -> DataFrame:
    """One row for each file below ``path``: file, text."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return reader.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def text_of(of: Column, key: str) -> Column:
    """The text of a value by its key, NULL where there is none."""
    return F.try_element_at(of, F.lit(key))["text"]
