"""Markdown blocks as a table function of SQL.

    SELECT d.doc_id, b.kind FROM docs d, LATERAL markdown_blocks(d.body) b
    SELECT * FROM markdown_blocks(TABLE(lines) PARTITION BY doc_id ORDER BY line_no)

Given a text it returns the text's blocks.  Given a table it reads lines: of the columns line_no and line
the blocks of each partition are made, and its other columns, of whatever names and types, come out in
front, as they are in the partition's first row.  The blocks are those of ``segment.blocks_of``, which is the faster way where a
DataFrame will do: this one runs in Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

NAME = "markdown_blocks"
_BREAK = re.compile("\r\n|[\n\x0b\x0c\r\x85\u2028\u2029]")
_SEPARATOR = re.compile("[-: ]+")
_BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_CELLS = ArrayType(StringType())
BLOCK = StructType().add("block", IntegerType()).add("kind", StringType()).add("level", IntegerType()).add("text", StringType()).add("items", _CELLS).add("header", _CELLS).add("rows", ArrayType(_CELLS))


def kind_of(line: str) -> str:
    bare = line.rstrip(" ")
    if not line.strip(_BLANKS):
        return "blank"
    for mark, kind in (("### ", "h3"), ("## ", "h2"), ("# ", "title")):
        if bare.startswith(mark):
            return kind
    bare = line.lstrip(" ")
    return "table" if bare.startswith("|") else "bullets" if bare.startswith("- ") else "para"


class Run:
    """Lines of one block, read one by one."""

    def __init__(self) -> None:
        self.block, self.kind, self.lines = 0, "", []

    def add(self, line: str) -> Iterator[tuple]:
        """The block that the line ends, if any."""
        kind = kind_of(line)
        if kind not in ("table", "bullets") or kind != self.kind:
            yield from self.done()
            self.block, self.kind, self.lines = self.block + 1, kind, []
        self.lines.append(line)

    def done(self) -> Iterator[tuple]:
        kind, lines = self.kind, self.lines
        self.kind, self.lines = "", []
        strip = lambda x: x.strip(_BLANKS)
        if kind in ("h2", "h3"):
            yield self.block, "heading", int(kind[1]), strip(lines[0][int(kind[1]) + 1 :]), None, None, None
        elif kind == "para":
            yield self.block, kind, None, strip(lines[0]), None, None, None
        elif kind == "bullets":
            yield self.block, kind, None, None, [strip(x.lstrip(" ")[2:]) for x in lines], None, None
        elif kind == "table":
            cells = [[strip(c) for c in strip(x).strip("|").split("|")] for x in lines]
            rows = [r for r in cells if not all(_SEPARATOR.fullmatch(c) for c in r)]
            if rows:
                yield self.block, kind, None, None, None, rows[0], rows[1:]


class MarkdownBlocks:
    """The table function; see the module."""

    @staticmethod
    def analyze(source: AnalyzeArgument) -> AnalyzeResult:
        if not source.isTable:
            if not isinstance(source.dataType, StringType):
                raise ValueError(f"{NAME} wants a text or a table, not {source.dataType.simpleString()}")
            return AnalyzeResult(BLOCK)
        names = [f.name for f in source.dataType.fields]
        if "line" not in names or "line_no" not in names:
            raise ValueError(f"{NAME} wants the columns line_no and line; there are {', '.join(names)}")
        kept = [f for f in source.dataType.fields if f.name not in ("line", "line_no")]
        return AnalyzeResult(StructType(kept + BLOCK.fields))

    def __init__(self) -> None:
        self.run, self.front = Run(), None

    def eval(self, source: Row | str | None) -> Iterator[tuple]:
        if source is None or isinstance(source, str):
            run = Run()
            for line in _BREAK.split(source) if source is not None else ():
                yield from run.add(line)
            yield from run.done()
            return
        if self.front is None:
            self.front = tuple(v for k, v in source.asDict().items() if k not in ("line", "line_no"))
        yield from ((*self.front, *b) for b in self.run.add(source["line"] or ""))

    def terminate(self) -> Iterator[tuple]:
        if self.front is not None:
            yield from ((*self.front, *b) for b in self.run.done())


def register(spark: SparkSession) -> None:
    """Make the function known to the session's SQL."""
    spark.udtf.register(NAME, udtf(MarkdownBlocks))
