"""Logs of JSON lines as a data source: ``spark.read.format("answer_log").schema(...).load(path)``.

Reading: a partition is a file's byte range of ``part_bytes``, of which it reads the lines that begin in
it, so one huge file is read by many tasks.  Filters that compare a column of text, whole numbers or
truth values with a literal are applied while lines are read; Spark applies the others.

What can't be read doesn't stop the rest.  If the schema has a column ``_bad``, a file that can't be
opened and a line that isn't an object of the schema's types are rows of nulls with their file,
place and fault there; without that column they are left out.

Writing: each task writes files under a hidden folder, which no reader lists, and tells their names; the
commit moves them beside the others, and an abort deletes them.  A task that runs again leaves
the first attempt's files behind there, uncommitted, and the commit removes the folder.  ``overwrite`` deletes what was
there after the new files are in place.

Paths are those of file systems that Arrow knows: a plain path, or a URI.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructType

NAME = "answer_log"
PART_BYTES = 32 << 20
BATCH = 4096  # rows of one Arrow batch
BAD = "_bad"
_PUSHED = (StringType, LongType, IntegerType, BooleanType)


def _file_system(path: str):
    from pyarrow.fs import FileSystem, LocalFileSystem

    return FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (LocalFileSystem(), path)


def _files(path: str) -> list:
    from pyarrow.fs import FileSelector, FileType

    fs, at = _file_system(path)
    info = fs.get_file_info(at)
    if info.type == FileType.NotFound:
        return []
    if info.type == FileType.File:
        return [info]
    found = fs.get_file_info(FileSelector(at))
    return sorted((f for f in found if f.type == FileType.File and f.base_name[:1] not in "._"), key=lambda f: f.path)


@dataclass
class Range(ds.InputPartition):
    """Bytes of a file."""

    path: str
    start: int
    end: int


def holds(test: ds.Filter, row: dict) -> bool:
    """Whether a pushed filter holds; a comparison with null doesn't."""
    if isinstance(test, ds.Not):
        inner = test.child
        return _value(inner, row) is not None and not holds(inner, row)
    x = _value(test, row)
    if isinstance(test, ds.IsNull):
        return x is None
    if x is None:
        return False
    compare = {
        ds.IsNotNull: lambda: True, ds.EqualTo: lambda: x == test.value, ds.In: lambda: x in test.value, ds.GreaterThan: lambda: x > test.value,
        ds.GreaterThanOrEqual: lambda: x >= test.value, ds.LessThan: lambda: x < test.value, ds.LessThanOrEqual: lambda: x <= test.value,
        ds.StringStartsWith: lambda: x.startswith(test.value), ds.StringEndsWith: lambda: x.endswith(test.value), ds.StringContains: lambda: test.value in x,
    }
    return compare[type(test)]()


def _value(test: ds.Filter, row: dict):
    return row.get(test.attribute[0])


_KNOWN = (ds.IsNull, ds.IsNotNull, ds.EqualTo, ds.In, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual, ds.StringStartsWith, ds.StringEndsWith, ds.StringContains)


class LogReader(ds.DataSourceReader):
    def __init__(self, schema: StructType, path: str, part_bytes: int):
        self.schema, self.path, self.part_bytes, self.tests = schema, path, part_bytes, []
        self.kinds = {f.name: f.dataType for f in schema}

    def _mine(self, test: ds.Filter) -> bool:
        inner = test.child if isinstance(test, ds.Not) else test
        if not isinstance(inner, _KNOWN) or len(inner.attribute) != 1 or inner.attribute[0] == BAD:
            return False
        # Code points, as Python orders text, and bytes of UTF-8, as Spark does, have one order.
        return isinstance(self.kinds.get(inner.attribute[0]), _PUSHED) and not (isinstance(test, ds.Not) and isinstance(inner, ds.IsNull))

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for test in filters:
            if self._mine(test):
                self.tests.append(test)
            else:
                yield test

    def partitions(self) -> list[Range]:
        out = []
        for f in _files(self.path):
            size = f.size or 0
            out += [Range(f.path, at, min(size, at + self.part_bytes)) for at in range(0, max(size, 1), self.part_bytes)]
        return out or [Range("", 0, 0)]

    def lines(self, part: Range) -> Iterator[tuple[int, bytes]]:
        """(place, line) of the lines that begin in the range."""
        if not part.path:
            return
        fs, _ = _file_system(self.path)
        with fs.open_input_file(part.path) as f:
            at = max(part.start - 1, 0)
            f.seek(at)
            held, skip = b"", part.start > 0  # the line that begins before is another's, up to the line feed before the range or in it
            while True:
                data = f.read(1 << 20)
                rows = (held + data).split(b"\n")
                held = rows.pop() if data else b""
                for row in rows:
                    if not skip and row.strip():
                        yield at, row
                    skip = False
                    at += len(row) + 1
                    if at >= part.end:
                        return
                if not data:
                    return

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(self.schema)
        names, with_bad = [f for f in self.kinds if f != BAD], BAD in self.kinds
        fault = lambda at, e: {BAD: f"{part.path}:{at}: {type(e).__name__}"}

        def made(rows: list[tuple[int, dict]]) -> Iterator[pa.RecordBatch]:
            if not rows:
                return
            try:
                yield pa.RecordBatch.from_pylist([r for _, r in rows], schema=arrow)
            except (pa.ArrowInvalid, pa.ArrowTypeError, TypeError, ValueError, OverflowError) as e:
                if len(rows) > 1:  # find the line that isn't of the schema's types
                    half = len(rows) // 2
                    yield from made(rows[:half])
                    yield from made(rows[half:])
                elif with_bad:
                    yield pa.RecordBatch.from_pylist([fault(rows[0][0], e)], schema=arrow)

        rows: list[tuple[int, dict]] = []
        try:
            for at, line in self.lines(part):
                try:
                    found = json.loads(line)
                    row = {k: found.get(k) for k in names}
                    if not all(holds(t, row) for t in self.tests):
                        continue
                except (ValueError, AttributeError, TypeError) as e:
                    if not with_bad:
                        continue
                    row = fault(at, e)
                rows.append((at, row))
                if len(rows) >= BATCH:
                    yield from made(rows)
                    rows = []
        except OSError as e:
            if with_bad:
                rows.append((0, fault(part.start, e)))
        yield from made(rows)


@dataclass
class Written(ds.WriterCommitMessage):
    files: list[str]


class LogWriter(ds.DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def _staged(self, at: str) -> str:
        return f"{at.rstrip('/')}/.staged-{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, at = _file_system(self.path)
        name = f"{uuid.uuid4().hex}.jsonl"
        out, n = None, 0
        for batch in iterator:
            if out is None:
                fs.create_dir(self._staged(at), recursive=True)
                out = fs.open_output_stream(f"{self._staged(at)}/{name}")
            out.write("".join(json.dumps(r, default=str, ensure_ascii=False) + "\n" for r in batch.to_pylist()).encode())
            n += batch.num_rows
        if out is not None:
            out.close()
        return Written([name] if n else [])

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = _file_system(self.path)
        fs.create_dir(at, recursive=True)
        before = _files(self.path) if self.overwrite else []
        for message in messages:
            for name in message.files if message else ():
                fs.move(f"{self._staged(at)}/{name}", f"{at.rstrip('/')}/{name}")
        for f in before:
            fs.delete_file(f.path)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow.fs import FileType

        fs, at = _file_system(self.path)
        if fs.get_file_info(self._staged(at)).type == FileType.Directory:
            fs.delete_dir(self._staged(at))


class AnswerLog(ds.DataSource):
    """The data source; see the module."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def reader(self, schema: StructType) -> LogReader:
        return LogReader(schema, self.options["path"], int(self.options.get("part_bytes", PART_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> LogWriter:
        return LogWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, and let Spark offer it filters."""
    spark.dataSource.register(AnswerLog)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
