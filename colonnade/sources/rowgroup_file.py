"""Row-group files: a Python data source that reads and writes the binary columnar interchange format.

A file is a 64-byte header, the schema, row groups of up to 2048 rows, a directory of 20 bytes a group, and four bytes of magic.
Reading deals neighbouring groups of a file to input partitions of about PARTITION_BYTES, so a large file is read by many tasks and
small groups share one; a task holds one group at a time. Comparisons that Spark pushes down are applied to a group's columns
before its rows leave the reader. Writing gives one file a task under a temporary name, to which groups go as they fill up; it is renamed
at commit and deleted at abort.

Options: columns, a JSON list of names, the only ones that are decoded; rowGroups, comma-separated numbers over all files in name order;
partitionBytes; groupRows for writing.
"""

from __future__ import annotations

import json
import operator
import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date, datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    Not,
    WriterCommitMessage,
)

from colonnade import types
from colonnade.types import ColumnType

# The layout of the format.
MAGIC = b"IYX\x01"
HEADER = struct.Struct("<IIQQQ32x")
ENTRY = struct.Struct("<QQI")
GROUP_ROWS = 2048
LENGTH = struct.Struct("<I")
#: Bytes of groups in an input partition, files whose footers are read at once, and bytes copied at a time.
PARTITION_BYTES, FOOTERS, COPY_BYTES = 64 << 20, 16, 8 << 20

COMPARISONS = {EqualTo: operator.eq, LessThan: operator.lt, LessThanOrEqual: operator.le, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge}


class FormatError(ValueError):
    """A file that is not of this format, or is cut short."""


def arrow_type(kind: ColumnType) -> pa.DataType:
    return {"int16": pa.int16(), "int32": pa.int32(), "int64": pa.int64(), "int128": pa.decimal128(38, 0), "bool": pa.bool_(), "string": pa.string(), "date": pa.date32(), "timestamp": pa.timestamp("us")}[kind.name]


def encode(column: pa.Array, kind: ColumnType, name: str) -> bytes:
    """A column's bytes: values back to back, strings each after a length of four bytes."""
    if column.null_count:
        raise ValueError(f"column {name!r} holds NULL, which row-group files can't")
    if kind.name == "int128":
        raise TypeError(f"column {name!r} is an int128, which has no stored form")
    if kind.name == "string":
        column = column.cast(pa.large_binary())
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        body = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
        sizes, n = np.diff(ends), len(column)
        out, text = np.empty(4 * n + len(body), np.uint8), np.ones(4 * n + len(body), bool)
        at = ((ends[:-1] - ends[0]) + 4 * np.arange(n))[:, None] + np.arange(4)
        text[at.ravel()] = False
        out[at.ravel()] = sizes.astype("<u4").view(np.uint8)
        out[text] = body
        return out.tobytes()
    if kind.name == "timestamp":
        column = pc.cast(column.cast(pa.timestamp("us")), pa.timestamp("s")).cast(pa.int64())  # fails rather than cut a second
    elif kind.name == "date":
        column = column.cast(pa.int32())
    elif kind.name == "bool":
        column = column.cast(pa.uint8())
    return np.asarray(column).astype(kind.stored).tobytes()


def decode(raw: memoryview, at: int, n: int, kind: ColumnType, wanted: bool = True) -> tuple[pa.Array | None, int]:
    """n values from position at on (none, if they are not wanted), and the position behind them."""
    if kind.name == "string":
        sizes, first, size_at = [0] * n, at, LENGTH.unpack_from
        try:
            for i in range(n):
                sizes[i] = size = size_at(raw, at)[0]
                at += 4 + size
        except struct.error:
            raise FormatError("the file is cut short") from None
        if at > len(raw):
            raise FormatError("the file is cut short")
        if not wanted:
            return None, at
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        text = np.ones(at - first, bool)
        text[((ends[:-1] + 4 * np.arange(n))[:, None] + np.arange(4)).ravel()] = False
        body = np.frombuffer(raw[first:at], np.uint8)[text]
        return pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(body)).cast(pa.string()), at
    end = at + n * kind.size
    if end > len(raw):
        raise FormatError("the file is cut short")
    if not wanted:
        return None, end
    stored = np.frombuffer(raw[at:end], kind.stored)
    if kind.name == "bool":
        return pa.array(stored != 0), end
    if kind.name == "timestamp":
        return pa.array(stored.astype(np.int64)).cast(pa.timestamp("s")).cast(pa.timestamp("us")), end
    return pa.array(stored).cast(arrow_type(kind)), end


@dataclass
class Layout:
    """What a file says about itself."""

    schema: T.StructType
    groups: list[tuple[int, int, int]]
    rows: int

    @property
    def kinds(self) -> list[ColumnType]:
        return [types.of_spark(f.dataType, f.name) for f in self.schema]


def read_layout(source: pa.NativeFile) -> Layout:
    size = source.size()
    if size <= HEADER.size + len(MAGIC):
        raise FormatError("too short for a row-group file")
    source.seek(size - len(MAGIC))
    if source.read(len(MAGIC)) != MAGIC:
        raise FormatError("no row-group file: the magic bytes are missing")
    source.seek(0)
    columns, _, rows, _, footer = HEADER.unpack(source.read(HEADER.size))
    if not HEADER.size <= footer <= size - len(MAGIC) or (size - len(MAGIC) - footer) % ENTRY.size:
        raise FormatError("the header points outside of the file")
    schema = T.StructType()
    for _ in range(columns):
        head = source.read(5)
        if len(head) < 5:
            raise FormatError("the schema is cut short")
        tag, length = struct.unpack("<BI", head)
        name = source.read(length)
        if len(name) < length:
            raise FormatError("the schema is cut short")
        if name.decode() in schema.names:
            raise FormatError(f"duplicate column {name.decode()!r}")
        schema.add(name.decode(), types.by_tag(tag).spark)
    source.seek(footer)
    entries = list(ENTRY.iter_unpack(source.read(size - len(MAGIC) - footer)))
    return Layout(schema, entries, rows)


def read_group(source: pa.NativeFile, layout: Layout, index: int, names: list[str] | None = None) -> pa.RecordBatch:
    """A group's columns of the names, in their order; all of them if none is given."""
    if not 0 <= index < len(layout.groups):
        raise IndexError(f"row group {index} of {len(layout.groups)}")
    offset, size, _ = layout.groups[index]
    source.seek(offset)
    raw = memoryview(source.read(size))
    if len(raw) < max(4, size):
        raise FormatError("the file is cut short")
    n, at, columns = int.from_bytes(raw[:4], "little"), 4, {}
    names = layout.schema.names if names is None else names
    for name, kind in zip(layout.schema.names, layout.kinds, strict=True):
        columns[name], at = decode(raw, at, n, kind, name in names)
    return pa.record_batch([columns[x] for x in names], names=names)


class FileWriter:
    """Writes one file; a group goes to the stream as soon as it is full, so that only one is held. The header, which names what comes later,
    is filled in last: in place in a local file, else by a copy of the stream's bytes behind it."""

    def __init__(self, path: str, fs: pafs.FileSystem, schema: T.StructType, group_rows: int = GROUP_ROWS) -> None:
        if not len(schema):
            raise ValueError("the schema has no columns")
        self.names, self.kinds = schema.names, [types.of_spark(f.dataType, f.name) for f in schema]
        self.group_rows, self.groups, self.rows, self.held, self.n_held = group_rows, [], 0, [], 0
        self.ended, self.fs, self.path, self.local = False, fs, path, isinstance(fs, pafs.LocalFileSystem)
        self.out = fs.open_output_stream(path if self.local else f"{path}.body", compression=None)
        self.at = 0
        self._put(bytes(HEADER.size))
        self._put(b"".join(struct.pack("<BI", k.tag, len(n.encode())) + n.encode() for n, k in zip(self.names, self.kinds, strict=True)))

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def add(self, batch: pa.RecordBatch) -> None:
        """Take rows; whole groups are encoded as they fill up."""
        if self.ended:
            raise RuntimeError("the file has been ended")
        if batch.schema.names != self.names:
            raise ValueError(f"the batch has the columns {batch.schema.names}, the file {self.names}")
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, self.group_rows - self.n_held)
            self.held.append(part)
            self.n_held += part.num_rows
            at += part.num_rows
            if self.n_held == self.group_rows:
                self._group()

    def _group(self) -> None:
        table = pa.Table.from_batches(self.held).combine_chunks()
        raw = struct.pack("<I", self.n_held) + b"".join(encode(_whole(table.column(i)), k, n) for i, (n, k) in enumerate(zip(self.names, self.kinds, strict=True)))
        self.groups.append((self.at, len(raw), self.n_held))
        self._put(raw)
        self.rows += self.n_held
        self.held, self.n_held = [], 0

    def end(self) -> None:
        if self.ended:
            raise RuntimeError("the file has been ended")
        if self.n_held:
            self._group()
        self.ended = True
        header = HEADER.pack(len(self.names), len(self.groups), self.rows, HEADER.size, self.at)
        self._put(b"".join(ENTRY.pack(*g) for g in self.groups) + MAGIC)
        self.out.close()
        if self.local:
            with open(self.path, "r+b") as made:
                made.write(header)
            return
        with self.fs.open_input_file(f"{self.path}.body") as body, self.fs.open_output_stream(self.path, compression=None) as out:
            out.write(header)
            body.seek(HEADER.size)
            while part := body.read(COPY_BYTES):
                out.write(part)
        self.fs.delete_file(f"{self.path}.body")


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def files_of(path: str) -> tuple[pafs.FileSystem, list[str]]:
    """The file system and the files of a file or folder, in name order."""
    fs, base = file_system(path)
    info = fs.get_file_info(base)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return fs, [base]
    return fs, sorted(x.path for x in fs.get_file_info(pafs.FileSelector(base)) if x.type == pafs.FileType.File and not x.base_name.startswith((".", "_")))


def layouts(path: str) -> list[tuple[str, Layout]]:
    """The files of a file or folder with what they say about themselves, several footers at a time."""
    fs, files = files_of(path)

    def one(file: str) -> Layout:
        with fs.open_input_file(file) as source:
            return read_layout(source)

    with ThreadPoolExecutor(FOOTERS) as pool:
        return list(zip(files, pool.map(one, files), strict=True))


@dataclass
class Groups(InputPartition):
    """Some groups of one file."""

    path: str
    groups: list[int]


class Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, only: str | None, partition_bytes: int) -> None:
        self.path, self.names, self.only, self.partition_bytes = path, schema.names, only, partition_bytes
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            inner, turned = (f.child, True) if isinstance(f, Not) else (f, False)
            name = {EqualTo: "ne" if turned else "eq", LessThan: "lt", LessThanOrEqual: "le", GreaterThan: "gt", GreaterThanOrEqual: "ge"}.get(type(inner))
            if name and (not turned or name == "ne") and len(inner.attribute) == 1 and isinstance(inner.value, (int, str, bool, date, datetime)):
                self.tests.append((inner.attribute[0], name, inner.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        found = [(file, i, size) for file, layout in layouts(self.path) for i, (_, size, _) in enumerate(layout.groups)]
        if self.only is not None:
            chosen = [int(x) for x in self.only.split(",")]
            for i in chosen:
                if not 0 <= i < len(found):
                    raise IndexError(f"row group {i} of {len(found)}")
            found = [found[i] for i in chosen]
        out: list[Groups] = []
        room = 0
        for file, i, size in found:
            if not out or out[-1].path != file or size > room:
                out.append(Groups(file, []))
                room = self.partition_bytes
            out[-1].groups.append(i)
            room -= size
        return out or [Groups("", [])]

    def read(self, partition: Groups) -> Iterator[pa.RecordBatch]:
        if not partition.groups:
            return
        fs, _ = file_system(self.path)
        with fs.open_input_file(partition.path) as source:
            layout = read_layout(source)
            for index in partition.groups:
                yield self._passed(read_group(source, layout, index, self.names))

    def _passed(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        compare = {"eq": pc.equal, "ne": pc.not_equal, "lt": pc.less, "le": pc.less_equal, "gt": pc.greater, "ge": pc.greater_equal}
        for name, how, value in self.tests:
            column = batch.column(batch.schema.get_field_index(name))
            batch = batch.filter(compare[how](column, pa.scalar(value, column.type)))
        return batch


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    file: str
    groups: int
    rows: int


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, group_rows: int, overwrite: bool) -> None:
        self.path, self.schema, self.group_rows, self.overwrite = path, schema, group_rows, overwrite
        for f in schema:
            types.of_spark(f.dataType, f.name)
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, base = file_system(self.path)
        fs.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        name, temporary = f"part-{part:05d}-{self.job}.iyx", f"{base}/.{self.job}-{uuid.uuid4().hex}"
        out = FileWriter(temporary, fs, self.schema, self.group_rows)
        for batch in iterator:
            out.add(batch)
        out.end()
        return Written(temporary, name, len(out.groups), out.rows)

    def commit(self, messages: list[Written | None]) -> None:
        """Old files go before new ones appear, so that no reader sees both; then what failed attempts have left goes too."""
        fs, base = file_system(self.path)
        made = [m for m in messages if m]
        if self.overwrite and fs.get_file_info(base).type == pafs.FileType.Directory:
            for old in files_of(self.path)[1]:
                fs.delete_file(old)
        for m in made:
            fs.move(m.temporary, f"{base}/{m.file}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = file_system(self.path)
        if fs.get_file_info(base).type == pafs.FileType.Directory:
            for x in fs.get_file_info(pafs.FileSelector(base)):
                if x.base_name.startswith(f".{self.job}"):
                    fs.delete_file(x.path)


class RowGroupSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "iyx"

    def schema(self) -> T.StructType:
        fs, files = files_of(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no row-group files in {self.options['path']}")
        with fs.open_input_file(files[0]) as source:
            whole = read_layout(source).schema
        # options' names come in lower case
        return whole if "columns" not in self.options else T.StructType([whole[c] for c in json.loads(self.options["columns"])])

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options["path"], schema, self.options.get("rowGroups"), int(self.options.get("partitionBytes", PARTITION_BYTES)))

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema, int(self.options.get("groupRows", GROUP_ROWS)), overwrite)


def register(spark) -> None:
    """Make the format known to a session, with pushdown."""
    spark.dataSource.register(RowGroupSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


@dataclass(frozen=True)
class Counts:
    """What a writer has written."""

    files: int
    groups: int
    rows: int
    bytes: int


def counts(path: str) -> Counts:
    """Of a file or folder, from the files' directories alone."""
    found = layouts(path)
    return Counts(len(found), sum(len(x.groups) for _, x in found), sum(x.rows for _, x in found), sum(size for _, x in found for _, size, _ in x.groups))


def write(df, path: str, mode: str = "overwrite", group_rows: int = GROUP_ROWS, single: bool = False) -> Counts:
    """One file a task below path, or one file at path if single. What the files then hold."""
    from colonnade import storage

    register(df.sparkSession)
    if single:
        folder = f"{path}.writing"
        df.coalesce(1).write.format("iyx").mode(mode).option("groupRows", group_rows).save(folder)
        storage.single_file(df.sparkSession, folder, path, ".iyx")
    else:
        df.write.format("iyx").mode(mode).option("groupRows", group_rows).save(path)
    return counts(path)


def read(spark, path: str, row_groups: list[int] | None = None, columns: list[str] | None = None):
    """A file or folder as a table; only the columns named are decoded, and only the groups numbered are read."""
    register(spark)
    source = spark.read.format("iyx")
    source = source if row_groups is None else source.option("rowGroups", ",".join(map(str, row_groups)))
    return (source if columns is None else source.option("columns", json.dumps(columns))).load(path)


def directory(path: str) -> list[tuple[str, int, int, int, int]]:
    """(file, group, offset, size, rows) of every group, from the files' directories."""
    return [(file, i, *g) for file, layout in layouts(path) for i, g in enumerate(layout.groups)]


def roundtrip(df, name: str):
    from colonnade import storage

    path = storage.fresh_path(df.sparkSession, name)
    write(df, path)
    return read(df.sparkSession, path)
