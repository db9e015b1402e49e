"""Schemas: StructTypes that are ordered lists of (name, type), and their side files of `name,type` lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from colonnade import storage, types
from colonnade.functions import csvtext

SPACE = " \t\r\n"


def make(*columns: tuple[str, str]) -> T.StructType:
    """A schema of (name, type name) pairs; names must be different."""
    out = T.StructType()
    for name, kind in columns:
        add(out, name, kind)
    return out


def add(schema: T.StructType, name: str, kind: str | T.DataType) -> T.StructType:
    """Add a column in place; a name that is there already is an error (names are case-sensitive)."""
    if has(schema, name):
        raise ValueError(f"duplicate column {name!r}")
    return schema.add(name, types.by_name(kind).spark if isinstance(kind, str) else kind)


def count(schema: T.StructType) -> int:
    return len(schema)


def at(schema: T.StructType, index: int) -> T.StructField:
    if not 0 <= index < len(schema):
        raise IndexError(f"column {index} of {len(schema)}")
    return schema[index]


def find(schema: T.StructType, name: str) -> int | None:
    """The position of a name, or None."""
    return schema.names.index(name) if name in schema.names else None


def has(schema: T.StructType, name: str) -> bool:
    return name in schema.names


def same(a: T.StructType, b: T.StructType) -> bool:
    """Equal names and types in equal order; nullability does not count."""
    return [(f.name, f.dataType) for f in a] == [(f.name, f.dataType) for f in b]


def valid(schema: T.StructType) -> bool:
    """Not empty, no empty names, no duplicates."""
    return bool(schema.names) and all(schema.names) and len(set(schema.names)) == len(schema.names)


def parse_line(line: str, number: int = 0) -> tuple[str, str]:
    """(name, type name) of a side file's line; fields may be quoted and stand in spaces."""
    where = f"line {number}: " if number else ""
    fields = [f.strip(SPACE) for f in csvtext.split_text(line)]
    if len(fields) != 2:
        raise ValueError(f"{where}expected name,type but found {len(fields)} fields")
    name, kind = fields
    if not name:
        raise ValueError(f"{where}empty column name")
    if not kind:
        raise ValueError(f"{where}empty type of column {name!r}")
    try:
        types.by_name(kind)
    except ValueError as e:
        raise ValueError(f"{where}{e}") from None
    return name, kind


def parse(text: str) -> T.StructType:
    """The schema in a side file's text. Blank lines are skipped but counted in line numbers, which start at 1."""
    out = T.StructType()
    for number, line in enumerate(text.split("\n"), 1):
        if not line.strip(SPACE):
            continue
        name, kind = parse_line(line, number)
        if has(out, name):
            raise ValueError(f"line {number}: duplicate column {name!r}")
        add(out, name, kind)
    if not len(out):
        raise ValueError("the schema has no columns")
    return out


def render(schema: T.StructType) -> str:
    """A side file's text."""
    return "".join(csvtext.join_text([f.name, types.of_spark(f.dataType, f.name).name]) + "\n" for f in schema)


def load(spark: SparkSession, path: str) -> T.StructType:
    return parse(storage.read_text(spark, path))


def save(spark: SparkSession, schema: T.StructType, path: str) -> None:
    storage.write_text(spark, path, render(schema))


def table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """One row a column: position, name, type."""
    rows = [(i, f.name, types.of_spark(f.dataType, f.name).name) for i, f in enumerate(schema)]
    return spark.createDataFrame(rows, "position int, name string, type string")
