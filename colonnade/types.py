"""The eight column types: names, tags, sizes and their Spark counterparts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class ColumnType:
    tag: int
    name: str
    #: Bytes of a value in a row-group file; 0 for a variable length.
    size: int
    spark: T.DataType
    #: numpy type of the stored values, none for strings.
    stored: str | None

    @property
    def fixed(self) -> bool:
        return self.size > 0


# Tags and names of the file format.
TYPES = (
    ColumnType(0, "int16", 2, T.ShortType(), "<i2"),
    ColumnType(1, "int32", 4, T.IntegerType(), "<i4"),
    ColumnType(2, "int64", 8, T.LongType(), "<i8"),
    ColumnType(3, "int128", 8, T.DecimalType(38, 0), "<i8"),
    ColumnType(4, "bool", 1, T.BooleanType(), "<u1"),
    ColumnType(5, "string", 0, T.StringType(), None),
    ColumnType(6, "date", 4, T.DateType(), "<i4"),
    ColumnType(7, "timestamp", 8, T.TimestampNTZType(), "<i8"),
)
BY_NAME = {t.name: t for t in TYPES}
BY_TAG = {t.tag: t for t in TYPES}
BY_SPARK = {t.spark.simpleString(): t for t in TYPES}


def by_name(name: str) -> ColumnType:
    """The type of an exact lower-case name."""
    try:
        return BY_NAME[name]
    except KeyError:
        raise ValueError(f"unknown type {name!r}") from None


def by_tag(tag: int) -> ColumnType:
    try:
        return BY_TAG[tag]
    except KeyError:
        raise ValueError(f"unknown type tag {tag}") from None


def of_spark(kind: T.DataType, column: str = "") -> ColumnType:
    """The type that stores a Spark type; others are rejected, with the column's name."""
    try:
        return BY_SPARK[kind.simpleString()]
    except KeyError:
        raise TypeError(f"column {column!r} has the type {kind.simpleString()}, which tables don't have; cast it to one of {', '.join(BY_NAME)}") from None


def name_of(tag: int) -> str:
    return BY_TAG[tag].name if tag in BY_TAG else "unknown"
