"""Text to values and back, as Catalyst expressions.

Parsing is strict: what does not read as the whole value is an error, not NULL. Spaces, tabs and line ends around a value
are dropped, but for strings, which stay as they are. NULL stays NULL, which CSV text never holds. Dates and timestamps
are calendar-checked, in UTC, of second precision, and without trailing text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade import types

WHOLE = {
    "int16": r"^-?[0-9]+$", "int32": r"^-?[0-9]+$", "int64": r"^-?[0-9]+$", "int128": r"^-?[0-9]+$",
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "timestamp": r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$",
}


def strip(text: Column) -> Column:
    """Without spaces, tabs and line ends at both ends."""
    return F.trim(text, F.lit(" \t\r\n"))


def lower(text: Column) -> Column:
    """A-Z as a-z, other letters unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parse(text: Column, kind: str, column: str = "") -> Column:
    """text as a value of the named type."""
    spark = types.by_name(kind).spark
    if kind == "string":
        return text
    bare = strip(text)
    if kind == "bool":
        low = lower(bare)
        found = F.when(low == "true", True).when(low == "false", False)
    else:
        found = F.when(F.rlike(bare, F.lit(WHOLE[kind])), bare.try_cast(spark))
    said = F.concat(F.lit(f"column {column}: " if column else ""), F.lit(f"not a value of {kind}: '"), text, F.lit("'"))
    return F.when(text.isNull(), F.lit(None).cast(spark)).otherwise(F.coalesce(found, F.raise_error(said).cast(spark)))


def to_text(value: Column, kind: T.DataType | str, raw_times: bool = False) -> Column:
    """A value's text. raw_times: dates as days and timestamps as seconds since 1970, instead of calendar text."""
    name = kind if isinstance(kind, str) else types.of_spark(kind).name
    if name == "date":
        return (days(value) if raw_times else F.date_format(value, "yyyy-MM-dd")).cast("string")
    if name == "timestamp":
        return (seconds(value) if raw_times else F.date_format(value, "yyyy-MM-dd HH:mm:ss")).cast("string")
    return value.cast("string")


def days(value: Column) -> Column:
    """Days since 1970-01-01."""
    return F.unix_date(value)


def seconds(value: Column) -> Column:
    """Whole seconds since 1970-01-01 00:00:00, down."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), value)
    return F.floor(micros / F.lit(1_000_000).cast("decimal(20,0)")).cast("long")


def date_text(n: Column) -> Column:
    """YYYY-MM-DD of days since 1970."""
    return F.date_format(F.date_from_unix_date(n.cast("int")), "yyyy-MM-dd")


def timestamp_text(n: Column) -> Column:
    """YYYY-MM-DD HH:MM:SS of seconds since 1970, whatever the session's zone."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.date_format(F.timestamp_add("SECOND", n.cast("long"), start), "yyyy-MM-dd HH:mm:ss")
