"""Table operators: building, column lookup, appending rows, counts, comparisons and the numeric product."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade import types
from colonnade.functions import values

PRIME = 1_000_000_007


def from_columns(spark: SparkSession, columns: dict[str, Sequence], schema: T.StructType | None = None) -> DataFrame:
    """A table of equal-length columns; a schema, if given, must agree with them in names and number."""
    sizes = {len(c) for c in columns.values()}
    if len(sizes) > 1:
        raise ValueError(f"columns of different lengths: {sorted(sizes)}")
    if schema is not None and schema.names != list(columns):
        raise ValueError(f"columns {list(columns)} for the schema {schema.names}")
    return spark.createDataFrame(list(zip(*columns.values(), strict=True)), schema or list(columns)) if sizes and sizes != {0} else empty(spark, schema or T.StructType())


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def clear(df: DataFrame) -> DataFrame:
    """No rows, the same schema."""
    return df.where(F.lit(False))


def column_at(df: DataFrame, index: int) -> DataFrame:
    if not 0 <= index < len(df.columns):
        raise IndexError(f"column {index} of {len(df.columns)}")
    return df.select(F.col(f"`{df.columns[index]}`"))


def column_named(df: DataFrame, name: str) -> DataFrame | None:
    """The column of a name in its exact case, or None."""
    return df.select(F.col(f"`{name}`")) if name in df.columns else None


def append_row(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """df and a row given as texts. A wrong number of fields is an error here; a text that does not parse is one when rows are made, and then no row is appended."""
    if len(fields) != len(df.schema):
        raise ValueError(f"expected {len(df.schema)} fields but found {len(fields)}")
    texts = df.sparkSession.createDataFrame([tuple(fields)], T.StructType([T.StructField(f"f{i}", T.StringType()) for i in range(len(fields))]))
    row = texts.select(*(values.parse(F.col(f"f{i}"), types.of_spark(c.dataType, c.name).name, c.name).alias(c.name) for i, c in enumerate(df.schema)))
    return df.unionAll(row)


def is_full(df: DataFrame, capacity: int) -> bool:
    """Whether a batch of so many rows would be full; no more rows than that are looked at."""
    return df.limit(capacity).count() >= capacity


def counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """df, and an observation whose `get["rows"]` is the number of rows that the next action on it has read or written, without a second pass."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


COMPARE = {"eq": "__eq__", "ne": "__ne__", "lt": "__lt__", "le": "__le__", "gt": "__gt__", "ge": "__ge__"}


def compare(df: DataFrame, column: str, op: str, value) -> DataFrame:
    """Rows whose column compares so with value; the comparison reaches the scan of a store."""
    if op not in COMPARE:
        raise ValueError(f"{op!r} is not one of {', '.join(COMPARE)}")
    other: Column = value if isinstance(value, Column) else F.lit(value)
    return df.where(getattr(F.col(f"`{column}`"), COMPARE[op])(other))


def product(x: np.ndarray) -> int:
    """The product modulo PRIME, signs as in C."""
    x = np.fmod(x.astype(np.int64), PRIME)
    while len(x) > 1:
        if len(x) % 2:
            x = np.append(x, 1)
        x = np.fmod(x[::2] * x[1::2], PRIME)
    return int(x[0]) if len(x) else 1


def numeric_product(df: DataFrame) -> DataFrame:
    """One row, `product`: all int16, int32 and int64 cells multiplied modulo PRIME. Every partition sends its product, one row, and these are multiplied in one task."""
    held = [f.name for f in df.schema if f.dataType.simpleString() in ("smallint", "int", "bigint")]
    numbers = df.select(*(F.col(f"`{c}`").cast("bigint").alias(f"c{i}") for i, c in enumerate(held)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 1
        for batch in batches:
            for column in batch.columns:
                total = product(np.array([total, product(np.asarray(column.drop_null()))]))
        yield pa.record_batch([pa.array([total], pa.int64())], names=["product"])

    if not held:
        return df.sparkSession.createDataFrame([(1,)], "product bigint")
    return numbers.mapInArrow(run, "product bigint").repartition(1).mapInArrow(run, "product bigint")
