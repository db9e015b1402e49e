"""Header-less CSV under an explicit schema, read and written without Python on the executors.

Spark's own CSV source differs in ways that change data (empty fields become NULL, short rows pass when columns are pruned,
spaces are trimmed, a lone carriage return ends a row), so lines come from the text source and are split by an expression.
Splitting is row-local: no shuffle, and large files are read in splits. Rows can't span lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade import schema as schemas
from colonnade import storage, types
from colonnade.functions import csvtext, values


def parse_lines(lines: DataFrame, schema: T.StructType, delimiter: str = csvtext.DELIMITER, quote: str = csvtext.QUOTE) -> DataFrame:
    """Rows of lines' column value. Empty lines are skipped; a wrong number of fields is an error, even if no column is asked for."""
    if not len(schema):
        raise ValueError("the schema has no columns")
    n = len(schema)
    # Generate keeps the fields from being computed for the filter and again for the projection
    fields = lines.where("value != ''").select(F.explode(F.array(csvtext.split(F.col("value"), delimiter, quote))).alias("f"))
    wrong = F.raise_error(F.concat(F.lit(f"expected {n} fields but found "), F.size("f").cast("string"), F.lit(": "), F.array_join("f", delimiter))).cast("boolean")
    checked = fields.where(F.when(F.size("f") == n, True).otherwise(wrong))
    return checked.select(*(values.parse(F.col("f")[i], types.of_spark(c.dataType, c.name).name, c.name).alias(c.name) for i, c in enumerate(schema)))


def read(spark: SparkSession, path: str, schema: T.StructType, delimiter: str = csvtext.DELIMITER, quote: str = csvtext.QUOTE) -> DataFrame:
    return parse_lines(spark.read.option("lineSep", "\n").text(path), schema, delimiter, quote)


def to_lines(df: DataFrame, delimiter: str = csvtext.DELIMITER, quote: str = csvtext.QUOTE, raw_times: bool = False) -> DataFrame:
    """The column value: a line a row. Types that tables don't have are rejected here, NULLs when the lines are made."""
    fields = []
    for c in df.schema:
        kind = types.of_spark(c.dataType, c.name).name
        text = values.to_text(F.col(f"`{c.name}`"), kind, raw_times)
        fields.append(F.coalesce(text, F.raise_error(F.lit(f"column {c.name!r} holds NULL, which CSV text can't")).cast("string")))
    return df.select(csvtext.join(fields, delimiter, quote).alias("value"))


def write(df: DataFrame, path: str, delimiter: str = csvtext.DELIMITER, quote: str = csvtext.QUOTE, raw_times: bool = False, single: bool = False) -> None:
    """Write lines below path, or, if single, to one file by one task."""
    lines = to_lines(df, delimiter, quote, raw_times)
    if not single:
        lines.write.mode("overwrite").option("lineSep", "\n").text(path)
        return
    folder = f"{path}.writing"
    lines.coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(folder)
    storage.single_file(df.sparkSession, folder, path, ".txt")


def roundtrip(df: DataFrame, name: str) -> DataFrame:
    """df written as CSV with its schema file, and read again from both."""
    spark = df.sparkSession
    path = storage.fresh_path(spark, name)
    write(df, f"{path}/data")
    schemas.save(spark, df.schema, f"{path}/schema.csv")
    return read(spark, f"{path}/data", schemas.load(spark, f"{path}/schema.csv"))


def first_error(spark: SparkSession, path: str, schema: T.StructType) -> tuple[int, str] | None:
    """The first line, from 1, that does not have the schema's number of fields or closed quotes, and the line; for a report after a failure."""
    lines = spark.read.option("lineSep", "\n").text(path)
    closed = ~csvtext.unclosed(F.col("value"))
    wrong = (F.col("value") != "") & (~closed | F.when(closed, F.size(csvtext.split(F.col("value"))) != len(schema)).otherwise(True))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a partition: its lines, and the number and text of the first wrong one."""
        seen, number, text = 0, None, None
        for batch in batches:
            if number is None and (at := pc.index(batch.column(0), True).as_py()) >= 0:
                number, text = seen + at + 1, batch.column(1)[at].as_py()
            seen += batch.num_rows
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([seen], pa.int64()), pa.array([number], pa.int64()), pa.array([text], pa.string())], names=["part", "lines", "number", "value"])

    before = 0
    checked = lines.select(wrong.alias("wrong"), F.when(wrong, F.col("value")).alias("value"))
    for r in sorted(checked.mapInArrow(first, "part int, lines bigint, number bigint, value string").collect()):  # one row a partition
        if r.number is not None:
            return before + r.number, r.value
        before += r.lines
    return None
