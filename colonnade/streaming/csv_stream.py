"""CSV folders as streams: the parsing of sources.csv_io over files as they arrive. An extension: the tables themselves are finite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from colonnade.functions import csvtext
from colonnade.sources import csv_io


def read(spark: SparkSession, folder: str, schema: T.StructType, delimiter: str = csvtext.DELIMITER, quote: str = csvtext.QUOTE) -> DataFrame:
    """An unbounded table of the rows of all files that come into folder."""
    return csv_io.parse_lines(spark.readStream.option("lineSep", "\n").text(folder), schema, delimiter, quote)


def import_available(spark: SparkSession, folder: str, schema: T.StructType, store_path: str, checkpoint: str) -> StreamingQuery:
    """Append the files that are new since the last run to a store, each once, and end."""
    return read(spark, folder, schema).writeStream.format("parquet").option("path", store_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
