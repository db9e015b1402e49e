"""The native store: Parquet folders, with row groups of a set number of rows where that is asked for.

Whole scans go through Spark's vectorised reader with its pruning and pushdown. The row-group directory and reads of single
groups go through footers, one task a file or group.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from colonnade import storage

#: Rows of a group in the row-group format, and in a store that copies its groups.
GROUP_ROWS = 2048


def write(df: DataFrame, path: str, group_rows: int | None = None, mode: str = "errorifexists") -> None:
    """Write a store; commit is all or nothing. group_rows: the most rows of a group, else Parquet's own size."""
    out = df.write.mode(mode)
    (out.option("parquet.block.row.count.limit", str(group_rows)) if group_rows else out).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _open(uri: str):
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    fs, path = pafs.FileSystem.from_uri(uri)
    return pq.ParquetFile(fs.open_input_file(path))


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = sorted(spark.read.parquet(path).inputFiles())
    return spark.createDataFrame([(i, f) for i, f in enumerate(files)], "file_no int, file string").repartition(max(1, len(files)))


def directory(spark: SparkSession, path: str) -> DataFrame:
    """One row a row group: file_no (in name order), group_no, row_offset in its file, byte_offset, byte_size, row_count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                meta, seen = _open(row["file"]).metadata, 0
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    first = group.column(0)
                    start = min(x for x in (first.dictionary_page_offset, first.data_page_offset) if x)
                    out.append((row["file_no"], row["file"], g, seen, start, group.total_byte_size, group.num_rows))
                    seen += group.num_rows
            names = ["file_no", "file", "group_no", "row_offset", "byte_offset", "byte_size", "row_count"]
            kinds = [pa.int32(), pa.string(), pa.int32(), *[pa.int64()] * 4]
            yield pa.record_batch([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=names)

    return _files(spark, path).mapInArrow(run, "file_no int, file string, group_no int, row_offset bigint, byte_offset bigint, byte_size bigint, row_count bigint")


def files_before(spark: SparkSession, path: str) -> DataFrame:
    """file_no with the groups (`groups_before`) and rows (`rows_before`) of all files before it; only a row a file comes to the driver."""
    found = directory(spark, path).groupBy("file_no").agg(F.count("*").alias("n"), F.sum("row_count").alias("rows")).collect()
    out, groups, rows = [], 0, 0
    for r in sorted(found):
        out.append((r.file_no, groups, rows))
        groups, rows = groups + r.n, rows + r.rows
    return spark.createDataFrame(out, "file_no int, groups_before bigint, rows_before bigint")


def numbered_directory(spark: SparkSession, path: str) -> DataFrame:
    """The directory with group_no and row_offset counted over all files."""
    found = directory(spark, path).join(F.broadcast(files_before(spark, path)), "file_no")  # a row a file
    return found.select("file", (F.col("groups_before") + F.col("group_no")).cast("int").alias("group_no"), (F.col("rows_before") + F.col("row_offset")).alias("row_offset"), "byte_offset", "byte_size", "row_count")


def read_groups(spark: SparkSession, path: str, groups: Sequence[int], columns: Sequence[str] | None = None) -> DataFrame:
    """The rows of some groups, numbered over all files from 0; only these groups and columns are read, and only counts of a file's groups come to the driver."""
    found = directory(spark, path).groupBy("file_no", "file").agg(F.count("*").alias("n")).collect()  # one row a file
    files = sorted((r.file_no, r.file, r.n) for r in found)
    ends = list(itertools.accumulate(n for _, _, n in files))
    wanted = []
    for g in groups:
        if not 0 <= g < (ends[-1] if ends else 0):
            raise IndexError(f"row group {g} of {ends[-1] if ends else 0}")
        at = bisect.bisect_right(ends, g)
        wanted.append((files[at][1], g - (ends[at - 1] if at else 0)))
    whole = read(spark, path)
    held = whole.select(*columns) if columns else whole
    arrow = to_arrow_schema(held.schema)
    places = spark.createDataFrame(wanted, "file string, group_no int").repartition(max(1, len(groups)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                table = _open(row["file"]).read_row_group(row["group_no"], columns=arrow.names).select(arrow.names).cast(arrow)
                yield from table.to_batches()

    return places.mapInArrow(run, held.schema)


def totals(spark: SparkSession, path: str) -> DataFrame:
    """Counts from footers alone: n_groups and n_rows."""
    return directory(spark, path).agg(F.count("*").alias("n_groups"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("n_rows"))


def roundtrip(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    path = storage.fresh_path(df.sparkSession, name)
    write(df, path, group_rows)
    return read(df.sparkSession, path)
