"""Conversions between CSV with a schema file and stores, from Python and from the command line.

    python -m colonnade.convert import SCHEMA.csv DATA.csv OUTPUT[.iyx]
    python -m colonnade.convert export INPUT[.iyx] DATA.csv SCHEMA.csv
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from colonnade import schema as schemas
from colonnade import session
from colonnade.operators import batch
from colonnade.sources import csv_io, rowgroup_file, store


def import_csv(spark: SparkSession, schema_path: str, data_path: str, output: str, single: bool = False) -> int:
    """CSV to a row-group file or folder if output ends in .iyx, else to a Parquet store. Every cell is converted; an error leaves no output. The number of rows, counted as they are written."""
    rows, seen = batch.counted(csv_io.read(spark, data_path, schemas.load(spark, schema_path)))
    if output.endswith(".iyx"):
        rowgroup_file.write(rows, output, single=single)
    else:
        store.write(rows, output, mode="overwrite")
    return seen.get["rows"]


def export_csv(spark: SparkSession, source: str, data_path: str, schema_path: str, raw_times: bool = False, single: bool = False) -> int:
    """A store or row-group file to CSV and a schema file. The number of rows, counted as they are written."""
    rows, seen = batch.counted(open_table(spark, source))
    schemas.save(spark, rows.schema, schema_path)
    csv_io.write(rows, data_path, raw_times=raw_times, single=single)
    return seen.get["rows"]


def open_table(spark: SparkSession, path: str) -> DataFrame:
    return rowgroup_file.read(spark, path) if path.endswith(".iyx") else store.read(spark, path)


def main(args: list[str]) -> int:
    if len(args) != 4 or args[0] not in ("import", "export"):
        print(__doc__, file=sys.stderr)
        return 1
    spark = session.start("colonnade-convert")
    try:
        n = (import_csv if args[0] == "import" else export_csv)(spark, *args[1:], single=True)
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print(f"{n} rows", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
