"""Where tables and files go: the shared folder, and small files by way of Hadoop's file systems."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share. Where it is unset, a folder of this session, in local mode only: no other process could see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.colonnade.work", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="colonnade-work-")
        spark.conf.set("spark.colonnade.work", found)
    return found.rstrip("/")


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of a path of any scheme."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used; removed when this process ends."""
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}-{name}"

    def remove() -> None:
        try:
            delete(spark, path)
        except Exception:  # the JVM may have gone first
            pass

    atexit.register(remove)
    return path


def delete(spark: SparkSession, path: str) -> None:
    fs, where = hadoop(spark, path)
    fs.delete(where, True)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's whole text."""
    fs, where = hadoop(spark, path)
    if not fs.exists(where) or fs.getFileStatus(where).isDirectory():
        raise FileNotFoundError(path)
    source = fs.open(where)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, where = hadoop(spark, path)
    out = fs.create(where, True)
    try:
        out.write(text.encode())
    finally:
        out.close()


def single_file(spark: SparkSession, folder: str, target: str, suffix: str = "") -> None:
    """Turn a folder that one task has written into one file at target."""
    fs, where = hadoop(spark, folder)
    _, to = hadoop(spark, target)
    parts = [x.getPath() for x in fs.listStatus(where) if x.getPath().getName().startswith("part-") and x.getPath().getName().endswith(suffix)]
    fs.delete(to, True)
    if not parts:
        fs.create(to, True).close()
    elif len(parts) > 1:
        raise ValueError(f"{folder} has {len(parts)} part files")
    else:
        fs.rename(parts[0], to)
    fs.delete(where, True)
