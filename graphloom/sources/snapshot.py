"""Snapshots of a build: Parquet tables in a numbered folder, claimed before and published after they are written.

A number is claimed by creating a file that must not be there yet, so of two
writers one gets it and the other takes the next. A snapshot is published by
another file, once all of it is written; readers take the highest published
number, so that none sees an older one after a newer, nor half of any. A writer
that dies leaves a claim that nobody publishes.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.schema import guarded

TABLES = ("nodes", "edges", "files", "meta")
BUCKETS = 64  # folders of files, by hash of the path


def _store(spark: SparkSession, path: str):
    """The Hadoop file system of ``path``, and the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    fs, at = _store(spark, folder)
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(at)) if fs.exists(at) else []


def _create(spark: SparkSession, path: str) -> bool:
    """Whether the file was not there and is now; of several that try at once, one is told so.

    Hadoop's own client of a local disk looks first and creates then, so there the system's exclusive creation is asked for.
    """
    fs, at = _store(spark, path)
    if fs.getScheme() == "file":
        local = at.toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            os.close(os.open(local, os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return False
        return True
    try:
        return fs.createNewFile(at)
    except Exception as error:
        if "FileAlreadyExists" in str(error):
            return False
        raise


def claim(spark: SparkSession, root: str) -> int:
    """The next number, which no other writer has or gets."""
    number = max([0, *_numbers(spark, f"{root}/claims")]) + 1
    while not _create(spark, f"{root}/claims/{number:012}"):
        number += 1
    return number


def publish(spark: SparkSession, root: str, number: int) -> None:
    _create(spark, f"{root}/published/{number:012}")


def _bucket(path):
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


def write(root: str, nodes: DataFrame, edges: DataFrame, files: DataFrame, meta: dict[str, str]) -> int:
    """Write a snapshot and publish it; a failed write leaves what was published before. Edges lie by type, files by hash of their path."""
    spark = nodes.sparkSession
    number = claim(spark, root)
    target = f"{root}/snapshot-{number:012}"
    nodes.write.parquet(f"{target}/nodes")
    guarded(edges).write.partitionBy("type").parquet(f"{target}/edges")
    files.withColumn("bucket", _bucket("path")).repartition("bucket").write.partitionBy("bucket").parquet(f"{target}/files")
    spark.createDataFrame(sorted(meta.items()), "key string, value string").coalesce(1).write.parquet(f"{target}/meta")
    publish(spark, root, number)
    return number


def current(spark: SparkSession, root: str) -> str:
    """Path of the newest published snapshot."""
    numbers = _numbers(spark, f"{root}/published")
    if not numbers:
        raise FileNotFoundError(f"no snapshot below {root}")
    return f"{root}/snapshot-{numbers[-1]:012}"


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    frame = spark.read.parquet(f"{current(spark, root)}/{table}")
    if table == "files":
        return frame.drop("bucket")
    return frame.select("src", "dst", "type", "line", "callee_text", "confidence") if table == "edges" else frame


def read_files(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """The records of ``paths`` alone: only the folders that their hashes name are read."""
    asked = spark.createDataFrame([(p,) for p in paths], "path string")
    buckets = sorted({r[0] for r in asked.select(_bucket("path")).collect()})
    frame = spark.read.parquet(f"{current(spark, root)}/files")
    return frame.filter(F.col("bucket").isin(buckets) & F.col("path").isin(paths)).drop("bucket")


def meta(spark: SparkSession, root: str, key: str) -> str | None:
    """The value of one key of the newest snapshot, if it has it."""
    row = read(spark, root, "meta").filter(F.col("key") == key).first()
    return row["value"] if row else None
