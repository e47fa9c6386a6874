"""Cut a loop's lineage where all executors can read it again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[tuple, str] = {}
TOGETHER = "16m"


def _folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and (not context.master.startswith("local") or "cluster" in context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="graphloom-"))
    return context.getCheckpointDir()


def keep(df: DataFrame, dealt: bool = False) -> DataFrame:
    """``df`` written in the shared folder and read from there; with ``dealt`` checkpointed, so that its partitions stay as they are.

    A checkpoint is planned with the size that was guessed for its plan, and
    that of a join is a product: in a loop it squares each round, so that
    nothing seems small and planning takes longer than the work. A written
    table has the size of its files.
    """
    spark = df.sparkSession
    folder = _folder(spark)
    if dealt:
        return df.checkpoint()
    path = f"{folder}/keep-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def dealt_by(spark: SparkSession, rows: int, each: int = 250_000) -> Iterator[None]:
    """What is written inside deals its shuffles into partitions of some ``each`` rows, of ``rows`` in all, if that is more than the session's number.

    So a task holds no more when there are more rows; where partitions turn out
    small, they are put together again, up to ``TOGETHER``: what is sorted or
    gathered takes many times its shuffled size.
    """
    name, size = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = {k: spark.conf.get(k, None) for k in (name, size)}
    spark.conf.set(name, max(rows // each, int(before[name] or spark.conf.get("spark.sql.shuffle.partitions"))))
    spark.conf.set(size, TOGETHER)
    try:
        yield
    finally:
        for k, value in before.items():
            spark.conf.set(k, value) if value else spark.conf.unset(k)


def once(spark: SparkSession, key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, written as a table in the shared folder once an application and ``key``, and read from there after.

    Inputs must not change while the application runs.
    """
    key = (spark.sparkContext.applicationId, *key)
    if key not in _WRITTEN:
        path = f"{_folder(spark)}/once-{uuid.uuid4().hex}"
        make().write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])
