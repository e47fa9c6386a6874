"""What the operators share: the shared folder, written intermediates, column clean-up."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.ship import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what the cluster names in ``spark.checkpoint.dir``. Only a local
    session, where there is one machine, gets a temporary folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="graphloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


BATCH_ROWS = 1000  # of an Arrow batch
BATCH_BYTES = 8 << 20


def prepared(f):
    """``f``, whose first argument is a session, with the package sent to the executors and small Arrow batches before it.

    Texts are some kilobytes each, some of them megabytes, and a batch is held
    by the JVM and by its worker at once, so Spark's 10,000 rows or 64 MB would
    take much of a small executor. A session that names other numbers keeps them.
    """

    @functools.wraps(f)
    def run(spark, *args, **kwargs):
        ship(spark)
        for name, usual, ours in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", f"{64 << 20}b", BATCH_BYTES)):
            name = f"spark.sql.execution.arrow.{name}"
            if spark.conf.get(name) in (usual, usual.rstrip("b")):
                spark.conf.set(name, str(ours))
        return f(spark, *args, **kwargs)

    return run


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts lineage, survives lost executors, and forgets the partitioning,
    so that a join over the result gets exchanges that AQE may split on skew.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id, k: int):
    """crc32 of the id as text, modulo ``k``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def labelled(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(label_id, label) of the training folds. Null labels and ids don't count, and an id with several labels has the largest."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(F.col(id_col), 3) != 1))
    return known.groupBy(F.col(id_col).alias("label_id")).agg((F.max(label_col) > 0).cast("int").alias("label"))


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, max_docs: int) -> DataFrame:
    """label_id, label and curve of at most ``max_docs`` ids of each class of ``labelled``.

    The smallest by hash of the id are taken; every fourth is for a curve that
    is fitted after the rest.
    """
    spark = labels.sparkSession
    known = labelled(labels, id_col, label_col)
    rows = [r for c in (0, 1) for r in known.filter(F.col("label") == c).orderBy(F.xxhash64("label_id"), "label_id").limit(max_docs).collect()]
    return spark.createDataFrame([(r["label_id"], r["label"], i % 4 == 0) for i, r in enumerate(rows)], "label_id long, label int, curve boolean")


def tidy(f):
    """``f``, a function of batches for ``mapInArrow``; when a task is done its worker gives back the memory that it no longer uses.

    Workers outlive a task, and what the allocators hold on to adds up to an
    executor's memory in the stages that follow.
    """

    @functools.wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
            if trim:
                trim(0)

    return run
