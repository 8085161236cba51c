"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows an Arrow batch may hold while whole texts travel to Python workers; keeps a worker's memory bounded.
TEXT_BATCH_ROWS = 1000
#: Code-point class of the words that the SimHash and quality contracts name.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; Spark opens the path, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the Arrow batch size for text columns unless the session already holds a smaller one."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > TEXT_BATCH_ROWS:
        spark.conf.set(key, str(TEXT_BATCH_ROWS))


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage: Spark's context cleaner then deletes shuffle files that a checkpoint replaced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def saved(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder of spark.checkpoint.dir; a temporary one only where that is unset."""
    sc = df.sparkSession.sparkContext
    release(df.sparkSession)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like saved, for large tables: written as compressed Parquet in the shared checkpoint folder and read again.

    Spark does not delete such a table by itself; it goes when the folder is cleared.
    """
    spark = df.sparkSession
    release(spark)
    sc = spark.sparkContext
    shared = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-")
    path = f"{shared}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


_kept: dict[str, Callable[[], None]] = {}


def begin(operator: str, forget: Callable[[], None] | None = None) -> None:
    """First call of a task's Python code. Spark keeps worker processes, so what another operator keeps in this one
    (forget() drops it) would add up over the stages of a pipeline; it goes, and freed memory is given back.
    """
    for other in [k for k in _kept if k != operator]:
        _kept.pop(other)()
    if forget is not None:
        _kept[operator] = forget
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def n_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unnamed(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """docs with its columns called c0, c1, ..., the new names of `names`, and what gives a result its old columns back.

    What an operator adds has other names, so no name of an input column clashes with it.
    """
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    back = lambda df: df.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(docs.columns)])
    return plain, [f"c{docs.columns.index(n)}" for n in names], back


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
