"""Folders that driver and executors share, written tables and small helpers for this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_task: list[int | None] = [None]
#: What this worker process keeps between tasks, by owner: how to give it up.
_HELD: dict[str, object] = {}


def holds(owner: str, give_up) -> None:
    _HELD[owner] = give_up


def worker_starts(owner: str | None = None) -> None:
    """Called by worker functions as they begin: what other operators keep in this process is given up.

    Workers are reused, so an encoder's memo would otherwise stay through all later stages. Memory that
    earlier tasks freed goes back to the system, so the workers of one machine do not all keep their peak.
    An owner that goes on with what it holds does not look for garbage again.
    """
    goes_on = owner in _HELD
    for name, give_up in list(_HELD.items()):
        if name != owner:
            give_up()
            del _HELD[name]
    task = TaskContext.get()
    if task is not None and task.taskAttemptId() != _task[0]:
        _task[0] = task.taskAttemptId()
        if not goes_on:
            gc.collect()
        release_memory()


def release_memory() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: it has no such call
        pass


BATCH_BYTES = 8 * 1024 * 1024


def small_batches(spark: SparkSession) -> None:
    """Let Spark hand texts to Python in batches of at most BATCH_BYTES, so workers stay small.

    Rows a batch are bounded by count only unless this is set; long texts then fill memory.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.rstrip("bB").isdigit() or int(now.rstrip("bB")) > BATCH_BYTES or int(now.rstrip("bB")) <= 0:
        spark.conf.set(name, str(BATCH_BYTES))


_local_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see: ``spark.checkpoint.dir``.

    Where that is unset, a local session, whose executors are the driver, gets a temporary folder; on
    a cluster this raises, as no folder of one machine would do.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _local_dir:
            _local_dir.append(tempfile.mkdtemp(prefix="quillmesh-"))
        base = _local_dir[0]
    return base.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/quillmesh/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: when an executor is lost afterwards, readers start from the files and
    nothing upstream runs again.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables of one computation, deleted together when it ends, with its result written or not."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        self.drop()

    def written(self, df: DataFrame, label: str) -> DataFrame:
        path = new_folder(self.spark, label)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        while self.paths:
            drop_folder(self.spark, self.paths.pop())


def drop_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(key: str, folds: int):
    """crc32 of the key as text, modulo ``folds``: the fold rule of the labelled operators."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(folds)
