"""Folders that the driver and all executors share, and renames in them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder's path below ``spark.checkpoint.dir``; where that is unset, a temporary one of a local session.

    A cluster without that setting raises an error, as a folder of one machine would not do.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="quillmesh-"))
        base = _local[0]
    return f"{base.rstrip('/')}/quillmesh/{label}-{uuid.uuid4().hex}"


def written_once(df: DataFrame, label: str) -> DataFrame:
    """The table written to a shared folder and read back, for what is read several times and dear to compute."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Files:
    """Names, renames and deletions in the file system of a path, through Spark's own connectors."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark.sparkContext._jvm
        self._fs = self._place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _place(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._place(path))

    def names(self, path: str) -> dict[str, int]:
        """Names in a folder with the time of their last change in milliseconds; none where it does not exist."""
        if not self.exists(path):
            return {}
        return {s.getPath().getName(): s.getModificationTime() for s in self._fs.listStatus(self._place(path))}

    def make(self, path: str) -> None:
        self._fs.mkdirs(self._place(path))

    def rename(self, path: str, to: str) -> None:
        if not self._fs.rename(self._place(path), self._place(to)):
            raise OSError(f"{path} cannot be moved to {to}")

    def drop(self, path: str) -> None:
        self._fs.delete(self._place(path), True)

    def write(self, path: str, text: str) -> None:
        """A small text file of the driver."""
        out = self._fs.create(self._place(path), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
