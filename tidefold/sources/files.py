"""Small files through Hadoop's file system, so that any store Spark reads will do."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share; it goes when the driver ends.

    It lies in ``spark.checkpoint.dir``; only where that is unset and Spark runs on one
    machine, in a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local()
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    own = Folder(spark, path)
    own.fs.deleteOnExit(own._path(""))
    return path


@lru_cache(1)
def _local() -> str:
    folder = tempfile.mkdtemp(prefix="tidefold-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


class Folder:
    """A directory of the table. Names are relative to it."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def make(self, name: str = "") -> None:
        self.fs.mkdirs(self._path(name))

    def has(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(name))] if self.has(name) else []

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self._path(name)).getLength() if self.has(name) else 0

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> bool:
        """Write a file that must not exist yet; False if it does."""
        try:
            stream = self.fs.create(self._path(name), False)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
            stream.hsync()
        finally:
            stream.close()
        return True

    def rename(self, old: str, new: str) -> bool:
        """False if ``new`` exists already."""
        return not self.has(new) and self.fs.rename(self._path(old), self._path(new))

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
