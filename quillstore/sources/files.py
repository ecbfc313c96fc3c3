"""Small control files, on any file system that Spark reads."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self.root = root.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def make(self, name: str = "") -> None:
        self._fs.mkdirs(self._path(name))

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> None:
        """The whole file or none: written aside and synced, then renamed. An existing name is an error, also when two write at once.

        That rests on a rename that never replaces a file, as HDFS and local disks have it.
        """
        aside = self._path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(aside, False)
        try:
            stream.write(bytearray(text.encode()))
            stream.hsync()
        finally:
            stream.close()
        if self._fs.exists(self._path(name)) or not self._fs.rename(aside, self._path(name)):
            self._fs.delete(aside, False)
            raise FileExistsError(f"{name} is there already")

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
