"""Small files of a database directory, through Hadoop's file systems (local, HDFS, object stores)."""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import SparkSession


class Store:
    """Paths are relative to the database directory."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.local = self._fs.getScheme() == "file"
        self._fs.mkdirs(self._path(self.root))

    def path(self, *parts: str) -> str:
        return "/".join([self.root, *parts])

    def _file(self, path: str) -> str:
        return self._path(path).toUri().getPath()

    def names(self, *parts: str) -> list[str]:
        folder = self._path(self.path(*parts))
        return sorted(s.getPath().getName() for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def read(self, *parts: str) -> str:
        path = self._path(self.path(*parts))
        stream = self._fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, text: str, *parts: str) -> bool:
        """Write a new file as a whole; False, and nothing changed, if there is one of that name already. Local disks
        (link) and HDFS (rename) take a name once; object stores whose rename replaces files need a single writer."""
        target = self.path(*parts)
        draft = f"{target}.{uuid.uuid4().hex}.draft"
        self._fs.mkdirs(self._path(target).getParent())
        if self.local:
            with open(self._file(draft), "w") as f:
                f.write(text)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(self._file(draft), self._file(target))  # fails if the name is taken
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(self._file(draft))
        stream = self._fs.create(self._path(draft), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self._fs.exists(self._path(target)) and self._fs.rename(self._path(draft), self._path(target)):
            return True
        self._fs.delete(self._path(draft), False)
        return False

    def age(self, *parts: str) -> float:
        """Seconds since a file or folder was last changed."""
        return time.time() - self._fs.getFileStatus(self._path(self.path(*parts))).getModificationTime() / 1000

    def delete(self, *parts: str) -> None:
        self._fs.delete(self._path(self.path(*parts)), True)
