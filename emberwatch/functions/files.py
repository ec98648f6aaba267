"""Small files next to tables, in whatever file system Spark writes to."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Folder:
    """A folder of small JSON files that are written once."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._io = jvm.org.apache.commons.io.IOUtils
        self.root = self._path(path)
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        if not self.fs.exists(self.root):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.root))

    def read(self, name: str) -> dict:
        stream = self.fs.open(self._path(self.root, name))
        try:
            return json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, name: str, value: dict) -> None:
        """The file appears whole under its name or not at all."""
        part = self._path(self.root, f".{name}.part")
        stream = self.fs.create(part, True)
        try:
            stream.write(json.dumps(value).encode())
        finally:
            stream.close()
        if not self.fs.rename(part, self._path(self.root, name)):
            raise OSError(f"cannot write {self.root}/{name}")

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(self.root, name), False)

    def delete_folders(self, pattern: str) -> None:
        """Folders below the root that match a glob pattern, with all they hold."""
        for s in self.fs.globStatus(self._path(self.root, pattern)) or []:
            self.fs.delete(s.getPath(), True)
