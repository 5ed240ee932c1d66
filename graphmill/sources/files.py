"""Files and folders wherever Spark can reach them: local disks, distributed file systems, object stores."""

from __future__ import annotations

import os
from typing import NamedTuple

from pyspark.sql import SparkSession


class Entry(NamedTuple):
    name: str
    path: str
    is_folder: bool
    length: int


class Files:
    """What a shelf needs of a Hadoop file system, by path; a path without a scheme is that of Spark's own reads."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str | os.PathLike):
        target = self._jvm.org.apache.hadoop.fs.Path(str(path))
        return target.getFileSystem(self._conf), target

    def exists(self, path: str | os.PathLike) -> bool:
        system, target = self._at(path)
        return system.exists(target)

    def list(self, path: str | os.PathLike) -> list[Entry]:
        """Direct entries by name, hidden ones left out; none where there is no such folder."""
        system, target = self._at(path)
        if not system.exists(target):
            return []
        found = [Entry(s.getPath().getName(), s.getPath().toString(), s.isDirectory(), s.getLen()) for s in system.listStatus(target)]
        return sorted(e for e in found if not e.name.startswith("."))

    def walk(self, path: str | os.PathLike, below: str = "") -> list[Entry]:
        """All files below a folder, named by their path relative to it."""
        out = []
        for entry in self.list(path):
            name = f"{below}{entry.name}"
            out += self.walk(entry.path, name + "/") if entry.is_folder else [entry._replace(name=name)]
        return out

    def make(self, path: str | os.PathLike) -> None:
        system, target = self._at(path)
        system.mkdirs(target)

    def delete(self, path: str | os.PathLike) -> None:
        system, target = self._at(path)
        system.delete(target, True)

    def upload(self, local: str | os.PathLike, path: str | os.PathLike) -> None:
        """Copy a file of this machine, replacing what is there."""
        system, target = self._at(path)
        system.mkdirs(target.getParent())
        system.copyFromLocalFile(False, True, self._jvm.org.apache.hadoop.fs.Path("file:" + os.path.abspath(local)), target)

    def download(self, path: str | os.PathLike, local: str | os.PathLike) -> None:
        system, target = self._at(path)
        system.copyToLocalFile(False, target, self._jvm.org.apache.hadoop.fs.Path("file:" + os.path.abspath(local)), True)

    def copy(self, path: str | os.PathLike, to: str | os.PathLike) -> None:
        """Copy a file or folder within and between file systems."""
        (source, here), (sink, there) = self._at(path), self._at(to)
        sink.mkdirs(there.getParent())
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(source, here, sink, there, False, True, self._conf)
