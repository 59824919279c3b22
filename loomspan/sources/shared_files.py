"""Small files and folders of any Hadoop file system, from the driver."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    """Files by path; each path may name its own file system."""

    def __init__(self, spark: SparkSession) -> None:
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        where = self._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self._conf), where

    def exists(self, path: str) -> bool:
        fs, where = self._at(path)
        return bool(fs.exists(where))

    def names(self, path: str) -> list[str]:
        fs, where = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def text(self, path: str) -> str:
        fs, where = self._at(path)
        stream = fs.open(where)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Write a file that must not be there yet; False if it is.  Who gets True is the only one (on file systems with exclusive create)."""
        fs, where = self._at(path)
        try:
            stream = fs.create(where, False)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception) or fs.exists(where):
                return False
            raise
        stream.write(text.encode())
        stream.close()
        return True

    def replace(self, path: str, text: str) -> None:
        """Write a file beside its place and move it there, so that no reader sees a part of it."""
        beside = f"{path}.{uuid.uuid4().hex}"
        self.create(beside, text)
        self.delete(path)
        self.move(beside, path)

    def delete(self, path: str) -> None:
        fs, where = self._at(path)
        fs.delete(where, True)

    def move(self, path: str, to: str) -> None:
        fs, where = self._at(path)
        target = self._jvm.org.apache.hadoop.fs.Path(to)
        fs.mkdirs(target.getParent())
        if not fs.rename(where, target):
            raise OSError(f"{path} could not be moved to {to}")

    def listing(self, path: str) -> list[tuple[str, int, int]]:
        """(name below the folder, bytes, time of change) of all files."""
        fs, where = self._at(path)
        root, out = fs.makeQualified(where).toString(), []
        found = fs.listFiles(where, True)
        while found.hasNext():
            s = found.next()
            out.append((s.getPath().toString()[len(root) :], s.getLen(), s.getModificationTime()))
        return sorted(out)
