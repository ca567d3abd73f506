"""A folder on any file system that Spark reaches, through Hadoop's own client in the driver's JVM."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        root = self._path(root)
        self.fs = root.getFileSystem(self._conf)
        self.root = self.fs.makeQualified(root).toString().rstrip("/")
        self.fs.mkdirs(self._path(self.root))

    def _path(self, text: str):
        return self._jvm.org.apache.hadoop.fs.Path(text)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def names(self, name: str) -> list[str]:
        """The names in a folder; none if it is not there."""
        path = self._path(self.at(name))
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def files(self, name: str) -> dict[str, int]:
        """Data files under a folder, as names from the root, and their bytes."""
        path = self._path(self.at(name))
        found = {s.getPath().getName(): s.getLen() for s in self.fs.listStatus(path)} if self.fs.exists(path) else {}
        return {f"{name}/{x}": found[x] for x in sorted(found) if x.startswith("part-")}

    def read(self, name: str) -> object:
        stream = self.fs.open(self._path(self.at(name)))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create(self, name: str, value: object) -> bool:
        """Writes a new JSON file; False, and nothing done, if there is one by that name. The file appears whole.

        A local file system's rename writes over what is there, so there the name is a hard link, which is exclusive; others
        (HDFS) refuse to rename onto a file.
        """
        side = self._path(self.at(f"_tmp/{name.replace('/', '-')}-{self._jvm.java.util.UUID.randomUUID().toString()}"))
        stream = self.fs.create(side, True)
        try:
            stream.write(bytearray(json.dumps(value, ensure_ascii=False, indent=1).encode()))
        finally:
            stream.close()
        target = self._path(self.at(name))
        self.fs.mkdirs(target.getParent())
        try:
            if self.fs.exists(target):
                return False
            if target.toUri().getScheme() == "file":
                old, new = (self._jvm.java.io.File(p.toUri().getPath()).toPath() for p in (side, target))
                try:
                    self._jvm.java.nio.file.Files.createLink(new, old)
                except Py4JJavaError:
                    if self.fs.exists(target):
                        return False  # another writer was first
                    raise
                return True
            return self.fs.rename(side, target)
        finally:
            self.fs.delete(side, False)

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(self.at(name)), True)
