"""A log of numbered commits in a folder of any Hadoop file system; each number is claimed by one writer."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession

from folioforge.session import local_path


class Conflict(RuntimeError):
    """Another writer claimed the number first."""


class Commits:
    """Commits appear whole or not at all.

    On a mounted file system a hard link claims the number, elsewhere a rename that fails where the target exists, as that of HDFS does; an object
    store needs a committer with such a rename.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        at = self._path(self.folder)
        if not self._fs.exists(at):
            return []
        return sorted(n for f in self._fs.listStatus(at) if (n := f.getPath().getName()).endswith(".json") and n[0].isdigit())

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.folder}/{name}"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def last(self) -> dict | None:
        names = self._names()
        return self._read(names[-1]) if names else None

    def all(self) -> list[dict]:
        return [self._read(n) for n in self._names()]

    def claim(self, number: int, what: dict) -> None:
        """Writes the commit of this number; `Conflict` if there is one."""
        target, draft = f"{self.folder}/{number:08d}.json", f"{self.folder}/_{uuid.uuid4().hex}"
        self._fs.mkdirs(self._path(self.folder))
        text = json.dumps(what | {"number": number})
        plain = local_path(self.folder)
        if plain is not None:
            hidden = os.path.join(plain, os.path.basename(draft))
            with open(hidden, "w") as f:
                f.write(text)
            try:
                os.link(hidden, os.path.join(plain, os.path.basename(target)))
            except FileExistsError:
                raise Conflict(f"commit {number} was claimed by another writer") from None
            finally:
                os.remove(hidden)
            return
        out = self._fs.create(self._path(draft), False)
        out.write(bytearray(text.encode()))
        out.close()
        if self._fs.exists(self._path(target)) or not self._fs.rename(self._path(draft), self._path(target)):
            self._fs.delete(self._path(draft), False)
            raise Conflict(f"commit {number} was claimed by another writer")

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def folders(self, parent: str) -> list[str]:
        at = self._path(parent)
        return [f.getPath().getName() for f in self._fs.listStatus(at) if f.isDirectory()] if self._fs.exists(at) else []
