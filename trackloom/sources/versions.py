"""A table of which readers see whole versions only."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import SparkSession


class Versions:
    """Versions of a table in a folder, each in a folder of its own; the newest that has been committed is the table.

    A commit is the creation of one empty file, so there is no moment without a table, and a writer that fails leaves the old one as it is. The
    version before the newest stays until the next commit, for readers that have just begun; all before it, and what writers
    that failed over a day ago left, are deleted then.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _at(self, name: str):
        return self._path(f"{self.path}/{name}")

    def _names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._at(folder))) if self.fs.exists(self._at(folder)) else []

    def committed(self) -> list[str]:
        return self._names("commits")

    def current(self) -> str | None:
        """The folder of the table; None if nothing has been committed."""
        done = self.committed()
        return f"{self.path}/versions/{done[-1]}" if done else None

    def begin(self) -> str:
        """The name of a new version; names are in order of time, and after all that are committed."""
        now, last = time.time_ns() // 1000, self.committed()[-1:]
        return f"{max([now, *[int(n[:20]) + 1 for n in last]]):020d}-{uuid.uuid4().hex[:12]}"

    def folder(self, name: str) -> str:
        return f"{self.path}/versions/{name}"

    def commit(self, name: str) -> None:
        if not self.fs.exists(self._at(f"versions/{name}")):
            raise FileNotFoundError(f"version {name} has not been written")
        self.fs.create(self._at(f"commits/{name}"), False).close()
        done = self.committed()
        kept, old = set(done[-2:]), f"{time.time_ns() // 1000 - 24 * 3600 * 10**6:020d}"
        for n in self._names("versions"):
            if n not in kept and (n in done or n < old):
                self.fs.delete(self._at(f"versions/{n}"), True)
        for n in done[:-2]:
            self.fs.delete(self._at(f"commits/{n}"), False)

    def abort(self, name: str) -> None:
        self.fs.delete(self._at(f"versions/{name}"), True)
