"""Groups of tables that are replaced as one: versions in folders, and a marker that makes one the current.

Everything of a version is written below a folder of its own. Then its marker, an empty file, is
created, which is one operation on every file system. Readers take the newest marked version,
so they see the old tables until the new ones are complete, and whatever a failed writer left is never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

MARKERS = "_versions"


class Folder:
    """Names, marks and deletions below one folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.path = path
        self._files = self._path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def names(self, below: str = "") -> list[str]:
        at = self._path(f"{self.path}/{below}" if below else self.path)
        if not self._files.exists(at):
            return []
        return sorted(status.getPath().getName() for status in self._files.listStatus(at))

    def exists(self, name: str) -> bool:
        return self._files.exists(self._path(f"{self.path}/{name}"))

    def mark(self, name: str) -> None:
        """Creates an empty file; fails if it is there."""
        self._files.create(self._path(f"{self.path}/{name}"), False).close()

    def delete(self, name: str) -> None:
        self._files.delete(self._path(f"{self.path}/{name}"), True)


class Versions:
    """The versions below one folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.folder = Folder(spark, path)

    def names(self) -> list[str]:
        """Complete versions, the oldest first."""
        return self.folder.names(MARKERS)

    def current(self) -> str | None:
        """Folder of the newest complete version."""
        names = self.names()
        return f"{self.folder.path}/{names[-1]}" if names else None

    def begin(self) -> str:
        """Folder of a version to write. Writers at the same time get folders of their own; the one
        with the larger name wins, whichever commits last."""
        numbers = [int(n.split("-")[0][1:]) for n in self.names()]
        return f"{self.folder.path}/v{max(numbers, default=0) + 1:012d}-{uuid.uuid4().hex[:12]}"

    def commit(self, version: str, keep: int = 2) -> None:
        """Makes `version` complete and deletes all but the newest `keep` of the complete ones.

        A reader that began before is safe as long as its version is among those.
        """
        self.folder.mark(f"{MARKERS}/{version.rsplit('/', 1)[1]}")
        for name in self.names()[:-keep]:
            # First the marker: a version without one is never read.
            self.folder.delete(f"{MARKERS}/{name}")
            self.folder.delete(name)
