"""Stored results brought up to date: what a store has is reused, what it lacks is computed, and both are published in one step.

A store is a folder: data of each update in a folder of its own, and numbered manifests that name the
folders which count.  An update writes its rows first, then a manifest with the next number, which
can be created only once; readers take the newest whole manifest.  So a failed or repeated task or job
leaves a folder that no manifest names, and nothing else.  Of two updates at a time the one that comes
second finds the number taken, leaves out what the first has published meanwhile, and takes the next.

Rows without key are not stored; of computed rows that share a key all are kept.  An update that
computes nothing publishes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Store:
    def __init__(self, spark: SparkSession, root: str, key: str) -> None:
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    def _at(self, path: str) -> tuple[Any, Any]:
        """The file system of a path in the store, and the path there."""
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return at.getFileSystem(conf), at

    def _names(self, folder: str) -> list[str]:
        files, at = self._at(folder)
        return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []

    def versions(self) -> list[int]:
        """Numbers of manifests, whole or not."""
        return [int(n[1:]) for n in self._names("manifests") if n.startswith("v")]

    def folders(self, version: int) -> list[str] | None:
        """The folders that a manifest names, None if it was cut off."""
        lines = [r.value for r in self.spark.read.text(f"{self.root}/manifests/v{version:09d}").collect()]
        return lines[:-1] if lines and lines[-1] == f"end {len(lines) - 1}" else None

    def current(self) -> list[str]:
        for version in reversed(self.versions()):
            found = self.folders(version)
            if found is not None:
                return found
        return []

    def read(self, names: list[str] | None = None) -> DataFrame | None:
        """All stored rows, or those of some folders; None where there are none."""
        names = self.current() if names is None else names
        return self.spark.read.parquet(*[f"{self.root}/data/{n}" for n in names]) if names else None

    def missing(self, wanted: DataFrame, names: list[str] | None = None) -> DataFrame:
        """The wanted rows whose key isn't stored."""
        wanted, stored = wanted.where(F.col(self.key).isNotNull()), self.read(names)
        return wanted if stored is None else wanted.join(stored.select(self.key).distinct(), self.key, "left_anti")

    def looked_up(self, wanted: DataFrame) -> DataFrame | None:
        """The stored rows of the wanted keys."""
        stored = self.read()
        return None if stored is None else stored.join(wanted.select(self.key).distinct(), self.key, "left_semi")

    def _published(self, names: list[str], version: int) -> bool:
        """Creates a manifest; False if its number is taken."""
        files, at = self._at(f"manifests/v{version:09d}")
        files.mkdirs(at.getParent())
        try:
            out = files.create(at, False)
        except Exception as e:
            if "AlreadyExists" in str(e) or files.exists(at):
                return False
            raise
        out.write(bytearray("\n".join([*names, f"end {len(names)}"]).encode()))
        out.close()
        return True

    def updated(self, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> int:
        """Computes what the store lacks of the wanted rows, from those rows, and publishes it; the number of new rows."""
        version, before = max(self.versions(), default=0) + 1, self.current()
        rows = compute(self.missing(wanted, before)).where(F.col(self.key).isNotNull())
        while True:
            name = uuid.uuid4().hex
            rows.write.parquet(f"{self.root}/data/{name}")
            new = self.spark.read.parquet(f"{self.root}/data/{name}")
            count = new.count()
            if not count:
                self._removed(name)
                return 0
            if self._published([*before, name], version):
                return count
            # another update came first: what it has is left out
            version, before = max(self.versions()) + 1, self.current()
            rows = self.missing(new, before)

    def _removed(self, name: str) -> None:
        files, at = self._at(f"data/{name}")
        files.delete(at, True)

    def cleaned(self) -> int:
        """Deletes the folders that no manifest names, which failed updates left; not while another update runs."""
        used = {n for v in self.versions() for n in self.folders(v) or ()}
        lost = [n for n in self._names("data") if n not in used]
        for n in lost:
            self._removed(n)
        return len(lost)
