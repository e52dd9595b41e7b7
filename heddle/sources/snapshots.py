"""Table state as numbered snapshots, each described by a marker that is written last."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of one appended table before they are rewritten as one.
COMPACT_AT = 64


class SnapshotStore:
    """Named tables under ``path`` (any Hadoop file system) that change together.

    A commit writes its tables whole into folders of their own; the marker ``commits/<n>``,
    written after that, lists each table's folders: a replaced table has new ones, an appended
    table the old ones and one more. Nothing is deleted or overwritten on the way: a run that
    dies at any point leaves the state as it was, and its folders unnamed. One writer at a
    time; a second one that commits the same number fails.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def versions(self) -> list[int]:
        """Numbers of the snapshots there are, in order."""
        folder = self._at("commits")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def version(self) -> int:
        """Number of the latest snapshot; 0 without one."""
        return max(self.versions(), default=0)

    def _marker(self, version: int) -> dict[str, list[str]]:
        return json.loads(self.spark.read.text(f"{self.path}/commits/{version:010d}").first()[0])

    def table(self, name: str = "state", version: int | None = None) -> DataFrame | None:
        """A table as of a snapshot, the latest by default; None if there is none."""
        v = self.version() if version is None else version
        folders = self._marker(v).get(name) if v else None
        return self.spark.read.parquet(*[f"{self.path}/{f}" for f in folders]) if folders else None

    def current(self) -> DataFrame | None:
        return self.table()

    def commit(self, df: DataFrame | None = None, replace: dict[str, DataFrame] | None = None,
        append: dict[str, DataFrame] | None = None) -> int:
        """Write the next snapshot, of the table ``state`` or of several; returns its number."""
        v = self.version() + 1
        marker = self._marker(v - 1) if v > 1 else {}
        for name, rows in {**({} if df is None else {"state": df}), **(replace or {})}.items():
            marker[name] = [self._write(v, name, rows)]
        for name, rows in (append or {}).items():
            old = marker.get(name, [])
            if len(old) >= COMPACT_AT:
                rows, old = self.table(name).unionByName(rows), []
            marker[name] = [*old, self._write(v, name, rows)]
        tmp, at = self._at(f"data/{v:010d}-{uuid.uuid4().hex}.marker"), self._at(f"commits/{v:010d}")
        out = self._fs.create(tmp, True)
        out.write(bytearray((json.dumps(marker) + "\n").encode()))
        out.close()
        self._fs.mkdirs(self._at("commits"))
        if self._fs.exists(at) or not self._fs.rename(tmp, at):
            raise RuntimeError(f"snapshot {v} of {self.path} was committed by another writer")
        return v

    def _write(self, version: int, name: str, rows: DataFrame) -> str:
        folder = f"data/{version:010d}-{name}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def expire(self, keep: int = 2) -> None:
        """Forget all but the latest ``keep`` snapshots; remove what none left refers to."""
        names = self.versions()
        for v in names[: max(0, len(names) - keep)]:
            self._fs.delete(self._at(f"commits/{v:010d}"), False)
        kept = {f.split("/")[1] for v in names[-keep:] for folders in self._marker(v).values() for f in folders}
        if self._fs.exists(self._at("data")):
            for f in self._fs.listStatus(self._at("data")):
                if f.getPath().getName() not in kept:
                    self._fs.delete(f.getPath(), True)
