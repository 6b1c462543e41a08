"""Tables that change by whole snapshots, switched by one rename.

Data are written to folders of their own beside the current ones. A snapshot is a small manifest that names its folders; it is
written under another name and renamed to the next version, which is the one step that readers can see. A writer that dies leaves folders
and half a manifest that no version names: readers go on with the last good version, and ``recover`` deletes the rest.
Two writers of one version don't mix: the second rename finds the name taken and fails.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer made the version first."""


class Snapshots:
    """The versions of one table or index under a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(""))] if self._fs.exists(self._path("")) else []

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, name: str, text: str) -> None:
        out = self._fs.create(self._path(name))
        out.write(bytearray(text.encode()))
        out.close()

    def _versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self._names() if n.startswith("v") and n.endswith(".json"))

    def version(self) -> int:
        """The last good version, 0 if there is none."""
        return max(self._versions(), default=0)

    def current(self, version: int | None = None) -> dict | None:
        """The manifest of a version, the last one unless another is asked for; None if there is none."""
        found = self.version() if version is None else version
        return json.loads(self._text(f"v{found}.json")) if found else None

    def last_good(self) -> float | None:
        """When the last good snapshot was made, in seconds since 1970."""
        now = self.current()
        return now and now["at"]

    def folder(self) -> str:
        """A new folder for data of the next version."""
        return f"{self.root}/data-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, by: tuple[str, ...] = ()) -> str:
        """df as Parquet in a new folder, which no reader sees before ``commit`` names it."""
        path = self.folder()
        df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
        name = path.rsplit("/", 1)[1]
        # A table without rows has no file to tell its columns.
        self._put(f"{name}/_schema", df.schema.json())
        return name

    def read(self, folder: str) -> DataFrame:
        """The rows of a folder that a manifest names."""
        return self.spark.read.schema(StructType.fromJson(json.loads(self._text(f"{folder}/_schema")))).parquet(f"{self.root}/{folder}")

    def commit(self, folders: dict, base: int, **facts) -> int:
        """Make the version after ``base`` the current one: a manifest of folders (name: folder or list of them) and facts about them."""
        version, draft = base + 1, f"draft-{uuid.uuid4().hex}"
        self._put(draft, json.dumps({"version": version, "at": time.time(), "folders": folders, **facts}))
        if self._fs.exists(self._path(f"v{version}.json")) or not self._fs.rename(self._path(draft), self._path(f"v{version}.json")):
            self._fs.delete(self._path(draft), False)
            raise Conflict(f"version {version} of {self.root} is there already")
        return version

    def _named(self, manifest: dict) -> set[str]:
        return {f for v in manifest["folders"].values() for f in ([v] if isinstance(v, str) else v)}

    def recover(self, keep: int = 1) -> list[str]:
        """Delete what the last ``keep`` versions don't name, what a dead writer left included; the names that went."""
        kept = self._versions()[-keep:]
        alive = {f"v{k}.json" for k in kept}.union(*(self._named(self.current(k)) for k in kept)) if kept else set()
        gone = [n for n in self._names() if n not in alive and (n.startswith(("data-", "draft-")) or n.startswith("v") and n.endswith(".json"))]
        for name in gone:
            self._fs.delete(self._path(name), True)
        return sorted(gone)

    def seed(self, sibling: "Snapshots") -> bool:
        """Begin with a copy of a sibling's last good snapshot, so that only what differs has to be written; False if either has no use for it."""
        other = sibling.current()
        if self.version() or other is None:
            return False
        conf = self.spark._jsc.hadoopConfiguration()
        for name in sorted(self._named(other)):
            self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(sibling._fs, sibling._path(name), self._fs, self._path(name), False, conf)
        facts = {k: v for k, v in other.items() if k not in ("version", "at", "folders")}
        self.commit(other["folders"], 0, **facts)
        return True

    def drop(self) -> None:
        """Delete all versions."""
        self._fs.delete(self._path(""), True)
