"""A batch source of version-control facts: visible files, commits and patch ids of a local repository."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_SCHEMAS = {"files": "file string", "log": "sha string, author string, at long, subject string", "patches": "sha string, patch string"}


def run(root: str, *arguments: str, stdin: str | None = None) -> str:
    """The output of a git command in a repository; empty if it fails."""
    done = subprocess.run(["git", "-C", root, *arguments], capture_output=True, text=True, errors="replace", input=stdin, timeout=120)
    return done.stdout if done.returncode == 0 else ""


class GitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.what, self.range = options["path"], options.get("what", "files"), options.get("range", "HEAD")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if self.what == "files":
            listed = run(self.root, "ls-files", "-z", "--cached", "--others", "--exclude-standard")
            yield from ((f,) for f in sorted({f for f in listed.split("\0") if f}))
        elif self.what == "log":
            for record in run(self.root, "log", "--format=%H%x1f%an%x1f%at%x1f%s%x1e", self.range).split("\x1e"):
                parts = record.strip().split("\x1f")
                if len(parts) == 4:
                    yield parts[0], parts[1], int(parts[2]), parts[3]
        else:
            for line in run(self.root, "patch-id", "--stable", stdin=run(self.root, "log", "-p", "--format=commit %H", self.range)).splitlines():
                patch, sha = line.split()
                yield sha, patch


class GitSource(DataSource):
    """``spark.read.format("git").option("what", "files" | "log" | "patches").load(root)`` after ``spark.dataSource.register(GitSource)``."""

    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return _SCHEMAS[self.options.get("what", "files")]

    def reader(self, schema) -> GitReader:
        return GitReader(self.options)
