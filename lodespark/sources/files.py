"""The data source repo_files: the files of a repository as rows (path, content, ord).

Spark's own file sources leave out hidden and empty files; this one lists every regular file but those of
version-control and build folders, and partitions read their own share.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SKIPPED, INNER = (".git/", ".gradle/", "build/", "target/"), ("/build/", "/target/")


def kept(path: str) -> bool:
    return not path.startswith(SKIPPED) and not any(x in path for x in INNER)


def inventory(root: str) -> Iterator[tuple[str, int]]:
    """(path, bytes) of the regular files below root; folders that are left out are not entered."""
    for folder, folders, names in os.walk(root):
        at = os.path.relpath(folder, root).replace(os.sep, "/")
        at = "" if at == "." else at + "/"
        folders[:] = sorted(d for d in folders if kept(f"{at}{d}/"))
        for name in sorted(names):
            if kept(at + name) and os.path.isfile(whole := os.path.join(folder, name)):
                yield at + name, os.path.getsize(whole)


class _Part(InputPartition):
    def __init__(self, paths: list[tuple[int, str]]) -> None:
        super().__init__(None)
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.size = options["path"], int(options.get("partitionBytes", 16 << 20))
        self.suffixes = tuple(s for s in options.get("suffixes", "").split(",") if s)

    def partitions(self) -> list[_Part]:
        parts, paths, size = [], [], 0
        for place, (path, n) in enumerate(sorted(inventory(self.root)), 1):
            if self.suffixes and not path.endswith(self.suffixes):
                continue
            paths.append((place, path))
            size += n + 4096
            if size >= self.size:
                parts.append(_Part(paths))
                paths, size = [], 0
        return parts + [_Part(paths)] if paths or not parts else parts

    def read(self, partition: _Part) -> Iterator[tuple[str, str, int]]:
        for place, path in partition.paths:
            with open(os.path.join(self.root, path), "rb") as f:
                yield path, f.read().decode("utf-8", "replace"), place


class RepoFiles(DataSource):
    """Options: path, partitionBytes, and suffixes (comma-separated), by which files are left out before they are read."""

    @classmethod
    def name(cls) -> str:
        return "repo_files"

    def schema(self) -> str:
        return "path string, content string, ord long"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001, ARG002
        return _Reader(dict(self.options))


def read_files(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """(path, content, ord), ord being the place by path, which the listing knows: no shuffle of the contents."""
    spark.dataSource.register(RepoFiles)
    return spark.read.format("repo_files").options(path=root, **options).load()
