"""A source tree as a data source of Spark: spark.read.format("csift_tree").option("ignore", ...).load(folder).

Columns: path (relative), size, content and read_error. Filters on path are pushed into the source: they are checked, as
ignore rules are, before a file is opened, and a wanted beginning keeps other folders from being listed. Partitions are folders,
opened until there are about `tasks`; each task lists what is below its own.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from csift.sources.ignore import IgnoreRules
from csift.sources.listing import FILE, FOLDER, entries, read_text

SCHEMA = "path string, size long, content string, read_error string"


@dataclass
class Part(InputPartition):
    """Folders to be walked, and files at hand."""

    folders: list[str]
    files: list[tuple[str, int]]


class TreeReader(DataSourceReader):
    def __init__(self, base: str, rules: IgnoreRules, tasks: int):
        self.base, self.rules, self.tasks, self.tests = base, rules, tasks, []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith, StringContains)) and f.attribute == ("path",):
                self.tests.append(f)
            else:
                yield f

    def wanted(self, path: str) -> bool:
        for f in self.tests:
            told = {EqualTo: lambda v: path == v, In: lambda v: path in v, StringStartsWith: path.startswith, StringEndsWith: path.endswith, StringContains: lambda v: v in path}
            if not told[type(f)](f.value):
                return False
        return True

    def enters(self, folder: str) -> bool:
        """Whether a wanted path can lie in a folder."""
        inside = f"{folder}/"
        for f in self.tests:
            starts = {EqualTo: lambda: (f.value,), In: lambda: tuple(f.value), StringStartsWith: lambda: (f.value,)}.get(type(f))  # noqa: B023
            if starts and not any(s.startswith(inside) or isinstance(f, StringStartsWith) and inside.startswith(s) for s in starts()):
                return False
        return True

    def listed(self, folder: str) -> tuple[list[str], list[tuple[str, int]]]:
        found = list(entries(self.base, folder, self.rules))
        return [p for p, kind, _ in found if kind == FOLDER and self.enters(p)], [(p, size) for p, kind, size in found if kind == FILE and self.wanted(p)]

    def partitions(self) -> list[Part]:
        """Folders are opened level by level while there are fewer than `tasks`; files met on the way are dealt out too."""
        folders, files = [""], []
        while folders and len(folders) < self.tasks:
            below = []
            for folder in folders:
                inner, own = self.listed(folder)
                below += inner
                files += own
            folders = below
        out = [Part(folders[k :: self.tasks], files[k :: self.tasks]) for k in range(self.tasks)]
        return [p for p in out if p.folders or p.files] or [Part([], [])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        folders, files = list(partition.folders), partition.files
        while True:
            for path, size in files:
                content, error = read_text(self.base, path)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size]), pa.array([content], pa.string()), pa.array([error], pa.string())], names=["path", "size", "content", "read_error"])
            if not folders:
                return
            inner, files = self.listed(folders.pop())
            folders += inner


class TreeSource(DataSource):
    """Options: path; ignore (patterns, one a line, after the defaults); tasks."""

    @classmethod
    def name(cls) -> str:
        return "csift_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        base = os.path.abspath(self.options["path"])
        rules = IgnoreRules(self.options.get("ignore", "").splitlines())
        rules.add_file(os.path.join(base, ".csiftignore"))
        return TreeReader(base, rules, int(self.options.get("tasks", "32")))


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets Spark push filters into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
