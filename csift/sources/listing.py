"""Listing and reading a source tree by executors.

A tree is listed level by level: the folders of one level are dealt out over tasks, which list each and say what to enter.
What ignore rules prune is never listed. The driver learns only whether there is another level. Files are then dealt out
by their bytes, by prefix sums over the listing, so that no task reads much more than its share but for a larger file.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from csift.operators.durable import durable
from csift.operators.prefix import ranked, running
from csift.sources.ignore import IgnoreRules

EXTENSIONS = (".c", ".h")
#: What a folder's entries are.
FOLDER, FILE, IGNORED = "folder", "file", "ignored"
LISTED = "path string, kind string, size long"
#: Bytes of a task, and what opening a file counts as.
TASK_BYTES, OPEN_BYTES = 32 << 20, 64 << 10


def entries(base: str, folder: str, rules: IgnoreRules) -> Iterator[tuple[str, str, int]]:
    """(path, kind, size) of a folder's files with the extensions, whatever their case, and of folders to be entered.

    A folder that can't be listed has none, nor are links to folders followed.
    """
    try:
        with os.scandir(os.path.join(base, folder)) as found:
            for entry in sorted(found, key=lambda e: e.name):
                path = f"{folder}/{entry.name}" if folder else entry.name
                if entry.is_dir():
                    if not entry.is_symlink() and not rules.prunes(path):
                        yield path, FOLDER, 0
                elif entry.name.lower().endswith(EXTENSIONS):
                    try:
                        size = entry.stat().st_size
                    except OSError:
                        size = 0
                    yield path, IGNORED if rules.ignores(path) else FILE, size
    except OSError:
        return


def list_tree(spark: SparkSession, base: str, rules: IgnoreRules, tasks: int | None = None) -> DataFrame:
    """path (relative), kind (file or ignored) and size of a tree's files."""
    tasks = tasks or spark.sparkContext.defaultParallelism * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                rows = list(entries(base, folder, rules))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], ["path", "kind", "size"])

    levels, frontier = [], spark.createDataFrame([("",)], "path string")
    while not levels or not frontier.isEmpty():
        listed = durable(frontier.repartition(tasks, "path").mapInArrow(run, LISTED))
        levels.append(listed.filter(F.col("kind") != FOLDER))
        frontier = listed.filter(F.col("kind") == FOLDER).select("path")
    return reduce(DataFrame.unionByName, levels)


def dealt(files: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """path and deal: files in order of their paths, a deal's together about task_bytes."""
    cost = ranked(files.select("path", (F.col("size") + OPEN_BYTES).alias("cost")), [], [F.col("path")], "place")
    return running(cost, [], "place", {"upto": "cost"}).select("path", F.floor((F.col("upto") - F.col("cost")) / task_bytes).cast("int").alias("deal"))


def read_listing(listing: DataFrame, base: str, partitions: int | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """path, content and read_error of a listing's files that aren't ignored. Bytes that aren't UTF-8 are replaced."""
    deals = durable(dealt(listing.filter(F.col("kind") == FILE), task_bytes))
    count = partitions or deals.agg(F.coalesce(F.max("deal"), F.lit(0)) + 1).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                content, error = read_text(base, path)
                yield pa.record_batch([pa.array([path]), pa.array([content], pa.string()), pa.array([error], pa.string())], ["path", "content", "read_error"])

    return deals.repartitionByRange(count, "deal").select("path").mapInArrow(run, "path string, content string, read_error string")


def read_text(base: str, path: str) -> tuple[str | None, str | None]:
    """(content, error)"""
    try:
        with open(os.path.join(base, path), encoding="utf-8", errors="replace") as file:
            return file.read(), None
    except OSError as e:
        return None, f"{type(e).__name__}: {e.strerror}"
