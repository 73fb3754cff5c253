"""Baselines as versions of one table that is bucketed by fingerprint.

A version adds only what changed: a row for each fingerprint whose count differs from the version before, 0 where it is gone.
A fingerprint's rows lie in one bucket, so the state at a version, the difference of two versions and a scan's join with a
baseline read buckets as they are, without another shuffle of the store. A version's rows are dealt out by bucket
before they are written, one file a bucket.

Defined results: version 0 is empty; findings without a fingerprint don't count; saving what is there already adds a
version without rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from csift.operators.baseline import fingerprint_counts

BUCKETS = 64


class Snapshots:
    """A store at a location that all executors share, under a table name of this session."""

    def __init__(self, spark: SparkSession, name: str, location: str, buckets: int = BUCKETS):
        if not re.fullmatch(r"\w+", name):
            raise ValueError(f"no table name: {name!r}")
        self.spark, self.name, self.buckets = spark, name, buckets
        quoted = location.replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (fingerprint STRING, count BIGINT, version INT) USING parquet CLUSTERED BY (fingerprint) INTO {buckets} BUCKETS LOCATION '{quoted}'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name}_versions (version INT) USING parquet LOCATION '{quoted}_versions'")

    def latest(self) -> int:
        return self.spark.table(f"{self.name}_versions").agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def state(self, version: int) -> DataFrame:
        """fingerprint and count at a version."""
        rows = self.spark.table(self.name).filter(F.col("version") <= version)
        return rows.groupBy("fingerprint").agg(F.max_by("count", "version").alias("count")).filter("count > 0")

    def save(self, found: DataFrame) -> int:
        """Adds the findings' fingerprints as a version, and returns its number."""
        version = self.latest() + 1
        changed = self.compared(self.state(version - 1), fingerprint_counts(found)).filter("before <> after")
        rows = changed.select("fingerprint", F.col("after").alias("count"), F.lit(version).alias("version"))
        rows.repartition(self.buckets, "fingerprint").write.insertInto(self.name)
        self.spark.createDataFrame([(version,)], "version int").write.insertInto(f"{self.name}_versions")
        return version

    @staticmethod
    def compared(before: DataFrame, after: DataFrame) -> DataFrame:
        """fingerprint, before and after (counts) of every fingerprint of either."""
        a, b = before.select("fingerprint", F.col("count").alias("before")), after.select("fingerprint", F.col("count").alias("after"))
        return a.join(b, "fingerprint", "full").fillna(0, ["before", "after"])

    def difference(self, old: int, new: int) -> DataFrame:
        """fingerprint, added and resolved of those whose count differs between two versions."""
        rows = self.compared(self.state(old), self.state(new)).filter("before <> after")
        return rows.select("fingerprint", F.greatest(F.col("after") - F.col("before"), F.lit(0)).alias("added"), F.greatest(F.col("before") - F.col("after"), F.lit(0)).alias("resolved"))

    def drop(self) -> None:
        """Forgets the tables; their files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_versions")
