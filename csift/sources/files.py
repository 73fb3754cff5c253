"""Files as rows of (path, content), or of (path, read_error)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, content string"


def from_text(spark: SparkSession, text: str, path: str = "source.c") -> DataFrame:
    return spark.createDataFrame([(path, text)], SCHEMA)


def from_table(table: DataFrame, path: str, content: str, partitions: int | None = None) -> DataFrame:
    """Any table of documents as files; dealt out to so many partitions if the table has few large ones."""
    out = table.select(F.col(path).cast("string").alias("path"), F.col(content).cast("string").alias("content"))
    return out.repartition(partitions) if partitions else out


def from_lake(spark: SparkSession, location: str) -> DataFrame:
    """Files that Spark reads itself, from any store it knows; names that begin with _ or . are left out by its readers."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[cChH]").load(location)
    return read.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def relative(path: Column, location: str) -> Column:
    """Paths as they stand under a location; stores write it with one slash or three after the scheme."""
    plain = lambda x: F.regexp_replace(x, r"^([A-Za-z][A-Za-z0-9+.-]*:)/*", "$1/")
    base = re.sub(r"^([A-Za-z][A-Za-z0-9+.-]*:)/*", r"\1/", location.rstrip("/")) + "/"
    return F.when(plain(path).startswith(base), F.substr(plain(path), F.lit(len(base) + 1))).otherwise(path)
