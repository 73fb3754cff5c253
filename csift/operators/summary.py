"""Sums over findings and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from csift.functions.lexing import split_lines

STATUSES = ("parsed", "fallback-parser", "regex", "parse-failed")


def severity_counts() -> list[Column]:
    return [F.count("rule_id").alias("issues_count"), *[F.count(F.when(F.col("impact") == s, 1)).alias(f"{s.lower()}_count") for s in ("High", "Medium", "Low")]]


def file_summaries(parses: DataFrame, found: DataFrame) -> DataFrame:
    """One row a file, clean ones too: lines of code, counts by severity, how it was parsed."""
    files = parses.select(
        F.col("path").alias("file_path"), F.size(split_lines(F.col("content"))).alias("lines_of_code"), F.when(F.col("error").isNull(), "success").otherwise("failed").alias("status"),
        F.col("parse.status").alias("parser"), F.col("parse.confidence").alias("confidence"), F.col("parse.parse_tier").alias("parse_tier"),
    )
    counts = found.groupBy("file_path").agg(*severity_counts())
    zero = {c: 0 for c in ("issues_count", "high_count", "medium_count", "low_count")}
    return files.join(counts, "file_path", "left").fillna(zero)


def totals(summaries: DataFrame) -> DataFrame:
    """One row over all files. Info findings count in the total only."""
    sums = ("lines_of_code", "issues_count", "high_count", "medium_count", "low_count")
    return summaries.agg(
        F.count(F.lit(1)).alias("files_discovered"), F.count(F.when(F.col("status") == "success", 1)).alias("files_analyzed"), F.count(F.when(F.col("status") == "failed", 1)).alias("files_failed"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums],
    )


def status_histogram(summaries: DataFrame) -> DataFrame:
    """(status, files) with a row for every status."""
    spark = summaries.sparkSession
    every = spark.range(1).select(F.explode(F.array(*map(F.lit, STATUSES))).alias("status"))
    counts = summaries.groupBy(F.col("parser").alias("status")).agg(F.count(F.lit(1)).alias("files"))
    return every.join(counts, "status", "left").fillna({"files": 0})


def overall_status(counts: dict[str, int]) -> tuple[str, str]:
    """(parser status, analysis status) of a whole scan."""
    some = [s for s in STATUSES if counts.get(s)]
    failed = counts.get("parse-failed", 0)
    done = sum(counts.values()) - failed
    analysis = "success" if not failed else "partial_success" if done else "failed"
    good = [s for s in some if s != "parse-failed"]
    if not some:
        return "none", analysis
    if not good:
        return "parse-failed", analysis
    names = {"parsed": "parser", "fallback-parser": "fallback-parser", "regex": "regex"}
    return ("hybrid" if len(good) > 1 else names[good[0]]), analysis


def severity_rollup(found: DataFrame) -> DataFrame:
    """Findings by severity and rule, with sums (null) over rules and over all."""
    return found.rollup("impact", "rule_id").agg(F.count(F.lit(1)).alias("n"))


def precision_recall(expected: DataFrame, reported: DataFrame) -> DataFrame:
    """(path, line, rule_id) sets compared: one row with expected, matched, missing and unexpected."""
    keys = ["path", "line", "rule_id"]
    e = expected.select(*keys).distinct().withColumn("_e", F.lit(1))
    r = reported.select(*keys).distinct().withColumn("_r", F.lit(1))
    return e.join(r, keys, "full_outer").agg(
        F.count("_e").alias("expected"), F.count(F.when(F.col("_e").isNotNull() & F.col("_r").isNotNull(), 1)).alias("matched"),
        F.count(F.when(F.col("_r").isNull(), 1)).alias("missing"), F.count(F.when(F.col("_e").isNull(), 1)).alias("unexpected"),
    )
