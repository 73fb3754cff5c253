"""Baselines: a multiset of fingerprints that an earlier report had."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from csift.operators.findings import REPORT_ORDER
from csift.operators.prefix import ranked


class BadBaseline(ValueError):
    """The report can't be read as a baseline."""


def read_baseline(spark: SparkSession, path: str) -> tuple[DataFrame, int | None]:
    """(fingerprint, count) of an earlier JSON report, and how many rules it applied if it says so.

    Spark reads the report; the driver gets what it says of itself only.
    """
    applied = "struct<rules_applied_count:int>"
    report = spark.read.schema(f"issues array<struct<fingerprint:string>>, summary {applied}, meta {applied}, _corrupt_record string")
    try:
        rows = report.option("multiLine", True).json(path)
        row = rows.select(F.col("_corrupt_record").isNotNull().alias("broken"), F.col("issues").isNull().alias("empty"), F.coalesce("summary.rules_applied_count", "meta.rules_applied_count").alias("rules")).first()
    except Exception as error:
        raise BadBaseline(f"cannot read baseline {path}") from error
    if row is None or row["broken"]:
        raise BadBaseline(f"baseline {path} is not JSON")
    if row["empty"]:
        raise BadBaseline(f"baseline {path} has no issues")
    return fingerprint_counts(rows.select(F.explode("issues.fingerprint").alias("fingerprint"))), row["rules"]


def fingerprint_counts(found: DataFrame) -> DataFrame:
    """Findings without a fingerprint don't count."""
    return found.filter("coalesce(fingerprint, '') <> ''").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("count"))


def new_findings(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """Multiset difference: in report order, a fingerprint's first findings use up the baseline's count, the others are new.

    Ranks are made over pieces, so a fingerprint that most findings have is many tasks.
    """
    counts = baseline.select("fingerprint", F.col("count").alias("_had"))
    nth = ranked(found, ["fingerprint"], [F.col(c) for c in REPORT_ORDER], "_nth", values=counts)
    return nth.filter(F.col("_nth") > F.coalesce("_had", F.lit(0))).select(*found.columns)


def resolved_count(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row, resolved: how many of the baseline's findings are gone."""
    now = fingerprint_counts(found).withColumnRenamed("count", "_now")
    gone = F.greatest(F.col("count") - F.coalesce("_now", F.lit(0)), F.lit(0))
    return baseline.join(now, "fingerprint", "left").agg(F.coalesce(F.sum(gone), F.lit(0)).alias("resolved"))
