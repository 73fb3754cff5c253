"""An extension: scans files as they arrive in a folder, a micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from csift.plans.scan import ScanConfig, scan_files


def file_stream(spark: SparkSession, location: str, most_files: int = 1000) -> DataFrame:
    """path and content of files under a location, each once."""
    read = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[cChH]").option("maxFilesPerTrigger", most_files)
    return read.load(location).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def scan_stream(files: DataFrame, output: str, checkpoint: str, config: ScanConfig = ScanConfig()) -> StreamingQuery:
    """Findings of each batch as Parquet under output, in a folder of its number: a batch that is repeated overwrites its own."""

    def batch(part: DataFrame, number: int) -> None:
        scan = scan_files(part, config)
        scan.findings.write.mode("overwrite").parquet(f"{output}/batch={number}")
        scan.unpersist()

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
