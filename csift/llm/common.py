"""What the operators share: durable intermediate tables and bounded Arrow slices."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def durable(df: DataFrame) -> DataFrame:
    """Writes df to the checkpoint folder that all executors share and reads it from there.

    Later reads survive the loss of executors. Spark removes the files with the table if
    spark.cleaner.referenceTracking.cleanCheckpoints is set; the pipeline removes those of each stage itself.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: spark.checkpoint.dir, or in local mode a folder of our own. On a cluster it must be named."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="csift-checkpoint-"))
    return context.getCheckpointDir()


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text"):
    """A null text counts as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def hash_sample(df: DataFrame, column: str, sample: int) -> DataFrame:
    """About `sample` rows of df, or all if it has no more: those whose hash of the column is under a bound.

    No task and no driver gathers more than the sample, however many partitions there are.
    """
    count = df.count()
    if count <= sample:
        return df
    return df.filter(F.pmod(F.xxhash64(column, F.lit(29)), F.lit(1 << 40)) < int((1 << 40) * sample / count))


def text_key(doc_id: str = "doc_id", text: str = "text"):
    """Tells documents apart: a doc_id together with a digest of its text, so that two texts with one doc_id are two."""
    return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.sha2(whole_text(text), 256))


def row_identity():
    """Numbers rows; only of use in a table that is made durable right after."""
    return F.monotonically_increasing_id()


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the named string column holds about most_bytes a slice; one long text is a slice of its own."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for i in range(n):
            if i > begin and held + sizes[i] > most_bytes:
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += int(sizes[i])
        yield batch.slice(begin)
