"""Connected components of a graph that is only ever held in Spark tables.

Large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014): each replaces
edges by edges to the least neighbour and keeps components; they end when every component is a star around its least
node. Each round's tables are durable, so that joins are exchanges that Spark can split where a hub is hot. They are
files and not checkpoints: a checkpoint keeps its plan's estimate of its size, a join's estimate is the product of its
sides', and a round joins two times, so that the estimate's digits grew fourfold with each round, until numbers of
thousands of digits filled the driver. Of files Spark takes the size they have.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from csift.llm.common import drop_folder, durable, shared_folder


def stars(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge to another and isn't its component's least; edges: (a, b), any order."""
    spark, at = edges.sparkSession, f"{shared_folder(edges.sparkSession)}/csift-stars-{uuid.uuid4().hex}"

    def filed(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{at}/{name}")
        return spark.read.schema(df.schema).parquet(f"{at}/{name}")

    try:
        now = filed(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi > lo").distinct(), "0")
        seen, k = None, 0
        while (state := _state(now)) != seen:
            seen, k = state, k + 1
            both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
            least = filed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{k}-least")
            large = filed(both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), f"{k}-large")
            least = filed(large.groupBy("hi").agg(F.min("lo").alias("m")), f"{k}-lower")
            moved = large.join(least, "hi").filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            now = filed(moved.union(least.select("hi", F.col("m").alias("lo"))).distinct(), f"{k}")
        return durable(now.select(F.col("hi").alias("node"), F.col("lo").alias("root")))
    finally:
        drop_folder(spark, at)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
