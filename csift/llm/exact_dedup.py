"""Exact dedup with a split of heavy hitters.

A Misra-Gries summary (Spark's `approx_top_k`, a DataSketches frequent-items sketch, which is Misra-Gries with a
median decrement) finds digests that may be frequent, in one pass with map-side partial summaries of a fixed size.
An exact count over just these candidates verifies them and finds the row that stays. The verified winners, `HEAVY`
at most, are broadcast, and their rows are decided where they lie. A digest that the summary did not report has fewer
than 1/HEAVY of all rows, so the remaining digests go through an ordinary shuffle of narrow rows.

Defined results: null text equals the empty text; of equal texts the largest doc_id stays, a null doc_id is the
smallest; of repeated rows (same doc_id and text) one stays; an empty table gives an empty result. Other columns pass
through, whatever their names (names that begin with `_csift_` are ours).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from csift.llm.common import durable, row_identity, whole_text

#: Digests that the summary may report, and counters that it keeps.
HEAVY = 1000
COUNTERS = 8192


def digest_column(text: str = "text"):
    return F.sha2(whole_text(text), 256)


def frequent_digests(digests: DataFrame, column: str, heavy: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """At most `heavy` candidates, by a Misra-Gries summary with `counters` counters."""
    summary = digests.agg(F.expr(f"approx_top_k({column}, {heavy}, {counters})").alias("top"))
    return summary.select(F.explode("top").alias("top")).select(F.col("top.item").alias(column))


def verified_winners(digests: DataFrame, heavy: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """_csift_digest, _csift_n, _csift_best (doc_id and row of the row that stays) of candidates that really repeat."""
    candidates = frequent_digests(digests, "_csift_digest", heavy, counters)
    return durable(
        digests.join(F.broadcast(candidates), "_csift_digest", "left_semi")
        .groupBy("_csift_digest")
        .agg(F.count(F.lit(1)).alias("_csift_n"), F.max(F.struct("doc_id", "_csift_row")).alias("_csift_best"))
        .filter("_csift_n > 1")
    )


def narrow_digests(docs: DataFrame) -> DataFrame:
    return durable(docs.select("doc_id", digest_column().alias("_csift_digest"), row_identity().alias("_csift_row")))


def exact_copies(docs: DataFrame, heavy: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of each row."""
    digests = narrow_digests(docs)
    winners = verified_winners(digests, heavy, counters)
    split = digests.join(F.broadcast(winners), "_csift_digest", "left")
    same = Window.partitionBy("_csift_digest")
    rest = (
        split.filter("_csift_n is null")
        .withColumn("_csift_n", F.count(F.lit(1)).over(same))
        .withColumn("_csift_best", F.max(F.struct("doc_id", "_csift_row")).over(same))
    )
    return split.filter("_csift_n is not null").unionByName(rest).select(
        "doc_id",
        F.col("_csift_best.doc_id").alias("keep_id"),
        F.col("_csift_n").alias("group_size"),
        (F.col("_csift_row") == F.col("_csift_best._csift_row")).alias("kept"),
        F.col("_csift_digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, heavy: int = HEAVY, counters: int = COUNTERS) -> DataFrame:
    """docs with one row of each text, all columns.

    Rows of frequent texts leave where they are read; only a frequent text's candidates for staying, and the other
    rows, are shuffled.
    """
    winners = verified_winners(narrow_digests(docs), heavy, counters).select(
        "_csift_digest", F.col("_csift_best.doc_id").alias("_csift_keep"), F.lit(True).alias("_csift_heavy")
    )
    split = docs.withColumn("_csift_digest", digest_column()).join(F.broadcast(winners), "_csift_digest", "left")
    staying = split.filter(F.col("_csift_heavy").isNull() | F.col("doc_id").eqNullSafe(F.col("_csift_keep")))
    first = Window.partitionBy("_csift_digest").orderBy(F.col("doc_id").desc_nulls_last())
    return staying.withColumn("_csift_nth", F.row_number().over(first)).filter("_csift_nth = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
