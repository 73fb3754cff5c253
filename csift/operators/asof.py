"""As-of join: each use with the nearest declaration before it.

Declarations and uses are put into one relation and sorted by range over key and place. Within a part the nearest declaration
is the last one seen; what a part's first key has of earlier parts is handed over as one row a part. So a name that a third
of all rows have is many tasks, and no pair of a use and a declaration is made but the one that counts.

Defined results: a use without a declaration before it has nulls; of declarations at one place that of the greatest values
counts; null keys are keys; rows with a null place are before all others; a repeated use gives a row again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from csift.operators.prefix import in_range_pieces


def nearest_before(uses: DataFrame, declarations: DataFrame, keys: Sequence[str], at: str, values: Sequence[str], same_place: bool = True, parts: int | None = None) -> DataFrame:
    """uses with `values` of the declaration nearest before; one at the same place counts if `same_place`."""
    key = [F.col(f"`{k}`").alias(f"_csift_key{i}") for i, k in enumerate(keys)]
    names = [f"_csift_key{i}" for i in range(len(keys))]
    later, sooner = (1, 0) if same_place else (0, 1)
    told = F.struct(*[F.col(f"`{v}`") for v in values])
    begun = declarations.select(*key, F.col(f"`{at}`").alias("_csift_place"), F.lit(sooner).alias("_csift_kind"), told.alias("_csift_told"))
    used = uses.select(*key, F.col(f"`{at}`").alias("_csift_place"), F.lit(later).alias("_csift_kind"), F.struct(*[F.col(f"`{c}`") for c in uses.columns]).alias("_csift_use"))
    rows, order = in_range_pieces(begun.unionByName(used, allowMissingColumns=True), names, [F.col("_csift_place"), F.col("_csift_kind"), F.col("_csift_told")], parts)
    last = rows.groupBy(*names, "_csift_piece").agg(F.max_by("_csift_told", F.when(F.col("_csift_told").isNotNull(), F.struct("_csift_place", "_csift_kind", "_csift_told", "_csift_row"))).alias("_csift_last"))
    earlier = Window.partitionBy(*names).orderBy("_csift_piece").rowsBetween(Window.unboundedPreceding, -1)
    # Not more rows than parts, for of a part's keys only the first has earlier pieces.
    handed = last.withColumns({"_csift_handed": F.last("_csift_last", ignorenulls=True).over(earlier), "_csift_later": F.count(F.lit(1)).over(earlier) > 0}).filter("_csift_later")
    handed = F.broadcast(handed.select(*[F.col(n).alias(f"{n}_of") for n in names], F.col("_csift_piece").alias("_csift_at"), "_csift_handed"))
    within = Window.partitionBy(*names, "_csift_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_csift_seen", F.last("_csift_told", ignorenulls=True).over(within)).filter(F.col("_csift_kind") == later)
    same = local["_csift_piece"] == handed["_csift_at"]
    for n in names:
        same = same & local[n].eqNullSafe(handed[f"{n}_of"])
    found = F.coalesce("_csift_seen", "_csift_handed")
    return local.join(handed, same, "left").withColumn("_csift_found", found).select("_csift_use.*", *[F.col(f"_csift_found.`{v}`").alias(v) for v in values])
