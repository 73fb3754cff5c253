"""Radix select: each group's k largest values, without sorting a group.

Distributed histograms over the bits of values find each group's kth value, DIGIT bits a round: counts of a digit are summed
where the rows lie, the bin that holds the kth is kept, and only rows in it are counted in the next round. Where more rows
tie at the kth value than are wanted, the same goes on over the UTF-8 bytes of their items, CHUNK bytes a round, from
the first byte in which they differ; so long common beginnings take no rounds. What is selected, k rows a group at most,
is ranked by a window.

Items are distinct within a group; values are from 0 to 2 ** BITS - 1. Joins of rows with their group's state are salted, so a
group may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from csift.llm.common import durable

BITS, DIGIT = 30, 10
CHUNK = 2
SALTS = 16


def salted_join(rows: DataFrame, values: DataFrame, keys: Sequence[str], salt: str, salts: int = SALTS) -> DataFrame:
    """rows with their key's values (a row a key); a key's rows are dealt out by the hash of `salt`. Keys are not null."""
    copies = values.withColumn("_csift_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_csift_salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int")).join(copies, [*keys, "_csift_salt"]).drop("_csift_salt")


def _kth(bins: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Of each group's bins (count, need) the one with its kth row; need becomes how many are wanted of it."""
    upto = F.sum("count").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return bins.withColumn("_upto", upto).filter((F.col("_upto") >= F.col("need")) & (F.col("_upto") - F.col("count") < F.col("need"))).withColumn("need", F.col("need") - F.col("_upto") + F.col("count")).drop("_upto")


def thresholds(rows: DataFrame, keys: Sequence[str], value: str, item: str, k: int, bits: int = BITS, digit: int = DIGIT) -> DataFrame:
    """keys, least (the kth value), need (how many rows at it are wanted) and count (how many there are)."""
    state = durable(rows.groupBy(*keys).agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("need")).withColumns({"least": F.lit(0).cast("long"), "count": F.lit(0).cast("long")}))
    for shift in range(bits - digit, -1, -digit):
        inside = salted_join(rows.select(*keys, F.col(value).alias("_value"), item), state.drop("count"), keys, item).filter(F.shiftright("_value", shift + digit) == F.col("least"))
        bins = inside.groupBy(*keys, "need", F.shiftright("_value", shift).alias("least")).agg(F.count(F.lit(1)).alias("count"))
        state = durable(_kth(bins, keys, F.col("least").desc()))
    return state


def common_bytes(a: Column, b: Column) -> Column:
    """How many bytes two texts have in common at their beginnings."""
    digits = lambda x: F.split(F.hex(F.encode(x, "UTF-8")), "(?<=\\G..)")
    differ = F.zip_with(digits(a), digits(b), lambda x, y: (~x.eqNullSafe(y)).cast("int"))
    return F.when(a == b, F.octet_length(a)).otherwise(F.array_position(differ, F.lit(1)) - 1).cast("int")


def tie_bounds(rows: DataFrame, keys: Sequence[str], value: str, item: str, state: DataFrame) -> DataFrame:
    """state with `bound` and `bytes`: of the rows at `least` those whose item's first `bytes` bytes aren't above it are wanted.

    Null where all rows at `least` are wanted.
    """
    settled = state.filter("count = need").withColumns({"bound": F.lit(None).cast("binary"), "bytes": F.lit(None).cast("int")})
    tied = salted_join(rows.select(*keys, F.col(value).alias("_value"), F.col(item).alias("_item")), state.filter("count > need").drop("count"), keys, "_item").filter("_value = least").drop("_value")
    tied = durable(tied)
    open_ = durable(tied.groupBy(*keys, "least", "need").agg(F.min("_item").alias("_low"), F.max("_item").alias("_high")).withColumn("_held", common_bytes(F.col("_low"), F.col("_high"))))
    found = [settled.select(*keys, "least", "bound", "bytes")]
    while not open_.isEmpty():
        # A chunk begins where the group's items first differ; all that are still in question agree before that.
        raw = F.encode("_item", "UTF-8")
        inside = salted_join(tied.drop("least", "need"), open_, keys, "_item").filter(F.substring(raw, F.lit(1), F.col("_held")) == F.substring(F.encode("_low", "UTF-8"), F.lit(1), F.col("_held")))
        upto = F.col("_held") + CHUNK
        bins = inside.groupBy(*keys, "least", "need", upto.alias("bytes"), F.substring(raw, F.lit(1), upto).alias("bound")).agg(F.count(F.lit(1)).alias("count"), F.min("_item").alias("_low"), F.max("_item").alias("_high"))
        kth = durable(_kth(bins, keys, F.col("bound").asc()))
        found.append(kth.filter("count = need").select(*keys, "least", "bound", "bytes"))
        open_ = durable(kth.filter("count > need").drop("count", "bound", "bytes").withColumn("_held", common_bytes(F.col("_low"), F.col("_high"))))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def top_ranks(rows: DataFrame, keys: Sequence[str], value: str, item: str, k: int) -> DataFrame:
    """Of each group the k rows of the largest values, ties by the item's UTF-8 bytes, with their rank from 1."""
    rows = durable(rows)
    state = tie_bounds(rows, keys, value, item, thresholds(rows, keys, value, item, k))
    at = F.substring(F.encode(item, "UTF-8"), F.lit(1), F.col("bytes"))
    chosen = salted_join(rows, state, keys, item).filter((F.col(value) > F.col("least")) | (F.col(value) == F.col("least")) & (F.col("bound").isNull() | (at <= F.col("bound"))))
    best = Window.partitionBy(*keys).orderBy(F.col(value).desc(), F.col(item))
    return chosen.select(*keys, item, value, F.row_number().over(best).alias("rank"))
