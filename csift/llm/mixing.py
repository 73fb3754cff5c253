"""Mixing sources to target weights.

Sizes are summed per source (map-side first, so a hot source costs one row a task), targets follow by water-filling
in closed form over the table of sources, and each document is emitted floor(rate) times plus once more with the
probability of the fraction, decided by a hash of its doc_id and the seed. A source has one of SEEDS seeds, each an
odd number that the hash is multiplied by: the one by which the words that it takes come nearest to its target (of
equally near ones the first), so that sources of few documents come near it too, as far as their documents' sizes
allow. No document is shuffled: the table of rates is broadcast while it has at most BROADCAST_SOURCES rows, which is
counted, and joined with salt beyond. Sources are ranked in one task, which sorts one narrow row a source and spills.

Targets: sources by code point (null last) weigh WEIGHTS in turn and share SHARE times all sizes; a target stops at
LIMIT times its source's size, and the excess goes to the others by weight until none is above. That is
min(LIMIT * size, weight * level) with the one level at which the targets sum up to the share.

Defined results: null text has size 0; null source is a source of its own; rows with the same doc_id are decided
alike (a null doc_id by its text); sources of size 0 have target 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from csift.llm.common import WORD, durable, whole_text

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2.0
SEED = 17
SEEDS = 64
#: Seed k multiplies by STEP * k + 1, which is odd, and small enough for 64 bits; hashes have 48.
STEP = 502
HASHES = 1 << 48
BROADCAST_SOURCES = 50_000
SALTS = 64


def size_column(text: str = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def hash_column(seed: int) -> Column:
    """The first 48 bits of a digest of doc_id and seed."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.sha2(whole_text(), 256))
    return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), key), 256), 1, 12), 16, 10).cast("long")


def drawn(hashed: Column, turn: Column) -> Column:
    """Whether the Bernoulli copy is taken: a number in [0, 1) from the hash and the source's seed is under the fraction."""
    uniform = (hashed * (turn * STEP + 1) % HASHES).cast("double") / F.lit(float(HASHES))
    return uniform < F.col("_csift_rate") - F.floor("_csift_rate")


def rates(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """source, source_size, target and rate; sizes has source and size. One row a source."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    everything = Window.partitionBy()
    weighed = sums.withColumn("_csift_place", place).withColumn(
        "_csift_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_csift_place") % len(weights) + 1)
    )
    ordered = Window.orderBy("_csift_fill", "_csift_place")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        weighed.withColumn("_csift_cap", F.col("source_size") * limit)
        .withColumn("_csift_fill", F.col("_csift_cap") / F.col("_csift_weight"))
        .withColumn("_csift_left", F.sum(F.col("source_size")).over(everything) * share - F.coalesce(F.sum("_csift_cap").over(before), F.lit(0.0)))
        .withColumn("_csift_heft", F.sum("_csift_weight").over(everything) - F.coalesce(F.sum("_csift_weight").over(before), F.lit(0.0)))
        .withColumn("_csift_level", F.col("_csift_left") / F.col("_csift_heft"))
        .withColumn("_csift_nth", F.row_number().over(ordered))
        .withColumn("_csift_level", F.min(F.when(F.col("_csift_level") <= F.col("_csift_fill"), F.struct("_csift_nth", "_csift_level"))).over(everything)["_csift_level"])
    )
    target = F.coalesce(F.least("_csift_cap", F.col("_csift_weight") * F.col("_csift_level")), F.col("_csift_cap"))
    return level.select("source", "source_size", target.alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    )


def with_rates(docs: DataFrame, table: DataFrame, broadcast_sources: int = BROADCAST_SOURCES, salts: int = SALTS) -> DataFrame:
    """docs with the table's other columns of their source, named _csift_source_size, _csift_target, _csift_rate, ..."""
    table = table.select(*[F.col(c).alias(f"_csift_{c}") for c in table.columns])
    same = F.col("source").eqNullSafe(F.col("_csift_source"))
    if table.count() <= broadcast_sources:
        return docs.join(F.broadcast(table), same, "left").drop("_csift_source")
    salted = table.withColumn("_csift_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = docs.withColumn("_csift_deal", F.pmod(F.xxhash64("doc_id", "text"), F.lit(salts)).cast("int"))
    return dealt.join(salted, same & (F.col("_csift_deal") == F.col("_csift_salt")), "left").drop("_csift_source", "_csift_salt", "_csift_deal")


def with_turns(sizes: DataFrame, table: DataFrame) -> DataFrame:
    """The table with each source's turn, the number of its seed; sizes has doc_id, source, size, _csift_hash and text."""
    each = with_rates(sizes, table).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(SEEDS - 1))))
    again = F.when(drawn(F.col("_csift_hash"), F.col("turn")), F.col("size")).otherwise(0)
    sums = each.groupBy("source", "turn").agg(F.sum(again).alias("again"))
    apart = F.abs(F.floor("rate") * F.col("source_size") + F.coalesce("again", F.lit(0)) - F.col("target"))
    right = table.withColumnRenamed("source", "_csift_source")
    near = sums.join(right, F.col("source").eqNullSafe(F.col("_csift_source"))).groupBy("source", "source_size", "target", "rate")
    return near.agg(F.min(F.struct(apart.alias("apart"), "turn"))["turn"].alias("turn"))


def copies_column() -> Column:
    return (F.floor("_csift_rate") + F.when(drawn(F.col("_csift_hash"), F.col("_csift_turn")), 1).otherwise(0)).cast("long")


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """Narrow rows, made durable, so that texts are counted once."""
    return durable(docs.select("doc_id", "source", size_column().alias("size"), hash_column(seed).alias("_csift_hash"), F.lit("").alias("text")))


def mixture(docs: DataFrame, seed: int = SEED, **parameters) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and taken of each row."""
    sizes = sized(docs, seed)
    table = durable(with_turns(sizes, durable(rates(sizes, **parameters))))
    return with_rates(sizes, table).withColumn("copies", copies_column()).select(
        "doc_id", "source", "size", F.col("_csift_source_size").alias("source_size"), F.col("_csift_target").alias("target"),
        F.col("_csift_rate").alias("rate"), "copies", (F.col("size") * F.col("copies")).alias("taken"),
    )


def mix(docs: DataFrame, seed: int = SEED, **parameters) -> DataFrame:
    """docs with each row as often as the mix takes it, all columns. A first pass over the texts makes narrow rows for the sums."""
    sizes = sized(docs, seed)
    table = durable(with_turns(sizes, durable(rates(sizes, **parameters))))
    joined = with_rates(docs, table).withColumn("_csift_hash", hash_column(seed)).withColumn("_csift_copies", copies_column())
    return joined.filter("_csift_copies > 0").withColumn("_csift_copy", F.explode(F.sequence(F.lit(1), F.col("_csift_copies").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
