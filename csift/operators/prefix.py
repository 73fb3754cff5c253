"""Segmented prefix sums and ranks whose groups may be larger than a task.

A group's rows are dealt out into pieces that follow each other. The first pass sums each piece; a window over the sums
(one row a piece) gives each piece its offset; the second pass sums within pieces and adds the offset. So no window
holds more than a piece, however many rows a group has.

`running` takes a dense position (a line's number, a turn's place) and cuts pieces by it. `ranked` takes any order: rows
are sorted by range over keys and order together, and each part of the sorted table is a piece of the groups it holds.
Only the first group of a part can have begun in another, so there are at most as many offsets as parts.

Null keys are keys. Rows that tie in `ranked` get ranks in any order. Names that begin with `_csift_` are ours.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from csift.operators.durable import durable

#: Positions of a piece.
PIECE = 1 << 14


def _same(rows: DataFrame, offsets: DataFrame, keys: Sequence[str]) -> Column:
    out = rows["_csift_piece"] == offsets["_csift_at"]
    for i, key in enumerate(keys):
        out = out & rows[key].eqNullSafe(offsets[f"_csift_key{i}"])
    return out


def _offsets(rows: DataFrame, keys: Sequence[str], sums: Mapping[str, str]) -> DataFrame:
    """A row for each piece of each group: what the group's earlier pieces sum to, null in its first."""
    totals = rows.groupBy(*[F.col(f"`{k}`").alias(f"_csift_key{i}") for i, k in enumerate(keys)], F.col("_csift_piece").alias("_csift_at")).agg(*[F.sum(f"`{v}`").alias(f"_csift_sum{j}") for j, v in enumerate(sums.values())])
    earlier = Window.partitionBy(*[f"_csift_key{i}" for i in range(len(keys))]).orderBy("_csift_at").rowsBetween(Window.unboundedPreceding, -1)
    summed = totals.withColumns({f"_csift_before{j}": F.sum(f"_csift_sum{j}").over(earlier) for j in range(len(sums))} | {"_csift_later": F.count(F.lit(1)).over(earlier) > 0})
    return summed.drop(*[f"_csift_sum{j}" for j in range(len(sums))])


def _summed(rows: DataFrame, keys: Sequence[str], order: Sequence, sums: Mapping[str, str], offsets: DataFrame, columns: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    within = Window.partitionBy(*[f"`{k}`" for k in keys], "_csift_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({f"_csift_local{j}": F.sum(f"`{v}`").over(within) for j, v in enumerate(sums.values())})
    joined = local.join(offsets, _same(local, offsets, keys), "left")
    return joined.select(*[local[f"`{c}`"] for c in columns], *[(F.col(f"_csift_local{j}") + F.coalesce(F.col(f"_csift_before{j}"), F.lit(0))).alias(name) for j, name in enumerate(sums)], *[offsets[f"`{c}`"] for c in more])


def running(df: DataFrame, keys: Sequence[str], position: str, sums: Mapping[str, str], piece: int = PIECE) -> DataFrame:
    """df with a column for each of `sums` (name: summed column): the sum over the group's rows up to this position.

    Positions are distinct within a group and nearly dense; df is read twice.
    """
    rows = df.withColumn("_csift_piece", F.floor(F.col(f"`{position}`") / piece))
    return _summed(rows, keys, [F.col(f"`{position}`")], sums, _offsets(rows, keys, sums).filter("_csift_later"), df.columns)


def in_range_pieces(df: DataFrame, keys: Sequence[str], order: Sequence[Column], parts: int | None = None) -> tuple[DataFrame, list[Column]]:
    """df sorted by range over keys and order, kept, with _csift_piece, the part that a row lies in; and the whole order.

    Rows that tie are told apart by a number of their own, so that many equal ones are dealt out as well. Of the groups
    in a part only the first can have begun in another.
    """
    rows = df.withColumn("_csift_row", F.monotonically_increasing_id())
    by = [*[F.col(f"`{k}`") for k in keys], *order, F.col("_csift_row")]
    return durable(rows.repartitionByRange(*([parts] if parts else []), *by).withColumn("_csift_piece", F.spark_partition_id())), [*order, F.col("_csift_row")]


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "nth", parts: int | None = None, values: DataFrame | None = None) -> DataFrame:
    """df with each row's rank in its group, from 1. df is sorted by range once and kept in the checkpoint folder.

    `values` has a row a group at most; its other columns are added, null where a group has none. They are joined with the
    groups' pieces and go to rows from there, so that a hot group's rows are many keys of that join.
    """
    rows, order = in_range_pieces(df, keys, order, parts)
    rows, sums = rows.withColumn("_csift_one", F.lit(1).cast("long")), {name: "_csift_one"}
    offsets = _offsets(rows, keys, sums)
    if values is None:
        # Not more rows than parts, for of a part's groups only the first has earlier pieces.
        return _summed(rows, keys, order, sums, F.broadcast(offsets.filter("_csift_later")), df.columns)
    more = [c for c in values.columns if c not in keys]
    given = values.withColumnsRenamed({k: f"_csift_given{i}" for i, k in enumerate(keys)})
    same = reduce(and_, [F.col(f"_csift_key{i}").eqNullSafe(F.col(f"_csift_given{i}")) for i in range(len(keys))])
    return _summed(rows, keys, order, sums, offsets.join(given, same, "left").drop(*[f"_csift_given{i}" for i in range(len(keys))]), df.columns, more)
