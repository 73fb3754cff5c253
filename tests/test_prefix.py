"""Prefix sums and ranks over pieces, against a pass over sorted rows."""

import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from csift.operators.prefix import ranked, running


@pytest.mark.parametrize("piece", [1, 3, 64, 10_000])
def test_running_sums_do_not_depend_on_pieces(spark, piece):
    chance = random.Random(piece)
    groups = {"hot": 400, None: 30, "a": 1, "b": 65}
    rows = [(g, n, chance.randint(-5, 5), chance.randint(0, 9)) for g, size in groups.items() for n in range(1, size + 1)]
    df = spark.createDataFrame(rows, "g string, n int, v long, w long").repartition(5)
    found = {(r["g"], r["n"]): (r["depth"], r["all"]) for r in running(df, ["g"], "n", {"depth": "v", "all": "w"}, piece).collect()}
    for g, size in groups.items():
        own = [r for r in rows if r[0] == g]
        for n, (v, w) in enumerate(zip(accumulate(r[2] for r in own), accumulate(r[3] for r in own)), 1):
            assert found[g, n] == (v, w)
    assert len(found) == len(rows)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_ranks_of_hot_groups(spark, parts):
    chance = random.Random(parts)
    rows = [("hot", chance.randint(0, 50), i) for i in range(900)] + [(None, None, -i) for i in range(40)] + [(f"k{i % 90}", i % 4, i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x int, i int").repartition(6)
    out = ranked(df, ["g"], [F.col("x").desc_nulls_last(), F.col("i")], parts=parts)
    wanted, seen = {}, {}
    for g, x, i in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2])):
        seen[g] = wanted[g, i] = seen.get(g, 0) + 1
    assert {(r["g"], r["i"]): r["nth"] for r in out.collect()} == wanted


def test_equal_rows_are_dealt_out(spark):
    df = spark.range(5_000).select(F.lit("same").alias("g"), F.lit(1).alias("x")).repartition(4)
    out = ranked(df, ["g"], [F.col("x")], parts=16)
    assert sorted(r["nth"] for r in out.collect()) == list(range(1, 5_001))
    assert ranked(df.limit(0), ["g"], [F.col("x")]).count() == 0 and running(df.limit(0), ["g"], "x", {"s": "x"}).count() == 0
