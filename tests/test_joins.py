"""As-of and band joins, running depth and multiset differences against brute force, with hot keys."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from csift.operators import baseline
from csift.operators.asof import nearest_before
from csift.operators.band import band_join
from csift.operators.lines import brace_depths, line_rows, room_of_buffers


def events(seed, hot=300, rest=120):
    chance = random.Random(seed)
    return [("f", "hot", chance.randint(0, 400), i) for i in range(hot)] + [(chance.choice(["f", "g", None]), chance.choice(["a", "b", None]), chance.randint(0, 30), hot + i) for i in range(rest)]


@pytest.mark.parametrize("parts", [1, 5, 32])
@pytest.mark.parametrize("same_place", [True, False])
def test_nearest_declaration(spark, parts, same_place):
    uses, told = events(parts), events(parts + 100, 90, 40)
    a = spark.createDataFrame(uses, "path string, name string, line int, use int").repartition(4)
    b = spark.createDataFrame(told, "path string, name string, line int, room int").withColumn("declared", F.col("line"))
    found = nearest_before(a, b, ["path", "name"], "line", ["declared", "room"], same_place, parts).collect()
    wanted = []
    for path, name, line, use in uses:
        above = [(n, room) for p, x, n, room in told if (p, x) == (path, name) and (n <= line if same_place else n < line)]
        wanted.append((path, name, line, use, *max(above, default=(None, None))))
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted))


def test_nearest_of_nothing(spark):
    a = spark.createDataFrame([("f", None, None, 1), ("f", None, None, 1)], "path string, name string, line int, use int")
    b = spark.createDataFrame([], "path string, name string, line int, room int")
    assert [r["room"] for r in nearest_before(a, b, ["path", "name"], "line", ["room"]).collect()] == [None, None]
    assert nearest_before(a.limit(0), b, ["path", "name"], "line", ["room"]).count() == 0


@pytest.mark.parametrize("width", [0, 1, 7, 1000])
def test_band(spark, width):
    checks, uses = events(width, 150, 60), events(width + 50, 150, 60)
    a = spark.createDataFrame(checks, "path string, name string, checked int, c int").repartition(3)
    b = spark.createDataFrame(uses, "path string, name string, used int, u int")
    found = band_join(a, b, ["path", "name"], "checked", "used", width).select("path", "name", "checked", "c", "used", "u").collect()
    wanted = [(p, x, n, c, m, u) for p, x, n, c in checks for q, y, m, u in uses if p and x and (p, x) == (q, y) and 0 <= m - n <= width]
    assert sorted(map(tuple, found)) == sorted(wanted)


def test_room_of_buffers(spark):
    text = "char a[8];\nvoid f(void) {\n  strcpy(a, s); char a[16];\n  strcat(a, s);\n  int b [ 3 ]; memcpy(b, a, 2); gets(nowhere);\n}\nunsigned char a[2];\nchar q[99999999999999999999]; strcpy(q, a);"
    rows = room_of_buffers(line_rows(spark.createDataFrame([("f", text), ("g", "gets(a);"), ("h", None)], "path string, content string"), ["path"], "content"), ["path"])
    found = sorted((r["path"], r["line_number"], r["name"], r["declared"], r["room"] and int(r["room"])) for r in rows.collect())
    assert found == [("f", 3, "a", 3, 16), ("f", 4, "a", 3, 16), ("f", 5, "b", 5, 3), ("f", 5, "nowhere", None, None), ("f", 8, "q", 8, 99999999999999999999), ("g", 1, "a", None, None)]


@pytest.mark.parametrize("piece", [2, 1 << 14])
def test_depths(spark, piece):
    chance = random.Random(piece)
    texts = {i: "\n".join("".join(chance.choice("{}a ") for _ in range(chance.randint(0, 6))) for _ in range(chance.randint(1, 40))) + "." for i in range(20)} | {50: None, 51: "{"}
    files = spark.createDataFrame(list(texts.items()), "id long, content string")
    found = {(r["id"], r["line_number"]): r["depth"] for r in brace_depths(line_rows(files, ["id"], "content"), ["id"], piece).collect()}
    wanted = {}
    for i, text in texts.items():
        depth = 0
        for n, line in enumerate((text or "").split("\n") if text else [], 1):
            depth += line.count("{") - line.count("}")
            wanted[i, n] = depth
    assert found == wanted


def test_a_hot_fingerprint_is_many_tasks(spark):
    chance = random.Random(3)
    rows = [(f"f{chance.randint(0, 50)}", i, 1, "r", "m", "hot") for i in range(1000)] + [(f"f{i}", i, 1, "r", None, chance.choice("xyz")) for i in range(60)] + [("f", 1, 1, "r", "m", None)] * 3
    found = spark.createDataFrame(rows, "file_path string, line_number int, column_number int, rule_id string, message string, fingerprint string").repartition(4)
    before = spark.createDataFrame([("hot", 700), ("x", 5), ("gone", 9)], "fingerprint string, count long")
    out = baseline.new_findings(found, before)
    had, seen, wanted = {"hot": 700, "x": 5}, Counter(), []
    for r in sorted(rows, key=lambda r: (r[0], r[1])):
        seen[r[5]] += 1
        if seen[r[5]] > had.get(r[5], 0):
            wanted.append(r)
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, wanted)) and out.columns == found.columns
    tasks = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert baseline.resolved_count(found, before).first()[0] == 9 and tasks
