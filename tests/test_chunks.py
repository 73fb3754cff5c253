"""Lexing in pieces against lexing whole texts, for every place of the cuts."""

import random

import pytest
from pyspark.sql import functions as F

from csift.functions import lexing
from csift.operators import chunks

ODD = [None, "", "/", "//", "/*", "/**/", "/*/", "/***/x", "a/b", "a//b\nc", "\"//\" // \"\n'", "'\\''/* x\n\n*/y", '"a\\"b" /*', "\\\"", "// a \\\nb", "/*\n*//*\n*/ //\n//\n", "'\"' /*'*/ \"'\"", '"\\\\" // c', "x /", "//*\n*/", "\n\n/* é漢🙂 */\n"]


def texts():
    chance = random.Random(5)
    return ODD + ["".join(chance.choice("/*\"'\\\nab ") for _ in range(chance.randint(1, 90))) for _ in range(120)] + ["x" * 700 + "/* long " + "y\n" * 600 + "*/ // end"]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(list(enumerate(texts())), "id long, content string").withColumn("piece", F.lit(1)).repartition(3).cache()


@pytest.fixture(scope="module")
def whole(files):
    rows = files.select("id", lexing.strip_comments(F.coalesce("content", F.lit(""))).alias("clean"), lexing.comments(F.coalesce("content", F.lit(""))).alias("comments")).collect()
    return {r["id"]: r["clean"] for r in rows}, sorted((r["id"], c["line"], c["text"]) for r in rows for c in r["comments"])


@pytest.mark.parametrize("size,fan", [(1, 2), (2, 64), (3, 3), (7, 64), (1 << 14, 64)])
def test_pieces_are_as_the_whole(files, whole, size, fan):
    cut = chunks.cut(files, ["id"], "content", size)
    pieces = chunks.durable(chunks.with_states(cut, ["id"], fan))
    assert {r["id"]: r["whole"] for r in pieces.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("piece", "text")))["text"], "").alias("whole")).collect()} == {i: t or "" for i, t in enumerate(texts())}
    clean = chunks.strip_comments(pieces, ["id"]).groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("piece", "clean")))["clean"], "").alias("clean"))
    assert {r["id"]: r["clean"] for r in clean.collect()} == whole[0]
    assert sorted(map(tuple, chunks.comments(pieces, ["id"]).collect())) == whole[1]


def test_transitions_compose(spark):
    chance = random.Random(6)
    pairs = [("".join(chance.choice("/*\"'\\\na") for _ in range(chance.randint(0, 6))), "".join(chance.choice("/*\"'\\\na") for _ in range(chance.randint(0, 6)))) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select(chunks.transition(F.concat("a", "b")).alias("whole"), chunks.composed(F.array(chunks.transition(F.col("a")), chunks.transition(F.col("b")))).alias("parts")).collect()
    assert all(r["whole"] == r["parts"] for r in rows)


def test_files_are_split(spark, tmp_path, files):
    text = "".join(f"int a{i}; /* c{i}\n more */ char *s = \"/*\"; // {i}\n" for i in range(3000))
    (tmp_path / "big.c").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        pieces = chunks.durable(chunks.with_states(chunks.cut_files(spark, str(tmp_path), 50), ["path"]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert pieces.count() > 60
    whole = spark.createDataFrame([(text,)], "t string").select(F.inline(lexing.comments(F.col("t")))).collect()
    assert sorted((r["line"], r["text"]) for r in chunks.comments(pieces, ["path"]).collect()) == sorted((r["line"], r["text"]) for r in whole)


def test_no_files(spark, files):
    pieces = chunks.lex(files.limit(0), ["id"], "content")
    assert chunks.strip_comments(pieces, ["id"]).count() == chunks.comments(pieces, ["id"]).count() == 0
