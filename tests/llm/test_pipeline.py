"""The pipeline's stages, each on what its predecessor kept, and the queries' SQL."""

import base64
import hashlib
import os
import re
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from csift.llm import bpe, mixing, quality, queries
from tests.llm.test_operators import LONG, filled, odd
from tests.llm.test_similar import brute_force

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def scored_by_hand(docs, labels):
    """doc_ids that the classifier keeps: its rules in numpy, over the statistics of each text."""
    rules, intercept = quality.train(docs, labels)
    rows = docs.select("doc_id", *[c.alias(f"s_{n}") for n, c in quality.statistics().items()]).collect()
    x = np.array([r[1:] for r in rows], np.float64)
    margin = intercept + sum((r.weight * r.holds(x) for r in rules), np.zeros(len(x)))
    return sorted(r["doc_id"] for r, m in zip(rows, margin) if 1 / (1 + np.exp(-m)) >= quality.THRESHOLD)


def mixed_by_hand(rows):
    """How often each doc_id is taken: rates from the targets, then the hash under the source's best seed."""
    sizes, each = {}, []
    for r in rows:
        n = len(re.findall("[^\\x20\\x09-\\x0D]+", r["text"] or ""))
        sizes[r["source"]] = sizes.get(r["source"], 0) + n
        each.append((r["doc_id"], r["source"], n, int(hashlib.sha256(f"{mixing.SEED}:{r['doc_id']}".encode()).hexdigest()[:12], 16)))
    out, targets = {}, filled(sizes)
    for s in sizes:
        rate = targets[s] / sizes[s]
        drawn = lambda h, turn: h * (turn * mixing.STEP + 1) % mixing.HASHES / mixing.HASHES < rate - int(rate)  # noqa: B023, E731
        own = [x for x in each if x[1] == s]
        best = min(range(mixing.SEEDS), key=lambda t: (abs(sum(n * (int(rate) + drawn(h, t)) for _, _, n, h in own) - targets[s]), t))  # noqa: B023
        out |= {i: int(rate) + drawn(h, best) for i, _, _, h in own}
    return {i: n for i, n in out.items() if n}


def test_stages(spark):
    """Each stage against a brute-force version, over its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{SF}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.collect()
        out = stage(spark, docs, SF)
        if name == "byte_bpe":
            lines = dict(x.split() for x in bpe.rank_file().splitlines())
            library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in lines.items()}, special_tokens={})
            assert sorted((r["doc_id"], r["ids"]) for r in out.collect()) == sorted((r["doc_id"], library.encode_ordinary(r["text"] or "")) for r in rows)
            continue
        assert out.columns == columns
        out = spark.createDataFrame(out.collect(), out.schema).repartition(3)
        kept = sorted(r["doc_id"] for r in out.select("doc_id").collect())
        ids, texts = [r["doc_id"] for r in rows], [r["text"] for r in rows]
        if name == "quality_classifier":
            assert kept == scored_by_hand(docs, labels) and 0 < len(kept) < len(rows)
        elif name == "exact_dedup":
            assert kept == sorted({t or "": i for i, t in sorted(zip(ids, texts))}.values())
        elif name == "simhash_near_dedup":
            assert kept == brute_force(ids, texts)
        else:
            assert {i: kept.count(i) for i in set(kept)} == mixed_by_hand(rows)
        docs = out


def test_odd_documents(spark):
    """Nulls, empty and long texts, ties, repeats, one doc_id with two texts, clashing columns, and an empty table."""
    strange = odd(spark).union(odd(spark).filter("doc_id = 5").withColumn("text", F.lit("another text with that doc_id")))
    for docs in (strange, strange.filter("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name == "byte_bpe":
                assert out.count() == docs.count()
                break
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert docs.count() <= 20
    kept = corpus_pipeline.near_deduplication(spark, corpus_pipeline.exact_deduplication(spark, strange, SF), SF).collect()
    assert sorted(r["text"] or "" for r in kept if r["doc_id"] == 5) == sorted([LONG, "another text with that doc_id"])


def test_nothing_but_the_last_input_stays(spark, tmp_path):
    before = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    corpus_pipeline.run(spark, SF).count()
    folder = next(x for x in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).parent.rglob("csift-pipeline-*"))
    assert sorted(x.name.split("-", 1)[1] for x in folder.iterdir()) in (["source_mixing", "work"], ["source_mixing"])
    if before:
        spark.sparkContext.setCheckpointDir(before)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert "pipeline" in queries.queries()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    mine = queries.queries()[name](spark, SF)
    columns = ", ".join(f'"{c}"' for c in sorted(mine.columns))
    wanted = connection.sql(f"SELECT {columns} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in mine.select(*sorted(mine.columns)).collect()))) == sorted(map(repr, wanted))


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in queries.queries() if n.startswith("op")} == set(range(1, 11))
