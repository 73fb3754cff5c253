"""SimHash near-dedup with vantage-point trees.

Fingerprints are collapsed to distinct ones first (a group of exact copies is then one point). Two fingerprints at
distance <= REACH agree, in at least one of `blocks` equal bit blocks, up to REACH // blocks bits. So each block has a
tree of its own over the block's Hamming distance, built on the driver from a bounded sample (it only says where
shards lie; results don't depend on it), and a fingerprint goes to every shard that the ball of that radius around its
block's code may meet by the triangle bound. With BLOCKS = 4 the radius is 0 and a ball meets one shard, so the tree
only says which codes share a shard; with 1 or 2 the results are the same, but balls overlap more boundaries and rows
are copied more often (README has figures). Within a shard the vantage split goes on over all 64 bits with radius
REACH, codes within reach of a boundary in both parts, and the last parts are compared exactly. A shard beyond PART
rows is dealt out as pairs of its parts. Shards return stars, not pairs; their components are found in Spark. The
sample has about SAMPLE fingerprints at most; nothing else reaches the driver.

`drop_near_copies` keeps one document of each component, by these links (3-word shingles, REACH bits) or, with a
similarity, by the exact Jaccard similarity of 5-word shingles. Then, too, fingerprints (here of the 5-word shingles)
are linked by the trees first, and each link is confirmed on the whole sets; 64 bits can't tell all pairs of that
similarity from others, so `similar.roots_of` looks for what is left, between the components that the links made.

Defined results: null text is empty, no word gives fingerprint zero; component_id ignores null doc_ids unless a
component has no other; repeated rows share fingerprint and component; two texts with one doc_id are two documents;
an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from csift.llm.common import durable, hash_sample, slices, text_key
from csift.llm.components import stars
from csift.llm.vptree import VantageTree, linked_groups

SHINGLE = 3
SEED = 42
REACH = 3
BLOCKS = 4
SAMPLE = 1 << 16
LEAF = 4096
PART = 1 << 15
BITS = 64
#: Bytes of a text, and shingles of a slice, that are held as words or bits at a time.
PIECE = 1 << 20
HELD = 1 << 17
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def shingle_hashes(text: bytes, shingle: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a text, repeats included, a piece of the text at a time; of fewer words, of all of them."""
    digest, at, carried, whole = xxhash.xxh64_intdigest, 0, [], 0
    while at < len(text):
        gap = SPACE.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = gap.start() if gap else len(text)
        # bytes: only A-Z change, only ASCII white space separates
        words = carried + text[at:end].lower().split()
        at = end
        if len(words) >= shingle:
            ends = np.cumsum([len(w) + 1 for w in words]).tolist()
            joined, begins = b" ".join(words), [0, *ends[:-shingle]]
            whole += len(begins)
            yield np.fromiter((digest(joined[i : j - 1], seed) for i, j in zip(begins, ends[shingle - 1 :])), np.uint64, len(begins))
        carried = words[max(0, len(words) - shingle + 1) :]
    if carried and not whole:
        yield np.array([digest(b" ".join(carried), seed)], np.uint64)


def fingerprints_of(texts: list[bytes], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """One unsigned 64-bit fingerprint a text: a bit is set if it is in over half of the shingles' hashes."""
    set_, total = np.zeros((len(texts), BITS), np.int64), np.zeros(len(texts), np.int64)
    rows, held, waiting = [], [], 0

    def count() -> None:
        sizes = [len(x) for x in held]
        bits = np.unpackbits(np.concatenate(held).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        np.add.at(set_, rows, np.add.reduceat(bits, np.cumsum([0, *sizes[:-1]]), axis=0, dtype=np.int64))
        np.add.at(total, rows, sizes)
        rows.clear()
        held.clear()

    for row, text in enumerate(texts):
        for hashes in shingle_hashes(text, shingle, seed):
            rows.append(row)
            held.append(hashes)
            waiting += len(hashes)
            if waiting > HELD:
                count()
                waiting = 0
    if rows:
        count()
    return np.packbits(set_ * 2 > total[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprint_of(held: np.ndarray) -> int:
    """The fingerprint (a signed long) of a set of hashes."""
    set_ = np.zeros(BITS, np.int64)
    for at in range(0, len(held), HELD):
        set_ += np.unpackbits(held[at : at + HELD].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_ * 2 > len(held), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, key=None) -> DataFrame:
    """doc_id, _csift_key (of the key column, or null) and fingerprint (a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            texts = [b"" if x is None else x for x in part.column("text").cast(pa.binary()).to_pylist()]
            found = pa.array(fingerprints_of(texts, shingle, seed).view(np.int64))
            yield pa.record_batch([part.column("doc_id"), part.column("_csift_key"), found], ["doc_id", "_csift_key", "fingerprint"])

    named = (F.lit(None) if key is None else key).cast("string").alias("_csift_key")
    rows = docs.select(F.col("doc_id").cast("long"), named, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, _csift_key string, fingerprint long")


def block_codes(codes: np.ndarray, block: int, blocks: int) -> np.ndarray:
    width = BITS // blocks
    return (codes >> np.uint64(block * width)) & np.uint64((1 << width) - 1)


def links(points: DataFrame, reach: int = REACH, blocks: int = BLOCKS, sample: int = SAMPLE, leaf: int = LEAF, part: int = PART) -> DataFrame:
    """(a, b): links that connect what pairs of distinct fingerprints at distance <= reach connect."""
    if BITS % blocks:
        raise ValueError("blocks must divide the number of bits")
    spark, count = points.sparkSession, points.count()
    drawn = np.sort(hash_sample(points, "fingerprint", sample).select("fingerprint").toPandas()["fingerprint"].to_numpy(np.int64)).view(np.uint64)
    size = max(4, leaf * len(drawn) // max(1, count))
    trees = spark.sparkContext.broadcast([VantageTree.build(block_codes(drawn, b, blocks), size) for b in range(blocks)])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for block, tree in enumerate(trees.value):
                rows, leaves = tree.route(block_codes(codes, block, blocks), reach // blocks)
                for at in range(0, len(rows), 100_000):
                    piece = slice(at, at + 100_000)
                    found = pa.array(codes[rows[piece]].view(np.int64))
                    yield pa.record_batch([found, pa.array(np.full(len(found), block, np.int32)), pa.array(leaves[piece])], ["fingerprint", "block", "leaf"])

    def groups(shard: pa.Table) -> pa.Table:
        codes = np.unique(shard.column("fingerprint").to_numpy()).view(np.uint64)
        label = linked_groups(codes, reach)
        moved = np.nonzero(label != np.arange(len(label)))[0]
        return pa.table({"a": codes[moved].view(np.int64), "b": codes[label[moved]].view(np.int64)})

    routed = durable(points.select("fingerprint").mapInArrow(shards, "fingerprint long, block int, leaf long"))
    # One row a leaf, and the trees have at most SAMPLE / 4 leaves a block.
    large = routed.groupBy("block", "leaf").count().filter(F.col("count") > part).select("block", "leaf", F.ceil(F.col("count") / part).cast("int").alias("parts"))
    dealt = routed.join(F.broadcast(large), ["block", "leaf"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    mine = F.pmod(F.xxhash64("fingerprint"), F.col("parts")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(F.least(x, F.col("mine")).alias("i"), F.greatest(x, F.col("mine")).alias("j")))
    dealt = dealt.withColumn("mine", mine).withColumn("meet", F.explode(meets)).select("fingerprint", "block", "leaf", "meet.i", "meet.j")
    # A shard is little data but much work: a fixed number of tasks, which Spark doesn't merge by bytes.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks * count // (8 * leaf))
    return dealt.repartition(tasks, "block", "leaf", "i", "j").groupBy("block", "leaf", "i", "j").applyInArrow(groups, "a long, b long")


def linked_points(points: DataFrame, **parameters) -> DataFrame:
    """(a, b), a < b: points (point, fingerprint) of equal fingerprints, each with the least of them, and the least ones of linked fingerprints."""
    least = durable(points.groupBy("fingerprint").agg(F.min("point").alias("least")))
    found = links(least, **parameters)
    ends = [least.select(F.col("fingerprint").alias(c), F.col("least").alias(f"of_{c}")) for c in ("a", "b")]
    near = found.join(ends[0], "a").join(ends[1], "b").select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b"))
    same = points.join(least, "fingerprint").filter("point <> least").select(F.col("least").alias("a"), F.col("point").alias("b"))
    return durable(near.union(same).distinct())


def components(docs: DataFrame, key=None, **parameters) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, _csift_key, fingerprint), (fingerprint, component_id, _csift_best: key of the row that stays)."""
    rows = durable(fingerprints(docs, key=key))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_csift_key"))
    points = durable(rows.groupBy("fingerprint").agg(best.alias("best")))
    joined = stars(links(points, **parameters))
    members = durable(joined.select(F.col("node").alias("fingerprint"), "root").union(joined.select("root", "root").distinct()))
    least = durable(members.join(points, "fingerprint").groupBy("root").agg(F.min("best").alias("least")))
    moved = members.join(least, "root").select("fingerprint", "least")
    every = points.join(durable(moved), "fingerprint", "left").withColumn("best", F.coalesce("least", "best"))
    return rows, durable(every.select("fingerprint", F.col("best.doc_id").alias("component_id"), F.col("best._csift_key").alias("_csift_best")))


def near_copies(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row."""
    rows, found = components(docs, **parameters)
    return rows.join(found, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, similarity: tuple[int, int] | None = None, **parameters) -> DataFrame:
    """docs with one document of each component, the one with the least doc_id (null only if there is no other); all columns.

    similarity: a fraction, such as (4, 5); documents are then linked by the similarity of their 5-word shingles.
    Of repeated rows (same doc_id and text) one stays.
    """
    if similarity is None:
        _, found = components(docs, key=text_key(), **parameters)
        staying = found.select(F.col("_csift_best").alias("_csift_key")).distinct()
    else:
        from csift.llm import similar

        staying = similar.staying(docs, similarity, **parameters)
    first = Window.partitionBy("_csift_key").orderBy("_csift_key")
    kept = docs.withColumn("_csift_key", text_key()).join(durable(staying), "_csift_key", "left_semi")
    return kept.withColumn("_csift_nth", F.row_number().over(first)).filter("_csift_nth = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
