"""The exact form of near-dedup: components by the Jaccard similarity of word shingles.

Documents are linked if the sets of their SHINGLE-word shingles have at least the similarity, a fraction num / den.
Equal sets are collapsed first. Candidates come by prefixes: in one order of all shingles, two sets of n and m
shingles that are similar share one of the first n - ceil(n num / den) + 1 and m - ceil(m num / den) + 1. That holds for
any order, so no pair is missed; the order used (rarest first in a sample, then by hash) only makes candidates
few, and puts what a document has alone, such as edits, first.

SimHash links (`simhash.linked_points`) come first: fingerprints of the same shingles, linked by vantage-point trees, each
link confirmed on the whole sets. What follows looks only between the components that these links make.

A shingle's documents are a list. In a first round each document is compared with its list's pivot, the document with
the fewest shingles of its own before the shared one: in a group of near copies that is the copy with the fewest
edits. Lists that still hold several components and are longer than SMALL go through more such rounds, each with the
next pivot among those not yet compared, until a round finds nothing, or ROUNDS are over; what is left is compared
within its list, in parts of PART documents, but only across components. So a large group of near copies costs no square, and rounds change the cost only, never the
result. Sketches of 256 counts, which bound what two sets share, rule most candidates out; every link is confirmed on
the whole sets. At most COMMON shingles reach the driver.

Defined results: null text is empty, and empty texts are alike; up to SHINGLE words are one shingle; rows that share
a doc_id and a text are one document; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from csift.llm.common import durable, hash_sample, slices, text_key, whole_text
from csift.llm.components import stars
from csift.llm.simhash import fingerprint_of, linked_points, shingle_hashes

SHINGLE = 5
SEED = 43
SAMPLE = 4096
SHARE = 1000
COMMON = 1 << 17
BROADCAST = 1 << 17
SMALL = 256
ROUNDS = 4
PART = 4096


def shingles_of(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes."""
    held = np.zeros(0, np.uint64)
    for hashes in shingle_hashes(text, shingle, SEED):
        held = np.unique(np.concatenate([held, hashes]))
    return held


def point_of(held: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(held.tobytes(), SEED)


def prefix_of(held: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """The first of held by how often the sample has them, then by hash; common is sorted."""
    num, den = similarity
    kept = len(held) + num * len(held) // -den + 1 if len(held) else 0
    if not len(common):
        return held[:kept]
    at = np.minimum(np.searchsorted(common, held), len(common) - 1)
    often = np.where(common[at] == held, counts[at], 0)
    return held[np.lexsort((held, often))[:kept]]


def sketch_of(held: np.ndarray) -> bytes:
    """How many hashes begin with each byte: what two of these share bounds what the sets share. Empty if a count passes a byte."""
    counts = np.bincount((held >> np.uint64(56)).astype(np.int64), minlength=256)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def _bytes(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def _longs(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def common_shingles(docs: DataFrame, sample: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the commonest shingles of a sample of `sample` documents, or of one of SHARE if that is more.

    So a shingle in a few thousand documents is known as common however many there are, and lists stay short.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            yield pa.record_batch([_longs(np.concatenate([shingles_of(x) for x in _bytes(part.column("text"))]))], ["shingle"])

    sample = max(sample, docs.count() // SHARE)
    drawn = hash_sample(docs.select("doc_id", whole_text().alias("text")), "doc_id", sample).select("text")
    often = drawn.mapInArrow(run, "shingle long").groupBy("shingle").count().filter("count > 2").orderBy(F.desc("count"), "shingle").limit(most).collect()
    order = np.argsort(hashes := np.array([r[0] for r in often], np.int64).view(np.uint64))
    return hashes[order], np.array([r[1] for r in often], np.int64)[order]


def points_of(docs: DataFrame, similarity: tuple[int, int], sample: int = SAMPLE, most: int = COMMON) -> DataFrame:
    """doc_id, _csift_key, digest (of the text), point (one a set), size, fingerprint, sketch and prefix of each row."""
    order = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, sample, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            held = [shingles_of(x) for x in _bytes(part.column("text"))]
            prefixes = [prefix_of(x, *order.value, similarity).view(np.int64) for x in held]
            yield pa.record_batch(
                [part.column("doc_id"), part.column("_csift_key"), part.column("digest"), _longs([point_of(x) for x in held]), pa.array(map(len, held), pa.int32()), pa.array(map(fingerprint_of, held), pa.int64()), pa.array(map(sketch_of, held), pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))],
                ["doc_id", "_csift_key", "digest", "point", "size", "fingerprint", "sketch", "prefix"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), text_key().alias("_csift_key"), F.sha2(whole_text(), 256).alias("digest"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, _csift_key string, digest string, point long, size int, fingerprint long, sketch binary, prefix array<long>")


def bound(similarity: tuple[int, int]):
    """Whether an overlap is enough for sets of two sizes; of numbers, arrays or columns."""
    num, den = similarity
    return lambda overlap, size, other: (num + den) * overlap >= num * (size + other)


class Comparison:
    """Compares pairs of points, whose texts docs holds."""

    def __init__(self, docs: DataFrame, points: DataFrame, similarity: tuple[int, int], broadcast: int = BROADCAST):
        self.docs, self.points, self.similarity, self.broadcast = docs, points, similarity, broadcast

    def possible(self, pairs: DataFrame) -> DataFrame:
        """The distinct pairs without those whose sketches rule similarity out."""
        enough = bound(self.similarity)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept = []
                for x, y in zip(batch.column("x"), batch.column("y")):
                    x, y = (np.frombuffer(v.as_buffer(), np.uint8).astype(np.int32) for v in (x, y))
                    kept.append(not len(x) or not len(y) or bool(enough(int(np.minimum(x, y).sum()), int(x.sum()), int(y.sum()))))
                yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

        sketches = self.points.select("point", "sketch")
        joined = pairs.join(sketches.toDF("a", "x"), "a").join(sketches.toDF("b", "y"), "b")
        return durable(joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """(a, b): the similar ones of the possible pairs. Only texts that they ask for are read as sets."""
        pairs = self.possible(pairs)

        def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "text", 1 << 20):
                found = [shingles_of(x) for x in _bytes(part.column("text"))]
                yield pa.record_batch([_longs([point_of(x) for x in found]), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], ["point", "held"])

        asked = pairs.select(F.col("a").alias("point")).union(pairs.select("b")).distinct().join(self.points, "point").select("digest")
        texts = self.docs.select(F.sha2(whole_text(), 256).alias("digest"), whole_text().alias("text"))
        texts = texts.join(F.broadcast(asked) if asked.count() <= self.broadcast else asked, "digest", "left_semi")
        sets = durable(texts.dropDuplicates(["digest"]).select("text").mapInArrow(sets_of, "point long, held array<long>"))
        joined = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
        alike = bound(self.similarity)(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"))
        return durable(joined.filter(alike).select("a", "b"))

    def across(self, lists: DataFrame) -> DataFrame:
        """(a, b): in each list of (point, size, at, root, n) the pairs of different roots whose sizes and places allow similarity."""
        enough, (num, den) = bound(self.similarity), self.similarity

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.column("members"):
                    fields = [row.values.field(k).to_numpy() for k in range(5)]
                    order = np.argsort(fields[1], kind="stable")
                    point, size, at, root, part = (x[order].astype(np.int64) for x in fields)
                    both = part.max() != part.min()  # two parts meet here; pairs of one part are found elsewhere
                    ends = np.searchsorted(size, size * den // num, "right")
                    for i in range(len(point)):
                        j = slice(i + 1, ends[i])
                        near = (root[j] != root[i]) & enough(np.minimum(size[i] - at[i], size[j] - at[j]), size[i], size[j])
                        if both:
                            near &= part[j] != part[i]
                        if near.any():
                            found = point[j][near]
                            yield pa.record_batch([pa.array(np.minimum(found, point[i])), pa.array(np.maximum(found, point[i]))], ["a", "b"])

        dealt = lists.withColumn("parts", F.ceil(F.col("n") / PART).cast("int")).withColumn("part", F.pmod(F.xxhash64("point"), F.col("parts")).cast("int"))
        meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(F.least(x, F.col("part")).alias("i"), F.greatest(x, F.col("part")).alias("j")))
        members = F.collect_list(F.struct("point", "size", "at", "root", "part")).alias("members")
        return dealt.withColumn("meet", F.explode(meets)).groupBy("shingle", "meet").agg(members).select("members").mapInArrow(run, "a long, b long")


def rooted(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """Lists that hold several components, with each document's root and the list's length."""
    return spread(lists.drop("root").join(roots, "point", "left").withColumn("root", F.coalesce("root", "point")))


def spread(postings: DataFrame) -> DataFrame:
    """The postings of lists that hold several components, with the list's length."""
    same = Window.partitionBy("shingle")
    counted = postings.select("*", F.count(F.lit(1)).over(same).alias("n"), F.min("root").over(same).alias("low"), F.max("root").over(same).alias("high"))
    return durable(counted.filter("low < high").select("shingle", "point", "size", "at", "root", "n"))


def roots_of(points: DataFrame, compare: Comparison, small: int = SMALL, rounds: int = ROUNDS) -> DataFrame:
    """(point, root) of the points that have others in their component, without its least."""
    same, enough = Window.partitionBy("shingle"), bound(compare.similarity)
    roots = joined(None, compare.confirmed(linked_points(points)))
    placed = points.select("point", "size", "prefix").join(roots, "point", "left").withColumn("root", F.coalesce("root", "point"))
    left = spread(placed.select(F.posexplode("prefix").alias("at", "shingle"), "point", "size", "root"))
    for k in range(max(1, rounds)):
        # the pivot is compared with its whole list, and then done with
        pivot = F.min(F.struct("at", "size", "point", "root")).over(same).alias("pivot")
        others = left.filter(F.col("n") > (small if k else 1)).select("*", pivot).filter("point <> pivot.point")
        possible = enough(F.least(F.col("size") - F.col("at"), F.col("pivot.size") - F.col("pivot.at")), F.col("size"), F.col("pivot.size"))
        met = others.filter(F.col("root") != F.col("pivot.root")).filter(possible)
        met = durable(met.select(F.least("point", "pivot.point").alias("a"), F.greatest("point", "pivot.point").alias("b")).distinct())
        near = None if k and met.isEmpty() else compare.confirmed(met)
        if k and (near is None or near.isEmpty()):
            break  # pivots bring nothing more
        roots = joined(roots, near)
        lists = others.select("shingle", "point", "size", "at")
        left = rooted(lists.union(left.filter(F.col("n") <= small).select(*lists.columns)) if k else lists, roots)
    more = compare.confirmed(compare.across(left).distinct())
    return roots if more.isEmpty() else joined(roots, more)


def joined(roots: DataFrame | None, near: DataFrame) -> DataFrame:
    """(point, root) with the links of near, too."""
    links = near if roots is None else near.union(roots.select("point", "root"))
    return stars(links).withColumnRenamed("node", "point")


def staying(docs: DataFrame, similarity: tuple[int, int], sample: int = SAMPLE, most: int = COMMON, **parameters) -> DataFrame:
    """_csift_key (see text_key) of one document of each component, the one with the least doc_id."""
    rows = points_of(docs, similarity, sample, most)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_csift_key")).alias("best")
    points = durable(rows.groupBy("point").agg(best, F.min("digest").alias("digest"), *[F.first(c).alias(c) for c in ("size", "fingerprint", "sketch", "prefix")]))
    roots = roots_of(points, Comparison(docs, points, similarity), **parameters)
    every = points.select("point", "best").join(roots, "point", "left").groupBy(F.coalesce("root", "point")).agg(F.min("best").alias("best"))
    return every.select(F.col("best._csift_key").alias("_csift_key")).distinct()
