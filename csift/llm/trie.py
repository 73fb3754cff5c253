"""Prefix trie of conversations by smallest-member ownership.

A node is a distinct sequence of first turns; its owner is its smallest member. A member's deeper nodes have no more
members, so what a conversation owns is a suffix of its path. An aggregate by node names owners, and from each owner's
first node on a window's running sums mark its path as owned. One group-by over prefixes then sums for each member what
its path holds from here on (occurrence tokens) without what it owns of that: a node of the subtree is counted once less
than it has members. Leaf flags and children are sums over owned nodes, too.

A prefix is told by its depth and four sums of 32 bits of SHA-256 over (place, role, text) of its turns, so that prefix
sums over pieces (`csift.operators.prefix`) give the keys of a path of any length, and a conversation may hold any share of
all rows. Groups by node are summed where they lie first. The only thing that can't be split is the digest of a node's
ends, for SHA-256 is sequential: their ids pass sorted through one task, in batches that it doesn't keep.

Defined results: turns go by turn (null first), then by the digest of role and text; null role and text are empty; a
repeated row is a turn of its own; rows with a null conv_id belong to no conversation and are left out; an empty table has
no root and gives an empty result; columns beside the four are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from csift.llm.common import durable
from csift.operators.prefix import ranked, running

#: A conversation takes over turns from the one whose id is the multiple of EVERY before it: fewer than HEADS.
EVERY, HEADS = 5, 9
#: Turns of a stretch, by which joins with a conversation's values are dealt out.
STRETCH = 1 << 14
#: A parent with more than 1/HEAVY of all searched children is broadcast.
HEAVY = 1000
SUMS = ("k0", "k1", "k2", "k3")
NODE = ("depth", *SUMS)


def placed(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), digest and bytes of each turn; texts go no further."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    return ranked(durable(rows), ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("digest")], "place").select("conv_id", "place", "digest", "bytes")


def with_values(rows: DataFrame, place: str, values: DataFrame, length: str) -> DataFrame:
    """rows with their conversation's values, joined by stretches, so that a long conversation is many keys."""
    stretches = values.withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col(length) / STRETCH))))
    return rows.withColumn("stretch", F.floor(F.col(place) / STRETCH)).join(stretches, ["conv_id", "stretch"]).drop("stretch")


def rebuilt(turns: DataFrame, every: int = EVERY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): conv_id, place, digest, bytes, turns of each rebuilt turn; conv_id, turns of each conversation.

    `turns` is how many turns the rebuilt conversation has. It begins with the first h original turns of the conversation
    conv_id - conv_id % every, h = crc32(conv_id) % heads, and goes on with its own after its first h.
    """
    convs = durable(turns.groupBy("conv_id").agg(F.max("place").alias("own")))
    h = F.crc32(F.col("conv_id").cast("string")) % heads
    base = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("has"))
    convs = convs.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % every}).join(base, "base", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("has", F.lit(0)))).withColumn("turns", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    own = with_values(turns, "place", convs.select("conv_id", "h", "taken", "turns", "own"), "own").filter("place > h")
    own = own.withColumn("place", F.col("place") - F.col("h") + F.col("taken"))
    head = turns.filter((F.col("place") < heads) & (F.col("conv_id") % every == 0)).withColumnRenamed("conv_id", "base")
    head = convs.select("conv_id", "base", "taken", "turns").join(head, "base").filter("place <= taken")
    columns = ["conv_id", "place", "digest", "bytes", "turns"]
    return own.select(*columns).unionByName(head.select(*columns)), convs.select("conv_id", "turns")


def paths(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row for each node of each conversation's path, the root among them.

    depth and k0 to k3 tell the node, depth - 1 and p0 to p3 its parent; `before` is the bytes of the turns before the
    last, `bytes` its own.
    """
    hashed = F.sha2(F.concat(F.col("place").cast("string"), F.lit(":"), F.hex("digest")), 256)
    rows = turns.withColumn("hashed", hashed).withColumns({f"p{i}": F.conv(F.substring("hashed", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)})
    rows = rows.select("conv_id", F.col("place").alias("depth"), "bytes", "turns", "p0", "p1", "p2", "p3")
    rows = running(rows, ["conv_id"], "depth", {**{f"k{i}": f"p{i}" for i in range(4)}, "before": "bytes"}, STRETCH)
    rows = rows.withColumns({f"p{i}": F.col(f"k{i}") - F.col(f"p{i}") for i in range(4)} | {"before": F.col("before") - F.col("bytes")})
    nothing = {c: F.lit(0).cast("long") for c in ("depth", "bytes", "before", *SUMS, "p0", "p1", "p2", "p3")}
    return rows.unionByName(conversations.withColumns(nothing))


def ends_digests(ends: DataFrame) -> DataFrame:
    """NODE and ends_sha256 of each node at which conversations end: the hash of their ids, ascending, comma-joined."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, done = None, None, []
        for batch in batches:
            ids = [str(i).encode() for i in batch.column(len(NODE)).to_pylist()]
            nodes = list(zip(*(batch.column(i).to_pylist() for i in range(len(NODE)))))
            at = 0
            while at < len(nodes):
                to = at + 1
                while to < len(nodes) and nodes[to] == nodes[at]:
                    to += 1
                if nodes[at] == current:
                    state.update(b",")
                else:
                    if state:
                        done.append((*current, state.hexdigest()))
                    current, state = nodes[at], hashlib.sha256()
                state.update(b",".join(ids[at:to]))
                at = to
            if len(done) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=[*NODE, "ends_sha256"])
                done = []
        if state:
            done.append((*current, state.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=[*NODE, "ends_sha256"])

    schema = ", ".join(f"{c} long" for c in NODE) + ", ends_sha256 string"
    return ends.select(*NODE, "conv_id").repartition(*NODE).sortWithinPartitions(*NODE, "conv_id").mapInArrow(hashed, schema)


def owned_from(rows: DataFrame) -> DataFrame:
    """conv_id, turns, first (the depth from which a conversation owns its path), upto (bytes before that) and leaf."""
    nodes = rows.groupBy(*NODE).agg(F.min(F.struct("conv_id", "before")).alias("owner"), F.count(F.lit(1)).alias("members"), F.sum((F.col("depth") == F.col("turns")).cast("long")).alias("ends"))
    owners = nodes.groupBy(F.col("owner.conv_id").alias("conv_id")).agg(
        F.min(F.struct("depth", F.col("owner.before").alias("before"))).alias("start"), F.max((F.col("members") == F.col("ends")).cast("long")).alias("leaf")
    )
    last = rows.filter("depth = turns").select("conv_id", "turns", (F.col("before") + F.col("bytes")).alias("all"))
    return last.join(owners, "conv_id", "left").select("conv_id", "turns", F.coalesce("start.depth", F.col("turns") + 1).alias("first"), F.coalesce("start.before", "all").alias("upto"), F.coalesce("leaf", F.lit(0)).alias("leaf"))


def with_parents(nodes: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """nodes with parent_conv_id. A node that isn't its owner's first has the owner's node above it; others look it up.

    Each conversation looks up one node at most, so fewer than `heavy` parents have more than 1/heavy of what is looked
    up: these are broadcast, and no key of the shuffled rest has more.
    """
    inner, first = nodes.filter("depth > first or depth = 0"), nodes.filter("depth = first and depth > 0")
    found = inner.withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    many = first.count() // heavy
    above = nodes.select((F.col("depth") + 1).alias("depth"), *[F.col(f"k{i}").alias(f"p{i}") for i in range(4)], F.col("conv_id").alias("parent_conv_id"), "n_children")
    key = ["depth", "p0", "p1", "p2", "p3"]
    hot = F.broadcast(above.filter(F.col("n_children") > many).drop("n_children")) if many else None
    rest = above.filter(F.col("n_children") <= many).drop("n_children") if many else above.drop("n_children")
    if hot is None:
        return found.unionByName(first.join(rest, key))
    return found.unionByName(first.join(hot, key)).unionByName(first.join(hot, key, "left_anti").join(rest, key))


def trie(turns: DataFrame, conversations: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """A row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    and ends_sha256. `turns` and `conversations` as `rebuilt` gives them."""
    rows = durable(paths(turns, conversations))
    joined = with_values(rows.drop("turns"), "depth", owned_from(rows), "turns")
    below: Column = F.col("depth") + 1
    nodes = joined.groupBy(*NODE).agg(
        F.min(F.struct("conv_id", "first", "p0", "p1", "p2", "p3")).alias("owner"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum(((below >= F.col("first")) & (below <= F.col("turns"))).cast("long")).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(F.greatest(F.col("upto") - F.col("before"), F.lit(0))).alias("saved_tokens"),
    )
    nodes = with_parents(durable(nodes.select(*NODE, "owner.*", "n_convs", "n_children", "n_leaves", "saved_tokens")), heavy)
    out = nodes.join(ends_digests(rows.filter("depth = turns")), list(NODE), "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def conversation_trie(turns: DataFrame, every: int = EVERY, heads: int = HEADS) -> DataFrame:
    return trie(*rebuilt(placed(turns), every, heads))
