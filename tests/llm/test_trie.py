"""The conversation trie against a brute-force one, however stretches, heavy parents and hot conversations fall."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from csift.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def sign(turn):
    role, text = turn
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def brute(rows):
    """{(conv_id, depth): (parent, n_convs, n_children, n_leaves, saved, ends)} of rows (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, sign((role or "", text or "")), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c > 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def under(node):
        todo, out = [node], []
        while todo:
            out.append(todo.pop())
            todo += children.get(out[-1], [])
        return out

    out = {}
    for node, own in members.items():
        below = under(node)
        ends = ",".join(map(str, sorted(c for c in own if len(built[c]) == len(node))))
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        out[min(own), len(node)] = (min(members[node[:-1]]) if node else None, len(own), len(children.get(node, [])), sum(x not in children for x in below), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def found(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("place", "depth", "turns", "bytes", "k0", "first")}).repartition(3)
    out = trie.conversation_trie(df)
    return {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in out.collect()}


def chance_rows(seed, n, longest):
    chance = random.Random(seed)
    rows = []
    for c in range(-7, n):
        if chance.random() < 0.85:
            said = [("user" if k % 2 else "bot", chance.choice(["a", "é", "", "longer text"])) for k in range(chance.randint(1, longest))]
            rows += [(c, k, *x) for k, x in enumerate(said)]
    return rows


@pytest.mark.parametrize("stretch", [2, 1 << 14])
def test_trie(spark, monkeypatch, stretch):
    monkeypatch.setattr(trie, "STRETCH", stretch)
    rows = chance_rows(1, 60, 14)
    assert found(spark, rows) == brute(rows)


def test_hot_conversation_and_hot_parent(spark, monkeypatch):
    monkeypatch.setattr(trie, "STRETCH", 16)
    rows = [(1000, k, "user", f"t{k % 3}") for k in range(300)]  # most rows are one conversation
    rows += [(c, k, "user", x) for c in range(2000, 2100, 5) for k, x in enumerate(["same", f"own {c}", "more"])]
    rows += [(c, 0, "user", "copy") for c in range(3000, 3050, 5)]
    assert found(spark, rows) == brute(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    out = trie.trie(*trie.rebuilt(trie.placed(df)), heavy=4)  # the parent "same" is broadcast
    assert {(r["conv_id"], r["depth"]): r["parent_conv_id"] for r in out.collect()} == {k: v[0] for k, v in brute(rows).items()}


def test_odd(spark):
    rows = [(None, 0, "user", "nobody's"), (1, None, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (1, 0, "bot", "tie"), (2, None, "user", None), (2, None, "user", None), (-3, 5, None, "a b"), (5, 0, "", ""), (6, 1, "u", "x" * 200_000)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == {}
    assert found(spark, [(None, 1, "user", "x")]) == {}
