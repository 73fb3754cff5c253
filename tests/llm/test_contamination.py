"""Benchmark decontamination against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from csift.llm import contamination

SCHEMA = "doc_id long, text string, lang string"
ITEMS = "item_id long, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, window, near):
    counts = Counter(w for _, text, _ in docs for w in words(text))
    asked = {}
    for i, text in items:
        w = words(text)
        if w:
            asked.setdefault("" if i is None else str(i), set()).update(tuple(w[k : k + window]) for k in range(max(1, len(w) - window + 1)))
    phrases = {p: sorted(set(p), key=lambda t: (counts[t], t))[:2] for own in asked.values() for p in own}
    out = []
    for doc_id, text, _ in docs:
        w, hit, found, close = words(text), set(), set(), set()
        at = {}
        for k, x in enumerate(w):
            at.setdefault(x, []).append(k)
        for p, rare in phrases.items():
            places = [k for k in at.get(p[0], []) if tuple(w[k : k + len(p)]) == p]
            hit.update(x for k in places for x in range(k, k + len(p)))
            if places:
                found.add(p)
            if any(len(rare) == 1 or any(abs(a - b) <= near for b in at.get(rare[1], [])) for a in at.get(rare[0], [])):
                close.add(p)
        named = sorted(i for i, own in asked.items() if own & found)
        out.append((doc_id, len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit), sum(bool(own & (close | found)) for own in asked.values())))
    return sorted(map(repr, out))


def found(spark, docs, items, **how):
    clash = {c: F.lit(1) for c in ("key", "row", "item", "start", "phrase", "n", "list")}
    out = contamination.contamination(spark.createDataFrame(docs, SCHEMA).withColumns(clash).repartition(3), spark.createDataFrame(items, ITEMS).withColumns(clash), **how)
    return sorted(map(repr, map(tuple, out.collect())))


@pytest.mark.parametrize("block", [20_000, 40])
def test_decontamination(spark, block):
    chance = random.Random(block)
    common, rare = ["the", "of", "in", "é", "a1"], [f"word{i}" for i in range(60)]
    some = lambda n: [chance.choice(common if chance.random() < 0.6 else rare) for _ in range(n)]
    items = [(i, " ".join(some(n))) for i, n in enumerate([3, 1, 2, 5, 6, 8, 12, 20, 9, 30])]
    items += [(7, "Second, text. OF item"), (None, "no id here at all"), (70, None), (71, "..."), (72, items[6][1])]
    docs = []
    for i in range(80):
        w = some(chance.randint(0, 40))
        for _ in range(chance.randint(0, 3)):
            k = chance.randint(0, len(w))
            w[k:k] = words(chance.choice(items)[1])
        docs.append((i, ", ".join(w).title() if i % 3 else " ".join(w), None))
    docs += [(None, items[7][1], "x"), (None, items[7][1], "x"), (900, None, None), (901, "", None), (902, "the of " * 3000 + items[9][1], None), (903, f"{items[9][1]} {items[9][1]}", None)]
    assert found(spark, docs, items, window=5, near=3, block=block) == brute(docs, items, 5, 3)


def test_hot_passage(spark):
    item = " ".join(f"p{i}" for i in range(14))
    docs = [(i, f"own{i} {item} end" if i % 3 else f"own{i} p3 p4", None) for i in range(200)]
    assert found(spark, docs, [(1, item)]) == brute(docs, [(1, item)], 10, 20)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a b")]) == []
    assert found(spark, [(1, "a b", None)], []) == brute([(1, "a b", None)], [], 10, 20)
