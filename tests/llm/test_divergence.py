"""The divergence audit and radix select against brute force."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from csift.llm import divergence, radix

SCHEMA = "doc_id long, text string, lang string, source string"


def words(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(rows, documents, ranks):
    had, counts = {}, {}
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        counts.setdefault(lang, {}).setdefault(source, Counter()).update(words(text))
        had.setdefault(lang, Counter()).update(set(words(text)))
    out = set()
    for lang, groups in counts.items():
        kept = [t for t, n in had[lang].items() if n >= documents]
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        p, q = {g: share(c) for g, c in groups.items()}, share(sum(groups.values(), Counter()))
        for g, c in groups.items():
            pairs = sorted(((-sum(abs(p[g][t] - p[h][t]) for t in kept), h.encode()) for h in groups if h != g))
            terms = sorted((q[t] - p[g][t], t.encode()) for t in kept if c[t] and p[g][t] > q[t])[:ranks]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, g, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)}
    return out


def found(spark, rows, documents, ranks):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("term", "count", "item", "value", "rank", "share", "base", "kept")}).repartition(3)
    out = [tuple(r) for r in divergence.divergence(df, documents, ranks).collect()]
    assert len(out) == len(set(out))
    return set(out)


@pytest.mark.parametrize("documents,ranks", [(3, 4), (1, 1000), (10, 50)])
def test_divergence(spark, documents, ranks):
    chance = random.Random(documents)
    many = ["The", "the", "É", "é", "ab1cd", "x", "long" * 40, "long" * 40 + "a", "漢字", "Z-z", "rare"] + [f"w{c}" for c in "abcdefghijkl"]
    rows = [(i, " ".join(chance.choices(many, range(1, len(many) + 1), k=chance.randint(0, 30))), chance.choice(["en", "en", "de", None]), chance.choice(["hot", "hot", "hot", "a", "b", None])) for i in range(120)]
    rows += [(500, None, "en", "silent"), (501, "", "en", "silent"), (502, "1 2 3", "fr", "alone"), (503, "1", "xx", "one"), (504, None, "xx", "two")] + [(505, "same text", "en", "a")] * 2
    rows.append((506, "long text " * 20_000, "en", "b"))
    assert found(spark, rows, documents, ranks) == brute(rows, documents, ranks)


@pytest.mark.parametrize("most", [1, 2, 7, 64, 1 << 20])
def test_terms_do_not_depend_on_pieces(most):
    chance = random.Random(most)
    texts = ["".join(chance.choice("aB é漢1 .Z\x00🙂") for _ in range(chance.randint(0, 60))) for _ in range(80)] + ["", "x" * 500]
    own, term, counts, terms = divergence.text_terms(pa.array([*texts, "cut off"]).slice(0, len(texts)), most)
    found = {}
    for o, t, n in zip(own.tolist(), term.tolist(), counts.tolist()):
        assert found.setdefault(o, {}).setdefault(terms[t].as_py(), n) == n
    assert found == {i: dict(Counter(words(t))) for i, t in enumerate(texts) if words(t)}


def test_no_documents(spark):
    assert found(spark, [], 30, 50) == set()


def test_radix_select(spark):
    chance = random.Random(9)
    rows = [("hot", chance.choice([0, 1, 7, 2**20, 2**30 - 1, chance.randrange(2**30)]), f"i{i:04}") for i in range(1500)]
    rows += [("tied", 5, x) for x in ("", "a", "aa", "é", "漢", "🙂", "￿", "z" * 3000, "z" * 3000 + "b", "z" * 3000 + "a", "z" * 2999)]
    rows += [("few", 3, "x"), ("few", 3, "y"), ("one", 0, "")]
    df = spark.createDataFrame(rows, "g string, v long, t string").repartition(4)
    for k in (1, 3, 8, 9, 10, 400):
        wanted = set()
        for g in {r[0] for r in rows}:
            best = sorted(((-v, t.encode()) for x, v, t in rows if x == g))[:k]
            wanted |= {(g, t.decode(), -v, n) for n, (v, t) in enumerate(best, 1)}
        assert {tuple(r) for r in radix.top_ranks(df, ["g"], "v", "t", k).collect()} == wanted
