"""The pipeline's near-dedup stage against brute force over all pairs."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from csift.llm import similar, simhash


def word_sets(texts):
    for t in texts:
        w = (t or "").lower().split()
        yield frozenset([tuple(w)] if 0 < len(w) <= 5 else zip(w, w[1:], w[2:], w[3:], w[4:]))


def brute_force(ids, texts):
    sets, root = list(word_sets(texts)), list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if root[i] != root[j] and 5 * both >= 4 * (len(x) + len(sets[j]) - both):
                gone, root = root[i], [root[j] if r == root[i] else r for r in root]
    return sorted(min(i for i, r in zip(ids, root) if r == k) for k in set(root))


def near_copies():
    chance, out = random.Random(5), []
    words = [f"w{i}" for i in range(3000)]
    for _ in range(40):
        base = chance.choices(words, k=chance.choice([3, 6, 40, 150, 600]))
        out.append(" ".join(base))
        for _ in range(chance.choice([1, 2, 8])):
            copy = list(base)
            for _ in range(chance.randint(0, max(1, len(base) // 30))):
                copy[chance.randrange(len(copy))] = chance.choice(words)
            if chance.random() < 0.3:
                copy += chance.choices(words, k=len(copy) // 5)
            out.append(" ".join(copy))
    return [*out, "", None, " \n", "Ab c", "ab  C"]


def test_stage_finds_every_pair(spark):
    texts = near_copies()
    ids = random.Random(6).sample(range(10_000), len(texts))
    docs = spark.createDataFrame([(i, t, "en") for i, t in zip(ids, texts)], "doc_id long, text string, lang string")
    out = corpus_pipeline.near_deduplication(spark, docs, "")
    wanted = brute_force(ids, texts)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == wanted and len(wanted) < len(texts)
    # neither the order of the shingles nor the number of rounds matters
    kept = simhash.drop_near_copies(docs, similarity=(4, 5), sample=20, most=5, small=2, rounds=2)
    assert sorted(r["doc_id"] for r in kept.collect()) == wanted
    assert corpus_pipeline.near_deduplication(spark, docs.limit(0), "").count() == 0


def edited(group, count, edits, chance):
    """Copies of a text with edits that are each copy's own."""
    base = [f"g{group}w{i}" for i in range(150)]
    for k in range(count):
        copy = list(base)
        for at in chance.sample(range(len(base)), edits(k)):
            copy[at] = f"own{group}-{k}-{at}"
        yield " ".join(copy)


def test_large_groups_make_no_squares(spark, monkeypatch):
    """Links are found from central copies; pairs of a group's members aren't compared one by one."""
    chance = random.Random(8)
    texts = [*edited(0, 160, lambda k: chance.choice([0, 1, 2, 3, 4, 5, 6]), chance), *edited(1, 60, lambda k: k % 3, chance)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    counts, possible = [], similar.Comparison.possible

    def counted(self, pairs):
        out = possible(self, pairs)
        counts.append(out.count())
        return out

    monkeypatch.setattr(similar.Comparison, "possible", counted)
    monkeypatch.setattr(similar, "PART", 7)
    kept = sorted(r["doc_id"] for r in simhash.drop_near_copies(docs, similarity=(4, 5), small=20).collect())
    assert kept == brute_force(range(len(texts)), texts)
    assert sum(counts) < 6 * len(texts)


def test_one_doc_id_with_two_texts_is_two_documents(spark):
    rows = [(1, "one text about a river and a stone"), (1, "another text, of clouds and quiet houses"), (1, "one text about a river and a stone"), (None, "x"), (None, "y"), (None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("point", F.lit(1)).withColumn("root", F.lit(2)).repartition(3)
    for similarity in (None, (4, 5)):
        kept = simhash.drop_near_copies(docs, similarity=similarity)
        assert kept.columns == docs.columns
        assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted({(i or 0, t) for i, t in rows})


def test_fingerprints_link_first(spark, monkeypatch):
    """SimHash links are the stage's first candidates; what they link is confirmed, and isn't compared again."""
    chance = random.Random(9)
    texts = [*edited(0, 20, lambda k: k % 2, chance), *edited(1, 5, lambda k: 8 * k, chance), "a short text", ""]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    compared, confirmed = [], similar.Comparison.confirmed

    def told(self, pairs):
        out = confirmed(self, pairs)
        compared.append(({tuple(r) for r in pairs.select("a", "b").collect()}, {tuple(r) for r in out.collect()}))
        return out

    monkeypatch.setattr(similar.Comparison, "confirmed", told)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_deduplication(spark, docs, "").collect())
    assert kept == brute_force(range(len(texts)), texts)
    code = {}
    for t in texts:
        held = similar.shingles_of(t.encode())
        code[similar.point_of(held) - (1 << 64) * (similar.point_of(held) >> 63)] = simhash.fingerprint_of(held) % (1 << 64)
    first, linked = compared[0]
    assert linked and linked <= first
    near = {(a, b) for a in code for b in code if a < b and (code[a] ^ code[b]).bit_count() <= simhash.REACH}
    groups = {frozenset(x) for x in near}
    assert {frozenset(x) for x in first} & groups and not linked & set().union(*(pairs for pairs, _ in compared[1:]))
