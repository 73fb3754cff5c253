"""Benchmark decontamination over a positional inverted index.

Windows are runs of WINDOW words of a test item (a shorter item is one window). A first pass counts, over all training
documents, the words that windows have. Each window then asks for its LISTS rarest terms only. The second pass stores these
terms' postings: of each document, by position; a posting of a window's rarest term also holds the words around it. Lists
are offset-adjusted (position minus the term's place in the window) and intersected by document, window and start; an exact
match of all words follows on what is left. The same lists, not adjusted, give proximity matches: a window's rarest terms
within NEAR words of each other.

Test windows go in blocks of at most about BLOCK (item, window) pairs, dealt out by hash, each block against all
documents; so what is broadcast or made part of the plan (windows, terms) is bounded, however large the benchmark. Postings
are never shuffled by term: windows are brought to them, and the intersection is dealt out by (document, window), so
neither a term nor a passage that a third of all documents have makes a large task.

Defined results: null text has no words; a null item_id is the empty string; items with equal item_id are one item; each row
of documents gives a row, a repeated one again; without items nothing is contaminated; an empty table gives an empty
result; columns beside those named are ignored. Words are lower-cased in A-Z only. Main path: DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from csift.functions.lexing import let
from csift.llm.common import durable, row_identity, text_key
from csift.llm.divergence import lower_ascii

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Rarest terms of a window whose lists are intersected.
LISTS = 2
#: Words that a window's rarest terms may be apart in a proximity match.
NEAR = 20
#: (item, window) pairs that are searched in one pass.
BLOCK = 20_000


def words_of(text: str = "text") -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(F.col(text), F.lit(""))), F.lit(WORDS), F.lit(0))


def test_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item and phrase (its words) of each distinct window."""
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of().alias("words")).filter(F.size("words") > 0)
    last = F.greatest(F.size("words") - window + 1, F.lit(1))
    cut = let(F.col("words"), lambda w: F.transform(F.sequence(F.lit(1), last), lambda i: F.slice(w, i, window)))
    return words.select("item", F.explode(cut).alias("phrase")).distinct()


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term and n, its occurrences in all documents. terms: at most a block's."""
    return docs.select(F.explode(words_of()).alias("term")).join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def rarest_terms(docs: DataFrame, phrases: DataFrame, lists: int = LISTS) -> DataFrame:
    """phrase_id, term, offset (of its first place), list (from 0, the rarest) and lists of each phrase, a row a list."""
    places = phrases.select("phrase_id", F.posexplode("phrase").alias("offset", "term")).groupBy("phrase_id", "term").agg(F.min("offset").alias("offset"))
    counted = places.join(term_counts(docs, places.select("term").distinct()), "term", "left").fillna(0, ["n"])
    order = Window.partitionBy("phrase_id").orderBy("n", "term")
    ranked = counted.withColumn("list", F.row_number().over(order) - 1).filter(F.col("list") < lists)
    return ranked.withColumn("lists", F.count(F.lit(1)).over(Window.partitionBy("phrase_id"))).select("phrase_id", "term", "offset", "list", "lists")


def positional_index(docs: DataFrame, terms: list[str], rarest: list[str], window: int = WINDOW) -> DataFrame:
    """doc_id, key (tells documents apart), row, n_words and postings of each document.

    A posting is (pos, term, lead, around): around holds the words up to window - 1 places before and behind, of which
    lead are before; it is null for terms that aren't in `rarest`.
    """
    posting = "array<struct<pos:int,term:string,lead:int,around:array<string>>>"

    def postings(w: Column) -> Column:
        def of(i: Column) -> Column:
            lead, term = F.least(i, F.lit(window - 1)), F.get(w, i)
            around = F.when(term.isin(rarest), F.slice(w, i - lead + 1, lead + window))
            return F.struct(i.alias("pos"), term.alias("term"), lead.alias("lead"), around.alias("around"))

        places = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1)).otherwise(F.array().cast("array<int>"))
        found = F.transform(F.filter(places, lambda i: F.get(w, i).isin(terms)), of) if terms else F.array()
        return F.struct(F.size(w).cast("long").alias("n_words"), found.cast(posting).alias("postings"))

    made = docs.select("doc_id", text_key().alias("key"), let(words_of(), postings).alias("made"))
    return durable(made.select("doc_id", "key", row_identity().alias("row"), "made.*"))


def lists_of(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """row, phrase_id, pos, start (adjusted by the offset), bit of its list and bits of all: the postings of each phrase's terms."""
    rows = index.select("row", F.inline("postings")).select("row", "pos", "term")
    joined = rows.join(F.broadcast(anchors), "term")
    return joined.select("row", "phrase_id", "pos", (F.col("pos") - F.col("offset")).alias("start"), F.expr("shiftleft(1, list)").alias("bit"), F.expr("shiftleft(1, cast(lists as int)) - 1").alias("bits"))


def intersections(lists: DataFrame, near: int = NEAR) -> DataFrame:
    """row, phrase_id, start, adjusted (in all of the adjusted lists) and close (all lists have a place within `near` words)."""
    around = Window.partitionBy("row", "phrase_id").orderBy("pos").rangeBetween(-near, near)
    rows = lists.withColumn("close", (F.bit_or("bit").over(around) == F.col("bits")) & (F.col("bit") == 1))
    both = rows.groupBy("row", "phrase_id", "start").agg((F.bit_or("bit") == F.max("bits")).alias("adjusted"), F.bool_or("close").alias("close"))
    return both.filter("adjusted or close")


def exact_matches(index: DataFrame, met: DataFrame, phrases: DataFrame, anchors: DataFrame) -> DataFrame:
    """row, phrase_id, start and length of the phrase's occurrences."""
    first = anchors.filter("list = 0").select("phrase_id", "offset")
    asked = met.filter("adjusted and start >= 0").join(F.broadcast(first.join(phrases, "phrase_id")), "phrase_id").withColumn("pos", F.col("start") + F.col("offset"))
    held = index.select("row", F.inline("postings")).filter("around is not null").select("row", "pos", "lead", "around")
    same = F.slice("around", F.col("lead") - F.col("offset") + 1, F.size("phrase")) == F.col("phrase")
    return asked.join(held, ["row", "pos"]).filter((F.col("lead") >= F.col("offset")) & same).select("row", "phrase_id", "start", F.size("phrase").alias("length"))


def search(docs: DataFrame, pairs: DataFrame, lists: int = LISTS, near: int = NEAR, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index, matches, items) of a block of (item, phrase) pairs.

    matches: key, start, length. items: key, item, exact (one of its windows occurs; else it is a proximity match).
    """
    phrases = durable(pairs.select("phrase").distinct().withColumn("phrase_id", row_identity()))
    anchors = durable(rarest_terms(docs, phrases, lists))
    names = [(r["term"], r["best"]) for r in anchors.groupBy("term").agg(F.min("list").alias("best")).collect()]
    index = positional_index(docs, sorted(t for t, _ in names), sorted(t for t, best in names if best == 0), window)
    met = durable(intersections(lists_of(index, anchors), near))
    exact = durable(exact_matches(index, met, phrases, anchors))
    keys = index.select("row", "key")
    matches = exact.select("row", "start", "length").distinct().join(keys, "row").select("key", "start", "length")
    found = exact.select("row", "phrase_id", F.lit(True).alias("exact")).unionByName(met.filter("close").select("row", "phrase_id", F.lit(False).alias("exact")))
    found = found.groupBy("row", "phrase_id").agg(F.max("exact").alias("exact"))
    named = F.broadcast(pairs.join(phrases, "phrase").select("phrase_id", "item"))
    items = found.join(named, "phrase_id").groupBy("row", "item").agg(F.max("exact").alias("exact")).join(keys, "row").select("key", "item", "exact")
    return index, matches, items


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, lists: int = LISTS, near: int = NEAR, block: int = BLOCK) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated and n_near.

    n_near counts items of which a window's rarest terms occur near each other, those that match exactly among them.
    """
    pairs = durable(test_windows(items, window))
    blocks = max(1, -(-pairs.count() // block))
    parts = [search(docs, pairs.filter(F.pmod(F.xxhash64("item", "phrase"), F.lit(blocks)) == b), lists, near, window) for b in range(blocks)]
    base = parts[0][0].select("doc_id", "key", "n_words")
    spans, named = (reduce(DataFrame.unionByName, [p[i] for p in parts]) for i in (1, 2))
    ends = F.col("start") + F.col("length")
    before = Window.partitionBy("key").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.distinct().withColumn("upto", F.coalesce(F.max(ends).over(before), F.lit(0)))
    hit = spans.groupBy("key").agg(F.sum(F.greatest(ends - F.greatest("start", "upto"), F.lit(0))).alias("n_hit"))
    named = named.groupBy("key", "item").agg(F.max("exact").alias("exact"))
    named = named.groupBy("key").agg(F.array_sort(F.collect_list(F.when(F.col("exact"), F.col("item")))).alias("found"), F.count(F.lit(1)).alias("n_near"))
    none = F.array().cast("array<string>")
    out = base.join(hit, "key", "left").join(named, "key", "left").withColumn("found", F.coalesce("found", none))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size("found").cast("long").alias("n_items"), F.sha2(F.array_join("found", ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )
