"""Source divergence audit: how sources of a language differ in their words, and by which.

Each language keeps the terms that enough of its documents have. A group (language and source) gives each kept term a
smoothed share p in billionths, whole numbers throughout; a term that it doesn't have gets its baseline b. The distance
of two groups g and h sums |p - q| over all kept terms, but only terms that a group has are looked at: with no terms it
is V |b_g - b_h|; a term of g alone changes that by |p - b_h| - |b_g - b_h|, which running sums over g's distinct shares
give for every b_h at once; and a term of both takes off twice the overlap of [b_g, p] and [b_h, q] from the two
changes. Terms by which a group exceeds its language are ranked by radix select (`csift.llm.radix`).

Each document adds a term's occurrences and, once, the document itself. Both are summed where the rows lie, by (language,
source, term), in numpy over a slice's bytes and then in Spark, so a source of any size is many partial sums. Joins with a group's or a language's values are
salted.

Defined results: null text, lang and source are empty; a repeated row counts again; a group without terms, or a language
without kept terms, has pairs of value 0 or of its baselines, and no term rows; a source alone in its language has no pair;
an empty table gives an empty result; columns beside the three are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from csift.llm.common import durable, slices
from csift.llm.radix import salted_join, top_ranks

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents of its language that a kept term has at least; what is added to each count; the whole; ranks of terms.
DOCUMENTS, ADDED, WHOLE, RANKS = 30, 5, 1_000_000_000, 50
#: Bytes of texts that are counted together, and that are looked at at once.
SLICE, PIECE = 16 << 20, 8 << 20


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else; a text of ASCII only takes the faster way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


#: By byte: what it is in lower case, and whether terms have it (letters, and all of a character beyond ASCII).
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
OF_TERM = np.isin(LOWERED, np.arange(97, 123)) | (np.arange(256) >= 128)


def _pieces(data: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of about `most` bytes that end where a term can't go on."""
    begin = 0
    while begin < len(data):
        end = begin + most
        while end < len(data) and OF_TERM[data[end]]:
            gaps = np.flatnonzero(~OF_TERM[data[end : end + most]])
            end = min(len(data), end + (int(gaps[0]) if len(gaps) else most))
        yield begin, min(end, len(data))
        begin = end


def text_terms(texts: pa.StringArray, most: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.StringArray]:
    """(text's number, term's number, occurrences) of each term of each text, and the terms. Texts are read a piece at a time."""
    texts = texts.cast(pa.large_string())
    raw, at = texts.buffers()[2], np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(raw, np.uint8)[at[0] : at[-1]] if raw else np.empty(0, np.uint8)
    at = at - at[0]
    found = []
    for begin, end in _pieces(data, most):
        part = LOWERED[data[begin:end]]
        inside = OF_TERM[part]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        heads = at[(at >= begin) & (at < end)] - begin
        starts[heads] = inside[heads]  # a text's first byte begins a term, whatever the text before ends with
        starts = np.flatnonzero(starts)
        offsets = np.append(np.cumsum(inside, dtype=np.int32)[starts] - 1, inside.sum()).astype(np.int32)
        terms = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(part[inside])).dictionary_encode()
        own, width = np.searchsorted(at, starts + begin, "right") - 1, max(1, len(terms.dictionary))
        pairs, counts = np.unique(own * width + terms.indices.to_numpy(), return_counts=True)
        found.append((pairs // width, pairs % width, counts, terms.dictionary))
    if len(found) == 1:
        return found[0]
    if not found:
        return np.empty(0, int), np.empty(0, int), np.empty(0, int), pa.array([], pa.string())
    terms = pa.concat_arrays([d.take(pa.array(c)) for _, c, _, d in found]).dictionary_encode()
    width = max(1, len(terms.dictionary))
    pairs, where = np.unique(np.concatenate([o for o, *_ in found]) * width + terms.indices.to_numpy(), return_inverse=True)
    return pairs // width, pairs % width, np.bincount(where, np.concatenate([n for _, _, n, _ in found])).astype(int), terms.dictionary


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SLICE):
        lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
        own, term, counts, terms = text_terms(batch.column("text"))
        width, sources = max(1, len(terms)), len(source.dictionary)
        group = lang.indices.to_numpy().astype(np.int64) * sources + source.indices.to_numpy()
        keys, where = np.unique(group[own] * width + term, return_inverse=True)
        take = lambda values, at: values.take(pa.array(at))
        yield pa.RecordBatch.from_arrays(
            [take(lang.dictionary, keys // width // sources), take(source.dictionary, keys // width % sources), take(terms, keys % width), pa.array(np.bincount(where, counts).astype(np.int64)), pa.array(np.bincount(where).astype(np.int64))],
            names=["lang", "source", "term", "count", "docs"],
        )


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count (occurrences) and docs (documents of the group that have it)."""
    filled = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    rows = filled.mapInArrow(_counted, "lang string, source string, term string, count long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def kept_counts(counts: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """lang, source, term, count and lang_count (occurrences in the language) of kept terms."""
    by_term = Window.partitionBy("lang", "term")
    both = counts.withColumns({"lang_docs": F.sum("docs").over(by_term), "lang_count": F.sum("count").over(by_term)})
    return both.filter(F.col("lang_docs") >= documents).select("lang", "source", "term", "count", "lang_count")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(WHOLE * (count + ADDED) / (total + ADDED * kept)), exactly."""
    long = lambda x, digits: x.cast(f"decimal({digits},0)")
    quotient = F.call_function("div", long(count + ADDED, 20) * F.lit(WHOLE).cast("decimal(10,0)"), long(total + ADDED * kept, 20))
    return F.lit(1) + quotient


def group_values(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, total (occurrences of kept terms), kept (V), lang_total and base of every group that occurs."""
    groups = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    terms = kept.groupBy("lang", "term").agg(F.sum("count").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("lang_total"))
    values = groups.join(totals, ["lang", "source"], "left").join(terms, "lang", "left").fillna(0, ["total", "kept", "lang_total"])
    return durable(values.withColumn("base", F.when(F.col("kept") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))).otherwise(F.lit(0))))


def one_sided(shares: DataFrame, values: DataFrame) -> DataFrame:
    """lang, lo, hi, value: for each ordered pair of groups what the first one's terms alone change, and the base of both."""
    one = values.select("lang", "source", "kept", "base")
    pairs = one.join(one.select("lang", F.col("source").alias("item"), F.col("base").alias("other")), "lang").filter("source <> item")
    levels = shares.groupBy("lang", "source", F.col("share").alias("at")).agg(F.count(F.lit(1)).alias("n"), F.sum("share").alias("sum"))
    nothing = F.lit(0).cast("long")
    events = levels.select("lang", "source", "at", F.lit(0).alias("point"), "n", "sum", F.lit(None).cast("string").alias("item"), nothing.alias("kept"), nothing.alias("base"))
    points = pairs.select("lang", "source", F.col("other").alias("at"), F.lit(1).alias("point"), nothing.alias("n"), nothing.alias("sum"), "item", "kept", "base")
    group = Window.partitionBy("lang", "source")
    upto = group.orderBy("at", "point").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.unionByName(points).withColumns({"n1": F.sum("n").over(upto), "s1": F.sum("sum").over(upto), "n": F.sum("n").over(group), "s": F.sum("sum").over(group)}).filter("point = 1")
    above = F.col("n1") * F.col("base") - F.col("s1") + F.col("s") - F.col("s1") - (F.col("n") - F.col("n1")) * (2 * F.col("at") - F.col("base"))
    changed = F.when(F.col("at") <= F.col("base"), F.col("s") - F.col("n") * F.col("base")).otherwise(above)
    bases = F.when(F.col("source") < F.col("item"), F.col("kept") * F.abs(F.col("base") - F.col("at"))).otherwise(0)
    return rows.select("lang", F.least("source", "item").alias("lo"), F.greatest("source", "item").alias("hi"), (changed + bases).alias("value"))


def overlaps(shares: DataFrame) -> DataFrame:
    """lang, lo, hi, value: what terms of both groups take off."""
    a = shares.select("lang", "term", F.col("source").alias("lo"), F.col("share").alias("p"), F.col("base").alias("b"))
    b = shares.select("lang", "term", F.col("source").alias("hi"), F.col("share").alias("q"), F.col("base").alias("c"))
    both = a.join(b, ["lang", "term"]).filter("lo < hi").select("lang", "lo", "hi", (F.least("p", "q") - F.greatest("b", "c")).alias("common")).filter("common > 0")
    return both.groupBy("lang", "lo", "hi").agg((-2 * F.sum("common")).alias("value"))


def divergence(docs: DataFrame, documents: int = DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank."""
    kept = durable(kept_counts(term_counts(docs), documents))
    values = group_values(docs, kept)
    own = values.select("lang", "source", "total", "kept", "lang_total", "base")
    shares = durable(
        salted_join(kept, own, ["lang", "source"], "term")
        .withColumns({"share": share(F.col("count"), F.col("total"), F.col("kept")), "lang_share": share(F.col("lang_count"), F.col("lang_total"), F.col("kept"))})
        .select("lang", "source", "term", "share", "base", "lang_share")
    )
    sums = one_sided(shares, values).unionByName(overlaps(shares)).groupBy("lang", "lo", "hi").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct(F.col("lo").alias("source"), F.col("hi").alias("item")), F.struct(F.col("hi").alias("source"), F.col("lo").alias("item")))
    pairs = sums.select("lang", "value", F.inline(ways))
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
    beyond = shares.filter("share > lang_share").select("lang", "source", F.col("term").alias("item"), (F.col("share") - F.col("lang_share")).alias("value"))
    terms = top_ranks(beyond, ["lang", "source"], "value", "item", ranks)
    return pairs.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
