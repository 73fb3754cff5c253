"""Toxicity by ordinal regression: grades 0 (none), 1 and 2, by a cumulative link over sparse text features.

Labels say only whether a document is toxic. Its grade comes from the sample: a word is telling if it stands in
toxic rows far more often than in others; a toxic row with STRONG or more distinct telling words has grade 2, another
has grade 1. The sample is halved for that, by a hash: the words that grade a row are those that the other half's
rows show to be telling. The model P(grade > k) = sigmoid(w x - cut[k]) shares w over the cuts; its features are
which of at most TERMS words of the sample, and of beginnings that several of its words share, a text has, wherever
they stand. The expected severity
is the sum of P(grade > k).

Defined results: null and empty text have no features; without toxic and other labelled rows every severity is 0;
a doc_id with several labels counts once, by the least, and one with several texts by the least text; repeated rows
score alike; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from csift.llm.common import durable, slices
from csift.llm.linear import Rows, fit_cumulative, sigmoid
from csift.llm.quality import held_out_column, labelled

SAMPLE = 8_000
TERMS = 4000
LEAST = 3
STRONG = 3
SHRINK = 5e-5
THRESHOLD = 0.4
LEVELS = 3
WORDS = re.compile(r"[^\W_]+")
#: Lengths of word beginnings, and numbers of distinct longer words with one that are a term: so words that are made of
#: one stem count together, but not one alone.
BEGINNINGS = (5, 6)
SEVERAL = (2, 3)
PIECE = 1 << 20


def words_of(text: str) -> set[str]:
    """The words, a piece of the text at a time: a long text has few distinct ones."""
    out: set[str] = set()
    at = 0
    while at < len(text):
        gap = re.compile(r"[\W_]").search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        out.update(WORDS.findall(text[at:end].lower()))
        at = end
    return out


def terms_of(text: str | None) -> set[str]:
    """Words, and beginnings with the number of words that have them (`begin*2`)."""
    words = words_of(text or "")
    counts = Counter(w[:k] for w in words for k in BEGINNINGS if len(w) > k)
    return words.union(f"{begin}*{m}" for begin, n in counts.items() for m in SEVERAL if n >= m)


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    cuts: tuple[float, ...]

    def over(self, text: str | None) -> np.ndarray:
        """P(grade > k) for each k."""
        get = self.weights.get
        return sigmoid(sum(get(t, 0.0) for t in sorted(self.weights.keys() & terms_of(text))) - np.array(self.cuts))


def telling(a, b, n_yes: int, n_no: int):
    """z of the difference of smoothed logarithmic odds of a term in a of n_yes toxic and b of n_no other texts."""
    a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
    c, d = n_yes - a + 0.5, n_no - b + 0.5
    a, b = a + 0.5, b + 0.5
    return np.log(a * d / (b * c)) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)


def fit(terms: list[str], yes: np.ndarray, no: np.ndarray, rows: Rows, toxic: np.ndarray, half: np.ndarray, shrink: float = SHRINK) -> Model:
    """terms: features, with the numbers of toxic and of other texts of each half that have them (terms x halves);
    rows: which text has which; toxic and half of each text."""
    words = np.array(["*" not in t for t in terms], bool)
    telling_words = np.zeros(len(toxic))
    for h in (0, 1):
        other = 1 - h
        n_yes, n_no = int(toxic[half == other].sum()), int((1 - toxic[half == other]).sum())
        a, b = yes[:, other], no[:, other]
        strong = words & (telling(a, b, n_yes, n_no) > 3) & (a * max(n_no, 1) > 10 * b * max(n_yes, 1))
        telling_words += np.where(half == h, rows.times(strong.astype(np.float64)), 0.0)
    grades = np.where(toxic == 0, 0, np.where(telling_words >= STRONG, 2, 1))
    weights, cuts = fit_cumulative(rows, grades, LEVELS, shrink)
    return Model({t: float(w) for t, w in zip(terms, weights) if abs(w) > 1e-4}, tuple(float(c) for c in cuts))


NOTHING = Model({}, (50.0,) * (LEVELS - 1))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Counts of terms are made in Spark; the driver gets at most TERMS terms, and which of them the sample's texts have."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            found = pa.array([sorted(terms_of(x)) for x in part.column("text").to_pylist()], pa.list_(pa.string()))
            yield pa.record_batch([part.column("doc_id"), part.column("label"), part.column("half"), found], ["doc_id", "label", "half", "terms"])

    half = F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(2)).alias("half")
    chosen = labelled(docs, labels, "toxic", sample).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_csift_label").cast("long").alias("label"), half, F.col("text").cast("string").alias("text"))
    texts = durable(chosen.mapInArrow(split, "doc_id long, label long, half long, terms array<string>"))
    n_yes, n = texts.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count(F.lit(1))).first()
    if not n_yes or n_yes == n:
        return NOTHING
    of = lambda label, h: F.sum(((F.col("label") == label) & (F.col("half") == h)).cast("long")).alias(f"n{label}{h}")
    counts = texts.select("label", "half", F.explode("terms").alias("term")).groupBy("term").agg(*[of(label, h) for label in (0, 1) for h in (0, 1)])
    counts = counts.withColumn("yes", F.col("n10") + F.col("n11")).withColumn("no", F.col("n00") + F.col("n01"))
    a, b, c, d = F.col("yes") + 0.5, F.col("no") + 0.5, F.lit(n_yes) - F.col("yes") + 0.5, F.lit(n - n_yes) - F.col("no") + 0.5
    z = F.abs(F.log(a * d / (b * c)) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d))
    top = counts.filter(F.col("yes") + F.col("no") >= LEAST).orderBy(F.round(z, 9).desc(), "term").limit(TERMS).collect()
    index = docs.sparkSession.sparkContext.broadcast({r["term"]: i for i, r in enumerate(top)})

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [[index.value[t] for t in terms if t in index.value] for terms in batch.column("terms").to_pylist()]
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "label", "half")), pa.array(held, pa.list_(pa.int32()))], ["doc_id", "label", "half", "held"])

    found = texts.mapInArrow(numbered, "doc_id long, label long, half long, held array<int>").toPandas().sort_values("doc_id", kind="stable")
    held = [np.asarray(x, np.int64) for x in found["held"]]
    rows = Rows(np.repeat(np.arange(len(held)), [len(x) for x in held]), np.concatenate(held), (len(held), len(top)))
    yes, no = (np.array([[r[f"n{label}{h}"] for h in (0, 1)] for r in top]).reshape(-1, 2) for label in (1, 0))
    return fit([r["term"] for r in top], yes, no, rows, found["label"].to_numpy(np.int64), found["half"].to_numpy(np.int64))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, expected_severity, severity (the likeliest grade), score (P of any toxicity), predicted of each row."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            over = np.array([model.value.over(x) for x in part.column("text").to_pylist()])
            mass = np.diff(-np.hstack([np.ones((len(over), 1)), over, np.zeros((len(over), 1))]))
            columns = [over.sum(1), mass.argmax(1).astype(np.int32), over[:, 0], (over[:, 0] >= threshold).astype(np.int32)]
            yield pa.record_batch([part.column("doc_id"), part.column("held_out"), *map(pa.array, columns)], ["doc_id", "held_out", "expected_severity", "severity", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out_column().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, expected_severity double, severity int, score double, predicted int")
