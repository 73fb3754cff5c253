"""Quality classifier: a sparse ensemble of rules, compiled into Spark columns.

Statistics of a text are Spark columns. On a bounded sample of labelled rows (SAMPLE, of rows that aren't held out)
small regression trees are boosted; each path from a root gives a rule, a conjunction of conditions on statistics; an
L1 logistic regression over the rules keeps few of them; and the rules with their weights become one expression.
Labels, lang, source and doc_id are no input of a score.

Defined results: null and empty text have all statistics 0 and a score like any other; without labels of both kinds
every score is 1 (nothing is rejected); a doc_id with several labels counts once, by the least, and one with several
texts by the least text; repeated rows score alike; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from csift.llm.common import hash_sample, whole_text
from csift.llm.linear import Dense, fit_logistic, sigmoid

SAMPLE = 12_000
TREES, DEPTH, BINS, RATE = 60, 3, 48, 0.3
SHRINK = 4e-4
THRESHOLD = 0.7


def held_out_column() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def statistics(text: str = "text") -> dict[str, Column]:
    """Ratios are 0 where there is nothing to count."""
    whole = whole_text(text)
    words = F.array_remove(F.split(whole, r"[\x20\x09-\x0D]+"), "")
    lines = F.array_remove(F.split(whole, "\n"), "")
    chars, count = F.length(whole), F.size(words)

    def ratio(part: Column, of: Column) -> Column:
        return F.when(of > 0, part / of).otherwise(0.0).cast("double")

    def share(pattern: str) -> Column:
        return ratio(chars - F.length(F.regexp_replace(whole, pattern, "")), chars)

    return {
        "chars": F.log1p(chars),
        "words": F.log1p(count),
        "word_length": ratio(chars - F.length(F.regexp_replace(whole, r"[^\x20\x09-\x0D]+", "")), count),
        "distinct_words": ratio(F.size(F.array_distinct(words)), count),
        "words_per_distinct": ratio(count, F.size(F.array_distinct(words))),
        "lines": F.log1p(F.size(lines)),
        "distinct_lines": ratio(F.size(F.array_distinct(lines)), F.size(lines)),
        "line_length": F.log1p(ratio(chars, F.size(lines))),
        "capitals": share(r"\p{Lu}+"),
        "digits": share(r"\p{N}+"),
        "symbols": share(r"[^\p{L}\p{N}\s]+"),
        "odd_symbols": share(r"[^\p{L}\p{N}\s.,;:'\"()-]+"),
        "repeated_symbols": share(r"([^\p{L}\p{N}\s])\1+"),
        "white": share(r"\s+"),
    }


@dataclass(frozen=True)
class Rule:
    """Conditions (statistic's index, whether above, bound) that hold together, and a weight."""

    conditions: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        return functools.reduce(np.logical_and, [(x[:, i] > b) == above for i, above, b in self.conditions])

    def column(self, statistics: list[Column]) -> Column:
        return functools.reduce(lambda a, b: a & b, [statistics[i] > b if above else statistics[i] <= b for i, above, b in self.conditions])


def _bounds(x: np.ndarray) -> list[np.ndarray]:
    """Candidate bounds, between quantiles of each statistic."""
    out = []
    for column in x.T:
        levels = np.unique(np.quantile(column, np.linspace(0, 1, BINS), method="nearest"))
        out.append((levels[1:] + levels[:-1]) / 2)
    return out


def grow(x: np.ndarray, residual: np.ndarray, bounds: list[np.ndarray], binned: np.ndarray, depth: int, least: int) -> tuple[list[tuple], np.ndarray]:
    """A tree's paths (each a tuple of conditions), and its prediction for each row: leaves predict mean residuals."""
    paths, prediction = [], np.zeros(len(x))
    todo = [((), np.arange(len(x)))]
    while todo:
        conditions, rows = todo.pop()
        best = (1e-9, None, None)
        if len(conditions) < depth and len(rows) >= 2 * least:
            total, n = residual[rows].sum(), len(rows)
            for i, levels in enumerate(bounds):
                if not len(levels):
                    continue
                counts = np.bincount(binned[rows, i], minlength=len(levels) + 1).cumsum()[:-1]
                sums = np.bincount(binned[rows, i], residual[rows], len(levels) + 1).cumsum()[:-1]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = sums**2 / counts + (total - sums) ** 2 / (n - counts) - total**2 / n
                gain[(counts < least) | (n - counts < least)] = -1
                if gain.max() > best[0]:
                    best = (gain.max(), i, levels[gain.argmax()])
        if best[1] is None:
            prediction[rows] = residual[rows].mean() if len(rows) else 0.0
            continue
        _, i, bound = best
        above = x[rows, i] > bound
        for side in (False, True):
            path = (*conditions, (i, side, float(bound)))
            paths.append(path)
            todo.append((path, rows[above == side]))
    return paths, prediction


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, shrink: float = SHRINK) -> tuple[list[Rule], float]:
    """Rules with weights that aren't 0, and the intercept."""
    if len(y) == 0 or y.min() == y.max():
        return [], 50.0
    bounds = _bounds(x)
    binned = np.stack([np.searchsorted(b, c, side="left") for b, c in zip(bounds, x.T)], 1)
    chance, margin, paths = np.random.default_rng(5), np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(trees):
        drawn = np.sort(chance.permutation(len(y))[: max(1, len(y) * 3 // 5)])
        residual = y - sigmoid(margin)
        found, _ = grow(x[drawn], residual[drawn], bounds, binned[drawn], depth, max(3, len(drawn) // 400))
        if not found:
            break
        paths.update(dict.fromkeys(tuple(sorted(p)) for p in found))
        # the tree's step on all rows: leaves are the paths that no other path extends
        leaves = [p for p in found if not any(q[: len(p)] == p and len(q) > len(p) for q in found)]
        for p in leaves:
            rows = Rule(p).holds(x)
            if rows.any():
                s = sigmoid(margin[rows])
                margin[rows] += RATE * np.clip((y[rows] - s).sum() / max((s * (1 - s)).sum(), 1e-3), -4, 4)
    rules = [Rule(p) for p in sorted(paths)]
    matrix = np.stack([r.holds(x) for r in rules], 1).astype(np.float64)
    varied = (matrix.mean(0) > 0.002) & (matrix.mean(0) < 0.998)
    rules, matrix = [r for r, v in zip(rules, varied) if v], matrix[:, varied]
    if not rules:
        return [], float(np.log(y.mean() / (1 - y.mean())))
    weights, intercept = fit_logistic(Dense(matrix), y, shrink, 1500)
    return [Rule(r.conditions, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-4], intercept


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """docs of about `sample` labelled doc_ids at most that aren't held out, chosen by a hash, with _csift_label."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out_column())
    chosen = hash_sample(known, "doc_id", sample).groupBy("doc_id").agg(F.min(label).alias("_csift_label"))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "_csift_label").agg(F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[Rule], float]:
    table = labelled(docs, labels, "quality", sample).select(F.col("_csift_label").cast("double"), *[c.alias(name) for name, c in statistics().items()]).toPandas().to_numpy(np.float64)
    table = table[np.lexsort(table.T[::-1])]  # any order of rows gives the same model
    return fit(table[:, 1:], table[:, 0])


def score_column(rules: list[Rule], intercept: float, statistics: list[Column]) -> Column:
    """The rules as one expression."""
    margin = functools.reduce(lambda a, b: a + b, [F.when(r.column(statistics), r.weight).otherwise(0.0) for r in rules], F.lit(intercept))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with _csift_score."""
    rules, intercept = train(docs, labels, sample)
    found = statistics()
    used = sorted({i for r in rules for i, _, _ in r.conditions})
    names = list(found)
    # the row's number keeps Spark from computing the statistics once for each rule that a filter names
    held = docs.withColumn("_csift_statistics", F.struct(F.monotonically_increasing_id().alias("_row"), *[found[names[i]].alias(names[i]) for i in used]))
    columns = [F.col(f"_csift_statistics.{n}") if i in used else F.lit(0.0) for i, n in enumerate(names)]
    score = F.when(F.col("_csift_statistics._row") >= 0, score_column(rules, intercept, columns))
    return held.withColumn("_csift_score", score).drop("_csift_statistics")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **parameters) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    return scored(docs, labels, **parameters).select(
        "doc_id", held_out_column().alias("held_out"), F.col("_csift_score").alias("score"), (F.col("_csift_score") >= threshold).cast("int").alias("predicted")
    )


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **parameters) -> DataFrame:
    """docs that aren't rejected, all columns."""
    return scored(docs, labels, **parameters).filter(F.col("_csift_score") >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
