"""Rules of a user's own: over lines, over facts, or as a query."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.cloudpickle import dumps
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from csift.rules.lines import each, hit

#: A scan's own rules are numbered from here on, in order.
NUMBERS = 1000


@dataclass(frozen=True)
class CustomRule:
    """One of: condition(line, masked) -> Column, evaluated natively; scan_line(line, masked) -> message or None, in
    Python; query(parses) -> DataFrame of (path, line, column, message).

    Findings of these rules are suppressed, overridden and made distinct like any others."""

    rule_id: str
    name: str
    impact: str = "Medium"
    remediation: str = ""
    cwe_id: str = ""
    message: str = ""
    condition: Callable[[Column, Column], Column] | None = None
    scan_line: Callable[[str, str], str | None] | None = None
    query: Callable[[DataFrame], DataFrame] | None = None

    def __post_init__(self):
        if sum(x is not None for x in (self.condition, self.scan_line, self.query)) != 1:
            raise ValueError(f"{self.rule_id}: give one of condition, scan_line and query")
        if self.scan_line is not None:
            try:
                dumps(self.scan_line)
            except Exception as error:
                raise ValueError(f"{self.rule_id}: its function cannot be sent to workers") from error


_registered: dict[str, CustomRule] = {}


def register(rule: CustomRule) -> CustomRule:
    _registered[rule.rule_id] = rule
    return rule


def registered(rule_id: str) -> CustomRule:
    if rule_id not in _registered:
        raise KeyError(f"no rule {rule_id} is registered")
    return _registered[rule_id]


def hits_of(rows: DataFrame, lines: Column, rules: tuple[CustomRule, ...]) -> tuple[DataFrame, list[Column]]:
    """(rows, hits): of conditions, where a file's row lies, and of queries, by one join of what they find, a row a file.

    Hits of functions are found with the file's other ones, so that a function that fails fails its file alone.
    """
    parts = []
    for k, rule in enumerate(rules):
        if rule.condition is not None:
            found = lambda x, k=k, rule=rule: F.when(rule.condition(x["line"], x["masked"]), hit(NUMBERS + k, x["n"], F.lit(1), rule.message or rule.name))
            parts.append(each(lines, found))
    queries = None
    for k, rule in enumerate(rules):
        if rule.query is not None:
            found = rule.query(rows).select("path", hit(NUMBERS + k, F.col("line"), F.col("column"), F.col("message"), engine="AST").alias("hit"))
            queries = found if queries is None else queries.unionByName(found)
    if queries is not None:
        rows = rows.join(queries.groupBy("path").agg(F.collect_list("hit").alias("_queried")), "path", "left")
        parts.append(F.col("_queried"))
    return rows, parts
