"""Hits to findings, and what is done with findings: suppression, severities, first-wins dedup, fingerprints, order.

Hits of one file lie in one row, so suppression and dedup happen there, in arrays; nothing is shuffled until a report
wants an order or sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from csift.frontend.lexical import ONLY_WITHOUT_FACTS, RULES
from csift.functions.lexing import fingerprint, let, mask_literals, split_lines, suppressions
from csift.rules import catalog
from csift.rules.custom import NUMBERS, CustomRule, hits_of
from csift.rules.facts import FROM_PATHS, NEED_FACTS, fact_rules, from_front_end
from csift.rules.lines import HIT
from csift.schema import FINDING_COLUMNS

REGEX, AST, HYBRID = "regex", "ast", "hybrid"
CHUNK = 6


def numbered_lines(clean: Column, with_masks: bool = True) -> Column:
    """array<struct<n, line>>, and masked."""
    masks = lambda x: [mask_literals(x).alias("masked")] if with_masks else []
    return F.transform(split_lines(clean), lambda x, i: F.struct((i + 1).cast("int").alias("n"), x.alias("line"), *masks(x)))


def needs_facts(numbers, mode: str = HYBRID) -> bool:
    """Whether any of the rules looks at syntax facts in this mode; if none does, nothing need be parsed."""
    return mode != REGEX and not NEED_FACTS.isdisjoint(numbers)


def with_hits(parses: DataFrame, numbers, mode: str = HYBRID, reallocators: tuple[str, ...] = (), custom: tuple[CustomRule, ...] = ()) -> DataFrame:
    """Adds `hits`, all rules' hits of the file.

    The line form of a rule counts in regex and hybrid mode, there unless its facts say more (021); the fact form in
    ast and hybrid mode. Rules are evaluated a few a projection, so that no generated method grows too long.
    """
    rows = parses.withColumn("lines", numbered_lines(F.col("clean"), with_masks=any(r.condition for r in custom)))
    lines, parse = F.col("lines"), F.col("parse")
    by_fact = fact_rules(reallocators)
    line_forms = [n for n in numbers if n in RULES and mode != AST and not (mode == HYBRID and n in ONLY_WITHOUT_FACTS)]
    path_forms = [n for n in numbers if n in FROM_PATHS and mode != REGEX]
    functions = [NUMBERS + k for k, r in enumerate(custom) if r.scan_line is not None]
    parts: list[Column] = [from_front_end(parse, [*line_forms, *functions], path_forms)] if line_forms or path_forms or functions else []
    parts += [by_fact[n](parse, lines) for n in numbers if n in by_fact and (n == 13 or mode != REGEX)]
    rows, more = hits_of(rows, lines, custom)
    parts += more
    names = []
    for k in range(0, len(parts), CHUNK):
        names.append(f"_hits{k}")
        rows = rows.withColumn(names[-1], F.concat(*[F.coalesce(p, F.array()).cast(f"array<{HIT}>") for p in parts[k : k + CHUNK]]))
    together = F.concat(*names) if names else F.array().cast(f"array<{HIT}>")
    return rows.withColumn("hits", F.when(F.col("error").isNull(), together).otherwise(F.array().cast(f"array<{HIT}>"))).drop(*names)


def exploded(rows: DataFrame) -> DataFrame:
    """One row a hit, with its place in the order of emission; outer, then filtered, so that no rule is evaluated twice."""
    out = rows.select("path", "parse.confidence", F.posexplode_outer("hits").alias("emit_idx", "hit"))
    return out.filter("hit is not null")


def findings(
    rows: DataFrame, prefix: str = catalog.PREFIX, overrides: dict[str, str] | None = None, suppress: bool = True, keyword: str = "csift", numbers=None, custom: tuple[CustomRule, ...] = (),
) -> DataFrame:
    """All columns of findings, from file rows with hits: suppressed ones left out, the first of equal (rule, line, message) kept.

    numbers: the rules that the hits are of, if not all; the plan then holds only their texts. custom: a user's own
    rules, numbered from NUMBERS on; their message is their only parameter.

    A rule's severity is overridden before rule 001 lowers a bounded copy to Low.
    """
    none = F.array().cast("array<struct<line:int,rule_id:string>>")
    rules = [r for r in catalog.RULES if numbers is None or r.number in numbers]

    def by_rule(rule: Column, of) -> Column:
        """of(rule) by the rule's number."""
        pairs = [(r.number, of(r)) for r in rules] + [(NUMBERS + k, of(r)) for k, r in enumerate(custom)]
        return F.element_at(F.create_map(*[F.lit(x) for pair in pairs for x in pair]), rule) if pairs else F.lit(None).cast("string")

    def named(h: Column) -> Column:
        usual = F.concat(F.lit(f"{prefix}-"), F.lpad(h["rule"].cast("string"), 3, "0"))
        own = F.element_at(F.array(*[F.lit(r.rule_id) for r in custom]), h["rule"] - NUMBERS + 1) if custom else usual
        return F.when(h["rule"] < NUMBERS, usual).otherwise(own)

    def shown(s: Column) -> Column:
        hidden = lambda h: F.exists(s["directives"], lambda d: (d["line"] == h["line"]) & ((d["rule_id"] == "*") | (d["rule_id"] == F.upper(named(h)))))
        return F.filter(s["hits"], lambda h: ~hidden(h))

    def first(hits: Column) -> Column:
        """Hits sorted by what makes them equal stand beside each other; those kept go back to their order."""
        key = lambda h, i: F.struct(h["rule"].alias("rule"), h["line"].alias("line"), h["message"].alias("message"), i.alias("i"))
        apart = lambda a, b: (a["rule"] != b["rule"]) | (a["line"] != b["line"]) | (a["message"] != b["message"])
        kept = let(F.array_sort(F.transform(hits, key)), lambda keys: F.filter(keys, lambda x, k: (k == 0) | apart(x, F.get(keys, k - 1))))
        return F.transform(F.array_sort(F.transform(kept, lambda x: x["i"])), lambda i: F.get(hits, i))

    # a file without hits has no use for its directives
    directives = F.when(F.size("hits") > 0, suppressions(F.col("content"), keyword)).otherwise(none) if suppress else none
    kept = let(F.struct(F.col("hits").alias("hits"), directives.alias("directives")), shown)
    # the line pass comes first, then facts; among equal ones the first stays
    ordered = F.transform(F.array_sort(F.transform(kept, lambda h, i: F.struct(h["pass"].alias("pass"), i.alias("i"), h.alias("h")))), lambda x: x["h"])
    text = lambda h: F.when(h["rule"] < NUMBERS, catalog.message_column(h["rule"], h["parameters"], numbers)).otherwise(F.get(h["parameters"], F.lit(0)))
    told = let(F.transform(ordered, lambda h: h.withField("message", text(h))), first)
    raw_lines = let(split_lines(F.col("content")), lambda lines: F.transform("hits", lambda h: h.withField("raw", F.get(lines, h["line"] - 1))))
    out = exploded(rows.select("path", "content", "parse", told.alias("hits")).withColumn("hits", F.when(F.size("hits") > 0, raw_lines)))
    rule, parameters, line = F.col("hit.rule"), F.col("hit.parameters"), F.col("hit.line")
    fix, automatic, suggested = catalog.fix_columns(rule, parameters, numbers)
    raw = F.col("hit.raw")
    severity = by_rule(rule, lambda r: (overrides or {}).get(r.rule_id if isinstance(r, CustomRule) else catalog.rule_id(r.number, prefix), r.impact))
    out = out.select(
        named(F.col("hit")).alias("rule_id"),
        by_rule(rule, lambda r: r.name).alias("rule_name"),
        F.when((rule == 1) & (F.get(parameters, F.lit(0)) == "bounded"), "Low").otherwise(severity).alias("impact"),
        F.col("path").alias("file_path"),
        line.alias("line_number"),
        F.greatest(F.col("hit.column"), F.lit(1)).alias("column_number"),
        F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"^\s+|\s+$", "")).alias("code_snippet"),
        F.col("hit.message").alias("message"),
        by_rule(rule, lambda r: r.remediation).alias("remediation"),
        by_rule(rule, lambda r: r.cwe_id).alias("cwe_id"),
        F.col("hit.engine").alias("engine"),
        fix.alias("fix_type"),
        automatic.alias("auto_fix_replacement"),
        suggested.alias("suggested_fix_replacement"),
        "confidence",
    )
    marked = out.withColumn("fingerprint", fingerprint(F.col("rule_id"), F.col("file_path"), F.col("code_snippet")))
    return marked.select(*FINDING_COLUMNS)


THRESHOLDS = {"high": ("High",), "medium": ("High", "Medium"), "low": ("High", "Medium", "Low")}


def at_least(found: DataFrame, threshold: str | None) -> DataFrame:
    """high, medium or low; all (or nothing) keeps every finding, Info ones too."""
    if threshold in (None, "all"):
        return found
    if threshold not in THRESHOLDS:
        raise ValueError(f"severity must be one of all, high, medium, low: {threshold!r}")
    return found.filter(F.col("impact").isin(*THRESHOLDS[threshold]))


def suppressed(found: DataFrame, directives: DataFrame) -> DataFrame:
    """Findings without those that a (path, line, rule_id) directive names: a left anti join."""
    d = directives.select(F.col("path").alias("_path"), F.col("line").alias("_line"), F.col("rule_id").alias("_rule"))
    hides = (F.col("file_path") == F.col("_path")) & (F.col("line_number") == F.col("_line")) & ((F.col("_rule") == "*") | (F.col("_rule") == F.upper("rule_id")))
    return found.join(d, hides, "left_anti")


def first_wins(found: DataFrame, *order: str) -> DataFrame:
    """The first of each (file_path, rule_id, line_number, message) by the order columns."""
    same = Window.partitionBy("file_path", "rule_id", "line_number", "message").orderBy(*order)
    return found.withColumn("_nth", F.row_number().over(same)).filter("_nth = 1").drop("_nth")


REPORT_ORDER = ("file_path", "line_number", "column_number", "rule_id", "message")


def in_report_order(found: DataFrame) -> DataFrame:
    return found.orderBy(*REPORT_ORDER)
