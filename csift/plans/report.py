"""Reports of a scan: JSON, SARIF, Markdown and text.

Rows become text in Spark, are ranked in report order and written by as many tasks as they fill; the driver has only
sums, and where one file is wanted it copies the parts' bytes. `write_lines` leaves one JSON text a finding in a folder.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from csift import __version__
from csift.functions import lexing
from csift.functions.lexing import CONTROL_SEQUENCE
from csift.operators import summary
from csift.operators.durable import shared_folder
from csift.operators.findings import REPORT_ORDER, in_report_order
from csift.operators.prefix import ranked
from csift.plans.scan import Scan
from csift.schema import FINDING_COLUMNS

SCHEMA_VERSION = "1"
LEVELS = {"High": "error", "Medium": "warning", "Low": "note", "Info": "note"}
ERROR_COLUMNS = ("file_path", "error_type", "message")


# rows
def json_of(*columns: str) -> Column:
    """A row as a JSON text, nulls too."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def level_column() -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair]), F.col("impact")), F.lit("note"))


def sarif_result(index: list[str] | None = None) -> Column:
    """A finding as a SARIF result; index: rule ids in the order of the tool's rules."""
    at = F.array_position(F.array(*map(F.lit, index)), F.col("rule_id")) - 1 if index else F.lit(None).cast("long")
    region = F.struct(
        F.greatest(F.lit(1), "line_number").alias("startLine"), F.greatest(F.lit(1), "column_number").alias("startColumn"), F.struct(F.col("code_snippet").alias("text")).alias("snippet")
    )
    place = F.struct(F.struct(F.replace("file_path", F.lit("\\"), F.lit("/")).alias("uri")).alias("artifactLocation"), region.alias("region"))
    return F.to_json(
        F.struct(
            F.col("rule_id").alias("ruleId"), at.alias("ruleIndex"), level_column().alias("level"), F.struct(F.col("message").alias("text")).alias("message"),
            F.array(F.struct(place.alias("physicalLocation"))).alias("locations"), F.struct(F.col("fingerprint").alias("primaryLocationLineHash")).alias("partialFingerprints"),
        )
    )


def write_lines(found: DataFrame, folder: str, row: Column | None = None) -> None:
    """One JSON text a finding, in report order over the folder's files."""
    in_report_order(found).select((json_of(*FINDING_COLUMNS) if row is None else row).alias("value")).write.mode("overwrite").text(folder)


# whole reports
def overview(scan: Scan) -> dict:
    """What a report says before its findings: sums only."""
    files = scan.summaries.agg(
        F.count(F.lit(1)).alias("files"), F.count(F.when(F.col("status") == "failed", 1)).alias("failed"), F.coalesce(F.sum("lines_of_code"), F.lit(0)).alias("lines")
    ).first()
    statuses = {s: 0 for s in summary.STATUSES} | {r["parser"]: r["count"] for r in scan.summaries.groupBy("parser").count().orderBy("parser").collect()}
    parser, analysis = summary.overall_status(statuses)
    by = {r["impact"]: r["count"] for r in scan.findings.groupBy("impact").count().collect()}
    issues = sum(by.values())
    sums = {
        "files_discovered": scan.discovered if scan.discovered is not None else files["files"], "files_analyzed": files["files"] - files["failed"], "files_ignored": scan.ignored_files.count() if scan.ignored_files is not None else 0, "files_failed": files["failed"],
        "lines_of_code": files["lines"], "issues_count": issues, "high_count": by.get("High", 0), "medium_count": by.get("Medium", 0), "low_count": by.get("Low", 0), "rules_applied_count": scan.rules,
        "scan_duration_seconds": round(time.time() - scan.started, 4),
    }
    if scan.baseline_path is not None:
        sums["baseline"] = {"path": scan.baseline_path, "new": issues, "resolved": scan.resolved}
    return {
        "schema_version": SCHEMA_VERSION,
        "meta": {"tool": "csift", "version": __version__, "target": scan.target, "timestamp": scan.timestamp, "engine": scan.config.mode, "rules_applied_count": scan.rules},
        "analysis": {"status": analysis, "parser": parser, "status_counts": statuses}, "summary": sums,
    }


# A report is rows of text (section, nth, text), each a line or a few. Findings are ranked by the order of the report without
# a task that sees them all, so every row knows whether a comma follows it, and rows are written by as many tasks as
# they fill.
@dataclass
class Part:
    """Ordered rows under a heading: a list in JSON, lines elsewhere. `opened` and `closed` stand around them, `empty` instead of them."""

    rows: DataFrame
    order: tuple[str, ...]
    text: Column
    opened: str | None = None
    closed: str | None = None
    empty: str | None = None
    separator: str = ""


def laid_out(spark: SparkSession, content: list[str | Part]) -> DataFrame:
    """section, nth and text of a report's parts, in this order."""
    sections, literals = [], []
    for k, part in enumerate(content):
        if isinstance(part, str):
            literals.append((2 * k, part))
            continue
        names = [f"_csift_by{i}" for i in range(len(part.order))]
        rows = part.rows.select(*[F.col(c).alias(n) for c, n in zip(part.order, names)], part.text.alias("text"))
        sections.append((k, part, ranked(rows, [], [F.col(n) for n in names]).select(F.lit(2 * k).alias("section"), "nth", "text")))
    sizes = {}
    if sections:
        together = reduce(DataFrame.unionByName, [rows for *_, rows in sections])
        sizes = {r["section"]: r["n"] for r in together.groupBy("section").agg(F.max("nth").alias("n")).collect()}
    out = []
    for k, part, rows in sections:
        size = sizes.get(2 * k, 0)
        literals += [(2 * k - 1, part.opened), (2 * k + 1, part.closed)] if size else [(2 * k, part.empty)]
        if size:
            out.append(rows.withColumn("text", F.concat("text", F.when(F.col("nth") < size, part.separator).otherwise(""))))
    lines = spark.createDataFrame([(k, n, text) for n, (k, text) in enumerate(literals) if text is not None], "section int, nth long, text string")
    return reduce(DataFrame.unionByName, out, lines)


def _list(rows: DataFrame, order: tuple[str, ...], text: Column, before: str, after: str = "") -> Part:
    """A JSON array, one row a line."""
    return Part(rows, order, F.concat(F.lit("    "), text), f"{before}[", f"  ]{after}", f"{before}[]{after}", ",")


def json_rows(scan: Scan, head: dict) -> DataFrame:
    """The JSON report's keys in order."""
    spark, files = scan.findings.sparkSession, scan.summaries
    quoted = F.regexp_extract(F.to_json(F.struct("file_path")), r"(?s)^\{\"file_path\":(.*)\}$", 1)
    content: list[str | Part] = ["{", *[f"  {json.dumps(k)}: {json.dumps(v, ensure_ascii=False, default=str)}," for k, v in head.items()]]
    content += [
        _list(scan.findings, REPORT_ORDER, json_of(*FINDING_COLUMNS), '  "issues": ', ","),
        _list(files, ("file_path",), json_of(*files.columns), '  "file_summaries": ', ","),
        _list(scan.errors, ERROR_COLUMNS, json_of(*ERROR_COLUMNS), '  "scan_errors": ', ","),
        _list(scan.ignored_files if scan.ignored_files is not None else files.select("file_path").limit(0), ("file_path",), quoted, '  "ignored_paths": ', ","),
        _list(files.filter("status = 'failed'"), ("file_path",), quoted, '  "failed_paths": '),
        "}",
    ]
    return laid_out(spark, content)


def sarif_rows(scan: Scan, head: dict) -> DataFrame:
    kinds = scan.findings.groupBy("rule_id").agg(*[F.min(c).alias(c) for c in ("rule_name", "remediation", "cwe_id")], F.min(level_column()).alias("level")).orderBy("rule_id").collect()
    rules = [{"id": r["rule_id"], "name": r["rule_name"], "shortDescription": {"text": r["rule_name"]}, "help": {"text": r["remediation"]}, "defaultConfiguration": {"level": r["level"]}, "properties": {"cwe": r["cwe_id"]}} for r in kinds]
    driver = {"driver": {"name": "csift", "version": __version__, "rules": rules}}
    note = F.struct(
        F.lit("error").alias("level"), F.struct(F.concat_ws(": ", "error_type", "message").alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation")).alias("physicalLocation"))).alias("locations"),
    )
    invoked = f'  "invocations": [{{"executionSuccessful": {json.dumps(not head["summary"]["files_failed"])}, "toolExecutionNotifications": '
    return laid_out(scan.findings.sparkSession, [
        '{"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [{', f'  "tool": {json.dumps(driver, ensure_ascii=False)},',
        _list(scan.errors, ERROR_COLUMNS, F.to_json(note), invoked, "}],"),
        _list(scan.findings, REPORT_ORDER, sarif_result([r["rule_id"] for r in kinds]), '  "results": '),
        "}]}",
    ])


def _filled(*columns: str) -> Column:
    """The first that says something."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns], F.lit(""))


def markdown_rows(scan: Scan, head: dict) -> DataFrame:
    sums, cell, text = head["summary"], lexing.markdown_cell, lambda c: F.col(c).cast("string")
    content: list[str | Part] = [
        f"# Audit of `{_cell(head['meta']['target'])}`\n\n| files | lines | findings | high | medium | low |\n|---|---|---|---|---|---|",
        "| " + " | ".join(str(sums[k]) for k in ("files_analyzed", "lines_of_code", "issues_count", "high_count", "medium_count", "low_count")) + " |",
    ]
    if "baseline" in sums:
        content.append(f"\nBaseline: {sums['baseline']['new']} new, {sums['baseline']['resolved']} resolved.")
    content.append(f"\nAnalysis: {head['analysis']['status']}, parser: {head['analysis']['parser']}.\n\n## Findings\n")
    fix = cell(_filled("auto_fix_replacement", "suggested_fix_replacement", "remediation"))
    row = F.concat(F.lit("| "), F.col("rule_id"), F.lit(" | "), F.col("impact"), F.lit(" | `"), cell(F.col("file_path")), F.lit(":"), text("line_number"), F.lit("` | "), cell(F.col("message")), F.lit(" | "), fix, F.lit(" |"))
    failed = F.concat(F.lit("- `"), cell(F.col("file_path")), F.lit("`: "), cell(F.col("error_type")), F.lit(": "), cell(F.coalesce("message", F.lit(""))))
    content.append(Part(scan.findings, REPORT_ORDER, row, "| rule | severity | place | message | fix |\n|---|---|---|---|---|", empty="None."))
    content.append(Part(scan.errors, ERROR_COLUMNS, failed, "\n## Errors\n"))
    return laid_out(scan.findings.sparkSession, content)


def _cell(text) -> str:
    return re.sub(r"\r\n|\r|\n", " ", str(text)).replace("|", "\\|").replace("`", "'")


def plain(text) -> str:
    """For a terminal: no escape sequences, line ends or control characters."""
    text = re.sub(CONTROL_SEQUENCE, "", str(text))
    return re.sub(r"[\x00-\x1f\x7f]", "", re.sub(r"\r\n|\r|\n", " ", text))


def text_rows(scan: Scan, head: dict) -> DataFrame:
    sums, plain_, text = head["summary"], lexing.terminal_text, lambda c: F.col(c).cast("string")
    row = F.concat(
        plain_(F.col("file_path")), F.lit(":"), text("line_number"), F.lit(":"), text("column_number"), F.lit(": "), F.col("impact"), F.lit(": "), plain_(F.col("message")), F.lit(" ["), F.col("rule_id"), F.lit("]\n    "),
        plain_(F.coalesce("code_snippet", F.lit(""))),
    )
    failed = F.concat(F.lit("error: "), plain_(F.col("file_path")), F.lit(": "), plain_(F.col("error_type")), F.lit(": "), plain_(F.coalesce("message", F.lit(""))))
    content: list[str | Part] = [Part(scan.findings, REPORT_ORDER, row), Part(scan.errors, ERROR_COLUMNS, failed)]
    content.append(f"{sums['files_analyzed']} files, {sums['lines_of_code']} lines: {sums['issues_count']} findings ({sums['high_count']} high, {sums['medium_count']} medium, {sums['low_count']} low)")
    if "baseline" in sums:
        content.append(f"baseline: {sums['baseline']['new']} new, {sums['baseline']['resolved']} resolved")
    return laid_out(scan.findings.sparkSession, content)


FORMS = {"json": json_rows, "sarif": sarif_rows, "markdown": markdown_rows, "text": text_rows}
BY_EXTENSION = {".json": "json", ".sarif": "sarif", ".md": "markdown", ".markdown": "markdown", ".txt": "text"}


def report_rows(scan: Scan, form: str, head: dict | None = None) -> DataFrame:
    """section, nth and text: a report's lines, in no order."""
    return FORMS[form](scan, overview(scan) if head is None else head)


def write_parts(scan: Scan, form: str, folder: str, head: dict | None = None) -> None:
    """A report as files of a folder: put together in the order of their names they are the report."""
    report_rows(scan, form, head).orderBy("section", "nth").select("text").write.mode("overwrite").text(folder)


def join_parts(spark: SparkSession, folder: str, path: str) -> None:
    """A folder's parts as one file, wherever either is; bytes are copied by streams, and nothing is kept of them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    of = jvm.org.apache.hadoop.fs.Path
    source, target = of(folder), of(path)
    files = source.getFileSystem(conf)
    names = sorted(x.getPath().toString() for x in files.listStatus(source) if x.getPath().getName().startswith("part-"))
    store = target.getFileSystem(conf)
    # the local one would leave a file of checksums beside it
    out = (store.getRawFileSystem() if store.getUri().getScheme() == "file" else store).create(target, True)
    try:
        for name in names:
            part = files.open(of(name))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            finally:
                part.close()
    finally:
        out.close()


def write_report(scan: Scan, form: str, path: str, head: dict | None = None) -> None:
    """A report as one file: parts are written by tasks to the shared folder, then joined."""
    spark = scan.findings.sparkSession
    folder = f"{shared_folder(spark)}/csift-report-{uuid.uuid4().hex}"
    write_parts(scan, form, folder, head)
    try:
        join_parts(spark, folder, path)
    finally:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def render(scan: Scan, form: str) -> str:
    """A whole report in memory."""
    rows = report_rows(scan, form).orderBy("section", "nth").select("text").collect()
    return "".join(f"{r['text']}\n" for r in rows)


def as_dict(scan: Scan) -> dict:
    """The JSON report, read back."""
    return json.loads(render(scan, "json"))


def to_json(report: dict, pretty: bool = True) -> str:
    return json.dumps(report, indent=2 if pretty else None, ensure_ascii=False, default=str)


def chosen_format(flag: str | None, configured: str | None, output: str | None) -> str:
    """A flag, else the settings, else the output's extension, else text."""
    suffix = re.search(r"\.\w+$", output or "")
    return flag or configured or BY_EXTENSION.get(suffix[0].lower() if suffix else "", "text")


def exit_code(head: dict, fail_on: str | None = None, fail_on_error: bool = False, warn_on_fallback: bool = False) -> int:
    """0 if all is well: no failed file and no file parsed by patterns where that counts, no finding at the level or above."""
    sums = head["summary"]
    if fail_on_error and sums["files_failed"]:
        return 1
    if warn_on_fallback and head["analysis"]["status_counts"].get("fallback-parser"):
        return 1
    counted = {"high": ("high_count",), "medium": ("high_count", "medium_count"), "low": ("high_count", "medium_count", "low_count")}
    counted["all"] = counted["low"]
    return int(any(sums[c] for c in counted.get(fail_on or "none", ())))
