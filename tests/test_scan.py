"""Rules, findings, sources, settings, reports and the command line, end to end."""

import json
import re
import os

import pytest
from pyspark.sql import functions as F

import csift
from csift import cli
from csift.corpus import CASES, corpus
from csift.operators import baseline, summary
from csift.operators.findings import at_least, findings, with_hits
from csift.operators.parse import RELATIONS, parsed, register_views, relation
from csift.plans import report as reports
from csift.plans.scan import ScanConfig, scan_files, scan_path, scan_text
from csift.queries import message_text, severity_of
from csift.rules import catalog
from csift.rules.custom import CustomRule, register, registered
from csift.schema import FINDING_COLUMNS
from csift.sources.config import BadConfig, find_config, load_config, read_config
from csift.sources.files import from_lake, from_table
from csift.sources.ignore import IgnoreRules

BAD = 'int f(char *p) {\n  gets(p); /* gets */\n  return p[0];\n}\n'


def found_in(spark, text, numbers=None, **how):
    files = spark.createDataFrame([("a.c", text)], "path string, content string")
    rows = with_hits(parsed(files), numbers or [r.number for r in catalog.RULES], how.pop("mode", "hybrid"))
    return [(r["rule_id"], r["line_number"]) for r in findings(rows, **how).orderBy("line_number", "rule_id").collect()]


def test_every_rule_in_its_corpus(spark):
    """Expected hits of all rules, each rule over its own templates, in one job a family."""
    for numbers in (range(1, 14), range(14, 27), range(27, 39)):
        frames, wanted = None, []
        for n in numbers:
            files = spark.createDataFrame([(f"{n}-{i}.c", s.replace("@K", "7").replace("@N", "9")) for i, (s, _) in enumerate(CASES[n])], "path string, content string")
            out = findings(with_hits(parsed(files), [n])).select("file_path", "rule_id", "line_number", "impact", "message")
            frames = out if frames is None else frames.union(out)
            wanted += [
                (f"{n}-{i}.c", catalog.rule_id(n), line, severity_of(n, p), message_text(n, p).replace("@K", "7").replace("@N", "9")) for i, (_, hits) in enumerate(CASES[n]) for line, p in hits
            ]
        assert sorted(map(tuple, frames.collect())) == sorted(set(wanted))


def test_catalogue_is_whole(spark):
    assert [r.number for r in catalog.RULES] == list(range(1, 39))
    assert [sum(r.impact == s for r in catalog.RULES) for s in ("High", "Medium", "Low")] == [26, 7, 5]
    assert catalog.rules_table(spark).count() == 38
    assert {n for n, _ in catalog.MESSAGES} == set(range(1, 39)) == set(CASES)


def test_modes(spark):
    text = "int f(int n) {\n  int *p;\n  return n;\n}\n"
    assert found_in(spark, text, [21], mode="regex") == [("CSIFT-021", 2)]
    assert found_in(spark, text, [21]) == found_in(spark, text, [21], mode="ast") == []
    with pytest.raises(ValueError):
        ScanConfig(mode="other")


def test_suppression_and_severity(spark):
    text = "void f(char *b) {\n  gets(b); // csift-ignore: CSIFT-001\n  gets(b);\n  goto x; // csift-ignore: CSIFT-001\nx:\n  b = \"// csift-ignore\"; gets(b);\n}\n"
    assert found_in(spark, text, [1, 18]) == [("CSIFT-001", 3), ("CSIFT-018", 4), ("CSIFT-001", 6)]
    assert len(found_in(spark, text, [1, 18], suppress=False)) == 4


def test_first_wins_and_snippets(spark):
    files = spark.createDataFrame([("a.c", 'void f(char *p) {\n\tsystem(p); system(p);\n}\n')], "path string, content string")
    rows = findings(with_hits(parsed(files), [30])).collect()
    assert [(r["engine"], r["column_number"], r["code_snippet"], r["confidence"]) for r in rows] == [("Regex", 2, "system(p); system(p);", "FULL")]


def test_overrides_come_before_the_bounded_copy(spark):
    text = 'void f(void) {\n  char b[9];\n  strcpy(b, "x");\n  gets(b);\n}\n'
    files = spark.createDataFrame([("a.c", text)], "path string, content string")
    rows = findings(with_hits(parsed(files), [1]), overrides={"CSIFT-001": "Medium"}).orderBy("line_number").collect()
    assert [r["impact"] for r in rows] == ["Low", "Medium"]
    assert at_least(findings(with_hits(parsed(files), [1])), "high").count() == 1


def test_a_failing_file_fails_alone(spark, monkeypatch):
    files = spark.createDataFrame([("a.c", BAD), ("deep.c", "int f(void) { return " + "(" * 20000 + "1; }"), ("n.c", None), ("e.c", "")], "path string, content string")
    scan = scan_files(files, ScanConfig(numbers=(1, 4)))
    status = {r["file_path"]: r["status"] for r in scan.summaries.collect()}
    assert status["a.c"] == status["n.c"] == status["e.c"] == "success"
    assert {r["rule_id"] for r in scan.findings.filter("file_path = 'a.c'").collect()} >= {"CSIFT-001", "CSIFT-004"}


def test_partitions_do_not_matter(spark):
    part = spark.range(60).select(F.col("id").alias("p_partkey"), (F.col("id") % 7 + 1).alias("p_size"))
    files = corpus(part, [s for n in (1, 3, 22) for s, _ in CASES[n]])
    one, many = (sorted(map(tuple, scan_files(files.repartition(k), ScanConfig(numbers=(1, 3, 22))).findings.collect())) for k in (1, 7))
    assert one == many and one


def test_relations_and_views(spark):
    parses = parsed(spark.createDataFrame([("a.c", BAD)], "path string, content string")).persist()
    for name in RELATIONS:
        relation(parses, name).collect()
    register_views(parses, "c_")
    assert spark.sql("SELECT name FROM c_functions").first()[0] == "f"
    with pytest.raises(ValueError):
        relation(parses, "other")


def test_baseline(spark, tmp_path):
    config = ScanConfig(numbers=(1, 18))
    first = scan_text(spark, "void f(char *b) {\n  gets(b);\n  gets(b);\n  goto x;\nx:;\n}\n", "a.c", config)
    path = str(tmp_path / "base.json")
    with open(path, "w") as file:
        file.write(reports.to_json(reports.as_dict(first)))
    later = scan_text(spark, "\nvoid f(char *b) {\n  gets(b);\n  gets(b);\n  gets(b);\n}\n", "a.c", config)
    new, warning = later.against(path)
    assert warning is None and new.resolved == 1
    assert [r["line_number"] for r in new.findings.collect()] == [5]
    other, warning = scan_text(spark, "int a;", "a.c", ScanConfig(numbers=(1,))).against(path)
    assert warning and other.findings.count() == 0
    for text in ("{}", "no", ""):
        with open(path, "w") as file:
            file.write(text)
        with pytest.raises(baseline.BadBaseline):
            baseline.read_baseline(spark, path)
    with pytest.raises(baseline.BadBaseline):
        baseline.read_baseline(spark, str(tmp_path / "none.json"))


def test_summaries(spark):
    scan = scan_files(spark.createDataFrame([("a.c", BAD), ("b.c", "int x;\n\n")], "path string, content string"), ScanConfig(numbers=(1, 4)))
    rows = {r["file_path"]: r for r in scan.summaries.collect()}
    assert (rows["a.c"]["high_count"], rows["b.c"]["issues_count"], rows["b.c"]["lines_of_code"]) == (2, 0, 2)
    assert summary.totals(scan.summaries).first()["issues_count"] == 2
    assert {r["status"]: r["files"] for r in summary.status_histogram(scan.summaries).collect()} == {"parsed": 2, "fallback-parser": 0, "regex": 0, "parse-failed": 0}


@pytest.mark.parametrize(
    "counts, wanted",
    [({}, ("none", "success")), ({"parsed": 2}, ("parser", "success")), ({"parsed": 1, "regex": 1}, ("hybrid", "success")), ({"parse-failed": 1}, ("parse-failed", "failed")), ({"parse-failed": 1, "regex": 2}, ("regex", "partial_success"))],
)
def test_overall_status(counts, wanted):
    assert summary.overall_status(counts) == wanted


def test_custom_rules(spark):
    native = CustomRule("X-1", "todo", message="a todo", condition=lambda line, masked: line.contains("todo"))
    python = register(CustomRule("X-2", "long", scan_line=lambda line, masked: "too long" if len(line) > 20 else None))
    query = CustomRule("X-3", "main", query=lambda parses: relation(parses, "functions").filter("name = 'main'").select("path", F.col("start_line").alias("line"), F.lit(1).alias("column"), F.lit("main").alias("message")))
    scan = scan_files(spark.createDataFrame([("a.c", "int todo;\nint main(void) { return 0; }\n")], "path string, content string"), ScanConfig(numbers=()), custom=(native, python, query))
    assert sorted((r["rule_id"], r["line_number"]) for r in scan.findings.collect()) == [("X-1", 1), ("X-2", 2), ("X-3", 2)]
    assert registered("X-2") is python
    with pytest.raises(KeyError):
        registered("X-9")
    with pytest.raises(ValueError):
        CustomRule("X-4", "none")
    with pytest.raises(ValueError):
        CustomRule("X-5", "lock", scan_line=__import__("threading").Lock().acquire)


def test_custom_rules_are_rules_like_others(spark):
    """Suppressed, overridden, made distinct; a function that fails fails its file alone."""
    native = CustomRule("X-1", "todo", message="a todo", condition=lambda line, masked: line.contains("todo"))
    python = CustomRule("X-2", "long", scan_line=lambda line, masked: "too long" if len(line) > 40 else None)
    query = CustomRule("X-3", "names", query=lambda parses: parses.select("path", F.explode(F.array(F.lit(1), F.lit(1), F.lit(2))).alias("line"), F.lit(1).alias("column"), F.lit("seen").alias("message")))
    text = "int todo; // csift-ignore: X-1\nint todo;\nint a_name_that_is_longer_than_forty_characters; // csift-ignore: X-2\nchar *s = \"todo and a long text that is longer\";\n"
    files = spark.createDataFrame([("a.c", text)], "path string, content string")
    scan = scan_files(files, ScanConfig(numbers=(18,), overrides={"X-1": "High"}), custom=(native, python, query))
    found = sorted((r["rule_id"], r["line_number"], r["impact"]) for r in scan.findings.collect())
    assert found == [("X-1", 2, "High"), ("X-1", 4, "High"), ("X-2", 4, "Medium"), ("X-3", 1, "Medium"), ("X-3", 2, "Medium")]
    assert all(len(r["fingerprint"]) == 16 and r["code_snippet"] for r in scan.findings.collect())
    failing = CustomRule("X-4", "fails", scan_line=lambda line, masked: line.index("int") and None)
    files = spark.createDataFrame([("a.c", "int a;\n"), ("b.c", "char b;\n")], "path string, content string")
    scan = scan_files(files, ScanConfig(numbers=()), custom=(failing,))
    assert [(r["file_path"], r["error_type"]) for r in scan.errors.collect()] == [("b.c", "ValueError")]


def test_only_calls_of_one_path_meet(spark):
    """Rule 35 over many paths: each use with each check of its own path before it, unless the path changed in between."""
    body = "".join(f"  access(p{k}, 0);\n" for k in range(250)) + "  p3 = other();\n" + "".join(f"  fopen((char *) p{k}, m);\n" for k in range(250)) + "  stat(p7, &s);\n  remove(p7);\n  openat(d, p9, 0);\n"
    found = scan_text(spark, f"void f(char *p1) {{\n  char *p3;\n{body}}}\n", "a.c", ScanConfig(numbers=(35,), mode="ast")).findings.select("line_number", "message").collect()
    wanted = {(254 + k, 3 + k) for k in range(250) if k != 3} | {(505, 10), (505, 504), (506, 12)}
    assert {(r["line_number"], int(re.search(r"line (\d+)", r["message"])[1])) for r in found} == wanted


def test_nothing_is_parsed_where_no_rule_needs_it(spark):
    files = spark.createDataFrame([("a.c", BAD)], "path string, content string")
    assert scan_files(files, ScanConfig(numbers=(1, 13, 18))).summaries.first()["parser"] == "regex"
    assert scan_files(files, ScanConfig(numbers=(1, 4))).summaries.first()["parser"] == "parsed"


def test_macro_limit_is_reported(spark):
    text = "#define A0 x x x x x x x x\n" + "".join(f"#define A{k} A{k - 1} A{k - 1} A{k - 1} A{k - 1} A{k - 1} A{k - 1} A{k - 1} A{k - 1}\n" for k in range(1, 8)) + "int f(void) { return A7; }\n"
    scan = scan_files(spark.createDataFrame([("a.c", text), ("b.c", "int a;\n")], "path string, content string"), ScanConfig(numbers=(4,)))
    errors = scan.errors.collect()
    assert [(r["file_path"], r["error_type"]) for r in errors] == [("a.c", "MacroLimit")] and "200000" in errors[0]["message"]
    assert {r["status"] for r in scan.summaries.collect()} == {"success"}


def by_hand(scan, head):
    """The JSON and the Markdown report, from collected rows."""
    rows = lambda df, *by: [json.dumps(r.asDict(True), ensure_ascii=False, separators=(",", ":")) for r in sorted(df.collect(), key=lambda r: tuple(r[c] for c in by))]
    order = ("file_path", "line_number", "column_number", "rule_id", "message")
    lists = {"issues": rows(scan.findings.select(*FINDING_COLUMNS), *order), "file_summaries": rows(scan.summaries, "file_path"), "scan_errors": rows(scan.errors, "file_path", "error_type", "message")}
    lists |= {"ignored_paths": [json.dumps(x) for x in sorted(scan.ignored)], "failed_paths": [json.dumps(r["file_path"]) for r in scan.summaries.filter("status = 'failed'").orderBy("file_path").collect()]}
    whole = [f"  {json.dumps(k)}: {json.dumps(v, ensure_ascii=False)}" for k, v in head.items()]
    whole += [f"  {json.dumps(k)}: " + ("[\n    " + ",\n    ".join(v) + "\n  ]" if v else "[]") for k, v in lists.items()]
    cell = lambda x: re.sub(r"\r\n|\r|\n", " ", x).replace("|", "\\|").replace("`", "'")
    lines = [f"| {i['rule_id']} | {i['impact']} | `{cell(i['file_path'])}:{i['line_number']}` | {cell(i['message'])} | {cell(i['auto_fix_replacement'] or i['suggested_fix_replacement'] or i['remediation'])} |" for i in map(json.loads, lists["issues"])]
    return "{\n" + ",\n".join(whole) + "\n}\n", lines


def test_reports_are_written_in_parts(spark, tree, tmp_path):
    """Byte for byte what one pass over collected rows gives, in many tasks."""
    (tree / "src/a | `b`.c").write_text("int f(void) {\n  char b[9];\n  gets(b); \n  strcpy(b, \"\u00e9\");\n}\n" * 40)
    scan = scan_path(spark, str(tree), ScanConfig(numbers=(1, 4)), patterns=["old.c"])
    head = reports.overview(scan)
    wanted, lines = by_hand(scan, head)
    for parallel in ("4", "64"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parallel)
        try:
            reports.write_report(scan, "json", str(tmp_path / "out.json"), head)
            reports.write_report(scan, "markdown", str(tmp_path / "out.md"), head)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        assert (tmp_path / "out.json").read_text(encoding="utf-8") == wanted
        assert [x for x in (tmp_path / "out.md").read_text(encoding="utf-8").split("\n") if x.startswith("| CSIFT")] == lines
    assert sorted(x.name for x in tmp_path.iterdir() if "out" in x.name) == ["out.json", "out.md"]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        reports.write_parts(scan, "json", str(tmp_path / "parts"), head)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted(x for x in (tmp_path / "parts").iterdir() if x.name.startswith("part-"))
    assert len(parts) > 1 and "".join(x.read_text(encoding="utf-8") for x in parts) == wanted
    text = reports.render(scan, "text").split("\n")
    assert len([x for x in text if x.endswith("]") and "[CSIFT" in x]) == len(lines)


def test_reports_of_odd_scans(spark, tree, tmp_path):
    scan = scan_path(spark, str(tree), ScanConfig(numbers=(1, 4)))
    reports.write_lines(scan.findings, str(tmp_path / "lines"))
    assert [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "lines")).collect()] == reports.as_dict(scan)["issues"]
    sarif = json.loads(reports.render(scan, "sarif"))["runs"][0]
    assert all(sarif["tool"]["driver"]["rules"][x["ruleIndex"]]["id"] == x["ruleId"] for x in sarif["results"])
    empty = scan_text(spark, "int a;\n", "a.c", ScanConfig(numbers=(1,)))
    assert json.loads(reports.render(empty, "sarif"))["runs"][0]["results"] == [] and "None." in reports.render(empty, "markdown")


def test_folder_of_a_store(spark, tree):
    scan = scan_path(spark, f"file://{tree}", ScanConfig(numbers=(1,)), patterns=["vendor/", "_x.c"])
    assert sorted(r["file_path"] for r in scan.summaries.collect()) == ["lib/old.c", "src/H.H", "src/crlf.c"]


def test_config_round_trip():
    config = ScanConfig(numbers=(1, 2), banned={"f": ("a", "b")}, allocators=("my_alloc",))
    assert ScanConfig.from_dict(json.loads(json.dumps(config.to_dict()))) == config


def test_project_names(spark):
    text = "int f(int n) {\n  char *p = my_alloc(n);\n  p[0] = 1;\n  my_free(p);\n  my_free(p);\n  old(n);\n  p = my_grow(p, n);\n  return 0;\n}\n"
    plain = scan_text(spark, text, "a.c", ScanConfig(numbers=(1, 3, 27, 32)))
    assert plain.findings.count() == 0
    scan = scan_text(spark, text, "a.c", ScanConfig(numbers=(1, 3, 27, 32), allocators=("my_alloc",), deallocators=("my_free",), reallocators=("my_grow",), banned={"old": ("is old", "new()")}))
    assert sorted((r["rule_id"], r["line_number"]) for r in scan.findings.collect()) == [("CSIFT-001", 6), ("CSIFT-003", 2), ("CSIFT-027", 5), ("CSIFT-032", 7)]


# ignore rules
@pytest.mark.parametrize(
    "rules, path, is_folder, ignored",
    [
        (["*.c"], "a/b.c", False, True), (["/a.c"], "b/a.c", False, False), (["a/b.c"], "x/a/b.c", False, False), (["*.c", "!keep.c"], "x/keep.c", False, False),
        (["x/"], "x", False, False), (["x/"], "x", True, True), (["x/"], "y/x/a.c", False, True), (["**/t/*.c"], "p/q/t/a.c", False, True), (["a?.c"], "ab.c", False, True),
        (["a?.c"], "a/.c", False, False), (["d/**"], "d/e/f.c", False, True), (["!a.c", "a.c"], "a.c", False, True), ([], "build/a.c", False, True), (["#a.c", ""], "a.c", False, False), (["a.c"], "./a.c", False, True),
        (["[x].c"], "x.c", False, False),
    ],
)
def test_ignore(spark, rules, path, is_folder, ignored):
    made = IgnoreRules(rules)
    assert made.ignores(path, is_folder) == ignored
    if not is_folder:
        assert spark.range(1).select(made.column(F.lit(path))).first()[0] == ignored


def test_prune():
    assert IgnoreRules(["v/"]).prunes("v") and not IgnoreRules(["v/", "!v/keep.c"]).prunes("v")
    assert IgnoreRules(["v/", "!w/keep.c"]).prunes("v") and not IgnoreRules(["v/", "!*.h"]).prunes("v")


@pytest.fixture
def tree(tmp_path):
    for name, text in {"src/_x.c": BAD, "src/H.H": "int h(void);\n", "vendor/v.c": BAD, "src/readme.txt": "x", "build/b.c": BAD, "lib/old.c": BAD}.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
    (tmp_path / "src/crlf.c").write_bytes(b"int a;\r\nint \xff;\r\n")
    (tmp_path / ".csiftignore").write_text("vendor/\n")
    return tmp_path


def test_scan_path(spark, tree):
    scan = scan_path(spark, str(tree), ScanConfig(numbers=(1,)), patterns=["old.c"])
    assert sorted(r["file_path"] for r in scan.summaries.collect()) == ["src/H.H", "src/_x.c", "src/crlf.c"]
    assert scan.ignored == ["lib/old.c"] and scan.discovered == 4
    assert [r["file_path"] for r in scan.findings.collect()] == ["src/_x.c"]
    assert {r["file_path"]: r["lines_of_code"] for r in scan.summaries.collect()}["src/crlf.c"] == 2
    assert scan_path(spark, str(tree / "src/_x.c"), ScanConfig(numbers=(1,))).findings.first()["file_path"] == "_x.c"
    with pytest.raises(FileNotFoundError):
        scan_path(spark, str(tree / "none"))
    with pytest.raises(ValueError):
        scan_path(spark, str(tree), partitions=-1)


def test_other_sources(spark, tree):
    rows = from_table(spark.createDataFrame([(1, BAD)], "id int, code string"), "id", "code").collect()
    assert rows[0]["path"] == "1"
    assert from_lake(spark, str(tree / "src")).count() >= 2  # Spark's readers leave _x.c out


def test_unreadable_file(spark, tree):
    os.symlink("/nowhere", tree / "src/gone.c")
    report = reports.as_dict(scan_path(spark, str(tree), ScanConfig(numbers=(1,))))
    assert report["failed_paths"] == ["src/gone.c"] and report["analysis"]["status"] == "partial_success"
    assert reports.exit_code(report, None, fail_on_error=True) == 1


# settings
def test_find_config(tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "pyproject.toml").write_text("[tool.csift.rules]\nskip = ['CSIFT-001']\n")
    assert find_config(str(tmp_path / "a/b")) == str(tmp_path / "pyproject.toml")
    (tmp_path / ".csift.toml").write_text("[rules.skip]\nCSIFT-002 = 'why'\n")
    assert load_config(None, str(tmp_path / "a")).skipped == {"CSIFT-002": "why"}
    (tmp_path / "bad.toml").write_text("[")
    for path in ("bad.toml", "none.toml"):
        with pytest.raises(BadConfig):
            load_config(str(tmp_path / path))


def test_read_config():
    out = read_config({"other": 1, "schema_version": "9", "rules": {"severity": {"csift-001": "low", "x": "odd"}}, "output": {"default_format": "odd", "fail_on": "high", "warn_on_fallback": "maybe"}, "functions": {"memory": {"alloc": ["a"]}, "banned": {"f": {"reason": "r"}}}})
    assert len(out.warnings) == 5 and out.severities == {"CSIFT-001": "Low"} and out.fail_on == "high" and out.banned["f"][0] == "r"
    for bad in ({"functions": {"memory": {"alloc": ["1a"]}}}, {"functions": {"banned": {"a b": "x"}}}, {"output": {"fail_on": "odd"}}):
        with pytest.raises(BadConfig):
            read_config(bad)
    assert read_config({"output": {"warn_on_fallback": "yes"}}).warn_on_fallback


def test_excludes_move_with_the_base(tmp_path):
    config = read_config({"paths": {"exclude": ["/src/gen/*", "*.tmp.c", "/other/x.c"]}}, str(tmp_path / ".csift.toml"))
    assert config.excludes_from(str(tmp_path / "src")) == ["/gen/*", "*.tmp.c"]
    assert config.excludes_from(str(tmp_path)) == config.excludes


# reports
def test_reports(spark, tree):
    scan = scan_path(spark, str(tree), ScanConfig(numbers=(1, 4)))
    report = reports.as_dict(scan)
    assert list(report) == ["schema_version", "meta", "analysis", "summary", "issues", "file_summaries", "scan_errors", "ignored_paths", "failed_paths"]
    assert json.loads(reports.to_json(report, pretty=False))["summary"]["high_count"] == len(report["issues"]) == 4
    places = [(i["file_path"], i["line_number"]) for i in report["issues"]]
    assert places == sorted(places)
    sarif = json.loads(reports.render(scan, "sarif"))
    assert sarif["version"] == "2.1.0" and len(sarif["runs"][0]["results"]) == 4 and {r["id"] for r in sarif["runs"][0]["tool"]["driver"]["rules"]} == {"CSIFT-001", "CSIFT-004"}
    assert "| CSIFT-001 | High |" in reports.render(scan, "markdown")
    assert "src/_x.c:2:3: High" in reports.render(scan, "text")


@pytest.mark.parametrize("flag, configured, output, wanted", [("json", "sarif", "a.md", "json"), (None, "sarif", "a.md", "sarif"), (None, None, "a.md", "markdown"), (None, None, "a.sarif", "sarif"), (None, None, None, "text")])
def test_format(flag, configured, output, wanted):
    assert reports.chosen_format(flag, configured, output) == wanted


def test_cli(spark, tree, capsys, monkeypatch):
    run = lambda *a: cli.main(list(a), spark)
    skipped = ", ".join(f"'{r.rule_id}'" for r in catalog.RULES if r.number not in (1, 18))
    (tree / ".csift.toml").write_text(f"[rules]\nskip = [{skipped}]\n")
    assert run(str(tree), "--fail-on", "none", "-q") == 0
    assert "CSIFT-001" in capsys.readouterr().out
    assert run("scan", str(tree), "--fail-on", "high", "-f", "json") == 1
    assert run("scan", str(tree / "none")) == 1
    base = str(tree / "base.json")
    assert run("scan", str(tree), "--update-baseline", base, "-o", str(tree / "r.sarif")) == 0
    assert json.loads((tree / "r.sarif").read_text())["version"] == "2.1.0"
    assert run("scan", str(tree), "--baseline", base, "--fail-on", "low") == 0
    assert run("rules") == 0 and "ACTIVE" in capsys.readouterr().out
    monkeypatch.chdir(tree / "lib")
    assert run("init-ignore") == 0 and run("init-ignore") == 1
    with pytest.raises(SystemExit):
        run("--version")


def test_public_names():
    for name in csift.__all__:
        assert getattr(csift, name) is not None


def test_stream(spark, tree, tmp_path):
    from csift.streaming.scan import file_stream, scan_stream

    query = scan_stream(file_stream(spark, str(tree / "lib")), str(tmp_path / "out"), str(tmp_path / "state"), ScanConfig(numbers=(1,)))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
