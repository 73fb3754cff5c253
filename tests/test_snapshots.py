"""Versions of a baseline, rules as table functions, and progress."""

import pytest

from csift import cli
from csift.operators.baseline import new_findings
from csift.operators.snapshots import Snapshots
from csift.plans.progress import Progress
from csift.plans.scan import ScanConfig, scan_files, scan_path
from csift.queries import Repeated
from csift.rules.table_rules import line_rule, register_table_rule


def findings_of(spark, text):
    rows = [("f", i, 1, "r", "m", None if c == "-" else c) for i, c in enumerate(text)]
    return spark.createDataFrame(rows, "file_path string, line_number int, column_number int, rule_id string, message string, fingerprint string")


def test_versions(spark, tmp_path):
    store = Snapshots(spark, "versions_test", str(tmp_path / "it's here"), 4)
    assert store.latest() == 0 and store.state(0).count() == 0
    assert [store.save(findings_of(spark, x)) for x in ("aab--", "abbc", "abbc", "c")] == [1, 2, 3, 4]
    state = lambda v: {r["fingerprint"]: r["count"] for r in store.state(v).collect()}
    assert [state(v) for v in range(5)] == [{}, {"a": 2, "b": 1}, {"a": 1, "b": 2, "c": 1}, {"a": 1, "b": 2, "c": 1}, {"c": 1}]
    changed = lambda a, b: {r["fingerprint"]: (r["added"], r["resolved"]) for r in store.difference(a, b).collect()}
    assert changed(1, 2) == {"a": (0, 1), "b": (1, 0), "c": (1, 0)} and changed(2, 3) == {} and changed(4, 1) == {"a": (2, 0), "b": (1, 0), "c": (0, 1)}
    assert spark.table("versions_test").filter("version = 3").count() == 0 and spark.table("versions_test").filter("version = 4").count() == 2
    assert sorted(r["fingerprint"] for r in new_findings(findings_of(spark, "aabbbc"), store.state(2)).collect()) == ["a", "b"]
    store.drop()
    again = Snapshots(spark, "versions_again", str(tmp_path / "it's here"), 4)  # another session finds what is there
    assert again.latest() == 4 and {r["fingerprint"]: r["count"] for r in again.state(2).collect()} == {"a": 1, "b": 2, "c": 1}
    with pytest.raises(ValueError):
        Snapshots(spark, "no name; drop", str(tmp_path))


def test_the_store_is_not_shuffled_again(spark, tmp_path):
    store = Snapshots(spark, "buckets_test", str(tmp_path / "store"), 4)
    store.save(findings_of(spark, "abcdefgh" * 3))
    store.save(findings_of(spark, "abc"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows in (store.state(2), store.difference(1, 2)):
            assert "Exchange hashpartitioning" not in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    store.drop()


def test_table_rules(spark):
    rows = [("a", 1, "x"), ("a", 2, ""), ("a", 3, "x "), ("a", 4, " x"), ("a", 5, "y"), ("b", 1, "y"), ("c", 1, "z"), ("c", 2, "z")]
    spark.createDataFrame(rows, "path string, line_number int, line string").repartition(5).createOrReplaceTempView("some_lines")
    register_table_rule(spark, "said_again", Repeated)
    found = spark.sql("SELECT * FROM said_again(TABLE(some_lines) PARTITION BY path ORDER BY line_number)").collect()
    assert sorted((r["path"], r["line"]) for r in found) == [("a", 0), ("a", 3), ("a", 4), ("c", 2)]


def test_table_rules_in_scans(spark):
    files = spark.createDataFrame([("a.c", "int a;\nint a; // comment\nint a; // csift-ignore: X-9\n"), ("b.c", "int a;\n")], "path string, content string")
    scan = scan_files(files, ScanConfig(numbers=(18,)), custom=(line_rule("X-9", "said again", Repeated),))
    assert sorted((r["rule_id"], r["file_path"], r["line_number"]) for r in scan.findings.collect() if r["line_number"]) == [("X-9", "a.c", 2)]


def test_progress(spark, tmp_path):
    for k in range(25):
        (tmp_path / f"f{k}.c").write_text(f"int a{k};\n")
    told = []
    with Progress(spark, lambda *x: told.append(x), 0.01) as progress:
        scan_path(spark, str(tmp_path), ScanConfig(numbers=(18,)), progress=progress).summaries.count()
    counts = [n for n, *_ in told]
    assert counts == sorted(set(counts)) and counts[-1] == 25 and {total for _, total, _ in told} == {25} and all(path.endswith(".c") for *_, path in told)
    with pytest.raises(KeyError), Progress(spark, lambda *x: {}["no"]) as progress:
        scan_path(spark, str(tmp_path), ScanConfig(numbers=(18,)), progress=progress).summaries.count()


def test_progress_on_a_terminal(capsys):
    cli.show(1, 2, "a\x1b[31m.c")
    cli.show(2, 2, None)
    out = capsys.readouterr().err
    assert "[1/2] a.c" in out and "[2/2]" in out and out.endswith("\n")
