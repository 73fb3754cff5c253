"""The driver's entry points, with and without the training-data operators."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {f"rule_{n:03d}" for n in range(1, 39)} <= set(entry.queries())


@here
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@here
@pytest.mark.parametrize("name", ["lines_loc", "comment_extract", "suppressions", "baseline_new", "baseline_resolved", "script_calls_pages", "ignore_filter", "severity_totals", "rule_catalog", "node_facts", "reachability", "json_report", "sarif_results", "text_report", "lex_in_pieces", "running_depth", "buffer_room", "nearest_declaration", "check_then_use", "snapshot_difference", "table_rule_lines"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    connection = duckdb.connect()
    for table in ("part", "documents", "pages"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    mine = entry.queries()[name](spark, SF)
    columns = ", ".join(f'"{c}"' for c in sorted(mine.columns))
    wanted = connection.sql(f"SELECT {columns} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in mine.select(*sorted(mine.columns)).collect()))) == sorted(map(repr, wanted))


def test_works_without_the_operators():
    code = (
        "import importlib.util as u; real = u.find_spec\n"
        "u.find_spec = lambda n, *a: None if n.startswith('csift.llm') else real(n, *a)\n"
        "import __spark_entry__ as e; names = set(e.queries()); assert names and not any(n.startswith('op') or n == 'pipeline' for n in names)"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


@here
@pytest.mark.parametrize("name", ["symbol_resolution", "node_facts", "reachability"])
def test_relations_of_a_file_meet_in_its_row(spark, name):
    """The corpus is parsed once, and what is known of a file isn't shuffled to meet again."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == (2 if name == "reachability" else 1)
