"""Queries over small tables written here, against brute force: nothing of the input is left out."""

import hashlib
from collections import Counter

import pytest

import __spark_entry__ as entry


@pytest.fixture
def folder(spark, tmp_path):
    def written(name, rows, columns):
        spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return written


def line_fingerprint(line):
    return hashlib.sha256(f"CSIFT-000|d|{' '.join(line.split())}".encode()).hexdigest()[:16]


def test_baselines_take_lines_of_every_length(spark, folder):
    long, longer = "a line of sixty characters and more " * 2, "word " * 400
    texts = {1: f"short\n{long}", 2: longer, 3: f"{long}\n{longer}\nonly in the third {long}\nshort", 13: f"short\n\n{longer} end", 14: "x" * 60}
    sf = folder("documents", list(texts.items()), "doc_id long, text string")
    every = [(i, n, line_fingerprint(x)) for i, t in sorted(texts.items()) for n, x in enumerate(t.split("\n"), 1)]
    had, seen, new = Counter(f for i, _, f in every if i % 10 != 3), Counter(), []
    for i, n, f in every:
        seen[f] += 1
        if seen[f] > had[f]:
            new.append((i, n, f))
    found = [tuple(r) for r in entry.queries()["baseline_new"](spark, sf).collect()]
    assert sorted(found) == sorted(new) and {i for i, _, f in new if f == line_fingerprint(f"{longer} end")} == {13}
    assert entry.queries()["baseline_resolved"](spark, sf).first()[0] == sum((Counter(f for *_, f in every) - had).values())


def test_calls_of_every_script(spark, folder):
    pages = [(1, '<script>a(1);</script><p>x(9)</p><script type="m">b(2); c("d(3)")</script>'), (2, "<p>no(0)</p>"), (3, "<script></script><script>\ne(4)\n</script>")]
    sf = folder("pages", pages, "page_id long, html string")
    found = [tuple(r) for r in entry.queries()["script_calls_pages"](spark, sf).select("page_id", "callee").collect()]
    assert sorted(found) == [(1, "a"), (1, "b"), (1, "c"), (3, "e")]
