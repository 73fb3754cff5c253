"""Listing by executors and the tree as a data source, against os.walk."""

import os

import pytest

from csift.sources.ignore import IgnoreRules
from csift.sources.listing import EXTENSIONS, dealt, list_tree, read_listing
from csift.sources.tree_source import TreeReader, TreeSource, register

RULES = ["vendor/", "old*.c", "!keep/old_but_good.c"]


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    base = tmp_path_factory.mktemp("tree")
    for k in range(6):
        for name in (f"m{k}/a.c", f"m{k}/deep/er/b.H", f"m{k}/vendor/v.c", f"m{k}/old{k}.c", f"m{k}/x.txt", f"build/{k}.c", f"keep/{k}.c"):
            path = base / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(f"int n{k}; /* {name} */\n" * (k * 40 + 1))
    (base / "keep/old_but_good.c").write_bytes(b"int \xff;\n")
    os.symlink(base / "m1", base / "linked")
    os.symlink(base / "m1/nowhere.c", base / "broken.c")
    return base


def walked(base, rules):
    found, ignored = set(), set()
    for folder, folders, files in os.walk(base):
        inside = os.path.relpath(folder, base).replace(os.sep, "/")
        name = lambda x: x if inside == "." else f"{inside}/{x}"  # noqa: B023, E731
        folders[:] = [f for f in folders if not rules.prunes(name(f))]
        for f in files:
            if f.lower().endswith(EXTENSIONS):
                (ignored if rules.ignores(name(f)) else found).add(name(f))
    return found, ignored


@pytest.mark.parametrize("patterns", [RULES, [], ["m*/"], ["*.c"]])
def test_listing_is_as_a_walk(spark, tree, patterns):
    rules = IgnoreRules(patterns)
    rows = list_tree(spark, str(tree), rules).collect()
    found, ignored = walked(tree, rules)
    assert {r["path"] for r in rows if r["kind"] == "file"} == found and {r["path"] for r in rows if r["kind"] == "ignored"} == ignored
    assert all(r["size"] == os.path.getsize(tree / r["path"]) for r in rows if r["path"] != "broken.c")


def test_pruned_folders_are_never_listed(tree):
    listed = []
    rules = IgnoreRules(RULES)
    reader = TreeReader(str(tree), rules, 1000)
    real, reader.listed = reader.listed, lambda folder: listed.append(folder) or real(folder)
    reader.partitions()
    assert "m1/deep/er" in listed and not any("vendor" in x or x.startswith("build") or x == "linked" for x in listed)


def test_files_are_dealt_out_by_size(spark, tree):
    listing = list_tree(spark, str(tree), IgnoreRules(RULES))
    share = 200_000
    sizes = {r["path"]: r["size"] for r in listing.filter("kind = 'file'").collect()}
    deals = {}
    for r in dealt(listing.filter("kind = 'file'"), share).collect():
        deals.setdefault(r["deal"], []).append(sizes[r["path"]] + 65536)
    assert len(deals) > 3 and sum(map(len, deals.values())) == len(sizes) and all(sum(x) < share + max(x) for x in deals.values())
    rows = {r["path"]: r for r in read_listing(listing, str(tree), task_bytes=share).collect()}
    assert set(rows) == set(sizes) and rows["broken.c"]["read_error"].startswith("FileNotFoundError") and rows["keep/old_but_good.c"]["content"] == "int �;\n"
    assert rows["m3/a.c"]["content"] == (tree / "m3/a.c").read_text()
    assert read_listing(listing.limit(0), str(tree)).count() == 0


def test_tree_as_a_source(spark, tree):
    register(spark)
    found, _ = walked(tree, IgnoreRules(RULES))
    read = lambda tasks: spark.read.format("csift_tree").option("ignore", "\n".join(RULES)).option("tasks", tasks).load(str(tree))
    for tasks in (1, 3, 50):
        assert {r["path"] for r in read(tasks).collect()} == found
    some = read(4).filter("path like 'm3/%' and path like '%.c' and size > 10")
    assert [r["path"] for r in some.collect()] == ["m3/a.c"] and some.first()["content"] == (tree / "m3/a.c").read_text()
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "StartsWith" not in plan.split("BatchScan")[0] and "size" in plan  # Spark is left the filter on sizes alone
    assert {r["path"] for r in read(4).filter("path in ('keep/1.c', 'm2/a.c', 'none.c')").collect()} == {"keep/1.c", "m2/a.c"}
    assert {r["path"] for r in read(4).filter("path = 'm2/deep/er/b.H' or size < 0").collect()} == {"m2/deep/er/b.H"}  # not pushed, and right


def test_wanted_beginnings_keep_folders_shut(tree):
    from pyspark.sql.datasource import EqualTo, StringStartsWith

    for test, opened in ((StringStartsWith(("path",), "m3/de"), {"", "m3", "m3/deep", "m3/deep/er"}), (EqualTo(("path",), "keep/1.c"), {"", "keep"})):
        reader, listed = TreeReader(str(tree), IgnoreRules(RULES), 1000), []
        assert list(reader.pushFilters([test])) == []
        real, reader.listed = reader.listed, lambda folder: listed.append(folder) or real(folder)  # noqa: B023
        reader.partitions()
        assert set(listed) == opened
    assert TreeSource.name() == "csift_tree"
