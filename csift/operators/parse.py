"""Files to parses: one Arrow pass of the front end over file rows, and the relations that come out of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from csift import schema
from csift.frontend.lexical import RULES, Rules, masked
from csift.functions.lexing import normalized_newlines, strip_comments
from csift.rules.catalog import BANNED

EMPTY = {"reason": None, "unsigned_typedefs": [], "functions": [], "globals": [], "switches": [], "controls": [], "hits": [], "nodes": [], "edges": [], "facts": []}


def lexed(files: DataFrame) -> DataFrame:
    """path, content and clean (without comments), native."""
    return files.select("path", normalized_newlines(F.col("content")).alias("content")).withColumn("clean", strip_comments(F.col("content")))


def parsed(
    files: DataFrame, with_facts: bool = True, allocators=(), reallocators=(), deallocators=(), numbers=None, banned: dict[str, tuple[str, str]] | None = None,
    functions: tuple[tuple[int, Callable[[str, str], str | None]], ...] = (), seen=None, asked=None,
) -> DataFrame:
    """path, content, clean, parse and error of each file; a file whose analysis fails has an error and no facts.

    Without facts only tokens are looked at, and nothing is parsed. numbers: rules whose line forms are looked for (all
    if it isn't given), with the names that banned adds; asked: parts of the facts that are wanted (see `extract.PARTS`;
    all if it isn't given), the others stay empty; functions: (number, function of a line and its masked form).
    seen: an accumulator that is told (1, path) of each file.
    """
    target = to_arrow_schema(StructType.fromDDL(schema.PARSED))
    wanted = sorted(RULES if numbers is None else RULES.keys() & set(numbers))
    table = {**BANNED, **(banned or {})}

    def analysed(content: str, clean: str) -> dict:
        from csift.frontend.extract import FileFacts, control_statements

        if with_facts:
            found = FileFacts(content, clean, allocators, reallocators, deallocators, asked).row()
        else:
            found = {**EMPTY, "status": "regex", "parse_tier": "tokens", "confidence": "LIMITED", "controls": control_statements(clean) if asked is None or "controls" in asked else []}
        by_line = [{**h, "pass": 0} for h in Rules(clean, table, tuple(reallocators)).hits(wanted)]
        for number, function in functions:
            for n, line in enumerate(clean.split("\n"), 1):
                if line.strip() and (message := function(line, masked(line))) is not None:
                    by_line.append({"rule": number, "line": n, "column": 1, "parameters": [str(message)], "context": None, "pass": 0})
        return {**found, "hits": by_line + found["hits"]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for row in batch.slice(at, 64).to_pylist():
                    try:
                        found, error = analysed(row["content"], row["clean"]), None
                    except Exception as e:  # a file fails alone, and as a whole
                        found = {**EMPTY, "status": "parse-failed", "parse_tier": None, "confidence": None}
                        error = {"error_type": type(e).__name__, "message": str(e)}
                    for f in found["functions"]:
                        f["types"] = list(f["types"].items()) if isinstance(f["types"], dict) else f["types"]
                    rows.append({**row, "parse": found, "error": error})
                    if seen is not None:
                        seen.add((1, row["path"]))
                yield pa.RecordBatch.from_pylist(rows, target)

    return lexed(files).mapInArrow(run, schema.PARSED)


#: Rows of a batch of `reach`.
HELD = 1 << 16


def reach(parses: DataFrame) -> DataFrame:
    """(path, fn_idx, src, dst, from_line, to_line): which node can follow which, by paths of any length, found where the file's row lies."""
    kinds = {"path": pa.string(), "fn_idx": pa.int32(), "src": pa.int32(), "dst": pa.int32(), "from_line": pa.int32(), "to_line": pa.int32()}

    def rows_of(path: str, edges: list[dict], nodes: list[dict]) -> Iterator[tuple]:
        from csift.frontend.flow import reached_in_turn

        of: dict[int, list[tuple[int, int]]] = {}
        for e in edges or ():
            of.setdefault(e["fn_idx"], []).append((e["src"], e["dst"]))
        line = {(n["fn_idx"], n["node_id"]): n["line"] for n in nodes or ()}
        for f in sorted(of):
            for a, b in reached_in_turn(of[f]):
                yield path, f, a, b, line[f, a], line[f, b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("path", "edges", "nodes"))))
        found = (row for file in files for row in rows_of(*file))
        while held := list(islice(found, HELD)):
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*held), kinds.values())], list(kinds))

    ends = F.transform("parse.edges", lambda e: F.struct(e["fn_idx"].alias("fn_idx"), e["src"].alias("src"), e["dst"].alias("dst"))).alias("edges")
    lines = F.transform("parse.nodes", lambda n: F.struct(n["fn_idx"].alias("fn_idx"), n["node_id"].alias("node_id"), n["line"].alias("line"))).alias("nodes")
    return parses.select("path", ends, lines).mapInArrow(run, "path string, fn_idx int, src int, dst int, from_line int, to_line int")


def relation(parses: DataFrame, name: str) -> DataFrame:
    """A relation of facts: functions, params, variables, globals, calls, cfg_nodes, cfg_edges, node_facts, controls, switches."""
    of_file = {"globals": "globals", "cfg_nodes": "nodes", "cfg_edges": "edges", "node_facts": "facts", "controls": "controls", "switches": "switches"}
    if name in of_file:
        return parses.select("path", F.inline(f"parse.{of_file[name]}"))
    functions = parses.select("path", F.explode("parse.functions").alias("f"))
    if name == "functions":
        return functions.select("path", *[F.col(f"f.{c}") for c in ("idx", "name", "return_type", "start_line", "end_line", "body_lines", "empty_params", "void_params", "returns_boolean", "has_assertions")]).withColumnRenamed("idx", "fn_idx")
    if name in ("params", "variables", "calls", "casts", "events", "sizeofs"):
        out = functions.select("path", F.col("f.idx").alias("fn_idx"), F.posexplode(f"f.{name}").alias("nth", "x")).select("path", "fn_idx", "nth", "x.*")
        return out.withColumnRenamed("idx", "call_idx").drop("nth") if name == "calls" else out
    raise ValueError(f"no relation {name!r}")


RELATIONS = ("functions", "params", "variables", "globals", "calls", "casts", "events", "sizeofs", "cfg_nodes", "cfg_edges", "node_facts", "controls", "switches")


def register_views(parses: DataFrame, prefix: str = "") -> None:
    """Every relation as a view for SQL."""
    for name in RELATIONS:
        relation(parses, name).createOrReplaceTempView(f"{prefix}{name}")
