"""Hits as columns, and a file's lines: what rules over facts and rules of a user's own share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

HIT = "struct<rule:int,line:int,column:int,parameters:array<string>,engine:string,pass:int>"


def hit(rule: int, line: Column, column: Column, *parameters, engine: str = "Regex", order: int = 0) -> Column:
    values = [p if isinstance(p, Column) else F.lit(p) for p in parameters]
    return F.struct(
        F.lit(rule).alias("rule"), line.cast("int").alias("line"), column.cast("int").alias("column"),
        (F.array(*[v.cast("string") for v in values]) if values else F.array().cast("array<string>")).alias("parameters"), F.lit(engine).alias("engine"), F.lit(order).alias("pass"),
    )


def none() -> Column:
    return F.array().cast(f"array<{HIT}>")


def each(lines: Column, of: Callable[[Column], Column]) -> Column:
    """The hits of single lines; blank lines have none."""
    return F.array_compact(F.transform(lines, lambda x: F.when(F.trim(x["line"]) != "", of(x))))
