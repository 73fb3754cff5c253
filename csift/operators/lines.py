"""Relations over lines: a row a line, and what holds of a line given those before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from csift.functions import lexing
from csift.operators.asof import nearest_before
from csift.operators.prefix import PIECE, running

#: An array of a number of elements, and the destination of a call that fills it.
ARRAY = r"\b(?:char|int|short|long|unsigned|wchar_t)\s+(\w+)\s*\[\s*(\d+)\s*\]"
FILLED = r"\b(strcpy|strcat|strncpy|strncat|sprintf|snprintf|memcpy|memmove|gets)\s*\(\s*(\w+)\s*[,)]"


def line_rows(files: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """keys, line_number (from 1) and line."""
    parts = F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), lexing.LINE_END, -1)  # split once, for a generator evaluates what it names each time
    lines = files.select(*[f"`{k}`" for k in keys], F.posexplode(lexing.let(parts, lexing.without_last_end)).alias("n", "line"))
    return lines.select(*[f"`{k}`" for k in keys], (F.col("n") + 1).cast("long").alias("line_number"), "line")


def brace_depths(lines: DataFrame, keys: Sequence[str], piece: int = PIECE) -> DataFrame:
    """lines with `depth`, the net depth of braces after each, by prefix sums over pieces of a file."""
    return running(lines.withColumn("_change", lexing.brace_change(F.col("line"))), keys, "line_number", {"depth": "_change"}, piece).drop("_change")


def arrays(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, name, line_number, declared (the same) and room of each array that a line declares with a number."""
    found = lines.select(*[f"`{k}`" for k in keys], "line_number", F.explode(F.regexp_extract_all("line", F.lit(ARRAY), F.lit(0))).alias("x"))
    return found.select(*[f"`{k}`" for k in keys], F.regexp_extract("x", ARRAY, 1).alias("name"), "line_number", F.col("line_number").alias("declared"), F.regexp_extract("x", ARRAY, 2).cast("decimal(38,0)").alias("room"))


def filled(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, line_number, callee and name of each call that fills a named buffer."""
    found = lines.select(*[f"`{k}`" for k in keys], "line_number", F.explode(F.regexp_extract_all("line", F.lit(FILLED), F.lit(0))).alias("x"))
    return found.select(*[f"`{k}`" for k in keys], "line_number", F.regexp_extract("x", FILLED, 1).alias("callee"), F.regexp_extract("x", FILLED, 2).alias("name"))


def room_of_buffers(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, line_number, callee, name, declared and room: each filled buffer with the nearest declaration at or above it."""
    return nearest_before(filled(lines, keys), arrays(lines, keys), [*keys, "name"], "line_number", ["declared", "room"])
