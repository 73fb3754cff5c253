"""Lexing of texts in pieces: comments and literals of a text of any size, with no task that holds the whole text.

A text is cut into pieces. What a piece makes of the lexer's state before it, for each state that could be, is a small
array (`ends`), found by lexing the piece behind an opener of that state. Such arrays compose associatively, so the states
at all pieces come from a scan: groups of FAN pieces are composed, groups of groups above them, up to one for a text;
then each level hands the states down to the one below. No group holds more than FAN arrays. With its state known, each
piece is lexed for itself, behind the opener, by the same pattern that lexes whole texts.

Pieces are rows (keys, piece, text, after): piece counts from 0 without gaps, `after` is the first character of the next
piece (it tells whether a slash at the end of this one begins a comment), null at the last one. `cut` makes them of texts;
`cut_files` reads files that no task could hold.

Defined results: a null text is empty and has one empty piece; a text's pieces, put together, are the text; the results don't
depend on where it is cut, if no piece but a text's only one is empty. Null keys are keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from csift.functions import lexing
from csift.operators.durable import durable
from csift.operators.prefix import running

#: Characters of a piece; pieces of a group in the scan.
SIZE, FAN = 1 << 14, 64
#: The lexer's states, by number, and a text that leaves the lexer there: code, after a slash, in a block comment, after
#: a star in it, in a line comment, in a string, after a backslash in it, in a character literal, after a backslash in it.
CODE, SLASH, BLOCK, STAR, LINE, STRING, STRING_ESCAPE, CHARACTER, CHARACTER_ESCAPE = range(9)
OPENERS = ("", "/", "/*", "/**", "//", '"', '"\\', "'", "'\\")
#: A piece without these leaves code, comments and literals as they are.
MARKS = r"""[/*"'\\\n]"""
PLAIN = (CODE, CODE, BLOCK, BLOCK, LINE, STRING, STRING, CHARACTER, CHARACTER)


def cut(files: DataFrame, keys: Sequence[str], text: str, size: int = SIZE) -> DataFrame:
    """keys, piece, text and after of each text; one pass over each."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    parts = F.when(whole == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(whole, F.lit(rf"(?s).{{1,{size}}}"), F.lit(0)))
    pieces = lexing.let(parts, lambda p: F.transform(p, lambda x, i: F.struct(i.cast("long").alias("piece"), x.alias("text"), F.left(F.get(p, i + 1), F.lit(1)).alias("after"))))
    return files.select(*[f"`{k}`" for k in keys], F.inline(pieces))


def cut_files(spark: SparkSession, location: str, lines: int = 256) -> DataFrame:
    """path, piece, text and after of files that Spark splits as it reads, so that one huge file is many tasks.

    Pieces are runs of up to `lines` lines of one split. A file's last line counts as ended.
    """
    rows = spark.read.option("lineSep", "\n").text(location).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"))
    first = Window.partitionBy("path", "split")
    rows = durable(rows).withColumn("block", F.floor((F.col("id") - F.min("id").over(first)) / lines))
    runs = rows.groupBy("path", "split", "block").agg(F.array_sort(F.collect_list(F.struct("id", "value"))).alias("rows"))
    runs = runs.select("path", "split", "block", F.concat(F.array_join("rows.value", "\n"), F.lit("\n")).alias("text"), F.lit(1).alias("one"))
    order = Window.partitionBy("path").orderBy("split", "block")
    return runs.withColumn("piece", (F.row_number().over(order) - 1).cast("long")).select("path", "piece", "text", F.lit(None).cast("string").alias("after"))


def end_state(found: Column, text: Column) -> Column:
    """The lexer's state after a text, by its last token."""
    last = F.element_at(found, -1)
    inner = F.substr(last, F.lit(2))
    # whether an odd run of backslashes ends the literal so far
    escape = F.length(F.regexp_extract(inner, r"(\\*)\z", 1)) % 2 == 1

    def literal(quote: str, state: int) -> Column:
        closed = last.rlike(rf"(?s)^{quote}(?:[^{quote}\\]++|\\.)*+{quote}\z")
        return F.when(closed, CODE).when(escape, state + 1).otherwise(state)

    block = F.when((F.length(last) > 3) & last.endswith("*/"), CODE).when((F.length(last) > 2) & last.endswith("*"), STAR).otherwise(BLOCK)
    known = F.when(last.startswith("/*"), block).when(last.startswith("//"), LINE).when(last.startswith('"'), literal('"', STRING)).when(last.startswith("'"), literal("'", CHARACTER))
    return F.when(text == "", CODE).otherwise(known.when(last == "/", SLASH).otherwise(CODE)).cast("tinyint")


def transition(text: Column) -> Column:
    """ends: the state after the text for each state before it.

    After a slash, a star or a backslash only the first character can make another state of it than without.
    """

    def behind(state: int) -> Column:
        whole = F.concat(F.lit(OPENERS[state]), text)
        return lexing.let(lexing.tokens(whole), lambda t: end_state(t, whole))

    first = F.substring(text, 1, 1)
    alike = {SLASH: (CODE, "/*"), STAR: (BLOCK, "/"), STRING_ESCAPE: (STRING, "\"\\"), CHARACTER_ESCAPE: (CHARACTER, "'\\")}
    own = [s for s in range(len(OPENERS)) if s not in alike]

    def every(found: Column) -> Column:
        of = lambda s: F.get(found, F.lit(own.index(s)))
        return F.array(*[F.when(first.isin(*alike[s][1]), behind(s)).otherwise(of(alike[s][0])) if s in alike else of(s) for s in range(len(OPENERS))])

    same = F.array(*[F.lit(s).cast("tinyint") for s in range(len(OPENERS))])
    plain = F.array(*[F.lit(s).cast("tinyint") for s in PLAIN])
    return F.when(text == "", same).when(~text.rlike(MARKS), plain).otherwise(lexing.let(F.array(*map(behind, own)), every))


def composed(functions: Column) -> Column:
    """One transition for a list of them, in order."""
    first = F.array(*[F.lit(s).cast("tinyint") for s in range(len(OPENERS))])
    return F.aggregate(functions, first, lambda f, g: F.transform(f, lambda s: F.get(g, s.cast("int"))))


def scan(rows: DataFrame, keys: Sequence[str], fan: int = FAN) -> DataFrame:
    """keys, piece and state before each piece; rows: keys, piece, ends. Groups hold `fan` rows at most at each level."""
    member = F.struct("piece", "ends")
    grouped = rows.groupBy(*[f"`{k}`" for k in keys], F.floor(F.col("piece") / fan).alias("group")).agg(F.array_sort(F.collect_list(member)).alias("members"))
    grouped = durable(grouped)
    if grouped.filter("group > 0").isEmpty():
        states = grouped.withColumn("state", F.lit(CODE).cast("tinyint"))
    else:
        above = grouped.select(*[f"`{k}`" for k in keys], F.col("group").alias("piece"), composed(F.col("members.ends")).alias("ends"))
        given = scan(above, keys, fan).select(*[F.col(f"`{k}`").alias(f"_csift_key{i}") for i, k in enumerate(keys)], F.col("piece").alias("_csift_group"), "state")
        same = grouped["group"] == given["_csift_group"]
        for i, k in enumerate(keys):
            same = same & grouped[k].eqNullSafe(given[f"_csift_key{i}"])
        states = grouped.join(given, same).drop("_csift_group", *[f"_csift_key{i}" for i in range(len(keys))])
    start = F.struct(F.col("state").alias("now"), F.array().cast("array<tinyint>").alias("before"))
    before = F.aggregate("members", start, lambda s, m: F.struct(F.get(m["ends"], s["now"].cast("int")).alias("now"), F.concat(s["before"], F.array(s["now"])).alias("before")), lambda s: s["before"])
    paired = F.zip_with("members.piece", before, lambda p, s: F.struct(p.alias("piece"), s.alias("state")))
    return states.select(*[f"`{k}`" for k in keys], F.inline(paired))


def with_states(pieces: DataFrame, keys: Sequence[str], fan: int = FAN) -> DataFrame:
    """pieces with `state` before each and `end` after it."""
    rows = pieces.select(*[f"`{k}`" for k in keys], "piece", transition(F.col("text")).alias("ends"))
    rows = durable(rows)
    states = scan(rows, keys, fan)
    both = [*[f"_csift_key{i}" for i in range(len(keys))], "_csift_piece"]
    told = rows.join(_named(states.withColumnRenamed("state", "_csift_state"), keys), _matches(rows, keys)).select(*[F.col(f"`{k}`") for k in keys], F.col("piece"), F.col("_csift_state").alias("state"), F.get("ends", F.col("_csift_state").cast("int")).alias("end"))
    return pieces.join(_named(told, keys), _matches(pieces, keys)).drop(*both)


def _named(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.withColumnsRenamed({k: f"_csift_key{i}" for i, k in enumerate(keys)} | {"piece": "_csift_piece"})


def _matches(rows: DataFrame, keys: Sequence[str]) -> Column:
    out = rows["piece"] == F.col("_csift_piece")
    for i, k in enumerate(keys):
        out = out & rows[k].eqNullSafe(F.col(f"_csift_key{i}"))
    return out


def _opener(state: Column) -> Column:
    return F.get(F.array(*map(F.lit, OPENERS)), state.cast("int"))


def _opens() -> Column:
    """Whether the slash that ends this piece begins a comment."""
    return (F.col("end") == SLASH) & F.coalesce(F.col("after").isin("/", "*"), F.lit(False))


def _lexed() -> Column:
    return F.concat(_opener(F.col("state")), F.col("text"), F.when(_opens(), F.col("after")).otherwise(""))


def strip_comments(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, piece and clean: the piece with comments made blank. pieces: as `with_states` gives them."""
    clean = lexing.strip_comments(_lexed())
    return pieces.select(*[f"`{k}`" for k in keys], "piece", F.substr(clean, F.length(_opener(F.col("state"))) + 1, F.length("text")).alias("clean"))


def comments(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, line (in which the comment begins) and text of each comment, in however many pieces it lies.

    Each piece gives what it has of each comment; prefix sums number comments and lines, and what belongs to one
    comment is put together in order.
    """
    opener = _opener(F.col("state"))
    ends = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    rows = pieces.select(*[f"`{k}`" for k in keys], "piece", "state", _opens().alias("opens"), F.length(opener).alias("opened"), ends.cast("long").alias("ends"), F.substring("text", 1, 1).alias("first"), lexing.comments(_lexed()).alias("found"))
    goes_on = F.col("state").isin(BLOCK, STAR, LINE) | (F.col("state") == SLASH) & F.col("first").isin("/", "*")
    rows = rows.withColumn("goes_on", goes_on).withColumn("begun", (F.size("found") - F.col("goes_on").cast("int")).cast("long"))
    rows = durable(rows)
    counted = running(rows.select(*[f"`{k}`" for k in keys], "piece", "begun", "ends"), keys, "piece", {"_csift_begun": "begun", "_csift_ends": "ends"})
    rows = rows.join(_named(counted.drop("begun", "ends"), keys), _matches(rows, keys)).drop(*[f"_csift_key{i}" for i in range(len(keys))], "_csift_piece")

    def part(c: Column, i: Column) -> Column:
        carried = F.col("goes_on") & (i == 0)
        text = F.when(carried, F.substr(c["text"], F.col("opened") + 1)).otherwise(c["text"])
        last = F.col("opens") & (i == F.size("found") - 1)
        return F.struct(
            (F.col("_csift_begun") - F.col("begun") + i + F.when(F.col("goes_on"), 0).otherwise(1)).alias("comment"),
            F.when(~carried, F.col("_csift_ends") - F.col("ends") + c["line"]).alias("line"),
            F.when(last, F.left(text, F.length(text) - 1)).otherwise(text).alias("text"),
        )

    parts = rows.select(*[f"`{k}`" for k in keys], "piece", F.inline(F.transform("found", part)))
    # Only a comment that leaves its piece needs the others; a piece's inner comments are whole, but are few rows more.
    whole = parts.groupBy(*[f"`{k}`" for k in keys], "comment").agg(F.max("line").alias("line"), F.array_sort(F.collect_list(F.struct("piece", "text"))).alias("parts"))
    return whole.select(*[f"`{k}`" for k in keys], F.col("line").cast("long").alias("line"), F.array_join("parts.text", "").alias("text"))


def lex(files: DataFrame, keys: Sequence[str], text: str, size: int = SIZE) -> DataFrame:
    """Pieces of texts with their states, made once."""
    return durable(with_states(cut(files, keys, text, size), keys))
