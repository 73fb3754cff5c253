"""Chat formatting into budgeted windows.

Prefix sums of turn tokens, per conversation, choose spans that begin and end at turns. They first deal a conversation
out into stretches of BLOCKS full windows (a turn belongs to the stretch in which its first token falls), so that the
greedy choice of spans works on arrays of a bounded size and a long conversation is many of them; within a stretch
each span takes turns while they fit. Each window holds the conversation's system turn, a limited history (the last
turns before the span, at most HISTORY_TURNS and HISTORY_TOKENS, as far as the budget allows) and its span. Room for the
system turn and the history is kept when spans are chosen, so a window exceeds the budget only if the system turn and
one single turn do: no turn is ever cut. Assistant texts of the span are under the loss mask; what a window repeats
is not.

A turn is `<s>[INST]role[/INST]text</s>`. In roles and texts a backslash becomes `\\b`, and a control string gets its
first character replaced: `[` by `\\o`, `<` by `\\l`; so no text can hold a mark, and unescaping gives it back.

Defined results: null text and null role are empty; turns go by turn, then role, then text (repeated rows stay, each
once); rows with a null conv_id belong to no conversation, so each is one of its own (equal ones together); an empty
table gives an empty result; columns beside the four are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from csift.llm.common import WORD

BUDGET = 2048
HISTORY_TURNS = 2
HISTORY_TOKENS = BUDGET // 4
#: Tokens of a turn's marks.
MARKS = 4
#: Full windows of a stretch.
BLOCKS = 64


def escape(column: Column) -> Column:
    x = F.replace(column, F.lit("\\"), F.lit("\\b"))
    x = F.regexp_replace(x, r"\[(?=/?INST\])", r"\\o")
    return F.regexp_replace(x, r"<(?=/?s>|</?SYS>>)", r"\\l")


def unescape(column: Column) -> Column:
    x = F.replace(column, F.lit("\\o"), F.lit("["))
    return F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def format_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<s>[INST]"), escape(role), F.lit("[/INST]"), escape(text), F.lit("</s>"))


def begins(members: Column, room: Column) -> Column:
    """Places of the turns at which spans begin: a turn that doesn't fit what its span has begins the next one."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("at"))

    def step(s: Column, x: Column) -> Column:
        new = (F.size(s["at"]) == 0) | (s["used"] + x["tokens"] > room)
        used = F.when(new, x["tokens"]).otherwise(s["used"] + x["tokens"])
        return F.struct(used.alias("used"), F.when(new, F.concat(s["at"], F.array(x["place"]))).otherwise(s["at"]).alias("at"))

    return F.aggregate(members, start, step, lambda s: s["at"])


def chat_windows(turns: DataFrame, budget: int = BUDGET, history_turns: int = HISTORY_TURNS, history_tokens: int = HISTORY_TOKENS) -> DataFrame:
    """conv_id, row_key (tells rows of a null conv_id apart), window, formatted, n_tokens, n_repeated (turns at the
    window's head that it repeats) and loss_spans.

    loss_spans are (start, length) in code points of `formatted`, start from 1.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("row_key", F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")))
    one = Window.partitionBy("conv_id", "row_key")
    by_turn = one.orderBy("turn", "role", "text")
    rows = (
        rows.withColumn("tokens", F.regexp_count("text", F.lit(WORD)).cast("long") + MARKS)
        .withColumn("place", F.row_number().over(by_turn))
        .withColumn("before", F.sum("tokens").over(by_turn.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens"))
        .withColumn("retained", (F.col("place") == 1) & (F.col("role") == "system"))
        .withColumn("kept", F.coalesce(F.max(F.when(F.col("retained"), F.col("tokens"))).over(one), F.lit(0)))
        .withColumn("room", F.greatest(F.lit(1), F.lit(budget - history_tokens) - F.col("kept")))
    )
    stretch = F.floor(F.col("before") / (F.col("room") * BLOCKS)).alias("stretch")
    member = F.struct("place", "role", "text", "tokens", "before", "retained")
    rows = rows.groupBy("conv_id", "row_key", "kept", "room", stretch).agg(F.array_sort(F.collect_list(member)).alias("members"))
    rows = rows.withColumn("begins", begins(F.col("members"), F.col("room"))).select("*", F.explode("members").alias("member")).select("conv_id", "row_key", "kept", "begins", "member.*")
    by_place = one.orderBy("place")
    rows = rows.withColumn("starts", F.array_contains("begins", F.col("place")).cast("int")).drop("begins")
    rows = rows.withColumn("window", F.sum("starts").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("spanned", F.sum("tokens").over(Window.partitionBy("conv_id", "row_key", "window")))
    ahead = []
    for j in range(1, history_turns + 1):
        later = lambda c, j=j: F.lead(c, j).over(by_place)
        told = later("before") - F.col("before")
        fits = (told <= history_tokens) & (told + F.col("kept") + later("spanned") <= budget)
        ahead.append(F.when((later("starts") == 1) & fits, later("window")))
    rows = rows.withColumn("again", F.array_compact(F.array(*ahead)) if ahead else F.array().cast("array<long>")).withColumn("last_window", F.max("window").over(one))
    later = F.when(F.col("last_window") > F.col("window"), F.sequence(F.col("window") + 1, F.col("last_window"))).otherwise(F.array().cast("array<long>"))
    copies = F.concat(F.array("window"), F.when(F.col("retained"), later).otherwise(F.col("again")))
    parts = (
        rows.select("conv_id", "row_key", "place", "role", "text", "tokens", F.col("window").alias("own"), F.explode(copies).alias("window"))
        .withColumn("repeated", F.col("own") != F.col("window"))
        .withColumn("part", format_turn(F.col("role"), F.col("text")))
    )
    in_window = Window.partitionBy("conv_id", "row_key", "window").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("offset", F.sum(F.length("part")).over(in_window) - F.length("part"))
    head = F.length(F.concat(F.lit("<s>[INST]"), escape(F.col("role")), F.lit("[/INST]")))
    taught = F.when(
        (F.col("role") == "assistant") & ~F.col("repeated"),
        F.struct((F.col("offset") + head + 1).cast("int").alias("start"), F.length(escape(F.col("text"))).alias("length")),
    )
    return (
        parts.withColumn("taught", taught)
        .groupBy("conv_id", "row_key", "window")
        .agg(
            F.sort_array(F.collect_list(F.struct("place", "part", "taught"))).alias("parts"),
            F.sum("tokens").alias("n_tokens"),
            F.sum(F.col("repeated").cast("int")).alias("n_repeated"),
        )
        .select(
            "conv_id", "row_key", "window", "n_tokens", "n_repeated",
            F.array_join(F.col("parts.part"), "").alias("formatted"),
            F.array_compact(F.col("parts.taught")).alias("loss_spans"),
        )
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a window, as array<struct<role, text>>."""
    ended = F.split(formatted, "</s>", -1)
    return F.transform(
        F.slice(ended, F.lit(1), F.size(ended) - 1),
        lambda x: F.struct(
            unescape(F.substr(F.substring_index(x, "[/INST]", 1), F.lit(len("<s>[INST]") + 1))).alias("role"),
            unescape(F.substr(x, F.length(F.substring_index(x, "[/INST]", 1)) + len("[/INST]") + 1)).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"], s["length"]))), "")


def conversation_digests(windows: DataFrame) -> DataFrame:
    """Reads the windows back: of each conversation the new turns in order, and the text under the loss mask."""
    turns = read_turns(F.col("formatted"))
    said = F.transform(F.slice(turns, F.col("n_repeated").cast("int") + 1, F.greatest(F.size(turns), F.lit(1))), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = windows.select("conv_id", "row_key", "window", F.length("formatted").cast("long").alias("chars"), said.alias("said"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    whole = read.groupBy("conv_id", "row_key").agg(
        F.sort_array(F.collect_list(F.struct("window", "said", "loss"))).alias("all"), F.sum("chars").alias("formatted_chars")
    )
    loss = F.array_join(F.col("all.loss"), "")
    return whole.withColumn("said", F.flatten(F.col("all.said"))).select(
        "conv_id",
        F.size("said").cast("long").alias("n_turns"),
        F.sha2(F.array_join("said", ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
