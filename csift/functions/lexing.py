"""Lexical functions as Spark columns: comments, literals, lines, suppression directives, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A comment, a literal (an open one runs to the end), or a stretch of anything else.
TOKEN = r"""(?s)/\*(?:.*?\*/|.*\z)|//[^\n]*|"(?:[^"\\]++|\\.)*+(?:"|\\?\z)|'(?:[^'\\]++|\\.)*+(?:'|\\?\z)|[^/"']++|/"""
LITERAL = r"""(?s)"(?:[^"\\]++|\\.)*+(?:"|\\?\z)|'(?:[^'\\]++|\\.)*+(?:'|\\?\z)|[^"']++"""
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
#: ECMA-48: a control sequence has parameter bytes 30-3F, intermediate bytes 20-2F and a final byte 40-7E; another escape has one byte 40-5F.
CONTROL_SEQUENCE = r"\x1b\[[\x30-\x3f]*[\x20-\x2f]*[\x40-\x7e]|\x1b[\x40-\x5f]"
#: What a directive does.
VERBS = ("ignore", "disable")
IDENTIFIER = r"\b[a-zA-Z_]\w*\b"


def let(value: Column, body) -> Column:
    """body(value), with the value computed once a row: a column that lambdas name would be put into them, and computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalized_newlines(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def is_comment(token: Column) -> Column:
    return token.startswith("//") | token.startswith("/*")


def strip_comments(text: Column) -> Column:
    """Comments become blanks; newlines, columns and literals stay."""
    return F.array_join(F.transform(tokens(text), lambda t: F.when(is_comment(t), F.regexp_replace(t, r"[^\n]", " ")).otherwise(t)), "")


def mask_literals(line: Column) -> Column:
    """What literals hold becomes x; quotes and the length stay, an escape is a backslash and an x. Lines stand alone."""

    def masked(t: Column) -> Column:
        quote = F.substring(t, 1, 1)
        rest = F.regexp_replace(F.substr(t, F.lit(2)), r"(?s)(\\).", "$1x")
        closed = (F.length(rest) > 0) & (F.substring(rest, -1, 1) == quote)
        inner = F.when(closed, F.left(rest, F.length(rest) - 1)).otherwise(rest)
        return F.concat(quote, F.regexp_replace(inner, r"(?s)(\\)x|.", "$1x"), F.when(closed, quote).otherwise(""))

    literal = lambda t: t.startswith('"') | t.startswith("'")
    whole = F.array_join(F.transform(F.regexp_extract_all(line, F.lit(LITERAL), F.lit(0)), lambda t: F.when(literal(t), masked(t)).otherwise(t)), "")
    return F.when(line.contains('"') | line.contains("'"), whole).otherwise(line)


def split_lines(text: Column) -> Column:
    """Lines as a text editor counts them: a final line end begins no line, the empty text has none."""
    return without_last_end(F.split(text, LINE_END, -1))


def without_last_end(parts: Column) -> Column:
    return F.when(F.size(parts) == 0, parts).when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def comments(text: Column) -> Column:
    """array<struct<line, text>> of comments with the line they begin in.

    What is left of the text is its line ends, and a mark where a comment begins; marks counted line by line give the
    lines of the comments in order, in one pass however many there are.
    """
    empty = F.array().cast("array<struct<line:int,text:string>>")

    def of(parts: Column) -> Column:
        ends = lambda t: F.regexp_replace(t, r"[^\n]", "")
        marks = F.array_join(F.transform(parts, lambda t: F.when(is_comment(t), F.concat(F.lit("*"), ends(t))).otherwise(ends(t))), "")
        places = F.flatten(F.transform(F.split(marks, "\n", -1), lambda x, i: F.array_repeat((i + 1).cast("int"), F.length(x))))
        return F.zip_with(places, F.filter(parts, is_comment), lambda n, t: F.struct(n.alias("line"), t.alias("text")))

    return F.when(text.contains("//") | text.contains("/*"), let(tokens(text), of)).otherwise(empty)


def suppressions(text: Column, keyword: str = "csift") -> Column:
    """array<struct<line, rule_id>> of directives in comments; rule_id is * for all rules.

    A directive is the keyword and a verb, then perhaps -next-line and -line, then perhaps a colon or white space and rule
    ids with commas between them. What follows is taken as ids even if it's prose.
    """
    run = r"[A-Za-z0-9_,\-\s]*"
    whole = rf"(?i){keyword}-(?:{'|'.join(VERBS)}){run}(?::{run})?"
    blank = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))

    def parsed(directive: Column, line: Column) -> Column:
        verb = F.lower(F.element_at(F.split(directive, "-"), 2))
        length = F.lit(0)
        for v in VERBS:
            length = F.when(verb.startswith(v), len(keyword) + 1 + len(v)).otherwise(length)
        rest = F.upper(F.substr(directive, length + 1))
        following = rest.startswith("-NEXT-LINE")
        rest = F.when(following, F.substr(rest, F.lit(len("-NEXT-LINE") + 1))).otherwise(rest)
        rest = F.when(rest.startswith("-LINE"), F.substr(rest, F.lit(len("-LINE") + 1))).otherwise(rest)
        head = F.substring_index(rest, ":", 1)
        # ids stand behind the colon if nothing stands before it, else before it, and then behind white space
        listed = F.when((blank(head) == "") & rest.contains(":"), F.substring_index(rest, ":", -1)).when(F.substring(head, 1, 1).rlike(r"\s"), head).otherwise("")
        names = F.filter(F.transform(F.split(listed, ","), blank), lambda x: x != "")
        at = (line + following.cast("int")).cast("int")
        return F.transform(F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("*"))), lambda x: F.struct(at.alias("line"), x.alias("rule_id")))

    def of(comment: Column) -> Column:
        return F.flatten(F.transform(F.regexp_extract_all(comment["text"], F.lit(whole), F.lit(0)), lambda d: parsed(d, comment["line"])))

    directives = F.flatten(F.transform(comments(text), of))
    empty = F.array().cast("array<struct<line:int,rule_id:string>>")
    return F.when(F.lower(text).contains(f"{keyword.lower()}-"), directives).otherwise(empty)


def fingerprint(rule_id: Column, path: Column, snippet: Column) -> Column:
    """16 hex digits of rule, path and snippet, whatever their white space and slashes."""
    plain = F.regexp_replace(F.regexp_replace(snippet, r"^\s+|\s+$", ""), r"\s+", " ")
    return F.substring(F.sha2(F.concat_ws("|", rule_id, F.replace(path, F.lit("\\"), F.lit("/")), plain), 256), 1, 16)


def terminal_text(text: Column) -> Column:
    """Without escape sequences, line ends and control characters."""
    x = F.regexp_replace(text, CONTROL_SEQUENCE, "")
    return F.regexp_replace(F.regexp_replace(x, "\r\n|\r|\n", " "), "[\x00-\x1f\x7f]", "")


def markdown_cell(text: Column) -> Column:
    x = F.regexp_replace(text, "\r\n|\r|\n", " ")
    return F.replace(F.replace(x, F.lit("|"), F.lit("\\|")), F.lit("`"), F.lit("'"))


def brace_change(line: Column) -> Column:
    """By how much a line changes the depth of braces."""
    count = lambda c: F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))
    return (count("{") - count("}")).cast("long")


def inside_literal(line: Column, index: Column) -> Column:
    """Whether the character at the 1-based index stands in a literal, its opening quote included."""
    before = F.substr(line, F.lit(1), index)
    parts = F.regexp_extract_all(before, F.lit(LITERAL), F.lit(0))
    last = F.element_at(parts, -1)
    literal = last.startswith('"') | last.startswith("'")
    closed = literal & (F.length(last) > 1) & last.rlike(r"""(?s)^(?:"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')$""")
    return F.coalesce(literal & ~closed | closed & (F.length(last) > 0), F.lit(False))
