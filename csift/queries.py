"""Queries over the given tables, and SQL that must give the same rows.

For rules the SQL holds what must be found by construction: each template's lines and messages, joined with the table
that the corpus is made of. For lexing and for what is done with findings it computes the same from the text.
"""

from __future__ import annotations

import functools
import re
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from csift.corpus import ALL_CASES, CASES, corpus, corpus_sql, sources_of, sql_text
from csift.functions import classify, lexing
from csift.operators import baseline, chunks, summary
from csift.operators.asof import nearest_before
from csift.operators.band import band_join
from csift.operators.durable import durable, shared_folder
from csift.operators.findings import at_least, findings, first_wins, needs_facts, suppressed, with_hits
from csift.operators.lines import ARRAY, FILLED, brace_depths, line_rows, room_of_buffers
from csift.operators.parse import lexed, parsed, reach, relation
from csift.operators.snapshots import Snapshots
from csift.plans import report
from csift.plans.scan import Scan, ScanConfig
from csift.rules import catalog
from csift.rules.facts import parts_of
from csift.rules.table_rules import register_table_rule
from csift.schema import FINDING, FINDING_COLUMNS
from csift.sources.ignore import IgnoreRules

FOUND = ("file_path", "rule_id", "line_number", "impact", "message")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rule_query(number: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = corpus(table(spark, sf_dir, "part"), sources_of(number))
        return findings(with_hits(parsed(files, needs_facts([number]), numbers=[number], asked=parts_of([number])), [number]), numbers=[number]).select(*FOUND)

    run.__doc__ = f"Findings of rule {number} in its corpus."
    return run


def message_text(number: int, parameters: tuple[str, ...]) -> str:
    form = parameters[0] if number in catalog.FORMS else ""
    values = parameters
    if number == 1 and form == "call":
        values = (*parameters, *catalog.BANNED[parameters[1]])
    return re.sub(r"\{(\d)\}", lambda m: values[int(m[1])] if int(m[1]) < len(values) else "", catalog.MESSAGES[number, form])


def severity_of(number: int, parameters: tuple[str, ...]) -> str:
    return "Low" if number == 1 and parameters[0] == "bounded" else catalog.BY_NUMBER[number].impact


def expected_sql(number: int, cases=None, first: int = 0, of: int | None = None) -> str:
    """What must be found, as rows; `first` is the first template's place among `of`."""
    cases = CASES[number] if cases is None else cases
    of = of or len(cases)
    parts = [
        f"SELECT 'src/f' || p_partkey || '.c' AS file_path, '{catalog.rule_id(number)}' AS rule_id, CAST({line} AS INT) AS line_number, '{severity_of(number, p)}' AS impact, {sql_text(message_text(number, p))} AS message FROM part WHERE p_partkey % {of} = {first + i}"
        for i, (_, hits) in enumerate(cases)
        for line, p in hits
    ]
    return " UNION ALL ".join(parts)


# A corpus of some rules together, for what is done with findings.
MIXED = (1, 12, 18, 24, 26)
MIXED_SOURCES = [s for n in MIXED for s in sources_of(n)] + [
    "int main(void) {\n  char b[9];\n  gets(b); // csift-ignore: CSIFT-001\n  // csift-ignore-next-line\n  gets(b);\n  gets(b); /* csift-disable-line CSIFT-012 */\n  puts(\"// csift-ignore\"); gets(b);\n  return @N;\n}\n"
]
#: (line, suppressing directives) of the last template: (line, rule).
DIRECTIVES = [(3, "CSIFT-001"), (5, "*"), (6, "CSIFT-012")]


def mixed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(table(spark, sf_dir, "part"), MIXED_SOURCES)


def mixed_hits(spark: SparkSession, sf_dir: str, twice: bool = False) -> DataFrame:
    """Line rules only, so nothing is parsed; kept where it is read twice."""
    parses = parsed(mixed_files(spark, sf_dir), with_facts=False, numbers=MIXED)
    return with_hits(parses.persist(StorageLevel.MEMORY_AND_DISK) if twice else parses, MIXED, "regex")


def mixed_findings(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    return findings(mixed_hits(spark, sf_dir), numbers=MIXED, **how)


def mixed_sql(suppressed_too: bool = False) -> str:
    parts, at = [], 0
    for n in MIXED:
        parts.append(expected_sql(n, first=at, of=len(MIXED_SOURCES)))
        at += len(CASES[n])
    lines = [3, 5, 6, 7] if suppressed_too else [6, 7]
    message = message_text(1, ("call", "gets")).replace("'", "''")
    parts += [f"SELECT 'src/f' || p_partkey || '.c', 'CSIFT-001', CAST({line} AS INT), 'High', '{message}' FROM part WHERE p_partkey % {len(MIXED_SOURCES)} = {at}" for line in lines]
    return " UNION ALL ".join(parts)


# lexing
def lines_loc(spark, sf_dir):
    """Lines of each document, counted as an editor counts them."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(lexing.split_lines(F.coalesce("text", F.lit("")))).cast("long").alias("loc"))


LINES_SQL = r"""
WITH d AS (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]') AS parts FROM documents)
SELECT doc_id, CAST(len(parts) - CASE WHEN parts[-1] = '' THEN 1 ELSE 0 END AS BIGINT) AS loc FROM d
"""
LEX_SOURCES = [source for _, _, source in ALL_CASES if "/*" in source or "//" in source or '"' in source or "'" in source] + [
    "/* one\n   two */ int a@K; // end\nchar *s = \"/* no */ // no\"; char c = '\"'; /* open\n x",
    "char *t = \"a\\\"b\"; // \"c\nint b = @N; /**/ int d; /* x *//* y */\n",
]
SQL_TOKEN = r"""(?s)/\*(?:.*?\*/|.*\z)|//[^\n]*|"(?:[^"\\]|\\.)*(?:"|\\?\z)|'(?:[^'\\]|\\.)*(?:'|\\?\z)|[^/"']+|/"""


def lex_corpus(spark, sf_dir):
    return lexed(corpus(table(spark, sf_dir, "part"), LEX_SOURCES))


def strip_comments(spark, sf_dir):
    """The corpus without comments, geometry kept."""
    return lex_corpus(spark, sf_dir).select("path", "clean")


def _tokens_sql(column: str = "content") -> str:
    return f"regexp_extract_all({column}, '{SQL_TOKEN.replace(chr(39), chr(39) * 2)}')"


STRIP_SQL = f"""
WITH c AS ({corpus_sql(LEX_SOURCES)}), t AS (SELECT path, unnest({_tokens_sql()}) AS tok, generate_subscripts({_tokens_sql()}, 1) AS i FROM c)
SELECT path, string_agg(CASE WHEN starts_with(tok, '//') OR starts_with(tok, '/*') THEN regexp_replace(tok, '[^\\n]', ' ', 'g') ELSE tok END, '' ORDER BY i) AS clean FROM t GROUP BY path
"""


def mask_literals(spark, sf_dir):
    """The corpus's lines with what literals hold made x."""
    rows = lex_corpus(spark, sf_dir).select("path", F.posexplode(lexing.split_lines(F.col("clean"))).alias("n", "line"))
    return rows.select("path", (F.col("n") + 1).cast("long").alias("line_number"), lexing.mask_literals(F.col("line")).alias("masked"))


MASK_TOKEN = r"""(?s)"(?:[^"\\]|\\.)*(?:"|\\?\z)|'(?:[^'\\]|\\.)*(?:'|\\?\z)|[^"']+""".replace("'", "''")
MASK_SQL = f"""
WITH s AS ({STRIP_SQL}), p AS (SELECT path, string_split(clean, chr(10)) AS ls FROM s),
l AS (SELECT path, unnest(ls) AS line, generate_subscripts(ls, 1) AS n, len(ls) AS total FROM p),
k AS (SELECT path, n, line FROM l WHERE NOT (n = total AND line = '')),
t AS (SELECT path, n, unnest(regexp_extract_all(line, '{MASK_TOKEN}')) AS tok, generate_subscripts(regexp_extract_all(line, '{MASK_TOKEN}'), 1) AS i FROM k),
e AS (SELECT *, substr(tok, 1, 1) AS q, regexp_replace(substr(tok, 2), '(?s)(\\\\).', '\\1x', 'g') AS rest FROM t),
m AS (SELECT path, n, i, CASE WHEN q NOT IN ('"', '''') THEN tok
        WHEN rest <> '' AND right(rest, 1) = q THEN q || regexp_replace(left(rest, length(rest) - 1), '(?s)(\\\\)x|.', '\\1x', 'g') || q
        ELSE q || regexp_replace(rest, '(?s)(\\\\)x|.', '\\1x', 'g') END AS x FROM e)
SELECT k.path, CAST(k.n AS BIGINT) AS line_number, coalesce(string_agg(m.x, '' ORDER BY m.i), '') AS masked FROM k LEFT JOIN m ON k.path = m.path AND k.n = m.n GROUP BY k.path, k.n
"""


def comment_extract(spark, sf_dir):
    """The corpus's comments, with the lines they begin in."""
    rows = lex_corpus(spark, sf_dir).select("path", F.inline(lexing.comments(F.col("content"))))
    return rows.select("path", F.col("line").cast("long").alias("line"), "text")


COMMENT_SQL = f"""
WITH c AS ({corpus_sql(LEX_SOURCES)}), t AS (SELECT path, unnest({_tokens_sql()}) AS tok, generate_subscripts({_tokens_sql()}, 1) AS i FROM c),
n AS (SELECT *, 1 + coalesce(sum(length(tok) - length(replace(tok, chr(10), ''))) OVER (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM t)
SELECT path, CAST(line AS BIGINT) AS line, tok AS text FROM n WHERE starts_with(tok, '//') OR starts_with(tok, '/*')
"""


def _claused(text: str = "text"):
    """A text whose sentences' last parts are comments: from a comma to the full stop, and from a colon to the line's end."""
    out = F.coalesce(F.col(text), F.lit(""))
    for old, new in (", ", " /* "), (". ", " */ "), (": ", " // "):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


CLAUSED_SQL = "SELECT doc_id, replace(replace(replace(coalesce(text, ''), ', ', ' /* '), '. ', ' */ '), ': ', ' // ') AS content FROM documents"


def lex_in_pieces(spark, sf_dir):
    """Documents with clauses made comments, lexed piece by piece: stripped pieces, and comments with their lines."""
    files = table(spark, sf_dir, "documents").select("doc_id", _claused().alias("content"))
    pieces = chunks.lex(files, ["doc_id"], "content")
    clean = chunks.strip_comments(pieces, ["doc_id"]).select("doc_id", F.lit("clean").alias("part"), F.col("piece").alias("place"), F.col("clean").alias("text"))
    return clean.unionByName(chunks.comments(pieces, ["doc_id"]).select("doc_id", F.lit("comment").alias("part"), F.col("line").alias("place"), "text"))


PIECES_SQL = f"""
WITH c AS ({CLAUSED_SQL}), t AS (SELECT doc_id, unnest({_tokens_sql()}) AS tok, generate_subscripts({_tokens_sql()}, 1) AS i FROM c),
n AS (SELECT *, 1 + coalesce(sum(length(tok) - length(replace(tok, chr(10), ''))) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM t),
s AS (SELECT doc_id, string_agg(CASE WHEN starts_with(tok, '//') OR starts_with(tok, '/*') THEN regexp_replace(tok, '[^\\n]', ' ', 'g') ELSE tok END, '' ORDER BY i) AS clean FROM t GROUP BY doc_id),
w AS (SELECT c.doc_id, coalesce(s.clean, '') AS clean FROM c LEFT JOIN s ON c.doc_id IS NOT DISTINCT FROM s.doc_id),
p AS (SELECT doc_id, clean, unnest(range(greatest(1, CAST(ceil(length(clean) / {chunks.SIZE}e0) AS BIGINT)))) AS piece FROM w)
SELECT doc_id, 'clean' AS part, piece AS place, substr(clean, piece * {chunks.SIZE} + 1, {chunks.SIZE}) AS text FROM p
UNION ALL SELECT doc_id, 'comment', CAST(line AS BIGINT), tok FROM n WHERE starts_with(tok, '//') OR starts_with(tok, '/*')
"""


def _braced(line: str = "text"):
    """A text whose commas open braces and whose full stops close them."""
    out = F.coalesce(F.col(line), F.lit(""))
    return F.replace(F.replace(out, F.lit(","), F.lit("{")), F.lit("."), F.lit("}"))


def running_depth(spark, sf_dir):
    """Net depth after each line of each document, commas opening and full stops closing."""
    lines = line_rows(table(spark, sf_dir, "documents").select("doc_id", _braced().alias("content")), ["doc_id"], "content")
    return brace_depths(lines, ["doc_id"]).select("doc_id", "line_number", "depth")


DOCUMENT_LINES_SQL = r"""
WITH d AS (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]') AS parts FROM documents),
u AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS line_number, len(parts) AS total FROM d),
l AS (SELECT doc_id, line, line_number FROM u WHERE NOT (line_number = total AND line = ''))
"""
DEPTH_SQL = f"""
{DOCUMENT_LINES_SQL}
SELECT doc_id, line_number, CAST(sum(len(line) - len(replace(line, ',', '')) - len(line) + len(replace(line, '.', ''))) OVER (PARTITION BY doc_id ORDER BY line_number) AS BIGINT) AS depth FROM l
"""


def buffer_room(spark, sf_dir):
    """Buffers that calls of the corpus fill, each with the nearest declaration above."""
    files = lexed(corpus(table(spark, sf_dir, "part"), sources_of(1) + sources_of(37) + BUFFERS))
    return room_of_buffers(line_rows(files, ["path"], "clean"), ["path"])


BUFFERS = [
    "void f_@K(char *s) {\n  char b[@N];\n  strcpy(b, s); // char b[1]\n  char b[7]; strcat(b, s);\n  memcpy(c, b, 3);\n}\nint c[4];\nvoid g_@K(void) { gets(c); gets(b); }\n",
]
ROOM_SQL = f"""
WITH s AS (SELECT path, string_split(clean, chr(10)) AS ls FROM ({STRIP_SQL.replace(corpus_sql(LEX_SOURCES), corpus_sql(sources_of(1) + sources_of(37) + BUFFERS))})),
l AS (SELECT path, unnest(ls) AS line, CAST(generate_subscripts(ls, 1) AS BIGINT) AS line_number FROM s),
a AS (SELECT path, line_number, unnest(regexp_extract_all(line, '{ARRAY}', 1)) AS name, CAST(unnest(regexp_extract_all(line, '{ARRAY}', 2)) AS DECIMAL(38, 0)) AS room FROM l),
f AS (SELECT path, line_number, unnest(regexp_extract_all(line, '{FILLED}', 1)) AS callee, unnest(regexp_extract_all(line, '{FILLED}', 2)) AS name FROM l)
SELECT f.path, f.name, f.line_number, f.callee, a.line_number AS declared, a.room FROM f ASOF LEFT JOIN a ON f.path = a.path AND f.name = a.name AND f.line_number >= a.line_number
"""


def _line_words(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Lines of documents by their first and by their last words, each with its source and its place in it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text")
    lines = line_rows(docs, ["doc_id", "source"], "text").withColumn("at", F.col("doc_id") * (1 << 24) + F.col("line_number"))
    heads = lines.select("source", F.regexp_extract("line", r"^(\w+)", 1).alias("name"), "at").filter("name <> ''")
    # from behind, for a pattern that ends with the line is tried at each of its places
    tails = lines.select("source", F.reverse(F.regexp_extract(F.reverse("line"), r"^\W*(\w+)", 1)).alias("name"), "at").filter("name <> ''")
    return heads, tails


def nearest_declaration(spark, sf_dir):
    """For each line, by its last word: the nearest line before in its source that begins with that word."""
    heads, tails = _line_words(spark, sf_dir)
    return nearest_before(tails, heads.withColumn("declared", F.col("at")), ["source", "name"], "at", ["declared"], same_place=False)


WORDS_SQL = rf"""
{DOCUMENT_LINES_SQL.replace("SELECT doc_id, regexp_split", "SELECT doc_id, coalesce(source, '') AS source, regexp_split").replace("SELECT doc_id, unnest", "SELECT doc_id, source, unnest").replace("SELECT doc_id, line,", "SELECT source, doc_id * 16777216 + line_number AS at_line, line,")},
h AS (SELECT source, regexp_extract(line, '^([A-Za-z0-9_]+)', 1) AS name, at_line FROM l WHERE regexp_matches(line, '^[A-Za-z0-9_]')),
t AS (SELECT source, regexp_extract(line, '([A-Za-z0-9_]+)[^A-Za-z0-9_]*$', 1) AS name, at_line FROM l WHERE regexp_matches(line, '[A-Za-z0-9_]'))
"""
NEAREST_SQL = f"""
{WORDS_SQL}
SELECT t.source, t.name, t.at_line AS "at", h.at_line AS declared FROM t ASOF LEFT JOIN h ON t.source = h.source AND t.name = h.name AND t.at_line > h.at_line
"""
#: Lines that a check and its use may be apart.
APART = 20


def check_then_use(spark, sf_dir):
    """Pairs of lines of a source, up to APART lines apart, the first of which begins with the word that ends the second."""
    heads, tails = _line_words(spark, sf_dir)
    return band_join(heads.withColumnRenamed("at", "checked"), tails.withColumnRenamed("at", "used"), ["source", "name"], "checked", "used", APART)


BAND_SQL = f"""
{WORDS_SQL}
SELECT t.source, t.name, h.at_line AS checked, t.at_line AS used FROM h JOIN t ON t.source = h.source AND t.name = h.name AND t.at_line BETWEEN h.at_line AND h.at_line + {APART}
"""


def secret_scan_documents(spark, sf_dir):
    """Lines of documents that give something named like a secret a literal of 40 hex digits."""
    docs = table(spark, sf_dir, "documents").filter(F.lower("text").contains("token"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    pattern = r'(?i)\b(\w*token)\s*=\s*"([0-9a-f]{40})"'
    found = lines.filter(F.col("line").rlike(pattern))
    return found.select("doc_id", (F.col("n") + 1).cast("long").alias("line_number"), F.regexp_extract("line", pattern, 1).alias("name"), lexing.fingerprint(F.lit("CSIFT-024"), F.col("doc_id").cast("string"), F.regexp_extract("line", pattern, 0)).alias("fingerprint"))


SECRET_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
m AS (SELECT *, regexp_extract(line, '(?i)\b(\w*token)\s*=\s*"([0-9a-f]{40})"', 0) AS hit FROM l)
SELECT doc_id, CAST(n AS BIGINT) AS line_number, regexp_extract(hit, '(?i)\b(\w*token)\s*=', 1) AS name, substr(sha256('CSIFT-024|' || doc_id || '|' || regexp_replace(trim(hit), '\s+', ' ', 'g')), 1, 16) AS fingerprint FROM m WHERE hit <> ''
"""


def script_calls_pages(spark, sf_dir):
    """Calls in the scripts of pages, their literals masked first."""
    scripts = F.regexp_extract_all("html", F.lit(r"(?s)<script[^>]*>(.*?)</script>"), F.lit(1))
    pages = table(spark, sf_dir, "pages").select("page_id", F.explode(scripts).alias("script"))
    rows = pages.select("page_id", F.explode(F.regexp_extract_all(lexing.mask_literals(F.col("script")), F.lit(r"\b[A-Za-z_]\w*\([^)]*\)"), F.lit(0))).alias("call"))
    return rows.select("page_id", F.regexp_extract("call", r"^(\w+)", 1).alias("callee"), F.regexp_extract("call", r"\((.*)\)$", 1).alias("arguments"))


SCRIPT_SQL = r"""
WITH e AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1)) AS script FROM pages),
s AS (SELECT page_id, regexp_replace(script, '"[^"]*"', '""', 'g') AS js FROM e),
c AS (SELECT page_id, unnest(regexp_extract_all(js, '\b[A-Za-z_]\w*\([^)]*\)')) AS call FROM s)
SELECT page_id, regexp_extract(call, '^(\w+)', 1) AS callee, regexp_extract(call, '\((.*)\)$', 1) AS arguments FROM c
"""


# suppression, dedup, fingerprints
def suppressions(spark, sf_dir):
    """Directives in the comments of the mixed corpus."""
    rows = lexed(mixed_files(spark, sf_dir)).select("path", F.inline(lexing.suppressions(F.col("content"))))
    return rows.select("path", F.col("line").cast("long").alias("line"), "rule_id")


SUPPRESSIONS_SQL = " UNION ALL ".join(
    f"SELECT 'src/f' || p_partkey || '.c' AS path, CAST({line} AS BIGINT) AS line, '{rule}' AS rule_id FROM part WHERE p_partkey % {len(MIXED_SOURCES)} = {len(MIXED_SOURCES) - 1}" for line, rule in DIRECTIVES
)


def suppressed_findings(spark, sf_dir):
    """Findings that stay, by an anti join with directives."""
    found = mixed_findings(spark, sf_dir, suppress=False)
    directives = lexed(mixed_files(spark, sf_dir)).select("path", F.inline(lexing.suppressions(F.col("content"))))
    return suppressed(found, directives).select(*FOUND)


def mixed_scan(spark, sf_dir):
    """Findings of some line rules in the mixed corpus, suppressed ones left out within their files."""
    return mixed_findings(spark, sf_dir).select(*FOUND)


def dedup_first_wins(spark, sf_dir):
    """Of equal (order, status, supplier) findings over order lines the first by line number stays."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("file_path"), F.col("l_linestatus").alias("rule_id"), (F.col("l_suppkey") % 3).cast("int").alias("line_number"), F.col("l_returnflag").alias("message"), "l_linenumber", "l_partkey",
    )
    return first_wins(lines, "l_linenumber", "l_partkey")


DEDUP_SQL = """
SELECT file_path, rule_id, line_number, message, l_linenumber, l_partkey FROM (
  SELECT CAST(l_orderkey AS VARCHAR) AS file_path, l_linestatus AS rule_id, CAST(l_suppkey % 3 AS INT) AS line_number, l_returnflag AS message, l_linenumber, l_partkey,
         row_number() OVER (PARTITION BY l_orderkey, l_linestatus, l_suppkey % 3, l_returnflag ORDER BY l_linenumber, l_partkey) AS nth FROM lineitem) WHERE nth = 1
"""


def fingerprints(spark, sf_dir):
    """Fingerprints of the documents' lines, and how often each occurs."""
    lines = table(spark, sf_dir, "documents").select("source", F.explode(F.split("text", "\n")).alias("line")).filter("trim(line) <> ''")
    return lines.groupBy(lexing.fingerprint(F.lit("CSIFT-000"), F.col("source"), F.col("line")).alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"))


FINGERPRINT_SQL = r"""
WITH l AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT substr(sha256('CSIFT-000|' || replace(source, chr(92), '/') || '|' || regexp_replace(regexp_replace(line, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')), 1, 16) AS fingerprint, count(*) AS n
FROM l WHERE trim(line) <> '' GROUP BY 1
"""


# sums
def file_summary(spark, sf_dir):
    """Counts by severity of every file, clean ones too."""
    rows = mixed_hits(spark, sf_dir, twice=True)
    return summary.file_summaries(rows, findings(rows, numbers=MIXED)).select("file_path", "lines_of_code", *[F.col(c).cast("long").alias(c) for c in ("issues_count", "high_count", "medium_count", "low_count")], "status", "parser", "confidence")


FILE_SQL = f"""
WITH f AS ({mixed_sql()}), c AS ({corpus_sql(MIXED_SOURCES)})
SELECT path AS file_path, CAST(length(content) - length(replace(content, chr(10), '')) AS INT) AS lines_of_code, count(f.rule_id) AS issues_count, count(CASE WHEN impact = 'High' THEN 1 END) AS high_count,
       count(CASE WHEN impact = 'Medium' THEN 1 END) AS medium_count, count(CASE WHEN impact = 'Low' THEN 1 END) AS low_count, 'success' AS status, 'regex' AS parser, 'LIMITED' AS confidence
FROM c LEFT JOIN f ON c.path = f.file_path GROUP BY path, content
"""


def severity_totals(spark, sf_dir):
    """One row over all files."""
    rows = mixed_hits(spark, sf_dir, twice=True)
    return summary.totals(summary.file_summaries(rows, findings(rows, numbers=MIXED)))


TOTALS_SQL = f"""
WITH s AS ({FILE_SQL})
SELECT count(*) AS files_discovered, count(*) AS files_analyzed, CAST(0 AS BIGINT) AS files_failed, CAST(sum(lines_of_code) AS BIGINT) AS lines_of_code, CAST(sum(issues_count) AS BIGINT) AS issues_count,
       CAST(sum(high_count) AS BIGINT) AS high_count, CAST(sum(medium_count) AS BIGINT) AS medium_count, CAST(sum(low_count) AS BIGINT) AS low_count FROM s
"""


def severity_rollup(spark, sf_dir):
    """Findings by severity and rule, with sums."""
    return summary.severity_rollup(mixed_findings(spark, sf_dir))


ROLLUP_SQL = f"WITH f AS ({mixed_sql()}) SELECT impact, rule_id, count(*) AS n FROM f GROUP BY ROLLUP (impact, rule_id)"


def severity_threshold(spark, sf_dir):
    """Findings of at least medium severity."""
    return at_least(mixed_findings(spark, sf_dir), "medium").select(*FOUND)


def severity_override(spark, sf_dir):
    """Rule 018 made High and rule 001 Medium; a bounded copy is Low all the same."""
    return mixed_findings(spark, sf_dir, overrides={"CSIFT-018": "High", "CSIFT-001": "Medium"}).select(*FOUND)


OVERRIDE_SQL = f"""
WITH f AS ({mixed_sql()})
SELECT file_path, rule_id, line_number, CASE WHEN rule_id = 'CSIFT-018' THEN 'High' WHEN rule_id = 'CSIFT-001' AND impact <> 'Low' THEN 'Medium' ELSE impact END AS impact, message FROM f
"""


def rule_skip(spark, sf_dir):
    """Without rule 018, by an anti join of the catalogue."""
    skipped = spark.range(1).select(F.lit("CSIFT-018").alias("rule_id"))
    kept = catalog.rules_table(spark).join(skipped, "rule_id", "left_anti").select("rule_id")
    return mixed_findings(spark, sf_dir).join(F.broadcast(kept), "rule_id", "left_semi").select(*FOUND)


def rule_catalog(spark, sf_dir):
    """The catalogue in its order."""
    order = catalog.catalogue_order(F.col("impact"), F.col("rule_id"))
    from pyspark.sql import Window

    rules = catalog.rules_table(spark)
    return rules.select("rule_id", "name", "impact", "engine", "cwe_id", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


def _catalog_sql() -> str:
    rows = ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in (r.rule_id, r.name, r.impact, r.engine, r.cwe_id)) + ")" for r in catalog.RULES)
    return f"SELECT *, row_number() OVER (ORDER BY CASE impact WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 ELSE 2 END, rule_id) AS place FROM (VALUES {rows}) AS t(rule_id, name, impact, engine, cwe_id)"


TIERS = ["int a_@K(void) { return @N; }\n", "int b_@K(int n) {\n  return n +;\n}\n", "#define BAD (\nint c_@K(void) { return BAD 1 + 2); }\n"]


def status_histogram(spark, sf_dir):
    """How many files were parsed how; every status has a row."""
    parses = parsed(corpus(table(spark, sf_dir, "part"), TIERS)).persist(StorageLevel.MEMORY_AND_DISK)
    none = findings(with_hits(parses, []), numbers=[])
    return summary.status_histogram(summary.file_summaries(parses, none))


STATUS_SQL = """
WITH n AS (SELECT CASE WHEN p_partkey % 3 = 1 THEN 'fallback-parser' ELSE 'parsed' END AS status FROM part),
e AS (SELECT * FROM (VALUES ('parsed'), ('fallback-parser'), ('regex'), ('parse-failed')) AS t(status))
SELECT e.status, count(n.status) AS files FROM e LEFT JOIN n ON e.status = n.status GROUP BY e.status
"""


# baseline: the lines of documents as findings, and an earlier state without every tenth document
def _line_findings(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.select(
        F.col("doc_id"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("file_path"), (F.col("n") + 1).alias("line_number"), F.lit(1).alias("column_number"), F.lit("CSIFT-000").alias("rule_id"), F.lit("").alias("message"),
        lexing.fingerprint(F.lit("CSIFT-000"), F.lit("d"), F.col("line")).alias("fingerprint"),
    )


LINE_FINDINGS_SQL = r"""
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
f AS (SELECT doc_id, n, substr(sha256('CSIFT-000|d|' || regexp_replace(regexp_replace(line, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')), 1, 16) AS fingerprint FROM l)
"""


def baseline_new(spark, sf_dir):
    """Findings beyond what the earlier state had of their fingerprint, the last in report order."""
    now = _line_findings(spark, sf_dir)
    before = baseline.fingerprint_counts(now.filter("doc_id % 10 <> 3"))
    return baseline.new_findings(now, before).select("doc_id", F.col("line_number").cast("long").alias("line_number"), "fingerprint")


BASELINE_NEW_SQL = f"""
WITH {LINE_FINDINGS_SQL}, b AS (SELECT fingerprint, count(*) AS had FROM f WHERE doc_id % 10 <> 3 GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY doc_id, n) AS nth FROM f)
SELECT r.doc_id, CAST(r.n AS BIGINT) AS line_number, r.fingerprint FROM r LEFT JOIN b ON r.fingerprint = b.fingerprint WHERE nth > coalesce(had, 0)
"""


def baseline_resolved(spark, sf_dir):
    """How many of an earlier state's findings are gone."""
    every = _line_findings(spark, sf_dir)
    return baseline.resolved_count(every.filter("doc_id % 10 <> 3"), baseline.fingerprint_counts(every))


RESOLVED_SQL = f"""
WITH {LINE_FINDINGS_SQL}, b AS (SELECT fingerprint, count(*) AS c FROM f GROUP BY 1), w AS (SELECT fingerprint, count(*) AS c FROM f WHERE doc_id % 10 <> 3 GROUP BY 1)
SELECT CAST(sum(greatest(b.c - coalesce(w.c, 0), 0)) AS BIGINT) AS resolved FROM b LEFT JOIN w ON b.fingerprint = w.fingerprint
"""

def snapshot_difference(spark, sf_dir):
    """Fingerprints of which two versions of a store have different counts: without every tenth document, then without others."""
    every = _line_findings(spark, sf_dir)
    folder = f"{shared_folder(spark)}/csift-snapshots-{uuid.uuid4().hex}"
    store = Snapshots(spark, f"csift_{uuid.uuid4().hex}", folder)
    for left_out in (3, 7):
        store.save(every.filter(F.col("doc_id") % 10 != left_out))
    out = durable(store.difference(1, 2))
    store.drop()
    return out


SNAPSHOT_SQL = f"""
WITH {LINE_FINDINGS_SQL}, a AS (SELECT fingerprint, count(*) AS c FROM f WHERE doc_id % 10 <> 3 GROUP BY 1), b AS (SELECT fingerprint, count(*) AS c FROM f WHERE doc_id % 10 <> 7 GROUP BY 1),
j AS (SELECT coalesce(a.fingerprint, b.fingerprint) AS fingerprint, coalesce(a.c, 0) AS before, coalesce(b.c, 0) AS after FROM a FULL JOIN b ON a.fingerprint = b.fingerprint)
SELECT fingerprint, greatest(after - before, 0) AS added, greatest(before - after, 0) AS resolved FROM j WHERE before <> after
"""


class Repeated:
    """A rule of a user's own: a line that says what the line before said, blank lines apart."""

    def __init__(self):
        self.last, self.count = None, 0

    def line(self, row):
        said = row["line"].strip(" ")
        if said and said == self.last:
            self.count += 1
            yield row["line_number"], "repeats the line before"
        self.last = said or self.last

    def end(self):
        if self.count > 1:
            yield 0, f"{self.count} repeated lines"


def table_rule_lines(spark, sf_dir):
    """A user's rule as a table function over the lines of documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    view, function = f"lines_{uuid.uuid4().hex}", f"repeated_{uuid.uuid4().hex}"
    line_rows(docs, ["path"], "text").createOrReplaceTempView(view)
    register_table_rule(spark, function, Repeated)
    return spark.sql(f"SELECT path, line, message FROM {function}(TABLE({view}) PARTITION BY path ORDER BY line_number)")


TABLE_RULE_SQL = f"""
{DOCUMENT_LINES_SQL},
s AS (SELECT doc_id, line_number, trim(line, ' ') AS said FROM l WHERE trim(line, ' ') <> ''),
r AS (SELECT *, lag(said) OVER (PARTITION BY doc_id ORDER BY line_number) AS last FROM s),
h AS (SELECT doc_id, line_number FROM r WHERE said = last)
SELECT CAST(doc_id AS VARCHAR) AS path, CAST(line_number AS INT) AS line, 'repeats the line before' AS message FROM h
UNION ALL SELECT CAST(doc_id AS VARCHAR), 0, count(*) || ' repeated lines' FROM h GROUP BY doc_id HAVING count(*) > 1
"""

IGNORED = ["*.html", "!keep*.html", "/en/*", "de/", "page?.txt", "!en/1*"]


def ignore_filter(spark, sf_dir):
    """Paths of pages that ignore rules leave in."""
    paths = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_extract("url", r"^\w+://[^/]*/([^?#]*)", 1), "^/+", "").alias("path"))
    return paths.filter(~IgnoreRules(IGNORED).column(F.col("path")))


IGNORE_SQL = r"""
WITH p AS (SELECT page_id, ltrim(regexp_extract(url, '^\w+://[^/]*/([^?#]*)', 1), '/') AS path FROM pages),
d AS (SELECT *, CASE
  WHEN regexp_matches(path, '^en/1[^/]*(?:/.*)?$') THEN false
  WHEN regexp_matches(path, '(?:^|/)page[^/]\.txt(?:/.*)?$') THEN true
  WHEN regexp_matches(path, '(?:^|/)de/.*$') THEN true
  WHEN regexp_matches(path, '^en/[^/]*(?:/.*)?$') THEN true
  WHEN regexp_matches(path, '(?:^|/)keep[^/]*\.html(?:/.*)?$') THEN false
  WHEN regexp_matches(path, '(?:^|/)[^/]*\.html(?:/.*)?$') THEN true
  WHEN regexp_matches(path, '(?:^|/)(?:\.git|\.svn|\.hg|build|dist|out|node_modules|__pycache__|\.venv|venv)/.*$') THEN true
  WHEN regexp_matches(path, '(?:^|/)[^/]*\.(?:o|obj|a|so|exe|d)(?:/.*)?$') THEN true ELSE false END AS ignored FROM p)
SELECT page_id, path FROM d WHERE NOT ignored
"""

# facts
FACT_SOURCES = ["int f_@K(char *p, int n) {\n  char *q = malloc(n);\n  if (q == NULL) {\n    return @N;\n  }\n  q[0] = p[0];\n  free(q);\n  return 0;\n}\n", "unsigned long total_@K;\nstatic int g_@K(void) {\n  int a = 1, *b = &a;\n  return h(a, k(*b));\n}\n"]


def _facts(spark, sf_dir, *asked: str) -> DataFrame:
    """Parses of the corpus with what is asked of the facts; no rule looks at it."""
    return parsed(corpus(table(spark, sf_dir, "part"), FACT_SOURCES), numbers=[], asked=asked)


def functions(spark, sf_dir):
    """Functions of the corpus."""
    return relation(_facts(spark, sf_dir), "functions").select("path", "name", "return_type", "start_line", "end_line", "empty_params", "void_params")


FUNCTIONS_SQL = """
SELECT 'src/f' || p_partkey || '.c' AS path, CASE p_partkey % 2 WHEN 0 THEN 'f_' ELSE 'g_' END || p_partkey AS name, 'int' AS return_type,
       CAST(CASE p_partkey % 2 WHEN 0 THEN 1 ELSE 2 END AS INT) AS start_line, CAST(CASE p_partkey % 2 WHEN 0 THEN 9 ELSE 5 END AS INT) AS end_line, false AS empty_params, p_partkey % 2 = 1 AS void_params FROM part
"""


def variables(spark, sf_dir):
    """Local variables of the corpus."""
    return relation(_facts(spark, sf_dir), "variables").select("path", "name", "type", "is_pointer", "has_initializer", "line")


VARIABLES_SQL = """
SELECT 'src/f' || p_partkey || '.c' AS path, v.name, v.type, v.is_pointer, true AS has_initializer, CAST(v.line AS INT) AS line
FROM part JOIN (VALUES (0, 'q', 'char *', true, 2), (1, 'a', 'int', false, 3), (1, 'b', 'int *', true, 3)) AS v(w, name, type, is_pointer, line) ON p_partkey % 2 = v.w
"""


def calls(spark, sf_dir):
    """Calls of the corpus in order, with targets."""
    return relation(_facts(spark, sf_dir, "calls"), "calls").select("path", F.col("call_idx").cast("long").alias("call_idx"), "callee", "line", "raw_args", "target")


CALLS_SQL = """
SELECT 'src/f' || p_partkey || '.c' AS path, CAST(v.i AS BIGINT) AS call_idx, v.callee, CAST(v.line AS INT) AS line, v.raw_args, v.target
FROM part JOIN (VALUES (0, 0, 'malloc', 2, 'n', 'q'), (0, 1, 'free', 7, 'q', NULL), (1, 0, 'h', 4, 'a, k(*b)', NULL), (1, 1, 'k', 4, '*b', NULL)) AS v(w, i, callee, line, raw_args, target) ON p_partkey % 2 = v.w
"""


def node_facts(spark, sf_dir):
    """What is known of each variable before each node that names it."""
    facts = relation(_facts(spark, sf_dir, "flow"), "node_facts")
    return facts.select("path", "line", "kind", F.col("var").alias("name"), "nullness", "init", "alloc")


#: (template, line, kind, name, nullness, init, alloc) before each node.
NODE_FACTS = [
    (0, 2, "allocation", "malloc", "UNKNOWN", "UNINITIALIZED", "NOT_ALLOCATED"), (0, 2, "allocation", "n", "UNKNOWN", "INITIALIZED", "NOT_ALLOCATED"), (0, 2, "allocation", "q", "UNKNOWN", "INITIALIZED", "NOT_ALLOCATED"),
    (0, 3, "if_cond", "NULL", "UNKNOWN", "UNINITIALIZED", "NOT_ALLOCATED"), (0, 3, "if_cond", "q", "MAYBE_NULL", "INITIALIZED", "ALLOCATED"), (0, 6, "assignment", "p", "UNKNOWN", "INITIALIZED", "NOT_ALLOCATED"),
    (0, 6, "assignment", "q", "NON_NULL", "INITIALIZED", "ALLOCATED"), (0, 7, "free", "q", "NON_NULL", "INITIALIZED", "ALLOCATED"), (1, 3, "decl", "a", "UNKNOWN", "INITIALIZED", "NOT_ALLOCATED"),
    (1, 3, "decl", "a", "UNKNOWN", "INITIALIZED", "NOT_ALLOCATED"), (1, 3, "decl", "b", "UNKNOWN", "INITIALIZED", "NOT_ALLOCATED"), (1, 4, "return", "a", "UNKNOWN", "INITIALIZED", "NOT_ALLOCATED"),
    (1, 4, "return", "b", "UNKNOWN", "INITIALIZED", "NOT_ALLOCATED"), (1, 4, "return", "h", "UNKNOWN", "UNINITIALIZED", "NOT_ALLOCATED"), (1, 4, "return", "k", "UNKNOWN", "UNINITIALIZED", "NOT_ALLOCATED"),
]
NODE_SQL = f"""
SELECT 'src/f' || p_partkey || '.c' AS path, CAST(v.line AS INT) AS line, v.kind, v.name, v.nullness, v.init, v.alloc
FROM part JOIN (VALUES {", ".join(map(str, NODE_FACTS))}) AS v(w, line, kind, name, nullness, init, alloc) ON p_partkey % 2 = v.w
"""


def reachability(spark, sf_dir):
    """Pairs of lines of which the second can follow the first, by paths of any length."""
    return reach(_facts(spark, sf_dir, "flow")).select("path", "from_line", "to_line")


REACH_SQL = """
SELECT 'src/f' || p_partkey || '.c' AS path, CAST(v.a AS INT) AS from_line, CAST(v.b AS INT) AS to_line
FROM part JOIN (VALUES (0, 2, 3), (0, 2, 4), (0, 2, 6), (0, 2, 7), (0, 2, 8), (0, 3, 4), (0, 3, 6), (0, 3, 7), (0, 3, 8), (0, 6, 7), (0, 6, 8), (0, 7, 8),
                       (1, 3, 3), (1, 3, 4), (1, 3, 4)) AS v(w, a, b) ON p_partkey % 2 = v.w
"""


def symbol_resolution(spark, sf_dir):
    """The types of names in calls: a local's, else a parameter's, else a global's, looked up where the file's row lies."""
    typed = lambda items: F.transform(items, lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type")))
    functions = _facts(spark, sf_dir, "calls").select("path", typed(F.col("parse.globals")).alias("outer"), F.explode("parse.functions").alias("f"))
    calls = functions.select("path", "outer", typed(F.col("f.params")).alias("given"), typed(F.col("f.variables")).alias("local"), F.explode("f.calls").alias("call"))
    words = F.regexp_extract_all("call.raw_args", F.lit(lexing.IDENTIFIER), F.lit(0))
    used = calls.select("path", F.col("call.callee").alias("callee"), "local", "given", "outer", F.explode(F.array_distinct(words)).alias("name"))
    for scope in ("local", "given", "outer"):
        # each declaration of the name is a row, as a join has it; globals may be declared more than once
        own = F.transform(F.filter(scope, lambda x: x["name"] == F.col("name")), lambda x: x["type"])
        used = used.withColumn(f"_{scope}", F.explode_outer(own))
    return used.select("path", "callee", "name", F.coalesce("_local", "_given", "_outer").alias("type"))


SYMBOL_SQL = """
SELECT 'src/f' || p_partkey || '.c' AS path, v.callee, v.name, v.type
FROM part JOIN (VALUES (0, 'malloc', 'n', 'int'), (0, 'free', 'q', 'char *'), (1, 'h', 'a', 'int'), (1, 'h', 'k', NULL), (1, 'h', 'b', 'int *'), (1, 'k', 'b', 'int *')) AS v(w, callee, name, type) ON p_partkey % 2 = v.w
"""


def sensitive_words(spark, sf_dir):
    """Which parts' names are sensitive identifiers, and event types too: the classifiers over plain tables."""
    names = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", r"\s+")).alias("word")).union(table(spark, sf_dir, "events").select("event_type")).distinct()
    more = spark.range(1).select(F.explode(F.array(*map(F.lit, ("session_key", "keyboard", "my_iv", "drive", "apiKey", "keys", "hash_len", "key_size", "design_token", "passage_hash")))).alias("word"))
    return names.union(more).select("word", classify.sensitive_name(F.col("word")).alias("sensitive"), classify.security_function(F.col("word")).alias("security"))


def _words_sql() -> str:
    has = lambda words: f"regexp_matches(low, '{'|'.join(words)}')"
    part = lambda words: f"regexp_matches(low, '(?:^|[^a-z0-9])(?:{'|'.join(words)})(?:[^a-z0-9]|$)')"
    c = classify
    chance = f"(contains(low, 'sig') AND NOT contains(low, 'signature') AND NOT {part(['sig'])} OR contains(low, 'pass') AND NOT {has(['password', 'passwd'])} AND NOT {part(['pass'])})"
    more = "'session_key', 'keyboard', 'my_iv', 'drive', 'apiKey', 'keys', 'hash_len', 'key_size', 'design_token', 'passage_hash'"
    return f"""
WITH n AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(p_name, '\\s+')) AS word FROM part UNION ALL SELECT event_type FROM events)),
w AS (SELECT word, lower(word) AS low FROM (SELECT word FROM n UNION ALL SELECT unnest([{more}])))
SELECT word, NOT {has(c.NOT_SENSITIVE)} AND CASE WHEN {has(c.SENSITIVE)} THEN NOT {chance} ELSE {part(c.SEGMENTS)} OR {has(['key', 'crypto'])} AND low <> 'keys' END AS sensitive,
       {has(c.SECURITY)} OR {part(c.SEGMENTS)} OR {has(c.ACTIONS)} AND ({has(c.NOUNS)} OR {part(['iv'])}) AND NOT {has(c.METADATA)} AS security FROM w
"""


def precision_recall(spark, sf_dir):
    """Of what must be found and what was: rule 3 in its corpus."""
    reported = rule_query(3)(spark, sf_dir).select(F.col("file_path").alias("path"), F.col("line_number").alias("line"), "rule_id")
    keys = table(spark, sf_dir, "part").filter(F.col("p_partkey") % len(CASES[3]) == 0)
    expected = keys.select(F.concat(F.lit("src/f"), F.col("p_partkey").cast("string"), F.lit(".c")).alias("path"), F.lit(2).alias("line"), F.lit("CSIFT-003").alias("rule_id"))
    return summary.precision_recall(expected, reported)


PRECISION_SQL = f"SELECT count(CASE WHEN p_partkey % {len(CASES[3])} = 0 THEN 1 END) AS expected, count(CASE WHEN p_partkey % {len(CASES[3])} = 0 THEN 1 END) AS matched, CAST(0 AS BIGINT) AS missing, count(CASE WHEN p_partkey % {len(CASES[3])} = 2 THEN 1 END) AS unexpected FROM part"


def full_scan(spark, sf_dir):
    """All 38 rules over all templates, in hybrid mode: findings by rule. Rows only: rules meet each other's templates."""
    files = corpus(table(spark, sf_dir, "part"), [source for _, _, source in ALL_CASES])
    return findings(with_hits(parsed(files), [r.number for r in catalog.RULES])).groupBy("rule_id", "impact").agg(F.count(F.lit(1)).alias("n"))


def json_report(spark, sf_dir):
    """The mixed corpus's findings as the JSON report writes them, one text a finding, read back."""
    texts = mixed_findings(spark, sf_dir).select(report.json_of(*FINDING_COLUMNS).alias("json"))
    return texts.select(F.from_json("json", FINDING).alias("x")).select(*[f"x.{c}" for c in (*FOUND, "column_number", "code_snippet", "fingerprint")])


SARIF = (
    "ruleId string, level string, message struct<text:string>, partialFingerprints struct<primaryLocationLineHash:string>, "
    "locations array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,startColumn:int,snippet:struct<text:string>>>>>"
)


def sarif_results(spark, sf_dir):
    """The mixed corpus's findings as the SARIF report writes its results, read back."""
    texts = mixed_findings(spark, sf_dir).select(report.sarif_result().alias("json"))
    place = F.get("x.locations", F.lit(0))["physicalLocation"]
    return texts.select(F.from_json("json", SARIF).alias("x")).select(
        "x.ruleId", "x.level", F.col("x.message.text").alias("message"), place["artifactLocation"]["uri"].alias("uri"), place["region"]["startLine"].alias("startLine"),
        place["region"]["startColumn"].alias("startColumn"), place["region"]["snippet"]["text"].alias("snippet"), F.col("x.partialFingerprints.primaryLocationLineHash").alias("hash"),
    )


def _placed_sql() -> str:
    """What mixed_sql has, with each finding's snippet, column and fingerprint, from the templates' lines."""
    cases = [(n, source, hits) for n in MIXED for source, hits in CASES[n]]
    cases.append((1, MIXED_SOURCES[-1], [(6, ("call", "gets")), (7, ("call", "gets"))]))
    parts = []
    for at, (n, source, hits) in enumerate(cases):
        for line, p in hits:
            word = {1: p[1] if n == 1 else "", 12: p[0] if p else "", 18: "goto", 24: "char", 26: p[0] if p else ""}[n]
            raw = sql_text(source.split("\n")[line - 1])
            parts.append(
                f"SELECT 'src/f' || p_partkey || '.c' AS file_path, '{catalog.rule_id(n)}' AS rule_id, CAST({line} AS INT) AS line_number, '{severity_of(n, p)}' AS impact, {sql_text(message_text(n, p))} AS message, "
                f"CAST(strpos({raw}, {sql_text(word)}) AS INT) AS column_number, trim({raw}) AS code_snippet FROM part WHERE p_partkey % {len(MIXED_SOURCES)} = {at}"
            )
    return f"SELECT *, substr(sha256(rule_id || '|' || file_path || '|' || regexp_replace(code_snippet, '\\s+', ' ', 'g')), 1, 16) AS fingerprint FROM ({' UNION ALL '.join(parts)})"


SARIF_SQL = f"""
SELECT rule_id AS "ruleId", CASE impact WHEN 'High' THEN 'error' WHEN 'Medium' THEN 'warning' ELSE 'note' END AS level, message, file_path AS uri, line_number AS "startLine", column_number AS "startColumn",
       code_snippet AS snippet, fingerprint AS hash FROM ({_placed_sql()})
"""


def text_report(spark, sf_dir):
    """The mixed corpus's whole text report: section, place in it, and text."""
    rows = mixed_hits(spark, sf_dir, twice=True)
    found = findings(rows, numbers=MIXED)
    errors = rows.filter("error is not null").select(F.col("path").alias("file_path"), "error.error_type", "error.message")
    scan = Scan("corpus", ScanConfig(MIXED, "regex"), rows, found, summary.file_summaries(rows, found), errors)
    return report.report_rows(scan, "text")


TEXT_SQL = f"""
WITH f AS ({_placed_sql()}), t AS ({TOTALS_SQL})
SELECT 0 AS section, row_number() OVER (ORDER BY file_path, line_number, column_number, rule_id, message) AS nth,
       file_path || ':' || line_number || ':' || column_number || ': ' || impact || ': ' || message || ' [' || rule_id || ']' || chr(10) || '    ' || code_snippet AS text FROM f
UNION ALL SELECT 4, CAST(0 AS BIGINT), files_analyzed || ' files, ' || lines_of_code || ' lines: ' || issues_count || ' findings (' || high_count || ' high, ' || medium_count || ' medium, ' || low_count || ' low)' FROM t
"""

PLAIN = {
    "lines_loc": (lines_loc, LINES_SQL),
    "strip_comments": (strip_comments, STRIP_SQL),
    "mask_literals": (mask_literals, MASK_SQL),
    "comment_extract": (comment_extract, COMMENT_SQL),
    "lex_in_pieces": (lex_in_pieces, PIECES_SQL),
    "running_depth": (running_depth, DEPTH_SQL),
    "buffer_room": (buffer_room, ROOM_SQL),
    "nearest_declaration": (nearest_declaration, NEAREST_SQL),
    "check_then_use": (check_then_use, BAND_SQL),
    "secret_scan_documents": (secret_scan_documents, SECRET_SQL),
    "script_calls_pages": (script_calls_pages, SCRIPT_SQL),
    "suppressions": (suppressions, SUPPRESSIONS_SQL),
    "suppressed_findings": (suppressed_findings, mixed_sql()),
    "mixed_scan": (mixed_scan, mixed_sql()),
    "dedup_first_wins": (dedup_first_wins, DEDUP_SQL),
    "fingerprints": (fingerprints, FINGERPRINT_SQL),
    "file_summary": (file_summary, FILE_SQL),
    "severity_totals": (severity_totals, TOTALS_SQL),
    "severity_rollup": (severity_rollup, ROLLUP_SQL),
    "severity_threshold": (severity_threshold, f"SELECT * FROM ({mixed_sql()}) WHERE impact IN ('High', 'Medium')"),
    "severity_override": (severity_override, OVERRIDE_SQL),
    "rule_skip": (rule_skip, f"SELECT * FROM ({mixed_sql()}) WHERE rule_id <> 'CSIFT-018'"),
    "rule_catalog": (rule_catalog, _catalog_sql()),
    "status_histogram": (status_histogram, STATUS_SQL),
    "baseline_new": (baseline_new, BASELINE_NEW_SQL),
    "baseline_resolved": (baseline_resolved, RESOLVED_SQL),
    "snapshot_difference": (snapshot_difference, SNAPSHOT_SQL),
    "table_rule_lines": (table_rule_lines, TABLE_RULE_SQL),
    "ignore_filter": (ignore_filter, IGNORE_SQL),
    "functions": (functions, FUNCTIONS_SQL),
    "variables": (variables, VARIABLES_SQL),
    "calls": (calls, CALLS_SQL),
    "node_facts": (node_facts, NODE_SQL),
    "reachability": (reachability, REACH_SQL),
    "symbol_resolution": (symbol_resolution, SYMBOL_SQL),
    "sensitive_words": (sensitive_words, _words_sql()),
    "precision_recall": (precision_recall, PRECISION_SQL),
    "full_scan": (full_scan, None),
    "json_report": (json_report, _placed_sql()),
    "text_report": (text_report, TEXT_SQL),
    "sarif_results": (sarif_results, SARIF_SQL),
}


@functools.cache
def _all() -> dict:
    rules = {f"rule_{n:03d}": (rule_query(n), expected_sql(n)) for n in sorted(CASES)}
    return {**rules, **PLAIN}


def queries() -> dict:
    return {name: f for name, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}


def entry(spark: SparkSession) -> DataFrame:
    """The flagship: a scan of the mixed corpus on the smallest tables, summed by severity and rule."""
    return severity_rollup(spark, "/root/testdata/sf0.001")
