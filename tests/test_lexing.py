"""Column functions against small state machines, and classifiers against examples."""

import random

import pytest
from pyspark.sql import functions as F

from csift.frontend.lexical import literal_length
from csift.functions import classify, lexing


def stripped(text):
    """Comments to blanks, one character at a time."""
    out, state, k = [], "", 0
    while k < len(text):
        c, two = text[k], text[k : k + 2]
        if state == "//":
            state = "" if c == "\n" else state
            out.append(c if c == "\n" else " ")
        elif state == "/*":
            if two == "*/":
                out.append("  ")
                state, k = "", k + 1
            else:
                out.append(c if c == "\n" else " ")
        elif state:
            out.append(two if c == "\\" else c)
            k += c == "\\" and len(two) == 2
            state = "" if c == state else state
        elif two in ("//", "/*"):
            out.append("  ")
            state, k = two, k + 1
        else:
            out.append(c)
            state = c if c in "\"'" else ""
        k += 1
    return "".join(out)


def masked(line):
    out, state, k = [], "", 0
    while k < len(line):
        c = line[k]
        if not state:
            out.append(c)
            state = c if c in "\"'" else ""
        elif c == "\\" and k + 1 < len(line):
            out.append("\\x")
            k += 1
        elif c == state:
            out.append(c)
            state = ""
        else:
            out.append("x" if c != "\\" else "\\" if k + 1 == len(line) and False else "x")
        k += 1
    return "".join(out)


def texts(seed, alphabet, n=300):
    chance = random.Random(seed)
    return ["".join(chance.choice(alphabet) for _ in range(chance.randint(0, 40))) for _ in range(n)]


def apply(spark, values, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", column(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(rows)]


def test_strip_comments(spark):
    values = texts(1, "ab /*\n\"'\\") + ["/* open\n", "'", '"\\', "a//b\nc", "/*" + "x\n" * 5000 + "*/y"]
    found = apply(spark, values, lexing.strip_comments)
    assert found == [stripped(v) for v in values]
    assert all(len(a) == len(b) and a.count("\n") == b.count("\n") for a, b in zip(values, found))


def test_mask_literals(spark):
    values = [v for v in texts(2, "ab \"'x\\") if not v.endswith("\\")]
    assert apply(spark, values, lexing.mask_literals) == [masked(v) for v in values]


def test_split_lines(spark):
    values = ["", "a", "a\n", "a\n\nb", "\r\n", "a\rb\x0bc\x0cd\x85e f", "\n\n"]
    assert apply(spark, values, lexing.split_lines) == [v.splitlines() for v in values]


def test_comments_and_directives(spark):
    text = 'int a; // csift-ignore\n/* two\n lines csift-disable-next-line: csift-001, CSIFT-003 */ x\n"// csift-ignore"\n// CSIFT-IGNORE legacy code\n// csift-disable-line CSIFT-019\n'
    (found,) = apply(spark, [text], lexing.comments)
    assert [(c["line"], c["text"][:6]) for c in found] == [(1, "// csi"), (2, "/* two"), (5, "// CSI"), (6, "// csi")]
    (found,) = apply(spark, [text], lexing.suppressions)
    assert [tuple(d) for d in found] == [(1, "*"), (3, "CSIFT-001"), (3, "CSIFT-003"), (5, "LEGACY CODE"), (6, "CSIFT-019")]


def test_fingerprint_ignores_space_and_slashes(spark):
    make = lambda path, snippet: spark.range(1).select(lexing.fingerprint(F.lit("R"), F.lit(path), F.lit(snippet))).first()[0]
    assert make("a\\b.c", "  x  =\t1; ") == make("a/b.c", "x = 1;") != make("a/b.c", "x = 2;")
    assert len(make("a", "b")) == 16


def test_terminal_and_markdown(spark):
    assert apply(spark, ["\x1b[31mred\x1b[0m\r\nx\x07"], lexing.terminal_text) == ["red x"]
    assert apply(spark, ["a|b\n`c`"], lexing.markdown_cell) == ["a\\|b 'c'"]


def test_brace_change(spark):
    rows = spark.createDataFrame([("{",), ("x",), ("{ }",), ("}}{",), ("",)], "x string").select(lexing.brace_change(F.col("x")).alias("d")).collect()
    assert sorted(r["d"] for r in rows) == [-1, 0, 0, 0, 1]


def test_inside_literal(spark):
    line = 'a "b c" d'
    rows = spark.range(1, len(line) + 1).select(F.col("id"), lexing.inside_literal(F.lit(line), F.col("id").cast("int")).alias("y")).collect()
    found = "".join("1" if r["y"] else "0" for r in sorted(rows))
    assert found[3:6] == "111" and found[0] == "0" and found[-1] == "0"


@pytest.mark.parametrize(
    "classifier, yes, no",
    [
        (classify.sensitive_name, ["token", "my_iv", "apiKey", "session_hash", "privkey"], ["keyboard", "keys", "count", "key_len", "drive", "design_token", "spinner"]),
        (classify.sensitive_type, ["crypto_t", "hash_ctx", "key_t"], ["int", "key_count_t", "uint8_t *"]),
        (classify.security_function, ["login", "check_hash", "get_mac", "make_iv"], ["main", "check_header_len", "verify_length_sig"]),
        (classify.predictable_seed, ["time(NULL)", "42", "0x1fU", "", "SEED", "(unsigned) 7"], ["seed", "read_noise()"]),
    ],
)
def test_classifiers(spark, classifier, yes, no):
    assert apply(spark, yes, classifier) == [True] * len(yes)
    assert apply(spark, no, classifier) == [False] * len(no)


def test_literal_length():
    given = [['"abc"'], ['"a"', '"b\\n"'], ['"\\x41\\101"'], ['"\\1011"'], ['"\\x4142g"'], ['u8"\\\\"'], ['"\\8"'], ['"'], ['L"a"'], ['"é"'], ['""']]
    assert [literal_length(x) for x in given] == [3, 3, 2, 2, 2, 1, 1, 0, None, None, 0]


def test_directives(spark):
    given = ["// csift-ignore", "/* CSIFT-IGNORE-next-line: a-1 , b */", "// csift-disable-line x y", "// csift-disable-next-line-line:c", "// csift-ignored: x", "// csift-ignore a: b", "// csift-ignore : z", "// x-csift-ignore:\tq csift-ignore: r", "// csift-ignore-nothing", "// csift-ignore,a", "no csift-ignore"]
    found = [[(x["line"], x["rule_id"]) for x in r] for r in apply(spark, given, lexing.suppressions)]
    assert found == [[(1, "*")], [(2, "A-1"), (2, "B")], [(1, "X Y")], [(2, "C")], [(1, "*")], [(1, "A")], [(1, "Z")], [(1, "Q CSIFT-IGNORE")], [(1, "*")], [(1, "*")], []]


def test_paths_and_lvalues(spark):
    assert apply(spark, ["(const char *) p", "( p )", "a -> b"], classify.bare_path) == ["p", "p", "a->b"]
    given = ["(char *) x", "((x))", "a . b", "(x)", "(struct s *) (p)->q", "(x)->y", "(unsigned) x", "f(x)", "(char **) *x", "((char *) x)", "(a)(b)", "", None]
    assert apply(spark, given, classify.bare_lvalue) == ["x", "x", "a.b", "x", "(p)->q", "(x)->y", "x", "f(x)", "*x", "x", "b", "", None]
