"""The catalogue of rules, and the texts of findings.

A hit says which rule, where, and with which parameters; `MESSAGES` and `FIXES` turn it into text. Parameters are
`{0}`, `{1}` and so on; where a rule has several forms, the first parameter names the form.
"""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEVERITIES = ("High", "Medium", "Low", "Info")
PREFIX = "CSIFT"

MEMORY, STRINGS, ARITHMETIC, CRYPTO, CONTROL, STYLE = (
    "Memory safety", "Strings and formats", "Arithmetic", "Cryptography and secrets", "Control flow", "Style and standards",
)


@dataclass(frozen=True)
class Rule:
    number: int
    name: str
    impact: str
    category: str
    engine: str
    method: str
    complexity: str
    false_positives: str
    cwe_id: str
    description: str
    remediation: str
    vulnerable: str
    remediated: str

    @property
    def rule_id(self) -> str:
        return rule_id(self.number)


def rule_id(number: int, prefix: str = PREFIX) -> str:
    return f"{prefix}-{number:03d}"


def _r(number, name, impact, category, engine, forms, chance, cwe, description, remediation, bad, good):
    method = {"L": "pattern over lines", "A": "query over syntax facts", "LA": "pattern over lines and query over syntax facts", "F": "data flow over the control-flow graph"}[forms]
    complexity = {"L": "Low", "A": "Medium", "LA": "Medium", "F": "High"}[forms]
    return Rule(number, name, impact, category, engine, method, complexity, chance, cwe, description, remediation, bad, good)


RULES = (
    _r(1, "Banned functions", "High", STRINGS, "Regex", "L", "Low", "CWE-676 / CWE-120 / CWE-377", "Calls of library functions that cannot know the size of what they write, or whose file names can be raced.", "Use the bounded or descriptor-based counterpart.", "gets(line);", "fgets(line, sizeof line, stdin);"),
    _r(2, "Format string", "High", STRINGS, "Hybrid", "L", "Low", "CWE-134", "A printing function gets a variable as its format.", "Give a literal format and the variable as an argument.", "printf(name);", 'printf("%s", name);'),
    _r(3, "Unchecked allocation", "High", MEMORY, "Hybrid", "F", "Medium", "CWE-476 / CWE-252", "Memory is used on a path on which the allocation's result was not tested.", "Test the result before the first use.", "p = malloc(n); p[0] = 1;", "p = malloc(n); if (!p) return -1; p[0] = 1;"),
    _r(4, "Missing NULL check", "High", MEMORY, "AST", "F", "High", "CWE-476", "A pointer is dereferenced although it is NULL, or a parameter without a test.", "Test the pointer first.", "int f(int *p) { return *p; }", "int f(int *p) { return p ? *p : 0; }"),
    _r(5, "Comparison in variable time", "High", CRYPTO, "Hybrid", "LA", "Low", "CWE-208 / CWE-385", "Secrets are compared by a function that stops at the first difference.", "Compare in constant time.", "memcmp(mac, want, 32)", "CRYPTO_memcmp(mac, want, 32)"),
    _r(6, "Integer overflow", "High", ARITHMETIC, "Hybrid", "LA", "High", "CWE-190 / CWE-680", "Arithmetic on a size, or at the end of a type's range, without a test before it.", "Test the operands against the range.", "malloc(n * size)", "if (n > SIZE_MAX / size) return -1; malloc(n * size)"),
    _r(7, "Array index", "High", MEMORY, "Hybrid", "LA", "High", "CWE-129 / CWE-125", "An index is outside the array, or not tested on every path.", "Test both bounds first.", "a[i] = 0;", "if (i >= 0 && i < N) a[i] = 0;"),
    _r(8, "Wipe by memset", "High", CRYPTO, "Hybrid", "LA", "Medium", "CWE-14", "A secret is wiped by a memset that a compiler may remove.", "Use a wipe that is not removed.", "memset(key, 0, n); return;", "explicit_bzero(key, n); return;"),
    _r(9, "Stripped volatile", "High", CONTROL, "Hybrid", "LA", "Low", "CWE-562 / CWE-704", "A cast takes volatile away from what it points to.", "Keep volatile in the cast.", "(int *) status_reg", "(volatile int *) status_reg"),
    _r(10, "Variable-length array", "High", MEMORY, "Hybrid", "A", "Low", "CWE-400 / CWE-787", "An array on the stack has a length that is not constant.", "Allocate it, or fix its length.", "char b[n];", "char *b = malloc(n);"),
    _r(11, "Function pointer conversion", "High", CONTROL, "Hybrid", "LA", "Low", "CWE-843 / CWE-588", "A function's address is cast to data or to an integer.", "Keep function pointers in function pointer types.", "(void *) on_event", "handler_t h = on_event;"),
    _r(12, "Unsafe number conversion", "Medium", ARITHMETIC, "Regex", "L", "Low", "CWE-704 / CWE-190", "A conversion that cannot report errors.", "Use the strto family and test its end pointer.", "n = atoi(s);", "n = strtol(s, &end, 10);"),
    _r(13, "Control statement without braces", "Medium", CONTROL, "Hybrid", "L", "Low", "CWE-483 / MISRA C:2012 Rule 15.6", "The body of a control statement is not a block.", "Put the body in braces.", "if (x) y();", "if (x) { y(); }"),
    _r(14, "Magic number", "Medium", STYLE, "Hybrid", "L", "High", "CWE-1094", "An array's length is a bare number.", "Name the number.", "char b[512];", "char b[LINE_MAX];"),
    _r(15, "Bits of signed integers", "Medium", ARITHMETIC, "Hybrid", "L", "Low", "CWE-190 / CERT INT13-C", "A signed integer is shifted or masked.", "Use an unsigned type.", "int x = 1; x << 31;", "unsigned x = 1; x << 31;"),
    _r(16, "Single decision", "Medium", CONTROL, "AST", "A", "High", "CWE-1240", "A function that decides on access answers with one bit.", "Answer with values that one fault cannot swap.", "int auth() { return 1; }", "int auth() { return AUTH_GRANTED; }"),
    _r(17, "Switch without default", "Low", CONTROL, "Hybrid", "A", "Low", "CWE-478 / MISRA C:2012 Rule 16.4", "A switch has no default.", "Add one.", "switch (x) { case 1: break; }", "switch (x) { case 1: break; default: break; }"),
    _r(18, "Goto", "Low", CONTROL, "Regex", "L", "Low", "CWE-398 / MISRA C:2012 Rule 15.1", "A jump to a label.", "Use structured control flow.", "goto out;", "return clean_up();"),
    _r(19, "Empty parameter list", "Low", STYLE, "Hybrid", "A", "Low", "CWE-1188 / MISRA C:2012 Rule 8.2", "A definition with () takes any arguments.", "Write (void).", "int f() {}", "int f(void) {}"),
    _r(20, "Unused argument", "Low", STYLE, "AST", "A", "Low", "CWE-563 / MISRA C:2012 Rule 2.7", "A parameter that the body never names.", "Remove it, or mark it as unused.", "int f(int a) { return 0; }", "int f(int a) { (void) a; return 0; }"),
    _r(21, "Uninitialized pointer", "High", MEMORY, "AST", "F", "Medium", "CWE-457", "A pointer is used on a path on which nothing was assigned to it.", "Initialize it.", "char *p; *p = 1;", "char *p = NULL;"),
    _r(22, "Use after free", "High", MEMORY, "AST", "F", "High", "CWE-416", "Memory is used on a path on which it was freed.", "Do not use it, or set the pointer to NULL.", "free(p); p[0] = 1;", "free(p); p = NULL;"),
    _r(23, "Uninitialized read", "High", MEMORY, "AST", "F", "Medium", "CWE-457 / CWE-908", "A variable is read on a path on which nothing was assigned to it.", "Initialize it.", "int x; return x;", "int x = 0; return x;"),
    _r(24, "Secret in the source", "Medium", CRYPTO, "Regex", "L", "High", "CWE-312 / CWE-798", "A variable that names a secret is given a literal.", "Read it from a protected store.", 'char *password = "x";', "char *password = load_secret();"),
    _r(25, "No assertions", "Low", STYLE, "AST", "A", "Low", "CWE-617", "A long function without assertions.", "Assert what must hold.", "void f(void) { ... }", "void f(void) { assert(ready); ... }"),
    _r(26, "Sum of snprintf results", "High", STRINGS, "Regex", "L", "Low", "CWE-131", "An offset grows by what snprintf would have written.", "Test the result against the room that is left.", "n += snprintf(b + n, ...);", "if (r < 0 || r >= left) break; n += r;"),
    _r(27, "Double free", "High", MEMORY, "AST", "F", "High", "CWE-415", "Memory is freed on a path on which it was freed.", "Set the pointer to NULL after a free.", "free(p); free(p);", "free(p); p = NULL;"),
    _r(28, "Predictable random numbers", "High", CRYPTO, "Hybrid", "LA", "Low", "CWE-338", "Secrets come from a generator that can be predicted.", "Use the system's random source.", "token = rand();", "getrandom(&token, sizeof token, 0);"),
    _r(29, "Size of a pointer", "High", ARITHMETIC, "AST", "A", "Low", "CWE-467", "sizeof of a pointer where the pointed-to size is meant.", "Take the size of what it points to.", "memset(p, 0, sizeof(p));", "memset(p, 0, sizeof(*p));"),
    _r(30, "Command injection", "High", CONTROL, "Hybrid", "LA", "Low", "CWE-78", "A command that is not a literal is run.", "Run a fixed program with arguments.", "system(cmd);", 'execv("/bin/ls", argv);'),
    _r(31, "Weak cryptography", "High", CRYPTO, "Hybrid", "LA", "Low", "CWE-327", "A broken hash, cipher or mode.", "Use SHA-256, AES-GCM or ChaCha20-Poly1305.", "MD5(d, n, out);", "SHA256(d, n, out);"),
    _r(32, "Realloc over its own pointer", "High", MEMORY, "Hybrid", "LA", "Low", "CWE-401", "The only pointer is overwritten by a result that may be NULL.", "Keep the result in another pointer first.", "p = realloc(p, n);", "t = realloc(p, n); if (t) p = t;"),
    _r(33, "Signed and unsigned", "Medium", ARITHMETIC, "Hybrid", "LA", "Low", "CWE-195 / CERT INT02-C", "A comparison or a loop mixes signed and unsigned.", "Use one type on both sides.", "for (unsigned i = n; i >= 0; i--)", "for (unsigned i = n; i-- > 0;)"),
    _r(34, "Division by zero", "High", ARITHMETIC, "Hybrid", "F", "High", "CWE-369", "A divisor is zero, or not tested on every path.", "Test the divisor.", "a / n", "if (n != 0) a / n"),
    _r(35, "File check and use", "High", CONTROL, "Hybrid", "LA", "Low", "CWE-367", "A file is tested by its name and then used by its name.", "Open it, and test the descriptor.", "access(p, R_OK); fopen(p, m);", "fd = open(p, f); fstat(fd, &s);"),
    _r(36, "Memory leak", "High", MEMORY, "Hybrid", "F", "Medium", "CWE-401", "Memory is lost on a path to the function's end.", "Free it on every path.", "p = malloc(n); return;", "p = malloc(n); free(p); return;"),
    _r(37, "strncpy without an end", "High", STRINGS, "Regex", "L", "Medium", "CWE-170", "strncpy may leave the copy without its end.", "Write the end after the copy.", "strncpy(d, s, n);", "strncpy(d, s, n - 1); d[n - 1] = '\\0';"),
    _r(38, "Address of a local returned", "High", MEMORY, "AST", "A", "Low", "CWE-562", "A function returns the address of its own storage.", "Return allocated or given storage.", "char b[9]; return b;", "char *b = malloc(9); return b;"),
)
BY_NUMBER = {r.number: r for r in RULES}

#: Functions of rule 001 and what to use for them.
BANNED = {
    "gets": ("writes a line of any length", "fgets(buffer, sizeof(buffer), stdin)"),
    "strcpy": ("does not know the room at its destination", 'snprintf(dest, sizeof(dest), "%s", src)'),
    "strcat": ("does not know the room left at its destination", "strncat(dest, src, sizeof(dest) - strlen(dest) - 1)"),
    "sprintf": ("does not know the room at its destination", "snprintf(dest, sizeof(dest), fmt, ...)"),
    "vsprintf": ("does not know the room at its destination", "vsnprintf(dest, sizeof(dest), fmt, ap)"),
    "scanf": ("reads a word of any length by %s", 'scanf("%31s", dest)'),
    "mktemp": ("gives a file name that can be raced", "mkstemp(template)"),
    "tmpnam": ("gives a file name that can be raced", "mkstemp(template)"),
    "tempnam": ("gives a file name that can be raced", "mkstemp(template)"),
}
FORMS = {1, 4, 6, 7, 33, 34}

#: (rule, form): message. A form is the first parameter of rules in FORMS.
MESSAGES: dict[tuple[int, str], str] = {
    (1, "call"): "Call of '{1}', which {2}.",
    (1, "bounded"): "Call of '{1}': the literal has {2} bytes and '{3}' has room for {4}, so this copy fits, but a later edit may not.",
    (2, ""): "The format of {0}() is '{1}', not a literal.",
    (3, ""): "The result of the allocation of '{0}' is used without a test.",
    (4, "null"): "'{1}' is NULL where it is dereferenced.",
    (4, "parameter"): "Parameter '{1}' of '{2}' is dereferenced without a test.",
    (5, ""): "{0}({1}) compares sensitive values in variable time.",
    (6, "allocation"): "'{1} {2} {3}' in the size of an allocation may overflow.",
    (6, "largest"): "'{1} {2} {3}' may pass the end of the integer's range.",
    (7, "variable"): "Index '{1}' of '{2}' is not tested against its bounds on every path.",
    (7, "constant"): "Index {1} is outside '{2}', which has {3} elements.",
    (8, ""): "The wipe of '{0}' by memset may be removed by the compiler.",
    (9, ""): "A cast takes volatile away from '{0}'.",
    (10, ""): "'{0}' has the variable length '{1}'.",
    (11, ""): "'{0}' is a function (or a pointer to one) cast to data or an integer.",
    (12, ""): "{0}({1}) cannot report errors.",
    (13, ""): "The body of '{0}' has no braces.",
    (14, ""): "Array length {0} is a magic number.",
    (15, ""): "Bits of a signed integer are shifted or masked.",
    (16, ""): "'{0}' decides by a single 0 or 1.",
    (17, ""): "This switch has no default.",
    (18, ""): "Jump to '{0}'.",
    (19, ""): "'{0}' has an empty parameter list; write (void).",
    (20, ""): "Parameter '{0}' of '{1}' is not used.",
    (21, ""): "Pointer '{0}' may be used before anything is assigned to it.",
    (22, ""): "'{0}' is used after it was freed in line {1}.",
    (23, ""): "Variable '{0}' may be read before anything is assigned to it.",
    (24, ""): "'{0}' is given a literal secret.",
    (25, ""): "'{0}' has {1} lines and no assertion.",
    (26, ""): "'{0}' grows by the result of snprintf.",
    (27, ""): "'{0}' is freed again.",
    (28, ""): "{0}() is predictable, in a sensitive place.",
    (29, ""): "sizeof({0}) is the size of a pointer.",
    (30, ""): "{0}() runs a command that is not a literal.",
    (31, ""): "{0}() is weak cryptography.",
    (32, ""): "The result of {0}() overwrites '{1}', which leaks if it is NULL.",
    (33, "endless"): "Unsigned '{1}' is never below 0: this loop does not end.",
    (33, "bound"): "Signed counter '{1}' starts at the unsigned '{2}'.",
    (33, "negative"): "Unsigned '{1}' is compared with {2}.",
    (33, "mixed"): "Signed '{1}' is compared with unsigned '{2}'.",
    (34, "literal"): "Division by 0.",
    (34, "compound"): "Divisor '{1}' may be 0.",
    (34, "name"): "Divisor '{1}' may be 0 on a path to this division.",
    (35, ""): "{0}() in line {1} tests '{2}', which {3}() then uses by name.",
    (36, ""): "What '{0}' is given in line {1} is lost on a path.",
    (37, ""): "The copy by {0}() may have no end.",
    (38, ""): "'{1}' returns the address of its own '{0}'.",
}
SAFE, SUGGESTED, MANUAL = "safe_fix", "suggested_fix", "manual_review"
#: (rule, form): (kind of fix, replacement); others need a manual review.
FIXES: dict[tuple[int, str], tuple[str, str]] = {
    (1, "call"): (SUGGESTED, "{3}"),
    (1, "bounded"): (SUGGESTED, 'snprintf(dest, sizeof(dest), "%s", src)'),
    (2, "printf"): (SAFE, '{0}("%s", {1})'),
    (2, "vprintf"): (SAFE, '{0}("%s", {1})'),
    (3, ""): (SUGGESTED, "if ({0} == NULL) return -1;"),
    (4, "null"): (SUGGESTED, "if ({1} == NULL) return -1;"),
    (4, "parameter"): (SUGGESTED, "if ({1} == NULL) return -1;"),
    (5, ""): (SUGGESTED, "CRYPTO_memcmp({1})"),
    (6, "allocation"): (SUGGESTED, "if ({1} > SIZE_MAX / ({3})) return -1;"),
    (7, "variable"): (SUGGESTED, "if ({1} >= 0 && {1} < size)"),
    (7, "constant"): (SUGGESTED, "{2}[{3} - 1]"),
    (8, ""): (SAFE, "explicit_bzero({0}, {1});"),
    (10, ""): (SUGGESTED, "a constant length, or malloc({1})"),
    (12, ""): (SUGGESTED, "strtol({1}, &end, 10)"),
    (14, ""): (SUGGESTED, "#define BUFFER_SIZE {0}"),
    (17, ""): (SAFE, "default: break;"),
    (19, ""): (SAFE, "{0}(void)"),
    (20, ""): (SAFE, "(void) {0};"),
    (21, ""): (SAFE, "{0} = NULL;"),
    (23, ""): (SAFE, "{0} = 0;"),
    (26, ""): (SUGGESTED, "test the result before adding it"),
    (28, ""): (SUGGESTED, "getrandom()"),
    (30, ""): (SUGGESTED, "execv() with a fixed program"),
    (31, ""): (SUGGESTED, "SHA-256, AES-GCM or ChaCha20-Poly1305"),
    (32, ""): (SUGGESTED, "void *tmp = {0}({1}, ...);"),
    (33, "endless"): (SUGGESTED, "{1}-- > 0"),
    (33, "bound"): (SUGGESTED, "size_t {1}"),
    (33, "negative"): (SUGGESTED, "one type on both sides"),
    (33, "mixed"): (SUGGESTED, "one type on both sides"),
    (34, "name"): (SUGGESTED, "if ({1} != 0)"),
    (35, ""): (SUGGESTED, "open(), then fstat()"),
    (36, ""): (SUGGESTED, "free({0});"),
    (37, ""): (SUGGESTED, "dest[size - 1] = '\\0';"),
}


def _filled(template: str, parameters: Column) -> Column:
    """A template as a concatenation of its texts and parameters."""
    parts = [F.coalesce(F.get(parameters, F.lit(int(x))), F.lit("")) if k % 2 else F.lit(x) for k, x in enumerate(re.split(r"\{(\d)\}", template))]
    return F.concat(*parts)


def _chosen(table: dict, value, rule: Column, parameters: Column, numbers=None) -> Column:
    """value(entry) of the entry that a hit's rule and form name, else null; one branch a rule."""
    by_rule: dict[int, dict[str, Column]] = {}
    for (number, form), entry in table.items():
        if numbers is not None and number not in numbers:
            continue
        by_rule.setdefault(number, {})[form] = value(entry)
    out = None
    for number, forms in by_rule.items():
        inner = None
        if set(forms) == {""}:
            inner = forms[""]
        else:
            for form, column in forms.items():
                inner = F.when(F.get(parameters, F.lit(0)) == form, column) if inner is None else inner.when(F.get(parameters, F.lit(0)) == form, column)
        out = F.when(rule == number, inner) if out is None else out.when(rule == number, inner)
    return F.lit(None).cast("string") if out is None else out


def message_column(rule: Column, parameters: Column, numbers=None) -> Column:
    return _chosen(MESSAGES, lambda t: _filled(t, parameters), rule, parameters, numbers)


def fix_columns(rule: Column, parameters: Column, numbers=None) -> tuple[Column, Column, Column]:
    """fix_type, auto_fix_replacement, suggested_fix_replacement."""
    kind = F.coalesce(_chosen(FIXES, lambda x: F.lit(x[0]), rule, parameters, numbers), F.lit(MANUAL))
    text = _chosen(FIXES, lambda x: _filled(x[1], parameters), rule, parameters, numbers)
    return kind, F.when(kind == SAFE, text), F.when(kind == SUGGESTED, text)


def rules_table(spark: SparkSession, numbers=None, prefix: str = PREFIX, overrides: dict[str, str] | None = None) -> DataFrame:
    """The dimension of rules; overrides: rule_id -> severity."""
    rows = []
    for order, r in enumerate(RULES):
        if numbers is None or r.number in numbers:
            name = rule_id(r.number, prefix)
            rows.append({"rule": r.number, "ordinal": order, "rule_id": name, **{k: v for k, v in asdict(r).items() if k != "number"}, "impact": (overrides or {}).get(name, r.impact)})
    kinds = ["rule int", "ordinal int", "rule_id string", *(f"{k} string" for k in asdict(RULES[0]) if k != "number")]
    return spark.createDataFrame([tuple(x[k.split()[0]] for k in kinds) for x in rows], ", ".join(kinds))


def catalogue_order(impact: Column, name: Column) -> list[Column]:
    """High first, then Medium, then others; by id within."""
    return [F.when(impact == "High", 0).when(impact == "Medium", 1).otherwise(2), name]
