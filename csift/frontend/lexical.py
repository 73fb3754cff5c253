"""Rules that look at tokens: the line forms, which need no syntax and so hold for any text.

Tokens know literals and directives, and brackets know their partners; calls, arguments, statements and declarations
are found from these, however they are laid out over lines. A hit whose `context` isn't null counts only if one of
these words is a sensitive name; Spark decides that, with the classifiers of names.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

from csift.frontend.tokens import PATTERN, Token, tokens

#: Names that rules look for.
MAX_NAMES = frozenset(
    "INT_MAX UINT_MAX SHRT_MAX USHRT_MAX LONG_MAX ULONG_MAX LLONG_MAX ULLONG_MAX CHAR_MAX UCHAR_MAX SIZE_MAX INT32_MAX UINT32_MAX INT64_MAX UINT64_MAX".split()
)
ALLOCATORS = ("malloc", "calloc", "realloc", "aligned_alloc")
COMMANDS = ("system", "popen", "execlp", "execvp", "execvpe", "execlpe")
DRAWS, SEEDS = ("rand", "random", "drand48", "mrand48", "lrand48"), ("srand", "srandom")
CLOCKS = frozenset("time clock getpid getppid gettimeofday clock_gettime timespec_get".split())
CAST_WORDS = frozenset("unsigned signed int long short uint32_t time_t".split())
#: Functions that test a file and that use one, with the place of the path.
CHECKS = {"access": 0, "faccessat": 1, "stat": 0, "lstat": 0, "fstatat": 1}
USES = {"open": 0, "openat": 1, "fopen": 0, "freopen": 0, "chmod": 0, "fchmodat": 1, "chown": 0, "fchownat": 1, "remove": 0, "unlink": 0, "unlinkat": 1, "rmdir": 0, "truncate": 0}
WIPED = "key secret pass token auth hash iv pin cred session".split()
HARDWARE = "reg mmio hw io port shared vol".split()
CALLBACKS = ("_handler", "_fn", "_callback", "_hook", "func")
SECRETS = "password secret apikey api_key private_key auth_token".split()
SIZED = ("char", "int", "float", "double")

KEYWORDS = frozenset("return else if while for switch case do goto sizeof typedef break continue default".split())
RELATIONS = ("<", "<=", ">", ">=")
OPERATORS = frozenset("+ - * << += -= *= <<=".split())
CLOSING = {")": "(", "]": "[", "}": "{"}
Range = tuple[int, int]


def number_of(token: Token) -> int | None:
    """An integer constant's value."""
    digits = token.text.rstrip("uUlL")
    if token.kind != "number" or not digits:
        return None
    try:
        return int(digits, 8) if len(digits) > 1 and digits.isdigit() and digits[0] == "0" else int(digits, 0)
    except ValueError:
        return None


def at_the_end(value: int | None) -> bool:
    """Whether a number is the largest of an integer type of at least 32 bits."""
    return value is not None and value >= 2**31 - 1 and value & value + 1 == 0


def masked(line: str) -> str:
    """What literals hold made x, escapes a backslash and an x; the length stays."""
    out = []
    for match in PATTERN.finditer(line):
        text = match[0]
        if match.lastgroup in ("string", "char"):
            begin = min(text.find(q) for q in "\"'" if q in text) + 1
            closed = len(text) > begin and text[-1] == text[begin - 1]
            inner, k = text[begin : -1 if closed else None], 0
            held = []
            while k < len(inner):
                held.append("\\x" if inner[k] == "\\" and k + 1 < len(inner) else "x")
                k += len(held[-1])
            text = text[:begin] + "".join(held) + (text[-1] if closed else "")
        out.append(text)
    return "".join(out)


class Source:
    """Tokens of a text without comments; directives stand apart."""

    def __init__(self, clean: str):
        self.clean = clean
        self.tokens: list[Token] = []
        self.directives: list[list[Token]] = []
        self.begins = [0]
        self.begins += [k + 1 for k, c in enumerate(clean) if c == "\n"]
        line: list[Token] = []
        for token in [*tokens(clean), Token("line", "\n", 0, 0)]:
            if token.kind != "line":
                line.append(token)
                continue
            if line and line[0].text == "#":
                self.directives.append(line)
            else:
                self.tokens += line
            line = []
        self.partner = self._partners()
        self.bodies = self._bodies()
        self.by_name: dict[str, list[int]] = {}
        for k, t in enumerate(self.tokens):
            if t.kind == "word":
                self.by_name.setdefault(t.text, []).append(k)
        self.lines = [t.line for t in self.tokens]
        self.statements = self._statements()
        self._arrays: dict[str, list[tuple[int, Range]]] | None = None
        self._assigned: dict[str, list[int]] | None = None
        self._defined: dict[str, int] | None = None

    def _partners(self) -> dict[int, int]:
        """Places of brackets and of those that close them, both ways; what stays open has none."""
        out, opened = {}, []
        for k, t in enumerate(self.tokens):
            if t.kind != "punct":
                continue
            if t.text in "([{":
                opened.append(k)
            elif t.text in CLOSING:
                if t.text == "}":  # a brace ends what stayed open in it
                    while opened and self.tokens[opened[-1]].text != "{":
                        opened.pop()
                if opened and self.tokens[opened[-1]].text == CLOSING[t.text]:
                    begin = opened.pop()
                    out[begin], out[k] = k, begin
        return out

    def _bodies(self) -> list[Range]:
        """Function bodies: outer braces after a closing parenthesis."""
        out, k = [], 0
        while k < len(self.tokens):
            if self.tokens[k].text == "{" and self.tokens[k].kind == "punct":
                end = self.partner.get(k, len(self.tokens))
                if k and self.tokens[k - 1].text == ")":
                    out.append((k, end))
                    k = end
                elif k and self.tokens[k - 1].kind != "string":  # but an extern "C" block
                    k = end
            k += 1
        return out

    def text(self, k: int) -> str:
        return self.tokens[k].text if 0 <= k < len(self.tokens) else ""

    def kind(self, k: int) -> str:
        return self.tokens[k].kind if 0 <= k < len(self.tokens) else ""

    def shown(self, part: Range) -> str:
        """The source of some tokens, white space made one space."""
        first, last = self.tokens[part[0]], self.tokens[part[1] - 1]
        begin, end = (self.begins[t.line - 1] + t.column - 1 for t in (first, last))
        return " ".join(self.clean[begin : end + len(last.text)].split())

    def words(self, part: Range) -> list[str]:
        return [t.text for t in self.tokens[part[0] : part[1]] if t.kind == "word"]

    def on_lines(self, first: int, last: int) -> Range:
        return bisect_right(self.lines, first - 1), bisect_right(self.lines, last)

    def body_of(self, k: int) -> Range | None:
        """The function body around a place, or whose parameters it stands in."""
        at = bisect_right(self.bodies, (k, len(self.tokens) + 1)) - 1
        if at >= 0 and k < self.bodies[at][1]:
            return self.bodies[at]
        if at + 1 < len(self.bodies):
            brace = self.bodies[at + 1][0]
            opened = self.partner.get(brace - 1)
            if opened is not None and opened < k < brace:
                return self.bodies[at + 1]
        return None

    def _statements(self) -> list[int]:
        """For each place where its statement begins: behind the last ; or brace, but for those in brackets that are closed before it."""
        out, begin, opened = [], 0, []
        for k, t in enumerate(self.tokens):
            if t.kind == "punct" and t.text in ")]" and k in self.partner:
                while opened and opened[-1][0] >= self.partner[k]:
                    begin = opened.pop()[1]
            out.append(begin)
            if t.kind == "punct" and t.text in "([" and k in self.partner:
                opened.append((k, begin))
            elif t.kind == "punct" and t.text in ";{}":
                begin = k + 1
        return out

    def statement(self, k: int) -> int:
        """Where the statement begins that a place stands in."""
        return self.statements[k] if k < len(self.statements) else 0

    def arguments(self, name: int) -> list[Range]:
        """Of the call whose name stands at a place: ranges of tokens. An open call ends with its statement."""
        begin = name + 2
        end = self.partner.get(name + 1)
        if end is None:
            end = next((k for k in range(begin, len(self.tokens)) if self.text(k) in (";", "{", "}")), len(self.tokens))
        out, at, k = [], begin, begin
        while k < end:
            if self.text(k) == "," and self.kind(k) == "punct":
                out.append((at, k))
                at = k + 1
            k = self.partner[k] if self.text(k) in ("(", "[", "{") and k in self.partner else k
            k += 1
        return [*out, (at, end)] if end > begin else []

    def calls(self, names, once: bool = False) -> Iterator[tuple[int, str]]:
        """Places and names of calls, in order; once: a name counts once a line."""
        places = sorted(k for name in names for k in self.by_name.get(name, ()))
        seen = set()
        for k in places:
            if self.text(k + 1) == "(" and not self.declares(k) and not (once and (self.lines[k], self.text(k)) in seen):
                seen.add((self.lines[k], self.text(k)))
                yield k, self.text(k)

    def declares(self, k: int) -> bool:
        """Whether a name before a parenthesis is declared or defined there: only a type stands between it and its statement's begin."""
        first = k
        while first > 0 and (self.text(first - 1) == "*" or self.kind(first - 1) == "word" and self.text(first - 1) not in KEYWORDS):
            first -= 1
        return first <= self.statement(k) and any(t.kind == "word" for t in self.tokens[first:k])

    def is_literal(self, part: Range) -> bool:
        return part[0] < part[1] and all(t.kind == "string" for t in self.tokens[part[0] : part[1]])

    def bare(self, part: Range) -> Range:
        """Without casts to pointers before it, and parentheses around it."""
        a, b = part
        while a < b and self.text(a) == "(" and a in self.partner:
            close = self.partner[a]
            inner = self.tokens[a + 1 : close]
            if close == b - 1:
                a, b = a + 1, b - 1
            elif inner and inner[0].kind == "word" and all(t.kind == "word" or t.text == "*" for t in inner):
                a = close + 1
            else:
                break
        return a, b

    def texts(self, part: Range) -> list[str]:
        return [t.text for t in self.tokens[part[0] : part[1]]]

    def path_before(self, end: int) -> Range:
        """The name with members and indexes that ends at a place."""
        k = end
        while k > 0:
            if self.text(k - 1) == "]" and k - 1 in self.partner:
                k = self.partner[k - 1]
                continue
            if self.kind(k - 1) != "word":
                break
            k -= 1
            if self.text(k - 1) not in (".", "->"):
                break
            k -= 1
        return k, end

    def path_after(self, begin: int) -> Range:
        """The name with members that begins at a place."""
        k = begin
        if self.kind(k) == "word":
            k += 1
            while self.text(k) in (".", "->") and self.kind(k + 1) == "word":
                k += 2
        return begin, k

    # declarations
    @property
    def arrays(self) -> dict[str, list[tuple[int, Range]]]:
        """Places and dimensions of declared arrays, by name."""
        if self._arrays is None:
            self._arrays = {}
            for k, t in enumerate(self.tokens):
                if t.kind != "word" or self.text(k + 1) != "[" or k + 1 not in self.partner or not (self.kind(k - 1) == "word" or self.text(k - 1) in ("*", ",")):
                    continue
                # in a parameter list the declaration begins after its parenthesis or comma
                first = k
                while self.kind(first - 1) == "word" or self.text(first - 1) == "*":
                    first -= 1
                if self.text(first - 1) == ",":
                    first = min(first, self.statement(k)) if self.kind(first) != "word" or first == k else first
                if self.kind(first) == "word" and self.text(first) not in KEYWORDS and first < k and (self.kind(first + 1) == "word" or self.text(first + 1) == "*"):
                    self._arrays.setdefault(t.text, []).append((k, (k + 2, self.partner[k + 1])))
        return self._arrays

    def constant(self, part: Range) -> int | None:
        """A number, or the value of a #define or a const of that name."""
        if part[1] - part[0] != 1:
            return None
        token = self.tokens[part[0]]
        return self.named(token.text) if token.kind == "word" else number_of(token)

    def named(self, name: str) -> int | None:
        """The value of a #define or a const of that name."""
        if self._defined is None:
            self._defined = {}
            for d in self.directives:
                if len(d) > 3 and d[1].text == "define" and (value := number_of(d[3])) is not None:
                    self._defined.setdefault(d[2].text, value)
        if name in self._defined:
            return self._defined[name]
        for k in self.assigned.get(name, ()):
            if self.kind(k + 2) == "number" and "const" in self.texts((self.statement(k), k)):
                return number_of(self.tokens[k + 2])
        return None

    @property
    def assigned(self) -> dict[str, list[int]]:
        """Places of names that something is assigned to, members apart."""
        if self._assigned is None:
            self._assigned = {}
            for k, t in enumerate(self.tokens):
                if t.kind == "word" and self.text(k + 1) == "=" and self.text(k - 1) not in (".", "->"):
                    self._assigned.setdefault(t.text, []).append(k)
        return self._assigned

    def declared(self, name: str, k: int, body: Range | None) -> Range | None:
        """The dimension of the array of a name that is declared nearest above a place, in the same body (or in none)."""
        return next((part for at, part in reversed(self.arrays.get(name, ())) if at < k and self.body_of(at) == body), None)

    def alias(self, name: str, k: int) -> tuple[str, int] | None:
        """(array, offset) that a name is set to nearest above a place in its body: a, &a, &a[n], a + n or n + a."""
        body, places = self.body_of(k), self.assigned.get(name, [])
        for at in reversed(places[: bisect_right(places, k)]):
            if self.body_of(at) == body:
                end = next((e for e in range(at + 2, len(self.tokens)) if self.text(e) in (";", "{", "}")), len(self.tokens))
                a, b = self.bare((at + 2, end))
                if self.text(a) == "&":
                    a += 1
                value = self.tokens[a:b]
                shape = "".join({"word": "w", "number": "n"}.get(t.kind, t.text) for t in value)
                offset = {"w": 0, "w[n]": 2, "w+n": 2, "n+w": 0}.get(shape)
                if offset is not None:
                    array = value[2 if shape == "n+w" else 0].text
                    return (array, number_of(value[offset]) or 0 if shape != "w" else 0) if array != name else None
                return None
        return None

    def tested_before(self, line: int, names: set[str], near: int = 15) -> bool:
        """Whether an if, a while or an assertion in the lines before relates one of the names to something."""
        first, last = self.on_lines(line - near, line - 1)
        for k in range(first, last):
            if self.kind(k) != "word" or self.text(k) not in ("if", "while", "assert", "ASSERT") or self.text(k + 1) != "(":
                continue
            part = (k + 2, self.partner.get(k + 1, last))
            held = set(self.words(part))
            if self.text(k) in ("if", "while") and not any("MAX" in w or "MIN" in w for w in held):
                sides = (j + step for j in range(*part) if self.text(j) in RELATIONS for step in (-1, 1))
                held = {self.text(j) for j in sides if self.kind(j) == "word"}
            if held & names:
                return True
        return False


class Rules:
    """Each rule gives its hits of a source; `words` says what must stand somewhere in a text for a rule to look."""

    def __init__(self, clean: str, banned: dict[str, tuple[str, str]], reallocators: tuple[str, ...] = ()):
        self.clean, self.table, self.reallocators = clean, banned, ("realloc", *reallocators)
        self._source: Source | None = None

    @property
    def source(self) -> Source:
        if self._source is None:
            self._source = Source(self.clean)
        return self._source

    def hits(self, numbers) -> list[dict]:
        out = []
        for number in numbers:
            words, rule = RULES[number]
            wanted = self.table if number == 1 else self.reallocators if number == 32 else words
            if not wanted or any(w in self.clean for w in wanted):
                out += [{"rule": number, **h} for h in rule(self)]
        return out

    def hit(self, k: int, *parameters, context: list[str] | None = None) -> dict:
        token = self.source.tokens[k]
        return {"line": token.line, "column": token.column, "parameters": [str(p) for p in parameters], "context": context}

    @staticmethod
    def one_a_line(hits: Iterator[dict]) -> Iterator[dict]:
        seen = set()
        for h in hits:
            if h["line"] not in seen:
                seen.add(h["line"])
                yield h

    # 001
    def banned(self) -> Iterator[dict]:
        s = self.source
        for k, name in s.calls(self.table, once=True):
            given = s.arguments(k)
            form = s.tokens[slice(*given[0])] if given else []
            if name == "scanf" and not any(t.kind == "string" and "%s" in t.text for t in form):
                continue
            if name == "strcpy" and len(given) == 2 and s.is_literal(given[1]):
                length, (a, b) = literal_length(s.texts(given[1])), s.bare(given[0])
                room = self.room(s.text(a), k) if b - a == 1 and s.kind(a) == "word" else None
                if length is not None and room is not None and room > length + 1:
                    yield self.hit(k, "bounded", name, length, s.text(a), room)
                    continue
            yield self.hit(k, "call", name, *self.table[name])

    def room(self, name: str, k: int) -> int | None:
        """Elements of an array: of its function's, of the one it stands for, or of a global's."""
        s, body = self.source, self.source.body_of(k)
        other = s.alias(name, k)
        wanted = [(name, body), *([(other[0], body), (other[0], None)] if other and not other[1] else []), (name, None)]
        sizes = (s.constant(part) for n, where in wanted if (part := s.declared(n, k, where)) is not None)
        return next((n for n in sizes if n is not None), None)

    # 002
    def formats(self) -> Iterator[dict]:
        s = self.source
        for names, count in ((("printf", "vprintf"), 1), (("fprintf", "syslog", "dprintf"), 2)):
            for k, name in s.calls(names):
                given = s.arguments(k)
                if len(given) == count and s.kind(given[-1][0]) != "string":
                    yield self.hit(k, name, s.shown(given[-1]))

    # 005
    def compared(self) -> Iterator[dict]:
        s = self.source
        for k, name in s.calls(("memcmp", "strcmp", "strncmp", "bcmp")):
            if given := s.arguments(k):
                whole = (given[0][0], given[-1][1])
                yield self.hit(k, name, s.shown(whole), context=None if name == "bcmp" else s.words(whole))

    # 006
    def overflow(self) -> Iterator[dict]:
        s = self.source
        for k, _ in s.calls(ALLOCATORS):
            for a, b in s.arguments(k):
                if b - a > 2 and s.kind(a) in ("word", "number") and s.text(a + 1) in ("*", "+"):
                    if not s.tested_before(s.lines[k], {s.text(a), *s.words((a + 2, b))}):
                        yield self.hit(k, "allocation", s.text(a), s.text(a + 1), s.shown((a + 2, b)))
                    break
        headers = [(k + 1, s.partner[k + 1]) for k in s.by_name.get("for", ()) if k + 1 in s.partner]
        for k, t in enumerate(s.tokens):
            if t.text not in OPERATORS or t.kind != "punct" or not 0 < k < len(s.tokens) - 1:
                continue
            sides = s.tokens[k - 1], s.tokens[k + 1]
            simple = all(x.kind in ("word", "number") for x in sides) and sides[0].text not in KEYWORDS
            if simple and any(x.text in MAX_NAMES or at_the_end(number_of(x)) for x in sides) and not any(a < k < b for a, b in headers):
                if not s.tested_before(t.line, {x.text for x in sides if x.kind == "word"}):
                    yield self.hit(k - 1, "largest", sides[0].text, t.text, sides[1].text)

    # 007
    def constant_indexes(self) -> Iterator[dict]:
        s, seen = self.source, set()
        for k, t in enumerate(s.tokens):
            if t.text != "[" or not k or s.kind(k - 1) != "word" or s.partner.get(k) != k + 2 or s.text(k - 2) in (".", "->"):
                continue
            index, name, body = number_of(s.tokens[k + 1]), s.text(k - 1), s.body_of(k)
            if index is None or any(at == k - 1 for at, _ in s.arrays.get(name, ())):
                continue
            part, offset = s.declared(name, k, body), 0
            if part is None and (other := s.alias(name, k)) is not None:
                part, offset = s.declared(other[0], k, body), other[1]
            size = number_of(s.tokens[part[0]]) if part is not None and part[1] - part[0] == 1 else None
            if size is not None and index >= max(0, size - offset) and (t.line, name, index) not in seen:
                seen.add((t.line, name, index))
                yield self.hit(k - 1, "constant", index, name, max(0, size - offset))

    # 008
    def wiped(self) -> Iterator[dict]:
        s = self.source
        for k, _ in s.calls(("memset",)):
            given = s.arguments(k)
            if len(given) != 3 or s.texts(given[1]) != ["0"] or given[0][1] - given[0][0] != 1:
                continue
            name, line = s.text(given[0][0]), s.lines[k]
            after = range(*s.on_lines(line + 1, line + 3))
            ends = any(s.text(j) == "return" or s.text(j) == "}" and s.on_lines(s.lines[j], s.lines[j]) == (j, j + 1) for j in after)
            if ends and any(w in name.lower() for w in WIPED):
                yield self.hit(k, name, s.shown(given[2]))

    # 009, 011
    def casts(self) -> Iterator[tuple[int, list[str], str]]:
        """(place, type's words, name) of casts of names."""
        s = self.source
        for k, t in enumerate(s.tokens):
            close = s.partner.get(k) if t.text == "(" else None
            if close is not None and s.kind(k + 1) == "word" and s.kind(close + 1) == "word" and (s.kind(k - 1) != "word" or s.text(k - 1) in ("return", "else", "do", "case")):
                if all(s.kind(j) == "word" or s.text(j) == "*" for j in range(k + 2, close)):
                    yield k, [s.text(j) for j in range(k + 1, close)], s.text(close + 1)

    def hardware_casts(self) -> Iterator[dict]:
        for k, kind, name in self.casts():
            if kind[-1] == "*" and "volatile" not in kind and any(w in name.lower() for w in HARDWARE):
                yield self.hit(k, name)

    def function_casts(self) -> Iterator[dict]:
        for k, kind, name in self.casts():
            if kind in (["void", "*"], ["int"], ["long"], ["uint32_t"], ["unsigned", "int"]) and name.endswith(CALLBACKS):
                yield self.hit(k, name)

    # 012
    def conversions(self) -> Iterator[dict]:
        s = self.source
        for k, name in s.calls(("atoi", "atol", "atoll", "atof")):
            if given := s.arguments(k):
                yield self.hit(k, name, s.shown((given[0][0], given[-1][1])))

    # 014
    def magic_lengths(self) -> Iterator[dict]:
        s = self.source
        for k, t in enumerate(s.tokens):
            if t.kind == "word" and (t.text in SIZED or t.text.startswith("uint") and t.text.endswith("_t")) and s.kind(k + 1) == "word" and s.text(k + 2) == "[" and s.text(k + 4) == "]":
                digits = s.text(k + 3)
                if digits.isdigit() and 2 <= len(digits) <= 6 and digits[0] in "3456789":
                    yield self.hit(k, digits)

    # 015
    def signed_bits(self) -> Iterator[dict]:
        s, ends, last = self.source, [], {}
        for k, t in enumerate(s.tokens):
            if t.text == ";":
                ends.append(k)
            elif t.text in ("<<", ">>", "&=", "|=", "^=") and k and s.lines[k - 1] == t.line:
                last[t.line, s.text(k - 1)] = k - 1
        for k in s.by_name.get("int", ()):
            end = bisect_left(ends, k + 2)
            if s.kind(k + 1) == "word" and end < len(ends) and s.lines[ends[end]] == s.lines[k] and last.get((s.lines[k], s.text(k + 1)), -1) > ends[end]:
                yield self.hit(k)
        for k, t in enumerate(s.tokens):
            if t.text == "-" and s.kind(k + 1) == "number" and s.text(k + 2) in ("<<", ">>") and s.kind(k - 1) not in ("number",) and (s.kind(k - 1) != "word" or s.text(k - 1) in KEYWORDS) and s.text(k - 1) not in (")", "]"):
                yield self.hit(k)

    # 018
    def jumps(self) -> Iterator[dict]:
        s = self.source
        for k in s.by_name.get("goto", ()):
            if s.kind(k + 1) == "word" and s.text(k + 2) == ";":
                yield self.hit(k, s.text(k + 1))

    # 021
    def bare_pointers(self) -> Iterator[dict]:
        s, begin = self.source, 0
        for k, t in enumerate(s.tokens):
            if t.text in (";", "{", "}") and t.kind == "punct":
                part = s.tokens[begin:k]
                stars = [j for j, x in enumerate(part) if x.text == "*"]
                plain = stars and all(x.kind == "word" or x.text == "*" for x in part)
                if t.text == ";" and plain and stars[0] > 0 and stars[-1] == len(part) - 2 and part[0].text not in KEYWORDS and part[0].text != "extern":
                    yield self.hit(begin, part[-1].text)
                begin = k + 1

    # 024
    def secrets(self) -> Iterator[dict]:
        s = self.source
        for k, t in enumerate(s.tokens):
            if t.kind != "word" or t.text.lower() not in ("char", "string"):
                continue
            at = k + 1
            while s.text(at) == "*":
                at += 1
            after = s.partner[at + 1] + 1 if s.text(at + 1) == "[" and at + 1 in s.partner else at + 1
            value = s.text(after + 1)
            if s.kind(at) == "word" and any(w in s.text(at).lower() for w in SECRETS) and s.text(after) == "=" and s.kind(after + 1) == "string" and value[value.find('"') + 1 :].strip('"'):
                yield self.hit(k, s.text(at))

    # 026
    def grown(self) -> Iterator[dict]:
        s = self.source
        for k in s.by_name.get("snprintf", ()):
            if s.text(k - 1) == "+=" and s.kind(k - 2) == "word" and s.text(k + 1) == "(":
                yield self.hit(k - 2, s.text(k - 2))

    # 028
    def random_numbers(self) -> Iterator[dict]:
        """Of a line's equal calls with equal contexts only the first counts, so a line's words are gathered once."""
        s, told = self.source, set()
        for k, name in s.calls(DRAWS, once=True):
            if not s.arguments(k) and (s.lines[k], name) not in told:
                told.add((s.lines[k], name))
                near = s.on_lines(s.lines[k] - 3, s.lines[k])
                yield self.hit(k, name, context=[w for w in s.words(near) if w != name])
        for k, name in s.calls(SEEDS):
            given = s.arguments(k)
            seed = set(s.words((given[0][0], given[-1][1]))) if given else set()
            predictable = bool(seed & CLOCKS) or all(w == w.upper() for w in seed - CAST_WORDS)
            if (s.lines[k], name, predictable) not in told:
                told.add((s.lines[k], name, predictable))
                yield self.hit(k, name, context=None if predictable else s.words(s.on_lines(s.lines[k], s.lines[k])))

    # 030
    def commands(self) -> Iterator[dict]:
        s = self.source
        for k, name in s.calls(COMMANDS):
            if (given := s.arguments(k)) and not s.is_literal(given[0]):
                yield self.hit(k, name)

    # 031
    def weak_cryptography(self) -> Iterator[dict]:
        s = self.source
        for k, name in s.calls([w for w in s.by_name if weak(w) is not None], once=True):
            near = () if weak(name) else s.words(s.on_lines(s.lines[k] - 3, s.lines[k]))
            yield self.hit(k, name, context=None if weak(name) else [w for w in near if weak(w) is None])

    # 032
    def reallocated(self) -> Iterator[dict]:
        s = self.source
        for k, name in s.calls(self.reallocators):
            at = k
            if s.text(at - 1) == ")" and at - 1 in s.partner:
                at = s.partner[at - 1]
            given = s.arguments(k)
            if s.text(at - 1) != "=" or not given:
                continue
            target = s.path_before(at - 1)
            while s.text(target[0] - 1) == "*" and s.statement(target[0]) == target[0] - 1:
                target = target[0] - 1, target[1]
            if target[0] < target[1] and s.texts(s.bare(target)) == s.texts(s.bare(given[0])):
                yield self.hit(target[0], name, s.shown(target)) | {"line": s.lines[k]}

    # 033
    def signed_loops(self) -> Iterator[dict]:
        s = self.source
        for k in s.by_name.get("for", ()):
            end = s.partner.get(k + 1)
            if end is None:
                continue
            stops = [j for j in range(k + 2, end) if s.text(j) == ";"]
            if len(stops) != 2:
                continue
            begin, test, step = s.texts((k + 2, stops[0])), s.texts((stops[0] + 1, stops[1])), s.texts((stops[1] + 1, end))
            if "=" not in begin[1:-1] or len(test) != 3 or test[1:] != [">=", "0"]:
                continue
            given = begin.index("=")
            kind, name, start = begin[: given - 1], begin[given - 1], begin[given + 1 :]
            if test[0] != name or not ({"--", "-="} & set(step) or any(step[j : j + 2] == [name, "-"] for j in range(len(step)))):
                continue
            if unsigned_words(kind):
                yield self.hit(k, "endless", name)
            elif kind == ["int"] and len(start) == 1 and any(unsigned_words(s.texts((s.statement(j), j))[-2:]) or unsigned_words([s.text(j - 1)]) for j in s.by_name.get(start[0], ())):
                yield self.hit(k, "bound", name, start[0])

    # 035
    def file_races(self) -> Iterator[dict]:
        s = self.source
        for k, check in s.calls(CHECKS):
            given = s.arguments(k)
            if len(given) <= CHECKS[check]:
                continue
            path = s.bare(given[CHECKS[check]])
            wanted, variable = s.texts(path), next(iter(s.words(path)), None)
            depth, line = 0, s.lines[k]
            for j in range(k + 1, s.on_lines(line, line + 50)[1]):
                text, later = s.text(j), s.lines[j] > line
                depth += (text == "{") - (text == "}")
                if depth < 0 or later and (text == "else" or text == variable and s.text(j + 1) == "="):
                    break
                if text in USES and s.kind(j) == "word" and s.text(j + 1) == "(":
                    used = s.arguments(j)
                    if len(used) > USES[text] and s.texts(s.bare(used[USES[text]])) == wanted:
                        yield self.hit(j, check, line, s.shown(given[CHECKS[check]]), text)
                        break

    # 037
    def unended_copies(self) -> Iterator[dict]:
        s = self.source
        for k, name in s.calls(("strncpy",)):
            given = s.arguments(k)
            if not given:
                continue
            a, b = s.bare(given[0])
            a += s.text(a) == "&"
            base = s.texts(s.path_after(a))
            ended = False
            for j in range(*s.on_lines(s.lines[k], s.lines[k] + 5)):
                close = s.partner.get(j) if s.text(j) == "[" else None
                if close is not None and base and s.texts((j - len(base), j)) == base and s.text(close + 1) == "=" and s.text(close + 2) in ("'\\0'", "0"):
                    ended = True
            if not ended:
                yield self.hit(k, name)


def weak(name: str) -> bool | None:
    """True for weak cryptography, False for what is weak in a sensitive place, None for neither."""
    family = name.split("_")[0]
    if family in ("MD5", "DES", "RC4") or name == "EVP_md5" or family == "EVP" and "ecb" in name:
        return True
    return False if family == "SHA1" or name in ("EVP_sha1", "EVP_md5_sha1") else None


def unsigned_words(kind: list[str]) -> bool:
    """size_t, uintN_t, unsigned or unsigned int."""
    return kind in (["size_t"], ["unsigned"], ["unsigned", "int"]) or len(kind) == 1 and kind[0].startswith("uint") and kind[0].endswith("_t")


def spelled_length(body: str) -> int:
    """Characters that a literal's inner text stands for: a backslash begins one, whatever number of digits name it."""
    count, at = 0, 0
    while at < len(body):
        count += 1
        if body[at] != "\\":
            at += 1
            continue
        digits, most = (string.hexdigits, len(body)) if body[at + 1 : at + 2] == "x" else (string.octdigits, at + 4)
        at += 2
        if digits is string.hexdigits or body[at - 1 : at] in string.octdigits:
            while at < min(most, len(body)) and body[at] in digits:
                at += 1
    return count


def literal_length(parts: list[str]) -> int | None:
    """Bytes of adjacent string literals; null where they are wide or not in ASCII."""
    if not all(text.isascii() and text.startswith(('"', 'u8"')) for text in parts):
        return None
    return sum(spelled_length(text[text.find('"') + 1 : len(text) - text.endswith('"')]) for text in parts)


#: Rule: (words of which every hit's text has one, none if there are no such words; the rule).
RULES: dict[int, tuple[tuple[str, ...], Callable[[Rules], Iterator[dict]]]] = {
    1: ((), Rules.banned),
    2: (("printf", "syslog"), Rules.formats),
    5: (("cmp",), Rules.compared),
    6: ((), Rules.overflow),
    7: (("[",), Rules.constant_indexes),
    8: (("memset",), Rules.wiped),
    9: (("*",), lambda r: r.one_a_line(r.hardware_casts())),
    11: ((")",), lambda r: r.one_a_line(r.function_casts())),
    12: (("ato",), lambda r: r.one_a_line(r.conversions())),
    14: (("[",), lambda r: r.one_a_line(r.magic_lengths())),
    15: (("<<", ">>", "&=", "|=", "^="), lambda r: r.one_a_line(r.signed_bits())),
    18: (("goto",), lambda r: r.one_a_line(r.jumps())),
    21: (("*",), lambda r: r.one_a_line(r.bare_pointers())),
    24: ((), lambda r: r.one_a_line(r.secrets())),
    26: (("snprintf",), lambda r: r.one_a_line(r.grown())),
    28: (("rand",), Rules.random_numbers),
    30: (("system", "popen", "exec"), Rules.commands),
    31: (("MD5", "EVP_", "DES", "RC4", "SHA1"), Rules.weak_cryptography),
    32: ((), Rules.reallocated),
    33: (("for",), lambda r: r.one_a_line(r.signed_loops())),
    35: (("access", "stat"), Rules.file_races),
    37: (("strncpy",), Rules.unended_copies),
}
#: Rules whose line form counts only where no syntax facts are asked for.
ONLY_WITHOUT_FACTS = frozenset({21})
