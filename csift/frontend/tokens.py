"""Tokens of C text without comments, and a preprocessor that works on them.

A token keeps the line and column it stands at; tokens from a macro keep those of its use, so no line numbers need mending.
"""

from __future__ import annotations

import re
from typing import NamedTuple

PATTERN = re.compile(
    r"(?P<space>[ \t\f\v\r]+|\\\r?\n)|(?P<line>\n)"
    r"|(?P<string>(?:u8|[uUL])?\"(?:[^\"\\\n]|\\.)*\"?)|(?P<char>(?:u8|[uUL])?'(?:[^'\\\n]|\\.)*'?)"
    r"|(?P<number>\.?\d(?:[eEpP][+-]|[\w.])*)|(?P<word>[A-Za-z_$][\w$]*)"
    r"|(?P<punct>\.\.\.|<<=|>>=|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^]=|##|[-+*/%&|^~!<>=?:;,.(){}\[\]#])|(?P<other>.)",
    re.S,
)


class Token(NamedTuple):
    kind: str
    text: str
    line: int
    column: int


class Unreadable(Exception):
    """The text isn't C that this front end understands."""


def tokens(text: str, line: int = 1) -> list[Token]:
    """All tokens but white space; each line's end is a token of kind `line`."""
    out, begin = [], 0
    for match in PATTERN.finditer(text):
        kind = match.lastgroup
        if kind == "line":
            out.append(Token(kind, "\n", line, match.start() - begin + 1))
            line, begin = line + 1, match.end()
        elif kind != "space":
            out.append(Token(kind, match[0], line, match.start() - begin + 1))
            if "\n" in match[0]:
                line += match[0].count("\n")
        elif "\n" in match[0]:
            line, begin = line + 1, match.end()
    return out


class TooLong(Unreadable):
    """A macro's expansion passes the limit; the reason is reported with the file."""


#: Tokens that macros may make of a stretch of text between directives; beyond, the file is read without macros.
MOST_TOKENS = 200_000


class Macro(NamedTuple):
    parameters: tuple[str, ...] | None
    variadic: bool
    body: tuple[Token, ...]


class Preprocessor:
    """Conditionals, object-like and function-like macros; includes are left out."""

    def __init__(self, most_tokens: int = MOST_TOKENS):
        self.most_tokens = most_tokens
        self.macros: dict[str, Macro] = {}

    def run(self, text: str) -> list[Token]:
        out: list[Token] = []
        pending: list[Token] = []
        # each open conditional: [is active, has been active, surroundings are active]
        open_: list[list[bool]] = []
        line: list[Token] = []
        for token in [*tokens(text), Token("line", "\n", 0, 0)]:
            if token.kind != "line":
                line.append(token)
                continue
            if line and line[0].text == "#":
                if not self._conditional(line[1:], open_) and all(x[0] for x in open_):
                    out += self.expand(pending)
                    pending = []
                    self._directive(line[1:])
            elif all(x[0] for x in open_):
                pending += line
            line = []
        return out + self.expand(pending)

    def _conditional(self, line: list[Token], open_: list[list[bool]]) -> bool:
        word = line[0].text if line else ""
        around = all(x[0] for x in open_)
        if word in ("if", "ifdef", "ifndef"):
            holds = around and (self.value(line[1:]) != 0 if word == "if" else bool(line[1:]) and (line[1].text in self.macros) == (word == "ifdef"))
            open_.append([holds, holds, around])
        elif word in ("elif", "else") and open_:
            last = open_[-1]
            holds = last[2] and not last[1] and (word == "else" or self.value(line[1:]) != 0)
            last[0], last[1] = holds, last[1] or holds
        elif word == "endif" and open_:
            open_.pop()
        else:
            return False
        return True

    def _directive(self, line: list[Token]) -> None:
        if len(line) < 2:
            return
        word, name = line[0].text, line[1]
        if word == "undef":
            self.macros.pop(name.text, None)
        elif word == "define" and name.kind == "word":
            body = line[2:]
            parameters, variadic = None, False
            if body and body[0].text == "(" and body[0].column == name.column + len(name.text):
                close = next((i for i, t in enumerate(body) if t.text == ")"), None)
                if close is None:
                    raise Unreadable("macro without end of parameters")
                names = [t.text for t in body[1:close] if t.text != ","]
                variadic = bool(names) and names[-1] == "..."
                parameters, body = tuple(names[:-1] if variadic else names), body[close + 1 :]
            self.macros[name.text] = Macro(parameters, variadic, tuple(body))

    def expand(self, line: list[Token], hidden: frozenset[str] = frozenset(), budget: list[int] | None = None) -> list[Token]:
        budget = budget if budget is not None else [self.most_tokens]
        out, at = [], 0
        while at < len(line):
            token = line[at]
            at += 1
            macro = self.macros.get(token.text) if token.kind == "word" and token.text not in hidden else None
            if macro is None or (macro.parameters is not None and (at >= len(line) or line[at].text != "(")):
                out.append(token)
                continue
            if macro.parameters is None:
                body = list(macro.body)
            else:
                arguments, at = _arguments(line, at)
                body = self._filled(macro, arguments, hidden, budget)
            budget[0] -= len(body) + 1
            if budget[0] < 0:
                raise TooLong(f"line {token.line}: macros, {token.text} the last, make more than {self.most_tokens} tokens")
            body = [Token(t.kind, t.text, token.line, token.column) for t in _pasted(body)]
            out += self.expand(body, hidden | {token.text}, budget)
        return out

    def _filled(self, macro: Macro, arguments: list[list[Token]], hidden: frozenset[str], budget: list[int]) -> list[Token]:
        given = dict(zip(macro.parameters, arguments))
        if macro.variadic:
            rest: list[Token] = []
            for k, argument in enumerate(arguments[len(macro.parameters) :]):
                rest += ([Token("punct", ",", 0, 0)] if k else []) + argument
            given["__VA_ARGS__"] = rest
        body, out = macro.body, []
        for k, token in enumerate(body):
            if token.text == "#" and k + 1 < len(body) and body[k + 1].text in given:
                continue
            before = body[k - 1].text if k else ""
            after = body[k + 1].text if k + 1 < len(body) else ""
            if token.text in given and before == "#":
                text = " ".join(t.text for t in given[token.text]).replace("\\", "\\\\").replace('"', '\\"')
                out.append(Token("string", f'"{text}"', 0, 0))
            elif token.text in given:
                out += given[token.text] if "##" in (before, after) else self.expand(given[token.text], hidden, budget)
            else:
                out.append(token)
        return out

    def value(self, line: list[Token]) -> int:
        """Of a condition; what can't be evaluated counts as 0."""
        plain, at = [], 0
        while at < len(line):
            if line[at].text == "defined":
                name = line[at + 2] if at + 2 < len(line) and line[at + 1].text == "(" else line[at + 1] if at + 1 < len(line) else None
                plain.append(Token("number", str(int(name is not None and name.text in self.macros)), 0, 0))
                at += 4 if at + 1 < len(line) and line[at + 1].text == "(" else 2
            else:
                plain.append(line[at])
                at += 1
        try:
            return Condition(self.expand(plain)).value()
        except (ValueError, ZeroDivisionError, RecursionError):
            return 0


#: Strength of binary operators in a condition.
STRENGTH = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}
WIDTH = 64


def _quotient(a: int, b: int) -> int:
    return abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)


OPERATIONS = {
    "||": lambda a, b: int(bool(a or b)), "&&": lambda a, b: int(bool(a and b)), "|": lambda a, b: a | b, "^": lambda a, b: a ^ b, "&": lambda a, b: a & b,
    "==": lambda a, b: int(a == b), "!=": lambda a, b: int(a != b), "<": lambda a, b: int(a < b), ">": lambda a, b: int(a > b), "<=": lambda a, b: int(a <= b), ">=": lambda a, b: int(a >= b),
    "<<": lambda a, b: a << b if 0 <= b < WIDTH else 0, ">>": lambda a, b: a >> b if 0 <= b < WIDTH else 0, "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b,
    "/": _quotient, "%": lambda a, b: a - _quotient(a, b) * b,
}


class Condition:
    """The value of a constant expression; names count as 0."""

    def __init__(self, line: list[Token]):
        self.line, self.at = line, 0

    def value(self) -> int:
        out = self._choice()
        if self.at < len(self.line):
            raise ValueError(self._text())
        return out

    def _text(self) -> str:
        return self.line[self.at].text if self.at < len(self.line) else ""

    def _choice(self) -> int:
        test = self._binary(1)
        if self._text() != "?":
            return test
        self.at += 1
        yes = self._choice()
        if self._text() != ":":
            raise ValueError(self._text())
        self.at += 1
        no = self._choice()
        return yes if test else no

    def _binary(self, least: int) -> int:
        left = self._unary()
        while STRENGTH.get(self._text(), 0) >= least:
            op = self._text()
            self.at += 1
            right = self._binary(STRENGTH[op] + 1)
            left = OPERATIONS[op](left, right)
        return left

    def _unary(self) -> int:
        if self.at >= len(self.line):
            raise ValueError("a value is missing")
        token = self.line[self.at]
        self.at += 1
        if token.text == "(":
            out = self._choice()
            if self._text() != ")":
                raise ValueError(self._text())
            self.at += 1
            return out
        if token.text in ("!", "~", "-", "+"):
            value = self._unary()
            return {"!": int(not value), "~": ~value, "-": -value, "+": value}[token.text]
        if token.kind == "word":
            return 0
        if token.kind != "number":
            raise ValueError(token.text)
        digits = token.text.rstrip("uUlL")
        return int(digits, 8) if re.fullmatch(r"0[0-7]+", digits) else int(digits, 0)


def _arguments(line: list[Token], at: int) -> tuple[list[list[Token]], int]:
    """The arguments of a call whose `(` is at `at`, and the place after its `)`."""
    arguments: list[list[Token]] = [[]]
    depth, at = 1, at + 1
    while at < len(line):
        token = line[at]
        at += 1
        depth += token.text in ("(", "[", "{")
        depth -= token.text in (")", "]", "}")
        if depth == 0:
            return arguments, at
        if depth == 1 and token.text == ",":
            arguments.append([])
        else:
            arguments[-1].append(token)
    raise Unreadable("call of a macro without end")


def _pasted(body: list[Token]) -> list[Token]:
    out: list[Token] = []
    joins = False
    for token in body:
        if token.text == "##":
            joins = True
        elif joins and out:
            text = out[-1].text + token.text
            found = [t for t in tokens(text) if t.kind != "line"]
            out[-1:] = found[:1] if len(found) == 1 else [out[-1], token]
            joins = False
        else:
            out.append(token)
    return out
