"""Functions, variables and calls by patterns and braces, for text that doesn't parse."""

from __future__ import annotations

import re
import string

HEADER = re.compile(r"^[ \t]*((?:[A-Za-z_]\w*[\s*]+)+?)\**\s*([A-Za-z_]\w*)\s*\(([^;{}()]*(?:\([^()]*\)[^;{}()]*)*)\)\s*\{", re.M)
WORDS_BEFORE = frozenset("if else while for switch do return case default sizeof typedef goto".split())
DECLARATION = re.compile(
    r"^\s*(?!(?:return|goto|else|case|typedef|if|while|for|switch|do|break|continue)\b)((?:(?:static|const|volatile|register|unsigned|signed|struct|union|enum|extern)\s+)*[A-Za-z_]\w*(?:\s+(?:int|long|char|short|double))*)"
    r"(\s*\*+\s*|\s+)([A-Za-z_]\w*)\s*(\[\s*([^\]]*)\s*\])?\s*(=(?!=)|;|,)"
)
CALL = re.compile(r"\b([A-Za-z_]\w*)\s*\(")
ASSIGNED = re.compile(r"(?<![=!<>+\-*/%&|^.\w>])([A-Za-z_]\w*)\s*(?:\[[^\]]*\]\s*)?(?:[+\-*/%&|^]|<<|>>)?=(?!=)")


def balanced(text: str, at: int) -> str | None:
    """What stands between the parenthesis at `at` and its partner; strings don't count."""
    depth, quote, k = 0, "", at
    while k < len(text):
        c = text[k]
        if quote:
            if c == "\\":
                k += 1
            elif c == quote:
                quote = ""
        elif c in "\"'":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if depth == 0:
                return text[at + 1 : k]
        k += 1
    return None


def split_arguments(text: str) -> list[str]:
    """Top-level arguments, trimmed; none for blank text."""
    out, depth, quote, begin, k = [], 0, "", 0, 0
    while k < len(text):
        c = text[k]
        if quote:
            if c == "\\":
                k += 1
            elif c == quote:
                quote = ""
        elif c in "\"'":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "," and depth == 0:
            out.append(text[begin:k].strip())
            begin = k + 1
        k += 1
    out.append(text[begin:].strip())
    return [] if out == [""] else out


NAME_CHARACTERS = string.ascii_letters + string.digits + "_"


def closing(text: str, at: int) -> int:
    """The place of the brace that closes the one at `at`, or the text's end."""
    depth, quote, k = 0, "", at
    while k < len(text):
        c = text[k]
        if quote:
            if c == "\\":
                k += 1
            elif c == quote or c == "\n":
                quote = ""
        elif c in "\"'":
            quote = c
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return k
        k += 1
    return len(text)


def functions(clean: str) -> list[dict]:
    """name, return_type, parameters (type, name), and where the header, the brace and the end stand."""
    out, after = [], 0
    for match in HEADER.finditer(clean):
        if match.start() < after or match[2] in WORDS_BEFORE or set(match[1].split()) & WORDS_BEFORE:
            continue
        end = closing(clean, match.end() - 1)
        begin = match.start() + len(match[0]) - len(match[0].lstrip())
        parameters = []
        for text in split_arguments(match[3]):
            head = text.partition("[")[0].rstrip()  # what a dimension stands behind
            name = head[len(head.rstrip(NAME_CHARACTERS)) :]
            kind = head.removesuffix(name).strip()
            if text not in ("void", "...") and name and not name[0].isdigit():
                parameters.append((kind, name) if kind else (name, ""))
        out.append({"name": match[2], "return_type": " ".join(match[1].split()), "parameters": parameters, "listed": match[3].strip(), "begin": begin, "brace": match.end() - 1, "end": end})
        after = end
    return out


def variables(text: str, first_line: int) -> list[dict]:
    """One declarator a line."""
    out = []
    for k, line in enumerate(text.split("\n")):
        for part in re.split(r"(?<=[;{}])", line):
            match = DECLARATION.match(part)
            if match and match[1].split()[-1] not in WORDS_BEFORE:
                out.append({"type": " ".join(match[1].split()), "stars": match[2].count("*"), "name": match[3], "array": match[4] is not None, "dimension": match[5], "initial": match[6] == "=", "line": first_line + k})
    return out
