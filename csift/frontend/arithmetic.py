"""Overflow (006) and signedness (033): rules over the expressions of a function's tree."""

from __future__ import annotations

from csift.frontend import flow
from csift.frontend.lexical import ALLOCATORS, MAX_NAMES, OPERATORS, at_the_end
from csift.frontend.syntax import Node, show

MIRRORED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
COMPARISONS = frozenset({*MIRRORED, "==", "!="})
#: A test counts for this many lines below it.
NEAR = 15


def value_of(x: Node | None) -> int | None:
    """An integer constant's value, negated or not."""
    from csift.frontend.extract import number

    if x is not None and x.kind == "unary" and x.text == "-":
        inner = value_of(x.parts[0])
        return None if inner is None else -inner
    return number(x.text) if x is not None and x.kind == "constant" else None


def is_largest(x: Node) -> bool:
    return x.kind == "name" and x.text in MAX_NAMES or at_the_end(value_of(x))


class Tests:
    """What a function's conditions and assertions relate to something, and in which lines."""

    def __init__(self, body: Node):
        self.found: list[tuple[int, set[str]]] = []
        for x in body.walk():
            if x.kind in ("if", "while", "do"):
                condition = x.parts[1 if x.kind == "do" else 0]
                mentioned = flow.names(condition)
                if any("MAX" in n or "MIN" in n for n in mentioned):
                    self.found.append((x.line, mentioned))
                else:
                    related = [y for y in condition.walk() if y.kind == "binary" and y.text in MIRRORED]
                    self.found.append((x.line, set().union(*map(flow.names, related))))
            elif x.kind == "call" and flow.callee(x) in flow.ASSERTIONS:
                self.found.append((x.line, set().union(*map(flow.names, x.parts[1:]))))

    def cover(self, line: int, names: set[str]) -> bool:
        return any(line - NEAR <= at < line and held & names for at, held in self.found)


def overflow(facts, body: Node) -> None:
    tests = Tests(body)
    headers = {id(y) for x in body.walk() if x.kind == "for" for part in x.parts[:-1] if part is not None for y in part.walk()}
    given = [(x.text, x.parts[0]) for x in body.walk() if x.kind == "declare" and x.parts[0] is not None]
    given += [(x.parts[0].text, x.parts[1]) for x in body.walk() if x.kind == "assign" and x.parts[0].kind == "name"]
    large = {name for name, value in given if any(is_largest(y) for y in value.walk())}
    for x in body.walk():
        if x.kind == "call" and flow.callee(x) in ALLOCATORS:
            sizes = (y for part in x.parts[1:] for y in part.walk() if y.kind == "binary" and y.text in ("*", "+") and y.parts[0].kind == "name")
            product = next(sizes, None)
            if product is not None and not tests.cover(x.line, flow.names(product)):
                facts.hit(6, x.line, "allocation", product.parts[0].text, product.text, show(product.parts[1]))
        if x.kind in ("binary", "assign") and x.text in OPERATORS and id(x) not in headers:
            touched = any(is_largest(y) or y.kind == "name" and y.text in large for y in x.parts)
            if touched and not tests.cover(x.line, flow.names(x)):
                facts.hit(6, x.line, "largest", show(x.parts[0]), x.text, show(x.parts[1]))


def held_above_zero(condition: Node | None) -> str | None:
    """The variable that a condition wants to be 0 or more."""
    if condition is None or condition.kind != "binary" or condition.text not in MIRRORED:
        return None
    left, right = condition.parts
    for one, op, other in ((left, condition.text, right), (right, MIRRORED[condition.text], left)):
        if one.kind == "name" and (op, value_of(other)) in ((">=", 0), (">", -1)):
            return one.text
    return None


def falls(step: Node | None, name: str) -> bool:
    """Whether a loop's step makes a variable less."""
    for x in step.walk() if step is not None else ():
        target = x.parts[0] if x.parts else None
        if target is not None and target.kind == "name" and target.text == name:
            if x.kind in ("unary", "postfix") and x.text == "--" or x.kind == "assign" and x.text == "-=":
                return True
            if x.kind == "assign" and x.text == "=" and any(y.kind == "binary" and y.text == "-" and y.parts[0].text == name for y in x.parts[1].walk()):
                return True
    return False


def signedness(facts, body: Node, types: dict[str, str]) -> None:
    from csift.frontend.extract import is_signed, is_unsigned

    typedefs = set(facts.typedefs)

    def unsigned(kind: str) -> bool | None:
        """None: neither is known."""
        if not kind or "*" in kind:
            return None
        return True if is_unsigned(kind, typedefs) else False if is_signed(kind) else None

    def side(x: Node) -> bool | None:
        return True if x.kind == "sizeof" else unsigned(types.get(x.text, "")) if x.kind == "name" else None

    for x in body.walk():
        if x.kind == "for":
            *starts, condition, step, _ = x.parts
            name = held_above_zero(condition)
            if name is None or not falls(step, name):
                continue
            declared = next((s for s in starts if s is not None and s.kind == "declare" and s.text == name), None)
            assigned = next((y for s in starts if s is not None for y in s.walk() if y.kind == "assign" and y.parts[0].text == name), None)
            start = declared.parts[0] if declared is not None else assigned.parts[1] if assigned is not None else None
            counter = unsigned(str(declared.extra["type"])) if declared is not None else unsigned(types.get(name, ""))
            if counter is True:
                facts.hit(33, x.line, "endless", name)
            elif counter is False and start is not None and start.kind == "name" and side(start) is True:
                facts.hit(33, x.line, "bound", name, start.text)
        elif x.kind == "binary" and x.text in COMPARISONS:
            for one, other in (x.parts, x.parts[::-1]):
                value = value_of(other)
                if value is not None and value < 0 and one.kind == "name" and side(one) is True:
                    facts.hit(33, x.line, "negative", one.text, show(other))
                if side(one) is False and side(other) is True:
                    facts.hit(33, x.line, "mixed", show(one), show(other))
