"""A small reader of HTML as it is found: elements with implied ends, raw-text elements, blocks of text.

Reading takes time in proportion to the text, however broken it is: where a tag's end isn't found that is remembered
for each quote on the way, and open elements are found by name.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_left, bisect_right

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main menu nav ol option optgroup p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements of running text; the others are containers.
FLOW = frozenset(
    "p h1 h2 h3 h4 h5 h6 b i em strong a span br u s small sub sup code pre blockquote li ul ol dl dt dd table tbody thead tr td th figure figcaption q cite mark time abbr hr img wbr".split()
)
#: An opening tag ends these if they are the innermost open ones of their kind, up to the barrier.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th")}
BARRIER = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "tbody": ("table",)}
ENDS_P = BLOCK - {"br", "button", "option", "optgroup", "caption", "legend", "summary", "td", "th", "tr", "tbody", "thead", "tfoot"}
P_BARRIER = ("table", "td", "th", "li", "button", "article", "section", "div", "blockquote")

LETTER = re.compile("/?[a-zA-Z]")
MARK = re.compile("[\"'>]")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")


class Element:
    """children are elements and strings. `hashed` sets the rest: see there."""

    __slots__ = ("name", "attributes", "children", "digest", "slot", "chars")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name, self.attributes, self.children, self.digest, self.slot, self.chars = name, attributes, [], 0, 0, 0

    @property
    def elements(self) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element)]


class _Ends:
    """Where tags end: at the first > outside quotes."""

    def __init__(self, text: str):
        self.text, self.marks, self.open = text, [m.start() for m in MARK.finditer(text)], set()

    def after(self, at: int) -> int:
        """The place behind the tag, or -1. `open` has the quotes from which no end is found."""
        way, k = [], bisect_left(self.marks, at)
        while k < len(self.marks) and (place := self.marks[k]) not in self.open:
            if self.text[place] == ">":
                return place + 1
            way.append(place)
            close = self.text.find(self.text[place], place + 1)
            if close < 0:
                break
            k = bisect_right(self.marks, close)
        self.open.update(way)
        return -1


class _Stack:
    """Open elements, and the depths of each name."""

    def __init__(self, root: Element):
        self.elements, self.depths = [root], {}

    def push(self, element: Element) -> None:
        self.depths.setdefault(element.name, []).append(len(self.elements))
        self.elements.append(element)

    def innermost(self, names: tuple[str, ...]) -> int:
        deepest = 0
        for name in names:
            if (held := self.depths.get(name)) and held[-1] > deepest:
                deepest = held[-1]
        return deepest

    def end(self, names: tuple[str, ...], barrier: tuple[str, ...] = ()) -> None:
        """Ends the innermost element of one of the names, unless a barrier stands further in."""
        depth = self.innermost(names)
        if depth and depth > self.innermost(barrier):
            for element in self.elements[depth:]:
                self.depths[element.name].pop()
            del self.elements[depth:]


def _attributes(token: str, begin: int) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(token, begin, len(token) - 1):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def parse(text: str) -> Element:
    """The root holds what the page holds; strings have their references decoded."""
    root = Element("", {})
    stack, ends, last, size = _Stack(root), _Ends(text), text.rfind(">"), len(text)
    begin = at = 0  # plain text since begin
    while (at := text.find("<", at)) >= 0:
        head = text[at + 1 : at + 3]
        if head[:1] in ("!", "?"):
            if text.startswith("<!--", at):
                after = text.find("-->", at + 4)
                after = size if after < 0 else after + 3
            else:
                after = text.find(">", at) + 1 if at < last else -1
            token = None
        elif LETTER.match(head):
            after = ends.after(at + 1)
            token = text[at:after]
        else:
            after = -1
        if after < 0:
            at += 1
            continue
        if begin < at:
            stack.elements[-1].children.append(html.unescape(text[begin:at]))
        begin = at = after
        if token is None:
            continue
        name = NAME.match(token)[1].lower()
        if token[1] == "/":
            stack.end((name,))
            continue
        if name in ENDS_P:
            stack.end(("p",), P_BARRIER)
        if name in CLOSES:
            stack.end(CLOSES[name], BARRIER[name])
        element = Element(name, _attributes(token, len(name) + 1) if len(token) > len(name) + 2 else {})
        stack.elements[-1].children.append(element)
        if name in RAW:
            close = re.compile(rf"</{name}\s*+>", re.I).search(text, at)
            body, at = (text[at : close.start()], close.end()) if close else (text[at:], size)
            element.children.append(body)
            begin = at
        elif name not in VOID and not token.endswith("/>"):
            stack.push(element)
    if begin < size:
        stack.elements[-1].children.append(html.unescape(text[begin:]))
    return root


def _digest(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"\0".join(parts), digest_size=8).digest(), "little", signed=True)


def hashed(element: Element) -> list[Element]:
    """Gives every element below (and this one) digests, and chars, the length of its text; parents come before children.

    digest is of the whole subtree: names, classes, ids and texts, white space made one space. slot, of containers
    only, masks texts: it has the container's name, class, id and role without digits, whether text stands in it
    outside other containers, and the set of slots of the containers in it; so a menu with changing words keeps its slot.
    """
    order, todo = [], [element]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += reversed(x.elements)
    shapes: dict[int, frozenset[bytes]] = {}
    for x in reversed(order):
        inside, shape, x.chars = [], set(), 0
        for c in x.children:
            if isinstance(c, Element):
                inside.append(c.digest.to_bytes(8, "little", signed=True))
                x.chars += c.chars
                shape |= shapes.pop(id(c))
            elif x.name not in RAW and (text := " ".join(c.split())):
                inside.append(b"t" + text.encode("utf-8", "replace"))
                x.chars += len(text)
                shape.add(b"")
            elif x.name in RAW:
                inside.append(c.encode("utf-8", "replace"))
        names = [x.name, *(x.attributes.get(k, "") for k in ("class", "id", "role"))] if x.attributes else [x.name, "", "", ""]
        x.digest = _digest(*(n.encode("utf-8", "replace") for n in names), *inside)
        if x.name in FLOW:
            shapes[id(x)] = frozenset(shape)
        else:
            masked = [re.sub(r"\d+", "", " ".join(n.split())).encode("utf-8", "replace") for n in names]
            x.slot = _digest(b"slot", *masked, *sorted(shape))
            shapes[id(x)] = frozenset([x.slot.to_bytes(8, "little", signed=True)])
    return order


def below(element: Element) -> list[Element]:
    out, todo = [], element.elements
    while todo:
        x = todo.pop()
        out.append(x)
        todo += x.elements
    return out


def blocks(element: Element, skip) -> list[str]:
    """Texts of the element's blocks in order; skip(element) says whether to leave a subtree out."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(held).split()):
            out.append(text)
        held.clear()

    todo: list = [element]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            held.append(x)
        elif x is element or not skip(x):
            if x.name in BLOCK:
                flush()
                todo.append(None)
            todo += reversed(x.children)
    flush()
    return out
