"""A recursive-descent parser for C declarations, statements and expressions.

Names that a text uses as types without declaring them (from headers that aren't read) are taken as types where only
a declaration makes sense: two names in a row, or a name, stars and a name at a statement's begin.
"""

from __future__ import annotations

from csift.frontend.tokens import Token, Unreadable

#: Keywords of types, and names that headers usually define.
BASE = frozenset("void char short int long float double signed unsigned _Bool _Complex __int128 __builtin_va_list".split())
QUALIFIERS = frozenset("const volatile restrict __restrict __restrict__ __const __volatile__ _Atomic".split())
STORAGE = frozenset("typedef extern static auto register inline __inline __inline__ _Noreturn _Thread_local __thread __extension__ __forceinline".split())
KNOWN = frozenset(
    "size_t ssize_t ptrdiff_t intptr_t uintptr_t int8_t int16_t int32_t int64_t uint8_t uint16_t uint32_t uint64_t intmax_t uintmax_t wchar_t bool FILE DIR "
    "time_t clock_t pid_t uid_t gid_t mode_t off_t va_list u8 u16 u32 u64 s8 s16 s32 s64 byte BYTE WORD DWORD uint ushort ulong uchar nullptr_t jmp_buf socklen_t sig_atomic_t".split()
) - {"byte"}
STATEMENTS = frozenset("if else while do for switch case default break continue goto return sizeof".split())
LEVELS = [("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!="), ("<", ">", "<=", ">="), ("<<", ">>"), ("+", "-"), ("*", "/", "%")]
STRENGTH = {op: k for k, ops in enumerate(LEVELS) for op in ops}
ASSIGNMENTS = frozenset("= += -= *= /= %= &= |= ^= <<= >>=".split())


class Node:
    """kind, line, and what the kind has; `parts` are its child nodes in source order."""

    __slots__ = ("kind", "line", "last", "parts", "text", "extra")

    def __init__(self, kind: str, line: int, parts=(), text: str = "", extra=None):
        self.kind, self.line, self.parts, self.text, self.extra = kind, line, list(parts), text, extra
        self.last = line

    def walk(self):
        todo = [self]
        while todo:
            node = todo.pop()
            if node is not None:
                yield node
                todo += reversed(node.parts)


class Type:
    """words: as written; layers: from the name outwards, "*", ("[]", dimension) or ("()", parameters)."""

    __slots__ = ("words", "qualifiers", "layers", "pointer_qualifiers")

    def __init__(self, words: list[str], qualifiers: set[str], layers: list):
        self.words, self.qualifiers, self.layers = words, qualifiers, layers

    @property
    def base(self) -> str:
        return " ".join(self.words) or "int"

    @property
    def is_array(self) -> bool:
        return bool(self.layers) and self.layers[0][0] == "[]"

    @property
    def is_function_pointer(self) -> bool:
        return len(self.layers) > 1 and self.layers[0] == "*" and self.layers[1][0] == "()"

    @property
    def is_function(self) -> bool:
        return bool(self.layers) and self.layers[0][0] == "()"

    @property
    def is_pointer(self) -> bool:
        """Pointers, and arrays of pointers."""
        rest = [x for x in self.layers if x == "*" or x[0] == "()"]
        return bool(rest) and rest[0] == "*"

    @property
    def dimension(self) -> Node | None:
        return self.layers[0][1] if self.is_array else None

    def __str__(self) -> str:
        out = " ".join([*(["volatile"] if "volatile" in self.qualifiers else []), self.base])
        for layer in reversed(self.layers):
            if layer == "*":
                out = f"(*{out})" if out.endswith(")") else f"{out} *"
            elif layer[0] == "[]":
                out += f"[{show(layer[1]) if layer[1] is not None else ''}]"
            else:
                out += f" ({', '.join(str(p.extra['type']) for p in layer[1]) or 'void'})"
        return out


def show(node: Node | None) -> str:
    """An expression with one space around binary operators."""
    if node is None:
        return ""
    k, p = node.kind, node.parts
    if k in ("name", "constant"):
        return node.text
    if k == "unary":
        return f"{node.text}{_within(p[0])}"
    if k == "postfix":
        return f"{_within(p[0])}{node.text}"
    if k in ("binary", "assign"):
        return f"{_within(p[0]) if k == 'binary' else show(p[0])} {node.text} {_within(p[1]) if k == 'binary' else show(p[1])}"
    if k == "call":
        return f"{_within(p[0])}({', '.join(map(show, p[1:]))})"
    if k == "index":
        return f"{_within(p[0])}[{show(p[1])}]"
    if k == "member":
        return f"{_within(p[0])}{node.text}{node.extra}"
    if k == "cast":
        return f"({node.extra}) {_within(p[0])}"
    if k == "sizeof":
        return f"sizeof({node.extra if node.extra is not None else show(p[0])})"
    if k == "choice":
        return f"{_within(p[0])} ? {show(p[1])} : {show(p[2])}"
    if k == "comma":
        return ", ".join(map(show, p))
    if k == "list":
        return "{" + ", ".join(map(show, p)) + "}"
    if k == "compound":
        return f"({node.extra}) {show(p[0])}"
    if k == "declare":
        return f"{node.extra['type']} {node.text}" + (f" = {show(p[0])}" if p and p[0] is not None else "")
    if k == "return":
        return "return" + (f" {show(p[0])}" if p and p[0] is not None else "")
    return node.text


def _within(node: Node) -> str:
    text = show(node)
    return f"({text})" if node.kind in ("binary", "assign", "choice", "comma", "cast") else text


class Parser:
    """recover: statements of blocks that can't be read are left out, and blocks may stay open."""

    def __init__(self, source: list[Token], recover: bool = False):
        self.recover = recover
        self.source = [t for t in source if t.kind != "line"]
        self.end = Token("end", "", self.source[-1].line if self.source else 1, 1)
        self.at = 0
        self.types: list[dict[str, bool]] = [{}]  # scopes: name -> is a type
        self.typedefs: list[tuple[str, Type]] = []

    # reading
    def peek(self, ahead: int = 0) -> Token:
        at = self.at + ahead
        return self.source[at] if at < len(self.source) else self.end

    def take(self) -> Token:
        token = self.peek()
        self.at += 1
        return token

    def got(self, text: str) -> bool:
        if self.peek().text == text and self.peek().kind in ("punct", "word"):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> Token:
        token = self.peek()
        if token.text != text or token.kind not in ("punct", "word"):
            raise Unreadable(f"line {token.line}: {text!r} expected, {token.text!r} found")
        return self.take()

    def is_type(self, name: str) -> bool:
        for scope in reversed(self.types):
            if name in scope:
                return scope[name]
        return name in KNOWN

    def name_it(self, name: str, is_type: bool) -> None:
        self.types[-1][name] = is_type

    # declarations
    def unit(self) -> list[Node]:
        out = []
        while self.peek().kind != "end":
            if self.got(";"):
                continue
            if self.peek().text in ("_Static_assert", "static_assert", "asm", "__asm__", "__asm"):
                self._skip_call()
                continue
            if self.peek().text == "extern" and self.peek(1).kind == "string":
                self.at += 2
                if self.got("{"):
                    while not self.got("}"):
                        if self.peek().kind == "end":
                            raise Unreadable("extern block without end")
                        out += self.declaration(True)
                continue
            out += self.declaration(True)
        return out

    def _skip_call(self) -> None:
        self.take()
        while self.peek().text in ("volatile", "__volatile__", "goto"):
            self.take()
        if self.peek().text == "(":
            self._skip_parentheses()
        self.got(";")

    def _skip_parentheses(self) -> None:
        depth = 0
        while True:
            token = self.take()
            if token.kind == "end":
                raise Unreadable("parentheses without end")
            depth += token.text == "("
            depth -= token.text == ")"
            if depth == 0:
                return

    def _attributes(self) -> None:
        while self.peek().text in ("__attribute__", "__attribute", "__declspec", "_Alignas", "__asm__", "asm", "__asm"):
            self.take()
            if self.peek().text == "(":
                self._skip_parentheses()

    def begins_declaration(self) -> bool:
        token, following = self.peek(), self.peek(1)
        if token.kind != "word":
            return False
        if token.text in BASE or token.text in QUALIFIERS or token.text in STORAGE or token.text in ("struct", "union", "enum", "typeof", "__typeof__", "__attribute__", "_Alignas"):
            return True
        if token.text in STATEMENTS:
            return False
        if self.is_type(token.text):
            return following.text not in ("=", ".", "->", "[", "++", "--", ";", ",", ")") or following.text == ";" and False
        if any(token.text in scope for scope in self.types):
            return False
        if following.kind == "word" and following.text not in STATEMENTS:
            return True
        k = 1
        while self.peek(k).text == "*" or self.peek(k).text in QUALIFIERS:
            k += 1
        return k > 1 and self.peek(k).kind == "word" and self.peek(k + 1).text in ("=", ";", ",", "[")

    def specifiers(self) -> tuple[Type, set[str]]:
        words, qualifiers, storage = [], set(), set()
        while True:
            self._attributes()
            token = self.peek()
            if token.kind != "word":
                break
            if token.text in QUALIFIERS:
                qualifiers.add(token.text.strip("_"))
                self.take()
            elif token.text in STORAGE:
                storage.add(token.text)
                self.take()
            elif token.text in BASE:
                words.append(self.take().text)
            elif token.text in ("struct", "union", "enum"):
                words += self._tagged()
            elif token.text in ("typeof", "__typeof__"):
                self.take()
                self._skip_parentheses()
                words.append("typeof")
            elif not words and token.text not in STATEMENTS:
                words.append(self.take().text)
            else:
                break
        return Type(words, qualifiers, []), storage

    def _tagged(self) -> list[str]:
        words = [self.take().text]
        self._attributes()
        if self.peek().kind == "word":
            words.append(self.take().text)
        self._attributes()
        if self.got("{"):
            if words[0] == "enum":
                while not self.got("}"):
                    name = self.take()
                    if name.kind != "word":
                        raise Unreadable(f"line {name.line}: name of a constant expected")
                    self.name_it(name.text, False)
                    if self.got("="):
                        self.choice()
                    if not self.got(","):
                        self.need("}")
                        break
            else:
                while not self.got("}"):
                    if self.got(";"):
                        continue
                    kind, _ = self.specifiers()
                    while not self.got(";"):
                        if self.peek().text != ":":
                            self.declarator(kind)
                        if self.got(":"):
                            self.choice()
                        self._attributes()
                        if not self.got(","):
                            self.need(";")
                            break
        return words

    def declarator(self, base: Type, abstract: bool = False) -> tuple[Token | None, Type]:
        stars = []
        while True:
            self._attributes()
            if self.got("*"):
                stars.append("*")
            elif self.peek().text in QUALIFIERS:
                self.take()
            else:
                break
        name, inner = None, []
        self._attributes()
        if self.peek().text == "(" and (self.peek(1).text in ("*", "^", "(") or not abstract and self.peek(1).kind == "word" and not self._type_word(self.peek(1))):
            self.take()
            name, held = self.declarator(Type([], set(), []), abstract)
            inner = held.layers
            self.need(")")
        elif self.peek().kind == "word" and self.peek().text not in STATEMENTS:
            name = self.take()
        elif not abstract:
            raise Unreadable(f"line {self.peek().line}: name expected, {self.peek().text!r} found")
        outer = []
        while True:
            if self.got("["):
                while self.peek().text in ("static", *QUALIFIERS):
                    self.take()
                dimension = None
                if self.peek().text == "*" and self.peek(1).text == "]":
                    self.take()
                elif self.peek().text != "]":
                    dimension = self.assignment()
                self.need("]")
                outer.append(("[]", dimension))
            elif self.peek().text == "(":
                self.take()
                outer.append(("()", self.parameters()))
            else:
                break
        self._attributes()
        return name, Type(base.words, base.qualifiers, [*inner, *outer, *stars])

    def _type_word(self, token: Token) -> bool:
        return token.text in BASE or token.text in QUALIFIERS or token.text in ("struct", "union", "enum") or self.is_type(token.text)

    def parameters(self) -> list[Node]:
        out = []
        if self.got(")"):
            return out
        while True:
            token = self.peek()
            if self.got("..."):
                out.append(Node("parameter", token.line, text="...", extra={"type": Type(["..."], set(), [])}))
            else:
                base, _ = self.specifiers()
                if not base.words:
                    raise Unreadable(f"line {token.line}: parameter expected")
                name, kind = self.declarator(base, True)
                out.append(Node("parameter", (name or token).line, text=name.text if name else "", extra={"type": kind}))
            if not self.got(","):
                self.need(")")
                return out

    def declaration(self, outside: bool) -> list[Node]:
        first = self.peek()
        base, storage = self.specifiers()
        out: list[Node] = []
        if self.got(";"):
            return out
        while True:
            name, kind = self.declarator(base)
            if name is None:
                raise Unreadable(f"line {first.line}: name expected")
            if outside and not out and kind.is_function and self.peek().text == "{":
                return [self.function(first, name, kind, storage)]
            if outside and not out and kind.is_function and self.begins_declaration():
                # parameters declared between the list and the body
                while self.peek().text != "{":
                    for declared in self.declaration(False):
                        for parameter in kind.layers[0][1]:
                            if str(parameter.extra["type"]) == declared.text:
                                parameter.text, parameter.extra = declared.text, {"type": declared.extra["type"]}
                return [self.function(first, name, kind, storage)]
            self.name_it(name.text, "typedef" in storage)
            if "typedef" in storage:
                self.typedefs.append((name.text, kind))
            start = None
            if self.got("="):
                start = self.initializer()
            if "typedef" not in storage:
                node = Node("declare", name.line, [start], name.text, {"type": kind, "storage": storage, "first": first.line})
                node.last = self.peek(-1).line
                out.append(node)
            if self.got(","):
                continue
            self.need(";")
            return out

    def function(self, first: Token, name: Token, kind: Type, storage: set[str]) -> Node:
        self.name_it(name.text, False)
        self.types.append({p.text: False for p in kind.layers[0][1] if p.text})
        brace = self.peek()
        body = self.block()
        self.types.pop()
        out = Node("function", first.line, [body], name.text, {"type": kind, "storage": storage, "name_line": name.line, "brace_line": brace.line})
        out.last = self.peek(-1).line
        return out

    def initializer(self) -> Node:
        token = self.peek()
        if not self.got("{"):
            return self.assignment()
        items = []
        while not self.got("}"):
            while self.peek().text in (".", "["):
                if self.got("."):
                    self.take()
                else:
                    self.take()
                    self.choice()
                    if self.got("..."):
                        self.choice()
                    self.need("]")
            self.got("=")
            items.append(self.initializer())
            if not self.got(","):
                self.need("}")
                break
        return Node("list", token.line, items)

    # statements
    def block(self) -> Node:
        token = self.need("{")
        self.types.append({})
        items: list[Node] = []
        while not self.got("}"):
            if self.peek().kind == "end":
                if self.recover:
                    break
                raise Unreadable("block without end")
            items += self._readable_item() if self.recover else self.item()
        self.types.pop()
        out = Node("block", token.line, items)
        out.last = self.peek(-1).line
        return out

    def _readable_item(self) -> list[Node]:
        """The next item, or none where it can't be read: then what follows its semicolon or block goes on."""
        begin, scopes = self.at, len(self.types)
        try:
            return self.item()
        except Unreadable:
            del self.types[scopes:]
            self.at, depth = begin, 0
            while self.peek().kind != "end" and (depth or self.peek().text != "}"):
                text = self.take().text
                depth += (text == "{") - (text == "}")
                if depth == 0 and text in (";", "}"):
                    break
            return []

    def item(self) -> list[Node]:
        if self.peek().kind == "word" and self.peek(1).text == ":" and self.peek().text not in ("default", "case"):
            return [self.statement()]
        if self.begins_declaration():
            return self.declaration(False)
        return [self.statement()]

    def statement(self) -> Node:
        token = self.peek()
        word = token.text if token.kind in ("word", "punct") else ""
        if word == "{":
            return self.block()
        if word == ";":
            self.take()
            return Node("empty", token.line)
        if word in ("asm", "__asm__", "__asm"):
            self._skip_call()
            return Node("empty", token.line)
        if word == "if":
            self.take()
            condition = self._condition()
            then = self.statement()
            other = self.statement() if self.got("else") else None
            return Node("if", token.line, [condition, then, other])
        if word == "while":
            self.take()
            return Node("while", token.line, [self._condition(), self.statement()])
        if word == "do":
            self.take()
            body = self.statement()
            self.need("while")
            condition = self._condition()
            self.need(";")
            return Node("do", token.line, [body, condition])
        if word == "for":
            self.take()
            self.need("(")
            self.types.append({})
            start: list[Node] = []
            if self.begins_declaration():
                start = self.declaration(False)
            elif not self.got(";"):
                start = [self.expression()]
                self.need(";")
            condition = None if self.peek().text == ";" else self.expression()
            self.need(";")
            step = None if self.peek().text == ")" else self.expression()
            self.need(")")
            body = self.statement()
            self.types.pop()
            return Node("for", token.line, [*start, condition, step, body], extra=len(start))
        if word == "switch":
            self.take()
            return Node("switch", token.line, [self._condition(), self.statement()])
        if word in ("case", "default"):
            self.take()
            label = None
            if word == "case":
                label = self.choice()
                if self.got("..."):
                    self.choice()
            self.need(":")
            return Node(word, token.line, [label, self._after_label()])
        if word in ("break", "continue"):
            self.take()
            self.need(";")
            return Node(word, token.line, text=word)
        if word == "goto":
            self.take()
            if self.got("*"):
                self.expression()
                self.need(";")
                return Node("empty", token.line)
            name = self.take()
            self.need(";")
            return Node("goto", token.line, text=name.text)
        if word == "return":
            self.take()
            value = None if self.peek().text == ";" else self.expression()
            self.need(";")
            return Node("return", token.line, [value])
        if token.kind == "word" and self.peek(1).text == ":":
            self.at += 2
            return Node("label", token.line, [self._after_label()], token.text)
        value = self.expression()
        self.need(";")
        return value

    def _after_label(self) -> Node:
        if self.peek().text == "}" or self.peek().text in ("case", "default"):
            return Node("empty", self.peek().line)
        if self.begins_declaration():
            return Node("block", self.peek().line, self.declaration(False))
        return self.statement()

    def _condition(self) -> Node:
        self.need("(")
        out = self.expression()
        self.need(")")
        return out

    # expressions
    def expression(self) -> Node:
        first = self.assignment()
        if self.peek().text != ",":
            return first
        parts = [first]
        while self.got(","):
            parts.append(self.assignment())
        return Node("comma", first.line, parts)

    def assignment(self) -> Node:
        left = self.choice()
        token = self.peek()
        if token.kind == "punct" and token.text in ASSIGNMENTS:
            self.take()
            return Node("assign", left.line, [left, self.initializer() if self.peek().text == "{" else self.assignment()], token.text)
        return left

    def choice(self) -> Node:
        condition = self.binary(0)
        if not self.got("?"):
            return condition
        yes = condition if self.peek().text == ":" else self.expression()
        self.need(":")
        return Node("choice", condition.line, [condition, yes, self.choice()])

    def binary(self, level: int) -> Node:
        left = self.unary()
        while True:
            token = self.peek()
            strength = STRENGTH.get(token.text, -1) if token.kind == "punct" else -1
            if strength < level:
                return left
            self.take()
            right = self.binary(strength + 1)
            left = Node("binary", left.line, [left, right], token.text, token.line)

    def _type_in_parentheses(self) -> bool:
        token = self.peek(1)
        if token.kind != "word" or token.text in STATEMENTS:
            return False
        if self._type_word(token) or token.text in ("typeof", "__typeof__"):
            return True
        if any(token.text in scope for scope in self.types):
            return False
        k = 2
        while self.peek(k).text == "*" or self.peek(k).text in QUALIFIERS:
            k += 1
        after = self.peek(k + 1)
        if self.peek(k).text != ")":
            return False
        # (unknown *) x, or (unknown) x
        return k > 2 or after.kind in ("word", "number", "string", "char") and after.text not in STATEMENTS

    def type_name(self) -> Type:
        base, _ = self.specifiers()
        _, kind = self.declarator(base, True)
        return kind

    def unary(self) -> Node:
        token = self.peek()
        if token.kind == "punct":
            if token.text in ("++", "--", "&", "*", "+", "-", "~", "!", "&&"):
                self.take()
                return Node("unary", token.line, [self.unary()], token.text)
            if token.text == "(" and self._type_in_parentheses():
                self.take()
                kind = self.type_name()
                self.need(")")
                if self.peek().text == "{":
                    return self.postfix(Node("compound", token.line, [self.initializer()], extra=kind))
                return Node("cast", token.line, [self.unary()], extra=kind)
        elif token.text in ("sizeof", "_Alignof", "alignof", "__alignof__"):
            self.take()
            if self.peek().text == "(" and self._type_in_parentheses():
                self.take()
                kind = self.type_name()
                self.need(")")
                return Node("sizeof", token.line, extra=kind)
            return Node("sizeof", token.line, [self.unary()])
        elif token.text == "__extension__":
            self.take()
            return self.unary()
        return self.postfix(self.primary())

    def primary(self) -> Node:
        token = self.take()
        if token.kind == "word" and token.text not in STATEMENTS:
            return Node("name", token.line, text=token.text)
        if token.kind in ("number", "char"):
            return Node("constant", token.line, text=token.text)
        if token.kind == "string":
            text = token.text
            while self.peek().kind == "string" or self.peek().kind == "word" and self.peek().text.startswith("PRI") and self.peek(1).kind == "string":
                text += " " + self.take().text
            return Node("constant", token.line, text=text)
        if token.text == "(":
            if self.peek().text == "{":
                body = self.block()
                self.need(")")
                return Node("statements", token.line, [body])
            inner = self.expression()
            self.need(")")
            return inner
        raise Unreadable(f"line {token.line}: expression expected, {token.text!r} found")

    def postfix(self, node: Node) -> Node:
        while True:
            token = self.peek()
            if token.kind != "punct":
                return node
            if token.text == "[":
                self.take()
                inner = self.expression()
                self.need("]")
                node = Node("index", node.line, [node, inner])
            elif token.text == "(":
                self.take()
                arguments = []
                while not self.got(")"):
                    if self.begins_declaration() and self._type_word(self.peek()):
                        kind = self.type_name()
                        arguments.append(Node("constant", token.line, text=str(kind)))
                    else:
                        arguments.append(self.assignment())
                    if not self.got(","):
                        self.need(")")
                        break
                node = Node("call", node.line, [node, *arguments])
            elif token.text in (".", "->"):
                self.take()
                node = Node("member", node.line, [node], token.text, self.take().text)
            elif token.text in ("++", "--"):
                self.take()
                node = Node("postfix", node.line, [node], token.text)
            else:
                return node


def parse(source: list[Token]) -> tuple[list[Node], list[tuple[str, Type]]]:
    """External declarations, and typedefs in order."""
    parser = Parser(source)
    try:
        return parser.unit(), parser.typedefs
    except RecursionError as error:
        raise Unreadable("nested too deeply") from error


def readable_block(source: list[Token]) -> Node:
    """The block that tokens begin with, without the statements that can't be read."""
    try:
        return Parser(source, recover=True).block()
    except RecursionError as error:
        raise Unreadable("nested too deeply") from error
