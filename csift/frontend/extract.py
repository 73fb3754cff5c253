"""Facts of one file: what the syntax tree and the graphs say, as plain rows.

Tiers, as a report names them: with macros; with directives left out; by patterns where neither parses.
"""

from __future__ import annotations

import re

from csift.frontend import fallback, flow
from csift.frontend.lexical import Source
from csift.frontend.syntax import Node, Type, parse, readable_block, show
from csift.frontend.tokens import Preprocessor, Token, TooLong, Unreadable, tokens

#: Type names that are unsigned, and words of functions that decide on access.
UNSIGNED = (
    "size_t size_type uint8_t uint16_t uint32_t uint64_t uintptr_t uintmax_t u_int8_t u_int16_t u_int32_t u_int64_t u_char u_int u_long u_short char16_t char32_t"
).split()
SIGNED = "int short long char ssize_t int8_t int16_t int32_t int64_t intptr_t ptrdiff_t".split()
DECIDING = "auth verify check_password validate_token boot_secure crypto admin login permission".split()
KEYWORDS = ("if", "else", "for", "while", "do")
WORD = re.compile(r"[A-Za-z_]\w*")
PREPROCESSED, PLAIN, PATTERNS = "macros-expanded", "directives-left-out", "patterns"


def is_unsigned(kind: str, typedefs: set[str] | frozenset[str]) -> bool:
    low = kind.lower()
    return "unsigned" in low or not {w.lower() for w in (*UNSIGNED, *typedefs)}.isdisjoint(WORD.findall(low))


def is_signed(kind: str) -> bool:
    low = kind.lower()
    return "unsigned" not in low and not set(SIGNED).isdisjoint(WORD.findall(low))


def unsigned_typedefs(clean: str) -> list[str]:
    """In order, so that a typedef can build on an earlier one."""
    out: list[str] = []
    for body in re.findall(r"\btypedef\b([^;{}]*);", clean):
        first = re.match(r"\s*((?:\w+\s+)*?)\s*(?=[\w*(][^,]*(?:,|$))", body)
        words = body.split(",")
        head = words[0].split()
        if len(head) < 2 and "(" not in words[0]:
            continue
        base = " ".join(head[:-1]) if "(" not in words[0] else words[0].split("(")[0]
        if first is None or not is_unsigned(base, set(out)):
            continue
        for declarator in words:
            pointer = re.search(r"\(\s*\*\s*(\w+)\s*\)", declarator)
            found = WORD.findall(re.sub(r"\[[^\]]*\]", "", declarator))
            if pointer is None and found and "*" not in declarator:
                out.append(found[-1])
    return out


def returns_truth(words: list[str]) -> bool:
    """Whether a return gives a truth value and nothing else, brackets apart."""
    for k, word in enumerate(words):
        if word == "return" and ";" in words[k : k + 5]:
            given = [w for w in words[k + 1 : words.index(";", k)] if w not in ("(", ")")]
            if len(given) == 1 and given[0] in ("0", "1", "true", "false"):
                return True
    return False


#: What is looked for on request: lists of a file's row and its functions' rows, "flow" for nodes, edges and facts, and numbers of rules.
ON_PATHS = frozenset({3, 4, 7, 21, 22, 23, 27, 34, 36})
PARTS = frozenset({*ON_PATHS, 6, 33, 38, "calls", "words", "events", "casts", "sizeofs", "switches", "controls", "flow"})


class FileFacts:
    """allocators and so on: names beside the usual ones that a project's settings add. asked: which of PARTS, all if not given."""

    def __init__(self, text: str, clean: str, allocators=(), reallocators=(), deallocators=(), asked=None):
        self.text, self.clean = text, clean
        self.asked = PARTS if asked is None else PARTS & frozenset(asked)
        self.extra = frozenset(allocators) | frozenset(reallocators)
        self.reallocators = frozenset({"realloc", *reallocators})
        self.deallocators = flow.DEALLOCATORS | frozenset(deallocators)
        self.typedefs = unsigned_typedefs(clean)
        self.hits: list[dict] = []
        self.functions: list[dict] = []
        self.nodes: list[dict] = []
        self.edges: list[dict] = []
        self.facts: list[dict] = []
        self.lines = clean.split("\n")
        self.reason: str | None = None
        self._source: Source | None = None

    def row(self) -> dict:
        tier, units = PREPROCESSED, None
        source: list[Token] = []
        for tier, read in ((PREPROCESSED, lambda: Preprocessor().run(self.clean)), (PLAIN, lambda: tokens(without_directives(self.clean)))):
            try:
                source = read()
                units, found = parse(source)
                break
            except TooLong as error:
                self.reason = str(error)
            except (Unreadable, RecursionError):
                continue
        else:
            tier = PATTERNS
        if units is None:
            self.by_patterns()
        else:
            for name, kind in found:
                if not kind.layers and is_unsigned(str(kind), set(self.typedefs)) and name not in self.typedefs:
                    self.typedefs.append(name)
            self.globals = [self.variable(x) for x in units if x.kind == "declare" and not x.extra["type"].is_function]
            for number, node in enumerate(x for x in units if x.kind == "function"):
                self.function(number, node)
        status, confidence = ("fallback-parser", "FALLBACK") if tier == PATTERNS else ("parsed", "FULL")
        return {
            "status": status, "reason": self.reason, "parse_tier": tier, "confidence": confidence, "unsigned_typedefs": self.typedefs, "functions": self.functions, "globals": self.globals,
            "switches": switches(self.clean) if "switches" in self.asked else [], "controls": control_statements(self.clean) if "controls" in self.asked else [], "hits": self.hits, "nodes": self.nodes, "edges": self.edges, "facts": self.facts,
        }

    def hit(self, rule: int, line: int, *parameters, column: int = 1) -> None:
        row = {"rule": rule, "line": line, "column": column, "parameters": [str(p) for p in parameters], "context": None, "pass": 1}
        if row not in self.hits:
            self.hits.append(row)

    # from the tree
    def variable(self, x: Node) -> dict:
        kind: Type = x.extra["type"]
        dimension = kind.dimension
        return {
            "name": x.text, "type": str(kind), "is_pointer": kind.is_pointer, "is_signed": not is_unsigned(kind.base, set(self.typedefs)), "is_volatile": "volatile" in kind.qualifiers,
            "is_vla": kind.is_array and dimension is not None and dimension.kind != "constant", "is_array": kind.is_array, "has_initializer": x.parts[0] is not None,
            "array_size": show(dimension) if dimension is not None else None, "line": x.line, "assigned": [], "is_static": "static" in x.extra["storage"] or "extern" in x.extra["storage"],
        }

    def function(self, number: int, node: Node) -> None:
        kind: Type = node.extra["type"]
        listed = kind.layers[0][1]
        is_void = len(listed) == 1 and str(listed[0].extra["type"]) == "void" and not listed[0].text
        parameters = [
            {"pos": i, "name": p.text, "type": str(p.extra["type"]), "is_pointer": p.extra["type"].is_pointer or p.extra["type"].is_function_pointer, "line": p.line}
            for i, p in enumerate(listed)
            if p.text != "..." and not is_void
        ]
        body = node.parts[0]
        below = list(body.walk())
        declared = [x for x in below if x.kind == "declare" and not x.extra["type"].is_function]
        variables = {x.text: self.variable(x) for x in declared}  # a later declaration of a name stands for all
        returned = {show(x.parts[0]) for x in below if x.kind == "return"}
        calls, asked = call_rows(body), lambda part, of, *given: of(*given) if part in self.asked else []
        for x in below:
            if x.kind == "assign":
                for name in flow.names(x.parts[0]) & variables.keys():
                    variables[name]["assigned"].append(x.line)
        row = {
            "idx": number, "name": node.text, "return_type": str(Type(kind.words, kind.qualifiers, kind.layers[1:])), "start_line": node.line, "end_line": node.last,
            "brace_line": node.extra["brace_line"], "body_lines": max(0, node.last - node.line - 1), "empty_params": not listed, "void_params": is_void,
            "returns_boolean": bool(returned & {"0", "1", "true", "false"}) and any(t in node.text.lower() for t in DECIDING),
            "has_assertions": any(c["callee"] in flow.ASSERTIONS for c in calls), "params": parameters, "variables": list(variables.values()),
            "calls": calls if "calls" in self.asked else [], "words": asked("words", lambda: sorted(set(WORD.findall(self.body_text(node))))), "events": asked("events", linear_events, body),
            "casts": asked("casts", casts, body), "sizeofs": asked("sizeofs", sizeofs, body),
            "types": {**{g["name"]: g["type"] for g in self.globals}, **{v["name"]: v["type"] for v in variables.values()}, **{p["name"]: p["type"] for p in parameters if p["name"]}},
        }
        self.functions.append(row)
        if not self.asked.isdisjoint({"flow", *ON_PATHS}):
            self.paths(number, node, row, variables)
        if 38 in self.asked:
            self.returned_addresses(node, listed)
        self.arithmetic(body, row)

    def body_text(self, node: Node) -> str:
        lines = self.lines[node.extra["brace_line"] - 1 : node.last]
        text = "\n".join(lines)
        return text[text.find("{") + 1 :]

    def paths(self, number: int, node: Node, row: dict, variables: dict[str, dict]) -> None:
        initialized = {p["name"] for p in row["params"]} | {g["name"] for g in self.globals} | {v for v, x in variables.items() if x["has_initializer"]}
        usual = flow.Graph(node)
        facts = usual.facts(initialized)
        own = (flow.Graph(node, flow.ALLOCATORS | self.extra, self.deallocators) if self.extra or self.deallocators != flow.DEALLOCATORS else usual)
        own_facts = facts if own is usual else own.facts(initialized)
        freeing = flow.Graph(node, flow.ALLOCATORS, self.deallocators) if own is not usual else usual
        free_facts = facts if own is usual else freeing.facts(initialized)
        if "flow" in self.asked:
            self.record(number, usual, facts)
        if 3 in self.asked:
            for event in live(own):
                for name in sorted(event.allocated):
                    if flow.unsafe_allocation_use(own, own_facts, event.id, name) is not None:
                        self.hit(3, event.line, name)
        if 4 in self.asked:
            for event in live(usual):
                for name in sorted(event.derefs):
                    if facts[event.id][name][0] == "NULL":
                        self.hit(4, event.line, "null", name)
            for p in row["params"]:
                if p["is_pointer"] and p["name"]:
                    event = flow.unsafe_parameter_use(usual, facts, p["name"])
                    if event is not None and facts[event.id][p["name"]][0] != "NULL":
                        self.hit(4, event.line, "parameter", p["name"], row["name"])
        for name, x in variables.items() if not self.asked.isdisjoint({21, 23}) else ():
            if x["has_initializer"] or x["is_static"]:
                continue
            for event in live(usual):
                used = name in event.reads or x["is_pointer"] and name in event.derefs
                if used and name not in event.writes and facts[event.id][name][1] != "INITIALIZED":
                    if x["is_pointer"] and 21 in self.asked:
                        self.hit(21, x["line"], name)
                    if not x["is_volatile"] and name in event.reads and 23 in self.asked:
                        self.hit(23, x["line"], name)
        for event in live(freeing) if not self.asked.isdisjoint({22, 27}) else ():
            for name in sorted(event.freed):
                if 27 in self.asked and free_facts[event.id][name][2] in ("FREED", "MAYBE_FREED"):
                    self.hit(27, event.line, name)
                for use in flow.uses_after_free(freeing, free_facts, event.id, name) if 22 in self.asked else ():
                    self.hit(22, use.line, name, event.line)
        if 36 in self.asked:
            leaking = flow.Graph(node, flow.LEAK_ALLOCATORS | self.extra, self.deallocators)
            leak_facts = leaking.facts(initialized)
            for event in live(leaking):
                for name in sorted(event.allocated):
                    if name in variables and flow.leaks(leaking, leak_facts, event.id, name, set(variables)):
                        self.hit(36, event.line, name, event.line)
        if 7 in self.asked:
            self.indexes(node, row, variables, usual)
        if 34 in self.asked:
            self.divisions(node, usual)

    @property
    def source(self) -> Source:
        """The text as tokens, for what is looked up by name."""
        if self._source is None:
            self._source = Source(self.clean)
        return self._source

    def record(self, number: int, graph: flow.Graph, facts: dict) -> None:
        for e in graph.events:
            sets = {k: sorted(getattr(e, k)) for k in ("reads", "writes", "null_writes", "freed", "allocated", "derefs", "asserted")}
            self.nodes.append({"fn_idx": number, "node_id": e.id, "kind": e.kind, "line": e.line, "expr": e.text, **sets})
            self.edges += [{"fn_idx": number, "src": e.id, "dst": to, "nonnull": sorted(yes), "null": sorted(no)} for to, yes, no in e.next]
            concerned = e.reads | e.writes | e.derefs | e.freed
            self.facts += [{"fn_idx": number, "node_id": e.id, "line": e.line, "kind": e.kind, "var": v, "nullness": f[0], "init": f[1], "alloc": f[2]} for v, f in sorted(facts.get(e.id, {}).items()) if v in concerned]

    # 007
    def declared_size(self, name: str, variables: dict[str, dict], node: Node, line: int, seen: frozenset = frozenset()) -> int | None:
        if name in seen:
            return None
        x = variables.get(name) or next((g for g in self.globals if g["name"] == name), None)
        if x is not None and x["array_size"]:
            text = x["array_size"]
            if text.isdigit():
                return int(text)
            if (value := self.source.named(text)) is not None:
                return value
            numbers = [int(t.text) for t in tokens(text) if t.text.isdigit()]
            if numbers:
                return numbers[0]
        found = None
        for y in node.walk():
            value = None
            if y.line <= line and y.kind == "declare" and y.text == name:
                value = y.parts[0]
            elif y.line <= line and y.kind == "assign" and y.text == "=" and y.parts[0].kind == "name" and y.parts[0].text == name:
                value = y.parts[1]
            if value is not None:
                found = alias(value)
        if found is not None and found[0] not in (name, "NULL", "nullptr"):
            size = self.declared_size(found[0], variables, node, line, seen | {name})
            return None if size is None else max(0, size - found[1])
        return None

    def indexes(self, node: Node, row: dict, variables: dict[str, dict], graph: flow.Graph) -> None:
        by_line: dict[int, int] = {}
        for e in graph.events:
            by_line.setdefault(e.line, e.id)
        done = set()
        for x in node.parts[0].walk():
            if x.kind != "index":
                continue
            array = show(x.parts[0])
            size = self.declared_size(array, variables, node, x.line)
            for name in sorted(flow.names(x.parts[1], callees=False)):
                if (x.line, array, name) in done:
                    continue
                signed = self.index_is_signed(name, row, variables)

                def guard(event: flow.Event):
                    return [True] if bounded(event.tree, name, size, signed) else None

                target = by_line.get(x.line)
                if target is not None:
                    safe = flow.guarded_everywhere(graph, target, name, guard)
                else:
                    safe = any(e.line <= x.line and guard(e) for e in graph.events)
                if not safe:
                    done.add((x.line, array, name))
                    self.hit(7, x.line, name, array)

    def index_is_signed(self, name: str, row: dict, variables: dict[str, dict]) -> bool:
        x = variables.get(name) or next((g for g in self.globals if g["name"] == name), None)
        if x is not None:
            return x["is_signed"]
        for p in row["params"]:
            if p["name"] == name:
                return not is_unsigned(p["type"], set(self.typedefs))
        return True

    # 034
    def divisions(self, node: Node, graph: flow.Graph) -> None:
        for x in node.parts[0].walk():
            if x.kind != "binary" or x.text not in ("/", "%"):
                continue
            divisor = x.parts[1]
            if divisor.kind == "constant":
                if number(divisor.text) == 0:
                    self.hit(34, x.line, "literal")
                continue
            if divisor.kind != "name":
                self.hit(34, x.line, "compound", show(divisor))
                continue
            here = [e for e in graph.events if e.line == x.line]
            plain = [e for e in here if e.kind != "if_cond"] or here
            exact = [e for e in plain if divisor.text in e.text] or plain
            if exact and not flow.guarded_everywhere(graph, max(e.id for e in exact), divisor.text, lambda e: nonzero(e, divisor.text)):
                self.hit(34, x.line, "name", divisor.text)

    # 038
    def returned_addresses(self, node: Node, listed: list[Node]) -> None:
        scopes: list[dict[str, bool | None]] = [{p.text: False for p in listed if p.text}]

        def look(name: str) -> bool | None:
            for scope in reversed(scopes):
                if name in scope:
                    return scope[name]
            return None

        def escaping(x: Node | None) -> set[str]:
            if x is None:
                return set()
            if x.kind == "name":
                return {x.text} if look(x.text) is True else set()
            if x.kind == "unary" and x.text == "&":
                inner, indexed = x.parts[0], False
                while inner.kind in ("index", "member"):
                    if inner.kind == "member" and inner.text == "->":
                        return set()
                    indexed |= inner.kind == "index"
                    inner = inner.parts[0]
                held = look(inner.text) if inner.kind == "name" else None
                return {inner.text} if held is True or held is False and not indexed else set()
            if x.kind == "cast" or x.kind == "comma":
                return escaping(x.parts[-1])
            if x.kind == "choice":
                return escaping(x.parts[1]) | escaping(x.parts[2])
            if x.kind == "binary" and x.text in ("+", "-"):
                return escaping(x.parts[0]) | escaping(x.parts[1])
            return set()

        def visit(x: Node | None) -> None:
            if x is None:
                return
            if x.kind in ("block", "for"):
                scopes.append({})
                for part in x.parts:
                    visit(part)
                scopes.pop()
            elif x.kind == "declare":
                fixed = bool({"static", "extern"} & x.extra["storage"])
                scopes[-1][x.text] = None if fixed else x.extra["type"].is_array
            elif x.kind == "return":
                found = escaping(x.parts[0])
                if found:
                    self.hit(38, x.line, ", ".join(sorted(found)), node.text)
            else:
                for part in x.parts:
                    if part is not None and part.kind in ("block", "if", "while", "do", "for", "switch", "case", "default", "label", "return", "declare"):
                        visit(part)

        visit(node.parts[0])

    # 006 and 033
    def arithmetic(self, body: Node, row: dict) -> None:
        from csift.frontend import arithmetic

        if 6 in self.asked:
            arithmetic.overflow(self, body)
        if 33 in self.asked:
            arithmetic.signedness(self, body, row["types"])

    # by patterns
    def by_patterns(self) -> None:
        found = fallback.functions(self.clean)
        line_of = lambda at: self.clean.count("\n", 0, at) + 1
        outside, at = [], 0
        for f in found:
            outside.append(self.clean[at : f["begin"]])
            outside.append("\n" * self.clean.count("\n", f["begin"], f["end"] + 1))
            at = f["end"] + 1
        outside.append(self.clean[at:])
        self.globals = [self.pattern_variable(v) for v in fallback.variables("".join(outside), 1)]
        for number, f in enumerate(found):
            inside, first = self.clean[f["brace"] + 1 : f["end"]], line_of(f["brace"])
            variables = {v["name"]: self.pattern_variable(v) for v in fallback.variables(inside, first)}
            for k, line in enumerate(inside.split("\n")):
                for name in fallback.ASSIGNED.findall(line):
                    if name in variables:
                        variables[name]["assigned"].append(first + k)
            parameters = [{"pos": i, "name": n, "type": t, "is_pointer": "*" in t, "line": line_of(f["begin"])} for i, (t, n) in enumerate(f["parameters"])]
            calls = []
            for match in fallback.CALL.finditer(inside):
                if match[1] in fallback.WORDS_BEFORE:
                    continue
                raw = fallback.balanced(inside, match.end() - 1)
                target = re.search(r"([A-Za-z_]\w*)\s*=\s*(?:\([^()]*\)\s*)?$", inside[: match.start()])
                calls.append({"idx": len(calls), "callee": match[1], "line": first + inside.count("\n", 0, match.start()), "raw_args": " ".join((raw or "").split()), "args": fallback.split_arguments(raw or ""), "target": target[1] if target else None, "after_else": []})
            start, end = line_of(f["begin"]), line_of(f["end"])
            row = {
                "idx": number, "name": f["name"], "return_type": f["return_type"], "start_line": start, "end_line": end, "brace_line": first, "body_lines": max(0, end - start - 1),
                "empty_params": f["listed"] == "", "void_params": f["listed"] == "void",
                "returns_boolean": any(t in f["name"].lower() for t in DECIDING) and returns_truth([t.text for t in tokens(inside)]),
                "has_assertions": any(c["callee"] in flow.ASSERTIONS for c in calls), "params": parameters, "variables": list(variables.values()), "calls": calls,
                "words": sorted(set(WORD.findall(inside))), "events": [], "casts": [], "sizeofs": [],
                "types": {**{g["name"]: g["type"] for g in self.globals}, **{v["name"]: v["type"] for v in variables.values()}, **{p["name"]: p["type"] for p in parameters if p["name"]}},
            }
            self.functions.append(row)
            for v in variables.values():
                if not v["is_pointer"] and not v["is_volatile"] and not v["has_initializer"] and not v["is_array"]:
                    self.hit(23, v["line"], v["name"])
            try:
                body = readable_block(tokens(without_directives(self.clean[f["brace"] : f["end"] + 1]), first))
            except Unreadable:
                continue
            self.rough_rules(row, Steps(body, flow.ALLOCATORS | flow.LEAK_ALLOCATORS | self.extra, self.deallocators))
            self.arithmetic(body, row)

    def pattern_variable(self, v: dict) -> dict:
        kind = v["type"] + " *" * v["stars"] + (f"[{v['dimension']}]" if v["array"] else "")
        return {
            "name": v["name"], "type": kind, "is_pointer": v["stars"] > 0, "is_signed": not is_unsigned(v["type"], set(self.typedefs)), "is_volatile": "volatile" in v["type"],
            "is_vla": v["array"] and bool(re.match(r"[a-z_]\w*$", v["dimension"] or "")), "is_array": v["array"], "has_initializer": v["initial"],
            "array_size": (v["dimension"] or "").strip() or None, "line": v["line"], "assigned": [], "is_static": "static" in v["type"].split(),
        }

    def rough_rules(self, row: dict, steps: Steps) -> None:
        """The flow rules where a body is only partly read: what stands behind a step, as long as no scope around it ends."""
        for step in steps.all:
            for name in sorted(step.event.allocated):
                later = list(steps.behind(step))
                if step.calls & (flow.ALLOCATORS | self.extra) and not any(name in x.tested or name in x.event.asserted for x in later if x.line <= step.line + 7):
                    self.hit(3, step.line, name)
                kept = any(name in x.event.freed or x.event.kind == "return" and name in x.event.reads or name in x.stored for x in later)
                if not kept:
                    self.hit(36, step.line, name, step.line)
            for name in sorted(step.event.freed):
                for x in steps.behind(step, 200):
                    if name in x.event.writes:
                        break
                    if name in x.event.freed:
                        self.hit(27, x.line, name)
                        break
                    if name in x.event.derefs or name in x.passed:
                        self.hit(22, x.line, name, step.line)
                        break
            # where a name is null: set so, or tested for it
            for name, after in [*((n, steps.behind(step)) for n in sorted(step.event.null_writes)), *((n, steps.inside(step)) for n in sorted(step.null_inside))]:
                for x in after:
                    if name in x.event.writes or x is not step and name in x.tested:
                        break
                    if name in x.event.derefs:
                        self.hit(4, x.line, "null", name)
                        break
        for p in row["params"]:
            if p["is_pointer"] and p["name"]:
                used = next((x for x in steps.all if p["name"] in x.event.derefs), None)
                first = steps.all[0].line if steps.all else 0
                tests = (x for x in steps.all if p["name"] in x.mentioned and (x.line < first + 6 or used is not None and x.at < used.at))
                if used is not None and next(tests, None) is None:
                    self.hit(4, used.line, "parameter", p["name"], row["name"])


class Step:
    """A statement or a condition of a body, read as an event of a graph, with the depth it stands at."""

    def __init__(self, at: int, depth: int, event: flow.Event, condition: Node | None = None):
        self.at, self.depth, self.event, self.line = at, depth, event, event.line
        tree = condition if condition is not None else event.tree
        held = flow.calls(tree)
        self.calls = {flow.callee(x) for x in held}
        self.passed = {a.text for x in held for a in x.parts[1:] if a.kind == "name"} - event.freed
        self.mentioned = flow.names(condition) if condition is not None else set(event.asserted)
        self.tested = set().union(*flow.null_tests(condition)) if condition is not None else set()
        self.null_inside = flow.surely_null(condition)[0] if condition is not None else set()
        target = flow.bare(event.tree.parts[0]) if condition is None and event.tree is not None and event.tree.kind == "assign" else None
        self.stored = flow.names(event.tree.parts[1]) if target is not None and target.kind != "name" else set()


class Steps:
    """A body's steps in source order."""

    def __init__(self, body: Node, allocators: frozenset, deallocators: frozenset):
        self.all: list[Step] = []
        self.allocators, self.deallocators = allocators, deallocators
        for x in body.parts:
            self._visit(x, 0)

    def _plain(self, x: Node, depth: int) -> None:
        event = flow.Event(len(self.all), x.kind, x.line, x)
        flow.describe(event, x, self.allocators, self.deallocators)
        self.all.append(Step(event.id, depth, event))

    def _test(self, line: int, condition: Node | None, depth: int) -> None:
        if condition is not None:
            self.all.append(Step(len(self.all), depth, flow.Event(len(self.all), "test", line, None), condition))

    def _visit(self, x: Node | None, depth: int) -> None:
        if x is None or x.kind in ("empty", "break", "continue", "goto"):
            return
        if x.kind == "block":
            for part in x.parts:
                self._visit(part, depth + 1)
        elif x.kind in ("if", "while", "switch"):
            self._test(x.line, x.parts[0], depth)
            for part in x.parts[1:]:
                self._visit(part, depth + (part is not None and part.kind != "block"))
        elif x.kind == "do":
            self._visit(x.parts[0], depth)
            self._test(x.line, x.parts[1], depth)
        elif x.kind == "for":
            *starts, condition, step, inner = x.parts
            for part in starts:
                self._plain(part, depth)
            self._test(x.line, condition, depth)
            self._visit(inner, depth + (inner is not None and inner.kind != "block"))
            if step is not None:
                self._plain(step, depth + 1)
        elif x.kind in ("case", "default", "label"):
            self._visit(x.parts[-1], depth)
        else:
            self._plain(x, depth)

    def behind(self, step: Step, lines: int = 1 << 30):
        """Later steps, until the scope that the step stands in ends."""
        for x in self.all[step.at + 1 :]:
            if x.depth < step.depth or x.line > step.line + lines:
                return
            yield x

    def inside(self, test: Step):
        """The steps that a condition governs."""
        for x in self.all[test.at + 1 :]:
            if x.depth <= test.depth:
                return
            yield x


def live(graph: flow.Graph) -> list[flow.Event]:
    return [e for e in graph.events if e.id in graph.reachable]


def without_directives(clean: str) -> str:
    out, going = [], False
    for line in clean.split("\n"):
        directive = going or line.lstrip().startswith("#")
        going = directive and line.rstrip().endswith("\\")
        out.append("" if directive else line)
    return "\n".join(out)


def number(text: str) -> int | None:
    digits = text.rstrip("uUlL")
    try:
        return int(digits, 8) if re.fullmatch(r"0[0-7]+", digits) else int(digits, 0)
    except ValueError:
        return None


def alias(value: Node) -> tuple[str, int] | None:
    """(array, offset) that a pointer's value stands for: a, &a, &a[k], a + k, k + a."""
    x = flow.bare(value)
    if x.kind == "unary" and x.text == "&":
        inner = x.parts[0]
        if inner.kind == "index" and inner.parts[0].kind == "name" and inner.parts[1].kind == "constant":
            return inner.parts[0].text, number(inner.parts[1].text) or 0
        x = inner
    if x.kind == "binary" and x.text == "+":
        for one, other in (x.parts, x.parts[::-1]):
            if one.kind == "name" and other.kind == "constant" and number(other.text) is not None:
                return one.text, number(other.text)
    return (x.text, 0) if x.kind == "name" else None


FLIPPED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}


def bounded(tree: Node | None, name: str, size: int | None, signed: bool) -> bool:
    """Whether an expression tests `name` against a lower bound (unless unsigned) and an upper one that fits the size."""
    lower, upper = not signed, False
    for x in tree.walk() if tree is not None else ():
        if x.kind == "call" and flow.callee(x) in ("min", "clamp") and name in flow.names(tree):
            limits = [n for y in tree.walk() if y.kind == "constant" and (n := number(y.text)) is not None]
            if size is None or not limits or any(n <= size for n in limits):
                upper = True
            lower |= flow.callee(x) == "clamp"
        if x.kind != "binary" or x.text not in FLIPPED:
            continue
        for one, other, op in ((*x.parts, x.text), (x.parts[1], x.parts[0], FLIPPED[x.text])):
            if one.kind != "name" or one.text != name:
                continue
            negative = other.kind == "unary" and other.text == "-"
            limit = number(other.parts[0].text if negative else other.text) if (other.parts[0] if negative else other).kind == "constant" else None
            limit = -limit if negative and limit is not None else limit
            if limit is None and (other.kind not in ("name", "constant", "binary", "sizeof", "call", "member", "cast")):
                continue
            if op in ("<", "<="):
                top = None if limit is None else limit + (op == "<=")
                lower |= top is not None and top <= 0  # the other branch has none below zero
                upper |= top is None or size is None or top <= size
            else:
                lower |= limit is None or limit - (op == ">=") >= -1
    return lower and upper


def nonzero(event: flow.Event, name: str) -> list[bool] | None:
    """For an if: whether `name` isn't zero where it holds and where it fails."""
    x = event.tree
    if event.kind != "if_cond" or x is None:
        return None
    yes = no = False
    for y in x.walk():
        if y.kind == "binary" and y.text in ("!=", "==", ">", "<"):
            for one, other, op in ((*y.parts, y.text), (y.parts[1], y.parts[0], FLIPPED.get(y.text, y.text))):
                if one.kind == "name" and one.text == name and other.kind == "constant" and number(other.text) == 0:
                    yes |= op != "=="
                    no |= op == "=="
    if x.kind == "name" and x.text == name:
        yes = True
    if x.kind == "unary" and x.text == "!" and x.parts[0].kind == "name" and x.parts[0].text == name:
        no = True
    return [yes, no and not yes] if yes or no else None


def call_rows(body: Node) -> list[dict]:
    """Calls in source order; after_else: for a call in an else branch, lines of the calls in the condition and the other branch."""
    out: list[dict] = []

    def visit(x: Node | None, target: str | None, before: tuple[int, ...]) -> None:
        if x is None:
            return
        if x.kind == "call":
            out.append({"idx": len(out), "callee": flow.callee(x), "line": x.line, "raw_args": ", ".join(map(show, x.parts[1:])), "args": [show(a) for a in x.parts[1:]], "target": target, "after_else": sorted(before)})
        if x.kind == "sizeof":
            out.append({"idx": len(out), "callee": "sizeof", "line": x.line, "raw_args": show(x.parts[0]) if x.parts else str(x.extra), "args": [show(x.parts[0]) if x.parts else str(x.extra)], "target": target, "after_else": sorted(before)})
        if x.kind == "if":
            visit(x.parts[0], None, before)
            visit(x.parts[1], None, before)
            tested = tuple(y.line for part in x.parts[:2] for y in flow.calls(part))
            visit(x.parts[2], None, (*before, *tested))
            return
        if x.kind == "assign":
            visit(x.parts[0], target, before)
            visit(x.parts[1], show(x.parts[0]), before)
            return
        if x.kind == "declare":
            for layer in x.extra["type"].layers:
                if layer[0] == "[]":
                    visit(layer[1], None, before)
            target = x.text
        for part in x.parts:
            visit(part, target if x.kind not in ("block", "while", "do", "for", "switch", "return") else None, before)

    visit(body, None, ())
    return out


def linear_events(body: Node) -> list[dict]:
    """kind, line, reads in source order: what comes after a statement in the text."""
    out = []

    def add(kind: str, x: Node, reads: set[str]) -> None:
        out.append({"kind": kind, "line": x.line, "reads": sorted(reads)})

    for x in body.walk():
        if x.kind == "declare":
            add("decl", x, flow.names(x.parts[0]))
        elif x.kind == "assign":
            add("assignment", x, flow.names(x.parts[1]))
        elif x.kind == "call":
            add("memset" if flow.callee(x) == "memset" else "call", x, set().union(*map(flow.names, x.parts[1:])) if len(x.parts) > 1 else set())
        elif x.kind in ("if", "while"):
            add(f"{x.kind}_cond", x, flow.names(x.parts[0]))
        elif x.kind == "for":
            add("for_cond", x, flow.names(x.parts[-3]))
        elif x.kind == "return":
            add("return", x, flow.names(x.parts[0]))
    return out


def casts(body: Node) -> list[dict]:
    return [
        {"line": x.line, "type": str(x.extra), "is_pointer": x.extra.is_pointer, "is_function_pointer": x.extra.is_function_pointer, "names": sorted(flow.names(x.parts[0]))}
        for x in body.walk()
        if x.kind == "cast"
    ]


def sizeofs(body: Node) -> list[dict]:
    return [{"line": x.line, "name": x.parts[0].text} for x in body.walk() if x.kind == "sizeof" and x.parts and x.parts[0].kind == "name"]


def control_statements(clean: str) -> list[dict]:
    """keyword, line, column, has_brace of if, else, for, while and do; `else if` and the tail of a do aren't statements of their own."""
    source = [t for t in tokens(without_directives(clean)) if t.kind != "line"]
    out, opened, tails = [], [], set()
    # which `while` closes a do: the one after the statement that follows the do
    for k, t in enumerate(source):
        if t.text == "{":
            opened.append(k)
        elif t.text == "}" and opened:
            begin = opened.pop()
            if begin and source[begin - 1].text == "do" and k + 1 < len(source) and source[k + 1].text == "while":
                tails.add(k + 1)
    for k, t in enumerate(source):
        if t.kind != "word" or t.text not in KEYWORDS or k in tails or k and source[k - 1].text in (".", "->"):
            continue
        after = k + 1
        if t.text in ("if", "for", "while"):
            if after >= len(source) or source[after].text != "(":
                continue
            depth = 0
            while after < len(source):
                depth += source[after].text == "("
                depth -= source[after].text == ")"
                after += 1
                if depth == 0:
                    break
        following = source[after].text if after < len(source) else ""
        if t.text == "else" and following == "if":
            continue
        if t.text == "while" and following == ";" and k and (source[k - 1].text == ";" and any(s.text == "do" for s in source[max(0, k - 60) : k]) and _bare_do(source, k)):
            continue
        out.append({"keyword": t.text, "line": t.line, "column": t.column, "has_brace": following == "{"})
    return out


def _bare_do(source: list[Token], at: int) -> bool:
    """Whether the statement that ends before `at` follows a do directly."""
    k = at - 2
    while k >= 0 and source[k].text not in (";", "{", "}"):
        if source[k].text == "do":
            return True
        k -= 1
    return False


def switches(clean: str) -> list[dict]:
    """line, has_default of each switch; a nested one's default is its own."""
    source = [t for t in tokens(without_directives(clean)) if t.kind != "line"]
    out: list[dict] = []
    open_: list[dict | None] = []
    waiting: dict | None = None
    depth = 0
    for k, t in enumerate(source):
        if t.text == "switch" and t.kind == "word" and k + 1 < len(source) and source[k + 1].text == "(":
            waiting, depth = {"line": t.line, "column": t.column, "has_default": False}, 0
        elif waiting is not None and t.text in "()":
            depth += 1 if t.text == "(" else -1
        elif t.text == "{":
            open_.append(waiting if depth == 0 else None)
            if waiting is not None and depth == 0:
                out.append(waiting)
                waiting = None
        elif t.text == "}" and open_:
            open_.pop()
        elif t.text == "default" and t.kind == "word" and k + 1 < len(source) and source[k + 1].text == ":":
            inner = next((x for x in reversed(open_) if x is not None), None)
            if inner is not None:
                inner["has_default"] = True
    return out
