"""Outbound events of one Go file: where the protocol's literals stand, calls with their arguments, message bodies.

Arguments are described, not evaluated: a text is a list of parts (literal, named constant, own parameter), a value is
the names and parameters it is made of. operators.events carries them from callee to caller.
"""

from __future__ import annotations

from ripplegraph.sources.golang import Node

# The literals that mark the broadcast protocol, and the names by which a message is put together.
SCHEME, ENDPOINT = "broadcast://", "/broadcast/send"
EVENT_FIELD, BODY_FIELD, EVENT_METHOD = "Event", "Body", "Event"


def anchors(x: Node | None) -> tuple[bool, bool]:
    """Whether the scheme and the endpoint stand below a node as whole literals."""
    if x is None:
        return False, False
    texts = {c.text[1:-1] for c in [x, *x.walk()] if c.kind == "lit" and c.lit in ("str", "raw")}
    return SCHEME in texts, ENDPOINT in texts


class FunctionEvents:
    """The calls and message bodies of one function. Locals stand for their value where they are assigned once."""

    def __init__(self, facts, function: Node, nodes: list[Node]):
        self.facts, self.function, self.nodes = facts, function, nodes
        names = [n for f in function.params for n in (f.names or [""])]
        self.params = {n: i for i, n in enumerate(names) if n}
        types = [facts.named(f.type) for f in function.params for _ in (f.names or [""])]
        self.types = {n: {"pkg": t["type_package"], "name": t["type_name_of"]} for n, t in zip(names, types) if n and t}
        given: dict[str, list] = {}
        for s in nodes:
            if s.kind == "assign":
                for i, left in enumerate(s.left):
                    if left.kind == "ident":
                        given.setdefault(left.name, []).append(s.right[i] if len(s.left) == len(s.right) else None)
            elif s.kind == "declstmt":
                for d in s.decls:
                    if d.kind in ("var", "const"):
                        for i, n in enumerate(d.names):
                            given.setdefault(n.name, []).append(d.values[i] if i < len(d.values) else None)
        self.locals = {n: values[0] if len(values) == 1 else None for n, values in given.items()}

    def parts(self, x: Node, open_: frozenset = frozenset()) -> list[dict] | None:
        """A text as its parts in order; None where one isn't known."""
        if x.kind == "paren":
            return self.parts(x.x, open_)
        if x.kind == "call" and x.fun.kind == "ident" and x.fun.name == "string" and len(x.args) == 1:
            return self.parts(x.args[0], open_)
        if x.kind == "ident":
            if x.name in self.locals:
                value = self.locals[x.name]
                return self.parts(value, open_ | {x.name}) if value is not None and x.name not in open_ else None
            if x.name in self.params:
                return [{"text": None, "pkg": None, "name": None, "param": self.params[x.name]}]
        if x.kind == "binary" and x.op == "+":
            a, b = self.parts(x.x, open_), self.parts(x.y, open_)
            return a + b if a is not None and b is not None else None
        if x.kind == "binary":
            return None
        found = self.facts.path_parts(x)
        return [{**p, "param": None} for p in found] if found is not None else None

    def made_of(self, x: Node | None, open_: frozenset = frozenset()) -> tuple[list[dict], list[int]]:
        """Names outside the function, parameters' types among them, and parameters that a value is made of."""
        deps, params = [], []

        def visit(c: Node) -> None:
            if c.kind == "selector" and c.x.kind == "ident" and c.x.name in self.facts.imports:
                deps.append({"pkg": self.facts.imports[c.x.name], "name": c.name})
            elif c.kind == "selector":
                visit(c.x)
            elif c.kind == "keyvalue":
                visit(c.value)
            elif c.kind != "ident":
                for k in c.children():
                    visit(k)
            elif c.name in self.locals:
                value = self.locals[c.name]
                if value is not None and c.name not in open_:
                    d, p = self.made_of(value, open_ | {c.name})
                    deps.extend(d)
                    params.extend(p)
            elif c.name in self.params:
                params.append(self.params[c.name])
                deps.extend([self.types[c.name]] if c.name in self.types else [])
            else:
                deps.append({"pkg": self.facts.package, "name": c.name})

        if x is not None:
            visit(x)
        return [dict(t) for t in sorted({tuple(sorted(d.items())) for d in deps})], sorted(set(params))

    def controls(self, x: Node) -> list[dict]:
        """Names in the conditions around a node."""
        around = [c for c in self.nodes if c.kind in ("if", "switch") and c.start <= x.start and x.end <= c.end]
        return [d for c in around for h in c.f.get("head", []) for d in self.made_of(h)[0]]

    def field(self, x: Node, name: str) -> Node | None:
        """The value of a field in a composite literal, or in a local's one value."""
        if x.kind == "unary":
            return self.field(x.x, name)
        if x.kind == "ident" and (value := self.locals.get(x.name)) is not None and value is not x:
            return self.field(value, name) if value.kind != "ident" else None
        if x.kind == "composite":
            return next((e.value for e in x.elements if e.kind == "keyvalue" and e.key.kind == "ident" and e.key.name == name), None)
        return None

    def emit(self) -> None:
        f, own = self.facts, self.function.symbol
        for x in self.nodes:
            if x.kind == "call":
                self.call(x)
            elif x.kind == "assign":
                for left, right in zip(x.left, x.right):
                    if left.kind == "ident" and (body := self.field(right, BODY_FIELD)) is not None:
                        deps, params = self.made_of(body)
                        f.row("event_bodies", function=own, variable=left.name, position=x.start, deps=deps, params=params)

    def call(self, x: Node) -> None:
        f, fun = self.facts, x.fun.x if x.fun.kind == "index" else x.fun
        common = dict(function=self.function.symbol, position=x.start, controls=self.controls(x), file=f.path, **f.span(x))
        if fun.kind == "ident" and fun.name not in self.locals and fun.name not in self.params:
            callee = f"func:{f.package}::{fun.name}"
        elif fun.kind == "selector" and fun.x.kind == "ident" and fun.x.name in f.imports:
            callee = f"func:{f.imports[fun.x.name]}::{fun.name}"
        else:
            if fun.kind == "selector" and fun.name == EVENT_METHOD and len(x.args) == 1 and fun.x.kind == "ident":
                f.row("event_emits", variable=fun.x.name, parts=self.parts(x.args[0]), raw=f.raw(x.args[0]), **common)
            return
        args = []
        for a in x.args:
            deps, params = self.made_of(a)
            args.append({"parts": self.parts(a), "deps": deps, "params": params, "raw": f.raw(a)})
        named = next(((i, v) for i, a in enumerate(x.args) if (v := self.field(a, EVENT_FIELD)) is not None), None)
        f.row("event_calls", id=f"{f.path}:{x.start}", callee=callee, args=args, event_at=named and named[0], event_parts=named and self.parts(named[1]), event_raw=named and f.raw(named[1]), **common)
