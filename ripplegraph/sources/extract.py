"""Facts of one Go file: declarations, mentions of names with what is known of their scope, and route events.

A file is read by itself. What needs other files (does this name exist, what does that constructor return) is left
to joins over the rows of all files: a mention carries its names, the import path of the first one, and the types
that its scope gives the first one.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from ripplegraph.sources import events, golang
from ripplegraph.sources.golang import Node, selector_parts

# Names that syntax rules go by.
HTTP_METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")
HANDLER_WRAPPERS = ("controllerwithreqresp", "appcontrollerwithreqresp", "controllerwithresp", "controller", "middlewarecontroller")
GROUP_WRAPPER_PREFIXES, GROUP_WRAPPER_PARTS = ("add",), ("guard", "validator")
GROUP_FACTORY_PREFIXES, GROUP_FACTORY_PART = ("create", "new", "build"), "group"
ROOT_TYPE, ROOT_SUFFIX = "Engine", "Group"
SERVER_REGISTRATION = re.compile(r"^Register(\w+)Server$")
CONFIG_SUFFIX, SETTER, MAPPER = "ServiceConfig", "SetProviderService", "MethodMapper"
TASK_TYPES, TASK_PACKAGES = ("JobListener", "TaskFunc"), ("jobx", "xxljob")


def import_name(path: str) -> str:
    parts = path.split("/")
    last = parts[-1]
    return parts[-2] if len(parts) > 1 and last[:1] == "v" and last[1:].isdigit() else last


def text_of(s: str) -> str:
    return s.encode("latin-1").decode("utf-8", "replace")


class FileFacts:
    """Collects rows as (relation, fields)."""

    def __init__(self, path: str, package: str, content: bytes):
        self.path, self.package, self.rows, self.n = path, package, [], 0
        self.parser, self.tree = golang.parse(content)
        self.imports, self.in_package = {}, set()
        self.consts = {}
        for d in self.tree.decls:
            if d.kind == "import":
                alias = d.alias or import_name(d.path)
                self.imports[alias] = d.path
                self.row("imports", file=path, alias=alias, import_path=d.path, **self.span(d))
        for d in self.tree.decls:
            self.declare(d)
        for d in self.tree.decls:
            self.explore(d)

    # Rows

    def row(self, relation: str, **fields) -> None:
        self.rows.append((relation, fields))

    def span(self, x: Node, prefix: str = "") -> dict:
        return self.between(x.start, x.end, prefix)

    def between(self, start: int, end: int, prefix: str = "") -> dict:
        (sl, sc), (el, ec) = self.parser.place(start), self.parser.place(end)
        return {prefix + "sl": sl, prefix + "sc": sc, prefix + "el": el, prefix + "ec": ec}

    def raw(self, x: Node) -> str:
        return text_of(self.parser.src[x.start : x.end])

    # Declarations

    def symbol(self, kind: str, receiver: str, name: str, x: Node) -> str:
        given = text_of(name)
        if given == "_" or given == "init" and kind == "func":
            given = f"{given}#{self.path}:{self.parser.place(x.start)[0]}"
        out = f"{kind}:{self.package}:{receiver}:{given}"
        self.row("symbols", id=out, kind=kind, package_path=self.package, receiver=receiver or None, name=text_of(name), file=self.path, **self.span(x))
        return out

    def declare(self, d: Node) -> None:
        if d.kind == "func":
            receiver = text_of(type_name(d.recv.type) or "") if d.recv else ""
            d.f["symbol"] = self.symbol("method" if receiver else "func", receiver, d.name, d)
            if d.results:
                self.type_row("returns", d.results[0].type, id=d.symbol)
            self.comments_of(d)
            self.shape_of(d)
        elif d.kind == "type":
            d.f["symbol"] = self.symbol("type", "", d.name, d)
            if d.type.kind == "struct":
                for f in d.type.fields:
                    for name in f.names or [type_name(f.type)]:
                        if name:
                            self.type_row("fields", f.type, package_path=self.package, type_name=text_of(d.name), field=text_of(name))
                    if not f.names:
                        self.type_row("embeds", f.type, package_path=self.package, type_name=text_of(d.name))
            elif d.type.kind == "interface":
                self.row("interfaces", id=d.symbol)
        elif d.kind in ("var", "const"):
            self.in_package |= {n.name for n in d.names}
            for i, n in enumerate(d.names):
                d.f.setdefault("symbols", []).append(self.symbol(d.kind, "", n.name, d))
                value = d.values[i] if i < len(d.values) else d.values[0] if len(d.values) == 1 else None
                if d.kind == "const" and value is not None:
                    self.row("consts", package_path=self.package, name=text_of(n.name), parts=self.path_parts(value))
                self.elements(n.name, value)
                scheme, endpoint = events.anchors(value)
                if scheme or endpoint:
                    self.row("event_anchors", id=d.symbols[i], scheme=scheme, endpoint=endpoint)
                for t in self.value_types(d.type, value):
                    self.row("values", package_path=self.package, var_name=text_of(n.name), **t)

    def elements(self, name: str, value: Node | None) -> None:
        """What the values of a map literal are, one by one; of some nothing is known."""
        if value is None or value.kind != "composite" or value.type is None or value.type.kind != "map":
            return
        for i, e in enumerate(value.elements):
            own = e.value if e.kind == "keyvalue" else e
            types = self.value_types(value.type.x if own.kind == "composite" and own.type is None else None, own)
            self.row("elements", package_path=self.package, var_name=text_of(name), ordinal=i, **(types[0] if types else {"type_package": None, "type_name_of": None, "maker": None}))

    def type_row(self, relation: str, t: Node, **fields) -> None:
        found = self.named(t)
        if found:
            self.row(relation, **fields, **found)

    def named(self, t: Node | None) -> dict | None:
        """Package and name of a type expression without pointers and type arguments."""
        while t is not None and t.kind in ("star", "paren", "index", "ellipsis"):
            t = t.x
        if t is None:
            return None
        if t.kind == "ident":
            return {"type_package": self.package, "type_name_of": text_of(t.name), "maker": None}
        if t.kind == "selector" and t.x.kind == "ident" and t.x.name in self.imports:
            return {"type_package": self.imports[t.x.name], "type_name_of": text_of(t.name), "maker": None}
        return None

    def value_types(self, t: Node | None, value: Node | None) -> list[dict]:
        """What is known of the type of a variable: a named type, or the function that makes it."""
        if t is not None:
            return [x for x in [self.named(t)] if x]
        while value is not None and (value.kind == "paren" or value.kind == "unary" and value.op == "&"):
            value = value.x
        if value is None:
            return []
        if value.kind == "composite" and value.type is not None:
            return [x for x in [self.named(value.type)] if x]
        if value.kind == "call":
            fun = value.fun.x if value.fun.kind == "index" else value.fun
            if fun.kind == "ident" and fun.name == "new" and value.args:
                return [x for x in [self.named(value.args[0])] if x]
            if fun.kind == "ident":
                return [{"type_package": self.package, "type_name_of": text_of(fun.name), "maker": f"func:{self.package}::{text_of(fun.name)}"}]
            if fun.kind == "selector" and fun.x.kind == "ident" and fun.x.name in self.imports:
                return [{"type_package": self.imports[fun.x.name], "type_name_of": text_of(fun.name), "maker": f"func:{self.imports[fun.x.name]}::{text_of(fun.name)}"}]
        return []

    def shape_of(self, d: Node) -> None:
        """Whether a method has the shape of a unary remote handler, and what a function's returns make."""
        params = [f.type for f in d.params for _ in (f.names or [""])]
        results = [f.type for f in d.results for _ in (f.names or [""])]
        first = params[0] if params else None
        context = first is not None and first.kind == "selector" and first.name == "Context"
        unary = len(params) == 2 and context and len(results) == 2 and results[1].kind == "ident" and results[1].name == "error"
        if d.recv and d.name[:1].isupper():
            self.row("shapes", id=d.symbol, package_path=self.package, receiver=text_of(type_name(d.recv.type) or ""), name=text_of(d.name), unary=unary)
        if d.recv and d.name == MAPPER and d.body:
            for x in d.body.walk():
                if x.kind == "keyvalue" and x.key.kind == "lit" and x.value.kind == "lit":
                    self.row("method_names", package_path=self.package, receiver=text_of(type_name(d.recv.type) or ""), go_method=text_of(x.key.text[1:-1]), name=text_of(x.value.text[1:-1]))
        if d.body and d.results:
            for x in own_nodes(d.body):
                if x.kind == "return" and x.values:
                    types = self.value_types(None, x.values[0])
                    self.row("made", id=d.symbol, **(types[0] if types else {"type_package": None, "type_name_of": None, "maker": None}))

    def comments_of(self, d: Node) -> None:
        """The comment lines right above a function, as possible annotations."""
        line = self.parser.place(d.start)[0]
        above, want = [], line - 1
        by_line = {self.parser.place(at)[0]: (at, c) for at, c in self.parser.comments if c.startswith("//")}
        while want in by_line:
            above.append(by_line[want])
            want -= 1
        for i, (at, c) in enumerate(reversed(above)):
            self.row("comments", handler_symbol=d.symbol, ordinal=i, raw=text_of(c), file=self.path, **self.between(at, at + len(c)))

    # Mentions

    def mention(self, source: str, role: str, x: Node, scope: Scope | None, group: int | None = None, whole: Node | None = None, parts: list[str] | None = None, owner: str | None = None) -> None:
        parts = parts or selector_parts(x)
        if not parts:
            return
        found = scope.find(parts[0]) if scope else None
        types = found if found is not None else []
        self.n += 1
        self.row(
            "mentions", n=self.n, from_symbol=source, role=role, owner=owner, package_path=self.package, file=self.path, imported=self.imports.get(parts[0]), parts=[text_of(p) for p in parts],
            is_local=found is not None, types=types, raw=self.raw(x), group=group if group is not None else self.n, **self.span(x), **self.span(whole or x, "w"),
        )

    def types_in(self, t: Node | None) -> Iterable[Node]:
        """The type names in a type expression, in order."""
        if t is None:
            return
        if t.kind == "ident" or t.kind == "selector":
            yield t
        elif t.kind in ("star", "paren", "array", "chan", "ellipsis"):
            yield from self.types_in(t.x)
        elif t.kind == "map":
            yield from self.types_in(t.key)
            yield from self.types_in(t.x)
        elif t.kind == "index":
            yield from self.types_in(t.x)
            for a in t.args:
                yield from self.types_in(a)
        elif t.kind in ("struct", "interface"):
            for f in t.fields:
                yield from self.types_in(f.type)
        elif t.kind == "functype":
            for f in [*t.params, *t.results]:
                yield from self.types_in(f.type)
        elif t.kind == "union":
            for x in t.types:
                yield from self.types_in(x)

    def mention_types(self, source: str, t: Node | None) -> None:
        group = self.n + 1
        for x in self.types_in(t):
            self.mention(source, "type", x, None, group)

    def explore(self, d: Node) -> None:
        if d.kind == "type":
            self.mention_types(d.symbol, d.type)
        elif d.kind in ("var", "const"):
            for source in d.symbols:
                self.mention_types(source, None if d.carried else d.type)
                for v in [] if d.carried else d.values:
                    self.expression(source, v, Scope())
        elif d.kind == "func":
            scope = Scope()
            for f in [*([d.recv] if d.recv else []), *d.tparams, *d.params, *d.results]:
                self.mention_types(d.symbol, f.type)
            for f in [*([d.recv] if d.recv else []), *d.params, *d.results]:
                for name in f.names:
                    scope.add(name, [x for x in [self.named(f.type)] if x])
            if d.body:
                self.statements(d.symbol, d.body.body, scope.inner())
                self.route_events(d)
                self.services(d, scope)
                scheme, endpoint = events.anchors(d.body)
                if scheme or endpoint:
                    self.row("event_anchors", id=d.symbol, scheme=scheme, endpoint=endpoint)
                events.FunctionEvents(self, d, list(own_nodes(d.body))).emit()

    def expression(self, source: str, x: Node | None, scope: Scope) -> None:
        if x is None:
            return
        k = x.kind
        if k == "ident":
            if scope.find(x.name) is None:
                self.mention(source, "value", x, scope)
        elif k == "selector":
            self.mention(source, "value", x, scope)
            if any(c.kind == "call" for c in x.x.walk()):
                self.expression(source, x.x, scope)
        elif k == "call":
            fun = x.fun
            if fun.kind == "index":
                for a in fun.args:
                    self.mention_types(source, a)
                fun = fun.x
            self.mention(source, "call", fun, scope, whole=x, parts=indexed_parts(fun))
            if fun.kind == "selector":
                self.mention(source, "receiver", fun, scope)
                if any(c.kind == "call" for c in fun.x.walk()):
                    self.expression(source, fun.x, scope)
            elif fun.kind in ("paren", "array", "map", "star"):
                self.mention_types(source, fun)
            elif fun.kind != "ident":
                self.expression(source, fun, scope)
            for a in x.args:
                self.expression(source, a, scope)
        elif k == "composite":
            self.mention_types(source, x.type)
            for e in x.elements:
                self.expression(source, e, scope)
        elif k == "keyvalue":
            if x.key.kind != "ident":
                self.expression(source, x.key, scope)
            self.expression(source, x.value, scope)
        elif k == "funclit":
            inner = scope.inner()
            for f in [*x.params, *x.results]:
                for name in f.names:
                    inner.add(name, [t for t in [self.named(f.type)] if t])
            self.statements(source, x.body.body, inner.inner())
        elif k in ("array", "map", "struct", "interface", "functype", "chan"):
            return
        else:
            for c in x.children():
                self.expression(source, c, scope)

    def statements(self, source: str, body: list[Node], scope: Scope) -> None:
        for s in body:
            self.statement(source, s, scope)

    def statement(self, source: str, s: Node | None, scope: Scope) -> None:
        if s is None:
            return
        k = s.kind
        if k == "assign":
            for v in s.right:
                self.expression(source, v, scope)
            for i, left in enumerate(s.left):
                if s.op == ":=" and left.kind == "ident":
                    scope.add(left.name, self.value_types(None, s.right[i] if len(s.right) == len(s.left) else s.right[0] if i == 0 else None))
                else:
                    self.expression(source, left, scope)
        elif k == "range":
            self.expression(source, s.right[0], scope)
            for left in s.left:
                if s.op == ":=" and left.kind == "ident":
                    scope.add(left.name, [])
                else:
                    self.expression(source, left, scope)
        elif k == "declstmt":
            for d in s.decls:
                if d.kind in ("var", "const"):
                    for v in [] if d.carried else d.values:
                        self.expression(source, v, scope)
                    for i, n in enumerate(d.names):
                        scope.add(n.name, self.value_types(d.type, d.values[i] if i < len(d.values) else None))
        elif k == "block":
            self.statements(source, s.body, scope.inner())
        elif k == "if":
            inner = scope.inner()
            for h in s.head:
                self.statement(source, h, inner)
            self.statement(source, s.then, inner)
            self.statement(source, s.other, inner)
        elif k == "for":
            inner = scope.inner()
            for h in s.head:
                self.statement(source, h, inner)
            self.statement(source, s.body, inner)
        elif k in ("switch", "select"):
            inner = scope.inner()
            for h in s.f.get("head", []):
                self.statement(source, h, inner)
            for c in s.cases:
                own = inner.inner()
                for g in c.guards:
                    self.statement(source, g, own) if k == "select" else self.expression(source, g, own)
                self.statements(source, c.body, own)
        elif k == "label":
            self.statements(source, s.body, scope)
        else:
            for c in s.children():
                self.expression(source, c, scope)

    # Services

    def services(self, d: Node, scope: Scope) -> None:
        """Registrations of remote services, provider configurations and jobs in a function."""
        local = {}
        for s in own_nodes(d.body):
            if s.kind == "assign":
                for left, right in zip(s.left, s.right):
                    if left.kind == "ident":
                        local[left.name] = self.value_types(None, right)
        tasks = {name for f in d.params for name in f.names if task_map(f.type)}
        for x in own_nodes(d.body):
            fun = x.fun.x if x.kind == "call" and x.fun.kind == "index" else x.f.get("fun")
            name = last_name(fun) if fun is not None else None
            if x.kind == "call" and name and (m := SERVER_REGISTRATION.match(name)) and len(x.args) == 2:
                imported = self.imports.get(fun.x.name) if fun.kind == "selector" and fun.x.kind == "ident" else self.package
                if imported:
                    own = f"{self.path}:{x.start}"
                    self.row("server_registrations", id=own, service_package=imported, service=text_of(m[1]), register_function=text_of(name), registration_symbol=d.symbol, file=self.path, **self.span(x))
                    for t in self.made_in(x.args[1], local, scope):
                        self.row("server_candidates", id=own, **t)
            elif x.kind == "call" and name == SETTER and x.args:
                own = f"{self.path}:{x.start}"
                self.row("provider_setters", function=d.symbol, id=own, position=x.start)
                for t in self.made_in(x.args[0], local, scope):
                    self.row("setter_candidates", id=own, **t)
            elif x.kind == "composite" and x.type is not None and (type_name(x.type) or "").endswith(CONFIG_SUFFIX):
                self.provider_config(d, x)
            elif x.kind == "assign" and x.left[0].kind == "index" and x.left[0].x.kind == "ident" and x.left[0].x.name in tasks and x.left[0].args[0].kind == "lit":
                job = text_of(x.left[0].args[0].text[1:-1])
                own = f"job:{d.symbol}:{job}"
                self.row("job_registrations", id=own, name=job, registration_symbol=d.symbol, file=self.path, **self.span(x))
                self.mention(d.symbol, "handler", x.right[0], scope, owner=own)

    def made_in(self, x: Node, local: dict, scope: Scope) -> Iterable[dict]:
        """Types and makers that an argument may hold: literals, constructors (called or named), variables."""
        if x.kind == "ident":
            yield from local.get(x.name) or scope.find(x.name) or [{"type_package": self.package, "type_name_of": text_of(x.name), "maker": f"value:{self.package}::{text_of(x.name)}"}]
        elif x.kind == "selector" and x.x.kind == "ident" and x.x.name in self.imports:
            yield {"type_package": self.imports[x.x.name], "type_name_of": text_of(x.name), "maker": f"value:{self.imports[x.x.name]}::{text_of(x.name)}"}
        elif x.kind in ("paren", "unary"):
            yield from self.made_in(x.x, local, scope)
        elif x.kind == "composite":
            yield from self.value_types(None, x)
        elif x.kind == "call":
            yield from self.value_types(None, x)
            for a in x.args:
                yield from self.made_in(a, local, scope)

    def provider_config(self, d: Node, x: Node) -> None:
        given = {e.key.name: e.value for e in x.elements if e.kind == "keyvalue" and e.key.kind == "ident"}
        interface, version = given.get("Interface"), given.get("Version")
        if interface is None or interface.kind != "lit":
            return
        literal = version is not None and version.kind == "lit"
        methods = [e.value for m in [given.get("Methods")] if m is not None for e in m.walk() if e.kind == "keyvalue" and e.key.kind == "ident" and e.key.name == "Name" and e.value.kind == "lit"]
        self.row(
            "provider_configs", function=d.symbol, id=f"{self.path}:{x.start}", position=x.end, interface=text_of(interface.text[1:-1]), version=text_of(version.text[1:-1]) if literal else None,
            version_expression=self.raw(version) if version is not None and not literal else None, methods=[text_of(m.text[1:-1]) for m in methods], file=self.path, **self.span(x),
        )

    # Routes

    def path_parts(self, x: Node) -> list[dict] | None:
        """A path expression as literals and constants in order; None for anything else."""
        if x.kind == "paren":
            return self.path_parts(x.x)
        if x.kind == "lit" and x.lit in ("str", "raw"):
            body = text_of(x.text)
            return [{"text": body[1:-1] if x.lit == "raw" else json.loads(body) if "\\" in body and _plain(body) else body[1:-1], "pkg": None, "name": None}]
        if x.kind == "ident":
            return [{"text": None, "pkg": self.package, "name": text_of(x.name)}]
        if x.kind == "selector" and x.x.kind == "ident" and x.x.name in self.imports:
            return [{"text": None, "pkg": self.imports[x.x.name], "name": text_of(x.name)}]
        if x.kind == "binary" and x.op == "+":
            left, right = self.path_parts(x.x), self.path_parts(x.y)
            return left + right if left is not None and right is not None else None
        return None

    def route_events(self, d: Node) -> None:
        Routes(self, d).run()


def _plain(body: str) -> bool:
    try:
        json.loads(body)
        return True
    except ValueError:
        return False


class Scope:
    """Names of a block and of those around it, with what is known of their types."""

    def __init__(self, outer: Scope | None = None):
        self.names, self.outer = {}, outer

    def inner(self) -> Scope:
        return Scope(self)

    def add(self, name: str, types: list[dict]) -> None:
        if name != "_":
            self.names[name] = types

    def find(self, name: str) -> list[dict] | None:
        return self.names[name] if name in self.names else self.outer.find(name) if self.outer else None


def own_nodes(x: Node) -> Iterable[Node]:
    """All nodes below, but for those of functions inside."""
    for c in x.children():
        if c.kind != "funclit":
            yield c
            yield from own_nodes(c)


def indexed_parts(x: Node) -> list[str] | None:
    """The names of a chain through an element, `m[k].F`, as m, [] and F; None for any other."""
    names = []
    while x.kind == "selector":
        names.append(x.name)
        x = x.x
    base = selector_parts(x.x) if x.kind == "index" and names else None
    return [*base, "[]", *reversed(names)] if base else None


def task_map(t: Node) -> bool:
    """Whether a type is a map from names to task functions."""
    return t.kind == "map" and t.x.kind == "selector" and t.x.name in TASK_TYPES and t.x.x.kind == "ident" and t.x.x.name in TASK_PACKAGES


def type_name(t: Node) -> str | None:
    while t.kind in ("star", "paren", "index", "ellipsis"):
        t = t.x
    return t.name if t.kind in ("ident", "selector") else None


class Routes:
    """The route events of one function, in order: groups, routes, middleware, and groups handed to other functions.

    A variable's group is known by block, so a group made in a branch ends with it. Events count up through the
    whole function.
    """

    def __init__(self, facts: FileFacts, d: Node):
        self.facts, self.d, self.func, self.count = facts, d, d.symbol, 0

    def run(self) -> None:
        groups, place = {}, 0
        self.scope = Scope()
        for f in [*([self.d.recv] if self.d.recv else []), *self.d.params]:
            for name in f.names:
                self.scope.add(name, [x for x in [self.facts.named(f.type)] if x])
        for f in self.d.params:
            root = (type_name(f.type) or "") if f.type.kind != "functype" else ""
            for name in f.names or ["_"]:
                if root == ROOT_TYPE or root.endswith(ROOT_SUFFIX):
                    own = f"{self.func}::{text_of(name)}"
                    groups[name] = own
                    self.facts.row("route_parameters", callee=self.func, position=place, group_id=own)
                place += 1
        self.body(self.d.body.body, groups)

    def next(self) -> int:
        self.count += 1
        return self.count

    def body(self, statements: list[Node], groups: dict) -> None:
        for s in statements:
            self.event(s, groups)

    def event(self, s: Node | None, groups: dict) -> None:
        if s is None:
            return
        if s.kind == "assign":
            for left, right in zip(s.left, s.right):
                if left.kind == "ident" and s.op == ":=":
                    self.scope.add(left.name, self.facts.value_types(None, right))
                if left.kind == "ident" and (made := self.made_group(right, groups)):
                    self.add_group(s, left.name, right, made, groups)
                else:
                    self.calls(right, groups)
        elif s.kind == "exprstmt" or s.kind in ("go", "defer"):
            self.calls(s.x, groups)
        elif s.kind == "return":
            for i, v in enumerate(s.values):
                if i == 0 and v.kind == "ident" and v.name in groups:
                    self.facts.row("route_returns", callee=self.func, group_id=groups[v.name])
                self.calls(v, groups)
        elif s.kind == "block":
            self.body(s.body, groups)
        elif s.kind in ("if", "for", "switch", "select"):
            inner = dict(groups)
            for h in s.f.get("head", []):
                self.event(h, inner)
            for part in (s.f.get("then"), s.f.get("other"), s.f.get("body")):
                self.event(part, dict(inner))
            for c in s.f.get("cases", []):
                own = dict(inner)
                if s.kind == "select":
                    self.body(c.guards, own)
                self.body(c.body, own)
        elif s.kind == "label":
            self.body(s.body, groups)

    def made_group(self, x: Node, groups: dict) -> tuple[str, list[dict] | None, str, list[Node], Node | None] | None:
        """Parent group, path parts, raw path, middleware and the called function of an expression that makes a group."""
        if x.kind != "call":
            return None
        name = last_name(x.fun)
        if x.fun.kind == "selector" and name == "Group" and x.args:
            parent = self.group_of(x.fun.x, groups)
            if parent:
                return parent, self.facts.path_parts(x.args[0]), self.facts.raw(x.args[0]), x.args[1:], None
            above = self.made_group(x.fun.x, groups)
            if above:
                own = self.facts.path_parts(x.args[0])
                parts = above[1] + [{"text": "/", "pkg": None, "name": None}] + own if above[1] is not None and own is not None else None
                return above[0], parts, f"{above[2]} {self.facts.raw(x.args[0])}", above[3] + x.args[1:], None
        low = (name or "").lower()
        if GROUP_FACTORY_PART in low and low.startswith(GROUP_FACTORY_PREFIXES) or low.startswith(GROUP_WRAPPER_PREFIXES) or any(p in low for p in GROUP_WRAPPER_PARTS):
            for a in x.args:
                if parent := self.group_of(a, groups):
                    return parent, [], "", [], x.fun
        return None

    def group_of(self, x: Node, groups: dict) -> str | None:
        """The group that an expression stands for: a variable, or a wrapper around one."""
        if x.kind == "ident":
            return groups.get(x.name)
        if x.kind == "call" and x.args:
            low = (last_name(x.fun) or "").lower()
            if low.startswith(GROUP_WRAPPER_PREFIXES) or any(p in low for p in GROUP_WRAPPER_PARTS):
                return self.group_of(x.args[0], groups)
        return None

    def add_group(self, s: Node, name: str, call: Node, made: tuple, groups: dict) -> None:
        parent, parts, raw, middleware, fun = made
        index = self.next()
        own = f"group:{self.func}:{text_of(name)}:{index}"
        groups[name] = own
        f = self.facts
        f.row("route_groups", id=own, group_var=text_of(name), parent_group_id=parent, prefix_parts=parts, prefix_raw=raw, route_func=self.func, statement_index=index, file=f.path, **f.span(s))
        if fun is not None and (callee := self.callee(fun)):
            self.hand_over(call, groups, callee)
            f.row("route_receivers", callee=callee, group_id=own)
        for m in middleware:
            self.add_middleware([m], own, text_of(name), s)

    def add_middleware(self, names: list[Node], group: str, var: str, s: Node) -> None:
        f, index = self.facts, self.next()
        own = f"middleware:{self.func}:{var}:{index}"
        f.row("middleware", id=own, group_id=group, group_var=var, middleware_raw=", ".join(f.raw(n) for n in names), route_func=self.func, statement_index=index, file=f.path, **f.span(s))
        for n in names:
            target = n.fun if n.kind == "call" else n
            f.mention(self.func, "middleware", target, self.scope, owner=own)

    def callee(self, fun: Node) -> str | None:
        parts = selector_parts(fun.x if fun.kind == "index" else fun)
        if parts and len(parts) == 1:
            return f"func:{self.facts.package}::{text_of(parts[0])}"
        if parts and len(parts) == 2 and parts[0] in self.facts.imports:
            return f"func:{self.facts.imports[parts[0]]}::{text_of(parts[1])}"
        return None

    def hand_over(self, x: Node, groups: dict, callee: str) -> None:
        for i, a in enumerate(x.args):
            if group := self.group_of(a, groups):
                self.facts.row("route_arguments", callee=callee, position=i, group_id=group, caller=self.func)

    def calls(self, x: Node, groups: dict) -> None:
        if x.kind != "call":
            return
        name = last_name(x.fun)
        if x.fun.kind == "selector":
            group = self.group_of(x.fun.x, groups)
            made = None if group else self.made_group(x.fun.x, groups)
            if name in HTTP_METHODS and len(x.args) >= 2 and (group or made):
                if made:
                    group = self.add_unnamed(x, made, groups)
                self.add_route(x, name, group, x.fun.x)
                return
            if name == "Use" and x.args and group:
                self.add_middleware(x.args, group, text_of(x.fun.x.name) if x.fun.x.kind == "ident" else "", x)
                return
        if callee := self.callee(x.fun):
            self.hand_over(x, groups, callee)

    def add_unnamed(self, x: Node, made: tuple, groups: dict) -> str:
        name = f"_{self.count + 1}"
        self.add_group(x, name, x.fun.x, made, groups)
        return groups.pop(name)

    def add_route(self, x: Node, method: str, group: str, receiver: Node) -> None:
        f, index = self.facts, self.next()
        handler, wrappers = self.unwrapped(x.args[1])
        outer, r = [], receiver
        while r.kind == "call" and r.args:
            outer.append({"name": text_of(last_name(r.fun) or ""), "raw": f.raw(r), "guessed": False})
            r = r.args[0]
        parts = f.path_parts(x.args[0])
        literal = "".join(p["text"] for p in parts) if parts is not None and all(p["text"] is not None for p in parts) else None
        own = f"route:{self.func}:{method}:{literal if literal is not None else f.raw(x.args[0])}:{index}"
        f.row(
            "routes", id=own, method=method, path_parts=parts, path_raw=None if literal is not None else f.raw(x.args[0]), group_id=group, group_var=text_of(r.name) if r.kind == "ident" else "", handler_raw=f.raw(handler),
            wrappers=outer + wrappers, route_func=self.func, statement_index=index, file=f.path, **f.span(x),
        )
        f.mention(self.func, "handler", handler, self.scope, owner=own)

    def unwrapped(self, x: Node) -> tuple[Node, list[dict]]:
        """The innermost handler, and the wrappers around it from outside in."""
        while x.kind == "paren":
            x = x.x
        if x.kind != "call" or not x.args or not (name := last_name(x.fun)):
            return x, []
        if name.lower() in HANDLER_WRAPPERS:
            inner, guessed = x.args[-1], False
        else:
            likely = [a for a in x.args if handler_like(a)]
            if not likely:
                return x, []
            inner, guessed = likely[-1], True
        found, wrappers = self.unwrapped(inner)
        return found, [{"name": text_of(name), "raw": self.facts.raw(x), "guessed": guessed}, *wrappers]


def last_name(fun: Node) -> str | None:
    fun = fun.x if fun.kind == "index" else fun
    return fun.name if fun.kind in ("ident", "selector") else None


def handler_like(x: Node) -> bool:
    while x.kind == "paren":
        x = x.x
    return x.kind in ("ident", "selector") or x.kind == "call" and bool(x.args)


def facts_of(path: str, package: str, content: bytes) -> list[tuple[str, dict]]:
    """All rows of a file; of one that can't be parsed, a diagnostic."""
    try:
        return FileFacts(path, package, content).rows
    except (golang.Unparsed, RecursionError) as e:
        return [("diagnostics", {"code": "package_load_failed", "severity": "error", "message": f"{path}: {e}", "file": path})]
