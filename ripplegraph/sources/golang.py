"""A tolerant parser of Go source files: tokens, declarations, statements and expressions with byte positions.

Nodes are plain objects with a kind, a start and an end offset, and fields by kind. The parser serves extraction:
it keeps what names, calls, types and scopes need, and raises Unparsed for text it can't follow.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator


class Unparsed(Exception):
    """The text is no Go that this parser follows; with the line."""


class Node:
    __slots__ = ("kind", "start", "end", "f")

    def __init__(self, kind: str, start: int, end: int, **fields):
        self.kind, self.start, self.end, self.f = kind, start, end, fields

    def __getattr__(self, name):
        try:
            return self.f[name]
        except KeyError:
            raise AttributeError(name) from None

    def children(self) -> Iterator[Node]:
        for v in self.f.values():
            if isinstance(v, Node):
                yield v
            elif isinstance(v, list):
                yield from (x for x in v if isinstance(x, Node))

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children():
            yield from c.walk()


_TOKEN = re.compile(
    r"""(?P<ws>[ \t\r]+)|(?P<nl>\n)|(?P<lc>//[^\n]*)|(?P<bc>/\*.*?\*/)|(?P<id>[A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*)"""
    r"""|(?P<num>0[xX][0-9A-Fa-f_]+|0[bBoO][0-9_]+|(?:[0-9][0-9_]*)?\.?[0-9][0-9_]*(?:\.[0-9_]*)?(?:[eE][+-]?[0-9_]+)?i?)"""
    r"""|(?P<raw>`[^`]*`)|(?P<str>"(?:[^"\\\n]|\\.)*")|(?P<chr>'(?:[^'\\\n]|\\.)+')"""
    r"""|(?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!~()\[\]{},;.:])""",
    re.S,
)
_ENDS = {"break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}
KEYWORDS = set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_BINARY = {"||": 1, "&&": 2, **dict.fromkeys(("==", "!=", "<", "<=", ">", ">="), 3), **dict.fromkeys(("+", "-", "|", "^"), 4), **dict.fromkeys(("*", "/", "%", "<<", ">>", "&", "&^"), 5)}
_ASSIGN = {"=", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^="}


def tokens(src: str) -> tuple[list[tuple[str, str, int, int]], list[tuple[int, str]]]:
    """(kind, text, start, end) with the semicolons that line ends stand for, and comments with their starts."""
    out, comments, at, last = [], [], 0, None

    def line_end() -> None:
        if last and (last[0] in ("id", "num", "raw", "str", "chr") and last[1] not in KEYWORDS or last[1] in _ENDS):
            out.append((";", "\n", at, at))

    while at < len(src):
        m = _TOKEN.match(src, at)
        if not m:
            raise Unparsed(f"line {src.count(chr(10), 0, at) + 1}: unexpected {src[at]!r}")
        kind, text = m.lastgroup, m[0]
        if kind == "nl":
            line_end()
            last = None
        elif kind in ("lc", "bc"):
            comments.append((at, text))
            if kind == "bc" and "\n" in text:
                line_end()
                last = None
        elif kind != "ws":
            token = (text if kind == "op" or text in KEYWORDS else kind, text, at, m.end())
            out.append(token)
            last = (kind, text)
        at = m.end()
    line_end()
    out.append(("eof", "", at, at))
    return out, comments


class Parser:
    def __init__(self, source: str):
        """source: the file's bytes as Latin-1, so that offsets count bytes."""
        self.src = source
        self.toks, self.comments = tokens(source)
        self.i, self.level = 0, 0
        self.lines = [0, *(m.end() for m in re.finditer("\n", source))]

    def place(self, offset: int) -> tuple[int, int]:
        n = bisect_right(self.lines, offset)
        return n, offset - self.lines[n - 1] + 1

    @property
    def tok(self) -> str:
        return self.toks[self.i][0]

    @property
    def pos(self) -> int:
        return self.toks[self.i][2]

    @property
    def last_end(self) -> int:
        return self.toks[self.i - 1][3]

    def take(self, kind: str | None = None) -> str:
        k, text, start, _ = self.toks[self.i]
        if kind and k != kind:
            raise Unparsed(f"line {self.place(start)[0]}: {kind!r} expected, {text!r} found")
        self.i += 1
        return text

    def got(self, kind: str) -> bool:
        if self.tok == kind:
            self.i += 1
            return True
        return False

    def semi(self) -> None:
        if self.tok not in (")", "}"):
            self.take(";")

    # Declarations

    def file(self) -> Node:
        self.take("package")
        name = self.take("id")
        self.semi()
        decls = []
        while self.tok == "import":
            decls += self.group(self.import_spec)
        while self.tok != "eof":
            if self.tok == "func":
                decls.append(self.func_decl())
                if self.tok != "eof":
                    self.semi()
            elif self.tok in ("type", "var", "const"):
                decls += self.declaration()
                if self.tok != "eof":
                    self.semi()
            elif not self.got(";"):
                raise Unparsed(f"line {self.place(self.pos)[0]}: declaration expected, {self.toks[self.i][1]!r} found")
        return Node("file", 0, len(self.src), name=name, decls=decls)

    def group(self, spec) -> list[Node]:
        start = self.pos
        self.i += 1
        if not self.got("("):
            out = [spec(start, 0)]
        else:
            out, n = [], 0
            while not self.got(")"):
                out.append(spec(None, n))
                n += 1
                self.semi()
        if spec == self.import_spec:
            self.semi()
        return out

    def import_spec(self, start: int | None, n: int) -> Node:
        at = self.pos
        alias = self.take() if self.tok in ("id", ".") else None
        path = self.take() if self.tok in ("str", "raw") else self.take("str")
        return Node("import", at, self.last_end, alias=alias, path=path[1:-1])

    def declaration(self) -> list[Node]:
        word = self.tok
        if word == "type":
            return self.group(self.type_spec)
        found = self.group(lambda start, n: self.value_spec(word, start, n))
        if word == "const":
            last = None
            for s in found:
                if not s.values and last is not None:
                    s.f["values"], s.f["carried"], s.f["type"] = last.values, True, s.type or last.type
                elif s.values:
                    last = s
        return found

    def type_spec(self, start: int | None, n: int) -> Node:
        at, name = self.pos, self.take("id")
        params = []
        if self.tok == "[" and self.toks[self.i + 1][0] == "id" and self.toks[self.i + 2][0] not in ("]", ".") and not (self.toks[self.i + 2][0] in _BINARY and self.toks[self.i + 2][0] not in ("*", "|")):
            params = self.type_params()
        alias = self.got("=")
        t = self.type()
        return Node("type", at, self.last_end, name=name, params=params, type=t, alias=alias)

    def type_params(self) -> list[Node]:
        self.take("[")
        out = []
        while not self.got("]"):
            at, names = self.pos, [self.take("id")]
            while self.got(","):
                names.append(self.take("id"))
            constraint = self.constraint()
            out.append(Node("field", at, self.last_end, names=names, type=constraint))
            if not self.got(","):
                self.take("]")
                break
        return out

    def constraint(self) -> Node:
        at, parts = self.pos, []
        while True:
            self.got("~")
            parts.append(self.type())
            if not self.got("|"):
                break
        return parts[0] if len(parts) == 1 else Node("union", at, self.last_end, types=parts)

    def value_spec(self, word: str, start: int | None, n: int) -> Node:
        at, names = self.pos, []
        while True:
            names.append(Node("ident", self.pos, self.toks[self.i][3], name=self.take("id")))
            if not self.got(","):
                break
        t = self.type() if self.tok not in ("=", ";", ")") else None
        values = self.expr_list() if self.got("=") else []
        return Node(word, at, self.last_end, names=names, type=t, values=values, carried=False, iota=n)

    def func_decl(self) -> Node:
        at = self.pos
        self.take("func")
        recv = self.params() if self.tok == "(" else None
        name = self.take("id")
        tparams = self.type_params() if self.tok == "[" else []
        params, results = self.signature()
        body = self.block() if self.tok == "{" else None
        return Node("func", at, self.last_end, name=name, recv=recv[0] if recv else None, tparams=tparams, params=params, results=results, body=body)

    def signature(self) -> tuple[list[Node], list[Node]]:
        params = self.params()
        if self.tok == "(":
            return params, self.params()
        if self.tok in ("id", "*", "[", "map", "chan", "func", "struct", "interface", "<-"):
            at = self.pos
            return params, [Node("field", at, self.last_end, names=[], type=self.type())]
        return params, []

    def params(self) -> list[Node]:
        self.take("(")
        entries = []
        while not self.got(")"):
            at = self.pos
            first = self.param_type()
            if self.tok not in (",", ")"):
                entries.append((at, first, self.param_type()))
            else:
                entries.append((at, first, None))
            if not self.got(","):
                self.take(")")
                break
        named = any(t is not None for _, _, t in entries)
        out, pending = [], []
        for at, first, t in entries:
            if not named:
                out.append(Node("field", at, first.end, names=[], type=first))
            else:
                pending.append(first.name if first.kind == "ident" else "_")
                if t is not None:
                    out.append(Node("field", at, t.end, names=pending, type=t))
                    pending = []
        return out

    def param_type(self) -> Node:
        at = self.pos
        if self.got("..."):
            t = self.type()
            return Node("ellipsis", at, t.end, x=t)
        return self.type()

    # Types

    def type(self) -> Node:
        at, k = self.pos, self.tok
        if k == "id":
            t = Node("ident", at, self.toks[self.i][3], name=self.take())
            if self.got("."):
                t = Node("selector", at, self.toks[self.i][3], x=t, name=self.take("id"))
            if self.tok == "[" and self.toks[self.i + 1][0] != "]":
                self.i += 1
                args = [self.type()]
                while self.got(","):
                    if self.tok == "]":
                        break
                    args.append(self.type())
                self.take("]")
                t = Node("index", at, self.last_end, x=t, args=args)
            return t
        if k == "*":
            self.i += 1
            t = self.type()
            return Node("star", at, t.end, x=t)
        if k == "(":
            self.i += 1
            t = self.type()
            self.take(")")
            return Node("paren", at, self.last_end, x=t)
        if k == "[":
            self.i += 1
            n = None
            if self.tok == "...":
                self.i += 1
            elif self.tok != "]":
                self.level += 1
                n = self.expr()
                self.level -= 1
            self.take("]")
            t = self.type()
            return Node("array", at, t.end, len=n, x=t)
        if k == "map":
            self.i += 1
            self.take("[")
            key = self.type()
            self.take("]")
            t = self.type()
            return Node("map", at, t.end, key=key, x=t)
        if k in ("chan", "<-"):
            self.i += 1
            if k == "<-":
                self.take("chan")
            else:
                self.got("<-")
            t = self.type()
            return Node("chan", at, t.end, x=t)
        if k == "func":
            self.i += 1
            params, results = self.signature()
            return Node("functype", at, self.last_end, params=params, results=results)
        if k == "struct":
            return self.struct()
        if k == "interface":
            return self.interface()
        raise Unparsed(f"line {self.place(at)[0]}: type expected, {self.toks[self.i][1]!r} found")

    def struct(self) -> Node:
        at = self.pos
        self.take("struct")
        self.take("{")
        fields = []
        while not self.got("}"):
            f = self.pos
            if self.tok in ("*", "(") or self.tok == "id" and self.toks[self.i + 1][0] in (".", ";", "}", "str", "raw"):
                t = self.type()
                fields.append(Node("field", f, self.last_end, names=[], type=t))
            else:
                names = [self.take("id")]
                if self.tok == "[" and self.toks[self.i + 1][0] == "id" and self.toks[self.i + 2][0] in ("]", ",", ".") and self.toks[self.i + 3][0] in (";", "}", "str", "raw"):
                    self.i -= 1  # an embedded generic type
                    fields.append(Node("field", f, self.last_end, names=[], type=self.type()))
                    names = None
                else:
                    while self.got(","):
                        names.append(self.take("id"))
                    t = self.type()
                    fields.append(Node("field", f, self.last_end, names=names, type=t))
            if self.tok in ("str", "raw"):
                self.i += 1
            self.semi()
        return Node("struct", at, self.last_end, fields=fields)

    def interface(self) -> Node:
        at = self.pos
        self.take("interface")
        self.take("{")
        methods = []
        while not self.got("}"):
            m = self.pos
            if self.tok == "id" and self.toks[self.i + 1][0] == "(":
                name = self.take()
                params, results = self.signature()
                methods.append(Node("field", m, self.last_end, names=[name], type=Node("functype", m, self.last_end, params=params, results=results)))
            else:
                methods.append(Node("field", m, self.last_end, names=[], type=self.constraint()))
            self.semi()
        return Node("interface", at, self.last_end, fields=methods)

    # Expressions

    def expr_list(self) -> list[Node]:
        out = [self.expr()]
        while self.got(","):
            out.append(self.expr())
        return out

    def expr(self, least: int = 1) -> Node:
        left = self.unary()
        while (p := _BINARY.get(self.tok, 0)) >= least:
            op = self.take()
            right = self.expr(p + 1)
            left = Node("binary", left.start, right.end, op=op, x=left, y=right)
        return left

    def unary(self) -> Node:
        at = self.pos
        if self.tok in ("+", "-", "!", "^", "&", "~"):
            op = self.take()
            x = self.unary()
            return Node("unary", at, x.end, op=op, x=x)
        if self.tok == "<-":
            if self.toks[self.i + 1][0] == "chan":
                return self.primary_rest(self.type())
            self.i += 1
            x = self.unary()
            return Node("unary", at, x.end, op="<-", x=x)
        if self.tok == "*":
            self.i += 1
            x = self.unary()
            return Node("star", at, x.end, x=x)
        return self.primary_rest(self.operand())

    def operand(self) -> Node:
        at, k = self.pos, self.tok
        if k in ("num", "str", "raw", "chr"):
            return Node("lit", at, self.toks[self.i][3], lit=k, text=self.take())
        if k == "id":
            return Node("ident", at, self.toks[self.i][3], name=self.take())
        if k == "(":
            self.i += 1
            self.level, saved = 0, self.level
            x = self.expr()
            self.level = saved
            self.take(")")
            return Node("paren", at, self.last_end, x=x)
        if k == "func":
            self.i += 1
            params, results = self.signature()
            if self.tok == "{":
                self.level, saved = 0, self.level
                body = self.block()
                self.level = saved
                return Node("funclit", at, self.last_end, params=params, results=results, body=body)
            return Node("functype", at, self.last_end, params=params, results=results)
        if k in ("[", "map", "chan", "struct", "interface"):
            return self.type()
        raise Unparsed(f"line {self.place(at)[0]}: expression expected, {self.toks[self.i][1]!r} found")

    def primary_rest(self, x: Node) -> Node:
        while True:
            k = self.tok
            if k == ".":
                self.i += 1
                if self.got("("):
                    t = None if self.got("type") else self.type()
                    self.take(")")
                    x = Node("assert", x.start, self.last_end, x=x, type=t)
                else:
                    x = Node("selector", x.start, self.toks[self.i][3], x=x, name=self.take("id"))
            elif k == "[":
                self.i += 1
                self.level, saved = 0, self.level
                args, sliced = [], False
                while self.tok != "]":
                    if self.got(":"):
                        sliced = True
                        continue
                    args.append(self.expr())
                    if not self.got(",") and self.tok not in ("]", ":"):
                        raise Unparsed(f"line {self.place(self.pos)[0]}: ']' expected")
                self.level = saved
                self.take("]")
                x = Node("slice" if sliced else "index", x.start, self.last_end, x=x, args=args)
            elif k == "(":
                self.i += 1
                self.level, saved = 0, self.level
                args = []
                while self.tok != ")":
                    args.append(self.expr())
                    self.got("...")
                    if not self.got(","):
                        break
                self.level = saved
                self.take(")")
                x = Node("call", x.start, self.last_end, fun=x, args=args)
            elif k == "{" and self.literal_type(x) and (self.level >= 0 or x.kind in ("array", "map", "struct")):
                x = self.composite(x)
            else:
                return x

    def literal_type(self, x: Node) -> bool:
        return x.kind in ("ident", "array", "map", "struct") or x.kind == "selector" and x.x.kind == "ident" or x.kind == "index" and self.literal_type(x.x)

    def composite(self, t: Node | None) -> Node:
        at = self.pos if t is None else t.start
        self.take("{")
        self.level, saved = 0, self.level
        elements = []
        while self.tok != "}":
            e = self.element()
            if self.got(":"):
                v = self.element()
                e = Node("keyvalue", e.start, v.end, key=e, value=v)
            elements.append(e)
            if not self.got(","):
                break
        self.got(";")
        self.level = saved
        self.take("}")
        return Node("composite", at, self.last_end, type=t, elements=elements)

    def element(self) -> Node:
        return self.composite(None) if self.tok == "{" else self.expr()

    # Statements

    def block(self) -> Node:
        at = self.pos
        self.take("{")
        self.level, saved = 0, self.level
        body = self.statements()
        self.level = saved
        self.take("}")
        return Node("block", at, self.last_end, body=body)

    def statements(self) -> list[Node]:
        out = []
        while self.tok not in ("}", "case", "default", "eof"):
            if self.got(";"):
                continue
            out.append(self.statement())
            if self.tok not in ("}", "case", "default"):
                self.take(";")
        return out

    def statement(self) -> Node:
        out = self.any_statement()
        if not out.end:
            out.end = self.last_end
        return out

    def any_statement(self) -> Node:
        at, k = self.pos, self.tok
        if k in ("var", "const", "type"):
            return Node("declstmt", at, 0, decls=self.declaration())
        if k == "{":
            return self.block()
        if k == "return":
            self.i += 1
            return Node("return", at, self.last_end, values=[] if self.tok in (";", "}") else self.expr_list())
        if k in ("go", "defer"):
            self.i += 1
            return Node(k, at, 0, x=self.expr())
        if k in ("break", "continue", "goto", "fallthrough"):
            self.i += 1
            if self.tok == "id":
                self.i += 1
            return Node(k, at, self.last_end)
        if k == "if":
            return self.if_stmt()
        if k == "for":
            return self.for_stmt()
        if k == "switch":
            return self.switch_stmt()
        if k == "select":
            self.i += 1
            return Node("select", at, 0, cases=self.cases(lambda: [self.simple()]))
        if k == "id" and self.toks[self.i + 1][0] == ":":
            self.i += 2
            return Node("label", at, self.last_end, body=[] if self.tok in ("}", ";") else [self.statement()])
        return self.simple()

    def simple(self) -> Node:
        at = self.pos
        if self.tok == "range":
            self.i += 1
            return Node("range", at, 0, left=[], op="", right=[self.expr()])
        left = self.expr_list()
        if self.tok in _ASSIGN:
            op = self.take()
            if self.got("range"):
                return Node("range", at, 0, left=left, op=op, right=[self.expr()])
            return Node("assign", at, 0, left=left, op=op, right=self.expr_list())
        if self.tok in ("++", "--"):
            self.i += 1
            return Node("incdec", at, self.last_end, x=left[0])
        if self.got("<-"):
            return Node("send", at, 0, x=left[0], y=self.expr())
        return Node("exprstmt", at, left[0].end, x=left[0])

    def header(self) -> tuple[list[Node], bool]:
        """Simple statements before a block, and whether there was a semicolon."""
        self.level, saved = -1, self.level
        out, parted = [], False
        while self.tok != "{":
            if self.got(";"):
                parted = True
                out.append(None)
                continue
            out.append(self.simple())
        self.level = saved
        return out, parted

    def if_stmt(self) -> Node:
        at = self.pos
        self.take("if")
        head, _ = self.header()
        then = self.block()
        other = None
        if self.got("else"):
            other = self.if_stmt() if self.tok == "if" else self.block()
        return Node("if", at, self.last_end, head=[h for h in head if h], then=then, other=other)

    def for_stmt(self) -> Node:
        at = self.pos
        self.take("for")
        head, _ = self.header()
        body = self.block()
        return Node("for", at, self.last_end, head=[h for h in head if h], body=body)

    def switch_stmt(self) -> Node:
        at = self.pos
        self.take("switch")
        head, _ = self.header()
        return Node("switch", at, self.last_end, head=[h for h in head if h], cases=self.cases(self.case_list))

    def case_list(self) -> list[Node]:
        out = [self.expr()]
        while self.got(","):
            out.append(self.expr())
        return out

    def cases(self, guard) -> list[Node]:
        self.take("{")
        self.level, saved = 0, self.level
        out = []
        while not self.got("}"):
            at = self.pos
            if self.got("default"):
                guards = []
            else:
                self.take("case")
                guards = guard()
            self.take(":")
            out.append(Node("case", at, self.last_end, guards=guards, body=self.statements()))
        self.level = saved
        return out


def selector_parts(x: Node) -> list[str] | None:
    """The names of a dotted chain, None for anything else."""
    names = []
    while x.kind == "selector":
        names.append(x.name)
        x = x.x
    return [x.name, *reversed(names)] if x.kind == "ident" else None


def parse(source: bytes) -> tuple[Parser, Node]:
    p = Parser(source.decode("latin-1"))
    return p, p.file()
