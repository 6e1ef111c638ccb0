"""A small sandboxed template language for conversations, compiled to Python closures.

Source -> tokens -> syntax tree -> constant folding -> closures. The language has
text, ``{{ expr }}``, ``{% for x in expr %}``, ``{% if %}/{% elif %}/{% else %}``,
``{% set x = expr %}`` and ``{% generation %}...{% endgeneration %}``, whose output
is under the loss mask. Expressions: string, integer and boolean literals, names,
``a.b`` and ``a['b']`` (mapping lookup only), ``not and or``, comparisons, ``in``,
``+``, ``~``, and the filters of ``FILTERS``. There are no calls, no attribute
access on Python objects and no way to reach anything but the given variables.

Rendering is a generator of ``(text, under_loss_mask)`` pieces: a loop draws its
items lazily, so a conversation of any length renders in the memory of one turn.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

Piece = tuple[str, bool]
_SPECIAL = re.compile(r"[\\#<:]")
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """A backslash before each character that a control string could start or end with."""
    return _SPECIAL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda v: escape(_text(v)),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "trim": lambda v: _text(v).strip(),
    "capitalize": lambda v: _text(v).capitalize(),
    "length": lambda v: len(v),
    "string": lambda v: _text(v),
}


class TemplateError(ValueError):
    pass


def _text(v: Any) -> str:
    return "" if v is None else v if isinstance(v, str) else str(v)


# --- syntax tree -----------------------------------------------------------


@dataclass
class Const:
    value: Any


@dataclass
class Name:
    name: str


@dataclass
class Lookup:
    of: Any
    key: Any


@dataclass
class Unary:
    op: str
    of: Any


@dataclass
class Binary:
    op: str
    left: Any
    right: Any


@dataclass
class Filter:
    name: str
    of: Any


@dataclass
class Output:
    expr: Any


@dataclass
class For:
    var: str
    items: Any
    body: list


@dataclass
class If:
    branches: list[tuple[Any, list]]
    otherwise: list = field(default_factory=list)


@dataclass
class Set:
    name: str
    expr: Any


@dataclass
class Generation:
    body: list


_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#.*?#\}", re.S)
_LEX = re.compile(r"\s*(?:(?P<str>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<int>\d+)|(?P<name>[A-Za-z]\w*)|(?P<op>==|!=|<=|>=|[<>+~.|()\[\]]))")
_ESC = {"n": "\n", "t": "\t"}


class _Expr:
    """Recursive descent over one expression."""

    def __init__(self, source: str):
        self.toks: list[tuple[str, str]] = []
        at, source = 0, source.strip()
        while at < len(source):
            m = _LEX.match(source, at)
            if not m or m.end() == at:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.toks.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, value: str | None = None) -> bool:
        return self.at < len(self.toks) and (value is None or self.toks[self.at][1] == value and self.toks[self.at][0] != "str")

    def take(self, value: str | None = None) -> tuple[str, str]:
        if not self.peek(value):
            raise TemplateError(f"expected {value or 'a value'}")
        self.at += 1
        return self.toks[self.at - 1]

    def whole(self):
        e = self.either()
        if self.at != len(self.toks):
            raise TemplateError(f"unexpected {self.toks[self.at][1]!r}")
        return e

    def either(self):
        e = self.both()
        while self.peek("or"):
            self.take()
            e = Binary("or", e, self.both())
        return e

    def both(self):
        e = self.negated()
        while self.peek("and"):
            self.take()
            e = Binary("and", e, self.negated())
        return e

    def negated(self):
        if self.peek("not"):
            self.take()
            return Unary("not", self.negated())
        return self.compared()

    def compared(self):
        e = self.joined()
        while self.at < len(self.toks) and self.toks[self.at] in [("op", o) for o in ("==", "!=", "<", ">", "<=", ">=")] + [("name", "in")]:
            e = Binary(self.take()[1], e, self.joined())
        return e

    def joined(self):
        e = self.filtered()
        while self.peek("+") or self.peek("~"):
            e = Binary(self.take()[1], e, self.filtered())
        return e

    def filtered(self):
        e = self.atom()
        while True:
            if self.peek("."):
                self.take()
                e = Lookup(e, Const(self.take()[1]))
            elif self.peek("["):
                self.take()
                e = Lookup(e, self.either())
                self.take("]")
            elif self.peek("|"):
                self.take()
                name = self.take()[1]
                if name not in FILTERS:
                    raise TemplateError(f"unknown filter {name!r}")
                e = Filter(name, e)
            else:
                return e

    def atom(self):
        kind, v = self.take()
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _ESC.get(m[1], m[1]), v[1:-1], flags=re.S))
        if kind == "int":
            return Const(int(v))
        if kind == "name":
            return Const({"true": True, "false": False, "none": None}[v]) if v in ("true", "false", "none") else Name(v)
        if v == "(":
            e = self.either()
            self.take(")")
            return e
        raise TemplateError(f"unexpected {v!r}")


def parse(source: str) -> list:
    """The syntax tree of a template."""
    items: list[tuple[str, str]] = []
    at, strip_next = 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if strip_next else text
        if (m[1] or m[4]) == "-":
            text = text.rstrip()
        if text:
            items.append(("text", text))
        if m[2] is not None:
            items.append(("expr", m[2]))
        elif m[5] is not None:
            items.append(("tag", m[5].strip()))
        strip_next = (m[3] or m[6]) == "-"
        at = m.end()
    if rest := source[at:].lstrip() if strip_next else source[at:]:
        items.append(("text", rest))

    pos = 0

    def block(*ends: str) -> tuple[list, str]:
        nonlocal pos
        out: list = []
        while pos < len(items):
            kind, v = items[pos]
            pos += 1
            if kind == "text":
                out.append(Output(Const(v)))
            elif kind == "expr":
                out.append(Output(_Expr(v).whole()))
            else:
                word, _, rest = v.partition(" ")
                if word in ends:
                    return out, v
                if word == "for":
                    m = re.fullmatch(r"(\w+)\s+in\s+(.+)", rest.strip(), re.S)
                    if not m:
                        raise TemplateError(f"bad loop {v!r}")
                    body, _ = block("endfor")
                    out.append(For(m[1], _Expr(m[2]).whole(), body))
                elif word == "if":
                    node, test = If([]), rest
                    while True:
                        body, end = block("elif", "else", "endif")
                        if test is None:
                            node.otherwise = body
                        else:
                            node.branches.append((_Expr(test).whole(), body))
                        if end == "endif":
                            break
                        test = end.partition(" ")[2] if end.startswith("elif") else None
                    out.append(node)
                elif word == "set":
                    name, eq, e = rest.partition("=")
                    if not eq or not re.fullmatch(r"[A-Za-z]\w*", name.strip()):
                        raise TemplateError(f"bad assignment {v!r}")
                    out.append(Set(name.strip(), _Expr(e).whole()))
                elif word == "generation":
                    out.append(Generation(block("endgeneration")[0]))
                else:
                    raise TemplateError(f"unknown tag {v!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return out, ""

    return block()[0]


# --- evaluation ------------------------------------------------------------

_BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "+": lambda a, b: a + b,
    "~": lambda a, b: _text(a) + _text(b),
}


def _look(of: Any, key: Any) -> Any:
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, tuple)) and isinstance(key, int) and -len(of) <= key < len(of):
        return of[key]
    return None


def fold(node):
    """Constant folding: constant expressions become literals, constant branches are
    decided, neighbouring literal outputs are joined."""
    if isinstance(node, list):
        out: list = []
        for n in map(fold, node):
            for x in n if isinstance(n, list) else [n]:
                if isinstance(x, Output) and isinstance(x.expr, Const) and out and isinstance(out[-1], Output) and isinstance(out[-1].expr, Const):
                    out[-1] = Output(Const(_text(out[-1].expr.value) + _text(x.expr.value)))
                elif not (isinstance(x, Output) and isinstance(x.expr, Const) and _text(x.expr.value) == ""):
                    out.append(x)
        return out
    if isinstance(node, Lookup):
        of, key = fold(node.of), fold(node.key)
        return Const(_look(of.value, key.value)) if isinstance(of, Const) and isinstance(key, Const) else Lookup(of, key)
    if isinstance(node, Unary):
        of = fold(node.of)
        return Const(not of.value) if isinstance(of, Const) else Unary(node.op, of)
    if isinstance(node, Binary):
        a, b = fold(node.left), fold(node.right)
        if node.op in ("and", "or"):
            if isinstance(a, Const):
                return (b if a.value else a) if node.op == "and" else (a if a.value else b)
        elif isinstance(a, Const) and isinstance(b, Const):
            return Const(_BINARY[node.op](a.value, b.value))
        return Binary(node.op, a, b)
    if isinstance(node, Filter):
        of = fold(node.of)
        return Const(FILTERS[node.name](of.value)) if isinstance(of, Const) else Filter(node.name, of)
    if isinstance(node, Output):
        return Output(fold(node.expr))
    if isinstance(node, Set):
        return Set(node.name, fold(node.expr))
    if isinstance(node, For):
        return For(node.var, fold(node.items), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        kept: list = []
        for test, body in node.branches:
            t, b = fold(test), fold(body)
            if isinstance(t, Const):
                if t.value:
                    return If(kept, b) if kept else b
                continue
            kept.append((t, b))
        return If(kept, fold(node.otherwise)) if kept else fold(node.otherwise)
    return node


def _value(node) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        v = node.value
        return lambda env: v
    if isinstance(node, Name):
        name = node.name
        return lambda env: env.get(name)
    if isinstance(node, Lookup):
        of, key = _value(node.of), _value(node.key)
        return lambda env: _look(of(env), key(env))
    if isinstance(node, Unary):
        of = _value(node.of)
        return lambda env: not of(env)
    if isinstance(node, Filter):
        of, f = _value(node.of), FILTERS[node.name]
        return lambda env: f(of(env))
    a, b = _value(node.left), _value(node.right)
    if node.op == "and":
        return lambda env: a(env) and b(env)
    if node.op == "or":
        return lambda env: a(env) or b(env)
    f = _BINARY[node.op]
    return lambda env: f(a(env), b(env))


Render = Callable[[dict, bool], Iterator[Piece]]


def _body(nodes: list) -> Render:
    parts = [_render(n) for n in nodes]

    def run(env: dict, masked: bool) -> Iterator[Piece]:
        for p in parts:
            yield from p(env, masked)

    return run


def _render(node) -> Render:
    if isinstance(node, Output):
        value = _value(node.expr)

        def output(env, masked):
            if text := _text(value(env)):
                yield text, masked

        return output
    if isinstance(node, Set):
        name, value = node.name, _value(node.expr)

        def assign(env, masked):
            env[name] = value(env)
            yield from ()

        return assign
    if isinstance(node, Generation):
        inner = _body(node.body)
        return lambda env, masked: inner(env, True)
    if isinstance(node, If):
        branches, otherwise = [(_value(t), _body(b)) for t, b in node.branches], _body(node.otherwise)

        def choose(env, masked):
            return next((body for test, body in branches if test(env)), otherwise)(env, masked)

        return choose
    var, items, body = node.var, _value(node.items), _body(node.body)

    def loop(env, masked):
        outer, source = {k: env.get(k) for k in (var, "loop")}, iter(items(env) or ())
        here = next(source, _END)
        i = 0
        while here is not _END:
            after = next(source, _END)
            env[var], env["loop"] = here, {"index0": i, "index": i + 1, "first": i == 0, "last": after is _END}
            yield from body(env, masked)
            here, i = after, i + 1
        env.update(outer)

    return loop


_END = object()


class Template:
    """A compiled template; ``render(messages=...)`` yields its pieces."""

    def __init__(self, source: str):
        self.tree = fold(parse(source))
        self._run = _body(self.tree)

    def render(self, **variables: Any) -> Iterator[Piece]:
        return self._run(dict(variables), False)


def spans(pieces: Iterable[Piece]) -> tuple[str, list[tuple[int, int]]]:
    """The whole output and its masked spans (code point offsets)."""
    out, at, marked = [], 0, []
    for text, masked in pieces:
        if masked:
            if marked and marked[-1][1] == at:
                marked[-1] = (marked[-1][0], at + len(text))
            else:
                marked.append((at, at + len(text)))
        out.append(text)
        at += len(text)
    return "".join(out), marked
