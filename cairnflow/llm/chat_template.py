"""A small sandboxed template language, compiled to Python closures.

    {{ expression }}   {% for m in messages %} ... {% endfor %}   {# note #}
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}   {% set name = e %}
    {% generation %} ... {% endgeneration %}   (output inside counts for the loss)

A `-` beside a delimiter strips white space on its side. Expressions have strings, integers,
true, false, none, names, `a.key` and `a['key']` (items of dictionaries and lists only),
`+ - * % ~`, comparisons, `in`, `and`, `or`, `not`, `x if c else y`, and filters from FILTERS.
There is no other call, no attribute of a Python object and no loop but over a given list, so
a template can't reach outside the values it gets.

The text is parsed into a tree of tuples; parts that are constant are folded; each node becomes
a closure, so rendering parses nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

ESCAPES = (("\\", "\\\\"), ("[", "\\("), ("<", "\\{"))
_BACK = {"\\": "\\", "(": "[", "{": "<"}


def escape(text: str) -> str:
    """Text without `[` and `<`, which open every control string; unescape() reverses it."""
    for plain, escaped in ESCAPES:
        if plain in text:
            text = text.replace(plain, escaped)
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text) if "\\" in text else text


def _str(x) -> str:
    return "" if x is None else x if isinstance(x, str) else {True: "true", False: "false"}.get(x) if isinstance(x, bool) else str(x)


FILTERS: dict[str, Callable] = {
    "escape": lambda x: escape(_str(x)), "trim": lambda x: _str(x).strip(), "upper": lambda x: _str(x).upper(),
    "lower": lambda x: _str(x).lower(), "length": len, "string": _str, "default": lambda x, y="": y if x is None else x,
    "replace": lambda x, a, b: _str(x).replace(a, b), "join": lambda x, sep="": sep.join(map(_str, x)),
}

_TOKEN = re.compile(r"\s*(?:(?P<int>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+*%~<>().,\[\]|=]))")
_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?)(.*?)(-?)#\}", re.S)
_WORDS = {"true": True, "false": False, "none": None}
_LEVELS = (("or",), ("and",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("~",), ("+", "-"), ("*", "%"))


class TemplateError(ValueError):
    """The template, or what it does with the values given, is not allowed."""


def _item(value, key):
    if isinstance(value, dict):
        return value.get(key)
    if isinstance(value, list) and isinstance(key, int) and -len(value) <= key < len(value):
        return value[key]
    if isinstance(value, str | list | type(None)):
        return None
    raise TemplateError(f"no items in {type(value).__name__}")


def _repeat(a, b):
    if not isinstance(a, int) or not isinstance(b, int):
        raise TemplateError("* is for integers")
    return a * b


_BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b, "in": lambda a, b: a in b, "~": lambda a, b: _str(a) + _str(b), "+": lambda a, b: a + b,
    "-": lambda a, b: a - b, "*": _repeat, "%": lambda a, b: a % b if isinstance(a, int) else _repeat(a, b), "[]": _item,
}


class _Expression:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, text: str):
        self.tokens, at, text = [], 0, text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"what is {text[at:]!r}?")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        kind, x = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        return x if kind in ("op", "name") else None

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} is missing")

    def name(self) -> str:
        kind, x = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        if kind != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return x

    def whole(self) -> tuple:
        tree = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def choice(self) -> tuple:
        tree = self.level(0)
        if self.take("if"):
            test = self.level(0)
            other = self.choice() if self.take("else") else ("const", None)
            tree = fold(("choice", test, tree, other))
        return tree

    def level(self, n: int) -> tuple:
        if n == len(_LEVELS):
            return self.unary()
        if n == 2 and self.take("not"):
            return fold(("not", self.level(2)))
        tree = self.level(n + 1)
        while True:
            if n == 2 and self.peek() == "not":
                self.at += 1
                self.need("in")
                tree = fold(("not", fold(("in", tree, self.level(n + 1)))))
            elif op := self.take(*_LEVELS[n]):
                tree = fold((op, tree, self.level(n + 1)))
            else:
                return tree

    def unary(self) -> tuple:
        if self.take("-"):
            return fold(("-", ("const", 0), self.unary()))
        tree = self.atom()
        while op := self.take(".", "[", "|"):
            if op == ".":
                tree = fold(("[]", tree, ("const", self.name())))
            elif op == "[":
                tree = fold(("[]", tree, self.choice()))
                self.need("]")
            else:
                name, args = self.name(), []
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                if self.take("(") and not self.take(")"):
                    args.append(self.choice())
                    while self.take(","):
                        args.append(self.choice())
                    self.need(")")
                tree = fold(("filter", name, tree, *args))
        return tree

    def atom(self) -> tuple:
        if self.take("("):
            tree = self.choice()
            self.need(")")
            return tree
        kind, x = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        self.at += 1
        if kind == "int":
            return "const", int(x)
        if kind == "str":
            return "const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), x[1:-1])
        if kind == "name":
            return ("const", _WORDS[x]) if x in _WORDS else ("name", x)
        raise TemplateError(f"unexpected {x!r}")


def fold(tree: tuple) -> tuple:
    """The tree, or what it comes to if its parts are constant."""
    kind, parts = tree[0], [x for x in tree[1:] if isinstance(x, tuple)]
    if kind == "choice" and tree[1][0] == "const":
        return tree[2] if tree[1][1] else tree[3]
    if parts and all(p[0] == "const" for p in parts):
        return "const", _value(tree)({})
    return tree


def _value(tree: tuple) -> Callable[[dict], object]:
    kind = tree[0]
    if kind == "const":
        x = tree[1]
        return lambda _: x
    if kind == "name":
        name = tree[1]
        return lambda names: names.get(name)
    if kind == "not":
        f = _value(tree[1])
        return lambda names: not f(names)
    if kind in ("and", "or"):
        f, g = _value(tree[1]), _value(tree[2])
        return (lambda names: f(names) and g(names)) if kind == "and" else (lambda names: f(names) or g(names))
    if kind == "choice":
        test, yes, no = map(_value, tree[1:])
        return lambda names: yes(names) if test(names) else no(names)
    if kind == "filter":
        call, f, args = FILTERS[tree[1]], _value(tree[2]), [_value(x) for x in tree[3:]]
        if not args:
            return lambda names: call(f(names))
        return lambda names: call(f(names), *[a(names) for a in args])
    op, f, g = _BINARY[kind], _value(tree[1]), _value(tree[2])
    return lambda names: op(f(names), g(names))


def parse(text: str) -> tuple:
    """The tree of a template: ("block", node, ...) with adjacent texts joined and constant tests resolved."""
    parts, at, strip = [], 0, False
    for m in _TAG.finditer(text):
        plain = text[at : m.start()]
        parts.append(("text", plain.lstrip() if strip else plain))
        k = next(i for i in (1, 4, 7) if m[i] is not None)
        if m[k]:
            parts[-1] = ("text", parts[-1][1].rstrip())
        if k < 7:
            parts.append(("value" if k == 1 else "tag", m[k + 1].strip()))
        strip, at = bool(m[k + 2]), m.end()
    parts.append(("text", text[at:].lstrip() if strip else text[at:]))
    parts.reverse()
    tree, ended = _block(parts, ())
    assert not ended
    return tree


def _block(parts: list, ends: tuple[str, ...]) -> tuple[tuple, str]:
    nodes: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "block":
            for x in node[1:]:
                add(x)
        elif node[0] == "text" and nodes and nodes[-1][0] == "text":
            nodes[-1] = ("text", nodes[-1][1] + node[1])
        elif node != ("text", ""):
            nodes.append(node)

    while parts:
        kind, x = parts.pop()
        if kind == "text":
            add(("text", x))
            continue
        if kind == "value":
            tree = _Expression(x).whole()
            add(("text", _str(tree[1])) if tree[0] == "const" else ("value", tree))
            continue
        word = x.split(None, 1)[0] if x else ""
        rest = x[len(word) :]
        if word in ends:
            return ("block", *nodes), x
        if word == "if":
            add(_if(parts, rest))
        elif word == "for":
            e = _Expression(rest)
            name = e.name()
            e.need("in")
            over = e.whole()
            body, _ = _need(parts, "endfor")
            add(("for", name, over, body))
        elif word == "set":
            e = _Expression(rest)
            name = e.name()
            e.need("=")
            add(("set", name, e.whole()))
        elif word == "generation":
            body, _ = _need(parts, "endgeneration")
            add(("generation", body))
        else:
            raise TemplateError(f"unexpected {word!r}")
    if ends:
        raise TemplateError(f"{ends[-1]!r} is missing")
    return ("block", *nodes), ""


def _need(parts: list, *ends: str) -> tuple[tuple, str]:
    return _block(parts, ends)


def _if(parts: list, test_text: str) -> tuple:
    test = _Expression(test_text).whole()
    yes, end = _need(parts, "elif", "else", "endif")
    no: tuple = ("block",)
    if end.startswith("elif"):
        no = _if(parts, end[4:])
    elif end == "else":
        no, _ = _need(parts, "endif")
    if test[0] == "const":
        return yes if test[1] else no
    return "if", test, yes, no


Out = Iterator[tuple[str, bool]]


def _render(tree: tuple, counted: bool) -> Callable[[dict], Out]:
    """A closure that yields (text, counts for the loss); counted: inside a generation tag."""
    kind = tree[0]
    if kind == "text":
        piece = tree[1], counted

        def run(names):
            yield piece
    elif kind == "value":
        f = _value(tree[1])

        def run(names):
            yield _str(f(names)), counted
    elif kind == "set":
        name, f = tree[1], _value(tree[2])

        def run(names):
            names[name] = f(names)
            return
            yield
    elif kind == "generation":
        run = _render(tree[1], True)
    elif kind == "if":
        test, yes, no = _value(tree[1]), _render(tree[2], counted), _render(tree[3], counted)

        def run(names):
            return yes(names) if test(names) else no(names)
    elif kind == "for":
        name, over, body = tree[1], _value(tree[2]), _render(tree[3], counted)

        def run(names):
            items = over(names)
            if items is None:
                return
            if isinstance(items, str | dict):
                raise TemplateError("a loop needs a list")
            within, rows, k = dict(names), iter(items), 0
            row = next(rows, within)
            while row is not within:  # one ahead, so that the last is known
                ahead = next(rows, within)
                within[name] = row
                within["loop"] = {"index": k + 1, "index0": k, "first": k == 0, "last": ahead is within}
                yield from body(within)
                row, k = ahead, k + 1
    else:
        steps = [_render(x, counted) for x in tree[1:]]

        def run(names):
            for s in steps:
                yield from s(names)

    return run


class Template:
    """A compiled template."""

    def __init__(self, text: str):
        self.tree = parse(text)
        self._run = _render(self.tree, False)

    def stream(self, messages: Iterable[dict], **names) -> Out:
        """(text, counts for the loss) piece by piece; messages may be any iterable, read once."""
        return self._run(dict(names) | {"messages": messages})

    def render(self, messages: Iterable[dict], **names) -> tuple[str, list[tuple[int, int]]]:
        """The whole text, and the spans of it that count for the loss."""
        out, spans, at = [], [], 0
        for text, counts in self.stream(messages, **names):
            if counts and text:
                if spans and spans[-1][1] == at:
                    spans[-1] = spans[-1][0], at + len(text)
                else:
                    spans.append((at, at + len(text)))
            out.append(text)
            at += len(text)
        return "".join(out), spans
