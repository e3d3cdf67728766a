"""A small sandboxed template language, compiled to Python closures.

Text is copied; ``{{ expression }}`` writes a value; ``{% for x in list %}``,
``{% if %} {% elif %} {% else %}``, ``{% generation %}`` and their ``{% end... %}``
are blocks. Expressions: strings, whole numbers, names, ``x.field``, ``+``, ``==``,
``!=``, ``not``, ``and``, ``or``, parentheses and ``| filter``. Names come from the
values handed in and loop variables; fields are dictionary entries and nothing else,
so no Python attribute or function can be reached. There are no calls, and loops run
over given lists only, so every template ends.

``compile_template`` parses to a tree, folds constant parts, and makes a closure of
each node. A rendering returns the text and the spans under ``generation``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

PIECES = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
SYMBOLS = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(\d+)|([A-Za-z_]\w*)|(==|!=|[+.|()]))""")
ESCAPES = {"n": "\n", "t": "\t"}


class TemplateError(ValueError):
    pass


# Trees are tuples whose first item names the node.


class _Expression:
    """Precedence, low to high: or, and, not, == !=, +, | filter, x.field."""

    def __init__(self, source: str):
        self.symbols, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = SYMBOLS.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:]!r}")
            self.symbols.append((m.lastindex, m[m.lastindex]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.symbols[self.at][1] if self.at < len(self.symbols) and self.symbols[self.at][0] != 1 else None

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted:
            self.at += 1
            return self.symbols[self.at - 1][1]
        return None

    def whole(self) -> tuple:
        tree = self.either()
        if self.at < len(self.symbols):
            raise TemplateError(f"unexpected {self.symbols[self.at][1]!r}")
        return tree

    def either(self) -> tuple:
        tree = self.both()
        while self.take("or"):
            tree = ("or", tree, self.both())
        return tree

    def both(self) -> tuple:
        tree = self.negated()
        while self.take("and"):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        tree = self.sum()
        while sign := self.take("==", "!="):
            tree = (sign, tree, self.sum())
        return tree

    def sum(self) -> tuple:
        tree = self.filtered()
        while self.take("+"):
            tree = ("+", tree, self.filtered())
        return tree

    def filtered(self) -> tuple:
        tree = self.field()
        while self.take("|"):
            tree = ("filter", self.name(), tree)
        return tree

    def field(self) -> tuple:
        tree = self.atom()
        while self.take("."):
            tree = ("field", tree, self.name())
        return tree

    def name(self) -> str:
        if self.at >= len(self.symbols) or self.symbols[self.at][0] != 3:
            raise TemplateError("a name is missing")
        self.at += 1
        return self.symbols[self.at - 1][1]

    def atom(self) -> tuple:
        if self.take("("):
            tree = self.either()
            if not self.take(")"):
                raise TemplateError("a ) is missing")
            return tree
        if self.at >= len(self.symbols):
            raise TemplateError("a value is missing")
        kind, text = self.symbols[self.at]
        self.at += 1
        if kind == 1:
            return ("value", re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == 2:
            return ("value", int(text))
        if kind == 3 and text not in ("and", "or", "not", "in"):
            return ("value", text == "true") if text in ("true", "false") else ("name", text)
        raise TemplateError(f"unexpected {text!r}")


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    top: list = []
    open_blocks: list[tuple[str, tuple, list, list]] = []  # kind, head, branches, body
    body, at = top, 0
    for m in PIECES.finditer(source):
        if m.start() > at:
            body.append(("value", source[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            body.append(_Expression(m[1]).whole())
            continue
        word, _, rest = m[2].strip().partition(" ")
        if word == "for":
            parts = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.*)", rest, re.S)
            if not parts:
                raise TemplateError("for needs: for name in list")
            open_blocks.append(("for", (parts[1], _Expression(parts[2]).whole()), [], body))
            body = []
        elif word == "if":
            open_blocks.append(("if", _Expression(rest).whole(), [], body))
            body = []
        elif word == "generation":
            open_blocks.append(("generation", (), [], body))
            body = []
        elif word in ("elif", "else") and open_blocks and open_blocks[-1][0] == "if":
            kind, head, branches, outer = open_blocks.pop()
            if head is None:
                raise TemplateError(f"{word} after else")
            branches.append((head, ("all", *body)))
            open_blocks.append((kind, _Expression(rest).whole() if word == "elif" else None, branches, outer))
            body = []
        elif word.startswith("end") and open_blocks and word == "end" + open_blocks[-1][0]:
            kind, head, branches, outer = open_blocks.pop()
            inner = ("all", *body)
            if kind == "for":
                outer.append(("for", *head, inner))
            elif kind == "if":
                outer.append(("if", (*branches, (head or ("value", True), inner))))
            else:
                outer.append(("generation", inner))
            body = outer
        else:
            raise TemplateError(f"unexpected {word!r}")
    if open_blocks:
        raise TemplateError(f"{open_blocks[-1][0]} is not ended")
    if at < len(source):
        body.append(("value", source[at:]))
    return ("all", *top)


def _constant(tree: tuple) -> bool:
    return tree[0] == "value"


def fold(tree: tuple, filters: dict[str, Callable[[str], str]]) -> tuple:
    """The tree with its constant parts worked out and neighbouring texts joined."""
    kind = tree[0]
    if kind in ("value", "name"):
        return tree
    if kind == "all":
        parts: list = []
        for part in (fold(x, filters) for x in tree[1:]):
            for piece in part[1:] if part[0] == "all" else (part,):
                if _constant(piece) and parts and _constant(parts[-1]):
                    parts[-1] = ("value", _written(parts[-1][1]) + _written(piece[1]))
                elif not (_constant(piece) and _written(piece[1]) == ""):
                    parts.append(piece)
        return parts[0] if len(parts) == 1 and _constant(parts[0]) else ("all", *parts)
    if kind == "for":
        return ("for", tree[1], fold(tree[2], filters), fold(tree[3], filters))
    if kind == "generation":
        return ("generation", fold(tree[1], filters))
    if kind == "if":
        kept = []
        for test, body in tree[1]:
            test = fold(test, filters)
            if _constant(test) and not test[1]:
                continue
            kept.append((test, fold(body, filters)))
            if _constant(test):
                break
        if not kept:
            return ("all",)
        return kept[0][1] if _constant(kept[0][0]) else ("if", tuple(kept))
    if kind == "filter":
        inner = fold(tree[2], filters)
        new: tuple = ("filter", tree[1], inner)
        parts_of = [inner]
    elif kind == "field":
        return ("field", fold(tree[1], filters), tree[2])
    else:
        parts_of = [fold(x, filters) for x in tree[1:]]
        new = (kind, *parts_of)
    if all(map(_constant, parts_of)):
        return ("value", _closure(new, filters)({}, None))
    return new


def _written(value) -> str:
    if value is None:
        return ""
    return value if isinstance(value, str) else str(value)


class _Output:
    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


BINARY = {
    "+": lambda a, b: _written(a) + _written(b) if isinstance(a, str) or isinstance(b, str) else a + b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "and": lambda a, b: a and b,
    "or": lambda a, b: a or b,
}


def _closure(tree: tuple, filters: dict[str, Callable[[str], str]]) -> Callable:
    """An expression as a function of the names in force (the output is not used)."""
    kind = tree[0]
    if kind == "value":
        return lambda names, _, v=tree[1]: v
    if kind == "name":
        return lambda names, _, n=tree[1]: names.get(n)
    if kind == "field":
        inner, field = _closure(tree[1], filters), tree[2]

        def get(names, _):
            value = inner(names, _)
            return value.get(field) if type(value) is dict else None

        return get
    if kind == "filter":
        if tree[1] not in filters:
            raise TemplateError(f"no filter {tree[1]!r}")
        inner, change = _closure(tree[2], filters), filters[tree[1]]
        return lambda names, _: change(_written(inner(names, _)))
    if kind == "not":
        inner = _closure(tree[1], filters)
        return lambda names, _: not inner(names, _)
    left, right, work = _closure(tree[1], filters), _closure(tree[2], filters), BINARY[kind]
    if kind in ("and", "or"):
        stop = kind == "or"
        return lambda names, _: v if bool(v := left(names, _)) is stop else right(names, _)
    return lambda names, _: work(left(names, _), right(names, _))


def _writer(tree: tuple, filters: dict[str, Callable[[str], str]]) -> Callable:
    """A template node as a function that writes to an output."""
    kind = tree[0]
    if kind == "all":
        parts = [_writer(x, filters) for x in tree[1:]]

        def run(names, out):
            for part in parts:
                part(names, out)

        return run
    if kind == "for":
        name, items, body = tree[1], _closure(tree[2], filters), _writer(tree[3], filters)

        def loop(names, out):
            given = items(names, None)
            if type(given) is not list:
                return
            inner = dict(names)
            for i, item in enumerate(given):
                inner[name] = item
                inner["loop"] = {"index": i + 1, "first": i == 0, "last": i == len(given) - 1}
                body(inner, out)

        return loop
    if kind == "if":
        branches = [(_closure(test, filters), _writer(body, filters)) for test, body in tree[1]]

        def choose(names, out):
            for test, body in branches:
                if test(names, None):
                    body(names, out)
                    return

        return choose
    if kind == "generation":
        body = _writer(tree[1], filters)

        def marked(names, out):
            start = out.size
            body(names, out)
            out.spans.append((start, out.size))

        return marked
    if kind == "value":
        return lambda names, out, text=_written(tree[1]): out.write(text)
    value = _closure(tree, filters)
    return lambda names, out: out.write(_written(value(names, None)))


def compile_template(source: str, filters: dict[str, Callable[[str], str]]) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from names (strings, numbers, lists, dictionaries) to the text and
    the spans (first code point and end) written within ``generation``."""
    write = _writer(fold(parse(source), filters), filters)

    def render(names: dict) -> tuple[str, list[tuple[int, int]]]:
        out = _Output()
        write(names, out)
        return "".join(out.parts), out.spans

    return render


def _mentions(tree: object, name: str) -> bool:
    if isinstance(tree, tuple):
        return tree[:2] == ("name", name) or any(_mentions(x, name) for x in tree)
    return False


def compile_turns(source: str, filters: dict[str, Callable[[str], str]], items: str = "messages") -> Callable[[dict], tuple[str, list[tuple[int, int]]]] | None:
    """A function from one item to what the template writes for it, with its spans, if the template is nothing
    but a loop over ``items`` whose body looks at its own item alone; else None."""
    tree = fold(parse(source), filters)
    if tree[0] != "all" or len(tree) != 2 or tree[1][0] != "for" or tree[1][2] != ("name", items):
        return None
    _, name, _, body = tree[1]
    if _mentions(body, items) or _mentions(body, "loop"):
        return None
    write = _writer(body, filters)

    def render(item: dict) -> tuple[str, list[tuple[int, int]]]:
        out = _Output()
        write({name: item}, out)
        return "".join(out.parts), out.spans

    return render
