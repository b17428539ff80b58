"""Source files: read once for all checks, with helpers to look into trees."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from typing import Any

from . import elixir, templates
from .elixir import Atom, Node, Sigil, Text, Tup, walk

DEFINITIONS = ("def", "defp", "defmacro", "defmacrop")
TYPE_ATTRIBUTES = ("spec", "callback", "macrocallback", "type", "typep", "opaque")


@dataclass
class Call:
    """A call: module (dotted, None for a local one; ``:name`` for an Erlang one), function, arguments; ``piped``: the
    first argument comes from a pipe."""

    module: str | None
    function: str
    args: list
    node: Node
    piped: bool = False

    @property
    def arity(self) -> int:
        return len(self.args) + self.piped

    @property
    def last(self) -> str | None:
        return self.module.rsplit(".", 1)[-1] if self.module else None

    @property
    def rest(self) -> list:
        """Arguments after the first."""
        return self.args if self.piped else self.args[1:]

    def is_(self, module: str, *functions: str) -> bool:
        return self.module == module and self.function in functions

    def repo(self, *functions: str) -> bool:
        return self.last == "Repo" and self.function in functions


@dataclass
class Definition:
    kind: str
    name: str
    params: list
    guard: Any
    body: Any
    node: Node
    module: str
    sections: list


def alias_name(x: Any) -> str | None:
    if isinstance(x, Node) and x.name == "__aliases__":
        parts = [alias_name(a) if isinstance(a, Node) else a for a in x.args]
        if all(isinstance(a, str) for a in parts):
            # names below the root are the same with and without it
            return ".".join(parts[1:] if len(parts) > 1 and parts[0] == "Elixir" else parts)
        return None
    if isinstance(x, Node) and x.name == "__MODULE__":
        return "__MODULE__"
    return None


def call(x: Any, piped: bool = False) -> Call | None:
    """The call that ``x`` is; a variable is none, nor is an operator."""
    if not isinstance(x, Node) or x.args is None:
        return None
    if isinstance(x.name, str):
        return None if x.name in elixir.BINARY or x.name in ("__aliases__", "__block__", "%{}", "%", "<<>>", "->", "access", "fn", "&", "@", "!", "^") else Call(None, x.name, x.args, x, piped)
    if x.name.name == "." and len(x.name.args) == 2 and isinstance(x.name.args[1], Atom):
        owner = x.name.args[0]
        module = alias_name(owner) or (f":{owner}" if isinstance(owner, Atom) else None)
        return Call(module, x.name.args[1].name, x.args, x, piped) if module else None
    return None


def is_var(x: Any, *names: str) -> bool:
    return isinstance(x, Node) and x.args is None and isinstance(x.name, str) and (not names or x.name in names)


def keywords(x: Any) -> dict[str, Any]:
    """A keyword list as a mapping; empty for anything else."""
    if isinstance(x, list) and x and all(isinstance(i, Tup) and len(i.items) == 2 and isinstance(i.items[0], Atom) for i in x):
        return {i.items[0].name: i.items[1] for i in x}
    return {}


def sections(node: Node) -> dict[str, Any]:
    """The do block and its other parts."""
    last = node.args[-1] if node.args else None
    return keywords(last) if isinstance(last, list) and "do" in keywords(last) else {}


def statements(body: Any) -> list:
    return body.args if isinstance(body, Node) and body.name == "__block__" else [] if body is None else [body]


def pipeline(x: Any) -> list:
    """The stages of a pipe, first to last."""
    return [*pipeline(x.args[0]), x.args[1]] if isinstance(x, Node) and x.name == "|>" and not (x.parens and False) else [x]


def flows(tree: Any) -> Iterator[tuple[Any, bool, Call]]:
    """(producer, whether it is itself piped into, consumer) for every value that goes as first argument into a call."""
    inside: set[int] = set()
    for x in walk(tree):
        if isinstance(x, Node) and x.name == "|>" and id(x) not in inside:
            stages = pipeline(x)
            y = x
            while isinstance(y, Node) and y.name == "|>":
                inside.add(id(y))
                y = y.args[0]
            for k in range(1, len(stages)):
                if c := call(stages[k], True):
                    yield stages[k - 1], k > 1, c
        elif (c := call(x)) and c.args:
            first = c.args[0]
            if isinstance(first, Node) and first.name == "|>":
                stages = pipeline(first)
                yield stages[-1], True, c
            else:
                yield first, False, c


def position(x: Any) -> tuple[int, int]:
    if isinstance(x, (Node, Text, Sigil, Tup)):
        if isinstance(x, Node) and isinstance(x.name, Node) and x.name.name == ".":
            return position(x.name.args[0]) if position(x.name.args[0])[0] else (x.line, x.column)
        return x.line, x.column
    for y in elixir.children(x):
        if (p := position(y))[0]:
            return p
    return 0, 0


def show(x: Any) -> str:
    """The tree as one line, for comparison."""
    if isinstance(x, Node):
        name = x.name if isinstance(x.name, str) else show(x.name)
        return name if x.args is None else f"{name}({','.join(map(show, x.args))})"
    if isinstance(x, Tup):
        return "{" + ",".join(map(show, x.items)) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(show, x)) + "]"
    if isinstance(x, Text):
        return '"' + "".join(p if isinstance(p, str) else "#{" + show(p) + "}" for p in x.parts) + '"'
    if isinstance(x, Sigil):
        return f"~{x.name}({x.text})"
    return f":{x.name}" if isinstance(x, Atom) else repr(x)


class Source:
    """One file.  A file that can't be read has no tree and gives no issues of code."""

    def __init__(self, file: str, content: str):
        self.file, self.content = file, content or ""

    @cached_property
    def _parsed(self) -> tuple[Any, list]:
        if self.file.endswith(".heex"):
            return Node("__block__", [], 1, 1), []
        try:
            return elixir.parse(self.content)
        except (elixir.ParseError, RecursionError, IndexError):
            return Node("__block__", [], 1, 1), []

    @property
    def tree(self) -> Any:
        return self._parsed[0]

    @property
    def comments(self) -> list[tuple[int, str]]:
        return self._parsed[1]

    @cached_property
    def nodes(self) -> list:
        return list(walk(self.tree))

    @cached_property
    def calls(self) -> list[Call]:
        """All calls, those in pipes with ``piped``."""
        piped = {id(x.args[1]) for x in self.nodes if isinstance(x, Node) and x.name == "|>"}
        return [c for x in self.nodes if (c := call(x, id(x) in piped))]

    @cached_property
    def flows(self) -> list[tuple[Any, bool, Call]]:
        return list(flows(self.tree))

    @cached_property
    def modules(self) -> list[tuple[str, Node]]:
        """Names (nested ones in full) and nodes of the modules."""
        out = []

        def into(x: Any, around: str) -> None:
            for y in [x] if isinstance(x, Node) else elixir.children(x):
                if isinstance(y, Node) and y.name == "defmodule" and y.args and (name := alias_name(y.args[0])):
                    full = f"{around}.{name}" if around else name
                    out.append((full, y))
                    into(sections(y).get("do"), full)
                else:
                    for z in elixir.children(y):
                        if isinstance(z, (Node, Tup, list)):
                            into(z, around)

        into(self.tree, "")
        return out

    def own(self, module: Node) -> list:
        """The statements right in a module."""
        return statements(sections(module).get("do"))

    @cached_property
    def definitions(self) -> list[Definition]:
        return [d for name, m in self.modules for x in self.own(m) if (d := definition(x, name))]

    @cached_property
    def type_attributes(self) -> list[tuple[str, Any, Node]]:
        """(attribute, expression, node) of specs and types."""
        out = []
        for x in self.nodes:
            if isinstance(x, Node) and x.name == "@" and isinstance(x.args[0], Node) and x.args[0].name in TYPE_ATTRIBUTES and x.args[0].args:
                out.append((x.args[0].name, x.args[0].args[0], x))
        return out

    @cached_property
    def templates(self) -> list[templates.Template]:
        if self.file.endswith(".heex"):
            return [templates.read(self.content)]
        return [templates.read(x.text, x.text_line, x.column + 3 if x.text_line == x.line else 1) for x in self.nodes if isinstance(x, Sigil) and x.name == "H"]

    def outside(self, paths: Any) -> bool:
        """Whether the file is in none of ``paths`` (parts of a path, or patterns)."""
        return not any(p.search(self.file) if isinstance(p, re.Pattern) else p in self.file for p in paths or ())


def definition(x: Any, module: str) -> Definition | None:
    if not (isinstance(x, Node) and x.name in DEFINITIONS and x.args):
        return None
    head, guard = x.args[0], None
    if isinstance(head, Node) and head.name == "when":
        head, guard = head.args[0], head.args[1]
    if not isinstance(head, Node) or not isinstance(head.name, str):
        return None
    parts = sections(x) or (keywords(x.args[1]) if len(x.args) > 1 else {})
    return Definition(x.name, head.name, head.args or [], guard, parts.get("do"), x, module, list(parts))
