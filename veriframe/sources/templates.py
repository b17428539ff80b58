"""Template tokens: start tags with attributes, text, expressions and end tags, in order.

A template is a file that ends with ``.heex`` or an ``~H`` sigil.  An attribute's value is a string, an expression or
nothing; an expression in place of attributes is the attribute ``:root``.  A template in which a tag, a quoted value, an
expression or a comment isn't closed has no tokens.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NAME = re.compile(r"[:.]?[A-Za-z][\w.:-]*")
_ATTR = re.compile(r"[^\s=/>{\"'<]+")


@dataclass
class Attr:
    name: str
    kind: str | None  # "string", "expr" or None
    value: str | None
    line: int
    column: int


@dataclass
class Tag:
    kind: str  # "tag", "local_component", "remote_component" or "slot"
    name: str
    attrs: list[Attr]
    closing: str | None  # "self", "void" or None
    line: int
    column: int

    def has(self, *names: str) -> bool:
        return any(a.name in names for a in self.attrs)

    @property
    def spread(self) -> bool:
        return self.has(":root")

    def get(self, name: str) -> Attr | None:
        return next((a for a in self.attrs if a.name == name), None)

    def static(self, name: str) -> str | None:
        a = self.get(name)
        return a.value if a and a.kind == "string" else None

    @property
    def trigger(self) -> str:
        return f"<{'.' if self.kind == 'local_component' else ':' if self.kind == 'slot' else ''}{self.name}"


@dataclass
class Words:
    text: str
    line: int
    column: int


@dataclass
class Expression:
    text: str
    line: int
    column: int


@dataclass
class Close:
    name: str
    line: int
    column: int


@dataclass
class Template:
    line: int
    column: int
    tokens: list = field(default_factory=list)

    @property
    def tags(self) -> list[Tag]:
        return [t for t in self.tokens if isinstance(t, Tag)]


class Unclosed(ValueError):
    """Something in the template has no end."""


class _Reader:
    def __init__(self, text: str, line: int, column: int):
        self.s, self.i, self.line, self.start = text, 0, line, 1 - column
        self.out: list = []

    def _go(self, to: int) -> None:
        for k in range(self.i, to):
            if self.s[k] == "\n":
                self.line, self.start = self.line + 1, k + 1
        self.i = to

    @property
    def column(self) -> int:
        return self.i - self.start + 1

    def _braces(self, k: int) -> int:
        """Past the brace that closes the one at ``k``; strings inside are skipped."""
        depth = 0
        while k < len(self.s):
            c = self.s[k]
            if c == '"':
                k += 1
                while k < len(self.s) and self.s[k] != '"':
                    k += 2 if self.s[k] == "\\" else 1
            depth += (c == "{") - (c == "}")
            k += 1
            if not depth:
                return k
        raise Unclosed("{")

    def _closed(self, end: int) -> int:
        if end < 0:
            raise Unclosed(f"line {self.line}")
        return end

    def _text(self, to: int) -> None:
        if to > self.i:
            self.out.append(Words(self.s[self.i : to], self.line, self.column))
            self._go(to)

    def run(self) -> list:
        s, k, raw = self.s, 0, None
        while k < len(s):
            if raw:
                end = s.lower().find(f"</{raw}", k)
                end = len(s) if end < 0 else end
                self._text(end)
                k, raw = end, None
            elif s.startswith("<!--", k) or s.startswith("<%!--", k):
                self._text(k)
                end = s.find("-->" if s[k + 1] == "!" else "--%>", k)
                k = self._closed(end) + (3 if s[k + 1] == "!" else 4)
                self._go(k)
            elif s.startswith("<%", k):
                self._text(k)
                end = self._closed(s.find("%>", k))
                m = re.compile(r"<%[=%]?").match(s, k)
                if s[k : k + 3] != "<%%":
                    self.out.append(Expression(s[m.end() : end], self.line, self.column))
                k = min(len(s), end + 2)
                self._go(k)
            elif s[k] == "{":
                self._text(k)
                end = self._braces(k)
                self.out.append(Expression(s[k + 1 : end - 1], self.line, self.column))
                self._go(end)
                k = end
            elif s.startswith("</", k) and (m := _NAME.match(s, k + 2)):
                self._text(k)
                self.out.append(Close(m[0].lstrip(".:"), self.line, self.column))
                k = self._closed(s.find(">", k)) + 1
                self._go(k)
            elif s[k] == "<" and (m := _NAME.match(s, k + 1)):
                self._text(k)
                k = self._tag(m)
                tag = self.out[-1]
                raw = tag.name if tag.kind == "tag" and tag.name in ("script", "style") and not tag.closing else None
            else:
                k += 1
        self._text(len(s))
        return self.out

    def _tag(self, m: re.Match) -> int:
        s, line, column = self.s, self.line, self.column
        name = m[0]
        kind = "local_component" if name[0] == "." else "slot" if name[0] == ":" else "remote_component" if name[0].isupper() else "tag"
        attrs: list[Attr] = []
        self._go(m.end())
        closing = "void" if kind == "tag" and name.lower() in VOID else None
        while self.i < len(s):
            c = s[self.i]
            if c.isspace():
                self._go(self.i + 1)
            elif s.startswith("/>", self.i):
                closing = "self"
                self._go(self.i + 2)
                break
            elif c == ">":
                self._go(self.i + 1)
                break
            elif c == "{":
                end = self._braces(self.i)
                attrs.append(Attr(":root", "expr", s[self.i + 1 : end - 1], self.line, self.column))
                self._go(end)
            elif a := _ATTR.match(s, self.i):
                at = (self.line, self.column)
                self._go(a.end())
                value = re.compile(r"\s*=\s*").match(s, self.i)
                if not value:
                    attrs.append(Attr(a[0], None, None, *at))
                    continue
                self._go(value.end())
                q = s[self.i : self.i + 1]
                if q == "{":
                    end = self._braces(self.i)
                    attrs.append(Attr(a[0], "expr", s[self.i + 1 : end - 1], *at))
                elif q in ('"', "'") and q:
                    end = self._closed(s.find(q, self.i + 1)) + 1
                    attrs.append(Attr(a[0], "string", s[self.i + 1 : end - 1], *at))
                else:
                    bare = re.compile(r"[^\s>]*").match(s, self.i)
                    end = bare.end()
                    attrs.append(Attr(a[0], "string", bare[0], *at))
                self._go(end)
            else:
                self._go(self.i + 1)
        else:
            raise Unclosed(name)
        self.out.append(Tag(kind, name.lstrip(".:"), attrs, closing, line, column))
        return self.i


def read(text: str, line: int = 1, column: int = 1) -> Template:
    try:
        return Template(line, column, _Reader(text, line, column).run())
    except Unclosed:
        return Template(line, column)
