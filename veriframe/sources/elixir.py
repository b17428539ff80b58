"""A reader of Elixir source: text to expression trees.

A tree is made of Node (a call, operator or variable: ``name`` is a string, or a Node for calls like ``Mod.fun()``),
Atom, Sigil, Text (a string, with the expressions in it), Python numbers, lists, and Tup.  Keyword lists are lists of
pairs (Tup with an Atom first, marked ``keyword``).  Blocks (do, else, rescue ...) are a keyword list as last argument,
and ``->`` clauses a list of Node("->", [[patterns], body]).  A variable has ``args`` None.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any


class ParseError(ValueError):
    """The source can't be read."""


@dataclass(eq=False)
class Node:
    name: Any
    args: list | None
    line: int
    column: int
    end_line: int = 0
    block: bool = False  # has a do block
    parens: bool = False


@dataclass(frozen=True)
class Atom:
    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(eq=False)
class Text:
    parts: list
    line: int
    column: int
    char_list: bool = False

    @property
    def plain(self) -> str:
        return "".join(p if isinstance(p, str) else "#{}" for p in self.parts)


@dataclass(eq=False)
class Sigil:
    name: str
    text: str
    line: int
    column: int
    text_line: int = 0


@dataclass(eq=False)
class Tup:
    items: list
    line: int
    column: int
    keyword: bool = False
    block_key: bool = False


@dataclass
class Token:
    kind: str
    value: Any
    line: int
    column: int
    space: bool  # white space before
    end_line: int = 0
    extra: Any = field(default=None)


OPERATORS = ["<<~", "~>>", "<~>", "<<<", ">>>", "===", "!==", "&&&", "|||", "^^^", "+++", "---", "...", "..", "->", "<-", "|>", "<~", "~>", "=>", "==", "!=", "=~", "<=", ">=", "&&", "||", "<>", "++", "--", "**", "//", "\\\\", "::", "<<", ">>", "+", "-", "*", "/", "=", "<", ">", "!", "^", "&", "|", "@", ".", ","]
#: operator -> (binding power, right associative)
BINARY = {}
for _power, _right, _ops in (
    (40, False, "<- \\\\"), (50, True, "when"), (60, True, "::"), (70, True, "|"), (80, True, "=>"), (100, True, "="), (120, False, "|| ||| or"), (130, False, "&& &&& and"),
    (140, False, "== != =~ === !=="), (150, False, "< > <= >="), (160, False, "|> <<< >>> <<~ ~>> <~ ~> <~>"), (170, False, "in not_in"), (180, False, "^^^"), (190, True, "//"),
    (200, True, "++ -- .. <> +++ ---"), (210, False, "+ -"), (220, False, "* /"), (230, False, "**"),
):
    for _op in _ops.split():
        BINARY[_op] = (_power, _right)
UNARY = {"&": 90, "+": 300, "-": 300, "!": 300, "^": 300, "not": 300, "@": 320}
BLOCK_WORDS = ("else", "rescue", "catch", "after")
_NAME = re.compile(r"[a-z_ß-￿][\w]*[?!]?")
_ALIAS = re.compile(r"[A-Z]\w*")
_NUMBER = re.compile(r"0x[0-9a-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(\.\d[\d_]*([eE][+-]?\d+)?)?")
_CLOSE = {"(": ")", "[": "]", "{": "}", "<": ">", "/": "/", "|": "|", '"': '"', "'": "'"}


class _Lexer:
    def __init__(self, source: str, line: int = 1, column: int = 1):
        self.s, self.i, self.line, self.start = source, 0, line, 1 - column
        self.tokens: list[Token] = []
        self.comments: list[tuple[int, str]] = []

    @property
    def column(self) -> int:
        return self.i - self.start + 1

    def _new_line(self) -> None:
        self.line += 1
        self.start = self.i

    def _add(self, kind: str, value: Any, line: int, column: int, space: bool, extra: Any = None) -> None:
        self.tokens.append(Token(kind, value, line, column, space, self.line, extra))

    def run(self) -> list[Token]:
        s, n = self.s, len(self.s)
        depth: list[str] = []
        while self.i < n:
            c = s[self.i]
            space = self.i == 0 or s[self.i - 1] in " \t\n\r"
            line, column = self.line, self.column
            if c in " \t\r":
                self.i += 1
            elif c == "\\" and s[self.i + 1 : self.i + 2] == "\n":
                self.i += 2
                self._new_line()
            elif c == "\n":
                self.i += 1
                self._new_line()
                self._add("eol", "\n", line, column, space)
            elif c == ";":
                self.i += 1
                self._add("eol", ";", line, column, space)
            elif c == "#":
                end = s.find("\n", self.i)
                end = n if end < 0 else end
                self.comments.append((line, s[self.i : end]))
                self.i = end
            elif s.startswith('"""', self.i) or s.startswith("'''", self.i):
                parts = self._heredoc(s[self.i : self.i + 3], True)
                self._add("text", parts, line, column, space, c == "'")
            elif c in "\"'":
                self.i += 1
                parts = self._until(c, True)
                if c == '"' and self._colon_after():
                    self.i += 1
                    self._add("key", "".join(p if isinstance(p, str) else "#{}" for p in parts), line, column, space)
                else:
                    self._add("text", parts, line, column, space, c == "'")
            elif c == "~" and re.match(r"~[a-zA-Z]+[(\[{<|/\"']", s[self.i : self.i + 12]):
                self._sigil(line, column, space)
            elif c == "?" and self.i + 1 < n and not (s[self.i + 1] in " \n" and space):
                k = 3 if s[self.i + 1] == "\\" else 2
                self._add("number", ord(s[self.i + k - 1]), line, column, space)
                self.i += k
            elif c.isdigit():
                m = _NUMBER.match(s, self.i)
                text = m[0].replace("_", "")
                self.i = m.end()
                self._add("number", float(text) if m[1] else int(text, 0) if text[:2] in ("0x", "0b", "0o") else int(text), line, column, space)
            elif c == ":" and s[self.i + 1 : self.i + 2] == '"':
                self.i += 2
                self._add("atom", "".join(p if isinstance(p, str) else "#{}" for p in self._until('"', True)), line, column, space)
            elif c == ":" and s[self.i + 1 : self.i + 2] != ":" and (m := re.compile(r":([\w@]+[?!]?)").match(s, self.i)) and not m[1][0].isdigit():
                self.i = m.end()
                self._add("atom", m[1], line, column, space)
            elif c == ":" and s[self.i + 1 : self.i + 2] != ":" and (op := next((o for o in ["<<>>", *OPERATORS, "%{}", "{}", "%"] if s.startswith(o, self.i + 1)), None)):
                self.i += 1 + len(op)
                self._add("atom", op, line, column, space)
            elif m := _ALIAS.match(s, self.i):
                self.i = m.end()
                self._name("alias", m[0], line, column, space)
            elif m := _NAME.match(s, self.i):
                self.i = m.end()
                self._name("name", m[0], line, column, space)
            elif c in "([{":
                self.i += 1
                depth.append(c)
                self._add(c, c, line, column, space)
            elif c in ")]}":
                self.i += 1
                self._add(c, c, line, column, space)
            elif c == "%":
                self.i += 1
                self._add("%", "%", line, column, space)
            elif op := next((o for o in OPERATORS if s.startswith(o, self.i)), None):
                self.i += len(op)
                if op == "&" and (m := re.compile(r"\d+").match(s, self.i)):
                    self.i = m.end()
                    self._add("capture", int(m[0]), line, column, space)
                else:
                    self._add("op", op, line, column, space)
            else:
                raise ParseError(f"line {line}: {c!r}")
        self._add("eol", "\n", self.line, self.column, True)
        self._add("eof", None, self.line, self.column, True)
        return self.tokens

    def _colon_after(self) -> bool:
        return self.s.startswith(":", self.i) and not self.s.startswith("::", self.i) and (self.i + 1 >= len(self.s) or self.s[self.i + 1] in " \n\t")

    def _name(self, kind: str, name: str, line: int, column: int, space: bool) -> None:
        if self._colon_after():
            self.i += 1
            self._add("key", name, line, column, space)
        elif kind == "name" and name in ("and", "or", "in", "when", "not"):
            self._add("op", name, line, column, space)
        elif kind == "name" and name in ("do", "end", "fn", *BLOCK_WORDS) and not (self.tokens and self.tokens[-1].value == "." and self.tokens[-1].kind == "op"):
            self._add("word", name, line, column, space)
        elif kind == "name" and name in ("true", "false", "nil"):
            self._add("constant", {"true": True, "false": False, "nil": None}[name], line, column, space)
        else:
            self._add(kind, name, line, column, space)

    def _interpolation(self) -> Any:
        """At the brace of ``#{``; gives the tree inside."""
        self.i += 1
        inner = _Lexer(self.s[self.i :], self.line, self.column)
        depth, k = 0, 0
        text = self.s[self.i :]
        while k < len(text):
            c = text[k]
            if c in "\"'" :
                k += 1
                while k < len(text) and text[k] != c:
                    k += 2 if text[k] == "\\" else 1
            elif c == "{":
                depth += 1
            elif c == "}":
                if not depth:
                    break
                depth -= 1
            k += 1
        inner.s = text[:k]
        tree = _Parser(inner.run()).program()
        for j in range(k):
            if text[j] == "\n":
                self.i += 1
                self._new_line()
            else:
                self.i += 1
        self.i += 1
        return tree

    def _until(self, close: str, interpolate: bool) -> list:
        out: list = [""]
        s, n = self.s, len(self.s)
        while True:
            if self.i >= n:
                raise ParseError(f"line {self.line}: text without end")
            c = s[self.i]
            if c == "\\" and self.i + 1 < n:
                out[-1] += {"n": "\n", "t": "\t", "s": " "}.get(s[self.i + 1], s[self.i + 1])
                self.i += 2
                if s[self.i - 1] == "\n":
                    self._new_line()
            elif s.startswith(close, self.i):
                self.i += len(close)
                return [p for p in out if p != ""]
            elif interpolate and c == "#" and s[self.i + 1 : self.i + 2] == "{":
                self.i += 1
                out += [self._interpolation(), ""]
            else:
                out[-1] += c
                self.i += 1
                if c == "\n":
                    self._new_line()

    def _heredoc(self, quotes: str, interpolate: bool) -> list:
        self.i = self.s.find("\n", self.i) + 1
        self._new_line()
        return self._until(quotes, interpolate)

    def _sigil(self, line: int, column: int, space: bool) -> None:
        m = re.compile(r"~([a-zA-Z]+)").match(self.s, self.i)
        name = m[1]
        self.i = m.end()
        if self.s.startswith(('"""', "'''"), self.i):
            quotes = self.s[self.i : self.i + 3]
            self.i = self.s.find("\n", self.i) + 1
            self._new_line()
            first, text_line = self.i, self.line
            end = self.s.find(quotes, self.i)
        else:
            close = _CLOSE[self.s[self.i]]
            self.i += 1
            first, text_line, quotes = self.i, self.line, close
            end = self.i
            while end < len(self.s) and not self.s.startswith(close, end):
                if name.islower() and self.s.startswith("#{", end):
                    end = self._brace_end(end + 2)
                else:
                    end += 2 if self.s[end] == "\\" else 1
        if end < 0 or end > len(self.s):
            raise ParseError(f"line {line}: sigil without end")
        text = self.s[first:end]
        while self.i < end:
            self.i += 1
            if self.s[self.i - 1] == "\n":
                self._new_line()
        self.i = end + len(quotes)
        if m := re.compile(r"[a-zA-Z]+").match(self.s, self.i):
            self.i = m.end()
        self._add("sigil", (name, text, text_line), line, column, space)

    def _brace_end(self, k: int) -> int:
        """Past the brace that closes the one before ``k``."""
        depth = 1
        while k < len(self.s) and depth:
            depth += {"{": 1, "}": -1}.get(self.s[k], 0)
            k += 1
        return k


_STARTS = {"name", "alias", "atom", "number", "text", "sigil", "constant", "capture", "key", "%"}


class _Parser:
    def __init__(self, tokens: list[Token]):
        self.t, self.k = tokens, 0
        self.no_do = 0

    @property
    def now(self) -> Token:
        return self.t[self.k]

    def peek(self, d: int = 1) -> Token:
        return self.t[min(self.k + d, len(self.t) - 1)]

    def is_(self, kind: str, value: Any = None) -> bool:
        return self.now.kind == kind and (value is None or self.now.value == value)

    def take(self, kind: str, value: Any = None) -> Token:
        if not self.is_(kind, value):
            raise ParseError(f"line {self.now.line}: {self.now.value!r} instead of {value or kind}")
        self.k += 1
        return self.t[self.k - 1]

    def skip(self) -> None:
        while self.is_("eol"):
            self.k += 1

    def program(self) -> Any:
        out = self.block(())
        if not self.is_("eof"):
            raise ParseError(f"line {self.now.line}: unexpected {self.now.value!r}")
        return out

    def _body(self, rows: list, at: Token) -> Any:
        return rows[0] if len(rows) == 1 else Node("__block__", rows, at.line, at.column)

    def _block_end(self, ends: tuple) -> bool:
        return self.is_("eof") or (self.is_("word") and self.now.value in ends) or (self.now.kind in (")", "}", "]"))

    def block(self, ends: tuple) -> Any:
        """Expressions, or ``->`` clauses as a list, up to an end word."""
        self.skip()
        at, rows, clauses = self.now, [], []
        while not self._block_end(ends):
            if self._is_clause(ends):
                clauses.append(self._clause(ends))
            else:
                rows.append(self.expr())
            if not self._block_end(ends):
                self.take("eol")
            self.skip()
        return clauses if clauses else self._body(rows, at)

    def _is_clause(self, ends: tuple) -> bool:
        """Whether an arrow comes before the expression ends."""
        depth, k = 0, self.k
        while k < len(self.t):
            t = self.t[k]
            if t.kind in ("(", "[", "{") or (t.kind == "word" and t.value in ("do", "fn")) or (t.kind == "op" and t.value == "<<"):
                depth += 1
            elif t.kind in (")", "]", "}") or (t.kind == "word" and t.value == "end") or (t.kind == "op" and t.value == ">>"):
                depth -= 1
                if depth < 0:
                    return False
            elif depth == 0:
                if t.kind == "op" and t.value == "->":
                    return True
                if t.kind == "eof" or (t.kind == "word" and t.value in BLOCK_WORDS):
                    return False
                if t.kind == "eol":
                    before, after = self.t[k - 1], next((x for x in self.t[k:] if x.kind != "eol"), self.t[-1])
                    goes_on = before.kind == "op" or (after.kind == "op" and after.value in BINARY and after.value not in ("+", "-")) or (before.kind == "word" and before.value == "fn")
                    if not goes_on:
                        return False
            k += 1
        return False

    def _clause(self, ends: tuple) -> Node:
        at = self.now
        patterns: list = []
        parens = self.is_("(") and self._closes_before_arrow()
        if parens:
            self.take("(")
            self.skip()
            patterns = self._args(")")
            self.take(")")
        elif not self.is_("op", "->"):
            patterns = self._args(None)
        self.skip()
        if self.is_("op", "when"):
            self.k += 1
            self.skip()
            patterns = [Node("when", [*patterns, self.expr()], at.line, at.column)]
        self.take("op", "->")
        self.skip()
        rows, first = [], self.now
        while not self._block_end(ends):
            rows.append(self.expr())
            if self._block_end(ends):
                break
            self.take("eol")
            self.skip()
            if not self._block_end(ends) and self._is_clause(ends):
                self.k -= 1
                while not self.is_("eol"):
                    self.k -= 1
                break
        return Node("->", [patterns, self._body(rows, first)], at.line, at.column)

    def _closes_before_arrow(self) -> bool:
        depth, k = 0, self.k
        while k < len(self.t):
            depth += self.t[k].kind in ("(", "[", "{")
            depth -= self.t[k].kind in (")", "]", "}")
            if not depth:
                after = next((x for x in self.t[k + 1 :] if x.kind != "eol"), self.t[-1])
                return after.kind == "op" and after.value in ("->", "when")
            k += 1
        return False

    def expr(self, power: int = 0) -> Any:
        left = self._prefix()
        while True:
            k = self.k
            if self.is_("eol"):
                while self.is_("eol") and self.now.value == "\n":
                    self.k += 1
                if not (self.is_("op") and self.now.value in BINARY and not (self.now.value in ("+", "-") or (self.now.value == "not"))):
                    self.k = k
                    return left
            t = self.now
            op = "not_in" if self.is_("op", "not") and self.peek().kind == "op" and self.peek().value == "in" else t.value
            if t.kind != "op" or op not in BINARY:
                self.k = k
                return left
            level, right = BINARY[op]
            if level < power or op == "->":
                self.k = k
                return left
            self.k += 2 if op == "not_in" else 1
            self.skip()
            if op == "|" and self._is_key():
                left = Node("|", [left, self._keywords(None)], t.line, t.column)
                continue
            other = self._keywords(None) if op == "when" and self._is_key() else self.expr(level if right else level + 1)
            if op == "in" and isinstance(left, Node) and left.name == "not" and not left.parens:
                # "not a in b" is read as "not (a in b)"
                left = Node("not", [Node("in", [left.args[0], other], t.line, t.column)], left.line, left.column)
                continue
            node = Node("in" if op == "not_in" else op, [left, other], t.line, t.column)
            left = Node("not", [node], t.line, t.column) if op == "not_in" else node

    def _is_key(self) -> bool:
        return self.is_("key")

    def _prefix(self) -> Any:
        t = self.now
        if t.kind == "op" and t.value in UNARY:
            self.k += 1
            self.skip()
            return Node(t.value, [self.expr(UNARY[t.value])], t.line, t.column)
        if t.kind == "op" and t.value in ("...", ".."):
            self.k += 1
            return Node(t.value, [], t.line, t.column)
        return self._postfix(self._primary())

    def _primary(self) -> Any:
        t = self.now
        self.k += 1
        if t.kind == "number" or t.kind == "constant":
            return t.value if t.kind == "number" else Atom({True: "true", False: "false", None: "nil"}[t.value])
        if t.kind == "atom":
            return Atom(t.value)
        if t.kind == "text":
            return Text(t.value, t.line, t.column, bool(t.extra))
        if t.kind == "sigil":
            return Sigil(t.value[0], t.value[1], t.line, t.column, t.value[2])
        if t.kind == "capture":
            return Node("&", [t.value], t.line, t.column)
        if t.kind == "alias":
            return Node("__aliases__", [t.value], t.line, t.column)
        if t.kind == "name":
            return self._call(t.value, t)
        if t.kind == "(":
            self.skip()
            inner = self.block(())
            self.skip()
            self.take(")")
            if isinstance(inner, Node):
                inner.parens = True
            return inner
        if t.kind == "[":
            self.skip()
            items = self._args("]")
            self.take("]")
            # bare keywords at the end are items of the list itself
            return [*items[:-1], *items[-1]] if self._bare else items
        if t.kind == "{":
            self.skip()
            items = self._args("}")
            self.take("}")
            return Tup(items, t.line, t.column)
        if t.kind == "%":
            return self._map(t)
        if t.kind == "op" and t.value == "<<":
            self.skip()
            items = self._args(">>")
            self.take("op", ">>")
            return Node("<<>>", items, t.line, t.column)
        if t.kind == "word" and t.value == "fn":
            clauses = self.block(("end",))
            end = self.take("word", "end")
            return Node("fn", clauses if isinstance(clauses, list) else [clauses], t.line, t.column, end.line)
        if t.kind == "key":
            self.k -= 1
            return self._keywords(None)
        raise ParseError(f"line {t.line}: unexpected {t.value!r}")

    def _map(self, t: Token) -> Node:
        struct = None
        if not self.is_("{"):
            struct = self._postfix(self._primary(), call=False) if not self.is_("op") else self._prefix_struct()
        self.take("{")
        self.skip()
        items = self._args("}")
        self.take("}")
        body = Node("%{}", items, t.line, t.column)
        return Node("%", [struct, body], t.line, t.column) if struct is not None else body

    def _prefix_struct(self) -> Any:
        t = self.now
        self.k += 1
        return Node(t.value, [self._primary()], t.line, t.column)

    _bare = False

    def _args(self, close: str | None) -> list:
        """Arguments up to ``close`` (not taken), keywords at the end as one list."""
        out: list = []
        bare = False
        while True:
            if close is not None:
                self.skip()
                if self.is_(close) or (close == ">>" and self.is_("op", ">>")):
                    break
            if self._is_key():
                out.append(self._keywords(close))
                bare = True
                break
            keep, self.no_do = self.no_do, 0 if close else self.no_do
            out.append(self.expr())
            self.no_do = keep
            if close is not None:
                self.skip()
            if not self.is_("op", ","):
                break
            self.k += 1
            self.skip()
        self._bare = bare
        return out

    def _keywords(self, close: str | None) -> list:
        out = []
        while self._is_key():
            t = self.take("key")
            self.skip()
            keep, self.no_do = self.no_do, 0 if close else self.no_do
            value = self.expr()
            self.no_do = keep
            out.append(Tup([Atom(t.value), value], t.line, t.column, keyword=True))
            k = self.k
            if close is not None:
                self.skip()
            if not self.is_("op", ","):
                if close is None:
                    self.k = k
                break
            self.k += 1
            self.skip()
            if not self._is_key():
                self.k = k if close is None else self.k
                break
        return out

    def _begins_args(self, t: Token) -> bool:
        """Whether ``now`` can begin arguments without parentheses."""
        n = self.now
        if not n.space or n.line != t.end_line:
            return False
        if n.kind in _STARTS or (n.kind == "word" and n.value == "fn") or n.kind in ("{", "["):
            return True
        if n.kind == "(":
            return True
        if n.kind == "op":
            after = self.peek()
            if n.value in ("-", "+", "&", "^", "!", "@"):
                return not after.space or n.value in ("!", "@", "^")
            return n.value in ("<<", "not", "...") and not (n.value == "not" and after.value == "in")
        return False

    def _call(self, name: Any, t: Token) -> Any:
        if self.is_("(") and not self.now.space:
            self.k += 1
            self.skip()
            args = self._args(")")
            self.take(")")
            return self._do(Node(name, args, t.line, t.column, parens=True))
        if self._begins_args(t):
            self.no_do += 1
            args = self._args(None)
            self.no_do -= 1
            return self._do(Node(name, args, t.line, t.column))
        return self._do(Node(name, None, t.line, t.column))

    def _do(self, node: Node) -> Node:
        """Takes a do block as the last argument."""
        if not self.is_("word", "do") or self.no_do:
            return node
        at = self.take("word", "do")
        keep, self.no_do = self.no_do, 0
        ends = ("end", *BLOCK_WORDS)
        sections = [Tup([Atom("do"), self.block(ends)], at.line, at.column, True, True)]
        while self.is_("word") and self.now.value in BLOCK_WORDS:
            w = self.now
            self.k += 1
            sections.append(Tup([Atom(w.value), self.block(ends)], w.line, w.column, True, True))
        end = self.take("word", "end")
        self.no_do = keep
        node.args = [*(node.args or []), sections]
        node.block, node.end_line = True, end.line
        return node

    def _postfix(self, left: Any, call: bool = True) -> Any:
        while True:
            t = self.now
            k = self.k
            if t.kind == "eol" and t.value == "\n":
                d = 0
                while self.peek(d).kind == "eol":
                    d += 1
                if not (self.peek(d).kind == "op" and self.peek(d).value == "."):
                    return left
                self.k += d
                t = self.now
            if t.kind == "op" and t.value == ".":
                self.k += 1
                self.skip()
                n = self.now
                if n.kind == "alias":
                    self.k += 1
                    if isinstance(left, Node) and left.name == "__aliases__":
                        left = Node("__aliases__", [*left.args, n.value], left.line, left.column)
                    else:
                        left = Node("__aliases__", [left, n.value], t.line, t.column)
                elif n.kind == "(":
                    self.k += 1
                    self.skip()
                    args = self._args(")")
                    self.take(")")
                    left = Node(Node(".", [left], t.line, t.column), args, t.line, t.column, parens=True)
                elif n.kind == "{":
                    self.k += 1
                    self.skip()
                    args = self._args("}")
                    self.take("}")
                    left = Node(Node(".", [left, Atom("{}")], t.line, t.column), args, t.line, t.column)
                elif n.kind in ("name", "op", "text", "word") or n.kind == "key":
                    if n.kind == "key":
                        self.k = k
                        return left
                    self.k += 1
                    name = n.value if isinstance(n.value, str) else "".join(map(str, n.value))
                    left = self._call(Node(".", [left, Atom(name)], t.line, t.column), n)
                    if left.args is None:
                        left.args = []
                else:
                    raise ParseError(f"line {n.line}: unexpected {n.value!r} after a dot")
                if not call:
                    continue
            elif t.kind == "[" and not t.space:
                self.k += 1
                self.skip()
                index = self._args("]")
                self.take("]")
                left = Node("access", [left, *index], t.line, t.column)
            elif t.kind == "(" and not t.space and isinstance(left, Node) and left.parens and not isinstance(left.name, str):
                self.k += 1
                self.skip()
                args = self._args(")")
                self.take(")")
                left = Node(left, args, t.line, t.column, parens=True)
            else:
                return left


def parse(source: str) -> tuple[Any, list[tuple[int, str]]]:
    """The tree and the comments (line, text)."""
    lexer = _Lexer(source)
    return _Parser(lexer.run()).program(), lexer.comments


def children(x: Any) -> list:
    if isinstance(x, Node):
        return [*([x.name] if isinstance(x.name, Node) else []), *(x.args or [])]
    if isinstance(x, Tup):
        return x.items
    if isinstance(x, list):
        return x
    if isinstance(x, Text):
        return [p for p in x.parts if not isinstance(p, str)]
    return []


def walk(x: Any, skip=None):
    """All parts of a tree, outermost first; not into those for which ``skip`` is true."""
    todo = [x]
    while todo:
        x = todo.pop()
        yield x
        if skip is None or not skip(x):
            todo += reversed(children(x))
