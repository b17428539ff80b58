"""Elements of a page by the standard library's parser, for comparison."""

from __future__ import annotations

from html.parser import HTMLParser

#: Fixed values of the HTML standard: elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose open sibling ends where they begin.
SIBLINGS = {"li": "li", "option": "option", "tr": "tr", "td": "td", "th": "th", "dt": "dt", "dd": "dd", "p": "p"}


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple] = []
        self._open: list[tuple[int, str]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self._open and SIBLINGS.get(tag) == self._open[-1][1]:
            self._open.pop()
        parent = self._open[-1][0] if self._open else None
        self.rows.append((len(self.rows), parent, len(self._open), tag, [{"name": n, "value": "" if v is None else v} for n, v in attrs], self.get_starttag_text()))
        if tag not in VOID:
            self._open.append((len(self.rows) - 1, tag))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self._open:
            self._open.pop()

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self._open) - 1, -1, -1):
            if self._open[k][1] == tag:
                del self._open[k:]
                break


def parse(html: str | None) -> list[tuple]:
    """(ordinal, parent, depth, tag, attributes, snippet) of every element; none for null."""
    if not html:
        return []
    reader = _Reader()
    reader.feed(html)
    reader.close()
    return reader.rows
