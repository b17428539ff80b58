"""Where source checks are registered."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

from ...sources.code import Source

Found = Iterator[tuple[Any, str]]


@dataclass(frozen=True)
class SourceCheck:
    name: str
    category: str
    run: Callable[[Source, Mapping[str, Any]], Found]


CHECKS: dict[str, SourceCheck] = {}


def check(name: str, category: str):
    """Registers a function that gives (place, message) for each issue; a place is a tree part, token or (line, column)."""

    def add(f):
        CHECKS[name] = SourceCheck(name, category, f)
        return f

    return add
