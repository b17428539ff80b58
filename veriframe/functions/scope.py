"""The scope language of rules, as null-safe column predicates.

A rule is a mapping; ``where`` and ``except`` are one matcher or a list of them.  Matchers are joined by OR, the keys of
one by AND.  A value is a string (equality), a compiled pattern (search anywhere), or a list of both (any).  A null never
matches, also not under ``except``; an array column matches if any element does.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _one(value: Any) -> Callable[[Column], Column]:
    if isinstance(value, re.Pattern):
        flags = "".join(f for bit, f in ((re.IGNORECASE, "i"), (re.MULTILINE, "m"), (re.DOTALL, "s"), (re.VERBOSE, "x")) if value.flags & bit)
        text = f"(?{flags}){value.pattern}" if flags else value.pattern
        return lambda c: _false(c.rlike(text))
    if isinstance(value, (str, bool, int, float)):
        return lambda c: _false(c == F.lit(value))
    raise ValueError(f"a matcher value must be a string or pattern, not {value!r}")


def matches(column: Column, value: Any, is_array: bool = False) -> Column:
    """Whether ``column`` matches a value or any of a list."""
    tests = [_one(v) for v in value] if isinstance(value, (list, tuple, set)) else [_one(value)]
    if not tests:
        raise ValueError("a matcher list must not be empty")
    any_of = lambda c: reduce(or_, [t(c) for t in tests])
    return _false(F.exists(column, any_of)) if is_array else any_of(column)


def _matchers(rule: Mapping[str, Any], part: str) -> list[Mapping[str, Any]]:
    given = rule.get(part)
    if given is None:
        return []
    found = [given] if isinstance(given, Mapping) else list(given)
    if not found or not all(isinstance(m, Mapping) and m for m in found):
        raise ValueError(f"{part} must be a matcher or a non-empty list of matchers")
    return found


def predicate(rule: Mapping[str, Any], columns: Mapping[str, str | Column], arrays: Iterable[str] = ()) -> Column:
    """Whether a row is in the rule's scope.  ``columns``: from matcher keys to columns; ``arrays``: keys of array
    columns."""
    arrays = set(arrays)

    def one(matcher: Mapping[str, Any]) -> Column:
        if unknown := set(matcher) - set(columns):
            raise ValueError(f"unknown matcher keys: {sorted(unknown)}")
        parts = [matches(F.col(c) if isinstance(c := columns[k], str) else c, v, k in arrays) for k, v in matcher.items()]
        return reduce(and_, parts)

    where, but = (reduce(or_, [one(m) for m in found]) if (found := _matchers(rule, part)) else None for part in ("where", "except"))
    inside = F.lit(True) if where is None else where
    return inside if but is None else inside & ~but


def rules_of(options: Mapping[str, Any], allowed: Iterable[str], required: Iterable[str] = (), default: bool = True) -> list[Mapping[str, Any]]:
    """The rules of a check's options: one mapping or a non-empty list; one global rule if there's none and ``default``.

    Unknown keys, and rules without the ``required`` ones, are errors.
    """
    given = options.get("rules")
    if given is None:
        if not default:
            raise ValueError("rules are required")
        own = {k: v for k, v in options.items() if k in set(allowed)}
        found = [own]
    else:
        found = [given] if isinstance(given, Mapping) else list(given)
        if not found:
            raise ValueError("rules must not be empty")
    for rule in found:
        if unknown := set(rule) - set(allowed) - {"where", "except", "validate"}:
            raise ValueError(f"unknown rule keys: {sorted(unknown)}")
        if missing := [k for k in required if not rule.get(k)]:
            raise ValueError(f"rule keys required: {missing}")
    return [r for r in found if r.get("validate", True) is not False]
