"""Query trees, compiled once on the executors into a flat row of facts for each query.

A query is a JSON object: ``operation``; ``from`` {schema, table, prefix, as, subquery}; ``joins`` [{qual, schema, table,
assoc, prefix, hints, on, as, subquery}]; ``wheres`` and ``havings`` [{op: and|or, expr}]; ``order_by`` [expr]; ``limit``
and ``offset`` (expr; a parameter without value is ["param", null]); ``select``, ``distinct``, ``group_by``, ``windows``,
``update`` (expr); ``ctes`` [{name, query}]; ``combinations`` [{op, query}].  An expression is a list: ["and"|"or"|"not",
...], ["=="|"!="|"<"|"<="|">"|">=", a, b], ["in", a, list or expr], ["is_nil", a], ["field", binding, name] with binding
a position or an alias, ["parent", name] for a field of the query around, ["lit"|"param", value, type], ["type", expr,
type], ["fragment", expr...], ["subquery", query].

Branches of a disjunction are kept as lists of facts.  A branch without facts stays, as an empty list: an expression
that isn't understood proves nothing, but it doesn't vanish.  Beyond BRANCH_LIMIT branches a query is marked
``over_limit`` and has one branch with what all of them share, which is all that most checks ask for: of keys the smallest
sets, of which there are mostly few (else ``keys_over``), of mentions the fields in every branch, of rejects the left
joins that every branch rejects, of predicates the empty lists, if every branch has one.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BRANCH_LIMIT = 4096
COMPARISONS = ("==", "!=", "<", "<=", ">", ">=")
MIRROR = {"==": "==", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
EXPRESSIONS = ("select", "distinct", "group_by", "windows", "update")

_SIDE = "struct<binding:int,field:string,schema:string,cast:string,literal:string>"
FACTS = (
    "query_id bigint, operation string, schema string, table_name string, db_schema string, bounded string, ordered boolean, order_fields array<string>, "
    "units array<struct<operation:string,limit_node:boolean,limit_value:boolean,offset_node:boolean,offset_value:boolean,ordered:boolean,probe:boolean>>, "
    "branches array<struct<path:string,schema:string,table_name:string,predicates:array<array<struct<field:string,op:string,vals:array<string>>>>,keys:array<array<string>>,mentions:array<array<string>>,rejects:array<array<struct<binding:int,field:string>>>,left_joins:array<struct<binding:int,alias:string>>>>, "
    "joins array<struct<join_index:int,qual:string,schema:string,assoc:string,alias:string,on_true:boolean,correlated:boolean,key_fields:array<string>,signature:string>>, "
    f"comparisons array<struct<path:string,clause:string,op:string,under_not:boolean,a:{_SIDE},b:{_SIDE}>>, "
    "unnamed array<struct<kind:string,detail:string>>, over_limit boolean, keys_over boolean"
)


class _Over(Exception):
    """Too many branches."""


def _kind(e: Any) -> str | None:
    return e[0] if isinstance(e, list) and e and isinstance(e[0], str) else None


def _walk(e: Any) -> Iterator[list]:
    """All expressions in ``e``, itself first; not into subqueries."""
    if isinstance(e, list):
        if _kind(e):
            yield e
        if _kind(e) not in ("lit", "param", "subquery"):
            for x in e:
                yield from _walk(x)


def _clauses(q: dict) -> Iterator[tuple[str, Any]]:
    for k in ("wheres", "havings"):
        for w in q.get(k) or ():
            yield k[:-1], w["expr"]
    for j in q.get("joins") or ():
        if j.get("on") is not None:
            yield "on", j["on"]
    for k in ("order_by", *EXPRESSIONS, "limit", "offset"):
        if q.get(k) is not None:
            yield k, q[k]


def _nested(q: dict) -> Iterator[tuple[str, dict]]:
    """The queries right inside ``q``."""
    if q["from"].get("subquery"):
        yield "from", q["from"]["subquery"]
    for j in q.get("joins") or ():
        if j.get("subquery"):
            yield "join", j["subquery"]
    for c in q.get("ctes") or ():
        yield "cte", c["query"]
    for c in q.get("combinations") or ():
        yield "combination", c["query"]
    for _, e in _clauses(q):
        for x in _walk(e):
            if x[0] == "subquery":
                yield "expression", x[1]


def _all_queries(q: dict) -> Iterator[dict]:
    yield q
    for _, x in _nested(q):
        yield from _all_queries(x)


def _layers(q: dict) -> list[dict]:
    out = [q]
    while out[-1]["from"].get("subquery"):
        out.append(out[-1]["from"]["subquery"])
    return out


def _set_branches(q: dict, path: tuple = ()) -> Iterator[tuple[str, dict]]:
    yield "/".join(f"{op}:{k}" for op, k in path), q
    for k, c in enumerate(q.get("combinations") or ()):
        yield from _set_branches(c["query"], (*path, (c["op"], k)))


class _Names:
    """Bindings of one query: the root is 0, join i is i + 1."""

    def __init__(self, q: dict):
        self.sources = [q["from"], *(q.get("joins") or ())]
        self.alias = {s["as"]: k for k, s in enumerate(self.sources) if s.get("as")}

    def field(self, e: Any, unwrap: bool = False) -> tuple[int, str] | None:
        if unwrap and _kind(e) == "type":
            e = e[1]
        if _kind(e) != "field":
            return None
        b = e[1] if isinstance(e[1], int) else self.alias.get(e[1])
        return None if b is None or not 0 <= b < len(self.sources) else (b, e[2])

    def schema(self, b: int) -> str | None:
        source = self.sources[b]
        return _layers(source["subquery"])[-1]["from"].get("schema") if source.get("subquery") else source.get("schema")


Leaf = Callable[[Any, bool], list]


def _product(left: list[list], right: list[list]) -> list[list]:
    if len(left) * len(right) > BRANCH_LIMIT:
        raise _Over
    return [a + b for a in left for b in right]


def branches(e: Any, leaf: Leaf, negated: bool = False) -> list[list]:
    """The disjunctive branches of an expression, each a list of what ``leaf`` gives; De Morgan's laws under not."""
    kind = _kind(e)
    if kind == "not":
        return branches(e[1], leaf, not negated)
    if kind in ("and", "or"):
        parts = [branches(x, leaf, negated) for x in e[1:]]
        if (kind == "and") != negated:
            out = parts[0]
            for p in parts[1:]:
                out = _product(out, p)
            return out
        out = [b for p in parts for b in p]
        if len(out) > BRANCH_LIMIT:
            raise _Over
        return out
    return [leaf(e, negated)]


def where_branches(wheres: list[dict], leaf: Leaf) -> list[list]:
    """All where clauses; the first one's operation doesn't matter."""
    out = None
    for w in wheres or ():
        own = branches(w["expr"], leaf)
        out = own if out is None else out + own if w.get("op") == "or" else _product(out, own)
    return [[]] if out is None else out


def _fold(wheres: list[list[dict]], leaf: Leaf, both: Callable, either: Callable) -> Any:
    """All where clauses of all layers, without expanding them; None without any."""

    def of(e: Any, negated: bool) -> Any:
        kind = _kind(e)
        if kind == "not":
            return of(e[1], not negated)
        if kind in ("and", "or"):
            return reduce(both if (kind == "and") != negated else either, [of(x, negated) for x in e[1:]])
        return leaf(e, negated)

    whole = None
    for layer in wheres:
        out = None
        for w in layer or ():
            own = of(w["expr"], False)
            out = own if out is None else (either if w.get("op") == "or" else both)(out, own)
        whole = out if whole is None else whole if out is None else both(whole, out)
    return whole


def _in_all(wheres: list[list[dict]], leaf: Leaf) -> frozenset:
    """What every branch has: either side's of a conjunction, both sides' of a disjunction."""
    return _fold(wheres, lambda e, negated: frozenset(leaf(e, negated)), frozenset.union, frozenset.intersection) or frozenset()


def _smallest(sets: set[frozenset]) -> set[frozenset]:
    """Without those that contain another one."""
    if len(sets) > BRANCH_LIMIT:
        raise _Over
    out: set[frozenset] = set()
    for _, same in groupby(sorted(sets, key=len), key=len):
        out |= {x for x in same if not any(y < x for y in out)}
    return out


def _smallest_sets(wheres: list[list[dict]], leaf: Leaf) -> list[list]:
    """The branches that contain no other one, as sets. Some branch lacks a field, or all of some fields, if one of these
    does."""

    def both(a: set, b: set) -> set:
        if len(a) * len(b) > 16 * BRANCH_LIMIT:
            raise _Over
        return _smallest({x | y for x in a for y in b})

    found = _fold(wheres, lambda e, negated: {frozenset(leaf(e, negated))}, both, lambda a, b: _smallest(a | b))
    return [[]] if found is None else sorted(map(sorted, found))


def boundedness(wheres: list[dict]) -> str:
    """``empty``, ``restricting`` or ``unrestricting``; anything but true, false and their combinations restricts."""

    def both(a: str, b: str) -> str:
        return "empty" if "empty" in (a, b) else "unrestricting" if a == b == "unrestricting" else "restricting"

    def either(a: str, b: str) -> str:
        return "unrestricting" if "unrestricting" in (a, b) else "empty" if a == b == "empty" else "restricting"

    def of(e: Any) -> str:
        kind = _kind(e)
        if kind == "lit" and isinstance(e[1], bool):
            return "unrestricting" if e[1] else "empty"
        if kind == "not":
            return {"empty": "unrestricting", "unrestricting": "empty"}.get(x := of(e[1]), x)
        if kind in ("and", "or"):
            out = of(e[1])
            for x in e[2:]:
                out = (both if kind == "and" else either)(out, of(x))
            return out
        return "restricting"

    state = None
    for w in wheres or ():
        own = of(w["expr"])
        state = own if state is None else (either if w.get("op") == "or" else both)(state, own)
    return state or "unrestricting"


def _value(e: Any) -> str | None:
    return json.dumps(e[1], sort_keys=True) if _kind(e) in ("lit", "param") and isinstance(e[1], (str, int, bool)) else None


def _is_nil(e: Any) -> bool:
    return _kind(e) in ("lit", "param") and e[1] is None


def _has_field(e: Any) -> bool:
    return any(x[0] == "field" for x in _walk(e))


def _predicate(names: _Names) -> Leaf:
    """Root comparisons with known values: ==, in, is_nil."""

    def leaf(e: Any, negated: bool) -> list:
        kind = _kind(e)
        if negated:
            return []
        if kind == "==":
            for x, y in ((e[1], e[2]), (e[2], e[1])):
                f, v = names.field(x), _value(y)
                if f and f[0] == 0 and v is not None:
                    return [{"field": f[1], "op": "==", "vals": [v]}]
        if kind == "in" and (f := names.field(e[1])) and f[0] == 0 and isinstance(e[2], list) and _kind(e[2]) is None:
            values = [_value(x) for x in e[2] if not _is_nil(x)]
            if None not in values:
                return [{"field": f[1], "op": "in", "vals": sorted(set(values))}]
        if kind == "is_nil" and (f := names.field(e[1])) and f[0] == 0:
            return [{"field": f[1], "op": "is_nil", "vals": ["null"]}]
        return []

    return leaf


def _keys(names: _Names) -> Leaf:
    """Root fields that == or in bind to something that is no field."""

    def leaf(e: Any, negated: bool) -> list:
        kind = _kind(e)
        if negated:
            return []
        if kind == "==":
            return [f[1] for x, y in ((e[1], e[2]), (e[2], e[1])) if (f := names.field(x, True)) and f[0] == 0 and not _has_field(y)][:1]
        if kind == "in" and (f := names.field(e[1], True)) and f[0] == 0 and not _has_field(e[2]):
            return [f[1]]
        return []

    return leaf


def _mentions(names: _Names) -> Leaf:
    """Root fields that a predicate is about: compared with a value, in, is_nil, or standing alone; also negated."""

    def leaf(e: Any, negated: bool) -> list:
        kind = _kind(e)
        if kind in COMPARISONS:
            return [f[1] for x, y in ((e[1], e[2]), (e[2], e[1])) if (f := names.field(x, True)) and f[0] == 0 and not _has_field(y)][:1]
        if kind in ("in", "is_nil"):
            f = names.field(e[1], True)
            return [f[1]] if f and f[0] == 0 and (kind == "is_nil" or not _has_field(e[2])) else []
        f = names.field(e, True)
        return [f[1]] if f and f[0] == 0 else []

    return leaf


def _rejects(names: _Names) -> Leaf:
    """Fields that must not be null for the predicate to hold."""

    def fields(e: Any) -> list:
        f = names.field(e, True)
        return [{"binding": f[0], "field": f[1]}] if f else []

    def leaf(e: Any, negated: bool) -> list:
        kind = _kind(e)
        if kind in ("==", "!="):
            for x, y in ((e[1], e[2]), (e[2], e[1])):
                if _kind(x) == "is_nil" and _kind(y) == "lit" and isinstance(y[1], bool):
                    says_nil = (y[1] == (kind == "==")) != negated
                    return [] if says_nil else fields(x[1])
        if kind in COMPARISONS:
            return fields(e[1]) + fields(e[2])
        if kind == "in":
            return fields(e[1])
        if kind == "is_nil":
            return fields(e[1]) if negated else []
        return fields(e)

    return leaf


def _correlated(e: Any) -> bool:
    """Whether rows of a lateral query depend on the query around."""
    kind = _kind(e)
    if kind == "and":
        return any(map(_correlated, e[1:]))
    if kind == "or":
        return all(map(_correlated, e[1:]))
    if kind == "not":
        return _correlated(e[1])
    if kind in (*COMPARISONS, "in", "fragment"):
        seen = {x[0] for x in _walk(e)}
        return "parent" in seen and "field" in seen
    return False


def _canonical(e: Any, names: _Names, own: int) -> Any:
    """The expression without names of bindings; operands of and, or, == in order; ``own`` as a placeholder."""
    kind = _kind(e)
    if kind == "field":
        f = names.field(e)
        return ["field", "own" if f and f[0] == own else f[0] if f else e[1], e[2]]
    if kind is None:
        return [_canonical(x, names, own) for x in e] if isinstance(e, list) else e
    if kind in ("lit", "param", "subquery"):
        return e
    parts = [_canonical(x, names, own) for x in e[1:]]
    return [kind, *(sorted(parts, key=lambda x: json.dumps(x, sort_keys=True)) if kind in ("and", "or", "==") else parts)]


def _terms(e: Any) -> list:
    return [t for x in e[1:] for t in _terms(x)] if _kind(e) == "and" else [e]


def _signature(q: dict, names: _Names, k: int) -> str:
    j = q["joins"][k]
    about = [_canonical(t, names, k + 1) for c in ("wheres", "havings") for w in q.get(c) or () for t in _terms(w["expr"]) if any(names.field(x) and names.field(x)[0] == k + 1 for x in _walk(t))]
    parts = {x: j.get(x) for x in ("qual", "schema", "table", "assoc", "prefix", "hints", "subquery")}
    return json.dumps([parts, _canonical(j.get("on"), names, k + 1), sorted(about, key=lambda x: json.dumps(x, sort_keys=True))], sort_keys=True)


def _side(e: Any, names: _Names) -> dict:
    cast = e[2] if _kind(e) == "type" else None
    f = names.field(e, True)
    x = e[1] if _kind(e) == "type" else e
    if isinstance(e, list) and _kind(e) is None:
        kinds = {y[2] if len(y) > 2 else None for y in e if _kind(y) in ("lit", "param")}
        literal = kinds.pop() if len(kinds) == 1 else None
    else:
        literal = x[2] if _kind(x) in ("lit", "param") and len(x) > 2 else None
    return {"binding": f[0] if f else None, "field": f[1] if f else None, "schema": names.schema(f[0]) if f else None, "cast": cast, "literal": literal}


def _comparisons(q: dict, path: str) -> Iterator[dict]:
    names = _Names(q)

    def of(e: Any, clause: str, under_not: bool) -> Iterator[dict]:
        kind = _kind(e)
        if kind in ("and", "or", "not"):
            for x in e[1:]:
                yield from of(x, clause, under_not or kind == "not")
        elif kind in COMPARISONS or kind == "in":
            yield {"path": path, "clause": clause, "op": kind, "under_not": under_not, "a": _side(e[1], names), "b": _side(e[2], names)}

    for clause, e in _clauses(q):
        if clause in ("where", "having", "on"):
            yield from of(e, clause, False)


def _unnamed(q: dict) -> Iterator[dict]:
    """Bindings without a name, and positional references to them."""
    if q.get("lookup"):
        return
    names = _Names(q)
    if not q["from"].get("as"):
        yield {"kind": "root", "detail": q["from"].get("table") or q["from"].get("schema") or "subquery"}
    for k, j in enumerate(q.get("joins") or ()):
        if not j.get("as"):
            yield {"kind": "join", "detail": str(k)}
    for clause, e in _clauses(q):
        if clause in ("limit", "offset"):
            continue
        for x in _walk(e):
            if x[0] == "field" and isinstance(x[1], int) and 0 <= x[1] < len(names.sources) and not names.sources[x[1]].get("as"):
                yield {"kind": "reference", "detail": f"{clause}:{x[1]}.{x[2]}"}
    for via, inner in _nested(q):
        if via in ("from", "join", "expression"):
            yield from _unnamed(inner)


def _unit(q: dict, operation: str) -> dict:
    limit, offset = q.get("limit"), q.get("offset")
    select = q.get("select")
    probe = limit is not None and _kind(limit) == "lit" and limit[1] == 1 and _kind(select) == "lit" and select[1] == 1
    there = lambda e: e is not None and not _is_nil(e)
    return {"operation": operation, "limit_node": limit is not None, "limit_value": there(limit), "offset_node": offset is not None, "offset_value": there(offset), "ordered": bool(q.get("order_by")), "probe": probe}


def _join_facts(q: dict) -> Iterator[dict]:
    names = _Names(q)
    for k, j in enumerate(q.get("joins") or ()):
        on = j.get("on")
        lateral = "lateral" in j.get("qual", "")
        inner = j.get("subquery")
        keys = []
        for t in _terms(on) if on is not None else ():
            if _kind(t) == "==" and (a := names.field(t[1])) and (b := names.field(t[2])) and a[1] == b[1] and max(a[0], b[0]) == k + 1 > min(a[0], b[0]):
                keys.append(a[1])
        yield {
            "join_index": k, "qual": j.get("qual", "inner"), "schema": j.get("schema"), "assoc": j.get("assoc"), "alias": j.get("as"),
            "on_true": _kind(on) == "lit" and on[1] is True, "correlated": bool(lateral and inner and any(_correlated(w["expr"]) for w in inner.get("wheres") or ())),
            "key_fields": keys, "signature": _signature(q, names, k),
        }


def _where_facts(b: dict, lefts: list[dict], out: dict) -> dict:
    names, wheres = _Names(b), b.get("wheres")
    try:
        return {k: where_branches(wheres, leaf(names)) for k, leaf in (("predicates", _predicate), ("mentions", _mentions), ("rejects", _rejects))}
    except _Over:
        out["over_limit"] = True
    predicate, rejects = _predicate(names), _rejects(names)
    empty = lambda e, negated: [p["field"] for p in predicate(e, negated) if p["op"] == "in" and not p["vals"]]
    rejected = lambda e, negated: [(r["binding"], r["field"]) for r in rejects(e, negated)]
    named = lambda leaf: _fold([wheres], lambda e, negated: frozenset(leaf(e, negated)), frozenset.union, frozenset.union)
    every_empty = _in_all([wheres], lambda e, negated: [True] * bool(empty(e, negated)))
    every_rejects = _in_all([wheres], lambda e, negated: [r[0] for r in rejected(e, negated)])
    return {
        "predicates": [[{"field": f, "op": "in", "vals": []} for f in sorted(named(empty))] if every_empty else []],
        "mentions": [sorted(_in_all([wheres], _mentions(names)))],
        "rejects": [[{"binding": k, "field": f} for k, f in sorted(named(rejected)) if k in every_rejects]],
    }


def _key_facts(layers: list[dict], out: dict) -> list[list]:
    try:
        keys = [[]]
        for layer in layers:
            keys = _product(keys, where_branches(layer.get("wheres"), _keys(_Names(layer))))
        return keys
    except _Over:
        pass
    # every layer's fields are read by its own names
    wheres = [[{"op": w.get("op"), "expr": _leaves(w["expr"], _keys(_Names(layer)))} for w in layer.get("wheres") or ()] for layer in layers]
    known = lambda e, negated: e[2] if negated else e[1]
    try:
        return _smallest_sets(wheres, known)
    except _Over:
        out["keys_over"] = True
        return [sorted(_in_all(wheres, known))]


def _leaves(e: Any, leaf: Leaf) -> list:
    """The expression with what ``leaf`` gives for its leaves, plain and negated."""
    return [e[0], *(_leaves(x, leaf) for x in e[1:])] if _kind(e) in ("and", "or", "not") else ["leaf", leaf(e, False), leaf(e, True)]


def compile_query(q: dict) -> dict:
    """The facts of one query."""
    root = _layers(q)[-1]["from"]
    out = {
        "operation": q.get("operation", "all"), "schema": root.get("schema"), "table_name": root.get("table"), "db_schema": root.get("prefix"),
        "bounded": boundedness(q.get("wheres")), "ordered": bool(q.get("order_by")), "over_limit": False, "keys_over": False,
        "order_fields": [f[1] for e in q.get("order_by") or () if (f := _Names(q).field(e)) and f[0] == 0],
        "units": [_unit(x, q.get("operation", "all") if x is q else "all") for x in _all_queries(q)],
        "joins": list(_join_facts(q)), "comparisons": [c for path, b in _set_branches(q) for c in _comparisons(b, path)],
        "unnamed": list(_unnamed(q)), "branches": [],
    }
    for path, b in _set_branches(q):
        layers, own = _layers(b), _layers(b)[-1]["from"]
        lefts = [{"binding": k + 1, "alias": j.get("as")} for k, j in enumerate(b.get("joins") or ()) if j.get("qual") in ("left", "left_lateral")]
        out["branches"].append({"path": path, "schema": own.get("schema"), "table_name": own.get("table"), "left_joins": lefts} | _where_facts(b, lefts, out) | {"keys": _key_facts(layers, out)})
    return out


def compile_queries(queries: DataFrame, id_column: str = "query_id", tree_column: str = "tree") -> DataFrame:
    """A row of FACTS for each query; null or malformed trees are errors."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(FACTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, len(batch), 1000):
                part = batch.slice(s, 1000)
                rows = [{"query_id": i} | compile_query(json.loads(t)) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return queries.select(F.col(id_column).cast("long"), F.col(tree_column)).mapInArrow(run, FACTS)
