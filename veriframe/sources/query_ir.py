"""Query trees as a flat row of facts for each query, worked out by column expressions.

A query is a JSON object: ``operation``; ``from`` {schema, table, prefix, as, subquery}; ``joins`` [{qual, schema, table,
assoc, prefix, hints, on, as, subquery}]; ``wheres`` and ``havings`` [{op: and|or, expr}]; ``order_by`` [expr]; ``limit``
and ``offset`` (expr; a parameter without value is ["param", null]); ``select``, ``distinct``, ``group_by``, ``windows``,
``update`` (expr); ``ctes`` [{name, query}]; ``combinations`` [{op, query}].  An expression is a list: ["and"|"or"|"not",
...], ["=="|"!="|"<"|"<="|">"|">=", a, b], ["in", a, list or expr], ["is_nil", a], ["field", binding, name] with binding
a position or an alias, ["parent", name] for a field of the query around, ["lit"|"param", value, type], ["type", expr,
type], ["fragment", expr...], ["subquery", query].

Nothing here runs in Python.  A tree is all that its facts need, and programs ask the same queries again and again: each
distinct tree is worked out once for each share of its queries (SHARES) and joined back to the queries that have it.  ``from_json`` reads a query
whose inner queries and expressions stay text; inner queries are reached by a worklist in ``aggregate``, in preorder, at
any depth.  An expression's closing brackets come in postorder, so ``aggregate`` over its tokens is a stack machine: atoms
are pushed, a closing bracket replaces a node's parts by what is known of the node.  What is known is a small algebra for
each fact (values of leaves, of conjunctions and of disjunctions, plain and negated).  A column that a check doesn't read
isn't worked out.

Branches of a disjunction are kept as lists of facts.  A branch without facts stays, as an empty list: an expression
that isn't understood proves nothing, but it doesn't vanish.  Beyond BRANCH_LIMIT branches a query is marked
``over_limit`` and has one branch with what all of them share, which is all that most checks ask for: of keys the smallest
sets, of which there are mostly few (else ``keys_over``), of mentions the fields in every branch, of rejects the left
joins that every branch rejects, of predicates the empty lists, if every branch has one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BRANCH_LIMIT = 4096
#: How many tasks the queries of one tree are dealt to; a tree is worked out at most that many times.
SHARES = 16
COMPARISONS = ("==", "!=", "<", "<=", ">", ">=")

_SIDE = "struct<binding:int,field:string,schema:string,cast:string,literal:string>"
_KINDS = {
    "units": "array<struct<operation:string,limit_node:boolean,limit_value:boolean,offset_node:boolean,offset_value:boolean,ordered:boolean,probe:boolean>>",
    "branches": "array<struct<path:string,schema:string,table_name:string,predicates:array<array<struct<field:string,op:string,vals:array<string>>>>,keys:array<array<string>>,mentions:array<array<string>>,rejects:array<array<struct<binding:int,field:string>>>,left_joins:array<struct<binding:int,alias:string>>>>",
    "joins": "array<struct<join_index:int,qual:string,schema:string,assoc:string,alias:string,on_true:boolean,correlated:boolean,key_fields:array<string>,signature:string>>",
    "comparisons": f"array<struct<path:string,clause:string,op:string,under_not:boolean,a:{_SIDE},b:{_SIDE}>>",
    "unnamed": "array<struct<kind:string,detail:string>>",
}
FACTS = "query_id bigint, operation string, schema string, table_name string, db_schema string, bounded string, ordered boolean, order_fields array<string>, " + ", ".join(f"{k} {v}" for k, v in _KINDS.items()) + ", over_limit boolean, keys_over boolean"

_EXPRESSIONS = ("select", "distinct", "group_by", "windows", "update")
#: A query whose inner queries and expressions are JSON text.
QUERY = (
    "struct<operation:string,`from`:struct<schema:string,table:string,prefix:string,as:string,subquery:string>,"
    "joins:array<struct<qual:string,schema:string,table:string,assoc:string,prefix:string,hints:string,on:string,as:string,subquery:string>>,"
    "wheres:array<struct<op:string,expr:string>>,havings:array<struct<op:string,expr:string>>,order_by:array<string>,limit:string,offset:string,"
    + "".join(f"{k}:string," for k in _EXPRESSIONS)
    + "lookup:string,ctes:array<struct<name:string,query:string>>,combinations:array<struct<op:string,query:string>>>"
)

_S, _T = r"\s*", r'"(?:[^"\\]|\\.)*"'
_FIELD = rf'\[{_S}"field"{_S},{_S}({_T}|-?\d+){_S},{_S}({_T}){_S}\]'
_VALUE = rf'\[{_S}"(lit|param)"{_S},{_S}({_T}|[^\[\]{{}},\s"]+)(?:{_S},{_S}({_T}|null))?{_S}\]'
_PARENT = rf'\[{_S}"parent"{_S},{_S}{_T}{_S}\]'
_TOKEN = "|".join([_FIELD, _VALUE, _PARENT, rf"\[{_S}{_T}", r"\[", r"\]", r"\{\d+\}", _T, r'[^\[\]{},:\s"]+'])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _list(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _some(xs: Column, kind: str) -> Column:
    """The array, empty if it's null."""
    return F.coalesce(xs, _list(kind))


def _rest(xs: Column) -> Column:
    return F.slice(xs, F.lit(2), F.greatest(F.size(xs), F.lit(1)))


def _text(token: Column) -> Column:
    """What a JSON string stands for."""
    plain = F.substring(token, F.lit(2), F.length(token) - 2)
    return F.when(F.instr(token, "\\") == 0, plain).otherwise(F.get_json_object(F.concat(F.lit('{"a":'), token, F.lit("}")), "$.a"))


def _read(text: Column) -> Column:
    return F.from_json(text, QUERY, {"mode": "FAILFAST"})


# Texts of expressions.

_OBJECT = "struct<sub:boolean,text:string>"
_SPLIT = f"struct<text:string,objects:array<{_OBJECT}>>"


def _split(e: Column) -> Column:
    """The expression with {0}, {1}, ... in place of its objects, and these; ``sub``: a subquery's."""
    pieces = F.regexp_extract_all(e, F.lit(rf'{_T}|[{{}}]|[^"{{}}]+'), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("own"), F.lit("").alias("text"), _list(_OBJECT).alias("objects"))

    def step(s: Column, p: Column) -> Column:
        opens, closes, inside = p == "{", p == "}", s["depth"] > 0
        begins, ends = opens & ~inside, closes & (s["depth"] == 1)
        done = F.struct(F.regexp_like(s["text"], F.lit(rf'"subquery"{_S},{_S}\{{\d+\}}$')).alias("sub"), F.concat(s["own"], p).alias("text"))
        return F.struct(
            (s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)).alias("depth"),
            F.when(begins, p).when(inside & ~ends, F.concat(s["own"], p)).otherwise(F.lit("")).alias("own"),
            F.when(begins, F.concat(s["text"], F.lit("{"), F.size(s["objects"]).cast("string"), F.lit("}"))).when(inside, s["text"]).otherwise(F.concat(s["text"], p)).alias("text"),
            F.when(ends, F.concat(s["objects"], F.array(done))).otherwise(s["objects"]).alias("objects"),
        )

    found = F.aggregate(pieces, start, step, lambda s: F.struct(s["text"].alias("text"), s["objects"].alias("objects")))
    return F.when(F.instr(e, "{") == 0, F.struct(e.alias("text"), _list(_OBJECT).alias("objects"))).otherwise(found)


def _clauses(q: Column, all_of_them: bool = True) -> Column:
    """(clause, text) of a query's expressions; else only of conditions."""
    one = lambda name, e: F.struct(F.lit(name).alias("clause"), e.alias("text"))
    where = lambda name, ws: F.transform(_some(ws, "struct<op:string,expr:string>"), lambda w: one(name, w["expr"]))
    parts = [where("where", q["wheres"]), where("having", q["havings"])]
    parts.append(F.transform(_joins(q), lambda j: one("on", j["on"])))
    if all_of_them:
        parts.append(F.array(one("order_by", F.concat(F.lit("["), F.array_join(q["order_by"], ","), F.lit("]"))), *[one(k, q[k]) for k in (*_EXPRESSIONS, "limit", "offset")]))
    return F.filter(F.concat(*parts), lambda c: c["text"].isNotNull())


# Queries within queries.

_JOIN = "struct<qual:string,schema:string,table:string,assoc:string,prefix:string,hints:string,on:string,as:string,subquery:string>"
_ITEM = "struct<at:array<int>,named:boolean,path:string,text:string>"
_PART = f"struct<at:array<int>,named:boolean,path:string,q:{QUERY}>"


def _joins(q: Column) -> Column:
    return _some(q["joins"], _JOIN)


def _truthy(text: Column) -> Column:
    return F.coalesce(~text.isin("", "false", "0", "[]", "{}"), F.lit(False))


def _inner(part: Column) -> Column:
    """The queries right inside one: its source's, joins', named queries, set operations, those in expressions."""
    q, at, path = part["q"], part["at"], part["path"]
    named = part["named"] & ~_truthy(q["lookup"])
    one = lambda text, bindings=True, path=None: F.struct((named if bindings else F.lit(False)).alias("named"), (_none("string") if path is None else path).alias("path"), text.alias("text"))
    sub = F.flatten(F.transform(_clauses(q), lambda c: F.transform(F.filter(_split(c["text"])["objects"], lambda o: o["sub"]), lambda o: o["text"])))
    below = lambda c, k: F.concat(path, F.when(path == "", "").otherwise("/"), c["op"], F.lit(":"), k.cast("string"))
    found = F.concat(
        F.array(one(q["from"]["subquery"])),
        F.transform(_joins(q), lambda j: one(j["subquery"])),
        F.transform(_some(q["ctes"], "struct<name:string,query:string>"), lambda c: one(c["query"], False)),
        F.transform(_some(q["combinations"], "struct<op:string,query:string>"), lambda c, k: one(c["query"], False, below(c, k))),
        F.transform(sub, lambda t: one(t)),
    )
    found = F.filter(found, lambda x: x["text"].isNotNull())
    return F.transform(found, lambda x, k: F.struct(F.concat(at, F.array(k)).alias("at"), x["named"].alias("named"), x["path"].alias("path"), x["text"].alias("text")))


def all_queries(tree: Column) -> Column:
    """The query and all within it, at any depth, in preorder: where (a number for each level), whether its bindings count
    as the outer query's do, its path in set operations (null outside of them), and the query."""
    n = F.size(F.regexp_extract_all(tree, F.lit(rf'"from"{_S}:'), F.lit(0)))
    root = F.struct(_list("int").alias("at"), F.lit(True).alias("named"), F.lit("").alias("path"), tree.alias("text"))
    as_part = lambda x: F.struct(x["at"].alias("at"), x["named"].alias("named"), x["path"].alias("path"), _read(x["text"]).alias("q"))
    start = F.struct(F.array(root).cast(f"array<{_ITEM}>").alias("todo"), _list(_PART).alias("done"))

    def step(s: Column, _: Column) -> Column:
        def go(part: Column) -> Column:
            return F.struct(F.concat(_inner(part), _rest(s["todo"])).alias("todo"), F.concat(s["done"], F.array(part)).alias("done"))

        return F.when(F.size(s["todo"]) == 0, s).otherwise(_let(as_part(F.get(s["todo"], F.lit(0))), go))

    walked = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), start, step, lambda s: s["done"])
    return F.when(n <= 1, F.array(as_part(root))).otherwise(walked)


def _layers(q: Column, steps: Column) -> Column:
    """The query, its source's query, and so on; at most ``steps`` + 1."""
    start = F.array(q).cast(f"array<{QUERY}>")
    deeper = lambda ls: _let(F.element_at(ls, -1)["from"]["subquery"], lambda t: F.when(t.isNull(), ls).otherwise(F.concat(ls, F.array(_read(t)))))
    return F.when(q["from"]["subquery"].isNull(), start).otherwise(F.aggregate(F.sequence(F.lit(1), steps), start, lambda ls, _: deeper(ls)))


def _aliases(q: Column) -> Column:
    """Names of bindings: the source is 0, join i is i + 1; null without one."""
    named = lambda a: F.when(a != "", a)
    return F.concat(F.array(named(q["from"]["as"])), F.transform(_joins(q), lambda j: named(j["as"])))


def _binding(token: Column, names: Column) -> Column:
    """The binding of a field token; null if there is none."""

    def of(b: Column) -> Column:
        at = b.cast("int")
        named = _let(_text(b), lambda a: F.size(names) - F.array_position(F.reverse(names), a).cast("int"))
        return F.when(F.startswith(b, F.lit('"')), _let(named, lambda k: F.when(k < F.size(names), k))).when((at >= 0) & (at < F.size(names)), at)

    return _let(F.regexp_extract(token, _FIELD, 1), of)


def _field_name(token: Column) -> Column:
    return _text(F.regexp_extract(token, _FIELD, 2))


# The stack machine.


def _element(kinds: dict[str, str], **known: Column) -> Column:
    return F.struct(*[(known[k].cast(t) if k in known else _none(t)).alias(k) for k, t in kinds.items()])


def _run(text: Column, kinds: dict[str, str], atom: Callable[[Column, Column], Column], node: Callable[[Column, Column], Column]) -> Column:
    """What is known of an expression: ``atom(head, token)`` of fields, values and strings (head: field, lit, param, parent
    or empty), ``node(kind, parts)`` of lists (kind: null for a plain list).  ``kinds`` has what is known, kind included."""
    e = "struct<" + ",".join(f"{k}:{t}" for k, t in kinds.items()) + ">"
    start = F.struct(_list(e).alias("stack"), _list("int").alias("marks"))

    def push(s: Column, x: Column, marks: Column) -> Column:
        return F.struct(F.concat(s["stack"], F.array(x)).alias("stack"), marks.alias("marks"))

    def close(s: Column) -> Column:
        def at(m: Column) -> Column:
            parts = F.slice(s["stack"], m + 2, F.size(s["stack"]))
            kept = F.slice(s["stack"], F.lit(1), m)
            own = _let(parts, lambda xs: node(F.get(s["stack"], m)["kind"], xs))
            return F.struct(F.concat(kept, F.array(own)).alias("stack"), F.slice(s["marks"], F.lit(1), F.size(s["marks"]) - 1).alias("marks"))

        return _let(F.element_at(s["marks"], -1), at)

    def step(s: Column, t: Column) -> Column:
        opens = F.startswith(t, F.lit("[")) & ~F.endswith(t, F.lit("]"))
        mark = _element(kinds, kind=F.when(t != "[", _text(F.regexp_extract(t, _T, 0))))
        value = _let(F.regexp_extract(t, rf'^\[{_S}"(\w+)"', 1), lambda h: atom(h, t))
        return F.when(opens, push(s, mark, F.concat(s["marks"], F.array(F.size(s["stack"]))))).when(t == "]", close(s)).otherwise(push(s, value, s["marks"]))

    return F.aggregate(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), start, step, lambda s: F.get(s["stack"], F.lit(0)))


def _value_parts(token: Column) -> tuple[Column, Column]:
    """The text of a value, null if it's no string, whole number or truth value; whether it is null."""
    v = F.regexp_extract(token, _VALUE, 2)
    return F.when(F.regexp_like(v, F.lit(r'^(".*|-?\d+|true|false)$')), v), v == "null"


def bounded(wheres: Column) -> Column:
    """``empty``, ``restricting`` or ``unrestricting``; anything but true, false and their combinations restricts."""
    kinds = {"kind": "string", "is": "string"}

    def atom(head: Column, t: Column) -> Column:
        v = F.when(head == "lit", F.regexp_extract(t, _VALUE, 2))
        return _element(kinds, kind=head, **{"is": F.when(v == "true", "unrestricting").when(v == "false", "empty").otherwise("restricting")})

    def fold(xs: Column, kind: Column) -> Column:
        is_ = lambda what: lambda x: x["is"] == what
        both = F.when(F.exists(xs, is_("empty")), "empty").when(F.forall(xs, is_("unrestricting")), "unrestricting").otherwise("restricting")
        either = F.when(F.exists(xs, is_("unrestricting")), "unrestricting").when(F.forall(xs, is_("empty")), "empty").otherwise("restricting")
        return F.when(kind == "and", both).otherwise(either)

    def node(kind: Column, xs: Column) -> Column:
        first = F.get(xs, F.lit(0))["is"]
        swapped = F.when(first == "empty", "unrestricting").when(first == "unrestricting", "empty").otherwise(first)
        return _element(kinds, kind=kind, **{"is": F.when(kind == "not", swapped).when(kind.isin("and", "or"), fold(xs, kind)).otherwise("restricting")})

    own = F.transform(wheres, lambda w: F.struct(F.coalesce(w["op"], F.lit("and")).alias("op"), _run(_split(w["expr"])["text"], kinds, atom, node)["is"].alias("is")))
    merged = F.aggregate(_rest(own), F.get(own, F.lit(0))["is"], lambda acc, w: fold(F.array(F.struct(acc.alias("is")), F.struct(w["is"].alias("is"))), F.when(w["op"] == "or", "or").otherwise("and")))
    return F.when(F.size(wheres) == 0, "unrestricting").otherwise(merged)


# Facts of conditions, plain and negated.

_FACT = "struct<tag:string,binding:int,field:string,op:string,vals:array<string>>"


def _fact(tag: str, field: Column, binding: Column | None = None, op: str | Column | None = None, vals: Column | None = None) -> Column:
    return F.struct(
        F.lit(tag).alias("tag"), (F.lit(0) if binding is None else binding).cast("int").alias("binding"), field.alias("field"), (_none("string") if op is None else F.lit(op)).alias("op"),
        (_none("array<string>") if vals is None else vals).alias("vals"),
    )


def _facts(kind: Column, a: Column, b: Column, ub: Column, un: Column, negated: bool) -> Column:
    """Of a condition with operands ``a`` and ``b`` that itself is the field ``ub``, ``un``, if any.  Tags: p for root
    comparisons with known values; k for root fields that == or in bind to something that is no field; m for root fields
    that it is about, also negated; r for fields that must not be null for it to hold."""
    pair = kind.isin(*COMPARISONS)
    out = []
    if not negated:
        equal = lambda x, y: F.when((x["fb"] == 0) & y["val"].isNotNull(), _fact("p", x["fn"], op="==", vals=F.array(y["val"])))
        known = b["plain"] & b["vals_known"]
        out.append(
            F.when(kind == "==", F.coalesce(equal(a, b), equal(b, a)))
            .when((kind == "in") & (a["fb"] == 0) & known, _fact("p", a["fn"], op="in", vals=F.array_sort(F.array_distinct(b["vals"]))))
            .when((kind == "is_nil") & (a["fb"] == 0), _fact("p", a["fn"], op="is_nil", vals=F.array(F.lit("null"))))
        )
    about = lambda x, y: F.when((x["ub"] == 0) & ~y["deep"], x["un"])
    either = F.coalesce(about(a, b), about(b, a))
    if not negated:
        key = F.when(kind == "==", either).when(kind == "in", about(a, b))
        out.append(F.when(key.isNotNull(), _fact("k", key)))
    own = F.when(pair, either).when(kind == "in", about(a, b)).when(kind == "is_nil", F.when(a["ub"] == 0, a["un"])).otherwise(F.when(ub == 0, un))
    out.append(F.when(own.isNotNull(), _fact("m", own)))
    field = lambda binding, name: F.when(binding.isNotNull(), _fact("r", name, binding))
    says = lambda x, y: F.when((x["kind"] == "is_nil") & y["truth"].isNotNull() & kind.isin("==", "!="), F.struct((y["truth"] == (kind == "==")).alias("nil"), x["nb"].alias("nb"), x["nn"].alias("nn")))
    told = F.coalesce(says(a, b), says(b, a))
    nil = told["nil"] != F.lit(negated)
    out.append(
        F.when(told.isNotNull(), F.when(~nil, field(told["nb"], told["nn"])))
        .when(pair | (kind == "in"), field(a["ub"], a["un"]))
        .when(kind == "is_nil", field(a["ub"], a["un"]) if negated else _none(_FACT))
        .otherwise(field(ub, un))
    )
    out.append(F.when(pair & told.isNull(), field(b["ub"], b["un"])))
    return F.array_compact(F.array(*[x.cast(_FACT) for x in out]))


#: A condition in postorder: leaves with their facts, operators with the number of their parts.
_STEP = f"struct<op:string,parts:int,pos:array<{_FACT}>,neg:array<{_FACT}>>"
_CLAUSE = f"struct<or:boolean,steps:array<{_STEP}>>"


def _steps(text: Column, names: Column) -> Column:
    """The condition as steps."""
    kinds = {
        "kind": "string", "plain": "boolean", "fb": "int", "fn": "string", "ub": "int", "un": "string", "deep": "boolean", "val": "string", "nil": "boolean", "truth": "boolean",
        "vals": "array<string>", "vals_known": "boolean", "nb": "int", "nn": "string", "steps": f"array<{_STEP}>",
    }
    no_fact = _list(_FACT)
    leaf = lambda pos, neg: F.array(F.struct(_none("string").alias("op"), F.lit(0).alias("parts"), pos.alias("pos"), neg.alias("neg")).cast(_STEP))

    def atom(head: Column, t: Column) -> Column:
        is_field, is_value = head == "field", head.isin("lit", "param")
        val, nil = _value_parts(t)

        def with_field(f: Column) -> Column:
            facts = F.when(f["b"].isNotNull(), F.concat(F.when(f["b"] == 0, F.array(_fact("m", f["n"]).cast(_FACT))).otherwise(no_fact), F.array(_fact("r", f["n"], f["b"]).cast(_FACT)))).otherwise(no_fact)
            return _element(
                kinds, kind=head, plain=F.lit(False), fb=f["b"], fn=f["n"], ub=f["b"], un=f["n"], deep=is_field, val=F.when(is_value, val), nil=F.coalesce(is_value & nil, F.lit(False)),
                truth=F.when((head == "lit") & val.isin("true", "false"), val == "true"), vals_known=F.lit(False), steps=_let(facts, lambda x: leaf(x, x)),
            )

        resolved = F.when(is_field, _binding(t, names))
        return _let(_let(resolved, lambda b: F.struct(b.alias("b"), F.when(b.isNotNull(), _field_name(t)).alias("n"))), with_field)

    def node(kind: Column, xs: Column) -> Column:
        a, b = F.get(xs, F.lit(0)), F.get(xs, F.lit(1))
        is_type = kind == "type"
        ub, un = F.when(is_type, a["fb"]), F.when(is_type, a["fn"])
        deep = F.coalesce(~kind.isin("lit", "param", "subquery"), F.lit(True)) & F.exists(xs, lambda x: x["deep"])
        given = F.filter(xs, lambda x: ~x["nil"])
        own = F.struct(kind.alias("op"), F.size(xs).alias("parts"), no_fact.alias("pos"), no_fact.alias("neg")).cast(_STEP)
        facts = lambda negated: F.when(kind.isNull(), no_fact).otherwise(_facts(kind, a, b, ub, un, negated))
        return _element(
            kinds, kind=kind, plain=kind.isNull(), ub=ub, un=un, deep=deep, nil=F.lit(False), vals=F.when(kind.isNull(), F.transform(given, lambda x: x["val"])),
            vals_known=kind.isNull() & F.forall(given, lambda x: x["val"].isNotNull()), nb=F.when(kind == "is_nil", a["ub"]), nn=F.when(kind == "is_nil", a["un"]),
            steps=F.when(kind.isin("and", "or", "not"), F.concat(F.flatten(F.transform(xs, lambda x: x["steps"])), F.array(own))).otherwise(leaf(facts(False), facts(True))),
        )

    return _run(_split(text)["text"], kinds, atom, node)["steps"]


def _where_steps(q: Column) -> Column:
    clause = lambda w, names: F.struct((F.coalesce(w["op"], F.lit("and")) == "or").alias("or"), _steps(w["expr"], names).alias("steps"))
    return _let(_aliases(q), lambda names: F.transform(_wheres(q), lambda w: clause(w, names)))


class _Algebra:
    """Values of conditions: of a leaf by its facts, of conjunctions and disjunctions of several."""

    def __init__(self, kind: str, leaf: Callable[[Column], Column], both: Callable[[Column], Column], either: Callable[[Column], Column]):
        self.kind, self.leaf, self.both, self.either = kind, leaf, both, either

    def of(self, steps: Column) -> Column:
        pair = lambda pos, neg: F.struct(pos.cast(self.kind).alias("pos"), neg.cast(self.kind).alias("neg"))

        def combined(op: Column, xs: Column) -> Column:
            pos, neg = F.transform(xs, lambda x: x["pos"]), F.transform(xs, lambda x: x["neg"])
            last = F.get(xs, F.lit(0))
            return F.when(op == "not", pair(last["neg"], last["pos"])).when(op == "and", pair(self.both(pos), self.either(neg))).otherwise(pair(self.either(pos), self.both(neg)))

        def step(stack: Column, s: Column) -> Column:
            kept = F.size(stack) - s["parts"]
            own = F.when(s["op"].isNull(), pair(self.leaf(s["pos"]), self.leaf(s["neg"]))).otherwise(_let(F.slice(stack, kept + 1, s["parts"]), lambda xs: combined(s["op"], xs)))
            return F.concat(F.slice(stack, F.lit(1), kept), F.array(own))

        return F.aggregate(steps, _list(f"struct<pos:{self.kind},neg:{self.kind}>"), step, lambda st: F.get(st, F.lit(0))["pos"])

    def where(self, clauses: Column, without: Column, either: Callable[[Column], Column] | None = None) -> Column:
        """Of all where clauses, ``without`` any as given; the first one's operation doesn't matter."""
        own = F.transform(clauses, lambda c: F.struct(c["or"].alias("or"), self.of(c["steps"]).alias("v")))
        merge = lambda acc, w: F.when(w["or"], (either or self.either)(F.array(acc, w["v"]))).otherwise(self.both(F.array(acc, w["v"])))
        merged = _let(own, lambda ws: F.aggregate(_rest(ws), F.get(ws, F.lit(0))["v"], merge))
        return F.when(F.size(clauses) == 0, without.cast(self.kind)).otherwise(merged)


_DNF = f"array<array<{_FACT}>>"


def _product(kind: str, limit: int) -> Callable[[Column], Column]:
    """All combinations of several lists of lists; null for more than ``limit`` at any point."""
    one = lambda: F.array(_list(kind)).cast(f"array<array<{kind}>>")
    pairs = lambda a, b: F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat(x, y))))
    step = lambda acc, xs: F.when(F.size(acc).cast("long") * F.size(xs) <= limit, pairs(acc, xs))
    return lambda lists: F.aggregate(lists, one(), lambda acc, xs: F.when(acc.isNotNull() & xs.isNotNull(), step(acc, xs)))


def _alternatives(lists: Column) -> Column:
    return _let(F.flatten(lists), lambda xs: F.when(F.size(xs) <= BRANCH_LIMIT, xs))


#: Branches; null beyond the limit.
BRANCHES = _Algebra(_DNF, F.array, _product(_FACT, BRANCH_LIMIT), _alternatives)

_SHARED = f"struct<every:array<{_FACT}>,some:array<{_FACT}>>"


def _shared() -> _Algebra:
    """What every branch has, and what some branch has, without expanding them."""
    united = lambda lists: F.array_distinct(F.flatten(lists))
    every, some = lambda xs: F.transform(xs, lambda x: x["every"]), lambda xs: F.transform(xs, lambda x: x["some"])

    def marked(fs: Column) -> Column:
        empty = F.filter(fs, lambda f: (f["tag"] == "p") & (f["op"] == "in") & (F.size(f["vals"]) == 0))
        # markers that don't depend on the field: an empty list, a binding that is rejected
        extra = F.concat(F.transform(F.slice(empty, 1, 1), lambda f: _fact("e", F.lit("")).cast(_FACT)), F.transform(F.filter(fs, lambda f: f["tag"] == "r"), lambda f: _fact("b", F.lit(""), f["binding"]).cast(_FACT)))
        return _let(F.concat(fs, extra), lambda xs: F.struct(xs.alias("every"), xs.alias("some")))

    def fold(xs: Column, both: bool) -> Column:
        common = lambda e: F.aggregate(_rest(e), F.get(e, F.lit(0)), lambda acc, x: F.array_intersect(acc, x))
        return F.struct((united(every(xs)) if both else _let(every(xs), common)).alias("every"), united(some(xs)).alias("some"))

    return _Algebra(_SHARED, marked, lambda xs: fold(xs, True), lambda xs: fold(xs, False))


SHARED = _shared()


def _smallest(sets: Column) -> Column:
    """Without those that contain another one; null beyond the limit."""
    one = F.array_distinct(F.transform(sets, lambda s: F.array_sort(F.array_distinct(s))))
    within = lambda y, x: (F.size(y) < F.size(x)) & (F.size(F.array_except(y, x)) == 0)
    return _let(one, lambda xs: F.when(F.size(xs) <= BRANCH_LIMIT, F.filter(xs, lambda x: ~F.exists(xs, lambda y: within(y, x)))))


def _key_sets() -> _Algebra:
    """The branches' sets of keys that contain no other one's."""
    product = _product("string", 16 * BRANCH_LIMIT)

    def both(lists: Column) -> Column:
        one = F.array(_list("string")).cast("array<array<string>>")
        return F.aggregate(lists, one, lambda acc, xs: _smallest(product(F.array(acc, xs))))

    keys = lambda fs: F.array(F.array_sort(F.array_distinct(F.transform(F.filter(fs, lambda f: f["tag"] == "k"), lambda f: f["field"]))))
    return _Algebra("array<array<string>>", keys, both, lambda lists: _smallest(F.flatten(lists)))


KEY_SETS = _key_sets()


def _wheres(q: Column) -> Column:
    return _some(q["wheres"], "struct<op:string,expr:string>")


def _with(tag: str, d: Column, of: Callable[[Column], Column]) -> Column:
    return F.transform(F.filter(d, lambda f: f["tag"] == tag), of)


def _branches(rows: DataFrame, sets: Column) -> DataFrame:
    """``rows`` with branches, over_limit and keys_over, worked out step by step: what is beyond the limit only where it is."""
    unit = F.array(_list(_FACT)).cast(_DNF)
    bare = F.array(_list("string")).cast("array<array<string>>")
    nothing = F.struct(_list(_FACT).alias("every"), _list(_FACT).alias("some"))
    field, nth = lambda f: f["field"], lambda xs, k: F.get(F.col(xs), k)
    predicate, rejected = lambda f: F.struct(f["field"].alias("field"), f["op"].alias("op"), f["vals"].alias("vals")), lambda f: F.struct(f["binding"].alias("binding"), f["field"].alias("field"))

    def conditions(p: Column) -> Column:
        left = F.filter(F.transform(_joins(p["q"]), lambda j, k: F.struct((k + 1).alias("binding"), j["as"].alias("alias"), j["qual"].alias("qual"))), lambda j: j["qual"].isin("left", "left_lateral"))
        left = F.transform(left, lambda j: F.struct(j["binding"].alias("binding"), j["alias"].alias("alias")))
        of = lambda ls: F.struct(p["path"].alias("path"), F.element_at(ls, -1)["from"].alias("root"), left.alias("left_joins"), F.transform(ls, _where_steps).alias("layers"))
        return _let(_layers(p["q"], F.col("n")), of)

    def told(d: Column) -> Column:
        return F.struct(F.transform(d, lambda x: _with("p", x, predicate)).alias("predicates"), F.transform(d, lambda x: _with("m", x, field)).alias("mentions"), F.transform(d, lambda x: _with("r", x, rejected)).alias("rejects"))

    def in_common(s: Column) -> Column:
        """One branch with what all share."""
        empty = F.filter(s["some"], lambda f: (f["tag"] == "p") & (f["op"] == "in") & (F.size(f["vals"]) == 0))
        has_empty = F.exists(s["every"], lambda f: f["tag"] == "e")
        bindings = F.transform(F.filter(s["every"], lambda f: f["tag"] == "b"), lambda f: f["binding"])
        rejects = F.array_sort(F.transform(F.filter(s["some"], lambda f: (f["tag"] == "r") & F.array_contains(bindings, f["binding"])), rejected))
        return F.struct(
            F.array(F.when(has_empty, F.array_sort(F.transform(empty, predicate))).otherwise(_list("struct<field:string,op:string,vals:array<string>>"))).alias("predicates"),
            F.array(F.array_sort(_with("m", s["every"], field))).alias("mentions"), F.array(rejects).alias("rejects"),
        )

    # or-ed clauses are alternatives without a limit of their own
    rows = rows.withColumn("conds", F.transform(sets, conditions))
    rows = rows.withColumn("dnfs", F.transform("conds", lambda c: F.transform(c["layers"], lambda ws: BRANCHES.where(ws, unit, F.flatten))))
    names = lambda d: F.transform(d, lambda x: _with("k", x, field))
    rows = rows.withColumn("all_keys", F.transform("dnfs", lambda ds: _product("string", BRANCH_LIMIT)(F.transform(ds, names))))
    rows = rows.withColumn("shared", F.transform("conds", lambda c, k: F.when(F.get(nth("dnfs", k), F.lit(0)).isNull() | nth("all_keys", k).isNull(), F.transform(c["layers"], lambda ws: SHARED.where(ws, nothing)))))
    rows = rows.withColumn("key_sets", F.transform("conds", lambda c, k: F.when(nth("all_keys", k).isNull(), F.transform(c["layers"], lambda ws: KEY_SETS.where(ws, bare)))))
    rows = rows.withColumn("few_keys", F.transform("key_sets", lambda ks: F.array_sort(KEY_SETS.both(ks))))
    every = lambda k: F.array(F.array_sort(F.array_distinct(F.flatten(F.transform(nth("shared", k), lambda s: _with("k", s["every"], field))))))

    def whole(c: Column, k: Column) -> Column:
        dnf = F.get(nth("dnfs", k), F.lit(0))
        where = F.when(dnf.isNotNull(), told(dnf)).otherwise(in_common(F.get(nth("shared", k), F.lit(0))))
        keys = F.coalesce(nth("all_keys", k), nth("few_keys", k), every(k))
        return F.struct(
            c["path"].alias("path"), c["root"]["schema"].alias("schema"), c["root"]["table"].alias("table_name"), where["predicates"].alias("predicates"), keys.alias("keys"),
            where["mentions"].alias("mentions"), where["rejects"].alias("rejects"), c["left_joins"].alias("left_joins"),
        )

    over = F.exists("dnfs", lambda ds: F.get(ds, F.lit(0)).isNull())
    untold = F.exists(F.transform("conds", lambda c, k: nth("all_keys", k).isNull() & nth("few_keys", k).isNull()), lambda x: x)
    rows = rows.withColumns({"branches": F.transform("conds", whole), "over_limit": over, "keys_over": untold})
    return rows.drop("conds", "dnfs", "all_keys", "shared", "key_sets", "few_keys")


# Comparisons, joins, units and names.

_PAIR = f"struct<op:string,under_not:boolean,a:{_SIDE},b:{_SIDE}>"


def _schemas(q: Column, n: Column) -> Column:
    """The schema of each binding; of a subquery the one at its root."""
    of = lambda s: F.when(s["subquery"].isNull(), s["schema"]).otherwise(_let(_layers(_read(s["subquery"]), n), lambda ls: F.element_at(ls, -1)["from"]["schema"]))
    return F.concat(F.array(of(q["from"])), F.transform(_joins(q), of))


def _comparisons(q: Column, path: Column, n: Column) -> Column:
    kinds = {"kind": "string", "fb": "int", "fn": "string", "ub": "int", "un": "string", "text": "string", "cast": "string", "typed": "boolean", "literal": "string", "found": f"array<{_PAIR}>"}
    no_pair = _list(_PAIR)

    def pairs(text: Column, names: Column, schemas: Column) -> Column:
        def atom(head: Column, t: Column) -> Column:
            is_field, is_value = head == "field", head.isin("lit", "param")
            kind_of = F.regexp_extract(t, _VALUE, 3)
            b = F.when(is_field, _binding(t, names))
            return _let(b, lambda k: _element(
                kinds, kind=head, fb=k, fn=F.when(k.isNotNull(), _field_name(t)), ub=k, un=F.when(k.isNotNull(), _field_name(t)), text=F.when(head == "", F.when(F.startswith(t, F.lit('"')), _text(t)).otherwise(t)),
                typed=is_value, literal=F.when(is_value & ~kind_of.isin("", "null"), _text(kind_of)), found=no_pair,
            ))

        def side(x: Column) -> Column:
            schema = F.when(x["ub"].isNotNull(), F.get(schemas, x["ub"]))
            return F.struct(x["ub"].alias("binding"), x["un"].alias("field"), schema.alias("schema"), x["cast"].alias("cast"), x["literal"].alias("literal"))

        def node(kind: Column, xs: Column) -> Column:
            a, b = F.get(xs, F.lit(0)), F.get(xs, F.lit(1))
            is_type = kind == "type"
            literals = F.array_distinct(F.transform(F.filter(xs, lambda x: x["typed"]), lambda x: x["literal"]))
            own = F.array(F.struct(kind.alias("op"), F.lit(False).alias("under_not"), side(a).alias("a"), side(b).alias("b")).cast(_PAIR))
            inner = F.flatten(F.transform(xs, lambda x: x["found"]))
            negated = F.transform(inner, lambda p: F.struct(p["op"].alias("op"), F.lit(True).alias("under_not"), p["a"].alias("a"), p["b"].alias("b")))
            return _element(
                kinds, kind=kind, ub=F.when(is_type, a["fb"]), un=F.when(is_type, a["fn"]), cast=F.when(is_type, b["text"]), typed=F.coalesce(kind.isin("lit", "param"), F.lit(False)),
                literal=F.when(is_type, F.when(a["typed"], a["literal"])).when(kind.isNull() & (F.size(literals) == 1), F.get(literals, F.lit(0))),
                found=F.when(kind == "not", negated).when(kind.isin("and", "or"), inner).when(kind.isin(*COMPARISONS, "in"), own).otherwise(no_pair),
            )

        return _run(_split(text)["text"], kinds, atom, node)["found"]

    def of(s: Column) -> Column:
        one = lambda c: F.transform(pairs(c["text"], s["names"], s["schemas"]), lambda p: F.struct(path.alias("path"), c["clause"].alias("clause"), *[p[k].alias(k) for k in ("op", "under_not", "a", "b")]))
        return F.flatten(F.transform(_clauses(q, False), one))

    return _let(F.struct(_aliases(q).alias("names"), _schemas(q, n).alias("schemas")), of)


def _correlated(wheres: Column) -> Column:
    """Whether rows of a lateral query depend on the query around."""
    kinds = {"kind": "string", "field": "boolean", "parent": "boolean", "is": "boolean"}

    def node(kind: Column, xs: Column) -> Column:
        walked = F.coalesce(~kind.isin("lit", "param", "subquery"), F.lit(True))
        field, parent = walked & F.exists(xs, lambda x: x["field"]), walked & F.exists(xs, lambda x: x["parent"])
        own = F.when(kind == "and", F.exists(xs, lambda x: x["is"])).when(kind == "or", F.forall(xs, lambda x: x["is"])).when(kind == "not", F.get(xs, F.lit(0))["is"]).when(kind.isin(*COMPARISONS, "in", "fragment"), field & parent).otherwise(F.lit(False))
        return _element(kinds, kind=kind, field=field, parent=parent, **{"is": own})

    atom = lambda head, t: _element(kinds, kind=head, field=head == "field", parent=head == "parent", **{"is": F.lit(False)})
    return F.exists(wheres, lambda w: _run(_split(w["expr"])["text"], kinds, atom, node)["is"])


_TERM = "struct<text:string,bindings:array<int>,key:string>"


def _terms(text: Column, names: Column, own: Column) -> Column:
    """An expression's canonical text and its conjuncts: canonical text (bindings by number, ``own`` as a placeholder, operands of and, or, ==
    in order), bindings, and the field name if it equates it between ``own`` and an earlier binding."""
    kinds = {"kind": "string", "fb": "int", "fn": "string", "text": "string", "bindings": "array<int>", "terms": f"array<{_TERM}>"}

    def of(split: Column) -> Column:
        def with_term(kind: Column, text: Column, bindings: Column, key: Column, fb: Column | None = None, fn: Column | None = None, terms: Column | None = None) -> Column:
            single = F.array(F.struct(text.alias("text"), bindings.alias("bindings"), key.alias("key")).cast(_TERM))
            known = {} if fb is None else {"fb": fb, "fn": fn}
            return _element(kinds, kind=kind, text=text, bindings=bindings, terms=single if terms is None else F.when(kind == "and", terms).otherwise(single), **known)

        def atom(head: Column, t: Column) -> Column:
            def with_binding(b: Column) -> Column:
                where = F.when(b == own, "own").when(b.isNotNull(), b.cast("string")).otherwise(F.regexp_extract(t, _FIELD, 1))
                value = F.concat(F.lit("["), F.array_join(F.array(F.regexp_extract(t, _VALUE, 1), F.regexp_extract(t, _VALUE, 2), F.regexp_extract(t, _VALUE, 3)), ","), F.lit("]"))
                object_ = F.get(split["objects"], F.regexp_extract(t, r"^\{(\d+)\}$", 1).try_cast("int"))["text"]
                text = F.when(head == "field", F.concat(F.lit("[field,"), where, F.lit(","), F.regexp_extract(t, _FIELD, 2), F.lit("]"))).when(head.isin("lit", "param"), value).when(F.startswith(t, F.lit("{")), object_).otherwise(t)
                return _let(text, lambda x: with_term(head, x, F.when(b.isNotNull(), F.array(b)).otherwise(_list("int")), _none("string"), b, F.when(b.isNotNull(), _field_name(t))))

            return _let(F.when(head == "field", _binding(t, names)), with_binding)

        def node(kind: Column, xs: Column) -> Column:
            texts = F.transform(xs, lambda x: x["text"])
            ordered = F.when(F.coalesce(kind.isin("and", "or", "=="), F.lit(False)), F.array_sort(texts)).otherwise(texts)
            text = F.concat(F.lit("["), F.coalesce(F.concat(kind, F.lit(":")), F.lit("")), F.array_join(ordered, ","), F.lit("]"))
            walked = F.coalesce(~kind.isin("lit", "param", "subquery"), F.lit(True))
            bindings = F.when(walked, F.array_distinct(F.flatten(F.transform(xs, lambda x: x["bindings"])))).otherwise(_list("int"))
            a, b = F.get(xs, F.lit(0)), F.get(xs, F.lit(1))
            key = F.when((kind == "==") & (a["fn"] == b["fn"]) & (F.greatest(a["fb"], b["fb"]) == own) & (F.least(a["fb"], b["fb"]) < own), a["fn"])
            return _let(text, lambda x: with_term(kind, x, bindings, key, terms=F.flatten(F.transform(xs, lambda y: y["terms"]))))

        return _let(_run(split["text"], kinds, atom, node), lambda x: F.struct(x["text"].alias("text"), x["terms"].alias("terms")))

    return _let(_split(text), of)


def _join_facts(q: Column) -> Column:
    def of(names: Column) -> Column:
        def one(j: Column, k: Column) -> Column:
            own = k + 1
            terms = F.when(j["on"].isNull(), F.struct(F.lit("").alias("text"), _list(_TERM).alias("terms"))).otherwise(_terms(j["on"], names, own))
            about = F.flatten(F.transform(F.filter(_clauses(q, False), lambda c: c["clause"] != "on"), lambda c: F.filter(_terms(c["text"], names, own)["terms"], lambda t: F.array_contains(t["bindings"], own))))
            source = F.to_json(F.struct(*[j[c].alias(c) for c in ("qual", "schema", "table", "assoc", "prefix", "hints", "subquery")]))
            lateral = F.coalesce(F.instr(j["qual"], "lateral") > 0, F.lit(False)) & j["subquery"].isNotNull()

            def facts(ts: Column) -> Column:
                signature = F.concat_ws("|", source, ts["text"], F.array_join(F.array_sort(F.transform(about, lambda t: t["text"])), "&"))
                return F.struct(
                    k.cast("int").alias("join_index"), F.coalesce(j["qual"], F.lit("inner")).alias("qual"), j["schema"].alias("schema"), j["assoc"].alias("assoc"), j["as"].alias("alias"),
                    F.coalesce(F.regexp_like(j["on"], F.lit(rf'^{_S}\[{_S}"lit"{_S},{_S}true{_S}[,\]]')), F.lit(False)).alias("on_true"),
                    F.when(lateral, _correlated(_wheres(_read(j["subquery"])))).otherwise(F.lit(False)).alias("correlated"),
                    F.array_compact(F.transform(ts["terms"], lambda t: t["key"])).alias("key_fields"), signature.alias("signature"),
                )

            return _let(terms, facts)

        return F.transform(_joins(q), one)

    return _let(_aliases(q), of)


def _unit(q: Column, operation: Column) -> Column:
    value = lambda e: F.coalesce(~F.regexp_like(e, F.lit(rf'^{_S}\[{_S}"(?:lit|param)"{_S},{_S}null{_S}[,\]]')), F.lit(False))
    is_one = lambda e: F.coalesce(F.regexp_like(e, F.lit(rf'^{_S}\[{_S}"lit"{_S},{_S}1{_S}[,\]]')), F.lit(False))
    return F.struct(
        operation.alias("operation"), q["limit"].isNotNull().alias("limit_node"), value(q["limit"]).alias("limit_value"), q["offset"].isNotNull().alias("offset_node"), value(q["offset"]).alias("offset_value"),
        (F.size(_some(q["order_by"], "string")) > 0).alias("ordered"), (is_one(q["limit"]) & is_one(q["select"])).alias("probe"),
    )


def _unnamed(q: Column) -> Column:
    """Bindings without a name, and positional references to them."""
    one = lambda kind, detail: F.struct(F.lit(kind).alias("kind"), detail.alias("detail"))
    root = q["from"]
    given = lambda text: F.when(text != "", text)

    def of(names: Column) -> Column:
        def reference(clause: Column, t: Column) -> Column:
            number = F.regexp_extract(t, _FIELD, 1).try_cast("int")
            # a name or a number that is no binding isn't a reference to one
            bare = F.when((number >= 0) & (number < F.size(names)), F.get(names, number).isNull())
            return F.when(bare, one("reference", F.concat(clause, F.lit(":"), number.cast("string"), F.lit("."), _field_name(t))))

        references = lambda c: F.array_compact(F.transform(F.regexp_extract_all(_split(c["text"])["text"], F.lit(_FIELD), F.lit(0)), lambda t: reference(c["clause"], t)))
        clauses = F.filter(_clauses(q), lambda c: ~c["clause"].isin("limit", "offset"))
        return F.concat(
            F.array_compact(F.array(F.when(F.get(names, F.lit(0)).isNull(), one("root", F.coalesce(given(root["table"]), given(root["schema"]), F.lit("subquery")))))),
            F.array_compact(F.transform(_joins(q), lambda j, k: F.when(F.get(names, k + 1).isNull(), one("join", k.cast("string"))))),
            F.flatten(F.transform(clauses, references)),
        )

    return F.when(_truthy(q["lookup"]), _list("struct<kind:string,detail:string>")).otherwise(_let(_aliases(q), of))


_PLAIN = {"ordered": "boolean", "order_fields": "array<string>", "over_limit": "boolean", "keys_over": "boolean"}
#: The facts that can be asked for, besides query_id.
NAMES = ("operation", "schema", "table_name", "db_schema", "bounded", "ordered", "order_fields", *_KINDS, "over_limit", "keys_over")


def compile_queries(queries: DataFrame, id_column: str = "query_id", tree_column: str = "tree", only: Iterable[str] = NAMES) -> DataFrame:
    """A row of FACTS for each query, or of ``only`` some; null or malformed trees are errors."""
    wanted = [c for c in NAMES if c in set(only)]
    tree = F.coalesce(F.col(tree_column), F.raise_error(F.lit("a query tree is null")).cast("string"))
    rows = queries.select(F.col(id_column).cast("long").alias("query_id"), tree.alias("tree"))
    # as many tasks as a shuffle has, however few bytes the trees are
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows meet the facts by 128 bits of hash, as trees are long; and what many queries have is dealt to several tasks,
    # each of which works it out for its own share
    key = {"h1": F.xxhash64("tree"), "h2": F.xxhash64(F.lit(1), "tree"), "share": F.pmod(F.xxhash64("query_id"), F.lit(SHARES)).cast("int")}
    rows = rows.withColumns(key)
    found = _facts_of(rows.select(*key, "tree").distinct().repartition(parts, *key), list(key), wanted)
    return rows.select("query_id", *key).join(found, list(key)).select("query_id", *wanted)


def _facts_of(rows: DataFrame, kept: list[str], wanted: list[str]) -> DataFrame:
    """The facts of each row's tree, and the columns ``kept``."""
    rows = rows.select(*kept, F.size(F.regexp_extract_all("tree", F.lit(rf'"from"{_S}:'), F.lit(0))).alias("n"), all_queries(F.col("tree")).alias("parts"))
    q, n = F.get("parts", F.lit(0))["q"], F.col("n")
    sets = F.filter("parts", lambda p: p["path"].isNotNull())
    operation = F.coalesce(q["operation"], F.lit("all"))
    order = lambda e: F.when(F.regexp_like(e, F.lit(f"^{_S}{_FIELD}{_S}$")), F.when(_binding(e, _aliases(q)) == 0, _field_name(e)))
    root = lambda: F.element_at(_layers(q, n), -1)["from"]
    made: dict[str, Callable[[], Column]] = {
        "operation": lambda: operation,
        "schema": lambda: root()["schema"],
        "table_name": lambda: root()["table"],
        "db_schema": lambda: root()["prefix"],
        "bounded": lambda: bounded(_wheres(q)),
        "ordered": lambda: F.size(_some(q["order_by"], "string")) > 0,
        "order_fields": lambda: F.array_compact(F.transform(_some(q["order_by"], "string"), order)),
        "units": lambda: F.transform("parts", lambda p, k: _unit(p["q"], F.when(k == 0, operation).otherwise(F.lit("all")))),
        "joins": lambda: _join_facts(q),
        "comparisons": lambda: F.flatten(F.transform(sets, lambda p: _comparisons(p["q"], p["path"], n))),
        "unnamed": lambda: F.flatten(F.transform(F.filter("parts", lambda p: p["named"]), lambda p: _unnamed(p["q"]))),
    }
    if {"branches", "over_limit", "keys_over"} & set(wanted):
        rows = _branches(rows, sets)
    facts = F.struct(*[(made[c]() if c in made else F.col(c)).cast(_KINDS.get(c, _PLAIN.get(c, "string"))).alias(c) for c in wanted])
    # a generator of one row: filters of the facts would else be pushed below it, and work them out again there
    return rows.select(*kept, F.inline(F.array(facts)))
