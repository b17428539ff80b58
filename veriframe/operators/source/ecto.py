"""Checks of queries, schemas and migrations in source."""

from __future__ import annotations

import re
from typing import Any

from ...sources.code import Source, alias_name, call, flows, is_var, keywords, sections
from ...sources.elixir import Atom, Node, Sigil, Text, Tup, walk
from .registry import Found, check

#: Names of query macros, of repository functions, and of query keys.
QUERY = frozenset("from where or_where select select_merge order_by group_by having or_having preload lock distinct limit offset join left_join right_join inner_join cross_join full_join update union union_all except except_all intersect intersect_all windows combinations".split())
BINDING_QUERY = frozenset("where select select_merge order_by group_by having preload lock distinct update".split())
JOINS = frozenset("join left_join right_join inner_join cross_join full_join".split())
REPO_READ = frozenset("get get! get_by get_by! all one one! aggregate exists? stream".split())
REPO_WRITE = frozenset("insert insert! update update! delete delete!".split())
MUTATIONS = frozenset("insert insert! insert_all insert_or_update insert_or_update! update update! update_all delete delete! delete_all".split())
CLAUSES = frozenset("combinations cross_join distinct except except_all full_join group_by having inner_join inner_lateral_join intersect intersect_all join left_join left_lateral_join limit lock offset or_having or_where order_by prefix preload right_join select select_merge union union_all update where windows with_cte".split())
COMPARE = (">", ">=", "<", "<=", "==", "===", "!=", "!==")
MIGRATIONS = "priv/repo/migrations/"


def repo_all(x: Any, piped: bool, *functions: str):
    c = call(x, piped)
    return c if c and c.repo(*(functions or ("all",))) else None


@check("ecto.composable_preload_queries", "warning")
def composable_preload_queries(src: Source, o) -> Found:
    for d in src.definitions:
        if d.name.endswith("_preload_query"):
            # names that stand for a literal of the helper itself
            fixed = {x.args[0].name for x in walk(d.body) if isinstance(x, Node) and x.name == "=" and is_var(x.args[0]) and not any(is_var(y) for y in walk(x.args[1]))}
            given = lambda what: isinstance(what, Node) and what.name == "^" and not is_var(what.args[0], *fixed or ("",))  # noqa: B023, E731
            for x in walk(d.body):
                c = call(x)
                if c and c.function == "preload" and c.module in (None, "Ecto.Query") and c.args:
                    if not given(c.args[-1]):
                        yield x, "a preload helper should take its preloads: preload(^preloads)"
                elif c and c.function == "from" and "preload" in (k := keywords(c.args[-1] if c.args else None)) and not given(k["preload"]):
                    yield x, "a preload helper should take its preloads: preload: ^preloads"


@check("ecto.context_owns_schema_queries", "design")
def context_owns_schema_queries(src: Source, o) -> Found:
    contexts, repos = list(o.get("contexts", ())), o.get("repo_modules", ())
    if not contexts or not src.outside(o.get("excluded_paths")):
        return

    def owner(schema: str) -> str | None:
        return max((c for c in contexts if schema.startswith(c + ".")), key=len, default=None)

    for module, node in src.modules:
        if module in o.get("excluded_modules", ()):
            continue
        full = {}
        for x in walk(node):
            c = call(x)
            if c and c.function == "alias" and c.module is None and c.args and (name := alias_name(c.args[0])):
                as_ = alias_name(keywords(c.args[-1]).get("as")) if len(c.args) > 1 else None
                full[as_ or name.rsplit(".", 1)[-1]] = name
        expand = lambda n: ".".join([full.get(n.split(".")[0], n.split(".")[0]), *n.split(".")[1:]])
        seen = set()
        for x in walk(sections(node).get("do")):
            names: list[Any] = []
            c = call(x)
            if isinstance(x, Node) and x.name == "|>" and (r := call(x.args[1], True)) and (r.function in QUERY if r.module in (None, "Ecto.Query") else _is_repo(expand(r.module), repos) and r.function in REPO_READ | REPO_WRITE):
                names.append(x.args[0])
            if c and c.module in (None, "Ecto.Query") and c.function in QUERY and c.args:
                first = c.args[0]
                names.append(first.args[1] if isinstance(first, Node) and first.name == "in" else first)
            elif c and c.module and _is_repo(expand(c.module), repos) and c.function in REPO_READ | REPO_WRITE and c.args:
                names.append(c.args[0])
            for n in names:
                n = n.args[0] if isinstance(n, Node) and n.name == "%" else n
                name = alias_name(n)
                own = owner(expand(name)) if name else None
                inside = module == own or (o.get("allow_owner_descendants") and module.startswith(f"{own}."))
                if own and not inside and id(n) not in seen:
                    seen.add(id(n))
                    yield x, f"{expand(name)} is queried outside {own}"


def _is_repo(name: str, repos) -> bool:
    return name in repos if repos else name.rsplit(".", 1)[-1] == "Repo"


@check("ecto.error_changeset_pattern_match", "warning")
def error_changeset_pattern_match(src: Source, o) -> Found:
    for x in src.nodes:
        if isinstance(x, Node) and x.name == "case" and isinstance(sections(x).get("do"), list):
            for clause in sections(x)["do"]:
                for p in clause.args[0]:
                    p = p.args[0] if isinstance(p, Node) and p.name == "when" else p
                    if isinstance(p, Tup) and len(p.items) == 2 and isinstance(p.items[0], Atom) and p.items[0].name == "error" and is_var(p.items[1], "changeset", "cs"):
                        yield clause, "match %Ecto.Changeset{} instead of any error value"


@check("ecto.named_binding", "readability")
def named_binding(src: Source, o) -> Found:
    if not src.outside(o.get("excluded_paths")):
        return
    for first, _, c in src.flows:
        if not c.piped or c.module not in (None, "Ecto.Query") or c.function not in BINDING_QUERY | JOINS:
            continue
        positional = any(isinstance(a, list) and a and all(is_var(v) for v in a) for a in c.args)
        if alias_name(first) or (positional and len(c.args) > 1):
            yield c.node, "start with from(x in X, as: :name) and use named bindings"


@check("ecto.no_and_in_where", "readability")
def no_and_in_where(src: Source, o) -> Found:
    for c in src.calls:
        if c.module not in (None, "Ecto.Query"):
            continue
        parts = c.args if c.function == "where" else [v for k, v in keywords(c.args[-1]).items() if k == "where"] if c.function == "from" and c.args else []
        for x in (x for p in parts for x in walk(p)):
            if isinstance(x, Node) and x.name == "and":
                yield x, "use several where clauses instead of and"


@check("ecto.no_data_changes_in_schema_migrations", "warning")
def no_data_changes_in_schema_migrations(src: Source, o) -> Found:
    if MIGRATIONS not in src.file:
        return
    for c in src.calls:
        if c.last == "Repo" and c.function in MUTATIONS:
            yield c.node, "a schema migration should not change rows"
        elif c.function == "execute" and c.module is None:
            for a in c.args:
                text = a.plain if isinstance(a, Text) else a.text if isinstance(a, Sigil) else ""
                text = re.sub(r"\A(\s+|--[^\n]*(\n|\Z)|/\*.*?\*/)*", "", text, flags=re.DOTALL)
                if re.match(r"(insert|update|delete|merge)\b", text, re.IGNORECASE):
                    yield a, "a schema migration should not change rows"
                    break


@check("ecto.no_repo_preload_after_query", "warning")
def no_repo_preload_after_query(src: Source, o) -> Found:
    helpers = set()
    for d in src.definitions:
        if d.params and is_var(d.params[0]):
            for first, _, c in flows(d.body):
                if c.repo("preload") and is_var(first, d.params[0].name):
                    helpers.add((d.name, len(d.params)))
    for block in [d.body for d in src.definitions]:
        results = {x.args[0].name for x in walk(block) if isinstance(x, Node) and x.name == "=" and is_var(x.args[0]) and _read(x.args[1])}
        for first, piped, c in flows(block):
            preloads = c.repo("preload") or (c.module is None and (c.function, c.arity) in helpers)
            if preloads and (repo_all(first, piped, "all", "one", "one!") or (is_var(first) and first.name in results)):
                yield c.node, "preload in the query"




def _read(x: Any) -> bool:
    while isinstance(x, Node) and x.name == "|>":
        if repo_all(x.args[1], True, "all", "one", "one!"):
            return True
        return False
    return bool(repo_all(x, False, "all", "one", "one!"))


@check("ecto.no_repo_transaction", "refactor")
def no_repo_transaction(src: Source, o) -> Found:
    for c in src.calls:
        if c.repo("transaction") and c.arity in (1, 2):
            yield c.node, "use Repo.transact instead of Repo.transaction"


@check("ecto.own_context_for_schema", "design")
def own_context_for_schema(src: Source, o) -> Found:
    wrappers = set(o.get("schema_modules", ()))
    for module, node in src.modules:
        parts = module.split(".")
        used = any((c := call(x)) and c.function == "use" and c.args and alias_name(c.args[0]) in wrappers for x in src.own(node))
        if used and len(parts) >= 3 and module not in o.get("excluded_modules", ()):
            context, name = parts[-2].lower(), parts[-1].lower()
            singular = context[:-3] + "y" if context.endswith("ies") else context[:-1] if context.endswith("s") else context
            if not name.startswith((context, singular)):
                yield node, f"{parts[-1]} doesn't belong under {parts[-2]}"


@check("ecto.pipe_based_queries", "readability")
def pipe_based_queries(src: Source, o) -> Found:
    for c in src.calls:
        if c.function == "from" and c.module in (None, "Ecto.Query") and len(c.args) == 2 and CLAUSES & set(keywords(c.args[1])):
            yield c.node, "build the query with pipes"


@check("ecto.prefer_datetime_over_date", "warning")
def prefer_datetime_over_date(src: Source, o) -> Found:
    date = lambda x: isinstance(x, Atom) and x.name == "date"
    for x in src.nodes:
        if isinstance(x, Node) and x.name in ("schema", "embedded_schema"):
            for y in walk(sections(x).get("do")):
                c = call(y)
                if c and c.function == "field" and len(c.args) > 1 and date(c.args[1]):
                    yield y, "use a datetime instead of a date"
    if MIGRATIONS in src.file:
        for c in src.calls:
            if c.module is None and c.function in ("add", "add_if_not_exists", "modify") and len(c.args) > 1 and date(c.args[1]):
                yield c.node, "use a datetime instead of a date"


@check("ecto.prefer_order_by_over_repo_all_enum_sort", "refactor")
def prefer_order_by_over_repo_all_enum_sort(src: Source, o) -> Found:
    for first, piped, c in src.flows:
        if repo_all(first, piped) and (c.is_("Enum", "sort") and c.arity == 1 or c.is_("Enum", "sort_by") and c.arity == 2):
            yield c.node, "sort in the query"


@check("ecto.prefer_repo_aggregate_count", "refactor")
def prefer_repo_aggregate_count(src: Source, o) -> Found:
    for first, piped, c in src.flows:
        if repo_all(first, piped) and c.arity == 1 and (c.is_("Enum", "count") or (c.function == "length" and c.module in (None, "Kernel"))):
            yield c.node, "count in the query: Repo.aggregate(query, :count)"

    def counts(x: Any) -> bool:
        while isinstance(x, Node) and x.name == "|>":
            x = x.args[1]
        c = call(x)
        return bool(c and c.repo("aggregate") and any(isinstance(a, Atom) and a.name == "count" for a in c.args))

    for x in src.nodes:
        if isinstance(x, Node) and x.name in COMPARE and any(counts(a) and b in (0, 1) for a, b in (x.args, x.args[::-1])):
            yield x, "use Repo.exists? to see if there are rows"


@check("ecto.prefer_repo_one_over_all_first", "refactor")
def prefer_repo_one_over_all_first(src: Source, o) -> Found:
    for first, piped, c in src.flows:
        if repo_all(first, piped) and (c.is_("List", "first") or (c.is_("Enum", "at") and c.rest[:1] == [0]) or (c.function == "hd" and c.module in (None, "Kernel"))):
            yield c.node, "read one row: limit in the query and Repo.one"


def projection(f: Any) -> bool:
    """A function that only takes fields of its parameter."""
    if not isinstance(f, Node):
        return False
    if f.name == "&" and f.args and isinstance(f.args[0], (Node, Tup)):
        body, own = f.args[0], lambda v: isinstance(v, Node) and v.name == "&" and v.args == [1]
    elif f.name == "fn" and len(f.args) == 1 and isinstance(f.args[0], Node) and f.args[0].name == "->" and len(f.args[0].args[0]) == 1 and is_var(f.args[0].args[0][0]):
        name, body = f.args[0].args[0][0].name, f.args[0].args[1]
        own = lambda v: is_var(v, name)
    else:
        return False

    def field(x: Any) -> bool:
        return isinstance(x, Node) and isinstance(x.name, Node) and x.name.name == "." and not x.args and not x.parens and (own(x.name.args[0]) or field(x.name.args[0]))

    if isinstance(body, Tup):
        return bool(body.items) and all(map(field, body.items))
    if isinstance(body, Node) and body.name == "%{}":
        values = [v for a in body.args for v in ([a.args[1]] if isinstance(a, Node) and a.name == "=>" else keywords(a).values() or [None])]
        return bool(values) and all(map(field, values))
    return field(body)


@check("ecto.prefer_select_over_repo_all_enum_map", "refactor")
def prefer_select_over_repo_all_enum_map(src: Source, o) -> Found:
    for first, piped, c in src.flows:
        if repo_all(first, piped) and c.is_("Enum", "map") and c.arity == 2 and projection(c.rest[0]):
            yield c.node, "select the fields in the query"


@check("ecto.use_my_app_schema", "design")
def use_my_app_schema(src: Source, o) -> Found:
    if src.file.endswith("/schema.ex"):
        return
    for c in src.calls:
        if c.function == "use" and c.module is None and c.args and alias_name(c.args[0]) == "Ecto.Schema":
            yield c.node, "use the application's schema module"
