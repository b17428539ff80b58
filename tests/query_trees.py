"""Query trees at random, of every shape that facts are made of."""

import random

FIELDS = ["id", "tenant_id", "title", "at", "day"]
ALIASES = ["p", "a", "b", None]


def binding(rng):
    return rng.choice([0, 0, 0, 1, 2, 5, "p", "a", "x", 'q"u'])


def field(rng):
    return ["field", binding(rng), rng.choice(FIELDS)]


def value(rng):
    v = rng.choice([1, 2, "x", "y z", 'a "quoted" [one], {too}', True, None, 1.5, "é"])
    return [rng.choice(["lit", "param"]), v] + ([rng.choice(["string", "naive_datetime", "utc_datetime", None])] if rng.random() < 0.6 else [])


def operand(rng, depth):
    k = rng.random()
    if k < 0.5:
        return field(rng)
    if k < 0.8:
        return value(rng)
    if k < 0.88:
        return ["type", rng.choice([field(rng), value(rng)]), rng.choice(["date", "integer"])]
    if k < 0.92:
        return ["parent", "id"]
    if k < 0.96:
        return ["fragment", "lower(?)", field(rng)]
    return ["subquery", query(rng, depth - 1)] if depth > 0 else ["is_nil", field(rng)]


def condition(rng, depth, nested=1):
    k = rng.random()
    if depth > 0 and k < 0.45:
        return [rng.choice(["and", "or"]), *[condition(rng, depth - 1, nested) for _ in range(rng.randrange(1, 4))]]
    if depth > 0 and k < 0.55:
        return ["not", condition(rng, depth - 1, nested)]
    if k < 0.75:
        return [rng.choice(["==", "==", "!=", "<", ">="]), operand(rng, nested), operand(rng, nested)]
    if k < 0.85:
        return ["in", operand(rng, nested), rng.choice([[value(rng) for _ in range(rng.randrange(4))], field(rng), value(rng)])]
    if k < 0.93:
        return ["is_nil", operand(rng, 0)]
    if k < 0.97:
        return ["==", ["is_nil", field(rng)], ["lit", rng.random() < 0.5, "boolean"]]
    return rng.choice([["lit", True], ["lit", False], field(rng), ["fragment", "x", ["parent", "id"], field(rng)]])


def clauses(rng, depth, nested):
    return [{"op": rng.choice(["and", "or"]), "expr": condition(rng, depth, nested)} for _ in range(rng.choice([0, 1, 1, 2, 3]))]


def source(rng, depth):
    if depth > 0 and rng.random() < 0.25:
        return {"subquery": query(rng, depth - 1), "as": rng.choice(ALIASES)}
    return {k: v for k, v in {"schema": rng.choice(["Post", "Author"]), "table": rng.choice(["posts", "authors"]), "prefix": rng.choice(["app", None]), "as": rng.choice(ALIASES)}.items() if v is not None or rng.random() < 0.3}


def join(rng, depth):
    on = rng.choice([["==", ["field", 0, "tenant_id"], ["field", 1, "tenant_id"]], ["lit", True], ["==", ["field", 2, "id"], ["field", 0, "id"]], None, 0])
    out = {"qual": rng.choice(["inner", "left", "cross", "left_lateral", "inner_lateral"])} | source(rng, depth)
    if rng.random() < 0.2:
        out["assoc"] = "author"
    if on is not None:
        out["on"] = condition(rng, 2, 0) if on == 0 else on
    return out


def query(rng, depth):
    q = {"from": source(rng, depth), "wheres": clauses(rng, 3, depth)}
    if rng.random() < 0.6:
        q["operation"] = rng.choice(["all", "delete_all", "update_all", "stream"])
    if rng.random() < 0.6:
        q["joins"] = [join(rng, depth) for _ in range(rng.randrange(4))]
        if q["joins"] and rng.random() < 0.3:
            q["joins"].append(dict(q["joins"][0]))
    if rng.random() < 0.3:
        q["havings"] = clauses(rng, 1, 0)
    if rng.random() < 0.5:
        q["order_by"] = [operand(rng, 0) for _ in range(rng.randrange(3))]
    for k in ("limit", "offset"):
        if rng.random() < 0.4:
            q[k] = rng.choice([["lit", 1], ["lit", 10, "integer"], ["param", None], ["param", 3]])
    if rng.random() < 0.4:
        q["select"] = rng.choice([["lit", 1], field(rng), ["fragment", "count(?)", field(rng)], [field(rng), field(rng)]])
    if rng.random() < 0.1:
        q["lookup"] = True
    if depth > 0:
        if rng.random() < 0.25:
            q["ctes"] = [{"name": "c", "query": query(rng, depth - 1)}]
        if rng.random() < 0.35:
            q["combinations"] = [{"op": rng.choice(["union", "except"]), "query": query(rng, depth - 1)} for _ in range(rng.randrange(1, 3))]
    return q


def trees(n, seed):
    rng = random.Random(seed)
    return [query(rng, rng.choice([0, 0, 1, 2, 3])) for _ in range(n)]


def deep(n):
    """Sources within sources, each but the outermost with an offset at the innermost only."""
    q = {"from": {"schema": "Post", "table": "posts", "as": "p"}, "wheres": [], "offset": ["lit", 3]}
    for _ in range(n):
        q = {"from": {"subquery": q, "as": "p"}, "wheres": [{"op": "and", "expr": ["==", ["field", 0, "id"], ["lit", n]]}]}
    return q
