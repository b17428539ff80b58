"""Checks of the language's own constructs."""

from __future__ import annotations

import re
from typing import Any

from ...sources.code import DEFINITIONS, Source, alias_name, call, is_var, keywords, sections, show
from ...sources.elixir import Atom, Node, Sigil, Text, Tup, children, walk
from .ecto import projection
from .registry import Found, check

#: Modules of the standard libraries, by first segment.
STANDARD = frozenset("Access ArgumentError ArithmeticError Behaviour Collectable Config DynamicSupervisor Enumerable ErlangError Inspect JSON KeyError PartitionSupervisor RuntimeError Agent Application Atom Base Bitwise Calendar Code Date DateTime Duration Enum Exception File Float Function GenServer Integer IO Kernel Keyword List Macro Map MapSet Module NaiveDateTime Node OptionParser Path Port Process Protocol Range Record Regex Registry Stream String StringIO Supervisor System Task Time Tuple URI Version".split())
#: Modules of Erlang's kernel and standard library.
ERLANG = frozenset("application array atomics base64 beam_lib binary c calendar code counters dets dict digraph digraph_utils disk_log edlin epp erl_anno erl_ddll erl_epmd erl_error erl_eval erl_expand_records erl_features erl_internal erl_lint erl_parse erl_pp erl_scan erl_tar erlang erpc error_handler error_logger escript ets file file_sorter filelib filename gb_sets gb_trees gen_event gen_fsm gen_sctp gen_server gen_statem gen_tcp gen_udp global global_group heart inet inet_res init io io_lib json lists log_mf_h logger logger_disk_log_h logger_filters logger_formatter logger_handler logger_std_h maps math ms_transform net net_adm net_kernel orddict ordsets os peer persistent_term pg pool prim_file proc_lib proplists qlc queue rand random re rpc seq_trace sets shell shell_default slave socket sofs string supervisor supervisor_bridge sys timer trace unicode uri_string user win32reg wrap_log_reader zip zlib".split())
COMPARE = ("==", "===", "!=", "!==")


def _excluded(f):
    """Skips files in excluded_paths."""

    def run(src: Source, o) -> Found:
        if src.outside(o.get("excluded_paths")):
            yield from f(src, o)

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


def _words(segment: str) -> list[str]:
    return re.findall(r"[A-Z]+(?![a-z])|[A-Z][a-z0-9]*|[a-z0-9]+", segment)


@check("elixir.app_module_acronym_casing", "readability")
def app_module_acronym_casing(src: Source, o) -> Found:
    acronyms = {a.lower(): a for a in o.get("acronyms", ("API", "CSV", "HTTP", "JSON", "LLM", "UUID"))}
    roots, exempt = tuple(o.get("app_roots", ())), tuple(o.get("exempt_prefixes", ("Mix.Tasks",)))
    for x in src.nodes:
        name = alias_name(x)
        if name and name.split(".")[0] in roots and not name.startswith(exempt):
            wrong = [w for part in name.split(".") for w in _split(part, acronyms)]
            if wrong:
                yield x, f"write {acronyms[wrong[0].lower()]} in {name}"


def _split(part: str, acronyms: dict[str, str]) -> list[str]:
    """Words of a name that are acronyms (also in the plural) in another case."""
    out = []
    for w in _words(part):
        low = w.lower()
        base = low if low in acronyms else low[:-1] if low.endswith("s") and low[:-1] in acronyms else None
        if base and not w.startswith(acronyms[base]):
            out.append(w if low in acronyms else w[:-1])
    return out


@check("elixir.doc_before_spec", "readability")
def doc_before_spec(src: Source, o) -> Found:
    for _, module in src.modules:
        doc = spec = None
        for x in src.own(module):
            if isinstance(x, Node) and x.name == "@" and isinstance(x.args[0], Node):
                if x.args[0].name == "doc":
                    doc = x
                elif x.args[0].name == "spec":
                    spec = spec or x
            elif isinstance(x, Node) and x.name in (*DEFINITIONS, "defguard", "defdelegate"):
                if x.name in ("def", "defguard", "defmacro") and doc and spec and doc.line > spec.line:
                    yield doc, "@doc belongs before @spec"
                doc = spec = None


def _after(name: str, category: str, first: tuple[str, ...], then, message: str) -> None:
    """Enum.x followed by a call."""

    @check(name, category)
    def run(src: Source, o) -> Found:
        for producer, piped, c in src.flows:
            p = call(producer, piped)
            if p and p.is_("Enum", *first) and p.arity == 2 and then(c):
                yield c.node, message


_after("elixir.filter_reject_first", "refactor", ("filter", "reject"), lambda c: c.is_("List", "first") and c.arity == 1, "use Enum.find instead of filtering for the first")
_after("elixir.reject_count", "refactor", ("reject",), lambda c: c.is_("Enum", "count") and c.arity == 1, "use Enum.count with a condition")


@check("elixir.prefer_enum_uniq_by", "readability")
def prefer_enum_uniq_by(src: Source, o) -> Found:
    for producer, piped, c in src.flows:
        p = call(producer, piped)
        if p and p.is_("Enum", "map") and p.arity == 2 and projection(p.rest[0]) and c.is_("Enum", "uniq") and c.arity == 1:
            yield c.node, "use Enum.uniq_by to find distinct fields"


@check("elixir.float_usage", "warning")
def float_usage(src: Source, o) -> Found:
    lines = set()
    float_type = lambda x: isinstance(x, Atom) and x.name == "float"
    found: list[Node] = []
    for c in src.calls:
        if c.module is None and c.function in ("add", "add_if_not_exists", "modify", "field") and len(c.args) > 1 and float_type(c.args[1]):
            found.append(c.node)
        elif c.module == "Float":
            found.append(c.node)
    for _, tree, _ in src.type_attributes:
        found += [x for x in walk(tree) if isinstance(x, Node) and x.name == "float" and x.args == []]
    for x in found:
        lines.add(x.line)
        yield x, "use Decimal or integers instead of floats"
    for x in src.nodes:
        for y in children(x):
            if isinstance(y, float):
                line, column = getattr(x, "line", 0), getattr(x, "column", 0)
                if line and line not in lines:
                    lines.add(line)
                    yield (line, column), "use Decimal or integers instead of floats"


def _types(src: Source, *names: str):
    return [(n, t, x) for n, t, x in src.type_attributes if n in names]


@check("elixir.fully_specified_struct_types", "warning")
def fully_specified_struct_types(src: Source, o) -> Found:
    for _, tree, _ in _types(src, "type", "typep", "opaque"):
        for x in walk(tree):
            if isinstance(x, Node) and x.name == "%" and not x.args[1].args:
                yield x, "give the types of the struct's fields"


def _is_keyword_type(x: Any) -> bool:
    c = call(x)
    return (isinstance(x, Node) and x.name == "keyword" and x.args == []) or bool(c and c.is_("Keyword", "t"))


@check("elixir.fully_typed_opts", "readability")
@_excluded
def fully_typed_opts(src: Source, o) -> Found:
    opts = lambda name: name in ("opts", "options") or name.endswith(("_opts", "_options"))
    for kind, tree, _ in src.type_attributes:
        if kind in ("type", "typep", "opaque"):
            if isinstance(tree, Node) and tree.name == "::" and isinstance(tree.args[0], Node) and isinstance(tree.args[0].name, str) and opts(tree.args[0].name) and _is_keyword_type(tree.args[1]):
                yield tree, "name the options and their types"
        else:
            for p in _spec_params(tree):
                if isinstance(p, Node) and p.name == "::" and is_var(p.args[0]) and opts(p.args[0].name) and _is_keyword_type(p.args[1]):
                    yield p, "name the options and their types"


def _spec_head(tree: Any) -> Node | None:
    if isinstance(tree, Node) and tree.name == "when":
        tree = tree.args[0]
    return tree.args[0] if isinstance(tree, Node) and tree.name == "::" and isinstance(tree.args[0], Node) else None


def _spec_params(tree: Any) -> list:
    head = _spec_head(tree)
    return (head.args or []) if head is not None else []


@check("elixir.named_spec_params", "readability")
def named_spec_params(src: Source, o) -> Found:
    for _, tree, node in _types(src, "spec"):
        params = _spec_params(tree)
        bare = [p for p in params if not (isinstance(p, Node) and p.name == "::")]
        if bare and len(params) >= o.get("min_params", 1):
            yield node, "name the parameters of the spec"


@check("elixir.no_catch_all_in_with_else", "readability")
def no_catch_all_in_with_else(src: Source, o) -> Found:
    for x in src.nodes:
        if isinstance(x, Node) and x.name == "with" and isinstance(clauses := sections(x).get("else"), list):
            for c in clauses:
                if isinstance(c, Node) and c.name == "->" and len(c.args[0]) == 1 and is_var(c.args[0][0]):
                    yield c, "name the results that else handles"
                    break


@check("elixir.no_end_of_day_time", "warning")
def no_end_of_day_time(src: Source, o) -> Found:
    if src.outside(o.get("excluded_paths", ("test/",))):
        for x in src.nodes:
            if isinstance(x, Sigil) and x.name == "T" and x.text.startswith("23:59:59"):
                yield x, "end an interval before the next day instead of at 23:59:59"


@check("elixir.no_extra_public_behaviour_functions", "design")
@_excluded
def no_extra_public_behaviour_functions(src: Source, o) -> Found:
    """``behaviours``: name -> its callbacks as (name, arity)."""
    known, allowed = dict(o.get("behaviours", {})), {tuple(a) for a in o.get("allowed", ())}
    for module, node in src.modules:
        own = [alias_name(x.args[0].args[0]) for x in src.own(node) if isinstance(x, Node) and x.name == "@" and isinstance(x.args[0], Node) and x.args[0].name == "behaviour" and x.args[0].args]
        own += [alias_name(c.args[0]) for x in src.own(node) if (c := call(x)) and c.function == "use" and c.args]
        callbacks = {tuple(cb) for b in own if b in known for cb in known[b]}
        seen = set()
        for d in src.definitions if callbacks else ():
            key = (d.name, len(d.params))
            if d.module == module and d.kind == "def" and key not in callbacks | allowed | seen:
                seen.add(key)
                yield d.node, f"{d.name}/{len(d.params)} is no callback"


@check("elixir.no_low_level_process_primitives", "design")
@_excluded
def no_low_level_process_primitives(src: Source, o) -> Found:
    for c in src.calls:
        if c.module in ("Process", "GenServer", ":ets"):
            yield c.node, f"{c.module.removeprefix(':')}.{c.function} belongs behind a process module"


def _bound(x: Any) -> set[str]:
    """Variables that a pattern binds, but for those that begin with _ and pinned ones."""
    out, todo = set(), [x]
    while todo:
        y = todo.pop()
        if isinstance(y, Node) and y.name == "^":
            continue
        if is_var(y) and not y.name.startswith("_"):
            out.add(y.name)
        todo += children(y.args[1] if isinstance(y, Node) and y.name == "%" else y)
    return out


@check("elixir.no_param_extraction_in_function_head", "readability")
def no_param_extraction_in_function_head(src: Source, o) -> Found:
    def maps(x: Any) -> list[Node]:
        if isinstance(x, Node) and x.name in ("%{}", "%"):
            return [x]
        return [m for y in children(x) for m in maps(y)]

    def bad(params: list, guard: Any) -> Any:
        used = {y.name for y in walk(guard) if is_var(y)} if guard is not None else set()
        return next((m for p in params for m in maps(p) if _bound(m) - used), None)

    for d in src.definitions:
        if d.kind in ("def", "defp") and (m := bad(d.params, d.guard)):
            yield m, "match in the head, extract in the body"
    for x in src.nodes:
        if isinstance(x, Node) and x.name == "->":
            params, guard = x.args[0], None
            if len(params) == 1 and isinstance(params[0], Node) and params[0].name == "when":
                params, guard = params[0].args[:-1], params[0].args[-1]
            if m := bad(params, guard):
                yield m, "match in the head, extract in the body"


@check("elixir.no_passthrough_wrapper", "refactor")
def no_passthrough_wrapper(src: Source, o) -> Found:
    kinds = ("def", "defp") if o.get("include_public") else ("defp",)
    count: dict[tuple, int] = {}
    for d in src.definitions:
        count[d.module, d.name, len(d.params)] = count.get((d.module, d.name, len(d.params)), 0) + 1
    for d in src.definitions:
        # a parameter may be matched with a struct beside its name
        params = [next((y for y in p.args if is_var(y)), p) if isinstance(p, Node) and p.name == "=" and any(isinstance(y, Node) and y.name == "%" and not y.args[1].args for y in p.args) else p for p in d.params]
        body, first = d.body, []
        if isinstance(body, Node) and body.name == "|>" and is_var(body.args[0]):
            first, body = [body.args[0]], body.args[1]
        c = call(body, bool(first))
        if d.kind in kinds and params and d.guard is None and count[d.module, d.name, len(params)] == 1 and all(map(is_var, params)) and c:
            if [show(a) for a in first + c.args] == [p.name for p in params] and (c.module, c.function) != (None, d.name):
                yield d.node, f"{d.name} only calls {c.function}"


@check("elixir.no_raise", "design")
@_excluded
def no_raise(src: Source, o) -> Found:
    def raises(x: Any) -> bool:
        c = call(x)
        return bool(c and ((c.module in (None, "Kernel") and c.function in ("raise", "reraise")) or c.function.endswith("!")))

    names = {id(d.node.args[0]) for d in src.definitions} | {id(d.node.args[0].args[0]) for d in src.definitions if d.guard is not None}
    heads = {id(x.args[0]) for x in src.nodes if isinstance(x, Node) and x.name in (*DEFINITIONS, "defdelegate") and x.args} | names
    typed = {id(y) for _, t, _ in src.type_attributes for y in walk(t)}
    for x in src.nodes:
        if id(x) in heads or id(x) in typed:
            continue
        if raises(x):
            yield x, "return an error instead of raising"
        elif isinstance(x, Node) and x.name == "=" and not is_var(x.args[0]):
            value = x.args[1]
            while isinstance(value, Node) and value.name == "|>":
                value = value.args[1]
            if call(value) and not raises(value) and isinstance(x.args[0], (Tup, Node, list)) and not call(value).node.block:
                yield x, "a match on a result raises; handle the other results"


@check("elixir.no_remote_calls_in_module_attributes", "design")
def no_remote_calls_in_module_attributes(src: Source, o) -> Found:
    full = {}
    for c in src.calls:
        if c.function == "alias" and c.module is None and c.args and (name := alias_name(c.args[0])):
            as_ = alias_name(keywords(c.args[-1]).get("as")) if len(c.args) > 1 else None
            full[as_ or name.rsplit(".", 1)[-1]] = name
    for _, module in src.modules:
        for x in src.own(module):
            if isinstance(x, Node) and x.name == "@" and isinstance(x.args[0], Node) and x.args[0].args and x.args[0].name not in ("spec", "type", "typep", "opaque", "callback", "macrocallback"):
                remote = lambda z: isinstance(z, Node) and z.name == "&" and isinstance(z.args[0], Node) and z.args[0].name == "/"
                for y in walk(x.args[0].args, skip=lambda z: isinstance(z, Node) and (z.name in ("fn", "quote") or (z.name == "&" and not remote(z)))):  # noqa: B023
                    c = call(y)
                    if c and c.module:
                        root, _, below = c.module.partition(".")
                        owner = full.get(root, root) + ("." + below if below else "")
                        standard = owner[1:] in ERLANG if owner.startswith(":") else owner.split(".")[0] in STANDARD
                        if not (standard and o.get("allow_standard_library", True)):
                            yield y, f"{c.module}.{c.function} runs when the module is compiled"


@check("elixir.no_result_tuple_argument", "design")
@_excluded
def no_result_tuple_argument(src: Source, o) -> Found:
    def result(p: Any) -> bool:
        if isinstance(p, Node) and p.name in ("=", "\\\\"):
            return any(map(result, p.args))
        return isinstance(p, Tup) and bool(p.items) and isinstance(p.items[0], Atom) and p.items[0].name in ("ok", "error")

    for d in src.definitions:
        if d.kind in ("def", "defp") and d.params and result(d.params[0]):
            yield d.node, "take the value, not a result tuple"


@check("elixir.no_then", "readability")
def no_then(src: Source, o) -> Found:
    for c in src.calls:
        if c.function == "then" and c.module in (None, "Kernel") and c.arity == 2:
            yield c.node, "bind the value instead of then"


@check("elixir.no_try_rescue", "warning")
def no_try_rescue(src: Source, o) -> Found:
    for x in src.nodes:
        if isinstance(x, Node) and x.name == "try" and {"rescue", "catch"} & set(sections(x)):
            yield x, "don't rescue; return errors"


@check("elixir.prefer_block_if", "readability")
def prefer_block_if(src: Source, o) -> Found:
    for c in src.calls:
        if c.function == "if" and c.module in (None, "Kernel") and not c.node.block and c.args and "do" in keywords(c.args[-1]):
            yield c.node, "write if with a do block"


@check("elixir.prefer_empty_list_checks", "readability")
def prefer_empty_list_checks(src: Source, o) -> Found:
    for x in src.nodes:
        if isinstance(x, Node) and x.name in COMPARE and any(a == [] for a in x.args):
            yield x, "use Enum.empty? or match on the list"


@check("elixir.prefer_enum_count", "readability")
def prefer_enum_count(src: Source, o) -> Found:
    guards = {id(y) for x in src.nodes if isinstance(x, Node) and x.name == "when" for y in walk(x.args[-1])}
    guards |= {id(y) for x in src.nodes if isinstance(x, Node) and x.name in ("defguard", "defguardp") for y in walk(x.args)}
    for c in src.calls:
        if c.function == "length" and c.module in (None, "Kernel") and c.arity == 1 and id(c.node) not in guards:
            yield c.node, "use Enum.count"


@check("elixir.prefer_list_type_syntax", "readability")
def prefer_list_type_syntax(src: Source, o) -> Found:
    for _, tree, node in src.type_attributes:
        for x in walk(tree):
            for y in children(x):
                if isinstance(y, list) and len(y) == 1 and not (isinstance(y[0], Tup) and y[0].keyword) and not (isinstance(y[0], Node) and y[0].name in ("->", "...")):
                    if not (isinstance(x, Node) and x.name == "->"):
                        yield node, "write list(type)"


@check("elixir.simple_tagged_tuple_values", "readability")
def simple_tagged_tuple_values(src: Source, o) -> Found:
    patterns = set()
    for x in src.nodes:
        if isinstance(x, Node) and x.name in ("=", "<-", "->"):
            left = x.args[0]
            patterns |= {id(y) for y in walk(left)}
    for d in src.definitions:
        patterns |= {id(y) for p in d.params for y in walk(p)}
    patterns |= {id(y) for _, t, _ in src.type_attributes for y in walk(t)}

    def tagged(x: Any) -> bool:
        return isinstance(x, Tup) and not x.keyword and len(x.items) > 1 and isinstance(x.items[0], Atom) and x.items[0].name not in ("true", "false", "nil")

    def simple(x: Any) -> bool:
        if isinstance(x, Text):
            return all(isinstance(p, str) for p in x.parts)
        if isinstance(x, Node) and x.name in ("-", "+") and len(x.args or ()) == 1:
            return isinstance(x.args[0], (int, float))
        return isinstance(x, (int, float, Atom)) or is_var(x) or alias_name(x) is not None or (tagged(x) and all(map(simple, x.items[1:])))

    inner = set()
    for x in src.nodes:
        if tagged(x) and id(x) not in patterns and id(x) not in inner:
            inner |= {id(y) for y in walk(x.items)}
            if not all(map(simple, x.items[1:])):
                yield x, "bind the value before it goes into a tagged tuple"


@check("elixir.use_maybe_in_function_name", "readability")
def use_maybe_in_function_name(src: Source, o) -> Found:
    seen = set()
    for _, module in src.modules:
        for x in src.own(module):
            if isinstance(x, Node) and x.name in (*DEFINITIONS, "defdelegate") and x.args:
                head = x.args[0].args[0] if isinstance(x.args[0], Node) and x.args[0].name == "when" else x.args[0]
                if isinstance(head, Node) and isinstance(head.name, str) and (m := re.match(r"(.+)_if_needed([!?]?)$", head.name)):
                    key = (id(module), head.name, len(head.args or ()))
                    if key not in seen:
                        seen.add(key)
                        yield x, f"call it maybe_{m[1]}{m[2]}"


@check("elixir.with_else_clause", "readability")
def with_else_clause(src: Source, o) -> Found:
    for x in src.nodes:
        if isinstance(x, Node) and x.name == "with" and (parts := sections(x)) and "else" not in parts:
            yield x, "say in else what other results mean"


