"""Checks of web code, live views and tests."""

from __future__ import annotations

import re
from typing import Any

from ...sources.code import DEFINITIONS, Source, alias_name, call, is_var, keywords, pipeline, sections, show, statements
from ...sources.elixir import Atom, Node, Sigil, Text, Tup, walk
from ...sources.templates import Tag
from .language import _excluded
from .registry import Found, check

#: Functions that take a path.
REQUESTS = ("get", "post", "put", "patch", "delete", "head", "options")
NAVIGATIONS = ("redirect", "push_navigate", "push_patch")
HELPERS = ("_location", "_path", "_url")
SELECTOR = re.compile(r"(?:^|\s)(?:phx-[\w:-]+|data-[\w:-]+|aria-[\w:-]+|id|class)\s*=", re.IGNORECASE)


@check("phoenix.context_function_naming", "design")
@_excluded
def context_function_naming(src: Source, o) -> Found:
    for kind, tree, node in src.type_attributes:
        if kind != "spec":
            continue
        tree = tree.args[0] if isinstance(tree, Node) and tree.name == "when" else tree
        if not (isinstance(tree, Node) and tree.name == "::" and isinstance(tree.args[0], Node) and isinstance(tree.args[0].name, str)):
            continue
        name, options = tree.args[0].name, []
        todo = [tree.args[1]]
        while todo:
            x = todo.pop()
            todo += x.args if isinstance(x, Node) and x.name == "|" else []
            options.append(x)
        tags = {x.items[0].name for x in options if isinstance(x, Tup) and x.items and isinstance(x.items[0], Atom)} | {x.name for x in options if isinstance(x, Atom) and x.name in ("ok", "error")}
        nil = any(isinstance(x, Atom) and x.name == "nil" for x in options)
        tagged = bool(tags & {"ok", "error"})
        if name.startswith("get_") and name.endswith("!") and (tagged or nil):
            yield node, f"{name} should return the value or raise"
        elif name.startswith("get_") and not name.endswith("!") and tagged:
            yield node, f"{name} should return the value or nil; call it fetch_"
        elif name.startswith("fetch_") and not name.endswith("!") and not {"ok", "error"} <= tags:
            yield node, f"{name} should return ok and error tuples"


@check("phoenix.no_repo_in_controller", "design")
def no_repo_in_controller(src: Source, o) -> Found:
    if src.file.endswith("_controller.ex"):
        for c in src.calls:
            if c.last == "Repo":
                yield c.node, "a controller should call a context, not the repository"


@check("phoenix.uri_decode_query", "warning")
def uri_decode_query(src: Source, o) -> Found:
    for x in src.nodes:
        c = call(x)
        if c and c.is_("URI", "decode_query"):
            yield x, "use Plug.Conn.Query.decode"


def _route(path: str) -> re.Pattern:
    return re.compile("/".join(r"[^/]+" if s.startswith(":") else ".+" if s.startswith("*") else re.escape(s) for s in path.split("/")) + r"(?:[?#].*)?$")


@check("phoenix.use_verified_routes", "warning")
def use_verified_routes(src: Source, o) -> Found:
    """``fallback_router_paths``: the routes' paths."""
    routes = [_route(p) for p in o.get("fallback_router_paths", ())]
    web = not src.outside(o.get("web_paths")) and src.outside(o.get("endpoint_paths")) and src.outside(o.get("router_paths"))
    cases = set(o.get("conn_case_modules", ()))
    test = src.file.endswith("_test.exs") and any(c.function == "use" and c.args and alias_name(c.args[0]) in cases for c in src.calls)
    if not routes or not (web or test):
        return

    def routed(x: Any) -> bool:
        text = "".join(p if isinstance(p, str) else "_" for p in x.parts) if isinstance(x, Text) else None
        return text is not None and text.startswith("/") and "{" not in text and any(r.match(text) for r in routes)

    seen = set()

    def report(xs: Any):
        for x in xs:
            if routed(x) and id(x) not in seen:
                seen.add(id(x))
                yield x, 'write the path as a verified route: ~p"..."'

    for c in src.calls:
        if c.function in REQUESTS and c.module in (None, "Phoenix.ConnTest"):
            yield from report(c.args[:2])
        elif c.function in NAVIGATIONS:
            yield from report(keywords(c.args[-1]).values() if c.args else ())
        elif c.function in ("put_resp_header", "get_resp_header") and any(isinstance(a, Text) and a.plain == "location" for a in c.args):
            yield from report(c.args)
        elif c.function == "redirected_to":
            yield from report(c.args)
    for x in src.nodes:
        if isinstance(x, Node) and x.name in ("==", "===", "=~") and any(is_var(a) and (a.name in ("location", "path", "url", "to") or a.name.endswith(HELPERS)) or ((c := call(a)) and c.function == "redirected_to") for a in x.args):
            yield from report(x.args)
    for d in src.definitions:
        if d.name.endswith(HELPERS):
            yield from report([*statements(d.body)[-1:]])


def _live(src: Source) -> bool:
    """Whether a module is a live view or component."""
    for c in src.calls:
        if c.function == "use" and c.args:
            used = alias_name(c.args[0]) or ""
            kinds = [a.name for a in c.args[1:] if isinstance(a, Atom)]
            if used in ("Phoenix.LiveView", "Phoenix.LiveComponent") or {"live_view", "live_component"} & set(kinds):
                return True
    return False


@check("phoenix_live_view.no_inline_assign_in_return_tuple", "readability")
def no_inline_assign_in_return_tuple(src: Source, o) -> Found:
    if not _live(src):
        return
    for x in src.nodes:
        if isinstance(x, Tup) and x.items and isinstance(x.items[0], Atom) and (x.items[0].name, len(x.items)) in (("ok", 2), ("noreply", 2), ("reply", 3), ("ok", 3)):
            value = x.items[2] if x.items[0].name == "reply" else x.items[1]
            if any((c := call(s, k > 0)) and c.function in ("assign", "assign_new") for k, s in enumerate(pipeline(value))):
                yield x, "assign before the return tuple"


@check("phoenix_live_view.require_explicit_connection_state_handling_in_mount", "design")
def require_explicit_connection_state_handling_in_mount(src: Source, o) -> Found:
    if not any(c.function == "use" and c.args and (alias_name(c.args[0]) == "Phoenix.LiveView" or any(isinstance(a, Atom) and a.name == "live_view" for a in c.args[1:])) for c in src.calls):
        return
    for d in src.definitions:
        if d.kind == "def" and d.name == "mount" and len(d.params) == 3:
            names = [show(p.args[-1] if isinstance(p, Node) and p.name == "=" and is_var(p.args[-1]) else p) for p in d.params]
            body, ok = d.body, False
            if isinstance(body, Node) and body.name == "if" and body.args and all(is_var(p) for p in d.params):
                parts, args = sections(body), ",".join(names)
                ok = show(body.args[0]) == f"connected?({names[2]})" and show(parts.get("do")) == f"mount_connected({args})" and show(parts.get("else")) == f"mount_disconnected({args})"
            if not ok:
                yield d.node, "mount/3 should only branch on connected?(socket) into mount_connected and mount_disconnected"


@check("phoenix_live_view.require_function_component_attrs", "warning")
def require_function_component_attrs(src: Source, o) -> Found:
    for _, module in src.modules:
        declared: set[str] = set()
        for x in src.own(module):
            c = call(x)
            if c and c.module is None and c.function in ("attr", "slot") and c.args and isinstance(c.args[0], Atom):
                declared.add(c.args[0].name)
            elif isinstance(x, Node) and x.name in DEFINITIONS:
                head = x.args[0].args[0] if isinstance(x.args[0], Node) and x.args[0].name == "when" else x.args[0]
                body = sections(x).get("do")
                last = statements(body)[-1:] if body is not None else []
                if x.name in ("def", "defp") and isinstance(head, Node) and len(head.args or ()) == 1 and head.name != "render" and last and isinstance(last[0], Sigil) and last[0].name == "H":
                    own = {y.name for y in _assigned(body)}
                    used: dict[str, None] = {}
                    template = next(t for t in src.templates if t.line == last[0].text_line)
                    for t in template.tokens:
                        texts = [a.value for a in t.attrs if a.kind == "expr"] if isinstance(t, Tag) else [t.text] if type(t).__name__ == "Expression" else []
                        used |= dict.fromkeys(m for text in texts for m in re.findall(r"@([a-z_]\w*)", text))
                    for name in used:
                        if name not in declared | own | {"inner_block", "myself", "flash", "socket", "rest"} - ({"inner_block", "rest"} - declared):
                            yield x, f"declare the attribute {name}"
                declared = set()


def _assigned(body: Any) -> list[Atom]:
    out = []
    for y in walk(body):
        c = call(y)
        if c and c.function == "assign":
            out += [a for a in c.args if isinstance(a, Atom)]
            out += [Atom(k) for a in c.args for k in keywords(a)]
            out += [Atom(k) for a in c.args if isinstance(a, Node) and a.name == "%{}" for b in a.args for k in keywords(b)]
    return out


def _tests(f):
    """Only for test files."""

    def run(src: Source, o) -> Found:
        if src.file.endswith("_test.exs") and src.outside(o.get("excluded_paths")):
            yield from f(src, o)

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


@check("testing.no_describe_blocks", "readability")
@_tests
def no_describe_blocks(src: Source, o) -> Found:
    imported, cases = set(), {"ExUnit.Case"}
    for c in src.calls:
        if c.function == "alias" and c.args and (name := alias_name(c.args[0])) in ("ExUnit.Case", "ExUnit"):
            cases.add(alias_name(keywords(c.args[-1]).get("as")) or name.rsplit(".", 1)[-1])
        if c.function == "import" and c.args and alias_name(c.args[0]) not in (None, "ExUnit.Case"):
            only = keywords(c.args[-1]).get("only") if len(c.args) > 1 else None
            imported |= {k for k in keywords(only)} if only is not None else set()
    local = {d.name for d in src.definitions} | imported
    for c in src.calls:
        if c.function == "describe" and c.node.block and ((c.module is None and "describe" not in local) or c.module in cases):
            yield c.node, "write tests without describe"


@check("testing.no_global_state_in_tests", "warning")
@_tests
def no_global_state_in_tests(src: Source, o) -> Found:
    for c in src.calls:
        if c.is_("Application", "put_env", "delete_env", "get_env", "fetch_env", "fetch_env!") or c.is_("System", "put_env", "delete_env", "get_env"):
            yield c.node, "tests must not read or change global state"


@check("testing.no_setup_in_tests", "design")
@_excluded
def no_setup_in_tests(src: Source, o) -> Found:
    for c in src.calls:
        if c.module is None and c.function in ("setup", "setup_all") and c.args and not (isinstance(c.args[0], Atom) and c.args[0].name == "verify_on_exit!"):
            yield c.node, "build what a test needs in the test"


@check("testing.no_tests_in_test_dir", "consistency")
def no_tests_in_test_dir(src: Source, o) -> Found:
    if src.file.startswith("test/") and src.file.endswith("_test.exs"):
        yield (1, 1), "a test belongs beside its module"


@check("testing.prefer_selector_assertions_for_html", "refactor")
@_tests
def prefer_selector_assertions_for_html(src: Source, o) -> Found:
    for c in src.calls:
        if c.function in ("assert", "refute") and c.args and isinstance(c.args[0], Node) and c.args[0].name in ("==", "===", "!=", "!==", "=~"):
            for a in c.args[0].args:
                text = a.plain if isinstance(a, Text) else a.text if isinstance(a, Sigil) and a.name in ("s", "S") else ""
                if any(len(SELECTOR.findall(tag)) >= 2 for tag in re.findall(r"<[A-Za-z][^<>]*", text)):
                    yield c.node, "assert with a selector"
                    break
