"""Checks of templates."""

from __future__ import annotations

import re
from typing import Any

from ...sources import elixir
from ...sources.code import Source, call, is_var
from ...sources.elixir import Atom, Node, walk
from ...sources.templates import Close, Expression, Tag, Template, Words
from .registry import Found, check

#: Utilities that set a margin, and those that set any spacing.
MARGINS = ("m", "mx", "my", "ms", "me", "mt", "mr", "mb", "ml")
SPACINGS = ("m", "mx", "my", "mt", "mr", "mb", "ml", "p", "px", "py", "pt", "pr", "pb", "pl", "gap", "gap-x", "gap-y", "space-x", "space-y")
#: Attributes that handle keys.
KEY_HANDLERS = ("phx-keydown", "phx-keyup", "phx-window-keydown", "phx-window-keyup", "onkeydown", "onkeyup")
NAMES = ("aria-label", "aria-labelledby")
PIXELS = re.compile(r"(?<![\w.-])-?(?:\d+(?:\.\d+)?|\.\d+)px\b", re.IGNORECASE)


def _tags(src: Source, *names: str) -> list[Tag]:
    return [t for template in src.templates for t in template.tags if t.kind == "tag" and (not names or t.name in names)]


def _trees(text: str) -> Any:
    try:
        return elixir.parse(text)[0]
    except (elixir.ParseError, RecursionError, IndexError):
        return []


def _named(tag: Tag) -> bool:
    """Whether it has an accessible name, or may have one."""
    return tag.spread or any((a := tag.get(n)) and (a.kind == "expr" or (a.value or "").strip()) for n in NAMES)


@check("heex.no_duplicate_static_ids", "warning")
def no_duplicate_static_ids(src: Source, o) -> Found:
    for template in src.templates:
        seen = set()
        for tag in template.tags:
            value = tag.static("id") if tag.kind == "tag" else None
            if value is not None and value in seen:
                yield tag.get("id"), f"the id {value} is used twice in one template"
            seen.add(value)


@check("heex.no_element_spacing", "design")
def no_element_spacing(src: Source, o) -> Found:
    for tag in _tags(src):
        for a in tag.attrs:
            if a.name.lower() == "class" and a.kind == "string":
                for m in re.finditer(r"\S+", a.value):
                    utility = m[0].rsplit(":", 1)[-1].removeprefix("!")
                    if utility != "mx-auto" and utility.lstrip("-").split("-")[0] in MARGINS and re.match(r"-?[a-z]+-", utility):
                        yield (a.line, a.column + 7 + m.start()), f"{m[0]}: space elements from their parent"


@check("heex.no_indirect_assign_access", "readability")
def no_indirect_assign_access(src: Source, o) -> Found:
    for template in src.templates:
        for line, column, text in _expressions(template):
            for x in walk(_trees(text)):
                c = call(x)
                direct = c and c.is_("Map", "get") and len(c.args) in (2, 3) and is_var(c.args[0], "assigns") and isinstance(c.args[1], Atom)
                if direct or (isinstance(x, Node) and x.name == "access" and is_var(x.args[0], "assigns") and len(x.args) == 2 and isinstance(x.args[1], Atom)):
                    yield (line, column), "read assigns as @name"


def _expressions(template: Template):
    for t in template.tokens:
        if isinstance(t, Expression):
            yield t.line, t.column, t.text
        elif isinstance(t, Tag):
            yield from ((a.line, a.column, a.value) for a in t.attrs if a.kind == "expr")


@check("heex.no_javascript_href", "warning")
def no_javascript_href(src: Source, o) -> Found:
    for tag in _tags(src, "a"):
        a = next((a for a in tag.attrs if a.name.lower() == "href"), None)
        if a and a.kind == "string" and a.value.lstrip().lower().startswith("javascript:"):
            yield a, "a link must not run javascript:"


@check("heex.prefer_link_for_navigation", "warning")
def prefer_link_for_navigation(src: Source, o) -> Found:
    for template in src.templates:
        for tag in template.tags:
            a = tag.get("phx-click")
            if a and a.kind == "expr" and not (tag.kind == "tag" and tag.name == "a") and not (tag.kind == "local_component" and tag.name == "link"):
                if any((c := call(x)) and c.module in ("JS", "Phoenix.LiveView.JS") and c.function in ("navigate", "patch") and c.args for x in walk(_trees(a.value))):
                    yield a, "navigation should be a link"


@check("heex.prefer_native_interactive_element", "warning")
def prefer_native_interactive_element(src: Source, o) -> Found:
    for tag in _tags(src, "div", "span"):
        if tag.has("phx-click") and not tag.spread and not (tag.has("role") and tag.has("tabindex") and tag.has(*KEY_HANDLERS)):
            yield tag, f"a clickable {tag.name} should be a button or a link"


def _contents(template: Template, opens) -> list[tuple[Tag, list]]:
    """Tags for which ``opens`` is true, with the tokens between them and their end."""
    out, stack = [], []
    for t in template.tokens:
        for _, inner in stack:
            inner.append(t)
        if isinstance(t, Tag) and opens(t):
            entry = (t, [])
            out.append(entry)
            if not t.closing:
                stack.append(entry)
        elif isinstance(t, Close):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0].name == t.name:
                    del stack[k]
                    break
    return out


def _speaks(inner: list, images: bool = False) -> bool:
    """Whether there is text or an expression, or an image with a text of its own."""
    for t in inner:
        if isinstance(t, Expression) or (isinstance(t, Words) and t.text.strip()):
            return True
        if images and isinstance(t, Tag) and t.name == "img" and (a := t.get("alt")) and (a.kind == "expr" or (a.value or "").strip()):
            return True
    return False


@check("heex.require_accessible_button_text", "warning")
def require_accessible_button_text(src: Source, o) -> Found:
    for template in src.templates:
        for tag, inner in _contents(template, lambda t: t.kind == "tag" and t.name == "button"):
            if not _named(tag) and not _speaks(inner):
                yield tag, "a button needs text or an aria-label"


@check("heex.require_link_text", "warning")
def require_link_text(src: Source, o) -> Found:
    for template in src.templates:
        for tag, inner in _contents(template, lambda t: (t.kind == "tag" and t.name == "a" and t.has("href")) or (t.kind == "local_component" and t.name == "link" and t.has("href", "navigate", "patch"))):
            if not _named(tag) and not _speaks(inner, images=True):
                yield tag, "a link needs text or an aria-label"


def _needs(name: str, tag_name: str, attribute: str, what: str) -> None:
    @check(name, "warning")
    def run(src: Source, o) -> Found:
        for tag in _tags(src, tag_name):
            if not tag.has(attribute) and not tag.spread:
                yield tag, what


_needs("heex.require_button_type", "button", "type", "a button needs a type")
_needs("heex.require_image_alt", "img", "alt", "an image needs an alt text, empty if it's decoration")
_needs("heex.require_link_href", "a", "href", "a link needs an href")


@check("heex.require_label_for_input", "warning")
def require_label_for_input(src: Source, o) -> Found:
    for template in src.templates:
        labels = {a.value for t in template.tags if t.name == "label" and (a := t.get("for")) and a.kind == "string"}
        for tag in template.tags:
            if tag.kind != "tag" or tag.name not in ("input", "select", "textarea") or _named(tag):
                continue
            kind, own = tag.get("type"), tag.get("id")
            if tag.name == "input" and kind and (kind.kind == "expr" or (kind.value or "").lower() == "hidden"):
                continue
            if own and (own.kind == "expr" or own.value in labels):
                continue
            yield tag, "a control needs a label or an aria-label"


@check("heex.require_loading_state_for_submit", "warning")
def require_loading_state_for_submit(src: Source, o) -> Found:
    attrs, classes = o.get("loading_attrs", ("phx-disable-with", "disabled")), o.get("loading_class_patterns", ())
    shows = lambda t: t.has(*attrs) or any(p in (t.static("class") or "") for p in classes)
    form = lambda t: t.name == "form" and t.kind in ("tag", "local_component") and t.has("phx-submit") and not t.spread
    control = lambda t: isinstance(t, Tag) and t.kind == "tag" and t.name in ("button", "input") and t.static("type") == "submit" and not t.spread
    for template in src.templates:
        for tag in template.tags:
            if control(tag) and not shows(tag):
                yield tag, "a submit control needs a loading state"
        for tag, inner in _contents(template, form):
            if not shows(tag) and not any(map(control, inner)):
                yield tag, "a form that submits needs a loading state"


@check("heex.require_target_blank_rel", "warning")
def require_target_blank_rel(src: Source, o) -> Found:
    for tag in _tags(src):
        rel = tag.get("rel")
        if (tag.static("target") or "").lower() == "_blank" and not tag.spread and not (rel and rel.kind == "expr"):
            if "noopener" not in (tag.static("rel") or "").lower().split():
                yield tag, 'target="_blank" needs rel="noopener"'


@check("heex.design_system.no_arbitrary_spacing", "design")
def no_arbitrary_spacing(src: Source, o) -> Found:
    utility = re.compile("(?:" + "|".join(sorted(map(re.escape, SPACINGS), key=len, reverse=True)) + r")-\[(.*)\]$", re.IGNORECASE)
    for template in src.templates:
        for a in (a for t in template.tags for a in t.attrs if a.kind == "string"):
            if a.name.lower() == "class":
                for token in a.value.split():
                    m = utility.match(token.rsplit(":", 1)[-1].lstrip("-"))
                    if m and PIXELS.search(m[1]):
                        yield a, f"{token}: use a spacing token"
            elif a.name.lower() == "style":
                for part in a.value.split(";"):
                    name, colon, value = part.partition(":")
                    if colon and re.match(r"(?:margin|padding)(?:$|-)", name.strip().lower()) and PIXELS.search(value):
                        yield a, f"{part.strip()}: use a spacing token"
