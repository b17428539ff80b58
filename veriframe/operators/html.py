"""Checks of rendered HTML over the table of elements."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.contract import CheckSpec, as_issues, normalize, run
from ..plans.store import stored
from ..sources.html import elements, unreadable

#: Hrefs that lead nowhere.
EMPTY_HREFS = ("", "#", "javascript:void(0)", "javascript:void(0);")
#: Types of a button.
BUTTON_TYPES = ("button", "submit", "reset")
#: Types of an input that takes no typed or remembered value.
NO_AUTOCOMPLETE = ("button", "checkbox", "file", "hidden", "image", "radio", "reset", "submit")
#: Commands that lead to another page.
NAVIGATION = ("navigate", "patch")


def _where_named(name: str, value: Column) -> Column:
    """``value`` where the start tag holds the name at all, else null: attributes aren't worked out for other elements,
    as what only one arm of a CASE needs isn't worked out ahead of it."""
    return F.when(F.contains(F.lower("snippet"), F.lit(name)), value)


def attribute(name: str) -> Column:
    """The first value of an attribute; null without it."""
    return _where_named(name, F.get(F.filter("attrs", lambda a: a["name"] == name), F.lit(0))["value"])


def has(name: str) -> Column:
    return F.coalesce(_where_named(name, F.exists("attrs", lambda a: a["name"] == name)), F.lit(False))


def trimmed(c: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(F.regexp_replace(c, "^[\\s\\p{Z}\\x85]+", ""), "[\\s\\p{Z}\\x85]+$", "")


def _issues(found: DataFrame, message: Column, seq: Column | None = None) -> DataFrame:
    return found.select(
        F.col("doc_id").cast("string").alias("subject"), F.col("doc_id").alias("subject_order"), (F.col("ordinal") if seq is None else seq).cast("int").alias("seq"),
        F.lit("html").alias("category"), message.alias("message"), "tag", "snippet",
    )


def _said(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def no_duplicate_attributes(e: DataFrame, options: Mapping[str, Any]) -> DataFrame:
    """An attribute name that an element has twice; one issue for each name, names in order."""
    names = F.transform("attrs", lambda a: a["name"])
    twice = F.array_sort(F.array_distinct(F.filter(names, lambda n: F.size(F.filter(names, lambda m: m == n)) > 1)))
    found = e.where(F.size("attrs") > F.size(F.array_distinct(names))).select("*", F.posexplode(twice).alias("k", "name"))
    return _issues(found, _said("<", F.col("tag"), "> has the attribute ", F.col("name"), " more than once"))


def no_inline_style(e: DataFrame, options: Mapping[str, Any]) -> DataFrame:
    return _issues(e.where(has("style")), _said("<", F.col("tag"), "> has an inline style"))


def prefer_button_for_action(e: DataFrame, options: Mapping[str, Any]) -> DataFrame:
    href = F.lower(trimmed(attribute("href")))
    return _issues(e.where((F.col("tag") == "a") & has("phx-click") & href.isin(*EMPTY_HREFS)), F.lit("a link that only acts should be a <button>"))


def prefer_link_for_navigation(e: DataFrame, options: Mapping[str, Any]) -> DataFrame:
    """The first navigation command among the JSON list of commands in phx-click; what is no JSON list is ignored."""
    click = attribute("phx-click")
    commands = _where_named("phx-click", F.from_json(F.when(F.try_parse_json(click).isNotNull(), click), "array<string>"))
    first = F.filter(F.transform(commands, lambda c: F.get(F.from_json(c, "array<string>"), F.lit(0))), lambda op: op.isin(*NAVIGATION))
    found = e.where((F.col("tag") != "a") & has("phx-click")).withColumn("op", F.get(first, F.lit(0))).where("op is not null")
    return _issues(found, _said("navigation should be an <a>; phx-click does ", F.col("op"), " on <", F.col("tag"), ">"))


def require_button_type(e: DataFrame, options: Mapping[str, Any]) -> DataFrame:
    known = F.coalesce(F.lower(trimmed(attribute("type"))).isin(*BUTTON_TYPES), F.lit(False))
    return _issues(e.where((F.col("tag") == "button") & ~known), F.lit("<button> needs a type: button, submit or reset"))


def require_image_alt(e: DataFrame, options: Mapping[str, Any]) -> DataFrame:
    return _issues(e.where((F.col("tag") == "img") & ~has("alt")), F.lit("<img> needs an alt attribute"))


def require_input_autocomplete(e: DataFrame, options: Mapping[str, Any]) -> DataFrame:
    kind = F.lower(trimmed(F.coalesce(attribute("type"), F.lit("text"))))
    blank = trimmed(F.coalesce(attribute("autocomplete"), F.lit(""))) == ""
    return _issues(e.where((F.col("tag") == "input") & ~kind.isin(*NO_AUTOCOMPLETE) & blank), F.lit("<input> needs an autocomplete attribute"))


def require_link_href(e: DataFrame, options: Mapping[str, Any]) -> DataFrame:
    return _issues(e.where((F.col("tag") == "a") & ~has("href")), F.lit("<a> needs an href attribute"))


CHECKS = {
    f.__name__: f
    for f in (no_duplicate_attributes, no_inline_style, prefer_button_for_action, prefer_link_for_navigation, require_button_type, require_image_alt, require_input_autocomplete, require_link_href)
}


def validate(pages: DataFrame, specs: Iterable[str | tuple | CheckSpec], id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """Issues of all pages; without specs nothing is read.  For several checks the elements are read once and stored.
    A page that can't be read gives one issue, of the check ``html`` and before all others, with its beginning."""
    specs = normalize(specs, CHECKS)
    if not specs:
        return run("html", None, specs, CHECKS, pages.sparkSession)
    found = elements(pages, id_column, html_column, nesting=False)
    if sum(s.options.get("validate", True) is not False for s in specs) > 1:
        found = stored(found)
    bad = unreadable(pages, id_column, html_column).withColumns({"ordinal": F.lit(-1), "tag": F.lit(None).cast("string")})
    unread = as_issues(_issues(bad, F.lit("the page can't be read: it isn't UTF-8")), "html", "html", -1)
    return unread.unionByName(run("html", found, specs, CHECKS, pages.sparkSession))


def summary(issues: DataFrame) -> DataFrame:
    """Issues by page and check, and the page's rank by issues."""
    n = issues.groupBy("subject", "check").agg(F.count("*").alias("n"))
    return n.withColumn("of_page", F.sum("n").over(Window.partitionBy("subject")))
