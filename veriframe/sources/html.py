"""Elements of rendered HTML as a table, by column expressions alone.

One pattern takes a page apart into comments, elements whose content is text, start tags and end tags, as the HTML
standard's tokenizer does; all checks read the table.  ``snippet`` is the start tag as it stands in the source.
Attributes stay a list: order and repetitions count, a name without value has an empty one, character references of
values are resolved.  Contents of script, style, title, textarea and the like aren't elements, an unclosed comment or
element of that kind reaches to the end, and a tag without its ``>`` is text.  Void elements and implied ends follow
the standard as far as the nesting of elements needs them; an end tag without an open element is passed over.  A page
that is null has no elements, and neither has one whose bytes aren't UTF-8 (``unreadable``).
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the HTML standard: elements without an end tag.
VOID = "area base br col embed hr img input link meta param source track wbr".split()
#: Fixed values of the HTML standard: elements whose content is text.
TEXT_ONLY = "iframe noembed noframes script style textarea title xmp".split()
#: Elements whose open sibling ends where they begin.
SIBLINGS = "dd dt li option p td th tr".split()
#: Tags that are nested at a time; bounds what a step copies.
BLOCK = 512

_NAME = r"[A-Za-z][^\s/>]*+"
_ATTRIBUTE = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+"""
_REST = rf"(?:[\s/]++|{_ATTRIBUTE})*+>"
_TOKEN = (
    r"(?is)<!--(?:-?>|.*?(?:--!?\s*+>|\z))"
    rf"|<({'|'.join(TEXT_ONLY)})(?=[\s/>]){_REST}.*?(?=</\1[\s/>]|\z)"
    rf"|<{_NAME}{_REST}|</{_NAME}[^>]*+>|<[!?/][^>]*+>"
)
_REFERENCE = r"&#(?:[0-9]+|[xX][0-9a-fA-F]+);?|&[A-Za-z][A-Za-z0-9]*+(?:;|(?!=))|[^&]+|&"
#: What a browser takes the numbers 128 to 159 for.
_WINDOWS = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 160))
#: Names and characters of the standard's references, each between marks that are in neither.
_NAMED = "".join(f"\x01{name}\x02{chars}" for name, chars in html5.items()) + "\x01"


def _numbered(ref: Column) -> Column:
    """The character of a numeric reference; the replacement character for what is none."""
    hexa = F.lower(F.substring(ref, 3, 1)) == "x"
    digits = F.regexp_replace(F.regexp_replace(ref, "^&#[xX]?0*", ""), ";$", "")
    short = F.when(F.length(digits) <= 7, digits)
    code = F.when(hexa, F.conv(short, 16, 10)).otherwise(short).try_cast("int")
    known = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    point = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(code.between(128, 159), F.substring(F.lit(_WINDOWS), code - 127, F.lit(1))).when(known, point).otherwise(F.lit("�"))


def _named(ref: Column) -> Column:
    """The characters of a named reference; what has no such name stays as it is."""
    key = F.concat(F.lit("\x01"), F.substring(ref, F.lit(2), F.length(ref)), F.lit("\x02"))
    place = F.call_function("instr", F.lit(_NAMED), key)
    return F.when(place > 0, F.substring_index(F.substring(F.lit(_NAMED), place + F.length(key), F.lit(4)), "\x01", 1)).otherwise(ref)


def resolved(value: Column) -> Column:
    """A value with its character references resolved."""
    part = lambda t: F.when(t.rlike("^&#[0-9xX]"), _numbered(t)).when(t.rlike("^&[A-Za-z]"), _named(t)).otherwise(t)
    return F.when(~F.contains(value, F.lit("&")), value).otherwise(F.array_join(F.transform(F.regexp_extract_all(value, F.lit(_REFERENCE), F.lit(0)), part), ""))


def _attribute(text: Column) -> Column:
    raw = F.regexp_extract(text, r"(?s)^[^\s/>][^\s/>=]*+\s*+=\s*+(.*)$", 1)
    quoted = F.substring(raw, 1, 1).isin('"', "'")
    return F.struct(
        F.lower(F.regexp_extract(text, r"^[^\s/>][^\s/>=]*+", 0)).alias("name"),
        resolved(F.when(quoted, F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)).alias("value"),
    )


def _tag(token: Column) -> Column:
    return F.lower(F.regexp_extract(token, rf"^</?({_NAME})", 1))


def _inside(token: Column) -> Column:
    """A start tag behind its name."""
    return F.regexp_replace(token, rf"^<{_NAME}", "")


def _nested(tags: Column) -> Column:
    """Parent and depth of each start tag among ``tags`` (tag, start, alone), by a stack of open elements; tags are
    taken a block at a time, so that no step copies more than a block, the stack and one reference for each block."""
    open_, place = "array<struct<ordinal:int,tag:string>>", "array<struct<parent:int,depth:int>>"
    state = lambda stack, n, out: F.struct(stack.alias("stack"), n.alias("n"), out.alias("out"))
    none = F.array().cast(place)

    def step(acc: Column, t: Column) -> Column:
        top = F.try_element_at(acc["stack"], F.lit(-1))
        ended = F.when(F.coalesce(top["tag"] == t["tag"], F.lit(False)) & t["tag"].isin(*SIBLINGS), F.slice(acc["stack"], F.lit(1), F.size(acc["stack"]) - 1)).otherwise(acc["stack"])
        here = F.struct(F.try_element_at(ended, F.lit(-1))["ordinal"].alias("parent"), F.size(ended).alias("depth"))
        pushed = F.when(t["alone"], ended).otherwise(F.concat(ended, F.array(F.struct(acc["n"].alias("ordinal"), t["tag"].alias("tag"))).cast(open_)))
        back = F.array_position(F.reverse(F.transform(acc["stack"], lambda o: o["tag"])), t["tag"]).cast("int")
        closed = F.when(back > 0, F.slice(acc["stack"], F.lit(1), F.size(acc["stack"]) - back)).otherwise(acc["stack"])
        started = state(pushed.cast(open_), acc["n"] + 1, F.concat(acc["out"], F.array(here).cast(place)))
        return F.when(t["start"], started).otherwise(state(closed.cast(open_), acc["n"], acc["out"]))

    def block(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, state(acc["stack"], acc["n"], none), step)
        return F.transform(F.array(done), lambda d: state(d["stack"], d["n"], F.concat(acc["out"], d["out"])))[0]

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(tags) - 1) / BLOCK).cast("int")), lambda b: F.slice(tags, b * BLOCK + 1, F.lit(BLOCK)))
    return F.when(F.size(tags) > 0, F.aggregate(blocks, state(F.array().cast(open_), F.lit(0), none), block, lambda acc: acc["out"])).otherwise(none)


def unreadable(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """Pages whose bytes aren't UTF-8: doc_id and their first 160 characters, with dots where there are more."""
    text = F.make_valid_utf8(F.col(f"`{html_column}`").cast("string"))
    bad = pages.where(~F.is_valid_utf8(F.col(f"`{html_column}`").cast("string")))
    return bad.select(F.col(f"`{id_column}`").cast("bigint").alias("doc_id"), F.when(F.length(text) > 160, F.concat(F.substring(text, 1, 160), F.lit("..."))).otherwise(text).alias("snippet"))


def elements(pages: DataFrame, id_column: str = "page_id", html_column: str = "html", nesting: bool = True) -> DataFrame:
    """One row for each element of each page: doc_id, ordinal (in the page, from 0), tag, attrs, snippet and, with
    ``nesting``, parent (ordinal, null at the top) and depth."""
    html = F.col(f"`{html_column}`").cast("string")
    read = pages.select(F.col(f"`{id_column}`").cast("bigint").alias("doc_id"), F.when(F.is_valid_utf8(html), html).alias("html"))
    # the outer form, as for the other one the optimizer asks whether there are tokens first and takes pages apart again
    kept = "^</?[A-Za-z]" if nesting else "^<[A-Za-z]"
    tokens = read.select("doc_id", F.filter(F.regexp_extract_all("html", F.lit(_TOKEN), F.lit(0)), lambda t: t.rlike(kept)).alias("tokens"))
    if nesting:
        alone = lambda t: _tag(t).isin(*VOID) | (F.regexp_replace(_inside(t), _ATTRIBUTE, "").endswith("/>") & ~_tag(t).isin(*TEXT_ONLY))
        start = lambda t: t.rlike("^<[A-Za-z]")
        tags = F.transform("tokens", lambda t: F.struct(_tag(t).alias("tag"), start(t).alias("start"), F.when(start(t), alone(t)).otherwise(False).alias("alone")))
        nested = tokens.select("doc_id", F.filter("tokens", start).alias("starts"), tags.alias("tags")).select("doc_id", "starts", _nested(F.col("tags")).alias("places"))
        found = nested.select("doc_id", F.posexplode_outer(F.arrays_zip("starts", "places")).alias("ordinal", "e")).where("ordinal is not null").select("doc_id", "ordinal", F.col("e.starts").alias("token"), "e.places.parent", "e.places.depth")
    else:
        found = tokens.select("doc_id", F.posexplode_outer("tokens").alias("ordinal", "token")).where("ordinal is not null")
    tag = _tag(F.col("token"))
    snippet = F.when(tag.isin(*TEXT_ONLY), F.regexp_extract("token", rf"^<{_NAME}{_REST}", 0)).otherwise(F.col("token"))
    attrs = F.transform(F.regexp_extract_all(_inside(F.col("snippet")), F.lit(_ATTRIBUTE), F.lit(0)), _attribute)
    named = found.withColumns({"tag": tag, "snippet": snippet})
    return named.select("doc_id", "ordinal", *(["parent", "depth"] if nesting else []), "tag", attrs.alias("attrs"), "snippet")
