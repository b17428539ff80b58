"""Elements of pages against the standard library's parser, and what only a browser's rules settle."""

import random

from pyspark.sql import functions as F

from veriframe.operators import html
from veriframe.plans.queries import marked_pages
from veriframe.sources.html import elements

from .plain_html import parse


def pages_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "page_id long, html string")


def rows(pages):
    found = {}
    for r in elements(pages).collect():
        found.setdefault(r.doc_id, []).append((r.ordinal, r.parent, r.depth, r.tag, [a.asDict() for a in r.attrs], r.snippet))
    return {k: sorted(v, key=lambda r: r[0]) for k, v in found.items()}


def same(pages):
    found = rows(pages)
    for r in pages.collect():
        assert found.get(r.page_id, []) == parse(r.html), r.html


def any_page(rng):
    """Nested and badly nested tags, attributes of all forms, comments, scripts."""
    value = lambda: rng.choice(["", "x", "a b", "1 > 2", "<i>", "&lt;&amp;&#65;&#x1F600;", "it's", "é ß", "/x/", "&nosuch;"])
    out = []
    for _ in range(rng.randrange(40)):
        kind, tag = rng.randrange(10), rng.choice(["p", "li", "ul", "DIV", "a", "td", "tr", "img", "br", "x-y"])
        if kind < 5:
            attrs = ""
            for _ in range(rng.randrange(4)):
                name, v = rng.choice(["class", "ID", "data-x", "@on", "phx-click"]), value()
                attrs += rng.choice([" ", "\n ", "  "]) + rng.choice([name, f'{name}="{v}"', name + " = '" + v.replace("'", "") + "'", f"{name}={v.split(' ')[0].replace('<', '') or 'v'}"])
            out.append(f"<{tag}{attrs}{rng.choice(['', '', ' ', ' /'])}>")
        elif kind < 8:
            out.append(f"</{tag}{rng.choice(['', ' '])}>")
        else:
            out.append(rng.choice(["text & more", "a < b", "<!-- <p class=c> -->", '<script>if (a<b) "<p>" </script>', "<style>p>a{}</style>", "<!doctype html>", "<!x>", "日本"]))
    return "".join(out)


def test_against_plain(spark):
    rng = random.Random(5)
    same(pages_of(spark, [any_page(rng) for _ in range(400)]))


def test_whole_tables(spark):
    same(marked_pages(spark, "/root/testdata/sf0.001"))


def test_elements(spark):
    found = rows(pages_of(spark, ['<ul><li>a<li CLASS="x" class=y>b</ul><br><script>"<a>"</script><p/><img src=1>', None, "", "text <", "<p"]))
    assert [r[:4] for r in found[0]] == [(0, None, 0, "ul"), (1, 0, 1, "li"), (2, 0, 1, "li"), (3, None, 0, "br"), (4, None, 0, "script"), (5, None, 0, "p"), (6, None, 0, "img")]
    assert found[0][2][4] == [{"name": "class", "value": "x"}, {"name": "class", "value": "y"}]
    assert list(found) == [0]


def test_as_a_browser(spark):
    """Content of titles and of unclosed comments is no element; references without a semicolon before letters stay."""
    found = rows(pages_of(spark, ["<title><a></title><textarea><b></textarea>", "<img><!-- <a>", "<img><script><a>", '<a b="&ampx &amp &#0; &#xD800; &#128; &notit;">', "<!--><i>"]))
    assert [[r[3] for r in found[k]] for k in range(5)] == [["title", "textarea"], ["img"], ["img", "script"], ["a"], ["i"]]
    assert found[3][0][4] == [{"name": "b", "value": "&ampx & � � € &notit;"}]


def test_very_long(spark):
    """Many elements, many open ones, one very long attribute; nothing recurses on them."""
    texts = ["<p><b>x</b><br></p>" * 20000, "<i>" * 2000, '<a href="' + "x" * 2_000_000 + '">', "<a " + "b " * 50000 + ">", "<script>" + "<" * 500_000, "<" * 200_000]
    found = rows(pages_of(spark, texts))
    assert [len(found.get(k, [])) for k in range(6)] == [60000, 2000, 1, 1, 1, 0]
    assert found[0] == parse(texts[0]) and found[1] == parse(texts[1]) and len(found[3][0][4]) == 50000


def test_without_specs(spark):
    pages = pages_of(spark, ["<img>", None])
    assert html.validate(pages, []).count() == 0
    found = html.validate(pages, ["require_image_alt", "no_inline_style"]).collect()
    assert [(r.subject, r.check, r.snippet) for r in found] == [("0", "require_image_alt", "<img>")]


def test_unreadable(spark):
    """A page that isn't UTF-8 gives one issue with its first 160 characters, and none of its elements."""
    long = "ff" + "<img>".encode().hex() * 40
    pages = spark.createDataFrame([(1, "ff3c696d673e"), (2, "<img>".encode().hex()), (3, long), (4, None)], "page_id long, h string").select("page_id", F.expr("unhex(h)").alias("html"))
    found = {(r.subject, r.check): r for r in html.validate(pages, ["require_image_alt", "no_inline_style"]).collect()}
    assert set(found) == {("1", "html"), ("2", "require_image_alt"), ("3", "html")}
    assert found["1", "html"].snippet == "�<img>" and found["3", "html"].snippet == ("�" + "<img>" * 40)[:160] + "..."
    assert html.validate(pages, []).count() == 0


def test_plan(spark):
    """No Python worker, and no shuffle, for one check."""
    plan = html.validate(marked_pages(spark, "/root/testdata/sf0.001"), ["require_image_alt"])._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in ("Python", "MapIn", "ArrowEval", "Exchange"))
