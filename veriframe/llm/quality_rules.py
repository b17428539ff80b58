"""Quality rules as a short-circuit cascade, with DataFrame functions only.

Every rule is a column over a few measures of the text.  ``plan`` takes a sample of the rows by hash and times, several
times over, what each rule works out of the text by itself; that is its cost.  Its share of rejected rows is its
selectivity, and the rules are ordered by rejection per cost.  They are evaluated in that order inside one CASE, so a
row leaves at the first rule that rejects it.  What only one rule needs is written inside the CASE and isn't worked out
for rows that leave before; in ``apply``, whose result has the measures, that's the letters of the last two rules, in
``keep_good`` it's all but the words and their repeats.  The verdict doesn't depend on the order, only the work does.

Defined cases: null text is a text without words (rejected, all counts 0); an empty table gives an empty result; each
row is judged on its own, so repeated rows give repeated results; columns of the input named like a result column are
replaced in ``apply``'s output by the result, all others are kept; texts of any length are taken whole.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: Fixed value: white space between words, as a Java character class.
SPACE = "[\\x20\\x09-\\x0D]+"
#: From a word's beginning to its first letter; matches begin at words only, so a long word isn't read again and again.
LETTERED = "(?<![^\\x20\\x09-\\x0D])[^\\x20\\x09-\\x0D\\p{L}]*+\\p{L}"
#: Fixed value: characters that count as symbols.
SYMBOLS = "#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``fails`` makes the column that is true for a text to reject, from ``text`` and columns of the measures."""

    name: str
    fails: Callable[[Mapping[str, Column]], Column]


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules.  Defaults keep ordinary prose of any of the languages."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbols_per_100_words: int = 10
    min_mean_word: float = 2.0
    max_mean_word: float = 12.0
    max_dup_line_percent: int = 40
    min_alpha_words_percent: int = 70
    max_upper_percent: int = 40
    #: Rows on which costs and selectivities are estimated, about; planning only, results don't depend on it.
    sample_rows: int = 1000
    #: How often a rule's cost is measured; the least counts.
    repeats: int = 3

    def rules(self) -> list[Rule]:
        text = F.coalesce(F.col("text"), F.lit(""))
        letters = F.regexp_count(text, F.lit("\\p{L}"))
        return [
            Rule("symbols", lambda m: 100 * m["n_symbols"] > self.max_symbols_per_100_words * m["n_words"]),
            Rule("mean_word", lambda m: (m["word_chars"] < self.min_mean_word * m["n_words"]) | (m["word_chars"] > self.max_mean_word * m["n_words"])),
            Rule("dup_lines", lambda m: _let(_lines(), lambda x: 100 * _dup_lines(x) > self.max_dup_line_percent * F.size(x)) if m["n_dup_lines"] is None else 100 * m["n_dup_lines"] > self.max_dup_line_percent * m["n_lines"]),
            Rule("alpha_words", lambda m: 100 * F.regexp_count(text, F.lit(LETTERED)) < self.min_alpha_words_percent * m["n_words"]),
            Rule("upper_case", lambda m: 100 * F.regexp_count(text, F.lit("\\p{Lu}")) > self.max_upper_percent * letters),
        ]

    def base_failed(self) -> Column:
        n = F.col("n_words")
        return (n < self.min_words) | (100 * F.col("n_repeat_words") > self.max_repeat_percent * n)


def _let(value: Column, body) -> Column:
    """Evaluates ``value`` once for all its uses in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(hashes: Column, windows: int = 3) -> Column:
    """How many words lie in windows that occur twice or more; ``hashes``: of the window at each word.

    Sorted (hash, place) pairs put equal windows side by side; the places of those with an equal neighbour, in order,
    cover as many words as the gaps between them allow.
    """
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(p: Column) -> Column:
        last = F.size(p) - 1
        return F.array_sort(
            F.transform(
                F.filter(
                    F.transform(p, lambda x, k: F.struct(x["i"].alias("i"), (((k > 0) & (F.get(p, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(p, k + 1)["h"] == x["h"]))).alias("twice"))),
                    lambda x: x["twice"],
                ),
                lambda x: x["i"],
            )
        )

    def cover(places: Column) -> Column:
        gaps = F.transform(places, lambda x, k: F.least(F.coalesce(F.get(places, k + 1) - x, F.lit(windows)), F.lit(windows)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g.cast("long"))

    return _let(_let(pairs, repeated), cover)


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _lines() -> Column:
    """Lines with a word."""
    return F.filter(F.split(_text(), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))


def _dup_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def _word_chars() -> Column:
    return F.length(F.regexp_replace(_text(), SPACE, "")).cast("long")


def _symbols() -> Column:
    return (F.length(_text()) - F.length(F.translate(_text(), SYMBOLS, ""))).cast("long")


def _work_out(docs: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are worked out once, here: the optimizer moves no expression through the generator, so it
    doesn't copy them to where they are used."""
    return docs.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _word_measures(docs: DataFrame) -> DataFrame:
    """Adds n_words and n_repeat_words, which all rules of a row build on."""
    words_name, windows_name = free_name(docs, "_words"), free_name(docs, "_windows")
    out = _work_out(docs, **{words_name: F.array_remove(F.split(_text(), SPACE), "")})
    words = F.col(words_name)
    windows = F.when(
        F.size(words) >= 3,
        F.transform(F.slice(words, F.lit(1), F.size(words) - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))
    out = _work_out(out, n_words=F.size(words).cast("long"), **{windows_name: windows}).drop(words_name)
    windows = F.col(windows_name)
    repeats = F.when(F.size(windows) == F.size(F.array_distinct(windows)), F.lit(0).cast("long")).otherwise(_covered(windows))
    return _work_out(out, n_repeat_words=repeats).drop(windows_name)


def measures(docs: DataFrame) -> DataFrame:
    """Adds the measures to ``docs`` (needs ``text``); ``n_lines`` counts the lines with a word."""
    out = _word_measures(docs.drop("n_lines", *MEASURES))
    lines_name = free_name(out, "_lines")
    out = _work_out(out, **{lines_name: _lines()})
    lines = F.col(lines_name)
    out = _work_out(out, word_chars=_word_chars(), n_symbols=_symbols(), n_lines=F.size(lines).cast("long"), n_dup_lines=_dup_lines(lines))
    return out.drop(lines_name)


def _private() -> dict[str, Column | None]:
    """Measures as expressions of the text, for rules that work out by themselves what they alone need."""
    return {"n_words": F.col("n_words"), "word_chars": _word_chars(), "n_symbols": _symbols(), "n_dup_lines": None, "n_lines": None}


def plan(docs: DataFrame, rules: QualityRules) -> list[Rule]:
    """The rules, those first that reject most for their time on a sample of ``docs``."""
    n = docs.count()
    if not n:
        return rules.rules()
    one_in = max(1, n // rules.sample_rows)
    few = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(one_in)) == 0)
    # copies of one text have one hash: a bound on the rows, which may all be its copies
    few = _word_measures(few.limit(4 * rules.sample_rows)).coalesce(1).cache()
    n = few.count()
    if not n:
        few.unpersist()
        return rules.rules()

    def rejected(fails: Column) -> tuple[float, int]:
        times, found = [], 0
        for _ in range(rules.repeats):
            began = time.perf_counter()
            found = few.agg(F.count_if(F.coalesce(fails, F.lit(False))).alias("n")).first().n
            times.append(time.perf_counter() - began)
        return min(times), found

    idle, _ = rejected(F.col("n_words") < 0)  # what a job takes that works nothing out
    scored = []
    for k, rule in enumerate(rules.rules()):
        seconds, found = rejected(rule.fails(_private()))
        scored.append((-(found / n) / max(seconds - idle, 1e-3), k, rule))
    few.unpersist()
    return [rule for _, _, rule in sorted(scored, key=lambda x: x[:2])]


def _verdict(order: list[Rule], m: Mapping[str, Column | None]) -> Column:
    verdict = F.when(F.col("base_failed"), F.lit("base"))
    for rule in order:
        verdict = verdict.when(F.coalesce(rule.fails(m), F.lit(False)), F.lit(rule.name))
    return verdict


def apply(docs: DataFrame, rules: QualityRules | None = None, order: list[Rule] | None = None) -> DataFrame:
    """``docs`` with the measures, ``base_failed``, ``rejected_by`` (null if kept) and ``kept``."""
    rules = rules or QualityRules()
    order = plan(docs, rules) if order is None else order
    out = measures(docs.drop("base_failed", "rejected_by", "kept")).withColumn("base_failed", rules.base_failed())
    out = _work_out(out, rejected_by=_verdict(order, {name: F.col(name) for name in (*MEASURES, "n_lines")}))
    return out.withColumn("kept", F.col("rejected_by").isNull())


def keep_good(docs: DataFrame, rules: QualityRules | None = None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns."""
    rules = rules or QualityRules()
    order = plan(docs, rules)
    out = _word_measures(docs.select(F.struct("*").alias("_row"), "text")).withColumn("base_failed", rules.base_failed())
    return _work_out(out, rejected_by=_verdict(order, _private())).where("rejected_by IS NULL").select("_row.*")
