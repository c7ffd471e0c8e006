"""Rule-based quality filter as a short-circuit cascade.

Each rule says which texts to reject. On a sample, the time and the share of rejections of each rule
are estimated; the rules then run in the order of rejections per cost, and a text that one rejects
isn't looked at by the next. The order changes the time and the rule that is named, never the verdict,
so the sample is a small one: about ``SAMPLE_ROWS`` texts of at most ``SAMPLE_CHARS`` characters, chosen at
random from all of the table. A rule's time includes the measures that it needs.

All work is one projection of built-in functions over the table; only the sample is a job of its own.

Defined cases: a null text has no words and so fails; word windows of a text of fewer than three words
don't exist; equal lines count from the second on, blank lines never; repeated rows and other columns
are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kdframe.llm.common import SPACE, let
from kdframe.session import materialize

MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of words
SAMPLE_ROWS, SAMPLE_CHARS = 500, 20_000
SYMBOLS = "[#*$%&|<>]"
BLANKS = " \t\n\x0b\f\r"


def words_of(text: Column) -> Column:
    stripped = F.btrim(text, F.lit(BLANKS))
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, f"[{SPACE}]+"))


def lines_of(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACE}]"))


def matches(text: Column, pattern: str) -> Column:
    """Characters of a text that match a character class."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def repeated_words(words: Column) -> Column:
    """Words in windows of three that occur at least twice."""

    def covered(places: Column) -> Column:
        def add(state: Column, at: Column) -> Column:
            fresh = F.least(F.lit(3), at - state["last"])
            return F.struct(at.alias("last"), (state["n"] + fresh).alias("n"))

        return F.aggregate(places, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), add)["n"]

    def places(ranked: Column) -> Column:
        def twin(x: Column, i: Column) -> Column:
            before, after = F.get(ranked, i - 1)["window"], F.get(ranked, i + 1)["window"]
            return F.coalesce(before == x["window"], F.lit(False)) | F.coalesce(after == x["window"], F.lit(False))

        return F.sort_array(F.transform(F.filter(ranked, twin), lambda x: x["at"]))

    def few(windows: Column, twice: Column) -> Column:
        found = F.transform(windows, lambda x, i: F.when(F.array_contains(twice, x), i))
        return covered(F.filter(found, lambda i: i.isNotNull()))

    def count(windows: Column) -> Column:
        """Few different repeated windows are looked for one by one; many are ranked with their places."""

        def by_number(twice: Column) -> Column:
            ranked = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("window"), i.alias("at"))))
            return F.when(F.size(twice) <= 8, few(windows, twice)).otherwise(let(ranked, lambda r: covered(places(r))))

        def again(ranked: Column) -> Column:
            return F.array_distinct(F.filter(ranked, lambda x, i: F.coalesce(x == F.get(ranked, i - 1), F.lit(False))))

        several = let(let(F.sort_array(windows), again), by_number)
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(several)

    at = F.sequence(F.lit(0), F.size(words) - 3)
    windows = F.transform(at, lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    return F.when(F.size(words) < 3, 0).otherwise(let(windows, count))


def measures(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the measures of the base rules: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.
    The words and lines stay as ``<prefix>words`` and ``<prefix>lines``, the text without nulls as ``<prefix>plain``."""
    plain = docs.withColumn(f"{prefix}plain", F.coalesce(F.col(text_col), F.lit("")))
    text, words, lines = (F.col(f"{prefix}{c}") for c in ("plain", "words", "lines"))
    split = plain.withColumns({f"{prefix}words": words_of(text), f"{prefix}lines": lines_of(text)})
    found = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": matches(text, SYMBOLS),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": repeated_words(words),
    }
    return split.withColumns({f"{prefix}{name}": c.cast("long") for name, c in found.items()})


@dataclass(frozen=True)
class Rule:
    name: str
    #: Whether to reject, from a function that gives the measures and parts of ``measures`` by name.
    rejects: Callable[[Callable[[str], Column]], Column]
    base: bool = False


# the order here only breaks ties
RULES = [
    Rule("few words", lambda c: c("n_words") < MIN_WORDS, base=True),
    Rule("repeated words", lambda c: 100 * c("n_repeat_words") > MAX_REPEATED * c("n_words"), base=True),
    Rule("symbols", lambda c: 4 * c("n_symbols") > c("n_words")),
    Rule("repeated lines", lambda c: 100 * c("n_dup_lines") > 50 * F.size(c("lines"))),
    Rule("word length", lambda c: ~c("word_chars").between(2 * c("n_words"), 15 * c("n_words"))),
    Rule("few letters", lambda c: 2 * matches(c("plain"), r"\p{L}+") < c("word_chars")),
    Rule("exclamations", lambda c: 10 * matches(c("plain"), "!+") > 5 * c("n_words")),
    Rule("bullets", lambda c: 10 * F.size(F.filter(c("lines"), lambda x: x.rlike("^[ \t]*[-*•]"))) > 9 * F.size(c("lines"))),
    Rule("ellipses", lambda c: 10 * F.size(F.filter(c("lines"), lambda x: x.rlike("(…|\\.\\.\\.)[ \t\r]*$"))) > 3 * F.size(c("lines"))),
]


def ordered(docs: DataFrame, rules: list[Rule], text_col: str = "text", prefix: str = "") -> list[Rule]:
    """Rules by rejections per cost on a sample of texts, the best first."""
    share = min(1.0, SAMPLE_ROWS / max(1, docs.count()))
    short = docs.select(text_col).where(F.length(text_col) <= SAMPLE_CHARS).sample(share, seed=0)
    small = docs.sparkSession.createDataFrame(short.limit(2 * SAMPLE_ROWS).collect(), short.schema)
    # only the texts are stored: each run makes the measures that its rule reads, and no others
    sample = measures(materialize(small), text_col, prefix)

    def run(condition: Column) -> tuple[float, int]:
        spent = []
        for _ in range(2):  # the first also compiles
            began = time.perf_counter()
            hits = sample.agg(F.count_if(condition)).first()[0]
            spent.append(time.perf_counter() - began)
        return min(spent), hits

    floor = run(F.lit(False))[0]
    rated = []
    for rule in rules:
        spent, hits = run(rule.rejects(lambda name: F.col(f"{prefix}{name}")))
        rated.append((-hits / max(spent - floor, 1e-3), rule))
    return [rule for _, rule in sorted(rated, key=lambda x: x[0])]


def cascade(measured: DataFrame, rules: list[Rule], *, prefix: str = "", into: str = "failed_rule") -> DataFrame:
    """``measured`` with the first of the rules that rejects the text, null if none does."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.rejects(lambda name: F.col(f"{prefix}{name}")), F.lit(rule.name)).otherwise(verdict)
    return measured.withColumn(into, verdict)


def apply_rules(docs: DataFrame, *, text_col: str = "text", rules: list[Rule] = RULES, prefix: str = "_q_") -> DataFrame:
    """``docs`` with the measures, ``base_failed``, ``failed_rule`` and ``kept``."""
    measured = measures(docs, text_col, prefix)
    judged = cascade(measured, ordered(docs, rules, text_col, prefix), prefix=prefix, into=f"{prefix}failed")
    base = F.lit(False)
    for rule in rules:
        if rule.base:
            base = base | rule.rejects(lambda name: F.col(f"{prefix}{name}"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.withColumns(
        {name: F.col(f"{prefix}{name}") for name in names}
        | {"base_failed": base, "failed_rule": F.col(f"{prefix}failed"), "kept": F.col(f"{prefix}failed").isNull()}
    ).drop(*(f"{prefix}{c}" for c in [*names, "plain", "words", "lines", "failed"]))
