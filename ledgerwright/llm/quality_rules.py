"""Quality rules as a short-circuit cascade (native expressions only).

A rule is a boolean expression over measures of the text that rejects. ``plan_rules``
counts what each rule rejects on a sample and times it there, less what a run of the same
sample costs without a rule, and orders the rules by rejection per cost; the order changes
speed, never the verdict. ``cascade`` is one CASE expression in that order, so a rejected
document is not measured for the rules after it. Measures that a caller has computed
already are read, not computed again.

Cases: null and empty texts have no words and fail the base rule; repeated rows are
judged one by one; an empty table keeps the given order of rules; extra columns are
kept. ``measures`` adds ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
``n_repeat_words`` and ``_words``; ``quality_filter`` adds ``kept``; input columns of those
names are replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, few_files

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: Marks that lead list items, line ends that break off, and a sign that is no ASCII mark or digit (fixed values).
BULLETS, BROKEN, LETTER = "[-*\u2022\u25cf\u25aa]", "(?:\\.\\.\\.|\u2026)", r"[^\x21-\x40\x5B-\x60\x7B-\x7E]"
_BASE_WORDS, _BASE_REPEAT = 50, 50


Measure = Callable[[str], Column]
Rule = Callable[[Measure], Column]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, wherever the optimizer moves the expression."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES, -1), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window found at least twice.

    Window hashes are sorted with their positions; a window is repeated if a neighbour
    has its hash. Repeated windows at p < q cover min(3, q - p) new words, the last 3.
    """

    def of(w):
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
        return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(windows, counted))

    def counted(hashes):
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(placed, _covered))

    return let(words, of)


def _covered(s: Column) -> Column:
    twice = F.filter(
        F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"])),
        lambda p: p.isNotNull(),
    )
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("sum"))
    return F.aggregate(F.array_sort(twice), start, lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(3), p - a["last"])).alias("sum")), lambda a: a["sum"] + F.lit(0)).cast("int")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: F.trim(F.translate(x, "\t\n\x0b\x0c\r", "     ")) != "")


def dup_lines(text: Column) -> Column:
    return let(_lines(F.coalesce(text, F.lit(""))), lambda x: F.size(x) - F.size(F.array_distinct(x)))


#: What rules look at, of (text without nulls, its words).
MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda t, w: F.size(w).cast("long"),
    "word_chars": lambda t, w: F.length(F.array_join(w, "")).cast("long"),
    "n_symbols": lambda t, w: F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
    "n_dup_lines": lambda t, w: dup_lines(t).cast("long"),
    "n_repeat_words": lambda t, w: repeat_words(w).cast("long"),
    "n_capitals": lambda t, w: F.regexp_count(t, F.lit("[A-Z]")).cast("long"),
    "n_lines": lambda t, w: F.size(F.split(t, "\n", -1)).cast("long"),
    "n_bullets": lambda t, w: F.regexp_count(t, F.lit(rf"(?:^|\n)[\x20\x09]*{BULLETS}")).cast("long"),
    "n_broken": lambda t, w: F.regexp_count(t, F.lit(rf"{BROKEN}[\x20\x09]*(?:\n|$)")).cast("long"),
    "n_letter_words": lambda t, w: F.size(F.filter(w, lambda x: x.rlike(LETTER))).cast("long"),
}
BASE_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the measures of the base rules as long columns (``_words`` stays until dropped)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.withColumn("_words", words_of(F.col(text_col))).withColumns({k: MEASURES[k](text, F.col("_words")) for k in BASE_MEASURES})


def base_failed() -> Column:
    return (F.col("n_words") < _BASE_WORDS) | (100 * F.col("n_repeat_words") > _BASE_REPEAT * F.col("n_words"))


#: Rules that reject; integer arithmetic, so that SQL gives the same.
DEFAULT_RULES: dict[str, Rule] = {
    "few_words": lambda m: m("n_words") < _BASE_WORDS,
    "word_length": lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 12 * m("n_words")),
    "symbols": lambda m: 10 * m("n_symbols") > 2 * m("n_words"),
    "capitals": lambda m: 10 * m("n_capitals") > 4 * m("word_chars"),
    "dup_lines": lambda m: 10 * m("n_dup_lines") > 6 * m("n_lines"),
    "repeats": lambda m: 100 * m("n_repeat_words") > _BASE_REPEAT * m("n_words"),
    "bullets": lambda m: 10 * m("n_bullets") > 9 * m("n_lines"),
    "broken_lines": lambda m: 10 * m("n_broken") > 3 * m("n_lines"),
    "letters": lambda m: 10 * m("n_letter_words") < 6 * m("n_words"),
}
#: The rules for a corpus that keeps short texts: only texts without words are too short.
CORPUS_RULES: dict[str, Rule] = {"no_words": lambda m: m("n_words") < 1} | {k: v for k, v in DEFAULT_RULES.items() if k != "few_words"}


def _measure(text: Column, words: Column, known: dict[str, Column]) -> Measure:
    return lambda name: known[name] if name in known else MEASURES[name](text, words)


def plan_rules(df: DataFrame, rules: dict[str, Rule] = DEFAULT_RULES, text_col: str = "text", sample: int = 1000, turns: int = 2) -> list[tuple[str, float, float]]:
    """Rules in the order of rejection per cost, as (name, rejected share, seconds).

    The sample is about ``sample`` rows picked by a hash of the text's start and length,
    from some files of a large table (``few_files``). It is written to a table; each rule
    runs over it ``turns`` times over in one job, and the quicker of two jobs, less a job
    without a rule, is its cost. The sample only decides the order.
    """
    some = few_files(df).select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    total = some.count()
    if not total:
        return [(name, 0.0, 0.0) for name in rules]
    place = F.pmod(F.xxhash64(F.left("_text", F.lit(200)), F.length("_text"), F.monotonically_increasing_id()), F.lit(1 << 20))
    with Scratch(df.sparkSession) as tables:
        few = tables.written(some.where(place < max(1, round(min(1.0, sample / total) * (1 << 20)))).withColumn("_words", words_of(F.col("_text"))), "rules-sample")
        often = few.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.lit(turns))))
        m = _measure(F.col("_text"), F.col("_words"), {})
        n = few.count()

        def timed(rule: Column) -> tuple[int, float]:
            best, hit = float("inf"), 0
            for _ in range(2):
                began = time.perf_counter()
                hit = often.select(F.count_if(rule)).first()[0]
                best = min(best, time.perf_counter() - began)
            return hit, best

        _, nothing = timed((F.length("_text") < 0) | (F.size("_words") < 0))
        found = []
        for name, rule in rules.items():
            hit, seconds = timed(rule(m))
            found.append((name, hit / max(1, n * turns), max(seconds - nothing, 1e-3)))
    return sorted(found, key=lambda x: (-x[1] / x[2], x[2], x[0]))


def cascade(rules: dict[str, Rule], order: list[str], text: Column, words: Column | None = None, known: dict[str, Column] | None = None) -> Column:
    """The name of the first rule, in ``order``, that rejects; null for a kept document. ``known``: measures at hand."""

    def first(t, w):
        expr, m = F.when(F.lit(False), F.lit("")), _measure(t, w, known or {})
        for name in order:
            expr = expr.when(rules[name](m), F.lit(name))
        return expr

    text = F.coalesce(text, F.lit(""))
    return first(text, words) if words is not None else let(words_of(text), lambda w: first(text, w))


def quality_filter(df: DataFrame, text_col: str = "text", rules: dict[str, Rule] = DEFAULT_RULES, sample: int = 1000) -> DataFrame:
    """``df`` with ``kept`` boolean by the planned cascade."""
    order = [name for name, _, _ in plan_rules(df, rules, text_col, sample)]
    return df.withColumn("kept", cascade(rules, order, F.col(text_col)).isNull())
