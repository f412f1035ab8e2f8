"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a test that a good text passes, over metrics of the text.  On a sample every rule's
cost (time a row to compute its metrics) and selectivity (share of texts it rejects) are
estimated; the rules are then asked in the order of rejection per cost, and a rule's metrics
are only computed for texts that all before it let pass.  The order changes the work, never
the verdict.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bounded, free_name

#: Rows (about) on which costs and selectivities are estimated.
SAMPLE_ROWS = 500
#: Passes over the sample that tell a rule's cost from that of a job.
REPEATS = 20
#: Words in a window for repeated words.
WINDOW = 5

_SPACE = "[ \\x09-\\x0D]+"


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Words: runs of anything but ASCII white space."""
    return F.filter(F.split(_text(text), _SPACE), lambda w: w != "")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(_text(text), F.lit("[#*$%&|<>]")).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    full = F.filter(F.split(_text(text), "\n"), lambda x: x.rlike("[^ \\x09-\\x0D]"))
    return (F.size(full) - F.size(F.array_distinct(full))).cast("long")


def word_chars(words: Column) -> Column:
    return F.char_length(F.array_join(words, "")).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: inside a lambda it is a variable, which the
    optimiser can't write out again at each place of use, as it may do with a column."""
    return F.get(F.transform(F.array(value), body), 0)


def n_repeat_words(words: Column) -> Column:
    """Words inside windows of five words that the text has twice or more.

    Windows are compared by hash inside their row: sorted with their places, a repeated one has
    an equal neighbour; the places of those, in order, each cover what lies before the next.
    """
    count = F.size(words) - (WINDOW - 1)
    hashes = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    none = F.lit(0).cast("long")

    def same(p: Column, x: Column, k: Column) -> Column:
        return F.coalesce(x["h"] == F.get(p, k)["h"], F.lit(False))

    def places(p: Column) -> Column:
        return F.sort_array(F.transform(F.filter(p, lambda x, k: same(p, x, k - 1) | same(p, x, k + 1)), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        step = F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(step, none, lambda a, x: a + x)

    def repeated(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        found = let(pairs, lambda p: let(places(p), covered))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), found).otherwise(none)

    return F.when(count > 1, let(hashes, repeated)).otherwise(none)


@dataclass(frozen=True)
class Rule:
    """``metrics`` it needs (names of METRICS) and what a good text satisfies."""

    name: str
    metrics: tuple[str, ...]
    passes: Callable[[dict[str, Column]], Column]


METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")
#: Metrics that ``judge`` gives for every row.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_BY_WORDS = {"n_words": lambda w: F.size(w).cast("long"), "word_chars": word_chars, "n_repeat_words": n_repeat_words}
_BY_TEXT = {
    "n_symbols": n_symbols, "n_dup_lines": n_dup_lines,
    "n_lines": lambda c: F.regexp_count(_text(c), F.lit("\n")).cast("long") + 1,
}


def single(text: Column, metric: str) -> Column:
    """One metric of a text as one expression."""
    return let(words(text), _BY_WORDS[metric]) if metric in _BY_WORDS else _BY_TEXT[metric](text)


def measured(df: DataFrame, text: str, metrics: tuple[str, ...], prefix: str = "") -> DataFrame:
    """``df`` with the metrics as columns ``prefix + name``; the text is cut into words once."""
    t = F.col(text)
    asked = [m for m in _BY_WORDS if m in metrics]
    made = {f"{prefix}{m}": _BY_TEXT[m](t) for m in _BY_TEXT if m in metrics}
    if not asked:
        return df.withColumns(made)
    hold = free_name(df, "word_metrics")
    one = let(words(t), lambda w: F.struct(*[_BY_WORDS[m](w).alias(m) for m in asked]))
    df = df.withColumns({**made, hold: one})
    return df.withColumns({f"{prefix}{m}": F.col(hold)[m] for m in asked}).drop(hold)


# thresholds follow published rules for web text; one or two repeated lines are no pattern
RULES = (
    Rule("words", ("n_words",), lambda m: m["n_words"] >= 10),
    Rule("repeats", ("n_words", "n_repeat_words"), lambda m: 100 * m["n_repeat_words"] <= 20 * m["n_words"]),
    Rule("word_length", ("n_words", "word_chars"), lambda m: m["word_chars"].between(2 * m["n_words"], 15 * m["n_words"])),
    Rule("symbols", ("n_words", "n_symbols"), lambda m: 10 * m["n_symbols"] <= m["n_words"]),
    Rule("dup_lines", ("n_lines", "n_dup_lines"), lambda m: (m["n_dup_lines"] <= 2) | (10 * m["n_dup_lines"] <= 3 * m["n_lines"])),
)


@dataclass(frozen=True)
class Estimate:
    """``cost`` in nanoseconds a row, rounded to a power of two: times of two runs differ."""

    rule: Rule
    cost: float
    rejects: float

    @property
    def worth(self) -> float:
        return self.rejects / max(self.cost, 1e-9)


def plan(
    documents: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, known: tuple[str, ...] = ()
) -> list[Estimate]:
    """The rules by rejection per cost, the most first.

    The sample is about ``SAMPLE_ROWS`` rows chosen by a hash of the text.  A rule's cost is
    how much longer ``REPEATS`` passes over the sample take than one, so what a job costs
    whatever it does is not counted; metrics that are ``known`` cost nothing.  On an empty
    table every rule rejects nothing.  Ties keep the order given, and costs are close to each
    other below a factor of two.
    """
    sample = bounded(documents.select(F.col(text).alias("text")), F.col("text"), SAMPLE_ROWS).persist()
    try:
        rows = sample.count()
        tests = {r.name: r.passes({m: F.col(m) for m in r.metrics}) for r in rules}
        rejects = measured(sample, "text", METRICS).agg(
            *(F.coalesce(F.sum(F.when(t, 0).otherwise(1)), F.lit(0)).alias(n) for n, t in tests.items())
        ).head()
        found = []
        for rule in rules:
            own = tuple(m for m in rule.metrics if m not in known)
            found.append(Estimate(rule, _rounded(_cost(sample, own, rows)), rejects[rule.name] / max(rows, 1)))
    finally:
        sample.unpersist()
    return sorted(found, key=lambda e: -e.worth)


def _cost(sample: DataFrame, metrics: tuple[str, ...], rows: int) -> float:
    """Nanoseconds a row that the metrics take."""
    if not metrics or not rows:
        return 1.0

    def seconds(times: int) -> float:
        again = sample.withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(times)))).select("text")
        one = measured(again, "text", metrics).agg(*(F.max(m) for m in metrics))
        began = time.perf_counter()
        one.collect()
        return time.perf_counter() - began

    seconds(1)  # compiles
    once, often = (min(seconds(t) for _ in range(2)) for t in (1, REPEATS))
    return max(1.0, (often - once) / (REPEATS - 1) / rows * 1e9)


def _rounded(cost: float) -> float:
    return 2.0 ** round(math.log2(cost))


def verdict(order: list[Estimate], metric: Callable[[str], Column]) -> tuple[Column, Column]:
    """``kept`` and the name of the first rule that rejects, asked in order: a later rule is
    evaluated, and what ``metric`` gives for it computed, only where all before it pass."""
    first = F.lit(None).cast("string")
    for e in reversed(order):
        passed = e.rule.passes({m: metric(m) for m in e.rule.metrics})
        first = F.when(passed, first).otherwise(F.lit(e.rule.name))
    return first.isNull(), first


def judge(
    documents: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, base: tuple[str, ...] = BASE
) -> DataFrame:
    """``documents`` with the metrics of ``base``, ``kept`` and ``rejected_by``.

    The metrics of ``base`` are columns of the result, so each is computed for every row and
    costs the rules nothing more; all other metrics are computed inside the cascade, where the
    rules before let a row pass.

    Null and empty texts have no words and one line, and are rejected by the first rule that
    minds.  Columns named like the results are replaced.
    """
    order = plan(documents, text, rules, base)
    own = [*base, "kept", "rejected_by"]
    hold = free_name(documents, "judged_text")
    df = documents.withColumn(hold, F.col(text)).drop(*[c for c in documents.columns if c in own])
    df = measured(df, hold, base)
    kept, rejected = verdict(order, lambda m: F.col(m) if m in base else single(F.col(hold), m))
    df = df.withColumns({"kept": kept, "rejected_by": rejected})
    return df.withColumn(text, F.col(hold)).drop(hold) if text in own else df.drop(hold)


def cascade(documents: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``documents`` that every rule lets pass, nothing computed that the verdict
    does not need.  All columns stay."""
    kept, _ = verdict(plan(documents, text, rules), lambda m: single(F.col(text), m))
    return documents.where(kept)
