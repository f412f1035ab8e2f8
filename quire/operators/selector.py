"""Element selectors: child and descendant steps, attribute tests, alternatives.

All steps of a selector, of its alternatives and of a title selector are bits of one state.
A row's own tests are worked out once, where the markup is; after that only the state goes
through the nesting windows of ``shred``.  A round hands the states of parents and ancestors
down by one step, for all alternatives at once, so the number of rounds is that of the
longest path; there is no join and no limit on depth.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.shred import attribute, enclosing, is_kind, nesting

_STEP = re.compile(r"(?P<axis>/{0,2})(?P<name>(?:tei:)?(?:[\w.-]+|\*))(?P<tests>(?:\[[^\]]*\])*)")
_TEST = re.compile(r"\[\s*@(?P<name>[\w:.-]+)\s*(?:=\s*(?:'(?P<a>[^']*)'|\"(?P<b>[^\"]*)\")\s*)?\]")
_ALTERNATIVE = re.compile(r"""(?:[^|"']|"[^"]*"|'[^']*')+""")
#: Steps of a selector with all its alternatives and titles.
MOST_STEPS = 62


@dataclass(frozen=True)
class Step:
    """``tests`` are attributes with the value they must have, or None where any will do."""

    descendant: bool
    name: str
    tests: tuple[tuple[str, str | None], ...]

    @property
    def on_every_row(self) -> bool:
        """Whether closing rows can be tested too (they carry name and id, not attributes)."""
        return all(name == "xml:id" for name, _ in self.tests)

    def matches(self) -> Column:
        found = F.col("elem_pos").isNotNull()
        if self.name != "*":
            found = found & F.col("tei")
            local = self.name.removeprefix("tei:")
            if local != "*":
                found = found & (F.col("name") == local)
        for name, value in self.tests:
            actual = F.col("xml_id") if name == "xml:id" else attribute(F.col("markup"), name)
            found = found & (actual.isNotNull() if value is None else F.coalesce(actual == value, F.lit(False)))
        return F.coalesce(found, F.lit(False))


@dataclass(frozen=True)
class Path:
    """``context`` is the depth the first step starts from: 1 the root element, 0 the document."""

    steps: tuple[Step, ...]
    context: int


def parse(xpath: str) -> tuple[Path, ...]:
    """Read a selector; anything beyond steps, attribute tests and ``|`` is an error."""
    parts = _ALTERNATIVE.findall(xpath)
    if "|".join(parts) != xpath or not parts:
        raise ValueError(f"unsupported selector: {xpath!r}")
    return tuple(_path(p.strip(), xpath) for p in parts)


def _path(text: str, xpath: str) -> Path:
    context = 0 if text.startswith("/") else 1
    rest = text[1:] if text.startswith("./") else text
    steps = []
    while rest:
        found = _STEP.match(rest)
        axis = found and found["axis"]
        if not found or (not axis and steps):
            raise ValueError(f"unsupported selector: {xpath!r}")
        name = found["name"]
        if name != "*" and not name.startswith("tei:"):
            raise ValueError(f"selector steps need the tei: prefix: {xpath!r}")
        tests = re.findall(r"\[[^\]]*\]", found["tests"])
        parsed = [_TEST.fullmatch(t) for t in tests]
        if not all(parsed):
            raise ValueError(f"unsupported test in selector: {xpath!r}")
        pairs = tuple((t["name"], t["a"] if t["a"] is not None else t["b"]) for t in parsed)
        steps.append(Step(axis == "//", name, pairs))
        rest = rest[found.end() :]
    if not steps:
        raise ValueError(f"empty selector: {xpath!r}")
    return Path(tuple(steps), context)


@dataclass(frozen=True)
class Title:
    """A title is an element whose state has the ``bit``, so many levels below the fragment, or
    as many at least."""

    bit: int
    below: int
    at_least: bool

    def matches(self, state: Column, depth: Column, fragment: Column) -> Column:
        far = depth - fragment
        return has(state, self.bit) & (far >= self.below if self.at_least else far == self.below)


def has(state: Column, bit: int) -> Column:
    return state.bitwiseAND(F.lit(1 << bit)) != 0


@dataclass(frozen=True)
class _Bit:
    step: Step
    before: int | None  # bit of the step before
    context: int | None  # for a first step: the depth it starts from, None for any


@dataclass(frozen=True)
class Machine:
    """The steps of a selector and of titles inside what it selects."""

    bits: tuple[_Bit, ...]
    rounds: int
    selected: tuple[int, ...]
    titles: tuple[Title, ...]

    def _met(self, before: Column, inside: dict[int, Column]) -> Iterator[Column]:
        """The bits whose step before is the parent's or an ancestor's."""
        for i, b in enumerate(self.bits):
            if b.before is None:
                if b.context is None:
                    ok = F.lit(True)
                else:
                    ok = F.col("depth") > b.context if b.step.descendant else F.col("depth") == b.context + 1
            else:
                ok = inside[b.before] if b.step.descendant else has(before, b.before)
            yield F.when(F.coalesce(ok, F.lit(False)), F.lit(1 << i)).otherwise(F.lit(0))

    def run(self, tokens: DataFrame, state: str = "state") -> DataFrame:
        """``tokens`` with a column ``state`` on the rows of all elements."""
        opening = is_kind("open", "empty")
        own_tests = reduce(
            Column.bitwiseOR,
            (F.when(b.step.matches(), F.lit(1 << i)).otherwise(F.lit(0)) for i, b in enumerate(self.bits)),
        )
        begun = reduce(
            Column.bitwiseOR,
            (c for c, b in zip(self._met(F.lit(0), dict.fromkeys(range(len(self.bits)), F.lit(False))), self.bits, strict=True)
             if b.before is None),
        )
        t = tokens.withColumn("_tests", own_tests)
        t = t.withColumn(state, F.col("_tests").bitwiseAND(begun))
        if self.rounds or not all(b.step.on_every_row for b in self.bits):
            t = t.withColumn(state, F.when(opening, F.col(state)))
            wide = {b.before for b in self.bits if b.before is not None and b.step.descendant}
            for _ in range(self.rounds):
                t = enclosing(t, F.col(state), "_up")
                own = F.when(is_kind("close"), F.col("_up")).otherwise(F.col(state))
                t = t.withColumns({f"_in{i}": nesting(F.coalesce(has(own, i), F.lit(False))) for i in wide})
                # the element itself does not count among its ancestors
                inside = {
                    i: F.col(f"_in{i}") - F.when(is_kind("open") & has(F.col(state), i), 1).otherwise(0) > 0 for i in wide
                }
                met = reduce(Column.bitwiseOR, self._met(F.coalesce("_up", F.lit(0)), inside))
                t = t.withColumn(state, F.when(opening, F.col("_tests").bitwiseAND(met)))
            t = enclosing(t, F.col(state), "_up").drop(*(f"_in{i}" for i in wide))
            t = t.withColumn(state, F.when(is_kind("close"), F.col("_up")).otherwise(F.col(state))).drop("_up")
        return t.drop("_tests").withColumn(state, F.coalesce(state, F.lit(0)))

    def marked(self, tokens: DataFrame, state: str = "state") -> DataFrame:
        """``tokens`` that ``run`` gave a state, with ``marked`` on the rows of what is selected."""
        found = reduce(or_, (has(F.col(state), i) for i in self.selected))
        return tokens.withColumns({"state": F.col(state), "marked": found})


def compile_paths(fragments: str, titles: str | None = None) -> Machine:
    """The machine of a selector of fragments and one of titles.

    Titles are paths of child steps below the fragment; the first step may be a descendant one.
    """
    bits: list[_Bit] = []
    selected, named, longest = [], [], 1
    for path in parse(fragments):
        for n, step in enumerate(path.steps):
            bits.append(_Bit(step, len(bits) - 1 if n else None, None if n else path.context))
        selected.append(len(bits) - 1)
        longest = max(longest, len(path.steps))
    for path in parse(titles) if titles else ():
        if path.context == 0 or any(s.descendant for s in path.steps[1:]):
            raise ValueError(f"a title selector is a path of child steps: {titles!r}")
        for n, step in enumerate(path.steps):
            bits.append(_Bit(step, len(bits) - 1 if n else None, None))
        named.append(Title(len(bits) - 1, len(path.steps), path.steps[0].descendant))
        longest = max(longest, len(path.steps))
    if len(bits) > MOST_STEPS:
        raise ValueError(f"a selector has {MOST_STEPS} steps at most: {fragments!r}, {titles!r}")
    return Machine(tuple(bits), longest - 1, tuple(selected), tuple(named))
