"""URL filter: allow and block rules first, gradient-boosted trees on lexical features else."""

from __future__ import annotations

import math
import string
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import arrow_column, bounded, free_name

#: The trees are fitted on about this many labelled URLs at most.
SAMPLE_ROWS = 20_000
#: Trees and their depth.
TREES, DEPTH = 12, 4


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(_rest(url), "^([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


@dataclass(frozen=True)
class Rule:
    """``text`` is a host and a path, as in ``example.org/en/``; it fits the host, all of its
    subdomains, and the paths that start with its own."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2] if "/" in self.text else ""


def ruled(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct of ``rule`` and ``verdict`` of the longest rule that fits, else null.

    Of equally long rules the first by text wins.  The rules are literals of the plan.
    """
    ranked = sorted(rules, key=lambda r: (-len(r.text), r.text))
    kind = "struct<host:string,path:string,rule:string,verdict:string>"
    known = F.array(*[
        F.struct(F.lit(r.host).alias("host"), F.lit(r.path).alias("path"), F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))
        for r in ranked
    ]).cast(f"array<{kind}>")
    fits = F.filter(known, lambda r: ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))) & path.startswith(r["path"]))
    best = F.get(fits, 0)
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


@dataclass(frozen=True)
class Filter:
    """Fitted trees with the suffix statistics they use; without trees ``usual`` holds."""

    trees: GBTClassificationModel | None
    suffixes: dict[str, tuple[float, float]]
    usual: str


def _suffixes(host: str) -> tuple[str, str]:
    parts = host.split(".")
    return parts[-1], ".".join(parts[-2:])


def lexical(url: str, suffixes: dict[str, tuple[float, float]]) -> list[float]:
    """Length, host and path lengths, depths, digit ratios, entropy, parameters, and how often
    labelled URLs with the same suffixes are blocked."""
    rest = url.partition("://")[2]
    cut = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    host, after = rest[:cut].lower(), rest[cut:]
    path = after.partition("#")[0].partition("?")[0]
    query = after.partition("#")[0].partition("?")[2]
    n = max(1, len(url))
    digits = sum(map(str.isdigit, url))
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(url).values())
    words = [p for p in path.split("/") if p]
    out = [
        len(url), len(host), len(path), host.count("."), len(words), host.count("-"),
        digits / n, sum(map(str.isdigit, host)) / max(1, len(host)), entropy,
        sum(1 for p in query.split("&") if p), len(query), float("#" in after),
        float(url.startswith("https")), max(map(len, words), default=0), len(words[0]) if words else 0,
        float(path.endswith("/")), float("." in path.rpartition("/")[2]),
    ]
    for s in _suffixes(host):
        out += suffixes.get(s, (0.5, 0.0))
    return [float(x) for x in out]


def features(url: Column, suffixes: dict[str, tuple[float, float]]) -> Column:
    def run(urls: pa.Array) -> pa.Array:
        return pa.array([lexical(u.as_py() or "", suffixes) for u in urls], pa.list_(pa.float64()))

    return array_to_vector(arrow_column(run, "array<double>", url))


def fit(labelled: DataFrame, url: str = "url", verdict: str = "verdict") -> Filter:
    """Trees from labelled URLs (``allow`` or ``block``); rows with another label or without a
    URL are left out.  About ``SAMPLE_ROWS`` rows at most are used, chosen by a hash of the URL.
    With one label only, that label is the verdict of all; without any, ``allow``.
    """
    rows = labelled.where(F.col(verdict).isin("allow", "block") & F.col(url).isNotNull()).select(
        F.col(url).alias("url"), (F.col(verdict) == "block").cast("double").alias("label")
    )
    sample = bounded(rows, F.col("url"), SAMPLE_ROWS).persist()
    try:
        host = host_of(F.col("url"))
        last, two = F.substring_index(host, ".", -1), F.substring_index(host, ".", -2)
        counted = sample.select(F.explode(F.array_distinct(F.array(last, two))).alias("s"), "label").groupBy("s").agg(
            F.sum("label").alias("blocked"), F.count("*").alias("n")
        )
        # at most two suffixes for each row of the bounded sample
        suffixes = {r["s"]: ((r["blocked"] + 1) / (r["n"] + 2), math.log1p(r["n"])) for r in counted.collect()}
        count = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
        if len(count) < 2:
            return Filter(None, suffixes, "block" if 1.0 in count else "allow")
        made = sample.select(features(F.col("url"), suffixes).alias("features"), "label")
        trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7).fit(made)
    finally:
        sample.unpersist()
    return Filter(trees, suffixes, "block" if count.get(1.0, 0) > count.get(0.0, 0) else "allow")


def judge(urls: DataFrame, rules: list[Rule], learned: Filter, url: str = "url") -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule`` (null if none fits), ``verdict`` and
    ``score`` (the trees' probability of ``block``; null without trees).

    The verdict is the longest fitting rule's, else the trees'.  A null URL, or one without
    ``://``, has an empty host and path and is judged by the trees.  Columns of ``urls`` named
    like the results are replaced, but for the URL itself.
    """
    df = urls
    hold, found, vector, raw, chance, guess = (
        free_name(df, n) for n in ("url_text", "url_rule", "url_features", "url_raw", "url_chance", "url_guess")
    )
    own = ["host", "path", "rule", "verdict", "score"]
    df = df.withColumn(hold, F.col(url)).drop(*[c for c in urls.columns if c in own])
    df = df.withColumns({"host": host_of(F.col(hold)), "path": path_of(F.col(hold))})
    df = df.withColumn(found, ruled(F.col("host"), F.col("path"), rules))
    if learned.trees is None:
        df = df.withColumn("score", F.lit(None).cast("double")).withColumn(guess, F.lit(learned.usual))
    else:
        from pyspark.ml.functions import vector_to_array

        model = learned.trees.copy().setFeaturesCol(vector).setRawPredictionCol(raw).setProbabilityCol(chance).setPredictionCol("")
        df = model.transform(df.withColumn(vector, features(F.col(hold), learned.suffixes)))
        df = df.withColumn("score", vector_to_array(chance)[1])
        df = df.withColumn(guess, F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    df = df.withColumns({"rule": F.col(found)["rule"], "verdict": F.coalesce(F.col(found)["verdict"], F.col(guess))})
    df = df.drop(vector, raw, chance, guess, found)
    return df.withColumn(url, F.col(hold)).drop(hold) if url in own else df.drop(hold)
