"""Run reports: counts, comparison of modes, previews, readable lines."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import compact
from quire.session import materialize

# Lengths of previews and the width of rules in the text report.
PREVIEW_CHARS = 400
REPORT_CHARS = 1200
RULE_WIDTH = 100


def run_summary(
    collections: DataFrame, resources: DataFrame, fragments: DataFrame
) -> DataFrame:
    """One row: collections, collection_members, resources, fragments, nothing_retrieved.

    ``nothing_retrieved``: members were listed, yet no resource came back.
    """
    parts = [
        collections.agg(
            F.count("*").alias("collections"),
            F.coalesce(F.sum(F.size("member")), F.lit(0)).cast("long").alias("collection_members"),
        ),
        resources.agg(F.count("*").alias("resources")),
        fragments.agg(F.count("*").alias("fragments")),
    ]
    # three single rows side by side
    keyed = [p.withColumn("_one", F.lit(1)) for p in parts]
    joined = reduce(lambda a, b: a.join(b, "_one"), keyed).drop("_one")
    empty = (F.col("collection_members") > 0) & (F.col("resources") == 0)
    return joined.withColumn("nothing_retrieved", empty)


def compare_modes(summaries: Mapping[str, DataFrame]) -> DataFrame:
    """One row per mode from the summaries (and run statistics) of its run."""
    tagged = [df.withColumn("mode", F.lit(mode)) for mode, df in summaries.items()]
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged
    ).withColumnRenamed("collection_members", "members")


def preview(resources: DataFrame, fragments: DataFrame, limit: int = 3) -> DataFrame:
    """The first resources by id with their first fragment.

    Takes the top ids before it touches the fragments, so only those resources are joined.
    """
    top = resources.orderBy("id").limit(limit).select("id", "title")
    first = F.min_by(F.struct("id", "level", "head", "breadcrumb", "content"), "position")
    mine = fragments.join(
        F.broadcast(top.select(F.col("id").alias("resource_id"))), "resource_id", "left_semi"
    )
    firsts = mine.groupBy(F.col("resource_id").alias("rid")).agg(
        F.count("*").alias("fragments"), first.alias("f")
    )
    return top.join(firsts, F.col("id") == F.col("rid"), "left").select(
        "id",
        "title",
        F.coalesce("fragments", F.lit(0)).cast("long").alias("fragments"),
        F.col("f.id").alias("fragment_id"),
        F.col("f.level").alias("level"),
        F.col("f.head").alias("head"),
        F.col("f.breadcrumb").alias("breadcrumb"),
        F.when(F.col("f").isNotNull(), compact(F.col("f.content"), PREVIEW_CHARS)).alias("content"),
    )


def report_lines(results: DataFrame, fragments: DataFrame) -> DataFrame:
    """Readable report: resource_id, part, line_no, line.

    ``part`` is 0 for the lines of the resource and 1.. for its fragments.  ``results``
    may carry ``metadata`` (JSON text), shown when it is not empty.  What the report shows of
    the fragments is written once, as their counts and their lines are both read from it.
    """
    shown_of = ["resource_id", "position", "id", "level", "head", "breadcrumb"]
    fragments = materialize(
        fragments.select(*shown_of, compact(F.col("content"), REPORT_CHARS).alias("preview")), "report-fragments"
    )
    rule, thin = F.lit("=" * RULE_WIDTH), F.lit("-" * RULE_WIDTH)

    def labelled(label: str, value) -> Column:
        return F.concat(F.lit(label), F.coalesce(value.cast("string"), F.lit("None")))

    counts = fragments.groupBy(F.col("resource_id").alias("id")).agg(F.count("*").alias("n"))
    counted = results.join(counts, "id", "left")
    heading = [
        rule,
        labelled("ID       : ", F.col("id")),
        labelled("Title    : ", F.col("title")),
        labelled("Fragments: ", F.coalesce("n", F.lit(0))),
    ]
    lines = F.array(*heading)
    if "metadata" in results.columns:
        shown = F.array(F.lit("Metadata"), F.col("metadata"))
        none = F.array().cast("array<string>")
        lines = F.concat(lines, F.when(F.col("metadata").isNotNull(), shown).otherwise(none))
    top = counted.select(
        F.col("id").alias("resource_id"), F.lit(0).alias("part"), F.posexplode(lines)
    )
    body = [
        thin,
        labelled("Fragment ", F.col("position") + 1),
        labelled("id   : ", F.col("id")),
        labelled("level     : ", F.col("level")),
        labelled("head      : ", F.col("head")),
        labelled("breadcrumb: ", F.col("breadcrumb")),
        F.lit(""),
        F.col("preview"),
        F.lit(""),
    ]
    parts = fragments.select(
        "resource_id", (F.col("position") + 1).alias("part"), F.posexplode(F.array(*body))
    )
    return (
        top.unionByName(parts)
        .withColumnRenamed("pos", "line_no")
        .withColumnRenamed("col", "line")
    )
