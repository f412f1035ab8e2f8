"""Breadth-first walk of the collection graph, and the parents of what it finds."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import id_list
from quire.session import checkpoint_root

VISIT = "object_id string, found_by string, depth int"


@dataclass(frozen=True)
class Walk:
    """Objects reached: each once, with its depth and the parent that found it."""

    visited: DataFrame
    collections: DataFrame
    resources: DataFrame
    missing: DataFrame


class Bucketed:
    """Rows kept as a table in the shared folder, in files by the hash of one column.

    Joins and groupings by that column read them where they are.  The name in the session's
    catalog is given back by ``forget``; the files stay with the folder.
    """

    def __init__(self, spark: SparkSession, label: str, column: str, parts: int) -> None:
        self.spark, self.column, self.parts = spark, column, parts
        self.name = f"quire_{label}_{uuid.uuid4().hex}"
        self.path = f"{checkpoint_root(spark)}/quire/{self.name}"

    @property
    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, rows: DataFrame, *folders: str) -> int:
        """Append rows, with a folder for each value of the columns named; their number."""
        counted = Observation()
        (
            rows.observe(counted, F.count(F.lit(1)).alias("n"))
            .write.mode("append").partitionBy(*folders).bucketBy(self.parts, self.column)
            .option("path", self.path).format("parquet").saveAsTable(self.name)
        )
        return counted.get["n"]

    def forget(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def next_level(edges: DataFrame, seen: DataFrame, depth: int) -> DataFrame:
    """What the objects of one level find that was not seen before.

    ``edges`` lie by ``asked`` and ``seen`` by ``object_id``, in equally many buckets: the level
    joins its edges in place, and only what it finds is exchanged, to where it would have been seen.
    """
    near = seen.filter(F.col("depth") == depth).select(F.col("object_id").alias("asked"))
    found = (
        edges.join(near, "asked")
        .groupBy(F.col("child_id").alias("object_id"))
        .agg(F.min(F.struct("parent_id", "pos"))["parent_id"].alias("found_by"))
    )
    fresh = found.join(seen.select("object_id"), "object_id", "left_anti")
    return fresh.select("object_id", "found_by", F.lit(depth + 1).alias("depth"))


def reach(edges: DataFrame, start: str, excluded: Sequence[str] = ()) -> DataFrame:
    """Ids reachable from ``start`` over ``edges(parent_id, child_id, pos)``.

    A parent that answered under another id than the one asked for has that one in
    ``request_id``, where there is such a column: the walk goes by the ids asked for.

    The edges are written once, in buckets by the id asked for, and never moved again; a round
    handles one level.  Of several parents on the level before, the smallest id finds the
    child.  Excluded ids are cut from the edges first, so what hangs on them is reached only
    on another way.
    """
    spark = edges.sparkSession
    if excluded:
        left_out = spark.createDataFrame([(e,) for e in set(excluded)], "child_id string")
        edges = edges.join(left_out, "child_id", "left_anti")
    asked = F.col("request_id" if "request_id" in edges.columns else "parent_id").alias("asked")
    edges = edges.select(asked, "parent_id", "child_id", "pos").filter(F.col("child_id") != start)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near, seen = Bucketed(spark, "edges", "asked", parts), Bucketed(spark, "seen", "object_id", parts)
    try:
        near.add(edges.repartition(parts, "asked"))
        fresh, depth = spark.createDataFrame([(start, None, 0)], VISIT), 0
        while seen.add(fresh, "depth"):
            fresh, depth = next_level(near.rows, seen.rows, depth), depth + 1
    finally:
        near.forget()
        seen.forget()
    return spark.read.schema(VISIT).parquet(seen.path)


def walk(
    described: DataFrame, edges: DataFrame, start: str, excluded: Sequence[str] = ()
) -> Walk:
    """Walk from ``start`` and split what was reached by type.

    ``described(object_id, type, ...)`` holds the objects whose payload was read, one row per
    ``request_id`` (``object_id`` where that column is missing); ids without one are
    ``missing`` (they carry no edges, so their subtree is not reached).  An object that
    answers to several ids is kept once, as found on the first level, then under the smallest id.
    """
    visited = reach(edges, start, excluded)
    if "request_id" not in described.columns:
        described = described.withColumn("request_id", F.col("object_id"))
    found = visited.withColumnRenamed("object_id", "request_id")
    first = (
        found.join(described.select("request_id", "object_id"), "request_id")
        .groupBy("object_id")
        .agg(F.min(F.struct("depth", "request_id", "found_by")).alias("f"))
        .select("f.request_id", "f.depth", "f.found_by")
    )
    known = first.join(described, "request_id").drop("request_id")
    is_resource = F.coalesce(F.col("type"), F.lit("Collection")) == "Resource"
    return Walk(
        visited=visited,
        collections=known.filter(~is_resource),
        resources=known.filter(is_resource),
        missing=found.join(described.select("request_id"), "request_id", "left_anti")
        .withColumnRenamed("request_id", "object_id"),
    )


def fallback_parents() -> Column:
    """The parent that found the object, as a list."""
    return id_list(F.array("found_by"))


def link_parents(visited: DataFrame, parents: DataFrame | None, fetch: bool = True) -> DataFrame:
    """Add ``linked_parents`` to walked objects.

    With ``fetch`` the parents payload decides, even when it lists none; a failed one (NULL
    or absent) and ``fetch=False`` leave the parent of the walk.
    """
    if not fetch or parents is None:
        return visited.withColumn("linked_parents", fallback_parents())
    told = parents.select(
        F.col("request_id").alias("object_id"), F.col("parents").alias("_parents")
    )
    joined = visited.join(told, "object_id", "left")
    return joined.withColumn(
        "linked_parents", F.coalesce("_parents", fallback_parents())
    ).drop("_parents")
