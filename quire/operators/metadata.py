"""Metadata of described objects: canonical keys, path projection, result records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import let
from quire.functions import variant as V
from quire.functions.text import strip


def dublin_core(raw: Column) -> Column:
    """``dublincore`` when the key is there (even empty), else ``dublinCore``."""
    return let(V.fields(raw, lower="dublincore", camel="dublinCore"), lambda x: F.coalesce(x["lower"], x["camel"]))


def extensions(raw: Column) -> Column:
    return V.fields(raw, extensions="extensions")["extensions"]


def build(
    raw: Column,
    metadata_dublincore: Sequence[str] | None = None,
    metadata_extensions: Sequence[str] | None = None,
) -> dict[str, Column]:
    """The two namespaces after projection; NULL when nothing is left of one."""
    return {
        "dublincore": V.pick(dublin_core(raw), metadata_dublincore),
        "extensions": V.pick(extensions(raw), metadata_extensions),
    }


def members(raw: Column) -> Column:
    """Members of a collection as ARRAY<STRUCT<id, type, title>>, in order."""
    listed = V.items(V.fields(raw, member="member")["member"], "string", id="@id", type="@type", title="title")
    shown = F.filter(listed, lambda m: m.isNotNull())
    return F.coalesce(shown, F.array().cast("array<struct<id:string,type:string,title:string>>"))


def collection_results(
    collections: DataFrame,
    metadata_dublincore: Sequence[str] | None = None,
    metadata_extensions: Sequence[str] | None = None,
) -> DataFrame:
    """Walked collections to id, type, title, linked_parents, dublincore, extensions, member."""
    raw = F.col("raw")
    kept = build(raw, metadata_dublincore, metadata_extensions)
    return collections.select(
        V.fields(raw, "string", id="@id")["id"].alias("id"),
        V.fields(raw, "string", type="@type")["type"].alias("type"),
        V.fields(raw, "string", title="title")["title"].alias("title"),
        "linked_parents",
        *[c.alias(name) for name, c in kept.items()],
        members(raw).alias("member"),
    )


def own_id(raw: Column) -> Column:
    """The trimmed ``@id``, '' when there is none."""
    return strip(F.coalesce(V.truthy(V.fields(raw, id="@id")["id"]).try_cast("string"), F.lit("")))


def resource_results(
    resources: DataFrame,
    metadata_dublincore: Sequence[str] | None = None,
    metadata_extensions: Sequence[str] | None = None,
) -> DataFrame:
    """Walked resources to id, type, title, linked_parents, dublincore, extensions.

    Fragments stay in their own table, keyed by the id; ids are trimmed, blank ones dropped.
    """
    raw = F.col("raw")
    own = own_id(raw)
    kind = V.truthy(V.fields(raw, type="@type")["type"]).try_cast("string")
    kept = build(raw, metadata_dublincore, metadata_extensions)
    return resources.filter(own != "").select(
        own.alias("id"),
        F.coalesce(kind, F.lit("Resource")).alias("type"),
        V.fields(raw, "string", title="title")["title"].alias("title"),
        "linked_parents",
        *[c.alias(name) for name, c in kept.items()],
    )


def with_fragments(results: DataFrame, fragments: DataFrame) -> DataFrame:
    """Results with their fragments nested in order: the record form of the export formats.

    The list of one resource is bounded by its document.  Everything else works on the
    fragments table as it is.
    """
    columns = [c for c in fragments.columns if c not in ("resource_id", "position")]
    item = F.struct("position", *columns)
    listed = fragments.groupBy(F.col("resource_id").alias("id")).agg(
        F.array_sort(F.collect_list(item), lambda a, b: a["position"] - b["position"]).alias("_f")
    )
    return (
        results.join(listed, "id", "left")
        .withColumnRenamed("_f", "fragments")
        .withColumn("fragments", F.coalesce("fragments", F.array().cast(listed.schema["_f"].dataType)))
    )


def flat_entries(results: DataFrame) -> DataFrame:
    """Long form of the flattened metadata: id, key, value."""
    both = F.concat(
        V.flatten(F.col("dublincore"), "dublincore."),
        V.flatten(F.col("extensions"), "extensions."),
    )
    return results.select("id", F.explode(both).alias("e")).select(
        "id", F.col("e.key").alias("key"), V.leaf_text(F.col("e.value")).alias("value")
    )
