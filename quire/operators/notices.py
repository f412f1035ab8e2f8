"""Notices: normalised records with text, agents, names and flat rows."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import variant as V
from quire.functions.text import strip


def _objectish(v: Column) -> Column:
    return F.coalesce(V.truthy(v), F.parse_json(F.lit("{}")))


def from_results(results: DataFrame) -> DataFrame:
    """Resource results to id, type, title, dublincore, extensions, linked_parents."""
    return results.select(
        "id",
        F.coalesce(F.nullif("type", F.lit("")), F.lit("Resource")).alias("type"),
        "title",
        _objectish(F.col("dublincore")).alias("dublincore"),
        _objectish(F.col("extensions")).alias("extensions"),
        F.coalesce("linked_parents", F.array().cast("array<string>")).alias("linked_parents"),
    )


def from_records(records: DataFrame) -> DataFrame:
    """Saved result records (``record`` VARIANT) to notices: id from ``id``, else ``@id``."""
    r = F.col("record")

    def text(name: str) -> Column:
        return V.truthy(V.get(r, name, type="variant")).try_cast("string")

    def namespace(name: str) -> Column:
        return _objectish(V.get(r, "metadata", name, type="variant"))

    parents = V.get(r, "linked_parents", type="array<string>")
    return records.select(
        F.coalesce(text("id"), text("@id")).alias("id"),
        F.coalesce(text("@type"), F.lit("Resource")).alias("type"),
        V.get(r, "title").alias("title"),
        namespace("dublincore").alias("dublincore"),
        namespace("extensions").alias("extensions"),
        F.coalesce(parents, F.array().cast("array<string>")).alias("linked_parents"),
        r.alias("raw"),
    )


def from_objects(described: DataFrame) -> DataFrame:
    """Described objects to notices without fragments and parents."""
    raw = F.col("raw")
    dc = V.first_truthy(
        V.get(raw, "dublinCore", type="variant"), V.get(raw, "dublincore", type="variant")
    )
    return described.select(
        V.get(raw, "@id").alias("id"),
        V.get(raw, "@type").alias("type"),
        V.get(raw, "title").alias("title"),
        _objectish(dc).alias("dublincore"),
        _objectish(V.get(raw, "extensions", type="variant")).alias("extensions"),
        F.array().cast("array<string>").alias("linked_parents"),
        "raw",
    )


def dc(key: str, default: Any = None) -> Column:
    """Dublin Core value at a dotted path; any empty value gives the default."""
    value = V.truthy(V.get_path(F.col("dublincore"), key, "variant"))
    return F.coalesce(value, F.lit(default).cast("variant"))


def ext(key: str, default: Any = None) -> Column:
    """Extension value at a dotted path; any empty value gives the default."""
    value = V.truthy(V.get_path(F.col("extensions"), key, "variant"))
    return F.coalesce(value, F.lit(default).cast("variant"))


def meta(key: str, default: Any = None) -> Column:
    """Dublin Core value at a dotted path; only a missing or null one gives the default."""
    value = V.present(V.get_path(F.col("dublincore"), key, "variant"))
    return F.coalesce(value, F.lit(default).cast("variant"))


def fragment_stats(fragments: DataFrame) -> DataFrame:
    """Fragments and characters per resource: id, fragments_count, text_length."""
    return fragments.groupBy(F.col("resource_id").alias("id")).agg(
        F.count("*").alias("fragments_count"),
        F.sum(F.coalesce(F.char_length("content"), F.lit(0))).cast("long").alias("text_length"),
    )


def with_stats(notices: DataFrame, fragments: DataFrame) -> DataFrame:
    """Notices with both counts; 0 without fragments."""
    joined = notices.join(fragment_stats(fragments), "id", "left")
    return joined.fillna(0, ["fragments_count", "text_length"])


def full_text(fragments: DataFrame) -> DataFrame:
    """Stripped non-empty contents in fragment order, joined by a blank line: id, text."""
    body = strip(F.coalesce("content", F.lit("")))
    parts = fragments.select(F.col("resource_id").alias("id"), "position", body.alias("body"))
    ordered = F.array_sort(F.collect_list(F.struct("position", "body")))
    return (
        parts.filter("body <> ''")
        .groupBy("id")
        .agg(F.array_join(F.transform(ordered, lambda p: p["body"]), "\n\n").alias("text"))
    )


def with_text(notices: DataFrame, fragments: DataFrame) -> DataFrame:
    """Notices with their full text, '' without any."""
    return notices.join(full_text(fragments), "id", "left").fillna("", ["text"])


def _creators() -> Column:
    """Items of ``extensions.creator``: an array as it is, one value as a list of it."""
    value = V.present(V.get(F.col("extensions"), "creator", type="variant"))
    return F.when(value.isNotNull(), F.coalesce(V.as_array(value), F.array(value)))


def agents(notices: DataFrame) -> DataFrame:
    """Creators that are objects or strings: id, pos, agent_id, agent_type, name, same_as, raw."""
    rows = notices.select("id", F.posexplode(_creators()).alias("pos", "item"))
    item = F.col("item")
    same = V.truthy(V.get(item, "sameAs", type="variant"))
    links = F.coalesce(
        F.when(V.is_string(same), F.array(same.try_cast("string"))),
        same.try_cast("array<string>"),
        F.array().cast("array<string>"),
    )
    name = F.when(V.is_string(item), item.try_cast("string")).otherwise(V.get(item, "name"))
    return rows.filter(V.is_object(item) | V.is_string(item)).select(
        "id",
        "pos",
        V.get(item, "@id").alias("agent_id"),
        V.get(item, "@type").alias("agent_type"),
        name.alias("name"),
        links.alias("same_as"),
        item.alias("raw"),
    )


def creator_names() -> Column:
    """Names of the agents, else the Dublin Core creators, else an empty list; within the row."""

    def name(item: Column) -> Column:
        own = V.truthy(V.get(item, "name", type="variant"))
        return F.when(V.is_string(item), item.try_cast("string")).otherwise(V.plain_text(own))

    named = F.filter(
        F.transform(_creators(), name), lambda n: n.isNotNull() & (n != "")
    )
    plain = V.truthy(V.get(F.col("dublincore"), "creator", type="variant"))
    listed = F.coalesce(
        F.transform(V.as_array(plain), V.plain_text),
        F.when(plain.isNotNull(), F.array(V.plain_text(plain))),
    )
    return F.coalesce(
        F.when(F.size(named) > 0, named), listed, F.array().cast("array<string>")
    )


def with_creators(notices: DataFrame) -> DataFrame:
    return notices.withColumn("creator_names", creator_names())


def metadata_keys(flat: DataFrame, column: str = "flat", most: int | None = None) -> list[str]:
    """Sorted union of the keys of a map column, all of them.

    The keys become the columns of a wide table.  With ``most``, more keys than that are an
    error; wider data can stay in the map, which every writer here also takes.
    """
    found = flat.select(F.explode(F.map_keys(column)).alias("key")).distinct()
    keys = [r["key"] for r in (found if most is None else found.limit(most + 1)).collect()]
    if most is not None and len(keys) > most:
        raise ValueError(f"more than {most} metadata keys: keep them in the map column")
    return sorted(keys)


def flat_rows(
    notices: DataFrame,
    fragments: DataFrame,
    include_text: bool = True,
    include_fragments: bool = False,
    keys: list[str] | None = None,
) -> DataFrame:
    """Core columns plus one text column per flattened metadata key.

    The map of a notice is built inside its row and each key is read out of it: no pivot,
    no shuffle beyond the join with the fragment counts.  ``keys`` saves the pass over the
    data that finds them.
    """
    flat = F.map_concat(
        V.flat_map(F.col("dublincore"), "dublincore."),
        V.flat_map(F.col("extensions"), "extensions."),
    )
    wide = notices.withColumn("flat", flat)
    names = metadata_keys(wide) if keys is None else keys
    counts = fragment_stats(fragments).select("id", "fragments_count")
    out = wide.join(counts, "id", "left").fillna(0, ["fragments_count"])
    core = ["id", "type", "title", "linked_parents", "fragments_count"]
    if include_text:
        out = with_text(out, fragments)
        core.append("text")
    if include_fragments:
        from quire.operators.metadata import with_fragments

        out = with_fragments(out, fragments)
    columns = [F.try_element_at("flat", F.lit(k)).alias(k) for k in names]
    tail = ["fragments"] if include_fragments else []
    return out.select(*core, *columns, *tail)
