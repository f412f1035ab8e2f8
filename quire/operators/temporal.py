"""Dates in metadata: only the temporal fields, with parsed year bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import let
from quire.functions import variant as V
from quire.functions.dates import is_temporal, year_bounds, year_end_iso, year_start_iso


def _pair(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.cast("variant").alias("value"))


def _enriched(e: Column, include_unparsed: bool) -> Column:
    """One temporal leaf as up to five entries: itself, and start and end as year and date."""
    value = e["value"]
    kind = F.schema_of_variant(value)
    number = F.when(kind == "BIGINT", value.try_cast("bigint"))
    text = F.when(kind == "STRING", value.try_cast("string"))

    def entries(b: Column) -> Column:
        start, end = b["start"], b["end"]
        parsed = start.isNotNull() | end.isNotNull()
        own = F.lit(True) if include_unparsed else parsed

        def named(suffix: str, v: Column) -> Column:
            return F.when(v.isNotNull(), _pair(F.concat(e["key"], F.lit(suffix)), v))

        return F.array_compact(
            F.array(
                F.when(own, _pair(e["key"], value)),
                named("_start", start),
                named("_start_iso", F.when(start.isNotNull(), year_start_iso(start))),
                named("_end", end),
                named("_end_iso", F.when(end.isNotNull(), year_end_iso(end))),
            )
        )

    return let(year_bounds(text, number), entries)


def temporal_entries(leaves: Column, include_unparsed: bool = True) -> Column:
    """Flattened leaves to ARRAY<STRUCT<key, value VARIANT>> of the temporal ones, enriched."""
    dated = F.filter(leaves, lambda e: is_temporal(e["key"], e["leaf"]))
    return F.flatten(F.transform(dated, lambda e: _enriched(e, include_unparsed)))


def namespaced(dublincore: Column, extensions: Column) -> Column:
    """Leaves of both namespaces under ``dublincore.`` and ``extensions.``."""
    return F.concat(
        V.flatten(dublincore, "dublincore."), V.flatten(extensions, "extensions.")
    )


def temporal_index(include_unparsed: bool = True) -> Column:
    """Entries of both namespaces, keys with the namespace."""
    return temporal_entries(
        namespaced(F.col("dublincore"), F.col("extensions")), include_unparsed
    )


def temporal_index_short(include_unparsed: bool = True) -> Column:
    """Entries of Dublin Core only, keys without a namespace."""
    return temporal_entries(V.flatten(F.col("dublincore")), include_unparsed)


def temporal_long(notices: DataFrame, short: bool = False, include_unparsed: bool = True) -> DataFrame:
    """Long form: id, key, value (text)."""
    entries = temporal_index_short(include_unparsed) if short else temporal_index(include_unparsed)
    return notices.select("id", F.explode(entries).alias("e")).select(
        "id", F.col("e.key").alias("key"), V.leaf_text(F.col("e.value")).alias("value")
    )
