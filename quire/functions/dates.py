"""Year bounds and their ISO edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import strip

# A year, or a year range with optional end, each with an optional mark.
YEAR_OR_RANGE = r"^(-?\d{1,4})([~?])?(/(-?\d{1,4})?([~?])?)?$"

# Paths and leaf names that hold dates.
TEMPORAL_PATHS = (
    "dublincore.date",
    "dublincore.created",
    "dublincore.issued",
    "dublincore.coverage",
    "extensions.dateCreated",
    "extensions.datePublished",
    "extensions.temporalCoverage",
)
TEMPORAL_LEAVES = (
    "date",
    "created",
    "issued",
    "coverage",
    "temporal",
    "temporalCoverage",
    "dateCreated",
    "datePublished",
)


def year_bounds(text: Column, number: Column | None = None) -> Column:
    """STRUCT<start BIGINT, end BIGINT>.  ``number`` is the value when it is a whole number."""
    v = strip(text)
    start = F.nullif(F.regexp_extract(v, YEAR_OR_RANGE, 1), F.lit("")).cast("long")
    upper = F.nullif(F.regexp_extract(v, YEAR_OR_RANGE, 4), F.lit("")).cast("long")
    end = F.when(F.contains(v, F.lit("/")), upper).otherwise(start)
    if number is not None:
        start = F.coalesce(number, start)
        end = F.coalesce(number, end)
    return F.struct(start.alias("start"), end.alias("end"))


def _padded(year: Column) -> Column:
    digits = year.cast("string")
    return F.when(F.length(digits) >= 4, digits).otherwise(F.lpad(digits, 4, "0"))


def year_start_iso(year: Column) -> Column:
    """First day of the year; a negative year stays a bare number."""
    return F.when(year >= 0, F.concat(_padded(year), F.lit("-01-01"))).otherwise(
        year.cast("string")
    )


def year_end_iso(year: Column) -> Column:
    """Last day of the year; a negative year stays a bare number."""
    return F.when(year >= 0, F.concat(_padded(year), F.lit("-12-31"))).otherwise(
        year.cast("string")
    )


def is_temporal(path: Column, leaf: Column) -> Column:
    """A known full path or a known leaf name."""
    return path.isin(*TEMPORAL_PATHS) | leaf.isin(*TEMPORAL_LEAVES)
