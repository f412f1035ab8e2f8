"""JSON results, CSV index, NDJSON exports, text report."""

from __future__ import annotations

import json
import zlib

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quire.functions import let
from quire.functions import variant as V
from quire.operators.exports import payload_object
from quire.operators.notices import metadata_keys, with_stats
from quire.operators.reports import RULE_WIDTH
from quire.session import materialize

#: Size of the key names of a written index.
MOST_KEY_BYTES = 16 << 20
# The leading columns of the index.
INDEX_CORE = ("id", "title", "linked_parents", "fragments_count", "text_length")


def write_results(tables: dict[str, DataFrame], path: str, format: str = "parquet") -> None:
    """Each result table under its name; parquet as the native form, json as the readable one."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(format).save(f"{path.rstrip('/')}/{name}")


def _flat_results(results: DataFrame) -> DataFrame:
    """Results with their metadata as a map from flat keys to texts."""
    flat = F.map_concat(
        V.flat_map(F.col("dublincore"), "dublincore.", V.csv_text),
        V.flat_map(F.col("extensions"), "extensions.", V.csv_text),
    )
    return results.withColumn("flat", F.coalesce(flat, F.create_map().cast("map<string,string>")))


def _index_core() -> list[Column]:
    return [
        F.col("id"),
        F.coalesce("title", F.lit("")).alias("title"),
        V.spaced_json(F.to_json("linked_parents")).alias("linked_parents"),
        F.col("fragments_count").cast("string").alias("fragments_count"),
        F.col("text_length").cast("string").alias("text_length"),
    ]


def index_rows(
    results: DataFrame, fragments: DataFrame, keys: list[str] | None = None
) -> DataFrame:
    """Flat index: core columns as text, then one column per metadata key, '' when absent."""
    wide = _flat_results(results)
    names = metadata_keys(wide) if keys is None else keys
    cells = [
        F.coalesce(F.try_element_at("flat", F.lit(k)), F.lit("")).alias(k) for k in names
    ]
    return with_stats(wide, fragments).select(*_index_core(), *cells)


def _cell(text: Column) -> Column:
    """A CSV cell, in quotes where it needs them; NULL is empty."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike('[",\r\n]|^\\s|\\s$'), quoted).otherwise(text), F.lit(""))


def _cells_in_order(flat: Column, names: list[str]) -> Column:
    """The cells of a line for all ``names``, each after a comma, from the entries of ``flat``.

    Only the keys that a row has are looked up, in buckets of names by their CRC-32; what lies
    between two of them is commas.
    """
    if not names:
        return F.lit("")
    buckets: list[list[dict]] = [[] for _ in names]
    for place, name in enumerate(names):
        buckets[zlib.crc32(name.encode()) % len(names)].append({"name": name, "place": place})
    kind = "array<array<struct<name:string,place:int>>>"
    table = F.from_json(F.lit(json.dumps(buckets)), kind)

    def placed(entry: Column) -> Column:
        bucket = F.get(table, (F.crc32(entry["key"].cast("binary")) % len(names)).cast("int"))
        same = F.filter(bucket, lambda b: b["name"] == entry["key"])
        return F.transform(same, lambda b: F.struct(b["place"].alias("place"), _cell(entry["value"]).alias("cell")))

    def joined(cells: Column) -> Column:
        def piece(c: Column, i: Column) -> Column:
            before = F.coalesce(F.get(cells, i - 1)["place"], F.lit(-1))
            return F.concat(F.repeat(F.lit(","), c["place"] - before), c["cell"])

        last = F.coalesce(F.get(cells, F.size(cells) - 1)["place"], F.lit(-1))
        return F.concat(F.array_join(F.transform(cells, piece), ""), F.repeat(F.lit(","), len(names) - 1 - last))

    return let(F.array_sort(F.flatten(F.transform(F.map_entries(flat), placed))), joined)


def write_index(
    results: DataFrame, fragments: DataFrame, path: str, keys: list[str] | None = None
) -> None:
    """The index as CSV files, each with a header; quotes doubled, line breaks kept inside quotes.

    Lines are rendered from the entries of the metadata map in the order of the keys, so there is
    no wide row, a row costs what it has, and the number of keys has no limit but the size of the
    dictionary, which is all that the driver holds (``MOST_KEY_BYTES``).
    """
    wide = _flat_results(results)
    names = metadata_keys(wide) if keys is None else keys
    if sum(map(len, names)) > MOST_KEY_BYTES:
        raise ValueError(f"{len(names)} metadata keys are more than a dictionary of {MOST_KEY_BYTES} bytes")
    dictionary = F.lit(names) if names else F.array().cast("array<string>")
    line = F.concat(F.array_join(F.array(*map(_cell, _index_core())), ","), _cells_in_order(F.col("flat"), names))
    header = F.array_join(F.transform(F.concat(F.lit(list(INDEX_CORE)), dictionary), _cell), ",")
    rows = with_stats(wide, fragments).select(line.alias("line"), F.monotonically_increasing_id().alias("place"))
    if rows.isEmpty():
        rows = results.sparkSession.range(1).select(header.alias("line"), F.lit(1).alias("place"))
    first = F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of its file
    out = F.when(first, F.concat(header, F.lit("\n"), F.col("line"))).otherwise(F.col("line"))
    rows.select(out.alias("value")).write.mode("overwrite").text(path)


def read_index(spark, path: str) -> DataFrame:
    """An index written by ``write_index``, all columns as text."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    return reader.csv(path).fillna("")


def write_actions(actions: DataFrame, path: str) -> None:
    """Bulk actions, one JSON object per line."""
    actions.select(F.to_json(F.struct(*actions.columns)).alias("value")).write.mode(
        "overwrite"
    ).text(path)


def write_points(points: DataFrame, path: str, counts: Observation | None = None) -> None:
    """Vector points, one JSON object per line, the payload as a nested object.

    With the ``counts`` of ``exports.checked_points`` a mismatch is an error once the points
    are written; ``exports.vector_mismatch`` names the ids.
    """
    fields = [
        F.parse_json("payload").alias("payload") if c == "payload" else F.col(c)
        for c in points.columns
    ]
    points.select(F.to_json(F.struct(*fields)).alias("value")).write.mode("overwrite").text(path)
    found = {name: n for name, n in counts.get.items() if n} if counts is not None else {}
    if found:
        raise ValueError(f"vectors length mismatch: {found}")


def write_payloads(payloads: DataFrame, path: str) -> None:
    """Vector payloads, one JSON object per line."""
    payloads.select(payload_object(payloads).alias("value")).write.mode("overwrite").text(path)


def write_report(lines: DataFrame, path: str, partitions: int | None = None) -> None:
    """The text report, ranged by resource so that files and their lines are in order.

    The lines of a resource are in one file, which begins with a rule.  The ranges are found
    from the lines as written, so that what makes them runs once.
    """
    kept = materialize(lines, "report-lines")
    ranges = [partitions] if partitions else []
    ranged = kept.repartitionByRange(*ranges, "resource_id")
    order = ["resource_id", "part", "line_no"]
    ranged.sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a written report, one row each, without the rule above them.

    The reader cuts the files at the rules, so no file is held as a whole.
    """
    rule = "=" * RULE_WIDTH
    blocks = spark.read.option("lineSep", f"\n{rule}\n").text(path)
    # the rule at the start of a file has no line before it
    return blocks.select(F.regexp_replace("value", f"^{rule}\n", "").alias("block"))
