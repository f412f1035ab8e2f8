"""Search documents, bulk actions, vector payloads and points, records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quire.functions import let
from quire.functions import variant as V
from quire.functions.text import sanitize_key, stable_int_id, strip
from quire.operators import notices as N
from quire.operators.metadata import with_fragments
from quire.operators.temporal import namespaced, temporal_entries


def _metadata(notices: DataFrame) -> DataFrame:
    """Add temporal (map), metadata_flat (map) and creator_names; all inside the row."""
    t = notices.withColumns(
        {
            "creator_names": N.creator_names(),
            "_leaves": namespaced(F.col("dublincore"), F.col("extensions")),
        }
    ).withColumn("_temporal", temporal_entries(F.col("_leaves")))
    under = F.transform(
        "_temporal",
        lambda e: F.struct(
            F.concat(F.lit("temporal."), e["key"]).alias("key"), e["value"].alias("value")
        ),
    )
    plain = F.transform("_leaves", lambda e: F.struct(e["key"], e["value"]))
    return t.withColumns(
        {
            "temporal": F.map_from_entries("_temporal"),
            "metadata_flat": F.map_from_entries(F.concat(plain, under)),
        }
    ).drop("_leaves", "_temporal")


def search_documents(
    notices: DataFrame, fragments: DataFrame, include_fragments: bool = True
) -> DataFrame:
    """One document per notice for a search index."""
    out = N.with_text(_metadata(notices), fragments)
    columns = [
        "id",
        "type",
        "title",
        "text",
        "dublincore",
        "extensions",
        "temporal",
        "creator_names",
        "linked_parents",
        "metadata_flat",
    ]
    if include_fragments:
        out = with_fragments(out, fragments)
        columns.append("fragments")
    return out.select(*columns)


def bulk_actions(documents: DataFrame, index: str) -> DataFrame:
    """Index actions around search documents: _op_type, _index, _id, _source."""
    return documents.select(
        F.lit("index").alias("_op_type"),
        F.lit(index).alias("_index"),
        F.col("id").alias("_id"),
        F.struct(*documents.columns).alias("_source"),
    )


def safe_metadata(metadata_flat: Column) -> Column:
    """Flat metadata under payload-safe keys; of colliding keys the last one stays."""
    return F.transform_keys(metadata_flat, lambda k, _: sanitize_key(k))


def key_collisions(notices: DataFrame) -> DataFrame:
    """Metadata keys of a notice that end up under one safe key: id, safe_key, keys."""
    keys = F.explode(F.map_keys("metadata_flat")).alias("key")
    return (
        _metadata(notices)
        .select("id", keys)
        .withColumn("safe_key", sanitize_key(F.col("key")))
        .groupBy("id", "safe_key")
        .agg(F.sort_array(F.collect_list("key")).alias("keys"))
        .filter(F.size("keys") > 1)
    )


def vector_payloads(
    notices: DataFrame,
    fragments: DataFrame,
    include_fragments: bool = True,
    include_raw: bool = False,
) -> DataFrame:
    """Payload columns of a vector store; ``safe`` holds the keys that go to the top level."""
    out = N.with_text(_metadata(notices), fragments)
    out = out.withColumns(
        {
            "record_id": F.col("id"),
            "metadata": F.struct("dublincore", "extensions", "temporal"),
            "safe": safe_metadata(F.col("metadata_flat")),
        }
    )
    columns = [
        "id",
        "record_id",
        "type",
        "title",
        "text",
        "creator_names",
        "linked_parents",
        "metadata",
        "metadata_flat",
        "safe",
    ]
    if include_fragments:
        out = with_fragments(out, fragments)
        columns.append("fragments")
    if include_raw:
        columns.append("raw")
    return out.select(*columns)


def payload_object(payloads: DataFrame) -> Column:
    """The payload as one JSON object, safe keys beside the core fields."""
    core = [c for c in payloads.columns if c != "safe"]
    whole = F.parse_json(F.to_json(F.struct(*core), {"ignoreNullFields": "false"}))
    return F.to_json(F.map_concat(V.as_map(whole), F.col("safe")))


def vector_mismatch(notices: DataFrame, vectors: DataFrame) -> DataFrame:
    """Ids on one side only: id, missing ('vector' or 'notice')."""
    n, v = notices.select("id"), vectors.select("id")
    return n.join(v, "id", "left_anti").withColumn("missing", F.lit("vector")).unionByName(
        v.join(n, "id", "left_anti").withColumn("missing", F.lit("notice"))
    )


def vector_points(
    payloads: DataFrame,
    vectors: DataFrame | None = None,
    point_id: Column | None = None,
    check: bool = True,
) -> DataFrame:
    """Points: id, payload (JSON), vector.

    ``vectors(id, vector)`` belong to notices by id; with ``check`` every notice must have
    one vector and every vector its notice, and no id may come twice.
    """
    rows = payloads
    if vectors is not None:
        if check:
            # ids only: the texts of the payloads are not built for it
            twice = vectors.groupBy("id").count().filter("count > 1")
            wrong = vector_mismatch(payloads, vectors).unionByName(
                twice.select("id", F.lit("none, repeated").alias("missing"))
            )
            shown = [f"{r['id']} (missing: {r['missing']})" for r in wrong.limit(5).collect()]
            if shown:
                raise ValueError("vectors length mismatch: " + ", ".join(shown))
        rows = payloads.join(vectors.select("id", "vector"), "id")
    point = stable_int_id(F.col("id")) if point_id is None else point_id
    columns = [point.alias("id"), payload_object(payloads).alias("payload")]
    if vectors is not None:
        columns.append(F.col("vector"))
    return rows.select(*columns)


#: Mismatches that ``checked_points`` counts.
MISMATCHES = ("without_vector", "without_notice", "repeated")


def checked_points(
    payloads: DataFrame, vectors: DataFrame, point_id: Column | None = None
) -> tuple[DataFrame, Observation]:
    """Points of ids that have one payload and one vector, and counts of the others.

    One full outer join by id.  The counts are there when the job that writes the points has
    run (``sinks.files.write_points`` looks at them): notices without a vector, vectors without a
    notice, ids with several vectors.  Nothing is read twice for the check.
    """
    told = vectors.groupBy(F.col("id").alias("_vid")).agg(
        F.any_value("vector").alias("vector"), F.count(F.lit(1)).alias("_vectors")
    )
    both = payloads.withColumn("_own", F.lit(True)).join(told, F.col("id") == F.col("_vid"), "full")
    counts = Observation()
    wrong = (F.col("_vectors").isNull(), F.col("_own").isNull(), F.col("_vectors") > 1)
    seen = both.observe(counts, *(F.count_if(w).alias(name) for w, name in zip(wrong, MISMATCHES, strict=True)))
    fine = seen.filter(F.col("_own") & (F.col("_vectors") == 1))
    point = stable_int_id(F.col("id")) if point_id is None else point_id
    return fine.select(point.alias("id"), payload_object(payloads).alias("payload"), "vector"), counts


def _shown(v: Column) -> Column:
    """Text of a value inside an index text; a list is shown as a quoted list."""

    def quoted(x: Column) -> Column:
        text = V.plain_text(x)
        mark = F.when(F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"')), '"').otherwise("'")
        return F.when(V.is_string(x), F.concat(mark, text, mark)).otherwise(
            F.coalesce(text, F.lit("None"))
        )

    listed = F.concat(F.lit("["), F.array_join(F.transform(V.as_array(v), quoted), ", "), F.lit("]"))
    return F.coalesce(listed, V.plain_text(v))


def index_payloads(
    notices: DataFrame,
    dublincore_fields: Sequence[str] = (),
    extension_fields: Sequence[str] = (),
    include_index_text: bool = True,
) -> DataFrame:
    """Chosen fields (none by default) as maps, temporal entries, creators, index text."""

    def chosen(namespace: str, fields: Sequence[str]) -> Column:
        pairs = [
            F.struct(
                F.lit(f).alias("key"),
                V.present(V.get_path(F.col(namespace), f, "variant")).alias("value"),
            )
            for f in fields
        ]
        if not pairs:
            return F.create_map().cast("map<string,variant>")
        return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))

    t = _metadata(notices).withColumns(
        {
            "dc": chosen("dublincore", dublincore_fields),
            "ex": chosen("extensions", extension_fields),
        }
    )
    columns = [
        "id",
        "type",
        "title",
        F.col("dc").alias("dublincore"),
        F.col("ex").alias("extensions"),
        "temporal",
        "creator_names",
    ]
    if include_index_text:

        def part(field: str) -> Column:
            return let(V.truthy(F.try_element_at("dc", F.lit(field))), _shown)

        names = F.array_join("creator_names", " ")
        parts = [F.col("title"), part("title"), part("creator"), part("source"), names]
        text = F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])
        columns.append(strip(text).alias("index_text"))
    return t.select(*columns)


def records(rows: DataFrame, column_map: Mapping[str, str] | None = None) -> DataFrame:
    """Flat rows with only the mapped columns under their new names; no map keeps all."""
    if not column_map:
        return rows
    have = set(rows.columns)
    return rows.select(
        *[F.col(f"`{old}`").alias(new) for old, new in column_map.items() if old in have]
    )


def fragment_records(notices: DataFrame, fragments: DataFrame) -> DataFrame:
    """One record per fragment with text; the index in the key counts the blank ones too."""
    body = strip(F.coalesce("content", F.lit("")))
    kept = fragments.withColumn("text", body).filter("text <> ''")
    owner = notices.select(
        F.col("id").alias("resource_id"), "title", "dublincore", "extensions", "linked_parents"
    )
    return kept.join(owner, "resource_id").select(
        F.concat("resource_id", F.lit("__frag_"), F.col("position").cast("string")).alias("key"),
        F.col("resource_id").alias("record_id"),
        "id",
        "title",
        "head",
        "breadcrumb",
        "text",
        F.struct("dublincore", "extensions").alias("metadata"),
        "linked_parents",
    )
