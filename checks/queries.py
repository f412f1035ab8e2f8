"""Registered queries: what runs on Spark, and the SQL that must give the same rows."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import corpora as C
from checks import oracles as O
from quire.functions import text as T
from quire.functions import variant as V
from quire.functions.dates import year_bounds, year_end_iso, year_start_iso
from quire.operators import exports as X
from quire.operators import fragments as FR
from quire.operators import metadata as M
from quire.operators import navigation as N
from quire.operators import notices as NO
from quire.operators import reports as R
from quire.operators import requestlog as L
from quire.operators import shred as S
from quire.operators import temporal as TM
from quire.operators import validate as VA
from quire.operators import walk as W
from quire.plans import corpus as PL
from quire.session import checkpoint_root, materialize
from quire.sinks import files as SF
from quire.sources import payloads as P
from quire.sources import results as SR

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its SQL when there is one."""

    def register(fn: Query) -> Query:
        name = fn.__name__
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# list cells of the index, with a blank after each comma and colon
SPACED = """replace(replace(replace(replace(replace(value, '","', '", "'), ',"', ', "'),
  '":', '": '), ',7', ', 7'), ',{', ', {')"""


def scratch(spark: SparkSession, label: str) -> str:
    """New folder below the shared checkpoint folder for a table a query writes."""
    import uuid

    return f"{checkpoint_root(spark)}/quire-checks/{label}-{uuid.uuid4().hex}"


def cut(spark: SparkSession, sf: str) -> S.Shred:
    return S.shred(C.tei(spark, sf), clustered=True)


def described(spark: SparkSession, sf: str) -> DataFrame:
    return P.objects(C.descriptions(spark, sf))


def results(spark: SparkSession, sf: str, dc=None, ext=None) -> DataFrame:
    """Resource results of all documents, with their source as the one parent."""
    linked = described(spark, sf).withColumn("linked_parents", F.array(F.lit("root")))
    return M.resource_results(linked, dc, ext)


def notices(spark: SparkSession, sf: str) -> DataFrame:
    return NO.from_results(results(spark, sf))


def whole(spark: SparkSession, sf: str) -> DataFrame:
    return FR.document_fragments(cut(spark, sf).tokens)


def by_navigation(spark: SparkSession, sf: str) -> DataFrame:
    """Routed fragments in auto mode."""
    return FR.split(C.tei(spark, sf), C.resource_depths(spark, sf), C.navigation(spark, sf)).fragments


# ------------------------------------------------------------------------ sources


@query(
    """SELECT CAST(event_id AS VARCHAR) AS request_id,
      CASE event_id % 11 WHEN 1 THEN 'not an object' WHEN 2 THEN 'not JSON' WHEN 3 THEN 'empty body'
        WHEN 4 THEN 'not an object' WHEN 5 THEN 'not an object' ELSE 'accepted' END AS verdict,
      CASE WHEN event_id % 11 IN (1, 2, 3, 4, 5) THEN NULL
        ELSE CAST(regexp_extract(props, '\\d+') AS BIGINT) END AS k
    FROM events"""
)
def payload_accept(spark: SparkSession, sf: str) -> DataFrame:
    split = P.accept(C.event_payloads(spark, sf))
    good = split.accepted.select(
        "request_id",
        F.lit("accepted").alias("verdict"),
        V.get(F.col("raw"), "k", type="bigint").alias("k"),
    )
    bad = split.rejected.select(
        "request_id", F.col("reason").alias("verdict"), F.lit(None).cast("bigint").alias("k")
    )
    return good.unionByName(bad)


@query(
    """WITH e AS (SELECT doc_id, unnest(range(1, 11)) AS j FROM documents)
    SELECT 'C' || doc_id AS parent_id, CAST(j - 1 AS BIGINT) AS pos, 'C' || (doc_id * 10 + j) AS child_id,
           'Collection' AS child_type, 'Group ' || (doc_id * 10 + j) AS child_title FROM e
    UNION ALL SELECT 'C' || doc_id, 10, 'D' || doc_id, 'Resource', NULL FROM documents"""
)
def member_edges(spark: SparkSession, sf: str) -> DataFrame:
    edges = P.member_edges(P.objects(C.tree_payloads(spark, sf)))
    return edges.select(
        "parent_id", F.col("pos").cast("bigint").alias("pos"), "child_id", "child_type", "child_title"
    )


@query(
    """SELECT 'D' || doc_id AS request_id, CASE doc_id % 3 WHEN 0 THEN 'lang:' || lang || '|src:' || source
      WHEN 1 THEN '' ELSE NULL END AS parents FROM documents"""
)
def parents_scan(spark: SparkSession, sf: str) -> DataFrame:
    told = P.parents(C.parents(spark, sf))
    return told.select("request_id", F.array_join("parents", "|").alias("parents"))


# --------------------------------------------------------------------------- walk


@query(
    f"""WITH RECURSIVE {O.GEO} {O.reach("edges")}
    SELECT f.id AS object_id, CAST(f.depth AS BIGINT) AS depth, f.found_by,
      CASE WHEN o.id IS NULL THEN 'missing' WHEN o.type = 'Resource' THEN 'resource' ELSE 'collection' END AS kind,
      o.title FROM found f LEFT JOIN objects o ON o.id = f.id"""
)
def walk_geo(spark: SparkSession, sf: str) -> DataFrame:
    objects, edges = C.geo(spark, sf)
    return _walked(W.walk(objects, edges, "W"))


def _walked(walked: W.Walk) -> DataFrame:
    def part(df: DataFrame, kind: str) -> DataFrame:
        title = F.col("title") if "title" in df.columns else F.lit(None).cast("string")
        return df.select(
            "object_id",
            F.col("depth").cast("bigint").alias("depth"),
            "found_by",
            F.lit(kind).alias("kind"),
            title.alias("title"),
        )

    return (
        part(walked.collections, "collection")
        .unionByName(part(walked.resources, "resource"))
        .unionByName(part(walked.missing, "missing"))
    )


@query(
    f"""WITH RECURSIVE {O.GEO}
    kept AS (SELECT * FROM edges WHERE child_id NOT IN ('R1', 'N3', 'N8', 'C5')), {O.reach("kept")}
    SELECT f.id AS object_id, CAST(f.depth AS BIGINT) AS depth, f.found_by,
      CASE WHEN o.id IS NULL THEN 'missing' WHEN o.type = 'Resource' THEN 'resource' ELSE 'collection' END AS kind,
      o.title FROM found f LEFT JOIN objects o ON o.id = f.id"""
)
def walk_excluded(spark: SparkSession, sf: str) -> DataFrame:
    objects, edges = C.geo(spark, sf)
    return _walked(W.walk(objects, edges, "W", ["R1", "N3", "N8", "C5"]))


@query(
    f"""WITH RECURSIVE {O.SUPPLY} {O.reach("edges")}
    SELECT id AS object_id, CAST(depth AS BIGINT) AS depth, found_by FROM found"""
)
def walk_multi_parent(spark: SparkSession, sf: str) -> DataFrame:
    reached = W.reach(C.supply_edges(spark, sf), "W")
    return reached.select("object_id", F.col("depth").cast("bigint").alias("depth"), "found_by")


@query(
    """SELECT 'D' || doc_id AS object_id,
      CASE doc_id % 3 WHEN 0 THEN 'lang:' || lang || '|src:' || source WHEN 1 THEN '' ELSE 'src:' || source END AS fetched,
      'src:' || source AS kept FROM documents"""
)
def linked_parents(spark: SparkSession, sf: str) -> DataFrame:
    found = C.documents(spark, sf).select(
        F.col("rid").alias("object_id"),
        F.expr("concat(' src:', source, ' ')").alias("found_by"),
    )
    told = P.parents(C.parents(spark, sf))
    on = W.link_parents(found, told).select(
        "object_id", F.array_join("linked_parents", "|").alias("fetched")
    )
    off = W.link_parents(found, told, fetch=False).select(
        "object_id", F.array_join("linked_parents", "|").alias("kept")
    )
    return on.join(off, "object_id")


# ----------------------------------------------------------------------- metadata


@query(
    f"""WITH {O.META} one AS (SELECT 1)
    SELECT rid AS id, has_dc AND doc_id % 4 IN (1, 2) AS has_creator,
      CASE WHEN has_dc THEN lang || ' ' || source || ' ' || doc_id END AS title,
      CASE WHEN has_dc THEN n_chars END AS deep,
      CASE WHEN has_dc THEN 3 + CAST(doc_id % 4 <> 0 AS BIGINT) ELSE 0 END AS dc_keys,
      '-50/20?' AS coverage, CAST(2 AS BIGINT) AS ext_keys FROM d"""
)
def meta_pick(spark: SparkSession, sf: str) -> DataFrame:
    """Chosen paths, nested and missing ones included, keep their nesting."""
    kept = results(
        spark,
        sf,
        ["title", "creator", "date", "deep.a.b", "deep.a.z", "note", "absent.x"],
        ["dct:coverage", "rank"],
    )
    dc, ext = F.col("dublincore"), F.col("extensions")
    creator = F.coalesce(F.size(F.split(V.get(dc, "creator"), "Author")) > 1, F.lit(False))
    return kept.select(
        "id",
        creator.alias("has_creator"),
        V.get(dc, "title").alias("title"),
        V.get_path(dc, "deep.a.b", "bigint").alias("deep"),
        F.coalesce(F.size(V.as_map(dc)), F.lit(0)).cast("bigint").alias("dc_keys"),
        V.get(ext, "dct:coverage").alias("coverage"),
        F.size(V.as_map(ext)).cast("bigint").alias("ext_keys"),
    )


@query(
    """SELECT 'D' || doc_id AS id, doc_id % 8 <> 7 AS has_dc,
      CASE WHEN doc_id % 8 <> 7 THEN lang || ' ' || source || ' ' || doc_id END AS title,
      CASE WHEN doc_id % 8 = 6 THEN 'other' ELSE lang || ' ' || source || ' ' || doc_id END AS raw_title
    FROM documents"""
)
def meta_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """Key spelling: presence decides for results, content decides for raw objects."""
    kept = results(spark, sf).select(
        "id",
        F.col("dublincore").isNotNull().alias("has_dc"),
        V.get(F.col("dublincore"), "title").alias("title"),
    )
    raw = NO.from_objects(described(spark, sf)).select(
        "id", V.get(F.col("dublincore"), "title").alias("raw_title")
    )
    return kept.join(raw, "id")


@query(
    f"""WITH {O.META} one AS (SELECT 1)
    SELECT rid AS id, CASE WHEN has_dc THEN 'all' ELSE 'none' END AS dc_all, 'none' AS dc_none, 'all' AS ext_all FROM d"""
)
def meta_build(spark: SparkSession, sf: str) -> DataFrame:
    """No list keeps everything, an empty list nothing."""
    kept = results(spark, sf, None, None)
    none = results(spark, sf, [], [])

    def state(c: str):
        return F.when(F.col(c).isNotNull(), "all").otherwise("none")

    return kept.select("id", state("dublincore").alias("dc_all"), state("extensions").alias("ext_all")).join(
        none.select("id", state("dublincore").alias("dc_none")), "id"
    )


@query(
    f"""WITH {O.META} one AS (SELECT 1)
    SELECT rid AS id, CASE WHEN has_dc AND doc_id % 4 = 1 THEN 'Author ' || n
        WHEN has_dc AND doc_id % 4 = 2 THEN '["Author ' || n || '","Second"]' ELSE '?' END AS dc_creator,
      CASE WHEN has_dc AND doc_id % 4 <> 0 THEN CASE doc_id % 4 WHEN 1 THEN 'Author ' || n
        WHEN 2 THEN '["Author ' || n || '","Second"]' ELSE '' END ELSE '?' END AS meta_creator,
      CASE WHEN doc_id % 7 = 0 THEN '9' ELSE CAST(doc_id % 7 AS VARCHAR) END AS ext_rank,
      '?' AS note FROM d"""
)
def meta_get(spark: SparkSession, sf: str) -> DataFrame:
    """Accessors with defaults: empty counts as missing for dc and ext, not for meta."""
    return notices(spark, sf).select(
        "id",
        NO.dc("creator", "?").cast("string").alias("dc_creator"),
        NO.meta("creator", "?").cast("string").alias("meta_creator"),
        NO.ext("rank", 9).cast("string").alias("ext_rank"),
        NO.meta("note", "?").cast("string").alias("note"),
    )


@query(
    f"""WITH {O.META} one AS (SELECT 1) SELECT rid AS id, key, value FROM flat"""
)
def meta_flat(spark: SparkSession, sf: str) -> DataFrame:
    return M.flat_entries(results(spark, sf))


@query(
    f"""WITH {O.META} one AS (SELECT 1)
    SELECT rid AS id, key, CASE WHEN key = 'extensions.open' THEN 'True'
      WHEN value LIKE '[%' THEN {SPACED}
      ELSE coalesce(value, '') END AS cell FROM flat"""
)
def meta_flat_csv(spark: SparkSession, sf: str) -> DataFrame:
    flat = F.map_concat(
        V.flat_map(F.col("dublincore"), "dublincore.", V.csv_text),
        V.flat_map(F.col("extensions"), "extensions.", V.csv_text),
    )
    return results(spark, sf).select("id", F.explode(flat).alias("key", "cell"))


@query(
    f"""WITH {O.META} one AS (SELECT 1)
    SELECT rid AS id, replace(replace(replace(replace(key, '.', '__'), ':', '__'), '-', '_'), '@', '') AS safe_key,
      value FROM flat"""
)
def payload_keys(spark: SparkSession, sf: str) -> DataFrame:
    flat = F.map_concat(
        V.flat_map(F.col("dublincore"), "dublincore."), V.flat_map(F.col("extensions"), "extensions.")
    )
    return results(spark, sf).select(
        "id", F.explode(X.safe_metadata(flat)).alias("safe_key", "value")
    )


@query(
    """SELECT 'C' || doc_id AS id, 'Collection' AS type, 'Group ' || doc_id AS title, 'up' AS linked_parents,
      'Group ' || doc_id AS dc_title, CAST(1 AS BIGINT) AS dc_keys, CAST(13 AS BIGINT) AS members,
      'C' || (doc_id * 10 + 1) AS first_member, 'D' || doc_id AS resource_member,
      'no id' AS last_title FROM documents"""
)
def collection_results(spark: SparkSession, sf: str) -> DataFrame:
    groups = P.objects(C.tree_payloads(spark, sf)).filter("type <> 'Resource'")
    rows = M.collection_results(
        groups.withColumn("linked_parents", F.array(F.lit("up"))), ["title"], []
    )
    return rows.select(
        "id",
        "type",
        "title",
        F.array_join("linked_parents", "|").alias("linked_parents"),
        V.get(F.col("dublincore"), "title").alias("dc_title"),
        F.size(V.as_map(F.col("dublincore"))).cast("bigint").alias("dc_keys"),
        F.size("member").cast("bigint").alias("members"),
        F.col("member")[0]["id"].alias("first_member"),
        F.col("member")[10]["id"].alias("resource_member"),
        F.col("member")[12]["title"].alias("last_title"),
    )


@query(
    f"""WITH {O.DIVS} counts AS (SELECT rid, count(*) AS n FROM divs GROUP BY rid)
    SELECT c.rid AS id, 'Resource' AS type, 'T' || doc_id AS title, 'root' AS linked_parents,
      CASE WHEN doc_id % 8 <> 7 THEN lang || ' ' || source || ' ' || doc_id END AS dc_title,
      CASE WHEN {O.GOOD} THEN CAST(1 AS BIGINT) ELSE 0 END AS fragments
    FROM docs d JOIN counts c USING (rid)"""
)
def resource_results(spark: SparkSession, sf: str) -> DataFrame:
    """Results with their nested fragments (whole documents here)."""
    rows = M.with_fragments(results(spark, sf), whole(spark, sf))
    return rows.select(
        "id",
        "type",
        "title",
        F.array_join("linked_parents", "|").alias("linked_parents"),
        V.get(F.col("dublincore"), "title").alias("dc_title"),
        F.size("fragments").cast("bigint").alias("fragments"),
    )


@query(
    f"""WITH {O.MEMBERS} one AS (SELECT 1)
    SELECT rid AS resource_id, CAST(k AS BIGINT) AS pos, 'd' || k AS member_id, parent_id, parent, title,
      CASE WHEN k % 7 = 6 THEN '2' ELSE '1' END AS level, CASE WHEN k % 2 = 0 THEN 'section' END AS cite_type
    FROM members WHERE doc_id % 10 <> 9
    UNION ALL SELECT rid, max(k) + 1, 'ghost', NULL, NULL, 'Ghost', '1', NULL FROM members
      WHERE doc_id % 10 <> 9 GROUP BY rid"""
)
def nav_fields(spark: SparkSession, sf: str) -> DataFrame:
    rows = N.members(C.navigation(spark, sf))
    return rows.select(
        "resource_id",
        F.col("pos").cast("bigint").alias("pos"),
        "member_id",
        "parent_id",
        "parent",
        "title",
        "level",
        "cite_type",
    )


@query(
    """SELECT 'D' || doc_id AS resource_id, CAST(CASE doc_id % 10 WHEN 8 THEN 0 WHEN 7 THEN 1 ELSE 2 END AS BIGINT)
      AS nav_depth FROM documents WHERE doc_id % 10 <> 9"""
)
def cite_depth(spark: SparkSession, sf: str) -> DataFrame:
    rows = N.depths(C.navigation(spark, sf))
    return rows.select("resource_id", F.col("nav_depth").cast("bigint").alias("nav_depth"))


@query(
    f"""WITH {O.MEMBERS} one AS (SELECT 1)
    SELECT rid AS resource_id, CAST(k AS BIGINT) AS pos,
      CASE k % 4 WHEN 1 THEN 'Part ' || k WHEN 3 THEN 'Other ' || k END AS title_of_all,
      CASE WHEN k % 4 = 1 THEN source END AS subject,
      CAST(CASE WHEN k % 4 = 1 THEN 1 ELSE 0 END AS BIGINT) AS kept, true AS none
    FROM members WHERE doc_id % 10 <> 9
    UNION ALL SELECT rid, max(k) + 1, NULL, NULL, 0, true FROM members WHERE doc_id % 10 <> 9 GROUP BY rid"""
)
def frag_meta(spark: SparkSession, sf: str) -> DataFrame:
    """Fragment metadata: everything, chosen keys, nothing."""
    rows = N.members(C.navigation(spark, sf))
    dc = F.col("dublin_core")
    picked = FR.filtered_metadata(dc, ["subject"])
    return rows.select(
        "resource_id",
        F.col("pos").cast("bigint").alias("pos"),
        V.get(FR.filtered_metadata(dc, None), "title").alias("title_of_all"),
        V.get(picked, "subject").alias("subject"),
        F.size(V.as_map(picked)).cast("bigint").alias("kept"),
        FR.filtered_metadata(dc, []).isNull().alias("none"),
    )


# ----------------------------------------------------------------------- temporal


@query(
    f"""WITH v AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN CAST(n_chars AS VARCHAR) WHEN 1 THEN '1200/' || n_chars
        WHEN 2 THEN '-50/20?' WHEN 3 THEN ' 987~ ' WHEN 4 THEN '/1499' WHEN 5 THEN '2021-05-01' WHEN 6 THEN '7/'
        WHEN 7 THEN '' ELSE '-3?' END AS v FROM documents),
    y AS (SELECT doc_id, v, nullif(regexp_extract(trim(v), '{O.YEARS}', 1), '') AS a,
      CASE WHEN v LIKE '%/%' THEN nullif(regexp_extract(trim(v), '{O.YEARS}', 4), '')
           ELSE nullif(regexp_extract(trim(v), '{O.YEARS}', 1), '') END AS b FROM v)
    SELECT 'D' || doc_id AS id, v AS value, CAST(a AS BIGINT) AS y_start, CAST(b AS BIGINT) AS y_end,
      CASE WHEN CAST(a AS BIGINT) >= 0 THEN lpad(a, 4, '0') || '-01-01' ELSE CAST(CAST(a AS BIGINT) AS VARCHAR) END AS iso_start,
      CASE WHEN CAST(b AS BIGINT) >= 0 THEN lpad(b, 4, '0') || '-12-31' ELSE CAST(CAST(b AS BIGINT) AS VARCHAR) END AS iso_end
    FROM y"""
)
def year_edges(spark: SparkSession, sf: str) -> DataFrame:
    v = F.expr(
        "case doc_id % 9 when 0 then string(n_chars) when 1 then concat('1200/', n_chars) "
        "when 2 then '-50/20?' when 3 then ' 987~ ' when 4 then '/1499' when 5 then '2021-05-01' "
        "when 6 then '7/' when 7 then '' else '-3?' end"
    )
    rows = C.documents(spark, sf).select(F.col("rid").alias("id"), v.alias("value"))
    b = year_bounds(F.col("value"))
    return rows.select(
        "id",
        "value",
        b["start"].alias("y_start"),
        b["end"].alias("y_end"),
        year_start_iso(b["start"]).alias("iso_start"),
        year_end_iso(b["end"]).alias("iso_end"),
    )


@query(
    f"""WITH {O.META} {O.temporal(O.DATED, "t")}
    SELECT rid AS id, key, value FROM t"""
)
def temporal_long(spark: SparkSession, sf: str) -> DataFrame:
    return TM.temporal_long(notices(spark, sf))


@query(
    f"""WITH {O.META} {O.temporal("(SELECT rid, 'date' AS key, value FROM dc WHERE key = 'dublincore.date')", "t")},
    parsed AS (SELECT rid FROM t WHERE key = 'date_start')
    SELECT rid AS id, key, value FROM t WHERE rid IN (SELECT rid FROM parsed)"""
)
def temporal_short(spark: SparkSession, sf: str) -> DataFrame:
    """Dublin Core only, without prefix, values that do not parse left out."""
    return TM.temporal_long(notices(spark, sf), short=True, include_unparsed=False)


# ---------------------------------------------------------------------- fragments


@query(
    f"""WITH {O.DIVS} per AS (
      SELECT rid, unnest(['div', 'head', 'note', 'TEI', 'teiHeader', 'fileDesc', 'title', 'text', 'body']) AS name,
        unnest([count(*), count(*) + 1, count(*), 1, 1, 1, 1, 1, 1]) AS n,
        unnest([count(*), 0, 0, 1, 0, 0, 0, 0, 0]) AS ids,
        unnest([CASE WHEN max(k) >= 6 THEN 5 ELSE 4 END, CASE WHEN max(k) >= 6 THEN 6 ELSE 5 END,
                CASE WHEN max(k) >= 6 THEN 6 ELSE 5 END, 1, 2, 3, 4, 2, 3]) AS deepest
      FROM divs WHERE {O.GOOD} GROUP BY rid
      UNION ALL SELECT rid, 'p', count(*), 0, CASE WHEN max(i) >= 30 THEN 6 ELSE 5 END FROM lines WHERE {O.GOOD} GROUP BY rid
      UNION ALL SELECT rid, unnest(['hi', 'lb']), count(*), 0,
        CASE WHEN max(i) FILTER (i // 5 % 7 = 6) IS NOT NULL THEN 7 ELSE 6 END
        FROM lines WHERE {O.GOOD} AND i % 5 IN (1, 3) GROUP BY rid)
    SELECT rid AS resource_id, name, CAST(n AS BIGINT) AS n, CAST(ids AS BIGINT) AS ids, CAST(deepest AS BIGINT) AS deepest FROM per"""
)
def xml_nodes(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.nodes(cut(spark, sf).tokens).filter("tei and end_pos >= pos")
    return rows.groupBy("resource_id", "name").agg(
        F.count("*").alias("n"),
        F.count("xml_id").alias("ids"),
        F.max("depth").cast("bigint").alias("deepest"),
    )


@query(
    """SELECT 'D' || doc_id AS resource_id, 'unmatched closing tag' AS reason FROM documents WHERE doc_id % 11 = 5"""
)
def xml_bad(spark: SparkSession, sf: str) -> DataFrame:
    return cut(spark, sf).quarantine


PAGE_ITEM = (
    r"""(?:<!\[CDATA\[(?s:.*?)\]\]>|<\?(?s:.*?)\?>|<!DOCTYPE[^\[>]*(?:\[[^\]]*\])?[^>]*>"""
    r"""|<[^<"''>]*(?:(?:"[^"]*"|''[^'']*'')[^<"''>]*)*>)[^<]*|<|[^<]+"""
)


@query(
    f"""SELECT 'W' || page_id AS resource_id, CAST(len(regexp_extract_all(html, '{PAGE_ITEM}')) AS BIGINT) AS items,
      CAST(length(html) AS BIGINT) AS characters FROM pages"""
)
def page_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """The cut into markup rows loses nothing, on real web pages."""
    rows = S.items(C.page_documents(spark, sf))
    return rows.groupBy("resource_id").agg(
        F.count("*").alias("items"), F.sum(F.char_length("item")).cast("bigint").alias("characters")
    )


@query(
    """SELECT 'D' || doc_id AS id, repeat('k.', CAST(6 + doc_id % 12 AS INT)) || 'doc' AS key,
      CAST(doc_id AS VARCHAR) AS value FROM documents"""
)
def meta_deep(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata of 7 to 18 levels."""
    levels = "cast(6 + doc_id % 12 as int)"
    deep = F.expr(
        f"concat(repeat('{{\"k\":', {levels}), '{{\"doc\":', doc_id, ',\"none\":{{}}}}', repeat('}}', {levels}))"
    )
    docs = C.table(spark, sf, "documents").select(F.expr("concat('D', doc_id)").alias("id"), deep.alias("j"))
    leaves = docs.select("id", F.explode(V.flatten(V.parse(F.col("j")))).alias("e"))
    return leaves.select("id", F.col("e.key").alias("key"), V.leaf_text(F.col("e.value")).alias("value"))


@query(
    """SELECT 'D' || doc_id AS resource_id, CAST(4 + 2 * (doc_id % 40) AS BIGINT) AS elements,
      CAST(2 + 2 * ((1 + doc_id % 40) // 3) AS BIGINT) AS tei_elements, 'A' AS text FROM documents"""
)
def xml_scopes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in which each paragraph declares a default namespace, and a reference of 14 digits."""
    uris = f"array('{S.TEI_NAMESPACE}', 'http://other.example/', '')"
    paragraphs = f"""array_join(transform(sequence(1, cast(1 + doc_id % 40 as int)),
      i -> concat('<p xmlns="', get({uris}, i % 3), '"><q/></p>')), '')"""
    xml = F.expr(
        f"""concat('<t xmlns="{S.TEI_NAMESPACE}">', {paragraphs}, '<s>&#00000000000065;</s></t>')"""
    )
    docs = C.documents(spark, sf).select(F.col("rid").alias("resource_id"), xml.alias("xml"))
    rows = S.shred(docs, clustered=True).tokens
    opening = F.col("kind").isin("open", "empty")
    return rows.groupBy("resource_id").agg(
        F.count_if(opening).alias("elements"),
        F.count_if(opening & F.col("tei")).alias("tei_elements"),
        F.max("text").alias("text"),
    )


@query("SELECT 'D' || doc_id AS resource_id, 'more than one document' AS reason FROM documents WHERE doc_id % 7 = 0")
def documents_again(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of which some have landed twice under one id."""
    docs = C.table(spark, sf, "documents")
    xml = docs.select(F.expr("concat('D', doc_id)").alias("resource_id"), F.lit("<a>x</a>").alias("xml"), "doc_id")
    again = xml.filter("doc_id % 7 = 0").withColumn("xml", F.lit("<b>y</b>"))
    return S.shred(xml.unionByName(again)).quarantine


@query("SELECT 'D' || doc_id AS request_id, 'T' || (doc_id % 4) AS title FROM documents")
def payloads_again(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads that landed one to four times; the last one counts."""
    docs = C.table(spark, sf, "documents")
    landed = docs.select(
        F.expr("concat('D', doc_id)").alias("request_id"),
        F.explode(F.expr("sequence(0, cast(doc_id % 4 as int))")).alias("landed_at"),
    ).withColumn("payload", F.to_json(F.struct(F.concat(F.lit("T"), F.col("landed_at").cast("string")).alias("title"))))
    return P.objects(P.one_each(landed, "request_id", "payload")).select("request_id", "title")


@query(
    """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'X' ELSE 'D' END || doc_id AS own FROM documents)
    SELECT 'W' AS object_id, CAST(0 AS BIGINT) AS depth, NULL AS found_by, 'collection' AS kind
    UNION ALL SELECT own, 1, 'W', 'collection' FROM d
    UNION ALL SELECT 'S' || (doc_id // 2), 2, arg_min(own, 'M' || doc_id), 'resource' FROM d WHERE doc_id % 5 <> 0 GROUP BY 1
    UNION ALL SELECT 'M' || doc_id, 2, own, 'missing' FROM d WHERE doc_id % 5 = 0"""
)
def walk_renamed(spark: SparkSession, sf: str) -> DataFrame:
    """Collections that answer under another id than asked for, resources that answer to two."""
    own = F.expr("concat(if(doc_id % 3 = 0, 'X', 'D'), doc_id)")
    docs = C.table(spark, sf, "documents").select("doc_id", own.alias("own"))
    collections = docs.select(
        F.expr("concat('D', doc_id)").alias("request_id"), F.col("own").alias("object_id"), F.lit("Collection").alias("type")
    )
    resources = docs.filter("doc_id % 5 != 0").selectExpr(
        "concat('M', doc_id) AS request_id", "concat('S', doc_id div 2) AS object_id", "'Resource' AS type"
    )
    root = spark.range(1).selectExpr("'W' AS request_id", "'W' AS object_id", "'Collection' AS type")
    top = docs.selectExpr("'W' AS request_id", "'W' AS parent_id", "0 AS pos", "concat('D', doc_id) AS child_id")
    below = docs.selectExpr("concat('D', doc_id) AS request_id", "own AS parent_id", "0 AS pos", "concat('M', doc_id) AS child_id")
    walked = W.walk(root.unionByName(collections).unionByName(resources), top.unionByName(below), "W")

    def shown(df: DataFrame, kind: str) -> DataFrame:
        return df.select("object_id", F.col("depth").cast("bigint").alias("depth"), "found_by", F.lit(kind).alias("kind"))

    return (
        shown(walked.collections, "collection")
        .unionByName(shown(walked.resources, "resource"))
        .unionByName(shown(walked.missing, "missing"))
    )


FRAG = ["resource_id", "position", "id", "head", "content", "breadcrumb", "level", "cite_type", "parent"]


def _frag(df: DataFrame, columns: list[str] = FRAG) -> DataFrame:
    return df.select(
        *[F.col(c).cast("bigint").alias(c) if c in ("position", "fragment_index") else F.col(c) for c in columns]
    )


@query(
    f"""WITH {O.DIVS} {O.DOC_TEXT}
    SELECT rid AS resource_id, '__DOCUMENT__' AS id, {O.ws("with_heads")} AS content, '' AS breadcrumb
    FROM doc_text WHERE {O.GOOD}"""
)
def frag_document(spark: SparkSession, sf: str) -> DataFrame:
    return _frag(whole(spark, sf), ["resource_id", "id", "content", "breadcrumb"])


@query(
    f"""WITH {O.DIVS} {O.DOC_TEXT}
    SELECT rid AS resource_id, '__DOCUMENT__' AS id, {O.ws("without_heads")} AS content, NULL AS breadcrumb
    FROM doc_text WHERE {O.GOOD}"""
)
def frag_document_noheads(spark: SparkSession, sf: str) -> DataFrame:
    rows = FR.document_fragments(cut(spark, sf).tokens, False, False)
    return _frag(rows, ["resource_id", "id", "content", "breadcrumb"])


@query(
    f"""WITH {O.MEMBERS} one AS (SELECT 1)
    SELECT rid AS resource_id, CAST(k AS BIGINT) AS position, 'd' || k AS id, title AS head, {O.ws("own")} AS content,
      breadcrumb, CASE WHEN k % 7 = 6 THEN '2' ELSE '1' END AS level,
      CASE WHEN k % 2 = 0 THEN 'section' END AS cite_type, parent
    FROM crumbs WHERE {O.GOOD} AND doc_id % 10 <> 9"""
)
def frag_nav(spark: SparkSession, sf: str) -> DataFrame:
    rows = FR.navigation_fragments(cut(spark, sf).tokens, N.members(C.navigation(spark, sf), breadcrumbs=True))
    return _frag(rows)


@query(
    f"""WITH {O.MEMBERS} one AS (SELECT 1)
    SELECT rid AS resource_id, 'd' || k AS id, title AS head, {O.strip_head("own", "title")} AS content
    FROM crumbs WHERE {O.GOOD} AND doc_id % 10 <> 9"""
)
def frag_nav_stripped(spark: SparkSession, sf: str) -> DataFrame:
    rows = FR.navigation_fragments(
        cut(spark, sf).tokens,
        N.members(C.navigation(spark, sf)),
        add_head_to_content=False,
        include_breadcrumb=False,
    )
    return _frag(rows, ["resource_id", "id", "head", "content"])


@query(
    f"""WITH {O.MEMBERS} kept AS (SELECT * FROM crumbs WHERE {O.GOOD} AND doc_id % 10 <> 9
      AND NOT coalesce(contains(strip_accents(lower({O.ws("title")})), 'part 1')
                    OR contains(strip_accents(lower({O.ws("title")})), 'el'), false))
    SELECT rid AS resource_id, row_number() OVER (PARTITION BY rid ORDER BY k) - 1 AS position, 'd' || k AS id,
      title AS head, {O.ws("own")} AS content, breadcrumb FROM kept"""
)
def frag_heads(spark: SparkSession, sf: str) -> DataFrame:
    """Exclusion by folded heads; breadcrumbs and texts do not change by it."""
    rows = FR.navigation_fragments(
        cut(spark, sf).tokens,
        N.members(C.navigation(spark, sf), breadcrumbs=True),
        exclude_heads_contains=["  PÀRT   1 ", "Él", ""],
    )
    return _frag(rows, ["resource_id", "position", "id", "head", "content", "breadcrumb"])


@query(
    f"""WITH {O.DIVS}
    joined AS (SELECT o.*, CASE WHEN i.rid IS NULL THEN '' ELSE i.own || ' tail' || i.k || ' ' END AS nested
      FROM divs o LEFT JOIN divs i ON i.rid = o.rid AND i.k = o.k + 1 AND i.k % 7 = 6 WHERE o.k % 7 <> 6),
    texts AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY k) - 1 AS nth, rest || nested AS full_rest FROM joined)
    SELECT rid AS resource_id, nth AS position, nth AS fragment_index, 'd' || k AS id, {O.ws("head")} AS head,
      {O.strip_head("full_rest", "head")} AS content, {O.ws("head")} AS breadcrumb
    FROM texts WHERE {O.GOOD}"""
)
def frag_xpath_div(spark: SparkSession, sf: str) -> DataFrame:
    """Top divisions with the divisions inside them."""
    tokens = cut(spark, sf).tokens
    rows = FR.selector_fragments(tokens, ".//tei:text/tei:body/tei:div")
    return _frag(rows, ["resource_id", "position", "fragment_index", "id", "head", "content", "breadcrumb"])


@query(
    f"""WITH {O.DIVS}
    p AS (SELECT l.rid, l.doc_id, l.i, l.line, d.head FROM lines l JOIN divs d ON d.rid = l.rid AND d.k = l.i // 5),
    c AS (SELECT rid, doc_id, i, {O.ws("head")} AS head, {O.strip_head("line", "head")} AS content FROM p)
    SELECT rid AS resource_id, CAST(i AS BIGINT) AS fragment_index,
      '__P__' || substr(sha1(rid || '::' || i || '::' || content), 1, 12) AS id, head, content
    FROM c WHERE content <> '' AND {O.GOOD}"""
)
def frag_xpath_p(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs: generated ids, heads of the nearest ancestor."""
    tokens = cut(spark, sf).tokens
    rows = FR.selector_fragments(tokens, ".//tei:div/tei:p", generated_id_prefix="__P__")
    return _frag(rows, ["resource_id", "fragment_index", "id", "head", "content"])


@query(
    f"""WITH {O.DIVS}
    n AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY k) - 1 AS nth,
      lead(own, 1) OVER (PARTITION BY rid ORDER BY k) AS next_own FROM divs),
    t AS (SELECT *, own || CASE WHEN k % 7 = 5 AND next_own IS NOT NULL
        THEN next_own || ' tail' || (k + 1) || ' ' ELSE '' END AS whole FROM n WHERE k % 2 = 0 OR k % 7 = 5)
    SELECT rid AS resource_id, row_number() OVER (PARTITION BY rid ORDER BY k) - 1 AS fragment_index, 'd' || k AS id,
      CASE WHEN {O.ws("head")} = '' THEN {O.ws("whole")} ELSE {O.ws("head || ' ' || whole")} END AS content
    FROM t WHERE {O.GOOD} AND k % 2 = 0"""
)
def frag_xpath_attr(spark: SparkSession, sf: str) -> DataFrame:
    """Selected by attribute at any depth, heads kept and put in front."""
    tokens = cut(spark, sf).tokens
    rows = FR.selector_fragments(
        tokens,
        ".//tei:body//tei:div[@type='even']",
        remove_fragment_heads=False,
        add_head_to_content=True,
    )
    return _frag(rows, ["resource_id", "fragment_index", "id", "content"])


@query(
    f"""WITH {O.DIVS}
    e AS (SELECT rid, doc_id, i // 5 AS k, i % 5 AS li, 0 AS part, line AS raw FROM lines WHERE i % 5 IN (1, 3)
      UNION ALL SELECT rid, doc_id, i // 5, i % 5, 1, '' FROM lines WHERE i % 5 = 1
      UNION ALL SELECT rid, doc_id, k, 9, 0, 'é<&>' FROM divs),
    n AS (SELECT e.*, d.head, row_number() OVER (PARTITION BY e.rid ORDER BY e.k, li, part) - 1 AS nth
      FROM e JOIN divs d ON d.rid = e.rid AND d.k = e.k),
    c AS (SELECT rid, doc_id, nth, {O.ws("head")} AS head, {O.strip_head("raw", "head")} AS content FROM n)
    SELECT rid AS resource_id, nth AS fragment_index, head, content FROM c WHERE content <> '' AND {O.GOOD}"""
)
def frag_xpath_union(spark: SparkSession, sf: str) -> DataFrame:
    """Alternatives with attribute presence and equality; empty elements count for the index."""
    xpath = ".//tei:div/tei:note | .//tei:p/tei:hi[@rend]|.//tei:p[@n='1']/tei:lb"
    rows = FR.selector_fragments(cut(spark, sf).tokens, xpath)
    return _frag(rows, ["resource_id", "fragment_index", "head", "content"])


@query(
    f"""WITH {O.DIVS}
    b AS (SELECT rid, any_value(doc_id) AS doc_id, arg_min(head, k) AS title,
      any_value(lang || ' ' || source) || chr(10)
        || string_agg(CASE WHEN k % 7 = 6 THEN own ELSE rest END || tail || chr(10), '' ORDER BY k) AS body
      FROM divs GROUP BY rid)
    SELECT rid AS resource_id, CAST(0 AS BIGINT) AS fragment_index, {O.ws("title")} AS head,
      {O.strip_head("body", "title")} AS content FROM b WHERE {O.GOOD}"""
)
def frag_xpath_titles(spark: SparkSession, sf: str) -> DataFrame:
    """A title two steps below the fragment; what all titles hold is left out, heads further down stay."""
    rows = FR.selector_fragments(cut(spark, sf).tokens, "/tei:TEI/tei:text//tei:body", "./tei:div/tei:head")
    return _frag(rows, ["resource_id", "fragment_index", "head", "content"])


@query(
    f"""WITH {O.MEMBERS} {O.DOC_TEXT}
    SELECT rid AS resource_id, CAST(k AS BIGINT) AS position, 'd' || k AS id, {O.ws("own")} AS content, breadcrumb
    FROM crumbs WHERE {O.GOOD} AND {O.NAV_ROUTE}
    UNION ALL SELECT rid, 0, '__DOCUMENT__', {O.ws("with_heads")}, '' FROM doc_text WHERE {O.GOOD} AND NOT ({O.NAV_ROUTE})"""
)
def frag_auto(spark: SparkSession, sf: str) -> DataFrame:
    return _frag(by_navigation(spark, sf), ["resource_id", "position", "id", "content", "breadcrumb"])


@query(
    f"""WITH {O.MEMBERS} one AS (SELECT 1)
    SELECT rid AS resource_id, 'd' || k AS member_id, breadcrumb FROM crumbs WHERE doc_id % 10 <> 9
    UNION ALL SELECT rid, 'ghost', 'Ghost' FROM docs WHERE doc_id % 10 <> 9"""
)
def breadcrumbs(spark: SparkSession, sf: str) -> DataFrame:
    return N.breadcrumbs(C.navigation(spark, sf))


@query(
    """SELECT 'W' AS resource_id, 'C' || c_custkey AS member_id, r_name || ' > ' || n_name || ' > ' || c_name AS breadcrumb
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 'W', 'N' || n_nationkey, r_name || ' > ' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 'W', 'R' || r_regionkey, r_name FROM region"""
)
def breadcrumbs_geo(spark: SparkSession, sf: str) -> DataFrame:
    """One deep tree: region, nation, customer."""
    objects, edges = C.geo(spark, sf)
    tree = (
        edges.filter("not startswith(child_id, 'O')")
        .join(objects, F.col("child_id") == F.col("object_id"))
        .select(
            F.lit("W").alias("resource_id"),
            F.col("child_id").alias("member_id"),
            F.nullif("parent_id", F.lit("W")).alias("parent_id"),
            "title",
        )
    )
    return N.climbed(tree)


@query(
    f"""WITH {O.MEMBERS} one AS (SELECT 1)
    SELECT rid AS resource_id, 'd' || k AS member_id, title AS head, 'Other ' || k AS dc_title
    FROM members WHERE k % 4 = 3 AND doc_id % 10 <> 9"""
)
def head_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    return FR.head_mismatches(N.members(C.navigation(spark, sf)))


@query(
    f"""SELECT 'D' || doc_id AS id, {O.ws("text")} AS collapsed, strip_accents(lower({O.ws("text")})) AS folded,
      CASE WHEN length({O.ws("text")}) <= 120 THEN {O.ws("text")} ELSE rtrim(substr({O.ws("text")}, 1, 120)) || '…' END AS preview
    FROM documents"""
)
def text_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Blanks, folding and previews over whole texts."""
    return C.documents(spark, sf).select(
        F.col("rid").alias("id"),
        T.normalize_ws(F.col("text")).alias("collapsed"),
        T.fold(F.col("text")).alias("folded"),
        T.compact(F.col("text"), 120).alias("preview"),
    )


@query(
    """SELECT page_id, url, CASE WHEN contains(url, '#') THEN nullif(regexp_extract(url, '#([^#]*)$', 1), '')
      ELSE nullif(regexp_extract(regexp_replace(url, '/+$', ''), '([^/]*)$', 1), '') END AS short_id FROM pages"""
)
def short_ids(spark: SparkSession, sf: str) -> DataFrame:
    return C.table(spark, sf, "pages").select(
        "page_id", "url", T.short_id(F.col("url")).alias("short_id")
    )


# ------------------------------------------------------------------------ notices


@query(
    f"""WITH {O.META} one AS (SELECT 1)
    SELECT rid AS id, 'Resource' AS type, 'T' || doc_id AS title,
      CAST(CASE WHEN has_dc THEN 5 + CAST(doc_id % 4 <> 0 AS INT) ELSE 0 END AS BIGINT) AS dc_keys,
      CAST(7 + CAST(doc_id % 5 <> 0 AS INT) AS BIGINT) AS ext_keys, CAST(1 AS BIGINT) AS parents FROM d"""
)
def notices_from_results(spark: SparkSession, sf: str) -> DataFrame:
    return notices(spark, sf).select(
        "id",
        "type",
        "title",
        F.size(V.as_map(F.col("dublincore"))).cast("bigint").alias("dc_keys"),
        F.size(V.as_map(F.col("extensions"))).cast("bigint").alias("ext_keys"),
        F.size("linked_parents").cast("bigint").alias("parents"),
    )


@query(
    """SELECT 'D' || doc_id AS id, 'Resource' AS type, 'T' || doc_id AS title,
      CASE WHEN doc_id % 8 = 6 THEN CAST(1 AS BIGINT) ELSE CAST(5 + CAST(doc_id % 4 <> 0 AS INT) AS BIGINT) END AS dc_keys,
      CAST(0 AS BIGINT) AS parents FROM documents"""
)
def notices_raw(spark: SparkSession, sf: str) -> DataFrame:
    return NO.from_objects(described(spark, sf)).select(
        "id",
        "type",
        "title",
        F.size(V.as_map(F.col("dublincore"))).cast("bigint").alias("dc_keys"),
        F.size("linked_parents").cast("bigint").alias("parents"),
    )


@query(
    f"""WITH {O.MEMBERS} {O.DOC_TEXT},
    frags AS (SELECT rid, k, {O.ws("own")} AS content FROM crumbs WHERE {O.GOOD} AND {O.NAV_ROUTE}
      UNION ALL SELECT rid, 0, {O.ws("with_heads")} FROM doc_text WHERE {O.GOOD} AND NOT ({O.NAV_ROUTE})),
    t AS (SELECT rid, count(*) AS n, sum(length(content)) AS len,
        string_agg(content, chr(10) || chr(10) ORDER BY k) FILTER (content <> '') AS whole FROM frags GROUP BY rid)
    SELECT d.rid AS id, coalesce(whole, '') AS text, CAST(coalesce(n, 0) AS BIGINT) AS fragments_count,
      CAST(coalesce(len, 0) AS BIGINT) AS text_length FROM docs d LEFT JOIN t ON t.rid = d.rid"""
)
def full_text(spark: SparkSession, sf: str) -> DataFrame:
    """Text and counts of every notice, also of those without fragments."""
    ids = C.documents(spark, sf).select(F.col("rid").alias("id"))
    frags = materialize(by_navigation(spark, sf).drop("metadata_dublincore"), "fragments")
    rows = NO.with_stats(NO.with_text(ids, frags), frags)
    return rows.select("id", "text", "fragments_count", "text_length")


@query(
    f"""WITH {O.META} a AS (
      SELECT rid, 0 AS pos, NULL AS agent_id, NULL AS agent_type, 'Ext ' || n AS name, '' AS same_as FROM d WHERE doc_id % 5 = 1
      UNION ALL SELECT rid, 0, 'https://id.example/' || n, 'Person', 'Obj ' || n, 'https://same.example/' || n FROM d WHERE doc_id % 5 = 2
      UNION ALL SELECT rid, 0, 'https://id.example/' || n, NULL, 'L1', 's1|s2' FROM d WHERE doc_id % 5 = 3
      UNION ALL SELECT rid, 1, NULL, NULL, 'Plain ' || n, '' FROM d WHERE doc_id % 5 = 3
      UNION ALL SELECT rid, 0, 'x', NULL, '', '' FROM d WHERE doc_id % 5 = 4)
    SELECT rid AS id, CAST(pos AS BIGINT) AS pos, agent_id, agent_type, name, same_as FROM a"""
)
def agents(spark: SparkSession, sf: str) -> DataFrame:
    return NO.agents(notices(spark, sf)).select(
        "id",
        F.col("pos").cast("bigint").alias("pos"),
        "agent_id",
        "agent_type",
        "name",
        F.array_join("same_as", "|").alias("same_as"),
    )


@query(f"""WITH {O.META} {O.CREATORS} one AS (SELECT 1) SELECT rid AS id, names FROM names""")
def creators(spark: SparkSession, sf: str) -> DataFrame:
    return NO.with_creators(notices(spark, sf)).select(
        "id", F.array_join("creator_names", "|").alias("names")
    )


WIDE = [
    "dublincore.creator",
    "dublincore.date",
    "dublincore.deep.a.b",
    "dublincore.source",
    "dublincore.title",
    "extensions.@extra-key",
    "extensions.creator",
    "extensions.creator.@id",
    "extensions.creator.@type",
    "extensions.creator.name",
    "extensions.creator.sameAs",
    "extensions.dateCreated",
    "extensions.dct:coverage",
    "extensions.list",
    "extensions.open",
    "extensions.rank",
    "extensions.temporalCoverage",
]
PIVOT = ", ".join(f"max(value) FILTER (key = '{k}') AS \"{k}\"" for k in WIDE)


@query(
    f"""WITH {O.META} wide AS (SELECT rid, NULL AS "dublincore.note", {PIVOT} FROM flat GROUP BY rid)
    SELECT rid AS id, 'Resource' AS type, 'T' || doc_id AS title, 'root' AS linked_parents,
      CAST(CASE WHEN {O.GOOD} THEN 1 ELSE 0 END AS BIGINT) AS fragments_count, wide.* EXCLUDE (rid)
    FROM wide JOIN d USING (rid)"""
)
def flat_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Wide rows; the columns are the keys found in the data."""
    rows = NO.flat_rows(notices(spark, sf), whole(spark, sf), include_text=False)
    return rows.withColumn("linked_parents", F.array_join("linked_parents", "|"))


@query(
    f"""WITH {O.META} {O.DIVS.strip().rstrip(',')}, {O.DOC_TEXT},
    cells AS (SELECT rid, key, CASE WHEN key = 'extensions.open' THEN 'True'
      WHEN value LIKE '[%' THEN {SPACED}
      ELSE coalesce(value, '') END AS value FROM flat),
    wide AS (SELECT rid, '' AS "dublincore.note",
      {", ".join(f"coalesce(max(value) FILTER (key = '{k}'), '') AS " + chr(34) + k + chr(34) for k in WIDE)}
      FROM cells GROUP BY rid)
    SELECT wide.rid AS id, 'T' || d.doc_id AS title, '["root"]' AS linked_parents,
      CASE WHEN d.{O.GOOD} THEN '1' ELSE '0' END AS fragments_count,
      CASE WHEN d.{O.GOOD} THEN CAST(length({O.ws("with_heads")}) AS VARCHAR) ELSE '0' END AS text_length,
      wide.* EXCLUDE (rid) FROM wide JOIN d ON d.rid = wide.rid JOIN doc_text t ON t.rid = wide.rid"""
)
def doc_index(spark: SparkSession, sf: str) -> DataFrame:
    """The flat index of the whole corpus: shred, whole-document text, counts, metadata."""
    return SF.index_rows(results(spark, sf), whole(spark, sf))


# ------------------------------------------------------------------------ exports

FLAT_TEXT = """
entries AS (SELECT rid, key, value FROM flat
  UNION ALL SELECT rid, 'temporal.' || key, value FROM t)"""


@query(
    f"""WITH {O.META} {O.CREATORS} {O.temporal(O.DATED, "t")}, {FLAT_TEXT},
    sizes AS (SELECT rid, count(*) AS n, count(*) FILTER (key LIKE 'temporal.%') AS tn FROM entries GROUP BY rid),
    {O.DIVS.strip().rstrip(",")}, {O.DOC_TEXT}
    SELECT d.rid AS id, 'Resource' AS type, 'T' || d.doc_id AS title,
      CASE WHEN d.{O.GOOD} THEN {O.ws("with_heads")} ELSE '' END AS text, names, 'root' AS linked_parents,
      CAST(sizes.n AS BIGINT) AS flat_keys, CAST(tn AS BIGINT) AS temporal_keys,
      CAST(CASE WHEN d.{O.GOOD} THEN 1 ELSE 0 END AS BIGINT) AS fragments
    FROM d JOIN names ON names.rid = d.rid JOIN sizes ON sizes.rid = d.rid JOIN doc_text ON doc_text.rid = d.rid"""
)
def search_docs(spark: SparkSession, sf: str) -> DataFrame:
    frags = materialize(whole(spark, sf).drop("metadata_dublincore"), "fragments")
    rows = X.search_documents(notices(spark, sf), frags)
    return rows.select(
        "id",
        "type",
        "title",
        "text",
        F.array_join("creator_names", "|").alias("names"),
        F.array_join("linked_parents", "|").alias("linked_parents"),
        F.size("metadata_flat").cast("bigint").alias("flat_keys"),
        F.size("temporal").cast("bigint").alias("temporal_keys"),
        F.size("fragments").cast("bigint").alias("fragments"),
    )


@query(
    f"""WITH {O.META} {O.CREATORS} one AS (SELECT 1)
    SELECT 'index' AS op, 'corpus' AS ix, rid AS id, rid AS source_id, 'T' || d.doc_id AS title,
      CASE WHEN has_dc THEN n_chars END AS deep, CASE WHEN has_dc THEN dt END AS date, names
    FROM d JOIN names USING (rid)"""
)
def bulk_actions(spark: SparkSession, sf: str) -> DataFrame:
    """Actions written as lines of JSON and read back."""
    docs = X.search_documents(notices(spark, sf), whole(spark, sf), include_fragments=False)
    path = scratch(spark, "actions")
    SF.write_actions(X.bulk_actions(docs, "corpus"), path)
    line = spark.read.text(path).select(F.parse_json("value").alias("v"))
    v = F.col("v")
    return line.select(
        V.get(v, "_op_type").alias("op"),
        V.get(v, "_index").alias("ix"),
        V.get(v, "_id").alias("id"),
        V.get(v, "_source", "id").alias("source_id"),
        V.get(v, "_source", "title").alias("title"),
        V.get(v, "_source", "metadata_flat", "dublincore.deep.a.b", type="bigint").alias("deep"),
        V.get(v, "_source", "temporal", "dublincore.date").alias("date"),
        F.array_join(V.get(v, "_source", "creator_names", type="array<string>"), "|").alias("names"),
    )


@query(
    f"""WITH {O.META} {O.temporal(O.DATED, "t")}, {FLAT_TEXT}
    SELECT rid AS id, rid AS record_id,
      replace(replace(replace(replace(key, '.', '__'), ':', '__'), '-', '_'), '@', '') AS safe_key, value FROM entries"""
)
def vector_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Safe keys at the top level of the payload object."""
    rows = X.vector_payloads(notices(spark, sf), whole(spark, sf), include_fragments=False)
    objects = rows.select("id", F.parse_json(X.payload_object(rows)).alias("whole"))
    top = objects.select(
        "id",
        V.get(F.col("whole"), "record_id").alias("record_id"),
        F.explode(V.as_map(F.col("whole"))).alias("safe_key", "v"),
    )
    safe = F.col("safe_key").rlike("^(dublincore|extensions|temporal)__")
    return top.filter(safe).select("id", "record_id", "safe_key", V.leaf_text(F.col("v")).alias("value"))


POINT_ID = "CAST(CAST('0x' || substr(sha1('D' || doc_id), 1, 16) AS UBIGINT) AS DECIMAL(20,0))"


@query(
    f"""SELECT {POINT_ID} AS id, 'D' || doc_id AS record_id, 'T' || doc_id AS title,
      CAST(len(embedding) AS BIGINT) AS dims, embedding[1] AS first_value
    FROM documents JOIN embeddings ON vec_id = doc_id"""
)
def vector_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points written as lines of JSON and read back."""
    payloads = X.vector_payloads(notices(spark, sf), whole(spark, sf), include_fragments=False)
    path = scratch(spark, "points")
    SF.write_points(X.vector_points(payloads, C.vectors(spark, sf), check=False), path)
    v = F.col("v")
    return spark.read.text(path).select(F.parse_json("value").alias("v")).select(
        V.get(v, "id", type="decimal(20,0)").alias("id"),
        V.get(v, "payload", "record_id").alias("record_id"),
        V.get(v, "payload", "title").alias("title"),
        F.size(V.get(v, "vector", type="array<float>")).cast("bigint").alias("dims"),
        F.get(V.get(v, "vector", type="array<float>"), 0).alias("first_value"),
    )


@query(
    """SELECT 'D' || doc_id AS id, 'vector' AS missing FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
    UNION ALL SELECT 'D' || vec_id, 'notice' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)"""
)
def vector_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    return X.vector_mismatch(notices(spark, sf), C.vectors(spark, sf))


@query(f"SELECT 'D' || doc_id AS id, {POINT_ID} AS point_id FROM documents")
def point_ids(spark: SparkSession, sf: str) -> DataFrame:
    return notices(spark, sf).select("id", T.stable_int_id(F.col("id")).alias("point_id"))


@query(
    f"""WITH {O.META} {O.CREATORS} one AS (SELECT 1)
    SELECT rid AS id, CASE WHEN has_dc THEN lang || ' ' || source || ' ' || d.doc_id END AS dc_title,
      CASE WHEN has_dc THEN n_chars END AS deep, CAST(d.doc_id % 7 AS BIGINT) AS rank,
      trim('T' || d.doc_id || CASE WHEN has_dc THEN ' ' || lang || ' ' || source || ' ' || d.doc_id ||
          CASE d.doc_id % 4 WHEN 1 THEN ' Author ' || n WHEN 2 THEN ' [''Author ' || n || ''', ''Second'']' ELSE '' END
          || ' ' || source ELSE '' END
        || CASE WHEN names = '' THEN '' ELSE ' ' || replace(names, '|', ' ') END) AS index_text
    FROM d JOIN names USING (rid)"""
)
def index_payload(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.index_payloads(
        notices(spark, sf), ["title", "creator", "source", "deep.a.b", "note"], ["rank", "absent"]
    )
    return rows.select(
        "id",
        V.leaf_text(F.try_element_at("dublincore", F.lit("title"))).alias("dc_title"),
        F.try_element_at("dublincore", F.lit("deep.a.b")).try_cast("bigint").alias("deep"),
        F.try_element_at("extensions", F.lit("rank")).try_cast("bigint").alias("rank"),
        "index_text",
    )


@query(
    f"""WITH {O.META} one AS (SELECT 1)
    SELECT rid AS resource_id, 'T' || doc_id AS name, CASE WHEN has_dc THEN dt END AS year, '-50/20?' AS coverage FROM d"""
)
def records_map(spark: SparkSession, sf: str) -> DataFrame:
    rows = NO.flat_rows(
        notices(spark, sf), whole(spark, sf), keys=["dublincore.date", "extensions.dct:coverage"]
    )
    return X.records(
        rows,
        {
            "id": "resource_id",
            "title": "name",
            "dublincore.date": "year",
            "extensions.dct:coverage": "coverage",
            "extensions.absent": "absent",
        },
    )


@query(
    f"""SELECT 'V' || conv_id || '__frag_' || turn AS key, 'V' || conv_id AS record_id, 't' || turn AS id,
      'Conversation ' || conv_id AS title, role AS head, conv_id || ' > ' || role AS breadcrumb, {O.strip("text")} AS text,
      'all' AS linked_parents
    FROM conversations WHERE (conv_id + turn) % 6 <> 5"""
)
def fragment_records(spark: SparkSession, sf: str) -> DataFrame:
    """One record per turn; blank ones are left out but keep their number."""
    frags = C.conversation_fragments(spark, sf)
    empty = F.parse_json(F.lit("{}"))
    owners = frags.select("resource_id").distinct().select(
        F.col("resource_id").alias("id"),
        F.lit("Resource").alias("type"),
        F.concat(F.lit("Conversation "), F.substr("resource_id", F.lit(2))).alias("title"),
        empty.alias("dublincore"),
        empty.alias("extensions"),
        F.array(F.lit("all")).alias("linked_parents"),
    )
    return X.fragment_records(owners, frags).select(
        "key",
        "record_id",
        "id",
        "title",
        "head",
        "breadcrumb",
        "text",
        F.array_join("linked_parents", "|").alias("linked_parents"),
    )


@query(
    """SELECT 'V' || conv_id AS id, CAST(count(*) AS BIGINT) AS fragments_count,
      CAST(sum(CASE WHEN (conv_id + turn) % 6 = 5 THEN 2 ELSE length(text) + 2 END) AS BIGINT) AS text_length
    FROM conversations GROUP BY conv_id"""
)
def conversation_stats(spark: SparkSession, sf: str) -> DataFrame:
    return NO.fragment_stats(C.conversation_fragments(spark, sf))


# --------------------------------------------------------------------- validation

PROFILE = """CASE WHEN source IN ('src0', 'src1') THEN 'collection' WHEN source IN ('src2', 'src3') THEN 'resource'
  ELSE 'resource_result' END"""

FAULTS = f"""
r AS (SELECT 'D' || doc_id AS rid, doc_id, {PROFILE} AS profile FROM documents),
faults AS (
  SELECT rid, profile, '''id'' is a required property' AS message, NULL AS path FROM r WHERE profile = 'resource_result' AND doc_id % 9 = 4
  UNION ALL SELECT rid, profile, '3 is not of type ''string'', ''null''', 'title' FROM r WHERE profile = 'resource_result' AND doc_id % 8 = 1
  UNION ALL SELECT rid, profile, '["a","a"] has non-unique elements', 'linked_parents' FROM r WHERE profile = 'resource_result' AND doc_id % 6 = 1
  UNION ALL SELECT rid, profile, '4 is not of type ''string''', 'linked_parents.1' FROM r WHERE profile = 'resource_result' AND doc_id % 6 = 2
  UNION ALL SELECT rid, profile, '[] is not of type ''object''', 'metadata' FROM r WHERE profile = 'resource_result' AND doc_id % 10 = 9
  UNION ALL SELECT rid, profile, '5 is not of type ''string''', 'fragments.0.content' FROM r WHERE profile = 'resource_result' AND doc_id % 7 = 3
  UNION ALL SELECT rid, profile, '1.5 is not of type ''integer'', ''string'', ''null''', 'fragments.0.level' FROM r WHERE profile = 'resource_result' AND doc_id % 4 = 3
  UNION ALL SELECT rid, profile, '''content'' is a required property', 'fragments.1' FROM r WHERE profile = 'resource_result' AND doc_id % 5 = 2
  UNION ALL SELECT rid, profile, '''@id'' is a required property', NULL FROM r WHERE profile = 'collection' AND doc_id % 2 <> 0
  UNION ALL SELECT rid, profile, '''many'' is not of type ''integer'', ''null''', 'totalItems' FROM r WHERE profile = 'collection' AND doc_id % 4 = 1
  UNION ALL SELECT rid, profile, 'False is not of type ''string'', ''null''', 'title' FROM r WHERE profile = 'collection' AND doc_id % 3 = 0
  UNION ALL SELECT rid, profile, '{{}} is not of type ''array''', 'member' FROM r WHERE profile = 'collection' AND doc_id % 5 = 0
  UNION ALL SELECT rid, profile, '7 is not of type ''string''', '@id' FROM r WHERE profile = 'resource' AND doc_id % 2 = 0
  UNION ALL SELECT rid, profile, '''xml'' is not of type ''array'', ''null''', 'mediaTypes' FROM r WHERE profile = 'resource' AND doc_id % 3 = 0)
"""


@query(f"WITH {FAULTS} SELECT rid AS record_id, profile, 'error' AS level, message, path FROM faults")
def issues(spark: SparkSession, sf: str) -> DataFrame:
    found = VA.issues(VA.check(C.records(spark, sf)))
    return found.select("record_id", "profile", "level", "message", "path")


@query(
    f"""WITH {FAULTS} SELECT r.rid AS record_id, r.profile, count(f.rid) = 0 AS ok, CAST(count(f.rid) AS BIGINT) AS issues,
      CASE WHEN count(f.rid) > 0 THEN min(coalesce(f.path, '')) END AS first_path
    FROM r LEFT JOIN faults f ON f.rid = r.rid GROUP BY r.rid, r.profile"""
)
def report(spark: SparkSession, sf: str) -> DataFrame:
    rows = VA.reports(VA.check(C.records(spark, sf)))
    first = F.get("issues", 0)
    return rows.select(
        "record_id",
        "profile",
        "ok",
        F.size("issues").cast("bigint").alias("issues"),
        F.when(~F.col("ok"), F.coalesce(first["path"], F.lit(""))).alias("first_path"),
    )


@query(
    f"""WITH {FAULTS}, per AS (SELECT r.rid, count(f.rid) AS n FROM r LEFT JOIN faults f ON f.rid = r.rid GROUP BY r.rid)
    SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (n = 0) AS BIGINT) AS valid,
      CAST(count(*) FILTER (n > 0) AS BIGINT) AS invalid, CAST(sum(n) AS BIGINT) AS issues FROM per"""
)
def batch_summary(spark: SparkSession, sf: str) -> DataFrame:
    return VA.summary(VA.check(C.records(spark, sf)))


@query(f"SELECT 'D' || doc_id AS record_id, {PROFILE} AS profile FROM documents")
def profile_infer(spark: SparkSession, sf: str) -> DataFrame:
    return C.records(spark, sf).select("record_id", VA.infer_profile(F.col("record")).alias("profile"))


CODED = VA.Profile(
    ("code",), {"code": VA.Field(("string",), allowed=("x", "y")), "tags": VA.Field(("array",), items=VA.TEXT, unique=True)}
)
LISTED = VA.Profile(("b",), {"b": VA.Field(("object",), inside=CODED)})
DEEP = VA.Profile(
    ("id", "part"),
    {"id": VA.TEXT, "part": VA.Field(("object",), inside=VA.Profile(("list",), {"list": VA.Field(("array",), items=LISTED)}))},
)


@query(
    """WITH r AS (SELECT 'D' || doc_id AS rid, doc_id FROM documents), f AS (SELECT * FROM r WHERE doc_id % 7 <> 6)
    SELECT rid AS record_id, 'part' AS path, '''list'' is a required property' AS message, 'required: ''list''' AS expected
      FROM r WHERE doc_id % 7 = 6
    UNION ALL SELECT rid, 'part.list.0.b.code', '''z'' is not one of [''x'', ''y'']', 'enum: ''x'', ''y''' FROM f WHERE doc_id % 5 = 1
    UNION ALL SELECT rid, 'part.list.0.b.tags.1', '5 is not of type ''string''', 'type: ''string''' FROM f WHERE doc_id % 3 = 0
    UNION ALL SELECT rid, 'part.list.1.b', '''code'' is a required property', 'required: ''code''' FROM f WHERE doc_id % 4 = 2
    UNION ALL SELECT rid, 'part.list.1.b', '''n'' is not of type ''object''', 'type: ''object''' FROM f WHERE doc_id % 4 = 3"""
)
def issues_deep(spark: SparkSession, sf: str) -> DataFrame:
    """A profile of one's own, with rules down to six steps below the record."""
    return VA.issues(VA.check(C.deep_records(spark, sf), DEEP)).select("record_id", "path", "message", "expected")


@query(
    f"""WITH r AS (SELECT 'D' || doc_id AS rid, doc_id, {PROFILE} AS profile FROM documents),
    own AS (SELECT * FROM r WHERE profile = 'resource'), res AS (SELECT * FROM r WHERE profile = 'resource_result')
    SELECT 'resource' AS "table", rid AS record_id, '@id' AS path, 'type' AS code, 'int' AS actual FROM own WHERE doc_id % 2 = 0
    UNION ALL SELECT 'resource', rid, unnest(['title', 'navigation']), 'missing', NULL FROM own
    UNION ALL SELECT 'resource', rid, 'document', 'type', 'null' FROM own WHERE doc_id % 4 = 0
    UNION ALL SELECT 'resource', rid, 'mediaTypes', 'type', 'str' FROM own WHERE doc_id % 3 = 0
    UNION ALL SELECT 'resource_result', rid, 'id', 'missing', NULL FROM res WHERE doc_id % 9 = 4
    UNION ALL SELECT 'resource_result', rid, 'title', 'type', 'int' FROM res WHERE doc_id % 8 = 1
    UNION ALL SELECT 'resource_result', rid, 'metadata', 'type', 'list' FROM res WHERE doc_id % 10 = 9
    UNION ALL SELECT 'collection', rid, '@type', 'value', 'str' FROM r WHERE doc_id % 6 = 0"""
)
def issues_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The rule tables of resources and their results, and a type that is not allowed."""
    kind = VA.infer_profile(F.col("record"))
    records = C.records(spark, sf)

    def faults(rows: DataFrame, table: str) -> DataFrame:
        return VA.rule_issues(rows, table).withColumn("table", F.lit(table))

    odd = C.documents(spark, sf).selectExpr(
        "rid AS record_id", """parse_json(concat('{"@id":"c","title":"t","@type":"', if(doc_id % 6 = 0, 'Shelf', 'Resource'), '"}')) AS record"""
    )
    return (
        faults(records.filter(kind == "resource"), "resource")
        .unionByName(faults(records.filter(kind == "resource_result"), "resource_result"))
        .unionByName(faults(odd, "collection"))
        .select("table", "record_id", "path", "code", "actual")
    )


@query(
    """SELECT 'D' || doc_id AS record_id, '@type' AS path, '''Shelf'' is not one of [''Collection'', ''Resource'']' AS message,
      'enum: ''Collection'', ''Resource''' AS expected, '''Shelf''' AS actual FROM documents WHERE doc_id % 6 = 0"""
)
def issues_allowed(spark: SparkSession, sf: str) -> DataFrame:
    """A type that is not in the list of allowed ones, against the profile of collections."""
    odd = C.documents(spark, sf).selectExpr(
        "rid AS record_id", """parse_json(concat('{"@id":"c","title":"t","@type":"', if(doc_id % 6 = 0, 'Shelf', 'Resource'), '"}')) AS record"""
    )
    return VA.issues(VA.check(odd, "collection")).select("record_id", "path", "message", "expected", "actual")


@query(
    f"""WITH r AS (SELECT 'D' || doc_id AS rid, doc_id, {PROFILE} AS profile FROM documents)
    SELECT rid AS record_id, '@id' AS path, 'missing' AS code, NULL AS actual FROM r WHERE profile = 'collection' AND doc_id % 2 <> 0
    UNION ALL SELECT rid, '@id', 'missing', NULL FROM r WHERE profile = 'resource_result'
    UNION ALL SELECT rid, '@id', 'type', 'int' FROM r WHERE profile = 'resource' AND doc_id % 2 = 0
    UNION ALL SELECT rid, '@type', 'missing', NULL FROM r WHERE profile = 'resource_result'
    UNION ALL SELECT rid, 'title', 'missing', NULL FROM r WHERE profile = 'resource'
    UNION ALL SELECT rid, 'title', 'type', CASE WHEN doc_id % 8 = 1 THEN 'int' ELSE 'null' END FROM r WHERE profile = 'resource_result'
    UNION ALL SELECT rid, 'title', 'type', 'bool' FROM r WHERE profile = 'collection' AND doc_id % 3 = 0
    UNION ALL SELECT rid, 'member', 'type', 'dict' FROM r WHERE profile = 'collection' AND doc_id % 5 = 0
    UNION ALL SELECT rid, 'totalItems', 'type', CASE WHEN doc_id % 4 = 1 THEN 'str' END FROM r WHERE profile = 'collection' AND doc_id % 4 = 1"""
)
def issues_rules(spark: SparkSession, sf: str) -> DataFrame:
    return VA.rule_issues(C.records(spark, sf), "collection")


# ----------------------------------------------------------- request log, reports


@query(
    f"""WITH {O.LOG} SELECT event_id AS attempt_id, request_key, class, retryable FROM tried"""
)
def attempt_class(spark: SparkSession, sf: str) -> DataFrame:
    rows = L.classified(C.request_log(spark, sf))
    return rows.select(
        "attempt_id", "request_key", "class", F.coalesce("retryable", F.lit(False)).alias("retryable")
    )


@query(
    f"""WITH {O.LOG}, n AS (SELECT *, row_number() OVER (PARTITION BY request_key ORDER BY ts, event_id) AS n FROM tried),
    b AS (SELECT * FROM n WHERE n <= 3),
    f AS (SELECT request_key, coalesce(min(n) FILTER (NOT retryable), max(n)) AS stop FROM b GROUP BY request_key)
    SELECT b.request_key, class AS outcome, class = 'ok' AS success, CAST(stop AS BIGINT) AS attempts
    FROM f JOIN b ON b.request_key = f.request_key AND b.n = f.stop"""
)
def request_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return L.outcomes(C.request_log(spark, sf))


@query(
    f"""WITH {O.LOG} SELECT CAST(count(*) AS BIGINT) AS requests_total, CAST(count(*) FILTER (class <> 'ok') AS BIGINT) AS http_errors,
      CAST(count(*) FILTER (class = 'timeout') AS BIGINT) AS timeouts, CAST(count(*) FILTER (class = 'http_500') AS BIGINT) AS http_500,
      CAST(round(epoch(max(ts)) - epoch(min(ts))) AS BIGINT) AS elapsed FROM classed"""
)
def run_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = L.run_stats(C.request_log(spark, sf))
    return rows.withColumn("elapsed", F.round("elapsed_seconds").cast("bigint")).drop("elapsed_seconds")


def tree_run(spark: SparkSession, sf: str) -> PL.CorpusRun:
    """A whole run over the ten-way tree of collections."""
    landed = PL.Landed(
        payloads=C.tree_payloads(spark, sf),
        documents=C.tei(spark, sf),
        navigation=C.navigation(spark, sf),
        parents=C.parents(spark, sf),
        request_log=C.request_log(spark, sf),
    )
    return PL.run(landed, PL.CollectionParams("C0"))


@query(
    f"""WITH {O.MEMBERS} {O.DOC_TEXT},
    frags AS (SELECT rid, {O.ws("own")} AS content FROM crumbs WHERE {O.GOOD} AND {O.NAV_ROUTE}
      UNION ALL SELECT rid, {O.ws("with_heads")} FROM doc_text WHERE {O.GOOD} AND NOT ({O.NAV_ROUTE})),
    t AS (SELECT rid, count(*) AS n, sum(length(content)) AS len FROM frags GROUP BY rid)
    SELECT d.rid AS id, CASE doc_id % 3 WHEN 0 THEN 'lang:' || lang || '|src:' || source WHEN 1 THEN ''
        ELSE 'C' || doc_id END AS linked_parents,
      CAST(n AS BIGINT) AS fragments_count, CAST(len AS BIGINT) AS text_length
    FROM docs d JOIN t ON t.rid = d.rid"""
)
def corpus_run(spark: SparkSession, sf: str) -> DataFrame:
    """Walk, parents, metadata and routed fragments in one run, saved and read back."""
    path = scratch(spark, "run")
    PL.save(tree_run(spark, sf), path)
    saved = PL.load(spark, path)
    rows = NO.with_stats(saved.resources, saved.fragments)
    return rows.select(
        "id",
        F.array_join("linked_parents", "|").alias("linked_parents"),
        "fragments_count",
        "text_length",
    )


@query(
    """SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS valid, CAST(0 AS BIGINT) AS invalid,
      CAST(0 AS BIGINT) AS issues, CAST(0 AS BIGINT) AS output_issues FROM documents WHERE doc_id % 11 <> 5"""
)
def run_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Validation attached to a run: its output and its resources."""
    output, resources = tree_run(spark, sf).validate()
    count = output.agg(F.count("*").alias("output_issues"))
    return resources.withColumn("_one", F.lit(1)).join(count.withColumn("_one", F.lit(1)), "_one").drop("_one")


@query(
    f"""WITH {O.MEMBERS} frags AS (SELECT rid FROM members WHERE {O.GOOD} AND {O.NAV_ROUTE}
      UNION ALL SELECT rid FROM docs WHERE {O.GOOD} AND NOT ({O.NAV_ROUTE}))
    SELECT (SELECT CAST(count(*) AS BIGINT) FROM documents) AS collections,
      (SELECT CAST(count(*) * 13 AS BIGINT) FROM documents) AS collection_members,
      (SELECT CAST(count(*) AS BIGINT) FROM documents WHERE {O.GOOD}) AS resources,
      (SELECT CAST(count(*) AS BIGINT) FROM frags) AS fragments, false AS nothing_retrieved"""
)
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    run = tree_run(spark, sf)
    return R.run_summary(run.collections, run.resources, run.fragments)


@query(
    f"""WITH {O.DIVS} good AS (SELECT * FROM divs WHERE {O.GOOD}),
    p AS (SELECT l.rid, l.i, {O.strip_head("line", "head")} AS content FROM lines l JOIN good d ON d.rid = l.rid AND d.k = l.i // 5)
    SELECT 'document' AS mode, CAST(0 AS BIGINT) AS collections, CAST(0 AS BIGINT) AS members,
        (SELECT CAST(count(*) AS BIGINT) FROM documents) AS resources, CAST(count(DISTINCT rid) AS BIGINT) AS fragments FROM good
    UNION ALL SELECT 'navigation', 0, 0, (SELECT count(*) FROM documents),
        count(*) FILTER (doc_id % 10 NOT IN (8, 9)) + count(DISTINCT CASE WHEN doc_id % 10 IN (8, 9) THEN rid END) FROM good
    UNION ALL SELECT 'tei_xpath', 0, 0, (SELECT count(*) FROM documents), count(*) FILTER (content <> '') FROM p"""
)
def mode_compare(spark: SparkSession, sf: str) -> DataFrame:
    """The modes side by side on one corpus."""
    docs, res, nav = C.tei(spark, sf), C.resource_depths(spark, sf), C.navigation(spark, sf)
    none = spark.range(0).select(F.array(F.lit("x")).alias("member"))
    modes = {
        "document": FR.FragmentParams("document"),
        "navigation": FR.FragmentParams("navigation"),
        "tei_xpath": FR.FragmentParams(
            "tei_xpath", fragment_xpath=".//tei:p", add_head_to_content=False
        ),
    }
    cut = FR.split_modes(docs, res, nav, modes)
    rows = R.compare_modes({m: R.run_summary(none, res, f.fragments) for m, f in cut.items()})
    return rows.select("mode", "collections", "members", "resources", "fragments")


@query(
    f"""WITH {O.DIVS} {O.DOC_TEXT}
    SELECT rid AS id, 'T' || doc_id AS title, CAST(CASE WHEN {O.GOOD} THEN 1 ELSE 0 END AS BIGINT) AS fragments,
      CASE WHEN NOT {O.GOOD} THEN NULL WHEN length({O.ws("with_heads")}) <= 400 THEN {O.ws("with_heads")}
        ELSE rtrim(substr({O.ws("with_heads")}, 1, 400)) || '…' END AS content
    FROM doc_text WHERE rid IN (SELECT rid FROM docs ORDER BY rid LIMIT 12)"""
)
def preview(spark: SparkSession, sf: str) -> DataFrame:
    """The first resources by id with their first fragment."""
    rows = R.preview(results(spark, sf), whole(spark, sf), 12)
    return rows.select("id", "title", "fragments", "content")


@query(
    f"""WITH {O.DIVS} {O.DOC_TEXT},
    top AS (SELECT rid, 0 AS part, unnest([0, 1, 2, 3]) AS line_no, unnest([repeat('=', 100), 'ID       : ' || rid,
        'Title    : T' || doc_id, 'Fragments: ' || CASE WHEN {O.GOOD} THEN '1' ELSE '0' END]) AS line FROM doc_text),
    body AS (SELECT rid, 1 AS part, unnest([0, 1, 2, 3, 4, 5, 6, 7, 8]) AS line_no, unnest([repeat('-', 100), 'Fragment 1',
        'id   : __DOCUMENT__', 'level     : None', 'head      : None', 'breadcrumb: ', '',
        CASE WHEN length({O.ws("with_heads")}) <= 1200 THEN {O.ws("with_heads")}
             ELSE rtrim(substr({O.ws("with_heads")}, 1, 1200)) || '…' END, '']) AS line FROM doc_text WHERE {O.GOOD})
    SELECT rid AS resource_id, CAST(part AS BIGINT) AS part, CAST(line_no AS BIGINT) AS line_no, line FROM top
    UNION ALL SELECT rid, part, line_no, line FROM body"""
)
def report_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = R.report_lines(results(spark, sf), whole(spark, sf))
    return rows.select(
        "resource_id",
        F.col("part").cast("bigint").alias("part"),
        F.col("line_no").cast("bigint").alias("line_no"),
        "line",
    )


@query(
    f"""WITH {O.META} one AS (SELECT 1)
    SELECT rid AS id, 'T' || doc_id AS title, 'root' AS linked_parents, CASE WHEN has_dc THEN dt END AS date,
      CAST(doc_id % 7 AS BIGINT) AS rank FROM d"""
)
def reload(spark: SparkSession, sf: str) -> DataFrame:
    """Results written once, then reused: the second call must not compute."""

    def never() -> DataFrame:
        raise AssertionError("saved results were not reused")

    path = scratch(spark, "results")
    SR.reuse_or_write(spark, path, lambda: results(spark, sf))
    rows = SR.reuse_or_write(spark, path, never)
    return rows.select(
        "id",
        "title",
        F.array_join("linked_parents", "|").alias("linked_parents"),
        V.get(F.col("dublincore"), "date").alias("date"),
        V.get(F.col("extensions"), "rank", type="bigint").alias("rank"),
    )


# ------------------------------------------------- files, views and faults round trip


@query("SELECT 'D' || doc_id || '/' || source || ' é?' AS resource_id, sha256(text) AS xml_sha256, CAST(length(text) AS BIGINT) AS chars FROM documents")
def doc_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that landed as one file each, under names with odd characters."""
    path = scratch(spark, "landed-documents")
    name = F.url_encode(F.concat(F.lit("D"), F.col("doc_id"), F.lit("/"), F.col("source"), F.lit(" é?")))
    rows = C.table(spark, sf, "documents").select(name.alias("name"), "text")
    C.land_files(rows, path, "xml")
    found = P.read_documents(spark, path)
    return found.select("resource_id", F.sha2("xml", 256).alias("xml_sha256"), F.char_length("xml").cast("bigint").alias("chars"))


@query(ORACLES["doc_index"])
def index_file(spark: SparkSession, sf: str) -> DataFrame:
    """The index written as CSV lines and read back."""
    path = scratch(spark, "index")
    SF.write_index(results(spark, sf), whole(spark, sf), path)
    return SF.read_index(spark, path)


@query(
    """SELECT 'D' || doc_id AS id, 'dublincore.k' || (doc_id * 6 + j) % 6000 AS key, CASE j WHEN 0 THEN 'a,"b"' || doc_id
      WHEN 1 THEN 'two' || chr(10) || 'lines ' ELSE 'v' || doc_id || j END AS value
    FROM documents, (SELECT unnest(generate_series(0, 5)) AS j)"""
)
def index_wide(spark: SparkSession, sf: str) -> DataFrame:
    """An index of up to 6,000 metadata keys, written as lines and read back."""
    pairs = F.expr(
        "map_from_entries(transform(sequence(0, 5), j -> struct(concat('k', (doc_id * 6 + j) % 6000), "
        """case j when 0 then concat('a,"b"', doc_id) when 1 then 'two\\nlines ' else concat('v', doc_id, j) end)))"""
    )
    rows = C.documents(spark, sf).select(
        F.col("rid").alias("id"), F.lit("t").alias("title"), F.array().cast("array<string>").alias("linked_parents"),
        F.parse_json(F.to_json(pairs)).alias("dublincore"), F.lit(None).cast("variant").alias("extensions"),
    )
    none = spark.createDataFrame([], "resource_id string, position int, content string")
    path = scratch(spark, "index-wide")
    SF.write_index(rows, none, path)
    wide = SF.read_index(spark, path)
    keys = wide.columns[len(SF.INDEX_CORE):]
    cells = F.arrays_zip(F.lit(keys).alias("key"), F.array(*(F.col(f"`{k}`") for k in keys)).alias("value"))
    return wide.select("id", F.inline(F.filter(cells, lambda c: c["value"] != "")))


@query(
    f"""WITH {O.DIVS} {O.DOC_TEXT}
    SELECT 'D' || doc_id AS id, 'Fragments: ' || CASE WHEN {O.GOOD} THEN '1' ELSE '0' END AS fragments,
      CASE WHEN NOT {O.GOOD} THEN NULL WHEN length({O.ws("with_heads")}) <= 1200 THEN {O.ws("with_heads")}
        ELSE rtrim(substr({O.ws("with_heads")}, 1, 1200)) || '…' END AS content FROM doc_text"""
)
def report_file(spark: SparkSession, sf: str) -> DataFrame:
    """The text report written to files and read back: each block is cut at its rule."""
    path = scratch(spark, "report")
    SF.write_report(R.report_lines(results(spark, sf), whole(spark, sf)), path)
    blocks = SF.read_report(spark, path)
    lines = F.split(F.col("block"), "\n")
    content = F.split(F.split(F.col("block"), "breadcrumb: \n\n")[1], "\n")[0]
    return blocks.select(
        F.regexp_extract(lines[0], "^ID       : (.*)$", 1).alias("id"), lines[2].alias("fragments"),
        F.when(F.contains("block", F.lit("Fragment 1")), content).alias("content"),
    )


REASONS = [
    None, "forbidden character", "stray markup", "malformed tag", "malformed processing instruction", "undefined entity",
    "text too long", "nested too deep", "unmatched closing tag", "text outside the root", "unclosed element",
    "not one root element", "more than one document",
]


@query(
    "SELECT 'D' || doc_id AS resource_id, list_extract(["
    + ", ".join("NULL" if r is None else f"'{r}'" for r in REASONS)
    + "], CAST(doc_id % 13 + 1 AS INT)) AS reason FROM documents WHERE doc_id % 13 <> 0"
)
def xml_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Every reason for which a document is set aside."""
    return S.shred(C.faulty(spark, sf), max_depth=3, max_text=60).quarantine


@query(
    r"""WITH p AS (SELECT page_id, html, CASE WHEN contains(html, '</p>') THEN substr(html, 1, strpos(html, '</p>') - 1) ELSE html END AS before FROM pages)
    SELECT 'W' || page_id AS resource_id,
      CASE WHEN contains(regexp_replace(before, '&(amp|lt|gt|quot|apos|#[0-9]+|#x[0-9A-Fa-f]+);', '', 'g'), '&')
        THEN 'undefined entity' ELSE 'unmatched closing tag' END AS reason FROM p"""
)
def page_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that are not well-formed XML, with the first fault: a script ends a paragraph that was not begun."""
    return S.shred(C.page_documents(spark, sf)).quarantine


@query(
    """SELECT 'D' || doc_id AS resource_id, unnest(['r', 'd']) AS xml_id, unnest([0, doc_id % 4 + 1]) AS pos FROM documents
    UNION ALL SELECT 'D' || doc_id, 'x', doc_id % 4 FROM documents WHERE doc_id % 4 > 0"""
)
def xml_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The element of every id; of several with one id the last."""
    xml = "concat('<a xml:id=\"r\">', repeat('<b xml:id=\"x\"/>', cast(doc_id % 4 as int)), '<c xml:id=\"d\"/></a>')"
    docs = C.documents(spark, sf).select(F.col("rid").alias("resource_id"), F.expr(xml).alias("xml"))
    return S.xml_ids(S.shred(docs, clustered=True).tokens).select("resource_id", "xml_id", F.col("pos").cast("bigint").alias("pos"))


@query(
    f"""WITH n AS (SELECT count(*) AS n FROM embeddings), v AS (SELECT vec_id, embedding FROM embeddings)
    SELECT {POINT_ID} AS id, 'D' || doc_id AS record_id, CAST(len(embedding) AS BIGINT) AS dims, embedding[1] AS first_value
    FROM documents, n JOIN v ON vec_id = doc_id % n.n"""
)
def points_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Points with a vector for every notice, counted in the job that writes them."""
    payloads = X.vector_payloads(notices(spark, sf), whole(spark, sf), include_fragments=False)
    rows = C.table(spark, sf, "embeddings")
    n = rows.count()
    vectors = C.documents(spark, sf).select("rid", (F.col("doc_id") % n).alias("vec_id")).join(rows, "vec_id")
    points, counts = X.checked_points(payloads, vectors.select(F.col("rid").alias("id"), F.col("embedding").alias("vector")))
    path = scratch(spark, "points-checked")
    SF.write_points(points, path, counts)
    v = F.col("v")
    return spark.read.text(path).select(F.parse_json("value").alias("v")).select(
        V.get(v, "id", type="decimal(20,0)").alias("id"),
        V.get(v, "payload", "record_id").alias("record_id"),
        F.size(V.get(v, "vector", type="array<float>")).cast("bigint").alias("dims"),
        F.get(V.get(v, "vector", type="array<float>"), 0).alias("first_value"),
    )


@query(
    """WITH v AS (SELECT CASE WHEN vec_id % 10 = 3 THEN 'X' ELSE 'D' END || vec_id AS id FROM embeddings
      UNION ALL SELECT 'D' || vec_id FROM embeddings WHERE vec_id % 10 = 4),
    one AS (SELECT id, count(*) AS n FROM v GROUP BY id), d AS (SELECT 'D' || doc_id AS id FROM documents)
    SELECT CAST(count(*) FILTER (one.id IS NULL) AS BIGINT) AS without_vector, CAST(count(*) FILTER (d.id IS NULL) AS BIGINT) AS without_notice,
      CAST(count(*) FILTER (n > 1) AS BIGINT) AS repeated, CAST(count(*) FILTER (d.id IS NOT NULL AND n = 1) AS BIGINT) AS points
    FROM d FULL JOIN one ON d.id = one.id"""
)
def points_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    """Missing, foreign and repeated vectors, as the writing job counts them."""
    payloads = X.vector_payloads(notices(spark, sf), whole(spark, sf), include_fragments=False)
    own = C.table(spark, sf, "embeddings").selectExpr("concat(if(vec_id % 10 = 3, 'X', 'D'), vec_id) AS id", "embedding AS vector", "vec_id")
    vectors = own.unionByName(own.filter("vec_id % 10 = 4")).drop("vec_id")
    points, counts = X.checked_points(payloads, vectors)
    path = scratch(spark, "points-mismatch")
    try:
        SF.write_points(points, path, counts)
    except ValueError:
        pass  # what it counted is shown
    n = spark.read.text(path).count()
    return spark.range(1).select(*(F.lit(counts.get[c]).cast("bigint").alias(c) for c in X.MISMATCHES), F.lit(n).cast("bigint").alias("points"))


ROUTED = f"""frags AS (SELECT rid FROM members WHERE {O.GOOD} AND {O.NAV_ROUTE}
  UNION ALL SELECT rid FROM docs WHERE {O.GOOD} AND NOT ({O.NAV_ROUTE}))"""


@query(f"WITH {O.MEMBERS} {ROUTED} SELECT rid AS id, CAST(count(*) AS BIGINT) AS fragments FROM frags GROUP BY rid")
def run_views(spark: SparkSession, sf: str) -> DataFrame:
    """The tables of a run as views, joined in SQL."""
    tree_run(spark, sf).register("checked_")
    return spark.sql(
        "SELECT r.id, count(*) AS fragments FROM checked_resource_results r JOIN checked_fragments f ON f.resource_id = r.id GROUP BY r.id"
    )


@query(
    """WITH d AS (SELECT doc_id FROM documents), r AS (SELECT doc_id FROM d WHERE doc_id % 11 <> 5)
    SELECT 'resource_results.D' || doc_id || '.linked_parents' AS path, '["x","x"] has non-unique elements' AS message
      FROM r WHERE doc_id % 5 = 0
    UNION ALL SELECT 'resource_results.D' || doc_id || '.title', '["t"] is not of type ''string'', ''null''' FROM r WHERE doc_id % 7 = 0
    UNION ALL SELECT 'collection_results.C' || doc_id || '.linked_parents', 'None is not of type ''array''' FROM d WHERE doc_id % 4 = 0
    UNION ALL SELECT 'summary', (SELECT count(*) FROM r) || ' ' || (SELECT count(*) FROM r WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0)
      || ' ' || (SELECT count(*) FROM r WHERE doc_id % 5 = 0 OR doc_id % 7 = 0)
      || ' ' || (SELECT count(*) FILTER (doc_id % 5 = 0) + count(*) FILTER (doc_id % 7 = 0) FROM r)"""
)
def run_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Validation of a run with faulty resources and collections."""
    run = tree_run(spark, sf)
    number = F.substr("id", F.lit(2)).cast("long")
    odd = dataclasses.replace(
        run,
        resources=run.resources.withColumns({
            "linked_parents": F.when(number % 5 == 0, F.array(F.lit("x"), F.lit("x"))).otherwise(F.col("linked_parents")),
            "title": F.when(number % 7 == 0, F.parse_json(F.lit('["t"]'))).otherwise(F.col("title").cast("variant")),
        }),
        collections=run.collections.withColumn("linked_parents", F.when(number % 4 != 0, F.col("linked_parents"))),
    )
    output, summary = odd.validate()
    line = F.concat_ws(" ", "total", "valid", "invalid", "issues")
    return output.select("path", "message").unionByName(summary.select(F.lit("summary").alias("path"), line.alias("message")))


@query(
    """SELECT CAST(count(*) AS BIGINT) AS collections, CAST(count(*) * 13 AS BIGINT) AS collection_members,
      CAST(0 AS BIGINT) AS resources, CAST(0 AS BIGINT) AS fragments, true AS nothing_retrieved FROM documents"""
)
def run_empty(spark: SparkSession, sf: str) -> DataFrame:
    """A run of which no document landed: collections list members, yet no resource came back."""
    landed = PL.Landed(payloads=C.tree_payloads(spark, sf), documents=C.tei(spark, sf).filter("resource_id IS NULL"))
    run = PL.run(landed, PL.CollectionParams("C0"))
    return R.run_summary(run.collections, run.resources, run.fragments)


@query(ORACLES["meta_flat"])
def notice_values(spark: SparkSession, sf: str) -> DataFrame:
    """Every value of the notices made from results."""
    return M.flat_entries(notices(spark, sf))


@query(f"WITH {O.META} {O.temporal(O.DATED, 't')}, {FLAT_TEXT} SELECT rid AS id, key, value FROM entries")
def search_values(spark: SparkSession, sf: str) -> DataFrame:
    """Every flat value of the search documents."""
    none = spark.createDataFrame([], ", ".join(f"{n} {t}" for n, t in FR.FRAGMENT_COLUMNS.items()))
    rows = X.search_documents(notices(spark, sf), none, include_fragments=False)
    return rows.select("id", F.explode("metadata_flat").alias("key", "v")).select("id", "key", V.leaf_text(F.col("v")).alias("value"))
