"""The same results as plain SQL over the check tables (DuckDB dialect).

The SQL never builds XML or JSON: it states what the operators must find, straight from
the columns and lines the derived corpora are made of.
"""

from __future__ import annotations

BLANKS = r"[\t-\r\x1c-\x1f\x{85}\p{Z}]+"


def ws(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{BLANKS}', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANKS}|{BLANKS}$', '', 'g')"


def strip_head(content: str, head: str) -> str:
    c, h = ws(content), ws(head)
    return (
        f"case when {h} = '' then {c} when {c} = {h} then '' "
        f"when starts_with({c}, {h} || ' ') then trim(substr({c}, length({h}) + 2)) else {c} end"
    )


# one row per line; one row per division with its texts
LINES = """
docs AS (SELECT *, 'D' || doc_id AS rid, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT rid, doc_id, lang, source, unnest(ls) AS line,
                 generate_subscripts(ls, 1) - 1 AS i FROM docs),
"""
DIVS = f"""{LINES}
divs0 AS (SELECT rid, doc_id, lang, source, CAST(i // 5 AS BIGINT) AS k,
                 string_agg(line, chr(10) ORDER BY i) AS body,
                 array_to_string(list_slice(string_split({ws("arg_min(line, i)")}, ' '), 1, 3), ' ') AS head
          FROM lines GROUP BY ALL),
divs AS (SELECT *, chr(10) || body || chr(10) || 'é<&>' || chr(10) AS rest,
                head || ' stray' || k || ' ' || chr(10) || body || chr(10) || 'é<&>' || chr(10) AS own,
                CASE WHEN k % 7 = 6 THEN ' tail' || k || ' ' ELSE '' END AS tail,
                max(k) OVER (PARTITION BY rid) AS last_k
         FROM divs0),
"""
GOOD = "doc_id % 11 <> 5"
NAV_ROUTE = "doc_id % 12 <> 11 AND doc_id % 10 NOT IN (8, 9)"

# title, parents and metadata of the navigation members
MEMBERS = f"""{DIVS}
members AS (SELECT *,
    CASE k % 4 WHEN 0 THEN nullif(head, '') ELSE 'Part ' || k END AS title,
    CASE WHEN k % 7 = 6 THEN 'd' || (k - 1) END AS parent_id,
    CASE WHEN k % 7 = 6 AND doc_id % 2 = 0 THEN '#d' || (k - 1) END AS parent
  FROM divs),
crumbs AS (SELECT m.*, CASE WHEN p.title IS NOT NULL AND m.title IS NOT NULL
                            THEN p.title || ' > ' || m.title
                            ELSE coalesce(p.title, m.title, '') END AS breadcrumb
           FROM members m LEFT JOIN members p ON m.rid = p.rid AND m.k % 7 = 6 AND p.k = m.k - 1),
"""

DOC_TEXT = """
doc_text AS (SELECT rid, any_value(doc_id) AS doc_id,
    any_value(lang || ' ' || source) || chr(10) || string_agg(own || tail || chr(10), '' ORDER BY k) AS with_heads,
    string_agg(rest || tail || chr(10), '' ORDER BY k) AS without_heads
  FROM divs GROUP BY rid)
"""

# effective metadata of a described document
META = """
d AS (SELECT *, 'D' || doc_id AS rid, doc_id % 8 <> 7 AS has_dc,
        CAST(doc_id % 97 AS VARCHAR) AS n,
        CASE doc_id % 6 WHEN 0 THEN '1972' WHEN 1 THEN '1200/1499' WHEN 2 THEN '1200~'
             WHEN 3 THEN '1200/' WHEN 4 THEN '2021-05-01' ELSE CAST(1000 + doc_id % 1000 AS VARCHAR) END AS dt
      FROM documents),
dc AS (
  SELECT rid, 'dublincore.title' AS key, lang || ' ' || source || ' ' || doc_id AS value FROM d WHERE has_dc
  UNION ALL SELECT rid, 'dublincore.creator', CASE doc_id % 4 WHEN 1 THEN 'Author ' || n
      WHEN 2 THEN '["Author ' || n || '","Second"]' ELSE '' END FROM d WHERE has_dc AND doc_id % 4 <> 0
  UNION ALL SELECT rid, 'dublincore.date', dt FROM d WHERE has_dc
  UNION ALL SELECT rid, 'dublincore.source', source FROM d WHERE has_dc
  UNION ALL SELECT rid, 'dublincore.note', NULL FROM d WHERE has_dc
  UNION ALL SELECT rid, 'dublincore.deep.a.b', CAST(n_chars AS VARCHAR) FROM d WHERE has_dc),
ext AS (
  SELECT rid, unnest(['extensions.dct:coverage', 'extensions.dateCreated', 'extensions.temporalCoverage',
                      'extensions.open', 'extensions.list', 'extensions.@extra-key', 'extensions.rank']) AS key,
         unnest(['-50/20?', '  1300 ', '["1900"]', 'true', '[1,"b",{"q":null}]', 'v',
                 CAST(doc_id % 7 AS VARCHAR)]) AS value FROM d
  UNION ALL SELECT rid, 'extensions.creator', CASE doc_id % 5 WHEN 1 THEN 'Ext ' || n
      ELSE '[{"@id":"https://id.example/' || n || '","name":"L1","sameAs":["s1","s2"]},"Plain ' || n || '",7]' END
    FROM d WHERE doc_id % 5 IN (1, 3)
  UNION ALL SELECT rid, unnest(['extensions.creator.@id', 'extensions.creator.@type', 'extensions.creator.name',
                                'extensions.creator.sameAs']),
                   unnest(['https://id.example/' || n, 'Person', 'Obj ' || n, 'https://same.example/' || n])
    FROM d WHERE doc_id % 5 = 2
  UNION ALL SELECT rid, unnest(['extensions.creator.@id', 'extensions.creator.name']), unnest(['x', '']) FROM d
    WHERE doc_id % 5 = 4),
flat AS (SELECT * FROM dc UNION ALL SELECT * FROM ext),
"""

# year bounds by pattern, then the derived entries
YEARS = r"^(-?\d{1,4})([~?])?(/(-?\d{1,4})?([~?])?)?$"


def temporal(source: str, out: str) -> str:
    s, e = "y_start", "y_end"
    pad = lambda y: f"CASE WHEN length({y}) >= 4 THEN {y} ELSE lpad({y}, 4, '0') END"
    iso = lambda y, d: (
        f"CASE WHEN CAST({y} AS BIGINT) >= 0 THEN {pad(f'CAST(CAST({y} AS BIGINT) AS VARCHAR)')} || '{d}' "
        f"ELSE CAST(CAST({y} AS BIGINT) AS VARCHAR) END"
    )
    return f"""
{out}_y AS (SELECT rid, key, value, nullif(regexp_extract(trim(value), '{YEARS}', 1), '') AS y_start,
    CASE WHEN value LIKE '%/%' THEN nullif(regexp_extract(trim(value), '{YEARS}', 4), '')
         ELSE nullif(regexp_extract(trim(value), '{YEARS}', 1), '') END AS y_end
  FROM {source}),
{out} AS (
  SELECT rid, key, value FROM {out}_y
  UNION ALL SELECT rid, key || '_start', CAST(CAST({s} AS BIGINT) AS VARCHAR) FROM {out}_y WHERE {s} IS NOT NULL
  UNION ALL SELECT rid, key || '_start_iso', {iso(s, "-01-01")} FROM {out}_y WHERE {s} IS NOT NULL
  UNION ALL SELECT rid, key || '_end', CAST(CAST({e} AS BIGINT) AS VARCHAR) FROM {out}_y WHERE {e} IS NOT NULL
  UNION ALL SELECT rid, key || '_end_iso', {iso(e, "-12-31")} FROM {out}_y WHERE {e} IS NOT NULL)"""


DATED = "(SELECT * FROM flat WHERE key IN ('dublincore.date', 'extensions.dateCreated', 'extensions.temporalCoverage'))"

CREATORS = """
names AS (SELECT rid, doc_id, CASE doc_id % 5 WHEN 1 THEN 'Ext ' || n WHEN 2 THEN 'Obj ' || n
      WHEN 3 THEN 'L1|Plain ' || n
      ELSE CASE WHEN has_dc AND doc_id % 4 = 1 THEN 'Author ' || n
                WHEN has_dc AND doc_id % 4 = 2 THEN 'Author ' || n || '|Second' ELSE '' END END AS names
    FROM d),
"""

# graph reachability: least depth, then the smallest parent on the level before
def reach(edges: str) -> str:
    return f"""
walk(id, depth) AS (
  SELECT 'W', 0
  UNION SELECT e.child_id, w.depth + 1 FROM walk w JOIN {edges} e ON e.parent_id = w.id),
first AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id),
found AS (SELECT f.id, f.depth, min(p.id) AS found_by FROM first f
          LEFT JOIN {edges} e ON e.child_id = f.id
          LEFT JOIN first p ON p.id = e.parent_id AND p.depth = f.depth - 1
          GROUP BY f.id, f.depth)"""


GEO = """
edges AS (
  SELECT 'W' AS parent_id, 'R' || r_regionkey AS child_id FROM region
  UNION ALL SELECT 'R' || n_regionkey, 'N' || n_nationkey FROM nation
  UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer
  UNION ALL SELECT 'C' || o_custkey, 'O' || o_orderkey FROM orders),
objects AS (
  SELECT 'W' AS id, 'Collection' AS type, 'World' AS title
  UNION ALL SELECT 'R' || r_regionkey, 'Collection', r_name FROM region
  UNION ALL SELECT 'N' || n_nationkey, CASE WHEN n_nationkey = 7 THEN NULL ELSE 'Collection' END, n_name FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'Collection', c_name FROM customer
  UNION ALL SELECT 'O' || o_orderkey, 'Resource', o_orderpriority FROM orders WHERE o_orderkey % 13 <> 0),
"""

SUPPLY = """
edges AS (
  SELECT 'W' AS parent_id, 'N' || n_nationkey AS child_id FROM nation
  UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier
  UNION ALL SELECT DISTINCT 'S' || l_suppkey, 'P' || l_partkey FROM lineitem),
"""

LOG = """
log AS (SELECT user_id || ':' || strftime(ts, '%Y-%m-%d') AS request_key, event_id, ts, event_type,
    CASE event_type WHEN 'error' THEN 500 WHEN 'view' THEN 429 WHEN 'signup' THEN 404
                    WHEN 'purchase' THEN NULL ELSE 200 END AS status,
    CASE WHEN event_id % 9 = 0 THEN 0 ELSE CAST(regexp_extract(props, '\\d+') AS INT) END AS body_len
  FROM events),
classed AS (SELECT *, CASE WHEN event_type = 'purchase' THEN 'timeout'
    WHEN event_type = 'click' AND event_id % 10 = 0 THEN 'error'
    WHEN status = 500 THEN 'http_500' WHEN status NOT BETWEEN 200 AND 299 THEN 'http'
    WHEN body_len = 0 THEN 'empty' ELSE 'ok' END AS class FROM log),
tried AS (SELECT *, class IN ('timeout', 'error', 'empty') OR coalesce(status = 429 OR status BETWEEN 500 AND 599, false)
    AS retryable FROM classed)
"""
