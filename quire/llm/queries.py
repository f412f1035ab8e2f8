"""Registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, html_text, quality_classifier, quality_rules, secret_scan
from quire.llm import sentencepiece_viterbi as pieces
from quire.llm import sharding, simhash, table_clustering, token_counts, url_filter, warc, whitening
from quire.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

#: Longest sequence that a training example may have.
MAX_TOKENS = 1024

URL_RULES = [
    url_filter.Rule("allow", "org/"),
    url_filter.Rule("block", "example.org/es/"),
    url_filter.Rule("block", "example.org/en/1"),
    url_filter.Rule("allow", "com/fr/"),
    url_filter.Rule("block", "com/de/"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL; the trees learn from the URLs that a rule labels."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    url = F.col("url")
    found = url_filter.ruled(url_filter.host_of(url), url_filter.path_of(url), URL_RULES)
    learned = url_filter.fit(pages.select("url", found["verdict"].alias("verdict")))
    judged = url_filter.judge(pages, URL_RULES, learned)
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n = token_counts.token_count(spark, F.col("text"), public_tokenizers.path("byte_bpe_50k.json"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return docs.select("doc_id", size.alias("n_bytes"), n.alias("n_tokens")).withColumn(
        "over_limit", F.col("n_tokens") > MAX_TOKENS
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = decontaminate.contamination(docs.select("doc_id", "text"), items)
    figures = ["n_words", "n_hit", "n_items", "items_sha256"]
    return found.select("row.doc_id", *figures).withColumn("contaminated", decontaminate.contaminated())


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = quality_classifier.held_out(F.col("doc_id"))
    model = quality_classifier.learned(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out.alias("held_out"), quality_classifier.score(docs, F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", quality_classifier.predicted())


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    placed = sharding.assign(docs, ["lang", "source"], shards=8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", html_text.extract(F.col("html")).alias("text")).withColumn(
        "n_chars", F.char_length("text").cast("long")
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules.judge(docs)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), "kept", "rejected_by",
    ).withColumn("kept", F.col("kept") & ~F.col("base_failed")).drop("rejected_by")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = pieces.load(spark, public_tokenizers.path("piece_bpe_32k.model"))
    made = docs.select("doc_id", pieces.transcode(F.col("text"), model).alias("t"))
    return made.select("doc_id", "t.ids", F.size("t.ids").cast("long").alias("n_ids"), "t.round_trip")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every document, and digests of its redacted text."""
    docs = table(spark, sf_dir, "documents")
    forest = secret_scan.fit(spark)
    found = docs.select("doc_id", secret_scan.scan(spark, F.col("text"), F.col("source"), forest).alias("s"))
    return found.select(
        "doc_id", "s.n_candidates", F.size("s.findings").cast("long").alias("n_findings"), "s.findings",
        F.sha2("s.redacted", 256).alias("redacted_sha256"),
    )


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record of every page, written to seekable bundles and read back from them."""
    pages = table(spark, sf_dir, "pages")
    archive = warc.write(pages, F.col("page_id"), F.col("url"), F.col("html"))
    return warc.read(archive, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_table_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_clustering.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_token_counts, op3_decontamination, op4_quality_classifier, op5_hilbert_shards,
        op6_html_text, op7_quality_rules, op8_simhash, op9_sentencepiece, op10_secret_scan, op11_warc, op12_whitening, op13_table_clustering,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3_SQL = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
     d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
     asked AS (
       SELECT DISTINCT item_id, least(len(w), 13) AS size,
              array_to_string(w[pos:pos + least(len(w), 13) - 1], ' ') AS win
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS pos FROM i WHERE len(w) > 0)),
     sizes AS (SELECT DISTINCT size FROM asked),
     placed AS (
       SELECT doc_id, size, pos, array_to_string(w[pos:pos + size - 1], ' ') AS win
       FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS pos
             FROM d, sizes WHERE len(w) >= size)),
     hits AS (SELECT doc_id, item_id, pos, p.size AS size FROM placed p JOIN asked USING (size, win)),
     words AS (SELECT doc_id, count(DISTINCT k) AS n_hit
               FROM (SELECT doc_id, unnest(generate_series(pos, pos + size - 1)) AS k FROM hits) GROUP BY 1),
     items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
               FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP7_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
     d AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
                  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines,
                  len(string_split(text, chr(10))) AS n_lines
           FROM t),
     win AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, win) AS n
             FROM (SELECT doc_id, pos, array_to_string(w[pos:pos + 4], ' ') AS win
                   FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS pos FROM d WHERE len(w) >= 5))),
     rep AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words
             FROM (SELECT doc_id, unnest(generate_series(pos, pos + 4)) AS k FROM win WHERE n > 1) GROUP BY 1),
     m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
                  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                  len(full_lines) - len(list_distinct(full_lines)) AS n_dup_lines, n_lines,
                  coalesce(n_repeat_words, 0) AS n_repeat_words
           FROM d LEFT JOIN rep USING (doc_id)),
     f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND 10 * n_symbols <= n_words
         AND (n_dup_lines <= 2 OR 10 * n_dup_lines <= 3 * n_lines) AS kept
FROM f
"""

# base32 is five bits a letter: four letters for five hexadecimal digits
OP11_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
     d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS hex FROM p),
     f AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(generate_series(0, 31), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
           (CAST('0x' || substr(hex, 1 + 5 * CAST(i // 4 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31
           AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


def _clustering_sql(k: int = 16, rounds: int = 3, length: int = 64) -> str:
    """The rounds written out; a centroid is a list, an assignment the least (distance, number)."""
    steps = [f"""
WITH kept AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
              FROM embeddings
              WHERE len(embedding) = {length}
                AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {length}),
     c0 AS (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS number, x AS c
            FROM (SELECT x, sha256('1:' || vec_id) AS h FROM kept ORDER BY h LIMIT {k}))"""]
    assign = """
     a{0} AS (SELECT vec_id, any_value(x) AS x, min(struct_pack(d := d, number := number)) AS best
              FROM (SELECT vec_id, x, number,
                           list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
                    FROM kept, c{0}) GROUP BY vec_id)"""
    for i in range(rounds):
        steps.append(assign.format(i))
        steps.append(f"""
     m{i + 1} AS (SELECT number, list(m ORDER BY pos) AS c
              FROM (SELECT best.number AS number, pos, CAST(floor(CAST(sum(x[pos]) AS DOUBLE) / count(*)) AS BIGINT) AS m
                    FROM a{i}, (SELECT unnest(generate_series(1, {length})) AS pos) GROUP BY 1, 2) GROUP BY 1),
     c{i + 1} AS (SELECT number, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i + 1} m USING (number))""")
    steps.append(assign.format(rounds))
    return ",".join(steps) + f"""
SELECT vec_id, best.number AS cluster, CAST(best.d AS BIGINT) AS distance,
       CAST(sum(best.d) OVER (PARTITION BY best.number) AS BIGINT) AS cluster_inertia,
       CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON number = best.number
"""


ORACLES: dict[str, str] = {
    "op3_decontamination": OP3_SQL, "op7_quality_rules": OP7_SQL, "op11_warc": OP11_SQL,
    "op13_table_clustering": _clustering_sql(),
}
