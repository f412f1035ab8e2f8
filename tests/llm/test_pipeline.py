"""The registered queries and the pipeline against brute force and their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import TABLES, rows_of
from quire.llm import decontaminate, simhash
from quire.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    df = QUERIES[name](spark, SF)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert ours == rows_of(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_covers_its_table(spark, name):
    df = QUERIES[name](spark, SF)
    key = df.columns[0]
    table = spark.read.parquet(f"{SF}/{dict(page_id="pages", vec_id="embeddings").get(key, "documents")}.parquet")
    df = df.where("component = 1") if "component" in df.columns else df
    rows = [r[0] for r in df.select(key).collect()]
    assert sorted(rows) == sorted(r[0] for r in table.select(key).collect())


def test_native_cascade_runs_no_python(spark):
    plan = QUERIES["op7_quality_rules"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, step, left = docs.columns, docs, {}
    for name, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert step.columns == columns
        left[name] = step.count()
    assert left["quality classifier"] > left["SimHash near-dedup"] >= left["benchmark decontamination"] == left["secret scans"]
    ran = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, ran.collect())) == sorted(map(str, step.collect()))
    assert ran.where(~F.col("round_trip")).count() == 0

    # brute force over what the classifier keeps
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.quality(spark, docs, SF).collect()}
    prints = {i: simhash.fingerprint(t.encode()) for i, t in kept.items()}
    first = set()
    for i in sorted(prints):
        reach, seen = [i], {i}
        while reach:
            a = reach.pop()
            for b in prints:
                if b not in seen and bin(prints[a] ^ prints[b]).count("1") <= 2:
                    seen.add(b)
                    reach.append(b)
        if min(seen) == i:
            first.add(i)
    items = [decontaminate.words(r["text"].encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[a : a + 13]) for w in items if w for a in range(max(1, len(w) - 12))}
    clean = set()
    for i in first:
        w = decontaminate.words(kept[i].encode())
        hit = {k for a in range(len(w)) for n in {len(x) for x in windows} if tuple(w[a : a + n]) in windows for k in range(a, a + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            clean.add(i)
    assert {r["doc_id"] for r in ran.collect()} == clean


def test_stages_take_odd_and_empty_tables(spark):
    rows = [
        (1, None, None, None, None, "a"), (1, None, None, None, None, "a"), (2, "", "en", "s", 0, "b"), (None, "x y z", "en", "s", 5, "c"),
        (3, 'token = "0cf1bbc67ab39b2ddebadc809bed189ed8c6ac4d"', "en", "s", 50, "d"), (4, "z " * 40_000, "en", "s", 80_000, None),
    ]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality_score string")
    for docs in (odd, odd.where("1 = 0")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            assert out.count() <= docs.count()
        assert corpus_pipeline.encoded(spark, docs, SF).count() == docs.count()
    masked = {r["doc_id"]: r for r in corpus_pipeline.secrets(spark, odd, SF).collect()}
    assert masked[3]["text"] == 'token = "[SECRET]"' and masked[3]["n_chars"] == 18 and masked[1]["text"] is None
