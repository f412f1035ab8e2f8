"""Walks, whole runs, exports, validation, logs, sources and sinks on small literal data."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from quire.operators import exports as X
from quire.operators import metadata as M
from quire.operators import notices as NO
from quire.operators import reports as R
from quire.operators import requestlog as L
from quire.operators import temporal as TM
from quire.operators import validate as VA
from quire.operators import walk as W
from quire.operators.shred import TEI_NAMESPACE
from quire.plans import corpus as PL
from quire.session import by_resource, checkpoint_root, materialize
from quire.sinks import files as SF
from quire.sources import payloads as P
from quire.sources import results as SR

TEI = (
    f'<TEI xmlns="{TEI_NAMESPACE}"><text><body><head>Whole</head>'
    '<div xml:id="intro"><head>Introduction</head><p> Some text.</p></div>'
    '<div xml:id="end"><head>Pièces</head><p> More.</p></div></body></text></TEI>'
)
RES1 = {
    "@id": "R1",
    "@type": "Resource",
    "title": "First",
    "citationTrees": {"maxCiteDepth": 2},
    "dublincore": {"creator": "Ann Author", "date": 2025, "title": "First"},
    "extensions": {"dct:coverage": "1280/1284", "dct:creator": [{"@id": "https://id.example/1"}], "download": "x"},
}
RES2 = {"@id": "R2", "@type": "Resource", "title": "Second", "dublinCore": {"creator": ["B", "C"]}}
ROOT = {
    "@id": "C",
    "@type": "Collection",
    "title": "Root",
    "member": [{"@id": "R1", "@type": "Resource", "title": "First"}, {"@id": "R2"}, {"@id": "R3"}, {"@id": "C"}],
    "dublincore": {"title": "Root", "rights": "free"},
}
NAV = {
    "citationTrees": {"maxCiteDepth": 2},
    "member": [
        {"@id": "#intro", "level": 1, "dublincore": {"title": "Introduction"}},
        {"@id": "#end", "level": 1, "dublincore": {"title": "Pièces"}},
    ],
}


def table(spark, rows, key, value="payload"):
    data = [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in rows.items()]
    return spark.createDataFrame(data, f"{key} string, {value} string")


@pytest.fixture(scope="module")
def landed(spark):
    return PL.Landed(
        payloads=table(spark, {"C": ROOT, "R1": RES1, "R2": RES2, "X": "oops"}, "request_id"),
        documents=table(spark, {"R1": TEI, "R2": TEI}, "resource_id", "xml"),
        navigation=table(spark, {"R1": NAV}, "resource_id"),
        parents=table(
            spark,
            {"C": {"member": [{"@id": "TOP"}]}, "R1": {"member": [{"@id": "P"}, {"id": " Q "}, 3, {"@id": "P"}]}, "R2": "failed"},
            "request_id",
        ),
    )


@pytest.fixture(scope="module")
def saved(landed, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("run"))
    return PL.run_or_load(landed, path, PL.CollectionParams("C"))


def test_whole_run(saved):
    assert [(r["id"], r["linked_parents"], len(r["member"])) for r in saved.collections.collect()] == [("C", ["TOP"], 4)]
    got = {r["id"]: r["linked_parents"] for r in saved.resources.collect()}
    assert got == {"R1": ["P", "Q"], "R2": ["C"]}
    frags = {(r["resource_id"], r["id"]) for r in saved.fragments.collect()}
    assert frags == {("R1", "intro"), ("R1", "end"), ("R2", "__DOCUMENT__")}
    assert [r["object_id"] for r in saved.missing.collect()] == ["R3"]


def test_landed_again_renamed_or_nameless(spark):
    sub = {"@id": "https://x/sub", "@type": "Collection", "member": [{"@id": "R1"}, {"@id": "R9"}, {"@id": "alias"}]}
    padded = {**RES1, "@id": " R1 "}
    payloads = [
        ("C", {"@id": "https://x/C", "member": [{"@id": "sub"}, {"@id": "C"}, {"@id": "https://x/C"}]}), ("sub", sub), ("sub", sub),
        ("R1", padded), ("R1", padded), ("alias", padded), ("R9", {"@id": "  ", "@type": "Resource"}),
    ]
    data = [(k, json.dumps(v)) for k, v in payloads] + [("R1", "oops")]
    landed = PL.Landed(
        spark.createDataFrame(data, "request_id string, payload string"),
        table(spark, {"R1": TEI}, "resource_id", "xml"),
        spark.createDataFrame([("R1", json.dumps(NAV))] * 2, "resource_id string, payload string"),
    )
    run = PL.run(landed, PL.CollectionParams("C"))
    assert sorted(r["id"] for r in run.collections.collect()) == ["https://x/C", "https://x/sub"]
    assert [(r["id"], r["linked_parents"]) for r in run.resources.collect()] == [("R1", ["https://x/sub"])]
    assert sorted((r["resource_id"], r["id"]) for r in run.fragments.collect()) == [("R1", "end"), ("R1", "intro")]
    assert [r["reason"] for r in run.quarantine.collect()] == ["blank id"]
    assert run.missing.count() == 0


def test_run_switches(landed):
    from quire.operators.fragments import FragmentParams

    run = PL.run(
        landed,
        PL.CollectionParams("C", ["R1"], ["title"], [], fetch_linked_parents=False),
        PL.ResourceParams([], None, False, FragmentParams("document")),
    )
    root = run.collections.collect()[0]
    assert root["linked_parents"] == [] and root["extensions"] is None
    assert [(r["id"], r["linked_parents"], r["dublincore"]) for r in run.resources.collect()] == [("R2", ["C"], None)]


def test_missing_document_is_set_aside(landed, spark):
    docs = table(spark, {"R1": "<broken>"}, "resource_id", "xml")
    part = PL.Landed(landed.payloads, docs, landed.navigation, landed.parents)
    run = PL.run(part, PL.CollectionParams("C"))
    assert run.resources.count() == 0
    assert {r["resource_id"]: r["reason"] for r in run.quarantine.collect()} == {
        "R1": "unclosed element",
        "R2": "no document",
    }


def test_walk_details(spark):
    edges = spark.createDataFrame(
        [("W", "a", 1), ("W", "b", 0), ("a", "s", 0), ("b", "s", 0), ("b", "x", 1), ("x", "y", 0), ("s", "W", 0), ("y", "a", 0)],
        "parent_id string, child_id string, pos int",
    )
    got = {r["object_id"]: (r["depth"], r["found_by"]) for r in W.reach(edges, "W").collect()}
    assert got == {"W": (0, None), "a": (1, "W"), "b": (1, "W"), "s": (2, "a"), "x": (2, "b"), "y": (3, "x")}
    less = {r["object_id"] for r in W.reach(edges, "W", ["b"]).collect()}
    assert less == {"W", "a", "s"}


def test_temporal(spark):
    meta = {
        "dublincore": {"title": "T", "coverage": "1200/1499"},
        "extensions": {"publisher": {"name": "P"}, "dateCreated": "1972", "temporalCoverage": "1200/1499", "nested": {"date": True}},
    }
    n = spark.createDataFrame([("1", json.dumps(meta["dublincore"]), json.dumps(meta["extensions"]))], "id string, d string, e string")
    n = n.select("id", F.parse_json("d").alias("dublincore"), F.parse_json("e").alias("extensions"))
    got = {r["key"]: r["value"] for r in TM.temporal_long(n).collect()}
    want = {"extensions.nested.date": "true"}
    for key, (start, end) in {
        "dublincore.coverage": (1200, 1499),
        "extensions.dateCreated": (1972, 1972),
        "extensions.temporalCoverage": (1200, 1499),
    }.items():
        want |= {
            key: "1972" if start == end else "1200/1499",
            f"{key}_start": str(start),
            f"{key}_start_iso": f"{start}-01-01",
            f"{key}_end": str(end),
            f"{key}_end_iso": f"{end}-12-31",
        }
    assert got == want
    short = {r["key"] for r in TM.temporal_long(n, short=True).collect()}
    assert short == {"coverage", "coverage_start", "coverage_start_iso", "coverage_end", "coverage_end_iso"}


def test_exports(saved, spark, tmp_path):
    n = NO.from_results(saved.resources)
    names = {r["id"]: r["creator_names"] for r in NO.with_creators(n).collect()}
    assert names == {"R1": ["Ann Author"], "R2": ["B", "C"]}
    payloads = X.vector_payloads(n, saved.fragments)
    one = json.loads(payloads.filter("id = 'R1'").select(X.payload_object(payloads)).head()[0])
    assert one["record_id"] == one["id"] == "R1"
    assert one["dublincore__creator"] == "Ann Author"
    assert one["extensions__dct__coverage"] == "1280/1284"
    assert one["temporal__dublincore__date_start"] == 2025
    assert [f["id"] for f in one["fragments"]] == ["intro", "end"]
    vec = spark.createDataFrame([("R1", [0.5])], "id string, vector array<float>")
    with pytest.raises(ValueError, match="vectors length mismatch"):
        X.vector_points(payloads, vec)
    for ids in (["R1", "R9"], ["R1", "R2", "R2"], ["R1", "R2", "R9"]):
        odd = spark.createDataFrame([(i, [0.5]) for i in ids], "id string, vector array<float>")
        with pytest.raises(ValueError, match="vectors length mismatch"):
            X.vector_points(payloads, odd)
    assert X.vector_points(payloads).count() == 2
    actions = X.bulk_actions(X.search_documents(n, saved.fragments), "ix")
    SF.write_actions(actions, str(tmp_path / "a"))
    lines = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "a")).collect()]
    assert {(a["_op_type"], a["_index"], a["_id"]) for a in lines} == {("index", "ix", "R1"), ("index", "ix", "R2")}
    SF.write_payloads(payloads, str(tmp_path / "p"))
    assert spark.read.text(str(tmp_path / "p")).count() == 2
    rows = NO.flat_rows(n, saved.fragments, include_fragments=True)
    assert {"dublincore.creator", "extensions.dct:coverage", "text", "fragments"} <= set(rows.columns)
    small = X.records(rows, {"id": "rid", "dublincore.date": "year"})
    assert {tuple(r) for r in small.collect()} == {("R1", "2025"), ("R2", None)}
    records = {r["key"]: r["text"] for r in X.fragment_records(n, saved.fragments).collect()}
    assert set(records) == {"R1__frag_0", "R1__frag_1", "R2__frag_0"}


def test_key_collisions(spark):
    n = spark.createDataFrame([("1", '{"a.b":1,"a:b":2}')], "id string, d string").select(
        "id", F.parse_json("d").alias("dublincore"), F.parse_json(F.lit("{}")).alias("extensions")
    )
    assert [(r["safe_key"], r["keys"]) for r in X.key_collisions(n).collect()] == [
        ("dublincore__a__b", ["dublincore.a.b", "dublincore.a:b"])
    ]


def test_index_file(saved, spark, tmp_path):
    path = str(tmp_path / "index")
    SF.write_index(saved.resources, saved.fragments, path)
    rows = {r["id"]: r.asDict() for r in SF.read_index(spark, path).collect()}
    assert rows["R1"]["linked_parents"] == '["P", "Q"]'
    assert rows["R1"]["extensions.dct:creator"] == '[{"@id": "https://id.example/1"}]'
    assert rows["R2"]["extensions.dct:creator"] == "" and rows["R2"]["fragments_count"] == "1"
    assert rows["R2"]["dublincore.creator"] == '["B", "C"]'


def test_report_file(saved, spark, tmp_path):
    path = str(tmp_path / "report")
    SF.write_report(R.report_lines(saved.resources, saved.fragments), path, 1)
    lines = [r[0] for r in spark.read.text(path).collect()]
    assert lines[0] == "=" * 100 and lines[1] == "ID       : R1"
    assert lines.index("ID       : R2") > lines.index("Fragment 2")


def test_report_blocks_of_many_files(spark, tmp_path):
    ids = [f"D{i:03}" for i in range(60)]
    results = spark.createDataFrame([(i, f"T{i}") for i in ids], "id string, title string")
    frags = spark.createDataFrame(
        [(i, n, f"f{n}", "1", None, "", f"text {i} {n} " * n) for i in ids for n in range(4)],
        "resource_id string, position int, id string, level string, head string, breadcrumb string, content string",
    )
    path = str(tmp_path / "report")
    SF.write_report(R.report_lines(results, frags), path, 5)
    assert len([f for f in (tmp_path / "report").iterdir() if f.name.startswith("part-")]) > 1
    for size in ("128m", "700", "101"):  # splits inside blocks and inside rules
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            blocks = [r[0] for r in SF.read_report(spark, path).collect()]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert sorted(b.split("\n")[0] for b in blocks) == [f"ID       : {i}" for i in ids]
        assert all(b.count("Fragment ") == 4 and b.split("\n")[2] == "Fragments: 4" for b in blocks)


def test_report_lines_make_the_fragments_once(spark):
    ids = spark.range(3).select(F.concat(F.lit("D"), "id").alias("id"))
    frags = ids.selectExpr(
        "id AS resource_id", "0 AS position", "'f' AS id", "'1' AS level", "'h' AS head", "'' AS breadcrumb", "repeat('x ', 900) AS content"
    )
    lines = R.report_lines(spark.createDataFrame([("D0", "t"), ("D9", "t")], "id string, title string"), frags)
    assert "Range (0" not in lines._jdf.queryExecution().toString()
    assert lines.filter("part = 1 AND line_no = 7 AND length(line) > 1190 AND line LIKE '%…'").count() == 3
    assert {r["line"] for r in lines.filter("part = 0 AND line_no = 3").collect()} == {"Fragments: 1", "Fragments: 0"}


def test_summary_and_preview(saved, spark):
    s = R.run_summary(saved.collections, saved.resources, saved.fragments).head()
    assert s.asDict() == {
        "collections": 1,
        "collection_members": 4,
        "resources": 2,
        "fragments": 3,
        "nothing_retrieved": False,
    }
    none = saved.resources.limit(0)
    assert R.run_summary(saved.collections, none, saved.fragments.limit(0)).head()["nothing_retrieved"]
    first = R.preview(saved.resources, saved.fragments, 1).collect()
    assert [(r["id"], r["fragments"], r["fragment_id"]) for r in first] == [("R1", 2, "intro")]


def test_validation(saved, spark):
    issues, summary = saved.validate()
    assert issues.count() == 0
    assert summary.head().asDict() == {"total": 2, "valid": 2, "invalid": 0, "issues": 0}
    bad = {
        "1": '{"id":3,"fragments":[{"id":"a"},{"content":1,"id":"b","level":1.5}],"linked_parents":["a","a",4]}',
        "2": '{"@type":"Collection","@id":"x","totalItems":1.0,"title":null}',
        "3": "[1]",
        "4": '{"resource_results":[{"id":"a","metadata":{},"fragments":[{"id":1,"content":""}]}],"collection_results":[{}],"meta":{},"type":"All"}',
        "5": '{"@type":"Resource","@id":"x","title":true,"mediaTypes":{}}',
    }
    rows = table(spark, bad, "record_id", "j").select("record_id", F.parse_json("j").alias("record"))
    got = {}
    for r in VA.issues(VA.check(rows)).orderBy("record_id", "seq").collect():
        got.setdefault(r["record_id"], []).append((r["path"], r["message"]))
    assert [p for p, _ in got["1"]] == [
        None,
        "fragments.0",
        "fragments.1.content",
        "fragments.1.level",
        "id",
        "linked_parents",
        "linked_parents.2",
    ]
    assert "2" not in got
    assert got["3"] == [(None, "[1] is not of type 'object'")]
    assert ("resource_results.0.fragments.0.id", "1 is not of type 'string'") in got["4"]
    assert (None, "'dtsVersion' is a required property") in got["4"]
    assert sum(p == "collection_results.0" for p, _ in got["4"]) == 5
    assert got["5"] == [
        ("mediaTypes", "{} is not of type 'array', 'null'"),
        ("title", "True is not of type 'string', 'null'"),
    ]
    with pytest.raises(ValueError, match="unknown profile"):
        VA.check(rows, "nope")


def test_request_outcomes(spark):
    log = spark.createDataFrame(
        [
            ("a", 1, 1, 500, False, None, 0),
            ("a", 2, 2, 200, False, None, 9),
            ("b", 3, 1, 404, False, None, 0),
            ("b", 4, 2, 200, False, None, 9),
            ("c", 5, 1, None, True, None, None),
            ("c", 6, 2, None, False, "reset", None),
            ("c", 7, 3, 200, False, None, 0),
            ("c", 8, 4, 200, False, None, 5),
        ],
        "request_key string, attempt_id long, ts long, status int, timed_out boolean, error string, body_len int",
    ).withColumn("ts", F.timestamp_seconds("ts"))
    got = {r["request_key"]: (r["outcome"], r["success"], r["attempts"]) for r in L.outcomes(log).collect()}
    assert got == {"a": ("ok", True, 2), "b": ("http", False, 1), "c": ("empty", False, 3)}
    more = {r["request_key"]: r["outcome"] for r in L.outcomes(log, retries=9).collect()}
    assert more["c"] == "ok"
    none = {r["request_key"]: r["outcome"] for r in L.outcomes(log, retries=-1).collect()}
    assert none == {"a": "http_500", "b": "http", "c": "timeout"}
    assert L.run_stats(log).head().asDict() == {
        "requests_total": 8,
        "http_errors": 5,
        "timeouts": 1,
        "http_500": 1,
        "elapsed_seconds": 3.0,
    }
    plan = L.outcomes(log)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_files_and_reload(spark, tmp_path):
    (tmp_path / "xml").mkdir()
    (tmp_path / "xml" / "a b.xml").write_text("<a>\n<b/>\n</a>", encoding="utf-8")
    (tmp_path / "xml" / "note.txt").write_text("no", encoding="utf-8")
    docs = P.read_documents(spark, str(tmp_path / "xml")).collect()
    assert [tuple(r) for r in docs] == [("a b", "<a>\n<b/>\n</a>")]
    (tmp_path / "json").mkdir()
    (tmp_path / "json" / "C.json").write_text(json.dumps(ROOT, indent=1), encoding="utf-8")
    described = P.objects(P.read_payload_files(spark, str(tmp_path / "json"))).collect()
    assert [(r["request_id"], r["object_id"], r["type"]) for r in described] == [("C", "C", "Collection")]
    path = str(tmp_path / "saved")
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    for use in (True, True, False):
        assert SR.reuse_or_write(spark, path, compute, use).count() == 3
    assert len(calls) == 2


def test_session_helpers(spark):
    df = by_resource(spark.range(10).withColumn("resource_id", F.col("id").cast("string")))
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert checkpoint_root(spark)
    assert materialize(df, "test").count() == 10


def test_raw_objects(spark):
    raw = P.objects(table(spark, {"R1": RES1, "R2": RES2}, "request_id"))
    rows = {r["id"]: str(r["dublincore"]) for r in NO.from_objects(raw).collect()}
    assert "Ann Author" in rows["R1"] and "C" in rows["R2"]
    linked = raw.withColumn("linked_parents", F.array())
    assert M.resource_results(linked).count() == 2


def test_a_level_moves_only_what_it_finds(spark):
    """Edges and what was seen are read from their buckets: one exchange, of the found objects."""
    edges = spark.range(4000).selectExpr("concat('a', id div 10) AS asked", "concat('a', id div 10) AS parent_id", "concat('a', id + 1) AS child_id", "0 AS pos")
    near, seen = W.Bucketed(spark, "t_edges", "asked", 4), W.Bucketed(spark, "t_seen", "object_id", 4)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert near.add(edges.repartition(4, "asked")) == 4000
        assert seen.add(spark.createDataFrame([("a0", None, 0)], W.VISIT), "depth") == 1
        level = W.next_level(near.rows, seen.rows, 0)
        assert {r["object_id"] for r in level.collect()} == {f"a{i}" for i in range(1, 11)}
        plan = level._jdf.queryExecution().executedPlan().toString()
        final = plan.split("== Initial Plan ==")[0]
        assert final.count("Exchange hashpartitioning(child_id") == 1 and final.count("Exchange ") == 1, final
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        near.forget()
        seen.forget()


def test_walk_of_a_deep_chain_and_no_edges(spark):
    chain = spark.range(40).selectExpr("concat('a', id) AS parent_id", "concat('a', (id + 1) % 40) AS child_id", "0 AS pos")
    got = {r["object_id"]: (r["depth"], r["found_by"]) for r in W.reach(chain, "a0").collect()}
    assert got == {f"a{i}": (i, f"a{i - 1}" if i else None) for i in range(40)}
    assert [tuple(r) for r in W.reach(chain.limit(0), "x").collect()] == [("x", None, 0)]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("quire_")]


def test_profiles_that_hold_themselves(spark):
    """Judged as deep as the record goes, whatever the depth."""
    tree = VA.Profile(("name",), {"name": VA.TEXT})
    tree.fields["children"] = VA.Field(("array",), items=tree)
    tree.fields["next"] = VA.Field(("object", "null"), inside=tree)
    deep = {"name": 5}
    for i in range(25):
        deep = {"name": "n", "children": [{"name": "ok"}, deep]} if i % 2 else {"name": "n", "next": deep}
    rows = [("deep", deep), ("flat", {"name": "x", "children": [{}, {"name": "y", "next": None}]}), ("list", [1]), ("none", {"name": "a[{[{"})]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in rows], "record_id string, text string")
    records = df.select("record_id", F.parse_json("text").alias("record"))
    got = {(r["record_id"], r["path"], r["message"]) for r in VA.issues(VA.check(records, tree)).collect()}
    path = ".".join(["next" if i % 2 == 0 else "children.1" for i in reversed(range(25))] + ["name"])
    assert got == {
        ("deep", path, "5 is not of type 'string'"), ("flat", "children.0", "'name' is a required property"),
        ("list", None, "[1] is not of type 'object'"),
    }


def test_newest_landing_without_moving_payloads(spark, tmp_path):
    """The last by time, then by place; identical rows once; keys without an id too."""
    rows = [("a", "old", 1), ("a", "new", 3), ("a", "mid", 2), ("b", "one", None), ("c", "same", 5), ("c", "same", 5),
            ("d", "x", 7), ("d", "y", 7), (None, "n1", 1), (None, "n2", 2), ("e", "t", None), ("e", "u", 1), ("f", None, 1)]
    path = str(tmp_path / "landed")
    spark.createDataFrame(rows, "request_id string, payload string, landed_at long").coalesce(1).write.parquet(path)
    landed = spark.read.parquet(path)
    one = P.one_each(landed, "request_id", "payload")
    assert sorted(map(str, (tuple(r) for r in one.collect()))) == sorted(map(str, [
        ("a", "new"), ("b", "one"), ("c", "same"), ("d", "y"), (None, "n2"), ("e", "u"), ("f", None)
    ]))
    plan = one._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(moved) == 1 and "_key" in moved[0]
    assert "ReadSchema: struct<request_id:string,landed_at:bigint>" in plan  # what is exchanged is read without payloads
    untimed = P.one_each(landed.drop("landed_at"), "request_id", "payload")
    got = {r["request_id"]: r["payload"] for r in untimed.collect()}
    assert untimed.count() == 7 and got["c"] == "same" and got["d"] in ("x", "y")


def test_a_save_that_stops_half_way_leaves_the_old_run(spark, saved, tmp_path, monkeypatch):
    path = str(tmp_path / "run")
    assert PL.load(spark, path) is None
    PL.save(saved, path)
    before = PL.load(spark, path)
    real = PL.write_results

    def stopped(tables, where, format="parquet"):
        real(dict(list(tables.items())[:3]), where, format)
        raise RuntimeError("executors lost")

    import dataclasses

    changed = dataclasses.replace(saved, resources=saved.resources.limit(0))
    monkeypatch.setattr(PL, "write_results", stopped)
    with pytest.raises(RuntimeError):
        PL.save(changed, path)
    again = PL.load(spark, path)
    assert again.resources.count() == before.resources.count() > 0
    assert again.resources.inputFiles() == before.resources.inputFiles()
    monkeypatch.setattr(PL, "write_results", real)
    # a manifest that was cut off is passed over, and a number that is taken is not used twice
    (tmp_path / "run" / "_manifests" / "000000000002.json").write_text('{"tables": {')
    assert PL.load(spark, path).resources.count() == before.resources.count()
    PL.save(changed, path)
    assert PL.load(spark, path).resources.count() == 0
    assert before.resources.count() > 0  # who reads the old version is not disturbed


def test_names_of_landed_files(spark, tmp_path):
    names = {"plain": "plain", "a%2Fb": "a/b", "a+b": "a b", "a%2Bb": "a+b", "100%": "100%", "sp ace": "sp ace", "é%C3%A9": "éé"}
    for name in names:
        (tmp_path / f"{name}.xml").write_text(f"<a>{name}</a>\n")
    got = {r["resource_id"]: r["xml"] for r in P.read_documents(spark, str(tmp_path)).collect()}
    assert got == {i: f"<a>{name}</a>\n" for name, i in names.items()}


def test_landed_files_of_many_folders_are_read_as_bytes(spark, tmp_path):
    """Files in folders below the landed one count too, and texts come back byte by byte."""
    texts = {"lines": "a\r\nb\n\n", "mark": "\ufeffx", "odd": "\x00 é \U0001f600"}
    for name, text in texts.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.xml").write_bytes(text.encode())
    (tmp_path / "flat.xml").write_bytes(b"\xff<a/>")
    (tmp_path / "other.json").write_text("{}")
    found = P.read_documents(spark, str(tmp_path))
    rows = {r.resource_id: bytes(r.b) for r in found.select("resource_id", F.col("xml").cast("binary").alias("b")).collect()}
    assert rows == {n: t.encode() for n, t in texts.items()} | {"flat": b"\xff<a/>"}


def test_points_are_checked_where_they_are_written(spark, tmp_path):
    payloads = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int").withColumn("safe", F.create_map().cast("map<string,variant>"))
    fine = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "id string, vector array<double>")
    points, counts = X.checked_points(payloads, fine)
    SF.write_points(points, str(tmp_path / "fine"), counts)
    assert spark.read.text(str(tmp_path / "fine")).count() == 2
    odd = spark.createDataFrame([("a", [1.0]), ("a", [1.0]), ("c", [2.0]), (None, [3.0])], "id string, vector array<double>")
    points, counts = X.checked_points(payloads, odd)
    with pytest.raises(ValueError, match="'without_vector': 1, 'without_notice': 2, 'repeated': 1"):
        SF.write_points(points, str(tmp_path / "odd"), counts)
    assert spark.read.text(str(tmp_path / "odd")).count() == 0


def test_index_lines_render_what_a_row_has(spark, tmp_path):
    names = [f"dublincore.k{i:03}" for i in range(40)] + ["dublincore.é", "dublincore.k001", "nowhere"]
    held = {"a": {"k000": "x", "k039": "y,z"}, "b": {"é": " e"}, "c": {}, "d": {f"k{i:03}": str(i) for i in range(60)}}
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in held.items()], "id string, dc string").select(
        "id", F.lit("t").alias("title"), F.array(F.lit("r")).alias("linked_parents"), F.parse_json("dc").alias("dublincore"),
        F.lit(None).cast("variant").alias("extensions"),
    )
    none = spark.createDataFrame([], "resource_id string, position int, content string")
    SF.write_index(df, none, str(tmp_path / "index"), names)
    assert "element_at" not in str(SF._cells_in_order(F.col("flat"), names))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "index")).collect()]
    found = {r[0]: r[5:] for r in csv.reader(lines) if r[0] != "id"}
    assert {len(r) for r in found.values()} == {len(names)}
    for k, v in held.items():
        assert found[k] == [v.get(n.removeprefix("dublincore."), "") for n in names]


def test_index_lines_of_an_empty_and_an_odd_table(spark, tmp_path):
    rows = [("a", "t,\"x\"", '{"k":" lead"}'), ("b", None, '{"k":"x\\ny","z z":"\\"q\\""}'), ("c", "", "{}")]
    df = spark.createDataFrame(rows, "id string, title string, dc string").select(
        "id", "title", F.array(F.lit("r")).alias("linked_parents"), F.parse_json("dc").alias("dublincore"),
        F.lit(None).cast("variant").alias("extensions"),
    )
    none = spark.createDataFrame([], "resource_id string, position int, content string")
    for n, some in (("all", df), ("none", df.limit(0))):
        SF.write_index(some, none, str(tmp_path / n))
    back = SF.read_index(spark, str(tmp_path / "all"))
    assert back.columns == [*SF.INDEX_CORE, "dublincore.k", "dublincore.z z"]
    assert sorted(map(tuple, back.collect())) == [
        ("a", 't,"x"', '["r"]', "0", "0", " lead", ""), ("b", "", '["r"]', "0", "0", "x\ny", '"q"'), ("c", "", '["r"]', "0", "0", "", ""),
    ]
    assert SF.read_index(spark, str(tmp_path / "none")).collect() == []


ODD_RECORDS = [
    '{"id":"a","metadata":{},"fragments":[]}', '{"id":5,"title":["t"],"metadata":[],"fragments":{}}', "[1]", '"s"', "null", "7", "{}",
    '{"id":null,"title":null,"linked_parents":["x","x",4],"metadata":{"a":1},"fragments":[{"id":"f"},3,null,{"id":1,"content":null,"level":1.0},'
    '{"id":"g","content":"c","level":1.5,"head":false,"breadcrumb":null},{"id":"h","content":"c","level":1e3}]}',
    '{"@id":"c","@type":"Shelf","title":"t","member":{},"totalItems":"many"}', '{"@type":"Resource","@id":7,"mediaTypes":"x","document":null}',
    '{"@type":"Collection","totalItems":2.0}',
    '{"resource_results":[{"id":"r"}],"collection_results":[{"@id":3,"member":[]}],"type":"All","meta":null,"dtsVersion":1}',
]


def test_profiles_written_out_find_what_the_table_of_nodes_finds(spark, monkeypatch):
    rows = [(str(i), t) for i, t in enumerate(ODD_RECORDS)]
    records = spark.createDataFrame(rows, "record_id string, t string").select("record_id", F.parse_json("t").alias("record"))

    def found(profile):
        checked = VA.check(records, profile).select("record_id", "profile", F.to_json("issues").alias("issues"))
        return sorted(tuple(r) for r in checked.collect())

    for profile in (None, *VA.PROFILES):
        written = found(profile)
        monkeypatch.setattr(VA, "WRITTEN_OUT", 0)
        assert written == found(profile)
        monkeypatch.undo()
    assert len([i for _, _, i in written if i != "[]"]) > 5


def test_issues_are_judged_once(spark):
    """Spark would push a test of the number of issues below them, and judge each record again for it."""
    records = spark.createDataFrame([("1", "{}")], "record_id string, t string").select("record_id", F.parse_json("t").alias("record"))
    plan = VA.issues(VA.check(records, "resource_result"))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" in plan and "Filter" not in plan


def test_navigation_is_read_once_for_routes_members_and_trails(landed):
    run = PL.run(landed, PL.CollectionParams("R"))
    plan = run.fragments._jdf.queryExecution().optimizedPlan().toString()
    assert "generate posexplode" in plan.lower() and "parseJson" not in plan


def test_the_driver_holds_no_list_of_landed_files(spark, tmp_path):
    """Names are listed and read in tasks, folder by folder to any depth, empty files too."""
    want = {}
    for i in range(40):
        folder = tmp_path.joinpath("a b%20c", *["in"] * (i % 4))
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"é%2F{i}.xml").write_text("x" * i)
        (folder / "_hidden.xml").write_text("x")
        (folder / f"{i}.xml.part").write_text("x")
        want[f"é/{i}"] = "x" * i
    (tmp_path / "a b%20c" / "_temporary").mkdir()
    (tmp_path / "a b%20c" / "_temporary" / "t.xml").write_text("x")
    found = P.read_documents(spark, str(tmp_path / "a b%20c"))
    assert not [f for f in found.inputFiles() if f.endswith(".xml")]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want.items())
    one = P.read_documents(spark, str(tmp_path / "a b%20c" / "in" / "*.xml")).collect()  # a pattern goes to Spark's reader
    assert len(one) == 10
    (tmp_path / "none").mkdir()
    assert P.read_documents(spark, str(tmp_path / "none")).collect() == []


def test_long_landed_texts_are_handed_on_in_pieces(spark, tmp_path):
    for i in range(30):
        (tmp_path / f"{i}.xml").write_text(f"{i}" + "x" * 700_000)
    got = P.read_documents(spark, str(tmp_path)).select("resource_id", F.length("xml").alias("n")).collect()
    assert {r["resource_id"]: r["n"] for r in got} == {f"{i}": 700_000 + len(f"{i}") for i in range(30)}


def test_faults_of_a_run_are_judged_once(saved):
    """Neither table of a run is judged again to tell which records have issues at all."""
    output, _ = saved.validate()
    plan = output._jdf.queryExecution().optimizedPlan().toString()
    # resources are read from a checkpoint, so what is judged here are the collections
    judged = [line for line in plan.splitlines() if "array_sort" in line]
    assert len(judged) == 1 and "Filter" not in judged[0]
