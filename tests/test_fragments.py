"""Fragments against a small tree walk that knows nothing of markup rows."""

import json
import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from quire.operators import fragments as FR
from quire.operators import navigation as N
from quire.operators import selector as SEL
from quire.operators import shred as S

TEI = "{" + S.TEI_NAMESPACE + "}"
XID = "{http://www.w3.org/XML/1998/namespace}id"

SAMPLE = f"""<TEI xmlns="{S.TEI_NAMESPACE}"><teiHeader><title>T</title></teiHeader><text><body>
<head>Whole</head> lost <p>before</p>
<div xml:id="d1" type="x"><head>Première  partie</head> tail <p>one<?pi?> two</p>
 <div xml:id="d2"><head>Sub</head><p>in</p></div> after <p>last</p></div>
<div xml:id="d3"><p>no head</p></div><div/></body></text></TEI>"""


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "resource_id string, xml string")


def ws(text):
    return " ".join(text.split())


def text_without(node, skipped):
    """Text of a node; a skipped element goes with the text after it."""
    out = [node.text or ""]
    for child in node:
        if child not in skipped:
            out.append(text_without(child, skipped))
            out.append(child.tail or "")
    return "".join(out)


def random_tei(rng):
    count = [0]

    def div(depth):
        count[0] += 1
        xid = f' xml:id="n{count[0]}"' if rng.random() < 0.7 else ""
        kind = rng.choice(["a", "b"])
        heads = "".join(f"<head>{rng.choice(['Alpha', 'Bêta x', ''])}</head>{rng.choice(['', ' t ', ' '])}" for _ in range(rng.choice([0, 1, 1, 2])))
        inner = "".join(
            div(depth + 1) + rng.choice(["", " gap "]) if depth < 4 and rng.random() < 0.4 else f"<p>w{count[0]} <hi>x<head>inner</head> y</hi></p> "
            for _ in range(rng.randint(0, 3))
        )
        return f'<div type="{kind}"{xid}>{heads}{inner}</div>'

    body = "".join(div(1) for _ in range(rng.randint(1, 3)))
    return f'<TEI xmlns="{S.TEI_NAMESPACE}"><text><body><head>Top</head> {body}</body></text></TEI>'


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    docs = {f"r{i}": random_tei(rng) for i in range(25)}
    return docs, S.shred(frame(spark, docs)).materialize().tokens


def test_document_mode(corpus):
    docs, tokens = corpus
    kept = {r["resource_id"]: r["content"] for r in FR.document_fragments(tokens).collect()}
    bare = {r["resource_id"]: r["content"] for r in FR.document_fragments(tokens, False).collect()}
    for rid, xml in docs.items():
        text = ET.fromstring(xml).find(f".//{TEI}text")
        assert kept[rid] == ws("".join(text.itertext()))
        assert bare[rid] == ws(text_without(text, set(text.iter(f"{TEI}head"))))


def test_navigation_mode(spark, corpus):
    docs, tokens = corpus
    rng = random.Random(9)
    navs, want = [], {}
    for rid, xml in docs.items():
        root = ET.fromstring(xml)
        ids = [e.get(XID) for e in root.iter() if e.get(XID)]
        chosen = [i for i in ids if rng.random() < 0.7]
        navs.append((rid, json.dumps({"member": [{"@id": f"#{i}", "title": f"t {i}"} for i in [*chosen, "nowhere"]]})))
        marked = {e for e in root.iter() if e.get(XID) in chosen}
        for e in marked:
            want[rid, e.get(XID)] = ws(text_without(e, marked - {e}))
    members = N.members(spark.createDataFrame(navs, "resource_id string, payload string"), breadcrumbs=True)
    rows = FR.navigation_fragments(tokens, members).collect()
    assert {(r["resource_id"], r["id"]): r["content"] for r in rows} == want


SELECTORS = [
    (".//tei:div", f".//{TEI}div"),
    (".//tei:body/tei:div", f".//{TEI}body/{TEI}div"),
    ("./tei:text/tei:body//tei:div/tei:p", f"./{TEI}text/{TEI}body//{TEI}div/{TEI}p"),
    (".//tei:div[@type='a']", f".//{TEI}div[@type='a']"),
    (".//tei:div[@type='a']/tei:div", f".//{TEI}div[@type='a']/{TEI}div"),
    (".//tei:div[@type='a']//tei:hi", f".//{TEI}div[@type='a']//{TEI}hi"),
    (".//tei:head", f".//{TEI}head"),
    (".//tei:div[@type]//tei:hi | .//tei:p|.//tei:div[@xml:id]/tei:p", f".//{TEI}div[@type]//{TEI}hi | .//{TEI}p"),
    (".//tei:body//tei:div//tei:div/tei:p/tei:hi|./tei:text", f".//{TEI}body//{TEI}div//{TEI}div/{TEI}p/{TEI}hi | ./{TEI}text"),
    (".//tei:div[@none]|.//tei:div[@type='a']/tei:div[@type='b']", f".//{TEI}div[@type='a']/{TEI}div[@type='b']"),
    (".//*[@type='b']", f".//{TEI}div[@type='b']"),
]


@pytest.mark.parametrize(
    "xpath,plain,titles",
    [
        *((x, p, "./tei:head") for x, p in SELECTORS),
        (".//tei:div", f".//{TEI}div", "./tei:p/tei:hi/tei:head"),
        (".//tei:div", f".//{TEI}div", "./tei:div/tei:head|./tei:p"),
        (".//tei:body/tei:div", f".//{TEI}body/{TEI}div", ".//tei:head"),
    ],
)
def test_selector_mode(corpus, xpath, plain, titles):
    docs, tokens = corpus
    rows = FR.selector_fragments(tokens, xpath, titles).collect()
    got = {(r["resource_id"], r["fragment_index"]): (r["head"], r["content"]) for r in rows}
    want = {}
    for rid, xml in docs.items():
        root = ET.fromstring(xml)
        above = {c: e for e in root.iter() for c in e}
        order = {e: i for i, e in enumerate(root.iter())}
        chosen = {e for p in plain.split(" | ") for e in root.findall(p)}
        for n, e in enumerate(sorted(chosen, key=order.get)):
            heads = [h for p in titles.split("|") for h in e.findall(p.replace("tei:", TEI))]
            heads.sort(key=order.get)
            head = ws("".join(heads[0].itertext())) if heads else None
            up = above.get(e)
            while head is None and up is not None:
                found = up.findall(f"{TEI}head")
                if found:
                    head = ws(" ".join("".join(h.itertext()) for h in found))
                up = above.get(up)
            content = ws(text_without(e, set(heads)))
            if head and content == head:
                content = ""
            elif head and content.startswith(head + " "):
                content = content[len(head) + 1 :]
            if content:
                want[rid, n] = (head, content)
    assert got == want


def test_sample_details(spark):
    tokens = S.shred(frame(spark, {"r": SAMPLE})).materialize().tokens
    rows = {r["fragment_index"]: r for r in FR.selector_fragments(tokens, ".//tei:div").collect()}
    # the processing instruction hides the text after it once heads are skipped
    assert rows[0]["content"] == "one Subin after last"
    assert (rows[1]["id"], rows[1]["content"]) == ("d2", "in")
    assert (rows[2]["head"], rows[2]["content"]) == ("Whole", "no head")
    assert 3 not in rows  # empty content
    kept = FR.selector_fragments(
        tokens, ".//tei:div", add_head_to_content=True, exclude_heads_contains=["PREMIERE partie"]
    ).collect()
    by_index = {r["fragment_index"]: r["content"] for r in kept}
    assert by_index == {1: "Sub in", 2: "Whole no head", 3: "Whole"}
    again = FR.selector_fragments(tokens, ".//tei:p", generated_id_prefix="__T__").collect()
    twice = FR.selector_fragments(tokens, ".//tei:p", generated_id_prefix="__T__").collect()
    assert [r["id"] for r in again] == [r["id"] for r in twice]
    assert all(r["id"].startswith("__T__") for r in again)


def test_exclusion_keeps_breadcrumbs(spark):
    tokens = S.shred(frame(spark, {"r": SAMPLE})).tokens
    payload = {
        "member": [
            {"identifier": "x/d1/", "title": "Première partie"},
            {"id": "d2", "parent": "#d1", "dublincore": {"title": "Sub"}, "dublinCore": {"title": "S", "k": 1}},
            {"id": "d3", "references": [{"@id": "#d3"}], "title": "loop"},
        ]
    }
    nav = spark.createDataFrame([("r", json.dumps(payload))], "resource_id string, payload string")
    members = N.members(nav, breadcrumbs=True)
    rows = FR.navigation_fragments(
        tokens, members, False, ["premiere"], metadata_dublincore=["k"]
    ).collect()
    got = {r["id"]: (r["position"], r["content"], r["breadcrumb"], str(r["metadata_dublincore"])) for r in rows}
    assert got["d2"][:3] == (0, "Subin", "Première partie > Sub")
    assert got["d3"][:3] == (1, "no head", "loop")
    assert '"k"' in got["d2"][3] or "k" in got["d2"][3]
    assert [tuple(r) for r in FR.head_mismatches(members).collect()] == [("r", "d2", "Sub", "S")]


def test_routing(spark):
    docs = frame(spark, {"a": SAMPLE, "b": SAMPLE, "c": SAMPLE, "bad": "<x>"})
    res = spark.createDataFrame(
        [("a", 2), ("b", 0), ("c", 1), ("bad", 1)], "resource_id string, max_cite_depth int"
    )
    member = {"member": [{"id": "d1", "title": "t"}]}
    nav = spark.createDataFrame(
        [("a", json.dumps(member)), ("b", json.dumps(member)), ("c", json.dumps({**member, "citationTrees": {"maxCiteDepth": 0}}))],
        "resource_id string, payload string",
    )

    def ids(params):
        cut = FR.split(docs, res, nav, params)
        return {(r["resource_id"], r["id"]) for r in cut.fragments.collect()}, cut.quarantine.count()

    doc = FR.DOCUMENT_ID
    assert ids(FR.FragmentParams()) == ({("a", "d1"), ("b", doc), ("c", doc)}, 1)
    assert ids(FR.FragmentParams("navigation")) == ({("a", "d1"), ("b", "d1"), ("c", doc)}, 1)
    assert ids(FR.FragmentParams("document"))[0] == {("a", doc), ("b", doc), ("c", doc)}
    assert ids(FR.FragmentParams(fetch_navigation=False))[0] == {("a", doc), ("b", doc), ("c", doc)}
    assert ids(FR.FragmentParams(fetch_document=False)) == (set(), 0)
    with pytest.raises(ValueError, match="unknown fragment mode"):
        FR.split(docs, res, nav, FR.FragmentParams("pages"))
    with pytest.raises(ValueError, match="fragment_xpath"):
        FR.split(docs, res, nav, FR.FragmentParams("tei_xpath"))


def test_routes_and_modes_read_raw_documents_once(spark, tmp_path):
    docs = {"a": SAMPLE, "b": SAMPLE, "bad": "<x>"}
    path = str(tmp_path / "rawdocs")
    frame(spark, docs).write.parquet(path)
    res = spark.createDataFrame([("a", 2), ("b", 0), ("bad", 1)], "resource_id string, max_cite_depth int")
    nav = spark.createDataFrame([(r, json.dumps({"member": [{"id": "d1", "title": "t"}]})) for r in docs], "resource_id string, payload string")
    read = spark.read.parquet(path)
    both = FR.split(read, res, nav).fragments
    assert {(r["resource_id"], r["id"]) for r in both.collect()} == {("a", "d1"), ("b", FR.DOCUMENT_ID)}
    raw = "ReadSchema: struct<resource_id:string,xml:string>"
    plan = both._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count(raw) == 1
    modes = {
        "document": FR.FragmentParams("document", add_head_to_content=False), "navigation": FR.FragmentParams("navigation"),
        "x": FR.FragmentParams("tei_xpath", fragment_xpath=".//tei:div[@type]"), "p": FR.FragmentParams("tei_xpath", fragment_xpath=".//tei:p"),
    }
    many = FR.split_modes(read, res, nav, modes)
    for name, params in modes.items():
        alone = FR.split(read, res, nav, params)
        assert sorted(map(str, many[name].fragments.collect())) == sorted(map(str, alone.fragments.collect()))
        later = many[name].fragments._jdf.queryExecution().executedPlan().toString()
        assert raw not in later  # the stored rows are read, not the documents
        assert [tuple(r) for r in many[name].quarantine.collect()] == [("bad", "unclosed element")]


def test_whole_documents_of_both_ways_are_equal(spark, corpus):
    _, tokens = corpus
    extra = S.shred(frame(spark, {"no": f'<TEI xmlns="{S.TEI_NAMESPACE}"><p>x</p></TEI>', "e": f'<TEI xmlns="{S.TEI_NAMESPACE}"><text/>y</TEI>',
                                  "pi": f'<TEI xmlns="{S.TEI_NAMESPACE}"><text>a<?x?>b<group><text>c</text></group> <head>h</head>d<?y?> e</text>z</TEI>'}))
    none = N.members(spark.createDataFrame([], "resource_id string, payload string"), breadcrumbs=True)
    for some in (tokens, extra.tokens):
        for heads in (True, False):
            one = FR.document_fragments(some, heads).select("resource_id", "id", "content", "position", "breadcrumb")
            way = FR.navigation_fragments(some.withColumn("route", F.lit("document")), none, heads)
            two = way.select("resource_id", "id", "content", "position", "breadcrumb")
            assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


@pytest.mark.parametrize("title", ["/tei:head", "./tei:div//tei:head", "x"])
def test_unsupported_titles(title):
    with pytest.raises(ValueError):
        SEL.compile_paths(".//tei:div", title)


def test_markup_is_not_written_out(spark):
    rows = S.shred(frame(spark, {"r": SAMPLE})).rows
    assert "markup" in rows.columns and "markup" not in FR.selection(rows, ".//tei:div[@type]", "./tei:head").columns


@pytest.mark.parametrize("xpath", ["", "div", ".//tei:a|", "|", ".//tei:div[@a='x|", ".//tei:div[1]", ".//tei:div/text()", ".//tei:a[b]"])
def test_unsupported_selectors(xpath):
    with pytest.raises(ValueError):
        SEL.parse(xpath)


def brute_trail(index, start):
    out, seen, at = [], set(), start
    while at in index and at not in seen:
        seen.add(at)
        up, title = index[at]
        out.insert(0, title)
        at = up
    return " > ".join(t for t in out if t)


def forests():
    r = random.Random(7)
    loops = [("a", "b", "A"), ("b", "a", "B"), ("c", "a", None), ("d", "gone", "D"), ("e", "e", "E"), ("f", "e", ""), ("g", "f", "G")]
    chain = [(f"n{i}", f"n{i - 1}" if i else None, f"t{i}" if i % 3 else None) for i in range(700)]
    again = [("a", "b", "A"), ("b", None, "first"), ("b", "c", "B"), ("c", None, "C"), (None, "a", "no id"), ("é", "a", "z"), ("\U0001f600", "é", "y")]
    yield from (loops, chain, again, [], [(None, None, "x")])
    for _ in range(20):
        n = r.randint(1, 30)
        yield [(f"m{r.randrange(n)}", f"m{r.randrange(n + 2)}" if r.random() < 0.8 else None, r.choice(["", None, "x", "y z"])) for _ in range(n)]


def test_breadcrumbs_in_the_row_equal_a_climb(spark):
    rows, want, aligned = [], {}, {}
    for i, members in enumerate(forests()):
        listed = [{k: v for k, v in (("id", m), ("parent", p), ("title", t)) if v is not None} for m, p, t in members]
        rows.append((f"r{i}", json.dumps({"member": [*listed, 5, "x"]})))
        index = {m: (p, t) for m, p, t in members if m is not None}
        want |= {(f"r{i}", m): brute_trail(index, m) for m in index}
        aligned |= {(f"r{i}", k): None if m is None else brute_trail(index, m) for k, (m, _, _) in enumerate(members)}
    nav = spark.createDataFrame(rows, "resource_id string, payload string")
    out = N.breadcrumbs(nav)
    assert {(r[0], r[1]): r[2] for r in out.collect()} == want and out.count() == len(want)
    members = N.members(nav, breadcrumbs=True)
    assert {(r["resource_id"], r["pos"]): r["breadcrumb"] for r in members.collect()} == aligned
    for df in (out, members):
        plan = df._jdf.queryExecution().toString()
        assert "Exchange" not in plan and "Join" not in plan and "Aggregate" not in plan


def test_breadcrumbs_of_a_table_climb_generation_by_generation(spark):
    rows = [("r", "a", "b", "A"), ("r", "b", "a", "B"), ("r", "c", "a", None), ("r", "d", "gone", "D")]
    index = spark.createDataFrame(rows, "resource_id string, member_id string, parent_id string, title string")
    got = {r["member_id"]: r["breadcrumb"] for r in N.climbed(index).collect()}
    assert got == {"a": "B > A", "b": "A > B", "c": "B > A", "d": "D"}
