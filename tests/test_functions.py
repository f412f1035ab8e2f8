import hashlib
import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from quire.functions import dates as D
from quire.functions import text as T
from quire.functions import variant as V


def test_blanks_are_unicode(one):
    s = " a  b\x85\x1fc\r\n "
    assert one(lambda: T.normalize_ws(F.col("s")), s=s) == " ".join(s.split())
    assert one(lambda: T.strip(F.col("s")), s="  x y ") == "x y"


@pytest.mark.parametrize(
    "s",
    ["Pièces  JUSTIFICATIVES", "Œuvre ﬁn ½ ²", "각가힣 한", "Ǆ Å ñ é", "İstanbul ΑΣ", "™ ﷺ Ⅷ ㎏"],
)
def test_folding_is_nfkd_without_marks(one, s):
    lowered = " ".join(s.split()).lower()
    want = "".join(c for c in unicodedata.normalize("NFKD", lowered) if not unicodedata.combining(c))
    assert one(lambda: T.fold(F.col("s")), s=s) == want


def test_folding_every_character_that_decomposes(spark):
    """One row per assigned letter, mark, number and symbol, against the Unicode database."""
    chars = [
        chr(c)
        for c in range(0xA0, 0x30000)
        if not 0xD800 <= c <= 0xDFFF
        and (unicodedata.decomposition(chr(c)) or unicodedata.combining(chr(c)))
        and chr(c).lower() == chr(c)
        and not chr(c).isspace()
    ]
    rows = spark.createDataFrame([(c,) for c in chars], "c string")
    got = {r["c"]: r["f"] for r in rows.select("c", T.fold(F.concat(F.lit("x"), "c", F.lit("x"))).alias("f")).collect()}
    for c in chars:
        want = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        assert got[c] == f"x{want}x", hex(ord(c))


def test_patterns(one):
    head = "Pièces justificatives"
    assert one(lambda: T.matches_any(F.col("h"), ["PIECES  just"]), h=head)
    assert not one(lambda: T.matches_any(F.col("h"), ["", "  "]), h=head)
    assert not one(lambda: T.matches_any(F.col("h"), ["oeuvre"]), h="Œuvre")
    assert one(lambda: T.matches_any(F.lit(None).cast("string"), ["a"])) is False


@pytest.mark.parametrize(
    "value,want",
    [
        ("https://x.org/a#b", "b"),
        ("x/y/z//", "z"),
        ("plain", "plain"),
        ("", None),
        ("#", None),
        ("a#b#c", "c"),
        ("a/b#", None),
    ],
)
def test_short_id(one, value, want):
    assert one(lambda: T.short_id(F.col("v")), v=value) == want


@pytest.mark.parametrize(
    "content,head,want",
    [
        ("Intro text", "Intro", "text"),
        ("Intro", "Intro ", ""),
        ("Introduction", "Intro", "Introduction"),
        (" a  b ", "", "a b"),
    ],
)
def test_strip_leading_head(one, content, head, want):
    assert one(lambda: T.strip_leading_head(F.col("c"), F.col("h")), c=content, h=head) == want


def test_ids(one):
    digest = hashlib.sha1("R::3::texte é".encode()).hexdigest()[:12]
    made = one(lambda: T.stable_fragment_id("__X__", F.col("r"), F.lit(3), F.col("t")), r="R", t="texte é")
    assert made == "__X__" + digest
    big = int(hashlib.sha1(b"abc").hexdigest()[:16], 16)
    assert int(one(lambda: T.stable_int_id(F.col("v")), v="abc")) == big
    assert one(lambda: T.sanitize_key(F.col("k")), k="a.b:c-d@e") == "a__b__c_de"
    got = one(lambda: T.id_list(F.array(F.lit("A"), F.lit(""), F.lit(" A "), F.lit(None), F.lit("B"))))
    assert got == ["A", "B"]
    assert one(lambda: T.id_list(F.lit(None).cast("array<string>"))) == []


def test_compact(one):
    assert one(lambda: T.compact(F.col("t"), 5), t="ab  cd ef") == "ab cd…"
    assert one(lambda: T.compact(F.col("t"), 3), t="ab cd") == "ab…"
    assert one(lambda: T.compact(F.col("t"), 5), t="ab cd") == "ab cd"


@pytest.mark.parametrize(
    "text,start,end",
    [
        ("1972", 1972, 1972),
        ("1972~", 1972, 1972),
        ("1200/1499", 1200, 1499),
        ("1200/", 1200, None),
        ("-50/20?", -50, 20),
        ("/1499", None, None),
        ("2021-05-01", None, None),
        ("12345", None, None),
        ("", None, None),
    ],
)
def test_year_bounds(one, text, start, end):
    got = one(lambda: D.year_bounds(F.col("t")), t=text)
    assert (got["start"], got["end"]) == (start, end)


def test_iso_edges(one):
    assert one(lambda: D.year_start_iso(F.lit(7).cast("long"))) == "0007-01-01"
    assert one(lambda: D.year_end_iso(F.lit(-50).cast("long"))) == "-50"
    assert one(lambda: D.year_end_iso(F.lit(12345).cast("long"))) == "12345-12-31"


def test_flatten(one):
    data = json.dumps({"a": {"b": {"c": 1}, "e": {}}, "l": [1, {"x": 2}], "n": None, "t": True})
    got = one(lambda: V.flat_map(V.parse(F.col("j")), "p."), j=data)
    assert got == {"p.a.b.c": "1", "p.l": '[1,{"x":2}]', "p.n": None, "p.t": "true"}
    cells = one(lambda: V.flat_map(V.parse(F.col("j")), "", V.csv_text), j=data)
    assert cells == {"a.b.c": "1", "l": '[1, {"x": 2}]', "n": "", "t": "True"}


@pytest.mark.parametrize("levels", [V.UNROLLED, V.UNROLLED + 1, 12, 40])
def test_flatten_any_depth(one, levels):
    data = {"end": "{x", "empty": {}}
    for _ in range(levels):
        data = {"k": data, "a": [{"b": 1}]}
    got = one(lambda: V.flat_map(V.parse(F.col("j"))), j=json.dumps(data))
    want = {"k." * i + "a": '[{"b":1}]' for i in range(levels)}
    assert got == {**want, "k." * levels + "end": "{x"}


def test_pick(one):
    data = json.dumps({"a": {"b": 1, "c": None}, "x:y": "z", "d": 0})

    def picked(paths):
        out = one(lambda: F.to_json(V.pick(V.parse(F.col("j")), paths)), j=data)
        return out and json.loads(out)

    assert picked(None) == json.loads(data)
    assert picked([]) is None
    assert picked(["a.b", "x:y", "a.c", "q"]) == {"a": {"b": 1}, "x:y": "z"}
    assert picked(["a.b", "a"]) == {"a": {"b": 1, "c": None}}
    assert picked(["q.r", "a.c"]) is None


def test_spaced_json_leaves_strings_alone(one):
    data = [1, {"a,b": 'x:"y', "u": "https://e.org"}, []]
    compact = json.dumps(data, separators=(",", ":"))
    assert one(lambda: V.spaced_json(F.col("j")), j=compact) == json.dumps(data)


def test_strip_leading_head_of_normalized_texts(one):
    """Texts that are normalized are not gone through again: no blank pattern is left in the plan."""
    both = {"content": "Intro text", "head": "Intro"}
    new = lambda: T.strip_leading_head(F.col("content"), F.col("head"), normalized=True)
    assert "regexp_replace" not in str(new()) and one(new, **both) == "text"
    assert one(new, content="Intro", head="") == "Intro"


def test_members_found_in_one_pass(spark):
    """``fields`` and ``items`` give what ``get`` gives, member by member."""
    odd = ['{"a":1,"A":"x","b":null,"c":{"d":[1,{}]},"@id":"q","e`f":false}', "[1]", '"s"', "null", "5", "{}", "x", '{"b":1.50,"a":[]}']
    rows = spark.createDataFrame([(t,) for t in odd], "t string").select(F.try_parse_json("t").alias("v"))
    keys = {"one": "a", "two": "A", "three": "b", "four": "c", "five": "@id", "six": "e`f", "seven": "missing"}
    v = F.col("v")
    for kind in ("variant", "string"):
        x = V.fields(v, kind, **keys)
        same = [F.to_json(F.struct(x[a].alias("x"))) == F.to_json(F.struct(V.get(v, k, type=kind).alias("x"))) for a, k in keys.items()]
        assert all(all(r) for r in rows.select(*same).collect())
    told = rows.select(V.fields(v, z="zz").isNotNull(), V.is_object(v), V.as_map(v).isNotNull(), V.has_key(v, "b")).collect()
    assert [tuple(r) for r in told] == [(k, k, k, h) for k, h in [(True, True)] + [(False, False)] * 4 + [(True, False), (False, False), (True, True)]]
    listed = spark.sql("""SELECT parse_json('[{"a":"1"},3,null,{"b":2},[]]') AS v""").select(V.items(v, "string", x="a").alias("i"))
    assert [i and i["x"] for i in listed.head()["i"]] == ["1", None, None, None, None] and listed.selectExpr("i[3] IS NOT NULL").head()[0]


@pytest.mark.parametrize("text, kind", [
    ("null", "null"), ('"s"', "string"), ('"5"', "string"), ("5", "integer"), ("2.0", "integer"), ("1e3", "integer"), ("1.5", "number"),
    ("true", "boolean"), ("[]", "array"), ('[{"a":1},2]', "array"), ("{}", "object"), ('{"_":null}', "object"), ("x", None),
])
def test_json_types(one, text, kind):
    assert one(lambda: V.json_type(V.parse(F.col("t"))), t=text) == kind


@pytest.mark.parametrize("text", ["null", '""', "0", "0.0", "-0.0", "0e5", "false", "[]", "{}", "x"])
def test_falsy(one, text):
    assert one(lambda: V.truthy(V.parse(F.col("t"))).isNull(), t=text)


@pytest.mark.parametrize("text", ['"0"', '"false"', '"[]"', '"{}"', '" "', '"0.0"', "0.5", "-0.5", "true", "[0]", '{"a":null}'])
def test_truthy(one, text):
    assert one(lambda: V.truthy(V.parse(F.col("t"))).isNotNull(), t=text)


def test_even_blanks_are_left_alone(one):
    text = " a  b\tc d   e\n\nf g\u0085h　"
    assert one(lambda: T.normalize_ws(F.col("t")), t=text) == "a b c d e f g h"
    assert one(lambda: F.regexp_count(F.col("t"), F.lit(T.UNEVEN_BLANKS)), t="a b c d") == 0
    blanks = [cp for cp in range(0x10000) if unicodedata.category(chr(cp)).startswith("Z") or cp in (*range(9, 14), *range(28, 32), 0x85)]
    assert one(lambda: T.normalize_ws(F.col("t")), t="".join(f"x{chr(c)}" for c in blanks)) == " ".join("x" * len(blanks))
