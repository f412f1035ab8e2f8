"""Operators on Spark: brute force, held-out accuracy, and tables with odd rows."""

import itertools
import random
import zlib
from collections import Counter

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from quire.llm import decontaminate, html_text, quality_classifier, quality_rules, secret_scan
from quire.llm import sentencepiece_viterbi as pieces
from quire.llm import sharding, simhash, token_counts, url_filter

SF = "/root/testdata/sf0.001"
# clashing names: columns called like results, or like names used inside
ODD_ROWS = [
    (1, None, "en", "s", 3, 0.5, "x"), (2, "", None, "s", None, None, None), (3, " \n\t", "en", None, 1, 0.1, "y"),
    (3, " \n\t", "en", None, 1, 0.1, "y"), (None, "one two three four five", "en", "s", 2, 0.2, "z"),
    (None, None, None, None, None, None, None), (4, "one two three four five", "de", "s", 2, 0.2, "z"),
    (5, "w " * 60_000, "de", "t", 9, 0.3, "z"), (6, "\U0001f600" * 50_000, "de", "t", 9, 0.3, "z"),
    (7, 'token = "0cf1bbc67ab39b2ddebadc809bed189ed8c6ac4d" and more words here to be a text', "en", "t", 9, 0.3, "z"),
]
ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD_ROWS, ODD_SCHEMA).withColumns(
        {n: F.lit("mine") for n in ("n_words", "kept", "shard", "slot", "size", "curve", "count", "key", "part", "root", "ids", "found")}
    )


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("1 = 0")


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# --- near-duplicates


def brute_components(prints):
    """Smallest id by union of all pairs at most two bits apart."""
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(prints, 2):
        if bin(prints[a] ^ prints[b]).count("1") <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in prints}


@pytest.mark.parametrize("paired", [256, 2, 0])
def test_links_and_components(spark, paired):
    r = random.Random(paired)
    prints = []
    for _ in range(12):
        f = r.getrandbits(64)
        for _ in range(9):
            prints.append(f)
            for _ in range(r.randint(1, 3)):
                f ^= 1 << r.choice([0, 1, 2, 3, 31, 32, 33, 34, 63])
    prints += [0, 1, 3, (1 << 64) - 1]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    label = {}
    for i, p in enumerate(signed):
        label.setdefault(p, i)
    nodes = spark.createDataFrame(list(label.items()), "fp long, label long")
    found = simhash.components(nodes, simhash.links(nodes.select("fp"), "fp", paired)).collect()
    got = {r["fp"]: r["component_id"] for r in found}
    want = brute_components(dict(enumerate(prints)))
    assert {i: got.get(p, label[p]) for i, p in enumerate(signed)} == want


def test_near_duplicates_of_texts(spark):
    r = random.Random(1)
    base = " ".join(f"w{r.randint(0, 500)}" for _ in range(300))
    texts = [base, base + " tail", base.upper(), "other text of a few words", "", None, "  ", "a b", "A  B"]
    got = {x["doc_id"]: x for x in simhash.near_duplicates(docs(spark, texts)).collect()}
    prints = {i: simhash.fingerprint((t or "").encode()) for i, t in enumerate(texts)}
    assert {i: x["component_id"] for i, x in got.items()} == brute_components(prints)
    assert all(x["fingerprint"] == f"{prints[i]:016x}" for i, x in got.items())


def test_near_duplicates_odd_rows(odd, empty):
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == len(ODD_ROWS)
    by = {(x["doc_id"], x["fingerprint"]): x["component_id"] for x in found}
    assert by[2, "0" * 16] == by[3, "0" * 16] == by[1, "0" * 16] == 1 and by[None, "0" * 16] == 1
    kept = simhash.first_of_each(odd)
    assert kept.columns == odd.columns
    assert Counter(x["doc_id"] for x in kept.collect()) == {1: 1, 4: 1, 5: 1, 6: 1, 7: 1, None: 2}
    assert simhash.near_duplicates(empty).count() == 0 and simhash.first_of_each(empty).count() == 0


def test_repeated_rows_leave_one(spark):
    rows = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (2, "x y z q")], "doc_id long, text string")
    assert sorted(map(tuple, simhash.first_of_each(rows).collect())) == [(1, "a b c d")]


def test_every_component_keeps_one_row(spark, odd, empty):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (2, "x y z q"), (None, "x y z q"), (None, "no id"), (None, "no id")]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, simhash.one_of_each(made).collect()), key=str)
    assert got == [(1, "a b c d"), (2, "x y z q"), (None, "no id")]
    # near copies under one id; one id on texts of several components
    r = random.Random(1)
    base = " ".join(f"w{r.randint(0, 500)}" for _ in range(300))
    texts = [base, base + " tail", base.upper(), "other text of a few words", "Other text  of a few words", "a b", "", None]
    prints = [simhash.fingerprint((t or "").encode()) for t in texts]
    groups = set(brute_components(dict(enumerate(prints))).values())
    for ids in ([7] * 8, [None] * 8, [3, 3, 2, 2, 9, 3, 3, 3], [1, 2, 3, 4, 5, 6, 7, 8]):
        made = spark.createDataFrame(list(zip(ids, texts)) * 2, "doc_id long, text string")
        kept = simhash.one_of_each(made)
        left = [texts.index(x["text"]) for x in kept.collect()]
        roots = brute_components(dict(enumerate(prints)))
        assert sorted(roots[i] for i in left) == sorted(groups), ids
        for i in left:
            mine = [ids[k] for k in range(8) if roots[k] == roots[i] and ids[k] is not None]
            assert ids[i] == min(mine, default=None)
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert Counter(x["doc_id"] for x in kept.collect()) == {1: 1, 4: 1, 5: 1, 6: 1, 7: 1}
    assert simhash.one_of_each(empty).count() == 0


# --- contamination


def contaminations(documents, items):
    return decontaminate.contamination(documents, items).select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256")


def test_contamination_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(10, "Four FIVE"), (9, "three four five"), (9, "w w"), (8, None), (7, ""), (None, "zz")], "item_id long, text string")
    row = contaminations(odd, items)
    assert row.count() == odd.count()
    got = {x["doc_id"]: x for x in row.collect()}
    assert (got[4]["n_words"], got[4]["n_hit"], got[4]["n_items"]) == (5, 3, 2)
    assert (got[5]["n_words"], got[5]["n_hit"], got[5]["n_items"]) == (60_000, 60_000, 1)
    assert got[1]["n_words"] == got[2]["n_words"] == got[3]["n_words"] == 0
    import hashlib

    assert got[4]["items_sha256"] == hashlib.sha256(b"10,9").hexdigest()
    none = contaminations(odd, items.where("1 = 0"))
    assert none.count() == odd.count() and none.where("n_hit > 0").count() == 0
    assert contaminations(empty, items).count() == 0
    hits = decontaminate.matches(odd.where("doc_id = 4"), items)
    assert sorted(map(tuple, hits.collect())) == [(4, "10", 3, 2), (4, "9", 2, 3)]


def slow_matches(documents, items, size):
    out = set()
    for d, doc in documents:
        w = decontaminate.words((doc or "").encode())
        for i, item in items:
            q = decontaminate.words((item or "").encode())
            n = min(size, len(q))
            for a in range(len(q) - n + 1 if n else 0):
                out |= {(d, i, p, n) for p in range(len(w) - n + 1) if w[p : p + n] == q[a : a + n]}
    return out


def slow_near(documents, items, size, within):
    out = set()
    for d, doc in documents:
        w = decontaminate.words((doc or "").encode())
        for i, item in items:
            q = decontaminate.words((item or "").encode())
            for a in range(max(1, len(q) - size + 1) if q else 0):
                need = Counter(q[a : a + size])
                full = {(x, y) for x in range(len(w)) for y in range(x, min(x + within, len(w))) if not need - Counter(w[x : y + 1])}
                out |= {(d, i, x, y - x + 1) for x, y in full if not any((u, v) != (x, y) and x <= u and v <= y for u, v in full)}
    return out


@pytest.mark.parametrize("shard, vocabulary", [(1 << 18, 8 << 20), (30, 0)])
def test_index_finds_every_window(spark, monkeypatch, shard, vocabulary):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard)
    monkeypatch.setattr(decontaminate, "VOCABULARY_BYTES", vocabulary)
    monkeypatch.setattr(decontaminate, "RAREST_BYTES", vocabulary)
    r = random.Random(6)
    text = lambda n: " ".join(r.choice("abcd") for _ in range(n))
    documents = [(i, text(r.randint(0, 40))) for i in range(30)] + [(30, ""), (31, "..."), (32, None)]
    items = [(str(i), text(n)) for i, n in enumerate([0, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9])]
    d, q = spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    found = sorted(map(tuple, decontaminate.matches(d, q, size=4).collect()))
    assert found == sorted(slow_matches(documents, items, 4))
    near = {tuple(x) for x in decontaminate.matches(d, q, size=4, within=6).collect()}
    assert near == slow_near(documents, items, 4, 6)


def test_repeated_words_take_linear_time(spark):
    import time

    documents = spark.createDataFrame([(1, "x " * 400_000), (2, "x y " * 9)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "x " * 1000), (2, "x " * 40 + "y"), (3, "x " * 1000)], "item_id long, text string")
    started = time.time()
    got = {x["doc_id"]: tuple(x)[1:4] for x in contaminations(documents, items).collect()}
    assert got == {1: (400_000, 400_000, 3), 2: (18, 0, 0)}
    assert time.time() - started < 60


def test_documents_without_contamination_keep_their_columns(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (None, None, None), (2, "q r", "t"), (2, "q r", "t"), (3, "", None)]
    documents = spark.createDataFrame(rows, "`_digest` long, text string, `n_hit` string")
    items = spark.createDataFrame([(1, "A b")], "item_id long, text string")
    left = decontaminate.without(documents, items)
    assert left.columns == documents.columns
    assert Counter(map(tuple, left.collect())) == Counter(rows[2:])


def test_shards_change_nothing(spark, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = lambda: sorted(map(str, contaminations(table, items).collect()))
    whole = rows()
    monkeypatch.setattr(decontaminate, "VOCABULARY_BYTES", 0)
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 5000)
    assert rows() == whole and any("n_hit=0" not in r for r in whole)


# --- classifier


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    learn = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    model = quality_classifier.fit(table, learn)
    scored = table.join(labels.select("doc_id", "quality"), "doc_id").select(
        "doc_id", "quality", quality_classifier.score(table, F.col("text"), model).alias("score")
    )
    rows = [r for r in scored.collect() if held_out(r["doc_id"])]
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    wins = sum((g > b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad)
    right = sum((r["score"] >= 0.3) == (r["quality"] == 1) for r in rows) / len(rows)
    assert wins > 0.97 and right > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_classifier_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame(
        [(1, 1), (5, 1), (5, 0), (6, 0), (7, None), (None, 1), (7, 1), (4, 0), (4, 0)], "doc_id long, quality int"
    )
    for learn in (labels, labels.where("quality = 1"), labels.where("1 = 0")):
        model = quality_classifier.fit(odd, learn)
        scores = [r[0] for r in odd.select(quality_classifier.score(odd, F.col("text"), model)).collect()]
        assert len(scores) == len(ODD_ROWS) and all(0 <= s <= 1 for s in scores)
    assert quality_classifier.fit(empty, labels).weights == ()
    assert empty.select(quality_classifier.score(empty, F.col("text"), model)).count() == 0


def test_classifier_learns_from_long_texts(spark, monkeypatch):
    monkeypatch.setattr(quality_classifier, "SAMPLE_BYTES", 200_000)
    r = random.Random(4)
    word = lambda a: "".join(r.choice(a) for _ in range(r.randint(2, 9)))
    sides = [[word("bcdfghjk") for _ in range(300)], [word("aeioulnrst") for _ in range(300)]]
    text = lambda side: " ".join(r.choice(side) for _ in range(40_000))
    rows = [(i, text(sides[i % 2]), i % 2) for i in range(24)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality_classifier.fit(table.select("doc_id", "text"), table.select("doc_id", "quality"))
    scored = table.select("quality", quality_classifier.score(table, F.col("text"), model).alias("s")).collect()
    assert model.weights and all((x["s"] > 0.5) == (x["quality"] == 1) for x in scored)


# --- shards


def check_law(rows, shards):
    count = Counter(r["shard"] for r in rows)
    n = [count.get(s, 0) for s in range(shards)]
    assert max(n) - min(n) <= 1
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(s, i) for s in range(shards) for i in range(n[s])]


@pytest.mark.parametrize("parts", ["1", "13"])
def test_shards_of_the_documents(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        table = spark.read.parquet(f"{SF}/documents.parquet")
        rows = sharding.assign(table, ["lang", "source"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    check_law(rows, 8)
    texts = {r["doc_id"]: r["text"].encode() for r in table.collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len(t) + 1, zlib.crc32(t)) for i, t in texts.items()}
    run = [r["curve"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert run == sorted(run) and len(set(run)) > 20


def test_shards_odd_rows(odd, empty):
    rows = sharding.assign(odd, ["lang", "source", "n_chars", "score"], shards=3).collect()
    assert len(rows) == len(ODD_ROWS)
    check_law(rows, 3)
    assert {r["size"] for r in rows if r["doc_id"] == 1} == {1} and {r["text_crc32"] for r in rows if r["doc_id"] == 1} == {0}
    few = sharding.assign(odd.limit(2), ["lang"], shards=8).collect()
    check_law(few, 8)
    assert sharding.assign(empty, ["lang", "source"]).count() == 0


def test_written_shards(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    sharding.write(table, str(tmp_path / "out"), ["lang", "source"])
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(table.columns) <= set(back.columns) and back.count() == table.count()
    assert back.select("shard").distinct().count() == 8


# --- rules


def brute_metrics(text):
    words = [w.decode() for w in (text or "").encode().split()]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    covered = {k for i, w in enumerate(windows) if count[w] > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
    }


def test_rule_metrics(spark):
    r = random.Random(8)
    texts = ["".join(r.choice(["a ", "b ", "c\n", "é#", " ", " ", "\r", "d| "]) for _ in range(r.randint(0, 60))) for _ in range(300)]
    texts += [None, "", "a b c d e", "a b c d e a b c d e", "a a a a a a", "x\nx\nx", "\n\n"]
    for row in quality_rules.judge(docs(spark, texts)).collect():
        want = brute_metrics(texts[row["doc_id"]])
        assert {k: row[k] for k in want} == want, repr(texts[row["doc_id"]])


def test_rules_cascade_equals_all_rules(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r[0] for r in quality_rules.judge(table).where("kept").select("doc_id").collect()}
    assert {r[0] for r in quality_rules.cascade(table).select("doc_id").collect()} == kept
    for order in itertools.permutations(quality_rules.plan(table)[:3]):
        one = quality_rules.measured(table, "text", quality_rules.METRICS)
        good, first = quality_rules.verdict(list(order), F.col)
        assert one.where(good != first.isNull()).count() == 0
    assert 0 < len(kept) < table.count()


def test_metrics_are_computed_behind_the_rules_before(spark):
    """A metric that fails where the rule before rejects: nobody asks for it there."""
    texts = ["a b"] * 50 + ["one two three four five six seven eight nine ten"] * 50
    table = docs(spark, texts)
    first, last = quality_rules.RULES[0], quality_rules.Rule("odd", ("n_lines",), lambda m: m["n_lines"] >= 1)
    order = [quality_rules.Estimate(first, 1.0, 1.0), quality_rules.Estimate(last, 1.0, 0.0)]

    def metric(name):
        own = quality_rules.single(F.col("text"), name)
        short = F.size(quality_rules.words(F.col("text"))) < 10
        return F.when(short, F.raise_error(F.lit("asked too early")).cast("long")).otherwise(own) if name == "n_lines" else own

    kept, by = quality_rules.verdict(order, metric)
    assert table.where(kept).count() == 50 and table.where(by == "words").count() == 50
    kept, _ = quality_rules.verdict(order[::-1], metric)
    with pytest.raises(Exception, match="asked too early"):
        table.where(kept).collect()


def test_order_is_the_same_from_run_to_run(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    orders = [[e.rule.name for e in quality_rules.plan(table, known=quality_rules.BASE)] for _ in range(5)]
    assert len(set(map(tuple, orders))) == 1
    worth = [e.worth for e in quality_rules.plan(table)]
    assert worth == sorted(worth, reverse=True)


def test_rules_odd_rows(odd, empty):
    judged = quality_rules.judge(odd)
    assert set(odd.columns) <= set(judged.columns) and judged.count() == len(ODD_ROWS)
    assert quality_rules.cascade(odd).columns == odd.columns
    assert quality_rules.judge(empty).count() == 0 and quality_rules.cascade(empty).count() == 0


# --- URLs

RULES = [
    url_filter.Rule("allow", "org/"), url_filter.Rule("block", "example.org/es/"), url_filter.Rule("block", "example.org/en/1"),
    url_filter.Rule("allow", "com/fr/"), url_filter.Rule("block", "com/de/"),
]


def brute_rule(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].partition("#")[0].partition("?")[0]
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best.text if best else None, best.verdict if best else None


URLS = [
    None, "", "x", "http://", "http://org/", "http://ORG", "http://a.example.org/es/x?y#z", "http://example.org/en/12", "http://b.com/fr/",
    "http://b.com/fr", "https://c.com/de/1#/x", "http://notorg/", "http://x.org?a=://b.com/de/", "://org/", "http://É.org/\n", "http://a.com/fr//de/",
    "http://" + "a" * 5000 + ".net/" + "b/" * 20_000, "ftp://u@Example.ORG:80/", "http://u.org#f?g/h",
]


def test_urls(spark):
    frame = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(URLS * 2)], "page_id long, url string, host string")
    labelled = spark.createDataFrame(
        [(f"http://h{i}.{'org' if i % 2 else 'com'}/{'fr' if i % 2 else 'de'}/{i}", "allow" if i % 2 else "block") for i in range(200)]
        + [(None, "allow"), ("http://q", None), ("http://q", "odd")], "url string, verdict string",
    )
    for learn in (labelled, labelled.where("verdict = 'block'"), labelled.where("1 = 0")):
        learned = url_filter.fit(learn)
        rows = url_filter.judge(frame, RULES, learned).collect()
        assert len(rows) == 2 * len(URLS)
        for r in rows:
            host, path, rule, verdict = brute_rule(r["url"])
            assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
            assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert url_filter.judge(frame.where("1 = 0"), RULES, learned).count() == 0


def test_trees_on_held_out_urls(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("aeioulrtns") for _ in range(r.randint(3, 8)))
    good = lambda: f"https://www.{word()}.org/{word()}/{word()}.html"
    bad = lambda: f"http://{word()}-{r.randint(100, 9999)}.{word()}.biz/{r.getrandbits(40):x}?id={r.randint(0, 10**9)}&a={r.randint(0, 9)}&s={word()}"
    made = spark.createDataFrame([((bad if i % 3 == 0 else good)(), "block" if i % 3 == 0 else "allow") for i in range(1500)], "url string, truth string")
    learned = url_filter.fit(made.limit(1000).withColumnRenamed("truth", "verdict"))
    judged = url_filter.judge(made, [], learned)
    assert judged.where("verdict = truth").count() > 0.97 * 1500


# --- secrets


def test_forest_on_held_out_findings(spark):
    forest = secret_scan.fit(spark)
    rows = spark.createDataFrame(secret_scan.labelled_findings(seed=99, rows=2000), "text string, path string, label int")
    found = rows.select("label", (F.size(secret_scan.scan(spark, F.col("text"), F.col("path"), forest)["findings"]) > 0).cast("int").alias("got"))
    assert found.where("label = got").count() > 0.95 * 2000


def test_forest_equals_the_library(spark):
    import numpy as np
    from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
    from pyspark.ml.linalg import Vectors

    r = np.random.default_rng(1)
    x = r.random((300, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    frame = spark.createDataFrame([(Vectors.dense(a), b) for a, b in zip(x.tolist(), y.tolist())], ["features", "label"])
    model: RandomForestClassificationModel = RandomForestClassifier(numTrees=7, maxDepth=4, seed=1).fit(frame)
    from quire.session import checkpoint_root

    path = f"{checkpoint_root(spark)}/test-forest-{random.getrandbits(40):x}"
    model.write().save(path)
    ours = secret_scan._forest(spark, path).share(x)
    theirs = np.array([v["probability"][1] for v in model.transform(frame).collect()])
    assert np.allclose(ours, theirs)


def test_scan_odd_rows(spark, odd, empty):
    forest = secret_scan.fit(spark)
    rows = {r["doc_id"]: r["s"] for r in odd.select("doc_id", secret_scan.scan(spark, F.col("text"), F.col("source"), forest).alias("s")).collect()}
    assert rows[7]["redacted"] == 'token = "[SECRET]" and more words here to be a text'
    assert rows[1]["redacted"] == "" and rows[5]["redacted"] == "w " * 60_000 and not rows[5]["findings"]
    assert empty.select(secret_scan.scan(spark, F.col("text"), F.col("source"), forest)).count() == 0
    none = spark.createDataFrame([], "text string, path string, label int")
    assert len(secret_scan.fit(spark, none).roots) == 1


ASSIGNED = [
    ('password := "{}"', "hunter2!x"), ("'password' => '{}',", "hunter2!x"), ('password          =          "{}"', "hunter2!x"),
    ("password:          {}", "hunter2!x"), ('if password == "{}":', "hunter2!x"), ("password\t\t\t\t\t\t=\t{}", "Tr0ub4dor&3"),
    ('config["password"] = "{}"', "Tr0ub4dor&3"), ("a=1&password={}", "s3cr3t!pass"), ("x:password={}", "hunter2!x"), ("password:\n  {}", "hunter2!x"),
    ("postgres://admin:{}@db.internal:5432/app", "hunter2!x"), ("redis://:{}@cache", "Tr0ub4dor&3"), ("see https://bob:{}@mirror.net/pkg", "s3cr3tPass9"),
]


def test_candidates_of_all_assignments():
    for form, value in ASSIGNED:
        text = f"Some words, then {form.format(value)} and more."
        assert value in [text[a:b] for a, b in secret_scan.candidates(text)], text
    for text in ("http://host:8080/a@b", "password != x", "password = 'x'", "://:@", "the password: it is"):
        assert not list(secret_scan.candidates(text)), text
    for part in ("password=", "password = ", "=", "://a:", "://a:b@", "password" + " " * 50, " = "):
        long = part * (400_000 // len(part))
        assert len(list(secret_scan.candidates(long))) <= len(long)


def test_assigned_secrets_are_masked(spark):
    forest = secret_scan.fit(spark)
    rows = spark.createDataFrame([(f"Some words, then {f.format(v)} and more.",) for f, v in ASSIGNED], "text string")
    got = [r[0] for r in rows.select(secret_scan.scan(spark, F.col("text"), F.lit("src/app.py"), forest)["redacted"]).collect()]
    assert got == [f"Some words, then {f.format('[SECRET]')} and more." for f, _ in ASSIGNED]


# --- tokens, pieces, pages


def test_row_operators_odd_rows(spark, odd, empty):
    n = token_counts.token_count(spark, F.col("text"), P.path("byte_bpe_50k.json"))
    counts = {r[0]: r[1] for r in odd.select("doc_id", n).collect()}
    assert counts[1] == counts[2] == 0 and counts[4] == 5
    model = pieces.load(spark, P.path("piece_bpe_32k.model"))
    ids = pieces.encode(F.col("text"), model)
    for frame, rows in ((odd, len(ODD_ROWS)), (empty, 0)):
        back = frame.select("text", ids.alias("i")).select("text", pieces.decode(F.col("i"), model).alias("b"))
        assert back.where("b = coalesce(text, '')").count() == back.count() == rows
        assert frame.select(html_text.extract(F.col("text")).alias("t")).where("t is not null").count() == rows
        assert frame.select(n).count() == rows


def test_key_blocks_of_any_number_and_label():
    begin, end = "-----BEGIN {} PRIVATE KEY-----", "-----END {} PRIVATE KEY-----"
    label = "A" * 60
    one = f"{begin.format(label)}\nabc\n{end.format(label)}"
    text = f"x {one} y {begin.format('RSA')} {begin.format('EC')} z {end.format('EC')} {end.format('EC')} {begin.format('DSA')} w"
    spans = list(secret_scan._blocks(text))
    assert [text[a:b] for a, b in spans] == [one, f"{begin.format('RSA')} {begin.format('EC')} z {end.format('EC')}"]
    long = "-----BEGIN PRIVATE KEY-----" * 40_000
    assert list(secret_scan._blocks(long)) == []


def test_shards_of_values_with_a_common_start_and_of_equal_rows(spark):
    names = [f"https://example.org/{c}{i}" for i, c in enumerate("qabzxm")]
    rows = [(None, "same", names[0])] * 500 + [(i, f"t{i}", names[i % 6]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sharding.shared_starts(df, ["source", "doc_id"]) == [len("https://example.org/"), 0]
    codes = [r[0] for r in df.select("source").distinct().withColumn("c", sharding.rank_code(df, "source", 20)).orderBy("c").collect()]
    assert codes == sorted(names)
    out = sharding.assign(df, ["source"], shards=8).collect()
    assert sorted(Counter(r["shard"] for r in out).values()) == [100] * 8
    assert sorted((r["shard"], r["slot"]) for r in out) == [(s, k) for s in range(8) for k in range(100)]


def test_a_labelled_id_that_repeats_counts_once(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice("alpha beta gamma delta river stone".split() if i % 2 else "xx buy now click free".split()) for _ in range(60)) for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    once = docs(spark, texts)
    again = once.unionByName(once.where("doc_id = 5").crossJoin(spark.range(300).select(F.lit("a").alias("x"))).select("doc_id", F.substr("text", F.lit(1), F.lit(20)).alias("text")))
    assert quality_classifier.fit(once, labels) == quality_classifier.fit(again, labels)
