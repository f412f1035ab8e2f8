"""Archives, whitening and clustering against brute force, round trips and odd tables."""

import base64
import hashlib
import io
import math
import random

import numpy as np
import pyarrow.fs as pafs
import pytest
import zstandard
from pyspark.sql import functions as F

from quire.llm import table_clustering, vectors, warc, whitening

SF = "/root/testdata/sf0.001"

# --- archives

LONG = "<p>" + "long text " * 300_000
PAGES = [
    (1, "http://a/", "<p>one</p>", "x"), (2, "http://b/", "<p>one</p>", "x"), (5, "http://c/\r\nX: y z%20é", "<p>one</p>", None),
    (3, None, None, None), (4, "", "", "y"), (None, "u", "<p>one</p>", "x"), (None, "u", None, "x"), (None, "u", "alone", "x"),
    (7, "d", "WARC/1.1\r\n\r\n\r\n\r\n", "x"), (7, "d", "WARC/1.1\r\n\r\n\r\n\r\n", "x"), (8, "e", "é\U0001f600\x00", "x"),
    (9, "f", LONG, "x"), (6, "f", LONG, "x"),
]


def pages(spark, rows=PAGES):
    odd = spark.createDataFrame(rows, "page_id long, url string, html string, first string")
    return odd.withColumns({n: F.lit("mine") for n in ("sha1", "salt", "place", "top", "payload", "size")})


def written(df, **more):
    return warc.write(df, F.col("page_id"), F.col("url"), F.col("html"), **more)


def expected(rows, least=0):
    out = []
    for i, (page, url, html, _) in enumerate(rows):
        data = (html or "").encode()
        equal = [(-math.inf if p is None else p, j, p) for j, (p, _, h, _) in enumerate(rows) if (h or "").encode() == data]
        top = max(equal)
        response = len(data) < least or top[1] == i
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, url, len(data), digest, "response" if response else "revisit", None if response else top[2], data if response else None))
    return sorted(out, key=repr)


def got(df):
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    return sorted(
        (tuple(bytes(v) if isinstance(v, bytearray) else v for v in (r[n] for n in names)) for r in df.collect()), key=repr
    )


@pytest.mark.parametrize("least,frame,bundle", [(0, 1 << 20, 1 << 28), (11, 1, 1), (0, 200, 400)])
def test_archive_gives_its_pages_back(spark, least, frame, bundle):
    archive = written(pages(spark), least_bytes=least, frame_bytes=frame, bundle_bytes=bundle)
    assert got(warc.read(archive)) == expected(PAGES, least)
    assert {r["payload"] for r in warc.read(archive, payloads=False).collect()} == {None}


def test_lookup_fetches_the_records_asked_for(spark):
    archive = written(pages(spark), frame_bytes=300)
    asked = spark.createDataFrame([(5,), (5,), (None,), (9,), (99,)], "page_id long")
    assert got(warc.lookup(archive, asked)) == [r for r in expected(PAGES) if r[0] in (5, None, 9)]


def test_bundles_are_frames_with_a_seek_table(spark):
    archive = written(pages(spark), frame_bytes=300, bundle_bytes=2000)
    system, base = pafs.FileSystem.from_uri(archive.folder)
    rows = archive.index.collect()
    assert len({r["record_id"] for r in rows}) == len(PAGES)
    for name in {r["bundle"] for r in rows}:
        with system.open_input_file(f"{base}/{name}") as f:
            frames = warc.frames_of(f)
            f.seek(0)
            data = f.read()
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        assert len(plain) == sum(f[2] for f in frames)
        assert [f[0] for f in frames] == [sum(x[1] for x in frames[:i]) for i in range(len(frames))]
        for r in rows:
            if r["bundle"] == name:  # a record is found with its frame alone
                whole = zstandard.ZstdDecompressor().decompress(data[r["frame_at"] : r["frame_at"] + r["frame_bytes"]])
                (one,) = warc.parsed(whole[r["offset"] : r["offset"] + r["length"]])
                assert (one["record_id"], one["record_type"]) == (r["record_id"], r["record_type"])


def test_damage_is_found():
    data = warc.record("urn:page:1:0", "u", b"abc", hashlib.sha1(b"abc").digest(), 3, None, "1970-01-01T00:00:00Z")
    assert next(warc.parsed(data))["payload"] == b"abc"
    for bad in (data.replace(b"abc", b"abd"), data[:-1], b"x" + data, data.replace(b"Length: 3", b"Length: 4")):
        with pytest.raises(ValueError):
            list(warc.parsed(bad))


def test_archive_of_an_empty_table(spark):
    archive = written(pages(spark).where("1 = 0"))
    assert warc.read(archive).count() == 0
    assert warc.lookup(archive, spark.createDataFrame([(1,)], "page_id long")).count() == 0


def test_copies_of_one_payload_are_spread(spark):
    many = spark.range(20_000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("same").alias("html"))
    placed = warc.landed(many, F.col("page_id"), F.col("url"), F.col("html"), 0)
    salts = placed.groupBy(F.pmod(F.xxhash64("place"), F.lit(warc.SALTS))).count().agg(F.max("count")).head()[0]
    assert salts < 60
    assert placed.where("first is null").select("page_id").collect()[0][0] == 19_999 and placed.where("first is null").count() == 1


# --- vectors

ENTRIES = [[0.5, -0.25], [0.5, -0.25], [0.1, 0.9], None, [], [None, 1.0], [float("nan"), 1.0], [float("inf"), 0.0], [0.2, 0.3, 0.4]]


def odd_vectors(spark, entries=ENTRIES):
    rows = [(None if i == 2 else i // 2 * 2, e, i) for i, e in enumerate(entries)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, vector int")
    return df.withColumns({n: F.lit("mine") for n in ("cluster", "n", "g", "w", "at", "distance", "deviation")})


def test_vectors_that_are_kept(spark):
    kept = vectors.vectors_of(odd_vectors(spark), "vec_id", "embedding")
    assert sorted((r["vec_id"] or -1, len(r["vector"])) for r in kept.collect()) == [(-1, 2), (-1, 2), (-1, 2)]
    assert vectors.vectors_of(odd_vectors(spark), "vec_id", "embedding", 3).count() == 1


@pytest.mark.parametrize("x", [
    np.random.default_rng(1).normal(size=(400, 64)) @ np.random.default_rng(2).normal(size=(64, 64)),
    np.random.default_rng(3).normal(size=(300, 40)) * np.logspace(0, -6, 40),
    np.random.default_rng(4).normal(size=(9, 20)),
    np.vstack([np.eye(16) * np.repeat([3, 2, 1, 1], 4), -np.eye(16) * np.repeat([3, 2, 1, 1], 4)])
    @ np.linalg.qr(np.random.default_rng(5).normal(size=(16, 16)))[0],
    np.vstack([np.eye(6), -np.eye(6)]),
    np.random.default_rng(6).normal(size=(50, 1)),
    np.hstack([np.random.default_rng(7).normal(size=(90, 5))] * 2 + [np.zeros((90, 2))]),
], ids=["general", "graded", "few rows", "repeated values", "equal", "one", "rank"])
def test_solver_gives_directions_to_double_precision(x):
    x = x - x.mean(axis=0)
    d = x.shape[1]
    r = np.linalg.qr(x, mode="r")
    values, axes = whitening.directions(np.vstack([r, np.zeros((d - len(r), d))]))
    true = np.linalg.svd(x, compute_uv=False) ** 2
    assert len(values) == (true > 1e-13 * true[0]).sum()
    assert np.abs(values / true[: len(values)] - 1).max() < 1e-12
    assert np.abs(x.T @ (x @ axes) - axes * values).max() < 1e-13 * true[0]
    assert np.abs(axes.T @ axes - np.eye(len(values))).max() < 1e-11


def brute_whitening(x, k):
    n = len(x)
    off = x - x.mean(axis=0)
    values, axes = np.linalg.eigh(off.T @ off / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return off @ axes / np.sqrt(values), values / np.trace(off.T @ off / n)


def test_whitening_equals_brute_force(spark):
    r = random.Random(3)
    base = [[r.gauss(0, 1 + j) for j in range(5)] for _ in range(300)]
    entries = base + base[:20] + ENTRIES
    rows = [(i, e) for i, e in enumerate(entries)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("component", F.lit("mine"))
    out = whitening.whiten(df, components=3)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    ids = list(range(320))
    x = np.floor(64 * np.array([entries[i] for i in ids], np.float32).astype(np.float64)) + 1e6
    white, share = brute_whitening(x, 3)
    exact = [sum((320 * int(v) - int(s)) ** 2 for v, s in zip(row, x.sum(axis=0), strict=True)) for row in x]
    got = {(a["vec_id"], a["component"]): a for a in out.collect()}
    assert set(got) == {(i, c) for i in ids for c in (1, 2, 3)}
    for c in (1, 2, 3):
        mine = np.array([got[i, c]["whitened"] for i in ids])
        sign = np.sign(mine @ white[:, c - 1])
        assert np.abs(sign * mine - white[:, c - 1]).max() < 1e-9
        assert abs(got[0, c]["explained"] / share[c - 1] - 1) < 1e-10
    assert [got[i, 1]["deviation"] for i in ids] == exact and got[0, 1]["n"] == 320
    assert all(0 <= a["identity_error"] < 1e-9 for a in got.values())


def test_whitening_does_not_depend_on_partitions(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    a, b = (
        {(r["vec_id"], r["component"]): r for r in whitening.whiten(x).collect()} for x in (df.coalesce(1), df.repartition(7))
    )
    assert set(a) == set(b) and len({r[1] for r in a}) == 32
    for key in a:
        assert a[key]["deviation"] == b[key]["deviation"]
        assert abs(abs(a[key]["whitened"]) - abs(b[key]["whitened"])) < 1e-9


@pytest.mark.parametrize("entries", [[], [[1.0, 2.0]], [[1.0, 2.0]] * 50, [None, [float("nan")]]])
def test_whitening_without_variance_has_no_rows(spark, entries):
    df = spark.createDataFrame([(i, e) for i, e in enumerate(entries)], "vec_id long, embedding array<double>")
    assert whitening.whiten(df).count() == 0


def test_large_deviations_are_null(spark):
    df = spark.createDataFrame([(i, [1000.0 * (-1) ** i, float(i)]) for i in range(60_000)], "vec_id long, embedding array<double>")
    assert whitening.whiten(df, components=1).where("deviation is not null").count() == 0


def brute_clusters(rows, k, rounds):
    """Plain differences, one row at a time."""
    x = [[math.floor(64 * v) for v in e] for _, e in rows]
    order = sorted(range(len(x)), key=lambda i: (hashlib.sha256(f"1:{rows[i][0]}".encode()).hexdigest(), rows[i][1]))
    centroids = [x[i] for i in order[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for v in x]

    for _ in range(rounds):
        found = assigned()
        for j in range(len(centroids)):
            own = [v for v, (_, g) in zip(x, found, strict=True) if g == j]
            if own:
                centroids[j] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    found = assigned()
    total = sum(d for d, _ in found)
    return sorted(
        (i, g, d, sum(e for e, h in found if h == g), total, hashlib.sha256(",".join(map(str, centroids[g])).encode()).hexdigest())
        for (i, _), (d, g) in zip(rows, found, strict=True)
    )


@pytest.mark.parametrize("spread,n,k", [(1.0, 200, 7), (0.02, 150, 4), (900.0, 120, 5), (1.0, 3, 16), (1.0, 1, 2)])
def test_clusters_equal_brute_force(spark, spread, n, k):
    r = random.Random(n)
    rows = [(i, [float(np.float32(r.gauss(0, spread) + 3 * spread * (i % 3))) for _ in range(4)]) for i in range(n)]
    rows += rows[:5]  # repeated ids and vectors
    df = spark.createDataFrame(rows + [(900 + i, e) for i, e in enumerate(ENTRIES)], "vec_id long, embedding array<float>")
    out = table_clustering.cluster(df.withColumn("cluster", F.lit("mine")), k=k, length=4)
    assert sorted(tuple(r) for r in out.collect()) == brute_clusters(rows, k, 3)


def test_values_of_a_wide_column_are_sorted_instead_of_marked():
    column = np.array([5, -(1 << 20), 5, 1 << 20, 0])
    values, place = table_clustering.occurring(column)
    assert values.tolist() == [-(1 << 20), 0, 5, 1 << 20] and (values[place] == column).all()
    values, place = table_clustering.occurring(column % 7)
    assert (values[place] == column % 7).all() and len(values) == len(set((column % 7).tolist()))


def test_clusters_of_odd_and_empty_tables(spark):
    df = odd_vectors(spark)
    assert sorted(map(str, (r["vec_id"] for r in table_clustering.cluster(df, length=2).collect()))) == ["0", "0", "None"]
    for none in (df.where("1 = 0"), df.where("vec_id > 2")):
        out = table_clustering.cluster(none, length=2)
        assert out.count() == 0 and out.columns == [f.split()[0] for f in table_clustering.RESULT.split(", ")]
