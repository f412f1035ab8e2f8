"""Benchmark decontamination with a stored, distributed positional inverted index.

``index`` cuts the documents into words once and writes their postings: one row for each term and
shard (some 256 KB of documents), with the sorted places of the term.  Places number the words of a
shard, with one number left out between documents, so words of two documents never follow each
other.  The test windows are made by Spark, equal ones once.  A search joins each window with
the lists of its rarest term, takes the offsets off, and intersects with the list of the next rarest
term in the same shard; what is left (hardly more than true matches) is intersected with the lists of
the other terms.  No list is longer than its shard, so no term, passage or item is a hot key of those
joins.  Only the set of test terms is broadcast, up to ``VOCABULARY_BYTES``; beyond that all words
are indexed.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate, chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import arrow_column, broadcast_bytes, free_name, held, ship, utf8
from quire.session import materialize

#: Text that one shard of the index holds; a longer text has a shard of its own.
SHARD_BYTES = 1 << 18
#: Test terms are broadcast up to this size, so that only they are indexed; else all words are.
VOCABULARY_BYTES = 8 << 20
#: The two rarest terms of all windows are broadcast up to this size; else Spark joins by exchange.
RAREST_BYTES = 16 << 20
#: So many starts are looked up one by one in a list, more are intersected with it.
FEW = 16

# word bytes stay, with A-Z as a-z; every other byte parts words
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def words(text: bytes) -> list[bytes]:
    """Runs of 0-9, a-z (A-Z lower-cased) and characters beyond ASCII."""
    return text.translate(_FOLD).split()


class Vocabulary:
    """Numbers of the test terms."""

    def __init__(self, data: bytes) -> None:
        listed = pickle.loads(data)
        self.terms = pa.array(listed, pa.binary())
        self.number = {t: i for i, t in enumerate(listed)}


def posted(documents: list[list[bytes]], known: Vocabulary | None) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """Terms of a shard with the number and the sorted list of their places; the place of the
    first word of a document is the words and the documents before it."""
    lengths = np.fromiter(map(len, documents), np.int64, len(documents))
    n = int(lengths.sum())
    flat = chain.from_iterable(documents)
    if known is None:
        own: dict[bytes, int] = {}
        ids = np.fromiter((own.setdefault(w, len(own)) for w in flat), np.int32, n)
        terms = pa.array(list(own), pa.binary())
    else:
        ids = np.fromiter(map(known.number.get, flat, repeat(-1)), np.int32, n)
        terms = known.terms
    place = np.arange(n) + np.repeat(np.arange(len(documents)), lengths)
    at = np.flatnonzero(ids >= 0)
    order = at[np.argsort(ids[at], kind="stable")]
    count = np.bincount(ids[order], minlength=len(terms))
    present = np.flatnonzero(count)
    ends = np.concatenate(([0], np.cumsum(count[present])))
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[order], pa.int32()))
    return terms.take(pa.array(present, pa.int64())), count[present], lists


@dataclass(frozen=True)
class Index:
    """``postings`` (term, shard, n, places) and ``documents`` (shard, first: the place of its first
    word, digest, n_words, row: the other columns), both stored in the shared folder."""

    postings: DataFrame
    documents: DataFrame


def index(documents: DataFrame, text: str = "text", terms: DataFrame | None = None) -> Index:
    """Postings of the words of ``text``; with ``terms`` (a column ``term``) of those only.

    Null and empty texts have no words and no postings, but a row among the documents.  Columns of
    the documents may have any names.  A shard is made in one task, from neighbouring rows.
    """
    spark = documents.sparkSession
    ship(spark)
    data = None
    if terms is not None:
        size = terms.agg(F.sum(F.octet_length("term") + 16).alias("size")).head()["size"] or 0
        if size <= VOCABULARY_BYTES:
            data = broadcast_bytes(spark, pickle.dumps(sorted(bytes(r["term"]) for r in terms.collect())))
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(documents.columns) if c != text]
    rows = documents.select(F.struct(F.lit(True).alias("row"), *others).alias("row"), F.col(f"`{text}`").alias("text"))

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if data is None else held("test terms", data.value, Vocabulary)
        shard = TaskContext.get().partitionId() << 32

        def made(texts: list[list[bytes]], digests: list[str], row: pa.Array) -> Iterator[pa.RecordBatch]:
            def batch(rows: int, **columns) -> pa.RecordBatch:
                kinds = {
                    "shard": pa.int64(), "term": pa.binary(), "n": pa.int64(), "places": pa.list_(pa.int32()),
                    "first": pa.int32(), "digest": pa.string(), "n_words": pa.int64(), "row": row.type,
                }
                columns["shard"] = np.full(rows, shard)
                full = [columns.get(c) for c in kinds]
                return pa.RecordBatch.from_arrays(
                    [pa.nulls(rows, k) if c is None else c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(full, kinds.values(), strict=True)],
                    list(kinds),
                )

            lengths = [len(t) for t in texts]
            first = [*accumulate((n + 1 for n in lengths[:-1]), initial=0)]
            yield batch(len(texts), first=first, digest=digests, n_words=lengths, row=row)
            term, n, places = posted(texts, known)
            if len(term):
                yield batch(len(term), term=term, n=n, places=places)

        for batch in batches:
            row, texts, digests, size = batch.column(0), [], [], 0
            for i, t in enumerate(utf8(batch.column(1))):
                if texts and size + len(t) > SHARD_BYTES:
                    yield from made(texts, digests, row.slice(i - len(texts), len(texts)))
                    shard, texts, digests, size = shard + 1, [], [], 0
                texts.append(words(t))
                digests.append(hashlib.sha256(t).hexdigest())
                size += len(t)
            if texts:
                yield from made(texts, digests, row.slice(len(row) - len(texts)))
                shard += 1

    kind = rows.schema["row"].dataType.simpleString()
    stored = materialize(
        rows.mapInArrow(
            build,
            "shard long, term binary, n long, places array<int>, first int, digest string, n_words long, row " + kind,
        ),
        "postings",
    )
    own = [F.col(f"row.c{i}").alias(c) for i, c in enumerate(documents.columns) if c != text]
    places = stored.where("term is null").select(
        "shard", "first", "digest", "n_words",
        F.struct(*own or [F.lit(True).alias("row")]).alias("row"),
    )
    return Index(stored.where("term is not null").select("term", "shard", "n", "places"), places)


def windows(items: DataFrame, item: str, text: str, size: int) -> DataFrame:
    """``item`` (string), ``window`` (a digest of its words) and ``terms`` of all windows, equal
    ones of an item once, stored in the shared folder."""

    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([words(t) for t in utf8(texts)], pa.list_(pa.binary()))

    cuts = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1))), lambda i: F.slice("words", i, size)
    )
    each = (
        items.select(
            F.coalesce(F.col(item).cast("string"), F.lit("None")).alias("item"),
            arrow_column(cut, "array<binary>", F.col(text)).alias("words"),
        )
        .where("size(words) > 0")
        .select("item", F.explode(cuts).alias("terms"))
    )
    digest = F.unhex(F.sha2(F.array_join(F.col("terms").cast("array<string>"), " "), 256))
    return materialize(each.withColumn("window", digest).dropDuplicates(["item", "window"]), "windows")


def _ranked(found: Index, cut: DataFrame) -> DataFrame:
    """Windows all of whose terms occur: ``window``, ``length`` and ``terms`` (n, offset, term)
    from the rarest."""
    # stored, so that its size is known before a term of many windows is exchanged
    count = materialize(found.postings.groupBy("term").agg(F.sum("n").alias("n")), "counts")
    each = cut.dropDuplicates(["window"]).select("window", F.size("terms").alias("length"), F.posexplode("terms").alias("offset", "term"))
    ranked = each.join(count, "term").groupBy("window", "length").agg(
        F.array_sort(F.collect_list(F.struct("n", "offset", "term"))).alias("terms")
    )
    return materialize(ranked.where(F.size("terms") == F.col("length")), "ranked")


def _starts() -> Column:
    """The places of a term with its offset in the window taken off."""
    return F.transform("places", lambda p: p - F.col("offset"))


def _agreeing() -> Column:
    """Of ``starts`` those where the term of the row has a place too; a few are looked up."""
    few = F.filter("starts", lambda s: F.array_contains("places", s + F.col("offset")))
    return F.when(F.size("starts") <= FEW, few).otherwise(F.array_intersect("starts", _starts()))


def occurrences(found: Index, cut: DataFrame) -> DataFrame:
    """``window``, ``length``, ``shard`` and ``starts``: where all words of a window follow each
    other."""
    live = _ranked(found, cut)
    postings = found.postings.drop("n")
    nth = lambda i: [F.col("terms")[i]["term"].alias("term"), F.col("terms")[i]["offset"].alias("offset")]
    first = live.select("window", "length", *nth(0), F.get("terms", F.lit(1)).alias("next"))
    room = F.octet_length("term") + F.coalesce(F.octet_length("next.term"), F.lit(0)) + 128
    size = first.agg(F.sum(room).alias("size")).head()["size"] or 0
    sized = F.broadcast if size <= RAREST_BYTES else lambda df: df
    rarest = postings.join(sized(first), "term")
    rarest = rarest.select("window", "length", "shard", _starts().alias("starts"), "next.term", F.col("next.offset").alias("offset"))
    single = rarest.where("length = 1").select("window", "length", "shard", "starts")
    second = live.where("length > 1").select(nth(1)[0])
    pairs = (
        rarest.where("length > 1")
        .join(postings.join(sized(second), "term", "left_semi"), ["term", "shard"])
        .select("window", "length", "shard", _agreeing().alias("starts"))
        .where("size(starts) > 0")
    )
    pairs = materialize(pairs, "pairs")
    others = live.where("length > 2").select("window", F.explode(F.slice("terms", 3, F.col("length"))).alias("t"))
    rest = (
        pairs.join(others.select("window", "t.term", "t.offset"), "window")
        .join(postings, ["term", "shard"])
        .select("window", "length", "shard", _agreeing().alias("starts"))
        .where("size(starts) > 0")
        .groupBy("window", "length", "shard")
        .agg(F.collect_list("starts").alias("lists"))
        .where("size(lists) = length - 2")
    )
    all_of = F.aggregate("lists", F.col("lists")[0], F.array_intersect)
    rest = rest.select("window", "length", "shard", all_of.alias("starts")).where("size(starts) > 0")
    return materialize(single.unionByName(pairs.where("length = 2")).unionByName(rest), "occurrences")


def spans(lists: list[tuple[int, list[int]]], within: int) -> list[tuple[int, int]]:
    """Start and length of the stretches of ``within`` words at most that have ``need`` places of
    each list ``(need, places)``, and no shorter such stretch inside."""
    events = sorted((p, k) for k, (_, places) in enumerate(lists) for p in places)
    lacking, have, held_here = len(lists), [0] * len(lists), deque()
    out: list[tuple[int, int]] = []
    for p, k in events:
        held_here.append((p, k))
        have[k] += 1
        lacking -= have[k] == lists[k][0]
        # of what starts earlier nothing is needed
        while have[held_here[0][1]] > lists[held_here[0][1]][0] or p - held_here[0][0] >= within:
            _, j = held_here.popleft()
            lacking += have[j] == lists[j][0]
            have[j] -= 1
        if not lacking and not (out and out[-1][0] == held_here[0][0]):
            out.append((held_here[0][0], p - held_here[0][0] + 1))
    return out


def nearby(found: Index, cut: DataFrame, within: int) -> DataFrame:
    """``window``, ``shard``, ``start`` and ``length`` of the shortest stretches of ``within``
    places at most that have every word of a window, in any order and as often as the window has
    it.  Some may reach from one document into the next; none of those lies inside another."""
    live = _ranked(found, cut)
    postings = found.postings.drop("n")
    rarest = live.select("window", F.col("terms")[0]["term"].alias("term")).join(postings.drop("places"), "term")
    need = live.select("window", F.explode("terms.term").alias("term")).groupBy("window", "term").agg(F.count("*").alias("need"))
    kinds = live.select("window", F.size(F.array_distinct("terms.term")).alias("kinds"))

    def judge(columns: pa.Array) -> pa.Array:
        made = [
            [{"start": a, "length": n} for a, n in spans([(x["need"], x["places"]) for x in lists], within)]
            for lists in (c.as_py() for c in columns)
        ]
        return pa.array(made, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))

    lists = (
        rarest.select("window", "shard")
        .join(need, "window")
        .join(postings, ["term", "shard"])
        .where(F.size("places") >= F.col("need"))
        .groupBy("window", "shard")
        .agg(F.collect_list(F.struct("need", "places")).alias("lists"))
        .join(kinds, "window")
        .where("size(lists) = kinds")
    )
    near = arrow_column(judge, "array<struct<start:long,length:long>>", F.col("lists"))
    return lists.select("window", "shard", F.explode(near).alias("m")).select("window", "shard", "m.start", "m.length")


def _placed(places: DataFrame, found: Index) -> DataFrame:
    """``places`` with the ``first`` of the document that their ``start`` is in: one sort of each
    shard's documents and places."""
    marked = found.documents.where("n_words > 0").select("shard", F.col("first").alias("start"), "first")
    whole = marked.unionByName(places, allowMissingColumns=True)
    order = Window.partitionBy("shard").orderBy("start", F.col("first").asc_nulls_last())
    last = F.last("first", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return whole.withColumn("document", last).where("first is null").drop("first").withColumnRenamed("document", "first")


def contamination(
    documents: DataFrame,
    items: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    size: int = 13,
) -> DataFrame:
    """For each document: ``row`` (struct of its columns but the text), ``digest`` (SHA-256 of the
    text, lowercase hex), ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``.

    A window is ``size`` consecutive words of an item; an item of fewer words, but not none, is
    one window.  A word inside any occurrence of a window is hit.  ``n_items`` counts distinct
    item ids with an occurring window, ``items_sha256`` digests those ids sorted as strings and
    joined by commas.  Null and empty texts have no words; null and empty items, and an empty
    table of items, never occur; items with equal ids count as one.  Repeated documents each
    have their row.
    """
    cut = windows(items, item, item_text, size)
    found = index(documents, text, cut.select(F.explode("terms").alias("term")).distinct())
    occurring = occurrences(found, cut)
    document = ["shard", "first"]
    each = occurring.select("window", "length", "shard", F.explode("starts").alias("start"))
    ends = each.groupBy("shard", "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    before = F.max("end").over(Window.partitionBy(*document).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.col("start"))), F.lit(0))
    hits = _placed(ends, found).withColumn("new", new).groupBy(*document).agg(F.sum("new").alias("n_hit"))
    ids = (
        _placed(each.select("window", "shard", "start"), found)
        .select("window", *document)
        .distinct()
        .join(cut.select("window", "item"), "window")
        .groupBy(*document)
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return (
        found.documents.join(hits.join(ids, document), document, "left")
        .select(
            "row",
            "digest",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size(listed).cast("long").alias("n_items"),
            F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        )
    )


def matches(
    documents: DataFrame,
    items: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    size: int = 13,
    within: int | None = None,
) -> DataFrame:
    """One row for each place where a window of an item occurs: ``doc``, ``item`` (string),
    ``start`` (word of the document, from 0) and ``length``.

    With ``within``, proximity matches instead: the stretches of ``within`` words at most that
    have every word of a window, in any order, as often as the window has it, and no shorter such
    stretch inside.  They do not depend on how documents are dealt to shards.
    """
    cut = windows(items, item, item_text, size)
    found = index(documents, text, cut.select(F.explode("terms").alias("term")).distinct())
    if within is None:
        places = occurrences(found, cut).select("window", "shard", F.explode("starts").alias("start"), F.col("length").cast("long").alias("length"))
    else:
        places = nearby(found, cut, within)
    return (
        _placed(places, found)
        .join(cut.select("window", "item"), "window")
        .join(found.documents, ["shard", "first"])
        .where("start + length <= first + n_words")
        .select(F.col(f"row.`{doc}`").alias(doc), F.col("item").alias(item), (F.col("start") - F.col("first")).cast("long").alias("start"), "length")
    )


def without(documents: DataFrame, items: DataFrame, text: str = "text", **columns) -> DataFrame:
    """The documents that are not contaminated; columns as they were, repeated rows too."""
    found = contamination(documents.select(text), items, text, **columns)
    name = free_name(documents, "digest")
    digests = found.where(contaminated()).select(F.col("digest").alias(name)).distinct()
    own = F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256)
    return documents.join(digests, own == F.col(name), "left_anti")


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words") -> Column:
    """Whether a twentieth of the words or more are hit, and any."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))
