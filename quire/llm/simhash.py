"""SimHash near-duplicates by multi-index hashing.

A fingerprint has two segments of 32 bits.  Two fingerprints at most two bits apart are at most
one bit apart in the high segment, or equal in the low one (if the high ones differ in two
bits, nothing is left for the low ones).  So every distinct fingerprint stands in a table under
each of its segments, and asks for the ball of radius 1 around its high segment and for its
low segment itself; what it fetches is verified on all 64 bits.

A table entry that very many fingerprints share is not paired out.  Inside such an entry the
same is asked of the other segment's balls, and those that share a point of a ball are linked
to one of them, which gives the same components with a number of rows in proportion to the
entry.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import arrow_column, free_name, utf8
from quire.session import materialize

#: Fingerprints under one table entry up to which they are paired directly.
PAIRED = 256

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_SEED = 42


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """A bit is set if it is in more than half of the shingles' XXH64 (seed 42).

    A-Z are lower-cased, words are parted by ASCII white space, a text of fewer words is one
    shingle, one without words has fingerprint 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, _SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-shingle] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], _SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], "<u8"
    )
    octets = hashes.view(np.uint8).reshape(-1, 8)
    if len(octets) < 64:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * ones > len(octets), bitorder="little").view("<u8")[0])


def fingerprints(text: Column, shingle: int = 3) -> Column:
    """Fingerprint of each text as a signed 64-bit number; 0 for null and empty texts."""

    def make(texts: pa.Array) -> pa.Array:
        values = np.fromiter((fingerprint(t, shingle) for t in utf8(texts)), np.uint64, len(texts))
        return pa.array(values.view(np.int64))

    return arrow_column(make, "long", text)


def _low(c: Column) -> Column:
    return c.bitwiseAND(F.lit(0xFFFFFFFF))


def _ball(c: Column) -> Column:
    """A 32-bit segment and the 32 that differ from it in one bit."""
    flipped = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: c.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))
    return F.concat(F.array(c), flipped)


def links(distinct: DataFrame, column: str = "fp", paired: int = PAIRED) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints with the components of all pairs that are
    at most two bits apart.  Every link is such a pair; entries of at most ``paired``
    fingerprints give all of their pairs."""
    fp = F.col(column)
    high, low = _low(F.shiftrightunsigned(fp, 32)), _low(fp)
    entries = distinct.select(
        fp.alias("b"), F.inline(F.array(
            F.struct(F.lit(0).alias("part"), high.alias("key")),
            F.struct(F.lit(1).alias("part"), low.alias("key")),
        ))
    )
    probes = distinct.select(
        fp.alias("a"), F.inline(F.concat(
            F.transform(_ball(high), lambda k: F.struct(F.lit(0).alias("part"), k.alias("key"))),
            F.array(F.struct(F.lit(1).alias("part"), low.alias("key"))),
        ))
    )
    sizes = entries.groupBy("part", "key").count()
    crowded = materialize(sizes.where(F.col("count") > paired).select("part", "key"), "simhash-crowded")
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    if crowded.isEmpty():
        return (
            probes.join(entries, ["part", "key"])
            .where((F.col("a") != F.col("b")) & (apart <= 2))
            .select("a", "b")
        )
    near = (
        probes.join(entries.join(crowded, ["part", "key"], "left_anti"), ["part", "key"])
        .where((F.col("a") != F.col("b")) & (apart <= 2))
        .select("a", "b")
    )
    # inside a crowded entry: whoever asks for it takes the points of the ball around its
    # other segment; members own the point that is their other segment itself
    asking = probes.join(crowded, ["part", "key"])
    other = lambda c: F.when(F.col("part") == 0, _low(c)).otherwise(_low(F.shiftrightunsigned(c, 32)))
    own = F.when(F.col("part") == 0, _low(F.shiftrightunsigned(F.col("a"), 32))).otherwise(_low(F.col("a")))
    points = asking.select(
        "part", "key", "a", (own == F.col("key")).alias("member"), other(F.col("a")).alias("rest"),
        F.explode(_ball(other(F.col("a")))).alias("point"),
    )
    owner = F.when(F.col("member") & (F.col("rest") == F.col("point")), F.col("a"))
    centres = points.groupBy("part", "key", "point").agg(
        F.min(owner).alias("owner"), F.min(F.when(F.col("member"), F.col("a"))).alias("first")
    ).select("part", "key", "point", F.coalesce("owner", "first").alias("b"))
    starred = (
        points.join(centres, ["part", "key", "point"])
        .where((F.col("a") != F.col("b")) & (apart <= 2))
        .select("a", "b")
    )
    return near.unionByName(starred)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(fp, component_id)``: the smallest ``label`` that each linked fingerprint reaches.

    ``nodes`` has ``fp`` (distinct) and ``label`` (null sorts last, equal labels are told apart
    by their fingerprint).  Each round every fingerprint takes the smallest root among its own
    and its neighbours', then the root of that root (pointer jumping), until no root falls.
    Rounds are written to the shared folder.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.distinct(), "simhash-edges")
    linked = both.select(F.col("a").alias("fp")).distinct()
    root = F.struct(F.col("label").isNull().alias("none"), F.col("label"), F.col("fp").alias("at"))
    state = materialize(nodes.join(linked, "fp").select("fp", root.alias("root")), "simhash-roots")
    while True:
        heard = (
            both.join(state.select(F.col("fp").alias("b"), "root"), "b")
            .groupBy(F.col("a").alias("fp")).agg(F.min("root").alias("heard"))
        )
        lower = state.join(heard, "fp").select("fp", F.col("root").alias("old"), F.least("root", "heard").alias("root"))
        lower = materialize(lower, "simhash-heard")
        further = lower.select(F.col("fp").alias("at"), F.col("root").alias("further"))
        stepped = lower.withColumn("at", F.col("root.at")).join(further, "at").select(
            "fp", "old", F.least("root", "further").alias("root")
        )
        state = materialize(stepped, "simhash-roots")
        if state.where(F.col("root") < F.col("old")).isEmpty():
            return state.select("fp", F.col("root.label").alias("component_id"))
        state = state.drop("old")


def near_duplicates(
    documents: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = 3, paired: int = PAIRED
) -> DataFrame:
    """One row per row of ``documents``: ``doc``, ``fingerprint`` (16 hexadecimal digits) and
    ``component_id``, the smallest ``doc`` reachable over links of at most two bits.

    Null, empty and wordless texts have fingerprint zero, which is linked like any other; equal
    texts share a component; rows with equal ids are kept apart; rows without an id count for
    no component's smallest id, and have none if all of theirs lack one.  Other columns are ignored.
    """
    rows = materialize(
        documents.select(F.col(doc).alias("doc"), fingerprints(F.col(text), shingle).alias("fp")), "simhash-rows"
    )
    distinct = rows.groupBy("fp").agg(F.min("doc").alias("label"))
    distinct = materialize(distinct, "simhash-distinct")
    found = components(distinct, links(distinct, "fp", paired))
    groups = distinct.join(found, "fp", "left").select("fp", F.coalesce("component_id", "label").alias("component_id"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    # a fingerprint that a large share of the rows has meets its one component here: only
    # the rows' side of the join is skewed, which adaptive execution splits
    return rows.join(groups, "fp", "left").select(
        F.col("doc").alias(doc), digits.alias("fingerprint"), "component_id"
    )


def first_of_each(documents: DataFrame, doc: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``documents`` whose id is its component's smallest; all columns stay.

    Of rows that repeat both id and text one stays.  Rows without an id stay, as nothing names
    them.
    """
    found = materialize(near_duplicates(documents, doc, text, **options), "simhash-found")
    gone, again = free_name(documents, "gone"), free_name(documents, "again")
    leave = found.where(F.col(doc) != F.col("component_id")).select(F.col(doc).alias(gone)).distinct()
    kept = documents.join(leave, documents[doc] == F.col(gone), "left_anti")
    repeated = found.where(F.col(doc).isNotNull()).groupBy(F.col(doc).alias(again)).count().where("count > 1").select(again)
    repeated = materialize(repeated, "simhash-repeated")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, kept[doc] == F.col(again), "left_semi").dropDuplicates([doc, text])
    return kept.join(repeated, kept[doc] == F.col(again), "left_anti").unionByName(once)


def one_of_each(
    documents: DataFrame, doc: str = "doc_id", text: str = "text", shingle: int = 3, paired: int = PAIRED
) -> DataFrame:
    """One row of every component of near-duplicates; all columns stay.

    It is the row with the smallest id, among those with the smallest hash of its text; rows
    without an id come last.  Ids need not be unique: rows are told apart by id and text, and
    of rows that repeat both one stays.
    """
    own = free_name(documents, "text_hash")
    gone, gone_hash = free_name(documents, "gone"), free_name(documents, "gone_hash")
    rows = documents.select(
        F.col(doc).alias("doc"), F.xxhash64(text).alias("hash"), fingerprints(F.col(text), shingle).alias("fp")
    )
    keys = materialize(rows.groupBy("doc", "hash", "fp").count(), "simhash-keys")
    least = F.struct(F.col("doc").isNull().alias("none"), "doc", "hash")
    distinct = materialize(keys.groupBy("fp").agg(F.min(least).alias("least")), "simhash-distinct")
    # labelled by their fingerprints, components are told apart where they share an id
    nodes = distinct.select("fp", F.col("fp").alias("label"))
    found = components(nodes, links(nodes, "fp", paired))
    groups = distinct.join(found, "fp", "left").select("fp", "least", F.coalesce("component_id", "fp").alias("group"))
    first = groups.groupBy("group").agg(F.min("least").alias("first"))
    owner = groups.select("fp", "group").join(first, "group").select("fp", "first")
    kept_key = F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("hash") == F.col("first.hash"))
    judged = materialize(
        keys.join(owner, "fp").where(~kept_key | (F.col("count") > 1))
        .select(F.col("doc").alias(gone), F.col("hash").alias(gone_hash), kept_key.alias("again")),
        "simhash-judged",
    )
    leave, again = judged.where("not again").drop("again"), judged.where("again").drop("again")
    hashed = documents.withColumn(own, F.xxhash64(text))
    same = hashed[doc].eqNullSafe(F.col(gone)) & (F.col(own) == F.col(gone_hash))
    kept = hashed.join(leave, same, "left_anti")
    if again.isEmpty():
        return kept.drop(own)
    same = kept[doc].eqNullSafe(F.col(gone)) & (F.col(own) == F.col(gone_hash))
    once = kept.join(again, same, "left_semi").dropDuplicates([doc, text])
    return kept.join(again, same, "left_anti").unionByName(once).drop(own)
