"""Shards along a Hilbert curve through document metadata.

Every dimension is cut into cells at its quantiles (a sketch of bounded size), the cells are
numbered along the Hilbert curve, rows are range-partitioned and sorted by that number, and the
one long run is cut into shards of equal row counts.  Neighbours on the curve are close in all
dimensions, so a shard, and every file or row group inside it, has a narrow range in each.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import arrow_column
from quire.session import materialize

#: Bits of each dimension.
BITS = 4


def curve_index(cells: list[np.ndarray], bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points given by one cell number per dimension.

    Gray-code walk: from the highest bit down, a dimension whose bit is set turns the lower
    bits of the first dimension round, and one whose bit is not set swaps them with its own.
    """
    x = [c.astype(np.int64).copy() for c in cells]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | (((x[i] ^ turn) >> b) & 1)
    return index


def rank_code(df: DataFrame, column: str, shared: int = 0) -> Column:
    """Number in the order of the column's values: numbers as they are, other values by six bytes
    of their text after the ``shared`` ones that all begin with; null is below all."""
    kind = dict(df.dtypes)[column]
    if is_number(kind):
        code = F.col(column).cast("double")
    else:
        some = F.substring(F.hex(F.col(column).cast("string")), 1 + 2 * shared, 12)
        code = F.conv(F.rpad(some, 12, "0"), 16, 10).cast("double")
    return F.coalesce(F.when(F.isnan(code), None).otherwise(code), F.lit(-1.0e300))


def is_number(kind: str) -> bool:
    return kind in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean") or kind.startswith("decimal")


def shared_starts(df: DataFrame, columns: list[str]) -> list[int]:
    """Bytes that all values of each column begin with (0 for numbers): what the smallest and the
    greatest value share, all share."""
    texts = [c for c in dict.fromkeys(columns) if not is_number(dict(df.dtypes)[c])]
    if not texts:
        return [0] * len(columns)
    both = df.agg(*(f(F.col(c).cast("string")).alias(f"{n}{i}") for i, c in enumerate(texts) for n, f in (("a", F.min), ("b", F.max)))).head()
    found = {c: len(os.path.commonprefix([(both[f"{n}{i}"] or "").encode() for n in "ab"])) for i, c in enumerate(texts)}
    return [found.get(c, 0) for c in columns]


def curve_column(df: DataFrame, dimensions: list[Column], bits: int = BITS) -> Column:
    """Hilbert index of each row for numeric dimensions, cut at their quantiles."""
    cells = 1 << bits
    at = [i / cells for i in range(1, cells)]
    found = df.select(*[F.percentile_approx(d, at, 10_000).alias(f"q{i}") for i, d in enumerate(dimensions)]).head()
    cuts = [sorted(set(q or [])) for q in found]

    def walk(*values: pa.Array) -> pa.Array:
        numbered = [np.searchsorted(c, v.to_numpy(zero_copy_only=False), "right") for c, v in zip(cuts, values, strict=True)]
        return pa.array(curve_index(numbered, bits))

    return arrow_column(walk, "long", *dimensions)


def assign(
    documents: DataFrame,
    dimensions: list[str],
    shards: int = 8,
    doc: str = "doc_id",
    text: str = "text",
    columns: list[str] | None = None,
    bits: int = BITS,
) -> DataFrame:
    """The ``columns`` (default: ``doc``) of every row, with ``size`` (UTF-8 bytes of the text,
    none for null, plus 1), ``text_crc32``, ``curve``, ``shard`` and ``slot``.

    Dimensions are columns of ``documents``; the size is always one more.  Law ``rows``: the
    shards' row counts differ by at most one; ``slot`` counts from 0 inside each shard, along
    the curve.  Rows of one cell, however many, are ordered by size, text and id, so equal
    texts lie together in it.  Repeated rows each have their own slot; rows without an id come
    first in their cell; an empty table gives no rows.  Columns of ``documents`` named like the
    results are replaced by them.
    """
    spark = documents.sparkSession
    own = ["size", "text_crc32", "curve", "shard", "slot"]
    keep = [c for c in (columns or [doc]) if c not in own]
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce(F.col(text).cast("binary"), F.lit(b"")))
    codes = [rank_code(documents, d, n) for d, n in zip(dimensions, shared_starts(documents, dimensions), strict=True)]
    rows = documents.select(
        *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)],
        F.col(doc).alias("id"), size.alias("size"), crc.alias("text_crc32"),
        *[c.alias(f"d{i}") for i, c in enumerate(codes)],
        F.xxhash64(F.monotonically_increasing_id()).alias("tie"),
    )
    axes = [F.col(f"d{i}") for i in range(len(codes))] + [F.col("size").cast("double")]
    rows = rows.withColumn("curve", curve_column(rows, axes, bits))
    # rows that are equal in all else, however many, may still be parted
    order = ["curve", "size", "text_crc32", "id", "tie"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # one sorted run in n parts; the identifier holds the part above bit 33 and, below it,
    # the row's place in the part
    run = (
        rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
        .select(*[f"k{i}" for i in range(len(keep))], "size", "text_crc32", "curve", F.monotonically_increasing_id().alias("at"))
    )
    run = materialize(run, "hilbert-run")
    part = F.shiftright("at", 33)
    counts = run.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    # one row for each part of the run
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
        F.sum("n").over(Window.partitionBy()).alias("total"),
    )
    rank = F.col("offset") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = run.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", rank)
    shard = F.expr(f"cast((rank * {shards}) div total as int)")
    first = F.expr(f"((cast((rank * {shards}) div total as bigint) * total) + {shards - 1}) div {shards}")
    return placed.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
        "size", "text_crc32", "curve", shard.alias("shard"), (F.col("rank") - first).alias("slot"),
    )


def write(documents: DataFrame, path: str, dimensions: list[str], **options) -> None:
    """Write all columns of ``documents`` as Parquet, one folder per shard, each file a stretch
    of the curve; readers prune folders by ``shard`` and row groups by every dimension."""
    placed = assign(documents, dimensions, columns=documents.columns, **options)
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        placed.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard").parquet(path)
    )
