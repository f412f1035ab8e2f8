"""Embedding vectors: which rows hold one, and their entries as integers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import ship

#: Entries of this size or more count as not finite: their squares would leave 64 bits.
LARGEST = float(1 << 20)
#: Rows that are worked on in one go.
BLOCK = 4096


def vectors_of(df: DataFrame, ident: str, vector: str, length: int | None = None) -> DataFrame:
    """Rows ``(vec_id, vector)`` whose vector has no null and no entry that is not finite, and
    ``length`` entries; without ``length`` as many as most of them have, the longer of equals.

    Other columns are left behind, ids may repeat or be null.
    """
    v = F.col("vector")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < LARGEST))
    some = df.select(F.col(ident).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where(fine)
    if length is None:
        sizes = some.groupBy(F.size("vector").alias("size")).count()
        most = sizes.orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
        length = most[0]["size"] if most else 0
    return some.where(F.size("vector") == length)


def blocks(batch: pa.RecordBatch, length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch of ``(vec_id, vector)``, each with ``floor(64 * entry)`` as rows of int64."""
    for at in range(0, batch.num_rows, BLOCK):
        part = batch.slice(at, BLOCK)
        entries = part.column("vector").flatten().to_numpy(zero_copy_only=False)
        yield part, np.floor(64 * entries.reshape(-1, length)).astype(np.int64)


def summed(rows: DataFrame, length: int, groups: Callable[[np.ndarray], np.ndarray]) -> dict[int, tuple[int, list[int]]]:
    """Number and exact sums of the integer vectors of each group.

    ``groups`` gives a group number for each row of a block.  A task sends one row a group, and
    Spark adds those up: the driver gets as many rows as there are groups, whatever the table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in blocks(batch, length):
                group = groups(x)
                for g in np.unique(group).tolist():
                    of = group == g
                    n[g] = n.get(g, 0) + int(of.sum())
                    sums[g] = sums.get(g, 0) + x[of].sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict(
                {"g": list(n), "n": list(n.values()), "s": [sums[g].tolist() for g in n]},
                pa.schema([("g", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))]),
            )

    ship(rows.sparkSession)
    parts = rows.mapInArrow(run, "g int, n long, s array<long>")
    total = parts.groupBy("g").agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(length)))
    return {r["g"]: (r["n"], [r[f"s{i}"] for i in range(length)]) for r in total.collect()}
