"""Run registered queries beside their SQL: ``python -m checks.compare sf_dir [names...]``."""

from __future__ import annotations

import sys
import time
from decimal import Decimal

import duckdb
from pyspark.sql import SparkSession

from checks.queries import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def rows_of(columns: list[str], rows) -> list[tuple]:
    """Rows in a fixed order with the columns sorted by name."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        whole = isinstance(v, (Decimal, int)) and not isinstance(v, bool)
        return str(v) if whole else v

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark: SparkSession, sf_dir: str, name: str) -> tuple[bool, str]:
    """Whether the query gives the rows of its SQL, and a line about it."""
    started = time.time()
    df = QUERIES[name](spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - started
    if name not in ORACLES:
        return True, f"{name}: {len(ours)} rows, no SQL, {took:.1f}s"
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    theirs = rows_of(columns, found.fetchall())
    if sorted(columns) != sorted(df.columns):
        return False, f"{name}: columns {sorted(df.columns)} against {sorted(columns)}"
    if ours == theirs:
        return True, f"{name}: {len(ours)} rows equal, {took:.1f}s"
    left, right = set(map(repr, ours)), set(map(repr, theirs))
    show = "\n".join(
        ["   cols " + str(sorted(columns))]
        + ["   ours " + r[:600] for r in sorted(left - right)[:3]]
        + ["   sql  " + r[:600] for r in sorted(right - left)[:3]]
    )
    return False, f"{name}: {len(ours)} rows against {len(theirs)}, {took:.1f}s\n{show}"


def main() -> None:
    sf_dir, *names = sys.argv[1:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in names or list(QUERIES):
        try:
            ok, text = compare(spark, sf_dir, name)
        except Exception as e:  # noqa: BLE001
            ok, text = False, f"{name}: {type(e).__name__} {str(e)[:1500]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + text, flush=True)
    print(f"{bad} failed")


if __name__ == "__main__":
    main()
