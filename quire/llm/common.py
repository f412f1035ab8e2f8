"""Small helpers that the training-data operators share."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import Broadcast, SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest model, vocabulary or block of a query set that is broadcast whole.
MAX_BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_bytes(spark: SparkSession, data: bytes) -> Broadcast:
    """Broadcast of bytes whose size is checked."""
    if len(data) > MAX_BROADCAST_BYTES:
        raise ValueError(f"{len(data)} bytes are too many to broadcast")
    return spark.sparkContext.broadcast(data)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or it with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def utf8(texts: pa.Array) -> Iterator[bytes]:
    """UTF-8 of each text, empty for null, one at a time."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.StringArray | pa.LargeStringArray):
        texts = texts.cast(pa.large_binary() if isinstance(texts, pa.LargeStringArray) else pa.binary())
    for x in texts:
        yield x.as_py() or b""


_held: dict = {}


def held(kind: str, data: bytes, make: Callable):
    """``make(data)``, kept until a worker needs another: a reused worker holds one model, with
    the tables it has grown, at a time."""
    if _held.get("key") != (kind, data):
        _held.clear()
        _held.update(value=make(data), key=(kind, data))
    return _held["value"]


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, if their path does not have it."""
    top = Path(__file__).resolve().parents[2]
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    sc = spark.sparkContext
    if str(top) in known or "quire.zip" in sc._python_includes:
        return
    folder = Path(SparkFiles.getRootDirectory()) / "packages"
    folder.mkdir(exist_ok=True)
    with zipfile.ZipFile(folder / "quire.zip", "w") as z:
        for f in sorted((top / "quire").rglob("*.py")):
            z.write(f, f.relative_to(top))
    sc.addPyFile(str(folder / "quire.zip"))


def arrow_column(fn: Callable[..., pa.Array], schema: str, *columns: Column | str) -> Column:
    """``fn`` over Arrow arrays of the columns, as a column of type ``schema``."""
    ship(SparkSession.active())
    return F.arrow_udf(fn, schema)(*columns)


def bounded(df: DataFrame, key: Column, rows: int, total: int | None = None) -> DataFrame:
    """About ``rows`` rows of ``df`` (all of a smaller one), chosen by a hash of ``key``.

    The same rows come out on every run, and no row moves.
    """
    total = df.count() if total is None else total
    if total <= rows:
        return df
    part = int(rows / total * (1 << 30))
    return df.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < part)
