"""Saved result tables: read them when they exist, else compute and write."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a finished write is at ``path`` (its success marker is there)."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return bool(marker.getFileSystem(conf).exists(marker))


def reuse_or_write(
    spark: SparkSession,
    path: str,
    compute: Callable[[], DataFrame],
    use_saved: bool = True,
    format: str = "parquet",
) -> DataFrame:
    """The saved table at ``path`` when allowed and complete, else the computed one, saved."""
    if use_saved and exists(spark, path):
        return spark.read.format(format).load(path)
    df = compute()
    df.write.mode("overwrite").format(format).save(path)
    return spark.read.format(format).schema(df.schema).load(path)


def _manifests(spark: SparkSession, path: str):
    """The folder of manifests with its file system, and the numbers published so far, last first."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_manifests")
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in system.listStatus(folder)] if system.exists(folder) else []
    numbers = sorted((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), reverse=True)
    return system, folder, numbers


def new_version(path: str) -> str:
    """A folder below ``path`` that nothing else writes to."""
    return f"{path.rstrip('/')}/versions/{uuid.uuid4().hex}"


def publish(spark: SparkSession, path: str, tables: dict[str, str]) -> int:
    """Make finished tables the current ones of ``path``; the number of the manifest.

    The manifest is the one file that readers look for, written last and under a number of its
    own: of two writers at once the later number counts, and neither mixes with the other.
    """
    system, folder, numbers = _manifests(spark, path)
    number = (numbers[0] if numbers else 0) + 1
    text = json.dumps({"tables": tables, "complete": True}).encode()
    while True:
        file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, f"{number:012d}.json")
        try:
            out = system.create(file, False)
        except Py4JJavaError as taken:
            if "AlreadyExists" not in str(taken.java_exception.getClass()):
                raise
            number += 1
            continue
        out.write(bytearray(text))
        out.close()
        return number


def published(spark: SparkSession, path: str) -> dict[str, str] | None:
    """The tables of the newest complete manifest of ``path``, None without one."""
    _, folder, numbers = _manifests(spark, path)
    for number in numbers:
        rows = spark.read.text(f"{folder.toString()}/{number:012d}.json", wholetext=True).collect()
        try:
            found = json.loads(rows[0]["value"]) if rows else {}
        except json.JSONDecodeError:
            continue  # cut off: the writer was lost
        if found.get("complete"):
            return found["tables"]
    return None
