"""Incremental payload acceptance: the same split as the batch scan, file by file.

Nothing here keeps state.  Each landed file is one row, goes to the accepted or to the
rejected table, and is remembered by the checkpoint of its query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.sources.payloads import accept, landed_name


def read_landing(spark: SparkSession, path: str, suffix: str = "json") -> DataFrame:
    """Streaming rows request_id, payload of the files that arrive below ``path``."""
    files = spark.readStream.format("text").option("wholetext", True)
    return (
        files.option("pathGlobFilter", f"*.{suffix}")
        .load(path)
        .select(landed_name(suffix).alias("request_id"), F.col("value").alias("payload"))
    )


def land(landing: DataFrame, out: str, checkpoint: str) -> list[StreamingQuery]:
    """Append what has arrived to ``out/accepted`` and ``out/rejected``, then stop."""
    kept = landing.withColumn("body", F.col("payload"))
    split = accept(kept)
    tables = {
        "accepted": split.accepted.select("request_id", F.col("body").alias("payload")),
        "rejected": split.rejected.select("request_id", "payload", "reason"),
    }
    return [
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{checkpoint.rstrip('/')}/{name}")
        .trigger(availableNow=True)
        .start(f"{out.rstrip('/')}/{name}")
        for name, df in tables.items()
    ]
