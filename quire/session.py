"""Session settings the jobs rely on, and the one way they cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Everything about one resource is keyed by resource_id.  With the first setting a
# join on (resource_id, x) accepts data already hashed by resource_id alone, so the
# token stream is exchanged once, before it is exploded, and never again.
SQL_SETTINGS = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # sanitised payload keys may collide: the last one stays
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # markup rows are sorted by resource where they are grouped by it: one group at a time,
    # in place of a table of the lists of all documents of a partition
    "spark.sql.execution.replaceHashWithSortAgg": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings; cluster-level settings are left alone."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def by_resource(df: DataFrame, key: str = "resource_id") -> DataFrame:
    """Rows hashed by resource into ``spark.sql.shuffle.partitions`` partitions.

    The number is stated, so that adaptive execution does not merge the partitions: it
    would judge them by the size of the packed documents, which grow a lot when cut.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, key)


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``, else one below the warehouse.

    Nothing here deletes it: whoever names the folder removes it when the runs are over.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def checkpointed(df: DataFrame, keep_partitioning: bool = False) -> DataFrame:
    """Reliable checkpoint in the shared folder.

    ``keep_partitioning`` plans the job without adaptive execution, which would hide how
    the rows are hashed and sorted, so that what reads them needs no exchange.
    """
    spark = df.sparkSession
    checkpoint_root(spark)
    if not keep_partitioning:
        return df.checkpoint()
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.checkpoint()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts lineage so that a lost executor costs a re-read, and gives the planner true
    sizes: a broadcast chosen on the result rests on the size of the written files.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/quire/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
