"""Collection, navigation and parents payloads, and documents, as landed files or tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import let
from quire.functions import variant as V
from quire.functions.text import id_list, strip
from quire.session import materialize


def id_of_name(on_disk: Column) -> Column:
    """The id in the name of a landed file without its suffix: percent-decoded, or as it is when that
    is no percent-encoding."""
    return F.coalesce(F.try_url_decode(on_disk), on_disk)


def landed_name(suffix: str) -> Column:
    """``id_of_name`` of the file that Spark reads a row from; Spark shows names as parts of a URI."""
    shown = F.regexp_extract(F.col("_metadata.file_name"), rf"^(.*)\.{suffix}$", 1)
    return id_of_name(F.url_decode(F.replace(shown, F.lit("+"), F.lit("%2B"))))


FILE_BYTES = 4_000_000  # of texts, or that many names and a bit, are handed on at once
HIDDEN = ("_", ".")  # what begins so is left out, as Spark's readers do


def read_files(spark: SparkSession, path: str, suffix: str, name: str) -> DataFrame:
    """One row per landed file: the id in its name, and its whole text (UTF-8).

    Files may lie in folders below ``path``, to any depth; a file of no bytes is a text of none.
    Spark's own readers keep the list of all files on the driver, with the block places of each.
    Here folders are listed in tasks, level by level, and files read in tasks by names that lie
    in a table, so nothing on the driver grows with their number.  The names of one folder go
    through one task.  Arrow must know the scheme of the path; for others, and for patterns in
    place of a path, it is Spark's reader after all.
    """
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    place = _folder(spark, path)
    if place is None:
        return _read_by_spark(spark, path, suffix, parts).withColumnRenamed("text", name)
    uri, ending = place, f".{suffix}"

    def at(uri: str):
        from urllib.parse import unquote, urlsplit

        from pyarrow import fs

        local = uri.startswith("file:")
        return (fs.LocalFileSystem(), unquote(urlsplit(uri).path)) if local else fs.FileSystem.from_uri(uri)

    def inside(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, _ = at(uri)
        for batch in batches:
            for folder in batch.column("file").to_pylist():
                found = [
                    (x.path, x.type == fs.FileType.Directory) for x in system.get_file_info(fs.FileSelector(folder))
                    if not x.base_name.startswith(HIDDEN) and (x.type == fs.FileType.Directory or x.base_name.endswith(ending))
                ]
                for i in range(0, len(found), 10_000):
                    files, folders = zip(*found[i : i + 10_000])
                    yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(folders, pa.bool_())], ["file", "folder"])

    def texts(batches):
        import pyarrow as pa

        system, _ = at(uri)
        files, read, size = [], [], 0
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(read, pa.binary())], ["file", "content"])
        for batch in batches:
            for file in batch.column("file").to_pylist():
                with system.open_input_stream(file, compression=None) as f:
                    files.append(file)
                    read.append(f.read())
                size += len(read[-1]) + 1_000
                if size >= FILE_BYTES:
                    yield rows()
                    files, read, size = [], [], 0
        yield rows()

    level, found = spark.createDataFrame([(at(uri)[1],)], "file string"), []
    while True:
        listed = materialize(level.mapInArrow(inside, "file string, folder boolean"), "landed-names")
        found.append(listed.filter("NOT folder").select("file"))
        below = listed.filter("folder").select("file")
        if below.isEmpty():
            break
        level = below.repartition(parts, "file")
    files = reduce(DataFrame.unionByName, found).repartition(parts, "file").mapInArrow(texts, "file string, content binary")
    last = F.substring_index("file", "/", -1)
    on_disk = F.substr(last, F.lit(1), F.char_length(last) - len(ending))
    return files.select(id_of_name(on_disk).alias("resource_id"), F.col("content").cast("string").alias(name))


def _folder(spark: SparkSession, path: str) -> str | None:
    """The URI of a folder that Arrow can open; NULL for patterns, other schemes and what is no folder."""
    import pyarrow as pa
    from pyarrow import fs

    if any(c in path for c in "*?[{"):
        return None
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(there).toUri()
    if whole.getScheme() == "file":
        system, base = fs.LocalFileSystem(), whole.getPath()
    else:
        try:
            system, base = fs.FileSystem.from_uri(whole.toString())
        except (pa.ArrowException, OSError):
            return None
    return whole.toString() if system.get_file_info(base).type == fs.FileType.Directory else None


def _read_by_spark(spark: SparkSession, path: str, suffix: str, parts: int) -> DataFrame:
    """Files by Spark's reader of bytes, its tasks of 32 small files joined.  It leaves out files of no bytes."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}")
    files = found.option("recursiveFileLookup", "true").load(path).coalesce(parts)
    return files.select(landed_name(suffix).alias("resource_id"), F.col("content").cast("string").alias("text"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Landed XML files: resource_id, xml."""
    return read_files(spark, path, "xml", "xml")


def read_payload_files(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON files: request_id, payload."""
    return read_files(spark, path, "json", "payload").withColumnRenamed("resource_id", "request_id")


@dataclass(frozen=True)
class Accepted:
    """Payloads that are JSON objects (``raw`` VARIANT), and the others with a reason."""

    accepted: DataFrame
    rejected: DataFrame


def accept(payloads: DataFrame, payload: str = "payload") -> Accepted:
    """Split payload rows into JSON objects and everything else; no shuffle."""
    parsed = payloads.withColumn("raw", V.parse(F.col(payload)))
    ok = V.is_object(F.col("raw"))
    reason = (
        F.when(F.col(payload).isNull() | (F.col(payload) == ""), "empty body")
        .when(F.col("raw").isNull(), "not JSON")
        .otherwise("not an object")
    )
    return Accepted(
        parsed.filter(ok).drop(payload),
        parsed.filter(~ok).withColumn("reason", reason).drop("raw"),
    )


def one_each(landed: DataFrame, key: str, value: str) -> DataFrame:
    """One row ``(key, value)`` per key of a table to which the same thing may have landed again.

    The last by ``landed_at`` stays where the table has that column, else the one with the
    greatest SHA-256; of equals the last in the table.  Keys that are NULL count as one.

    Keys are counted first; times (or digests) and places are looked at for the keys that landed
    more than once, and only rows of those are left out.  Where these keys are few, Spark
    broadcasts them and no payload moves; where there are none, the table stays as it is.  The
    table must give its rows in the same order each time, as a stored one does.
    """
    times = landed.groupBy(F.col(key).alias("_again")).count().filter("count > 1").select("_again")
    repeated = materialize(times, "landed-again")
    if repeated.isEmpty():
        return landed.select(key, value)
    age = F.col("landed_at") if "landed_at" in landed.columns else F.sha2(F.col("_value"), 256)
    # the order in the table is that of its rows before any join
    rows = landed.select(
        F.col(key).alias("_key"), F.col(value).alias("_value"), *[c for c in landed.columns if c == "landed_at"],
        F.monotonically_increasing_id().alias("_place"),
    )
    same = F.col("_key").eqNullSafe(F.col("_again"))
    # NULL is older than anything
    newest = F.max(F.struct(age.alias("_age"), F.col("_place")))["_place"]
    told = rows.join(repeated, same).groupBy("_key").agg(newest.alias("_last"))
    told = told.select(F.col("_key").alias("_again"), "_last")
    joined = rows.join(told, same, "left")
    kept = joined.filter(F.col("_last").isNull() | (F.col("_place") == F.col("_last")))
    return kept.select(F.col("_key").alias(key), F.col("_value").alias(value))


def canonical_id(raw: Column, request_id: Column) -> Column:
    """``@id`` when there is one, else the id that was asked for; trimmed."""
    own = V.truthy(V.fields(raw, id="@id")["id"]).try_cast("string")
    return strip(F.coalesce(own, request_id, F.lit("")))


def objects(payloads: DataFrame) -> DataFrame:
    """``payloads(request_id, payload)`` to one row per described object.

    request_id, object_id, type, title, raw.  A missing type means Collection.
    """
    raw = F.col("raw")
    kind = V.truthy(V.fields(raw, type="@type")["type"]).try_cast("string")
    return accept(payloads).accepted.select(
        "request_id",
        canonical_id(raw, F.col("request_id")).alias("object_id"),
        F.coalesce(kind, F.lit("Collection")).alias("type"),
        V.fields(raw, "string", title="title")["title"].alias("title"),
        "raw",
    )


def member_edges(described: DataFrame) -> DataFrame:
    """Members of every collection: request_id, parent_id, pos, child_id, child_type, child_title.

    Only members that are objects with a non-blank string ``@id`` count.
    """
    listed = described.filter(F.col("type") != "Resource").select(
        "request_id",
        F.col("object_id").alias("parent_id"),
        F.posexplode(
            V.items(V.fields(F.col("raw"), member="member")["member"], id="@id", type="@type", title="title")
        ).alias("pos", "m"),
    )
    own = F.col("m.id")
    child = strip(F.when(V.is_string(own), own.try_cast("string")))
    return (
        listed.withColumn("child_id", child)
        .filter(F.coalesce(F.col("child_id"), F.lit("")) != "")
        .select(
            "request_id",
            "parent_id",
            "pos",
            "child_id",
            F.col("m.type").try_cast("string").alias("child_type"),
            F.col("m.title").try_cast("string").alias("child_title"),
        )
    )


def parent_ids(raw: Column) -> Column:
    """Ids of the members of a parents payload, normalised; empty when it lists none."""

    def one(m: Column) -> Column:
        return let(V.first_truthy(m["at_id"], m["id"]), lambda v: F.when(V.is_string(v), v.try_cast("string")))

    return id_list(F.transform(V.items(V.fields(raw, member="member")["member"], at_id="@id", id="id"), one))


def parents(payloads: DataFrame) -> DataFrame:
    """``payloads(request_id, payload)`` to request_id, parents.

    NULL parents: the request failed or gave no object.  Empty parents: it has none.
    """
    raw = V.parse(F.col("payload"))
    return payloads.select(
        "request_id", F.when(V.is_object(raw), parent_ids(raw)).alias("parents")
    )
