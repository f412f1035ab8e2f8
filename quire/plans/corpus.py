"""From landed payloads to result tables, and back from saved ones."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import variant as V
from quire.operators import fragments as FR
from quire.operators import metadata as M
from quire.operators import navigation as nav
from quire.operators import validate as val
from quire.operators import walk as W
from quire.operators.requestlog import run_stats
from quire.session import checkpointed, configure, materialize
from quire.sinks.files import write_results
from quire.sources import payloads as P
from quire.sources import results as saved

# Fixed value: version of the text service interface the payloads follow.
DTS_VERSION = "1-alpha"


@dataclass(frozen=True)
class CollectionParams:
    """Where the walk starts, what it leaves out, what it keeps of collections."""

    collection_id: str | None = None
    excluded_ids: Sequence[str] = ()
    metadata_dublincore: Sequence[str] | None = None
    metadata_extensions: Sequence[str] | None = None
    fetch_linked_parents: bool = True


@dataclass(frozen=True)
class ResourceParams:
    """What is kept of resources, and how their documents are split."""

    metadata_dublincore: Sequence[str] | None = None
    metadata_extensions: Sequence[str] | None = None
    fetch_linked_parents: bool = True
    fragments: FR.FragmentParams = field(default_factory=FR.FragmentParams)


@dataclass(frozen=True)
class Landed:
    """Landed tables: payloads and parents by request_id, the others by resource_id."""

    payloads: DataFrame
    documents: DataFrame
    navigation: DataFrame | None = None
    parents: DataFrame | None = None
    request_log: DataFrame | None = None


@dataclass(frozen=True)
class CorpusRun:
    """Result tables of one run."""

    collections: DataFrame
    resources: DataFrame
    fragments: DataFrame
    quarantine: DataFrame
    missing: DataFrame
    meta: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {
            "collection_results": self.collections,
            "resource_results": self.resources,
            "fragments": self.fragments,
            "quarantine": self.quarantine,
            "missing": self.missing,
            "meta": self.meta,
        }

    def register(self, prefix: str = "") -> None:
        """Make the result tables temporary views for SQL."""
        for name, df in self.tables().items():
            df.createOrReplaceTempView(prefix + name)

    def validate(self) -> tuple[DataFrame, DataFrame]:
        """Issues of the output, and the summary of the resources."""
        return val.validate_run(
            self.collections, M.with_fragments(self.resources, self.fragments)
        )


def run(
    landed: Landed,
    collection: CollectionParams = CollectionParams(),
    resource: ResourceParams = ResourceParams(),
) -> CorpusRun:
    """Walk, link parents, project metadata, split documents.

    A resource whose document is ill-formed or missing has no result, as one whose
    description is missing; both stay visible in ``quarantine`` and ``missing``, as do
    resources without an id of their own.  Payloads that landed again count once
    (``sources.payloads.one_each``); documents that share an id are set aside.
    """
    spark = configure(landed.payloads.sparkSession)
    # every payload is parsed once, every document cut once
    objects = landed.payloads.filter(V.is_object(V.parse(F.col("payload"))))
    described = checkpointed(P.objects(P.one_each(objects, "request_id", "payload")))
    edges = materialize(P.member_edges(described), "edges")
    start = collection.collection_id or ""
    asked = described.filter(F.col("request_id") == start).select("object_id").head()
    # a member that names the start again does not visit it, under either of its ids
    again = [asked["object_id"]] if asked and asked["object_id"] != start else []
    walked = W.walk(described, edges, start, [*collection.excluded_ids, *again])

    parents = landed.parents
    if parents is not None:
        parents = P.parents(P.one_each(parents, "request_id", "payload"))
    navigation = landed.navigation
    if navigation is not None:
        navigation = P.one_each(navigation, "resource_id", "payload")
    collections = W.link_parents(walked.collections, parents, collection.fetch_linked_parents)
    resources = W.link_parents(walked.resources, parents, resource.fetch_linked_parents)

    named = M.own_id(F.col("raw")) != ""
    wanted = resources.filter(named).select(
        F.col("object_id").alias("resource_id"),
        nav.resource_depth(F.col("raw")).alias("max_cite_depth"),
    )
    cut = FR.split(
        landed.documents, wanted, navigation, resource.fragments, keep_rows=True
    )
    results = M.resource_results(
        resources, resource.metadata_dublincore, resource.metadata_extensions
    )
    nameless = resources.filter(~named).select(
        F.col("object_id").alias("resource_id"), F.lit("blank id").alias("reason")
    )
    quarantine = cut.quarantine.unionByName(nameless)
    if resource.fragments.fetch_document:
        absent = wanted.join(landed.documents, "resource_id", "left_anti").select(
            "resource_id", F.lit("no document").alias("reason")
        )
        quarantine = materialize(quarantine.unionByName(absent), "quarantine")
        results = results.join(
            quarantine.select(F.col("resource_id").alias("id")), "id", "left_anti"
        )
    meta = spark.range(1).select(F.lit(DTS_VERSION).alias("dtsVersion"), F.lit("All").alias("type"))
    if landed.request_log is not None:
        stats = run_stats(landed.request_log).withColumn("_one", F.lit(1))
        meta = meta.withColumn("_one", F.lit(1)).join(stats, "_one").drop("_one")
    return CorpusRun(
        collections=M.collection_results(
            collections, collection.metadata_dublincore, collection.metadata_extensions
        ),
        resources=results,
        fragments=cut.fragments,
        quarantine=quarantine,
        missing=walked.missing,
        meta=meta,
    )


def save(run_: CorpusRun, path: str, format: str = "parquet") -> None:
    """Write all result tables to a new version below ``path``, then publish it.

    A save that stops half way leaves the run before it in place.  Old versions stay until
    whoever owns ``path`` removes them, so readers of an older one are not disturbed.
    """
    tables = run_.tables()
    version = saved.new_version(path)
    write_results(tables, version, format)
    saved.publish(run_.resources.sparkSession, path, {n: f"{version}/{n}" for n in tables})


def load(spark: SparkSession, path: str) -> CorpusRun | None:
    """The run published last below ``path``, or None."""
    names = ("collection_results", "resource_results", "fragments", "quarantine", "missing", "meta")
    found = saved.published(spark, path)
    if found is None or not all(n in found and saved.exists(spark, found[n]) for n in names):
        return None
    return CorpusRun(*[spark.read.parquet(found[n]) for n in names])


def run_or_load(
    landed: Landed,
    path: str,
    collection: CollectionParams = CollectionParams(),
    resource: ResourceParams = ResourceParams(),
    use_saved: bool = True,
) -> CorpusRun:
    """The saved run when it is there and wanted, else a new one, saved and read back."""
    spark = landed.payloads.sparkSession
    found = load(spark, path) if use_saved else None
    if found is None:
        save(run(landed, collection, resource), path)
        found = load(spark, path)
    return found
