"""Audit log, graph index, versions and corpus tables at rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.sources import committed

AUDIT_SCHEMA = (
    "id string, timestamp timestamp, actor_type string, actor string, action string, "
    "target_type string, target_id string, path string, success boolean, "
    "detail map<string,string>, ip string, user_agent string"
)
# What an audit event holds when a field is not given.
AUDIT_DEFAULTS = {
    "actor_type": "system", "actor": "system", "target_type": "", "target_id": "", "path": "",
    "ip": "", "user_agent": "",
}


def read_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Audit events from JSON lines; blank and malformed lines are skipped."""
    return spark.read.schema(AUDIT_SCHEMA).option("mode", "DROPMALFORMED").json(folder)


def audit_events(events: DataFrame) -> DataFrame:
    """Events completed with an id, a time and the defaults; works on streams too."""
    def given(name: str, default):
        return F.coalesce(F.col(name), default) if name in events.columns else default

    defaults = {name: F.lit(value) for name, value in AUDIT_DEFAULTS.items()}
    new_id = F.concat(F.lit("audit-"), F.replace(F.uuid(), F.lit("-")))
    return events.select(
        given("id", new_id).alias("id"),
        given("timestamp", F.current_timestamp()).alias("timestamp"),
        *[given(n, defaults[n]).alias(n) for n in ("actor_type", "actor")],
        "action",
        *[given(n, defaults[n]).alias(n) for n in ("target_type", "target_id", "path")],
        given("success", F.lit(True)).alias("success"),
        given("detail", F.create_map().cast("map<string,string>")).alias("detail"),
        *[given(n, defaults[n]).alias(n) for n in ("ip", "user_agent")],
    )


def append_audit(events: DataFrame, folder: str) -> None:
    """Append events as JSON lines, one folder per day."""
    audit_events(events).withColumn("day", F.to_date("timestamp")).write.mode("append").partitionBy(
        "day"
    ).json(folder)


def read_graph_edges(spark: SparkSession, file: str) -> DataFrame:
    """Edges of a graph JSON document (``edges`` or ``links``), for ``adjacency``.

    Endpoints may be ids or objects with an id; they are read as text and looked into.
    """
    raw = "array<struct<source:string,target:string,relation:string,label:string,weight:string>>"
    doc = spark.read.option("multiLine", "true").schema(f"edges {raw}, links {raw}").json(file)

    def node(name: str):
        return F.coalesce(F.get_json_object(name, "$.id"), F.col(name))

    return doc.select(F.explode(F.coalesce("edges", "links")).alias("e")).select("e.*").select(
        node("source").alias("source"), node("target").alias("target"),
        F.coalesce(F.nullif("relation", F.lit("")), F.nullif("label", F.lit(""))).alias("relation"),
        F.col("weight").try_cast("double").alias("weight"),
    )


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str, version: int = 1) -> None:
    """Graph index: nodes, and edges by relation, stamped with version and time."""
    stamp = {"version": F.lit(version), "generated_at": F.current_timestamp()}
    nodes.withColumns(stamp).write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.withColumns(stamp).write.mode("overwrite").partitionBy("relation").parquet(f"{folder}/edges")


def append_versions(versions: DataFrame, folder: str) -> int:
    """Add versions to the store; all of them are visible at once, or none."""
    return committed.append(versions, folder)


def read_versions(spark: SparkSession, folder: str, at: int | None = None) -> DataFrame:
    """The versions of the store, as of its newest commit or commit ``at``."""
    return committed.read(spark, folder, at)


def compact_versions(spark: SparkSession, folder: str) -> int:
    """Rewrite the parts of the store as one, ordered for lookups by document."""
    return committed.rewrite(spark, folder, lambda rows: rows.repartitionByRange("doc_id", "version_id").sortWithinPartitions(
        "doc_id", "version_id"))


def write_postings(postings: DataFrame, table: str, buckets: int) -> None:
    """Postings bucketed by term (and shard, where they have one), so that lookups do not shuffle them."""
    keys = [c for c in ("term", "shard") if c in postings.columns]
    postings.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def write_chunks(chunks: DataFrame, table: str, buckets: int) -> None:
    """Chunks bucketed by document, so that joins on chunk keys do not shuffle them."""
    chunks.write.mode("overwrite").bucketBy(buckets, "doc_id").sortBy("doc_id", "chunk_index").saveAsTable(table)
