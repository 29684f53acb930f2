"""Usage, audit and dashboard aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rate window and limit, days that hourly and daily counts are kept, and
# the zone in which trend labels are shown.
WINDOW_SECONDS, RATE_LIMIT = 60, 30
HOURLY_DAYS, DAILY_DAYS = 8, 90
LABEL_ZONE = "+08:00"


def requests_per(requests: DataFrame, unit: str) -> DataFrame:
    """Request counts per hour or day."""
    return requests.groupBy(F.date_trunc(unit, "ts").alias("bucket")).agg(F.count("*").alias("requests"))


def kept_buckets(counts: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Buckets that have not expired ``days`` after they were opened."""
    return counts.filter(F.col("bucket") > as_of - F.make_dt_interval(F.lit(days)))


def search_trend(requests: DataFrame, as_of: Column) -> DataFrame:
    """The last 24 hours up to ``as_of``, oldest first, hours without requests as zero."""
    hour = F.date_trunc("hour", as_of)
    first = hour - F.make_dt_interval(F.lit(0), F.lit(23))
    spine = requests.sparkSession.range(1).select(
        F.posexplode(F.sequence(first, hour, F.make_dt_interval(F.lit(0), F.lit(1)))).alias("pos", "bucket")
    )
    recent = requests.filter((F.col("ts") >= first) & (F.col("ts") < hour + F.make_dt_interval(F.lit(0), F.lit(1))))
    counts = requests_per(recent, "hour")
    local = F.from_utc_timestamp("bucket", LABEL_ZONE)
    return spine.join(counts, "bucket", "left").select(
        "pos", F.concat(F.date_format(local, "HH"), F.lit(":00")).alias("label"),
        F.coalesce("requests", F.lit(0)).alias("requests"),
    )


def key_usage(requests: DataFrame) -> DataFrame:
    return requests.groupBy("key").agg(F.count("*").alias("use_count"), F.max("ts").alias("last_used_at"))


def dashboard(
    catalog: DataFrame, grants: DataFrame, requests: DataFrame, as_of: Column,
    nodes: DataFrame | None = None, edges: DataFrame | None = None,
) -> DataFrame:
    """One row: documents, active, expiring and total grants, requests of the day and in all.

    ``grants``: status (effective), expires_at. With the relation graph's ``nodes`` and ``edges``
    their numbers follow; without, they are null.
    """
    def size(rows: DataFrame | None) -> Column:
        return F.lit(None).cast("long") if rows is None else rows.agg(F.count("*").alias("n")).scalar()

    docs = catalog.agg(F.count("*").alias("n")).scalar()
    today = requests.filter(F.date_trunc("day", "ts") == F.date_trunc("day", as_of)).agg(
        F.count("*").alias("n")
    ).scalar()
    active = F.col("status") == "active"
    soon = active & F.col("expires_at").between(as_of, as_of + F.make_dt_interval(F.lit(1)))
    return grants.agg(
        F.count_if(active).alias("active_keys"), F.count_if(soon).alias("expiring_keys"),
        F.count("*").alias("total_keys"),
    ).select(docs.alias("documents"), "active_keys", "expiring_keys", "total_keys",
             today.alias("requests_today"), size(requests).alias("requests_total"),
             size(nodes).alias("graph_nodes"), size(edges).alias("graph_edges"))


def reindex_summary(log: DataFrame) -> DataFrame:
    """Tallies of one run from its log (doc_id, node, status, duration_ms)."""
    per_doc = log.groupBy("doc_id").agg(F.max(F.col("status") == "failed").alias("failed"))
    return per_doc.agg(
        F.count("*").alias("processed"), F.count_if(~F.col("failed")).alias("succeeded"),
        F.count_if("failed").alias("failed"),
    ).withColumn("status", F.when(F.col("failed") == 0, "completed").otherwise("failed"))


def node_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("node", "status").agg(F.count("*").alias("documents"))


def ingest_failures(log: DataFrame) -> DataFrame:
    return log.filter("status = 'failed'").select("doc_id", "title", "node", "error")
