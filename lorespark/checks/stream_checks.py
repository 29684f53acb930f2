"""Checked queries of the streaming jobs: each runs the stream over the given tables
until it has read everything, and returns what it left behind."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark.checks import fixtures as fx
from lorespark.checks.catalog_checks import stamped
from lorespark.checks.registry import check
from lorespark.checks.source_checks import _scratch
from lorespark.streaming import jobs


def _stream(spark, sf, name):
    return jobs.read_stream(spark, sf, fx.table(spark, sf, name).schema, f"{name}.parquet")


def _finish(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def _requests(spark, sf):
    return _stream(spark, sf, "events").select(
        F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))


@check("stream_ingest", fx.select(f"""
    , parts AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, source, lang, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body FROM documents),
    kept AS (SELECT p.* FROM parts p LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = p.doc_id WHERE coalesce(l.toxic, 0) = 0)
    SELECT doc_id, source AS title, lang AS path, sha256(body) AS content_hash FROM kept WHERE body <> ''""", "catalog"))
def stream_ingest(spark, sf):
    """All documents arrive, then the labels stream in and delete the toxic ones."""
    folder, seen = _scratch(spark), _scratch(spark)
    docs = _stream(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("seq"), F.lit("upsert").alias("op"),
        F.col("source").alias("title"), F.regexp_replace("text", r"^\s+|\s+$", "").alias("content"), F.col("lang").alias("path"),
        F.array("lang").alias("tags"))
    _finish(jobs.stream_ingest(docs, folder, f"{seen}/docs", embed=False))
    gone = _stream(spark, sf, "labels").filter("toxic = 1").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.lit(2).alias("seq"), F.lit("delete").alias("op"),
        F.lit("").alias("title"), F.lit("").alias("content"), F.lit("").alias("path"), F.array().cast("array<string>").alias("tags"))
    removal = gone.writeStream.option("checkpointLocation", f"{seen}/gone").foreachBatch(
        lambda rows, batch: jobs.ingest_batch(rows, folder, 1000 + batch, embed=False))
    _finish(removal)
    return jobs.read_current(spark, folder, "catalog").select("doc_id", "title", "path", "content_hash")


@check("stream_search_hourly", fx.select(
    f"SELECT {fx.stamp('date_trunc(' + repr('hour') + ', ts)')} AS bucket, count(*) AS requests FROM requests GROUP BY 1", "requests"))
def stream_search_hourly(spark, sf):
    folder = _scratch(spark)
    counts = jobs.request_counts(_requests(spark, sf)).writeStream.outputMode("update")
    _finish(counts.option("checkpointLocation", f"{folder}/seen").foreachBatch(jobs.latest_sink(f"{folder}/counts")))
    return stamped(jobs.read_latest(spark, f"{folder}/counts", ["bucket"]), "bucket")


@check("stream_search_late", fx.select("""
    , marked AS (SELECT date_trunc('hour', ts) AS bucket, date_trunc('hour', ts) + INTERVAL 2 HOUR
        <= (SELECT max(ts) FROM requests WHERE key % 3 = 0) AS late, key % 3 = 0 AS first_batch FROM requests)
    SELECT strftime(bucket, '%Y-%m-%d %H:%M:%S') AS bucket, count(*) FILTER (first_batch OR NOT late) AS requests,
      count(*) FILTER (late AND NOT first_batch) AS late_requests FROM marked GROUP BY bucket""", "requests"))
def stream_search_late(spark, sf):
    """A third of the users' requests arrive first; what the others asked before that is late."""
    folder = _scratch(spark)
    third = F.col("key") % 3 == 0
    for name, own in (("first", third), ("rest", ~third)):
        arriving = _requests(spark, sf).filter(own)
        shift = 0 if name == "first" else 1
        _finish(arriving.writeStream.option("checkpointLocation", f"{folder}/seen-{name}").foreachBatch(
            lambda rows, batch, shift=shift: jobs.count_batch(rows, f"{folder}/all", batch + shift)))
    return stamped(jobs.read_counts(spark, f"{folder}/all"), "bucket")


@check("stream_key_usage", fx.select(
    f"SELECT key, count(*) AS use_count, {fx.stamp('max(ts)')} AS last_used_at FROM requests GROUP BY key", "requests"))
def stream_key_usage(spark, sf):
    folder = _scratch(spark)
    usage = jobs.usage_counts(_requests(spark, sf)).writeStream.outputMode("update")
    _finish(usage.option("checkpointLocation", f"{folder}/seen").foreachBatch(jobs.latest_sink(f"{folder}/usage")))
    return stamped(jobs.read_latest(spark, f"{folder}/usage", ["key"]), "last_used_at")


@check("stream_new_content", fx.select("""
    SELECT content_hash, count(*) AS arrivals FROM (SELECT DISTINCT sha256(text) AS content_hash FROM documents
      WHERE sha256(text) NOT IN (SELECT content_hash FROM catalog WHERE list_contains(tags, 'quality')))
    GROUP BY content_hash""", "catalog"))
def stream_new_content(spark, sf):
    """All documents arrive; those equal to a live one or to an earlier arrival are skipped."""
    folder = _scratch(spark)
    arriving = _stream(spark, sf, "documents").select(
        F.col("doc_id"), F.col("text").alias("content"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
    live = fx.catalog(spark, sf).filter(F.array_contains("tags", "quality"))
    fresh = jobs.new_content(arriving, live, "ts").select("doc_id", "content_hash")
    _finish(fresh.writeStream.format("parquet").option("path", f"{folder}/fresh").option("checkpointLocation", f"{folder}/seen"))
    return spark.read.parquet(f"{folder}/fresh").groupBy("content_hash").agg(F.count("*").alias("arrivals"))


@check("stream_audit", "SELECT event_type AS action, count(*) AS events FROM events GROUP BY event_type")
def stream_audit(spark, sf):
    folder = _scratch(spark)
    bare = _stream(spark, sf, "events").select(
        F.col("event_type").alias("action"), F.col("ts").cast("timestamp").alias("timestamp"),
        F.col("user_id").cast("string").alias("actor"))
    _finish(jobs.audit_sink(bare, f"{folder}/audit", f"{folder}/seen"))
    return spark.read.json(f"{folder}/audit").groupBy("action").agg(F.count("*").alias("events"))


def _rate_sql(seconds: int, limit: int) -> str:
    return fx.select(f"""
        , opened AS (SELECT key, min(ts) AS at FROM requests GROUP BY key
          UNION SELECT o.key, (SELECT min(a.ts) FROM requests a WHERE a.key = o.key AND a.ts >= o.at + INTERVAL {seconds} SECOND)
          FROM opened o WHERE o.at IS NOT NULL),
        placed AS (SELECT o.key, row_number() OVER (PARTITION BY o.key, o.at ORDER BY a.ts) <= {limit} AS allowed
          FROM opened o JOIN requests a ON a.key = o.key AND a.ts >= o.at AND a.ts < o.at + INTERVAL {seconds} SECOND)
        SELECT key, allowed, count(*) AS requests FROM placed GROUP BY key, allowed""", "requests", recursive=True)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@check("stream_rate_window", _rate_sql(3600, 2))
def stream_rate_window(spark, sf):
    folder, setting = _scratch(spark), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, ROCKSDB)
    try:
        decided = jobs.rate_decisions(_requests(spark, sf), width_seconds=3600, limit=2)
        _finish(decided.writeStream.format("parquet").outputMode("append").option(
            "path", f"{folder}/decided").option("checkpointLocation", f"{folder}/seen"))
    finally:
        spark.conf.set(setting, before)
    return spark.read.parquet(f"{folder}/decided").groupBy("key", "allowed").agg(F.count("*").alias("requests"))
