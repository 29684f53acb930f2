"""Structured Streaming jobs over documents, requests and audit events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from lorespark.functions.text import content_hash
from lorespark.operators.catalog import latest_operations
from lorespark.operators.stats import RATE_LIMIT, WINDOW_SECONDS
from lorespark.plans.ingest import ingest_documents
from lorespark.sources.tables import audit_events

# A table that a stream maintains is a folder per micro-batch. A batch that is run again
# after a failure overwrites its own folder, and readers take the newest batch per key, so
# nothing that was written before has to be rewritten and no row counts twice.
STORED = ("catalog", "chunks", "postings", "sources")


def read_stream(spark: SparkSession, folder: str, schema: StructType | str, file: str = "*") -> DataFrame:
    """Parquet files of a folder as a stream; ``file`` may also name folders of part files in it."""
    if file == "*":
        return spark.readStream.schema(schema).parquet(folder)
    # As a pattern, since a stream takes a plain path to be a folder.
    pattern = file if set(file) & set("*?[{") else f"{file[:-1]}[{file[-1]}]"
    return spark.readStream.schema(schema).parquet(f"{folder}/{pattern}")


def _write_batch(df: DataFrame, folder: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def latest_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink for updated aggregates; read them with :func:`read_latest`."""
    return lambda rows, batch: _write_batch(rows, folder, batch)


def read_latest(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """The newest row per key."""
    rows = spark.read.parquet(folder)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in values])


# ---------------------------------------------------------------------------- documents


def ingest_batch(
    operations: DataFrame, folder: str, batch: int, embed: bool = True
) -> None:
    """Apply one micro-batch of document operations.

    ``operations``: doc_id, seq, op (upsert or delete), title, content, path, tags. The
    last operation of a document counts. A deleted or replaced document loses all its
    older rows because readers only take rows of its newest batch.
    """
    last = latest_operations(operations)
    rows = operations.join(last, ["doc_id", "seq", "op"])
    now = F.lit(operations.sparkSession.range(1).select(F.current_timestamp()).first()[0])
    done = ingest_documents(
        rows.filter("op = 'upsert'").select("doc_id", "title", "content", "path", "tags"), now, embed=embed
    )
    for name in STORED:
        _write_batch(getattr(done, name), f"{folder}/{name}", batch)
    _write_batch(done.log, f"{folder}/log", batch)
    # Rejected documents change nothing; their older version stays.
    changed = done.catalog.select("doc_id", F.lit("upsert").alias("op")).unionByName(
        last.filter("op = 'delete'").select("doc_id", "op")
    )
    _write_batch(changed, f"{folder}/operations", batch)


def stream_ingest(stream: DataFrame, folder: str, checkpoint: str, embed: bool = True) -> DataStreamWriter:
    """Documents arriving as operations; start the returned writer with any trigger."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda rows, batch: ingest_batch(rows, folder, batch, embed)
    )


def read_current(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Rows of a maintained table that belong to the newest version of their document."""
    newest = spark.read.parquet(f"{folder}/operations").groupBy("doc_id").agg(
        F.max_by("op", "batch").alias("op"), F.max("batch").alias("batch")
    )
    live = newest.filter("op = 'upsert'").select("doc_id", "batch")
    return spark.read.parquet(f"{folder}/{name}").join(live, ["doc_id", "batch"], "left_semi").drop("batch")


def compact(spark: SparkSession, folder: str, target: str) -> None:
    """Current rows of all tables as one batch in a new folder."""
    for name in STORED:
        _write_batch(read_current(spark, folder, name), f"{target}/{name}", 0)
    live = read_current(spark, folder, "catalog").select("doc_id", F.lit("upsert").alias("op"))
    _write_batch(live, f"{target}/operations", 0)


def new_content(stream: DataFrame, live: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """Stream rows whose content neither the live catalog nor the recent stream holds."""
    hashed = stream.withColumn("content_hash", content_hash(F.col("content")))
    return (
        hashed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["content_hash"])
        .join(live.select("content_hash").distinct(), "content_hash", "left_anti")
    )


# ----------------------------------------------------------------------------- requests


def request_counts(stream: DataFrame, unit: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Tumbling counts; rows later than the watermark are dropped."""
    return (
        stream.withWatermark("ts", delay).groupBy(F.window("ts", unit).alias("w"))
        .agg(F.count("*").alias("requests"))
        .select(F.col("w.start").alias("bucket"), "requests")
    )


def count_batch(
    rows: DataFrame, folder: str, batch: int, unit_seconds: int = 3600, delay_seconds: int = 3600
) -> None:
    """Count one micro-batch by time bucket; rows that come too late are set aside, not lost.

    A row is late where its bucket ends at or before the newest time of all earlier batches less
    the delay; a row without a time is late too. Counts carry whether they are late, and late rows
    are kept whole. A batch that is run again overwrites its own folders.
    """
    spark = rows.sparkSession
    counts = f"{folder}/counts"
    newest = None
    if batch > 0 and _exists(spark, counts):
        newest = spark.read.schema(f"{_COUNTED}, batch int").parquet(counts).filter(
            F.col("batch") < batch).agg(F.max("newest")).first()[0]
    width = F.lit(unit_seconds)
    bucket = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / width) * width)
    late = F.col("ts").isNull()
    if newest is not None:
        closed = F.lit(newest) - F.make_dt_interval(secs=F.lit(delay_seconds + unit_seconds))
        late = late | (bucket <= closed)
    marked = rows.withColumn("bucket", bucket).withColumn("late", late)
    _write_batch(marked.groupBy("bucket", "late").agg(
        F.count("*").alias("requests"), F.max("ts").alias("newest")), counts, batch)
    if not spark.read.schema(_COUNTED).parquet(f"{counts}/batch={batch}").filter("late").isEmpty():
        _write_batch(marked.filter("late").drop("late"), f"{folder}/late", batch)


_COUNTED = "bucket timestamp, late boolean, requests long, newest timestamp"


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def counted_requests(
    stream: DataFrame, folder: str, checkpoint: str, unit_seconds: int = 3600, delay_seconds: int = 3600
) -> DataStreamWriter:
    """Requests (with a time ``ts``) counted per bucket, late ones aside: see :func:`count_batch`."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda rows, batch: count_batch(rows, folder, batch, unit_seconds, delay_seconds))


def read_counts(spark: SparkSession, folder: str) -> DataFrame:
    """bucket, requests, late_requests of all batches; the two sum to the rows that arrived."""
    rows = spark.read.schema(f"{_COUNTED}, batch int").parquet(f"{folder}/counts")
    return rows.groupBy("bucket").agg(
        F.sum(F.when(F.col("late"), 0).otherwise(F.col("requests"))).alias("requests"),
        F.sum(F.when(F.col("late"), F.col("requests")).otherwise(0)).alias("late_requests"))


def usage_counts(stream: DataFrame) -> DataFrame:
    """Running use count and last use per key (update or complete mode)."""
    return stream.groupBy("key").agg(F.count("*").alias("use_count"), F.max("ts").alias("last_used_at"))


class _RateWindow(StatefulProcessor):
    """Open window of a key: its start and the number of requests in it."""

    def __init__(self, width_ms: int, limit: int):
        self.width_ms, self.limit = width_ms, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = [StructField("opened", LongType()), StructField("count", LongType())]
        self.window = handle.getValueState("window", StructType(fields))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Requests count in time order within a batch; memory is bounded by the batch.
        frame = pd.concat(list(rows)).sort_values("ts", ignore_index=True)
        times = frame["ts"].astype("datetime64[us]").astype("int64").to_numpy()
        opened, count = self.window.get() if self.window.exists() else (None, 0)
        counts = []
        for time in times:
            if opened is None or time >= opened + self.width_ms * 1000:
                opened, count = int(time), 0
            count += 1
            counts.append(count)
        self.window.update((opened, count))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(opened // 1000 + self.width_ms + 1)
        yield pd.DataFrame({
            "key": [key[0]] * len(frame), "ts": frame["ts"], "position": counts,
            "allowed": [c <= self.limit for c in counts],
        })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.window.clear()
        return iter(())

    def close(self) -> None:
        pass


def rate_decisions(
    stream: DataFrame, width_seconds: int = WINDOW_SECONDS, limit: int = RATE_LIMIT, delay: str = "1 minute"
) -> DataFrame:
    """Position of every request in its key's window and whether it is allowed.

    Needs the RocksDB state store. State is dropped once the watermark passes the end of
    the window.
    """
    key_type = stream.schema["key"].dataType.simpleString()
    return stream.select("key", "ts").withWatermark("ts", delay).groupBy("key").transformWithStateInPandas(
        statefulProcessor=_RateWindow(width_seconds * 1000, limit),
        outputStructType=f"key {key_type}, ts timestamp, position long, allowed boolean",
        outputMode="Append", timeMode="EventTime",
    )


# -------------------------------------------------------------------------------- audit


def audit_sink(events: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """Audit events appended as JSON lines, one folder per day."""
    stamped = audit_events(events).withColumn("day", F.to_date("timestamp"))
    return stamped.writeStream.format("json").partitionBy("day").option("path", folder).option(
        "checkpointLocation", checkpoint
    )
