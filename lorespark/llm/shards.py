"""Sharding by longest processing time: the largest group first, to the least loaded shard.

Groups of equal texts stay together. A group of at least the ``1 / (shards * grain)`` part of
all bytes is scheduled by itself; there are at most ``shards * grain`` of those, whatever the
corpus. Smaller groups are first put into ``shards * grain`` bundles by their digest, and a
bundle is scheduled as one group, so the heap on the driver sees at most twice that many units
and the loads differ by about one bundle where no group is larger than a shard.

Defined results: a null text counts as empty and has no bytes of its own; rows with a null or a
repeated id are rows like any other; an empty table gives no rows. Ties go to the lower digest
and the lower shard.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.operators.joins import materialize

ROW_BYTES = 8
GRAIN = 512
#: Rows numbered by one task.
BLOCK_ROWS = 20_000


def schedule(units: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """Shard of every (size, name)."""
    loads = [(0, shard) for shard in range(shards)]
    out = {}
    for size, name in sorted(units, key=lambda u: (-u[0], u[1])):
        load, shard = heapq.heappop(loads)
        out[name] = shard
        heapq.heappush(loads, (load + size, shard))
    return out


def assign_shards(
    docs: DataFrame, shards: int = 24, id_column: str = "doc_id", text_column: str = "text",
    grain: int = GRAIN,
) -> DataFrame:
    """Shard and gapless slot of every row: doc_id, size, text_crc32, shard, slot.

    Texts are read once and never shuffled, only their digests are.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = materialize(docs.select(
        F.col(id_column).alias("doc_id"), (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("digest"),
    ))
    groups = materialize(rows.groupBy("digest").agg(F.sum("size").alias("bytes")))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    parts = shards * grain
    # Eight hexadecimal digits of the digest deal the small groups evenly.
    bundle = F.concat(F.lit("bundle-"), F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") % parts)
    unit = F.when(F.col("bytes") * parts >= total, F.col("digest")).otherwise(bundle)
    placed = groups.withColumn("unit", unit)
    units = placed.groupBy("unit").agg(F.sum("bytes").alias("bytes")).collect()
    shard_of = schedule([(u["bytes"], u["unit"]) for u in units], shards)
    shard_table = spark.createDataFrame(sorted(shard_of.items()), "unit string, shard int")
    # Bounded by 2 * shards * grain rows.
    by_digest = placed.join(F.broadcast(shard_table), "unit").select("digest", "shard")
    sharded = rows.join(by_digest, "digest").drop("digest")
    return number_slots(sharded, shards)


def number_slots(sharded: DataFrame, shards: int) -> DataFrame:
    """Slots 0, 1, ... in every shard, in blocks dealt by a hash of the row."""
    sharded = materialize(sharded)
    blocks = max(1, -(-sharded.count() // (shards * BLOCK_ROWS)))
    blocked = sharded.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocked.groupBy("shard", "block").agg(F.count("*").alias("rows")).select(
        "shard", "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32"))
    return blocked.withColumn("inside", inside).join(starts, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("inside") - 1).alias("slot"))
