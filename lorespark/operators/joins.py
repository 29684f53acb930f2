"""Join and ranking building blocks that hold up under hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.session import shared_folder

SALTS = 16
# Fixed value: the largest number of results one search request may ask for.
MAX_TOP_K = 50
GRAM = 3


def salted_join(
    big: DataFrame, small: DataFrame, on: list[str], spread: list[str], how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join where one value of ``on`` may hold a large share of ``big``.

    Rows of ``big`` with the same key are spread over ``salts`` tasks by a hash of the
    ``spread`` columns; every row of ``small`` is repeated once per salt.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    right = small.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    )
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the shared checkpoint folder and read it back.

    Used where one result feeds several branches: it is computed once, survives the loss
    of executors, and gives the optimizer a measured size to choose joins by. The folder is
    removed when the driver ends.
    """
    spark = df.sparkSession
    target = f"{shared_folder(spark, 'table')}/rows"
    # A third smaller than by the default codec, and as fast to write and read.
    df.write.option("compression", "zstd").parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first by ``order``."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")


def in_ranges(df: DataFrame, *order: Column | str) -> DataFrame:
    """The rows, written in ranges of the order; ``_range`` numbers the ranges.

    Ranges are measured on the rows themselves, so they hold about equal numbers of rows however
    the values are distributed; rows equal in the whole order stay together.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(tasks, *order).withColumn("_range", F.spark_partition_id()))


def spread_row_number(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Row number per key by a column, without sorting a crowded key in one task.

    Rows are numbered within measured ranges of (key, order); the rows of a key before each range
    are counted from a pre-aggregation of one row a key and range. ``order`` must be unique per key.
    """
    ranged = in_ranges(df, *keys, order)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_c")).select(
        *keys, "_range", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before")
    )
    own = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(order))
    return ranged.withColumn("_own", own).join(starts, [*keys, "_range"]).withColumn(
        name, F.col("_own") + F.col("_before")
    ).drop("_range", "_own", "_before")


def rows_from(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """``limit`` rows after the first ``offset`` ones in order, without gathering those before.

    Rows are written in measured ranges; counts of the ranges tell which of them hold the wanted
    places, and only those are sorted, each in a task of its own. ``order`` must be unique.
    """
    ranged = in_ranges(df, *order)
    # One row a range.
    running = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_c")).select(
        "_range", "_c", F.coalesce(F.sum("_c").over(running), F.lit(0)).alias("_before"))
    touched = counts.filter((F.col("_before") < offset + limit) & (F.col("_before") + F.col("_c") > offset))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    placed = ranged.join(F.broadcast(touched), "_range").withColumn("_place", F.col("_before") + own)
    return placed.filter(F.col("_place").between(offset + 1, offset + limit)).orderBy("_place").select(*df.columns)


def top_per_query(df: DataFrame, score: str, rank: str = "rank") -> DataFrame:
    """Best ``top_k`` rows of every query; ties by doc_id, then chunk_index.

    A ``top_k`` above MAX_TOP_K is an error, as rows would be missing from the answer.

    The literal bound lets Spark cut every task's rows before the shuffle, so a query
    that matches a large share of the corpus ships at most MAX_TOP_K rows per task.
    """
    order = [F.col(score).desc(), F.col("doc_id")]
    if "chunk_index" in df.columns:
        order.append(F.col("chunk_index"))
    window = Window.partitionBy("query_id").orderBy(*order)
    refused = F.raise_error(F.lit(f"top_k is above {MAX_TOP_K}")).cast("int")
    limit = F.when(F.col("top_k") > MAX_TOP_K, refused).otherwise(F.col("top_k"))
    ranked = df.withColumn("top_k", limit).withColumn(rank, F.row_number().over(window))
    return ranked.filter((F.col(rank) <= MAX_TOP_K) & (F.col(rank) <= F.col("top_k")))


def _grams(text: Column, length: int) -> Column:
    """All grams of ``length`` characters; the pattern looks ahead, so they overlap."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=({'.' * length}))"), F.lit(1))


def _all_grams(text: Column) -> Column:
    return F.array_distinct(F.concat(*[_grams(text, n) for n in range(1, GRAM + 1)]))


def _longest_grams(text: Column) -> Column:
    """Grams of one length: GRAM, or the whole text when it is shorter."""
    return F.array_distinct(F.when(F.length(text) < GRAM, F.array(text)).otherwise(_grams(text, GRAM)))


def _distinct_texts(texts: DataFrame, name: str) -> DataFrame:
    """Distinct texts that are not empty, over all tasks: few bytes of text make many grams."""
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return texts.filter(F.col(name) != "").repartition(tasks, name).distinct()


def gram_table(haystacks: DataFrame) -> DataFrame:
    """hay, gram of every distinct text of ``haystacks`` (hay): all grams up to GRAM characters.

    Kept at rest, it answers :func:`containment_join` without cutting the texts again. For short
    texts such as tokens: every gram comes with the whole text.
    """
    return _distinct_texts(haystacks, "hay").select("hay", F.explode(_all_grams(F.col("hay"))).alias("gram"))


def containment_join(
    needles: DataFrame, haystacks: DataFrame | None = None, grams: DataFrame | None = None
) -> DataFrame:
    """All pairs (needle, hay) where the text ``needle`` occurs inside ``hay``.

    Every needle is looked up by its rarest character gram, so the work follows the
    number of texts that can match instead of needles x haystacks. Inputs are one-column
    tables ``needle`` and ``hay``, or the ready ``grams`` of the hays; equal texts are
    compared once. Long hays are known by a number until a needle's gram is found in them.
    """
    needle_grams = materialize(
        _distinct_texts(needles, "needle").select("needle", F.explode(_longest_grams(F.col("needle"))).alias("gram"))
    )
    # Grams that no needle has are dropped before anything is counted or shuffled.
    wanted = needle_grams.select("gram").distinct()
    if grams is None:
        hays = materialize(_distinct_texts(haystacks, "hay").withColumn("hay_id", F.monotonically_increasing_id()))
        cut = hays.select("hay_id", F.explode(_all_grams(F.col("hay"))).alias("gram"))
        hay_grams = materialize(cut.join(wanted, "gram", "left_semi"))
    else:
        hay_grams = grams.select("hay", "gram").join(wanted, "gram", "left_semi")
    frequency = hay_grams.groupBy("gram").agg(F.count("*").alias("df"))
    # Written, so that its measured size decides whether it can travel to the tasks.
    keyed = materialize(
        needle_grams.join(frequency, "gram", "left")
        .groupBy("needle")
        .agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("best"))
        # A needle with a gram that no hay has is in none.
        .filter("best.df > 0")
        .select("needle", F.col("best.gram").alias("gram"))
    )
    if grams is None:
        found = salted_join(hay_grams, keyed, ["gram"], spread=["hay_id"]).join(hays, "hay_id")
    else:
        found = salted_join(grams.select("hay", "gram"), keyed, ["gram"], spread=["hay"])
    # A needle that is its own gram occurs in all hays with that gram.
    return found.filter((F.col("needle") == F.col("gram")) | F.contains("hay", "needle")).select("needle", "hay")
