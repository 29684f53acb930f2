"""Boilerplate lines, by the share of a site's pages that contain them.

Native: split, hashes, counts and the filter are DataFrame functions. Per host, the number of
distinct pages containing a line is divided by the number of distinct pages; lines above
``ratio`` go from every page of that host. Pages with equal texts count once, since a copied page
is the business of near-dedup and says nothing about a site's frame.

Defined results: a null host is a host of its own; a null text stays null, an empty one empty;
white-space-only lines are never boilerplate, they shape the page; a host with fewer than
``least_pages`` distinct pages keeps all its lines; a page that consists of boilerplate becomes
empty but stays. Row count, other columns and the order of lines never change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import fresh
from lorespark.operators.joins import materialize

RATIO = 0.1
LEAST_PAGES = 10


def _key(line: Column) -> Column:
    """128 bits of a line; whether two lines are equal is decided by it."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit(1)).alias("b"))


def boilerplate(
    docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO,
    least_pages: int = LEAST_PAGES,
) -> DataFrame:
    """host, lines: keys of the lines to drop, at most lines per page / ``ratio`` for a host.

    Counts are pre-aggregated by each task before the shuffle, so a line or a host that holds
    a large share of all rows sends a row per task.
    """
    page = docs.select(F.col(host).alias("host"), F.col(text).cast("string").alias("text")).filter(
        "text IS NOT NULL").select("host", "text", F.sha2("text", 256).alias("page"))
    lines = F.array_distinct(F.transform(
        F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), _key))
    # One row of every distinct page of a host, texts left behind: only hashes are shuffled.
    pages = page.select("host", "page", lines.alias("lines")).dropDuplicates(["host", "page"])
    counted = materialize(pages.select("host", "lines"))
    totals = counted.groupBy("host").agg(F.count("*").alias("pages"))
    containing = counted.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(
        F.count("*").alias("containing"))
    often = containing.filter(F.col("containing") > ratio * least_pages).alias("c").join(
        totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")))
    return often.filter(
        (F.col("pages") >= least_pages) & (F.col("containing") > F.lit(ratio) * F.col("pages"))
    ).groupBy(F.col("c.host").alias("host")).agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(
    docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO,
    least_pages: int = LEAST_PAGES, counts: bool = False,
) -> DataFrame:
    """``docs`` without boilerplate lines in ``text``; with ``counts`` also n_lines, n_dropped.

    The lines to drop are written first, so Spark knows their size: it sends them to every
    task when small, and else joins by host and splits a skewed one.
    """
    key, drop, n_lines, n_dropped = fresh(docs, "host", "lines", "n_lines", "n_dropped")
    found = materialize(boilerplate(docs, host, text, ratio, least_pages)).select(
        F.col("host").alias(key), F.col("lines").alias(drop))
    joined = docs.join(found, docs[host].eqNullSafe(found[key]), "left")
    parts = F.split(F.col(text), "\n")
    kept = F.filter(parts, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(drop), _key(x)))
    kept = F.when(F.col(drop).isNull(), parts).otherwise(kept)
    cleaned = F.when(F.col(drop).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    columns = [cleaned.alias(c) if c == text else docs[c] for c in docs.columns]
    if counts:
        size = F.coalesce(F.size(parts), F.lit(0))
        columns += [size.alias(n_lines), (size - F.coalesce(F.size(kept), F.lit(0))).alias(n_dropped)]
    return joined.select(*columns)
