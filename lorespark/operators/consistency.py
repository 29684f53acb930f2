"""Drift between catalog, chunks and stored sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Issue codes and their severities.
ERRORS = ["missing_chunks", "missing_source"]
WARNINGS = ["chunk_count_mismatch", "orphan_document", "missing_doc_id", "invalid_metadata"]


def _chunk_stats(chunks: DataFrame) -> DataFrame:
    """Per document: chunk count and the first non-empty source path."""
    stored = F.nullif("source_path", F.lit(""))
    return chunks.filter("metadata_ok AND doc_id <> ''").groupBy("doc_id").agg(
        F.count("*").alias("actual"),
        F.min(F.when(stored.isNotNull(), F.struct("chunk_index", stored.alias("p")))).alias("first"),
    ).select("doc_id", "actual", F.col("first.p").alias("stored_path"))


def probe_sources(catalog: DataFrame, chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """(doc_id, readable): the stored path decides; without one, id and directory do."""
    by_path = sources.select(F.col("source_path").alias("stored_path"), F.lit(True).alias("at_path")).distinct()
    by_place = sources.select("doc_id", "path", F.lit(True).alias("at_place")).distinct()
    return (
        catalog.select("doc_id", "path")
        .join(_chunk_stats(chunks).select("doc_id", "stored_path"), "doc_id", "left")
        .join(by_path, "stored_path", "left").join(by_place, ["doc_id", "path"], "left")
        .select(
            "doc_id",
            F.when(F.col("stored_path").isNotNull(), F.coalesce("at_path", F.lit(False)))
            .otherwise(F.coalesce("at_place", F.lit(False))).alias("readable"),
        )
    )


def orphan_documents(chunks: DataFrame, catalog: DataFrame) -> DataFrame:
    """Documents that have chunks but no catalog row."""
    usable = chunks.filter("metadata_ok AND doc_id <> ''")
    return usable.select("doc_id").distinct().join(catalog.select("doc_id"), "doc_id", "left_anti")


def consistency_issues(catalog: DataFrame, chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per issue: code, severity, doc_id, details.

    ``chunks``: doc_id ('' when missing), chunk_index, source_path, metadata_ok.
    """
    docs = catalog.filter("doc_id <> ''")
    sized = docs.join(_chunk_stats(chunks), "doc_id", "left")
    detail = F.concat_ws("|", "title", "path")
    none = F.lit("")

    def issue(rows: DataFrame, code: str, doc_id: Column, details: Column) -> DataFrame:
        severity = "error" if code in ERRORS else "warning"
        return rows.select(
            F.lit(code).alias("code"), F.lit(severity).alias("severity"),
            doc_id.alias("doc_id"), details.alias("details"),
        )

    by_doc = F.col("doc_id")
    mismatch = F.col("chunk_count") != F.col("actual")
    counts = F.concat_ws("|", F.col("chunk_count").cast("string"), F.col("actual").cast("string"))
    index = F.col("chunk_index").cast("string")
    unreadable = docs.join(probe_sources(docs, chunks, sources).filter("NOT readable"), "doc_id")
    parts = [
        issue(sized.filter("actual IS NULL"), "missing_chunks", by_doc, detail),
        issue(sized.filter(mismatch), "chunk_count_mismatch", by_doc, counts),
        issue(unreadable, "missing_source", by_doc, detail),
        issue(orphan_documents(chunks, docs), "orphan_document", by_doc, none),
        issue(chunks.filter("NOT metadata_ok"), "invalid_metadata", none, index),
        issue(chunks.filter("metadata_ok AND doc_id = ''"), "missing_doc_id", none, index),
    ]
    return reduce(DataFrame.unionByName, parts)


def consistency_summary(issues: DataFrame, catalog: DataFrame, chunks: DataFrame) -> DataFrame:
    """Counts by severity and store; success means no error."""
    indexed = catalog.filter("doc_id <> ''").agg(F.count_distinct("doc_id").alias("n")).scalar()
    chunked = chunks.filter("metadata_ok AND doc_id <> ''").agg(
        F.count_distinct("doc_id").alias("n")
    ).scalar()
    return issues.agg(
        F.count("*").alias("issue_count"),
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    ).select(
        (F.col("errors") == 0).alias("success"), "issue_count", "errors", "warnings",
        indexed.alias("indexed_documents"), chunked.alias("chunked_documents"),
    )
