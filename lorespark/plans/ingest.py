"""Documents to catalog, chunks, postings and sources, with a log of every step."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions import metadata, text
from lorespark.functions.chunking import CHUNK_OVERLAP, CHUNK_SIZE, chunk_rows, with_chunks
from lorespark.functions.embedding import Provider, embed_chunks
from lorespark.functions.paths import path_normalize, source_path
from lorespark.operators.catalog import effective_metadata
from lorespark.operators.filters import reject_reason
from lorespark.operators.joins import materialize
from lorespark.operators.retrieval import build_postings

# The steps of an ingestion in order, and the step each rejection stops at.
NODES = [
    "parse_markdown", "normalize_content", "chunk", "embedding",
    "persist_source", "persist_vector", "commit_index",
]
STOPS_AT = {"blank_title": "parse_markdown", "blank_content": "parse_markdown", "no_chunks": "chunk"}


@dataclass(frozen=True)
class Ingested:
    catalog: DataFrame
    chunks: DataFrame
    postings: DataFrame
    sources: DataFrame
    log: DataFrame


def prepare(
    incoming: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """Incoming documents with normalised text, metadata, chunks and a rejection reason.

    ``incoming``: doc_id, title, content, path, tags.
    """
    normal = incoming.withColumn(
        "content", text.unify_newlines(F.coalesce("content", F.lit("")))
    ).withColumn("path", path_normalize(F.col("path")))
    headed = metadata.with_header(normal).withColumn(
        "tags", metadata.merge_values(F.col("tags"), F.col("header_tags"))
    )
    return with_chunks(headed, "content", size, overlap).withColumn("reason", reject_reason())


def ingest_log(prepared: DataFrame) -> DataFrame:
    """One row per document and step; nothing after the step that failed."""
    stops = F.create_map(*[F.lit(x) for pair in STOPS_AT.items() for x in pair])
    nodes = F.array(*map(F.lit, NODES))
    failed_at = F.try_element_at(stops, F.col("reason"))
    last = F.coalesce(F.array_position(nodes, failed_at), F.lit(len(NODES))).cast("int")
    return prepared.withColumn("_failed_at", failed_at).select(
        "doc_id", "title", F.explode(F.slice(nodes, F.lit(1), last)).alias("node"), "_failed_at",
        "reason", F.length("content").alias("content_chars"), F.size("chunk_texts").alias("n_chunks"),
    ).select(
        "doc_id", "title", "node",
        F.when(F.col("node") == F.col("_failed_at"), "failed").otherwise("succeeded").alias("status"),
        F.when(F.col("node") == F.col("_failed_at"), F.col("reason")).otherwise("").alias("error"),
        "content_chars", "n_chunks",
    )


def ingest_documents(
    incoming: DataFrame, now: Column, *providers: Provider, embed: bool = True,
    size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
) -> Ingested:
    """Run the whole chain. The prepared documents feed all outputs and are written once."""
    prepared = materialize(prepare(incoming, size, overlap))
    good = prepared.filter("reason IS NULL")
    catalog = good.select(
        "doc_id", "title", "path", "tags", "header_tags",
        F.col("header_entities").alias("entities"), "header_entities",
        F.lit(False).alias("metadata_overridden"),
        text.empty_strings().alias("tags_override"), text.empty_strings().alias("entities_override"),
        F.size("chunk_texts").alias("chunk_count"),
        F.sha2("content", 256).alias("content_hash"),
        now.alias("created_at"), now.alias("updated_at"),
    )
    place = source_path(F.col("doc_id"), F.col("path"))
    chunks = chunk_rows(good.select("doc_id", place.alias("source_path"), "chunk_texts"))
    return Ingested(
        catalog=catalog,
        chunks=embed_chunks(chunks, *providers) if embed else chunks,
        postings=build_postings(catalog, chunks),
        sources=good.select("doc_id", "path", place.alias("source_path"), "content"),
        log=ingest_log(prepared),
    )


def reindex(
    documents: DataFrame, *providers: Provider, embed: bool = False,
    size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
) -> Ingested:
    """Metadata and chunks of known documents rebuilt from their texts.

    ``documents``: doc_id, title, path, content, tags, old_header_tags,
    metadata_overridden, tags_override, entities_override.
    """
    headed = metadata.with_header(
        documents.withColumn("content", text.unify_newlines(F.coalesce("content", F.lit(""))))
    )
    prepared = materialize(
        with_chunks(effective_metadata(headed), "content", size, overlap)
        .withColumn("reason", reject_reason())
    )
    good = prepared.filter("reason IS NULL")
    catalog = good.select(
        "doc_id", "title", "path", F.col("new_tags").alias("tags"), "header_tags",
        F.col("new_entities").alias("entities"), "header_entities", "metadata_overridden",
        "tags_override", "entities_override", F.size("chunk_texts").alias("chunk_count"),
        F.sha2("content", 256).alias("content_hash"),
    )
    place = source_path(F.col("doc_id"), F.col("path"))
    chunks = chunk_rows(good.select("doc_id", place.alias("source_path"), "chunk_texts"))
    return Ingested(
        catalog=catalog,
        chunks=embed_chunks(chunks, *providers) if embed else chunks,
        postings=build_postings(catalog, chunks),
        sources=good.select("doc_id", "path", place.alias("source_path"), "content"),
        log=ingest_log(prepared),
    )
