"""Set-based catalog maintenance: matching, upserts, moves, versions, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions import metadata, text
from lorespark.functions.embedding import Provider, embed_chunks
from lorespark.functions.paths import breadcrumbs, parent_dir, path_normalize, source_path, under
from lorespark.operators.joins import first_per, rows_from, salted_join
from lorespark.operators.vectors import vector_channel

# Matches reported per document and the similarity a semantic match needs.
MATCHES = 5
SEMANTIC_MATCH = 0.9
# Fixed value: characters of an incoming text that stand for it in a semantic match.
HEAD_CHARS = 1000
#: Rows up to which a page is the end of a top-n; pages further back are found by ranges.
TOP_ROWS = 10_000


# ------------------------------------------------------------------ listings and pages


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, top_rows: int = TOP_ROWS) -> DataFrame:
    """One page in order, with the total number of rows before paging.

    A page within the first ``top_rows`` is a top-n over all tasks, one further back is taken from
    measured ranges of the order; the rows are the same. ``order`` must be unique. The total is a scalar subquery.
    """
    total, skipped = df.agg(F.count("*").alias("total")).scalar(), max(0, offset)
    if skipped + limit <= top_rows:
        rows = df.orderBy(*order).offset(skipped).limit(limit)
    else:
        rows = rows_from(df, order, skipped, limit)
    return rows.withColumn("total", total)


def list_documents(catalog: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """Newest first."""
    return page(catalog, [F.col("created_at").desc(), F.col("doc_id")], limit, offset)


def newest_page(
    df: DataFrame, time: str, tie: str, limit: int, offset: int = 0, top_rows: int = TOP_ROWS
) -> DataFrame:
    return page(df, [F.col(time).desc(), F.col(tie)], limit, offset, top_rows)


def task_page(tasks: DataFrame, limit: int) -> DataFrame:
    """Newest tasks; the limit is clamped to 1..200."""
    return tasks.orderBy(F.col("created_at").desc(), "task_id").limit(min(max(limit, 1), 200))


def retention_prune(snapshots: DataFrame, keep: int = 7) -> DataFrame:
    """Snapshots to delete: all but the newest ``keep``."""
    kept = snapshots.orderBy(F.col("created_at").desc(), "snapshot_id").limit(max(1, keep))
    return snapshots.join(kept.select("snapshot_id"), "snapshot_id", "left_anti")


def chunk_positions(chunks: DataFrame) -> DataFrame:
    """Chunk ids and totals recomputed from the rows of each document."""
    totals = chunks.groupBy("doc_id").agg(F.count("*").cast("int").alias("total_chunks"))
    return chunks.drop("total_chunks").join(totals, "doc_id").withColumn(
        "chunk_id", F.concat("doc_id", F.lit("#chunk-"), "chunk_index")
    )


def exact_duplicates(catalog: DataFrame) -> DataFrame:
    """Content hashes held by several documents, with the first of them."""
    return (
        catalog.groupBy("content_hash")
        .agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc_id"))
        .filter("copies > 1")
    )


# --------------------------------------------------------------------------- documents


def read_sources(catalog: DataFrame, chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Text of every document: by stored source path, by (id, directory), else its chunks.

    Only documents without a readable source have their chunks put together again.
    """
    pointers = chunks.groupBy("doc_id").agg(
        F.min_by("source_path", "chunk_index").alias("stored_path")
    )
    by_path = sources.select(F.col("source_path").alias("stored_path"), F.col("content").alias("by_path"))
    by_place = sources.select("doc_id", "path", F.col("content").alias("by_place"))
    found = (
        catalog.select("doc_id", "path").join(pointers, "doc_id")
        .join(by_path, "stored_path", "left").join(by_place, ["doc_id", "path"], "left")
        .select("doc_id", F.coalesce(
            F.nullif("by_path", F.lit("")), F.nullif("by_place", F.lit(""))).alias("source"))
    )
    rebuilt = (
        chunks.join(found.filter("source IS NULL").select("doc_id"), "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("parts"))
        .select("doc_id", F.array_join(F.col("parts.content"), "\n\n").alias("joined"))
    )
    return found.join(rebuilt, "doc_id", "left").select(
        "doc_id", F.coalesce("source", "joined").alias("content"),
        F.when(F.col("source").isNull(), "chunks").otherwise("source").alias("origin"),
    )


def get_documents(catalog: DataFrame, chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Document rows with their text and the ordered list of their chunks."""
    listed = chunks.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("chunk_index", "content", "total_chunks"))).alias("chunks")
    )
    texts = read_sources(catalog, chunks, sources).select("doc_id", "content")
    return (
        catalog.join(listed, "doc_id", "left").join(texts, "doc_id", "left")
        .withColumn("content", F.coalesce("content", F.lit("")))
    )


def rebuild_catalog(chunks: DataFrame, existing: DataFrame) -> DataFrame:
    """Document rows from chunk rows; other fields of known documents are kept.

    Documents without chunks disappear. ``chunks`` carries title, path, tags, entities,
    created_at and updated_at of its document.
    """
    carried = ["title", "path", "tags", "entities", "created_at"]
    fresh = chunks.filter("doc_id <> ''").groupBy("doc_id").agg(
        *[F.min_by(c, "chunk_index").alias(c) for c in carried],
        F.count("*").cast("int").alias("chunk_count"), F.max("updated_at").alias("updated_at"),
    )
    extra = existing.drop(*carried, "chunk_count", "updated_at", "write_status")
    return fresh.join(extra, "doc_id", "left")


# ----------------------------------------------------------------- matching and upserts


def _title_key(title: Column) -> Column:
    return F.lower(text.strip(title))


def find_similar(
    incoming: DataFrame, live: DataFrame, semantic: DataFrame | None = None, top_k: int = MATCHES
) -> DataFrame:
    """Best ``top_k`` live matches of every incoming document.

    ``incoming``: in_id, title, path, content_hash. ``semantic``: in_id, doc_id,
    similarity. Equal hash wins over equal title and directory; ties by doc_id. Only the
    first ``top_k`` live documents of a hash or a title can be among the result, so a
    crowded group contributes no more than that to the joins.
    """
    known = live.select("doc_id", "path", "content_hash", _title_key(F.col("title")).alias("title_key"))
    asked = incoming.select("in_id", "path", "content_hash", _title_key(F.col("title")).alias("title_key"))

    def matches(keys: list[str], reason: str, priority: int) -> DataFrame:
        window = Window.partitionBy(*keys).orderBy("doc_id")
        first = known.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= top_k)
        return salted_join(asked, first.select("doc_id", *keys), keys, spread=["in_id"]).select(
            "in_id", "doc_id", F.lit(1.0).alias("similarity"), F.lit(reason).alias("reason"),
            F.lit(priority).alias("priority"),
        )

    found = matches(["content_hash"], "content_hash", 0).union(
        matches(["path", "title_key"], "title_path", 1)
    )
    if semantic is not None:
        found = found.union(semantic.select(
            "in_id", "doc_id", "similarity", F.lit("semantic").alias("reason"), F.lit(2).alias("priority")
        ))
    best = first_per(found, ["in_id", "doc_id"], F.col("priority"))
    window = Window.partitionBy("in_id").orderBy(F.col("similarity").desc(), "doc_id")
    return (
        best.withColumn("rank", F.row_number().over(window))
        .filter(F.col("rank") <= top_k).drop("priority")
    )


def semantic_matches(
    incoming: DataFrame, live: DataFrame, vectors: DataFrame, *providers: Provider,
    top_k: int = MATCHES, head_chars: int = HEAD_CHARS,
) -> DataFrame:
    """in_id, doc_id, similarity for :func:`find_similar`: the live documents nearest in meaning.

    ``incoming``: in_id, path, and ``embedding`` or else ``content``, whose first ``head_chars``
    characters are embedded by the providers; blank texts match nothing. Only documents of the
    incoming document's directory count, all of them where it names none. A document with several
    chunks counts with its best one. ``vectors``: doc_id, chunk_index, embedding.
    """
    asked = incoming
    if "embedding" not in incoming.columns:
        heads = incoming.select("in_id", "path", F.substring("content", 1, head_chars).alias("content"))
        asked = embed_chunks(heads.filter(text.strip(F.col("content")) != ""), *providers)
    queries = asked.select(
        F.col("in_id").alias("query_id"), "embedding", F.lit(top_k).alias("top_k"),
        F.coalesce("path", F.lit("")).alias("filter_path"), text.empty_strings().alias("filter_tags"))
    found = vector_channel(queries, vectors, live)
    return found.groupBy(F.col("query_id").alias("in_id"), "doc_id").agg(F.max("raw_score").alias("similarity"))


def upsert_actions(
    incoming: DataFrame, matches: DataFrame, match_strategy: str = "title_path",
    on_conflict: str = "update",
) -> DataFrame:
    """Add ``target_id`` and ``action`` to the incoming documents."""
    wanted = {
        "title_path": F.col("reason") == "title_path",
        "hash": F.col("reason") == "content_hash",
        "semantic": F.col("similarity") >= SEMANTIC_MATCH,
    }[match_strategy]
    taken = {"update": "updated", "skip": "skipped", "create_new": "created_new"}[on_conflict]
    target = matches.filter(wanted).groupBy("in_id").agg(F.min_by("doc_id", "rank").alias("target_id"))
    return incoming.join(target, "in_id", "left").withColumn(
        "action", F.when(F.col("target_id").isNull(), "created").otherwise(taken)
    )


def apply_upserts(live: DataFrame, decided: DataFrame) -> DataFrame:
    """Catalog after the upserts; of several updates of one document the last one counts.

    ``decided`` carries the catalog columns of the new content beside in_id, target_id
    and action.
    """
    columns = live.columns
    fresh = decided.filter("action IN ('created', 'created_new')").withColumn("doc_id", F.col("in_id"))
    updates = first_per(decided.filter("action = 'updated'"), ["target_id"], F.col("in_id").desc())
    updates = updates.withColumn("doc_id", F.col("target_id"))
    kept = live.join(updates.select("doc_id"), "doc_id", "left_anti")
    return kept.select(*columns).unionByName(fresh.select(*columns)).unionByName(updates.select(*columns))


def classify_updates(changes: DataFrame, current: DataFrame) -> DataFrame:
    """Decide per change: skip, path_only or rewrite.

    ``changes``: doc_id, title, path, path_explicit, tags, content_hash (tags already
    merged with the header tags). A blank path keeps the old one unless it is explicit;
    a durable override replaces the incoming tags before the comparison.
    """
    old = current.select(
        "doc_id", F.col("title").alias("old_title"), F.col("path").alias("old_path"),
        F.col("tags").alias("old_tags"), F.col("content_hash").alias("old_hash"),
        "metadata_overridden", "tags_override",
    )
    keeps_path = (F.col("path") == "") & ~F.col("path_explicit")
    same_meta = (F.col("title") == F.col("old_title")) & (
        F.sort_array("new_tags") == F.sort_array("old_tags")
    )
    same_text = F.col("content_hash").eqNullSafe(F.col("old_hash"))
    same_path = F.col("new_path") == F.col("old_path")
    return (
        changes.join(old, "doc_id")
        .withColumn("new_path", F.when(keeps_path, F.col("old_path")).otherwise(path_normalize(F.col("path"))))
        .withColumn("new_tags", F.when(F.col("metadata_overridden"), F.col("tags_override")).otherwise(F.col("tags")))
        .withColumn(
            "action",
            F.when(~(same_meta & same_text), "rewrite").when(same_path, "skip").otherwise("path_only"),
        )
    )


def effective_metadata(docs: DataFrame) -> DataFrame:
    """Tags and entities that count after (re)reading a document's header.

    ``docs``: tags, old_header_tags (null for legacy rows), header_tags, header_entities,
    metadata_overridden, tags_override, entities_override. Manual tags are the old tags
    minus those the old header had declared.
    """
    manual = metadata.minus_by_key(F.col("tags"), F.coalesce("old_header_tags", text.empty_strings()))
    merged = docs.withColumn("_manual", manual).withColumn(
        "_merged", metadata.merge_values(F.col("_manual"), F.col("header_tags"))
    )
    overridden = F.coalesce("metadata_overridden", F.lit(False))
    return (
        merged.withColumn("new_tags", F.when(overridden, F.col("tags_override")).otherwise(F.col("_merged")))
        .withColumn(
            "new_entities",
            F.when(overridden, F.col("entities_override")).otherwise(F.col("header_entities")),
        )
        .drop("_manual", "_merged")
    )


def override_metadata(table: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply durable tag and entity edits to a catalog or chunk table.

    ``edits``: doc_id, new_tags, new_entities, edited_at.
    """
    normal = edits.select(
        "doc_id", metadata.normalize_values(F.col("new_tags")).alias("new_tags"),
        metadata.normalize_values(F.col("new_entities")).alias("new_entities"), "edited_at",
    )
    edited = F.col("edited_at").isNotNull()
    joined = table.join(normal, "doc_id", "left")
    values = {
        "tags": "new_tags", "entities": "new_entities",
        "tags_override": "new_tags", "entities_override": "new_entities", "updated_at": "edited_at",
    }
    for name, source in values.items():
        joined = joined.withColumn(name, F.when(edited, F.col(source)).otherwise(F.col(name)))
    return joined.withColumn(
        "metadata_overridden", edited | F.coalesce("metadata_overridden", F.lit(False))
    ).select(*table.columns)


def move_documents(table: DataFrame, moves: DataFrame) -> DataFrame:
    """New directory and source path for moved documents; texts and vectors stay.

    ``moves``: doc_id, new_path, moved_at.
    """
    moved = F.col("new_path").isNotNull()
    joined = table.join(moves.select("doc_id", "new_path", "moved_at"), "doc_id", "left")
    changed = {
        "source_path": source_path(F.col("doc_id"), F.col("new_path")),
        "updated_at": F.col("moved_at"),
        "path": F.col("new_path"),
    }
    for name, value in changed.items():
        if name in table.columns:
            joined = joined.withColumn(name, F.when(moved, value).otherwise(F.col(name)))
    return joined.select(*table.columns)


def _relocated(old: str, new: str) -> Column:
    return F.when(F.col("path") == old, F.lit(new)).otherwise(
        F.concat(F.lit(new), F.substring("path", len(old) + 1, 2**31 - 1))
    )


def rename_directory(table: DataFrame, old: str, new: str, known_dirs: DataFrame | None = None) -> DataFrame:
    """Move a directory with everything below it.

    ``table`` has a ``path`` (the catalog or the table of explicit directories);
    ``known_dirs`` is checked for a directory already at the target.
    """
    old, new = _normal(old), _normal(new)
    if not old:
        raise ValueError("the root cannot be renamed")
    if old == new:
        return table
    if new.startswith(old + "/"):
        raise ValueError("a directory cannot move below itself")
    if known_dirs is not None:
        outside = ~under(F.col("path"), F.lit(old))
        if known_dirs.filter(outside & (F.col("path") == new)).limit(1).count():
            raise ValueError(f"directory {new} exists")
    inside = under(F.col("path"), F.lit(old))
    return table.withColumn("path", F.when(inside, _relocated(old, new)).otherwise(F.col("path")))


def delete_directory(catalog: DataFrame, path: str) -> DataFrame:
    """Documents of a deleted subtree move to the root."""
    path = _normal(path)
    if not path:
        raise ValueError("the root cannot be deleted")
    inside = under(F.col("path"), F.lit(path))
    return catalog.withColumn("path", F.when(inside, F.lit("")).otherwise(F.col("path")))


def _normal(path: str) -> str:
    return "/".join(p for p in path.strip("/").replace("\\", "/").split("/") if p and p != "..")


def delete_documents(gone: DataFrame, **tables: DataFrame) -> dict[str, DataFrame]:
    """Every table without the documents of ``gone``."""
    ids = gone.select("doc_id").distinct()
    return {name: table.join(ids, "doc_id", "left_anti") for name, table in tables.items()}


# ---------------------------------------------------------------------------- versions


def snapshot(documents: DataFrame, reason: str, created_by: str, now: Column) -> DataFrame:
    """Version rows of documents as they are now."""
    return documents.select(
        F.concat(
            F.lit("v-"), F.date_format(now, "yyyyMMdd-HHmmss"), F.lit("-"),
            F.substring(F.replace(F.uuid(), F.lit("-")), 1, 8),
        ).alias("version_id"),
        "doc_id", "title", "content", "path", "tags", now.alias("created_at"),
        F.lit(created_by).alias("created_by"), F.lit(reason).alias("reason"),
    )


def list_versions(versions: DataFrame) -> DataFrame:
    """Versions without their text; order by newest first where they are shown."""
    return versions.drop("content")


def lookup_versions(wanted: DataFrame, versions: DataFrame) -> DataFrame:
    """(doc_id, version_id) requests with the version, and whether it was found."""
    known = versions.withColumn("found", F.lit(True))
    return wanted.join(known, ["doc_id", "version_id"], "left").withColumn(
        "found", F.coalesce("found", F.lit(False))
    )


def restore_versions(wanted: DataFrame, versions: DataFrame, current: DataFrame) -> DataFrame:
    """Updates that bring back the wanted versions, classified like any update.

    As everywhere, a version without a directory keeps the current one.
    """
    changes = lookup_versions(wanted, versions).filter("found").select(
        "doc_id", "version_id", "title", "path", F.lit(False).alias("path_explicit"), "tags",
        "content", text.content_hash(F.col("content")).alias("content_hash"),
    )
    return classify_updates(changes, current)


# ------------------------------------------------------------------------- directories


def directory_tree(catalog: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """Every directory of the tree: path, name, parent, depth, direct doc_count.

    ``explicit`` holds created, possibly empty directories (column ``path``).
    """
    direct = catalog.groupBy("path").agg(F.count("*").alias("n"))
    if explicit is not None:
        direct = direct.union(explicit.select("path", F.lit(0).cast("long")))
    return (
        direct.select("path", "n", F.explode(breadcrumbs(F.col("path"))).alias("dir"))
        .groupBy(F.col("dir.path").alias("path"), F.col("dir.name").alias("name"))
        .agg(F.sum(F.when(F.array_join(F.filter(F.split("path", "/"), lambda s: s != ""), "/")
                          == F.col("dir.path"), F.col("n")).otherwise(0)).alias("doc_count"))
        .withColumn("parent", parent_dir(F.col("path")))
        .withColumn("depth", F.size(F.split("path", "/")))
    )


def child_dirs(tree: DataFrame, path: str) -> DataFrame:
    return tree.filter(F.col("parent") == _normal(path)).select("name")


def available_tags(catalog: DataFrame) -> DataFrame:
    return (
        catalog.select(F.explode("tags").alias("tag")).withColumn("tag", text.strip(F.col("tag")))
        .filter("tag <> ''").distinct()
    )


# ---------------------------------------------------------------------- postings upkeep


def maintain_postings(postings: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Replace all postings of the changed documents by the fresh ones (none: deleted)."""
    kept = postings.join(changed.select("doc_id").distinct(), "doc_id", "left_anti")
    return kept.unionByName(fresh.select(*kept.columns))


def latest_operations(operations: DataFrame) -> DataFrame:
    """The last operation per document of a batch (doc_id, seq, op)."""
    return operations.groupBy("doc_id").agg(F.max_by("op", "seq").alias("op"), F.max("seq").alias("seq"))


def reconcile_grants(live: DataFrame, filed: DataFrame) -> DataFrame:
    """Live grants plus those that are only on file."""
    missing = filed.join(live.select("key_hash"), "key_hash", "left_anti")
    return live.unionByName(missing)
