"""Checked queries of catalog maintenance, directories, versions and consistency."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark.checks import fixtures as fx
from lorespark.checks.registry import check
from lorespark.checks.retrieval_checks import corpus
from lorespark.checks.scalar_checks import md_docs
from lorespark.functions import metadata, text
from lorespark.operators import catalog as cg
from lorespark.operators import consistency, retrieval
from lorespark.session import shared_folder
from lorespark.sources.tables import append_versions, compact_versions, read_versions

TIME = "yyyy-MM-dd HH:mm:ss"


def stamped(df, *names):
    for name in names:
        df = df.withColumn(name, F.date_format(name, TIME))
    return df


# --------------------------------------------------------------- documents and listings


@check("doc_count", fx.select("""
    SELECT (SELECT count(*) FROM catalog) AS documents,
      (SELECT count(DISTINCT doc_id) FROM chunks) AS chunked_documents""", "catalog", "chunks"))
def doc_count(spark, sf):
    chunked = fx.chunks(spark, sf).agg(F.count_distinct("doc_id").alias("n")).scalar()
    return fx.catalog(spark, sf).agg(F.count("*").alias("documents")).select(
        "documents", chunked.alias("chunked_documents"))


@check("exact_duplicates", fx.select("""
    SELECT content_hash, count(*) AS copies, min(doc_id) AS first_doc_id FROM catalog
    GROUP BY content_hash HAVING count(*) > 1""", "catalog"))
def exact_duplicates(spark, sf):
    return cg.exact_duplicates(fx.catalog(spark, sf))


@check("available_tags", fx.select("SELECT DISTINCT unnest(tags) AS tag FROM catalog", "catalog"))
def available_tags(spark, sf):
    return cg.available_tags(fx.catalog(spark, sf))


@check("chunk_position", fx.select("""
    SELECT doc_id || '#chunk-' || chunk_index AS chunk_id, CAST(chunk_index AS BIGINT) AS chunk_index,
      count(*) OVER (PARTITION BY doc_id) AS total_chunks FROM chunks""", "chunks"))
def chunk_position(spark, sf):
    return cg.chunk_positions(fx.chunks(spark, sf)).select(
        "chunk_id", F.col("chunk_index").cast("long").alias("chunk_index"),
        F.col("total_chunks").cast("long").alias("total_chunks"))


@check("list_documents", fx.select(f"""
    SELECT doc_id, title, path, {fx.stamp('created_at')} AS created_at, count(*) OVER () AS total FROM catalog
    WHERE list_has_any(tags, ['quality', 'src3']) ORDER BY catalog.created_at DESC, doc_id LIMIT 20 OFFSET 40""", "catalog"))
def list_documents(spark, sf):
    from lorespark.operators.filters import with_any_tag

    wanted = with_any_tag(fx.catalog(spark, sf), ["quality", "src3"])
    return stamped(cg.list_documents(wanted, limit=20, offset=40), "created_at").select(
        "doc_id", "title", "path", "created_at", "total")


@check("task_page", f"""
    SELECT 'task-' || event_id AS task_id, {fx.stamp('ts')} AS created_at FROM events
    ORDER BY ts DESC, 'task-' || event_id LIMIT 200""")
def task_page(spark, sf):
    tasks = fx.table(spark, sf, "events").select(
        F.concat(F.lit("task-"), "event_id").alias("task_id"), F.col("ts").alias("created_at"))
    return stamped(cg.task_page(tasks, 5000), "created_at")


@check("retention_prune", """
    SELECT snapshot_id FROM (SELECT 'snap-' || event_id AS snapshot_id,
      row_number() OVER (ORDER BY ts DESC, 'snap-' || event_id) AS rn FROM events) WHERE rn > 7""")
def retention_prune(spark, sf):
    snaps = fx.table(spark, sf, "events").select(
        F.concat(F.lit("snap-"), "event_id").alias("snapshot_id"), F.col("ts").alias("created_at"))
    return cg.retention_prune(snaps).select("snapshot_id")


# Stores with holes: some documents lose their chunks, sources or pointers.
fx.define("holed_chunks", ["chunks"], """
    SELECT k.doc_id, k.chunk_index, k.content, k.total_chunks,
      CASE WHEN d.lang = 'es' THEN 'old/' || k.source_path WHEN d.lang = 'de' THEN '' ELSE k.source_path END AS source_path
    FROM chunks k JOIN documents d ON CAST(d.doc_id AS VARCHAR) = k.doc_id
    LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE coalesce(l.toxic, 0) = 0""")
fx.define("holed_sources", ["sources"], """
    SELECT s.doc_id, s.path, s.source_path, CASE WHEN d.n_chars % 5 = 0 THEN '' ELSE s.content END AS content
    FROM sources s JOIN documents d ON CAST(d.doc_id AS VARCHAR) = s.doc_id
    LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE coalesce(l.quality, 1) = 1""")


def _doc_facts(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(fx.table(spark, sf, "labels"), "doc_id", "left").withColumn(
        "doc_id", F.col("doc_id").cast("string"))


def holed_chunks(spark, sf):
    pointer = (F.when(F.col("lang") == "es", F.concat(F.lit("old/"), "source_path"))
               .when(F.col("lang") == "de", "").otherwise(F.col("source_path")))
    return fx.chunks(spark, sf).join(_doc_facts(spark, sf), "doc_id").filter(
        F.coalesce("toxic", F.lit(0)) == 0
    ).withColumn("source_path", pointer).select("doc_id", "chunk_index", "content", "total_chunks", "source_path")


def holed_sources(spark, sf):
    return fx.sources(spark, sf).join(_doc_facts(spark, sf), "doc_id").filter(
        F.coalesce("quality", F.lit(1)) == 1
    ).withColumn("content", F.when(F.col("n_chars") % 5 == 0, "").otherwise(F.col("content"))).select(
        "doc_id", "path", "source_path", "content")


fx.define("read_back", ["catalog", "holed_chunks", "holed_sources"], r"""
    SELECT c.doc_id, coalesce(nullif(a.content, ''), nullif(b.content, ''), k.joined) AS content,
      CASE WHEN coalesce(nullif(a.content, ''), nullif(b.content, '')) IS NULL THEN 'chunks' ELSE 'source' END AS origin
    FROM catalog c JOIN (SELECT doc_id, arg_min(source_path, chunk_index) AS stored_path,
        string_agg(content, chr(10) || chr(10) ORDER BY chunk_index) AS joined FROM holed_chunks GROUP BY doc_id) k
      ON k.doc_id = c.doc_id
    LEFT JOIN holed_sources a ON a.source_path = k.stored_path
    LEFT JOIN holed_sources b ON b.doc_id = c.doc_id AND b.path = c.path""")


@check("read_source_with_fallback", fx.select("SELECT * FROM read_back", "read_back"))
def read_source_with_fallback(spark, sf):
    return cg.read_sources(fx.catalog(spark, sf), holed_chunks(spark, sf), holed_sources(spark, sf))


@check("get_document", fx.select("""
    SELECT c.doc_id, c.title, c.path, coalesce(r.content, '') AS content, coalesce(k.listed, '') AS chunks
    FROM catalog c LEFT JOIN read_back r ON r.doc_id = c.doc_id LEFT JOIN (
      SELECT doc_id, string_agg(chunk_index || ':' || content, '|' ORDER BY chunk_index) AS listed
      FROM holed_chunks GROUP BY doc_id) k ON k.doc_id = c.doc_id""", "catalog", "read_back", "holed_chunks"))
def get_document(spark, sf):
    docs = cg.get_documents(fx.catalog(spark, sf), holed_chunks(spark, sf), holed_sources(spark, sf))
    listed = F.array_join(F.transform("chunks", lambda c: F.concat(
        c["chunk_index"].cast("string"), F.lit(":"), c["content"])), "|")
    return docs.select("doc_id", "title", "path", "content", F.coalesce(listed, F.lit("")).alias("chunks"))


@check("catalog_rebuild", fx.select(f"""
    SELECT k.doc_id, c.title, c.path, k.n AS chunk_count, {fx.stamp('k.updated_at')} AS updated_at,
      CASE WHEN list_contains(c.tags, 'quality') THEN c.content_hash ELSE '' END AS content_hash
    FROM (SELECT k.doc_id, count(*) AS n, max(c.updated_at + k.chunk_index * INTERVAL 1 SECOND) AS updated_at
      FROM holed_chunks k JOIN catalog c ON c.doc_id = k.doc_id GROUP BY k.doc_id) k
    JOIN catalog c ON c.doc_id = k.doc_id""", "holed_chunks", "catalog"))
def catalog_rebuild(spark, sf):
    cat = fx.catalog(spark, sf)
    carried = cat.select("doc_id", "title", "path", "tags", "entities", "created_at", "updated_at")
    later = F.col("updated_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("chunk_index"))
    rows = holed_chunks(spark, sf).join(carried, "doc_id").withColumn("updated_at", later)
    known = cat.filter(F.array_contains("tags", "quality")).withColumn("write_status", F.lit("updating"))
    rebuilt = cg.rebuild_catalog(rows, known)
    return stamped(rebuilt, "updated_at").select(
        "doc_id", "title", "path", F.col("chunk_count").cast("long").alias("chunk_count"), "updated_at",
        F.coalesce("content_hash", F.lit("")).alias("content_hash"))


# ------------------------------------------------------------------------------ upserts

fx.define("live", ["catalog"], """
    SELECT c.* FROM catalog c WHERE c.doc_id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)""")
fx.define("incoming", ["catalog"], """
    SELECT CASE WHEN l.doc_id IS NULL THEN 'n' ELSE 'e' END || c.doc_id AS in_id, c.doc_id AS origin_id, c.title, c.path, c.tags, c.entities,
      CASE WHEN l.quality = 0 THEN sha256(d.text || chr(10) || 'revised') ELSE c.content_hash END AS content_hash,
      CASE WHEN l.quality = 0 THEN d.text || chr(10) || 'revised' ELSE d.text END AS content
    FROM catalog c JOIN documents d ON CAST(d.doc_id AS VARCHAR) = c.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id""")
fx.define("matches", ["live", "incoming"], """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY in_id ORDER BY doc_id) AS rank FROM (
      SELECT i.in_id, v.doc_id, CASE WHEN v.content_hash = i.content_hash THEN 'content_hash' ELSE 'title_path' END AS reason
      FROM incoming i JOIN live v ON v.content_hash = i.content_hash
        OR (v.path = i.path AND lower(trim(v.title)) = lower(trim(i.title))))) WHERE rank <= 5""")


def live(spark, sf):
    labelled = fx.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("doc_id"))
    return fx.catalog(spark, sf).join(labelled, "doc_id", "left_semi")


def incoming(spark, sf):
    """Unlabelled documents as new ones, and every live document again, some edited."""
    labels = fx.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("doc_id"), "quality")
    texts = fx.sources(spark, sf).select("doc_id", "content")
    both = fx.catalog(spark, sf).join(texts, "doc_id").join(labels, "doc_id", "left")
    content = F.when(F.col("quality") == 0, F.concat("content", F.lit("\nrevised"))).otherwise(F.col("content"))
    return both.withColumn("content", content).select(
        F.concat(F.when(F.col("quality").isNull(), "n").otherwise("e"), "doc_id").alias("in_id"),
        F.col("doc_id").alias("origin_id"), "title", "path", "tags", "entities", "content",
        text.content_hash(F.col("content")).alias("content_hash"))


@check("find_similar", fx.select(
    "SELECT in_id, doc_id, 1.0::DOUBLE AS similarity, reason, CAST(rank AS BIGINT) AS rank FROM matches", "matches"))
def find_similar(spark, sf):
    found = cg.find_similar(incoming(spark, sf), live(spark, sf))
    return found.withColumn("rank", F.col("rank").cast("long"))


def _actions_sql(reason: str, action: str) -> str:
    return f"""
        SELECT i.in_id, coalesce(m.target_id, '') AS target_id,
          CASE WHEN m.target_id IS NULL THEN 'created' ELSE '{action}' END AS action
        FROM incoming i LEFT JOIN (SELECT in_id, arg_min(doc_id, rank) AS target_id FROM matches
          WHERE reason = '{reason}' GROUP BY in_id) m ON m.in_id = i.in_id"""


def _actions(spark, sf, **options):
    new = incoming(spark, sf)
    decided = cg.upsert_actions(new, cg.find_similar(new, live(spark, sf)), **options)
    return decided.select("in_id", F.coalesce("target_id", F.lit("")).alias("target_id"), "action")


@check("upsert_by_title", fx.select(_actions_sql("title_path", "updated"), "incoming", "matches"))
def upsert_by_title(spark, sf):
    return _actions(spark, sf)


@check("upsert_create_new", fx.select(_actions_sql("title_path", "created_new"), "incoming", "matches"))
def upsert_create_new(spark, sf):
    """Documents whose title is known in their directory become new ones beside them."""
    return _actions(spark, sf, on_conflict="create_new")


# Incoming documents bring the embedding of their origin; live ones hold their own.
fx.define("all_matches", ["live", "incoming"], """
    SELECT in_id, doc_id, similarity, reason, row_number() OVER (PARTITION BY in_id ORDER BY similarity DESC, doc_id) AS rank FROM (
      SELECT in_id, doc_id, arg_min(similarity, priority) AS similarity, arg_min(reason, priority) AS reason FROM (
        SELECT i.in_id, v.doc_id, 1.0::DOUBLE AS similarity, 'content_hash' AS reason, 0 AS priority
          FROM incoming i JOIN live v ON v.content_hash = i.content_hash
        UNION ALL SELECT i.in_id, v.doc_id, 1.0, 'title_path', 1
          FROM incoming i JOIN live v ON v.path = i.path AND lower(trim(v.title)) = lower(trim(i.title))
        UNION ALL SELECT in_id, doc_id, similarity, 'semantic', 2 FROM (
          SELECT *, row_number() OVER (PARTITION BY in_id ORDER BY similarity DESC, doc_id) AS near FROM (
            SELECT i.in_id, v.doc_id, round(list_cosine_similarity(a.embedding, b.embedding), 9) AS similarity
            FROM incoming i JOIN live v ON v.path = i.path JOIN embedded a ON a.doc_id = i.origin_id JOIN embedded b ON b.doc_id = v.doc_id))
          WHERE near <= 5)
      GROUP BY in_id, doc_id) QUALIFY rank <= 5""".replace(
    "embedded", "(SELECT CAST(vec_id AS VARCHAR) AS doc_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)"))


def _all_matches(spark, sf):
    vectors = fx.vectors(spark, sf)
    new, old = incoming(spark, sf), live(spark, sf)
    own = vectors.select(F.col("doc_id").alias("origin_id"), "embedding")
    near = cg.semantic_matches(new.join(own, "origin_id"), old, vectors)
    return new, cg.find_similar(new, old, near)


@check("find_similar_semantic", fx.select("""
    SELECT in_id, doc_id, round(similarity, 6) AS similarity, reason, CAST(rank AS BIGINT) AS rank FROM all_matches""", "all_matches"))
def find_similar_semantic(spark, sf):
    return _all_matches(spark, sf)[1].withColumns(
        {"similarity": F.round("similarity", 6), "rank": F.col("rank").cast("long")})


@check("upsert_semantic", fx.select("""
    SELECT i.in_id, coalesce(m.target_id, '') AS target_id, CASE WHEN m.target_id IS NULL THEN 'created' ELSE 'updated' END AS action
    FROM incoming i LEFT JOIN (SELECT in_id, arg_min(doc_id, rank) AS target_id FROM all_matches
      WHERE similarity >= 0.9 GROUP BY in_id) m ON m.in_id = i.in_id""", "incoming", "all_matches"))
def upsert_semantic(spark, sf):
    new, matches = _all_matches(spark, sf)
    decided = cg.upsert_actions(new, matches, match_strategy="semantic")
    return decided.select("in_id", F.coalesce("target_id", F.lit("")).alias("target_id"), "action")


@check("stream_dedup_hash", fx.select(_actions_sql("content_hash", "skipped"), "incoming", "matches"))
def upsert_skip_by_hash(spark, sf):
    """Batch twin of the stream that skips known content."""
    return _actions(spark, sf, match_strategy="hash", on_conflict="skip")


@check("upsert_documents", fx.select(f"""
    , decided AS ({_actions_sql('title_path', 'updated')}),
    latest AS (SELECT target_id, max(in_id) AS in_id FROM decided WHERE action = 'updated' GROUP BY target_id)
    SELECT doc_id, title, path, content_hash FROM live WHERE doc_id NOT IN (SELECT target_id FROM latest)
    UNION ALL SELECT i.in_id, i.title, i.path, i.content_hash FROM incoming i JOIN decided d ON d.in_id = i.in_id WHERE d.action = 'created'
    UNION ALL SELECT t.target_id, i.title, i.path, i.content_hash FROM incoming i JOIN latest t ON t.in_id = i.in_id""",
    "live", "incoming", "matches"))
def upsert_documents(spark, sf):
    new, old = incoming(spark, sf), live(spark, sf)
    decided = cg.upsert_actions(new, cg.find_similar(new, old))
    columns = ["doc_id", "title", "path", "content_hash"]
    return cg.apply_upserts(old.select(*columns), decided)


def _with_override(catalog):
    """German documents carry a durable override of their tags."""
    german = F.array_contains("tags", "de")
    return catalog.withColumns({
        "metadata_overridden": german,
        "tags_override": F.when(german, F.array(F.lit("pinned"))).otherwise(text.empty_strings()),
        "entities_override": text.empty_strings(),
    }).withColumn("tags", F.when(german, F.array(F.lit("pinned"))).otherwise(F.col("tags")))


@check("classify_update", fx.select("""
    SELECT doc_id, new_path, array_to_string(new_tags, ',') AS new_tags, CASE
      WHEN NOT (title = old_title AND list_sort(new_tags) = list_sort(old_tags) AND content_hash = old_hash) THEN 'rewrite'
      WHEN new_path = old_path THEN 'skip' ELSE 'path_only' END AS action
    FROM (SELECT i.origin_id AS doc_id, CASE WHEN c.path LIKE 'es/%' THEN c.title || '!' ELSE c.title END AS title, c.title AS old_title,
        c.path AS old_path, c.content_hash AS old_hash, i.content_hash,
        CASE WHEN length(c.title) % 3 = 0 THEN 'archive/' || c.path WHEN length(c.title) % 3 = 1 THEN c.path
          WHEN length(c.title) % 2 = 0 THEN '' ELSE c.path END AS new_path,
        CASE WHEN c.path LIKE 'de/%' THEN ['pinned'] ELSE list_reverse(c.tags) END AS new_tags,
        CASE WHEN c.path LIKE 'de/%' THEN ['pinned'] ELSE c.tags END AS old_tags
      FROM incoming i JOIN catalog c ON c.doc_id = i.origin_id)""", "incoming", "catalog"))
def classify_update(spark, sf):
    size = F.length("title")
    changes = incoming(spark, sf).select(
        F.col("origin_id").alias("doc_id"),
        F.when(F.col("path").startswith("es/"), F.concat("title", F.lit("!"))).otherwise(F.col("title")).alias("title"),
        F.when(size % 3 == 0, F.concat(F.lit("/archive/"), "path")).when(size % 3 == 1, F.col("path")).otherwise("").alias("path"),
        ((size % 3 == 2) & (size % 2 == 0)).alias("path_explicit"), F.reverse("tags").alias("tags"), "content_hash")
    done = cg.classify_updates(changes, _with_override(fx.catalog(spark, sf)))
    return done.select("doc_id", "new_path", F.array_join("new_tags", ",").alias("new_tags"), "action")


@check("effective_metadata", fx.select("""
    SELECT doc_id, CASE WHEN lang = 'de' THEN 'pinned' ELSE array_to_string(list_filter([
        CASE WHEN lang = 'en' THEN 'manual' END, CASE WHEN lang = 'fr' THEN 'old' END, lang, source], lambda v: v IS NOT NULL), ',') END AS new_tags,
      CASE WHEN lang = 'de' THEN '' ELSE array_to_string(entities, ',') END AS new_entities FROM md_docs""", "md_docs"))
def effective_metadata(spark, sf):
    """English documents keep a manual tag, French ones are legacy rows, German ones overridden."""
    docs = metadata.with_header(md_docs(spark, sf))
    lang = F.get("header_tags", F.lit(0))
    extra = F.when(lang == "en", F.array(F.lit("manual"), F.lit("OLD"))).otherwise(F.array(F.lit("old")))
    rows = docs.select(
        "doc_id", extra.alias("tags"), "header_tags", "header_entities",
        F.when(lang == "fr", F.lit(None).cast("array<string>")).otherwise(F.array(F.lit("o-l-d"))).alias("old_header_tags"),
        (lang == "de").alias("metadata_overridden"), F.array(F.lit("pinned")).alias("tags_override"),
        text.empty_strings().alias("entities_override"))
    done = cg.effective_metadata(rows)
    return done.select("doc_id", F.array_join("new_tags", ",").alias("new_tags"),
                       F.array_join("new_entities", ",").alias("new_entities"))


_EDIT_AT = "TIMESTAMP '2025-01-01'"


@check("metadata_override", fx.select(f"""
    SELECT c.doc_id, CASE WHEN l.quality = 0 THEN 'Edited,' || l.toxic ELSE array_to_string(c.tags, ',') END AS tags,
      CASE WHEN l.quality = 0 THEN '' ELSE array_to_string(c.entities, ',') END AS entities,
      coalesce(l.quality = 0, false) AS metadata_overridden,
      {fx.stamp(f"CASE WHEN l.quality = 0 THEN {_EDIT_AT} ELSE c.updated_at END")} AS updated_at
    FROM catalog c LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = c.doc_id""", "catalog"))
def metadata_override(spark, sf):
    edits = fx.table(spark, sf, "labels").filter("quality = 0").select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.array(F.lit("Edited"), F.lit("edited"), F.col("toxic").cast("string")).alias("new_tags"),
        text.empty_strings().alias("new_entities"), F.lit("2025-01-01").cast("timestamp").alias("edited_at"))
    cat = fx.catalog(spark, sf).withColumns({
        "metadata_overridden": F.lit(False), "tags_override": text.empty_strings(), "entities_override": text.empty_strings()})
    done = cg.override_metadata(cat, edits)
    return stamped(done, "updated_at").select(
        "doc_id", F.array_join("tags", ",").alias("tags"), F.array_join("entities", ",").alias("entities"),
        "metadata_overridden", "updated_at")


@check("move_documents", fx.select(f"""
    SELECT k.doc_id, CAST(k.chunk_index AS BIGINT) AS chunk_index, CASE WHEN l.toxic = 1 THEN
      'documents/review/' || c.path || '/' || k.doc_id || '/source.md' ELSE k.source_path END AS source_path
    FROM chunks k JOIN catalog c ON c.doc_id = k.doc_id LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = k.doc_id""",
    "chunks", "catalog"))
def move_documents(spark, sf):
    toxic = fx.table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("doc_id"))
    moves = fx.catalog(spark, sf).join(toxic, "doc_id", "left_semi").select(
        "doc_id", F.concat(F.lit("review/"), "path").alias("new_path"), F.lit("2025-01-01").cast("timestamp").alias("moved_at"))
    return cg.move_documents(fx.chunks(spark, sf), moves).select(
        "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "source_path")


@check("rename_directory", fx.select("""
    SELECT doc_id, CASE WHEN path = 'en' OR starts_with(path, 'en/') THEN 'archive/english' || substr(path, 3) ELSE path END AS path
    FROM catalog""", "catalog"))
def rename_directory(spark, sf):
    cat = fx.catalog(spark, sf)
    return cg.rename_directory(cat, "/en/", "archive\\english", known_dirs=cat.select("path")).select("doc_id", "path")


@check("delete_directory", fx.select("""
    SELECT doc_id, CASE WHEN path = 'fr' OR starts_with(path, 'fr/') THEN '' ELSE path END AS path FROM catalog""", "catalog"))
def delete_directory(spark, sf):
    return cg.delete_directory(fx.catalog(spark, sf), "fr").select("doc_id", "path")


@check("delete_documents", fx.select("""
    SELECT 'catalog' AS store, count(*) AS "rows" FROM catalog WHERE doc_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)
    UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE doc_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)
    UNION ALL SELECT 'postings', count(*) FROM postings WHERE doc_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)
    UNION ALL SELECT 'sources', count(*) FROM sources WHERE doc_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)""",
    "catalog", "chunks", "postings", "sources"))
def delete_documents(spark, sf):
    cat, chk, postings = corpus(spark, sf)
    gone = fx.table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("doc_id"))
    left = cg.delete_documents(gone, catalog=cat, chunks=chk, postings=postings, sources=fx.sources(spark, sf))
    counts = [t.agg(F.count("*").alias("rows")).select(F.lit(n).alias("store"), "rows") for n, t in left.items()]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


# ----------------------------------------------------------------------------- versions


def versions(spark, sf):
    talks = fx.table(spark, sf, "conversations")
    return talks.select(
        F.concat(F.lit("v-"), "turn").alias("version_id"), F.col("conv_id").cast("string").alias("doc_id"),
        F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"),
        F.lit("").alias("path"), F.array("role").alias("tags"), F.col("turn").alias("created_at"),
        F.col("role").alias("created_by"), F.lit("manual").alias("reason"))


fx.define("versions", [], """
    SELECT 'v-' || turn AS version_id, CAST(conv_id AS VARCHAR) AS doc_id, split_part(text, chr(10), 1) AS title,
      text AS content, '' AS path, [role] AS tags, turn AS created_at, role AS created_by FROM conversations""")


@check("version_list", fx.select("""
    SELECT doc_id, version_id, title, created_by, row_number() OVER (PARTITION BY doc_id ORDER BY created_at DESC) AS position
    FROM versions""", "versions"))
def version_list(spark, sf):
    from pyspark.sql import Window

    newest = Window.partitionBy("doc_id").orderBy(F.col("created_at").desc())
    return cg.list_versions(versions(spark, sf)).select(
        "doc_id", "version_id", "title", "created_by", F.row_number().over(newest).cast("long").alias("position"))


@check("version_lookup", fx.select("""
    SELECT w.doc_id, w.version_id, coalesce(v.title, '') AS title, v.doc_id IS NOT NULL AS found
    FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'v-' || quality AS version_id FROM labels) w
    LEFT JOIN versions v ON v.doc_id = w.doc_id AND v.version_id = w.version_id""", "versions"))
def version_lookup(spark, sf):
    wanted = fx.table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("v-"), "quality").alias("version_id"))
    return cg.lookup_versions(wanted, versions(spark, sf)).select(
        "doc_id", "version_id", F.coalesce("title", F.lit("")).alias("title"), "found")


@check("restore_version", fx.select("""
    SELECT v.doc_id, v.version_id, c.path AS new_path, CASE WHEN v.title = n.title AND v.content = n.content AND v.tags = n.tags
      THEN 'skip' ELSE 'rewrite' END AS action
    FROM versions v JOIN (SELECT doc_id, max(created_at) AS last FROM versions GROUP BY doc_id) m ON m.doc_id = v.doc_id
    JOIN versions n ON n.doc_id = v.doc_id AND n.created_at = m.last JOIN catalog c ON c.doc_id = v.doc_id""", "versions", "catalog"))
def restore_version(spark, sf):
    """Every version of every conversation is restored over the newest one."""
    every = versions(spark, sf)
    newest = every.groupBy("doc_id").agg(
        *[F.max_by(c, "created_at").alias(c) for c in ("title", "tags")],
        text.content_hash(F.max_by("content", "created_at")).alias("content_hash"))
    places = fx.catalog(spark, sf).select("doc_id", "path")
    current = newest.join(places, "doc_id").withColumns(
        {"metadata_overridden": F.lit(False), "tags_override": text.empty_strings()})
    done = cg.restore_versions(every.select("doc_id", "version_id"), every, current)
    return done.select("doc_id", "version_id", "new_path", "action")


@check("version_append", fx.select("""
    SELECT doc_id, title, path, 'before_delete' AS reason, 'admin' AS created_by, true AS named FROM catalog""", "catalog"))
def version_append(spark, sf):
    """Snapshots of all documents are appended in two parts, compacted and read back."""
    docs = fx.catalog(spark, sf).join(fx.sources(spark, sf).select("doc_id", "content"), "doc_id")
    taken = cg.snapshot(docs, "before_delete", "admin", F.lit("2025-01-01").cast("timestamp"))
    store = shared_folder(spark, "versions")
    english = F.array_contains("tags", "en")
    append_versions(taken.filter(english), store)
    append_versions(taken.filter(~english), store)
    compact_versions(spark, store)
    return read_versions(spark, store).select("doc_id", "title", "path", "reason", "created_by",
                        F.col("version_id").startswith("v-20250101-").alias("named"))


# -------------------------------------------------------------------------- directories

fx.define("explicit", [], """
    SELECT DISTINCT 'created/' || split_part(url, '/', 3) || '/' || split_part(url, '/', 4) AS path FROM pages""")
fx.define("tree", ["catalog", "explicit"], """
    SELECT array_to_string(parts[1:lv], '/') AS path, parts[lv] AS name, array_to_string(parts[1:lv - 1], '/') AS parent,
      CAST(lv AS BIGINT) AS depth, sum(CASE WHEN lv = len(parts) THEN n ELSE 0 END)::BIGINT AS doc_count
    FROM (SELECT list_filter(string_split(path, '/'), lambda sg: sg <> '') AS parts, n FROM (
      SELECT path, count(*) AS n FROM catalog GROUP BY path UNION ALL SELECT path, 0 FROM explicit)),
      LATERAL unnest(range(1, len(parts) + 1)) AS u(lv) GROUP BY 1, 2, 3, 4""")


def tree(spark, sf):
    parts = F.split("url", "/")
    explicit = fx.table(spark, sf, "pages").select(F.concat_ws(
        "/", F.lit("created"), F.get(parts, F.lit(2)), F.get(parts, F.lit(3))).alias("path")).distinct()
    return cg.directory_tree(fx.catalog(spark, sf), explicit).withColumn("depth", F.col("depth").cast("long"))


@check("directory_tree", fx.select("SELECT path, name, parent, depth, doc_count FROM tree", "tree"))
def directory_tree(spark, sf):
    return tree(spark, sf).select("path", "name", "parent", "depth", "doc_count")


@check("child_dirs", fx.select("SELECT name FROM tree WHERE parent = 'created'", "tree"))
def child_dirs(spark, sf):
    return cg.child_dirs(tree(spark, sf), "/created/")


# ------------------------------------------------------------------------- consistency

fx.define("checked_catalog", ["catalog"], """
    SELECT doc_id, title, path, CASE WHEN path LIKE 'de/%' THEN chunk_count + 1 ELSE chunk_count END AS chunk_count
    FROM catalog WHERE length(title) >= 10""")
fx.define("checked_chunks", ["holed_chunks"], """
    SELECT CASE WHEN chunk_index > 0 AND content LIKE 'T%' THEN '' ELSE doc_id END AS doc_id, chunk_index, source_path,
      NOT contains(content, '|') AS metadata_ok FROM holed_chunks""")
fx.define("chunk_stats", ["checked_chunks"], """
    SELECT doc_id, count(*) AS actual, arg_min(source_path, chunk_index) FILTER (source_path <> '') AS stored_path
    FROM checked_chunks WHERE metadata_ok AND doc_id <> '' GROUP BY doc_id""")
fx.define("probed", ["checked_catalog", "chunk_stats", "holed_sources"], """
    SELECT c.doc_id, CASE WHEN s.stored_path IS NOT NULL THEN s.stored_path IN (SELECT source_path FROM holed_sources)
      ELSE EXISTS (SELECT 1 FROM holed_sources h WHERE h.doc_id = c.doc_id AND h.path = c.path) END AS readable
    FROM checked_catalog c LEFT JOIN chunk_stats s ON s.doc_id = c.doc_id""")
fx.define("issues", ["probed", "chunk_stats", "checked_catalog", "checked_chunks"], """
    SELECT 'missing_chunks' AS code, 'error' AS severity, c.doc_id, title || '|' || path AS details FROM checked_catalog c
      WHERE doc_id NOT IN (SELECT doc_id FROM chunk_stats)
    UNION ALL SELECT 'chunk_count_mismatch', 'warning', c.doc_id, chunk_count || '|' || actual FROM checked_catalog c
      JOIN chunk_stats s ON s.doc_id = c.doc_id WHERE chunk_count <> actual
    UNION ALL SELECT 'missing_source', 'error', c.doc_id, title || '|' || path FROM checked_catalog c
      JOIN probed p ON p.doc_id = c.doc_id WHERE NOT readable
    UNION ALL SELECT 'orphan_document', 'warning', doc_id, '' FROM chunk_stats
      WHERE doc_id NOT IN (SELECT doc_id FROM checked_catalog)
    UNION ALL SELECT 'invalid_metadata', 'warning', '', CAST(chunk_index AS VARCHAR) FROM checked_chunks WHERE NOT metadata_ok
    UNION ALL SELECT 'missing_doc_id', 'warning', '', CAST(chunk_index AS VARCHAR) FROM checked_chunks
      WHERE metadata_ok AND doc_id = ''""")


def _stores(spark, sf):
    cat = fx.catalog(spark, sf).filter(F.length("title") >= 10).withColumn("chunk_count", F.when(
        F.col("path").startswith("de/"), F.col("chunk_count") + 1).otherwise(F.col("chunk_count")))
    lost = (F.col("chunk_index") > 0) & F.col("content").startswith("T")
    chk = holed_chunks(spark, sf).select(
        F.when(lost, "").otherwise(F.col("doc_id")).alias("doc_id"), "chunk_index", "source_path",
        (~F.contains("content", F.lit("|"))).alias("metadata_ok"))
    return cat, chk, holed_sources(spark, sf)


@check("source_probe", fx.select("SELECT doc_id, readable FROM probed", "probed"))
def source_probe(spark, sf):
    return consistency.probe_sources(*_stores(spark, sf))


@check("orphan_docs", fx.select("SELECT doc_id FROM issues WHERE code = 'orphan_document'", "issues"))
def orphan_docs(spark, sf):
    cat, chk, _ = _stores(spark, sf)
    return consistency.orphan_documents(chk, cat)


@check("consistency_issues", fx.select("SELECT code, severity, doc_id, details FROM issues", "issues"))
def consistency_issues(spark, sf):
    return consistency.consistency_issues(*_stores(spark, sf))


@check("consistency_summary", fx.select("""
    SELECT count(*) FILTER (severity = 'error') = 0 AS success, count(*) AS issue_count,
      count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings,
      (SELECT count(*) FROM checked_catalog) AS indexed_documents, (SELECT count(*) FROM chunk_stats) AS chunked_documents
    FROM issues""", "issues", "checked_catalog", "chunk_stats"))
def consistency_summary(spark, sf):
    cat, chk, src = _stores(spark, sf)
    return consistency.consistency_summary(consistency.consistency_issues(cat, chk, src), cat, chk)


# ---------------------------------------------------------------------- postings upkeep


@check("postings_maintain", fx.select(f"""
    , changed AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, toxic FROM labels),
    edited AS (SELECT k.doc_id, k.chunk_index, unnest({fx.tokens("concat_ws(' ', 'revised', k.content)")}) AS term, 1 AS tf, 0 AS fields
      FROM chunks k JOIN changed g ON g.doc_id = k.doc_id WHERE g.toxic = 0),
    fresh AS (SELECT term, doc_id, chunk_index, CAST(sum(tf) AS INTEGER) AS tf, CAST(bit_or(fields) AS INTEGER) AS fields FROM (
      SELECT * FROM edited UNION ALL SELECT p.doc_id, p.chunk_index, p.term, 0, p.fields FROM postings p
        JOIN changed g ON g.doc_id = p.doc_id WHERE g.toxic = 0) GROUP BY ALL)
    SELECT term, doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, tf, fields FROM postings WHERE doc_id NOT IN (SELECT doc_id FROM changed)
    UNION ALL SELECT term, doc_id, CAST(chunk_index AS BIGINT), tf, fields FROM fresh""", "postings", "chunks", "catalog"))
def postings_maintain(spark, sf):
    """Labelled documents change: toxic ones are deleted, the others get a new word.

    Every document first gets an outdated delete, which the later operation replaces.
    """
    cat, chk, postings = corpus(spark, sf)
    labels = fx.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("doc_id"), "toxic")
    final = labels.select("doc_id", F.lit(2).alias("seq"), F.when(F.col("toxic") == 1, "delete").otherwise("upsert").alias("op"))
    stale = labels.select("doc_id", F.lit(1).alias("seq"), F.lit("delete").alias("op"))
    changed = cg.latest_operations(stale.union(final))
    kept = changed.filter("op = 'upsert'")
    edited = chk.join(kept, "doc_id", "left_semi").withColumn("content", F.concat(F.lit("revised "), "content"))
    done = cg.maintain_postings(postings, changed, retrieval.build_postings(cat, edited))
    return done.withColumn("chunk_index", F.col("chunk_index").cast("long"))


@check("grants_reconcile", """
    SELECT key_hash, 'live' AS origin FROM (SELECT CAST(user_id AS VARCHAR) AS key_hash FROM events WHERE event_type = 'error' GROUP BY user_id)
    UNION ALL SELECT CAST(user_id AS VARCHAR), 'file' FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'error') = 0""")
def grants_reconcile(spark, sf):
    events = fx.table(spark, sf, "events").withColumn("key_hash", F.col("user_id").cast("string"))
    in_use = events.filter("event_type = 'error'").select("key_hash").distinct().withColumn("origin", F.lit("live"))
    filed = events.select("key_hash").distinct().withColumn("origin", F.lit("file"))
    return cg.reconcile_grants(in_use, filed)
