"""Checked queries of sources, sinks, ingestion and usage statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark.checks import fixtures as fx
from lorespark.checks.catalog_checks import stamped
from lorespark.checks.graph_checks import relation_graph
from lorespark.checks.registry import check
from lorespark.checks.scalar_checks import AS_OF, EFFECTIVE_SQL, audit, grants, md_docs
from lorespark.functions import embedding
from lorespark.operators import catalog as cg
from lorespark.operators import filters, rates, stats
from lorespark.plans import ingest
from lorespark.sources import files, tables
from lorespark.session import shared_folder


# ------------------------------------------------------------------------------ listing


@check("source_listing", """
    SELECT object_path, parts[-2] AS doc_id, array_to_string(parts[2:-3], '/') AS path FROM (
      SELECT object_path, string_split(object_path, '/') AS parts FROM (
        SELECT 'documents/' || regexp_extract(url, '^https?://(.*)$', 1) || '/source.md' AS object_path FROM pages))""")
def source_listing(spark, sf):
    place = F.concat(F.lit("documents/"), F.regexp_extract("url", "^https?://(.*)$", 1), F.lit("/source.md"))
    return files.list_sources(fx.table(spark, sf, "pages").select(place.alias("object_path")))


@check("decode_documents", "SELECT doc_id, text FROM documents")
def decode_documents(spark, sf):
    """Every text encoded as UTF-16 with a mark, UTF-8 with a mark, or plain UTF-8."""
    pick = F.col("doc_id") % 3
    marked = F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE"))
    utf8 = F.encode("text", "UTF-8")
    raw = F.when(pick == 0, marked).when(pick == 1, F.concat(F.unhex(F.lit("EFBBBF")), utf8)).otherwise(utf8)
    return fx.table(spark, sf, "documents").select("doc_id", files.decode_bytes(raw).alias("text"))


# One CSV file per order: a header (missing for odd orders) and its line items.
def order_files(spark, sf):
    lines = fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat_ws(
            ",", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), "l_returnflag",
            F.when(F.col("l_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit('"'), F.lit("to, "), "l_linestatus", F.lit('"')))
        ).alias("line"))
    header = F.when(F.col("l_orderkey") % 2 == 0, F.lit("line,part,flag,flag\n")).otherwise("")
    return lines.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "line"))).alias("rows")
    ).select("l_orderkey", F.concat(F.lit("Order "), "l_orderkey").alias("title"),
             F.concat(header, F.array_join("rows.line", "\n"), F.lit("\n , ,,\n")).alias("content"))


fx.define("order_cells", [], """
    SELECT l_orderkey, headed, cells, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,
        cells[1] || ',' || cells[2] || ',' || cells[3] || ',' || CASE WHEN cells[4] = '' THEN '' ELSE '"' || cells[4] || '"' END) AS rn
    FROM (SELECT l_orderkey, l_linenumber, l_orderkey % 2 = 0 AS headed,
      [CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), l_returnflag,
        CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE 'to, ' || l_linestatus END] AS cells FROM lineitem)""")


@check("csv_to_records", fx.select("""
    SELECT l_orderkey, '# Order ' || l_orderkey || chr(10) || chr(10) || '## CSV 数据记录' || chr(10) || chr(10) ||
      string_agg('- 行号: ' || rn || chr(10) || body, chr(10) || chr(10) ORDER BY rn) || chr(10) AS markdown
    FROM (SELECT l_orderkey, rn, array_to_string(list_filter(list_transform(
        CASE WHEN headed THEN ['line', 'part', 'flag', 'flag（2）'] ELSE ['列1', '列2', '列3', '列4'] END,
        lambda nm, ix: CASE WHEN cells[ix] <> '' THEN '  - ' || nm || ': ' || cells[ix] END), lambda fd: fd IS NOT NULL), chr(10)) AS body
      FROM order_cells) GROUP BY l_orderkey""", "order_cells"))
def csv_to_records(spark, sf):
    return files.csv_to_records(order_files(spark, sf)).select("l_orderkey", "markdown")


@check("csv_header_detect", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN try_cast(replace(cell, ',', '') AS DOUBLE) IS NULL AND cell <> ''
      ELSE NOT (try_cast(replace(cell, ',', '') AS DOUBLE) IS NOT NULL AND below <> '' AND try_cast(replace(below, ',', '') AS DOUBLE) IS NOT NULL) END AS is_header
    FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN o_orderstatus ELSE '1,234.5' END AS cell,
      CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN o_orderpriority ELSE CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) END AS below FROM orders)""")
def csv_header_detect(spark, sf):
    """Two-row files (one row for every fourth order) with a label and a changing column."""
    pick, low = F.col("o_orderkey") % 3, F.col("o_orderkey") % 5
    cell = F.when(pick == 0, F.col("o_custkey").cast("string")).when(pick == 1, F.col("o_orderstatus")).otherwise("1,234.5")
    below = F.when(low == 0, "").when(low == 1, F.col("o_orderpriority")).otherwise(
        F.round("o_totalprice").cast("long").cast("string"))
    first = F.array(F.lit("name"), cell)
    rows = F.when(F.col("o_orderkey") % 4 == 0, F.array(first)).otherwise(F.array(first, F.array(F.lit("x"), below)))
    return fx.table(spark, sf, "orders").select(
        "o_orderkey", files.looks_like_header(files.clean_rows(rows)).alias("is_header"))


@check("csv_header_normalise", """
    SELECT doc_id, array_to_string(list_transform(names, lambda nm, ix: CASE
      WHEN len(list_filter(names[1:ix], lambda ot: ot = nm)) = 1 THEN nm
      ELSE nm || '（' || len(list_filter(names[1:ix], lambda ot: ot = nm)) || '）' END), '|') AS headers
    FROM (SELECT doc_id, list_transform(string_split(replace(split_part(text, chr(10), 1), 'e', ' '), ' '),
      lambda nm, ix: CASE WHEN nm = '' THEN '列' || ix ELSE nm END) AS names FROM documents)""")
def csv_header_normalise(spark, sf):
    words = F.split(F.replace(F.substring_index("text", "\n", 1), F.lit("e"), F.lit(" ")), " ")
    return fx.table(spark, sf, "documents").select(
        "doc_id", F.array_join(files.normalise_headers(words), "|").alias("headers"))


@check("corpus_export", fx.select(r"""
    SELECT doc_id, name || CASE WHEN k > 1 THEN '-' || k ELSE '' END || '.md' AS export_name FROM (
      SELECT doc_id, name, row_number() OVER (PARTITION BY name ORDER BY doc_id) AS k FROM (
        SELECT doc_id, path || '/' || CASE WHEN safe = '' THEN 'untitled' ELSE safe END AS name FROM (
          SELECT doc_id, path, trim(regexp_replace(title, '[<>:"/\\|?*]', '_', 'g'), ' ._') AS safe FROM catalog)))""", "catalog"))
def corpus_export(spark, sf):
    return files.export_names(fx.catalog(spark, sf)).select("doc_id", "export_name")


def _texts(spark, sf):
    return fx.table(spark, sf, "documents").select(
        F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("relpath"),
        F.col("text").alias("content"))


@check("snapshot_manifest", """
    SELECT lang || '/' || doc_id || '.md' AS relpath, sha256(text) AS sha256, octet_length(encode(text)) AS size FROM documents""")
def snapshot_manifest(spark, sf):
    return files.manifest(_texts(spark, sf))


@check("manifest_verify", """
    SELECT lang || '/' || d.doc_id || '.md' AS relpath, CASE WHEN coalesce(l.toxic, 0) = 1 THEN 'missing'
      WHEN l.quality = 0 THEN 'checksum_mismatch' ELSE 'ok' END AS verdict
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def manifest_verify(spark, sf):
    """Toxic documents are gone and poor ones were edited since the manifest was taken."""
    facts = fx.table(spark, sf, "documents").join(fx.table(spark, sf, "labels"), "doc_id", "left")
    now = facts.filter(F.coalesce("toxic", F.lit(0)) == 0).select(
        F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("relpath"),
        F.when(F.col("quality") == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("content"))
    return files.verify_manifest(files.manifest(_texts(spark, sf)), files.manifest(now))


def _halves(spark, sf):
    """Live files carry a doc per name and, for labelled ones, earlier restored copies."""
    base = files.manifest(_texts(spark, sf)).drop("size")
    labels = fx.table(spark, sf, "labels").join(fx.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    stem = F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".restored-"))
    copies = labels.select(F.concat(stem, F.when(F.col("quality") == 1, "1").otherwise("2"), F.lit(".md")).alias("relpath"),
                           F.lit("copy").alias("sha256"))
    english = F.col("relpath").startswith("en/")
    archive = base.filter(english | F.col("relpath").rlike("^(fr|es)/")).withColumn("sha256", F.reverse("sha256"))
    return base.filter(english | F.col("relpath").rlike("^(de|es)/")).unionByName(copies), archive


fx.define("live_files", [], """
    SELECT lang || '/' || doc_id || '.md' AS relpath, sha256(text) AS sha256 FROM documents WHERE lang IN ('en', 'de', 'es')
    UNION ALL SELECT d.lang || '/' || l.doc_id || '.restored-' || CASE WHEN l.quality = 1 THEN '1' ELSE '2' END || '.md', 'copy'
      FROM labels l JOIN documents d ON d.doc_id = l.doc_id""")
fx.define("archive_files", [], """
    SELECT lang || '/' || doc_id || '.md' AS relpath, lang || '/' || doc_id AS stem, reverse(sha256(text)) AS sha256
    FROM documents WHERE lang IN ('en', 'fr', 'es')""")


def _merge_sql(policy: str) -> str:
    fresh = "SELECT relpath, sha256, 'archive' AS origin FROM archive_files WHERE relpath NOT IN (SELECT relpath FROM live_files)"
    kept = "SELECT relpath, sha256, 'live' AS origin FROM live_files"
    body = {
        "skip": f"{kept} UNION ALL {fresh}",
        "overwrite": f"{kept} WHERE relpath NOT IN (SELECT relpath FROM archive_files) UNION ALL SELECT relpath, sha256, 'archive' FROM archive_files",
        "rename": f"""{kept} UNION ALL {fresh} UNION ALL SELECT stem || '.restored-' || (SELECT min(n) FROM range(1, 4) r(n)
            WHERE stem || '.restored-' || n || '.md' NOT IN (SELECT relpath FROM live_files)) || '.md', sha256, 'archive'
            FROM archive_files WHERE relpath IN (SELECT relpath FROM live_files)""",
    }[policy]
    return fx.select(body, "live_files", "archive_files")


@check("snapshot_merge", _merge_sql("rename"))
def snapshot_merge(spark, sf):
    return files.merge_snapshot(*_halves(spark, sf), "rename")


@check("snapshot_merge_skip", _merge_sql("skip"))
def snapshot_merge_skip(spark, sf):
    return files.merge_snapshot(*_halves(spark, sf), "skip")


@check("snapshot_merge_overwrite", _merge_sql("overwrite"))
def snapshot_merge_overwrite(spark, sf):
    return files.merge_snapshot(*_halves(spark, sf), "overwrite")


# --------------------------------------------------------------------------------- audit


def _scratch(spark) -> str:
    return f"{shared_folder(spark, 'files')}/out"


@check("audit_scan", """
    SELECT 'audit-' || event_id AS id, event_type AS action, 'user-' || user_id AS actor, event_type <> 'error' AS success,
      json_extract_string(props, '$.k') AS k FROM events WHERE event_type <> 'view'""")
def audit_scan(spark, sf):
    """Events as JSON lines, every view event cut off in the middle."""
    folder = _scratch(spark)
    line = F.to_json(F.struct("id", "timestamp", "actor_type", "actor", "action", "target_type", "target_id", "path", "success", "detail"))
    broken = F.when(F.col("action") == "view", F.substring(line, 1, 40)).otherwise(line)
    audit(spark, sf).select(F.concat(broken, F.lit("\n")).alias("value")).write.text(folder)
    return tables.read_audit(spark, folder).select("id", "action", "actor", "success", F.col("detail")["k"].alias("k"))


@check("audit_append", f"""
    SELECT {fx.stamp('ts')} AS "timestamp", 'system' AS actor_type, CAST(user_id AS VARCHAR) AS actor, event_type AS action,
      true AS success, CAST(38 AS BIGINT) AS id_length FROM events""")
def audit_append(spark, sf):
    """Bare events completed, appended by day and read back."""
    folder = _scratch(spark)
    bare = fx.table(spark, sf, "events").select(
        F.col("event_type").alias("action"), F.col("ts").alias("timestamp"), F.col("user_id").cast("string").alias("actor"))
    tables.append_audit(bare, folder)
    return stamped(tables.read_audit(spark, folder), "timestamp").select(
        "timestamp", "actor_type", "actor", "action", "success", F.length("id").cast("long").alias("id_length"))


@check("audit_page", f"""
    SELECT 'audit-' || event_id AS id, {fx.stamp('ts')} AS "timestamp", event_type AS action, count(*) OVER () AS total FROM events
    WHERE event_type <> 'error' ORDER BY ts DESC, 'audit-' || event_id LIMIT 100 OFFSET 300""")
def audit_page(spark, sf):
    rows = filters.audit_matches(audit(spark, sf), success=True)
    return stamped(cg.newest_page(rows, "timestamp", "id", limit=100, offset=300), "timestamp").select(
        "id", "timestamp", "action", "total")


@check("audit_page_deep", f"""
    SELECT 'audit-' || event_id AS id, {fx.stamp('ts')} AS "timestamp", event_type AS action, count(*) OVER () AS total FROM events
    WHERE event_type <> 'error' ORDER BY ts DESC, 'audit-' || event_id LIMIT 100 OFFSET 400""")
def audit_page_deep(spark, sf):
    """A page that is found by measured ranges."""
    rows = filters.audit_matches(audit(spark, sf), success=True)
    return stamped(cg.newest_page(rows, "timestamp", "id", limit=100, offset=400, top_rows=0), "timestamp").select(
        "id", "timestamp", "action", "total")


@check("graph_sink", fx.select(
    "SELECT relation, CAST(1 AS BIGINT) AS version, count(*) AS edges FROM edges GROUP BY relation", "edges"))
def graph_sink(spark, sf):
    """The relation graph written, and its edges read back per relation."""
    from lorespark.checks.graph_checks import relation_graph

    folder, built = _scratch(spark), relation_graph(spark, sf)
    tables.write_graph(built.nodes, built.edges, folder)
    return spark.read.parquet(f"{folder}/edges").groupBy(
        "relation", F.col("version").cast("long").alias("version")).agg(F.count("*").alias("edges"))


# ------------------------------------------------------------------------------- ingest


def uploads(spark, sf):
    """Markdown documents; some lack a title or a text."""
    labels = fx.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("doc_id"), "toxic")
    docs = md_docs(spark, sf).join(labels, "doc_id", "left")
    return docs.select(
        "doc_id", F.when(F.length("title") % 7 == 0, "  ").otherwise(F.col("title")).alias("title"), "path", "tags",
        F.when(F.col("toxic") == 1, " \n\t\n").otherwise(F.replace("content", F.lit("\n"), F.lit("\r\n"))).alias("content"))


fx.define("uploads", ["md_docs"], """
    SELECT d.doc_id, CASE WHEN length(d.title) % 7 = 0 THEN 'blank_title' WHEN l.toxic = 1 THEN 'blank_content' END AS reason,
      d.title, d.path, d.lang, d.source, d.entities, d.content
    FROM md_docs d LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = d.doc_id""")


@check("doc_reject_reasons", fx.select("SELECT doc_id, coalesce(reason, '') AS reason FROM uploads", "uploads"))
def doc_reject_reasons(spark, sf):
    return ingest.prepare(uploads(spark, sf)).select("doc_id", F.coalesce("reason", F.lit("")).alias("reason"))


_NOW = "2025-01-01"


@check("ingest_documents", fx.select("""
    SELECT u.doc_id, u.title, u.path, u.source || ',' || u.lang AS tags, array_to_string(u.entities, ',') AS entities, k.n AS chunk_count,
      sha256(u.content) AS content_hash, k.chars, k.n AS stored_chunks
    FROM uploads u JOIN (SELECT doc_id, count(*) AS n, sum(length(content))::BIGINT AS chars FROM md_chunks GROUP BY doc_id) k ON k.doc_id = u.doc_id
    WHERE reason IS NULL""", "uploads", "md_chunks"))
def ingest_documents(spark, sf):
    done = ingest.ingest_documents(uploads(spark, sf), F.lit(_NOW).cast("timestamp"))
    sizes = done.chunks.groupBy("doc_id").agg(
        F.sum(F.length("content")).alias("chars"), F.count_if(F.size("embedding") == 64).alias("stored_chunks"))
    return done.catalog.join(sizes, "doc_id").select(
        "doc_id", "title", "path", F.array_join("tags", ",").alias("tags"), F.array_join("entities", ",").alias("entities"),
        F.col("chunk_count").cast("long").alias("chunk_count"), "content_hash", "chars", "stored_chunks")


@check("ingest_log", fx.select("""
    SELECT doc_id, node, CASE WHEN reason IS NULL OR node <> 'parse_markdown' THEN 'succeeded' ELSE 'failed' END AS status,
      CASE WHEN reason IS NULL OR node <> 'parse_markdown' THEN '' ELSE reason END AS error
    FROM uploads, (VALUES ('parse_markdown'), ('normalize_content'), ('chunk'), ('embedding'), ('persist_source'),
      ('persist_vector'), ('commit_index')) n(node) WHERE reason IS NULL OR node = 'parse_markdown'""", "uploads"))
def ingest_log(spark, sf):
    return ingest.ingest_log(ingest.prepare(uploads(spark, sf))).select("doc_id", "node", "status", "error")


@check("reindex_summary", fx.select("""
    SELECT count(*) AS processed, count(*) FILTER (reason IS NULL) AS succeeded, count(*) FILTER (reason IS NOT NULL) AS failed,
      CASE WHEN count(*) FILTER (reason IS NOT NULL) = 0 THEN 'completed' ELSE 'failed' END AS status FROM uploads""", "uploads"))
def reindex_summary(spark, sf):
    return stats.reindex_summary(ingest.ingest_log(ingest.prepare(uploads(spark, sf))))


@check("ingest_failures", fx.select("""
    SELECT doc_id, reason AS error FROM uploads WHERE reason IS NOT NULL""", "uploads"))
def ingest_failures(spark, sf):
    return stats.ingest_failures(ingest.ingest_log(ingest.prepare(uploads(spark, sf)))).select("doc_id", "error")


@check("node_summary", fx.select("""
    SELECT node, CASE WHEN reason IS NULL OR node <> 'parse_markdown' THEN 'succeeded' ELSE 'failed' END AS status, count(*) AS documents
    FROM uploads, (VALUES ('parse_markdown'), ('normalize_content'), ('chunk'), ('embedding'), ('persist_source'),
      ('persist_vector'), ('commit_index')) n(node) WHERE reason IS NULL OR node = 'parse_markdown' GROUP BY ALL""", "uploads"))
def node_summary(spark, sf):
    return stats.node_summary(ingest.ingest_log(ingest.prepare(uploads(spark, sf))))


@check("reindex", fx.select("""
    SELECT k.doc_id, CAST(k.chunk_index AS BIGINT) AS chunk_index, k.content, d.lang || ',' || d.source AS tags
    FROM md_chunks k JOIN md_docs d ON d.doc_id = k.doc_id WHERE d.path LIKE 'en/%'""", "md_chunks", "md_docs"))
def reindex(spark, sf):
    """The English subtree again, its old header tags replaced by the new ones."""
    subtree = spark.createDataFrame([("en",)], "prefix string")
    docs = filters.in_subtrees(md_docs(spark, sf), subtree)
    done = ingest.reindex(docs.withColumns({
        "tags": F.array(F.lit("stale")), "old_header_tags": F.array(F.lit("Stale")), "metadata_overridden": F.lit(False),
        "tags_override": F.array().cast("array<string>"), "entities_override": F.array().cast("array<string>")}))
    return done.chunks.join(done.catalog.select("doc_id", "tags"), "doc_id").select(
        "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "content", F.array_join("tags", ",").alias("tags"))


@check("embed_chunks", fx.select("""
    SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, CAST(64 AS BIGINT) AS dims,
      CASE WHEN trim(content) = '' THEN 0.0 ELSE 1.0 END::DOUBLE AS norm FROM chunks""", "chunks"))
def embed_chunks(spark, sf):
    """Every line embedded; the first provider always fails over to the second."""
    def broken(texts):
        raise ConnectionError("down")

    chunks = fx.chunks(spark, sf).select("doc_id", "chunk_index", "content")
    done = embedding.embed_chunks(chunks, broken, embedding.hashed_terms)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return done.select(
        "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"),
        F.size("embedding").cast("long").alias("dims"), F.round(norm, 6).alias("norm"))


# -------------------------------------------------------------------------------- usage


def requests(spark, sf):
    return fx.table(spark, sf, "events").select(
        F.col("user_id").alias("key"), "ts")


fx.define("requests", [], "SELECT user_id AS key, ts FROM events")


def _buckets_sql(unit: str, days: int) -> str:
    return fx.select(f"""
        SELECT {fx.stamp(f"date_trunc('{unit}', ts)")} AS bucket, count(*) AS requests FROM requests
        WHERE date_trunc('{unit}', ts) > (SELECT max(ts) FROM requests) - INTERVAL {days} DAY GROUP BY date_trunc('{unit}', ts)""",
        "requests")


def _kept(spark, sf, unit, days):
    asked = requests(spark, sf)
    counts = stats.requests_per(asked, unit)
    newest = asked.agg(F.max("ts").alias("t")).scalar()
    return stamped(stats.kept_buckets(counts, newest, days), "bucket")


@check("search_hourly", _buckets_sql("hour", 8))
def search_hourly(spark, sf):
    return _kept(spark, sf, "hour", stats.HOURLY_DAYS)


@check("search_daily", _buckets_sql("day", 90))
def search_daily(spark, sf):
    return _kept(spark, sf, "day", stats.DAILY_DAYS)


@check("search_trend_24h", fx.select("""
    SELECT pos, strftime(h + INTERVAL 8 HOUR, '%H:00') AS label, (SELECT count(*) FROM requests r WHERE date_trunc('hour', r.ts) = h) AS requests
    FROM (SELECT pos, date_trunc('hour', TIMESTAMP '2024-01-15 12:34:56') - (23 - pos) * INTERVAL 1 HOUR AS h FROM range(0, 24) t(pos))""",
    "requests"))
def search_trend(spark, sf):
    return stats.search_trend(requests(spark, sf), F.lit("2024-01-15 12:34:56").cast("timestamp")).withColumn(
        "pos", F.col("pos").cast("long"))


@check("key_usage", fx.select(
    f"SELECT key, count(*) AS use_count, {fx.stamp('max(ts)')} AS last_used_at FROM requests GROUP BY key", "requests"))
def key_usage(spark, sf):
    return stamped(stats.key_usage(requests(spark, sf)), "last_used_at")


@check("corpus_dashboard", fx.select(f"""
    SELECT (SELECT count(*) FROM catalog) AS documents, count(*) FILTER (status = 'active') AS active_keys,
      count(*) FILTER (status = 'active' AND expires_at BETWEEN as_of AND as_of + INTERVAL 1 DAY) AS expiring_keys, count(*) AS total_keys,
      (SELECT count(*) FROM requests WHERE date_trunc('day', ts) = TIMESTAMP '2024-01-15') AS requests_today,
      (SELECT count(*) FROM requests) AS requests_total, (SELECT count(*) FROM nodes) AS graph_nodes,
      (SELECT count(*) FROM edges) AS graph_edges
    FROM (SELECT *, {EFFECTIVE_SQL} AS status FROM grants)""", "catalog", "requests", "grants", "nodes", "edges"))
def corpus_dashboard(spark, sf):
    as_of = F.lit(AS_OF).cast("timestamp")
    shown = grants(spark, sf).withColumnRenamed("stored", "status").withColumn("status", filters.effective_status(as_of))
    built = relation_graph(spark, sf)
    return stats.dashboard(fx.catalog(spark, sf), shown, requests(spark, sf), as_of, built.nodes, built.edges)


def _rate_sql(key: str, source: str, seconds: int, limit: int) -> str:
    # Jump from each window's opener to the first request after its expiry.
    return fx.select(f"""
        , asked AS (SELECT {key} AS key, ts FROM {source}),
        opened AS (SELECT key, min(ts) AS at FROM asked GROUP BY key
          UNION SELECT o.key, (SELECT min(a.ts) FROM asked a WHERE a.key = o.key AND a.ts >= o.at + INTERVAL {seconds} SECOND)
          FROM opened o WHERE o.at IS NOT NULL)
        SELECT o.key, {fx.stamp('o.at')} AS opened_at, count(*) AS requests, greatest(count(*) - {limit}, 0) AS rejected
        FROM opened o JOIN asked a ON a.key = o.key AND a.ts >= o.at AND a.ts < o.at + INTERVAL {seconds} SECOND
        WHERE o.at IS NOT NULL GROUP BY o.key, o.at""", "requests", recursive=True)


@check("anchored_rate_window", _rate_sql("key", "requests", 60, 30))
def anchored_rate_window(spark, sf):
    return stamped(rates.anchored_rate_windows(requests(spark, sf)), "opened_at")


@check("anchored_rate_window_hour", _rate_sql("event_type", "events", 3600, 3))
def anchored_rate_window_hour(spark, sf):
    """Few hot keys and long windows."""
    asked = fx.table(spark, sf, "events").select(F.col("event_type").alias("key"), "ts")
    return stamped(rates.anchored_rate_windows(asked, width_seconds=3600, limit=3), "opened_at")
