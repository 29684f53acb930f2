"""Checked queries of the scalar functions and the row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark.checks import fixtures as fx
from lorespark.checks.registry import check
from lorespark.functions import chunking, metadata, paths, scoring, text
from lorespark.operators import filters
from lorespark.operators import retrieval as rt

CJK = "[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}\\x{f900}-\\x{faff}]+"
# Latin vowels become ideographs, so that token runs to cut into bigrams exist.
VOWELS, IDEOGRAPHS = "aeiou", "知识库检索"


@check("tokenize", f"""SELECT doc_id, array_to_string({fx.tokens('text')}, '|') AS tokens FROM documents""")
def tokenize(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id", F.array_join(text.tokenize(F.col("text")), "|").alias("tokens"))


@check("keyword_terms", f"""
    SELECT item_id, array_to_string({fx.distinct_list('terms')}, '|') AS terms FROM (
      SELECT item_id, flatten(list_transform({fx.tokens('mixed')}, lambda tk: list_concat([tk],
        flatten(list_transform(regexp_extract_all(tk, '{CJK}'), lambda rn: list_transform(
          range(1, length(rn)), lambda ps: substr(rn, ps, 2))))))) AS terms
      FROM (SELECT item_id, translate(lower(text), '{VOWELS}', '{IDEOGRAPHS}') AS mixed FROM benchmark
        UNION ALL SELECT conv_id * 1000 + turn + 1000000, translate(lower(text), '{VOWELS}', '{IDEOGRAPHS}')
        FROM conversations))""")
def keyword_terms(spark, sf):
    talks = fx.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn") + 1000000).alias("item_id"), "text")
    both = fx.table(spark, sf, "benchmark").select("item_id", "text").union(talks)
    mixed = F.translate(F.lower("text"), VOWELS, IDEOGRAPHS)
    return both.select("item_id", F.array_join(text.keyword_terms(mixed), "|").alias("terms"))


@check("normalize_query", f"""
    SELECT item_id, array_to_string({fx.distinct_list(fx.tokens('text'))}, ' ') AS query FROM benchmark""")
def normalize_query(spark, sf):
    return fx.table(spark, sf, "benchmark").select(
        "item_id", text.normalize_query(F.col("text")).alias("query"))


@check("content_hash", """
    SELECT doc_id, sha256(text) AS content_hash,
      printf('%.1fKB', octet_length(encode(text)) / 1024.0::DOUBLE) AS size_label FROM documents""")
def content_hash(spark, sf):
    """The text is hashed with CRLF newlines; the SQL hashes it with LF."""
    return fx.table(spark, sf, "documents").select(
        "doc_id", text.content_hash(F.replace("text", F.lit("\n"), F.lit("\r\n"))).alias("content_hash"),
        text.size_label(F.col("text")).alias("size_label"))


_BUDGET = "(doc_id % 97)"
_AFTER = f"least(length(b), {_BUDGET} - least(length(a), {_BUDGET} // 2))"
_BEFORE = f"least(length(a), {_BUDGET} - {_AFTER})"


@check("bound_context", f"""
    SELECT doc_id, CASE WHEN {_BEFORE} > 0 THEN right(a, {_BEFORE}) ELSE '' END AS context_before,
      CASE WHEN {_AFTER} > 0 THEN left(b, {_AFTER}) ELSE '' END AS context_after
    FROM (SELECT doc_id, left(text, length(text) // 2) AS a, substr(text, length(text) // 2 + 1) AS b FROM documents)""")
def bound_context(spark, sf):
    """The two halves of every text stand around a hit."""
    half = F.expr("length(text) div 2")
    docs = fx.table(spark, sf, "documents").select(
        "doc_id", F.substring("text", F.lit(1), half).alias("a"),
        F.substring("text", half + 1, F.length("text")).alias("b"))
    before, after = text.bound_context(F.col("a"), F.col("b"), (F.col("doc_id") % 97).cast("int"))
    return docs.select("doc_id", before.alias("context_before"), after.alias("context_after"))


@check("heading_text", r"""
    SELECT doc_id, heading, CASE WHEN regexp_matches(heading, '^#{1,6}\s+.+$') THEN
        trim(regexp_replace(trim(regexp_extract(heading, '^#{1,6}\s+(.+)$', 1)), '\s*[（(][^）)]*[）)]\s*$', ''))
        ELSE heading END AS name,
      '> ' || CASE WHEN regexp_matches(heading, '^#{1,6}\s+.+$') THEN
        trim(regexp_replace(trim(regexp_extract(heading, '^#{1,6}\s+(.+)$', 1)), '\s*[（(][^）)]*[）)]\s*$', ''))
        ELSE heading END || '（2/' || part || '）' || chr(10) || chr(10) AS note
    FROM (SELECT doc_id, doc_id % 5 + 1 AS part, repeat('#', CAST(doc_id % 8 AS BIGINT)) || ' ' || split_part(text, chr(10), 1)
        || CASE WHEN doc_id % 2 = 0 THEN ' (remark)' ELSE '（备注） ' END AS heading FROM documents)""")
def heading_text(spark, sf):
    rest = F.when(F.col("doc_id") % 2 == 0, " (remark)").otherwise("（备注） ")
    docs = fx.table(spark, sf, "documents").select(
        "doc_id", (F.col("doc_id") % 5 + 1).alias("part"),
        F.concat(F.expr("repeat('#', cast(doc_id % 8 as int))"), F.lit(" "),
                 F.substring_index("text", "\n", 1), rest).alias("heading"))
    return docs.select(
        "doc_id", "heading", text.heading_text(F.col("heading")).alias("name"),
        text.continuation_note(F.col("heading"), F.lit(2), F.col("part")).alias("note"))


@check("sliding_chunks", """
    SELECT doc_id, ps AS position, CASE WHEN ps = n THEN substr(text, ps * 462 + 1)
      ELSE substr(text, ps * 462 + 1, 512) END AS part
    FROM (SELECT doc_id, text, CAST(greatest(ceil((length(text) - 512) / 462.0::DOUBLE), 0) AS BIGINT) AS n
      FROM documents), LATERAL unnest(range(0, n + 1)) AS u(ps)""")
def sliding_chunks(spark, sf):
    return fx.table(spark, sf, "documents").select(
        "doc_id", F.posexplode(text.sliding_windows(F.col("text"), 512, 50)).alias("position", "part")
    ).withColumn("position", F.col("position").cast("long"))


# Line by line, since the engine's patterns know no look-ahead.
_SPACED = r"""
    SELECT doc_id, string_agg(line || CASE WHEN regexp_matches(line, '^[^#>\[]') AND NOT regexp_matches(line, '^[ \t]*[-*+](\s|$)')
        AND regexp_matches(below, '^(\d+\.\s|[-*+]\s)') THEN chr(10) ELSE '' END, chr(10) ORDER BY pos) AS spaced
    FROM (SELECT doc_id, pos, lines[pos] AS line, coalesce(lines[pos + 1] || chr(10), '') AS below FROM (
      SELECT doc_id, list_transform(string_split(text, chr(10)), lambda ln, ix: CASE WHEN ix % 2 = 0 THEN '- ' || ln ELSE ln END) AS lines
      FROM documents), LATERAL unnest(range(1, len(lines) + 1)) AS u(pos)) GROUP BY doc_id"""


@check("list_spacing", _SPACED)
def list_spacing(spark, sf):
    """Document lines, every second turned into a list item."""
    lined = F.array_join(F.transform(F.split("text", "\n"), lambda l, i: F.when(
        i % 2 == 1, F.concat(F.lit("- "), l)).otherwise(l)), "\n")
    return fx.table(spark, sf, "documents").select("doc_id", text.list_spacing(lined).alias("spaced"))


_CAT_TERMS = "(SELECT c.*, " + fx.tokens("c.title") + " AS terms FROM catalog c)"


@check("keyword_score", fx.select(f"""
    SELECT c.doc_id, CAST(k.chunk_index AS BIGINT) AS chunk_index, round({fx.keyword_sql(
        'c.terms', 'lower(c.path)', 'lower(c.path)', "lower(array_to_string(c.entities, ' '))", 'lower(k.content)')}, 6) AS score
    FROM (SELECT *, {fx.distinct_list(fx.tokens('title'))} AS terms FROM catalog) c JOIN chunks k ON k.doc_id = c.doc_id""",
    "catalog", "chunks"))
def keyword_score(spark, sf):
    """Every chunk scored for the title of its document (with the path as title)."""
    cat = fx.catalog(spark, sf).select(
        "doc_id", text.keyword_terms(F.col("title")).alias("terms"), F.lower("path").alias("p"),
        F.lower(F.array_join("entities", " ")).alias("e"))
    score = scoring.keyword_score(F.col("terms"), F.col("p"), F.col("p"), F.col("e"), F.lower("content"))
    return fx.chunks(spark, sf).join(cat, "doc_id").select(
        "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.round(score, 6).alias("score"))


@check("structure_score", fx.select("""
    SELECT doc_id, CASE WHEN q = lower(doc_id) THEN 10.0 WHEN q <> '' AND q = lower(title) THEN 8.0
      WHEN q <> '' AND contains(lower(title), q) THEN 5.0 WHEN q <> '' AND contains(lower(path), q) THEN 3.0
      WHEN list_contains(ents, q) THEN 8.5
      WHEN q <> '' AND len(list_filter(ents, lambda en: contains(q, en))) > 0 THEN 6.0
      WHEN q <> '' AND len(list_filter(ents, lambda en: contains(en, q))) > 0 THEN 4.0
      WHEN q = '' THEN 1.0 ELSE 0.0 END::DOUBLE AS score
    FROM (SELECT *, list_transform(entities, lambda en: lower(en)) AS ents, lower(CASE length(title) % 8
      WHEN 0 THEN doc_id WHEN 1 THEN title WHEN 2 THEN substr(title, 2, 5) WHEN 3 THEN path
      WHEN 4 THEN coalesce(entities[1], '-') WHEN 5 THEN 'see ' || coalesce(entities[1], '-') || ' first'
      WHEN 6 THEN coalesce(substr(entities[1], 3, 6), '-') ELSE '' END) AS q FROM catalog)""", "catalog"))
def structure_score(spark, sf):
    first = F.coalesce(F.get("entities", F.lit(0)), F.lit("-"))
    inner = F.coalesce(F.substring(F.get("entities", F.lit(0)), 3, 6), F.lit("-"))
    pick = F.length("title") % 8
    query = F.lower(
        F.when(pick == 0, F.col("doc_id")).when(pick == 1, F.col("title"))
        .when(pick == 2, F.substring("title", 2, 5)).when(pick == 3, F.col("path")).when(pick == 4, first)
        .when(pick == 5, F.concat(F.lit("see "), first, F.lit(" first"))).when(pick == 6, inner).otherwise(""))
    cat = fx.catalog(spark, sf).withColumn("q", query)
    return cat.select("doc_id", scoring.structure_score(
        F.col("q"), F.lower("doc_id"), F.lower("title"), F.lower("path"),
        F.transform("entities", F.lower)).alias("score"))


@check("normalize_score", """
    SELECT event_id, channel, round(CASE WHEN channel = 'vector' THEN value
      WHEN channel = 'graph' THEN least(greatest(value, 0.0), 1.0) ELSE least(value / 10.0, 1.0) END, 6) AS score
    FROM (SELECT event_id, value, CASE event_id % 4 WHEN 0 THEN 'vector' WHEN 1 THEN 'graph' WHEN 2 THEN 'keyword'
      ELSE 'vector+neighbor' END AS channel FROM events)""")
def normalize_score(spark, sf):
    pick = F.col("event_id") % 4
    channel = (F.when(pick == 0, "vector").when(pick == 1, "graph").when(pick == 2, "keyword")
               .otherwise("vector+neighbor"))
    return fx.table(spark, sf, "events").select("event_id", "value", channel.alias("channel")).select(
        "event_id", "channel", F.round(scoring.normalize_score(F.col("channel"), F.col("value")), 6).alias("score"))


@check("metadata_normalize", r"""
    SELECT doc_id, array_to_string(list_filter(vals, lambda el, ix: list_position(keys,
        regexp_replace(lower(el), '[\s_-]+', '', 'g')) = ix)[1:32], '|') AS "values" FROM (
      SELECT doc_id, vals, list_transform(vals, lambda vl: regexp_replace(lower(vl), '[\s_-]+', '', 'g')) AS keys FROM (
        SELECT doc_id, list_filter(list_transform(regexp_split_to_array(raw, '[，,、;；|]+'), lambda vl:
          trim(regexp_replace(regexp_replace(trim(vl, ' ' || chr(9) || '`*_"''“”‘’'), '^#+\s*', ''), '\s+', ' ', 'g'))),
          lambda vl: length(vl) <= 120 AND regexp_matches(vl, '[\p{L}\p{N}]')
            AND regexp_replace(lower(vl), '[\s_-]+', '', 'g') <> '') AS vals
        FROM (SELECT doc_id, replace(replace(text, chr(10), '; '), '.', ' | ') AS raw FROM documents)))""")
def metadata_normalize(spark, sf):
    """Sentences and lines of every text as a list of values."""
    raw = F.replace(F.replace("text", F.lit("\n"), F.lit("; ")), F.lit("."), F.lit(" | "))
    return fx.table(spark, sf, "documents").select("doc_id", F.array_join(
        metadata.normalize_values(F.array(raw)), "|").alias("values"))


@check("override_flag", """
    SELECT event_id, lower(trim(CASE event_id % 7 WHEN 0 THEN 'True' WHEN 1 THEN '1' WHEN 2 THEN ' yes ' WHEN 3 THEN 'on'
      WHEN 4 THEN 'false' WHEN 5 THEN event_type ELSE '' END)) IN ('1', 'true', 'yes', 'on') AS enabled FROM events""")
def override_flag(spark, sf):
    pick = F.col("event_id") % 7
    raw = (F.when(pick == 0, "True").when(pick == 1, "1").when(pick == 2, " yes ").when(pick == 3, "on")
           .when(pick == 4, "false").when(pick == 5, F.col("event_type")).otherwise(""))
    return fx.table(spark, sf, "events").select("event_id", metadata.override_flag(raw).alias("enabled"))


_URL_PATH = "regexp_extract(url, '^https?://(.*)$', 1)"


@check("path_normalize", f"""
    SELECT page_id, array_to_string(list_filter(string_split(trim('/' || {_URL_PATH} || '/../x/', '/'), '/'),
        lambda sg: sg <> '' AND sg <> '..'), '/') AS catalog_path,
      trim('/' || {_URL_PATH} || '/../x/', '/') AS access_path FROM pages""")
def path_normalize(spark, sf):
    raw = F.concat(F.lit("/"), F.regexp_extract("url", "^https?://(.*)$", 1), F.lit("\\..//x/"))
    slashed = F.concat(F.lit("/"), F.regexp_extract("url", "^https?://(.*)$", 1), F.lit("/../x/"))
    return fx.table(spark, sf, "pages").select(
        "page_id", paths.path_normalize(raw).alias("catalog_path"), paths.access_path(slashed).alias("access_path"))


@check("breadcrumbs", f"""
    SELECT page_id, parts[lv] AS name, array_to_string(parts[1:lv], '/') AS path FROM (
      SELECT page_id, list_filter(string_split({_URL_PATH}, '/'), lambda sg: sg <> '') AS parts FROM pages),
      LATERAL unnest(range(1, len(parts) + 1)) AS u(lv)""")
def breadcrumbs(spark, sf):
    path = F.regexp_extract("url", "^https?://(.*)$", 1)
    return fx.table(spark, sf, "pages").select(
        "page_id", F.explode(paths.breadcrumbs(path)).alias("b")).select("page_id", "b.name", "b.path")


@check("parse_list_field", """
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type || '|' || 'a/b' || '|' ELSE event_type || '|' || 'a/b' END AS paths,
      CASE event_id % 3 WHEN 0 THEN 'x|y' WHEN 1 THEN 'write' ELSE 'read' END AS scope,
      event_type || '|t' AS tags FROM events""")
def parse_list_field(spark, sf):
    pick = F.col("event_id") % 3
    kind = F.col("event_type")
    raw_paths = F.when(pick == 0, F.concat(F.lit('["/'), kind, F.lit('/", "a\\\\b", ""]'))).otherwise(
        F.concat(kind, F.lit("/, ,/a/b,")))
    raw_scope = F.when(pick == 0, '["x","y"]').when(pick == 1, '"write"').otherwise("")
    return fx.table(spark, sf, "events").select(
        "event_id", F.array_join(paths.parse_allowed_paths(raw_paths), "|").alias("paths"),
        F.array_join(paths.parse_scope(raw_scope), "|").alias("scope"),
        F.array_join(paths.parse_tag_param(F.concat(kind, F.lit("， ,t"))), "|").alias("tags"))


_BASE = "regexp_extract(url, '([^/]*)$', 1)"


@check("filename_title", rf"""
    SELECT page_id, CASE WHEN stem = '' THEN '未命名文档' ELSE stem END AS title,
      CASE WHEN base = '' THEN 'base' ELSE 'base/' || base END AS merged FROM (
      SELECT page_id, base, CASE WHEN regexp_matches(base, '^\.*[^.].*\.[^.]*$')
        THEN regexp_replace(base, '\.[^.]*$', '') ELSE base END AS stem
      FROM (SELECT page_id, {_BASE} AS base FROM pages))""")
def filename_title(spark, sf):
    return fx.table(spark, sf, "pages").select(
        "page_id", paths.filename_title(F.col("url")).alias("title"),
        paths.merge_upload_path(F.lit("base"), F.regexp_extract("url", "([^/]*)$", 1)).alias("merged"))


# ---------------------------------------------------------------------------- filters

_DOC = "doc_id, title, path"


@check("filter_path_exact", fx.select(f"SELECT {_DOC} FROM catalog WHERE path = 'en/src1'", "catalog"))
def filter_path_exact(spark, sf):
    return filters.in_directory(fx.catalog(spark, sf), "en/src1").select("doc_id", "title", "path")


@check("filter_path_subtree", fx.select(f"""
    SELECT {_DOC} FROM catalog WHERE path IN ('fr', 'en/src2') OR starts_with(path, 'fr/')
      OR starts_with(path, 'en/src2/')""", "catalog"))
def filter_path_subtree(spark, sf):
    wanted = spark.createDataFrame([("fr",), ("en/src2",), ("e",)], "prefix string")
    return filters.in_subtrees(fx.catalog(spark, sf), wanted).select("doc_id", "title", "path")


@check("filter_tags_any", fx.select(
    f"SELECT {_DOC} FROM catalog WHERE list_has_any(tags, ['quality', 'src1'])", "catalog"))
def filter_tags_any(spark, sf):
    return filters.with_any_tag(fx.catalog(spark, sf), ["quality", "src1"]).select("doc_id", "title", "path")


@check("filter_text_q", fx.select(f"""
    SELECT {_DOC} FROM catalog WHERE contains(lower(title), 'ing') OR contains(lower(path), 'ing')
      OR len(list_filter(tags, lambda tg: contains(lower(tg), 'ing'))) > 0""", "catalog"))
def filter_text_q(spark, sf):
    return filters.with_text(fx.catalog(spark, sf), " ING ").select("doc_id", "title", "path")


def _with_status(catalog):
    return catalog.withColumn("write_status", F.when(
        F.array_contains("tags", "quality"), "updating").when(F.length("title") % 2 == 0, "ready"))


@check("filter_visible", fx.select(
    f"SELECT {_DOC} FROM catalog WHERE NOT list_contains(tags, 'quality')", "catalog"))
def filter_visible(spark, sf):
    return filters.visible(_with_status(fx.catalog(spark, sf))).select("doc_id", "title", "path")


GRANTS = [
    ("everyone", "all", []), ("root", "restricted", ["", "de"]), ("none", "restricted", []),
    ("french", "restricted", ["/fr/"]), ("two", "restricted", ["en/src1", "en/src2", "en"]),
    ("partial", "restricted", ["en/src"]),
]
_GRANT_SQL = ", ".join(
    f"('{p}', '{m}', CAST([{', '.join(repr(x.strip('/')) for x in a)}] AS VARCHAR[]))" for p, m, a in GRANTS)


@check("acl_filter", fx.select(f"""
    SELECT g.principal, c.doc_id FROM catalog c, (VALUES {_GRANT_SQL}) g(principal, path_mode, allowed)
    WHERE g.path_mode = 'all' OR len(list_filter(g.allowed, lambda al: al = '' OR c.path = al
      OR starts_with(c.path, al || '/'))) > 0""", "catalog"))
def acl_filter(spark, sf):
    grants = spark.createDataFrame(GRANTS, "principal string, path_mode string, allowed_paths array<string>")
    return filters.readable(fx.catalog(spark, sf), grants).select("principal", "doc_id")


def audit(spark, sf):
    return fx.table(spark, sf, "events").select(
        F.concat(F.lit("audit-"), "event_id").alias("id"), F.col("ts").alias("timestamp"),
        F.lit("api_key").alias("actor_type"), F.concat(F.lit("user-"), "user_id").alias("actor"),
        F.col("event_type").alias("action"), F.lit("document").alias("target_type"),
        F.col("user_id").cast("string").alias("target_id"), F.lit("").alias("path"),
        (F.col("event_type") != "error").alias("success"),
        F.from_json("props", "map<string,string>").alias("detail"))


@check("audit_filter", """
    SELECT 'audit-' || event_id AS id, event_type AS action, 'user-' || user_id AS actor FROM events
    WHERE event_type = 'click' AND contains('user-' || user_id, '1')""")
def audit_filter(spark, sf):
    return filters.audit_matches(
        audit(spark, sf), action="click", actor="1", target_type="document", success=True
    ).select("id", "action", "actor")


@check("request_validate", """
    SELECT doc_id, array_to_string(list_filter([
      CASE WHEN length(title) NOT BETWEEN 1 AND 500 THEN 'title' END,
      CASE WHEN length(content) NOT BETWEEN 1 AND 10485760 THEN 'content' END,
      CASE WHEN length(path) > 500 THEN 'path' END, CASE WHEN top_k NOT BETWEEN 1 AND 20 THEN 'top_k' END,
      CASE WHEN strategy NOT IN ('title_path', 'hash', 'semantic') THEN 'match_strategy' END,
      CASE WHEN policy NOT IN ('update', 'skip', 'create_new') THEN 'on_conflict' END], lambda pb: pb IS NOT NULL), ',') AS problems
    FROM (SELECT doc_id, regexp_extract(text, '[A-Z][a-z]{9,}') AS title, text AS content,
      repeat(source, CAST(n_chars AS BIGINT) // 40) AS path, n_chars % 30 AS top_k,
      CASE WHEN lang = 'en' THEN 'hash' ELSE lang END AS strategy, CASE WHEN lang = 'fr' THEN 'merge' ELSE 'skip' END AS policy
      FROM documents)""")
def request_validate(spark, sf):
    docs = fx.table(spark, sf, "documents").select(
        "doc_id", F.regexp_extract("text", "([A-Z][a-z]{9,})", 1).alias("title"), F.col("text").alias("content"),
        F.expr("repeat(source, cast(n_chars div 40 as int))").alias("path"), (F.col("n_chars") % 30).alias("top_k"),
        F.when(F.col("lang") == "en", "hash").otherwise(F.col("lang")).alias("match_strategy"),
        F.when(F.col("lang") == "fr", "merge").otherwise("skip").alias("on_conflict"))
    return docs.select("doc_id", F.array_join(filters.request_verdict(max_top_k=20), ",").alias("problems"))


@check("redact_payload", """
    SELECT conv_id, turn, role, '[redacted]' AS content, length(text) AS content_length FROM conversations""")
def redact_payload(spark, sf):
    talks = fx.table(spark, sf, "conversations").withColumnRenamed("text", "content")
    return filters.redact(talks, "content").withColumn("content_length", F.col("content_length").cast("long"))


@check("hit_projection", fx.select("""
    SELECT query_id, doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, round(final_score, 4) AS score,
      round(raw_score, 4) AS raw_score, path || ':' || title || '#chunk-' || chunk_index AS citation
    FROM (SELECT k.query_id, k.doc_id, k.chunk_index, k.raw_score, least(k.raw_score / 10.0, 1.0) AS final_score, c.title, c.path
      FROM q_keyword k JOIN catalog c ON c.doc_id = k.doc_id)""", "q_keyword", "catalog"))
def hit_projection(spark, sf):
    from lorespark.checks.retrieval_checks import indexed

    cat, _, index = indexed(spark, sf)
    found = rt.keyword_channel(rt.rewrite_queries(fx.queries(spark, sf)), index, cat)
    hits = found.join(cat.select("doc_id", "title", "path"), "doc_id").withColumn(
        "final_score", scoring.normalize_score(F.col("channel"), F.col("raw_score")))
    return rt.present_hits(hits).select(
        "query_id", "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "score", "raw_score", "citation")


def grants(spark, sf):
    """One grant per user, from the first event on, with a duration and a stored status."""
    first = fx.table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("created_at"))
    pick = F.col("user_id") % 4
    duration = F.when(pick == 0, "permanent").when(pick == 1, "30d").when(pick == 2, "7d").otherwise("odd")
    return first.withColumn("duration", duration).select(
        F.col("user_id").cast("string").alias("key_hash"), "created_at", "duration",
        filters.expiry(F.col("created_at"), F.col("duration")).alias("expires_at"),
        F.when(F.col("user_id") % 10 == 9, "revoked").otherwise("active").alias("stored"))


fx.define("grants", [], """
    SELECT CAST(user_id AS VARCHAR) AS key_hash, created_at, CASE user_id % 4 WHEN 0 THEN NULL
        WHEN 1 THEN created_at + INTERVAL 30 DAY ELSE created_at + INTERVAL 7 DAY END AS expires_at,
      CASE WHEN user_id % 10 = 9 THEN 'revoked' ELSE 'active' END AS stored, TIMESTAMP '2024-01-15 12:00:00' AS as_of
    FROM (SELECT user_id, min(ts) AS created_at FROM events GROUP BY user_id)""")
AS_OF = "2024-01-15 12:00:00"
EFFECTIVE_SQL = "CASE WHEN stored = 'active' AND expires_at < as_of THEN 'expired' ELSE stored END"


@check("grant_effective_status", fx.select(f"""
    SELECT key_hash, {fx.stamp('expires_at')} AS expires_at, {EFFECTIVE_SQL} AS status FROM grants""", "grants"))
def grant_effective_status(spark, sf):
    stored = grants(spark, sf).withColumnRenamed("stored", "status")
    return stored.select(
        "key_hash", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss").alias("expires_at"),
        filters.effective_status(F.lit(AS_OF).cast("timestamp")).alias("status"))


@check("source_path_build", fx.select("SELECT doc_id, source_path FROM sources", "sources"))
def source_path_build(spark, sf):
    cat = fx.catalog(spark, sf)
    odd = F.concat(F.lit("/"), F.replace("path", F.lit("/"), F.lit("\\")), F.lit("/"))
    return cat.select("doc_id", paths.source_path(F.col("doc_id"), odd).alias("source_path"))


@check("upload_type_filter", r"""
    SELECT page_id, CASE WHEN ext IN ('.md', '.csv') THEN 'accepted' ELSE 'skipped' END AS status FROM (
      SELECT page_id, CASE WHEN url LIKE '%/' THEN '' ELSE CASE length(url) % 4 WHEN 0 THEN '.md' WHEN 1 THEN '.csv' WHEN 2 THEN '.html' ELSE '' END END AS ext FROM pages)""")
def upload_type_filter(spark, sf):
    pick = F.length("url") % 4
    name = F.concat(F.regexp_replace("url", r"[.?#]", "_"), F.when(pick == 0, ".MD").when(
        pick == 1, ".Csv").when(pick == 2, ".html").otherwise(""))
    files = fx.table(spark, sf, "pages").withColumn("filename", name)
    verdict = filters.upload_verdict(F.col("filename"), paths.is_supported_upload(F.col("filename")))
    return files.select("page_id", verdict["status"].alias("status"))


# ------------------------------------------------------------------- Markdown documents


def md_docs(spark, sf):
    """Catalog rows as Markdown with a header block; every line is a paragraph."""
    cat = fx.catalog(spark, sf)
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "lang", "source", "text")
    head = F.concat(
        F.lit("# "), "title", F.lit("\n\n> 标签："), "lang", F.lit("、"), "source", F.lit("\nCore Entities: "),
        F.array_join("entities", ", "), F.lit("\n\n## Body\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return cat.join(docs, "doc_id").select("doc_id", "title", "path", F.array("source").alias("tags"), head.alias("content"))


fx.define("md_docs", ["catalog"], """
    SELECT c.doc_id, c.title, c.path, [d.source] AS tags, d.lang, d.source, c.entities,
      '# ' || c.title || chr(10) || chr(10) || '> 标签：' || d.lang || '、' || d.source || chr(10) || 'Core Entities: '
      || array_to_string(c.entities, ', ') || chr(10) || chr(10) || '## Body' || chr(10) || chr(10)
      || replace(d.text, chr(10), chr(10) || chr(10)) AS content
    FROM catalog c JOIN documents d ON CAST(d.doc_id AS VARCHAR) = c.doc_id""")
fx.define("md_paras", ["md_docs"], r"""
    SELECT doc_id, pos, paras[pos] AS para, sum(CASE WHEN pos = 1 OR regexp_matches(paras[pos], '^#{1,6}\s') THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS section_no
    FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(content,
        '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'), '\n\n+'), lambda pg: regexp_replace(pg, '^\s+|\s+$', '', 'g')),
        lambda pg: pg <> '') AS paras FROM md_docs), LATERAL unnest(range(1, len(paras) + 1)) AS u(pos)""")
fx.define("md_sections", ["md_paras"], r"""
    SELECT doc_id, CAST(section_no AS BIGINT) AS section_no,
      CASE WHEN regexp_matches(first(para ORDER BY pos), '^#{1,6}\s') THEN first(para ORDER BY pos) ELSE '' END AS heading,
      string_agg(para, chr(10) || chr(10) ORDER BY pos) AS section_text FROM md_paras GROUP BY doc_id, section_no""")


@check("section_split", fx.select("""
    SELECT *, CAST(greatest(1, ceil(length(section_text) / 358.0::DOUBLE)) AS BIGINT) AS total_parts FROM md_sections""",
    "md_sections"))
def section_split(spark, sf):
    rows = chunking.split_sections(md_docs(spark, sf).select("doc_id", "content"))
    return rows.withColumn("section_no", F.col("section_no").cast("long")).withColumn(
        "total_parts", F.col("total_parts").cast("long"))


# The packing of a section as a fold over its operations: add a paragraph or an item,
# emit a window, close a part.
fx.define("md_ops", ["md_paras"], r"""
    SELECT doc_id, section_no, list({'kind': kind, 'txt': txt, 'glue': glue} ORDER BY pos, ord, w) AS ops FROM (
      SELECT doc_id, section_no, pos, 0 AS ord, 0 AS w, 'para' AS kind, para AS txt, chr(10) || chr(10) AS glue
        FROM md_paras WHERE length(para) <= 512
      UNION ALL SELECT doc_id, section_no, pos, 0, 0, 'close', '', '' FROM md_paras WHERE length(para) > 512
      UNION ALL SELECT doc_id, section_no, pos, 1000000, 0, 'flush', '', '' FROM md_paras WHERE length(para) > 512
      UNION ALL SELECT doc_id, section_no, pos, ord, w, CASE WHEN n = 0 THEN 'item' WHEN w < n THEN 'window' ELSE 'tail' END,
          CASE WHEN w < n THEN substr(item, w * 462 + 1, 512) ELSE substr(item, w * 462 + 1) END,
          CASE WHEN contains(para, '|') THEN chr(10) ELSE ' ' END
        FROM (SELECT *, CAST(greatest(ceil((length(item) - 512) / 462.0::DOUBLE), 0) AS BIGINT) AS n FROM (
          SELECT doc_id, section_no, pos, para, ord, regexp_replace(items[ord], '^\s+|\s+$', '', 'g') AS item FROM (
            SELECT *, CASE WHEN starts_with(para, '|') THEN string_split(para, chr(10))
              ELSE string_split(regexp_replace(para, '([。！？.!?])\s+', '\1' || chr(1), 'g'), chr(1)) END AS items
            FROM md_paras WHERE length(para) > 512), LATERAL unnest(range(1, len(items) + 1)) AS u(ord)) WHERE item <> ''),
        LATERAL unnest(range(0, n + 1)) AS v(w))
    GROUP BY doc_id, section_no""")
_STEP = """list_reduce(ops, lambda st, op: CASE
    WHEN op.kind IN ('para', 'item') AND (st.held = '' OR length(JOINED) <= 512)
      THEN {'held': CASE WHEN st.held = '' THEN op.txt ELSE JOINED END, 'parts': st.parts}
    WHEN op.kind IN ('para', 'item') THEN {'held': op.txt, 'parts': list_append(st.parts, st.held)}
    WHEN op.kind = 'window' THEN {'held': '', 'parts': list_append(
      CASE WHEN st.held = '' THEN st.parts ELSE list_append(st.parts, st.held) END, op.txt)}
    WHEN op.kind = 'tail' THEN {'held': op.txt, 'parts': st.parts}
    WHEN op.kind = 'close' THEN {'held': '', 'parts': list_append(st.parts, st.held)}
    ELSE {'held': '', 'parts': CASE WHEN st.held = '' THEN st.parts ELSE list_append(st.parts, st.held) END} END,
    {'held': '', 'parts': CAST([] AS VARCHAR[])})""".replace(
    "JOINED", r"regexp_replace(st.held || op.glue || op.txt, '^\s+|\s+$', '', 'g')")
fx.define("md_packed", ["md_ops", "md_sections"], f"""
    SELECT doc_id, section_no, heading, section_text,
      CASE WHEN length(section_text) <= 512 THEN [section_text]
        WHEN st.held <> '' THEN list_append(st.parts, st.held) ELSE st.parts END AS parts
    FROM (SELECT s.*, {_STEP} AS st FROM md_sections s JOIN md_ops o ON o.doc_id = s.doc_id AND o.section_no = s.section_no)""")
fx.define("md_chunks", ["md_packed"], r"""
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section_no, part) - 1 AS chunk_index,
      count(*) OVER (PARTITION BY doc_id) AS total_chunks, content FROM (
      SELECT doc_id, section_no, part, regexp_replace(CASE WHEN part > 0 AND heading <> '' THEN '> ' ||
          CASE WHEN regexp_matches(heading, '^#{1,6}\s+.+$') THEN trim(regexp_replace(trim(regexp_extract(heading,
            '^#{1,6}\s+(.+)$', 1)), '\s*[（(][^）)]*[）)]\s*$', '')) ELSE heading END
          || '（' || part || '/' || CAST(greatest(1, ceil(length(section_text) / 358.0::DOUBLE)) AS BIGINT) || '）'
          || chr(10) || chr(10) ELSE '' END || parts[part + 1], '^\s+|\s+$', '', 'g') AS content
      FROM md_packed, LATERAL unnest(range(0, len(parts))) AS u(part)) WHERE content <> ''""")


@check("chunk_markdown", fx.select("""
    SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, CAST(total_chunks AS BIGINT) AS total_chunks, content
    FROM md_chunks""", "md_chunks"))
def chunk_markdown(spark, sf):
    chunked = chunking.with_chunks(md_docs(spark, sf).select("doc_id", "content"))
    return chunking.chunk_rows(chunked).withColumn("chunk_index", F.col("chunk_index").cast("long")).withColumn(
        "total_chunks", F.col("total_chunks").cast("long"))


@check("header_metadata", fx.select("""
    SELECT doc_id, lang || '|' || source AS header_tags, array_to_string(entities, '|') AS header_entities
    FROM md_docs""", "md_docs"))
def header_metadata(spark, sf):
    return metadata.with_header(md_docs(spark, sf)).select(
        "doc_id", F.array_join("header_tags", "|").alias("header_tags"),
        F.array_join("header_entities", "|").alias("header_entities"))
