"""Checked queries of the retrieval operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark.checks import fixtures as fx
from lorespark.checks.registry import check
from lorespark.operators import retrieval as rt
from lorespark.operators.joins import materialize


def corpus(spark, sf):
    """Catalog, chunks and postings as tables at rest, which is how they are searched."""
    cat, chk = materialize(fx.catalog(spark, sf)), materialize(fx.chunks(spark, sf))
    return cat, chk, materialize(rt.build_postings(cat, chk))


def indexed(spark, sf):
    """Catalog, chunks and the keyword index over them."""
    cat, chk, postings = corpus(spark, sf)
    return cat, chk, rt.keyword_index(postings)


def _keyword_ctes(prefix: str, queries: str) -> list[str]:
    """Recall and scoring CTEs over the CTE ``queries``."""
    fx.define(f"{prefix}_terms", [queries], f"""
        SELECT query_id, top_k, filter_path, filter_tags, {fx.tokens('text')} AS terms FROM {queries}""")
    fx.define(f"{prefix}_recall", [f"{prefix}_terms", "postings", "catalog"], f"""
        SELECT DISTINCT t.query_id, p.doc_id, p.chunk_index
        FROM (SELECT *, unnest(terms) AS term FROM {prefix}_terms) t
        JOIN postings p ON p.term = t.term JOIN catalog c ON c.doc_id = p.doc_id
        WHERE (t.filter_path = '' OR c.path = t.filter_path)
          AND (len(t.filter_tags) = 0 OR list_has_any(t.filter_tags, c.tags))""")
    # Points are found for every term once, by looking into whole texts and fields.
    fx.define(f"{prefix}_asked", [f"{prefix}_terms"], f"""
        SELECT query_id, unnest(terms) AS term FROM {prefix}_terms""")
    fx.define(f"{prefix}_text_points", [f"{prefix}_asked", "chunks"], f"""
        SELECT term, doc_id, chunk_index, CAST(least({fx.count_in('content_lc', 'term')}, 5) AS DOUBLE) AS points
        FROM (SELECT DISTINCT term FROM {prefix}_asked)
        JOIN (SELECT doc_id, chunk_index, lower(content) AS content_lc FROM chunks) ON contains(content_lc, term)""")
    fx.define(f"{prefix}_field_points", [f"{prefix}_asked", "lowered"], f"""
        SELECT term, doc_id, CAST((CASE WHEN contains(title_lc, term) THEN 3.0 ELSE 0.0 END)
          + (CASE WHEN contains(path_lc, term) THEN 1.5 ELSE 0.0 END)
          + (CASE WHEN contains(entities_lc, term) THEN 3.5 ELSE 0.0 END) AS DOUBLE) AS points
        FROM (SELECT DISTINCT term FROM {prefix}_asked) JOIN lowered
          ON contains(title_lc, term) OR contains(path_lc, term) OR contains(entities_lc, term)""")
    fx.define(f"{prefix}_scores", [f"{prefix}_text_points", f"{prefix}_field_points"], f"""
        SELECT query_id, doc_id, chunk_index, sum(points) AS raw_score FROM (
          SELECT query_id, doc_id, chunk_index, points FROM {prefix}_asked JOIN {prefix}_text_points USING (term)
          UNION ALL SELECT query_id, k.doc_id, k.chunk_index, points
          FROM {prefix}_asked JOIN {prefix}_field_points f USING (term) JOIN chunks k ON k.doc_id = f.doc_id)
        GROUP BY ALL""")
    fx.define(f"{prefix}_keyword", [f"{prefix}_recall", f"{prefix}_scores"], f"""
        SELECT query_id, doc_id, chunk_index, 'keyword' AS channel, raw_score FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id
            ORDER BY raw_score DESC, doc_id, chunk_index) AS rn FROM (
            SELECT r.query_id, r.doc_id, r.chunk_index, t.top_k, s.raw_score
            FROM {prefix}_recall r JOIN {prefix}_scores s USING (query_id, doc_id, chunk_index)
            JOIN {prefix}_terms t ON t.query_id = r.query_id) WHERE raw_score > 0)
        WHERE rn <= top_k""")


_keyword_ctes("q", "queries")
_keyword_ctes("f", "filtered_queries")

_CANDIDATES = "SELECT query_id, doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, channel, round(raw_score, 6) AS raw_score FROM "


def show(candidates):
    return candidates.select(
        "query_id", "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "channel",
        F.round("raw_score", 6).alias("raw_score"),
    )


@check("postings_build", fx.select(
    "SELECT term, doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, tf, fields FROM postings", "postings"))
def postings_build(spark, sf):
    postings = rt.build_postings(fx.catalog(spark, sf), fx.chunks(spark, sf))
    return postings.withColumn("chunk_index", F.col("chunk_index").cast("long"))


@check("keyword_recall", fx.select(
    "SELECT query_id, doc_id, CAST(chunk_index AS BIGINT) AS chunk_index FROM f_recall", "f_recall"))
def keyword_recall(spark, sf):
    cat, _, index = indexed(spark, sf)
    queries = rt.rewrite_queries(fx.filtered_queries(spark, sf))
    return rt.keyword_recall(queries, index, cat).withColumn(
        "chunk_index", F.col("chunk_index").cast("long"))


@check("keyword_channel", fx.select(_CANDIDATES + "q_keyword", "q_keyword"))
def keyword_channel(spark, sf):
    cat, _, index = indexed(spark, sf)
    return show(rt.keyword_channel(rt.rewrite_queries(fx.queries(spark, sf)), index, cat))


@check("keyword_channel_filtered", fx.select(_CANDIDATES + "f_keyword", "f_keyword"))
def keyword_channel_filtered(spark, sf):
    cat, _, index = indexed(spark, sf)
    return show(rt.keyword_channel(rt.rewrite_queries(fx.filtered_queries(spark, sf)), index, cat))


@check("keyword_scan_channel", fx.select("""
    SELECT query_id, doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, 'keyword' AS channel,
      round(raw_score, 6) AS raw_score FROM (
      SELECT s.*, t.top_k, row_number() OVER (PARTITION BY query_id
        ORDER BY raw_score DESC, doc_id, chunk_index) AS rn
      FROM q_scores s JOIN q_terms t USING (query_id) WHERE raw_score > 0)
    WHERE rn <= top_k""", "q_terms", "q_scores"))
def keyword_scan_channel(spark, sf):
    cat, _, index = indexed(spark, sf)
    return show(rt.keyword_scan_channel(rt.rewrite_queries(fx.queries(spark, sf)), index, cat))


def _structure_cte(prefix: str, queries: str) -> None:
    fx.define(f"{prefix}_structure", [queries, "catalog", "chunks"], f"""
        SELECT query_id, doc_id, chunk_index, 'structure' AS channel, raw_score FROM (
          SELECT s.*, k.chunk_index, row_number() OVER (PARTITION BY query_id
            ORDER BY raw_score DESC, s.doc_id) AS rn FROM (
            SELECT q.query_id, q.top_k, c.doc_id, CASE
              WHEN q.text = lower(c.doc_id) THEN 10.0
              WHEN q.text <> '' AND q.text = lower(c.title) THEN 8.0
              WHEN q.text <> '' AND contains(lower(c.title), q.text) THEN 5.0
              WHEN q.text <> '' AND contains(lower(c.path), q.text) THEN 3.0
              WHEN list_contains(ents, q.text) THEN 8.5
              WHEN q.text <> '' AND len(list_filter(ents, lambda en: contains(q.text, en))) > 0 THEN 6.0
              WHEN q.text <> '' AND len(list_filter(ents, lambda en: contains(en, q.text))) > 0 THEN 4.0
              WHEN q.text = '' THEN 1.0 ELSE 0.0 END AS raw_score
            FROM {queries} q, (SELECT *, list_transform(entities, lambda en: lower(en)) AS ents FROM catalog) c
            WHERE (q.filter_path = '' OR c.path = q.filter_path)
              AND (len(q.filter_tags) = 0 OR list_has_any(q.filter_tags, c.tags))
              AND (q.text <> '' OR q.filter_path <> '' OR len(q.filter_tags) > 0)) s
          JOIN (SELECT doc_id, min(chunk_index) AS chunk_index FROM chunks GROUP BY doc_id) k
            ON k.doc_id = s.doc_id
          WHERE raw_score > 0) WHERE rn <= top_k""")


_structure_cte("q", "queries")
_structure_cte("f", "filtered_queries")
_structure_cte("t", "title_queries")


@check("structure_channel", fx.select(_CANDIDATES + "t_structure", "t_structure"))
def structure_channel(spark, sf):
    queries = rt.rewrite_queries(fx.title_queries(spark, sf))
    return show(rt.structure_channel(queries, fx.catalog(spark, sf), fx.chunks(spark, sf)))


@check("structure_channel_filtered", fx.select(_CANDIDATES + "f_structure", "f_structure"))
def structure_channel_filtered(spark, sf):
    queries = rt.rewrite_queries(fx.filtered_queries(spark, sf))
    return show(rt.structure_channel(queries, fx.catalog(spark, sf), fx.chunks(spark, sf)))
