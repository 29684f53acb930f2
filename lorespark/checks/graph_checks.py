"""Checked queries of the vector, graph and hybrid operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorespark.checks import fixtures as fx
from lorespark.checks.registry import check
from lorespark.checks.retrieval_checks import _CANDIDATES, indexed, show
from lorespark.operators import graph, joins
from lorespark.operators import retrieval as rt
from lorespark.operators.vectors import semantic_pairs, vector_channel, vector_channel_coded, vector_codes
from lorespark.plans.graph_build import build_graph
from lorespark.plans.hybrid import Corpus, channel_union, hybrid_search

THRESHOLD = 0.40


def _vector_cte(name: str, queries: str) -> None:
    fx.define(name, [queries, "query_vectors", "vectors", "catalog"], f"""
        SELECT query_id, doc_id, chunk_index, 'vector' AS channel, raw_score FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id
            ORDER BY raw_score DESC, doc_id, chunk_index) AS rn FROM (
            SELECT q.query_id, q.top_k, v.doc_id, v.chunk_index,
              round(list_cosine_similarity(e.embedding, v.embedding), 9) AS raw_score
            FROM {queries} q JOIN query_vectors e ON e.query_id = q.query_id, vectors v
            JOIN catalog c ON c.doc_id = v.doc_id
            WHERE (q.filter_path = '' OR c.path = q.filter_path)
              AND (len(q.filter_tags) = 0 OR list_has_any(q.filter_tags, c.tags))))
        WHERE rn <= top_k""")


fx.define("all_vector_queries", [], """
    SELECT vec_id AS query_id, 5 AS top_k, '' AS filter_path, CAST([] AS VARCHAR[]) AS filter_tags
    FROM embeddings""")
_vector_cte("a_vector", "all_vector_queries")
_vector_cte("q_vector", "queries")
_vector_cte("f_vector", "filtered_queries")


@check("vector_channel", fx.select(_CANDIDATES + "a_vector", "a_vector"))
def vector_search(spark, sf):
    """Every embedding looks for its nearest documents."""
    queries = rt.rewrite_queries(
        fx.query_vectors(spark, sf).withColumn("text", F.lit("")))
    return show(vector_channel(queries, fx.vectors(spark, sf), fx.catalog(spark, sf)))


@check("vector_channel_filtered", fx.select(_CANDIDATES + "f_vector", "f_vector"))
def vector_search_filtered(spark, sf):
    queries = rt.rewrite_queries(fx.filtered_queries(spark, sf)).join(
        fx.query_vectors(spark, sf), "query_id")
    return show(vector_channel(queries, fx.vectors(spark, sf), fx.catalog(spark, sf)))


@check("vector_channel_tiled", fx.select(_CANDIDATES + "f_vector", "f_vector"))
def vector_search_tiled(spark, sf):
    """Filtered queries from quantised vectors, with exact scores of the candidates."""
    queries = rt.rewrite_queries(fx.filtered_queries(spark, sf)).join(
        fx.query_vectors(spark, sf), "query_id")
    vectors = joins.materialize(fx.vectors(spark, sf))
    return show(vector_channel_coded(queries, joins.materialize(vector_codes(vectors)), vectors, fx.catalog(spark, sf)))


@check("vector_channel_coded", fx.select(_CANDIDATES + "a_vector", "a_vector"))
def vector_search_coded(spark, sf):
    """Every embedding looks for its nearest documents in the quantised vectors."""
    queries = rt.rewrite_queries(fx.query_vectors(spark, sf).withColumn("text", F.lit("")))
    vectors = joins.materialize(fx.vectors(spark, sf))
    return show(vector_channel_coded(queries, joins.materialize(vector_codes(vectors)), vectors, fx.catalog(spark, sf)))


fx.define("semantic", ["vectors"], f"""
    SELECT source, target, similarity FROM (
      SELECT least(a.doc_id, b.doc_id) AS source, greatest(a.doc_id, b.doc_id) AS target,
        round(list_cosine_similarity(a.embedding, b.embedding), 9) AS similarity
      FROM vectors a JOIN vectors b ON a.doc_id < b.doc_id) WHERE similarity >= {THRESHOLD}""")


@check("semantic_pairs", fx.select(
    "SELECT source, target, round(similarity, 6) AS similarity FROM semantic", "semantic"))
def similar_pairs(spark, sf):
    return semantic_pairs(fx.vectors(spark, sf), THRESHOLD).withColumn(
        "similarity", F.round("similarity", 6))


@check("semantic_pairs_banded")
def similar_pairs_banded(spark, sf):
    """Candidates by bands of signs: few pairs at the threshold are missed, none is wrong."""
    return semantic_pairs(fx.vectors(spark, sf), 0.5, recall=0.95).withColumn("similarity", F.round("similarity", 6))


# ------------------------------------------------------------------------- graph build

fx.define("mentions", ["catalog"], r"""
    SELECT doc_id, created_at, pos, entities[pos] AS entity,
      'entity:' || substr(sha256(regexp_replace(lower(entities[pos]), '[\s_-]+', '', 'g')), 1, 20) AS entity_id
    FROM catalog, unnest(range(1, len(entities) + 1)) AS u(pos)""")
fx.define("entity_nodes", ["mentions"], """
    SELECT entity_id, first(entity ORDER BY created_at DESC, doc_id, pos) AS label,
      count(DISTINCT doc_id) AS document_count FROM mentions GROUP BY entity_id""")
fx.define("members", ["mentions", "catalog"], """
    SELECT 'co_entity' AS kind, entity_id AS value, doc_id, created_at FROM mentions
    UNION ALL SELECT 'co_tag', unnest(tags), doc_id, created_at FROM catalog
    UNION ALL SELECT 'same_directory', path, doc_id, created_at FROM catalog
      WHERE path NOT IN ('', '/')""")
fx.define("pairs", ["members"], """
    SELECT kind, value, least(a, b) AS source, greatest(a, b) AS target FROM (
      SELECT x.kind, x.value, x.doc_id AS a, y.doc_id AS b FROM sized x JOIN sized y
        ON x.kind = y.kind AND x.value = y.value AND x.doc_id < y.doc_id WHERE x.n <= 50
      UNION ALL SELECT kind, value, hub, doc_id FROM sized WHERE n > 50 AND doc_id <> hub)
    """.replace("sized", """(SELECT *, count(*) OVER (PARTITION BY kind, value) AS n,
        first_value(doc_id) OVER (PARTITION BY kind, value ORDER BY created_at DESC, doc_id) AS hub
        FROM members)"""))
fx.define("shared_edges", ["pairs", "entity_nodes"], """
    SELECT source, target, kind AS relation, round(CASE kind
        WHEN 'co_entity' THEN least(0.9, 0.65 + 0.10 * (count(*) - 1))
        WHEN 'co_tag' THEN least(0.75, 0.45 + 0.10 * (count(*) - 1)) ELSE 0.35 END::DOUBLE, 4) AS weight,
      list_sort(list(coalesce(e.label, p.value))) AS shared
    FROM pairs p LEFT JOIN entity_nodes e ON e.entity_id = p.value
    GROUP BY source, target, kind""")
fx.define("edges", ["shared_edges", "mentions", "semantic"], """
    SELECT source, target, relation, weight, shared, 'EXTRACTED' AS confidence FROM shared_edges
    UNION ALL SELECT least(doc_id, entity_id), greatest(doc_id, entity_id), 'declares_core_entity',
      0.85, [entity], 'EXTRACTED' FROM mentions
    UNION ALL SELECT source, target, 'semantically_similar', round(least(similarity, 1.0), 4),
      CAST([] AS VARCHAR[]), 'INFERRED' FROM semantic""")
fx.define("nodes", ["catalog", "entity_nodes"], """
    SELECT doc_id AS id, title AS label, 'document' AS file_type,
      CASE WHEN path = '' THEN '/' ELSE path END AS source_file, array_to_string(tags, ',') AS tags,
      array_to_string(entities, ',') AS entities, CAST(NULL AS BIGINT) AS document_count,
      updated_at FROM catalog
    UNION ALL SELECT entity_id, label, 'entity', 'entities', '', '', document_count, NULL
      FROM entity_nodes""")


def relation_graph(spark, sf):
    return build_graph(fx.catalog(spark, sf), fx.vectors(spark, sf), THRESHOLD)


@check("co_occurrence_pairs", fx.select("SELECT kind, value, source, target FROM pairs", "pairs"))
def co_occurrence_pairs(spark, sf):
    cat = fx.catalog(spark, sf)
    return graph.co_occurrence_pairs(graph.value_members(cat, graph.entity_mentions(cat)))


@check("shared_value_edges", fx.select(
    "SELECT source, target, relation, weight, array_to_string(shared, '|') AS shared FROM shared_edges",
    "shared_edges"))
def shared_value_edges(spark, sf):
    cat = fx.catalog(spark, sf)
    mentions = graph.entity_mentions(cat)
    pairs = graph.co_occurrence_pairs(graph.value_members(cat, mentions))
    return graph.shared_value_edges(pairs, graph.entity_nodes(mentions)).withColumn(
        "shared", F.array_join("shared", "|"))


@check("entity_nodes", fx.select(
    "SELECT entity_id, label, document_count FROM entity_nodes", "entity_nodes"))
def entity_nodes(spark, sf):
    return graph.entity_nodes(graph.entity_mentions(fx.catalog(spark, sf)))


@check("entity_key", fx.select(
    r"SELECT doc_id, entity, regexp_replace(lower(entity), '[\s_-]+', '', 'g') AS entity_key, entity_id FROM mentions",
    "mentions"))
def entity_key(spark, sf):
    from lorespark.functions.metadata import metadata_key

    return graph.entity_mentions(fx.catalog(spark, sf)).select(
        "doc_id", "entity", metadata_key(F.col("entity")).alias("entity_key"), "entity_id")


@check("graph_nodes", fx.select(
    f"SELECT * REPLACE ({fx.stamp('updated_at')} AS updated_at) FROM nodes", "nodes"))
def graph_nodes(spark, sf):
    return build_graph(fx.catalog(spark, sf)).nodes.withColumn(
        "updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


@check("graph_edges", fx.select(
    "SELECT source, target, relation, confidence, weight, array_to_string(shared, '|') AS shared FROM edges",
    "edges"))
def graph_edges(spark, sf):
    return relation_graph(spark, sf).edges.withColumn("shared", F.array_join("shared", "|"))


fx.define("adj", ["edges"], """
    SELECT source AS node, target AS next, weight, relation FROM edges WHERE weight >= 0.25
    UNION ALL SELECT target, source, weight, relation FROM edges WHERE weight >= 0.25""")
# The scan check drops every third weight so that the defaults are used.
fx.define("weak_edges", ["edges"], """
    SELECT source, target, relation, CASE WHEN length(source) % 3 = 0 THEN NULL ELSE weight END AS weight
    FROM edges""")


@check("graph_edges_scan", fx.select("""
    SELECT node, next, relation, weight FROM (
      SELECT source, target, relation, coalesce(weight, CASE relation
        WHEN 'semantically_similar' THEN 0.75 WHEN 'co_entity' THEN 0.65
        WHEN 'declares_core_entity' THEN 0.85 WHEN 'co_tag' THEN 0.50
        WHEN 'same_directory' THEN 0.35 ELSE 0.30 END) AS weight FROM weak_edges) e,
      LATERAL (SELECT source AS node, target AS next UNION ALL SELECT target, source) d
    WHERE weight >= 0.25""", "weak_edges"))
def graph_edges_scan(spark, sf):
    edges = relation_graph(spark, sf).edges.withColumn(
        "weight", F.when(F.length("source") % 3 != 0, F.col("weight")))
    return graph.adjacency(edges)


fx.define("communities", ["nodes"], """
    SELECT id AS node, CASE WHEN file_type = 'document' THEN CAST(length(label) % 10 AS VARCHAR)
      ELSE 'entities' END AS community FROM nodes""")


def _by_title_length(nodes):
    is_doc = F.col("file_type") == "document"
    return nodes.select(
        F.col("id").alias("node"),
        F.when(is_doc, (F.length("label") % 10).cast("string")).otherwise("entities").alias("community"))


@check("community_labels", fx.select("""
    SELECT c.community, coalesce(b.name, 'Community ' || c.community) AS label
    FROM (SELECT DISTINCT community FROM communities) c LEFT JOIN (
      SELECT community, CASE WHEN kind = 0 THEN '#' || value ELSE value END AS name FROM (
        SELECT community, kind, value, row_number() OVER (PARTITION BY community
          ORDER BY kind, count(*) DESC, value) AS rn FROM (
          SELECT c.community, 0 AS kind, unnest(string_split(n.tags, ',')) AS value
            FROM communities c JOIN nodes n ON n.id = c.node WHERE n.file_type = 'document' AND n.tags <> ''
          UNION ALL SELECT c.community, 1, n.source_file FROM communities c JOIN nodes n ON n.id = c.node
            WHERE n.file_type = 'document' AND n.source_file NOT IN ('', '/'))
        GROUP BY community, kind, value) WHERE rn = 1) b ON b.community = c.community""",
    "communities", "nodes"))
def community_labels(spark, sf):
    nodes = build_graph(fx.catalog(spark, sf)).nodes
    return graph.community_labels(_by_title_length(nodes), nodes)


@check("community_label_join", fx.select("""
    SELECT c.node, c.community, CASE WHEN c.community < '5' THEN '#label ' || c.community
      ELSE '分组 ' || c.community END AS community_label FROM communities c""", "communities"))
def community_label_join(spark, sf):
    members = _by_title_length(build_graph(fx.catalog(spark, sf)).nodes)
    labels = members.filter("community < '5'").select(
        "community", F.concat(F.lit("#label "), "community").alias("label")).distinct()
    return graph.attach_community_labels(members, labels)


def _propagation_sql(rounds: int) -> str:
    fx.define("lp_links", ["edges"], """
        SELECT node, next, sum(w) AS w FROM (
          SELECT source AS node, target AS next, CAST(round(weight * 10000) AS BIGINT) AS w FROM edges
          UNION ALL SELECT target, source, CAST(round(weight * 10000) AS BIGINT) FROM edges)
        GROUP BY node, next""")
    fx.define("lp0", ["nodes"], "SELECT id AS node, id AS community FROM nodes")
    for i in range(rounds):
        fx.define(f"lp{i + 1}", [f"lp{i}", "lp_links"], f"""
            SELECT l.node, coalesce(v.community, l.community) AS community FROM lp{i} l LEFT JOIN (
              SELECT k.node, o.community, row_number() OVER (PARTITION BY k.node
                ORDER BY sum(k.w) DESC, o.community) AS rn
              FROM lp_links k JOIN lp{i} o ON o.node = k.next GROUP BY k.node, o.community) v
              ON v.node = l.node AND v.rn = 1""")
    return fx.select(f"SELECT node, community FROM lp{rounds}", f"lp{rounds}")


@check("graph_communities", _propagation_sql(4))
def graph_communities(spark, sf):
    built = relation_graph(spark, sf)
    return graph.label_propagation(built.nodes, joins.materialize(built.edges), rounds=4)


def _moves_sql(rounds: int) -> str:
    fx.define("mv_degrees", ["lp_links"], "SELECT node, sum(w) AS degree FROM lp_links GROUP BY node")
    fx.define("mv0", ["nodes"], "SELECT id AS node, id AS community FROM nodes")
    for i in range(rounds):
        fx.define(f"mv{i + 1}", [f"mv{i}", "mv_degrees", "lp_links"], f"""
            SELECT m.node, coalesce(b.community, m.community) AS community FROM mv{i} m LEFT JOIN (
              SELECT o.node, o.community, row_number() OVER (PARTITION BY o.node ORDER BY
                CAST((SELECT sum(degree) FROM mv_degrees) AS DOUBLE) * CAST(o.w AS DOUBLE) - CAST(o.degree AS DOUBLE)
                  * CAST(s.total - CASE WHEN o.community = o.own THEN o.degree ELSE 0 END AS DOUBLE) DESC,
                o.community <> o.own, o.community) AS rn
              FROM (SELECT node, community, degree, own, sum(w) AS w FROM (
                  SELECT k.node, n.community, d.degree, h.community AS own, k.w FROM lp_links k
                    JOIN mv{i} n ON n.node = k.next JOIN mv{i} h ON h.node = k.node JOIN mv_degrees d ON d.node = k.node
                    WHERE k.node <> k.next
                  UNION ALL SELECT h.node, h.community, d.degree, h.community, 0 FROM mv{i} h JOIN mv_degrees d ON d.node = h.node)
                WHERE substr(md5(node || ':{i}'), 1, 1) < '8' GROUP BY ALL) o
              JOIN (SELECT h.community, sum(d.degree) AS total FROM mv{i} h JOIN mv_degrees d ON d.node = h.node
                GROUP BY h.community) s ON s.community = o.community) b ON b.node = m.node AND b.rn = 1""")
    return fx.select(f"SELECT node, community FROM mv{rounds}", f"mv{rounds}")


@check("graph_modularity_moves", _moves_sql(3))
def graph_modularity_moves(spark, sf):
    """The first rounds of moves, before anything is contracted."""
    built = relation_graph(spark, sf)
    links = joins.materialize(graph.modularity_links(built.nodes, built.edges))
    degrees = links.groupBy("node").agg(F.sum("w").alias("degree"))
    total = links.agg(F.sum("w")).first()[0] or 0
    members = built.nodes.select(F.col("id").alias("node"), F.col("id").alias("community"))
    for number in range(3):
        members = joins.materialize(graph.local_moves(links, members, degrees, total, number))
    return members


@check("graph_communities_modularity")
def graph_communities_modularity(spark, sf):
    built = relation_graph(spark, sf)
    return graph.modularity_communities(built.nodes, joins.materialize(built.edges))


fx.define("cc_links", ["edges"], """
    SELECT source AS u, target AS v FROM edges UNION SELECT target, source FROM edges""")


@check("graph_components", fx.select("""
    , reach(node, root) AS (SELECT id, id FROM nodes UNION
      SELECT k.v, r.root FROM reach r JOIN cc_links k ON k.u = r.node WHERE r.root < k.v)
    SELECT node, min(root) AS community FROM reach GROUP BY node""", "nodes", "cc_links", recursive=True))
def graph_components(spark, sf):
    """Components over all relations."""
    built = relation_graph(spark, sf)
    return graph.connected_components(built.nodes, built.edges)


@check("graph_stats", fx.select("""
    SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count,
      (SELECT count(DISTINCT community) FROM communities) AS community_count""",
    "nodes", "edges", "communities"))
def graph_stats(spark, sf):
    built = relation_graph(spark, sf)
    return graph.graph_stats(built.nodes, built.edges, _by_title_length(built.nodes))


# ----------------------------------------------------------------------------- hybrid

fx.define("candidates", ["q_vector", "q_keyword", "q_structure"], """
    SELECT query_id, doc_id, chunk_index, channel, raw_score FROM q_vector
    UNION ALL SELECT query_id, doc_id, chunk_index, channel, raw_score FROM q_keyword
    UNION ALL SELECT query_id, doc_id, chunk_index, channel, raw_score FROM q_structure""")
_ORDER = ("CASE channel WHEN 'vector' THEN 1 WHEN 'keyword' THEN 2 WHEN 'structure' THEN 3 "
          "WHEN 'vector+neighbor' THEN 4 WHEN 'keyword+neighbor' THEN 5 "
          "WHEN 'structure+neighbor' THEN 6 ELSE 7 END")
fx.define("neighbors", ["candidates", "chunks"], f"""
    SELECT query_id, doc_id, chunk_index, channel || '+neighbor' AS channel, raw_score * 0.85 AS raw_score
    FROM (SELECT r.*, row_number() OVER (PARTITION BY r.query_id, r.doc_id, r.chunk_index
        ORDER BY {_ORDER}, raw_score DESC, hit_index) AS rn
      FROM (SELECT query_id, doc_id, channel, raw_score, chunk_index AS hit_index, chunk_index + o AS chunk_index
        FROM candidates, (VALUES (-1), (1)) AS t(o)) r
      JOIN chunks k ON k.doc_id = r.doc_id AND k.chunk_index = r.chunk_index
      WHERE NOT EXISTS (SELECT 1 FROM candidates c WHERE c.query_id = r.query_id
        AND c.doc_id = r.doc_id AND c.chunk_index = r.chunk_index)) WHERE rn = 1""")


def _rerank_body(source: str) -> str:
    boost = fx.rerank_sql("q_tokens", "title_lc", "path_lc", "entities_lc", "content_lc")
    return f"""
        SELECT *, least((CASE WHEN channel = 'vector' THEN raw_score
            WHEN channel = 'graph' THEN least(greatest(raw_score, 0.0), 1.0)
            ELSE least(raw_score / 10.0, 1.0) END) + boost, 1.0) AS final_score FROM (
          SELECT c.*, q.top_k, {boost} AS boost FROM {source} c
          JOIN lowered l ON l.doc_id = c.doc_id
          JOIN (SELECT doc_id, chunk_index, lower(content) AS content_lc FROM chunks) k
            ON k.doc_id = c.doc_id AND k.chunk_index = c.chunk_index
          JOIN (SELECT query_id, top_k, {fx.tokens('text')} AS q_tokens FROM queries) q
            ON q.query_id = c.query_id)"""


def _fuse_body(source: str) -> str:
    return f"""
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
            ORDER BY final_score DESC, doc_id, chunk_index) AS rank FROM (
          SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, chunk_index
            ORDER BY final_score DESC, {_ORDER}) AS crn FROM {source}) WHERE crn = 1))
        WHERE rank <= top_k"""


fx.define("base", ["candidates", "neighbors"], """
    SELECT *, CAST(NULL AS VARCHAR) AS seed_id, CAST(NULL AS INTEGER) AS hop,
      CAST(NULL AS DOUBLE) AS path_weight, '' AS relations
    FROM (SELECT * FROM candidates UNION ALL SELECT * FROM neighbors)""")
fx.define("scored", ["base", "queries", "lowered", "chunks"], _rerank_body("base"))
fx.define("fused", ["scored"], _fuse_body("scored"))
fx.define("seeds", ["fused"], """
    SELECT query_id, doc_id AS seed_id, final_score AS seed_score, seed_rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id
        ORDER BY final_score DESC, doc_id, chunk_index) AS seed_rank FROM (
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id
          ORDER BY final_score DESC, chunk_index) AS drn FROM fused) WHERE drn = 1))
    WHERE seed_rank <= 3""")
for _hop in (1, 2):
    _from = ("(SELECT *, seed_id AS node, 1.0::DOUBLE AS path_weight, '' AS relations FROM seeds)"
             if _hop == 1 else """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, seed_id
                 ORDER BY path_weight DESC, node) AS frn FROM hop1) WHERE frn <= 60)""")
    _damp = "" if _hop == 1 else " * 0.75"
    _sep = "a.relation" if _hop == 1 else "f.relations || ' -> ' || a.relation"
    _unseen = "" if _hop == 1 else """ WHERE NOT EXISTS (SELECT 1 FROM hop1 h WHERE h.query_id = s.query_id
        AND h.seed_id = s.seed_id AND h.node = s.node AND h.path_weight >= s.path_weight)"""
    fx.define(f"hop{_hop}", ["seeds", "adj"] if _hop == 1 else ["seeds", "adj", "hop1"], f"""
        SELECT query_id, seed_id, seed_rank, seed_score, node, path_weight, relations, {_hop} AS hop
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id, seed_id, node
            ORDER BY path_weight DESC, relations) AS prn FROM (
          SELECT f.query_id, f.seed_id, f.seed_rank, f.seed_score, a.next AS node,
            f.path_weight * a.weight{_damp} AS path_weight, {_sep} AS relations
          FROM {_from} f JOIN adj a ON a.node = f.node
          WHERE NOT EXISTS (SELECT 1 FROM seeds o WHERE o.query_id = f.query_id AND o.seed_id = a.next))
          ) s{_unseen if _unseen else ' WHERE true'} AND prn = 1""")
_GRAPH_SCORE = fx.keyword_sql("terms", "l.title_lc", "l.path_lc", "l.entities_lc", "lower(k.content)")
fx.define("related", ["hop1", "hop2", "fused", "catalog", "lowered", "chunks", "queries"], f"""
    SELECT query_id, doc_id, chunk_index, 'graph' AS channel, raw_score, seed_id, hop, path_weight, relations
    FROM (SELECT t.*, k.chunk_index, row_number() OVER (PARTITION BY t.query_id, t.doc_id
        ORDER BY {_GRAPH_SCORE} DESC, k.chunk_index) AS krn
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, doc_id) AS rrn
        FROM (SELECT * FROM (SELECT r.query_id, r.node AS doc_id, r.seed_id, r.hop, r.path_weight, r.relations,
              least(r.seed_score * r.path_weight * 0.35::DOUBLE, 1.0) AS raw_score,
              row_number() OVER (PARTITION BY r.query_id, r.node ORDER BY
                least(r.seed_score * r.path_weight * 0.35::DOUBLE, 1.0) DESC, r.seed_rank, r.hop) AS brn
            FROM (SELECT * FROM hop1 UNION ALL SELECT * FROM hop2) r
            WHERE NOT EXISTS (SELECT 1 FROM fused f WHERE f.query_id = r.query_id AND f.doc_id = r.node))
          WHERE brn = 1 AND raw_score > 0 AND doc_id IN (SELECT doc_id FROM catalog))) t
      JOIN lowered l ON l.doc_id = t.doc_id JOIN chunks k ON k.doc_id = t.doc_id
      JOIN (SELECT query_id, {fx.tokens('text')} AS terms FROM queries) q ON q.query_id = t.query_id
      WHERE rrn <= 3) WHERE krn = 1""")
fx.define("rescored", ["scored", "related", "queries", "lowered", "chunks"], f"""
    SELECT query_id, doc_id, chunk_index, channel, raw_score, seed_id, hop, path_weight, relations, top_k, boost, final_score FROM scored
    UNION ALL SELECT query_id, doc_id, chunk_index, channel, raw_score, seed_id, hop, path_weight, relations, top_k, boost, final_score
    FROM ({_rerank_body('related')})""")
fx.define("hybrid", ["rescored"], _fuse_body("rescored"))


def _hybrid_inputs(spark, sf, with_graph=True):
    cat, chk, index = indexed(spark, sf)
    queries = fx.queries(spark, sf).join(fx.query_vectors(spark, sf), "query_id", "left")
    links = graph.graph_index(relation_graph(spark, sf).edges, cat, chk) if with_graph else None
    return queries, Corpus(cat, chk, index, fx.vectors(spark, sf), links)


@check("channel_union", fx.select(_CANDIDATES + "candidates", "candidates"))
def all_channels(spark, sf):
    queries, tables = _hybrid_inputs(spark, sf, with_graph=False)
    return show(channel_union(rt.rewrite_queries(queries), tables))


@check("neighbor_expand", fx.select(_CANDIDATES + "neighbors", "neighbors"))
def neighbor_expand(spark, sf):
    queries, tables = _hybrid_inputs(spark, sf, with_graph=False)
    candidates = joins.materialize(channel_union(rt.rewrite_queries(queries), tables))
    return show(rt.neighbor_expand(candidates, tables.chunks))


def _fused(spark, sf, with_graph=False):
    queries, tables = _hybrid_inputs(spark, sf, with_graph)
    asked = rt.rewrite_queries(queries)
    candidates = joins.materialize(channel_union(asked, tables))
    everything = candidates.unionByName(rt.neighbor_expand(candidates, tables.chunks))
    scored = rt.rerank(everything, asked, tables.catalog, tables.chunks)
    return asked, tables, scored, joins.materialize(rt.fuse(scored))


_SCORED = """SELECT query_id, doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, channel,
    round(boost, 6) AS boost, round(final_score, 6) AS final_score FROM """


@check("rerank_score", fx.select(_SCORED + "scored", "scored"))
def rerank_score(spark, sf):
    _, _, scored, _ = _fused(spark, sf)
    return scored.select(
        "query_id", "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "channel",
        F.round("boost", 6).alias("boost"), F.round("final_score", 6).alias("final_score"))


@check("fuse_dedup", fx.select(
    "SELECT CAST(rank AS BIGINT) AS rank, * FROM (" + _SCORED.replace("query_id,", "rank, query_id,", 1)
    + "fused)", "fused").replace("SELECT CAST(rank AS BIGINT) AS rank, *", "SELECT * REPLACE (CAST(rank AS BIGINT) AS rank)"))
def fuse_dedup(spark, sf):
    _, _, _, fused = _fused(spark, sf)
    return fused.select(
        F.col("rank").cast("long").alias("rank"), "query_id", "doc_id",
        F.col("chunk_index").cast("long").alias("chunk_index"), "channel",
        F.round("boost", 6).alias("boost"), F.round("final_score", 6).alias("final_score"))


@check("seed_docs", fx.select("""
    SELECT query_id, seed_id, CAST(seed_rank AS BIGINT) AS seed_rank, round(seed_score, 6) AS seed_score
    FROM seeds""", "seeds"))
def seed_docs(spark, sf):
    return graph.seed_docs(_fused(spark, sf)[3]).select(
        "query_id", "seed_id", F.col("seed_rank").cast("long").alias("seed_rank"),
        F.round("seed_score", 6).alias("seed_score"))


@check("graph_expand", fx.select("""
    SELECT query_id, doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, channel,
      round(raw_score, 6) AS raw_score, seed_id, CAST(hop AS BIGINT) AS hop,
      round(path_weight, 6) AS path_weight, relations FROM related""", "related"))
def graph_expand(spark, sf):
    asked, tables, _, fused = _fused(spark, sf, with_graph=True)
    found = graph.graph_expand(
        fused, asked, tables.graph, tables.catalog, tables.chunks)
    return found.select(
        "query_id", "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "channel",
        F.round("raw_score", 6).alias("raw_score"), "seed_id", F.col("hop").cast("long").alias("hop"),
        F.round("path_weight", 6).alias("path_weight"),
        F.array_join("relations", " -> ").alias("relations"))


# Budget between a hit's neighbours: half each, leftovers to the other side.
def _context_sql(budget: int) -> str:
    after = f"least(len_after, {budget} - least(len_before, {budget // 2}))"
    before = f"least(len_before, {budget} - {after})"
    return f"""
      CASE WHEN {before} > 0 THEN right(before, {before}) ELSE '' END AS context_before,
      CASE WHEN {after} > 0 THEN left(after, {after}) ELSE '' END AS context_after,
      len_before + len_after > {budget} AS context_truncated"""


def _enriched(source: str) -> str:
    return f"""(SELECT h.*, c.title, c.path, array_to_string(c.tags, ',') AS tags,
        array_to_string(c.entities, ',') AS entities, {fx.stamp('c.updated_at')} AS updated_at,
        k.content, CAST(k.total_chunks AS BIGINT) AS total_chunks,
        coalesce(b.content, '') AS before, coalesce(a.content, '') AS after,
        length(coalesce(b.content, '')) AS len_before, length(coalesce(a.content, '')) AS len_after
      FROM {source} h JOIN chunks k ON k.doc_id = h.doc_id AND k.chunk_index = h.chunk_index
      LEFT JOIN chunks b ON b.doc_id = h.doc_id AND b.chunk_index = h.chunk_index - 1
      LEFT JOIN chunks a ON a.doc_id = h.doc_id AND a.chunk_index = h.chunk_index + 1
      LEFT JOIN catalog c ON c.doc_id = h.doc_id)"""


_HIT_COLUMNS = """query_id, CAST(rank AS BIGINT) AS rank, doc_id, CAST(chunk_index AS BIGINT) AS chunk_index,
    total_chunks, title, path, tags, entities, updated_at, channel, content,
    round(raw_score, 6) AS raw_score, round(final_score, 6) AS final_score,
    path || ':' || title || '#chunk-' || chunk_index AS citation"""


def _show_hits(hits):
    return hits.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "doc_id",
        F.col("chunk_index").cast("long").alias("chunk_index"),
        F.col("total_chunks").cast("long").alias("total_chunks"), "title", "path",
        F.array_join("tags", ",").alias("tags"), F.array_join("entities", ",").alias("entities"),
        F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"), "channel", "content",
        F.round("raw_score", 6).alias("raw_score"), F.round("final_score", 6).alias("final_score"),
        "citation", "context_before", "context_after", "context_truncated")


@check("context_enrich", fx.select(
    f"SELECT {_HIT_COLUMNS}, {_context_sql(120)} FROM {_enriched('fused')}", "fused", "chunks", "catalog"))
def context_enrich(spark, sf):
    _, tables, _, fused = _fused(spark, sf)
    return _show_hits(rt.attach_context(fused, tables.catalog, tables.chunks, max_chars=120))


@check("hybrid_search", fx.select(f"""
    SELECT {_HIT_COLUMNS}, {_context_sql(2000)}, coalesce(seed_id, '') AS seed_id, relations
    FROM {_enriched('hybrid')}""", "hybrid", "chunks", "catalog"))
def hybrid(spark, sf):
    queries, tables = _hybrid_inputs(spark, sf)
    hits = hybrid_search(queries, tables)
    shown = _show_hits(hits).columns
    ready = hits.withColumn("seed_id", F.coalesce("seed_id", F.lit(""))).withColumn(
        "relations", F.array_join("relations", " -> "))
    return _show_hits(hits).join(
        ready.select("query_id", F.col("rank").cast("long").alias("rank"), "seed_id", "relations"),
        ["query_id", "rank"]).select(*shown, "seed_id", "relations")
