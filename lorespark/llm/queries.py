"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm import (
    decontaminate,
    exact_topk,
    fill_middle,
    lines,
    minhash,
    pieces,
    shards,
    simhash,
    suffix_tree,
    token_store,
    toxicity,
    warc,
    whitening,
)
from lorespark.llm.common import LOWER, UPPER, table
from lorespark.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return register


@query("op10_warc", """
    WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
    d AS (SELECT page_id, strlen(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
    f AS (SELECT *, CASE WHEN payload_bytes >= 100
      THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM d)
    SELECT page_id, payload_bytes, payload_digest,
      CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to FROM f""")
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived, indexed, and read back from the archives through the index."""
    folder = shared_folder(spark, "archives")
    captures = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    index = warc.write_index(captures, folder)
    found = warc.lookup(captures.select("key"), index, folder, with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_shards")
def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 24 shards of nearly equal bytes, equal texts together."""
    placed = shards.assign_shards(table(spark, sf_dir, "documents"), 24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query("op3_line_dedup", f"""
    WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM documents),
    page AS (SELECT DISTINCT source, text, parts FROM d WHERE text IS NOT NULL),
    total AS (SELECT source, count(*) AS pages FROM page GROUP BY ALL),
    line AS (SELECT source, line, count(*) AS containing FROM (
      SELECT source, unnest(list_distinct(parts)) AS line FROM page) WHERE trim(line) <> '' GROUP BY ALL),
    gone AS (SELECT l.source, list(line) AS gone FROM line l JOIN total t
      ON l.source IS NOT DISTINCT FROM t.source
      WHERE pages >= {lines.LEAST_PAGES} AND containing > {lines.RATIO} * pages GROUP BY ALL),
    kept AS (SELECT doc_id, d.source, text, parts,
      list_filter(parts, lambda x: trim(x) = '' OR NOT list_contains(coalesce(gone, []), x)) AS kept
      FROM d LEFT JOIN gone g ON d.source IS NOT DISTINCT FROM g.source)
    SELECT doc_id, source, array_to_string(kept, chr(10)) AS text,
      coalesce(len(parts), 0) AS n_lines, coalesce(len(parts), 0) - coalesce(len(kept), 0) AS n_dropped
    FROM kept""")
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the boilerplate lines of its source."""
    docs = table(spark, sf_dir, "documents")
    return lines.drop_boilerplate(docs, counts=True).select(
        "doc_id", "source", "text", "n_lines", "n_dropped")


@query("op1_token_ids")
def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written in ascending order of ids, and read back."""
    import public_tokenizers

    folder = shared_folder(spark, "tokens")
    token_store.write_tokens(
        table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.read_tokens(spark, folder)


@query("op8_decontamination", f"""
    WITH w AS (SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws
      FROM documents WHERE text IS NOT NULL),
    i AS (SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws
      FROM benchmark),
    s AS (SELECT DISTINCT item_id, least(len(ws), 5) AS width,
      unnest(list_transform(range(0, len(ws) - least(len(ws), 5) + 1),
        lambda k: array_to_string(ws[k + 1:k + least(len(ws), 5)], ' '))) AS sh FROM i WHERE len(ws) > 0),
    n AS (SELECT item_id, count(*) AS item_shingles FROM s GROUP BY ALL),
    g AS (SELECT DISTINCT width FROM s),
    d AS (SELECT doc_id, width, unnest(list_transform(range(0, greatest(len(ws) - width + 1, 0)),
        lambda k: array_to_string(ws[k + 1:k + width], ' '))) AS sh FROM w, g),
    m AS (SELECT doc_id, item_id, count(DISTINCT d.sh) AS matched FROM d JOIN s USING (width, sh) GROUP BY ALL)
    SELECT doc_id, item_id, matched, item_shingles, matched::DOUBLE / item_shingles AS containment
    FROM m JOIN n USING (item_id) WHERE matched * 10 >= item_shingles * 8""")
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return decontaminate.contained_items(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    placed = simhash.near_components(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", simhash.hexadecimal(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by its nearest labelled examples."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", (~toxicity.training(F.col("doc_id"))).alias("held_out"), "score",
        F.when(F.col("score") >= toxicity.REJECT, 1).otherwise(0).alias("predicted"),
        "neighbours", "cosines", "neighbour_labels")


@query("op7_fingerprints")
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return minhash.fingerprint_edits(table(spark, sf_dir, "documents"))


@query("op6_language_model")
def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the suffix tree and by the unigram base."""
    return suffix_tree.score_texts(table(spark, sf_dir, "documents"))


@query("op5_sentencepiece")
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, and whether its ids decode to its text."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = pieces.decode(pieces.encode(docs, path), path)
    return decoded.select(
        "doc_id", F.char_length("text").alias("n_chars"), F.size("ids").alias("n_ids"),
        F.xxhash64("ids").alias("ids_hash"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector on the 16 leading components, scaled to unit variance."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op12_exact_topk", """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
      WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
      vec_id, score FROM s QUALIFY rank <= 10""")
def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best vectors for every vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk.top_k(vectors, vectors.filter("vec_id % 100 = 0"))


@query("op13_fill_middle", """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(concat('1:', doc_id)) AS k FROM documents),
    h AS (SELECT doc_id, t, length(t)::BIGINT AS n, ('0x' || k[1:8])::UBIGINT AS h1, ('0x' || k[9:16])::UBIGINT AS h2,
      ('0x' || k[17:24])::UBIGINT AS h3, ('0x' || k[25:32])::UBIGINT AS h4 FROM d),
    c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS b,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
        WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
    o AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
      CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
      sha256(t) AS restored_sha256 FROM o""")
def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a fill-in-middle text, and the text rebuilt from it."""
    formed = fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return fill_middle.restore(formed).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
