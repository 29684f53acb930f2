"""Views derived from the given tables, once as DataFrames and once as SQL.

The tables hold plain prose, so titles, directories, tags, entities, chunks and queries
are derived from it the same way on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions import text
from lorespark.functions.paths import source_path

ENTITY_PATTERN = "[A-Z][a-z]{9,}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Texts in too few files to occupy all cores are spread first."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name == "documents" and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores)
    return df


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    first_line = F.substring_index("text", "\n", 1)
    matches = F.regexp_extract_all("text", F.lit(f"({ENTITY_PATTERN})"), F.lit(1))
    minutes = F.make_dt_interval(F.lit(0), F.lit(0), F.col("doc_id").cast("int"))
    added = F.lit("2024-01-01").cast("timestamp") + minutes
    # Taken from the texts before the join, which then moves no text.
    narrow = docs.select(
        "doc_id",
        F.regexp_replace(first_line, "[ .]+$", "").alias("title"),
        F.concat_ws("/", "lang", "source").alias("path"),
        F.array("lang", "source").alias("tags"),
        F.array_distinct(matches).alias("entities"),
        text.content_hash(F.col("text")).alias("content_hash"),
        (F.size(F.split("text", "\n"))).alias("chunk_count"),
        added.alias("created_at"),
        added.alias("updated_at"),
    )
    return narrow.join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("doc_id"),
        "title",
        "path",
        F.when(F.col("quality") == 1, F.concat("tags", F.array(F.lit("quality")))).otherwise(F.col("tags")).alias("tags"),
        "entities",
        "content_hash",
        "chunk_count",
        "created_at",
        "updated_at",
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per line."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "lang", "source")
    return docs.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        source_path(F.col("doc_id").cast("string"), path).alias("source_path"),
        F.size(F.split("text", "\n")).alias("total_chunks"),
        F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "lang", "source")
    doc_id = F.col("doc_id").cast("string")
    return docs.select(
        doc_id.alias("doc_id"), path.alias("path"),
        source_path(doc_id, path).alias("source_path"), F.col("text").alias("content"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text, whole."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"),
        "text",
        F.lit(5).alias("top_k"),
        text.empty_strings().alias("filter_tags"),
        F.lit("").alias("filter_path"),
    )


def filtered_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries again with filters: English directory or tag, some with blank text."""
    odd = F.col("query_id") % 2 == 1
    return queries(spark, sf_dir).select(
        "query_id",
        F.when(F.col("query_id") % 4 == 3, F.lit("")).otherwise(F.col("text")).alias("text"),
        "top_k",
        F.when(odd, F.array(F.lit("en"), F.lit("quality"))).otherwise(F.col("filter_tags"))
        .alias("filter_tags"),
        F.when(~odd, F.lit("en/src1")).otherwise(F.lit("")).alias("filter_path"),
    )


def title_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document asks for itself by id, title, directory or entity in turn."""
    pick = F.pmod(F.length("title"), F.lit(4))
    return catalog(spark, sf_dir).select(
        F.col("doc_id").cast("long").alias("query_id"),
        F.when(pick == 0, F.col("doc_id")).when(pick == 1, F.col("title"))
        .when(pick == 2, F.col("path"))
        .otherwise(F.concat_ws(" ", F.lit("about"), F.get("entities", F.lit(0)))).alias("text"),
        F.lit(5).alias("top_k"),
        text.empty_strings().alias("filter_tags"),
        F.lit("").alias("filter_path"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk-0 embeddings of the documents that are in the catalog."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"))
    emb = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("doc_id"),
        F.lit(0).alias("chunk_index"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    return emb.join(docs, "doc_id", "left_semi")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embedding with the id of the query stands in for the query's own."""
    emb = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    return emb


# ---------------------------------------------------------------------------------- SQL


def tokens(expr: str) -> str:
    return (
        f"list_filter(regexp_split_to_array(lower({expr}), '\\s+|[,，。；;：:、]+'), "
        "lambda tk: tk <> '')"
    )


def distinct_list(expr: str) -> str:
    return f"list_filter({expr}, lambda el, ix: list_position({expr}, el) = ix)"


def stamp(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def count_in(text_expr: str, term: str) -> str:
    return f"((length({text_expr}) - length(replace({text_expr}, {term}, ''))) // length({term}))"


def keyword_sql(terms: str, title: str, path: str, entities: str, content: str) -> str:
    point = (
        f"(CASE WHEN contains({title}, tm) THEN 3.0 ELSE 0.0 END)"
        f" + (CASE WHEN contains({path}, tm) THEN 1.5 ELSE 0.0 END)"
        f" + (CASE WHEN contains({entities}, tm) THEN 3.5 ELSE 0.0 END)"
        f" + least({count_in(content, 'tm')}, 5)"
    )
    return f"coalesce(list_sum(list_transform({terms}, lambda tm: CAST({point} AS DOUBLE))), 0.0)"


def rerank_sql(toks: str, title: str, path: str, entities: str, content: str) -> str:
    point = (
        f"(CASE WHEN contains({title}, tm) THEN 5 ELSE 0 END)"
        f" + (CASE WHEN contains({path}, tm) THEN 3 ELSE 0 END)"
        f" + (CASE WHEN contains({entities}, tm) THEN 5 ELSE 0 END)"
        f" + (CASE WHEN contains({content}, tm) THEN 2 ELSE 0 END)"
    )
    return f"least(coalesce(list_sum(list_transform({toks}, lambda tm: {point})), 0), 15) / 100.0"


_CTES: dict[str, tuple[list[str], str]] = {
    "catalog": ([], f"""
        SELECT CAST(d.doc_id AS VARCHAR) AS doc_id,
          regexp_replace(split_part(d.text, chr(10), 1), '[ .]+$', '') AS title,
          d.lang || '/' || d.source AS path,
          CASE WHEN l.quality = 1 THEN [d.lang, d.source, 'quality'] ELSE [d.lang, d.source] END AS tags,
          {distinct_list(f"regexp_extract_all(d.text, '{ENTITY_PATTERN}')")} AS entities,
          sha256(d.text) AS content_hash,
          len(string_split(d.text, chr(10))) AS chunk_count,
          TIMESTAMP '2024-01-01' + d.doc_id * INTERVAL 1 MINUTE AS created_at,
          TIMESTAMP '2024-01-01' + d.doc_id * INTERVAL 1 MINUTE AS updated_at
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""),
    "sources": ([], """
        SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang || '/' || source AS path,
          'documents/' || lang || '/' || source || '/' || doc_id || '/source.md' AS source_path,
          text AS content FROM documents"""),
    "chunks": (["sources"], """
        SELECT doc_id, source_path, len(parts) AS total_chunks, pos - 1 AS chunk_index,
          parts[pos] AS content
        FROM (SELECT doc_id, source_path, string_split(content, chr(10)) AS parts FROM sources) s,
          unnest(range(1, len(parts) + 1)) AS u(pos)"""),
    "raw_queries": ([], """
        SELECT item_id AS query_id, text, 5 AS top_k, CAST([] AS VARCHAR[]) AS filter_tags, '' AS filter_path FROM benchmark"""),
    "queries": (["raw_queries"], f"""
        SELECT query_id, array_to_string({distinct_list(tokens('text'))}, ' ') AS text,
          top_k, filter_tags, filter_path FROM raw_queries"""),
    "filtered_queries": (["raw_queries"], f"""
        SELECT query_id,
          CASE WHEN query_id % 4 = 3 THEN '' ELSE array_to_string({distinct_list(tokens('text'))}, ' ') END AS text,
          top_k,
          CASE WHEN query_id % 2 = 1 THEN ['en', 'quality'] ELSE filter_tags END AS filter_tags,
          CASE WHEN query_id % 2 = 0 THEN 'en/src1' ELSE '' END AS filter_path FROM raw_queries"""),
    "title_queries": (["catalog"], f"""
        SELECT query_id, array_to_string({distinct_list(tokens('raw'))}, ' ') AS text, 5 AS top_k,
          CAST([] AS VARCHAR[]) AS filter_tags, '' AS filter_path
        FROM (SELECT CAST(doc_id AS BIGINT) AS query_id, CASE length(title) % 4 WHEN 0 THEN doc_id
          WHEN 1 THEN title WHEN 2 THEN path ELSE concat_ws(' ', 'about', entities[1]) END AS raw
          FROM catalog)"""),
    "vectors": ([], """
        SELECT CAST(vec_id AS VARCHAR) AS doc_id, 0 AS chunk_index,
          CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings
        WHERE vec_id IN (SELECT doc_id FROM documents)"""),
    "query_vectors": ([], """
        SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings"""),
    "lowered": (["catalog"], """
        SELECT doc_id, lower(title) AS title_lc, lower(path) AS path_lc,
          lower(array_to_string(entities, ' ')) AS entities_lc, path, tags FROM catalog"""),
    "postings": (["catalog", "chunks"], f"""
        SELECT term, k.doc_id, k.chunk_index, CAST(sum(tf) AS INTEGER) AS tf, CAST(bit_or(fields) AS INTEGER) AS fields
        FROM (SELECT doc_id, chunk_index, unnest({tokens('content')}) AS term, 1 AS tf, 0 AS fields FROM chunks
          UNION ALL SELECT k.doc_id, k.chunk_index, f.term, 0, f.fields FROM chunks k JOIN (
            SELECT doc_id, unnest({tokens('doc_id')}) AS term, 0 AS fields FROM catalog
            UNION ALL SELECT doc_id, unnest({tokens('title')}), 1 FROM catalog
            UNION ALL SELECT doc_id, unnest({tokens('path')}), 2 FROM catalog
            UNION ALL SELECT doc_id, unnest({tokens("array_to_string(entities, ' ')")}), 4 FROM catalog) f
            ON f.doc_id = k.doc_id) k GROUP BY ALL"""),
}


def define(name: str, deps: list[str], sql: str) -> None:
    if name in _CTES:
        raise ValueError(f"CTE {name} defined twice")
    _CTES[name] = (deps, sql)


def select(body: str, *names: str, recursive: bool = False) -> str:
    """``body`` preceded by the named CTEs and everything they depend on."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for dep in _CTES[name][0]:
            visit(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    ctes = ", ".join(f"{n} AS ({_CTES[n][1].strip()})" for n in ordered)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return f"{head}{ctes} {body}" if ctes else body
