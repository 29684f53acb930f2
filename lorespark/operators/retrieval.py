"""Retrieval channels, neighbour expansion, fusion and context, for whole query batches.

Tables and their columns:
  queries     query_id, text (rewritten), top_k, filter_tags, filter_path
  catalog     doc_id, title, path, tags, entities, ...
  chunks      doc_id, chunk_index, total_chunks, content
  postings    term, doc_id, chunk_index, tf, fields
  candidates  query_id, doc_id, chunk_index, channel, raw_score
Scores tie-break on doc_id, then chunk_index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.functions import scoring, text
from lorespark.operators.joins import (
    first_per,
    materialize,
    top_per_query,
)
from lorespark.operators.keyword_blocks import IN_ENTITIES, IN_PATH, IN_TITLE, asked_blocks, chunk_hits, terms_inside
from lorespark.operators.occurrences import question_hits

CANDIDATE = ["query_id", "doc_id", "chunk_index", "channel", "raw_score"]
CHUNK_KEY = ["doc_id", "chunk_index"]
# Order in which channels are listed, and the damping of neighbour chunks.
CHANNEL_ORDER = [
    "vector", "keyword", "structure",
    "vector+neighbor", "keyword+neighbor", "structure+neighbor", "graph",
]
NEIGHBOR_DAMPING = 0.85


def channel_rank(channel: Column) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in CHANNEL_ORDER]), channel)


def rewrite_queries(queries: DataFrame) -> DataFrame:
    """Normalise query texts and give absent filters their defaults."""
    defaults = {
        "top_k": F.lit(5),
        "filter_tags": text.empty_strings(),
        "filter_path": F.lit(""),
    }
    for name, value in defaults.items():
        if name not in queries.columns:
            queries = queries.withColumn(name, value)
    return queries.withColumn("text", text.normalize_query(F.col("text")))


def lower_fields(catalog: DataFrame) -> DataFrame:
    """Catalog columns in the form the scores and filters need."""
    return catalog.select(
        "doc_id",
        F.lower("title").alias("title_lc"),
        F.lower("path").alias("path_lc"),
        F.lower(F.array_join("entities", " ")).alias("entities_lc"),
        "path",
        "tags",
    )


def matches_filters() -> Column:
    """Exact directory and any-of tags; an empty filter accepts every document."""
    path_ok = (F.col("filter_path") == "") | (F.col("path") == F.col("filter_path"))
    tags_ok = (F.size("filter_tags") == 0) | F.arrays_overlap("filter_tags", "tags")
    return path_ok & tags_ok


def has_filters() -> Column:
    return (F.col("filter_path") != "") | (F.size("filter_tags") > 0)


#: Postings of one term that may lie together; a more frequent term is spread over several shards.
SHARD_ROWS = 2_000_000
#: Queries of a batch that may be sent to every task.
BATCH = 100_000


def build_postings(catalog: DataFrame, chunks: DataFrame) -> DataFrame:
    """Inverted index: term, doc_id, chunk_index, tf, fields.

    ``tf`` counts the token in the chunk's text; ``fields`` marks the fields of the document that
    have it. What a term adds to a score is known from its postings, so chunk texts are not read
    again. Bigrams of CJK runs and tokens of the id only recall: they have neither.
    """
    def entries(terms: Column, tf: int, mark: int) -> Column:
        return F.transform(
            F.coalesce(terms, text.empty_strings()),
            lambda t: F.struct(t.alias("term"), F.lit(tf).alias("tf"), F.lit(mark).alias("fields")))

    entities = F.array_join("entities", " ")
    everything = F.concat_ws(" ", "doc_id", "title", "path", entities)
    marks = F.concat(
        entries(text.tokenize(F.col("title")), 0, IN_TITLE), entries(text.tokenize(F.col("path")), 0, IN_PATH),
        entries(text.tokenize(entities), 0, IN_ENTITIES), entries(text.tokenize(F.col("doc_id")), 0, 0),
        entries(text.cjk_bigrams(everything), 0, 0),
    )
    fields = catalog.filter(F.col("doc_id") != "").select("doc_id", F.array_distinct(marks).alias("marks"))
    content = F.concat(
        entries(text.tokenize(F.col("content")), 1, 0), entries(text.cjk_bigrams(F.col("content")), 0, 0))
    # Texts are shuffled, once, and not the many rows of their tokens: a chunk's are counted where its text lies.
    tasks = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = chunks.select(*CHUNK_KEY, "content").repartition(tasks, "doc_id").join(fields, "doc_id")
    posted = placed.select(
        *CHUNK_KEY, F.explode(F.concat(F.col("marks"), content)).alias("e")).select(*CHUNK_KEY, "e.*")
    return posted.groupBy("term", *CHUNK_KEY).agg(
        F.sum("tf").cast("int").alias("tf"), F.bit_or("fields").alias("fields"))


@dataclass(frozen=True)
class KeywordIndex:
    """Tables that keyword search reads.

    postings    term, shard, doc_id, chunk_index, tf, fields; at rest in buckets of (term, shard)
    vocabulary  hay: the tokens of texts and fields, each once
    hot         term, shards: terms that lie in more than one shard
    """

    postings: DataFrame
    vocabulary: DataFrame
    hot: DataFrame


def keyword_index(postings: DataFrame, shard_rows: int = SHARD_ROWS) -> KeywordIndex:
    """The index over ``postings``. Frequent terms are measured, and only they are spread."""
    counted = materialize(postings.groupBy("term").agg(
        F.count("*").alias("n"), F.max((F.col("tf") > 0) | (F.col("fields") > 0)).alias("used")))
    hot = materialize(counted.filter(F.col("n") > shard_rows).select(
        "term", F.ceil(F.col("n") / shard_rows).cast("int").alias("shards")))
    # No more hot terms than rows / shard_rows, so they travel to the tasks.
    spread = postings.join(F.broadcast(hot), "term", "left").withColumn(
        "shard", F.pmod(F.xxhash64(*CHUNK_KEY), F.coalesce("shards", F.lit(1))).cast("int")).drop("shards")
    return KeywordIndex(spread, counted.filter("used").select(F.col("term").alias("hay")), hot)


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(text.keyword_terms(F.col("text"))).alias("term"))


def _lookup(index: KeywordIndex, found: DataFrame) -> DataFrame:
    """Postings of the tokens in ``found`` (token, ...) with its other columns; the index stays where it is."""
    shards = F.explode(F.sequence(F.lit(0), F.coalesce("shards", F.lit(1)) - 1))
    asked = found.withColumnRenamed("token", "term").join(F.broadcast(index.hot), "term", "left").withColumn(
        "shard", shards).drop("shards")
    return index.postings.join(materialize(asked), ["term", "shard"])


def matching_documents(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """(query, document) pairs that pass the filters of the queries that have any."""
    asked = queries.filter(has_filters()).select("query_id", "filter_path", "filter_tags")
    fields = catalog.select("doc_id", "path", "tags")
    in_dir = fields.join(asked.filter("filter_path <> ''"), F.col("path") == F.col("filter_path"))
    any_dir = asked.filter("filter_path = ''").withColumn("tag", F.explode("filter_tags"))
    tagged = fields.withColumn("tag", F.explode("tags")).join(any_dir, "tag").drop("tag")
    return in_dir.unionByName(tagged).filter(matches_filters()).select("query_id", "doc_id").distinct()


def _asked(queries: DataFrame, catalog: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(queries as blocks take them, terms with their numbers, documents with the filters they pass).

    Filters are numbered like terms; without a catalog, or where no query has a filter, all are free.
    """
    named = queries.filter(F.col("query_id").isNotNull())
    words = materialize(query_terms(named))
    terms = materialize(words.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id()))
    asked = words.join(terms, "term").groupBy("query_id").agg(F.collect_list("term_id").alias("terms"))
    limits = named.groupBy("query_id").agg(F.max(F.col("top_k").cast("int")).alias("top_k"))
    none = F.array().cast("array<long>")
    if catalog is None or not queries.filter(has_filters()).limit(1).count():
        return asked.join(limits, "query_id").withColumns({"free": F.lit(True), "filters": none}), terms, None
    filters = materialize(named.filter(has_filters()).select("filter_path", "filter_tags").distinct().withColumn(
        "filter_id", F.monotonically_increasing_id()))
    own = named.join(filters, ["filter_path", "filter_tags"], "left").groupBy("query_id").agg(
        F.coalesce(F.max(~has_filters()), F.lit(False)).alias("free"), F.collect_set("filter_id").alias("filters"))
    passing = matching_documents(filters.withColumnRenamed("filter_id", "query_id"), catalog).groupBy("doc_id").agg(
        F.collect_set("query_id").alias("passes"))
    return asked.join(limits, "query_id").join(own, "query_id"), terms, materialize(passing)


def _hits(
    asked: DataFrame, found: DataFrame, passing: DataFrame | None, index: KeywordIndex, **wanted: bool
) -> DataFrame:
    """:func:`chunk_hits` of the postings of ``found`` (token, found)."""
    asked = materialize(asked)
    matched = _lookup(index, found).select(*CHUNK_KEY, "tf", "fields", "found")
    if passing is not None:
        # Where every query has filters, no other document is looked at.
        how = "left" if asked.filter("free").limit(1).count() else "inner"
        matched = matched.join(passing, "doc_id", how).withColumn(
            "passes", F.coalesce("passes", F.array().cast("array<long>")))
    return chunk_hits(matched, asked_blocks(asked), asked.schema["query_id"].dataType.simpleString(), **wanted)


def _pass_filters(found: DataFrame, queries: DataFrame, passing: DataFrame | None) -> DataFrame:
    """``found`` (query_id, ..., held_ok) for each query of that id whose filters accept the document."""
    if passing is None:
        return found.drop("held_ok")
    limited = queries.select("query_id", has_filters().alias("_limited"))
    flagged = found.join(F.broadcast(limited) if queries.count() <= BATCH else limited, "query_id")
    return flagged.filter("NOT _limited OR held_ok").filter("_limited IS NOT NULL").drop("_limited", "held_ok")


def keyword_recall(queries: DataFrame, index: KeywordIndex, catalog: DataFrame) -> DataFrame:
    """Distinct (query, chunk) that share a term and pass the query's filters."""
    asked, terms, passing = _asked(queries, catalog)
    found = _hits(asked, _themselves(terms), passing, index, scored=False, recalled=True)
    return _pass_filters(found, queries, passing).select("query_id", *CHUNK_KEY)


def _themselves(terms: DataFrame) -> DataFrame:
    """Terms as the only tokens that hold them."""
    return terms.select(F.col("term").alias("token"), F.array(F.shiftleft("term_id", 4) + 3).alias("found"))


def expand_terms(terms: DataFrame, index: KeywordIndex) -> DataFrame:
    """token, found: the tokens that hold a term of ``terms`` (term, term_id), and which ones, how often.

    A term has no separator, so it occurs in a text as often as in the text's tokens together.
    Terms that are no token of a text or field stand for themselves.
    """
    known = index.vocabulary.join(terms.select(F.col("term").alias("hay")), "hay", "left_semi")
    rest = terms.join(known.select(F.col("hay").alias("term")), "term", "left_anti")
    return terms_inside(index.vocabulary, terms).unionByName(_themselves(rest))


def keyword_scores(queries: DataFrame, index: KeywordIndex) -> DataFrame:
    """query_id, doc_id, chunk_index, raw_score, recalled of every chunk in which a query's term occurs.

    ``recalled``: the chunk has a whole token or field token that is a term of the query. Scores
    come from the postings alone. Matched postings move once, to the chunk they belong to; all
    queries are scored there.
    """
    asked, terms, _ = _asked(queries, None)
    return _hits(asked, expand_terms(terms, index), None, index).drop("held_ok")


def _best_keywords(queries: DataFrame, index: KeywordIndex, catalog: DataFrame, recalled: bool) -> DataFrame:
    asked, terms, passing = _asked(queries, catalog)
    found = _hits(asked, expand_terms(terms, index), passing, index, recalled=recalled, best=True)
    allowed = _pass_filters(found, queries, passing)
    return _as_candidates(allowed.join(queries.select("query_id", "top_k"), "query_id"), "keyword")


def _as_candidates(scored: DataFrame, channel: str) -> DataFrame:
    # Zero scores rank last, so dropping them after the ranking gives the same rows and
    # spares evaluating the score once more for a filter below it.
    best = top_per_query(scored, "raw_score").filter("raw_score > 0")
    return best.withColumn("channel", F.lit(channel)).select(*CANDIDATE)


def keyword_channel(queries: DataFrame, index: KeywordIndex, catalog: DataFrame) -> DataFrame:
    """Best chunks among those that have a term of the query as a token of text or fields."""
    return _best_keywords(queries, index, catalog, recalled=True)


def keyword_scan_channel(queries: DataFrame, index: KeywordIndex, catalog: DataFrame) -> DataFrame:
    """Best chunks among all that contain a query term anywhere, also inside tokens."""
    return _best_keywords(queries, index, catalog, recalled=False)


def structure_matches(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """(query, document) pairs with a positive structure score, with their ``place``.

    Left out are pairs that cannot be among the MAX_TOP_K best of their query, because as many that
    score as much were met before; ``place`` counts those.
    """
    asked = queries.select("query_id", "text", "filter_path", "filter_tags").dropna()
    fields = materialize(catalog.filter(F.col("doc_id").isNotNull()).select(
        "doc_id",
        F.lower("doc_id").alias("id_lc"),
        F.lower("title").alias("title_lc"),
        F.lower("path").alias("path_lc"),
        F.transform("entities", F.lower).alias("entities_lc"),
        "path",
        "tags",
    ))
    return question_hits(asked, fields)


def structure_channel(queries: DataFrame, catalog: DataFrame, chunks: DataFrame) -> DataFrame:
    """Best documents by structure, represented by their first chunk.

    Queries that ask the same are answered once: many that name a crowded directory would else meet
    all of its documents each.
    """
    first = chunks.groupBy("doc_id").agg(F.min("chunk_index").alias("chunk_index"))
    same = ["text", "filter_path", "filter_tags", "limit"]
    limits = queries.groupBy("query_id").agg(F.max("top_k").alias("limit"))
    asking = queries.select("query_id", *same[:-1]).join(limits, "query_id")
    questions = materialize(asking.select(*same).distinct().withColumn("question", F.monotonically_increasing_id()))
    asked = questions.withColumnsRenamed({"question": "query_id", "limit": "top_k"})
    # Documents without chunks are no answers, so they do not stand before others.
    matched = structure_matches(asked, catalog.join(first.select("doc_id"), "doc_id", "left_semi"))
    most = questions.agg(F.max("limit")).first()[0] or 0
    matched = matched.filter(F.col("place") < most).join(asked.select("query_id", "top_k"), "query_id")
    best = top_per_query(matched, "raw_score").join(first, "doc_id").select(
        F.col("query_id").alias("question"), *CHUNK_KEY, "raw_score")
    scored = (
        asking.join(questions, same).select("query_id", "question")
        .join(materialize(best), "question").drop("question")
        .join(queries.select("query_id", "top_k"), "query_id")
    )
    return _as_candidates(scored, "structure")


def neighbor_expand(candidates: DataFrame, chunks: DataFrame, window: int = 1) -> DataFrame:
    """Adjacent chunks of every hit that no channel has found itself; first hit wins."""
    offsets = [F.lit(o) for o in range(-window, window + 1) if o != 0]
    reached = candidates.select(
        "query_id", "doc_id", "channel", "raw_score",
        F.col("chunk_index").alias("hit_index"),
        F.explode(F.array(*offsets)).alias("offset"),
    ).withColumn("chunk_index", F.col("hit_index") + F.col("offset"))
    fresh = reached.join(
        candidates.select("query_id", *CHUNK_KEY), ["query_id", *CHUNK_KEY], "left_anti"
    ).join(chunks.select(*CHUNK_KEY), CHUNK_KEY)
    first = first_per(
        fresh, ["query_id", *CHUNK_KEY],
        channel_rank(F.col("channel")), F.col("raw_score").desc(), F.col("hit_index"),
    )
    return first.select(
        "query_id", *CHUNK_KEY,
        F.concat("channel", F.lit("+neighbor")).alias("channel"),
        (F.col("raw_score") * NEIGHBOR_DAMPING).alias("raw_score"),
    )


def rerank(
    candidates: DataFrame, queries: DataFrame, catalog: DataFrame, chunks: DataFrame
) -> DataFrame:
    """Final score of every candidate: normalised channel score plus the token boost."""
    boost = scoring.rerank_score(
        F.col("tokens"), F.col("title_lc"), F.col("path_lc"), F.col("entities_lc"),
        F.col("content_lc"),
    )
    lowered = chunks.select(*CHUNK_KEY, F.lower("content").alias("content_lc"))
    tokens = queries.select("query_id", "top_k", text.tokenize(F.col("text")).alias("tokens"))
    return (
        candidates.join(lower_fields(catalog).drop("path", "tags"), "doc_id")
        .join(lowered, CHUNK_KEY)
        .join(tokens, "query_id")
        .withColumn("boost", boost)
        .withColumn(
            "final_score",
            scoring.final_score(F.col("channel"), F.col("raw_score"), F.col("boost")),
        )
        .drop("title_lc", "path_lc", "entities_lc", "content_lc", "tokens")
    )


def fuse(scored: DataFrame) -> DataFrame:
    """Best candidate per chunk, then the best ``top_k`` chunks per query."""
    best = first_per(
        scored, ["query_id", *CHUNK_KEY],
        F.col("final_score").desc(), channel_rank(F.col("channel")),
    )
    return top_per_query(best, "final_score")


def attach_context(
    hits: DataFrame, catalog: DataFrame, chunks: DataFrame, max_chars: int = 2000
) -> DataFrame:
    """Chunk text with its neighbours (within a budget) and the document's metadata.

    The chunk table is joined once for the hit and both neighbours.
    """
    around = hits.select("query_id", *CHUNK_KEY).distinct().select(
        "query_id", "doc_id",
        F.col("chunk_index").alias("hit_index"),
        F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("offset"),
    ).withColumn("chunk_index", F.col("hit_index") + F.col("offset"))

    def text_at(offset: int, name: str) -> Column:
        found = F.max(F.when(F.col("offset") == offset, F.col("content")))
        return F.coalesce(found, F.lit("")).alias(name)

    texts = (
        around.join(chunks.select(*CHUNK_KEY, "content", "total_chunks"), CHUNK_KEY)
        .groupBy("query_id", "doc_id", F.col("hit_index").alias("chunk_index"))
        .agg(
            text_at(0, "content"), text_at(-1, "before"), text_at(1, "after"),
            F.max("total_chunks").alias("total_chunks"),
        )
    )
    before, after = text.bound_context(F.col("before"), F.col("after"), F.lit(max_chars))
    docs = catalog.select("doc_id", "title", "path", "tags", "entities", "updated_at")
    return (
        hits.join(texts, ["query_id", *CHUNK_KEY])
        .join(docs, "doc_id", "left")
        .withColumn("context_before", before)
        .withColumn("context_after", after)
        .withColumn("context_truncated", F.length("before") + F.length("after") > max_chars)
        .withColumn("citation", citation())
        .drop("before", "after")
    )


def citation() -> Column:
    place = F.when(F.coalesce("path", F.lit("")) == "", F.lit("/")).otherwise(F.col("path"))
    return F.concat(place, F.lit(":"), F.col("title"), F.lit("#chunk-"), F.col("chunk_index"))


def present_hits(hits: DataFrame) -> DataFrame:
    """Reply columns: scores to four digits and a citation."""
    return (
        hits.withColumn("score", F.round("final_score", 4))
        .withColumn("raw_score", F.round("raw_score", 4))
        .withColumn("citation", citation())
    )
