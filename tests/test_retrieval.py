"""Retrieval and graph operators on small cases and against brute force."""

import itertools
import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorespark.functions.embedding import embed_chunks, hashed_terms
from lorespark.operators import graph, joins, occurrences, vectors
from lorespark.operators import retrieval as rt
from lorespark.plans.graph_build import build_graph
from lorespark.plans.hybrid import Corpus, hybrid_search
from lorespark.sources.tables import read_graph_edges

CATALOG = "doc_id string, title string, path string, tags array<string>, entities array<string>, created_at timestamp, updated_at timestamp"
CHUNKS = "doc_id string, chunk_index int, total_chunks int, content string"


def catalog(spark, *rows):
    full = [(d, t, p, tags, ents, None, None) for d, t, p, tags, ents in rows]
    return spark.createDataFrame(full, CATALOG).withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))


def small_corpus(spark):
    cat = catalog(
        spark, ("doc-1", "Alpha Manual", "guides", ["ops"], ["Data Portal"]),
        ("doc-2", "Beta Reference", "refs", ["dev", "api"], []), ("doc-3", "内部知识库管理平台", "refs", [], []))
    chk = spark.createDataFrame(
        [("doc-1", 0, 2, "deploy the gateway"), ("doc-1", 1, 2, "rollback steps"), ("doc-2", 0, 1, "alpha and beta"),
         ("doc-3", 0, 1, "平台说明")], CHUNKS)
    return cat, chk


def queries(spark, *rows):
    df = spark.createDataFrame(
        [(i, t, 5, tags, path) for i, (t, tags, path) in enumerate(rows)],
        "query_id int, text string, top_k int, filter_tags array<string>, filter_path string")
    return rt.rewrite_queries(df)


def hits(df):
    return {(r.query_id, r.doc_id, r.chunk_index): r.raw_score for r in df.collect()}


def test_keyword_channel_and_filters(spark):
    cat, chk = small_corpus(spark)
    index = rt.keyword_index(rt.build_postings(cat, chk))
    asked = queries(spark, ("alpha", [], ""), ("alpha", ["ops"], ""), ("alpha", [], "refs"), ("知识库检索", [], ""), ("absent", [], ""))
    got = hits(rt.keyword_channel(asked, index, cat))
    assert got == {
        (0, "doc-1", 0): 3.0, (0, "doc-1", 1): 3.0, (0, "doc-2", 0): 1.0, (1, "doc-1", 0): 3.0, (1, "doc-1", 1): 3.0,
        (2, "doc-2", 0): 1.0, (3, "doc-3", 0): 6.0}


def test_scan_channel_finds_terms_inside_tokens(spark):
    cat, chk = small_corpus(spark)
    index = rt.keyword_index(rt.build_postings(cat, chk))
    asked = queries(spark, ("oll", [], ""), ("a", [], "guides"))
    got = hits(rt.keyword_scan_channel(asked, index, cat))
    assert got[(0, "doc-1", 1)] == 1.0
    assert (1, "doc-1", 0) in got and not rt.keyword_channel(asked, index, cat).filter("query_id = 0").count()


def plain_keyword_scores(docs, asked, scan):
    """Scores by looking into whole texts: {(query, doc, chunk): score}."""
    out = {}
    for q, words in enumerate(asked):
        terms = list(dict.fromkeys(words.lower().split()))
        for d, title, path, entities, contents in docs:
            fields = (title.lower(), path.lower(), " ".join(entities).lower())
            for i, content in enumerate(contents):
                own = set(" ".join([d, title, path, *entities, content]).lower().split())
                if not scan and not own & set(terms):
                    continue
                score = sum(min(content.lower().count(t), 5) + sum(p for f, p in zip(fields, (3.0, 1.5, 3.5)) if t in f) for t in terms)
                if score > 0:
                    out[q, d, i] = score
    return out


def random_corpus(spark, seed, count):
    rng = random.Random(seed)

    def words(n):
        return " ".join("".join(rng.choice("abAc") for _ in range(rng.randint(1, 4))) for _ in range(n))

    docs = [(f"d{i:02}", words(3), f"p{i % 3}", [words(1), words(2)], [words(rng.randint(0, 30)) for _ in range(3)]) for i in range(count)]
    cat = catalog(spark, *[(d, t, p, ["odd" if i % 2 else "even"], e) for i, (d, t, p, e, _) in enumerate(docs)])
    chk = spark.createDataFrame([(d, i, 3, c) for d, _, _, _, cs in docs for i, c in enumerate(cs)], CHUNKS)
    return docs, cat, chk, [words(rng.randint(1, 12)) for _ in range(8)]


def test_keyword_scores_against_whole_texts(spark):
    docs, cat, chk, asked = random_corpus(spark, 17, 30)
    # Small shards: most terms are hot and lie in several of them.
    for rows in (2_000_000, 7):
        index = rt.keyword_index(rt.build_postings(cat, chk), shard_rows=rows)
        assert bool(index.hot.count()) == (rows == 7)
        scores = rt.keyword_scores(queries(spark, *[(a, [], "") for a in asked]), index).filter("raw_score > 0")
        for scan in (False, True):
            got = scores if scan else scores.filter("recalled")
            assert hits(got) == plain_keyword_scores(docs, asked, scan)


def test_keyword_filters_against_whole_texts(spark):
    docs, cat, chk, asked = random_corpus(spark, 18, 24)
    index = rt.keyword_index(rt.build_postings(cat, chk))
    limits = [([], ""), (["odd"], ""), ([], "p1"), (["even", "odd"], "p2"), (["none"], ""), ([], "p0"), (["odd"], "p0"), ([], "")]
    batch = queries(spark, *[(a, tags, path) for a, (tags, path) in zip(asked, limits)])
    scores = plain_keyword_scores(docs, asked, False)
    tags = {d[0]: {"odd" if i % 2 else "even"} for i, d in enumerate(docs)}
    paths = {d[0]: d[2] for d in docs}
    want = {}
    for q, (some, path) in enumerate(limits):
        own = [(-s, d, i) for (o, d, i), s in scores.items() if o == q and (not some or tags[d] & set(some)) and path in ("", paths[d])]
        want |= {(q, d, i): -s for s, d, i in sorted(own)[:5]}
    assert hits(rt.keyword_channel(batch, index, cat)) == want
    recalled = {(r.query_id, r.doc_id, r.chunk_index) for r in rt.keyword_recall(batch, index, cat).collect()}
    assert set(want) <= recalled and all((not limits[q][0] or tags[d] & set(limits[q][0])) for q, d, _ in recalled)


def test_a_chunk_of_one_very_common_term(spark):
    """One term in every chunk and many times in one: counts are capped, nothing else is."""
    cat = catalog(spark, *[(f"d{i:03}", "t", "p", [], []) for i in range(200)])
    chk = spark.createDataFrame([(f"d{i:03}", 0, 1, "hot " * (1 + i % 9)) for i in range(200)], CHUNKS)
    index = rt.keyword_index(rt.build_postings(cat, chk), shard_rows=10)
    got = hits(rt.keyword_scores(queries(spark, ("hot", [], "")), index))
    assert got == {(0, f"d{i:03}", 0): float(min(1 + i % 9, 5)) for i in range(200)}


def test_keyword_search_reads_no_chunk_text_and_leaves_the_index_in_place(spark):
    from lorespark.sources import tables

    docs, cat, chk, asked = random_corpus(spark, 19, 10)
    built = rt.keyword_index(rt.build_postings(cat, chk), shard_rows=20)
    tables.write_postings(built.postings, "test_index", 4)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = rt.KeywordIndex(spark.table("test_index"), built.vocabulary, built.hot)
        found = rt.keyword_channel(queries(spark, *[(a, [], "") for a in asked]), index, cat)
        plan = found._jdf.queryExecution().executedPlan().toString()
        # Down from the join to the scan of the index there is a sort at most.
        scan = plan.index("test_index")
        above = plan[:scan].rsplit("Join", 1)[1]
        assert "Exchange" not in above and "content" not in plan
        assert found.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        spark.sql("DROP TABLE test_index")


def test_structure_channel(spark):
    cat, chk = small_corpus(spark)
    asked = queries(spark, ("Data Portal deployment", [], ""), ("doc-2", [], ""), ("", ["api"], ""), ("", [], "guides"), ("", [], ""))
    assert hits(rt.structure_channel(asked, cat, chk)) == {
        (0, "doc-1", 0): 6.0, (1, "doc-2", 0): 10.0, (2, "doc-2", 0): 1.0, (3, "doc-1", 0): 1.0}


@pytest.mark.parametrize("at_once", [1000, 10])
def test_structure_channel_against_brute_force(spark, monkeypatch, at_once):
    monkeypatch.setattr(occurrences, "AT_ONCE", at_once)
    monkeypatch.setattr(occurrences, "WIDER", 2)
    rng = random.Random(5)

    def words(low, high):
        return " ".join(rng.choice(["a", "ab", "b a", "abc", "über", "x", "abcdefgh"]) for _ in range(rng.randint(low, high)))

    rows = [(f"d{i:03}", words(1, 9), rng.choice(["ab/x", "b", "", None]), rng.sample(["t", "u", "v"], rng.randint(0, 2)),
             [words(1, 2) for _ in range(rng.randint(0, 3))]) for i in range(400)]
    rows += [("a", None, "b", ["t"], None), ("d000", "ab", "b", [], ["x"]), ("bare", "a", "b", [], [])]
    cat = catalog(spark, *rows).repartition(3)
    chk = spark.createDataFrame([(r[0], c, 2, "t") for r in rows if r[0] != "bare" for c in (4, 3)], CHUNKS).distinct()
    texts = [rng.choice(rows)[rng.choice([0, 1, 1, 2])] or "" for _ in range(60)] + ["a", "ab", "", "b", "x", "h", "abcdefgh abc"] * 3
    asked = queries(spark, *[(t, rng.sample(["t", "u", "w"], rng.choice([0, 0, 0, 1, 2])), rng.choice(["", "", "b", "ab/x"])) for t in texts])

    def rule(q, doc, title, path, entities):
        if q == doc:
            return 10.0
        for hit, score in ((q == title, 8.0), (q in (title or ""), 5.0), (q in (path or ""), 3.0)):
            if q and hit:
                return score
        if q in entities:
            return 8.5
        return 0.0 if not q else 6.0 if any(e in q for e in entities) else 4.0 if any(q in e for e in entities) else 0.0

    want = []
    for r in asked.collect():
        found = []
        for doc, title, path, tags, entities in rows:
            okay = r.filter_path in ("", path) and (not r.filter_tags or set(r.filter_tags) & set(tags))
            blank = 1.0 if not r.text and (r.filter_path or r.filter_tags) else 0.0
            score = rule(r.text, doc, title, path, entities or []) or blank
            if okay and score and doc != "bare" and (r.text or blank):
                found.append((-score, doc))
        want += [(r.query_id, doc, 3, -score) for score, doc in sorted(found)[:5]]
    got = [(r.query_id, r.doc_id, r.chunk_index, r.raw_score) for r in rt.structure_channel(asked, cat, chk).collect()]
    assert sorted(got) == sorted(want)


def test_structure_matches_leave_out_what_cannot_be_among_the_best(spark, monkeypatch):
    # A question that stands in all titles met all documents before.
    monkeypatch.setattr(occurrences, "AT_ONCE", 1000)
    cat = catalog(spark, *[(f"d{i:04}", f"the title {i}", "p", [], []) for i in range(3000)]).repartition(4)
    asked = queries(spark, ("the", [], ""), ("title 77", [], ""))
    found = rt.structure_matches(asked, cat).groupBy("query_id").count().collect()
    counts = {r.query_id: r["count"] for r in found}
    assert counts == {0: 50, 1: 11}


def test_containment_join_against_brute_force(spark):
    rng = random.Random(7)

    def word(low, high):
        return "".join(rng.choice("abc d") for _ in range(rng.randint(low, high)))

    needles, hays = {word(1, 5) for _ in range(60)} | {""}, {word(1, 14) for _ in range(80)}
    got = joins.containment_join(
        spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame([(h,) for h in hays], "hay string"))
    want = {(n, h) for n in needles for h in hays if n and n in h}
    rows = [(r.needle, r.hay) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_salted_join_equals_join(spark):
    big = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    small = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c")], "k long, v string")
    plain = sorted(map(tuple, big.join(small, "k").select("k", "id", "v").collect()))
    salted = joins.salted_join(big, small, ["k"], spread=["id"]).select("k", "id", "v")
    assert sorted(map(tuple, salted.collect())) == plain


def test_top_per_query_cuts_before_the_shuffle(spark):
    rows = spark.range(100).select((F.col("id") % 2).alias("query_id"), F.col("id").cast("string").alias("doc_id"), F.lit(3).alias("top_k"), F.col("id").alias("s"))
    plan = joins.top_per_query(rows, "s")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_neighbors_skip_existing_hits_and_keep_the_first(spark):
    chk = spark.createDataFrame([("d", i, 4, "x") for i in range(4)], CHUNKS)
    found = spark.createDataFrame(
        [(1, "d", 1, "keyword", 4.0), (1, "d", 3, "vector", 0.8)],
        "query_id int, doc_id string, chunk_index int, channel string, raw_score double")
    got = {(r.chunk_index, r.channel): r.raw_score for r in rt.neighbor_expand(found, chk).collect()}
    assert got == {(0, "keyword+neighbor"): 4.0 * 0.85, (2, "vector+neighbor"): 0.8 * 0.85}


def test_fuse_keeps_the_stronger_channel(spark):
    cat, chk = small_corpus(spark)
    asked = queries(spark, ("alpha", [], ""))
    found = spark.createDataFrame(
        [(0, "doc-1", 0, "keyword", 1.0), (0, "doc-1", 0, "structure", 9.0)],
        "query_id int, doc_id string, chunk_index int, channel string, raw_score double")
    row = rt.fuse(rt.rerank(found, asked, cat, chk)).collect()
    assert [r.channel for r in row] == ["structure"] and row[0].final_score >= 0.9


# -------------------------------------------------------------------------------- vectors


def vector_table(spark, array, name):
    return spark.createDataFrame([(f"{name}{i:03}", 0, [float(x) for x in v]) for i, v in enumerate(array)],
                                 "doc_id string, chunk_index int, embedding array<double>")


def test_vector_paths_agree_with_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    corpus, asked = rng.normal(size=(60, 8)), rng.normal(size=(9, 8))
    corpus[10:30] = corpus[10]  # a crowd of copies
    corpus[40] = 0
    cat = catalog(spark, *[(f"d{i:03}", "t", "p" if i % 2 else "q", ["x"] if i % 3 else ["y"], []) for i in range(60)])
    rows = [(i, "", 5, ["y"] if i % 4 == 1 else [], "p" if i % 4 == 2 else "", v.tolist()) for i, v in enumerate(asked)]
    q = spark.createDataFrame(rows, "query_id int, text string, top_k int, filter_tags array<string>, filter_path string, embedding array<double>")
    table = vector_table(spark, corpus, "d")

    def cosine(a, b):
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return round(float(a @ b / n), 9) if n else 0.0

    want = set()
    for i, v in enumerate(asked):
        ok = [j for j in range(60) if not (i % 4 == 1 and j % 3) and not (i % 4 == 2 and j % 2 == 0)]
        best = sorted(ok, key=lambda j: (-cosine(v, corpus[j]), f"d{j:03}"))[:5]
        want |= {(i, f"d{j:03}") for j in best}
    codes = vectors.vector_codes(table)
    for kept, some in ((16 << 20, 128 << 10), (2000, 100)):
        monkeypatch.setattr(vectors, "HELD_BYTES", kept)
        monkeypatch.setattr(vectors, "QUERY_BYTES", some)
        for got in (vectors.vector_channel(q, table, cat), vectors.vector_channel_coded(q, codes, table, cat)):
            rows = got.collect()
            assert len(rows) == len(want) and {(r.query_id, r.doc_id) for r in rows} == want
    # Without filters every copy ties, yet few of them are candidates of any query.
    free = q.withColumn("filter_path", F.lit("")).withColumn("filter_tags", F.array().cast("array<string>"))
    found = vectors.vector_candidates(free, codes, cat).groupBy("query_id").count().collect()
    assert all(r["count"] <= 3 * 5 * 60 for r in found)


def test_codes_bound_every_cosine(spark):
    rng = np.random.default_rng(9)
    rows = rng.normal(size=(300, 32)) * rng.uniform(0.01, 100, (300, 1))
    asked = rng.normal(size=(20, 32))
    cat = catalog(spark, *[(f"d{i:03}", "t", "p", [], []) for i in range(300)])
    q = spark.createDataFrame([(i, "", 10, [], "", v.tolist()) for i, v in enumerate(asked)],
                              "query_id int, text string, top_k int, filter_tags array<string>, filter_path string, embedding array<double>")
    table = vector_table(spark, rows, "d")
    true = (asked / np.linalg.norm(asked, axis=1, keepdims=True)) @ (rows / np.linalg.norm(rows, axis=1, keepdims=True)).T
    found = vectors.vector_candidates(q, vectors.vector_codes(table), cat).collect()
    assert all(r.low <= true[r.query_id, int(r.doc_id[1:])] <= r.high for r in found)
    exact = {(r.query_id, r.doc_id): r.raw_score for r in vectors.vector_channel(q, table, cat).collect()}
    coded = {(r.query_id, r.doc_id): r.raw_score for r in vectors.vector_channel_coded(q, vectors.vector_codes(table), table, cat).collect()}
    # Recall 1 from a small share of the rows.
    assert coded == exact and len(exact) == 200 and len(found) < 0.2 * 20 * 300


def test_vectors_of_other_widths_are_no_hits(spark):
    cat = catalog(spark, *[(f"d{i}", "t", "p", [], []) for i in range(4)])
    table = spark.createDataFrame([("d0", 0, [1.0, 0.0]), ("d1", 0, [1.0, 0.0, 0.0]), ("d2", 0, []), ("d3", 0, None)],
                                  "doc_id string, chunk_index int, embedding array<double>")
    q = spark.createDataFrame([(1, "", 5, [], "", [1.0, 1.0]), (2, "", 5, [], "", None), (3, "", 5, [], "", [])],
                              "query_id int, text string, top_k int, filter_tags array<string>, filter_path string, embedding array<double>")
    for got in (vectors.vector_channel(q, table, cat), vectors.vector_channel_coded(q, vectors.vector_codes(table), table, cat)):
        assert [(r.query_id, r.doc_id) for r in got.collect()] == [(1, "d0")]


def test_semantic_pairs_with_copies_and_crowded_cells(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(50, 6))
    base[5:12] = base[4]
    base[20:30] = base[19] + rng.normal(scale=0.05, size=(10, 6))
    base[49] = 0
    unit = np.divide(base, np.linalg.norm(base, axis=1, keepdims=True), out=np.zeros_like(base),
                     where=np.linalg.norm(base, axis=1, keepdims=True) > 0)
    want = {(f"d{i:03}", f"d{j:03}") for i, j in itertools.combinations(range(50), 2) if unit[i] @ unit[j] >= 0.6 - 1e-12}
    table = vector_table(spark, base, "d")
    for pivots, rows in ((64, 4096), (4, 3), (1, 7)):
        got = vectors.semantic_pairs(table, 0.6, pivots=pivots, block_rows=rows).collect()
        assert len(got) == len(want) and {(r.source, r.target) for r in got} == want
    star = {(r.source, r.target) for r in vectors.semantic_pairs(table, 0.6, copies="star").collect()}
    crowd = {f"d{i:03}" for i in range(4, 12)}
    assert {p for p in star if set(p) <= crowd} == {("d004", f"d{i:03}") for i in range(5, 12)}
    assert {p for p in star if not set(p) & crowd} == {p for p in want if not set(p) & crowd}


def test_banded_pairs_are_true_and_few_are_missed(spark):
    rng = np.random.default_rng(9)
    heart = rng.normal(size=(40, 16))
    base = np.repeat(heart, 6, axis=0) + rng.normal(scale=0.35, size=(240, 16))
    base[200:230] = base[200]
    table = vector_table(spark, base, "d")
    exact = {(r.source, r.target): r.similarity for r in vectors.semantic_pairs(table, 0.8).collect()}
    got = vectors.semantic_pairs(table, 0.8, recall=0.99, block_rows=16).collect()
    assert len({(r.source, r.target) for r in got}) == len(got)
    assert all(exact[r.source, r.target] == r.similarity for r in got)
    assert len(got) >= 0.97 * len(exact) > 500
    more, fewer = vectors.band_counts(1000, 0.6, 0.95), vectors.band_counts(1000, 0.9, 0.95)
    assert more[0] == fewer[0] < vectors.band_counts(10**8, 0.9, 0.95)[0] and more[1] > fewer[1]
    with pytest.raises(ValueError):
        vectors.semantic_pairs(table, 0.8, recall=1.0)
    assert vectors.semantic_pairs(table.limit(0), 0.8, recall=0.9).count() == 0


def test_equal_structure_queries_are_answered_once(spark, monkeypatch):
    cat = catalog(spark, *[(f"d{i}", f"Title {i}", "crowded/dir", ["x"], []) for i in range(40)])
    chk = spark.createDataFrame([(f"d{i}", c, 2, "t") for i in range(40) for c in (0, 1)], CHUNKS)
    made = []

    def counted(asked, catalog, _matches=rt.structure_matches):
        made.append(_matches(asked, catalog).count())
        return _matches(asked, catalog)

    monkeypatch.setattr(rt, "structure_matches", counted)
    asked = queries(spark, *[("crowded/dir", [], "")] * 30, ("title 7", [], ""), ("crowded/dir", ["y"], ""))
    got = rt.structure_channel(asked, cat, chk).collect()
    assert made == [41]
    for q in range(30):
        assert sorted(r.doc_id for r in got if r.query_id == q) == ["d0", "d1", "d10", "d11", "d12"]
    assert [(r.query_id, r.doc_id, r.chunk_index, r.raw_score) for r in got if r.query_id >= 30] == [(30, "d7", 0, 8.0)]


def test_bands_copy_vectors_few_times():
    # Each band copies every vector; 2,950 bands of 17 bits did so before.
    bits, bands = vectors.band_counts(100_000, 0.5, 0.95)
    assert bands <= 60 and 100_000 / 2**bits <= 1024
    assert 1 - (1 - (2 / 3) ** bits) ** bands >= 0.95


def test_spread_row_number(spark):
    rows = spark.range(300).select((F.col("id") % 2).alias("k"), F.col("id").cast("string").alias("d"))
    got = {(r.k, r.d): r.n for r in joins.spread_row_number(rows, ["k"], "d", "n").collect()}
    want = {(k, d): n for k in (0, 1) for n, d in enumerate(sorted(str(i) for i in range(300) if i % 2 == k), 1)}
    assert got == want


def test_numbers_of_crowded_ids_come_from_several_ranges(spark):
    # One key has nearly all rows and all its ids begin alike.
    rows = spark.range(2000).select(F.when(F.col("id") < 10, "few").otherwise("most").alias("k"),
                                    F.format_string("document-%05d", (F.col("id") * 7919) % 2000).alias("d"))
    ranged = joins.in_ranges(rows, "k", "d").groupBy("_range").agg(F.count("*").alias("n")).collect()
    assert len(ranged) == 4 and max(r.n for r in ranged) < 1000
    got = [(r.k, r.d, r.n) for r in joins.spread_row_number(rows, ["k"], "d", "n").collect()]
    known = [(r.k, r.d) for r in rows.collect()]
    want = [(k, d, n) for k in ("few", "most") for n, d in enumerate(sorted(d for o, d in known if o == k), 1)]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("offset, limit", [(0, 3), (37, 20), (95, 20), (100, 5), (500, 5)])
def test_rows_from_equal_the_sorted_slice(spark, offset, limit):
    rows = spark.range(100).select((F.col("id") % 3).alias("a"), "id")
    got = [(r.a, r.id) for r in joins.rows_from(rows, [F.col("a").desc(), F.col("id")], offset, limit).collect()]
    assert got == sorted(((i % 3, i) for i in range(100)), key=lambda r: (-r[0], r[1]))[offset:offset + limit]
    assert joins.rows_from(rows.limit(0), [F.col("id")], offset, limit).count() == 0


# ---------------------------------------------------------------------------------- graph


def edges_of(spark, *docs):
    built = build_graph(catalog(spark, *docs))
    return built, {(r.source, r.target, r.relation): r.weight for r in built.edges.collect()}


def test_edge_weights(spark):
    built, edges = edges_of(spark, ("a", "A", "x", ["t1", "t2"], ["Data Portal"]), ("b", "B", "x", ["t1", "t2"], ["data-portal"]))
    assert edges[("a", "b", "co_tag")] == 0.55
    assert edges[("a", "b", "same_directory")] == 0.35
    assert edges[("a", "b", "co_entity")] == 0.65
    entity = built.nodes.filter("file_type = 'entity'").collect()
    assert [(n.label, n.document_count) for n in entity] == [("Data Portal", 2)]
    assert edges[("a", entity[0].id, "declares_core_entity")] == 0.85


def test_large_groups_become_stars(spark):
    _, edges = edges_of(spark, *[(f"doc-{i:02}", "T", "", ["t"], []) for i in range(60)])
    assert set(edges) == {("doc-00", f"doc-{i:02}", "co_tag") for i in range(1, 60)}
    _, small = edges_of(spark, *[(f"doc-{i:02}", "T", "", ["t"], []) for i in range(50)])
    assert len(small) == 50 * 49 // 2


def test_a_graph_has_all_values_of_a_document(spark):
    names = [f"Entity {i:02}" for i in range(50)]
    built, edges = edges_of(spark, ("a", "A", "x", [f"t{i:02}" for i in range(40)], names))
    nodes = {n.id: n for n in built.nodes.collect()}
    assert nodes["a"].entities.split(",") == names and len(nodes["a"].tags.split(",")) == 40
    assert sorted(n.label for n in nodes.values() if n.file_type == "entity") == names
    assert sum(relation == "declares_core_entity" for _, _, relation in edges) == 50


def test_a_graph_links_every_pair_of_equal_or_like_vectors(spark):
    docs = catalog(spark, *[(f"d{i:02}", "T", "", [], []) for i in range(9)])
    # Two crowds of copies that are like each other, and one vector unlike both.
    rows = [(f"d{i:02}", 0, [1.0, 0.0, 0.2] if i < 4 else [1.0, 0.5, 0.0]) for i in range(8)] + [("d08", 0, [0.0, 0.0, -1.0])]
    built = build_graph(docs, spark.createDataFrame(rows, "doc_id string, chunk_index int, embedding array<double>"), 0.4)
    names = [f"d{i:02}" for i in range(8)]
    got = [(r.source, r.target) for r in built.edges.collect()]
    assert sorted(got) == list(itertools.combinations(names, 2))
    stats = graph.graph_stats(built.nodes, built.edges, graph.connected_components(built.nodes, built.edges)).first()
    assert (stats.node_count, stats.edge_count, stats.community_count) == (9, 28, 2)


def test_graph_json_scan(spark, tmp_path):
    doc = {"links": [
        {"source": "a", "target": {"id": "b"}, "relation": "co_entity", "weight": 0.82},
        {"source": "a", "target": "c", "relation": "co_tag", "weight": 0.1},
        {"source": "a", "target": "a", "relation": "co_tag"}, {"source": "c", "target": "d", "label": "co_tag"},
        {"source": "d", "target": "e", "weight": "heavy"}, {"source": "e", "target": "f", "weight": 7}]}
    path = tmp_path / "graph.json"
    path.write_text(json.dumps(doc, indent=1))
    got = {(r.node, r.next): (r.weight, r.relation) for r in graph.adjacency(read_graph_edges(spark, str(path))).collect()}
    assert got == {
        ("a", "b"): (0.82, "co_entity"), ("b", "a"): (0.82, "co_entity"), ("c", "d"): (0.5, "co_tag"), ("d", "c"): (0.5, "co_tag"),
        ("d", "e"): (0.3, "related"), ("e", "d"): (0.3, "related"), ("e", "f"): (1.0, "related"), ("f", "e"): (1.0, "related")}


def expand(spark, filter_path="", hops=1, weight=1.0):
    cat = catalog(spark, ("doc-1", "A", "guides", [], []), ("doc-2", "B", "refs", [], []), ("doc-3", "C", "refs", [], []))
    chk = spark.createDataFrame([(d, i, 2, f"text {i}") for d in ("doc-1", "doc-2", "doc-3") for i in range(2)], CHUNKS)
    edges = spark.createDataFrame(
        [("doc-1", "doc-2", "co_entity", 0.9), ("doc-2", "doc-3", "co_tag", 0.5)], "source string, target string, relation string, weight double")
    found = spark.createDataFrame([(0, "doc-1", 0, 0.9)], "query_id int, doc_id string, chunk_index int, final_score double")
    index = graph.graph_index(edges, cat, chk)
    done = graph.graph_expand(found, queries(spark, ("text 1", [], filter_path)), index, cat, chk, weight=weight, max_hops=hops)
    return {r.doc_id: (round(r.raw_score, 6), r.chunk_index, r.association_reason) for r in done.collect()}


def test_graph_expansion(spark):
    got = expand(spark)
    assert got == {"doc-2": (0.81, 1, "seed=doc-1; hops=1; relations=co_entity; edge_score=0.9000")}
    assert expand(spark, filter_path="guides") == {}
    far = expand(spark, hops=2)["doc-3"]
    assert far == (round(0.9 * 0.9 * 0.5 * 0.75, 6), 1, "seed=doc-1; hops=2; relations=co_entity -> co_tag; edge_score=0.3375")


def test_graph_expansion_of_a_hub_follows_the_index(spark):
    """A node with most links: few ranked links answer like all links, whatever the depth."""
    rng = random.Random(5)
    names = [f"d{i:03}" for i in range(150)]
    cat = catalog(spark, *[(n, "T", "even" if i % 2 == 0 else "odd", [], []) for i, n in enumerate(names)])
    chk = spark.createDataFrame([(n, 0, 1, "x") for n in names], CHUNKS)
    links = [("d000", n, "co_tag", round(rng.uniform(0.3, 1), 3)) for n in names[1:]]
    links += [(*sorted(rng.sample(names, 2)), "co_entity", round(rng.uniform(0.3, 1), 3)) for _ in range(200)]
    edges = spark.createDataFrame(links, "source string, target string, relation string, weight double")
    found = spark.createDataFrame([(q, f"d{q:03}", 0, 0.9) for q in range(4)], "query_id int, doc_id string, chunk_index int, final_score double")
    asked = queries(spark, *[("x", [], p) for p in ("", "", "odd", "even")])
    seen = []
    for depth in (128, 3):
        index = graph.graph_index(edges, cat, chk, depth=depth)
        assert depth == 128 or index.ranked.groupBy("node").count().agg(F.max("count")).first()[0] <= 2 * depth
        for hops in (1, 2, 3):
            done = graph.graph_expand(found, asked, index, cat, chk, max_hops=hops)
            seen.append((depth, hops, sorted((r.query_id, r.doc_id, round(r.raw_score, 9), r.hop) for r in done.collect())))
    assert [rows for d, _, rows in seen if d == 128] == [rows for d, _, rows in seen if d == 3]
    best = {}
    for a, b, _, w in links:
        best[a, b] = best[b, a] = max(w, best.get((a, b), 0))
    one = {q: sorted((-round(0.9 * w * 0.35, 9), n) for (a, n), w in best.items() if a == f"d{q:03}")[:3] for q in (0, 1)}
    assert [(q, n, -s) for q in (0, 1) for s, n in sorted(one[q], key=lambda x: x[1])] == [
        (q, d, s) for q, d, s, _ in seen[0][2] if q < 2]


def test_graph_search_reads_links_in_place(spark):
    cat = catalog(spark, ("a", "A", "p", [], []), ("b", "B", "p", [], []))
    chk = spark.createDataFrame([("a", 0, 1, "x"), ("b", 0, 1, "y")], CHUNKS)
    edges = spark.createDataFrame([("a", "b", "co_tag", 0.5)], "source string, target string, relation string, weight double")
    index = graph.graph_index(edges, cat, chk)
    seeds = spark.createDataFrame([(0, "a", 1, 0.9)], "query_id int, seed_id string, seed_rank int, seed_score double")
    first = index.ranked.filter("document_place <= 5").join(seeds.withColumnRenamed("seed_id", "node"), "node")
    assert "Window" not in first._jdf.queryExecution().executedPlan().toString()
    assert [(r.node, r.returnable) for r in graph.graph_reach(seeds, [index.ranked]).collect()] == [("b", True)]


def test_components_against_brute_force(spark):
    rng = random.Random(11)
    names = [f"n{i:03}" for i in range(120)]
    links = [tuple(rng.sample(names, 2)) for _ in range(70)] + list(zip(names[100:], names[101:]))
    parent = {n: n for n in names}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        one, two = sorted((root(a), root(b)))
        parent[two] = one
    got = graph.connected_components(
        spark.createDataFrame([(n,) for n in names], "id string"), spark.createDataFrame(links, "source string, target string"))
    assert {r.node: r.community for r in got.collect()} == {n: root(n) for n in names}


def _cliques(spark, count, size):
    names = [f"c{c}-{i}" for c in range(count) for i in range(size)]
    edges = [(f"c{c}-{i}", f"c{c}-{j}", 1.0) for c in range(count) for i, j in itertools.combinations(range(size), 2)]
    edges += [(f"c{c}-0", f"c{(c + 1) % count}-1", 0.5) for c in range(count)]
    return (spark.createDataFrame([(n,) for n in [*names, "alone"]], "id string"),
            spark.createDataFrame(edges, "source string, target string, weight double"))


def test_modularity_finds_cliques_and_follows_the_resolution(spark):
    nodes, edges = _cliques(spark, 4, 5)
    nodes, edges = joins.materialize(nodes.coalesce(1)), joins.materialize(edges.coalesce(1))
    got = {r.node: r.community for r in graph.modularity_communities(nodes, edges, patience=2).collect()}
    assert got == {**{f"c{c}-{i}": f"c{c}-0" for c in range(4) for i in range(5)}, "alone": "alone"}
    links = graph.modularity_links(nodes, edges)
    frame = spark.createDataFrame(list(got.items()), "node string, community string")
    total = 4 * 10 + 4 * 0.5
    assert graph.modularity(frame, links) == pytest.approx(40 / total - 4 * (2 * total / 4) ** 2 / (2 * total) ** 2)
    coarse = graph.modularity_communities(nodes, edges, resolution=0.05, patience=1)
    assert coarse.filter("node <> 'alone'").select("community").distinct().count() < 4
    assert graph.modularity_communities(nodes, edges.limit(0)).filter("node <> community").count() == 0
    assert graph.modularity(frame, links.limit(0)) == 0.0


def test_modularity_rounds_move_links_once(spark, monkeypatch):
    """The ties that the moves are made from give the modularity, also with hubs and links of a node with itself."""
    rng = random.Random(8)
    rows = [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", rng.randrange(1, 9) / 10) for _ in range(50)]
    edges = spark.createDataFrame(rows + [("n0", "n0", 0.7)], "source string, target string, weight double")
    links = joins.materialize(graph.modularity_links(edges, edges.coalesce(1)))
    degrees = links.groupBy("node").agg(F.sum("w").alias("degree"))
    members = degrees.select("node", F.concat(F.lit("c"), F.pmod(F.substring("node", 2, 2).cast("int"), F.lit(3))).alias("community"))
    placed = members.join(degrees, "node")
    ties = graph._ties(links, placed, 2)
    sums = graph._sums(ties).collect()
    total = sum(r.total_degree for r in sums)
    assert total == links.agg(F.sum("w")).first()[0]
    got = sum(r.inner for r in sums) / total - sum(float(r.total_degree) ** 2 for r in sums) / total / total
    assert got == pytest.approx(graph.modularity(members, links), abs=1e-12)
    for number in range(2):
        moved = graph._moves(ties, graph._sums(ties), placed, total, number, 1.0, 2).drop("degree")
        assert set(moved.collect()) == set(graph.local_moves(links, members, degrees, total, number).collect())
    calls, modularity = [], graph.modularity
    monkeypatch.setattr(graph, "modularity", lambda *a: (calls.append(1), modularity(*a))[1])
    nodes, edges = _cliques(spark, 2, 3)
    got = {r.node: r.community for r in graph.modularity_communities(nodes, edges, patience=1).collect()}
    assert got == {**{f"c{c}-{i}": f"c{c}-0" for c in range(2) for i in range(3)}, "alone": "alone"}
    assert len(calls) == 1


def test_modularity_is_at_least_that_of_label_propagation(spark):
    rng = random.Random(3)
    names = [f"n{i:02}" for i in range(60)]
    pairs = {tuple(sorted(rng.sample(names, 2))) for _ in range(60)}
    pairs |= {(a, b) for a, b in itertools.combinations(names, 2) if a[1] == b[1] and rng.random() < 0.5}
    pairs |= {("n00", n) for n in names[1:]}  # a hub
    nodes = spark.createDataFrame([(n,) for n in names], "id string")
    edges = spark.createDataFrame([(a, b, rng.choice([0.3, 0.6, 0.9])) for a, b in sorted(pairs)],
                                  "source string, target string, weight double")
    links = joins.materialize(graph.modularity_links(nodes, edges))
    moved = joins.materialize(graph.modularity_communities(nodes, edges, patience=2))
    spread = joins.materialize(graph.label_propagation(nodes, edges, rounds=3))
    assert moved.count() == 60
    assert graph.modularity(moved, links) >= graph.modularity(spread, links)


def test_hybrid_search_without_vectors_or_graph(spark):
    cat, chk = small_corpus(spark)
    corpus = Corpus(cat, chk, rt.keyword_index(rt.build_postings(cat, chk)))
    rows = hybrid_search(queries(spark, ("data portal", [], "")), corpus).orderBy("rank").collect()
    assert rows[0].doc_id == "doc-1" and rows[0].context_after == "rollback steps"
    assert rows[0].citation == "guides:Alpha Manual#chunk-0"
    assert {r.channel for r in rows} <= {"keyword", "structure", "keyword+neighbor", "structure+neighbor"}


def test_hybrid_search_embeds_queries_and_takes_parts_from_the_caller(spark):
    cat, chk = small_corpus(spark)
    corpus = Corpus(cat, chk, rt.keyword_index(rt.build_postings(cat, chk)), embed_chunks(chk.select("doc_id", "chunk_index", "content")))
    asked = queries(spark, ("rollback steps", [], ""), ("  ", [], ""))

    def failing(texts):
        raise ConnectionError("down")

    seen = []

    def last_document(hits, asked, corpus):
        seen.append(sorted({r.query_id for r in hits.collect()}))
        return hits.filter("rank = 1").select(
            "query_id", F.lit("doc-3").alias("doc_id"), F.lit(0).alias("chunk_index"), F.lit("graph").alias("channel"),
            F.lit(0.2).alias("raw_score"), F.col("doc_id").alias("seed_id"), F.lit(1).alias("hop"), F.lit(0.5).alias("path_weight"),
            F.array(F.lit("cites")).alias("relations"), F.lit("cited").alias("association_reason"))

    found = hybrid_search(asked, corpus, providers=[failing, hashed_terms], expander=last_document,
                          postprocessor=lambda scored: rt.fuse(scored.filter("doc_id <> 'doc-2'"))).collect()
    best = {r.doc_id: r for r in found if r.query_id == 0}
    assert best["doc-1"].channel == "vector" and "doc-2" not in best
    assert best["doc-3"].channel == "graph" and best["doc-3"].association_reason == "cited"
    assert seen == [[0]] and {r.query_id for r in found} == {0}
    plain = hybrid_search(asked, corpus).collect()
    assert "vector" not in {r.channel for r in plain}


def test_keyword_blocks_keep_chunks_whole_and_rows_few(spark, monkeypatch):
    """Chunks cut across many small blocks, ties by document; no row is made for each (query, chunk) pair."""
    from lorespark.operators import keyword_blocks as kb

    rows = [(f"d{i:03d}", "T", "p", ["x"] if i % 2 else ["y"], []) for i in range(60)]
    cat = catalog(spark, *rows)
    chk = spark.createDataFrame([(r[0], c, 3, f"alpha beta{i % 7} gamma alpha") for i, r in enumerate(rows) for c in range(3)], CHUNKS)
    index = rt.keyword_index(rt.build_postings(cat, chk))
    asked = queries(spark, ("alpha", [], ""), ("eta3 gamma", ["x"], ""), ("beta1", [], "nowhere"))
    assert [f.name for f in index.vocabulary.schema] == ["hay"]
    got = rt.keyword_scan_channel(asked, index, cat).collect()
    first = [r.doc_id for r in sorted((r for r in got if r.query_id == 0), key=lambda r: (r.doc_id, r.chunk_index))]
    assert first == ["d000"] * 3 + ["d001"] * 2 and {r.raw_score for r in got if r.query_id == 0} == {2.0}
    assert [(r.doc_id, r.raw_score) for r in sorted(got, key=lambda r: (r.doc_id, r.chunk_index)) if r.query_id == 1] == [
        ("d003", 2.0)] * 3 + [("d017", 2.0)] * 2
    assert not [r for r in got if r.query_id == 2]
    assert rt.keyword_recall(asked, index, cat).count() == 60 * 3 + 30 * 3
    # Three chunks, two of one hash and mixed, over batches of two rows and blocks of about one.
    keys = [(1, "a", 0), (1, "b", 0), (1, "a", 0), (1, "b", 0), (2, "a", 1)]
    table = pa.table({"hash": [k[0] for k in keys], "doc_id": [k[1] for k in keys], "chunk_index": [k[2] for k in keys]})
    monkeypatch.setattr(kb, "HELD_BYTES", 20)
    cut = [(part.num_rows, starts.tolist()) for part, starts in kb._whole_chunks(iter(table.to_batches(max_chunksize=2)))]
    assert cut == [(4, [0, 2]), (1, [0])]


def test_rare_terms_are_listed_and_frequent_ones_multiplied(spark, monkeypatch):
    """Both ways give the same points; a term that one query asks for takes no column of the matrix."""
    from lorespark.operators import keyword_blocks as kb

    rng = np.random.default_rng(3)
    lists = [sorted(rng.choice(40, 6).tolist()) + [99] for _ in range(30)]
    block = pa.table({
        "query_id": list(range(30)), "top_k": [5] * 30, "terms": lists, "free": [True] * 30,
        "filters": pa.array([[]] * 30, pa.list_(pa.int64()))})
    terms = sorted({t for own in lists for t in own})
    cell = np.unique(rng.integers(0, 20 * len(terms), 200))
    worth = rng.integers(1, 20, len(cell)) / 2.0
    dense, asks = np.zeros((20, len(terms))), np.array([[own.count(t) for own in lists] for t in terms])
    dense[cell // len(terms), cell % len(terms)] = worth
    for listed, columns in ((8, int((np.count_nonzero(asks, axis=1) > 8).sum())), (0, len(terms)), (30, 0)):
        monkeypatch.setattr(kb, "LISTED", listed)
        asked = kb._Asked(block)
        assert asked.weight.shape == (columns, 30)
        got = asked.add_up(cell // len(terms), cell % len(terms), worth, 20)
        assert got.tolist() == (dense @ asks).tolist()


def test_postings_shuffle_texts_and_not_tokens(spark):
    """Repeated words of a chunk are counted where its text lies."""
    cat, chk = small_corpus(spark)
    built = rt.build_postings(cat, chk.union(spark.createDataFrame([("doc-2", 1, 2, "beta beta api")], CHUNKS)))
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and "hashpartitioning(term" not in plan
    rows = {r.term: (r.tf, r.fields) for r in built.filter("doc_id = 'doc-2' AND chunk_index = 1").collect()}
    assert rows == {"beta": (2, 1), "api": (1, 0), "reference": (0, 1), "refs": (0, 2), "doc-2": (0, 0)}


def test_similar_pairs_copy_no_vector_to_other_cells(spark, monkeypatch):
    """Vectors that visit many cells are read there, not written once a cell."""
    rng = np.random.default_rng(5)
    points = rng.standard_normal((300, 4))
    table = spark.createDataFrame([(f"d{i}", p.tolist()) for i, p in enumerate(points)], "doc_id string, embedding array<double>")
    written = []

    def counting(df):
        done = joins.materialize(df)
        written.append(done.count())
        return done

    monkeypatch.setattr(vectors, "materialize", counting)
    got = vectors.semantic_pairs(table, 0.3, pivots=20, block_rows=16).collect()
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    near = np.rint(unit @ unit.T * vectors.SCALE) / vectors.SCALE >= 0.3
    expected = {tuple(sorted((f"d{i}", f"d{j}"))) for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True)}
    assert {(r.source, r.target) for r in got} == expected and len(got) == len(expected)
    assert max(written) == 300
