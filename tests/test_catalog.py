"""Catalog maintenance, consistency, snapshots, rate windows, ingestion and streams."""

import random

import pytest
from pyspark.sql import functions as F

from lorespark.functions import text
from lorespark.functions.embedding import embed_chunks, hashed_terms
from lorespark.operators import catalog as cg
from lorespark.operators import consistency, rates
from lorespark.plans.ingest import ingest_documents, reindex
from lorespark.sources import committed, files, tables
from lorespark.streaming import jobs


def paths_table(spark, *paths):
    return spark.createDataFrame([(str(i), p) for i, p in enumerate(paths)], "doc_id string, path string")


def test_listing_is_newest_first_with_total(spark):
    docs = spark.range(5).select(F.col("id").cast("string").alias("doc_id"), F.timestamp_seconds("id").alias("created_at"))
    rows = cg.list_documents(docs, limit=2, offset=2).collect()
    assert [(r.doc_id, r.total) for r in rows] == [("2", 5), ("1", 5)]


def test_rename_directory(spark):
    docs = paths_table(spark, "a", "a/b", "ab", "")
    moved = [r.path for r in cg.rename_directory(docs, "a", "x/y").orderBy("doc_id").collect()]
    assert moved == ["x/y", "x/y/b", "ab", ""]
    assert cg.rename_directory(docs, "a", "/a/") is docs
    for old, new in (("", "x"), ("a", "a/c"), ("a", "ab")):
        with pytest.raises(ValueError):
            cg.rename_directory(docs, old, new, known_dirs=docs)
    with pytest.raises(ValueError):
        cg.delete_directory(docs, "/")


def test_directory_tree_counts_only_direct_documents(spark):
    tree = cg.directory_tree(paths_table(spark, "a", "a/b", "a/b", ""), spark.createDataFrame([("c/d",)], "path string"))
    assert {(r.path, r.doc_count) for r in tree.collect()} == {("a", 1), ("a/b", 2), ("c", 0), ("c/d", 0)}
    assert [r.name for r in cg.child_dirs(tree, "").orderBy("name").collect()] == ["a", "c"]


def test_similar_prefers_hash_and_caps_matches(spark):
    live = spark.createDataFrame([(f"d{i}", "Same", "p", "h") for i in range(8)] + [("e", "Other", "p", "x")],
                                 "doc_id string, title string, path string, content_hash string")
    new = spark.createDataFrame([("n", " same ", "p", "h")], "in_id string, title string, path string, content_hash string")
    found = cg.find_similar(new, live).orderBy("rank").collect()
    assert [(r.doc_id, r.reason) for r in found] == [(f"d{i}", "content_hash") for i in range(5)]
    near = spark.createDataFrame([("n", "e", 0.95)], "in_id string, doc_id string, similarity double")
    other = new.withColumn("content_hash", F.lit("none")).withColumn("title", F.lit("none"))
    decided = cg.upsert_actions(other, cg.find_similar(other, live, near), "semantic").first()
    assert (decided.target_id, decided.action) == ("e", "updated")


def test_consistency_codes(spark):
    docs = spark.createDataFrame([("ok", "t", "p", 1), ("gone", "t", "p", 1), ("less", "t", "p", 2)],
                                 "doc_id string, title string, path string, chunk_count int")
    chunks = spark.createDataFrame(
        [("ok", 0, "s/ok", True), ("less", 0, "", True), ("lost", 0, "", True), ("", 1, "", True), ("x", 2, "", False)],
        "doc_id string, chunk_index int, source_path string, metadata_ok boolean")
    sources = spark.createDataFrame([("ok", "p", "s/ok"), ("less", "p", "s/less")], "doc_id string, path string, source_path string")
    issues = consistency.consistency_issues(docs, chunks, sources)
    assert {(r.code, r.doc_id) for r in issues.collect()} == {
        ("missing_chunks", "gone"), ("missing_source", "gone"), ("chunk_count_mismatch", "less"), ("orphan_document", "lost"),
        ("missing_doc_id", ""), ("invalid_metadata", "")}
    summary = consistency.consistency_summary(issues, docs, chunks).first()
    assert (summary.success, summary.errors, summary.warnings) == (False, 2, 4)


def test_rebuild_drops_stale_and_keeps_extra_fields(spark):
    rows = [("a", i, "T", "p", ["x"], [], None, None) for i in range(2)]
    chunks = spark.createDataFrame(rows, "doc_id string, chunk_index int, title string, path string, tags array<string>, "
                                   "entities array<string>, created_at timestamp, updated_at timestamp")
    old = chunks.limit(1).select("doc_id", "title", "path", "tags", "entities", "created_at", "updated_at").withColumns(
        {"content_hash": F.lit("h"), "chunk_count": F.lit(9), "write_status": F.lit("updating")})
    stale = old.withColumn("doc_id", F.lit("stale"))
    got = cg.rebuild_catalog(chunks, old.union(stale)).collect()
    assert [(r.doc_id, r.chunk_count, r.content_hash) for r in got] == [("a", 2, "h")]


def test_snapshot_merge_policies(spark):
    live = spark.createDataFrame([("a.md", "1"), ("a.restored-1.md", "2"), ("b", "3")], "relpath string, sha256 string")
    archive = spark.createDataFrame([("a.md", "9"), ("c.md", "8"), ("b", "7")], "relpath string, sha256 string")

    def merged(policy):
        return {(r.relpath, r.sha256) for r in files.merge_snapshot(live, archive, policy).collect()}

    kept = {("a.md", "1"), ("a.restored-1.md", "2"), ("b", "3")}
    assert merged("skip") == kept | {("c.md", "8")}
    assert merged("overwrite") == {("a.md", "9"), ("a.restored-1.md", "2"), ("b", "7"), ("c.md", "8")}
    assert merged("rename") == kept | {("c.md", "8"), ("a.restored-2.md", "9"), ("b.restored-1", "7")}
    assert merged("replace_all") == {("a.md", "9"), ("c.md", "8"), ("b", "7")}


def test_files_and_manifest(spark, tmp_path):
    (tmp_path / "x" / "d1").mkdir(parents=True)
    (tmp_path / "x" / "d1" / "source.md").write_bytes(b"hello")
    found = files.read_files(spark, str(tmp_path), "*.md")
    row = files.manifest(found).first()
    assert (row.relpath, row.size) == ("x/d1/source.md", 5)
    verdicts = files.verify_manifest(
        files.manifest(found).union(spark.createDataFrame([("gone.md", "0", 1)], "a string, b string, c long")),
        files.manifest(found).withColumn("sha256", F.lit("bad")))
    assert {(r.relpath, r.verdict) for r in verdicts.collect()} == {("x/d1/source.md", "checksum_mismatch"), ("gone.md", "missing")}


def test_bucketed_postings_are_not_shuffled(spark):
    post = spark.createDataFrame([("a", "d", 0), ("b", "e", 1)], "term string, doc_id string, chunk_index int")
    tables.write_postings(post, "test_postings", 4)
    try:
        asked = spark.createDataFrame([("a",)], "term string").hint("merge")
        plan = spark.table("test_postings").join(asked, "term")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= 1
    finally:
        spark.sql("DROP TABLE test_postings")


# ----------------------------------------------------------------------------- rate windows


def brute_windows(times, width):
    opened, windows = None, {}
    for t in sorted(times):
        if opened is None or t >= opened + width:
            opened = t
        windows[opened] = windows.get(opened, 0) + 1
    return windows


def given_windows(spark, times, width):
    rows = [(k, t) for k, ts in times.items() for t in ts]
    asked = spark.createDataFrame(rows, "key string, s long").select("key", F.timestamp_seconds("s").alias("ts"))
    got = rates.anchored_rate_windows(asked, width, 3).collect()
    return {(r.key, int(r.opened_at.timestamp())): (r.requests, r.rejected) for r in got}, len(got)


@pytest.mark.parametrize("width, span", [(60, 3000), (7, 3000), (1, 200)])
def test_rate_windows_against_brute_force(spark, monkeypatch, width, span):
    monkeypatch.setattr(rates, "SPAN", 4)
    rng = random.Random(width)
    # One key with nine tenths of the rows, a null key, gaps, full cells, repeated times.
    times = {"busy": [rng.randrange(0, span) for _ in range(900)], "edge": list(range(0, 1200, 60)) + [59, 60, 61],
             "rare": [5, 64, 65, 66, 2000], "gap": [10, 69, 70, 700, 1290], "one": [77, 77], None: [3, 4, 70, 500]}
    got, rows = given_windows(spark, times, width)
    want = {(k, o): (n, max(n - 3, 0)) for k, ts in times.items() for o, n in brute_windows(ts, width).items()}
    assert got == want and rows == len(want)


def test_rate_windows_chain_only_requests_without_a_pause_before(spark, monkeypatch):
    asked, successors = [], rates.successors

    def counted(times, width):
        asked.append(times.count())
        return successors(times, width)

    monkeypatch.setattr(rates, "SPAN", 4)
    monkeypatch.setattr(rates, "successors", counted)
    # Pauses everywhere but in one key, whose requests from 100 to 200 are left; times before 1970, over the ends of spans.
    times = {f"k{i}": [i * 7 - 500 + 90 * j + d for j in range(20) for d in (0, 20)] for i in range(5)} | {
        "run": [10, 65, 100, 130, 170, 200, 400]}
    got, rows = given_windows(spark, times, 60)
    want = {(k, o): (n, max(n - 3, 0)) for k, ts in times.items() for o, n in brute_windows(ts, 60).items()}
    assert got == want and rows == len(want)
    assert asked == [4]


def test_rate_windows_of_nothing(spark):
    empty = spark.createDataFrame([], "key string, ts timestamp")
    assert rates.anchored_rate_windows(empty).count() == 0
    assert rates.anchored_rate_windows(spark.sql("SELECT 'a' AS key, CAST(NULL AS TIMESTAMP) AS ts")).count() == 0


# ----------------------------------------------------------------------- ingestion, streams

UPLOAD = "doc_id string, title string, content string, path string, tags array<string>"


def test_ingest_splits_good_and_rejected(spark):
    docs = spark.createDataFrame([
        ("a", "A", "Tags: x\r\n\r\nbody", "/p\\q/", ["X", "y"]), ("b", " ", "body", "", []), ("c", "C", " \n", "", None)], UPLOAD)
    done = ingest_documents(docs, F.lit("2025-01-01").cast("timestamp"))
    row = done.catalog.first()
    assert (row.doc_id, row.path, row.tags, row.chunk_count) == ("a", "p/q", ["X", "y"], 1)
    assert row.content_hash == done.sources.select(text.content_hash(F.col("content")).alias("h")).first().h
    failed = {(r.doc_id, r.node, r.error) for r in done.log.filter("status = 'failed'").collect()}
    assert failed == {("b", "parse_markdown", "blank_title"), ("c", "parse_markdown", "blank_content")}
    assert done.log.filter("doc_id = 'a'").count() == 7
    assert done.postings.filter("term = 'body'").count() == 1


def test_reindex_refreshes_header_tags_and_keeps_manual_ones(spark):
    row = [("a", "A", "p", "Tags: refreshed\nEntities: New", ["manual", "Old Tag"], ["old-tag"], False, [], [])]
    docs = spark.createDataFrame(row, "doc_id string, title string, path string, content string, tags array<string>, "
                                 "old_header_tags array<string>, metadata_overridden boolean, tags_override array<string>, entities_override array<string>")
    got = reindex(docs).catalog.first()
    assert (got.tags, got.entities) == (["manual", "refreshed"], ["New"])


def test_embedding_batches_and_fallback(spark):
    def short(texts):
        return [[0.0]] * (len(texts) - 1)

    chunks = spark.range(450).select(F.concat(F.lit("t "), F.col("id").cast("string")).alias("content")).coalesce(1)
    done = embed_chunks(chunks, short, hashed_terms)
    assert done.filter("size(embedding) = 64").count() == 450
    with pytest.raises(Exception, match="no embedding provider"):
        embed_chunks(chunks, short).collect()


def test_stream_replaces_deletes_and_survives_a_repeated_batch(spark, tmp_path):
    folder = str(tmp_path / "store")
    schema = "doc_id string, seq int, op string, title string, content string, path string, tags array<string>"

    def batch(*rows):
        return spark.createDataFrame([(d, s, o, "T", c, "", []) for d, s, o, c in rows], schema)

    first = batch(("a", 1, "upsert", "one"), ("b", 1, "upsert", "two"), ("a", 2, "upsert", "newer"))
    jobs.ingest_batch(first, folder, 0)
    jobs.ingest_batch(first, folder, 0)
    jobs.ingest_batch(batch(("b", 3, "delete", ""), ("c", 1, "upsert", "three"), ("a", 3, "upsert", " ")), folder, 1)

    def current(name):
        return {r.doc_id for r in jobs.read_current(spark, folder, name).collect()}

    assert current("catalog") == current("chunks") == {"a", "c"}
    texts = {r.content for r in jobs.read_current(spark, folder, "chunks").collect()}
    assert texts == {"newer", "three"}  # the rejected update of a changed nothing
    jobs.compact(spark, folder, str(tmp_path / "compact"))
    assert {r.doc_id for r in jobs.read_current(spark, str(tmp_path / "compact"), "chunks").collect()} == {"a", "c"}


def test_audit_log_round_trip(spark, tmp_path):
    folder = str(tmp_path / "audit")
    tables.append_audit(spark.createDataFrame([("login",)], "action string"), folder)
    day = next((tmp_path / "audit").glob("day=*"))
    (day / "part-broken.json").write_text('\n\n{"broken": \n')
    rows = tables.read_audit(spark, folder).filter("action IS NOT NULL").collect()
    assert [(r.action, r.actor, r.success) for r in rows] == [("login", "system", True)]


def test_commits_are_seen_whole_and_rewrites_lose_nothing(spark, tmp_path):
    store = str(tmp_path / "versions")
    with pytest.raises(FileNotFoundError):
        committed.read(spark, store)
    assert committed.rewrite(spark, store, lambda rows: rows) == 0
    rows = [spark.range(10 * i, 10 * i + 10).withColumn("text", F.col("id").cast("string")) for i in range(4)]
    assert [committed.append(r, store) for r in rows[:2]] == [1, 2]
    rows[3].write.parquet(f"{store}/parts/part-unfinished")  # written, never published
    early = committed.read(spark, store)

    def while_another_appends(df):
        committed.append(rows[2], store)
        return df.coalesce(1)

    assert committed.rewrite(spark, store, while_another_appends) == 4
    ids = [r.id for r in committed.read(spark, store).orderBy("id").collect()]
    assert ids == list(range(30))
    assert early.count() == 20 and committed.read(spark, store, at=1).count() == 10
    # A number that is taken is not published twice.
    assert not committed._Store(spark, store).publish(4, {"parts": []})
    assert len(committed.clean(spark, store, keep=1)) == 3
    assert committed.read(spark, store).count() == 30
    committed.replace(rows[0], store)
    assert committed.read(spark, store).count() == 10


def test_versions_are_read_back(spark, tmp_path):
    docs = spark.createDataFrame([("d1", "T", "text", "p", ["a"])], "doc_id string, title string, content string, path string, tags array<string>")
    for reason in ("manual", "before_delete"):
        tables.append_versions(cg.snapshot(docs, reason, "admin", F.current_timestamp()), str(tmp_path))
    tables.compact_versions(spark, str(tmp_path))
    got = tables.read_versions(spark, str(tmp_path))
    assert sorted(r.reason for r in got.collect()) == ["before_delete", "manual"]
    assert got.select("version_id").distinct().count() == 2


def test_late_requests_are_counted_and_kept(spark, tmp_path):
    def batch(number, *times):
        rows = spark.createDataFrame([("k", t) for t in times], "key string, t string").select("key", F.col("t").cast("timestamp").alias("ts"))
        jobs.count_batch(rows, str(tmp_path), number)

    batch(0, "2024-01-01 10:05:00", "2024-01-01 12:30:00")
    for _ in range(2):  # a batch that is run again counts once
        # At 12:30 less an hour, the hour from 10 is closed and that from 11 is open.
        batch(1, "2024-01-01 10:59:59", "2024-01-01 11:00:00", None)
    got = {(str(r.bucket)[11:13] if r.bucket else None): (r.requests, r.late_requests) for r in jobs.read_counts(spark, str(tmp_path)).collect()}
    assert got == {"10": (1, 1), "12": (1, 0), "11": (1, 0), None: (0, 1)}
    assert spark.read.parquet(str(tmp_path / "late")).count() == 2


def test_semantic_matches_by_head_and_directory(spark):
    live = spark.createDataFrame([("a", "A", "p", ["x"], "h1"), ("b", "B", "q", [], "h2"), ("c", "C", "p", [], "h3")],
                                 "doc_id string, title string, path string, tags array<string>, content_hash string")
    texts = spark.createDataFrame([("a", 0, "red fox"), ("a", 1, "red fox jumps"), ("b", 0, "red fox jumps"), ("c", 0, "blue whale")],
                                  "doc_id string, chunk_index int, content string")
    stored = embed_chunks(texts)
    new = spark.createDataFrame([("n1", "N", "p", "red fox jumps", "x1"), ("n2", "N", "", "red fox jumps", "x2"), ("n3", "N", "p", "  ", "x3")],
                                "in_id string, title string, path string, content string, content_hash string")
    near = cg.semantic_matches(new, live, stored)
    best = {r.in_id: (r.doc_id, r.reason) for r in cg.find_similar(new, live, near).filter("rank = 1").collect()}
    assert best == {"n1": ("a", "semantic"), "n2": ("a", "semantic")}
    decided = cg.upsert_actions(new, cg.find_similar(new, live, near), match_strategy="semantic")
    assert {r.in_id: (r.target_id, r.action) for r in decided.collect()} == {
        "n1": ("a", "updated"), "n2": ("a", "updated"), "n3": (None, "created")}
    short = {r.in_id: r.similarity for r in cg.semantic_matches(new, live, stored, head_chars=7, top_k=1).collect()}
    assert short["n1"] == 1.0  # the head alone is the first chunk of a


def test_stream_reads_tables_of_part_files_and_single_files(spark, tmp_path):
    rows = spark.range(20).select(F.col("id").alias("n"))
    rows.repartition(3).write.parquet(str(tmp_path / "given" / "docs.parquet"))
    part = next((tmp_path / "given" / "docs.parquet").glob("part-*"))
    (tmp_path / "given" / "one.parquet").write_bytes(part.read_bytes())
    for name, wanted in (("docs", 20), ("one", spark.read.parquet(str(part)).count())):
        seen, out = str(tmp_path / f"seen-{name}"), str(tmp_path / f"out-{name}")
        stream = jobs.read_stream(spark, str(tmp_path / "given"), "n long", f"{name}.parquet")
        stream.writeStream.format("parquet").option("checkpointLocation", seen).option("path", out).trigger(
            availableNow=True).start().awaitTermination()
        assert spark.read.schema("n long").parquet(out).count() == wanted
