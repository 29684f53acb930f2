"""Exact top-k against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.llm import exact_topk
from lorespark.llm.queries import ORACLES, QUERIES

VECTORS = "vec_id long, embedding array<double>, label int"


def brute(vectors, queries, k, scale=1024):
    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return tuple(math.floor(max(-2.0**52, min(2.0**52, x * scale))) for x in v)

    rows = [(i, whole(v)) for i, v in vectors if whole(v) is not None]
    out = []
    for q, v in {(i, whole(v)) for i, v in queries if i is not None and whole(v) is not None}:
        found = [(-max(-2**61, min(2**61, sum(a * b for a, b in zip(v, c)))), i is None, i or 0, i)
                 for i, c in rows if len(c) == len(v) and (i is None or i != q)]
        out += [(q, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:k])]
    return sorted(out, key=repr)


def run(spark, vectors, queries, k, scale=1024):
    def frame(rows):
        return spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS).withColumn("rank", F.lit("clash")).withColumn(
            "score", F.lit(None)).repartition(3)

    got = exact_topk.top_k(frame(vectors), frame(queries), k, scale).collect()
    return sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in got), key=repr)


def near(seed, n, d):
    return [(i, [float(x) for x in row]) for i, row in enumerate(np.random.default_rng(seed).normal(0, 0.1, (n, d)))]


@pytest.mark.parametrize("bins,hold,block", [(1024, 16 << 20, 64 << 10), (64, 9000, 1000)])
def test_equals_brute_force(spark, monkeypatch, bins, hold, block):
    monkeypatch.setattr(exact_topk, "BINS", bins)
    monkeypatch.setattr(exact_topk, "HOLD_BYTES", hold)
    monkeypatch.setattr(exact_topk, "BLOCK_BYTES", block)
    rows = near(1, 400, 8)
    # A third of all rows are copies, so kth values are ties of many.
    rows += [(1000 + i, rows[0][1]) for i in range(200)]
    queries = [r for r in rows if r[0] % 50 == 0]
    assert run(spark, rows, queries, 7) == brute(rows, queries, 7)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [2.0, 1.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]),
            (5, []), (6, []), (7, [1.0]), (8, [1e300, 1e300]), (9, [-1e300, -1e300]), (10, [0.0, 0.0]), (None, [1.0, 2.0]),
            (None, [1.0, 2.0]), (11, [1.0, 2.0]), (11, [1.0, 2.0]), (-3, [1.0, 2.0]), (2**62, [1.0, 2.0])]
    for k in (3, 50):
        assert run(spark, rows, rows, k, 2) == brute(rows, rows, k, 2)


def test_nothing(spark):
    assert run(spark, [], [], 3) == []
    assert run(spark, near(2, 5, 3), [], 3) == [] and run(spark, [], near(2, 5, 3), 3) == []
    assert run(spark, [(100, [1.0])], [(100, [1.0])], 3) == []


def test_products_are_exact():
    rng = np.random.default_rng(5)
    for size in (2**10, 2**24, 2**30, 2**50):
        q, c = rng.integers(-size, size, (4, 9)), rng.integers(-size, size, (6, 9))
        want = np.clip(q.astype(object) @ c.T.astype(object), -2**61, 2**61)
        assert (exact_topk.products(q, c) == want).all()


def test_no_scores_are_moved(spark):
    """A pass returns few counts of each query and task, however many rows tie."""
    rows = [(i, [0.5, 0.5]) for i in range(3000)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS).repartition(2)
    got = exact_topk.top_k(frame, frame.filter("vec_id < 5"), 4)
    assert sorted((r.query_id, r.vec_id) for r in got.collect()) == [
        (q, c) for q in range(5) for c in [i for i in range(6) if i != q][:4]]


def test_query_against_sql(spark):
    import duckdb

    path = "/root/testdata/sf0.001"
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'")
    rows = sql.execute(ORACLES["op12_exact_topk"]).fetchall()
    columns = [c[0] for c in sql.description]
    got = QUERIES["op12_exact_topk"](spark, path).select(*columns).collect()
    assert sorted(tuple(map(int, r)) for r in got) == sorted(tuple(map(int, r)) for r in rows) and rows
