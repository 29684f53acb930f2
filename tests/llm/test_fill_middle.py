"""Fill-in-middle texts against the plain definition, and exact round trips."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lorespark.llm import fill_middle
from tests.llm.helpers import docs, prose


def plainly(doc_id, text, seed=1):
    """The contract, on strings."""
    text = text or ""
    n = len(text)
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[i:i + 8], 16) for i in range(0, 32, 8))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("step", [1, 3, 1 << 16])
def test_rotation_exchanges_blocks(monkeypatch, step):
    monkeypatch.setattr(fill_middle, "STEP", step)
    rng = random.Random(3)
    for _ in range(200):
        data = bytes(rng.randrange(256) for _ in range(rng.randrange(30)))
        a, b, c = sorted(rng.randrange(len(data) + 1) for _ in range(3))
        buf = bytearray(data)
        fill_middle.rotate(buf, a, b, c)
        assert bytes(buf) == data[:a] + data[b:c] + data[a:b] + data[c:]
        fill_middle.rotate(buf, a, a + c - b, c)
        assert bytes(buf) == data


TEXTS = [None, "", "a", "é漢字🙂 ünï", "x<P>y", "<S>", "ends <M>", "<", "<P", "P>", "<<P<S<M>>"[:6], "<P" * 50, ">" * 40,
         "\x00 \n\r\t", prose(5, 40_000) + " é", "same text", "same text"]


def test_equals_the_plain_definition(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1000 + i, TEXTS[i % 17]) for i in range(300)]
    rows += [(None, "no id"), (None, "no id"), (-5, "negative"), (7, "again"), (7, "again")]
    frame = docs(spark, rows).withColumn("form", F.lit("clash")).withColumn("output", F.lit(1)).withColumn("_x", F.lit(None))
    made = fill_middle.restore(fill_middle.fill_in_middle(frame.repartition(3)))
    got = made.collect()
    want = sorted((repr((d, *plainly(d, t))) for d, t in rows))
    assert sorted(repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, bytes(r.output).decode())) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert sorted(bytes(r.restored) for r in got) == sorted((t or "").encode() for _, t in rows)
    assert {"lang", "source", "_x"} <= set(made.columns) and "text" not in made.columns


def test_batches_of_few_bytes(spark, monkeypatch):
    run = fill_middle._by_row
    monkeypatch.setattr(fill_middle, "SLICE", 10)
    assert run is fill_middle._by_row
    rows = [(i, "word " * (i % 9)) for i in range(60)]
    got = fill_middle.restore(fill_middle.fill_in_middle(docs(spark, rows))).collect()
    assert {(r.doc_id, bytes(r.restored).decode()) for r in got} == set(rows)


def test_bytes_that_are_not_text(spark):
    frame = spark.createDataFrame([(i, bytearray(b"ab\xff\xfe\xc3cd" * 3)) for i in range(40)], "doc_id long, text binary")
    got = fill_middle.restore(fill_middle.fill_in_middle(frame)).collect()
    assert {bytes(r.restored) for r in got} == {b"ab\xff\xfe\xc3cd" * 3} and {r.n for r in got} == {21}


def test_no_documents(spark):
    assert fill_middle.restore(fill_middle.fill_in_middle(docs(spark, []))).count() == 0


def test_query_against_the_definition(spark):
    from lorespark.llm.queries import QUERIES

    made = QUERIES["op13_fill_middle"](spark, "/root/testdata/sf0.001").collect()
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = {}
    for r in given:
        n, kind, a, b, output = plainly(r.doc_id, r.text)
        want[r.doc_id] = (n, kind, a, b, hashlib.sha256(output.encode()).hexdigest(),
                          hashlib.sha256((r.text or "").encode()).hexdigest())
    assert {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in made} == want
