"""Document fingerprints by one-permutation MinHash, with DataFrame functions only.

Shingles of five words are hashed once. The upper bits of a hash choose one of ``BINS`` bins, and the
least hash of a bin is its value. An empty bin takes the value of a filled one by optimal
densification: it tries bins in an order that depends on its own number only, so two documents
with the same filled bins fill alike, and each filled bin is as likely as any other. Of every bin
the lowest ``BITS`` bits of a hash of its value and its number are packed into a string of hexadecimal
digits, so one value that fills many bins gives each other bits. Likeness is the share of equal
bins, corrected for the share that is equal by chance.

Defined results: a null text counts as empty; fewer than five words are one shingle; a text without
words has the empty fingerprint, which is like itself (1) and unlike any other (0). Rows are
ordered by id, then text hash, so repeated ids follow one another; null ids come last in descending order.
An empty table gives no rows; a single document is its own next one.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.llm.common import SHINGLE, words
from lorespark.operators.joins import materialize

BIN_BITS, BITS = 8, 4
BINS = 1 << BIN_BITS
DIGITS = "0123456789abcdef"
#: Bins an empty one tries in two rounds; after those all filled ones are ordered by a hash of both numbers.
TRIES = (8, 32)
#: Rows that one task puts in order.
BLOCK_ROWS = 4_000


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingle_hashes(text: Column) -> Column:
    """Hashes of the word shingles of a text."""

    def spans(h: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(h) - (SHINGLE - 1))
        return F.transform(starts, lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(SHINGLE)]))

    def of(w: Column) -> Column:
        return (F.when(F.size(w) >= SHINGLE, _let(F.transform(w, lambda x: F.xxhash64(x)), spans))
                .when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " "))))
                .otherwise(F.array().cast("array<bigint>")))

    return _let(words(text), of)


def _bin(value: Column) -> Column:
    """0 to BINS - 1, in the order of the signed hashes."""
    return F.shiftright(value, 64 - BIN_BITS) + BINS // 2


def _orders() -> Column:
    """For every bin, the bins it tries when empty; a fixed pseudo-random order."""
    rng = random.Random(BINS)
    rows = [", ".join(str(rng.randrange(BINS)) for _ in range(sum(TRIES))) for _ in range(BINS)]
    # One expression: ten thousand literals made one by one cost the driver seconds a plan.
    return F.expr(f"array({', '.join(f'array({row})' for row in rows)})")


def signature(hashes: Column) -> Column:
    """Least hash of every bin, empty ones densified."""
    # The largest value of each bin marks it as empty: with one mark a bin, the first value of
    # every bin stands where the bin changes in the sorted array.
    marks = [((b - BINS // 2) << (64 - BIN_BITS)) + (1 << (64 - BIN_BITS)) - 1 for b in range(BINS)]
    marked = F.lit(marks)

    def firsts(v: Column) -> Column:
        return F.filter(v, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(v, i - 1))))

    def densified(d: Column) -> Column:
        orders, (few, more) = _orders(), TRIES

        def filled(t: Column) -> Column:
            return F.get(d, t) != F.get(marked, t)

        def fill(x: Column, b: Column) -> Column:
            order = F.get(orders, b)
            first = F.get(F.filter(F.slice(order, 1, few), filled), F.lit(0))
            second = F.get(F.filter(F.slice(order, few + 1, more), filled), F.lit(0))
            ranked = F.transform(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), filled), lambda t: F.struct(F.xxhash64(b, t).alias("h"), t.alias("t")))
            last = F.array_min(ranked)["t"]
            return F.when(x != F.get(marked, b), x).otherwise(F.get(d, F.coalesce(first, second, last)))

        return F.transform(d, fill)

    return _let(_let(F.array_sort(F.concat(hashes, marked)), firsts), densified)


def fingerprint(text: Column) -> Column:
    """One hexadecimal digit for each bin; empty for a text without words."""
    low = F.lit(list(DIGITS))

    def packed(h: Column) -> Column:
        digits = F.transform(
            signature(h), lambda x, b: F.get(low, F.xxhash64(x, b).bitwiseAND(F.lit(len(DIGITS) - 1)).cast("int")))
        return F.when(F.size(h) == 0, F.lit("")).otherwise(F.array_join(digits, ""))

    return _let(shingle_hashes(text), packed)


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance of two fingerprints, from 0 to 1."""
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda x: x))
    chance = 2.0 ** -BITS
    near = F.greatest((same / F.lit(float(BINS)) - chance) / (1 - chance), F.lit(0.0))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(near)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, fingerprint, next_text, next_fingerprint: the next document of every one, in
    descending order of ids and back to the first after the last.

    Ids are dealt into blocks of equal width, in which a window finds the next row; the texts are
    shuffled once. Only the first document of each block is looked up apart. Ids that crowd in
    a few places make uneven blocks, which the sort spills.
    """
    rows, low, high = docs.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    blocks = max(1, -(-rows // BLOCK_ROWS))
    low, high = (0, 0) if low is None else (low, high)
    width = (high - low) // blocks + 1
    number = F.floor((F.lit(high).cast("decimal(20,0)") - F.col("doc_id")) / F.lit(width)).cast("long")
    place = F.coalesce(number, F.lit(blocks + 1).cast("long"))
    tie = F.xxhash64("text")
    based = docs.select("doc_id", "text", place.alias("block"))
    # Ids of the first documents by a scan of the ids alone, then their texts.
    heads = docs.select("doc_id", place.alias("block")).groupBy("block").agg(F.max("doc_id").alias("head"))
    heads = materialize(heads)
    firsts = based.join(heads, (based["block"] == heads["block"]) & based["doc_id"].eqNullSafe(heads["head"])).groupBy(
        based["block"]).agg(F.min_by("text", tie).alias("first_text"))
    # One small row a block.
    order = Window.orderBy("block")
    turn = heads.select("block", F.coalesce(F.lead("block").over(order), F.min("block").over(Window.partitionBy())).alias("following"))
    firsts = firsts.withColumnRenamed("block", "following").withColumn("first_fingerprint", fingerprint(F.col("first_text")))
    starts = materialize(turn.join(firsts, "following").select(F.col("block").alias("of"), "first_text", "first_fingerprint"))
    inside = Window.partitionBy("block").orderBy(F.col("doc_id").desc_nulls_last(), tie)
    led = based.withColumn("fingerprint", fingerprint(F.col("text"))).select(
        "*", F.lead("text").over(inside).alias("next_text"), F.lead("fingerprint").over(inside).alias("next_fingerprint"))
    return led.join(starts, F.col("block") == F.col("of"), "left").select(
        "doc_id", "text", "fingerprint", F.coalesce("next_text", "first_text").alias("next_text"),
        F.coalesce("next_fingerprint", "first_fingerprint").alias("next_fingerprint"))


def fingerprint_edits(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of every text, of the text with its last third replaced by the beginning of
    the next one, and their likeness."""
    clean = docs.select(F.col(id_column).cast("long").alias("doc_id"),
                        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    made = with_next(clean).select(
        "doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    both = made.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
