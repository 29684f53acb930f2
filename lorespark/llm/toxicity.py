"""Toxicity by the nearest labelled examples.

Terms are words and the beginnings of words. Those that tell the labels apart in a bounded sample of
labelled examples are kept (chi-square), weighted by TF-IDF with document frequencies of the whole
corpus. The examples form an inverted index in blocks, with the largest weight of every term in
every block; a query visits blocks in the order of their upper bounds and stops when none can
reach its k-th neighbour, so the cosine neighbours are exact. Their votes, weighted by distance, are
calibrated by isotonic regression on the examples' own leave-one-out votes.

The sample is bounded by ``PER_CLASS`` examples of each label, picked by a hash of the id;
near copies of an example count once, or one copied text would choose the terms. Everything else
covers all rows.

Defined results: null, empty and term-free texts have no neighbour and get the calibrated share of
positive examples that are alike; labels that are null or whose id is null are not used; the larger
of several labels of one id counts; without examples of both kinds every score is their share
(0 for none). Rows are scored one by one: repeats get equal scores, other columns never matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespark.llm.common import SHINGLE, fresh, with_text
from lorespark.operators.joins import first_per, materialize

PER_CLASS = 6_000
#: Terms kept, the least chi-square of a term (one in a million by chance), its least examples, and
#: how many times more frequent it must be with one label than with the other.
TERMS, CHI_SQUARE, SUPPORT, LIFT = 2_048, 24.0, 3, 3.0
PREFIXES = (4, 5, 6)
NEIGHBOURS, BLOCK, EVIDENCE = 25, 64, 3
REJECT = 0.7
EDGES = ".,;:!?\"'()[]{}<>«»¿¡…-–—*_/\\|"
MEMO = 400_000


def training(doc_id: Column) -> Column:
    """Rows whose labels may be learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def features(word: str) -> tuple[str, ...]:
    """Terms of a lower-case word: itself and its beginnings."""
    word = word.strip(EDGES)
    return (word, *(f"{word[:n]}~" for n in PREFIXES if len(word) >= n)) if word else ()


@dataclass
class Model:
    """Terms and weights, example vectors (terms, values), labels, ids, and the calibration."""

    terms: dict[str, int]
    idf: np.ndarray
    index: "BlockIndex"
    steps: tuple[np.ndarray, np.ndarray]
    alone: float


def count_terms(text: str | None, terms: dict[str, int], memo: dict[str, tuple[int, ...]]) -> dict[int, int]:
    """Occurrences of the kept terms in a whole text."""
    out: Counter = Counter()
    for word, times in Counter((text or "").lower().split()).items():
        own = memo.get(word)
        if own is None:
            own = tuple(terms[t] for t in features(word) if t in terms)
            if len(memo) < MEMO and len(word) < 64:
                memo[word] = own
        for term in own:
            out[term] += times
    return out


def vector(counts: dict[int, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms in order and unit TF-IDF values."""
    at = np.array(sorted(counts), np.int64)
    value = (1 + np.log(np.array([counts[t] for t in at.tolist()], float))) * idf[at] if len(at) else np.zeros(0)
    norm = np.sqrt((value ** 2).sum())
    return at, value / norm if norm else value


class BlockIndex:
    """Examples in blocks; per term its postings, and its largest value in each block."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray,
                 weights: np.ndarray, ids: np.ndarray, n_terms: int):
        # Neighbours in a block are alike, so that blocks differ in what they can reach.
        order = sorted(range(len(vectors)), key=lambda i: (vectors[i][0].tolist(), int(ids[i])))
        self.labels, self.weights, self.ids = labels[order], weights[order], ids[order]
        self.blocks = -(-len(order) // BLOCK)
        self.top = np.zeros((n_terms, max(1, self.blocks)))
        postings: list[list[tuple[int, float]]] = [[] for _ in range(n_terms)]
        for place, i in enumerate(order):
            for term, value in zip(*vectors[i], strict=True):
                postings[term].append((place, value))
                self.top[term, place // BLOCK] = max(self.top[term, place // BLOCK], value)
        self.places = [np.array([p for p, _ in x], np.int64) for x in postings]
        self.values = [np.array([v for _, v in x]) for x in postings]

    def nearest(self, query: tuple[np.ndarray, np.ndarray], k: int = NEIGHBOURS, skip: int = -1):
        """Places and cosines of the k best examples of positive cosine; ties by place."""
        terms, values = query
        bound = values @ self.top[terms] if len(terms) else np.zeros(0)
        places, scores, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        for block in np.argsort(-bound, kind="stable"):
            # A hair of slack, as the bound is summed in another order than the scores.
            if bound[block] <= 0 or bound[block] + 1e-9 < least:
                break
            score = np.zeros(BLOCK)
            for term, value in zip(terms, values, strict=True):
                a, b = np.searchsorted(self.places[term], (block * BLOCK, (block + 1) * BLOCK))
                score[self.places[term][a:b] - block * BLOCK] += value * self.values[term][a:b]
            found = np.flatnonzero(score > 0)
            found = found[found + block * BLOCK != skip]
            places = np.append(places, found + block * BLOCK)
            scores = np.append(scores, score[found])
            best = np.lexsort((places, -scores))[:k]
            places, scores = places[best], scores[best]
            least = scores[-1] if len(scores) == k else 0.0
        return places, scores

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        """Share of positive votes; a vote weighs more the nearer it is."""
        weight = self.weights[places] / (1.05 - np.minimum(cosines, 1.0))
        return float((weight * self.labels[places]).sum() / weight.sum())


def isotonic(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing step function from votes to the weighted share of positives, smoothed."""
    pools: list[list[float]] = []
    for vote in np.unique(votes):
        own = votes == vote
        pools.append([vote, (weights * labels)[own].sum(), weights[own].sum()])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, hits, weight = pools.pop()
            pools[-1][1] += hits
            pools[-1][2] += weight
    share = (weights * labels).sum() / weights.sum()
    return (np.array([p[0] for p in pools]),
            np.array([(p[1] + share) / (p[2] + 1) for p in pools]))


def _sample(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label: str) -> DataFrame:
    """Examples doc_id, text, label, weight: how many labelled rows one stands for."""
    known = labels.select(F.col(id_column).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & training(F.col("doc_id"))
    ).groupBy("doc_id").agg(F.max("label").alias("label"))
    order = F.xxhash64("doc_id")
    picked = [known.filter(F.col("label") == y).orderBy(order, "doc_id").limit(PER_CLASS) for y in (0, 1)]
    sample = F.broadcast(picked[0].unionAll(picked[1]))  # 2 * PER_CLASS rows at most
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).join(
        sample, "doc_id").select("doc_id", "text", "label")


def _signature(words: list[str]) -> int:
    """The least hash of the word shingles; near copies mostly share it."""
    from xxhash import xxh64_intdigest

    width = max(1, min(SHINGLE, len(words)))
    return min((xxh64_intdigest(" ".join(words[i:i + width])) for i in range(len(words) - width + 1)), default=0)


def _choose_terms(examples: DataFrame) -> tuple[DataFrame, list[str]]:
    """Examples with near copies taken out, and the terms that tell the labels apart."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One text at a time: words of a whole batch would fill the memory of a worker.
            signs = [_signature((t.as_py() or "").lower().split()) - 2**63 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(signs, pa.int64()), batch.column(1)],
                                             names=["doc_id", "label", "sign", "text"])

    signed = examples.mapInArrow(sign, "doc_id long, label int, sign long, text string")
    single = materialize(first_per(signed, ["sign", "label"], F.col("doc_id")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {0: Counter(), 1: Counter()}
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen[label].update({t for w in set((text.as_py() or "").lower().split()) for t in features(w)})
        for label, found in seen.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.string()), pa.array([label] * len(found), pa.int32()), pa.array(list(found.values()), pa.int64())],
                names=["term", "label", "n"])

    totals = {r["label"]: r["count"] for r in single.groupBy("label").count().collect()}
    n1, n0 = float(totals.get(1, 0)), float(totals.get(0, 0))
    if not n1 or not n0:
        return single, []
    a, b = F.col("a"), F.col("b")
    chi = (n1 + n0) * (a * n0 - b * n1) ** 2 / (n1 * n0 * (a + b) * (n1 + n0 - a - b))
    counted = single.select("label", "text").mapInArrow(count, "term string, label int, n long").groupBy("term").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).cast("double").alias("a"),
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).cast("double").alias("b"))
    apart = (a / n1 >= LIFT * b / n0) | (b / n0 >= LIFT * a / n1)
    kept = counted.filter((a + b >= SUPPORT) & (a + b < n1 + n0) & apart).withColumn("chi", chi).filter(
        F.col("chi") >= CHI_SQUARE)
    return single, [r["term"] for r in kept.orderBy(F.desc("chi"), "term").limit(TERMS).collect()]


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
        label: str = "toxic") -> Model:
    """Terms, corpus-wide weights, example index and calibration."""
    examples, chosen = _choose_terms(_sample(docs, labels, id_column, text_column, label))
    terms = {t: i for i, t in enumerate(chosen)}

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, seen, rows = {}, np.zeros(len(terms), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for text in batch.column(0):
                seen[list(count_terms(text.as_py(), terms, memo))] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *range(len(terms))], pa.int64()), pa.array([rows, *seen.tolist()], pa.int64())], names=["term", "df"])

    text = docs.select(F.col(text_column).cast("string").alias("text"))
    df = dict(text.mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df")).collect())
    rows = df.pop(-1, 0)
    idf = np.log((1 + rows) / (1 + np.array([df.get(i, 0) for i in range(len(terms))], float))) + 1

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = {}
        for batch in batches:
            found = [sorted(count_terms(t, terms, memo).items()) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([[t for t, _ in f] for f in found], pa.list_(pa.int64())),
                 pa.array([[n for _, n in f] for f in found], pa.list_(pa.int64()))], names=["doc_id", "label", "terms", "counts"])

    encoded = examples.select("doc_id", "label", "text").mapInArrow(
        encode, "doc_id long, label int, terms array<long>, counts array<long>").orderBy("doc_id").collect()
    sizes = labels.filter(F.col(label).isin(0, 1) & training(F.col(id_column))).groupBy(F.col(label).cast("int")).count()
    stands = dict(map(tuple, sizes.collect()))
    have = Counter(r["label"] for r in encoded)
    weight = {y: stands.get(y, 0) / n for y, n in have.items()}
    scale = sum(have.values()) / max(1e-9, sum(weight[y] * n for y, n in have.items()))
    y = np.array([r["label"] for r in encoded], float)
    w = np.array([weight[r["label"]] * scale for r in encoded])
    vectors = [vector(dict(zip(r["terms"], r["counts"], strict=True)), idf) for r in encoded]
    index = BlockIndex(vectors, y, w, np.array([r["doc_id"] for r in encoded], np.int64), max(1, len(terms)))
    place = {int(i): p for p, i in enumerate(index.ids)}
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((index, vectors, [place[r["doc_id"]] for r in encoded]))

    def leave_one_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, vectors, places = sent.value
        for batch in batches:
            at = batch.column(0).to_pylist()
            found = [index.nearest(vectors[i], skip=places[i]) for i in at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([index.vote(*f) if len(f[0]) else None for f in found], pa.float64())], names=["id", "vote"])

    votes, without = np.full(len(y), -1.0), np.zeros(len(y), bool)
    tasks = spark.sparkContext.defaultParallelism * 2
    for i, vote in spark.range(0, len(y), 1, tasks).mapInArrow(leave_one_out, "id long, vote double").collect():
        votes[i], without[i] = (-1.0, True) if vote is None else (vote, False)
    share = float((w * y).sum() / w.sum()) if len(y) else 0.0
    alone = float(((w * y)[without].sum() + share) / (w[without].sum() + 1))
    told = ~without
    steps = isotonic(votes[told], y[told], w[told]) if told.any() else (np.zeros(1), np.array([share]))
    return Model(terms, idf, index, steps, alone)


class Scorer:
    """Scores texts in a task; equal vectors are searched once."""

    def __init__(self, model: Model):
        self.model, self.words, self.seen = model, {}, {}

    def __call__(self, text: str | None) -> tuple[float, list[int], list[float], list[int]]:
        counts = count_terms(text, self.model.terms, self.words)
        key = tuple(sorted(counts.items()))
        if key not in self.seen:
            if len(self.seen) > MEMO // 4:
                self.seen.clear()
            self.seen[key] = self._score(counts)
        return self.seen[key]

    def _score(self, counts: dict[int, int]):
        index = self.model.index
        places, cosines = index.nearest(vector(counts, self.model.idf))
        if not len(places):
            return self.model.alone, [], [], []
        at, value = self.model.steps
        score = float(np.interp(index.vote(places, cosines), at, value))
        best = places[:EVIDENCE]
        return (min(1.0, max(0.0, score)), index.ids[best].tolist(), cosines[:EVIDENCE].tolist(),
                index.labels[best].astype(int).tolist())


EXTRA = {"score": T.DoubleType(), "neighbours": T.ArrayType(T.LongType()), "cosines": T.ArrayType(T.DoubleType()),
         "neighbour_labels": T.ArrayType(T.IntegerType())}
_KINDS = (pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.int32()))


def score(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """``docs`` with score, and its evidence: the nearest examples, their cosines and labels.

    Where ``docs`` has such a column already, an underscore is put before the new one.
    """
    names = fresh(docs, *EXTRA)
    (probe,) = fresh(docs, "probe")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    probed, at = with_text(docs, text_column, probe)
    width = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            scored = (scorer(t.as_py()) for t in batch.column(at))
            found = list(zip(*scored, strict=True)) or [[]] * 4
            added = [pa.array(list(v), k) for v, k in zip(found, _KINDS, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *added], names=[*batch.schema.names[:width], *names])

    added = [T.StructField(n, kind) for n, kind in zip(names, EXTRA.values(), strict=True)]
    schema = T.StructType([*docs.schema.fields, *added])
    return probed.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, least: float = REJECT, id_column: str = "doc_id",
               text_column: str = "text", label: str = "toxic") -> DataFrame:
    """``docs`` without those that score ``least`` or more."""
    scored = score(docs, fit(docs, labels, id_column, text_column, label), text_column)
    name = scored.columns[len(docs.columns)]
    return scored.filter(F.col(name) < least).select(*docs.columns)
