"""Keyword scores of chunks in numpy blocks that Spark distributes.

Postings arrive by chunk. A task holds some chunks, reads the queries block by block from the shared
folder and adds up what the terms of each query add to each chunk: through the lists of queries of rare terms, by a
product for those that many queries ask for. No row is made for a (chunk, query) pair before it is known
to be wanted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.functions import scoring
from lorespark.operators.blocks import held, read_blocks, write_blocks
from lorespark.operators.joins import MAX_TOP_K

#: Marks of the fields in which a term stands.
IN_TITLE, IN_PATH, IN_ENTITIES = 1, 2, 4
#: Bytes of postings that a task holds; cells of a block of chunks by terms or queries, and of queries by terms.
HELD_BYTES, CHUNK_CELLS, QUERY_CELLS = 16 << 20, 1 << 20, 1 << 23
#: Needles that a task looks for at a time.
NEEDLES = 100_000
NEVER = -(2**62)
#: Queries of a block up to which a term's are listed; what more queries ask for is a column of a matrix.
LISTED = 8


def packed(term_id: int, times: int, whole: bool) -> int:
    """A term's number, how often a token has it (as far as it counts) and if it is the token."""
    return term_id << 4 | min(times, scoring.KEYWORD_COUNT_CAP) << 1 | whole


def terms_inside(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """token, found: for each text of ``tokens`` (hay) the :func:`packed` terms (term, term_id) that occur in it.

    Every part of the token that is as long as some term is looked up among the terms, so the work
    is the tokens' characters times the lengths that terms have.
    """
    folder = write_blocks(terms.select("term", "term_id"), NEEDLES)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hays = batch.column("hay").to_pylist()
            for block in read_blocks(folder):
                numbers = dict(zip(block.column("term").to_pylist(), block.column("term_id").to_pylist(), strict=True))
                lengths = sorted({len(term) for term in numbers if term})
                kept, found = [], []
                for hay in hays:
                    parts = {hay[i:i + n] for n in lengths if n <= len(hay) for i in range(len(hay) - n + 1)}
                    inside = parts & numbers.keys()
                    if inside:
                        kept.append(hay)
                        found.append([packed(numbers[p], hay.count(p), p == hay) for p in inside])
                yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), pa.array(found, pa.list_(pa.int64()))], names=["token", "found"])

    # Over all tasks: few bytes of tokens have many parts.
    tasks = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tokens.select("hay").repartition(tasks, "hay").mapInArrow(scan, "token string, found array<long>")


def asked_blocks(asked: DataFrame) -> str:
    """Queries (query_id, top_k, terms, free, filters) as blocks whose matrices of terms are bounded."""
    longest = asked.agg(F.max(F.size("terms"))).first()[0] or 1
    return write_blocks(asked, math.isqrt(QUERY_CELLS // max(1, longest)) or 1)


class _Asked:
    """A block of queries: how often each asks for each term, limits and filters."""

    def __init__(self, block: pa.Table):
        self.ids = block.column("query_id").combine_chunks()
        self.limit = np.clip(block.column("top_k").fill_null(0).to_numpy(), 0, MAX_TOP_K + 1).astype(np.int64)
        self.k = max(1, int(self.limit.max()))
        lists = block.column("terms").combine_chunks()
        flat = lists.flatten().to_numpy()
        self.terms, place = np.unique(flat, return_inverse=True)
        # (term, query) pairs in order, and how often the query has the term.
        pairs, times = np.unique(
            place * len(block) + np.repeat(np.arange(len(block)), lists.value_lengths().to_numpy()), return_counts=True)
        term, self.query, self.times = pairs // len(block), pairs % len(block), times.astype(np.float64)
        self.start = np.searchsorted(term, np.arange(len(self.terms)))
        self.asking = np.bincount(term, minlength=len(self.terms))
        frequent = np.flatnonzero(self.asking > LISTED)
        self.column = np.full(len(self.terms), -1)
        self.column[frequent] = np.arange(len(frequent))
        self.weight = np.zeros((len(frequent), len(block)), np.float32)
        own = self.column[term] >= 0
        self.weight[self.column[term[own]], self.query[own]] = times[own]
        self.free = block.column("free").to_numpy()
        self.filters = block.column("filters").to_pylist()

    def add_up(self, chunk: np.ndarray, place: np.ndarray, worth: np.ndarray, rows: int) -> np.ndarray:
        """(chunk, query): the worth of each (chunk, term) times how often the query asks for the term.

        Terms of few queries are added pair by pair, as most terms are; the others are multiplied.
        """
        column = self.column[place]
        many = column >= 0
        cells = np.zeros((rows, len(self.weight)), np.float32)
        cells[chunk[many], column[many]] = worth[many]
        chunk, place, worth = chunk[~many], place[~many], worth[~many]
        each = self.asking[place]
        pair = np.repeat(self.start[place] - np.cumsum(each) + each, each) + np.arange(each.sum())
        listed = np.bincount(
            np.repeat(chunk, each) * len(self.ids) + self.query[pair], np.repeat(worth, each) * self.times[pair],
            rows * len(self.ids))
        return cells @ self.weight + listed.reshape(rows, -1).astype(np.float32)

    def passing(self, passes: list | None, rows: int) -> np.ndarray:
        """(row, query): whether the row passes one of the query's filters."""
        out = np.zeros((rows, len(self.ids)), bool)
        if passes is not None:
            known = {f: np.array([f in (p or ()) for p in passes], bool) for own in self.filters for f in own}
            for q, own in enumerate(self.filters):
                for f in own:
                    out[:, q] |= known[f]
        return out


def _changes(rows: pa.Table, *names: str) -> np.ndarray:
    """First places of the runs of equal values in the columns."""
    new = np.zeros(max(0, len(rows) - 1), bool)
    for name in names:
        column = rows.column(name).combine_chunks()
        if pa.types.is_string(column.type):
            column = column.dictionary_encode().indices
        values = column.fill_null(-1).to_numpy(zero_copy_only=False)
        new |= values[1:] != values[:-1]
    return np.r_[0, np.flatnonzero(new) + 1]


def _whole_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Postings and the first places of their chunks; rows come in the order of the chunks' hash."""
    def cut(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
        starts = _changes(rows, "hash", "doc_id", "chunk_index")
        if len(starts) > len(_changes(rows, "hash")):
            # Chunks of equal hash may lie mixed.
            rows = rows.sort_by([(c, "ascending") for c in ("hash", "doc_id", "chunk_index")]).combine_chunks()
            starts = _changes(rows, "hash", "doc_id", "chunk_index")
        return rows, starts

    rest = None
    for rows in held(batches, HELD_BYTES):
        rows = (pa.concat_tables([rest, rows]) if rest is not None else rows).combine_chunks()
        last = int(_changes(rows, "hash")[-1])
        if last:
            yield cut(rows.slice(0, last).combine_chunks())
        rest = rows.slice(last)
    if rest is not None and len(rest):
        yield cut(rest.combine_chunks())


def _worth(cell: np.ndarray, size: int, times: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """What each of ``size`` (chunk, term) cells adds to the score of its chunk."""
    worth = np.minimum(np.bincount(cell, times, size), scoring.KEYWORD_COUNT_CAP)
    points = ((IN_TITLE, scoring.KEYWORD_TITLE), (IN_PATH, scoring.KEYWORD_PATH), (IN_ENTITIES, scoring.KEYWORD_ENTITY))
    for mark, value in points:
        worth[np.unique(cell[marks & mark > 0])] += value
    return worth


def chunk_hits(matched: DataFrame, folder: str, id_type: str, scored: bool = True, recalled: bool = False, best: bool = False) -> DataFrame:
    """query_id, doc_id, chunk_index, raw_score, recalled, held_ok of the wanted (query, chunk) pairs.

    ``matched``: doc_id, chunk_index, tf, fields, found and, where queries have filters, passes.
    ``scored``: scores are wanted; ``recalled``: only pairs in which a whole token is a term;
    ``best``: each task keeps to the pairs that can be among the ``top_k`` best of their query.
    Pairs that neither a filter nor the lack of one lets pass are left out. Scores are multiples of
    a half, so their sums are exact in any order.
    """
    schema = f"query_id {id_type}, doc_id string, chunk_index int, raw_score double, recalled boolean, held_ok boolean"
    names = [c.split()[0] for c in schema.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached: dict[int, np.ndarray] = {}
        for rows, starts in _whole_chunks(batches):
            count = len(starts)
            of_row = np.repeat(np.arange(count), np.diff(np.r_[starts, len(rows)]))
            lists = rows.column("found").chunk(0)
            flat, at = lists.flatten().to_numpy(), np.repeat(np.arange(len(rows)), lists.value_lengths().to_numpy())
            term, chunk, whole = flat >> 4, of_row[at], flat & 1 > 0
            times = rows.column("tf").to_numpy()[at] * ((flat & 15) >> 1)
            marks = rows.column("fields").to_numpy()[at]
            first = rows.select([c for c in rows.column_names if c in ("doc_id", "chunk_index", "passes")]).take(pa.array(starts))
            passes = first.column("passes").to_pylist() if "passes" in first.column_names else None
            rank = np.empty(count, np.int64)
            rank[pc.sort_indices(first, [("doc_id", "ascending"), ("chunk_index", "ascending")]).to_numpy()] = np.arange(count)
            for number, block in enumerate(read_blocks(folder)):
                asked = _Asked(block)
                width = len(asked.terms)
                if not width:
                    continue
                local = np.minimum(np.searchsorted(asked.terms, term), width - 1)
                own = np.flatnonzero(asked.terms[local] == term)
                place, here = local[own], chunk[own]
                step = max(1, CHUNK_CELLS // max(len(asked.weight), len(asked.ids)))
                for low in range(0, count, step):
                    high = min(count, low + step)
                    part = slice(*np.searchsorted(here, [low, high]))
                    picked = own[part]
                    cells, cell = np.unique((here[part] - low) * width + place[part], return_inverse=True)
                    at_chunk, at_term = cells // width, cells % width
                    hit = None
                    if recalled or not best:
                        exact = np.unique(cell[whole[picked]])
                        hit = asked.add_up(at_chunk[exact], at_term[exact], np.ones(len(exact)), high - low) > 0
                    scores = np.zeros((high - low, len(asked.ids)), np.float32)
                    if scored:
                        worth = _worth(cell, len(cells), times[picked], marks[picked])
                        scores = asked.add_up(at_chunk, at_term, worth, high - low)
                    wanted = hit if recalled else scores > 0 if best else (scores > 0) | hit
                    okay = asked.passing(passes and passes[low:high], high - low)
                    wanted = wanted & (asked.free[None, :] | okay)
                    if best:
                        before = reached.get(number)
                        if before is None:
                            before = np.zeros((len(asked.ids), asked.k), np.float32)
                        least = before[np.arange(len(asked.ids)), np.maximum(asked.limit, 1) - 1]
                        wanted &= (scores > 0) & (scores >= least[None, :]) & (asked.limit > 0)[None, :]
                        # Earlier chunks win ties: the place is folded into the sort key.
                        keys = np.rint(scores.T * 2).astype(np.int64) * count - rank[low:high]
                        keys[~wanted.T] = NEVER
                        k = min(asked.k, high - low)
                        top = np.argpartition(-keys, k - 1, axis=1)[:, :k]
                        alive = np.take_along_axis(keys, top, axis=1) > NEVER
                        gained = np.where(alive, np.take_along_axis(scores.T, top, axis=1), 0)
                        reached[number] = -np.sort(-np.concatenate([before, gained], axis=1), axis=1)[:, :asked.k]
                        q, c = np.nonzero(alive)[0], top[alive]
                    else:
                        c, q = np.nonzero(wanted)
                    if len(q):
                        found = first.take(pa.array(c + low))
                        yield pa.RecordBatch.from_arrays(
                            [asked.ids.take(pa.array(q)), found.column("doc_id").combine_chunks(), found.column("chunk_index").combine_chunks(),
                             pa.array(scores[c, q].astype(np.float64)), pa.array(np.full(len(q), recalled) if hit is None else hit[c, q]),
                             pa.array(okay[c, q])], names=names)

    # A chunk is in one task, its postings side by side; one number is sorted faster than the key.
    placed = matched.withColumn("hash", F.xxhash64("doc_id", "chunk_index")).repartition("hash").sortWithinPartitions("hash")
    return placed.mapInArrow(scan, schema)
