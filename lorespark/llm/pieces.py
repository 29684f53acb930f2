"""SentencePiece encoding and decoding, giant documents by a max-plus parallel scan.

The models are byte-pair models: their segmentation is the one whose adjacent pieces are what the
library makes of each such pair alone. That turns encoding into a search for the best path through
a lattice of pieces, where an edge exists between pieces that can stand side by side, and no other
path has a score. A document longer than ``CHUNK`` is cut anywhere. The states at a cut are the
pieces that may cover the character before it. A chunk yields the matrix of best scores from
every state at its beginning to every state at its end; matrices are combined in the (max, +)
semiring, which is associative, so prefixes come from a scan in pairs. The states chosen at the
cuts let every chunk recover its pieces by itself. No piece goes on over a space, so between the
first and the last space of a chunk the path is what the library gives.

Shorter documents are one chunk without states and are encoded in the task that reads them.

Defined results: a null text counts as empty; an empty text has no ids; characters without a piece
become their bytes; decoding gives back the very text, but for U+2581, which the library's format
cannot tell from a space. Rows are encoded one by one, so null or
repeated ids, and other columns, make no difference.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorespark.llm.common import fresh, with_text
from lorespark.llm.memo import WordMemo
from lorespark.operators.joins import materialize

CHUNK = 20_000
SPACE = "▁"
Place = tuple[int, int]


class Model:
    """A model file: whole texts, single pieces, and which pieces can stand side by side."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        proto.normalizer_spec.add_dummy_prefix = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.score, self.bytes = {}, []
        for p in proto.pieces:
            if p.type == kinds.NORMAL:
                self.score[p.piece] = p.score
            self.bytes.append(bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE
                              else p.piece.replace(SPACE, " ").encode() if p.type == kinds.NORMAL else b"")
        self.longest = max(map(len, self.score))
        self.code = "<u2" if len(proto.pieces) <= 1 << 16 else "<u4"
        self.ids_of: dict[str, list[int]] = {}
        self.beside: dict[tuple[str, str], bool] = {}
        kind = "H" if self.code == "<u2" else "I"
        encode = lambda texts: [array(kind, x).tobytes() for x in self.whole.encode(texts, num_threads=1)]
        self.memo = WordMemo(encode, encode, prefix=True, words=250_000)
        self.plain = encode

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        odd = [i for i, t in enumerate(texts) if SPACE in t]
        out = self.memo(["" if SPACE in t else t for t in texts])
        for i, ids in zip(odd, self.plain([texts[i] for i in odd]) if odd else [], strict=True):
            out[i] = ids
        return [np.frombuffer(x, self.code) for x in out]

    def ids(self, text: str) -> list[int]:
        """Ids of a stretch of the spaced form."""
        if len(text) > self.longest:
            return self.bare.encode(text)
        if text not in self.ids_of:
            if len(self.ids_of) > 200_000:
                self.ids_of.clear()
            self.ids_of[text] = self.bare.encode(text)
        return self.ids_of[text]

    def token(self, text: str) -> bool:
        """Whether a stretch is one piece, or one character that has none."""
        return len(text) == 1 or text in self.score and len(self.ids(text)) == 1

    def adjacent(self, a: str, b: str) -> bool:
        if b[0] == SPACE and a[-1] != SPACE:
            return True
        pair = (a, b)
        if pair not in self.beside:
            if len(self.beside) > 200_000:
                self.beside.clear()
            self.beside[pair] = self.bare.encode(a + b) == self.ids(a) + self.ids(b)
        return self.beside[pair]

    def forget(self) -> None:
        """At the end of a task: the worker lives on, and other stages need its memory."""
        for held in (self.ids_of, self.beside):
            held.clear()
        self.memo.forget()

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return data[1:]


@lru_cache(maxsize=2)
def _model(path: str) -> Model:
    return Model(path)


def states_at(model: Model, text: str, cut: int, end: bool) -> list[Place]:
    """Pieces (from, to) that may cover the character before ``cut``; at the end of a text, end there."""
    out = []
    for start in range(max(0, cut - model.longest), cut):
        for stop in range(cut, cut + 1 if end else min(len(text), start + model.longest) + 1):
            if model.token(text[start:stop]):
                out.append((start, stop))
    return out


def walk(model: Model, text: str, begin: int, stop: int, before: str | None) -> dict[int, tuple[int, float]]:
    """Where the piece that ends at each place from ``begin`` on begins, and the path's score.

    ``before`` is the piece in front. At most one piece can end at a place, as the stretch up to
    there has one segmentation.
    """
    reach: dict[int, tuple[int, float]] = {begin: (-1, 0.0)}
    for i in range(begin, stop):
        if i not in reach:
            continue
        last = before if i == begin else text[reach[i][0]:i]
        for j in range(i + 1, min(len(text), i + model.longest) + 1):
            piece = text[i:j]
            if j not in reach and model.token(piece) and (last is None or model.adjacent(last, piece)):
                reach[j] = (i, reach[i][1] + model.score.get(piece, 0.0))
    return reach


def _breaks(text: str, a: int, b: int) -> tuple[int, int] | None:
    """First and last place in [a, b] where a space begins; no piece goes over it."""
    inside = [i for i in (_next_break(text, a, b, 1), _next_break(text, b, a, -1)) if i is not None]
    return (inside[0], inside[1]) if inside else None


def _next_break(text: str, start: int, stop: int, step: int) -> int | None:
    for i in range(start, stop + step, step):
        if 0 < i < len(text) and text[i] == SPACE and text[i - 1] != SPACE:
            return i
    return None


def transfer(model: Model, text: str, a: int, b: int, first: bool, last: bool) -> np.ndarray:
    """Best scores from the states at ``a`` to those at ``b``; minus infinity where there is no path."""
    entries = [(a, a)] if first else states_at(model, text, a, False)
    exits = states_at(model, text, b, last)
    out = np.full((len(entries), len(exits)), -np.inf)
    middle = _breaks(text, a, b)
    if middle and middle[0] < b:
        begin, end = middle
        tail = walk(model, text, end, b, None)
        score = sum(model.whole.get_score(i) for i in model.ids(text[begin:end])) if end > begin else 0.0
        ways = {(s, e): tail[e][1] for s, e in exits if e in tail and tail[e][0] == s and s >= end}
        if end == b:  # the states end at the space itself
            ways = {}
            for n, (s, e) in enumerate(exits):
                if e == b and begin < end:
                    ids, own = model.ids(text[begin:end]), model.ids(text[s:e])
                    if ids[-len(own):] == own:
                        ways[s, e] = 0.0
            if begin == end:
                middle = None
        if middle:
            for m, (s, e) in enumerate(entries):
                head = walk(model, text, e, begin, text[s:e] if e > s else None) if e <= begin else {}
                if begin in head:
                    for n, place in enumerate(exits):
                        if place in ways:
                            out[m, n] = head[begin][1] + score + ways[place]
            return out
    for m, (s, e) in enumerate(entries):
        reach = walk(model, text, e, b, text[s:e] if e > s else None)
        for n, (x, y) in enumerate(exits):
            if y in reach and reach[y][0] == x:
                out[m, n] = reach[y][1]
            elif (x, y) == (s, e):  # one piece over the whole chunk
                out[m, n] = 0.0
    return out


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product in the (max, +) semiring."""
    return (a[:, :, None] + b[None, :, :]).max(1)


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Products of the first 1, 2, ... matrices, by products of pairs."""
    if len(matrices) < 2:
        return matrices
    pairs = scan([times(a, b) for a, b in zip(matrices[::2], matrices[1::2], strict=False)])
    out = []
    for i, m in enumerate(matrices):
        out.append(m if i == 0 else pairs[i // 2] if i % 2 else times(pairs[i // 2 - 1], m))
    return out


def choose(matrices: list[np.ndarray]) -> list[int]:
    """The state at the end of every chunk on the best path."""
    best = scan(matrices)
    state = int(np.argmax(best[-1][0]))
    if not np.isfinite(best[-1][0][state]):
        raise ValueError("no path through the lattice")
    out = [state]
    for i in range(len(matrices) - 1, 0, -1):
        state = int(np.argmax(best[i - 1][0] + matrices[i][:, state]))
        out.append(state)
    return out[::-1]


def recover(model: Model, text: str, a: int, b: int, first: bool, last: bool, entry: int, exit_: int) -> list[int]:
    """Ids of the pieces that begin in the chunk, given the states at both ends."""
    s, e = (a, a) if first else states_at(model, text, a, False)[entry]
    x, y = states_at(model, text, b, last)[exit_]
    if (x, y) == (s, e):
        return []
    middle = _breaks(text, max(a, e), x)
    stop = x if middle is None else middle[0]

    def path(reach: dict, at: int, begin: int) -> list[int]:
        cuts = [at]
        while cuts[-1] != begin:
            cuts.append(reach[cuts[-1]][0])
        cuts.reverse()
        return [i for p, q in zip(cuts, cuts[1:], strict=False) for i in model.ids(text[p:q])]

    ids = path(walk(model, text, e, stop, text[s:e] if e > s else None), stop, e)
    if middle is not None:
        ids += model.ids(text[middle[0]:middle[1]]) if middle[1] > middle[0] else []
        ids += path(walk(model, text, middle[1], x, None), x, middle[1])
    return ids + model.ids(text[x:y])


def _cut(text: str, longest: int, chunk: int) -> list[tuple[int, int, int, int, str]]:
    """Chunks of the spaced form: number, how many, where it begins and ends in its own stretch, the stretch."""
    spaced = SPACE + text.replace(" ", SPACE)
    count = max(1, len(spaced) // chunk)
    edges = [len(spaced) * i // count for i in range(count + 1)]
    out = []
    for i in range(count):
        low, high = max(0, edges[i] - longest), min(len(spaced), edges[i + 1] + longest)
        out.append((i, count, edges[i] - low, edges[i + 1] - low, spaced[low:high]))
    return out


CHUNKS = "row long, number int, count int, begin int, stop int, stretch string"


def _giant_ids(giants: DataFrame, path: str, chunk: int) -> DataFrame:
    """row, ids of documents in chunks; ``giants`` has row, text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            for row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = list(zip(*_cut(text, model.longest, chunk), strict=True))
                kinds = [pa.int32()] * 4 + [pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * len(found[0]), pa.int64()), *(pa.array(c, k) for c, k in zip(found, kinds, strict=True))],
                    names=["row", "number", "count", "begin", "stop", "stretch"])

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            for row, number, count, a, b, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = transfer(model, text, a, b, number == 0, number == count - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row], pa.int64()), pa.array([number], pa.int32()), pa.array([own.shape[1]], pa.int32()),
                     pa.array([own.ravel()], pa.list_(pa.float64()))], names=["row", "number", "width", "scores"])

    def combine(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["number"])
        ends = choose([np.array(r["scores"]).reshape(-1, r["width"]) for r in rows])
        return pa.table({
            "row": pa.array([r["row"] for r in rows], pa.int64()), "number": pa.array([r["number"] for r in rows], pa.int32()),
            "entry": pa.array([0, *ends[:-1]], pa.int32()), "exit": pa.array(ends, pa.int32())})

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            for row, number, count, a, b, text, entry, exit_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = recover(model, text, a, b, number == 0, number == count - 1, entry, exit_)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row], pa.int64()), pa.array([number], pa.int32()), pa.array([ids], pa.list_(pa.int32()))],
                    names=["row", "number", "ids"])
        model.forget()

    # Chunks are dealt anew, so one giant document is worked on by many tasks.
    chunks = materialize(giants.select("row", "text").mapInArrow(cut, CHUNKS).repartition("row", "number"))
    states = chunks.mapInArrow(matrix, "row long, number int, width int, scores array<double>").groupBy("row").applyInArrow(
        combine, "row long, number int, entry int, exit int")
    found = chunks.join(states, ["row", "number"]).select(
        "row", "number", "count", "begin", "stop", "stretch", "entry", "exit").mapInArrow(back, "row long, number int, ids array<int>")
    return found.groupBy("row").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("number", "ids"))), lambda x: x["ids"])).alias("ids"))


def encode(docs: DataFrame, path: str, text_column: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``docs`` with ids (array of int) of every whole text."""
    name, row, probe = fresh(docs, "ids", "row", "probe")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    long = F.char_length(text) >= 2 * chunk
    probed, place = with_text(docs.filter(~long), text_column, probe)
    width = len(docs.columns)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = model.encode([t or "" for t in part.column(place).to_pylist()])
                ends = np.append(0, np.cumsum([len(x) for x in ids]))
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                own = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*part.columns[:width], own], names=[*part.schema.names[:width], name])
        model.forget()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [uuid.uuid4().int >> 65 for _ in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.int64())], names=[*batch.schema.names, row])

    short = probed.mapInArrow(whole, schema)
    giants = materialize(docs.filter(long).mapInArrow(
        number, T.StructType([*docs.schema.fields, T.StructField(row, T.LongType())])))
    ids = _giant_ids(giants.select(F.col(row).alias("row"), text.alias("text")), path, chunk).select(
        F.col("row").alias(probe), F.col("ids").alias(name))
    return short.unionAll(giants.join(ids, giants[row] == ids[probe]).select(*docs.columns, name))


def decode(encoded: DataFrame, path: str, ids_column: str = "ids", name: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids."""
    (name,) = fresh(encoded, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [model.decode(x.values.to_numpy().tolist()) if x.is_valid else None
                         for x in part.column(part.schema.names.index(ids_column))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, name])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(name, T.StringType())]))
