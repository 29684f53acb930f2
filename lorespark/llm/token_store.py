"""Token ids as binary shards with a shared compression dictionary.

A shard file holds one zstandard frame per document, then its index (document id, offset, number
of ids for each document), then a footer. All frames use one dictionary, trained on the
serialized ids of a bounded sample; the file carries the dictionary's SHA-256 and is not read with
another. One document is read with two range reads: footer with index, then its frame.

Defined results: a null text counts as empty; every document ends with the end id, so an empty one
has a single id; documents with a null id come first; repeated ids are kept, ordered by text.
Ids below 65,536 take two bytes, others four. An empty table gives no shard.
"""

from __future__ import annotations

import bisect
import hashlib
import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.common import Reader, TaskFile, get_json, open_folder, put_json
from lorespark.llm.memo import WordMemo
from lorespark.operators.joins import materialize

MAGIC = b"IDSHARD1"
FOOTER = "<8s32sBxxxxxxxQQ"  # magic, dictionary hash, bytes per id, documents, index offset
NULL_ID = -(2**63)
DICTIONARY = "dictionary.zstd"
SPACE = "Ġ"  # as the byte-level alphabet writes it
#: Words that go to the library in one text; its time a word grows again in longer ones.
PACK = 64
#: Bounds of the dictionary's training sample: documents, and ids of each.
SAMPLE_DOCS, SAMPLE_IDS = 1500, 16_384
SHARDS = "part long, file string, docs long, tokens long, first long, last long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


@lru_cache(maxsize=2)
def _encoder(path: str) -> tuple[WordMemo, int]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    width = 2 if tokenizer.get_vocab_size() <= 1 << 16 else 4

    kind, code = ("H", "<u2") if width == 2 else ("I", "<u4")

    def encode(texts: list[str]) -> list[bytes]:
        found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array(kind, x.ids).tobytes() for x in found]

    # A space begins a piece, so words can go to the library many in one text: each begins where a token
    # does that holds its space.
    opens = np.zeros(tokenizer.get_vocab_size(), bool)
    opens[[i for token, i in tokenizer.get_vocab().items() if token.startswith(SPACE)]] = True

    def spaced(words: list[str]) -> list[bytes]:
        out = []
        packs = [words[i:i + PACK] for i in range(0, len(words), PACK)]
        for pack, raw in zip(packs, encode(["".join(f" {w}" for w in p) for p in packs]), strict=True):
            starts = (np.flatnonzero(opens[np.frombuffer(raw, code)]) * width).tolist()
            if len(starts) == len(pack):
                out += [raw[a:b] for a, b in zip(starts, [*starts[1:], len(raw)], strict=True)]
            else:  # a tokenizer that writes spaces otherwise
                out += encode([" " + w for w in pack])
        return out

    return WordMemo(encode, spaced), width


def train_dictionary(docs: DataFrame, tokenizer: str, size: int = 112_640) -> bytes:
    """A dictionary from the first ids of ``SAMPLE_DOCS`` documents, picked by a hash of the id."""
    picked = docs.select("doc_id").orderBy(F.xxhash64("doc_id")).limit(SAMPLE_DOCS).distinct()
    sample = docs.join(F.broadcast(picked), "doc_id", "left_semi").limit(SAMPLE_DOCS)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, width = _encoder(tokenizer)
        for batch in batches:
            ids = [x[: SAMPLE_IDS * width] for x in memo([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], names=["ids"])

    samples = [bytes(r[0]) for r in sample.mapInArrow(encode, "ids binary").collect()]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too little to train on: the sample itself
        return b"".join(samples)[-size:]


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, level: int = 3,
    id_column: str = "doc_id", text_column: str = "text",
) -> list[dict]:
    """Write ``docs`` in ascending order of ids to ``folder``; its manifest, a row per shard.

    Documents are ranged by id, encoded and written by the task that has the range.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"),
                       F.col(text_column).cast("string").alias("text"))
    dictionary = train_dictionary(docs, tokenizer)
    store, root = open_folder(folder)
    with store.open_output_stream(f"{root}/{DICTIONARY}", compression=None) as out:
        out.write(dictionary)
    sent = spark.sparkContext.broadcast(dictionary)
    digest = hashlib.sha256(dictionary).digest()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, width = _encoder(tokenizer)
        end = end_id.to_bytes(width, "little")
        pack = _compressor(sent.value, level)
        file, index = None, []
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                ids, texts = (c.to_pylist() for c in batch.slice(start, 1024).columns)
                file = file or TaskFile(folder, "tokens", ".ids")
                for doc_id, own in zip(ids, memo([t or "" for t in texts]), strict=True):
                    own += end
                    at, _ = file.write(pack.compress(own))
                    index.append((NULL_ID if doc_id is None else doc_id, at, len(own) // width))
        if file:
            at, _ = file.write(np.array(index, "<i8").tobytes())
            file.write(struct.pack(FOOTER, MAGIC, digest, width, len(index), at))
            file.close()
            yield pa.RecordBatch.from_pylist([{
                "part": int(file.name.split("-")[1]), "file": file.name, "docs": len(index),
                "tokens": sum(x[2] for x in index), "first": index[0][0], "last": index[-1][0]}])

    ranged = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = materialize(ranged.mapInArrow(write, SHARDS)).orderBy("part").collect()
    starts = accumulate((s["tokens"] for s in shards), initial=0)
    manifest = [{**s.asDict(), "start": at} for s, at in zip(shards, starts, strict=False)]
    put_json(folder, "manifest.json.gz", manifest)
    return manifest


def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=level, dict_data=data, write_dict_id=False)


class Shard:
    """One shard file: its index, and the ids of any of its documents."""

    def __init__(self, reader: Reader, file: str, dictionary: bytes):
        self.reader, self.file, size = reader, file, reader.size(file)
        magic, digest, self.width, docs, self.end = struct.unpack(
            FOOTER, reader.read(file, size - struct.calcsize(FOOTER), struct.calcsize(FOOTER)))
        if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{file} was not written with this dictionary")
        raw = reader.read(file, self.end, docs * 24)
        self.doc_ids, self.offsets, self.counts = np.frombuffer(raw, "<i8").reshape(-1, 3).T
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.unpack = zstandard.ZstdDecompressor(dict_data=data)

    def frames(self, first: int, last: int) -> list[np.ndarray]:
        """Ids of the documents at places first to last (excluded), by one range read."""
        ends = np.append(self.offsets[first + 1: last], self.offsets[last] if last < len(self.offsets) else self.end)
        at = int(self.offsets[first])
        raw = self.reader.read(self.file, at, int(ends[-1]) - at)
        return [
            np.frombuffer(self.unpack.decompress(raw[a - at: b - at], max_output_size=int(n) * self.width), f"<u{self.width}")
            for a, b, n in zip(self.offsets[first:last].tolist(), ends.tolist(), self.counts[first:last], strict=True)]


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Every document of the shards in ``folder``: its place in the id stream, count and CRC-32."""
    manifest = get_json(folder, "manifest.json.gz")
    dictionary = Reader(folder)
    sent = spark.sparkContext.broadcast(dictionary.read(DICTIONARY, 0, dictionary.size(DICTIONARY)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder)
        for batch in batches:
            for file, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard = Shard(reader, file, sent.value)
                starts = start + np.append(0, np.cumsum(shard.counts)[:-1])
                for a in range(0, len(starts), 1000):
                    b = min(a + 1000, len(starts))
                    ids = [x.astype("<u4") for x in shard.frames(a, b)]
                    own = shard.doc_ids[a:b]
                    columns = [
                        pa.array(own, mask=own == NULL_ID), pa.array(starts[a:b]), pa.array(shard.counts[a:b]),
                        pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())]
                    columns += [pa.array(ids, pa.list_(pa.int64()))] if with_ids else []
                    yield pa.RecordBatch.from_arrays(
                        columns, names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    files = spark.createDataFrame([(m["file"], m["start"]) for m in manifest], "file string, start long")
    return files.repartition(max(1, len(manifest))).mapInArrow(read, READ + ", ids array<long>" * with_ids)


def read_document(folder: str, doc_id: int) -> list[np.ndarray]:
    """Ids of one document (of each of its repeats), by range reads of the shards that span it."""
    reader, out = Reader(folder), []
    dictionary = reader.read(DICTIONARY, 0, reader.size(DICTIONARY))
    for entry in get_json(folder, "manifest.json.gz"):
        if entry["first"] <= doc_id <= entry["last"]:
            shard = Shard(reader, entry["file"], dictionary)
            own = shard.doc_ids.tolist()
            a, b = bisect.bisect_left(own, doc_id), bisect.bisect_right(own, doc_id)
            out += shard.frames(a, b) if a < b else []
    return out
