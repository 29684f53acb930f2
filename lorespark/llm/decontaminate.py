"""Documents that contain benchmark items, by size-partitioned MinHash containment search.

Items are partitioned by their number n of distinct shingles. A document that contains at least
``SIMILAR`` of them lacks at most n - ceil(SIMILAR n), so it holds one of any n - ceil(SIMILAR n) + 1.
Those with the smallest hashes are the item's MinHash signature; its length belongs to the size
partition. A sketch of the long side would lose short items, whose resemblance to a long document
is near zero, so documents are probed with all their shingles: no item is missed. Candidates are
verified by the exact share of the item's shingles, compared as text, in the whole document.

Items are searched in blocks of bounded size that go to every task; documents are read once
per block and never shuffled.

Defined results: words as in ``common``; an item with fewer than five words is one shingle of all its
words, one without words (or null) is never found; null or empty documents contain nothing;
repeated rows are found as often as they occur; empty tables give no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import SHINGLE, SIMILAR, byte_words, fresh, with_text
from lorespark.operators.joins import materialize

#: Words of the items that one block may have; a single longer item is a block of its own.
BLOCK_WORDS = 2_000_000
FOUND = "doc_id long, item_id long, matched int, item_shingles int, containment double"


def shingles(words: list[bytes], size: int) -> list[bytes]:
    """``size`` words each; none where there are fewer."""
    return [b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)]


class ItemIndex:
    """Signatures and shingles of a block of items."""

    def __init__(self, items: list[tuple[int, bytes]], share: float, size: int):
        from xxhash import xxh64_intdigest

        self.items: list[tuple[int, frozenset[bytes], int]] = []
        self.signature: dict[int, dict[bytes, list[int]]] = defaultdict(lambda: defaultdict(list))
        exact = Fraction(str(share))
        for item_id, text in items:
            words = byte_words(text)
            width = min(size, len(words))
            own = frozenset(shingles(words, width)) if words else frozenset()
            if not own:
                continue
            least = max(1, ceil(exact * len(own)))
            self.items.append((item_id, own, least))
            for s in sorted(own, key=lambda x: (xxh64_intdigest(x), x))[: len(own) - least + 1]:
                self.signature[width][s].append(len(self.items) - 1)
        self.signature = {w: dict(s) for w, s in self.signature.items()}

    def find(self, text: bytes | None) -> list[tuple[int, int, int]]:
        """(item id, shingles found, shingles of the item) of every item that ``text`` contains."""
        words = byte_words(text)
        out = []
        for width, signature in self.signature.items():
            own = set(shingles(words, width))
            asked = {i for s in own & signature.keys() for i in signature[s]}
            for item_id, item, least in (self.items[i] for i in asked):
                matched = len(item & own)
                if matched >= least:
                    out.append((item_id, matched, len(item)))
        return sorted(out, key=lambda x: (x[0] is None, x))


def _blocks(items: DataFrame, id_column: str, text_column: str) -> Iterator[list[tuple[int, bytes]]]:
    """Blocks of items on the driver, one at a time."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary")
    item = materialize(items.select(F.col(id_column).cast("long").alias("item_id"), text.alias("text")))
    words = item.agg(F.sum(F.size(F.split(F.col("text").cast("string"), " ")))).first()[0] or 0
    count = max(1, -(-words // BLOCK_WORDS))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    for i in range(count):
        yield [(r[0], bytes(r[1])) for r in item.filter(block == i).collect()]


def contained_items(
    docs: DataFrame, items: DataFrame, share: float = SIMILAR, size: int = SHINGLE,
    id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """A row per document and item it contains: FOUND."""
    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"),
                       F.col(text_column).cast("string").cast("binary").alias("text"))
    parts = []
    for block in _blocks(items, item_id, item_text):
        sent = sc.broadcast(ItemIndex(block, share, size))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(d, i, m, n, m / n) for d, t in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                        for i, m, n in sent.value.find(t)]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    names=["doc_id", "item_id", "matched", "item_shingles", "containment"])

        parts.append(docs.mapInArrow(search, FOUND))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def drop_contaminated(
    docs: DataFrame, items: DataFrame, share: float = SIMILAR, size: int = SHINGLE,
    text_column: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``docs`` without those that contain an item; all columns kept, row by row."""
    columns = list(docs.columns)
    (probe,) = fresh(docs, "probe")
    sc = docs.sparkSession.sparkContext
    for block in _blocks(items, item_id, item_text):
        sent = sc.broadcast(ItemIndex(block, share, size))
        probed, at = with_text(docs, text_column, probe)

        def keep(batches: Iterator[pa.RecordBatch], sent=sent, at=at) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                # One text at a time: bytes of a whole batch would fill the memory of a worker.
                clean = [not sent.value.find(t.as_py()) for t in batch.column(at).cast(pa.binary())]
                kept = batch.filter(pa.array(clean, pa.bool_()))
                yield pa.RecordBatch.from_arrays(kept.columns[:len(columns)], names=columns)

        docs = probed.mapInArrow(keep, docs.schema)
    return docs
