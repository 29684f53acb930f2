"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints sorted by Gray rank put similar ones side by side. Groups of neighbours share masked
bit patterns, which go to an upper node; a node holds only what its parent does not. A search adds
up differences from the root down and leaves out a whole group when they exceed the radius, and
also when the group already belongs to the component of the query.

Fingerprints are dealt to tasks by the pigeonhole principle: of radius + 1 parts of the bits, two
that link have one in common, so each goes to radius + 1 groups, however many there are; a group
of more than ``CELL`` is dealt anew by parts of the other bits. A task has the groups of some
values of one part, puts the bits of that part first in the order, and searches its Gray index
only below nodes that agree in them. It returns a spanning forest of the links, never all pairs. Equal
fingerprints are compared once. Components of the forests are found by rounds over written tables.

Defined results: null and empty texts have fingerprint zero and link like any other; rows with a
repeated id are one document; rows with a null id belong to components but never name one, and are
never dropped. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import SHINGLE, SIMILAR, byte_words, fresh
from lorespark.llm.components import components
from lorespark.operators.joins import materialize

WORDS, SEED, RADIUS = 3, 42, 2
#: Fingerprints and radius of the search for near copies.
TABLES, WIDE = 6, 3
#: Beside them, bands of least hashes of the five-word shingles, and hashes of a band. Two texts of resemblance
#: r agree in a band with probability r ** ROWS: at 0.8, all bands miss 2 pairs of 10,000.
BANDS, ROWS = 28, 6
#: Candidates that one task compares.
GROUP = 400
#: Fingerprints of a group that share bits, children of a node.
CELL, FAN = 20_000, 16
#: Pairs of query and node that a search has at a time.
PAIRS = 65_536


def fingerprint(text: bytes | None, size: int = WORDS) -> int:
    """64 bits: 1 where more than half of the shingles' XXH64 have it; as a signed integer."""
    from xxhash import xxh64_intdigest

    words = byte_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    size = min(size, len(words))
    spans = list(zip(starts, ends[size - 1:], strict=False))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(spans), 65_536):
        hashes = np.array([xxh64_intdigest(joined[a:b - 1], SEED) for a, b in spans[at:at + 65_536]], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(spans)).view("<i8")[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, fingerprint (long) of every row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fingerprint"])

    return docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").cast("binary")
    ).mapInArrow(make, "doc_id long, fingerprint long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def compressed(parent: np.ndarray) -> np.ndarray:
    while True:
        above = parent[parent]
        if np.array_equal(above, parent):
            return parent
        parent = above


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``parent``, with every node pointing at its root, after linking a[i] with b[i]."""
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        parent = compressed(parent)


class GrayIndex:
    """Codes with the bits that count (``masks``), in Gray order, under nodes of shared bits."""

    def __init__(self, codes: np.ndarray, masks: np.ndarray | None = None):
        masks = np.full(len(codes), ~np.uint64(0)) if masks is None else masks
        self.order = np.argsort(gray_rank(codes), kind="stable")
        bits, mask = codes[self.order], masks[self.order]
        levels = [(bits, mask)]
        while len(bits) > 1:
            cuts = np.arange(0, len(bits), FAN)
            every, some = np.bitwise_and.reduceat(bits, cuts), np.bitwise_or.reduceat(bits, cuts)
            mask = np.bitwise_and.reduceat(mask, cuts) & ~(every ^ some)
            bits = every
            levels.append((bits, mask))
        # Own bits of a node: those its parent's pattern lacks.
        self.levels = [
            (b, m & ~np.repeat(levels[i + 1][1], FAN)[: len(m)] if i + 1 < len(levels) else m)
            for i, (b, m) in enumerate(levels)]

    def labels(self, label: np.ndarray) -> list[np.ndarray]:
        """For each level, the label that all codes of a node have, or -1."""
        out = [label[self.order]]
        while len(out[-1]) > 1:
            cuts = np.arange(0, len(out[-1]), FAN)
            low, high = np.minimum.reduceat(out[-1], cuts), np.maximum.reduceat(out[-1], cuts)
            out.append(np.where(low == high, low, -1))
        return out

    def search(self, queries: np.ndarray, radius: int, own: np.ndarray | None = None,
               labels: list[np.ndarray] | None = None, must: np.uint64 = np.uint64(0)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, code) places within ``radius`` that agree in ``must``, in batches; without those of equal label."""
        top = len(self.levels) - 1
        start = (top, np.arange(len(queries)), np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64))
        waiting = [start]
        while waiting:
            level, query, node, apart = waiting.pop()
            if len(query) > PAIRS:
                half = len(query) // 2
                waiting += [(level, query[:half], node[:half], apart[:half]), (level, query[half:], node[half:], apart[half:])]
                continue
            bits, mask = self.levels[level]
            differ = (queries[query] ^ bits[node]) & mask[node]
            apart = apart + np.bitwise_count(differ)
            near = (apart <= radius) & (differ & must == 0)
            if labels is not None:
                near &= labels[level][node] != own[query]
            query, node, apart = query[near], node[near], apart[near]
            if not len(query):
                continue
            if level == 0:
                yield query, self.order[node]
                continue
            below = len(self.levels[level - 1][0])
            child = (node[:, None] * FAN + np.arange(FAN)).ravel()
            real = child < below
            waiting.append((level - 1, np.repeat(query, FAN)[real], child[real], np.repeat(apart, FAN)[real]))


def forest(codes: np.ndarray, radius: int = RADIUS, must: np.uint64 = np.uint64(0)) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links among ``codes`` that have the bits of ``must`` in common."""
    if not len(codes):
        return codes, codes
    parent = np.arange(len(codes))
    index = GrayIndex(codes)
    at, size = 0, 64
    while at < len(codes):
        # Labels are renewed for each block; small blocks first, so that a dense group is
        # united early and then left out as a whole.
        block = np.arange(at, min(at + size, len(codes)))
        for query, code in index.search(codes[block], radius, parent[block], index.labels(parent), must):
            parent = unite(parent, block[query], code)
        at, size = at + size, min(size * 2, 4096)
    linked = np.flatnonzero(parent != np.arange(len(codes)))
    return codes[linked], codes[parent[linked]]


def parts(mask: int, count: int) -> list[int]:
    """``mask`` with, in turn, each of ``count`` nearly equal parts of the bits that it lacks."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * i // count for i in range(count + 1)]
    return [mask | sum(1 << b for b in free[x:y]) for x, y in zip(cuts, cuts[1:], strict=False) if y > x]


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


def moved(codes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Codes with their bits (the highest first) in another order, which keeps differences."""
    bits = np.unpackbits(codes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(np.ascontiguousarray(bits[:, order]), axis=1).ravel().view(">u8").astype(np.uint64)


def _routed(codes: DataFrame, radius: int, limit: int) -> DataFrame:
    """table, mask, code: codes that agree in the bits of a mask, no more than ``limit`` of them where bits are left.

    Of radius + 1 parts of the bits, two codes within the radius have one in common, so a code goes
    to radius + 1 groups, however many codes there are. Crowded groups are dealt anew by
    parts of the other bits.
    """
    masks, out = [0], None
    rest = codes.select("table", F.lit(0).cast("long").alias("mask"), F.col("fingerprint").alias("code"))
    while True:
        child = {m: parts(m % 2**64, radius + 1) for m in masks}
        deeper = F.create_map(*[x for m, c in child.items() for x in (
            F.lit(m).cast("long"), F.array(*[F.lit(_signed(k)).cast("long") for k in c]))])
        keyed = rest.select("table", F.explode(F.element_at(deeper, F.col("mask"))).alias("mask"), "code").withColumn(
            "value", F.col("code").bitwiseAND(F.col("mask")))
        # A mask may be come by in several ways.
        keyed = keyed if out is None else keyed.distinct()
        key = ["table", "mask", "value"]
        crowded = materialize(keyed.groupBy(*key).count().filter(F.col("count") > limit).drop("count"))
        # Masks of crowded groups only; with all bits in common a group is one code.
        masks = [r["mask"] for r in crowded.select("mask").distinct().collect()]
        if not masks or -1 in masks:
            return keyed if out is None else out.unionByName(keyed)
        done = keyed.join(crowded, key, "left_anti")
        out = done if out is None else out.unionByName(done)
        rest = materialize(keyed.join(crowded, key, "left_semi").select("table", "mask", "code"))


def link_forests(found: DataFrame, radius: int, limit: int = CELL) -> DataFrame:
    """table, a, b: spanning forests of the links between fingerprints (table, fingerprint)."""
    codes = materialize(found.select(F.col("table").cast("int").alias("table"), "fingerprint").distinct())
    # About ``limit`` codes a task; the values of a mask share tasks, and stay apart within them.
    most = codes.groupBy("table").count().agg(F.max("count")).first()[0] or 0
    shares = max(1, -(-most // limit))

    def link(group: pa.Table) -> pa.Table:
        mask = group.column("mask")[0].as_py() % 2**64
        own = group.column("code").to_numpy().astype(np.int64).view(np.uint64)
        # The bits in common come first: they decide the upper nodes of the index.
        order = np.array(sorted(range(64), key=lambda b: not mask >> (63 - b) & 1))
        common = bin(mask).count("1")
        a, b = forest(moved(own, order), radius, np.uint64((2**common - 1) << (64 - common)))
        back = np.argsort(order)
        table = np.full(len(a), group.column("table")[0].as_py(), np.int32)
        return pa.table({"table": table, "a": moved(a, back).view(np.int64), "b": moved(b, back).view(np.int64)})

    routed = _routed(codes, radius, limit).withColumn("share", F.pmod(F.xxhash64("value"), F.lit(shares)))
    return routed.select("table", "mask", "share", "code").groupBy("table", "mask", "share").applyInArrow(
        link, "table int, a long, b long")


def near_components(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS,
    limit: int = CELL,
) -> DataFrame:
    """doc_id, fingerprint, component_id, the smallest id reachable, of every row."""
    found = materialize(fingerprints(docs, id_column, text_column))
    own = found.groupBy("fingerprint").agg(F.min("doc_id").alias("own"))
    links = link_forests(found.select(F.lit(0).alias("table"), "fingerprint"), radius, limit)
    roots = components(links.select("a", "b")).withColumnRenamed("node", "fingerprint")
    rooted = own.join(roots, "fingerprint", "left").withColumn(
        "root", F.coalesce("root", "fingerprint"))
    least = rooted.groupBy("root").agg(F.min("own").alias("component_id"))
    named = materialize(rooted.join(least, "root").select("fingerprint", "component_id"))
    return found.join(named, "fingerprint")


def hexadecimal(code: Column) -> Column:
    return F.lower(F.lpad(F.hex(code), 16, "0"))


def sketches(words: list[bytes]) -> list[int]:
    """``TABLES`` fingerprints of the distinct words, of independent hashes; signed."""
    from xxhash import xxh64_intdigest

    own = sorted(set(words))
    if not own:
        return [0] * TABLES
    counts = np.zeros((TABLES, 64), np.int64)
    for at in range(0, len(own), 16_384):
        part = own[at:at + 16_384]
        hashes = np.array([[xxh64_intdigest(w, seed) for w in part] for seed in range(TABLES)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(TABLES, -1, 8), axis=2).sum(1, dtype=np.int64)
    return np.packbits(counts * 2 > len(own), axis=1).view("<i8").ravel().tolist()


def bands(words: list[bytes]) -> list[int]:
    """``BANDS`` hashes, each of ``ROWS`` least hashes of the distinct word shingles; signed. None without words."""
    from xxhash import xxh64_intdigest

    if not words:
        return []
    rng = np.random.default_rng(SEED)
    times = rng.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    mask = rng.integers(0, 2**63, BANDS * ROWS, np.uint64)
    own = np.array([xxh64_intdigest(s) for s in _shingles(words)], "<u8")
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(own), 2048):
        least = np.minimum(least, ((own[at:at + 2048, None] ^ mask) * times).min(0))
    raw = least.astype("<u8").tobytes()
    width = 8 * ROWS
    return [xxh64_intdigest(raw[i * width:(i + 1) * width]) - 2**63 for i in range(BANDS)]


def _shingles(words: list[bytes]) -> set[bytes]:
    return {b" ".join(words[i:i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def _share(x: set[bytes], y: set[bytes]) -> float:
    return len(x & y) / len(x | y) if x or y else 1.0


def resemblance(a: list[bytes], b: list[bytes]) -> float:
    """Share of common word shingles; 1 for two texts without words."""
    return _share(_shingles(a), _shingles(b))


def near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", similar: float = SIMILAR,
                radius: int = WIDE) -> DataFrame:
    """doc_id of every document that repeats another one that stays, and ``kept``, that one.

    Equal texts are found by digest. Of different ones, candidates link in any of ``TABLES``
    SimHash fingerprints of their distinct words, which edits of single words hardly move, or in any
    of ``BANDS`` bands of least hashes of their shingles, whose chance depends on the resemblance
    alone, so that added and cut passages are found like scattered edits. Candidate pairs are
    verified by the exact share of common five-word shingles, and components of the verified links
    are then gone through by the same share. In blocks of
    about ``GROUP`` documents, one by one, a document is dropped that reaches ``similar`` with an
    earlier one that stays. Components of one block are settled at once, larger ones dealt anew
    until their blocks drop nothing, and then one leader at a time. Nothing is dropped
    unverified. Documents with a null id are never dropped.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One text at a time: words of a whole batch would fill the memory of a worker.
            found = [sketches(words) + bands(words) for words in (byte_words(t.as_py()) for t in batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "digest", "codes"])

    text = F.coalesce(F.col(text_column).cast("string"), F.lit("")).cast("binary")
    named = docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text")).filter("doc_id IS NOT NULL")
    coded = materialize(named.select("doc_id", F.sha2("text", 256).alias("digest"), "text").mapInArrow(
        make, "doc_id long, digest string, codes array<long>"))
    firsts = coded.groupBy("digest").agg(F.min("doc_id").alias("node"))
    equal = materialize(coded.join(firsts, "digest").filter("doc_id <> node").select("doc_id", F.col("node").alias("kept")).distinct())
    # A repeated id with several texts is taken by its least digest.
    single = materialize(coded.join(equal, "doc_id", "left_anti").groupBy("doc_id").agg(F.min_by("codes", "digest").alias("codes"))
                         .select(F.col("doc_id").alias("node"), F.posexplode("codes").alias("table", "fingerprint")))
    # Tables from ``TABLES`` on are bands, in which only equal hashes link.
    forests = materialize(link_forests(single.filter(F.col("table") < TABLES), radius))
    least = single.groupBy("table", "fingerprint").agg(F.min("node").alias("least"), F.max("node").alias("most"))
    # Two centres of every band: a document that is unlike one may be like the other.
    same = single.join(least, ["table", "fingerprint"]).select(
        F.col("node").alias("a"), F.explode(F.array("least", "most")).alias("b"))

    def at(end: str) -> DataFrame:
        return least.select("table", F.col("fingerprint").alias(end), F.col("least").alias(f"node_{end}"))

    linked = forests.join(at("a"), ["table", "a"]).join(at("b"), ["table", "b"]).select(
        F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    candidates = materialize(linked.unionAll(same).filter("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ends = candidates.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = materialize(named.join(ends, F.col("doc_id") == F.col("node"), "left_semi").groupBy("doc_id").agg(
        F.min("text").alias("text")).withColumnRenamed("doc_id", "node"))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [resemblance(byte_words(a.as_py()), byte_words(b.as_py())) >= similar
                    for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    # Only verified links make components, so unlike documents never crowd one.
    pairs = candidates.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    roots = materialize(components(materialize(pairs.mapInArrow(alike, "a long, b long"))))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [resemblance(byte_words(a), byte_words(b)) >= similar
                    for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(near, pa.bool_())], names=["node", "root", "first", "near"])

    def settle(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("node", "root", "text", "blocks")), strict=True))
        leaders, kept = [], []
        for node, _, text, _ in rows:
            own = _shingles(byte_words(text))
            kept.append(next((other for other, held in leaders if _share(own, held) >= similar), None))
            if kept[-1] is None:
                leaders.append((node, own))
        return pa.table({
            "node": pa.array([r[0] for r in rows], pa.int64()), "root": pa.array([r[1] for r in rows], pa.int64()),
            "kept": pa.array(kept, pa.int64()), "alone": pa.array([r[3] == 1 for r in rows], pa.bool_())})

    dropped, open_, turn = equal, roots, 0
    while not open_.isEmpty():
        sizes = open_.groupBy("root").agg(F.ceil(F.count("*") / GROUP).alias("blocks"))
        block = F.pmod(F.xxhash64("node", F.lit(turn)), F.col("blocks"))
        asked = open_.join(sizes, "root").withColumn("block", block).join(texts, "node")
        told = materialize(asked.groupBy("root", "block").applyInArrow(
            settle, "node long, root long, kept long, alone boolean"))
        gone = told.filter("kept IS NOT NULL").select(F.col("node").alias("doc_id"), "kept")
        dropped, turn = dropped.unionAll(gone), turn + 1
        open_ = told.filter("kept IS NULL AND NOT alone").select("node", "root")
        if told.filter("kept IS NOT NULL AND NOT alone").isEmpty():
            break
    # Components that stay crowded though no block of them drops any more: one leader at a time.
    while not open_.isEmpty():
        first = open_.groupBy("root").agg(F.min("node").alias("first"))
        pairs = open_.join(first, "root").filter("node <> first")
        asked = pairs.join(texts, "node").join(
            texts.select(F.col("node").alias("first"), F.col("text").alias("first_text")), "first")
        told = materialize(asked.select("node", "root", "first", "text", "first_text").mapInArrow(
            verify, "node long, root long, first long, near boolean"))
        dropped = dropped.unionAll(told.filter("near").select(F.col("node").alias("doc_id"), F.col("first").alias("kept")))
        open_ = told.filter("NOT near").select("node", "root")
    # A text equal to one that was dropped repeats what that one repeats.
    final = dropped.select(F.col("doc_id").alias("kept"), F.col("kept").alias("last"))
    return dropped.join(final, "kept", "left").select("doc_id", F.coalesce("last", "kept").alias("kept")).distinct()


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
             similar: float = SIMILAR, radius: int = WIDE) -> DataFrame:
    """``docs`` without the near copies of documents that stay; all columns kept."""
    (gone,) = fresh(docs, "gone")
    dropped = materialize(near_copies(docs, id_column, text_column, similar, radius).select(
        F.col("doc_id").alias(gone)).distinct())
    return docs.join(dropped, docs[id_column].cast("long") == dropped[gone], "left_anti")
