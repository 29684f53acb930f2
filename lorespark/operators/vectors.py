"""Exact vector search and exact similarity pairs in numpy blocks that Spark distributes.

Cosines are rounded to nine digits before they are ranked or compared, so the order of
floating point additions cannot decide a tie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.operators.blocks import held, read_blocks, write_blocks
from lorespark.operators.joins import MAX_TOP_K, materialize, salted_join, top_per_query

SCORE_DIGITS = 9
SCALE = 10**SCORE_DIGITS
#: Bytes of one block of queries and of the vectors that a task compares with it, as doubles.
QUERY_BYTES, HELD_BYTES = 128 << 10, 16 << 20
#: Key of a row that a query's filters refuse.
NEVER = -(2**62)
#: Levels of a quantised entry, on either side of zero.
LEVELS = 127
CODES = "doc_id string, chunk_index int, code binary, step double, off double, same long"


def unit_rows(column: pd.Series) -> np.ndarray:
    return _unit(np.array(column.tolist(), dtype=np.float64))


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _by_width(table: pa.Table, name: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, places, unit vectors) of the list column ``name``, for each width there is."""
    column = table.column(name)
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    widths = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    for width in np.unique(widths[widths > 0]):
        at = np.flatnonzero(widths == width)
        flat = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        yield int(width), at, _unit(flat.reshape(len(at), int(width)))


class _Asked:
    """A block of queries of one width, with their limits and filters."""

    def __init__(self, block: pa.Table, at: np.ndarray, unit: np.ndarray):
        own = block.take(pa.array(at))
        self.ids, self.unit = own.column("query_id").combine_chunks(), unit
        self.top_k = own.column("top_k").to_numpy()
        self.filters = [(path or "", frozenset(tags or ())) for path, tags in zip(
            own.column("filter_path").to_pylist(), own.column("filter_tags").to_pylist(), strict=True)]

    def allowed(self, path: list, tags: list) -> np.ndarray | None:
        """(query, row): whether the row passes the query's filters; None where there are none."""
        if not any(p or t for p, t in self.filters):
            return None
        known = {
            f: np.array([(not f[0] or p == f[0]) and (not f[1] or not f[1].isdisjoint(t or ()))
                         for p, t in zip(path, tags, strict=True)], bool)
            for f in set(self.filters)}
        return np.array([known[f] for f in self.filters])


def _asked_blocks(queries: DataFrame) -> str:
    """Queries that have a vector, as blocks of bounded bytes in the shared folder."""
    asked = queries.filter(F.size("embedding") > 0).select(
        "query_id", F.col("top_k").cast("int").alias("top_k"), "filter_path", "filter_tags",
        F.col("embedding").cast("array<double>").alias("embedding"))
    width = asked.agg(F.max(F.size("embedding"))).first()[0] or 1
    return write_blocks(asked, QUERY_BYTES // (8 * width))


def _in_order(table: pa.Table) -> pa.Table:
    """By document and chunk, which settles ties."""
    return table.sort_by([("doc_id", "ascending"), ("chunk_index", "ascending")])


def _hits_schema(queries: DataFrame) -> str:
    return f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id string, chunk_index int, raw_score double, top_k int"


def vector_channel(queries: DataFrame, vectors: DataFrame, catalog: DataFrame) -> DataFrame:
    """Exact cosine top-k of every query, within the query's directory and tag filters.

    ``queries`` carries an ``embedding``; ``vectors`` has doc_id, chunk_index, embedding.
    Vectors are scanned in place: a task holds some of them and reads the queries block by block
    from the shared folder, so neither passes the driver and memory does not grow with either. A
    task returns its own best rows of each query. Vectors of another width than the query's are
    no hits; a query without a vector has none.
    """
    folder = _asked_blocks(queries)
    placed = vectors.select("doc_id", "chunk_index", F.col("embedding").cast("array<double>").alias("embedding")).join(
        catalog.select("doc_id", "path", "tags"), "doc_id")
    schema = _hits_schema(queries)
    names = [c.split()[0] for c in schema.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in held(batches, HELD_BYTES):
            rows = _in_order(rows)
            parts = {w: (at, unit) for w, at, unit in _by_width(rows, "embedding")}
            for block in read_blocks(folder):
                for width, own, unit in _by_width(block, "embedding"):
                    if width not in parts:
                        continue
                    asked, (at, corpus) = _Asked(block, own, unit), parts[width]
                    scores = np.rint(asked.unit @ corpus.T * SCALE).astype(np.int64)
                    # Earlier rows win ties: the place is folded into the sort key.
                    keys = scores * len(at) - np.arange(len(at))
                    near = rows.take(pa.array(at))
                    allowed = asked.allowed(near.column("path").to_pylist(), near.column("tags").to_pylist())
                    if allowed is not None:
                        keys[~allowed] = NEVER
                    k = min(int(asked.top_k.max()), len(at))
                    best = np.argpartition(-keys, k - 1, axis=1)[:, :k] if k < len(at) else np.tile(np.arange(k), (len(keys), 1))
                    q, c = np.repeat(np.arange(len(keys)), k), best.ravel()
                    ok = keys[q, c] > NEVER
                    q, c = q[ok], c[ok]
                    found = near.take(pa.array(c))
                    yield pa.RecordBatch.from_arrays(
                        [asked.ids.take(pa.array(q)), found.column("doc_id").combine_chunks(), found.column("chunk_index").combine_chunks(),
                         pa.array(scores[q, c] / SCALE), pa.array(asked.top_k[q], pa.int32())], names=names)

    return top_per_query(placed.mapInArrow(scan, schema), "raw_score").select(
        "query_id", "doc_id", "chunk_index", F.lit("vector").alias("channel"), "raw_score"
    )


def vector_codes(vectors: DataFrame) -> DataFrame:
    """Quantised vectors at rest: CODES.

    A unit vector becomes one signed byte an entry, an eighth of its size, ``step`` what a level
    is worth, and ``off`` its distance from what the bytes stand for, which bounds the error of
    every cosine. ``same`` is equal for equal vectors.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for _, at, unit in _by_width(table, "embedding"):
                step = np.maximum(np.abs(unit).max(axis=1), 1e-300) / LEVELS
                code = np.rint(unit / step[:, None]).astype(np.int8)
                off = np.linalg.norm(unit - code * step[:, None], axis=1)
                own = table.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id").combine_chunks(), own.column("chunk_index").combine_chunks(),
                     pa.array([c.tobytes() for c in code], pa.binary()), pa.array(step), pa.array(off), own.column("same").combine_chunks()],
                    names=[c.split()[0] for c in CODES.split(", ")])

    rows = vectors.select("doc_id", F.col("chunk_index").cast("int").alias("chunk_index"),
                          F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.withColumn("same", F.xxhash64("embedding")).mapInArrow(encode, CODES)


def _decoded(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    codes = table.column("code").combine_chunks()
    widths = np.array([len(c) for c in codes.to_pylist()], np.int64)
    step = table.column("step").to_numpy()
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        joined = b"".join(codes.take(pa.array(at)).to_pylist())
        yield int(width), at, np.frombuffer(joined, np.int8).reshape(len(at), int(width)) * step[at, None]


def vector_candidates(queries: DataFrame, codes: DataFrame, catalog: DataFrame) -> DataFrame:
    """query_id, doc_id, chunk_index, low, high, top_k: rows that can be among a query's best.

    Only the codes are scanned. The cosine of a row lies between ``low`` and ``high``; a row goes
    when k others are surely better. Of rows with equal vectors only the first k can be results.
    """
    folder = _asked_blocks(queries)
    placed = codes.join(catalog.select("doc_id", "path", "tags"), "doc_id")
    schema = _hits_schema(queries).replace("raw_score double", "low double, high double")
    names = [c.split()[0] for c in schema.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in held(batches, HELD_BYTES // 8):
            rows = _in_order(rows)
            parts = {w: (at, unit) for w, at, unit in _decoded(rows)}
            for block in read_blocks(folder):
                for width, own, unit in _by_width(block, "embedding"):
                    if width not in parts:
                        continue
                    asked, (at, corpus) = _Asked(block, own, unit), parts[width]
                    near = rows.take(pa.array(at))
                    # Half a digit for the rounding of scores, as much again for that of the products.
                    off = near.column("off").to_numpy() + 1.0 / SCALE
                    about = asked.unit @ corpus.T
                    allowed = asked.allowed(near.column("path").to_pylist(), near.column("tags").to_pylist())
                    same = near.column("same").to_numpy()
                    for q in range(len(about)):
                        usable = np.arange(len(at)) if allowed is None else np.flatnonzero(allowed[q])
                        k = int(asked.top_k[q])
                        if len(usable) > k:
                            low = (about[q] - off)[usable]
                            usable = usable[(about[q] + off)[usable] >= np.partition(low, -k)[-k]]
                            usable = usable[_first_of_each(same[usable], k)]
                        found = near.take(pa.array(usable))
                        yield pa.RecordBatch.from_arrays(
                            [asked.ids.take(pa.array(np.full(len(usable), q))), found.column("doc_id").combine_chunks(),
                             found.column("chunk_index").combine_chunks(), pa.array((about[q] - off)[usable]),
                             pa.array((about[q] + off)[usable]), pa.array(np.full(len(usable), k), pa.int32())], names=names)

    return placed.mapInArrow(scan, schema)


def _first_of_each(values: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each value, in order."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    start = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    within = np.arange(len(values)) - np.repeat(start, np.diff(np.r_[start, len(values)]))
    return np.sort(order[within < k])


def vector_channel_coded(queries: DataFrame, codes: DataFrame, vectors: DataFrame, catalog: DataFrame) -> DataFrame:
    """The same hits as :func:`vector_channel`, from codes at rest and the vectors of few candidates.

    The kth best lower bound over all tasks leaves out candidates that one task could not; those
    that remain are scored by their vectors, so no hit is missed (recall 1).
    """
    found = materialize(vector_candidates(queries, codes, catalog))
    order = Window.partitionBy("query_id").orderBy(F.col("low").desc())
    bound = (
        found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= MAX_TOP_K)
        .filter(F.col("_n") <= F.col("top_k")).groupBy("query_id").agg(F.min("low").alias("least"), F.count("*").alias("n"))
    )
    kept = materialize(found.join(bound, "query_id").filter(
        (F.col("n") < F.col("top_k")) | (F.col("high") >= F.col("least"))).select("query_id", "doc_id", "chunk_index", "top_k"))
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("asked"))
    wanted = vectors.select("doc_id", "chunk_index", F.col("embedding").cast("array<double>").alias("embedding"))
    pairs = kept.join(wanted, ["doc_id", "chunk_index"]).join(asked, "query_id")
    # Equal texts of numbers make equal products: summed in one order, then rounded.
    dot = F.aggregate(F.zip_with("asked", "embedding", lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)

    def norm(name: str) -> Column:
        return F.sqrt(F.aggregate(name, F.lit(0.0), lambda t, x: t + x * x))

    length = norm("asked") * norm("embedding")
    score = F.when(length > 0, F.round(dot / length, SCORE_DIGITS)).otherwise(F.lit(0.0))
    return top_per_query(pairs.select("query_id", "doc_id", "chunk_index", "top_k", score.alias("raw_score")), "raw_score").select(
        "query_id", "doc_id", "chunk_index", F.lit("vector").alias("channel"), "raw_score")


#: Rows of one side of a tile; two such sides and their products fit every task.
BLOCK_ROWS = 2048
#: Unrelated vectors that may share a bucket of a band of signs.
BUCKET_ROWS = 1024
#: Bytes of the vectors that a task compares with the blocks of all cells.
VISITOR_BYTES = 8 << 20
PAIRS = "source string, target string, similarity double"


def _split(rows: DataFrame, keys: list[str], name: str, block_rows: int) -> DataFrame:
    """``block`` of every row and the number of blocks ``name`` of its group."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / block_rows).cast("int").alias(name))
    return salted_join(rows, sizes, keys, spread=["doc_id"]).withColumn(
        "block", F.pmod(F.xxhash64("doc_id"), F.col(name)).cast("int"))


def _tiles(rows: DataFrame, keys: list[str], threshold: float, block_rows: int) -> DataFrame:
    """Pairs within each group of ``rows``: doc_id, embedding and the keys of their group.

    Groups are cut into blocks, and every two blocks that meet are one tile, so a crowded group
    is many tasks.
    """
    def side(part: DataFrame, second: bool, x: Column, y: Column) -> DataFrame:
        return part.select("doc_id", "embedding", *keys, F.lit(second).alias("second"), x, y)

    own = _split(rows, keys, "n_own", block_rows)
    block = F.col("block")
    sides = side(own, False, block.alias("x"), F.explode(F.sequence(block, F.col("n_own") - 1)).alias("y")).unionByName(
        side(own.filter(block > 0), True, F.explode(F.sequence(F.lit(0), block - 1)).alias("x"), block.alias("y")))

    def tile(both: pd.DataFrame) -> pd.DataFrame:
        first, others = both[~both["second"]], both[both["second"]]
        alone = both["x"].iat[0] == both["y"].iat[0]
        others = first if alone else others
        if first.empty or others.empty:
            return pd.DataFrame(columns=[c.split()[0] for c in PAIRS.split(", ")])
        cosines = np.rint(unit_rows(first["embedding"]) @ unit_rows(others["embedding"]).T * SCALE) / SCALE
        if alone:
            cosines[np.tri(len(first), dtype=bool)] = -2.0
        i, j = np.nonzero(cosines >= threshold)
        return pd.DataFrame({"source": first["doc_id"].to_numpy()[i], "target": others["doc_id"].to_numpy()[j],
                             "similarity": cosines[i, j]})

    return sides.groupBy(*keys, "x", "y").applyInPandas(tile, PAIRS)


def _cell_pairs(units: DataFrame, n: int, threshold: float, pivots: int | None, block_rows: int) -> DataFrame:
    """Pairs by cells around pivots; a vector visits only the cells that can hold a partner.

    With u in the cell of pivot p, a partner in the cell of pivot q lies beyond the plane between
    p and q, which must be within the distance of the threshold, and within the cell's radius.
    Of two cells one visits the other, by the parity of their numbers. Tasks read the cells block by
    block from the shared folder, so no vector is copied to the cells it visits.
    """
    wanted = pivots or math.ceil(min(math.sqrt(n) / 2, n / block_rows))
    chosen = units.orderBy(F.xxhash64("doc_id"), "doc_id").limit(wanted).toPandas()
    centre = unit_rows(chosen["embedding"])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cosines = np.clip(unit_rows(batch["embedding"]) @ centre.T, -1.0, 1.0)
                cell = cosines.argmax(axis=1)
                angle = np.arccos(cosines[np.arange(len(batch)), cell])
                yield batch.assign(cell=cell.astype(np.int32), angle=angle)

    # The number tells rows apart; it is fixed by being written.
    placed = materialize(units.mapInPandas(assign, "doc_id string, embedding array<double>, cell int, angle double").withColumn(
        "number", F.monotonically_increasing_id()))
    # One row a pivot, as many as the pivots themselves.
    measured = placed.groupBy("cell").agg(F.max("angle").alias("radius")).toPandas()
    radius = np.full(len(centre), -np.inf)
    radius[measured["cell"].to_numpy()] = measured["radius"].to_numpy()
    reach = math.acos(min(1.0, threshold - 1.0 / SCALE)) + 1e-6
    span = math.sqrt(2.0 - 2.0 * min(1.0, threshold - 1.0 / SCALE)) + 1e-6

    tasks = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owners = placed.select("number", "doc_id", "embedding", "cell")
    folder = write_blocks(owners.repartitionByRange(tasks, "cell").sortWithinPartitions("cell"), block_rows)

    def visited(unit: np.ndarray, home: np.ndarray) -> np.ndarray:
        """(row, cell): whether the row meets the cell, its own included."""
        numbers = np.arange(len(centre))
        cosines = np.clip(unit @ centre.T, -1.0, 1.0)
        gap = np.sqrt(np.maximum(2.0 - 2.0 * (centre[home] @ centre.T), 0.0))
        lead = cosines[np.arange(len(unit)), home][:, None] - cosines
        turn = np.where((home[:, None] + numbers) % 2 == 1, home[:, None] < numbers, home[:, None] > numbers)
        near = turn & (lead <= span * gap + 1e-9) & (np.arccos(cosines) <= radius + reach)
        return near | (home[:, None] == numbers)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in held(batches, VISITOR_BYTES):
            rows = rows.combine_chunks()
            unit, home = unit_rows(rows.column("embedding").to_pandas()), rows.column("cell").to_numpy()
            meets = np.concatenate([visited(unit[i:i + 256], home[i:i + 256]) for i in range(0, len(unit), 256)])
            number, name = rows.column("number").to_numpy(), rows.column("doc_id").combine_chunks()
            for block in read_blocks(folder):
                cells, names = block.column("cell").to_numpy(), block.column("doc_id").combine_chunks()
                others, numbers = unit_rows(block.column("embedding").to_pandas()), block.column("number").to_numpy()
                edges = np.r_[0, np.flatnonzero(np.diff(cells)) + 1, len(cells)]
                for start, end in zip(edges[:-1], edges[1:], strict=True):
                    guests = np.flatnonzero(meets[:, cells[start]])
                    for at in range(0, len(guests), BLOCK_ROWS):
                        own = guests[at:at + BLOCK_ROWS]
                        cosines = np.rint(unit[own] @ others[start:end].T * SCALE) / SCALE
                        # Within a cell both meet each other.
                        twice = (home[own] == cells[start])[:, None] & (number[own][:, None] >= numbers[start:end])
                        i, j = np.nonzero((cosines >= threshold) & ~twice)
                        if len(i):
                            yield pa.RecordBatch.from_arrays(
                                [name.take(pa.array(own[i])), names.take(pa.array(start + j)), pa.array(cosines[i, j])],
                                names=[c.split()[0] for c in PAIRS.split(", ")])

    return owners.repartition(tasks).mapInArrow(scan, PAIRS)


def band_counts(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits of a band, bands) that bring together a pair at the threshold with probability ``recall``.

    Bits follow the logarithm of the number of vectors, so that buckets of unrelated vectors do not
    grow; the number of bands follows from the threshold. Every bit more multiplies the bands, and each
    band copies the vectors, which costs more than comparing some hundreds of them in a block.
    """
    bits = max(4, min(48, math.ceil(math.log2(max(n, 2) / BUCKET_ROWS))))
    equal = (1.0 - math.acos(min(1.0, threshold)) / math.pi) ** bits
    return bits, 1 if equal >= 1.0 else max(1, math.ceil(math.log(1.0 - recall) / math.log1p(-equal)))


def _band_pairs(units: DataFrame, n: int, threshold: float, recall: float, block_rows: int, seed: int = 42) -> DataFrame:
    """Pairs that agree in the signs of one band of random directions, verified by their cosine."""
    bits, bands = band_counts(n, threshold, recall)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = None
        for batch in batches:
            for start in range(0, len(batch), 1024):
                part = batch.iloc[start:start + 1024]
                unit = unit_rows(part["embedding"])
                if planes is None:
                    planes = np.random.default_rng(seed).standard_normal((bands * bits, unit.shape[1]))
                above = (unit @ planes.T > 0).reshape(len(part), bands, bits)
                code = above @ (np.int64(1) << np.arange(bits, dtype=np.int64))
                yield pd.DataFrame({
                    "doc_id": np.repeat(part["doc_id"].to_numpy(), bands), "band": np.tile(np.arange(bands, dtype=np.int32), len(part)),
                    "code": code.ravel()})

    codes = materialize(units.mapInPandas(sign, "doc_id string, band int, code long"))
    # Vectors follow only into buckets that hold two or more. Many small buckets share a task;
    # those beyond a block are cut into tiles.
    shared = codes.groupBy("band", "code").agg(F.count("*").alias("n")).filter("n > 1")
    met = materialize(salted_join(codes, shared, ["band", "code"], spread=["doc_id"]).join(units, "doc_id"))

    def buckets(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("code", kind="stable")
        unit, code, names = unit_rows(rows["embedding"]), rows["code"].to_numpy(), rows["doc_id"].to_numpy()
        edges = np.r_[0, np.flatnonzero(np.diff(code)) + 1, len(code)]
        parts = []
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            cosines = np.rint(unit[start:end] @ unit[start:end].T * SCALE) / SCALE
            i, j = np.nonzero(np.triu(cosines >= threshold, 1))
            parts.append((names[start + i], names[start + j], cosines[i, j]))
        source, target, similarity = (np.concatenate(c) for c in zip(*parts, strict=True))
        return pd.DataFrame({"source": source, "target": target, "similarity": similarity})

    shares = max(1, math.ceil(n / block_rows))
    small = met.filter(F.col("n") <= block_rows).withColumn("share", F.pmod(F.xxhash64("code"), F.lit(shares)))
    found = small.groupBy("band", "share").applyInPandas(buckets, PAIRS).union(
        _tiles(met.filter(F.col("n") > block_rows), ["band", "code"], threshold, block_rows))
    return found.select(
        F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), "similarity").distinct()


def semantic_pairs(
    vectors: DataFrame, threshold: float, pivots: int | None = None, block_rows: int = BLOCK_ROWS,
    copies: str = "pairs", recall: float | None = None,
) -> DataFrame:
    """All document pairs whose cosine reaches ``threshold`` (> 0).

    Equal vectors are compared once. Without ``recall`` the result is exact: vectors lie in cells
    around pivots (half the square root of the vectors, but no more than there are blocks) and meet
    the cells that can hold a partner. With ``recall`` (below 1) candidates are the pairs that agree in a band of signs;
    a pair at the threshold is found with that probability, closer ones more often, and every
    pair returned is verified.

    ``copies`` says how documents with equal vectors appear: "pairs" lists every pair,
    which is the whole result; "star" links each copy to its first document only and
    keeps the result linear in the number of copies, like the graph's large groups.
    """
    if copies not in ("pairs", "star"):
        raise ValueError(f"unknown treatment of copies: {copies}")
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    if recall is not None and not 0 < recall < 1:
        raise ValueError("recall must lie between 0 and 1")
    usable = vectors.filter(F.exists("embedding", lambda x: x != 0)).select("doc_id", "embedding")
    keyed = usable.withColumn("_hash", F.xxhash64("embedding"))
    distinct = keyed.groupBy("_hash", "embedding").agg(F.min("doc_id").alias("rep"))
    members = materialize(
        salted_join(keyed, distinct, ["_hash", "embedding"], spread=["doc_id"]).select("rep", "doc_id")
    )
    units = materialize(distinct.select(F.col("rep").alias("doc_id"), "embedding"))
    n = units.count()
    if n == 0:
        return members.select(
            F.col("doc_id").alias("source"), F.col("doc_id").alias("target"),
            F.lit(1.0).alias("similarity"),
        ).filter("false")
    found = (_cell_pairs(units, n, threshold, pivots, block_rows) if recall is None
             else _band_pairs(units, n, threshold, recall, block_rows))
    if copies == "star":
        links = members.filter("rep <> doc_id").select(
            F.col("rep").alias("source"), F.col("doc_id").alias("target"), F.lit(1.0).alias("similarity")
        )
        return found.select(
            F.least("source", "target").alias("source"),
            F.greatest("source", "target").alias("target"), "similarity",
        ).union(links)
    return _expand_copies(found, members)


def _expand_copies(found: DataFrame, members: DataFrame) -> DataFrame:
    """Replace representatives by all documents that share their vector."""
    ones = members.select(F.col("rep").alias("source"), F.col("doc_id").alias("one"))
    twos = members.select(F.col("rep").alias("target"), F.col("doc_id").alias("two"))
    half = salted_join(ones, found, ["source"], spread=["one"])
    crossed = salted_join(twos, half, ["target"], spread=["two"]).select("one", "two", "similarity")
    crowded = members.filter("rep <> doc_id").select("rep").distinct()
    copies = salted_join(members, crowded, ["rep"], spread=["doc_id"]).select(
        "rep", F.col("doc_id").alias("one")
    )
    same = salted_join(
        copies, copies.select("rep", F.col("one").alias("two")), ["rep"], spread=["one"]
    ).filter("one < two").select("one", "two", F.lit(1.0).alias("similarity"))
    return crossed.union(same).select(
        F.least("one", "two").alias("source"), F.greatest("one", "two").alias("target"), "similarity"
    )
