"""Exact top-k by integer inner product, by distributed selection over score histograms.

Every query keeps one interval of scores that holds its kth value: first all scores that its vector
can have. A pass scores all candidates against all queries, counts each query's scores in BINS
equal parts of its interval, adds the counts of all tasks, and takes the part with the kth value as
the next interval. Passes end when an interval is one score wide or has at most SLACK rows in it
and above. A last pass keeps what reaches the interval's lower end; ties at the kth value go to
smaller ids, of which no task returns more than k for a query.

Of its histogram a task returns only the parts down to its own kth value: lower ones cannot hold the
global one. So a pass moves at most k counts a query and task, never the scores. Queries are small
files in the shared folder, read by the tasks one at a time; neither they nor the candidates pass
the driver. A task holds HOLD rows and one file of queries. Lost tasks repeat and count the same.

Scores are exact: products run in doubles where no sum can pass 2^53, else in whole numbers.

Defined results: a vector that is null or has a null or non-finite entry takes no part. Entries of
more than 2^52 after scaling count as 2^52, scores of more than 2^61 as 2^61. A vector is compared
with vectors of its own length only. A query's own rows are all with its id; of a query given more
than once, each different vector is answered on its own, equal ones once. Repeated candidates are as
many results; a null id is a candidate after all others of its score and never a query. Fewer than
k candidates: all of them. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespark.llm.common import open_folder
from lorespark.operators.joins import materialize
from lorespark.session import shared_folder

BINS = 1024
#: Bytes of one file of queries, and candidates that a task scores at a time (in bytes as doubles).
BLOCK_BYTES, HOLD_BYTES = 64 << 10, 16 << 20
#: Scores that a task has at a time.
CELLS = 2 << 20
#: An interval ends when it and all above have so many rows for each of the k.
SLACK = 4
LIMIT, REACH = 2.0**52, 2**61
COUNTED = "number long, bin int, rows long"
FOUND = "number long, vec_id long, score long"


def whole(vector: Column, scale: int) -> Column:
    """floor(scale x) of every entry as long, null where the vector takes no part."""
    entries = vector.cast("array<double>")
    usable = F.forall(entries, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    bound = F.lit(LIMIT)
    rounded = F.transform(entries, lambda x: F.floor(F.least(F.greatest(x * scale, -bound), bound)).cast("long"))
    return F.when(usable, rounded)


def lists(data: pa.Table, name: str) -> pa.ListArray:
    """A column of lists in one piece."""
    column = data.column(name)
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def matrix(column: pa.ListArray, rows: np.ndarray, width: int) -> np.ndarray:
    """The lists at ``rows``, all of ``width`` entries, as a matrix of long."""
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64, copy=False).reshape(len(rows), width)


def largest(x: np.ndarray) -> float:
    return float(np.abs(x).max()) if x.size else 0.0


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products (query, row) as long."""
    bound = largest(queries) * largest(rows) * max(1, rows.shape[1])
    if bound < 2**53:
        return (queries.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    if bound < REACH:
        return queries @ rows.T
    exact = queries.astype(object) @ rows.T.astype(object)
    return np.clip(exact, -REACH, REACH).astype(np.int64).reshape(len(queries), len(rows))


class Held:
    """Candidates that a task has at hand: ids, whether they have one, and matrices by width."""

    def __init__(self, batches: list[pa.RecordBatch]):
        data = pa.Table.from_batches(batches)
        ids = data.column("vec_id").fill_null(0).to_numpy()
        named = data.column("vec_id").is_valid().to_numpy()
        vectors = lists(data, "vector")
        widths = vectors.value_lengths().to_numpy(zero_copy_only=False)
        self.parts = {}
        for width in np.unique(widths):
            at = np.flatnonzero(widths == width)
            # In the order that settles ties, so the first of equal scores is the one to keep.
            at = at[np.lexsort((ids[at], ~named[at]))]
            self.parts[int(width)] = (ids[at], named[at], matrix(vectors, at, int(width)))


def held(batches: Iterator[pa.RecordBatch]) -> Iterator[Held]:
    kept, size = [], 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        step = max(1, int(HOLD_BYTES * batch.num_rows // max(1, batch.nbytes)))
        for i in range(0, batch.num_rows, step):
            kept.append(batch.slice(i, step))
            size += batch.nbytes * kept[-1].num_rows // batch.num_rows
            if size >= HOLD_BYTES:
                yield Held(kept)
                kept, size = [], 0
    if kept:
        yield Held(kept)


class Block:
    """Queries of one width from one file: numbers, ids, vectors, and the interval of each."""

    def __init__(self, data: pa.Table, rows: np.ndarray, width: int):
        def column(name: str) -> np.ndarray:
            return data.column(name).to_numpy()[rows]

        self.number, self.id = column("number"), column("query_id")
        self.low, self.high, self.step = column("low"), column("high"), column("step")
        self.width = width
        self.vector = matrix(lists(data, "vector"), rows, width)


def blocks(folder: str, only_open: bool) -> Iterator[Block]:
    """Blocks of the queries in a folder, file by file; all, or those whose interval is open."""
    store, root = open_folder(folder)
    for info in sorted(store.get_file_info(arrow_fs.FileSelector(root)), key=lambda x: x.path):
        if not info.path.endswith(".parquet"):
            continue
        with store.open_input_file(info.path) as file:
            data = pq.read_table(file)
        if only_open:
            data = data.filter(data.column("open"))
        widths = lists(data, "vector").value_lengths().to_numpy(zero_copy_only=False)
        for width in np.unique(widths):
            yield Block(data, np.flatnonzero(widths == width), int(width))


def scored(
    hold: Held, folder: str, only_open: bool = False,
) -> Iterator[tuple[Block, slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(block, its queries, ids, named, scores, whether a score counts) in pieces of CELLS scores."""
    for block in blocks(folder, only_open):
        if block.width not in hold.parts:
            continue
        ids, named, rows = hold.parts[block.width]
        step = max(1, CELLS // len(ids))
        for i in range(0, len(block.number), step):
            some = slice(i, i + step)
            counts = (ids[None, :] != block.id[some, None]) | ~named[None, :]
            yield block, some, ids, named, products(block.vector[some], rows), counts


def _batch(columns: list[np.ndarray | pa.Array], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def _histograms(folder: str, k: int, bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hold in held(batches):
            for block, some, _, _, scores, counts in scored(hold, folder, only_open=True):
                low, high, step = (x[some, None] for x in (block.low, block.high, block.step))
                # How many rows are above the interval is known; below it none can matter.
                part = (scores - low) // step
                inside = counts & (scores >= low) & (scores < high)
                q, _ = np.nonzero(inside)
                own = np.bincount(q * bins + part[inside], minlength=len(low) * bins).reshape(-1, bins)
                before = own[:, ::-1].cumsum(axis=1)[:, ::-1] - own
                q, b = np.nonzero((own > 0) & (before < k))
                yield _batch([block.number[some][q], b.astype(np.int32), own[q, b]], ["number", "bin", "rows"])

    return run


def _winners(folder: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hold in held(batches):
            for block, some, ids, named, scores, counts in scored(hold, folder):
                numbers, kept_q, kept_c = block.number[some], [], []
                for q, c in enumerate((scores >= block.low[some, None]) & counts):
                    at = np.flatnonzero(c)
                    if len(at) > k:
                        # A stable sort keeps the order of ids among equal scores.
                        at = at[np.argsort(-scores[q, at], kind="stable")[:k]]
                    kept_q.append(np.full(len(at), q))
                    kept_c.append(at)
                q, c = np.concatenate(kept_q), np.concatenate(kept_c)
                yield _batch([numbers[q], pa.array(ids[c], pa.int64(), mask=~named[c]), scores[q, c]],
                             ["number", "vec_id", "score"])

    return run


def _write_queries(queries: DataFrame, rows: int, files: int) -> str:
    """Files of at most ``rows`` queries in a new folder."""
    folder = f"{shared_folder(queries.sparkSession, 'queries')}/rows"
    queries.repartition(files).write.option("maxRecordsPerFile", rows).parquet(folder)
    return folder


def _next_interval(counted: DataFrame, state: DataFrame, k: int) -> DataFrame:
    """Interval of every query: the part that holds its kth value."""
    total = counted.groupBy("number", "bin").agg(F.sum("rows").alias("rows"))
    down = Window.partitionBy("number").orderBy(F.col("bin").desc())
    ranked = total.withColumn("upto", F.sum("rows").over(down)).join(
        state.select("number", "above"), "number").withColumn("upto", F.col("upto") + F.col("above"))
    # The first part that reaches k from above; with fewer than k rows in all, the last one.
    reached = F.struct((F.col("upto") >= k).alias("reaches"), F.when(F.col("upto") >= k, F.col("bin"))
                       .otherwise(-F.col("bin")).alias("place"), "bin", "rows", "upto")
    found = ranked.groupBy("number").agg(F.max(reached).alias("f")).select(
        "number", F.col("f.bin").alias("bin"), F.col("f.rows").alias("rows"), F.col("f.upto").alias("upto"))
    moved = state.join(found, "number", "left")
    hit = F.col("open") & F.col("bin").isNotNull()
    low = F.col("low") + F.col("bin") * F.col("step")
    ends = (F.col("step") == 1) | (F.col("upto") <= SLACK * k)
    return moved.select(
        "number", "query_id", "vector", F.when(hit, low).otherwise(F.col("low")).alias("low"),
        F.when(hit, F.least("high", low + F.col("step"))).otherwise(F.col("high")).alias("high"),
        F.when(hit, F.expr(f"(step + {BINS - 1}) div {BINS}")).otherwise(F.col("step")).alias("step"),
        F.when(hit, F.col("upto") - F.col("rows")).otherwise(F.col("above")).alias("above"),
        (hit & ~ends).alias("open"))


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024,
    id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best rows of ``vectors`` for every row of ``queries``.

    Both tables have the id and the vector column. Every row of ``vectors`` but the query's own
    is a candidate; order is by score falling, then id.
    """
    spark = vectors.sparkSession

    def own(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_column).cast("long").alias("vec_id"),
                         whole(F.col(vector_column), scale).alias("vector")).filter("vector IS NOT NULL")

    candidates = materialize(own(vectors))
    reach = candidates.agg(
        F.max(F.greatest(F.coalesce(F.array_max("vector"), F.lit(0)), -F.coalesce(F.array_min("vector"), F.lit(0)))).alias("m"),
        F.max(F.size("vector")).alias("d")).first()
    most, wide = reach["m"] or 0, max(1, reach["d"] or 1)
    # Half the range of a query's scores, held within a long.
    sums = F.aggregate("vector", F.lit(0.0), lambda a, x: a + F.abs(x))
    half = F.least(sums * (float(most) * (1 + 1e-9)), F.lit(float(REACH))).cast("long") + 1
    asked = own(queries).filter("vec_id IS NOT NULL").distinct()
    state = materialize(asked.select(
        F.monotonically_increasing_id().alias("number"), F.col("vec_id").alias("query_id"), "vector",
        (-half).alias("low"), (half + 1).alias("high"), F.lit(0).cast("long").alias("step"),
        F.lit(0).cast("long").alias("above"), F.lit(True).alias("open")).withColumn(
        "step", F.expr(f"(high - low) div {BINS} + 1")))
    rows = max(1, BLOCK_BYTES // (8 * wide))
    files = -(-max(1, state.count()) // rows)
    folder = _write_queries(state, rows, files)
    while state.filter("open").limit(1).count():
        counted = candidates.mapInArrow(_histograms(folder, k, BINS), COUNTED)
        folder = _write_queries(_next_interval(counted, state, k), rows, files)
        state = spark.read.schema(state.schema).parquet(folder)
    found = candidates.mapInArrow(_winners(folder, k), FOUND)
    place = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    return ranked.join(state.select("number", "query_id"), "number").select("query_id", "rank", "vec_id", "score")
