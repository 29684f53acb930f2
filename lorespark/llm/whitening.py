"""Whitening of embeddings by the leading components of their covariance, found by contour integration.

Entries become whole numbers. Over the fit list, each distinct vector once, tasks add up sums and,
after taking off the whole number next to every mean, products; both are exact, so the covariance
is rounded once and is the same however the rows are dealt. Its size is the square of the vectors'
width, not of their number; it is one file in the shared folder, which solving tasks read.

Eigenvalues are isolated by inertia: the number of positive pivots of V - s I, factored as L D L',
is the number of eigenvalues above s. Rounds of shifts, each counted by a task of its own, cut the
spectrum from the top into slices of few eigenvalues. Every slice is then a task: a block of vectors
is projected on the slice's eigenspace by quadrature of the resolvent along a circle (solves with
complex shifts of V), Rayleigh-Ritz in the projected space gives values and vectors, and this
repeats until residuals are at rounding and as many values lie in the slice as inertia counted. A
last Rayleigh-Ritz over all slices makes vectors of close values orthogonal to each other.

Defined results: vectors that are null, have null or non-finite entries, or are not of the commonest
width (of equally common ones the larger) are left out. Scaled entries of more than 2^40 count as
2^40. Eigenvalues within rounding of zero have no component, so constant data, a single distinct
vector and empty tables give no rows; there are at most as many components as entries. Repeated rows
are results as often as they occur and count once in the fit list; null ids stay null. Equal
eigenvalues have some orthogonal components. A deviation beyond a long is null. Components have the
sign that makes their largest entry positive. Other columns are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.llm.common import open_folder
from lorespark.llm.exact_topk import lists, matrix
from lorespark.operators.joins import materialize
from lorespark.session import shared_folder

SCALE, SHIFT = 64, 1_000_000
LIMIT = 2.0**40
#: Eigenvalues that one slice of the spectrum may hold; more only where they are as good as equal.
SLICE = 8
#: Shifts that cut one slice in a round, the most that its ends may differ as a ratio, the width,
#: against the largest value, of one that stays whole, and how clear of eigenvalues a cut must be.
CUTS, RATIO, NARROW, CLEAR = 15, 4.0, 1e-8, 1e-11
#: Points of the quadrature on the half circle, and rounds of projection before the block doubles.
POINTS, ROUNDS = 8, 10
EPS = float(np.finfo(np.float64).eps)
LIMB = 30
PARTS = "cell int, low long, middle long, high long"
WHITE = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
         "identity_error double, eigenvalue double")


def whole(vector: Column) -> Column:
    """floor(SCALE c) + SHIFT of every entry as long, null where the vector is left out."""
    entries = vector.cast("array<double>")
    usable = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    held = F.transform(entries, lambda c: (F.floor(F.least(F.greatest(c * SCALE, F.lit(-LIMIT)), F.lit(LIMIT))) + SHIFT).cast("long"))
    return F.when(usable, held)


# --- exact sums -----------------------------------------------------------------------------------

def exact_gram(x: np.ndarray) -> np.ndarray:
    """x' x in whole numbers, through doubles in steps that stay below 2^53."""
    most = int(np.abs(x).max()) if x.size else 0
    if most**2 >= 2**52:
        return x.astype(object).T @ x.astype(object)
    step = max(1, 2**52 // max(1, most**2))
    out = np.zeros((x.shape[1], x.shape[1]), object if most**2 * len(x) >= 2**62 else np.int64)
    for i in range(0, len(x), step):
        some = x[i:i + step].astype(np.float64)
        out = out + (some.T @ some).astype(np.int64)
    return out


def _limbs(values: np.ndarray) -> list[np.ndarray]:
    mask = (1 << LIMB) - 1
    return [(values & mask).astype(np.int64), ((values >> LIMB) & mask).astype(np.int64), (values >> 2 * LIMB).astype(np.int64)]


def _added(fit: DataFrame, cells: int, centre: np.ndarray | None) -> list[int]:
    """Exact sums over ``fit``: of the entries, or of products of entries less ``centre``; (i, j <= i) row by row."""
    width = cells if centre is None else len(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, object)
        for batch in batches:
            x = matrix(lists(pa.Table.from_batches([batch]), "x"), np.arange(batch.num_rows), width)
            total = total + (x.sum(axis=0) if centre is None else exact_gram(x - centre)[np.tril_indices(width)])
        parts = [pa.array(np.arange(cells, dtype=np.int32)), *(pa.array(v) for v in _limbs(total))]
        yield pa.RecordBatch.from_arrays(parts, names=["cell", "low", "middle", "high"])

    added = fit.select("x").mapInArrow(run, PARTS).groupBy("cell").agg(
        *[F.sum(c).alias(c) for c in ("low", "middle", "high")])
    out = [0] * cells
    for r in added.toLocalIterator():
        out[r["cell"]] = r["low"] + (r["middle"] << LIMB) + (r["high"] << 2 * LIMB)
    return out


@dataclass(frozen=True)
class Moments:
    """n, the sums S, and the covariance (divisor n) of the fit list."""

    n: int
    sums: list[int]
    covariance: np.ndarray

    @property
    def centre(self) -> np.ndarray:
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)


def moments(fit: DataFrame, width: int) -> Moments:
    n = fit.count()
    sums = _added(fit, width, None)
    centre = Moments(n, sums, np.empty(0)).centre
    lower = _added(fit, width * (width + 1) // 2, centre)
    rest = np.array([s - n * int(c) for s, c in zip(sums, centre, strict=True)], object)
    products = np.zeros((width, width), object)
    products[np.tril_indices(width)] = lower
    # What is left of the means is taken off exactly; one division rounds.
    squared = n * products - np.tril(np.outer(rest, rest))
    half = (squared / (n * n)).astype(np.float64)
    return Moments(n, sums, half + np.tril(half, -1).T)


# --- eigenpairs -----------------------------------------------------------------------------------

def positive(a: np.ndarray) -> int:
    """Number of positive eigenvalues of a symmetric matrix, from the pivots of L D L'."""
    a, k, found = a.copy(), 0, 0
    share = (1 + 17**0.5) / 8

    def swap(i: int, j: int) -> None:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]

    while k < len(a):
        below = np.abs(a[k + 1:, k])
        most, own = (float(below.max()) if below.size else 0.0), abs(a[k, k])
        pair = False
        if max(most, own) == 0:
            k += 1
            continue
        if own < share * most:
            r = k + 1 + int(below.argmax())
            row = np.abs(a[r, k:])
            row[r - k] = 0
            if own * row.max() < share * most * most:
                if abs(a[r, r]) >= share * row.max():
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    pair = True
        size = 2 if pair else 1
        pivot, rest = a[k:k + size, k:k + size].copy(), a[k + size:, k:k + size].copy()
        # A pivot of two is taken only where it is indefinite.
        found += 1 if pair else int(pivot[0, 0] > 0)
        a[k + size:, k + size:] -= rest @ np.linalg.solve(pivot, rest.T)
        k += size
    return found


def slice_pairs(v: np.ndarray, low: float, high: float, count: int, top: float) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues of ``v`` in (low, high] and their vectors, by contour integration."""
    d = len(v)
    middle, radius = (low + high) / 2, max((high - low) / 2, 4 * d * EPS * top)
    angle = (2 * np.arange(1, POINTS + 1) - 1) * np.pi / (2 * POINTS)
    weight = radius * np.exp(1j * angle)
    shifted = (middle + weight)[:, None, None] * np.eye(d) - v
    goal, size, random = 2 * d * EPS * top, min(d, count + count // 2 + 2), np.random.default_rng(d)
    block = random.standard_normal((d, size))
    while True:
        last = np.inf
        for _ in range(ROUNDS):
            solved = np.linalg.solve(shifted, np.broadcast_to(block.astype(complex), (POINTS, *block.shape)))
            projected = (weight[:, None, None] * solved).sum(axis=0).real / POINTS
            base, weights, _ = np.linalg.svd(projected, full_matrices=False)
            base = base[:, weights > d * EPS * weights[0]]
            value, turn = np.linalg.eigh(base.T @ v @ base)
            block = base @ turn
            off = np.maximum(np.maximum(low - value, value - high), 0)
            best = np.sort(np.argsort(off, kind="stable")[:count])
            residual = np.linalg.norm(v @ block - block * value, axis=0)[best].max(initial=0)
            settled = residual <= goal or residual <= 64 * goal and residual > last / 2
            if settled and len(best) == count and off[best].max(initial=0) <= 8 * goal:
                return value[best], block[:, best]
            last = residual
        if size == d:
            break
        # Values crowd beyond the ends: a larger block takes them in, at last the whole space.
        size = min(d, 2 * size)
        block = np.hstack([block, random.standard_normal((d, size - block.shape[1]))])
    raise ArithmeticError(f"{count} eigenvalues were counted in ({low}, {high}], not all were found")


def _load(path: str) -> np.ndarray:
    store, at = open_folder(path)
    with store.open_input_file(at) as file:
        return np.load(io.BytesIO(file.read()))


def _save(spark: SparkSession, v: np.ndarray) -> str:
    folder = shared_folder(spark, "covariance")
    store, at = open_folder(folder)
    data = io.BytesIO()
    np.save(data, v)
    with store.open_output_stream(f"{at}/v.npy") as out:
        out.write(data.getvalue())
    return f"{folder}/v.npy"


def _counts(spark: SparkSession, path: str, shifts: list[float]) -> dict[float, int]:
    """Number of eigenvalues above every shift; a task for each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("shift").to_pylist()
            v = _load(path)
            found = [positive(v - s * np.eye(len(v))) for s in at]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.float64()), pa.array(found, pa.int32())], names=["shift", "above"])

    asked = spark.createDataFrame([(s,) for s in shifts], "shift double").repartition(len(shifts))
    return {r["shift"]: r["above"] for r in asked.mapInArrow(run, "shift double, above int").collect()}


def _cuts(low: float, high: float) -> list[float]:
    """Points within a slice: by equal ratios while it spans magnitudes, then by equal steps."""
    points = np.geomspace(low, high, CUTS + 2) if high > RATIO * low else np.linspace(low, high, CUTS + 2)
    return [float(p) for p in points[1:-1]]


def _clear(cut: float, top: float) -> tuple[float, float]:
    """Points beside a cut; it stands where no eigenvalue is between them, so no cluster is torn."""
    off = min(CLEAR * top, cut / 64)
    return cut - off, cut + off


def slices(spark: SparkSession, path: str, v: np.ndarray, k: int) -> tuple[list[tuple[float, float, int]], float]:
    """(low, high, eigenvalues) that together hold the ``k`` largest, or all that are not zero."""
    top = float(np.abs(v).sum(axis=1).max()) * (1 + 8 * EPS)
    if top == 0:
        return [], top
    floor = 8 * len(v) * EPS * top
    above = {top: 0, **_counts(spark, path, [floor])}
    edges, wanted = [floor, top], min(k, above[floor])
    while True:
        needed = [(a, b, above[a] - above[b]) for a, b in zip(edges[:-1], edges[1:], strict=True)
                  if above[a] > above[b] and above[b] < wanted]
        crowded = [(a, b) for a, b, n in needed if b > RATIO * a or n > SLICE and b - a > NARROW * top]
        cuts = [c for a, b in crowded for c in _cuts(a, b)]
        found = _counts(spark, path, [s for c in cuts for s in _clear(c, top)]) if cuts else {}
        clear = {c: found[s] for c in cuts for s, t in [_clear(c, top)] if found[s] == found[t]}
        if not clear:
            return needed, top
        above.update(clear)
        edges = sorted({*edges, *clear})


def eigenpairs(spark: SparkSession, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of ``v`` that are not zero, falling, and their unit vectors as columns."""
    path = _save(spark, v)
    parts, top = slices(spark, path, v, k)
    if not parts:
        return np.empty(0), np.empty((len(v), 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _load(path)
            for r in batch.to_pylist():
                _, vectors = slice_pairs(own, r["low"], r["high"], r["count"], top)
                yield pa.RecordBatch.from_arrays([pa.array(vectors.T.tolist(), pa.list_(pa.float64()))], names=["vector"])

    asked = spark.createDataFrame(parts, "low double, high double, count int").repartition(len(parts))
    found = sorted(r["vector"] for r in asked.mapInArrow(run, "vector array<double>").collect())
    base, _ = np.linalg.qr(np.array(found).T)
    value, turn = np.linalg.eigh(base.T @ v @ base)
    value, vectors = value[::-1][:k], (base @ turn)[:, ::-1][:, :k]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return value, vectors * sign


# --- whitening ------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Whitener:
    moments: Moments
    eigenvalues: np.ndarray
    components: np.ndarray
    identity_error: float = 0.0

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        centre, n = self.moments.centre, self.moments.n
        rest = np.array([s - n * int(c) for s, c in zip(self.moments.sums, centre, strict=True)], object)
        y = x - centre
        if y.size and int(np.abs(y).max()) * n + n < 2**62:
            return n * y - rest.astype(np.int64)
        return n * y.astype(object) - rest

    def whiten(self, numerators: np.ndarray) -> np.ndarray:
        centred = (numerators / self.moments.n).astype(np.float64)
        return centred @ (self.components / np.sqrt(self.eigenvalues))


def deviations(numerators: np.ndarray) -> pa.Array:
    """Sums of squares as long; null where one does not fit."""
    most = int(np.abs(numerators).max()) if numerators.size else 0
    if most**2 * max(1, numerators.shape[1]) < 2**63:
        return pa.array((numerators**2).sum(axis=1).astype(np.int64))
    sums = (numerators.astype(object) ** 2).sum(axis=1)
    return pa.array([int(s) if s < 2**63 else None for s in sums], pa.int64())


def _identity_error(fit: DataFrame, whitener: Whitener) -> float:
    """Largest entry of the covariance of the whitened fit list less the identity."""
    k, width = len(whitener.eigenvalues), len(whitener.components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            x = matrix(lists(pa.Table.from_batches([batch]), "x"), np.arange(batch.num_rows), width)
            white = whitener.whiten(whitener.numerators(x))
            total += np.vstack([white.T @ white, white.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["cell", "value"])

    added = fit.select("x").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    total = np.zeros((k + 1) * k)
    for r in added.collect():
        total[r["cell"]] = r["value"]
    total = total.reshape(k + 1, k) / whitener.moments.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def usable_rows(vectors: DataFrame, id_column: str, vector_column: str) -> tuple[DataFrame, int]:
    """vec_id and x of the rows that remain, written once, and the width of x."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), whole(F.col(vector_column)).alias("x"))
    rows = materialize(rows.filter("x IS NOT NULL"))
    common = rows.groupBy(F.size("x").alias("d")).count().agg(F.max(F.struct("count", "d")).alias("m")).first()["m"]
    width = common["d"] if common else 0
    return rows.filter(F.size("x") == width), width


def fit_whitener(rows: DataFrame, width: int, k: int = 16) -> Whitener | None:
    """Components of the distinct vectors of ``rows`` (x); None where there are none."""
    if width == 0:
        return None
    fit = materialize(rows.select("x").distinct())
    found = moments(fit, width)
    value, vectors = eigenpairs(rows.sparkSession, found.covariance, k)
    if len(value) == 0:
        return None
    whitener = Whitener(found, value, vectors)
    return Whitener(found, value, vectors, _identity_error(fit, whitener))


def whiten(vectors: DataFrame, k: int = 16, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """A row per remaining vector and component: WHITE."""
    rows, width = usable_rows(vectors, id_column, vector_column)
    whitener = fit_whitener(rows, width, k)
    if whitener is None:
        return vectors.sparkSession.createDataFrame([], WHITE)
    value, trace = whitener.eigenvalues, float(np.trace(whitener.moments.covariance))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(value)
        for batch in batches:
            n = batch.num_rows
            x = matrix(lists(pa.Table.from_batches([batch]), "x"), np.arange(n), width)
            above = whitener.numerators(x)
            which = pa.array(np.repeat(np.arange(n), m))
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(which), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), n)),
                pa.array(np.full(n * m, whitener.moments.n, np.int64)), deviations(above).take(which),
                pa.array(whitener.whiten(above).ravel()), pa.array(np.tile(value / trace, n)),
                pa.array(np.full(n * m, whitener.identity_error)), pa.array(np.tile(value, n))],
                names=[c.split()[0] for c in WHITE.split(", ")])

    return rows.mapInArrow(run, WHITE)
