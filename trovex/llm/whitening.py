"""Embedding whitening by contour integration (operator 12).

Entries are rounded to whole numbers, x = floor(64 c) + 1000000, so counts, sums and products are added up exactly, whatever
the order of the tasks: each task subtracts the whole number next to the mean before it multiplies, and the fraction that is
left follows from the exact sums. What leaves the tasks grows with the squared dimension, not with the rows.

The components are the eigenvectors of the covariance V with the largest eigenvalues. Inertia counts (signs of the pivots of
the factorized V - s I, once V is tridiagonal) tell how many eigenvalues lie above s, and cut the upper spectrum into intervals
of few eigenvalues each, with their ends in gaps. Each interval is a task of its own: a block of vectors is filtered by the quadrature of (z I - V)^-1 along
a circle through the interval's ends, Rayleigh-Ritz extracts the pairs, and both are repeated until residuals vanish. As many
must be found as the counts say, otherwise the fit fails. One last Rayleigh-Ritz over all of them makes them orthogonal.

Edge cases: rows whose vector is null or has null or non-finite entries go; vectors of different widths are an error, and so
are entries beyond LARGEST and vectors wider than WIDEST; directions without variance (fewer distinct vectors than dimensions)
are no components; equal eigenvalues come in any order; repeated rows count and are returned as often as they occur; null ids
are returned; an empty table, and one without variance, gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
WIDEST = 1024  #: dimensions: a covariance of 8 MB at most is sent to tasks
LARGEST = 1 << 27  #: of a rounded entry without the shift, so that products of a run of rows stay exact
RUN = 64  #: rows whose products are added up in 64 bits
NODES = 8  #: quadrature points on the upper half of a contour
CROWD = 8  #: eigenvalues that an interval holds at most, unless they are too close to be parted
ROUNDS = 40


@dataclass
class Model:
    """n vectors with sums (of x), components as columns of basis, their eigenvalues and V's trace."""

    n: int
    sums: list[int]
    basis: np.ndarray
    values: np.ndarray
    trace: float


def usable(vectors: DataFrame, column: str = "embedding") -> Column:
    """Whether a row has a vector of finite entries."""
    v = F.col(column)
    return v.isNotNull() & ~F.exists(v, lambda c: F.coalesce(F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")), F.lit(True)))


def rounded(column: pa.Array, width: int) -> np.ndarray:
    """floor(64 c) of each entry."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != width * len(column) or (np.diff(column.offsets.to_numpy()) != width).any():
        raise ValueError("vectors have different widths")
    y = np.floor(SCALE * flat)
    if len(y) and np.abs(y).max() > LARGEST:
        raise ValueError(f"an entry is beyond {LARGEST // SCALE}")
    return y.astype(np.int64).reshape(len(column), width)


def _summed(vectors: DataFrame, each, size: int) -> list[int]:
    """Exact sums of `size` whole numbers that each(batch) gives (as int64 arrays, several a batch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, object)
        some = False
        for b in batches:
            for part in each(b):
                total = total + part.astype(object)
                some = True
        if some:
            values = [Decimal(int(v)) for v in total]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(values, pa.decimal128(38, 0))], ["i", "v"])

    rows = vectors.mapInArrow(run, "i long, v decimal(38,0)").groupBy("i").agg(F.sum("v").alias("v")).collect()  # one row for each number
    out = [0] * size
    for r in rows:
        out[r.i] = int(r.v)
    return out


def moments(vectors: DataFrame, width: int) -> tuple[int, list[int], np.ndarray]:
    """n, the sums of x, and the covariance of x, exact but for the last rounding. vectors: (embedding), all usable."""

    def counts(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        y = rounded(b.column(0), width)
        yield np.concatenate(([len(y)], y.sum(axis=0)))

    n, *sums = _summed(vectors, counts, width + 1)
    if not n:
        return 0, sums, np.zeros((width, width))
    middle = np.array([round(Fraction(s, n)) for s in sums], np.int64)
    upper = np.triu_indices(width)

    def products(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        z = rounded(b.column(0), width) - middle
        small = len(z) > 0 and int(np.abs(z).max()) ** 2 * len(z) < 1 << 53
        for lo in range(0, len(z), len(z) if small else RUN):
            part = z[lo:] if small else z[lo : lo + RUN]
            # whole numbers below 2**53 are exact as doubles, whose product is much faster
            yield ((part.astype(np.float64).T @ part.astype(np.float64)).astype(np.int64) if small else part.T @ part)[upper]

    gram = _summed(vectors, products, len(upper[0]))
    left = [s - n * int(m) for s, m in zip(sums, middle)]
    v = np.zeros((width, width))
    for i, j, g in zip(*upper, gram):
        v[i, j] = v[j, i] = (n * g - left[i] * left[j]) / (n * n)  # of whole numbers: rounded once
    return n, [s + n * SHIFT for s in sums], v


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and side diagonal of a tridiagonal matrix with v's eigenvalues, by reflections."""
    a = v.copy()
    side = np.zeros(max(len(a) - 1, 0))
    for k in range(len(a) - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        side[k] = -size if x[0] > 0 else size
        x[0] -= side[k]
        if (norm := np.linalg.norm(x)) == 0:
            continue
        x /= norm
        rest = a[k + 1 :, k + 1 :]
        w = rest @ x
        w -= (w @ x) * x
        rest -= 2 * (np.outer(x, w) + np.outer(w, x))
    if len(a) > 1:
        side[-1] = a[-1, -2]
    return np.diagonal(a).copy(), side


def above(tri: tuple[np.ndarray, np.ndarray], shifts: np.ndarray | float) -> np.ndarray:
    """How many eigenvalues are larger than each shift: the positive pivots of the factorized, shifted matrix, whose inertia is v's."""
    diagonal, side = tri
    shifts = np.atleast_1d(np.asarray(shifts, float))
    tiny = np.finfo(float).tiny ** 0.5
    pivot = diagonal[0] - shifts
    count = (pivot > 0).astype(np.int64)
    for d, e in zip(diagonal[1:], side):
        pivot = d - shifts - e * e / np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot > 0
    return count


def intervals(tri: tuple[np.ndarray, np.ndarray], k: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues in it) that cover at least the k largest eigenvalues, or all that aren't zero; ends lie in the middle of gaps."""
    diagonal, side = tri
    around = np.abs(np.concatenate((side, [0]))) + np.abs(np.concatenate(([0], side)))
    top = float((np.abs(diagonal) + around).max())
    least = max(len(diagonal) * np.finfo(float).eps * top, np.finfo(float).tiny)
    nonzero = int(above(tri, least)[0]) if top > least else 0
    if not nonzero:
        return []
    # a rough place of each eigenvalue that isn't zero, from the counts
    nth = np.arange(1, nonzero + 1)
    low, high = np.zeros(nonzero), np.full(nonzero, top * (1 + 1e-9))
    for _ in range(50):
        middle = (low + high) / 2
        up = above(tri, middle) >= nth
        low, high = np.where(up, middle, low), np.where(up, high, middle)
    places = np.append((low + high) / 2, 0.0)
    gaps, close = places[:-1] - places[1:], 1e-6 * top
    k = min(k, nonzero)
    last = k + int(gaps[k - 1 : k + CROWD].argmax())
    if gaps[last - 1] < close:
        last = k + int(gaps[k - 1 :].argmax())
    cuts, todo = {0, last}, [(0, last)]
    while todo:
        a, b = todo.pop()
        if b - a <= CROWD:
            continue
        quarter = (b - a) // 4
        c = a + quarter + int(gaps[a + quarter - 1 : b - quarter].argmax())
        if gaps[c - 1] >= close:
            cuts.add(c)
            todo += [(a, c), (c, b)]
    order = sorted(cuts)
    ends = [float(places[0] + max((places[0] - places[last - 1]) / 4, close, gaps[last - 1] / 4)), *[float(places[c - 1] - gaps[c - 1] / 2) for c in order[1:]]]
    return [(ends[i + 1], ends[i], order[i + 1] - order[i]) for i in range(len(order) - 1)]


def contour(v: np.ndarray, low: float, high: float, count: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The count eigenvalues of v in (low, high] and their vectors."""
    width = len(v)
    size = min(width, max(count + 4, 2 * count))
    y = np.random.default_rng(seed).standard_normal((width, size))
    centre, radius = (low + high) / 2, (high - low) / 2
    x, w = np.polynomial.legendre.leggauss(NODES)
    norm = float(np.abs(v).sum(axis=1).max())
    best = np.inf
    for _ in range(ROUNDS):
        filtered = np.zeros_like(y)
        for node, weight in zip(x, w):
            ray = np.exp(1j * np.pi / 2 * (1 - node))
            solved = np.linalg.solve((centre + radius * ray) * np.eye(width) - v, y.astype(complex))
            filtered += weight / 2 * (radius * ray * solved).real
        q, _ = np.linalg.qr(filtered)
        values, small = np.linalg.eigh(q.T @ v @ q)
        y = q @ small
        inside = np.flatnonzero((values > low) & (values <= high))
        if len(inside) == count:
            worst = float(np.abs(v @ y[:, inside] - y[:, inside] * values[inside]).max())
            if worst <= 1e-14 * norm or worst <= 1e-12 * norm and worst >= best / 2:
                return values[inside], y[:, inside]
            best = min(best, worst)
    raise RuntimeError(f"{count} eigenvalues lie between {low} and {high}, but they did not converge in {ROUNDS} rounds")


def eigenpairs(spark, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues that aren't zero, falling, and their vectors as columns; an interval is a task."""
    tri = tridiagonal(v)
    parts = intervals(tri, k)
    if not parts:
        return np.zeros(0), np.zeros((len(v), 0))
    sent = spark.sparkContext.broadcast(v)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples():
                values, vectors = contour(sent.value, r.low, r.high, r.n)
                yield pd.DataFrame({"value": values, "vector": list(vectors.T)})

    frame = spark.createDataFrame([(i, float(lo), float(hi), n) for i, (lo, hi, n) in enumerate(parts)], "i int, low double, high double, n int").repartition(len(parts), "i")
    rows = frame.mapInPandas(solve, "value double, vector array<double>").collect()  # one for each component asked for, and those too close to be parted
    expected = int(above(tri, parts[-1][0])[0])
    if len(rows) != expected:
        raise RuntimeError(f"{len(rows)} eigenvalues found, {expected} counted")
    q, _ = np.linalg.qr(np.array([r.vector for r in sorted(rows, key=lambda r: r.value)]).T)
    values, small = np.linalg.eigh(q.T @ v @ q)
    keep = np.argsort(-values, kind="stable")[:k]
    return values[keep], (q @ small)[:, keep]


def fit(vectors: DataFrame, components: int = 32, column: str = "embedding") -> Model | None:
    """The model over all usable vectors; None if there are none."""
    rows = vectors.where(usable(vectors, column)).select(F.col(column).alias("embedding"))
    width, least = rows.agg(F.max(F.size("embedding")), F.min(F.size("embedding"))).first()
    if not width:
        return None
    if width != least:
        raise ValueError("vectors have different widths")
    if width > WIDEST:
        raise ValueError(f"vectors are wider than {WIDEST}")
    n, sums, v = moments(rows, width)
    values, basis = eigenpairs(vectors.sparkSession, v, components)
    return Model(n, sums, basis, values, float(np.trace(v)))


def _centred(column: pa.Array, model: Model) -> np.ndarray:
    """n x - S, exact."""
    sums = np.array([s - model.n * SHIFT for s in model.sums], object)
    y = rounded(column, len(sums))
    bound = model.n * (int(np.abs(y).max()) if y.size else 0) + max(map(abs, sums))
    if len(sums) * bound**2 < 1 << 63:
        return model.n * y - sums.astype(np.int64)
    out = model.n * y.astype(object) - sums
    if out.size and max((out * out).sum(axis=1)) >= 1 << 63:
        raise OverflowError("the deviation is beyond 64 bits")
    return out.astype(np.int64)


def whiten(vectors: DataFrame, model: Model, column: str = "embedding") -> DataFrame:
    """The usable rows of vectors (with all their columns) and deviation long, whitened array<double>."""
    name, at = vectors.columns, vectors.columns.index(column)
    weight = model.basis / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _centred(b.column(at), model)
            flat = ((x / model.n) @ weight).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * weight.shape[1], pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((x * x).sum(axis=1)), lists], [*name, "deviation", "whitened"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.where(usable(vectors, column)).mapInArrow(run, f"{kinds}, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, n: int, k: int) -> float:
    """The largest absolute entry of the whitened vectors' covariance, taken from their own mean, less the identity."""

    def added(each, size: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = sum((each(b.column(0).flatten().to_numpy().reshape(-1, k)) for b in batches if b.num_rows), np.zeros(size))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["i", "v"])

        rows = whitened.select("whitened").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()  # one row for each number
        return np.array([r.v for r in rows]) / n

    mean = added(lambda w: w.sum(axis=0), k)
    cov = added(lambda w: ((w - mean).T @ (w - mean)).reshape(-1), k * k)
    return float(np.abs(cov.reshape(k, k) - np.eye(k)).max())


def op12_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    model = fit(vectors)
    if model is None or not len(model.values):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    out = whiten(vectors, model).select("vec_id", "deviation", "whitened")
    error = identity_error(out, model.n, len(model.values))
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    flat = out.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return flat.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, "at").alias("explained"), F.lit(error).alias("identity_error"))
