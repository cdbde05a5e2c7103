"""Whitened embeddings: leading eigenpairs of an exact covariance by spectrum slicing."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import map_arrow

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
# Doubles beyond 2^53 have no unit digits; scaled entries are held within it.
LARGEST = float(1 << 53)
# Sums of products below this are exact in doubles.
EXACT = float(1 << 53)
# Relative size of what counts as one eigenvalue, and as rounding.
ROUNDING = 4 * np.finfo(float).eps


# --- spectrum slicing ------------------------------------------------------------------------------------------------


def inertia(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of a symmetric ``matrix`` above ``shift``, from the signs of D in LDL^T of matrix - shift I.

    Pivots are chosen over the whole remaining diagonal, and a block of two where a single pivot would be unstable;
    such a block has one eigenvalue of either sign.
    """
    a = matrix - shift * np.eye(len(matrix))
    above, n = 0, len(a)
    alpha = (1 + np.sqrt(17)) / 8
    while n:
        diagonal = np.abs(np.diagonal(a))
        r = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diagonal(a)))
        p, q = divmod(int(off.argmax()), n)
        if diagonal[r] == 0.0 and off[p, q] == 0.0:
            break  # zero rows: eigenvalues equal to the shift
        if diagonal[r] >= alpha * off[p, q]:
            keep = np.delete(np.arange(n), r)
            column = a[keep, r]
            above += int(a[r, r] > 0)
            a = a[np.ix_(keep, keep)] - np.outer(column, column / a[r, r])
        else:
            keep = np.delete(np.arange(n), [p, q])
            block, columns = a[np.ix_([p, q], [p, q])], a[np.ix_(keep, [p, q])]
            above += 1  # a pivot of indefinite kind
            a = a[np.ix_(keep, keep)] - columns @ np.linalg.solve(block, columns.T)
        a, n = (a + a.T) / 2, len(a)
    return above


def _solve(matrix: np.ndarray, shift: float, x: np.ndarray, scale: float) -> np.ndarray:
    """A unit vector along (matrix - shift I)^-1 x; a shift that hits an eigenvalue is moved by a rounding."""
    for k in range(60):
        moved = matrix - (shift + k * ROUNDING * scale) * np.eye(len(x))
        try:
            y = np.linalg.solve(moved, x)
        except np.linalg.LinAlgError:
            continue
        size = np.linalg.norm(y)
        if np.isfinite(size) and size > 0:
            return y / size
    raise ArithmeticError("no shift near the eigenvalue gives a solution")


def _free(x: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    """``x`` without its parts along ``found``, as a unit vector."""
    for _ in range(2):
        for v in found:
            x = x - (v @ x) * v
    return x / np.linalg.norm(x)


def _isolate(matrix: np.ndarray, count: int, low: float, high: float, scale: float) -> list[tuple[float, float, int, int]]:
    """Intervals (a, b] from the top down with the numbers of their first and last eigenvalue, ``count`` of them in all.

    An interval is halved until it holds one eigenvalue, or is as narrow as rounding: then its eigenvalues are one multiple.
    """
    done, open_ = [], [(low, high, inertia(matrix, low), inertia(matrix, high))]
    while open_:
        a, b, n_a, n_b = open_.pop()
        if n_a == n_b or n_b >= count:
            continue
        if n_a == n_b + 1 or b - a <= 64 * ROUNDING * scale:
            done.append((a, b, n_b + 1, n_a))
            continue
        middle = (a + b) / 2
        n_m = inertia(matrix, middle)
        open_ += [(a, middle, n_a, n_m), (middle, b, n_m, n_b)]
    return sorted(done, key=lambda t: t[2])


def leading_eigenpairs(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` greatest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns.

    Inertia counts isolate each eigenvalue; Rayleigh quotient iteration converges inside its interval, which is halved once more
    where the quotient leaves it. Counts on both sides of each value certify its number. Multiple eigenvalues get an
    orthonormal base by inverse iteration.
    """
    d = len(matrix)
    scale = float(np.abs(matrix).sum(axis=1).max()) if d else 0.0
    if scale == 0.0 or count == 0:
        return np.zeros(0), np.zeros((d, 0))
    radius = np.abs(matrix).sum(axis=1) - np.abs(np.diagonal(matrix))
    low, high = float((np.diagonal(matrix) - radius).min()) - scale * 1e-3, float((np.diagonal(matrix) + radius).max()) + scale * 1e-3
    rng = np.random.default_rng(11)
    values, vectors = [], []
    for a, b, first, last in _isolate(matrix, min(count, d), low, high, scale):
        for number in range(first, min(last, count) + 1):
            x = _free(rng.standard_normal(d), vectors)
            lo, hi, shift = a, b, (a + b) / 2
            for _ in range(200):
                x = _free(_solve(matrix, shift, x, scale), vectors)
                value = float(x @ matrix @ x)
                rest = float(np.linalg.norm(matrix @ x - value * x))
                if rest <= 16 * d * ROUNDING * scale and lo - rest <= value <= hi + rest:
                    break
                if first == last and not lo < value <= hi and hi - lo > 64 * ROUNDING * scale:
                    middle = (lo + hi) / 2  # the quotient follows another eigenvalue: halve by one more count
                    lo, hi = (middle, hi) if inertia(matrix, middle) >= number else (lo, middle)
                    shift = (lo + hi) / 2
                else:
                    shift = value if lo < value <= hi else (lo + hi) / 2
            else:
                raise ArithmeticError(f"eigenvalue {number} did not converge")
            for _ in range(2):  # the last rounding of the vector
                x = _free(_solve(matrix, value, x, scale), vectors)
                value = float(x @ matrix @ x)
            values.append(value)
            vectors.append(x)
    for k, value in enumerate(values, 1):
        margin = 64 * d * ROUNDING * scale
        if inertia(matrix, value - margin) < k or inertia(matrix, value + margin) >= k:
            raise ArithmeticError(f"counts do not certify eigenvalue {k}")
    return np.array(values), np.array(vectors).T


# --- sums over the fit list ------------------------------------------------------------------------------------------


def usable(vector: Column) -> Column:
    """True for vectors without null or non-finite entries."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def scaled(column: pa.Array, dimension: int) -> np.ndarray:
    """Rows of floor(64 c), as doubles with integer values, without the shift that all entries share."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(SCALE * flat), -LARGEST, LARGEST).reshape(-1, dimension)


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """left^T right of integer-valued doubles, exact: in doubles if no sum can pass 2^53, else in Python's integers."""
    bound = float(np.abs(left).max(initial=0.0)) * float(np.abs(right).max(initial=0.0)) * max(1, len(left))
    if bound < EXACT:
        return (left.T @ right).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m], dtype=object).reshape(m.shape)
    return whole(left).T @ whole(right)


def _summed(rows: DataFrame, part) -> dict[int, int]:
    """Exact sums over all rows of what ``part`` makes of a block: a task sends one row per cell, Spark adds the cells.

    The result has one value per cell, whatever the number of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = np.asarray(part(batch.column(0))).ravel().astype(object)
                total = found if total is None else total + found
        if total is not None:
            with localcontext() as wide:
                wide.prec = 60
                cells = pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), cells], ["cell", "v"])

    cells = map_arrow(rows.select("embedding"), run, "cell int, v decimal(38,0)")
    return {r.cell: int(r.v) for r in cells.groupBy("cell").agg(F.sum("v").alias("v")).collect()}


def _float(value: Fraction) -> float:
    return value.numerator / value.denominator


def fit(rows: DataFrame, dimension: int) -> tuple[int, list[int], list[int], np.ndarray]:
    """(n, centres, remainders, covariance) of usable rows of one dimension, from exact sums in two passes.

    A centre is the integer nearest to a mean, and its remainder what n times the mean has beyond it, so rows are centred before
    they are multiplied, and each entry of the covariance is one exact fraction rounded once.
    """
    sums = _summed(rows, lambda c: np.append(_products(np.ones((len(c), 1)), scaled(c, dimension)).ravel(), len(c)))
    n = sums[dimension]
    centres = [(2 * sums[i] + n) // (2 * n) for i in range(dimension)]
    rest = [sums[i] - n * centres[i] for i in range(dimension)]
    middle = np.array(centres, dtype=np.float64)

    def products(column: pa.Array) -> np.ndarray:
        centred = scaled(column, dimension) - middle
        return _products(centred, centred)

    cells = _summed(rows, products)
    covariance = np.array([
        [_float(Fraction(n * cells[i * dimension + j] - rest[i] * rest[j], n * n)) for j in range(dimension)] for i in range(dimension)
    ])
    return n, centres, rest, covariance


# --- the operator ----------------------------------------------------------------------------------------------------


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every usable row and leading component.

    ``embeddings``: vec_id (any type, nulls and repeats allowed), embedding (array of numbers). Rows whose vector is null or
    holds a null or non-finite entry are dropped. A vector of a length other than the most common one (the longest, if tied)
    has no place in the covariance and is dropped too. Entries are floor(64 c), held within 2^53, plus 1,000,000. Components whose
    eigenvalue is zero to rounding can't be scaled and are left out, so equal rows give none; an empty table gives no rows.
    ``deviation`` is null where it exceeds a long. What is collected has the size of the covariance, not of the data.
    """
    rows = embeddings.select("vec_id", "embedding").filter(usable(F.col("embedding")))
    lengths = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not lengths or lengths[0].d == 0:
        return embeddings.sparkSession.createDataFrame([], schema)
    dimension = lengths[0].d
    rows = rows.filter(F.size("embedding") == dimension)
    n, centres, rest, covariance = fit(rows, dimension)
    values, vectors = leading_eigenpairs(covariance, min(components, dimension))
    kept = values > 64 * dimension * ROUNDING * max(values.max(initial=0.0), 0.0)
    if not kept.any():
        return embeddings.sparkSession.createDataFrame([], schema)
    values, vectors = values[kept], vectors[:, kept]
    projection = vectors / np.sqrt(values)
    middle, remainder = np.array(centres, dtype=np.float64), np.array([float(r) for r in rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centred = scaled(batch.column(1), dimension) - middle
            deviations = _deviations(centred, n, rest)
            whitened = ((n * centred - remainder) / n) @ projection
            flat = pa.array(whitened.ravel())
            offsets = pa.array(np.arange(0, whitened.size + 1, whitened.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(deviations, pa.int64()), pa.ListArray.from_arrays(offsets, flat)], ["vec_id", "deviation", "w"]
            )

    scored = cut_lineage(map_arrow(rows, run, f"vec_id {kind}, deviation long, w array<double>"))
    error = identity_error(scored, n, len(values))
    trace = float(np.trace(covariance))
    explained = F.array(*[F.lit(float(v) / trace) for v in values])
    long_rows = scored.select("vec_id", "deviation", F.posexplode("w").alias("_at", "whitened"))
    return long_rows.select(
        "vec_id", (F.col("_at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("_at")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def _deviations(centred: np.ndarray, n: int, rest: list[int]) -> list[int | None]:
    """Sums of (n x - S)^2: in 64-bit integers if they fit, else in Python's."""
    largest = n * float(np.abs(centred).max(initial=0.0)) + max((abs(r) for r in rest), default=0)
    if largest * largest * max(1, centred.shape[1]) < 2.0**62:
        return ((n * centred.astype(np.int64) - np.array(rest, dtype=np.int64)) ** 2).sum(axis=1).tolist()
    sums = [sum((n * int(v) - r) ** 2 for v, r in zip(row, rest)) for row in centred]
    return [s if s < 1 << 63 else None for s in sums]


def identity_error(scored: DataFrame, n: int, width: int) -> float:
    """Largest absolute entry of the covariance of ``w`` minus the identity; sums per task, added per cell in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares, sums = np.zeros((width, width)), np.zeros(width)
        for batch in batches:
            w = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            squares += w.T @ w
            sums += w.sum(axis=0)
        cells = np.append(squares.ravel(), sums)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cells)), pa.int32()), pa.array(cells)], ["cell", "v"])

    cells = map_arrow(scored.select("w"), run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(width * width + width)
    for r in cells:
        flat[r.cell] = r.v
    means = flat[width * width :] / n
    found = flat[: width * width].reshape(width, width) / n - np.outer(means, means)
    return float(np.abs(found - np.eye(width)).max())
