"""Whitening of embeddings by contour integration (FEAST).

Spark makes the distinct vectors, their sums and their covariance (dimension-squared sums, added up
per task before they meet).  What is left is one symmetric matrix.  Inertia counts (the signs of an
LDL^T factorisation of the shifted covariance) say how many eigenvalues lie above any point; bisection
on them cuts the upper end of the spectrum into intervals with a few eigenvalues each, in and around
them: those just outside a circle are hardly damped, and a block with fewer columns than there are of
them hardly settles.  For each interval a circle around it is cut at Gauss-Legendre nodes; every
(interval, node) is a row, and its complex shifted solve a Spark task.  The weighted sum of the solves
projects a random block onto the interval's eigenvectors, Rayleigh-Ritz extracts them, and rounds go on
until the residuals are at the size of rounding errors.  An interval is done only when it holds as many
settled Ritz values as its inertia counts say, so no component is missed.  Clusters that cannot be cut
stay in one interval.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, functions as F

from loomgraph.session import materialize

#: Grid of the vectors (fixed by the contract): floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components returned, quadrature nodes on half a circle, rounds of projection at most.
COMPONENTS, NODES, ROUNDS = 16, 8, 30
#: Eigenvalues wanted in one interval at most, where they can be told apart.
PER_INTERVAL = 8
#: Radii of an interval's circle within which eigenvalues are counted as its neighbourhood: those beyond are damped well.
REACH = 1.4
#: Eigenvalues below this share of the largest are zero: such directions have no whitened coordinate.
NULL_SHARE = 1e-12
#: Numbers held at once while a batch of vectors is worked through.
_CELLS = 1 << 20


def grid(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the usable rows: not null, not empty, every entry finite."""
    entry = F.transform("embedding", lambda c: c.cast("double"))
    usable = F.forall("c", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)) & ~F.isnan(c))
    x = F.transform("c", lambda c: F.floor(c * SCALE) + F.lit(SHIFT).cast("long"))
    return (vectors.select("vec_id", entry.alias("c")).where((F.size("c") > 0) & usable)
            .select("vec_id", x.alias("x")))


def _blocks(batch: pa.RecordBatch, dim: int):
    """(first row, matrix of longs) of parts of a batch, of bounded size."""
    rows = max(1, _CELLS // dim)
    for first in range(0, batch.num_rows, rows):
        part = batch["x"].slice(first, rows)
        yield first, part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), dim)


def _sums(fit: DataFrame, dim: int, make) -> np.ndarray:
    """The sum over all blocks of ``make(x)``, a matrix of doubles: summed per task, then by entry."""
    def run(batches):
        total = 0
        for batch in batches:
            for _, x in _blocks(batch, dim):
                total = total + make(x)
        if not np.isscalar(total):
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(a.ravel()) for a in (i, j, total)], ["i", "j", "v"])

    cells = (fit.select("x").mapInArrow(run, "i long, j long, v double").groupBy("i", "j")
             .agg(F.sum("v").alias("v")).toArrow())  # dimension squared cells
    out = np.zeros((max(cells["i"].to_pylist()) + 1, max(cells["j"].to_pylist()) + 1))
    out[cells["i"].to_numpy(), cells["j"].to_numpy()] = cells["v"].to_numpy()
    return out


def inertia(matrix: np.ndarray) -> int:
    """How many eigenvalues of a symmetric matrix are positive, by LDL^T with pivots of size 1 and 2."""
    a, positive = matrix.copy(), 0
    while len(a):
        n = len(a)
        diagonal = np.abs(np.diag(a))
        at = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diag(a)))
        i, j = divmod(int(off.argmax()), n) if n > 1 else (0, 0)
        # complete pivoting: growth stays bounded, and with it the sign errors
        if n == 1 or diagonal[at] >= 0.6404 * off[i, j]:
            pivot = [at]
            positive += a[at, at] > 0
        else:
            pivot = [i, j]
            positive += 1  # a negative determinant: one eigenvalue of either sign
        rest = np.setdiff1d(np.arange(n), pivot)
        block = a[np.ix_(pivot, pivot)]
        if not block.any():
            return positive  # nothing but zeros is left
        side = a[np.ix_(rest, pivot)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
    return positive


def _above(v: np.ndarray, s: float) -> int:
    """How many eigenvalues are larger than ``s``."""
    return inertia(v - s * np.eye(len(v)))


def _bound(v: np.ndarray) -> float:
    """No eigenvalue is larger."""
    return float(np.abs(v).sum(1).max())


def _circle(v: np.ndarray, low: float, high: float) -> tuple[float, float]:
    """Centre and radius: a hair wider than the interval, so that an eigenvalue at its end is not on the circle."""
    pad = 0.05 * (high - low) + 1e-9 * _bound(v)
    low, high = low - pad, high + pad
    return (low + high) / 2, (high - low) / 2


def _columns(count: int) -> int:
    """Columns of a block for so many eigenvalues."""
    return count + max(6, count)


def _near(v: np.ndarray, low: float, high: float) -> int:
    """How many eigenvalues are in the interval or so near that its circle hardly damps them."""
    centre, radius = _circle(v, low, high)
    return _above(v, centre - REACH * radius) - _above(v, centre + REACH * radius)


def intervals(v: np.ndarray, wanted: int, per_interval: int = PER_INTERVAL) -> list[tuple[float, float, int]]:
    """(low, high, count) from above, which hold the ``wanted`` largest eigenvalues that are not zero.

    An interval holds at most ``per_interval`` eigenvalues and its neighbourhood no more than its block has
    columns, or ones closer than can be told apart.
    """
    top = _bound(v)
    if top == 0:
        return []
    above = lambda s: _above(v, s)
    floor = NULL_SHARE * top
    found: list[tuple[float, float, int]] = []

    def cut(low: float, high: float, n_low: int, n_high: int) -> None:
        """From above: counts are those of eigenvalues above each end."""
        if n_low == n_high or n_high >= wanted:
            return
        count = n_low - n_high
        if high - low > 1e-10 * top and (count > per_interval or _near(v, low, high) > _columns(count)):
            middle = (low + high) / 2 if low > high / 64 else np.sqrt(low * high)
            n_middle = above(middle)
            cut(middle, high, n_middle, n_high)
            cut(low, middle, n_low, n_middle)
        else:
            found.append((low, high, count))

    cut(floor, top * (1 + 1e-9), above(floor), 0)
    return found


def _nodes(centre: float, radius: float) -> list[tuple[complex, complex]]:
    """Nodes on the upper half of a circle, and their weights."""
    x, w = np.polynomial.legendre.leggauss(NODES)
    angle = np.pi / 2 * (1 - x)
    turn = np.exp(1j * angle)
    return list(zip(centre + radius * turn, w / 4 * 2 * radius * turn))


def _orthonormal(block: np.ndarray) -> np.ndarray:
    """A basis of the block's columns, without directions that are rounding errors only."""
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    return u[:, s > s[0] * 1e-13]


def eigenpairs(spark, v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of ``v`` that are not zero, falling, and unit eigenvectors.

    The solves run as Spark tasks, one for each (interval, node) and round.
    """
    dim, scale = len(v), max(_bound(v), 1e-300)
    work = []
    rng = np.random.default_rng(7)
    for low, high, count in intervals(v, wanted):
        near, size = _near(v, low, high), _columns(count)
        size = min(dim, size if near <= size else near + 6)
        work.append({"low": low, "high": high, "count": count, "size": size, "circle": _circle(v, low, high),
                     "block": rng.standard_normal((dim, size)), "done": None})
    for _ in range(ROUNDS):
        going = [i for i, w in enumerate(work) if w["done"] is None]
        if not going:
            break
        solved = _solve(spark, v, [(i, *work[i]["circle"], work[i]["block"]) for i in going])
        for i in going:
            w, q = work[i], _orthonormal(solved[i])
            values, mix = np.linalg.eigh(q.T @ v @ q)
            vectors = q @ mix
            inside = (values > w["low"]) & (values <= w["high"])
            residual = np.linalg.norm(v @ vectors - vectors * values, axis=0)
            # a mix of eigenvectors on both sides has a value in between, but no small residual: no eigenpair
            settled = inside & (residual <= 1e-14 * scale * np.sqrt(dim))
            if settled.sum() == w["count"]:
                w["done"] = values[settled], vectors[:, settled]
            w["block"] = vectors
            # a basis that lost directions gets fresh ones
            if vectors.shape[1] < w["size"]:
                w["block"] = np.hstack([vectors, rng.standard_normal((dim, w["size"] - vectors.shape[1]))])
    if any(w["done"] is None for w in work):
        raise ArithmeticError("an interval holds other eigenvalues than its inertia counts say")
    if not work:
        return np.zeros(0), np.zeros((dim, 0))
    # once more over all intervals: neighbours on either side of a cut become orthogonal
    q = _orthonormal(np.hstack([w["done"][1] for w in work]))
    values, mix = np.linalg.eigh(q.T @ v @ q)
    order = np.argsort(-values, kind="stable")[:wanted]
    vectors = (q @ mix)[:, order]
    # the largest entry is positive
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(order))])
    return values[order], vectors


def _solve(spark, v: np.ndarray, work: list) -> dict[int, np.ndarray]:
    """The contour sums of each (interval, centre, radius, block): its solves as rows of one small table."""
    matrix, dim = v.tobytes(), len(v)
    rows = [Row(interval=i, re=float(z.real), im=float(z.imag), wre=float(w.real), wim=float(w.imag),
                block=bytearray(block.tobytes()))
            for i, centre, radius, block in work for z, w in _nodes(centre, radius)]
    table = spark.createDataFrame(rows, "interval int, re double, im double, wre double, wim double, block binary")

    def run(batches):
        a = np.frombuffer(matrix).reshape(dim, dim)
        for batch in batches:
            for row in batch.to_pylist():
                z, w = complex(row["re"], row["im"]), complex(row["wre"], row["wim"])
                y = np.frombuffer(row["block"]).reshape(dim, -1)
                part = (w * np.linalg.solve(z * np.eye(dim) - a, y.astype(complex))).real
                yield pa.RecordBatch.from_pylist([{"interval": row["interval"], "part": part.tobytes()}],
                                                 pa.schema([("interval", pa.int32()), ("part", pa.binary())]))

    parts = (table.repartition(min(len(rows), spark.sparkContext.defaultParallelism))
             .mapInArrow(run, "interval int, part binary").toArrow().to_pylist())  # blocks of dim x size
    out: dict[int, np.ndarray] = {}
    for part in parts:
        found = np.frombuffer(part["part"]).reshape(dim, -1)
        out[part["interval"]] = out.get(part["interval"], 0) + found
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of ``vectors``.

    ``vectors`` has vec_id and embedding (an array of numbers).  Rows whose embedding is null, empty or
    holds a null or non-finite entry are left out; all others must have one length, else a
    ``ValueError`` names the lengths.  Each usable row has one row per component, numbered from 1 by
    falling eigenvalue of the covariance of the distinct vectors on the grid; directions without variance
    have no component, so fewer than two distinct vectors (or none) give no rows.  Repeated rows give
    repeated results and count once for the fit; null vec_id passes; other columns are ignored.
    A deviation beyond a long raises Spark's overflow error.
    """
    spark = vectors.sparkSession
    rows = grid(vectors)
    fit = materialize(rows.select("x").distinct(), "whitening-fit")
    shape = fit.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("x")).alias("least"),
                    F.max(F.size("x")).alias("most")).first()
    n, dim = shape["n"], shape["most"] or 0
    if shape["least"] != shape["most"]:
        raise ValueError(f"vectors have {shape['least']} to {shape['most']} entries")
    nothing = spark.createDataFrame([], _schema(rows))
    if n < 2:
        return nothing
    totals = [r["s"] for r in fit.select(F.posexplode("x").alias("i", "x")).groupBy("i")
              .agg(F.sum("x").alias("s")).orderBy("i").collect()]  # one exact sum per dimension
    # n*x - S in whole numbers first: the division by n is the only rounding
    whole = np.array([s // n for s in totals]), np.array([s % n for s in totals]) / n

    def centred(x: np.ndarray) -> np.ndarray:
        return (x - whole[0]) - whole[1]

    def outer(x: np.ndarray) -> np.ndarray:
        c = centred(x)
        return c.T @ c

    covariance = _sums(fit, dim, outer) / n
    values, axes = eigenpairs(spark, covariance, min(components, dim))
    k = len(values)
    if not k:
        return nothing
    to_white = axes / np.sqrt(values)

    def white_moments(x: np.ndarray) -> np.ndarray:
        w = centred(x) @ to_white
        return np.vstack([w.sum(0), w.T @ w])

    moments = _sums(fit, dim, white_moments) / n
    error = float(np.abs(moments[1:] - np.outer(moments[0], moments[0]) - np.eye(k)).max())
    explained = values / np.trace(covariance)

    def run(batches):
        names = ["vec_id", "component", "deviation", "whitened", "explained"]
        for batch in batches:
            for first, x in _blocks(batch, dim):
                w, again = centred(x) @ to_white, np.repeat(np.arange(first, first + len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [batch["vec_id"].take(pa.array(again)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                     batch["deviation"].take(pa.array(again)), pa.array(w.ravel()),
                     pa.array(np.tile(explained, len(x)))], names)

    return (rows.withColumn("deviation", _deviation(n, totals))
            .mapInArrow(run, f"vec_id {_id_type(rows)}, component int, deviation long, whitened double, explained double")
            .select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                    "explained", F.lit(error).alias("identity_error")))


def _deviation(n: int, totals: list[int]) -> Column:
    sums = F.array(*[F.lit(s).cast("long") for s in totals])
    parts = F.zip_with("x", sums, lambda x, s: (F.lit(n).cast("long") * x - s))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda total, d: total + d * d)


def _id_type(rows: DataFrame) -> str:
    return rows.schema["vec_id"].dataType.simpleString()


def _schema(rows: DataFrame) -> str:
    return (f"vec_id {_id_type(rows)}, component int, n long, deviation long, whitened double, "
            "explained double, identity_error double")
