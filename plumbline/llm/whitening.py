"""Operator 13: whitening of embeddings with eigenvectors by Jacobi-Davidson on distributed centred products."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import discard, read, written

#: x = floor(SCALE * c) + SHIFT of each entry c.
SCALE, SHIFT = 1024.0, 100_000
COMPONENTS = 8
#: Entries whose scaled value is not below this count as non-finite: sums of x stay exact.
LARGEST = 2.0**40
#: The search space is restarted at so many times the wanted components, with twice as many.
MOST_SPACE, KEPT_SPACE = 8, 2
#: Steps of the inner solver in a round at most, and the share of a residual at which it stops.
INNER, INNER_SHARE = 4, 0.05
ROUNDS = 200
#: A residual is at double precision at so many units in the last place of the largest eigenvalue, times the root of the dimensions; eigenvalues not above
#: RANK times the trace are zero.
ULPS, RANK = 16, 1e-13


def entries(table: DataFrame) -> DataFrame:
    """(vec_id, x) of the usable rows of table(vec_id, embedding): vectors of the commonest length (the larger of equals) without null or non-finite entries."""
    fits = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) * SCALE < LARGEST))
    good = table.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(fits, F.lit(False)))
    x = written(good.select("vec_id", F.transform("embedding", lambda e: F.floor(e.cast("double") * SCALE) + F.lit(SHIFT).cast("long")).alias("x")))
    lengths = x.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("d").desc()).first()
    return x.where(F.size("x") == (lengths.d if lengths else 0))


def _matrices(batches: Iterator[pa.RecordBatch], d: int, column: str = "x") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def summed(rows: DataFrame, d: int, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], kind: str = "double", column: str = "x") -> np.ndarray:
    """The sum over all rows of part(matrix of a batch of rows), an array of a shape.

    Each task adds up its batches and gives its sum once, in numbered cells; the cells' sums over tasks are an
    aggregation. What reaches the driver is one number a cell, however many rows or tasks there are.
    """
    name = "long" if kind == "long" else "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _matrices(batches, d, column):
            now = part(x)
            total = now if total is None else total + now
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "value"])

    add = F.sum(F.col("value").cast("decimal(38,0)")) if kind == "long" else F.sum("value")
    found = rows.select(column).mapInArrow(run, f"cell long, value {name}").groupBy("cell").agg(add.alias("value")).collect()
    out = np.zeros(int(np.prod(shape)), object if kind == "long" else float)
    for r in found:
        out[r.cell] = int(r.value) if kind == "long" else r.value
    return out.reshape(shape)


class Centre:
    """The mean of exact sums as whole numbers and a remainder below one, so that x less the mean is rounded once, at its own size."""

    def __init__(self, n: int, sums: np.ndarray) -> None:
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([(s % n) / n for s in sums])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest


def orthonormal(block: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what a block has outside of orthonormal bases; directions that are rounding errors are left out."""
    out = np.zeros((len(block), 0))
    for v in block.T:
        size = np.linalg.norm(v)
        for _ in range(3):
            for b in (*bases, out):
                v = v - b @ (b.T @ v)
        left = np.linalg.norm(v)
        if left > 1e-10 * size and left > 0:
            out = np.column_stack((out, v / left))
    return out


def corrections(product: Callable[[np.ndarray], np.ndarray], values: np.ndarray, residuals: np.ndarray, known: np.ndarray, steps: int = INNER, share: float = INNER_SHARE) -> np.ndarray:
    """Approximate solutions t, orthogonal to the columns of known, of (I - P)(V - value)(I - P) t = -residual, one column each, P projecting on known.

    MINRES for all columns side by side, each with its own shift, Lanczos basis and rotations, so that a step is one product of V with a block.
    """
    out_of = lambda z: z - known @ (known.T @ z)
    r = out_of(-residuals)
    beta = np.linalg.norm(r, axis=0)
    t, goal = np.zeros_like(r), share * beta
    live = beta > 0
    v_old, v = np.zeros_like(r), np.where(live, r / np.where(live, beta, 1), 0)
    w_old, w, eta = np.zeros_like(r), np.zeros_like(r), beta.copy()
    c_old, c, s_old, s, b = (np.ones(len(beta)), np.ones(len(beta)), np.zeros(len(beta)), np.zeros(len(beta)), np.zeros(len(beta)))
    for _ in range(steps):
        live &= np.abs(eta) > goal
        if not live.any():
            break
        z = np.zeros_like(r)
        z[:, live] = out_of(product(v[:, live]) - v[:, live] * values[live])
        alpha = (v * z).sum(0)
        z = z - alpha * v - b * v_old
        b_new = np.where(live, np.linalg.norm(z, axis=0), 0)
        # the new column of the tridiagonal matrix, turned by the two rotations before it
        far, near = s_old * b, c * (c_old * b) + s * alpha
        diagonal = c * alpha - s * (c_old * b)
        rho = np.hypot(diagonal, b_new)
        ok = live & (rho > 0)
        safe = np.where(ok, rho, 1)
        c_new, s_new = np.where(ok, diagonal / safe, 1), np.where(ok, b_new / safe, 0)
        w_new = np.where(ok, (v - near * w - far * w_old) / safe, 0)
        t = t + np.where(ok, c_new * eta, 0) * w_new
        eta = np.where(ok, -s_new * eta, eta)
        v_old, v = v, np.where(b_new > 0, z / np.where(b_new > 0, b_new, 1), 0)
        w_old, w, c_old, c, s_old, s, b = w, w_new, c, c_new, s, s_new, b_new
        live = ok & (b_new > 0)
    return out_of(t)


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], d: int, trace: float, wanted: int = COMPONENTS, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues by falling size, unit eigenvectors as columns) of the symmetric positive matrix of d dimensions that product applies; the `wanted` largest.

    Rayleigh-Ritz on a search space; pairs whose residual is at double precision are locked and left out of the space; the others' corrections
    widen it. Ends when all are locked or the space is whole. Eigenvalues of no more than RANK of the trace are not given.
    """
    wanted, rng = min(wanted, d), np.random.default_rng(seed)
    locked, values = np.zeros((d, 0)), np.zeros(0)
    q = orthonormal(rng.standard_normal((d, min(wanted, d))))
    vq = product(q)
    largest = 0.0
    for _ in range(ROUNDS):
        h = q.T @ vq
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        q, vq = q @ y, vq @ y
        largest = max(largest, theta[0] if len(theta) else 0.0, *values.tolist(), 0.0)
        out_of = lambda z, known=locked: z - known @ (known.T @ z)
        open_ = min(wanted - len(values), len(theta))
        residual = out_of(vq[:, :open_] - q[:, :open_] * theta[:open_])
        size = np.linalg.norm(residual, axis=0)
        whole = q.shape[1] + locked.shape[1] >= d
        done = 0
        while done < open_ and (size[done] <= ULPS * np.sqrt(d) * np.finfo(float).eps * largest or whole):
            done += 1
        if done:
            locked = np.column_stack((locked, orthonormal(q[:, :done], locked)))
            values = np.concatenate((values, theta[:done]))
            q, vq, theta, residual = q[:, done:], vq[:, done:], theta[done:], residual[:, done:open_]
        if len(values) >= wanted or whole:
            break
        left = wanted - len(values)
        if q.shape[1] + left > MOST_SPACE * wanted:
            q, vq = q[:, : KEPT_SPACE * wanted], vq[:, : KEPT_SPACE * wanted]
        known = np.column_stack((locked, orthonormal(q[:, :left], locked)))
        if residual.shape[1]:
            new = corrections(product, theta[: residual.shape[1]], residual, known)
        else:
            new = rng.standard_normal((d, left))
        new = orthonormal(new, locked, q)
        if new.shape[1] < left:  # nothing new from some residual: any direction will do
            new = np.column_stack((new, orthonormal(rng.standard_normal((d, min(left - new.shape[1], d - locked.shape[1] - q.shape[1] - new.shape[1]))), locked, q, new)))
        q, vq = np.column_stack((q, new)), np.column_stack((vq, product(new)))
    else:
        raise ArithmeticError("residuals do not reach double precision")
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > RANK * trace]
    return values[order], locked[:, order]


def whitened_vectors(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each usable row of table(vec_id, embedding) and component.

    Rows are as entries() says; x are whole numbers with sums S over all n rows. Components are unit eigenvectors of the covariance of x (divisor n),
    numbered from 1 by falling eigenvalue, as many as asked for or as have a variance at all: one vector, or equal ones, have none, nor has an empty
    table. deviation is the exact sum of (n x - S)^2, null where it doesn't fit in a long. Repeated rows and ids count as often as they are there.
    The covariance is never formed: each product is one pass over the rows, and d numbers a column reach the driver.
    """
    rows = entries(table)
    spark = table.sparkSession
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    kind = table.schema["vec_id"].dataType.simpleString()
    head = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    n, d = head.n, head.d
    if not n:
        return spark.createDataFrame([], out.replace("vec_id long", f"vec_id {kind}"))
    sums = summed(rows, d, lambda x: x.sum(0), (d,), "long")
    centre = Centre(n, sums)
    trace = float(summed(rows, d, lambda x: np.array([(centre(x) ** 2).sum() / n]), (1,))[0])

    def product(block: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            y = centre(x)
            return y.T @ (y @ block) / n

        return summed(rows, d, part, block.shape)

    values, vectors = jacobi_davidson(product, d, trace, components) if trace > 0 else (np.zeros(0), np.zeros((d, 0)))
    k = len(values)
    onto = vectors / np.sqrt(values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sums.astype(float)
        for batch, x in _matrices(batches, d):
            w = centre(x) @ onto
            fits = ((x.astype(float) * n - total) ** 2).sum(1) < 2.0**62
            t = np.zeros_like(x)
            # n x - S from the whole parts, so that n x itself need not fit
            t[fits] = (x[fits] - centre.whole) * n - np.array([s % n for s in sums], np.int64)
            deviation = pa.array((t * t).sum(1), mask=~fits)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), deviation, pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, k), pa.int32()), pa.array(w.ravel()))], names=["vec_id", "deviation", "w"])

    if not k:
        return spark.createDataFrame([], out.replace("vec_id long", f"vec_id {kind}"))
    wide = written(rows.mapInArrow(project, f"vec_id {kind}, deviation long, w array<double>"))
    middle = summed(wide, k, lambda w: w.sum(0) / n, (k,), column="w")
    spread = summed(wide, k, lambda w: (w - middle).T @ (w - middle) / n, (k, k), column="w")
    error = float(np.abs(spread - np.eye(k)).max())
    explained = F.array(*[F.lit(float(e / trace)) for e in values])
    tall = wide.select("vec_id", "deviation", F.posexplode("w").alias("place", "whitened"))
    return tall.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("place")].alias("explained"), F.lit(error).alias("identity_error")
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector of embeddings on the first components of them all; see whitened_vectors."""
    return whitened_vectors(read(spark, sf_dir, "embeddings"))
