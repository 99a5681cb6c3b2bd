"""Whitening of embeddings by shifted CholeskyQR.

A component c of a vector becomes x = floor(64 c) + 1,000,000. Statistics are over the fit list, each distinct x vector once.

1. The fit list is made by one shuffle with partial aggregation, so copies of a hot vector meet in their own tasks first,
   and written once. Its values are floor(64 c) in the type of the input, which holds them exactly.
2. Sums are exact integers. Rows are centred before anything is multiplied: z = (n x - S) / n, the numerator exact.
3. Gram passes: every task adds up Q^T Q of its rows, with Q = Z R1^-1 R2^-1 ... by triangular solves; only d x d sums leave
   a task. The driver factors the total by Cholesky, the first time with a shift that makes it positive definite whatever
   the condition of Z. Passes repeat until Q is orthonormal to rounding; R = ... R2 R1 then has the singular values of Z.
4. The SVD of R, d x d, gives components V and eigenvalues s^2 / n. One more Gram pass over the whitened fit list measures
   how far its covariance is from the identity.

What reaches the driver or is sent to tasks depends on d alone. Lost executors only cost their tasks, as every pass reads the
written fit list.

Rows whose vector is null, or holds a null, a NaN or an infinity, are left out, and so are rows whose vector has another
length than most of the distinct ones (ties: the longer). Values of floor(64 c) beyond 2^44 in size count as 2^44. Rows with
a null or repeated vec_id are rows like others. Components without variance (all vectors equal, constant or dependent
dimensions) have whitened NULL; explained is NULL where there is no variance at all. deviation is NULL where it doesn't fit
a long. An empty table gives no rows. Other columns are carried along by ``whiten``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacancia.llm import storage

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
LARGEST = 1 << 44
#: Passes at most; three do unless dimensions depend on each other.
PASSES = 6
#: Numbers of one block of rows, 32 MB.
BLOCK = 1 << 22


@dataclass
class Model:
    """n rows and sums of the fit list; components by column (d x k), eigenvalues, their trace, and the measured error."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def projection(self) -> np.ndarray:
        """Centred rows times this are whitened."""
        alive = self.eigenvalues > 0
        return np.where(alive, self.components / np.sqrt(np.where(alive, self.eigenvalues, 1)), 0)


def finite(vector: str) -> Column:
    return F.col(vector).isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))


def floors(vector: str) -> Column:
    """floor(64 c) as doubles, without a negative zero."""
    return F.transform(vector, lambda c: F.greatest(F.least(F.floor(c.cast("double") * SCALE), F.lit(LARGEST)), F.lit(-LARGEST)).cast("double"))


def matrices(arrays: pa.Array, d: int) -> Iterator[np.ndarray]:
    """The vectors as integers x, in blocks of bounded size."""
    rows = max(1, BLOCK // max(d, 1))
    for at in range(0, len(arrays), rows):
        yield np.asarray(arrays.slice(at, rows).flatten(), np.float64).astype(np.int64).reshape(-1, d) + OFFSET


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: as 64-bit integers where these hold it, else as Python's."""
    if n * (LARGEST if not x.size else int(np.abs(x).max())) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def solved(z: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """z R1^-1 R2^-1 ..., by forward substitution."""
    for r in factors:
        q = np.empty_like(z)
        for j in range(z.shape[1]):
            q[:, j] = (z[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
        z = q
    return z


def gram(fit: DataFrame, d: int, rows_of: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum of w^T w over the fit list, where ``rows_of`` maps integer rows to rows w of the given width."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, met = np.zeros((width, width)), False
        for batch in batches:
            for x in matrices(batch.column(0), d):
                w = rows_of(x)
                total, met = total + w.T @ w, True
        if met:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "row"])

    cells = fit.mapInArrow(partial, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((width, width))
    for r in cells.collect():  # width squared
        out[r["i"], r["j"]] = r["v"]
    return (out + out.T) / 2


def triangle(q: np.ndarray, shift: float) -> np.ndarray:
    """R of q = R^T R, upper; shifted more until it exists."""
    while True:
        try:
            return np.linalg.cholesky(q + shift * np.eye(len(q))).T
        except np.linalg.LinAlgError:
            shift = max(10 * shift, float(np.trace(q)) * len(q) * np.finfo(float).eps)


def fit_list(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """x: the distinct vectors of floor(64 c), written once."""
    kind = vectors.schema[vector].dataType.simpleString()
    narrow = "array<float>" if kind == "array<float>" else "array<double>"
    rows = vectors.where(finite(vector)).select(floors(vector).cast(narrow).alias("x"))
    return storage.written(rows.distinct(), "whitening-fit")


def fit(vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> Model | None:
    """The components of the fit list; None where no vector is left."""
    storage.ship(vectors.sparkSession)
    distinct = fit_list(vectors, vector)
    lengths = distinct.groupBy(F.size("x").alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return None
    d, n = lengths["d"], lengths["count"]
    rows = distinct.where(F.size("x") == d)

    def partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in matrices(batch.column(0), d):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(x.sum(axis=0))], names=["i", "s"])

    summed = rows.mapInArrow(partial_sums, "i int, s bigint").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    sums = [int(r["s"]) for r in sorted(summed, key=lambda r: r["i"])]

    def z(x: np.ndarray) -> np.ndarray:
        return centred(x, n, sums).astype(np.float64) / n

    first = gram(rows, d, z, d)
    alive = np.flatnonzero(np.diag(first) > 0)
    vectors_, values = np.zeros((d, min(components, d))), np.zeros(min(components, d))
    if len(alive):
        eps, m = np.finfo(float).eps / 2, len(alive)
        now, factors, r = first[np.ix_(alive, alive)], [], np.eye(m)
        for i in range(PASSES):
            factors.append(triangle(now, 0.0 if i else 11 * (n * m + m * (m + 1)) * eps * float(np.trace(now))))
            r = factors[-1] @ r
            now = gram(rows, d, lambda x: solved(z(x)[:, alive], factors), m)
            if np.abs(now - np.eye(m)).max() < 1e-12:
                break
        r = triangle(now, 0.0) @ r
        _, s, vt = np.linalg.svd(r)
        k = min(len(values), m)
        s = np.where(s > s[0] * m * 8 * eps, s, 0)
        signs = np.sign(vt[np.arange(m), np.abs(vt).argmax(axis=1)])  # the largest entry is positive
        vectors_[alive, :k], values[:k] = (vt * signs[:, None])[:k].T, s[:k] ** 2 / n
        trace = float((s**2).sum() / n)
    else:
        trace = 0.0
    model = Model(n, sums, vectors_, values, trace)
    live, projection = np.flatnonzero(values > 0), model.projection
    if len(live):
        both = gram(rows, d, lambda x: np.column_stack([z(x) @ projection[:, live], np.ones(len(x))]), len(live) + 1)
        mean = both[-1, :-1] / n
        model.identity_error = float(np.abs(both[:-1, :-1] / n - np.outer(mean, mean) - np.eye(len(live))).max())
    return model


def whiten(vectors: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> tuple[DataFrame, Model | None]:
    """The given columns, deviation (long) and whitened (array<double>, NULL where a component has no variance); the model."""
    model = fit(vectors, components, vector)
    kept = [c for c in vectors.columns if c.lower() not in ("deviation", "whitened")]
    schema = vectors.select(*kept, F.lit(None).cast("long").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened")).schema
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema), None
    name = storage.free_name(vectors, "x")
    n, sums, d, projection, live = model.n, model.sums, len(model.sums), model.projection, model.eigenvalues > 0

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in matrices(batch.column(name), d):
                numerators = centred(x, n, sums)
                exact = numerators if numerators.dtype == object or float((numerators.astype(np.float64) ** 2).sum(axis=1).max(initial=0)) < 2**62 else numerators.astype(object)
                deviations = [v if v < 1 << 63 else None for v in (exact * exact).sum(axis=1).tolist()]
                w = (numerators.astype(np.float64) / n) @ projection
                values = pa.array(w.ravel(), mask=np.tile(~live, len(w)))
                arrays = [batch.column(c).slice(at, len(x)) for c in kept]
                whitened = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), values)
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(deviations, pa.int64()), whitened], names=[*kept, "deviation", "whitened"])
                at += len(x)

    rows = vectors.where(finite(vector)).select(*kept, floors(vector).alias(name)).where(F.size(name) == d)
    return rows.mapInArrow(apply, schema), model


def digest(whitened: DataFrame, model: Model | None) -> DataFrame:
    """One row for each vector and component."""
    rows = whitened.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = [float(e / model.trace) if model and model.trace > 0 else None for e in (model.eigenvalues if model else [])]
    explained = F.element_at(F.array(*[F.lit(s) for s in shares] or [F.lit(None)]).cast("array<double>"), F.col("at") + 1)
    return rows.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
        explained.alias("explained"), F.lit(model.identity_error if model else None).cast("double").alias("identity_error"),
    )
