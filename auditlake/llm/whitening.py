"""Embedding whitening by shifted CholeskyQR.

The distinct vectors are a tall matrix whose rows Spark holds. A pass over it sends each centred row through triangular
solves with the factors found so far and sums the Gram matrix of what comes out, one partial sum a task. The Cholesky
factor of that matrix, shifted on its diagonal while the columns are far from orthogonal, is the next factor. The
composed factors make a small matrix R with the singular values and right singular vectors of the centred rows; its
singular value decomposition gives the components.

Only d x d matrices reach the driver. Tasks keep one batch and one Gram matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import written

SCALE = 256
COMPONENTS = 4
PASSES = 8  # at most; two or three do unless the columns are nearly dependent
ROUND = 2.0**-53


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(x, row): x is floor(256 c) of each entry c, as longs; row is a struct of all columns of rows.

    Rows whose vector is null or empty or holds a null or an entry that isn't finite go. So do those with another number
    of entries than most have (of equally many rows the smaller number).
    """
    whole = rows.select(F.col(f"`{vector}`").cast("array<double>").alias("c"), F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    whole = whole.where(F.col("c").isNotNull() & (F.size("c") > 0) & F.forall("c", finite))
    first = whole.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), "d").first()
    size = first["d"] if first else 0
    return whole.where(F.size("c") == size).select(F.transform("c", lambda c: F.floor(c * SCALE)).alias("x"), "row")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The lists of a column, all of one length and without nulls, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _largest(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


@dataclass
class Whitening:
    """n and sums of the fit list; factors: the triangular factors, first to last; vectors and values: the components."""

    n: int
    sums: list[int]
    factors: list[np.ndarray] = field(default_factory=list)
    vectors: np.ndarray | None = None
    values: np.ndarray | None = None
    trace: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, from one exact whole number where those fit 53 bits."""
        most = max(map(abs, self.sums), default=0) + self.n * _largest(x)
        if most < 1 << 53:
            return (x * self.n - np.array(self.sums, dtype=np.int64)) / self.n
        return x - np.array([s / self.n for s in self.sums])

    def orthogonalised(self, x: np.ndarray) -> np.ndarray:
        q = self.centred(x)
        for r in self.factors:
            q = _solved(q, r)
        return q

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n x - S)^2 over the entries of each row, exactly; None if that is no 64-bit number."""
        most = max(map(abs, self.sums), default=0) + self.n * _largest(x)
        kind = np.int64 if most * most * max(1, x.shape[1]) < 1 << 63 else object
        d = x.astype(kind) * self.n - np.array(self.sums, dtype=kind)
        return [int(v) if v < 1 << 63 else None for v in (d * d).sum(axis=1)]


def _solved(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """q R^-1 for an upper triangular R, one column after the other."""
    out = np.empty_like(q)
    for j in range(r.shape[0]):
        out[:, j] = (q[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def _grams(model: Whitening, white: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (i, sums) for each column i of a task's Gram matrix."""
    total = None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch.column(0))
            q = model.whitened(x) if white else model.orthogonalised(x)
            total = q.T @ q + (0 if total is None else total)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "g"])


def _gram(fit: DataFrame, model: Whitening, white: bool = False) -> np.ndarray:
    """The Gram matrix of the whitened or orthogonalised rows, summed over the tasks by its entries."""
    parts = fit.select("x").mapInArrow(partial(_grams, model, white), "i int, g array<double>")
    sums = parts.select("i", F.posexplode("g").alias("j", "g")).groupBy("i", "j").agg(F.sum("g").alias("g")).collect()  # d x d rows
    out = np.zeros((1 + max(r["i"] for r in sums),) * 2)
    for r in sums:
        out[r["i"], r["j"]] = r["g"]
    return (out + out.T) / 2


def _cholesky(gram: np.ndarray) -> np.ndarray | None:
    try:
        return np.linalg.cholesky(gram).T
    except np.linalg.LinAlgError:
        return None


def fit(x: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, Whitening]:
    """The distinct vectors (x) as a written table and the whitening that they give, of `components` components at most.

    Directions in which the vectors don't vary are no components: a table without two distinct vectors has none.
    """
    rows = written(x.select("x").distinct())
    sums = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).orderBy("i").collect()  # d rows
    if not sums or sums[0]["n"] < 2:
        return rows, Whitening(sums[0]["n"] if sums else 0, [int(r["s"]) for r in sums])
    model, d = Whitening(sums[0]["n"], [int(r["s"]) for r in sums]), len(sums)
    gram = _gram(rows, model)
    model.trace = float(np.trace(gram)) / model.n
    unit = np.eye(d)
    for _ in range(PASSES):
        # columns this close to orthonormal need no further pass; those of a deficient rank never come close
        if model.factors and np.abs(gram - unit).max() < 1e-8:
            break
        shift = 11 * (model.n * d + d * (d + 1)) * ROUND * np.linalg.norm(gram, 2)
        shifted = np.linalg.cond(gram) > 1e12
        factor = None if shifted else _cholesky(gram)
        while factor is None:
            factor, shift = _cholesky(gram + shift * unit), 10 * shift
        model.factors.append(factor)
        gram = _gram(rows, model)
    # what is left of the last Gram matrix is its own factor; its root also serves where the rank is deficient
    left, turn = np.linalg.eigh(gram)
    r = np.sqrt(np.clip(left, 0, None))[:, None] * turn.T
    for factor in reversed(model.factors):
        r = r @ factor
    _, singular, right = np.linalg.svd(r)
    kept = [k for k in range(min(components, d)) if singular[k] > d * 1e-12 * singular[0]]
    vectors = right[kept].T
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), range(len(kept))] < 0, -1.0, 1.0)
    model.vectors, model.values = vectors, singular[kept] ** 2 / model.n
    return rows, model


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened rows minus the identity; one more pass."""
    return float(np.abs(_gram(rows, model, white=True) / model.n - np.eye(len(model.values))).max())


def _whiten(model: Whitening, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _matrix(batch.column("x")) if batch.num_rows else np.zeros((0, len(model.sums)), np.int64)
        white = pa.array(model.whitened(x).tolist(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(model.deviations(x), pa.int64()), white], names=["row", "deviation", "whitened"])


def whitened(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(row, deviation, whitened, explained, n, identity_error) for each usable() row of rows.

    row: a struct of all its columns, whatever their names. whitened: its values on the components, by falling
    eigenvalue; explained: their shares of the total variance. Equal rows give equal results; vectors count once in the fit.
    deviation: the exact sum of (n x - S)^2, null if that is beyond 64 bits. Without two distinct vectors there are no
    components and whitened is empty. An empty table gives no rows.
    """
    used = usable(rows, vector)
    kind = used.schema["row"].dataType.simpleString()
    fitted, model = fit(used, components)
    if model.vectors is None:
        model.vectors, model.values = np.zeros((len(model.sums), 0)), np.zeros(0)
    error = identity_error(fitted, model) if len(model.values) else None
    out = used.select("row", "x").mapInArrow(partial(_whiten, model), f"row {kind}, deviation long, whitened array<double>")
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.values]).cast("array<double>")
    return out.select("*", explained.alias("explained"), F.lit(model.n).cast("long").alias("n"), F.lit(error).cast("double").alias("identity_error"))
