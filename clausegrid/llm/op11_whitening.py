"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The fit list holds each distinct integer vector once. From a random unit vector v, products Xv and X'u with the centred rows alternate; every new
vector is made orthogonal to all earlier ones of its side (again where that takes away half of it). The right vectors live on the driver (one number per dimension). A left vector
has a number per row and is never gathered: it is X times a vector w of the driver, so each product is a map over the row blocks that
multiplies its rows by all w and adds up inner products, and one sum per number over the blocks. The singular values of the small
matrix of the products (bidiagonal but where the search starts afresh) give deviations, its right vectors the components.

The steps end when the first components' residuals are below `TOLERANCE` of the largest deviation and stay the leading ones over
`CONFIRM` steps from another random vector, orthogonal to all found, which finds further copies of equal eigenvalues; or when no
direction is left. Sums of the integer vectors are exact.

Cases: rows whose vector is null, empty, or holds null or non-finite entries, or an entry whose scaled value doesn't fit 64 bits, take no part, nor do
vectors of another length than most rows have (of equally frequent lengths the largest); null ids are kept; repeated rows are answered again and
count once in the fit; an empty table gives an empty result; directions without deviation are no components, so equal vectors
give no rows and data of rank 2 give two; a deviation beyond 64 bits is null; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.llm.common import keep

SCALE, COMPONENTS, SEED = 256, 4, 11
TOLERANCE, NOTHING, CONFIRM = 1e-13, 1e-11, 10
_BOUND = float(2**63)


def integer_rows(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, x: the usable vectors, each entry c as floor(scale * c)."""
    scaled = F.transform(F.col(vector_col), lambda v: v.cast("double") * F.lit(float(scale)))
    fits = F.forall(scaled, lambda v: F.coalesce((v >= -_BOUND) & (v < _BOUND), F.lit(False)))  # a NaN is above every number
    usable = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & fits
    return table.select(
        F.col(id_col).cast("long").alias("vec_id"), F.when(usable, F.transform(scaled, lambda v: F.floor(v))).alias("x")).where("x IS NOT NULL")


def _matrix(column, dim: int, dtype=np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, dim)


def _block_sums(fn, dim: int, mean: np.ndarray):
    """`fn` adds up a list of numbers over centred rows; one list a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.column(0).slice(at, 4096)
                if len(part):
                    sums = fn(_matrix(part, dim) - mean)
                    total = sums if total is None else total + sums
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["place", "value"])

    return run


@dataclass
class Fit:
    """The centred fit list: `rows` is a written table of the column x."""

    rows: DataFrame
    n: int
    sums: list[int]
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def add_up(self, fn, size: int) -> np.ndarray:
        """Sums over all rows of the `size` numbers that `fn` gives for a block of centred rows: one row per number comes to the driver."""
        parts = self.rows.select("x").mapInArrow(_block_sums(fn, len(self.sums), self.mean), "place int, value double")
        out = np.zeros(size)
        for r in parts.groupBy("place").agg(F.sum("value").alias("value")).collect():
            out[r["place"]] = r["value"]
        return out


def fit_list(rows: DataFrame) -> Fit | None:
    """The distinct vectors with exact sums; None without rows."""
    fit = keep(rows.select("x").distinct(), "whitening-fit")
    places = fit.select(F.posexplode("x").alias("place", "c")).groupBy("place").agg(
        F.count("*").alias("n"), F.sum(F.col("c").cast("decimal(38,0)")).alias("s"), F.sum(F.col("c").cast("decimal(19,0)") * F.col("c").cast("decimal(19,0)")).alias("q"))
    got = sorted(places.collect(), key=lambda r: r["place"])  # one row per dimension
    if not got:
        return None
    n, sums = got[0]["n"], [int(r["s"]) for r in got]
    return Fit(fit, n, sums, sum(n * int(r["q"]) - s * s for r, s in zip(got, sums)) / n**2)


def _orthogonal(v: np.ndarray, basis: Sequence[np.ndarray]) -> np.ndarray:
    if basis:
        m = np.array(basis)
        for _ in range(2):
            v = v - m.T @ (m @ v)
    return v


def bidiagonalise(fit: Fit, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues of the covariance, falling, and their unit eigenvectors as rows."""
    dim, rng = len(fit.sums), np.random.default_rng(SEED)
    if fit.trace <= 0:
        return np.zeros(0), np.zeros((0, dim))
    total = np.sqrt(fit.n * fit.trace)  # the centred rows' Frobenius norm
    right: list[np.ndarray] = []  # v
    left: list[np.ndarray] = []  # w, with u = X w
    back: list[np.ndarray] = []  # X'u
    entries: list[tuple[int, int, float]] = []

    def products(w: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """The inner products of Xw with all left vectors, its squared length, and X'Xw."""
        all_w = np.array([*left, w]).T

        def sums(x):
            u = x @ all_w
            return np.concatenate([u.T @ u[:, -1], x.T @ u[:, -1]])

        got = fit.add_up(sums, len(left) + 1 + dim)
        return got[: len(left)], got[len(left)], got[len(left) + 1 :]

    def start() -> np.ndarray | None:
        for _ in range(3):
            v = _orthogonal(rng.standard_normal(dim), right)
            if np.linalg.norm(v) > 1e-8:
                return v / np.linalg.norm(v)
        return None

    def solve():
        b = np.zeros((max(len(left), 1), len(right)))
        for i, j, x in entries:
            b[i, j] = x
        p, s, q = np.linalg.svd(b, full_matrices=False)
        return p, s, q

    v, beta, confirming, leading = start(), 0.0, None, None
    while v is not None:
        right.append(v)
        w, j = v.copy(), len(right) - 1
        if beta:
            w = w - beta * left[-1]
            entries.append((len(left) - 1, j, beta))
        for _ in range(2):
            c, square, z = products(w)
            whole = square
            if left:
                w, z, square = w - np.array(left).T @ c, z - np.array(back).T @ c, square - float(c @ c)
            if square >= 0.5 * whole > (NOTHING * total) ** 2:
                break  # little was taken away, so what is left is orthogonal; else once more
        alpha = float(np.sqrt(max(square, 0.0)))
        last = 0.0
        if alpha > NOTHING * total:
            left.append(w / alpha)
            back.append(z / alpha)
            entries.append((len(left) - 1, j, alpha))
            following = _orthogonal(z / alpha - alpha * v, right)
            last = float(np.linalg.norm(following))
        p, s, q = solve()
        if last <= NOTHING * total:
            v, beta, last = start(), 0.0, 0.0
        else:
            v, beta = following / last, last
        if confirming is not None:
            confirming -= 1
        top = s[:wanted]
        settled = len(left) >= wanted and np.all(last * np.abs(p[len(left) - 1, :wanted]) <= TOLERANCE * total)
        if confirming is None and settled and v is not None:
            # what was found is invariant: go on from a random vector orthogonal to it
            v, beta, confirming, leading = start(), 0.0, CONFIRM, top
        elif confirming is not None and confirming <= 0 and settled:
            if np.all(np.abs(top - leading) <= 1e-9 * top[0]):
                break
            confirming, leading = CONFIRM, top
    p, s, q = solve()
    keep_n = min(wanted, int(np.sum(s > NOTHING * total)))
    vectors = q[:keep_n] @ np.array(right)
    return s[:keep_n] ** 2 / fit.n, vectors


def whiten(rows: DataFrame, fit: Fit, values: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """vec_id, deviation, whitened (one number per component) of every row of `rows` (vec_id, x)."""
    dim, mean, n, sums = len(fit.sums), fit.mean, fit.n, fit.sums
    project = vectors.T / np.sqrt(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                x = _matrix(b.column(1), dim, np.int64)
                z = (x - mean) @ project
                if n * int(max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))) + max(map(abs, sums)) < int((2**63 / dim) ** 0.5):
                    deviation = ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
                else:  # exact beyond 64 bits
                    deviation = [int(d) if d < 2**63 else None for d in ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(deviation, pa.int64()), flat], names=["vec_id", "deviation", "whitened"])

    return rows.select("vec_id", "x").mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def identity_error(fit: Fit, values: np.ndarray, vectors: np.ndarray) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    project, k = vectors.T / np.sqrt(values), len(values)
    centre = fit.add_up(lambda x: (x @ project).sum(axis=0), k) / fit.n

    def sums(x):
        z = x @ project - centre
        return (z.T @ z).ravel()

    return float(np.abs(fit.add_up(sums, k * k).reshape(k, k) / fit.n - np.eye(k)).max())


COLUMNS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def report(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = keep(integer_rows(table), "whitening-rows")
    length = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    empty = table.sparkSession.createDataFrame([], COLUMNS)
    if length is None:
        return empty
    rows = rows.where(F.size("x") == length["dim"])
    fit = fit_list(rows)
    values, vectors = bidiagonalise(fit, components)
    if not len(values):
        return empty
    error = identity_error(fit, values, vectors)
    explained = F.array(*[F.lit(float(e / fit.trace)) for e in values])
    return whiten(rows, fit, values, vectors).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened")).select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"))
