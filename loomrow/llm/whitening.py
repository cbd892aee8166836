"""Whitening of embeddings by shifted CholeskyQR.

Vectors become whole numbers once and are written; every pass reads only these. A pass multiplies the centred rows by
the inverses of the triangular factors found so far and adds up their Gram matrix in the tasks; what moves is one d x d
matrix a task, what reaches the driver one d x d matrix a pass. The first Gram matrix is shifted before its Cholesky
factor is taken, so that it exists whatever the condition; the next passes make the rows orthogonal to double precision.
The product of the factors is the R of the centred rows, and the singular vectors of this small matrix are the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted, table, unpacked, whole_row, written

SCALE, OFFSET = 1024.0, 100_000
COMPONENTS = 8
#: larger entries are held at this value, far beyond what embeddings hold
LARGEST = 1 << 61
#: passes at most; three do for rows of any condition, unless they have directions without any variance
PASSES = 6
#: the Gram matrix of orthogonal rows is as near to a projector
NEAR = 1e-13
#: a direction with less of the largest singular value has no variance but that of rounding
LEAST = 1e-10
UNIT = float(np.finfo(np.float64).eps) / 2


def fixed_point(df: DataFrame, vector: str) -> DataFrame:
    """``row`` (all columns) and ``x``, for vectors without null or non-finite entries: ``floor(1024 * c) + 100000``."""
    packed = df.select(whole_row(df).alias("row"), quoted(vector).cast("array<double>").alias("v")).where("v is not null")
    row = packed.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls are not numbers, either
            lengths = np.asarray(pa.compute.list_value_length(column), dtype=np.int64)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            bad = np.bincount(owner, weights=~np.isfinite(values), minlength=len(lengths)) > 0
            kept = ~bad[owner]
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(SCALE * values[kept]), -LARGEST, LARGEST).astype(np.int64) + OFFSET
            offsets = np.concatenate([[0], np.cumsum(lengths[~bad])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(x))
            yield pa.RecordBatch.from_arrays([batch.column("row").filter(pa.array(~bad)), lists], names=["row", "x"])

    return packed.mapInArrow(run, f"row {row}, x array<bigint>")


def block(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dimensions)


def added_up(x: DataFrame, width: int, shape: tuple[int, int], part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``part`` over blocks of rows: added up within each task first, then by Spark, entry by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += part(block(batch.column("x"), width))
        i, j = np.indices(shape, dtype=np.int32).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "value"])

    entries = x.select("x").mapInArrow(run, "i int, j int, value double")
    out = np.zeros(shape)
    for r in entries.groupBy("i", "j").agg(F.sum("value").alias("value")).collect():  # as many as the shape says
        out[r.i, r.j] = r.value
    return out


def totals(x: DataFrame, width: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sums = 0, [0] * width
        for batch in batches:
            values = block(batch.column("x"), width)
            # halves, so that the sums of a batch cannot overflow
            high, low = (values >> 32).sum(axis=0), (values & 0xFFFFFFFF).sum(axis=0)
            sums = [s + (int(h) << 32) + int(w) for s, h, w in zip(sums, high, low)]
            rows += len(values)
        entries = [rows, *sums]
        places = pa.array(np.arange(-1, width, dtype=np.int32))
        parts = [pa.array([e >> 32 for e in entries], pa.int64()), pa.array([e & 0xFFFFFFFF for e in entries], pa.int64())]
        yield pa.RecordBatch.from_arrays([places, *parts], names=["i", "high", "low"])

    parts = x.select("x").mapInArrow(run, "i int, high long, low long")
    wide = [F.sum(F.col(name).cast("decimal(38,0)")).alias(name) for name in ("high", "low")]
    found = {r.i: (int(r.high) << 32) + int(r.low) for r in parts.groupBy("i").agg(*wide).collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(width)]


def through(factors: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """``rows`` times the inverses of upper triangular factors, by forward substitution."""
    columns = rows.T.copy()
    for r in factors:
        for j in range(len(r)):
            if j:
                columns[j] -= r[:j, j] @ columns[:j]
            columns[j] /= r[j, j]
    return columns.T


def factor(gram: np.ndarray, rows: int, shifted: bool) -> np.ndarray:
    """The upper Cholesky factor; of the shifted matrix where asked for, or where the plain one has none."""
    d = len(gram)
    if not shifted:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            pass
    shift = 11 * (d * rows + d * (d + 1)) * UNIT * np.linalg.norm(gram, 2)
    return np.linalg.cholesky(gram + shift * np.eye(d)).T


def triangular(x: DataFrame, width: int, rows: int, mean: np.ndarray) -> np.ndarray:
    """R of the centred rows: one distributed Gram pass for each factor."""
    factors: list[np.ndarray] = []
    for turn in range(PASSES):
        done = list(factors)

        def part(values: np.ndarray) -> np.ndarray:
            q = through(done, values - mean)
            return q.T @ q

        gram = added_up(x, width, (width, width), part)
        if not gram.any():
            return np.zeros((width, width))
        if turn and np.abs(gram @ gram - gram).max() <= NEAR * width:
            break
        factors.append(factor(gram, rows, shifted=turn == 0))
    r = np.eye(width)
    for own in factors:
        r = own @ r
    return r


@dataclass
class Whitening:
    """What whitens vectors of ``dimensions`` entries: fixed in size, whatever the number of rows."""

    rows: int
    sums: list[int]
    mean: np.ndarray
    #: eigenvectors of the covariance by falling eigenvalue, one a column, and the eigenvalues
    vectors: np.ndarray
    values: np.ndarray
    #: each eigenvalue over their sum
    explained: np.ndarray
    identity_error: float = 0.0

    @property
    def dimensions(self) -> int:
        return len(self.mean)

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum of ``(n x - S)^2``, exactly; null beyond 64 bits."""
        largest = max((abs(int(v)) for v in (x.min(initial=0), x.max(initial=0))), default=0)
        bound = self.rows * largest + max(map(abs, self.sums), default=0)
        if bound**2 * self.dimensions < 1 << 63:
            return ((self.rows * x - np.array(self.sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        out = [sum((self.rows * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in out]


def learnt(x: DataFrame, width: int, components: int) -> Whitening:
    """The whitening of all rows of ``x``, with the error that the whitened rows show."""
    rows, sums = totals(x, width)
    mean = np.array([float(s // rows) + (s % rows) / rows for s in sums]) if rows else np.zeros(width)
    empty = np.zeros(0)
    if not rows or not width:
        return Whitening(rows, sums, mean, np.zeros((width, 0)), empty, empty)
    _, singular, right = np.linalg.svd(triangular(x, width, rows, mean))
    found = int(np.count_nonzero(singular > LEAST * singular[0]))
    kept = min(components, found)
    vectors = right[:kept].T
    if kept:  # either sign will do; the largest entry is positive, so that reruns agree
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(kept)])
    values = singular**2 / rows
    share = values[:kept] / values.sum() if found else empty
    result = Whitening(rows, sums, mean, vectors, values[:kept], share)
    if kept:
        centre = added_up(x, width, (1, kept), lambda v: result.project(v).sum(axis=0, keepdims=True)) / rows

        def products(v: np.ndarray) -> np.ndarray:
            z = result.project(v) - centre
            return z.T @ z

        covariance = added_up(x, width, (kept, kept), products) / rows
        result.identity_error = float(np.abs(covariance - np.eye(kept)).max())
    return result


def whitened(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening]:
    """The rows of ``df`` with ``deviation`` and ``whitened`` (array of up to ``components`` doubles), and the whitening.

    Entries become ``floor(1024 * c) + 100000`` (held at 2^61). Rows whose vector is null or holds null or non-finite entries go;
    so do vectors whose length is not the most frequent one (of two as frequent, the longer), as they have no covariance with the others.
    Directions without variance are no components: one row alone, or equal vectors, give empty arrays, an empty table no rows.
    Repeated rows and zero vectors count like any others. ``deviation`` is null beyond 64 bits. Input columns named like a result
    are replaced. Work tables are written, so a lost executor repeats single tasks.
    """
    kept = written(fixed_point(df, vector), "fixed")
    sizes = kept.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("rows"))
    most = sizes.orderBy(F.desc("rows"), F.desc("d")).head()
    width = most.d if most else 0
    kept = kept.where(F.size("x") == width)
    model = learnt(kept, width, components)
    row = kept.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = block(batch.column("x"), width)
            z = model.project(x)
            offsets = np.arange(len(x) + 1, dtype=np.int32) * z.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(z.ravel()))
            arrays = [batch.column("row"), pa.array(model.deviation(x), pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "deviation", "whitened"])

    out = kept.mapInArrow(run, f"row {row}, deviation long, whitened array<double>")
    return unpacked(out, "row", ["deviation", "whitened"]), model


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    rows, model = whitened(table(spark, folder, "embeddings").select("vec_id", "embedding"))
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    shares = F.array(*[F.lit(float(share)) for share in model.explained]).cast("array<double>")
    return each.select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(model.rows).cast("long").alias("n"), "deviation",
        "whitened", F.get(shares, F.col("place")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
