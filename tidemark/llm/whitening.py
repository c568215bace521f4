"""Whitening of embeddings from an exact integer scatter.

Entries become integers (floor(scale * c)). Distinct vectors are what the covariance is taken over. Tasks subtract an integer shift (near the
mean, so that numbers stay small) and add up products without rounding: blocks of rows so small that a double holds every sum, or else digits
of 20 bits, then Python's integers. Each sum leaves its task as digits of 30 bits, which Spark adds up natively, so that no total can overflow.
The driver, which sees only a number for each pair of dimensions, forms n XtX - S St as integers; only that is converted to double and decomposed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean

_DIGIT = 30
#: So many dimensions at most: their squares are what the driver holds.
DIMENSIONS = 4096


def integers(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(_id, x array<long>) of the rows that count, written: vectors without null or non-finite entries, of the table's length.

    Vectors that are empty, that hold an entry beyond the range of a long, or whose length is not the most frequent one (of equally frequent
    ones the longest) have no place in a covariance and go as well.
    """
    c = F.col(vector_col)
    fits = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double") * scale) < 2.0**63))
    rows = df.where(c.isNotNull() & F.coalesce(fits, F.lit(False)) & (F.size(c) > 0)).select(F.col(id_col).alias("_id"), F.transform(c, lambda v: F.floor(v.cast("double") * scale)).alias("x"))
    rows = cut(rows, scan=True)
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if usual and usual["d"] > DIMENSIONS:
        raise ValueError(f"vectors of {usual['d']} entries; the covariance is made for {DIMENSIONS} at most")
    return rows.where(F.size("x") == (usual["d"] if usual else 0))


def matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """The rows of a list column as one array of longs."""
    col = batch.column(batch.schema.get_field_index(name))
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(batch.num_rows, -1)


def exact_products(x: np.ndarray) -> list[list[int]]:
    """Xt X of whole numbers (int64, or Python's where they don't fit), as Python's integers."""
    d = x.shape[1]
    total = np.zeros((d, d), object)
    most = int(np.abs(x).max(initial=0))
    if most < 1 << 26:
        step = max(1, (1 << 53) // max(1, most * most))  # a block's sums stay below 2**53
        for lo in range(0, len(x), step):
            part = x[lo : lo + step].astype(np.float64)
            total += (part.T @ part).astype(np.int64).astype(object)
        return total.tolist()
    digits, rest = [], x.astype(object)
    while np.any((rest != 0) & (rest != -1)) or not digits:
        digits.append((rest & 0xFFFFF).astype(np.float64))
        rest = rest >> 20
    digits.append(rest.astype(np.float64))  # 0 or -1: the sign
    step = 1 << 13  # 2**13 products of 2**40
    for i, a in enumerate(digits):
        for j, b in enumerate(digits):
            for lo in range(0, len(x), step):
                total += (a[lo : lo + step].T @ b[lo : lo + step]).astype(np.int64).astype(object) << (20 * (i + j))
    return total.tolist()


def _digits(v: int) -> Iterator[tuple[int, int]]:
    sign, v, k = (-1 if v < 0 else 1), abs(v), 0
    while v:
        yield k, sign * (v & ((1 << _DIGIT) - 1))
        v >>= _DIGIT
        k += 1


def _sent(cells: Iterator[tuple[int, int, int]]) -> pa.RecordBatch:
    rows = [(i, j, k, v) for i, j, total in cells for k, v in _digits(total)]
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["i", "j", "k", "v"])


def _totals(parts: DataFrame) -> dict[tuple[int, int], int]:
    """The sums of all tasks' digits: one number a cell."""
    out: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("i", "j", "k").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = out.get((r["i"], r["j"]), 0) + (r["v"] << (_DIGIT * r["k"]))
    return out


def _shifted(x: np.ndarray, shift: list[int]) -> np.ndarray:
    """x - shift, without overflow."""
    if max(int(np.abs(x).max(initial=0)), max(map(abs, shift), default=0)) < 1 << 61:
        return x - np.array(shift, np.int64)
    return x.astype(object) - np.array(shift, object)


class Scatter:
    """n, sums (S, a number a dimension), scatter (n XtX - S St, whole numbers), trace, values and vectors (of the covariance, by falling eigenvalue)."""

    def __init__(self, fit: DataFrame):
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = 0, None
            for b in batches:
                x = matrix(b, "x")
                part = ((x >> 32).sum(0).astype(object) << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)
                n, total = n + len(x), part if total is None else total + part
            if n:
                yield _sent([(-1, -1, n), *[(-1, j, int(v)) for j, v in enumerate(total)]])

        of_sums = _totals(fit.mapInArrow(lean(sums), "i int, j int, k int, v long"))
        self.n = of_sums.get((-1, -1), 0)
        width = fit.select(F.size("x")).first()
        d = width[0] if width else 0
        self.sums = [of_sums.get((-1, j), 0) for j in range(d)]
        shift = [s // self.n for s in self.sums]

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                part = np.array(exact_products(_shifted(matrix(b, "x"), shift)), object)
                total = part if total is None else total + part
            if total is not None:
                yield _sent((i, j, int(total[i][j])) for i in range(d) for j in range(i, d))

        cells = _totals(fit.mapInArrow(lean(products), "i int, j int, k int, v long"))
        rest = [s - self.n * m for s, m in zip(self.sums, shift, strict=True)]  # the sums of shifted vectors
        self.scatter = [[self.n * cells.get((min(i, j), max(i, j)), 0) - rest[i] * rest[j] for j in range(d)] for i in range(d)]
        square = self.n * self.n
        # whole numbers divide to the nearest double
        cov = np.array([[v / square for v in row] for row in self.scatter], np.float64).reshape(d, d)
        self.trace = sum(self.scatter[i][i] for i in range(d)) / square if d else 0.0
        values, vectors = np.linalg.eigh(cov) if d else (np.zeros(0), np.zeros((0, 0)))
        self.values, self.vectors = values[::-1].copy(), vectors[:, ::-1].copy()

    def rank(self) -> int:
        """Components whose variance is more than rounding."""
        return int((self.values > len(self.values) * np.finfo(float).eps * max(self.values[:1].sum(), 0.0)).sum())


def _projected(rows: DataFrame, model: Scatter, k: int) -> DataFrame:
    """_id, deviation, w (the first k whitened components; null where there is no variance) of each row."""
    n, sums, known = model.n, model.sums, min(k, model.rank())
    axes = model.vectors[:, :known] / np.sqrt(model.values[:known])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b, "x")
            if (max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums)))) < 1 << 62:
                y = x * n - np.array(sums, np.int64)
            else:
                y = x.astype(object) * n - np.array(sums, object)
            most = int(np.abs(y).max(initial=0))
            if most * most * y.shape[1] < 1 << 63:
                deviation = (y.astype(np.int64) ** 2).sum(1).tolist()
            else:
                deviation = [v if v < 1 << 63 else None for v in (y.astype(object) ** 2).sum(1).tolist()]
            w = (y / n).astype(np.float64) @ axes
            cells = pa.array(w.ravel(), pa.float64()) if known == k else pa.array([v for row in w.tolist() for v in (*row, *[None] * (k - known))], pa.float64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), cells)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("_id")), pa.array(deviation, pa.int64()), lists], names=["_id", "deviation", "w"])

    kind = dict(rows.dtypes)["_id"]
    return rows.select("_id", "x").mapInArrow(lean(project), f"_id {kind}, deviation long, w array<double>")


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, components: int = 4) -> DataFrame:
    """One row per row that counts (see integers) and component (from 1, at most `components`): id, component, n, deviation, whitened, explained, identity_error.

    n is the number of distinct integer vectors. deviation is the sum over dimensions of (n x - S)**2; null where no long holds it. A component without
    variance (copies of one vector, fewer vectors than components) has whitened null and explained 0, or null where all vectors are one. identity_error is
    the same everywhere: how far the covariance of the whitened distinct vectors is from the identity at most. Null ids stay; repeated rows get equal
    answers. Other columns, whatever their names, are not read; a table without a row that counts gives no rows.
    """
    rows = integers(df, id_col, vector_col, scale)
    fit = cut(rows.select("x").distinct())
    model = Scatter(fit)
    k = min(components, len(model.sums))
    kind = dict(rows.dtypes)["_id"]
    if not k:
        return rows.select(F.col("_id").alias(id_col), *[F.lit(None).cast(t).alias(c) for c, t in (("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))]).limit(0)
    known, w = min(k, model.rank()), F.col("w")
    error = None
    if known:
        seen = _projected(fit.select(F.lit(None).cast(kind).alias("_id"), "x"), model, k)
        pairs = [(i, j) for i in range(known) for j in range(i, known)]
        found = seen.agg(*[F.covar_pop(F.get(w, i), F.get(w, j)) for i, j in pairs]).first()
        error = max(abs(c - (i == j)) for (i, j), c in zip(pairs, found, strict=True))
    share = [float(v) / model.trace if model.trace else None for v in model.values[:k]]
    share = [v if v is None or i < known else 0.0 for i, v in enumerate(share)]
    out = _projected(rows, model, k).select("_id", "deviation", F.posexplode_outer("w").alias("_c", "whitened"))
    return out.select(
        F.col("_id").alias(id_col), (F.col("_c") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(F.array(*[F.lit(v).cast("double") for v in share]), F.col("_c")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
