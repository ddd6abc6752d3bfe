"""Embedding whitening by spectrum slicing.

Vectors become whole numbers x = floor(scale * c) + offset. One pass over the table gives their number, exact sums and
centred scatter: each Arrow batch is centred on its own mean before multiplying, and partials are merged exactly in the
means (sums are whole numbers) and in the order of the partitions, so that reruns agree. What reaches the driver is a few
partials of one matrix, however many rows there are.

The driver then slices the spectrum of the covariance V. An LDL' factorisation of V - s with complete pivoting has as many
positive pivots as V has eigenvalues above s (Sylvester), so bisection by counts puts each leading eigenvalue into an
interval of its own. Rayleigh quotient iteration from the middle of the interval converges cubically to its vector, and
two counts just beside the value certify its number. Values that no count can part (equal up to rounding) share an
interval and get an orthonormal basis.

Rows whose vector is null, empty or holds null or non-finite entries are dropped. Where lengths differ, the most frequent
one among the others counts (of equally frequent ones the longest) and vectors of other lengths are dropped too. Entries
beyond 2^52 / scale count as that limit. Rows with null or repeated identifiers are rows like others. Components without
variance (eigenvalue at rounding level) are left out, so equal vectors, one vector or an empty table give no rows.
Columns other than the two that are named play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

EPS = np.finfo(np.float64).eps
LIMIT = float(1 << 52)
FAN = 32  # partials that are merged in one group


# Factorisation and counts -------------------------------------------------------------------------------------------


class Factor:
    """P (A - s I) P' = L D L' with diagonal blocks of size 1 and 2, pivots chosen from the whole remainder."""

    def __init__(self, a: np.ndarray, shift: float):
        n = len(a)
        least = max(np.abs(a).max(initial=0.0), abs(shift), 1e-150) * EPS / 8
        a = a - shift * np.eye(n)
        self.perm, self.lower, self.blocks, self.positive = np.arange(n), np.eye(n), [], 0
        k = 0
        while k < n:
            rest = np.abs(a[k:, k:])
            diagonal = np.diagonal(rest)
            r = int(diagonal.argmax())
            top = diagonal[r]
            p, q = divmod(int(rest.argmax()), n - k)
            if p == q or top >= 0.6404 * rest[p, q]:
                self._swap(a, k, k + r)
                pivot = a[k, k] if abs(a[k, k]) > least else np.copysign(least, a[k, k])
                column = a[k + 1 :, k] / pivot
                a[k + 1 :, k + 1 :] -= np.outer(column, a[k, k + 1 :])
                self.lower[k + 1 :, k] = column
                self.blocks.append((k, 1, pivot))
                self.positive += bool(pivot > 0)
                k += 1
            else:
                p, q = sorted((p, q))
                self._swap(a, k, k + p)
                self._swap(a, k + 1, k + q)
                block = a[k : k + 2, k : k + 2].copy()
                below = a[k + 2 :, k : k + 2].copy()
                columns = below @ np.linalg.inv(block)
                a[k + 2 :, k + 2 :] -= columns @ below.T
                self.lower[k + 2 :, k : k + 2] = columns
                self.blocks.append((k, 2, block))
                self.positive += 1  # such a block has one positive and one negative eigenvalue
                k += 2

    def _swap(self, a: np.ndarray, i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]
            self.perm[[i, j]] = self.perm[[j, i]]
            done = min(i, j)
            self.lower[[i, j], :done] = self.lower[[j, i], :done]

    def solve(self, b: np.ndarray) -> np.ndarray:
        y = b[self.perm].copy()
        for i in range(1, len(y)):
            y[i] -= self.lower[i, :i] @ y[:i]
        for k, size, block in self.blocks:
            y[k : k + size] = y[k] / block if size == 1 else np.linalg.solve(block, y[k : k + 2])
        for i in range(len(y) - 2, -1, -1):
            y[i] -= self.lower[i + 1 :, i] @ y[i + 1 :]
        out = np.empty_like(y)
        out[self.perm] = y
        return out


def above(a: np.ndarray, shift: float) -> int:
    """Number of eigenvalues above the shift."""
    return Factor(a, shift).positive


def _iterated(a: np.ndarray, norm: float, low: float, high: float, found: list[np.ndarray], seed: int) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration from the middle of (low, high), orthogonal to what is found; None if it leaves the interval."""
    basis = np.array(found)

    def unit(v):
        for _ in range(2 if found else 0):
            v = v - basis.T @ (basis @ v)
        return v / np.linalg.norm(v)

    middle = Factor(a, (low + high) / 2)
    v = unit(np.random.default_rng(seed).normal(size=len(a)))
    for _ in range(3):
        v = unit(middle.solve(v))
    slack, best = 4 * len(a) * EPS * norm, None
    for _ in range(12):
        value = float(v @ a @ v)
        rest = float(np.linalg.norm(a @ v - value * v))
        if best is not None and rest >= best[0]:
            break
        best = rest, value, v
        if not low - slack <= value <= high + slack:
            return None
        v = unit(Factor(a, value).solve(v))
    rest, value, v = best
    return (value, v) if rest <= 64 * slack else None


def leading(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues of a symmetric matrix in falling order and their unit vectors as rows.

    At most wanted ones; values at rounding level of the largest are left out.
    """
    n = len(a)
    norm = float(np.abs(a).sum(1).max(initial=0.0))
    if n == 0 or norm == 0.0:
        return np.zeros(0), np.zeros((0, n))
    tight = 16 * n * EPS * norm
    values, vectors = [], []
    # Intervals (low, high] with the numbers of eigenvalues above either end, the highest interval on top.
    todo = [(tight, norm * (1 + 8 * EPS) + tight, above(a, tight), 0)]
    while todo and len(values) < wanted:
        low, high, many, few = todo.pop()
        if many <= few:
            continue
        pair = None
        if many - few == 1 or high - low <= tight:
            pair = _iterated(a, norm, low, high, vectors, seed=len(values))
        if pair is None and high - low > tight:
            middle = (low + high) / 2
            count = min(max(above(a, middle), few), many)
            todo += [(low, middle, many, count), (middle, high, count, few)]
            continue
        if pair is None:
            raise ArithmeticError("Rayleigh quotient iteration did not converge")
        values.append(pair[0])
        vectors.append(pair[1])
        if many - few > 1:  # the next one of values that no count can part
            todo.append((low, high, many, few + 1))
    for i, value in enumerate(values):
        if not (above(a, value + tight) <= i and above(a, value - tight) >= i + 1):
            raise ArithmeticError(f"eigenvalue {i + 1} is not certified by counts")
    order = np.argsort(-np.array(values), kind="stable")
    out = np.array(vectors).reshape(-1, n)[order]
    signs = [np.sign(v[np.abs(v).argmax()]) for v in out]
    return np.array(values)[order], out * np.reshape(signs, (-1, 1))


# Passes over the table ----------------------------------------------------------------------------------------------


def _numbers(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length of vectors in the batch: the length, the rows' places and floor(scale * c), finite rows only."""
    lists = batch.column("vector")
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == size)
        flat = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
        good = np.isfinite(flat).all(axis=1)
        if good.any():
            yield int(size), at[good], np.clip(np.floor(scale * flat[good]), -LIMIT, LIMIT)


@dataclass
class Scatter:
    """Number, exact sums (Python integers) and centred scatter of rows of whole numbers."""

    n: int
    sums: list[int]
    scatter: np.ndarray

    @classmethod
    def of(cls, u: np.ndarray) -> "Scatter":
        sums = u.astype(np.int64).sum(0) if np.abs(u).max() * len(u) < 2**62 else u.astype(np.int64).astype(object).sum(0)
        sums = [int(s) for s in sums]
        centred = u - np.array([s / len(u) for s in sums])
        return cls(len(u), sums, centred.T @ centred)

    def plus(self, other: "Scatter") -> "Scatter":
        if not self.n:
            return other
        gap = np.array([(b * self.n - a * other.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums)])
        n = self.n + other.n
        return Scatter(n, [a + b for a, b in zip(self.sums, other.sums)], self.scatter + other.scatter + np.outer(gap, gap) * (self.n / n * other.n))


PARTIAL = "part long, dims int, n long, sums array<string>, scatter array<double>"


def _partial(part: int, dims: int, s: Scatter) -> dict:
    return {"part": part, "dims": dims, "n": s.n, "sums": [str(x) for x in s.sums], "scatter": s.scatter.ravel()}


def _scatter(row) -> Scatter:
    dims = int(row["dims"])
    return Scatter(int(row["n"]), [int(x) for x in row["sums"]], np.asarray(row["scatter"], dtype=np.float64).reshape(dims, dims))


def _merged(partials: DataFrame) -> list[tuple[int, Scatter]]:
    """(length, scatter) for each length. Groups of FAN neighbouring partials are merged on Spark, twice, the rest here."""
    import pandas as pd

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part", kind="stable")
        total = Scatter(0, [], np.zeros(0))
        for row in group.to_dict("records"):
            total = total.plus(_scatter(row))
        return pd.DataFrame([_partial(int(group["part"].iloc[0]) // FAN, int(group["dims"].iloc[0]), total)])

    for _ in range(2):
        partials = partials.groupBy("dims", F.floor(F.col("part") / FAN).alias("group")).applyInPandas(lambda key, g: merge(g), PARTIAL)
    out: dict[int, Scatter] = {}
    for row in sorted(partials.collect(), key=lambda r: (r["dims"], r["part"])):
        out[row["dims"]] = out.get(row["dims"], Scatter(0, [], np.zeros(0))).plus(_scatter(row))
    return sorted(out.items())


def _vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return table.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))


@dataclass
class Whitening:
    """A fitted whitening: number of vectors, exact sums, trace and leading eigenpairs of the covariance."""

    n: int
    dims: int
    scale: float
    offset: int
    sums: list[int]  # of floor(scale * c), without the offset
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float = 0.0

    def centred(self, u: np.ndarray) -> np.ndarray:
        """x minus its mean; the whole part of the mean is taken off exactly."""
        whole = [s // self.n for s in self.sums]
        part = [(s - w * self.n) / self.n for s, w in zip(self.sums, whole)]
        return (u - np.array(whole, dtype=np.float64)) - np.array(part)

    def project(self, u: np.ndarray) -> np.ndarray:
        return (self.centred(u) @ self.vectors.T) / np.sqrt(self.values)

    def deviations(self, u: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)^2, exact."""
        whole = [s // self.n for s in self.sums]
        rest = [s - w * self.n for s, w in zip(self.sums, whole)]
        most = (max(float(np.abs(u).max(initial=0.0)), max(map(abs, whole), default=0)) * 2 + 1) * self.n
        kind = np.int64 if self.dims * most**2 < 2**62 else object
        gaps = self.n * (u.astype(np.int64).astype(kind) - np.array(whole, dtype=kind)) - np.array(rest, dtype=kind)
        return [int(x) for x in (gaps * gaps).sum(1)]


def fit(table: DataFrame, components: int = 32, scale: float = 64.0, offset: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> Whitening | None:
    """Fits on every usable row of the table; None if there is none. Driver: d x d matrices, time d^3 a count."""

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Scatter] = {}
        part = None
        for batch in batches:
            if batch.num_rows and part is None:
                part = batch.column("part")[0].as_py()
            for size, _, u in _numbers(batch, scale):
                found[size] = found.get(size, Scatter(0, [], np.zeros(0))).plus(Scatter.of(u))
        for size, s in found.items():
            yield pa.RecordBatch.from_pylist([_partial(part, size, s) | {"scatter": s.scatter.ravel().tolist()}], schema=SCHEMA)

    rows = _vectors(table, id_col, vector_col).select(F.spark_partition_id().cast("long").alias("part"), "vector")
    sizes = _merged(rows.mapInArrow(scatter, PARTIAL))
    if not sizes:
        return None
    dims, s = max(sizes, key=lambda x: (x[1].n, x[0]))
    v = s.scatter / s.n
    v = (v + v.T) / 2
    values, vectors = leading(v, components)
    model = Whitening(s.n, dims, scale, offset, s.sums, float(np.trace(v)), values, vectors)
    model.identity_error = _identity_error(table, model, id_col, vector_col)
    return model


SCHEMA = pa.schema([("part", pa.int64()), ("dims", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("scatter", pa.list_(pa.float64()))])
MOMENTS = "part long, n long, mean array<double>, scatter array<double>"
MOMENTS_SCHEMA = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("scatter", pa.list_(pa.float64()))])


def _plus(a, b):
    """Moments (n, mean, scatter) of two sets of rows together."""
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] / n * b[0])


def _identity_error(table: DataFrame, model: Whitening, id_col: str, vector_col: str) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over all rows of the fit."""
    import pandas as pd

    k = len(model.values)
    if not k:
        return 0.0

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = None, None
        for batch in batches:
            if batch.num_rows and part is None:
                part = batch.column("part")[0].as_py()
            for size, _, u in _numbers(batch, model.scale):
                if size == model.dims:
                    z = model.project(u)
                    mean = z.mean(0)
                    own = len(z), mean, (z - mean).T @ (z - mean)
                    total = own if total is None else _plus(total, own)
        if total:
            yield pa.RecordBatch.from_pylist([{"part": part, "n": total[0], "mean": total[1].tolist(), "scatter": total[2].ravel().tolist()}], schema=MOMENTS_SCHEMA)

    def merged(rows):
        total = None
        for r in rows:
            own = int(r["n"]), np.asarray(r["mean"], dtype=np.float64), np.asarray(r["scatter"], dtype=np.float64).reshape(k, k)
            total = own if total is None else _plus(total, own)
        return total

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        n, mean, scatter = merged(group.sort_values("part", kind="stable").to_dict("records"))
        return pd.DataFrame([{"part": int(group["part"].iloc[0]) // FAN, "n": n, "mean": mean, "scatter": scatter.ravel()}])

    rows = _vectors(table, id_col, vector_col).select(F.spark_partition_id().cast("long").alias("part"), "vector").mapInArrow(moments, MOMENTS)
    for _ in range(2):
        rows = rows.groupBy(F.floor(F.col("part") / FAN).alias("group")).applyInPandas(lambda key, g: merge(g), MOMENTS)
    n, _, scatter = merged(sorted(rows.collect(), key=lambda r: r["part"]))
    return float(np.abs(scatter / n - np.eye(k)).max())


def whiten(table: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each usable row and component: the identifier, component, n, deviation, whitened, explained, identity_error.

    deviation is a decimal as its exact value outgrows a long with the table; over 38 digits it is null.
    """
    source = _vectors(table, id_col, vector_col)
    kind = source.schema["id"].dataType.simpleString()
    columns = f"{id_col} {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return table.sparkSession.createDataFrame([], columns)
    k = len(model.values)
    explained = model.values / model.trace

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, at, u in _numbers(batch, model.scale):
                if size != model.dims:
                    continue
                times = np.repeat(np.arange(len(at)), k)
                deviations = [d if d < 10**38 else None for d in model.deviations(u)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(pa.array(at[times])),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                        pa.array(np.full(len(times), model.n)),
                        _decimals(deviations).take(pa.array(times)),
                        pa.array(model.project(u).ravel()),
                        pa.array(np.tile(explained, len(at))),
                        pa.array(np.full(len(times), model.identity_error)),
                    ],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return source.mapInArrow(rows, columns)


def _decimals(numbers: list[int | None]) -> pa.Array:
    from decimal import Context, Decimal

    exact = Context(prec=38)
    return pa.array([None if x is None else exact.create_decimal(x) for x in numbers], type=pa.decimal128(38, 0))


def whitened(table: DataFrame, **options) -> DataFrame:
    """Fits on the table and whitens it."""
    return whiten(table, fit(table, **options), **{k: v for k, v in options.items() if k in ("id_col", "vector_col")})
