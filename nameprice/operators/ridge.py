"""Ridge regression by preconditioned conjugate gradients on the normal equations.

The fit minimises ||y - Xw - b||^2 + alpha ||w||^2 for several alphas and targets
at once. Rows are packed into sparse blocks once (persisted, spilling to disk); then
every round is one pass over the blocks and one `treeAggregate` of X'(XV) for all open
systems together, so four alphas cost the passes of one. The driver holds vectors of
the feature width alone (width x systems).

Features are centred implicitly, X_c'X_c v = X'(Xv) - n m (m'v), so sparse
rows stay sparse and the intercept is not penalised. The preconditioner solves the
`HEAVY` features with the largest variance exactly (their Gram matrix takes one
pass) and scales all others by their diagonal: engineered counts of very unequal size
stand beside TF-IDF weights, and they are what makes the plain method slow. A system ends
when its residual is below `TOLERANCE` of the right-hand side, never by a round count.

A feature without variance gets the coefficient 0. Rows without a target are not
fitted. A table without rows raises ValueError.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nameprice.session import share_package

HEAVY = 1024               # features solved exactly: 8 MB of sums from a task
TOLERANCE = 1e-10
BLOCK_ROWS = 4096
TASK_ENTRIES = 1 << 24      # entries that one task holds, with 16 bytes for each
TASK_ROWS = 1 << 16         # rows a task is worth, and when cores are left
SPARE_ROWS = 1 << 13
BLOCK = "start binary, place binary, value binary, target binary, n int"


@dataclass(frozen=True)
class Block:
    """Rows in compressed form: entry i of `value` stands in `row[i]` and column `place[i]`."""
    row: np.ndarray
    place: np.ndarray
    value: np.ndarray
    target: np.ndarray                     # rows x targets

    def times(self, v: np.ndarray) -> np.ndarray:
        """Rows times v (width x systems)."""
        n = len(self.target)
        return np.stack([np.bincount(self.row, self.value * c[self.place], n) for c in v.T], axis=1)

    def back(self, u: np.ndarray, width: int) -> np.ndarray:
        """Transposed rows times u (rows x systems)."""
        return np.stack([np.bincount(self.place, self.value * c[self.row], width) for c in u.T], axis=1)


    def times_wide(self, v: np.ndarray) -> np.ndarray:
        """`times` for many systems: a product of small matrices per row."""
        return _products(self.row, self.place, self.value, v, len(self.target))

    def back_wide(self, u: np.ndarray, width: int) -> np.ndarray:
        """`back` for many systems: a product of small matrices per column."""
        short = self.place.astype(np.uint16) if width <= 1 << 16 else self.place   # sorted by digits
        order = np.argsort(short, kind="stable")
        return _products(self.place[order], self.row[order], self.value[order], u, width)


def _products(to: np.ndarray, at: np.ndarray, value: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """(n x systems): row i holds the sum of value * v[at] over the entries with `to` i (ascending)."""
    out = np.zeros((n, v.shape[1]))
    first = np.nonzero(np.diff(to, prepend=-1))[0]
    ends = np.append(first, len(to)).tolist()
    for i, start, end in zip(to[first].tolist(), ends, ends[1:]):
        out[i] = value[start:end] @ v[at[start:end]]
    return out


def entries(vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, place, value) of an Arrow column of unwrapped ML vectors, sparse or dense."""
    kind = vectors.field("type").to_numpy(zero_copy_only=False)
    values = vectors.field("values")
    sizes = np.diff(values.offsets.to_numpy())
    value = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    place = np.zeros(len(value), dtype=np.int32)
    sparse = np.repeat(kind == 0, sizes)
    place[sparse] = vectors.field("indices").flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    place[~sparse] = (np.arange(len(value)) - np.repeat(starts, sizes))[~sparse]
    return np.append(starts, len(value)), place, value


def unwrapped(features: str) -> Column:
    return F.unwrap_udt(F.col(features)).alias("_vector")


def blocks(data: DataFrame, targets: list[Column], features: str = "features"):
    """RDD of Blocks of the rows that have every target, persisted."""
    rows = data.select(unwrapped(features), F.array(*[t.cast("double") for t in targets]).alias("_y")) \
        .where(F.forall("_y", lambda y: y.isNotNull() & ~F.isnan(y)))
    n_targets = len(targets)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                ends, place, value = entries(part.column(0))
                y = part.column(1).flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.tobytes()], pa.binary()) for x in (ends.astype(np.int64), place, value, y)]
                    + [pa.array([part.num_rows], pa.int32())],
                    names=["start", "place", "value", "target", "n"])

    def unpack(r) -> Block:
        ends = np.frombuffer(r["start"], dtype=np.int64)
        return Block(np.repeat(np.arange(r["n"], dtype=np.int32), np.diff(ends)),
                     np.frombuffer(r["place"], dtype=np.int32), np.frombuffer(r["value"], dtype=np.float64),
                     np.frombuffer(r["target"], dtype=np.float64).reshape(r["n"], n_targets))

    share_package()
    count, cores = rows.count(), data.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-count // TASK_ROWS), min(cores, -(-count // SPARE_ROWS)))
    packed = rows.coalesce(tasks).mapInArrow(pack, BLOCK)
    return packed.rdd.map(unpack).persist(StorageLevel.MEMORY_AND_DISK)


def summed(parts, of, shape: tuple[int, ...]) -> np.ndarray:
    """Sum of of(block) over all blocks: partial sums in every partition, then in a tree. Blocks of a
    list are summed here."""
    def add(a, b):
        return b if a is None else a if b is None else a + b
    if isinstance(parts, list):
        return sum((of(b) for b in parts), np.zeros(shape))
    total = parts.treeAggregate(None, lambda acc, block: add(acc, of(block)), add)
    return np.zeros(shape) if total is None else total


@dataclass(frozen=True)
class Moments:
    n: float
    mean: np.ndarray
    square: np.ndarray                     # centred sum of squares of every feature
    y_mean: np.ndarray
    xy: np.ndarray                         # centred X'y (width x targets)


def moments(parts, width: int, n_targets: int) -> Moments:
    def of(b: Block) -> np.ndarray:
        ones = np.ones((len(b.target), 1))
        columns = b.back(np.hstack([ones, b.target]), width)
        squares = np.bincount(b.place, b.value ** 2, width)[:, None]
        ends = np.zeros((1, 2 + n_targets))
        ends[0, 0], ends[0, 2:] = len(b.target), b.target.sum(0)
        return np.vstack([np.hstack([columns[:, :1], squares, columns[:, 1:]]), ends])
    total = summed(parts, of, (width + 1, 2 + n_targets))
    n = total[-1, 0]
    if not n:
        raise ValueError("no rows to fit")
    mean, y_mean = total[:-1, 0] / n, total[-1, 2:] / n
    square = np.maximum(0.0, total[:-1, 1] - n * mean ** 2)
    # differences of rounding size are no variance
    square[square <= 1e-12 * np.maximum(total[:-1, 1], 1e-300)] = 0.0
    return Moments(n, mean, square, y_mean, total[:-1, 2:] - n * np.outer(mean, y_mean))


def _heavy_gram(parts, heavy: np.ndarray, m: Moments) -> np.ndarray:
    """Centred Gram matrix of the heavy features."""
    own = np.full(len(m.mean), -1, dtype=np.int64)
    own[heavy] = np.arange(len(heavy))

    def of(b: Block) -> np.ndarray:
        column = own[b.place]
        dense = np.zeros((len(b.target), len(heavy)))
        dense[b.row[column >= 0], column[column >= 0]] = b.value[column >= 0]
        return dense.T @ dense
    gram = summed(parts, of, (len(heavy), len(heavy)))
    return gram - m.n * np.outer(m.mean[heavy], m.mean[heavy])


class Preconditioner:
    """Exact on the heavy features, the diagonal on all others; one per system."""

    def __init__(self, parts, gram: np.ndarray, heavy: np.ndarray, square: np.ndarray, alphas: np.ndarray):
        self.heavy, self.scale = heavy, 1.0 / (square[:, None] + alphas[None])

        def inverse(a: float) -> np.ndarray:
            return np.linalg.inv(gram + a * np.eye(len(heavy)))
        # one task per system: tasks run linear algebra on one thread, beside each other
        self.solved = [inverse(a) for a in alphas.tolist()] if isinstance(parts, list) else \
            parts.context.parallelize(alphas.tolist(), len(alphas)).map(inverse).collect()

    def apply(self, r: np.ndarray, systems: np.ndarray) -> np.ndarray:
        z = r * self.scale[:, systems]
        for i, s in enumerate(systems):
            z[self.heavy, i] = self.solved[s] @ r[self.heavy, i]
        return z


def solve(parts, width: int, m: Moments, alphas: np.ndarray, rhs: np.ndarray,
          tolerance: float = TOLERANCE) -> tuple[np.ndarray, int]:
    """(coefficients width x systems, rounds): system i has alphas[i] and the column rhs[:, i]."""
    live = m.square > 0
    rhs = np.where(live[:, None], rhs, 0.0)
    heavy = np.sort(np.argsort(-m.square, kind="stable")[:min(HEAVY, width)])
    heavy = heavy[live[heavy]]
    pre = Preconditioner(parts, _heavy_gram(parts, heavy, m), heavy, m.square, alphas)
    w, r = np.zeros_like(rhs), rhs.copy()
    z = pre.apply(r, np.arange(len(alphas)))
    rz = (r * z).sum(0)
    goal, p, rounds = tolerance ** 2 * rz, z.copy(), 0
    while True:
        todo = np.nonzero(rz > goal)[0]
        if not len(todo):
            return w, rounds
        if rounds > 10 * width + 100:          # exact arithmetic needs at most `width`
            raise ArithmeticError(f"no convergence in {rounds} rounds")
        v = p[:, todo]
        product = summed(parts, lambda b: b.back(b.times(v), width), v.shape)
        product = np.where(live[:, None], product - m.n * np.outer(m.mean, m.mean @ v), 0.0) + alphas[todo] * v
        step = rz[todo] / (v * product).sum(0)
        w[:, todo] += step * v
        r[:, todo] -= step * product
        z = pre.apply(r[:, todo], todo)
        new = (r[:, todo] * z).sum(0)
        p[:, todo] = z + new / rz[todo] * v
        rz[todo] = new
        rounds += 1


@dataclass(frozen=True)
class RidgeModel:
    """Coefficients of one or more systems; `transform` adds their predictions."""
    weights: np.ndarray                    # width x systems
    intercepts: np.ndarray
    rounds: int
    features: str = "features"

    @property
    def coefficients(self) -> DenseVector:
        return Vectors.dense(self.weights[:, 0])

    @property
    def intercept(self) -> float:
        return float(self.intercepts[0])

    def predictions(self) -> Column:
        """array<double>: a prediction per system."""
        weights, intercepts = self.weights, self.intercepts

        @F.pandas_udf("array<double>")
        def apply(indices: pd.Series, values: pd.Series) -> pd.Series:
            sizes = np.array([len(v) for v in values])
            if not len(sizes):
                return pd.Series([], dtype=object)
            place = np.concatenate([np.arange(len(v)) if i is None else i for i, v in zip(indices, values)])
            row, value = np.repeat(np.arange(len(sizes)), sizes), np.concatenate(values.to_list())
            found = np.stack([np.bincount(row, value * c[place.astype(np.int64)], len(sizes))
                              for c in weights.T], axis=1)
            return pd.Series(list(found + intercepts))
        vector = F.unwrap_udt(F.col(self.features))
        return apply(vector["indices"], vector["values"])

    def transform(self, data: DataFrame) -> DataFrame:
        return data.withColumn("_pred", self.predictions()[0])


def _solved_alone(parts, width: int, n_targets: int, alphas: np.ndarray, of: np.ndarray, tolerance: float):
    """(moments, coefficients, rounds) with a task for each system that holds all blocks."""
    def one(own: tuple) -> tuple:
        i, found = own
        held = [b for _, b in sorted(found, key=lambda pair: pair[0])]
        m = moments(held, width, n_targets)
        return i, m, *solve(held, width, m, alphas[i:i + 1], m.xy[:, of[i:i + 1]], tolerance)

    systems = range(len(alphas))
    numbered = parts.mapPartitionsWithIndex(lambda p, found: (((p, n), b) for n, b in enumerate(found)))
    copies = numbered.flatMap(lambda pair: [(i, pair) for i in systems]).groupByKey(len(alphas))
    solved = sorted(copies.map(one).collect(), key=lambda s: s[0])
    if not solved:
        raise ValueError("no rows to fit")
    return solved[0][1], np.hstack([w for _, _, w, _ in solved]), max(r for *_, r in solved)


def fit(data: DataFrame, systems: list[tuple[float, Column]], features: str = "features",
        tolerance: float = TOLERANCE) -> RidgeModel:
    """Fit every (alpha, target column) on the rows of `data` that have all targets."""
    names = list(dict.fromkeys(str(t) for _, t in systems))
    targets = [next(t for _, t in systems if str(t) == n) for n in names]
    of = np.array([names.index(str(t)) for _, t in systems])
    alphas = np.array([float(a) for a, _ in systems])
    if (alphas <= 0).any():
        raise ValueError("alpha must be positive")
    parts = blocks(data, targets, features)
    first = data.select(features).first()
    width = first[0].size if first is not None else 0
    if parts.map(lambda b: len(b.value)).sum() <= TASK_ENTRIES:
        m, weights, rounds = _solved_alone(parts, width, len(targets), alphas, of, tolerance)
    else:
        m = moments(parts, width, len(targets))
        weights, rounds = solve(parts, width, m, alphas, m.xy[:, of], tolerance)
    parts.unpersist()
    return RidgeModel(weights, m.y_mean[of] - m.mean @ weights, rounds, features)
