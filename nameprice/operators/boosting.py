"""Gradient boosting by shared rounds: many configurations, one binned matrix.

Dense features are cut into at most `BINS` bins once; the bin numbers, the target, a
held-out flag per configuration and the predictions of every configuration lie side by side in
blocks of rows. All configurations grow together: a step is one pass over the
blocks that counts, for each configuration's open nodes, rows and residuals by feature and
bin. The counts of some `NODES` nodes at a time meet in a task that picks their splits, so
the driver receives a split per node and nothing that grows with bins or rows. The pass
that counts the roots of the next trees also carries the predictions on by the trees just
finished and sums the held-out error. A configuration ends by its own
patience on its held-out rows or at its number of rounds; the others go on. Nothing that was
grown is ever fitted again, and the kept model is the prefix up to the best round.

Trees follow the usual histogram rule for squared error: the gain of a split is
s_l^2 / (n_l + l2) + s_r^2 / (n_r + l2) - s^2 / (n + l2), leaves hold rate * s / (n + l2),
and growth stops at the depth, at the leaf count, at the least rows per leaf or without gain. With a leaf
limit the nodes of a level with the largest gain go first. Rows are sampled per
round by a hash of row id and round, columns per tree by a hash of column and round, so a
retried task draws the same.

A table that one task holds (`TASK_ROWS` rows) is copied to one task per configuration, which
goes through the same steps without an exchange per level. From `BLOCK_ROWS` rows on it counts
the smaller child of every split alone: the sibling is what is left of the parent. Else predictions live in blocks that are persisted (spilling to disk) and
checkpointed into the shared folder every `CHECKPOINT` rounds; a lost executor
recomputes from there. Rows that are not fitted can lie in the blocks too (`fit_predicted`): finished
trees move their predictions on as well, those up to the best round are kept beside them, and the
trees themselves are dropped, so nothing grows with rounds or leaves. Missing feature values (NULL, NaN) have a bin of their own
below all others. Rows without a target are not fitted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nameprice.operators import ridge, sparsebins
from nameprice.operators.sparsebins import SparseBins
from nameprice.session import ensure_checkpoint_dir, share_package

BINS = 32
BLOCK_ROWS = 8192
NODES = 16                 # open nodes whose counts travel together
TASK_ROWS = 1 << 18        # rows that one task holds, and the least it is worth beside others
SPARE_ROWS = 1 << 13
TASK_ENTRIES = 1 << 24     # the same for sparse rows, and for trees that do not need each other
FOREST_ENTRIES = 1 << 26
KEPT_ROWS = 128            # from here on a node's counts are kept for its children,
KEPT_BYTES = 1 << 27       # while they take no more than this
CELLS = 1 << 18            # counts that a task chooses splits from at once
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 16)]))
CHECKPOINT = 25
MIN_GAIN = 1e-12
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class BoostConfig:
    name: str
    rounds: int
    rate: float
    depth: int
    leaves: int | None = None              # None: no limit but the depth
    min_leaf: int = 1
    l2: float = 0.0
    rows: float = 1.0                      # share of the rows that a tree sees
    columns: float = 1.0
    held_share: float = 0.0                # share of the training rows held out
    patience: int | None = None
    bag: bool = False                      # rows drawn with replacement, as in a forest


@dataclass
class Tree:
    """Nodes in arrays; `feature` is -1 in a leaf, a row goes left where its bin <= `cut`."""
    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, gain: float) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.gain[node] = feature, cut, gain
        self.left[node] = len(self.feature)
        for column, empty in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.value, 0.0),
                              (self.gain, 0.0)):
            column.extend([empty, empty])
        return self.left[node], self.left[node] + 1

    def places(self, bins: np.ndarray) -> np.ndarray:
        """Node at which every row (of bins) ends."""
        feature, cut, left = np.array(self.feature), np.array(self.cut), np.array(self.left)
        at = np.zeros(len(bins), dtype=np.int64)
        while True:
            inner = np.nonzero(feature[at] >= 0)[0]
            if not len(inner):
                return at
            node = at[inner]
            at[inner] = left[node] + (_at(bins, inner, feature[node]) > cut[node])

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.places(bins)]


@dataclass(frozen=True)
class Block:
    """Rows with their state: predictions (rows x configurations) and held-out flags; of rows to be
    predicted also whether they are fitted, the predictions of the best rounds, and what is told of them."""
    ids: np.ndarray
    bins: np.ndarray
    target: np.ndarray
    held: np.ndarray
    pred: np.ndarray
    fits: np.ndarray | None = None         # None: all are fitted
    best: np.ndarray | None = None
    told: tuple[pa.RecordBatch, ...] = ()

    @property
    def counted(self) -> np.ndarray:
        """(rows x configurations): whether a configuration's trees are fitted to a row."""
        return ~self.held if self.fits is None else ~self.held & self.fits[:, None]

    def sums(self) -> np.ndarray:
        """Target and number of the rows that each configuration is fitted to."""
        use = self.counted
        return np.stack([(self.target[:, None] * use).sum(0), use.sum(0)])


def _at(bins: np.ndarray | SparseBins, rows: np.ndarray, columns) -> np.ndarray:
    return bins.at(rows, columns) if isinstance(bins, SparseBins) else bins[rows, columns]


def _ends(bins: np.ndarray | SparseBins) -> tuple[np.ndarray, np.ndarray]:
    return bins.ends() if isinstance(bins, SparseBins) else (bins.min(0), bins.max(0))


def _uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on key and salt alone."""
    x = (keys.astype(np.int64).view(np.uint64) + np.uint64(salt + 1)) * GOLDEN
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _salt(name: str, number: int = 0) -> int:
    import zlib
    return zlib.crc32(name.encode()) * 4096 + number


def held_rows(cfg: BoostConfig, ids: np.ndarray) -> np.ndarray:
    return _uniform(ids, _salt(cfg.name, 1)) < cfg.held_share


# ---- binning -------------------------------------------------------------------------

def bin_edges(data: DataFrame, features: str, bins: int = BINS) -> list[np.ndarray]:
    """Ascending upper edges of the bins of every feature: approximate quantiles of the
    distinct sketch values, one aggregate over exploded columns."""
    first = data.select(F.size(features)).first()
    if first is None:
        raise ValueError("no rows to fit")
    width = first[0]
    shares = [i / bins for i in range(1, bins)]
    cells = data.select(F.posexplode(features).alias("i", "x")).where(~F.isnan("x"))
    found = cells.groupBy("i").agg(F.percentile_approx("x", F.lit(shares), 10_000).alias("q")).collect()
    edges = [np.zeros(0)] * width
    for r in found:
        edges[r["i"]] = np.unique(np.array(r["q"], dtype=np.float64))
    return edges


def sparse_edges(data: DataFrame, features: str, bins: int = BINS) -> list[np.ndarray]:
    """Edges for a vector column: 0, and quantiles of a column's other values."""
    first = data.select(features).first()
    if first is None:
        raise ValueError("no rows to fit")
    vector = F.unwrap_udt(F.col(features))
    places = F.coalesce(vector["indices"], F.sequence(F.lit(0), F.size(vector["values"]) - 1))
    shares = [i / (bins - 1) for i in range(1, bins - 1)]
    cells = data.select(F.explode(F.arrays_zip(places.alias("i"), vector["values"].alias("x"))).alias("e")).select("e.*")
    found = cells.where((F.col("x") != 0) & ~F.isnan("x")).groupBy("i").agg(
        F.percentile_approx("x", F.lit(shares), 10_000).alias("q")).collect()
    edges = [np.zeros(1)] * first[0].size
    for r in found:
        edges[r["i"]] = np.unique(np.append(np.array(r["q"], dtype=np.float64), 0.0))
    return edges


def binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin numbers: 0 for a missing value, else 1 + the number of edges below the value."""
    out = np.zeros(values.shape, dtype=np.uint8)
    for i, e in enumerate(edges):
        known = ~np.isnan(values[:, i])
        out[known, i] = 1 + np.searchsorted(e, values[known, i], "left")
    return out


def blocks(data: DataFrame, target: Column, configs: list[BoostConfig], edges: list[np.ndarray],
           features: str, id_col: str, fits: Column | None = None, tell: tuple[str, ...] = ()):
    """RDD of Blocks of all rows with a target, persisted; in one partition without the state of any
    configuration. With `fits` the blocks hold all rows: those where it is true and that have a target
    are fitted, and the columns `tell` stay beside each row."""
    if isinstance(data.schema[features].dataType, VectorUDT):
        return _sparse_blocks(data, target, configs, edges, features, id_col)
    y = target.cast("double")
    known = y.isNotNull() & ~F.isnan(y)
    use = known if fits is None else known & F.coalesce(fits, F.lit(False))
    rows = data.select(F.col(id_col).cast("long").alias("id"), F.col(features).alias("x"),
                       F.when(use, y).alias("y"), *tell)
    if fits is None:
        rows = rows.where(F.col("y").isNotNull())
    width, whole = len(edges), fits is None

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                values = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                found = binned(values.reshape(part.num_rows, width), edges)
                told = part.select(list(range(3, part.num_columns)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a], pa.binary()) for a in
                     (part.column(0).to_numpy(zero_copy_only=False).tobytes(), found.tobytes(),
                      part.column(2).to_numpy(zero_copy_only=False).astype(np.float64).tobytes(), _packed(told))],
                    names=["ids", "bins", "y", "told"])

    def unpack(r) -> Block:
        ids, y = np.frombuffer(r["ids"], dtype=np.int64), np.frombuffer(r["y"], dtype=np.float64)
        bins = np.frombuffer(r["bins"], dtype=np.uint8).reshape(len(ids), width)
        if whole:
            return _block(ids, bins, y, own)
        return _block(ids, bins, np.nan_to_num(y), own, ~np.isnan(y), tuple(pa.ipc.open_stream(r["told"])))

    share_package()
    count, cores = rows.count(), data.sparkSession.sparkContext.defaultParallelism
    tasks = 1 if count <= TASK_ROWS else max(-(-count // TASK_ROWS), min(cores, -(-count // SPARE_ROWS)))
    own = configs if tasks > 1 else []
    packed = rows.coalesce(tasks).mapInArrow(pack, "ids binary, bins binary, y binary, told binary")
    return packed.rdd.mapPartitions(lambda rows: _merged([unpack(r) for r in rows])).persist(
        StorageLevel.MEMORY_AND_DISK)


def _sparse_blocks(data: DataFrame, target: Column, configs: list[BoostConfig], edges: list[np.ndarray],
                   features: str, id_col: str):
    """`blocks` of a vector column; a null id counts as 0."""
    rows = data.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), ridge.unwrapped(features),
                       target.cast("double").alias("y")).where(F.col("y").isNotNull() & ~F.isnan("y"))
    zero = sparsebins.zero_bins(edges)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                b = sparsebins.binned(*ridge.entries(part.column(1)), edges, zero)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a.tobytes()], pa.binary()) for a in
                     (part.column(0).to_numpy(), b.start.astype(np.int64), b.place, b.bin, part.column(2).to_numpy())], names=names)

    def unpack(r) -> Block:
        start, place, found = (np.frombuffer(r[c], dtype=t) for c, t in (
            ("start", np.int64), ("place", np.int32), ("bin", np.uint8)))
        return _block(np.frombuffer(r["ids"], dtype=np.int64), SparseBins(start, place, found, zero),
                      np.frombuffer(r["y"], dtype=np.float64), own)

    names = ["ids", "start", "place", "bin", "y"]
    share_package()
    entries = rows.select(F.coalesce(F.sum(F.size("_vector.values")), F.lit(0))).first()[0]
    most = FOREST_ENTRIES if all(c.rounds == 1 for c in configs) else TASK_ENTRIES
    cores = data.sparkSession.sparkContext.defaultParallelism
    tasks = 1 if entries <= most else max(cores, -(-entries // TASK_ENTRIES))
    own = configs if tasks > 1 else []
    packed = rows.coalesce(tasks).mapInArrow(pack, ", ".join(f"{n} binary" for n in names))
    return packed.rdd.mapPartitions(lambda rows: _merged([unpack(r) for r in rows])).persist(
        StorageLevel.MEMORY_AND_DISK)


def _packed(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _block(ids: np.ndarray, bins: np.ndarray | SparseBins, target: np.ndarray, configs: list[BoostConfig],
           fits: np.ndarray | None = None, told: tuple[pa.RecordBatch, ...] = ()) -> Block:
    """Rows before the first round."""
    held = np.zeros((len(ids), len(configs)), dtype=bool)
    for i, c in enumerate(configs):
        held[:, i] = held_rows(c, ids) if fits is None else held_rows(c, ids) & fits
    pred = np.zeros(held.shape)
    return Block(ids, bins, target, held, pred, fits, None if fits is None else pred, told)


def _merged(blocks: list[Block]) -> list[Block]:
    """The blocks of a task as one (none of none), the bins of a feature side by side."""
    if not blocks:
        return []
    ids, target, held, pred = (np.concatenate([getattr(b, f) for b in blocks])
                               for f in ("ids", "target", "held", "pred"))
    bins = [b.bins for b in blocks]
    if isinstance(bins[0], SparseBins):
        return [Block(ids, sparsebins.merged(bins), target, held, pred)]
    fits, best = (None if blocks[0].fits is None else np.concatenate([getattr(b, f) for b in blocks])
                  for f in ("fits", "best"))
    return [Block(ids, np.asfortranarray(np.concatenate(bins)), target, held, pred, fits, best,
                  tuple(t for b in blocks for t in b.told))]


# ---- one step ------------------------------------------------------------------------

@dataclass
class Growing:
    """A configuration on its way: the tree in work and its open nodes."""
    config: BoostConfig
    index: int
    base: float = 0.0
    keep: bool = True                      # whether finished trees are kept
    trees: list[Tree] = field(default_factory=list)
    grown: int = 0
    errors: list[float] = field(default_factory=list)
    tree: Tree | None = None
    open: list[int] = field(default_factory=list)
    level: int = 0
    leaves: int = 1
    columns: np.ndarray | None = None
    done: bool = False

    def begin(self, width: int) -> None:
        c = self.config
        self.tree, self.open, self.level, self.leaves = Tree(), [0], 0, 1
        if c.columns < 1:
            draw = np.argsort(_uniform(np.arange(width), _salt(c.name, 2 + 2 * self.grown)))
            self.columns = np.sort(draw[:max(1, int(round(c.columns * width)))])
        else:
            self.columns = np.arange(width)

    def best_round(self) -> int:
        """Trees up to the lowest held-out error; all of them without held-out rows."""
        if self.config.patience is None or not self.errors:
            return self.grown
        return int(np.argmin(self.errors)) + 1

    def settle(self, error: float | None) -> None:
        """After a tree is complete and its error is known: go on or end."""
        if error is not None:
            self.errors.append(error)
        c = self.config
        late = c.patience is not None and self.errors and \
            len(self.errors) - 1 - int(np.argmin(self.errors)) >= c.patience
        self.done = late or self.grown >= c.rounds

    def finish(self, width: int) -> Tree:
        """The tree in work, which is complete; the next one is begun."""
        tree = self.tree
        if self.keep:
            self.trees.append(tree)
        self.grown += 1
        self.begin(width)
        return tree


@dataclass(frozen=True)
class Work:
    """What a pass needs of an open configuration: its tree in work and open nodes."""
    config: BoostConfig
    index: int
    number: int
    tree: Tree
    nodes: tuple[int, ...]
    columns: np.ndarray

    @cached_property
    def nodes_set(self) -> frozenset[int]:
        return frozenset(self.nodes)


def _seen(block: Block, work: Work) -> np.ndarray:
    """Whether the tree in work sees a row."""
    use = ~block.held[:, work.index]
    if block.fits is not None:
        use &= block.fits
    if work.config.rows < 1:
        use = use & (_uniform(block.ids, _salt(work.config.name, 3 + 2 * work.number)) < work.config.rows)
    return use


def _drawn(block: Block, work: Work, rows: np.ndarray) -> np.ndarray:
    """`rows` as often as the tree in work draws them."""
    if not work.config.bag:
        return rows
    return np.repeat(rows, np.searchsorted(POISSON, _uniform(block.ids[rows], _salt(work.config.name, 4)), "right"))


def _placed(block: Block, work: Work) -> np.ndarray:
    """Number of the open node in which every row lies that the tree sees, else -1."""
    slot = np.full(len(work.tree.feature), -1)
    slot[list(work.nodes)] = np.arange(len(work.nodes))
    return np.where(_seen(block, work), slot[work.tree.places(block.bins)], -1)


def _cells(bins: np.ndarray, rows: np.ndarray, slot: np.ndarray, nodes: int, residual: np.ndarray,
           columns: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(nodes x 2 x cells): number and residual sum of `rows` by node (`slot`) and bin; the bins of
    column j lie from ends[j] to ends[j + 1]. A column at a time, so that its sums stay in cache."""
    if isinstance(bins, SparseBins):
        return bins.cells(rows, slot, nodes, residual, columns, ends)
    stride = int(np.diff(ends).max())
    out, base = np.empty((nodes, 2, int(ends[-1]))), slot * stride
    for column, start, end in zip(columns.tolist(), ends.tolist(), ends[1:].tolist()):
        cell = base + bins[:, column][rows]
        for part, weights in enumerate((None, residual)):
            out[:, part, start:end] = np.bincount(cell, weights, nodes * stride).reshape(nodes, stride)[:, :end - start]
    return out


def _counted(block: Block, work: Work, slot: np.ndarray, first: int, ends: np.ndarray) -> np.ndarray:
    """`_cells` of up to NODES open nodes from number `first`."""
    nodes = min(NODES, len(work.nodes) - first)
    rows = _drawn(block, work, np.nonzero((slot >= first) & (slot < first + nodes))[0])
    return _cells(block.bins, rows, slot[rows] - first, nodes,
                  block.target[rows] - block.pred[rows, work.index], work.columns, ends)


def _narrowed(work: Work, ends: np.ndarray, kind: np.ndarray) -> tuple[Work, np.ndarray]:
    """Without the columns that cannot be chosen: those of kind -1, which have one value, and those of
    the kind of a column before them, which are equal to it."""
    kinds, first = np.unique(kind[work.columns], return_index=True)
    own = np.sort(first[kinds >= 0])
    own = own if len(own) else np.zeros(1, dtype=np.int64)
    return replace(work, columns=work.columns[own]), np.append(0, np.cumsum(np.diff(ends)[own]))


def _splits(cells: np.ndarray, work: Work, ends: np.ndarray) -> np.ndarray:
    """Per node (gain, column, bin, rows, sum, rows left, sum left) of its best split."""
    c, starts = work.config, ends[:-1]
    left = cells.cumsum(axis=2)
    whole = left[:, :, ends[1] - 1].copy()
    before = np.zeros((len(cells), 2, len(starts)))
    before[:, :, 1:] = left[:, :, starts[1:] - 1]
    left -= np.repeat(before, np.diff(ends), axis=2)
    n, total = left[:, 0], left[:, 1]
    rest_n, gain, least = whole[:, :1] - n, total * total, max(1, c.min_leaf)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain /= n + c.l2
        rest = whole[:, 1:] - total
        rest *= rest
        rest /= rest_n + c.l2
        gain += rest
        gain -= (whole[:, 1] ** 2 / (whole[:, 0] + c.l2))[:, None]
    gain[(n < least) | (rest_n < least)] = -np.inf
    best, each = gain.argmax(axis=1), np.arange(len(cells))
    column = np.searchsorted(ends, best, "right") - 1
    return np.stack([gain[each, best], work.columns[column], best - starts[column],
                     whole[:, 0], whole[:, 1], n[each, best], total[each, best]], axis=1)


def _count_blocks(blocks: list[Block], work: list[Work], ends: list[np.ndarray],
                  with_errors: bool) -> Iterator[tuple]:
    """((configuration, first node), counts of up to NODES nodes) and the held-out errors."""
    if not blocks:
        return
    for i, (w, e) in enumerate(zip(work, ends)):
        slots = [_placed(b, w) for b in blocks]
        for first in range(0, len(w.nodes), NODES):
            yield (i, first), sum(_counted(b, w, s, first, e) for b, s in zip(blocks, slots))
    if with_errors:
        yield (-1, 0), sum(_errors(b) for b in blocks)


def _picked(pair: tuple, work: list[Work], ends: list[np.ndarray]) -> tuple:
    (i, at), cells = pair
    return i, at, cells if i < 0 else _splits(cells, work[i], ends[i])


class Spread:
    """Blocks over many tasks: counts of the same nodes meet in a shuffle."""

    def __init__(self, parts):
        self.parts, self.step = parts, 0
        low, high = parts.map(lambda b: _ends(b.bins)).reduce(
            lambda a, b: (np.minimum(a[0], b[0]), np.maximum(a[1], b[1])))
        self.kind = np.where(low < high, np.arange(len(low)), -1)

    def advance(self, change) -> None:
        old, self.parts = self.parts, self.parts.map(change).persist(StorageLevel.MEMORY_AND_DISK)
        if self.step % CHECKPOINT == 0:
            self.parts.checkpoint()
        self.step += 1
        self.parts.foreach(lambda block: None)
        old.unpersist()

    def found(self, work: list[Work], ends: list[np.ndarray], with_errors: bool) -> list[tuple]:
        work, ends = zip(*[_narrowed(w, e, self.kind) for w, e in zip(work, ends)]) if work else ((), ())
        counted = self.parts.mapPartitions(lambda blocks: _count_blocks(list(blocks), work, ends, with_errors))
        return counted.reduceByKey(lambda a, b: a + b).map(lambda p: _picked(p, work, ends)).collect()


class Together:
    """Rows that one task holds: the same steps without an exchange, for one configuration."""

    def __init__(self, blocks: list[Block]):
        self.block, = _merged(sorted(blocks, key=lambda b: b.ids[0]))
        self.rows: dict[int, np.ndarray] = {}      # of the tree in work, by open node
        self.cells: dict[int, np.ndarray] = {}     # counts of the open nodes of KEPT_ROWS rows or more
        self.kind: np.ndarray | None = None

    def advance(self, change) -> None:
        self.block = change(self.block)

    def found(self, work: list[Work], ends: list[np.ndarray], with_errors: bool) -> list[tuple]:
        if len(self.block.ids) <= BLOCK_ROWS:
            return [_picked(p, work, ends) for p in _count_blocks([self.block], work, ends, with_errors)]
        errors = [(-1, 0, _errors(self.block))] if with_errors else []
        return errors + [(i, 0, self._level(w, e)) for i, (w, e) in enumerate(zip(work, ends))]

    def _kinds(self) -> np.ndarray:
        """By column: -1 with one value only, else the number of the first column equal to it."""
        if self.kind is None and isinstance(self.block.bins, SparseBins):
            low, high = self.block.bins.ends()
            self.kind = np.where(low < high, np.arange(len(low)), -1)
        elif self.kind is None:
            seen: dict[bytes, int] = {}
            columns = self.block.bins.T
            self.kind = np.array([-1 if c.min() == c.max() else seen.setdefault(
                hashlib.sha256(c.tobytes()).digest(), i) for i, c in enumerate(columns)])
        return self.kind

    def _level(self, work: Work, ends: np.ndarray) -> np.ndarray:
        """Best splits of the open nodes."""
        work, ends = _narrowed(work, ends, self._kinds())
        best: dict[int, np.ndarray] = {}
        residual = self.block.target - self.block.pred[:, work.index]
        if work.nodes == (0,):
            split = [(None, [_drawn(self.block, work, np.nonzero(_seen(self.block, work))[0])], [0])]
            rows, cells = {}, {}
        else:
            rows, cells, split = self.rows, self.cells, self._children(work)
        self.rows, self.cells = {}, {}
        # counting the rows of a node costs less where rows are sparse
        least = KEPT_ROWS * (4 if isinstance(self.block.bins, SparseBins) else 1)
        kept_most, step = KEPT_BYTES // (16 * int(ends[-1])), max(2, min(256, CELLS // int(ends[-1])))
        for at in range(0, len(split), step):
            own = split[at:at + step]
            # of both children of a node with kept counts the smaller one is counted
            todo = [(n, r) for parent, parts, nodes in own for n, r in self._todo(parent in cells, parts, nodes)]
            sizes = [len(r) for _, r in todo]
            among = np.concatenate([r for _, r in todo])
            counted = dict(zip((n for n, _ in todo), _cells(
                self.block.bins, among, np.repeat(np.arange(len(todo)), sizes), len(todo), residual[among],
                work.columns, ends)))
            opened = []
            for parent, parts, nodes in own:
                for n, r in zip(nodes, parts):
                    if n not in work.nodes_set:
                        continue
                    if n not in counted:
                        counted[n] = cells[parent] - counted[nodes[0] + nodes[1] - n]
                    opened.append(n)
                    self.rows[n] = r
                    if len(r) >= least and len(self.cells) < kept_most:
                        self.cells[n] = counted[n].copy()
                rows.pop(parent, None), cells.pop(parent, None)
            if opened:
                best |= zip(opened, _splits(np.stack([counted[n] for n in opened]), work, ends))
        return np.stack([best[n] for n in work.nodes])

    def _children(self, work: Work) -> list[tuple]:
        """(node, rows of its children, children) of the nodes split last that have an open child."""
        out, tree = [], work.tree
        for node, rows in self.rows.items():
            left = tree.left[node]
            if tree.feature[node] < 0 or not {left, left + 1} & work.nodes_set:
                continue
            right = _at(self.block.bins, rows, tree.feature[node]) > tree.cut[node]
            out.append((node, [rows[~right], rows[right]], [left, left + 1]))
        return out

    @staticmethod
    def _todo(kept: bool, parts: list[np.ndarray], nodes: list[int]) -> list[tuple]:
        pairs = sorted(zip(nodes, parts), key=lambda p: len(p[1]))
        return pairs[:1] if kept else pairs


def _pass(state: Spread | Together, work: list[Work], sizes: np.ndarray, with_errors: bool):
    """({configuration: splits of its open nodes}, held-out errors): one pass over the blocks."""
    ends = [np.append(0, np.cumsum(sizes[w.columns])) for w in work]
    found = sorted(state.found(work, ends, with_errors), key=lambda r: r[:2])
    errors = next((r[2] for r in found if r[0] < 0), None)
    splits = {w.index: np.concatenate([r[2] for r in found if r[0] == i]) for i, w in enumerate(work)}
    return splits, errors


def _carried(block: Block, finished: list[tuple[int, Tree]], best: list[int]) -> Block:
    """The block with the finished trees added to its predictions; those of `best` are kept before."""
    pred, kept = block.pred.copy(), block.best
    if kept is not None and best:
        kept = kept.copy()
        kept[:, best] = pred[:, best]
    for index, tree in finished:
        pred[:, index] += tree.predict(block.bins)
    return replace(block, pred=pred, best=kept)


def _errors(block: Block) -> np.ndarray:
    """(2 x configurations): squared held-out errors and held-out rows."""
    away = (block.target[:, None] - block.pred) ** 2
    return np.stack([(away * block.held).sum(0), block.held.sum(0).astype(float)])


def _choose(g: Growing, splits: np.ndarray) -> None:
    """Split or close the open nodes of a configuration."""
    c, least, following = g.config, max(1, g.config.min_leaf), []

    def value(n: float, total: float) -> float:
        return c.rate * total / max(n + c.l2, 1e-12)

    for node, row in zip(g.open, splits):
        g.tree.value[node] = value(row[3], row[4])
    for i in np.argsort(-splits[:, 0], kind="stable"):
        gain, column, cut, n, total, left_n, left_sum = splits[i]
        if not gain > MIN_GAIN * max(1.0, abs(total)) or (c.leaves is not None and g.leaves >= c.leaves):
            continue
        children = g.tree.split(g.open[i], int(column), int(cut), float(gain))
        for child, cn, cs in zip(children, (left_n, n - left_n), (left_sum, total - left_sum)):
            g.tree.value[child] = value(cn, cs)
            if cn >= 2 * least:
                following.append(child)
        g.leaves += 1
    g.level += 1
    # children that can no longer be split stay as they are
    full = g.level >= c.depth or (c.leaves is not None and g.leaves >= c.leaves)
    g.open = [] if full else following


@dataclass(frozen=True)
class BoostModel:
    config: BoostConfig
    base: float
    trees: list[Tree]
    errors: list[float]                    # held-out error after every round grown
    edges: list[np.ndarray]
    features: str
    sparse: bool = False                   # a vector column, not array<double>

    def of_bins(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for tree in self.trees:
            out += tree.predict(bins)
        return out

    def gains(self) -> np.ndarray:
        """Total gain of every feature over all splits, as a share."""
        out = np.zeros(len(self.edges))
        for tree in self.trees:
            for f, g in zip(tree.feature, tree.gain):
                if f >= 0:
                    out[f] += g
        return out / out.sum() if out.sum() else out


def predictions(models: list[BoostModel]) -> Column:
    """array<double>: the prediction of every model (all of one fit: bins are shared)."""
    first = models[0]
    if first.sparse:
        return _sparse_predictions(models)

    @F.pandas_udf("array<double>")
    def apply(rows: pd.Series) -> pd.Series:
        if not len(rows):
            return pd.Series([], dtype=object)
        bins = binned(np.stack(rows.to_list()).astype(np.float64), first.edges)
        return pd.Series(list(np.stack([m.of_bins(bins) for m in models], axis=1)))
    share_package()
    return apply(F.col(first.features))


def _sparse_predictions(models: list[BoostModel]) -> Column:
    edges, zero = models[0].edges, sparsebins.zero_bins(models[0].edges)

    @F.pandas_udf("array<double>")
    def apply(indices: pd.Series, values: pd.Series) -> pd.Series:
        if not len(values):
            return pd.Series([], dtype=object)
        start = np.append(0, np.cumsum([len(v) for v in values]))
        place = np.concatenate([np.arange(len(v)) if i is None else i for i, v in zip(indices, values)]).astype(np.int32)
        bins = sparsebins.binned(start, place, np.concatenate(values.to_list()).astype(np.float64), edges, zero)
        return pd.Series(list(np.stack([m.of_bins(bins) for m in models], axis=1)))
    share_package()
    vector = F.unwrap_udt(F.col(models[0].features))
    return apply(vector["indices"], vector["values"])


def _alone(own: tuple, configs: list[BoostConfig], tasks: int, sizes: np.ndarray, keep: bool) -> Iterator[tuple]:
    """(number, grown, block) of every `tasks`-th configuration, over the blocks of all rows."""
    first, found = own
    block, = _merged(sorted(found, key=lambda b: b.ids[0]))
    for i in _longest_first(configs)[first::tasks]:
        one = _block(block.ids, block.bins, block.target, configs[i:i + 1], block.fits, block.told)
        total, n = one.sums()
        state = Together([one])
        grown = _rounds(state, configs[i:i + 1], total / np.maximum(n, 1), sizes, keep=keep)[0]
        yield i, grown, state.block


@dataclass(frozen=True)
class Rounds:
    """What is known of a configuration whose trees were dropped: trees kept, and the held-out error
    after every round grown."""
    config: BoostConfig
    kept: int
    errors: list[float]


def fit(data: DataFrame, target: Column, configs: list[BoostConfig], features: str = "dense",
        id_col: str = "product_id") -> list[BoostModel]:
    """Grow all configurations on the rows of `data` with a target; `features` is array<double> or a vector.

    The bins come from all rows; held-out rows are those of each configuration's hash.
    """
    ensure_checkpoint_dir(data.sparkSession)
    sparse = isinstance(data.schema[features].dataType, VectorUDT)
    edges = sparse_edges(data, features) if sparse else bin_edges(data, features)
    sizes = np.array([len(e) + 2 for e in edges])
    state = blocks(data, target, configs, edges, features, id_col)
    if state.isEmpty():
        raise ValueError("no rows to fit")
    if state.getNumPartitions() == 1:
        alone = _copies(state, configs, sizes, True).map(lambda found: found[:2])
        grown = [g for _, g in sorted(alone.collect(), key=lambda pair: pair[0])]
    else:
        spread, grown = _shared(state, configs, sizes, True)
        spread.parts.unpersist()
    state.unpersist()
    return [BoostModel(g.config, g.base, g.trees[:g.best_round()], g.errors, edges, features, sparse) for g in grown]


def fit_predicted(data: DataFrame, target: Column, fits: Column, configs: list[BoostConfig], tell: list[str],
                  features: str = "dense", id_col: str = "product_id") -> tuple[DataFrame, list[Rounds]]:
    """`fit` on the rows where `fits` is true, and the predictions of every row of `data`: (the columns
    `tell`, number of the configuration `m`, prediction `p`), checkpointed. `features` is array<double>.

    The trees stay where they grow and are dropped once the rows have moved on by them.
    """
    ensure_checkpoint_dir(data.sparkSession)
    edges = bin_edges(data.where(fits), features)
    sizes = np.array([len(e) + 2 for e in edges])
    state = blocks(data, target, configs, edges, features, id_col, fits, tuple(tell))
    if not state.map(lambda b: bool(b.fits.any())).fold(False, lambda a, b: a or b):
        raise ValueError("no rows to fit")
    if state.getNumPartitions() == 1:
        def told(found: tuple) -> list:
            i, g, block = found
            return [(i, g), *_predictions(block, [i])]
        # read twice, by the driver for the rounds and for the rows
        done = _copies(state, configs, sizes, False).flatMap(told).persist(StorageLevel.MEMORY_AND_DISK)
        done.checkpoint()
        grown = [g for _, g in sorted(done.filter(lambda r: isinstance(r, tuple)).collect(), key=lambda r: r[0])]
        chunks = done.filter(lambda r: isinstance(r, bytes))
    else:
        spread, grown = _shared(state, configs, sizes, False)
        done, chunks = spread.parts, spread.parts.flatMap(lambda b: _predictions(b, range(len(configs))))
    kinds = data.select(*tell).schema.add("m", "integer").add("p", "double")

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                yield from pa.ipc.open_stream(chunk)
    rows = data.sparkSession.createDataFrame(chunks.map(lambda c: (c,)), "c binary").mapInArrow(unpack, kinds)
    rows = rows.checkpoint()
    done.unpersist()
    state.unpersist()
    return rows, [Rounds(g.config, g.best_round(), g.errors) for g in grown]


def _predictions(block: Block, numbers: Iterable[int]) -> Iterator[bytes]:
    """Arrow streams of the rows' told columns, number of the configuration and prediction."""
    for column, i in enumerate(numbers):
        at = 0
        for told in block.told:
            p = block.best[at:at + told.num_rows, column]
            at += told.num_rows
            yield _packed(pa.RecordBatch.from_arrays(
                [*told.columns, pa.array(np.full(len(p), i, dtype=np.int32)), pa.array(p)],
                names=[*told.schema.names, "m", "p"]))


def _longest_first(configs: list[BoostConfig]) -> list[int]:
    """Numbers of the configurations; tasks begin in their order, so that the long ones do not begin last."""
    return sorted(range(len(configs)), key=lambda i: -configs[i].rounds * min(configs[i].depth, configs[i].leaves or 1 << 30))


def _copies(state, configs: list[BoostConfig], sizes: np.ndarray, keep: bool):
    """RDD of what `_alone` gives of every configuration, from a copy of all rows for each task."""
    tasks = min(len(configs), max(16, state.context.defaultParallelism))
    copies = state.flatMap(lambda b: [(i, b) for i in range(tasks)]).groupByKey(tasks)
    return copies.flatMap(lambda own: _alone(own, configs, tasks, sizes, keep))


def _shared(state, configs: list[BoostConfig], sizes: np.ndarray, keep: bool) -> tuple[Spread, list[Growing]]:
    """All configurations grown over the blocks of many tasks."""
    total, n = state.map(Block.sums).treeReduce(lambda a, b: a + b)
    spread = Spread(state)
    return spread, _rounds(spread, configs, total / np.maximum(n, 1), sizes, keep=keep)


def _rounds(state: Spread | Together, configs: list[BoostConfig], base: np.ndarray,
            sizes: np.ndarray, only: int | None = None, keep: bool = True) -> list[Growing]:
    """Grow all configurations (or one of them) round by round until each has ended."""
    grow = [Growing(c, i, float(base[i]), keep) for i, c in enumerate(configs) if only in (None, i)]
    for g in grow:
        g.begin(len(sizes))
    change, first = (lambda b: replace(b, pred=b.pred + base)), True
    while active := [g for g in grow if not g.done]:
        state.advance(change)
        splits, errors = _pass(state, _work(active), sizes, True)
        best = []
        for g in () if first else active:      # the trees of the round before are in the errors now
            held = errors[1, g.index]
            g.settle(float(errors[0, g.index] / held) if held else None)
            if g.best_round() == g.grown:
                best.append(g.index)
        active, first = [g for g in active if not g.done], False
        while opened := [g for g in active if g.open]:
            if splits is None:
                splits, _ = _pass(state, _work(opened), sizes, False)
            for g in opened:
                _choose(g, splits[g.index])
            splits = None
        finished = [(g.index, g.finish(len(sizes))) for g in active]
        change = lambda b, f=finished, k=best: _carried(b, f, k)
    if not keep:
        state.advance(change)                  # the best rounds of those that ended last
    return grow


def _work(grow: list[Growing]) -> list[Work]:
    return [Work(g.config, g.index, g.grown, g.tree, tuple(g.open), g.columns) for g in grow]


def permutation_errors(model: BoostModel, data: DataFrame, target: Column) -> np.ndarray:
    """Rise of the mean absolute error for every feature when its values are dealt out anew.

    Rows are put in a hashed order in blocks of `BLOCK_ROWS`; a feature's bins are moved on by
    a hashed number of places inside a block, which gives each row the value of another random
    row. Only features that a tree uses are tried, and only the trees that use a feature are asked
    again. One pass; a task sends one row of sums.
    """
    used = sorted({f for t in model.trees for f in t.feature if f >= 0})
    width = len(model.edges)
    rows = data.select(F.col(model.features).alias("x"), target.cast("double").alias("y")).where("y is not null") \
        .withColumn("o", F.xxhash64("x", "y"))
    tasks = max(1, -(-rows.count() // BLOCK_ROWS))
    mixed = rows.repartition(tasks, "o").sortWithinPartitions("o")
    users = {f: [i for i, t in enumerate(model.trees) if f in t.feature] for f in used}

    def away(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 + len(used))
        n = 0
        for batch in batches:
            values = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            bins, y = binned(values.reshape(batch.num_rows, width), model.edges), batch.column(1).to_numpy()
            each = np.array([t.predict(bins) for t in model.trees]).reshape(len(model.trees), len(y))
            whole = model.base + each.sum(axis=0)
            sums[0] += np.abs(y - whole).sum()
            for i, f in enumerate(used):
                kept = bins[:, f].copy()
                bins[:, f] = np.roll(kept, 1 + _salt(str(f)) % max(1, len(y) - 1))
                change = sum(model.trees[t].predict(bins) - each[t] for t in users[f])
                sums[1 + i] += np.abs(y - whole - change).sum()
                bins[:, f] = kept
            n += len(y)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sums.tolist()])], names=["n", "sums"])

    share_package()
    found = mixed.select("x", "y").mapInArrow(away, "n long, sums array<double>").collect()
    n, total = sum(r["n"] for r in found), np.sum([r["sums"] for r in found], axis=0)
    out = np.zeros(width)
    if n:
        out[used] = (total[1:] - total[0]) / n
    return out
