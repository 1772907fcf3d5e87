"""Vector codes by product quantisation over Hilbert-sorted flat blocks.

Components become integers floor(1024 x); a vector is cut into `PARTS` equal parts and
each part position gets a codebook of `ENTRIES` entries by `ROUNDS` exact k-means rounds,
which start from the vectors with the smallest ids.

The parts of one position are sorted along a Hilbert curve (one range exchange on
position, curve place and row) and stored as flat blocks of up to `BLOCK` neighbours:
their integers, the smallest and largest value per dimension (a box) and their sum. In a
round every block compares its box with the codebook: an entry whose least distance to the
box exceeds some other entry's largest cannot be nearest to any member. The entries that are left form
the block's shortlist. With one entry left the block adds its stored sum and count
without looking at its members; else a small integer kernel compares members with the
shortlist only. Blocks are read where they lie; a round sends at most one row per entry
and task, and the driver holds the codebooks (PARTS x ENTRIES entries) alone.

All arithmetic is exact: products of floats below 2^53 where the box permits it, else
64-bit integers. Boxes only rule out entries that are farther than another one, so ties
still go to the lower index.

Defined cases: vectors that are null or hold null or non-finite components are dropped,
as are empty vectors and those of another length than the first kept one (by vec_id), or
all if that length does not divide into parts. Rows that repeat a vec_id are rows of
their own, ordered by their vectors; null vec_ids come last and keep a row each. Fewer
than `ENTRIES` vectors give as many entries; an entry that nothing uses stays. Scaled
components beyond +-2^26 raise ValueError (distances of 64 bits hold no more). An
empty table gives an empty result and the digest of an empty string would apply to no
row. Extra columns are kept by `encode`, under a prefix of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nameprice.llm.common import checkpoint, share_package

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
BLOCK = 128
KEY_BITS = 62              # bits of the place on the curve
LARGEST = 1 << 26
EXACT = 1 << 53
BLOCKS = ("part int, n int, rows binary, points binary, low array<long>, high array<long>, "
          "total array<long>")
SUMS = "part int, entry int, n long, total array<long>"
CODES = "row long, part int, entry int, error long"


def integers(vector: Column) -> Column:
    """floor(1024 x) of every component as array<long>."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))


def usable(vector: Column) -> Column:
    """True for vectors without null and non-finite components that are not empty."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of every row of a grid with 2^bits cells a side."""
    x = cells.astype(np.uint64).T.copy()
    dims, one = len(x), np.uint64(1)
    for b in range(bits - 1, 0, -1):           # undo the rotations of the outer bits
        bit, below = one << np.uint64(b), (one << np.uint64(b)) - one
        for i in range(dims):
            inside = (x[i] & bit) != 0
            swap = np.where(inside, np.uint64(0), (x[0] ^ x[i]) & below)
            x[0] ^= np.where(inside, below, swap)
            x[i] ^= swap
    for i in range(1, dims):                   # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] & (one << np.uint64(b))) != 0, (one << np.uint64(b)) - one, np.uint64(0))
    x ^= turn
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            place = (place << one) | ((x[i] >> np.uint64(b)) & one)
    return place.astype(np.int64)


@dataclass(frozen=True)
class Grid:
    """Cells of the curve: `bits` a dimension around the mean, over the first `dims` dimensions."""
    low: np.ndarray
    width: np.ndarray
    dims: int
    bits: int

    def places(self, points: np.ndarray) -> np.ndarray:
        side = 1 << self.bits
        cells = np.floor((points[:, :self.dims] - self.low[:self.dims]) / self.width[:self.dims] * side)
        return hilbert(np.clip(cells, 0, side - 1).astype(np.int64), self.bits)


def _matrix(column: pa.Array, kind=np.int64) -> np.ndarray:
    return column.flatten().to_numpy().astype(kind, copy=False).reshape(len(column), -1)


def grids(kept: DataFrame, width: int) -> list[Grid]:
    """A grid per part position, two deviations around the mean of every dimension."""
    def moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(width), np.zeros(width)
        for batch in batches:
            points = _matrix(batch.column(0), np.float64)
            n, total, square = n + len(points), total + points.sum(0), square + (points ** 2).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()]),
                                          pa.array([square.tolist()])], names=["n", "total", "square"])

    found = kept.select("ints").mapInArrow(moments, "n long, total array<double>, square array<double>")
    sums = found.select("n", F.posexplode(F.arrays_zip("total", "square")).alias("i", "z")) \
        .groupBy("i").agg(F.sum("n").alias("n"), F.sum("z.total").alias("t"), F.sum("z.square").alias("s")) \
        .orderBy("i").collect()
    mean = np.array([r["t"] / r["n"] for r in sums])
    spread = np.sqrt(np.maximum(1.0, np.array([r["s"] / r["n"] for r in sums]) - mean ** 2))
    each = width // PARTS
    dims = min(each, KEY_BITS)
    low, size = mean - 2 * spread, 4 * spread
    return [Grid(low[p * each:(p + 1) * each], size[p * each:(p + 1) * each], dims, KEY_BITS // dims)
            for p in range(PARTS)]


def blocks(kept: DataFrame, width: int) -> DataFrame:
    """Flat blocks of all parts (BLOCKS), in the order of the curve."""
    own, each = grids(kept, width), width // PARTS

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch.column(1))
            for p in range(PARTS):
                part = points[:, p * each:(p + 1) * each]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), p), pa.int32()), pa.array(own[p].places(part)),
                     batch.column(0), pa.array([r.tobytes() for r in part.astype("<i4")], pa.binary())],
                    names=["part", "place", "row", "point"])

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column(0).to_numpy()
            starts = np.append(0, np.nonzero(part[1:] != part[:-1])[0] + 1)
            starts = np.concatenate([np.arange(a, b, BLOCK) for a, b in
                                     zip(starts, np.append(starts[1:], len(part)))])
            points = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<i4").reshape(len(part), each)
            rows, ends = batch.column(1).to_numpy(), np.append(starts[1:], len(part))
            pieces = [(points[a:b], rows[a:b]) for a, b in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[starts], pa.int32()), pa.array(ends - starts, pa.int32()),
                 pa.array([r.tobytes() for _, r in pieces], pa.binary()),
                 pa.array([x.tobytes() for x, _ in pieces], pa.binary()),
                 pa.array([x.min(0).tolist() for x, _ in pieces], pa.list_(pa.int64())),
                 pa.array([x.max(0).tolist() for x, _ in pieces], pa.list_(pa.int64())),
                 pa.array([x.sum(0, dtype=np.int64).tolist() for x, _ in pieces], pa.list_(pa.int64()))],
                names=["part", "n", "rows", "points", "low", "high", "total"])

    keys = ["part", "place", "row"]            # the row splits equal vectors over tasks
    sorted_parts = kept.select("row", "ints").mapInArrow(
        placed, "part int, place long, row long, point binary") \
        .repartitionByRange(*keys).sortWithinPartitions(*keys)
    return checkpoint(sorted_parts.select("part", "row", "point").mapInArrow(packed, BLOCKS))


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(blocks x entries) True where an entry may be nearest to a member of the block."""
    under = np.maximum(low[:, None] - entries[None], 0)
    over = np.maximum(entries[None] - high[:, None], 0)
    far = np.maximum(np.abs(entries[None] - low[:, None]), np.abs(entries[None] - high[:, None]))
    least, most = ((under + over) ** 2).sum(2), (far ** 2).sum(2)
    return least <= most.min(axis=1, keepdims=True)


def nearest(points: np.ndarray, entries: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry, ties to the lower index; `reach` bounds
    the components. Floats give exact integers while all sums stay below 2^53."""
    if 4 * reach * reach * points.shape[1] < EXACT:
        a, b = points.astype(np.float64), entries.astype(np.float64)
        away = (a ** 2).sum(1)[:, None] - 2 * (a @ b.T) + (b ** 2).sum(1)[None]
    else:
        away = np.stack([((points.astype(np.int64) - e) ** 2).sum(1) for e in entries], axis=1)
    at = away.argmin(axis=1)
    return at, away[np.arange(len(at)), at].astype(np.int64)


def _assigned(batch: pa.RecordBatch, books: list[np.ndarray], wanted: bool):
    """Per block (part, points, rows, entry indexes, distances, n, sum); where the shortlist
    has one entry and distances are not wanted, points are not unpacked."""
    part, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    low, high, total = (_matrix(batch.column(i)) for i in (4, 5, 6))
    for p in np.unique(part):
        own = np.nonzero(part == p)[0]
        entries, width = books[p], low.shape[1]
        for chunk in np.array_split(own, -(-len(own) // 64)):
            short = shortlists(low[chunk], high[chunk], entries)
            for b, may in zip(chunk, short):
                left = np.nonzero(may)[0]
                if len(left) == 1 and not wanted:
                    yield p, None, None, left, None, int(n[b]), total[b]
                    continue
                points = np.frombuffer(batch.column(3)[b].as_buffer(), "<i4").reshape(-1, width)
                reach = int(max(np.abs(low[b]).max(), np.abs(high[b]).max(), np.abs(entries[left]).max()))
                at, away = nearest(points, entries[left], reach)
                yield p, points, batch.column(2)[b].as_buffer(), left[at], away, int(n[b]), total[b]


def _round(stored: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: floored means, unused entries as before."""
    each = books[0].shape[1]

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((PARTS, len(books[0])), dtype=np.int64)
        total = np.zeros((PARTS, len(books[0]), each), dtype=np.int64)
        for batch in batches:
            for p, points, _, at, _, n, whole in _assigned(batch, books, False):
                if points is None:
                    count[p, at[0]] += n
                    total[p, at[0]] += whole
                else:
                    np.add.at(count[p], at, 1)
                    np.add.at(total[p], at, points)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]),
             pa.array(total[p, e].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    rows = stored.mapInArrow(sums, SUMS).select("part", "entry", "n", F.posexplode("total").alias("i", "x"))
    means = rows.groupBy("part", "entry", "i").agg(F.expr("sum(x)").alias("x"), F.sum("n").alias("n")) \
        .groupBy("part", "entry").agg(F.sort_array(F.collect_list(F.struct("i", "x", "n"))).alias("z"))
    new = [b.copy() for b in books]
    for r in means.collect():                  # one row per entry in use
        new[r["part"]][r["entry"]] = [z["x"] // z["n"] for z in r["z"]]
    return new


@dataclass(frozen=True)
class Codebooks:
    books: list[np.ndarray]

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and position."""
        listed = ",".join(str(x) for book in self.books for x in book.ravel().tolist())
        return hashlib.sha256(listed.encode()).hexdigest()


def _kept(vectors: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """Checkpointed (row, vec_id, ints, own columns) of the rows that take part, and their width."""
    share_package()
    own = [F.col(f"`{c}`").alias(f"own_{c}") for c in vectors.columns if c not in ("vec_id", vector)]
    rows = vectors.where(usable(F.col(vector))).select(
        F.col("vec_id").alias("id"), integers(F.col(vector)).alias("ints"), *own)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "ints").select(F.size("ints").alias("w")).first()
    width = first["w"] if first is not None and first["w"] % PARTS == 0 else 0
    kept = checkpoint(rows.where(F.size("ints") == width))
    largest = kept.agg(F.max(F.greatest(F.abs(F.array_max("ints")), F.abs(F.array_min("ints"))))).first()[0]
    if largest is not None and largest > LARGEST:
        raise ValueError(f"scaled components up to {largest}, more than {LARGEST}")
    return kept.withColumn("row", F.monotonically_increasing_id()), width


def encode(vectors: DataFrame, vector: str = "embedding") -> tuple[DataFrame, Codebooks]:
    """((vec_id, codes array<int>, error, own_* columns), codebooks) of all vectors kept."""
    kept, width = _kept(vectors, vector)
    seeds = kept.orderBy(F.col("id").asc_nulls_last(), "ints").limit(ENTRIES).select("ints").collect()
    each = width // PARTS
    start = np.array([r["ints"] for r in seeds], dtype=np.int64).reshape(len(seeds), width)
    books = [start[:, p * each:(p + 1) * each].copy() for p in range(PARTS)]
    columns = [F.col("id").alias("vec_id"), *[c for c in kept.columns if c.startswith("own_")]]
    if not seeds:
        return kept.select(*columns, F.array().cast("array<int>").alias("codes"),
                           F.lit(0).cast("long").alias("error")), Codebooks(books)
    stored = blocks(kept, width)
    for _ in range(ROUNDS):
        books = _round(stored, books)

    def final(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_assigned(batch, books, True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.frombuffer(f[2], np.int64) for f in found])),
                 pa.array(np.repeat([f[0] for f in found], [len(f[3]) for f in found]), pa.int32()),
                 pa.array(np.concatenate([f[3] for f in found]), pa.int32()),
                 pa.array(np.concatenate([f[4] for f in found]))], names=["row", "part", "entry", "error"])

    codes = stored.mapInArrow(final, CODES).groupBy("row").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("part", "entry"))), lambda c: c["entry"]).alias("codes"),
        F.sum("error").alias("error"))
    return kept.drop("ints").join(codes, "row").select(*columns, "codes", "error"), Codebooks(books)


def decode(codes: Column, books: Codebooks) -> Column:
    """The vector that a code stands for: its entries' centres, scaled back."""
    given = books.books

    @F.pandas_udf("array<double>")
    def centre(lists: pd.Series) -> pd.Series:
        return pd.Series([np.concatenate([given[p][c] for p, c in enumerate(x)]) / SCALE + 0.5 / SCALE
                          for x in lists])
    share_package()
    return centre(codes)
