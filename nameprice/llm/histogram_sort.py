"""Sharding by histogram sort: equal bytes per shard in one global key order.

Splitters are found without moving rows: every round lays probes evenly over the
bracket of each open splitter, counts the exact bytes between probes over all
partitions (partial sums; at most probes x splitters rows reach the driver) and
narrows the bracket, until what is left inside it is within the tolerance. Then
rows are dealt out in one range exchange and numbered.

The order is (doc_id, hash of the text, row number), held in longs whose differences cannot
overflow: doc_id >> 2, doc_id & 3, the hash >> 2 and the number of the row as read. A bracket
that has shrunk to one value of a key goes on in the next one, so a doc_id that holds a large
part of the rows is split by text, and rows that are equal in both by their number.

Defined cases: a null text has size 1 and crc 0, as an empty one. Null doc_ids
sort first. Rows that repeat doc_id and text are dealt out like all others. Very long texts
are one row of their size. Fewer rows than shards leave shards empty; an empty table gives an
empty result. Other columns are ignored by `shard_documents` and kept by `write_shards`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nameprice.llm.common import checkpoint, with_positions

SHARDS = 8
PROBES = 64                # probes per splitter and round
TOLERANCE = 1e-4           # of a shard's ideal bytes
KEYS = ("_k1", "_k2", "_k3", "_k4")
NULL_KEY = -(1 << 61) - 1


def key_columns(doc_id: Column, text: Column) -> list[Column]:
    return [F.coalesce(F.shiftright(doc_id, 2), F.lit(NULL_KEY)).alias(KEYS[0]),
            F.coalesce(doc_id.bitwiseAND(F.lit(3)), F.lit(0)).cast("long").alias(KEYS[1]),
            F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 2).alias(KEYS[2]),
            F.monotonically_increasing_id().alias(KEYS[3])]


def text_size(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


@dataclass
class Bracket:
    """An open splitter: keys before `level` are fixed, the next lies in [low, high)."""
    target: float
    fixed: tuple
    low: int
    high: int
    below: int               # exact bytes of all rows below the bracket
    inside: int              # exact bytes in it

    @property
    def place(self) -> tuple:
        return (self.fixed, self.low, self.high)


def _in(b: Bracket) -> Column:
    cond = F.col(KEYS[len(b.fixed)]).between(b.low, b.high - 1)
    for k, v in zip(KEYS, b.fixed):
        cond = cond & (F.col(k) == F.lit(v))
    return cond


def _narrow(b: Bracket, step: int, sums: dict[int, int]) -> Bracket:
    """The bucket of the bracket in which the target falls."""
    below, inside = b.below, 0
    last = max(sums, default=0)
    for i in sorted(sums):
        inside = sums[i]
        if below + inside > b.target or i == last:
            return Bracket(b.target, b.fixed, b.low + i * step,
                           min(b.high, b.low + (i + 1) * step), below, inside)
        below += inside
    return b


def splitters(keyed: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE,
              probes: int = PROBES) -> list[tuple]:
    """Keys (k1, k2, k3, k4) at which shards 1, 2, ... begin; `keyed` has KEYS and `size`."""
    top = keyed.agg(F.sum("size"), *[f(k) for k in KEYS for f in (F.min, F.max)]).first()
    if top[0] is None:
        return []
    total, ends = int(top[0]), [(int(top[1 + 2 * i]), int(top[2 + 2 * i]) + 1) for i in range(len(KEYS))]
    spare = tolerance * total / shards
    found: dict[int, tuple] = {}
    open_ = {i: Bracket(total * i / shards, (), *ends[0], 0, total) for i in range(1, shards)}
    while open_:
        for i, b in list(open_.items()):
            if b.inside > spare and b.high - b.low <= 1 and len(b.fixed) < len(KEYS) - 1:
                level = len(b.fixed) + 1
                b = open_[i] = Bracket(b.target, (*b.fixed, b.low), *ends[level], b.below, b.inside)
            if b.inside <= spare or b.high - b.low <= 1:
                up = b.below + b.inside - b.target < b.target - b.below   # the nearer edge
                edge = (*b.fixed, b.high if up else b.low)
                found[i] = edge + (NULL_KEY,) * (len(KEYS) - len(edge))
                del open_[i]
        if not open_:
            break
        places = list(dict.fromkeys(b.place for b in open_.values()))
        first = {p: next(b for b in open_.values() if b.place == p) for p in places}
        step = {p: -(-(p[2] - p[1]) // probes) for p in places}
        which, bucket = F.lit(None).cast("int"), F.lit(None).cast("long")
        for n, p in enumerate(places):
            cond = _in(first[p])
            offset = F.expr(f"({KEYS[len(p[0])]} - ({p[1]}L)) div {step[p]}L")
            which = F.when(cond, F.lit(n)).otherwise(which)
            bucket = F.when(cond, offset).otherwise(bucket)
        rows = keyed.select(which.alias("w"), bucket.alias("b"), "size").where("w is not null") \
            .groupBy("w", "b").agg(F.sum("size").alias("s")).collect()
        sums: dict[tuple, dict[int, int]] = {p: {} for p in places}
        for r in rows:
            sums[places[r["w"]]][int(r["b"])] = int(r["s"])
        open_ = {i: _narrow(b, step[b.place], sums[b.place]) for i, b in open_.items()}
    return [found[i] for i in sorted(found)]


def shard_of(cuts: list[tuple]) -> Column:
    """Shard of a row that has KEYS: the number of cuts at or below it."""
    shard = F.lit(0)
    for cut in cuts:
        at = F.col(KEYS[-1]) >= cut[-1]
        for key, value in list(zip(KEYS, cut))[-2::-1]:
            at = (F.col(key) > value) | ((F.col(key) == value) & at)
        shard = shard + at.cast("int")
    return shard


def shard_documents(docs: DataFrame, shards: int = SHARDS,
                    tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): the plan of the shards, without texts."""
    text = F.col("text")
    keyed = checkpoint(docs.select(
        "doc_id", text_size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        *key_columns(F.col("doc_id"), text)))
    dealt = keyed.withColumn("shard", shard_of(splitters(keyed, shards, tolerance)).cast("int"))
    return with_positions(dealt, ["shard"], list(KEYS), "slot").drop(*KEYS)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS,
                 tolerance: float = TOLERANCE) -> list[tuple]:
    """Write the whole rows to path/shard=N as sorted Parquet; returns the splitters."""
    keys = key_columns(F.col("doc_id"), F.col("text"))
    keyed = docs.select(text_size(F.col("text")).alias("size"), *keys)
    cuts = splitters(checkpoint(keyed), shards, tolerance)
    names = [F.col(f"`{c}`") for c in docs.columns if c not in ("shard", *KEYS)]
    (docs.select(*names, *keys).withColumn("shard", shard_of(cuts))
     .repartitionByRange("shard", *KEYS).sortWithinPartitions("shard", *KEYS).drop(*KEYS)
     .write.partitionBy("shard").parquet(path))
    return cuts
