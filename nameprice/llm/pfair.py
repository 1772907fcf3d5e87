"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are cut into blocks of `block_rows` in doc_id order. With
integer weight w of a total W, block i of a source is released at slot
floor(i * W / w) and due at ceil((i + 1) * W / w); in every slot the released
block with the earliest deadline runs. On one processor this schedule exists and
keeps every source, at every prefix, less than one block from its share.

The schedule repeats every W slots, so only one period (W rows, W is bounded by
`resolution` plus the number of sources) is made on the driver; block i of a
source runs in slot (i div w) * W + slot_in_period(i mod w), a join with that
table. A source that has run out leaves its slots unused, so in order of slots the
others go on at their weights to each other, and every document of a weighted source
has a slot. `in_mix` tells the rows before the first slot whose source has no block
left, where the weights of all sources still hold; `keep_mix` keeps all rows, in order
of their slots. (It matches rows by doc_id, source and hashed text; rows repeating all
three share the first one's place.)

Defined cases: a null source is a source of its own (first in tie order). Null
doc_ids sort first; repeated rows are separate documents. `mix` does not read text.
Sources without a weight, or with weight 0, take no part. An empty table gives an
empty mix. More than `MAX_SOURCES` sources raise ValueError (no block schedule can
serve them at this resolution).
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nameprice.llm.common import same, with_positions

BLOCK_ROWS = 16
RESOLUTION = 1000          # target sum of the integer weights
MAX_SOURCES = 100_000


def period(weights: list[int]) -> list[int]:
    """One period of the schedule: the index of the source that runs in each slot."""
    total = sum(weights)
    waiting = [(0, -(-total // w), i, 0) for i, w in enumerate(weights) if w > 0]  # release, due
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, due, i, n = heapq.heappop(waiting)
            heapq.heappush(ready, (due, i, n))
        _, i, n = heapq.heappop(ready)
        out.append(i)
        w, n = weights[i], n + 1
        heapq.heappush(waiting, (n * total // w, -(-(n + 1) * total // w), i, n))
    return out


def tempered_weights(counts: dict, exponent: float = 0.5, resolution: int = RESOLUTION) -> dict:
    """Integer target weights: shares proportional to count ** exponent."""
    whole = sum(n ** exponent for n in counts.values())
    return {s: max(1, int(resolution * n ** exponent / whole + 0.5)) for s, n in counts.items()}


def source_counts(docs: DataFrame) -> dict:
    rows = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return {r["source"]: r["n"] for r in rows}


def mix(docs: DataFrame, weights: dict | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Schedule of every document of a weighted source.

    (doc_id, source, weight, block, idx, release, deadline, slot, in_mix): the
    document is number `idx` of its source's block `block`, which runs in `slot`;
    in_mix tells the rows before the first source runs out.
    """
    return _schedule(docs.select("doc_id", "source"), weights, block_rows)


def _schedule(rows: DataFrame, weights: dict | None, block_rows: int) -> DataFrame:
    """`mix` of rows (doc_id, source, ...); further columns order rows of one doc_id and stay."""
    spark = rows.sparkSession
    more = [c for c in rows.columns if c not in ("doc_id", "source")]
    counts = source_counts(rows)
    weights = tempered_weights(counts) if weights is None else weights
    names = sorted((s for s in counts if weights.get(s, 0) > 0),
                   key=lambda s: (s is not None, s or ""))
    w = [int(weights[s]) for s in names]
    total = sum(w)
    seen = [0] * len(names)
    slots: list[tuple] = []          # (source, weight, index in period, slot in period)
    at: list[list[int]] = [[] for _ in names]
    for slot, i in enumerate(period(w)):
        slots.append((names[i], w[i], seen[i], slot))
        at[i].append(slot)
        seen[i] += 1
    blocks = [-(-counts[s] // block_rows) for s in names]
    # the first slot whose source has nothing left
    end = min(((b // w[i]) * total + at[i][b % w[i]] for i, b in enumerate(blocks)), default=0)
    plan = spark.createDataFrame(
        slots, "p_source string, weight long, p_index long, p_slot long")
    placed = with_positions(rows, ["source"], ["doc_id", *more], "_n").select(
        "doc_id", "source", *more, F.expr(f"_n div {block_rows}").alias("block"),
        (F.col("_n") % block_rows).alias("idx"))
    # `plan` has W rows: bounded by RESOLUTION and the number of sources
    width = F.broadcast(plan.where("p_index = 0").select(F.col("p_source").alias("w_source"),
                                                         F.col("weight").alias("weight")))
    weighted = placed.join(width, same(F.col("source"), F.col("w_source"))).drop("w_source")
    joined = weighted.join(
        F.broadcast(plan.drop("weight")), same(F.col("source"), F.col("p_source"))
        & (F.col("block") % F.col("weight") == F.col("p_index")))
    slot = F.expr(f"(block div weight) * {total} + p_slot")
    return joined.select(
        "doc_id", "source", *more, "weight", "block", "idx",
        F.expr(f"(block * {total}) div weight").alias("release"),
        F.expr(f"((block + 1) * {total} + weight - 1) div weight").alias("deadline"),
        slot.alias("slot"), (slot < F.lit(end)).alias("in_mix"))


def _slotted(docs: DataFrame, weights: dict | None, block_rows: int) -> DataFrame:
    """The rows of `docs` of every weighted source with `__mix_at`, their (slot, idx)."""
    text = F.xxhash64("text")
    placed = _schedule(docs.select("doc_id", "source", text.alias("__mix_text")), weights, block_rows)
    first = placed.groupBy(F.col("doc_id").alias("__mix_doc"), F.col("source").alias("__mix_source"),
                           "__mix_text").agg(F.min(F.struct("slot", "idx")).alias("__mix_at"))
    on = (same(docs.doc_id, F.col("__mix_doc")) & same(docs.source, F.col("__mix_source"))
          & (F.xxhash64(docs.text) == F.col("__mix_text")))
    return docs.join(first, on)


def keep_mix(docs: DataFrame, weights: dict | None = None,
             block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows of `docs` (all columns) of every weighted source, in order of (slot, idx)."""
    return _slotted(docs, weights, block_rows).orderBy("__mix_at").select(*[docs[c] for c in docs.columns])


def with_slots(docs: DataFrame, weights: dict | None = None,
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`docs` with `slot` and `slot_idx`, which carry the order of the mix through files (columns
    of these names are replaced). A function of the rows: `keep_mix` of the same rows orders by it."""
    own = [docs[c] for c in docs.columns if c not in ("slot", "slot_idx")]
    return _slotted(docs, weights, block_rows).select(
        *own, F.col("__mix_at.slot").alias("slot"), F.col("__mix_at.idx").alias("slot_idx"))


def with_places(docs: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`docs`, read from the files that `keep_mix` wrote, with `slot` and `slot_idx` from each row's
    place in those files: a row follows the order in which the mix wrote it, no schedule is
    worked out again and no text is moved. Place p is row p mod `block_rows` of slot p div
    `block_rows`: slots that the mix left unused are closed up. (Columns of these names are
    replaced.)

    Files are numbered by the writing task and the part of its output; the table of them, a row
    per file, is broadcast.
    """
    own = [docs[c] for c in docs.columns if c not in ("slot", "slot_idx")]
    rows = docs.select(*own, F.col("_metadata.file_name").alias("__mix_file"),
                       F.col("_metadata.row_index").alias("__mix_row"))
    name = F.col("__mix_file")
    order = [F.regexp_extract(name, r"^part-(\d+)", 1).cast("long"),
             F.coalesce(F.try_to_number(F.regexp_extract(name, r"-c(\d+)", 1), F.lit("999999999")), F.lit(0)), name]
    sizes = rows.groupBy("__mix_file").agg((F.max("__mix_row") + 1).alias("n"))
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)      # a row per file
    starts = sizes.select(name.alias("__mix_of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__mix_start"))
    placed = rows.join(F.broadcast(starts), name == F.col("__mix_of")).withColumn(
        "__mix_place", F.col("__mix_start") + F.col("__mix_row"))
    return placed.select(*[c for c in docs.columns if c not in ("slot", "slot_idx")],
                         F.expr(f"__mix_place div {block_rows}").alias("slot"),
                         (F.col("__mix_place") % block_rows).alias("slot_idx"))
