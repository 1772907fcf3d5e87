"""Ranked lexical search over a length-stratified index.

A document of n terms has the normaliser m = 10 + (90 n N) div L (N documents with a
term, L terms in all). Documents of equal m form a stratum, stored as segments of at
most `SEGMENT_POSTINGS` postings; a segment's postings are grouped by term and tf:
(m, segment, term, tf, docs). In a stratum the impact of a posting,
(10^9 tf) div (1000 tf + 8 m), depends on tf alone and is computed once per tf.

Building takes two passes. The first cuts texts into terms and writes each document's
distinct terms and frequencies; the second deals the documents out by (m, doc_id) in
one range exchange of `TASK_POSTINGS` postings a task, so that a stratum that holds many
rows spans several tasks and a task's memory does not grow with the corpus, and writes the
segments. Every document with a term is indexed.

A search takes its items in blocks of bounded size (`BLOCK_PAIRS` terms), each against
the whole index. Postings of the block's terms are read once. The bound of a stratum for
an item is the sum of weight times impact at the largest tf in it. First every item's
best strata are searched, which gives each item a least score; then tasks visit all
other segments in descending order of their bounds and stop where the bound falls below the
item's tenth score. The bound is never below a document's score, so results are exact.
Only ten documents per item and task leave a task.

Defined cases: null or empty texts and texts without a term are no documents and never
rank. Rows that repeat a doc_id are documents of their own under the same id. Null
doc_ids come last among equal scores (the index holds them as 2^63 - 1). Items without
a term that the corpus holds have no rows; rows that repeat an item_id form one item
with the terms of all; null item_ids are one item. Equal scores go by ascending doc_id.
Very long texts are cut one at a time. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nameprice.llm.common import checkpoint, release_memory, share_package, shared_folder
from nameprice.llm.tokens import slices, terms

TOP = 10
SEGMENT_POSTINGS = 1 << 18 # postings of a segment (or one document)
TASK_POSTINGS = 1 << 19    # postings that a task of the build is worth
CUT_BYTES = 1 << 20        # texts that a task of the build cuts at once (one text may be longer)
BLOCK_PAIRS = 1 << 18      # (item, term) pairs searched at once
LEAD = 1                   # strata per item that are searched first
BUFFER = 2_000_000         # postings that a task orders by bound at once
NULL_ID = (1 << 63) - 1
SCALE, TF_FACTOR, M_FACTOR = 1_000_000_000, 1000, 8
FORWARD = "doc_id long, n long, terms array<string>, tfs array<int>"
POSTINGS = "m long, segment long, term string, tf int, docs array<long>"


@dataclass(frozen=True)
class Index:
    """Where the postings lie, and the corpus totals."""
    path: str
    n_docs: int
    n_terms: int

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(POSTINGS).parquet(self.path)


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def forward(docs: DataFrame) -> DataFrame:
    """(doc_id, n, terms, tfs): distinct terms of every document that has one."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, CUT_BYTES):
                found = terms(part.column(1))
                if not len(found.ids):
                    continue
                width = len(found.words)
                keys, tfs = np.unique(found.row * width + found.ids, return_counts=True)
                row = keys // width
                have, first = np.unique(row, return_index=True)
                n = np.bincount(found.row, minlength=part.num_rows)[have]
                ends = np.append(first, len(keys)).astype(np.int32)
                words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                                 found.words.take(pa.array(keys % width)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(have)), pa.array(n, pa.int64()), words,
                     _lists(tfs, ends, pa.int32())], names=["doc_id", "n", "terms", "tfs"])
                release_memory()

    share_package()
    return rows.mapInArrow(cut, FORWARD)


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive documents with at most SEGMENT_POSTINGS terms together (or one document)."""
    offsets = batch.column(2).offsets.to_numpy()
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + SEGMENT_POSTINGS, "right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def _segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of documents that come in order of m: a batch is cut into segments."""
    number = TaskContext.get().partitionId() << 33
    for batch in batches:
        for part in _cut(batch):
            doc, m = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            lists = part.column(2)
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            coded = lists.flatten().dictionary_encode()
            term = coded.indices.to_numpy().astype(np.int64)
            tf = part.column(3).flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(part.num_rows), sizes)
            # rows that repeat a doc_id are neighbours; a segment holds each id once
            new = np.append(True, (m[1:] != m[:-1]) | (doc[1:] != doc[:-1]))
            repeat = np.arange(len(m)) - np.maximum.accumulate(np.where(new, np.arange(len(m)), 0))
            stratum = np.cumsum(np.append(0, m[1:] != m[:-1]))
            _, segment = np.unique(stratum * (repeat.max() + 1) + repeat, return_inverse=True)
            order = np.lexsort((doc[row], -tf, term, segment[row]))
            row, term, tf = row[order], term[order], tf[order]
            own = segment[row]
            new = np.append(True, (own[1:] != own[:-1]) | (term[1:] != term[:-1]) | (tf[1:] != tf[:-1]))
            first = np.nonzero(new)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(m[row[first]]), pa.array(number + own[first]),
                 coded.dictionary.take(pa.array(term[first])), pa.array(tf[first], pa.int32()),
                 _lists(doc[row], np.append(first, len(row)), pa.int64())],
                names=["m", "segment", "term", "tf", "docs"])
            number += int(segment.max()) + 1
        release_memory()


def build(docs: DataFrame, folder: str | None = None) -> Index:
    """Index every document of `docs` (doc_id, text) below `folder`."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "stratified")
    forward(docs).write.parquet(f"{folder}/forward")
    cut = spark.read.schema(FORWARD).parquet(f"{folder}/forward")
    total = cut.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms"),
                    F.sum(F.size("tfs")).alias("postings")).first()
    n_docs, n_terms = int(total["docs"]), int(total["terms"] or 0)
    normaliser = F.expr(f"10L + (90L * n * {n_docs}L) div {max(n_terms, 1)}L")
    rows = cut.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), normaliser.alias("m"),
                      "terms", "tfs", F.monotonically_increasing_id().alias("_row"))
    keys = ["m", "doc_id", "_row"]         # the row number splits a doc_id that many rows share
    tasks = max(spark.sparkContext.defaultParallelism, -(-int(total["postings"] or 0) // TASK_POSTINGS))
    placed = rows.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys).drop("_row")
    placed.mapInArrow(_segments, POSTINGS).write.parquet(f"{folder}/postings")
    return Index(f"{folder}/postings", n_docs, n_terms)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of every item."""
    rows = items.select(F.col("item_id").cast("long").alias("doc_id"), "text")
    return forward(rows).select(F.col("doc_id").alias("item_id"), F.explode("terms").alias("term")).distinct()


@dataclass(frozen=True)
class Queries:
    """A block of items in arrays: the terms of item i lie from starts[i] to starts[i + 1]."""
    words: tuple[str, ...]
    starts: np.ndarray
    term: np.ndarray
    weight: np.ndarray


def impacts(tf: np.ndarray, m: int) -> np.ndarray:
    """Unweighted impact of every posting, computed once per tf."""
    each, place = np.unique(tf, return_inverse=True)
    return ((SCALE * each) // (TF_FACTOR * each + M_FACTOR * m))[place]


class Segment:
    """Postings of a block's terms in one segment, ordered by term."""

    def __init__(self, m: int, term: np.ndarray, tf: np.ndarray, docs: np.ndarray, sizes: np.ndarray):
        value = impacts(tf, m)
        self.terms, first = np.unique(term, return_index=True)
        self.peaks = np.maximum.reduceat(value, first)
        self.ends = np.append(0, np.cumsum(np.add.reduceat(sizes, first)))
        self.docs, local = np.unique(docs, return_inverse=True)
        self.local = local.astype(np.int32)
        self.value = np.repeat(value, sizes).astype(np.int32)          # impacts are below 10^6

    def bounds(self, queries: Queries) -> np.ndarray:
        """Largest score that a document of the segment can have, for every item."""
        peak = np.zeros(len(queries.words), dtype=np.int64)
        peak[self.terms] = self.peaks
        return np.add.reduceat(queries.weight * peak[queries.term], queries.starts[:-1])

    def scores(self, term: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Score of every document of the segment (sums stay below 2^53)."""
        at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
        held = self.terms[at] == term
        spans = [(self.ends[i], self.ends[i + 1], w) for i, w in zip(at[held].tolist(), weight[held].tolist())]
        places = np.concatenate([self.local[a:b] for a, b, _ in spans])
        values = np.concatenate([self.value[a:b] * float(w) for a, b, w in spans])
        return np.bincount(places, values, len(self.docs)).astype(np.int64)


class Best:
    """The ten best documents of each item so far, and the score that others must reach."""

    def __init__(self, least: np.ndarray):
        self.least = least.copy()
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, item: int, docs: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= max(1, self.least[item])
        docs, scores = docs[good], scores[good]
        if item in self.found:
            docs = np.concatenate([self.found[item][0], docs])
            scores = np.concatenate([self.found[item][1], scores])
        order = np.lexsort((docs, -scores))[:TOP]
        self.found[item] = docs[order], scores[order]
        if len(order) == TOP:
            self.least[item] = max(self.least[item], scores[order[-1]])


def visit(segments: list[Segment], queries: Queries, best: Best) -> None:
    """Search segments for every item, those of the highest bound first."""
    if not segments:
        return
    bounds = np.stack([s.bounds(queries) for s in segments])
    for item in range(len(queries.starts) - 1):
        own = slice(queries.starts[item], queries.starts[item + 1])
        for i in np.argsort(-bounds[:, item], kind="stable"):
            if bounds[i, item] < max(1, best.least[item]):
                break
            scores = segments[i].scores(queries.term[own], queries.weight[own])
            best.add(item, segments[i].docs, scores)


def _by_segment(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one segment after the other; a segment may span batches."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        number = batch.column("segment").to_numpy()
        cuts = [0, *(np.nonzero(number[1:] != number[:-1])[0] + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if rest and rest[0].column("segment")[0].as_py() != number[a]:
                yield pa.Table.from_batches(rest).combine_chunks()
                rest = []
            rest.append(batch.slice(a, b - a))
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def _searched(hits: DataFrame, queries: Queries, least: np.ndarray) -> DataFrame:
    """(item, doc_id, score): the best documents of each item in every task."""
    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, ready, held = Best(least), [], 0
        for part in _by_segment(batches):
            docs = part.column("docs").chunk(0)
            sizes = np.diff(docs.offsets.to_numpy()).astype(np.int64)
            ready.append(Segment(part.column("m")[0].as_py(), part.column("word").to_numpy(),
                                 part.column("tf").to_numpy().astype(np.int64),
                                 docs.flatten().to_numpy(), sizes))
            held += int(sizes.sum())
            if held > BUFFER:
                visit(ready, queries, best)
                ready, held = [], 0
                release_memory()
        visit(ready, queries, best)
        for item, (docs, scores) in best.found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(docs), item)), pa.array(docs), pa.array(scores)],
                names=["item", "doc_id", "score"])
        release_memory()

    share_package()
    ordered = hits.repartition("m", "segment").sortWithinPartitions("m", "segment", "word") \
        .select("m", "segment", "word", "tf", "docs")
    return ordered.mapInArrow(search, "item long, doc_id long, score long")


def _top(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)


def _search_block(index: Index, pairs: DataFrame, folder: str) -> DataFrame:
    """Results of one block of items; `pairs` is its (item_id, term)."""
    spark = pairs.sparkSession
    asked = sorted(pairs.collect(), key=lambda r: (r["item_id"] is not None, r["item_id"] or 0, r["term"]))
    words = tuple(sorted({r["term"] for r in asked}))
    place = {w: i for i, w in enumerate(words)}
    names = spark.createDataFrame(list(place.items()), "term string, word int")
    # at most BLOCK_PAIRS words, so their table has a bounded size
    index.postings(spark).join(F.broadcast(names), "term").drop("term").write.parquet(folder)
    hits = spark.read.parquet(folder)
    df = {r["word"]: r for r in hits.groupBy("word").agg(F.sum(F.size("docs")).alias("df")).select(
        "word", F.floor(1000 * F.log((2.0 * index.n_docs + 2) / (2.0 * F.col("df") + 1))).alias("w"))
        .collect()}
    ids, starts, term, weight = [], [0], [], []
    for r in asked:
        known = df.get(place[r["term"]])
        if known is None:
            continue
        if not ids or ids[-1] != r["item_id"]:
            if ids:
                starts.append(len(term))
            ids.append(r["item_id"])
        term.append(known["word"])
        weight.append(known["w"])
    starts.append(len(term))
    results = "item_id long, rank int, doc_id long, score long"
    if not ids:
        return spark.createDataFrame([], results)
    queries = Queries(words, np.array(starts), np.array(term), np.array(weight, dtype=np.int64))
    weights = spark.createDataFrame(
        [(i, t, w) for i, (a, b) in enumerate(zip(starts, starts[1:]))
         for t, w in zip(term[a:b], weight[a:b])], "item long, word int, w long")
    peaks = hits.groupBy("m", "word").agg(F.max("tf").alias("tf"))
    impact = F.expr(f"w * (({SCALE}L * tf) div ({TF_FACTOR}L * tf + {M_FACTOR}L * m))")
    bounds = peaks.join(F.broadcast(weights), "word").groupBy("item", "m").agg(
        F.sum(impact).alias("bound"))
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "m")
    # a block has at most BLOCK_PAIRS items, so at most LEAD * BLOCK_PAIRS strata
    lead = checkpoint(bounds.withColumn("i", F.row_number().over(order)).where(F.col("i") <= LEAD)
                      .select("m").distinct())
    none = np.zeros(len(ids), dtype=np.int64)
    first = checkpoint(_top(_searched(hits.join(F.broadcast(lead), "m", "left_semi"), queries, none)))
    least = none.copy()
    for r in first.where(F.col("rank") == TOP).select("item", "score").collect():
        least[r["item"]] = r["score"]
    others = _searched(hits.join(F.broadcast(lead), "m", "left_anti"), queries, least)
    named = spark.createDataFrame(list(enumerate(ids)), "item long, item_id long")
    best = _top(first.drop("rank").unionByName(others)).join(F.broadcast(named), "item")
    return best.select("item_id", "rank", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"),
                       "score")


def search(index: Index, items: DataFrame, folder: str | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): the ten best documents of every item."""
    spark = items.sparkSession
    folder = folder or shared_folder(spark, "stratified-search")
    pairs = checkpoint(item_terms(items))
    blocks = max(1, -(-pairs.count() // BLOCK_PAIRS))
    out = None
    for i in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i)
        found = _search_block(index, own, f"{folder}/hits-{i}")
        out = found if out is None else out.unionByName(found)
    return out
