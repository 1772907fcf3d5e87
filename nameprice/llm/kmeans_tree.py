"""Approximate nearest neighbours: hierarchical k-means tree, best bin first.

Nearness is the inner product. Vectors get one more component that puts them all
on a sphere whose radius is the largest norm (an exact aggregate), where the
largest inner product is the smallest distance. A tree of k-means splits is fitted
on at most `SAMPLE` vectors; every row descends to its leaf. The number of leaves
follows the number of vectors (`LEAF_ROWS` rows each), up to `SAMPLE / 8`.

A query walks the tree through a priority queue of nodes by distance to their
centres, so leaves come best bin first. How many it visits is calibrated:
`CALIBRATION` queries are compared with brute force over all rows, and visits are
widened until `RECALL` of their true neighbours lie in visited leaves. Queries
meet the rows of a leaf in a cogroup; leaves and their visits are cut into cells
of at most `CELL` rows, so a hot leaf is many tasks. Scores are exact inner
products in double precision.

Equal vectors are indexed once with their k + 1 smallest ids: more can never be
among anybody's k nearest, so a vector that a third of all rows share costs one
row. Equal queries are searched once.

Defined cases: rows with a null vec_id take no part, nor do vectors that are null,
empty, zero, of another length than the most frequent one, or that hold null or
non-finite components. Rows that repeat id and vector count once. Ties go to the
smaller vec_id. Fewer than k candidates are all returned; an empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from nameprice.llm.common import checkpoint, share_package, worker_udf

NEIGHBOURS = 20
SAMPLE = 20_000            # vectors that the tree is fitted on
LEAF_ROWS = 256
BRANCHES = 16
ROUNDS = 8
CALIBRATION = 256          # queries compared with brute force
RECALL = 0.96
CELL = 4096
PART = "qkey long, scores array<double>, ids array<long>"


@dataclass
class Tree:
    """Nodes in arrays: centre, children (empty for a leaf) and leaf number (-1 inside)."""
    centres: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray
    radius: float

    @property
    def leaves(self) -> int:
        return int((self.leaf >= 0).sum())

    def place(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of every row: the nearest child at each level."""
        points = on_sphere(rows, self.radius)
        out = np.zeros(len(points), dtype=np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            if self.leaf[node] >= 0:
                out[at] = self.leaf[node]
                continue
            kids = self.children[node]
            near = distances(points[at], self.centres[kids]).argmin(axis=1)
            todo += [(int(k), at[near == i]) for i, k in enumerate(kids) if (near == i).any()]
        return out

    def best_bins(self, query: np.ndarray) -> Iterator[int]:
        """Leaves in best-bin-first order."""
        size = math.sqrt(float(query @ query))
        point = np.append(query * (self.radius / size), 0.0)[None, :]
        queue: list[tuple[float, int]] = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                yield int(self.leaf[node])
                continue
            kids = self.children[node]
            for d, k in zip(distances(point, self.centres[kids])[0].tolist(), kids.tolist()):
                heapq.heappush(queue, (d, k))


def on_sphere(rows: np.ndarray, radius: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0.0, radius * radius - (rows * rows).sum(axis=1)))
    return np.column_stack([rows, rest])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)


def _kmeans(points: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
    centres = points[random.choice(len(points), k, replace=False)]
    near = np.zeros(len(points), dtype=np.int64)
    for _ in range(ROUNDS):
        near = distances(points, centres).argmin(axis=1)
        for i in range(k):
            own = points[near == i]
            centres[i] = own.mean(axis=0) if len(own) else points[random.integers(len(points))]
    return distances(points, centres).argmin(axis=1)


def fit(rows: np.ndarray, radius: float, leaves: int) -> Tree:
    """Split the sample until nodes hold its share of a leaf."""
    random = np.random.default_rng(7)
    points = on_sphere(rows, radius)
    most = max(1.0, len(points) / max(1, leaves))
    centres, children, leaf, found = [points.mean(axis=0)], [np.zeros(0, int)], [-1], 0
    todo = [(0, np.arange(len(points)))]
    while todo:
        node, at = todo.pop()
        k = min(BRANCHES, math.ceil(len(at) / most), len(np.unique(points[at], axis=0)))
        near = _kmeans(points[at], k, random) if k > 1 and len(at) > 1.5 * most else None
        groups = [] if near is None else [at[near == i] for i in range(k) if (near == i).any()]
        if len(groups) < 2:
            leaf[node], found = found, found + 1
            continue
        kids = []
        for own in groups:
            kids.append(len(centres))
            centres.append(points[own].mean(axis=0))
            children.append(np.zeros(0, int))
            leaf.append(-1)
            todo.append((kids[-1], own))
        children[node] = np.array(kids)
    return Tree(np.array(centres), children, np.array(leaf), radius)


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)
                      & (F.abs(x) != F.lit(float("inf"))))
    rows = vectors.select("vec_id", "embedding").where(
        F.col("vec_id").isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False))
        & F.exists(v, lambda x: x != 0))
    size = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(
        F.desc("count"), "size").first()
    return rows.where(F.size("embedding") == (size["size"] if size else 0)).distinct()


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(embedding, ids): every different vector with its k + 1 smallest ids.

    Ranking below a limit is cut off in every task before the exchange, so a
    vector that many rows share sends few rows.
    """
    order = Window.partitionBy("embedding").orderBy("vec_id")
    return rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1) \
        .groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def top(scores: np.ndarray, ids: list, k: int) -> tuple[list[float], list[int]]:
    """The k best (score, id) of rows with a score and a sorted list of ids each."""
    pairs = [(-s, int(i)) for s, own in zip(scores.tolist(), ids) for i in own[:k]]
    best = heapq.nsmallest(k, pairs)
    return [-s for s, _ in best], [i for _, i in best]


def search(queries: np.ndarray, rows: np.ndarray, ids: list, k: int) -> Iterator[tuple]:
    """For each query its k best (scores, ids) among the rows."""
    for at in range(0, len(queries), 512):
        block = queries[at:at + 512]
        rough = block @ rows.T
        for q, line in zip(block, rough):
            if len(line) > k:
                least = np.partition(line, len(line) - k)[len(line) - k]
                pick = np.nonzero(line >= least - 1e-9 * max(1.0, abs(least)))[0]
            else:
                pick = np.arange(len(line))
            exact = (rows[pick] * q).sum(axis=1)
            yield top(exact, [ids[i] for i in pick], k)


def merged(parts: DataFrame, k: int) -> DataFrame:
    """(qkey, best): the k best of each query's parts, as sorted (far, id) structs."""
    pairs = F.arrays_zip(F.transform("scores", lambda s: -s).alias("far"), F.col("ids").alias("id"))
    return parts.select("qkey", pairs.alias("p")).groupBy("qkey").agg(
        F.slice(F.sort_array(F.flatten(F.collect_list("p"))), 1, k).alias("best"))


def brute_force(index: DataFrame, queries: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    """(qkey, scores, ids) of a bounded list of queries, per task, over all rows."""
    keys = [q for q, _ in queries]
    block = np.stack([v for _, v in queries])

    def scan(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[tuple[list, list]] = [([], []) for _ in keys]
        for batch in batches:
            rows, ids = matrix(batch["embedding"]), list(batch["ids"])
            for i, (scores, found) in enumerate(search(block, rows, ids, k)):
                s, f = best[i]
                best[i] = top(np.array(s + scores), [[x] for x in f + found], k)
        yield pd.DataFrame({"qkey": keys, "scores": [s for s, _ in best],
                            "ids": [f for _, f in best]})

    share_package()
    return index.select("embedding", "ids").mapInPandas(scan, PART)


def calibrated_visits(index: DataFrame, tree: Tree, queries: list[tuple[int, np.ndarray]],
                      k: int, recall: float) -> int:
    """Leaves to visit so that `recall` of the true neighbours are in visited leaves."""
    truth = merged(brute_force(index, queries, k), k).select(
        "qkey", F.explode("best.id").alias("id"))
    homes = index.select("leaf", F.explode("ids").alias("id")).join(truth, "id")
    needed: dict[int, list[int]] = {}
    for r in homes.select("qkey", "leaf").collect():        # CALIBRATION x k rows
        needed.setdefault(r["qkey"], []).append(r["leaf"])
    ranks: list[int] = []
    for qkey, query in queries:
        order = {leaf: i + 1 for i, leaf in enumerate(tree.best_bins(query))}
        ranks += [order[leaf] for leaf in needed.get(qkey, [])]
    if not ranks:
        return 1
    return int(np.sort(ranks)[min(len(ranks) - 1, math.ceil(recall * len(ranks)) - 1)])


def _times(leaf: Column, cells: dict[int, int]) -> Column:
    """Number of cells of a leaf; only leaves with more than one are listed."""
    many = {x: n for x, n in cells.items() if n > 1}
    if not many:
        return F.lit(1)
    listed = F.create_map(*[F.lit(v) for pair in many.items() for v in pair])
    return F.coalesce(F.try_element_at(listed, leaf), F.lit(1))


def nearest(vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS,
            recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for every query row."""
    rows = usable(vectors)
    spark = vectors.sparkSession
    flat = checkpoint(distinct_vectors(rows, k))
    squares = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    size = flat.agg(F.count(F.lit(1)).alias("n"), F.max(squares).alias("m")).first()
    if not size["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = flat.orderBy(F.xxhash64("embedding"), "embedding").limit(SAMPLE).select("embedding").toPandas()
    radius = math.sqrt(size["m"]) * (1 + 1e-9)
    leaves = min(math.ceil(size["n"] / LEAF_ROWS), max(1, SAMPLE // 8))
    tree = fit(matrix(sample["embedding"]), radius, leaves)

    @worker_udf("long")
    def leaf_of(column: pd.Series) -> pd.Series:
        return pd.Series(tree.place(matrix(column)) if len(column) else [], dtype="int64")

    index = checkpoint(flat.withColumn("leaf", leaf_of("embedding")))
    stock = {r["leaf"]: r["n"] for r in index.groupBy("leaf").agg(
        F.count(F.lit(1)).alias("n")).collect()}            # at most SAMPLE / 8 leaves

    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "embedding")
    keyed = asked.groupBy("embedding").agg(F.min("query_id").alias("qkey"))
    chosen = keyed.orderBy(F.xxhash64("embedding"), "qkey").limit(CALIBRATION).toPandas()
    some = [(int(q), np.asarray(v, dtype=np.float64))
            for q, v in zip(chosen["qkey"], chosen["embedding"])]
    visits = calibrated_visits(index, tree, some, k + 1, recall) if some else 1

    @worker_udf("array<long>")
    def leaves_of(column: pd.Series) -> pd.Series:
        out = []
        for query in column:
            seen, held = [], 0
            for leaf in tree.best_bins(np.asarray(query, dtype=np.float64)):
                seen.append(leaf)
                held += stock.get(leaf, 0)
                if len(seen) >= visits and held > k:        # enough leaves and candidates
                    break
            out.append(seen)
        return pd.Series(out)

    walked = checkpoint(keyed.withColumn("leaves", leaves_of("embedding")))
    calls = walked.select("qkey", "embedding", F.explode("leaves").alias("leaf"))
    load = {r["leaf"]: r["n"] for r in calls.groupBy("leaf").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    row_cells = {leaf: math.ceil(n / CELL) for leaf, n in stock.items()}
    call_cells = {leaf: math.ceil(n / CELL) for leaf, n in load.items()}

    def dealt(df: DataFrame, own: dict, other: dict, key: str, names: tuple[str, str]) -> DataFrame:
        """Rows go to one of their own cells and meet every cell of the other side."""
        mine = F.pmod(F.xxhash64(key), _times(F.col("leaf"), own)).cast("int")
        theirs = F.explode(F.sequence(F.lit(0), _times(F.col("leaf"), other) - 1))
        return df.withColumn(names[0], mine).withColumn(names[1], theirs)

    left = dealt(index, row_cells, call_cells, "embedding", ("rc", "cc"))
    right = dealt(calls, call_cells, row_cells, "qkey", ("cc", "rc"))

    def meet(stored: pd.DataFrame, called: pd.DataFrame) -> pd.DataFrame:
        if not len(stored) or not len(called):
            return pd.DataFrame([], columns=["qkey", "scores", "ids"], dtype=object)
        found = list(search(matrix(called["query"]), matrix(stored["embedding"]),
                            list(stored["ids"]), k + 1))
        return pd.DataFrame({"qkey": called["qkey"].to_numpy(), "scores": [s for s, _ in found],
                             "ids": [i for _, i in found]})

    share_package()
    keys = ["leaf", "rc", "cc"]
    asking = right.select(*[F.col(c).alias(f"q_{c}") for c in keys],
                          F.col("embedding").alias("query"), "qkey")
    parts = left.select(*keys, "embedding", "ids").groupBy(*keys).cogroup(
        asking.groupBy(*[f"q_{c}" for c in keys])).applyInPandas(meet, PART)
    # every query row takes its vector's answers, without itself
    answers = merged(parts, k + 1).join(keyed, "qkey").select("embedding", "best")
    own = asked.join(answers, "embedding").select("query_id", F.slice(F.filter(
        "best", lambda b: b["id"] != F.col("query_id")), 1, k).alias("best"))
    return own.select("query_id", F.posexplode("best").alias("rank", "b")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), F.col("b.id").alias("vec_id"),
        (-F.col("b.far")).alias("score"))
