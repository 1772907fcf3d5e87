"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, one of toxic and one of ordinary texts, are counted over all rows that
may be learned from. A class c gives a word w behind v the probability

    P_c(w | v) = max(n_c(v w) - D, 0) / n_c(v) + D * t_c(v) / n_c(v) * P_c(w)
    P_c(w)     = max(s_c(w) - D, 0) / S_c + D * T_c / S_c * P(w)
    P(w)       = (s(w) + 1) / (S + W + 1)

n are counts of bigrams, t_c(v) the number of different words behind v, s_c(w) the number of
different words before w (continuation counts) with sum S_c over T_c words; s, S and W are
the same over both classes together: the backoff counts that both models share, so an
expression that one class has never seen is judged by how the corpus as a whole uses it.
A text's evidence is its log-likelihood ratio divided by its number of words, spread
around 0. Two numbers,
scale and offset, turn evidence into a score: a logistic fit on the histogram of the
evidence of one fold of the training rows, from which nothing is counted.

Counting is distributed: tasks send one row per distinct bigram, and continuation counts
are aggregates of the bigram table, which grows with the corpus. Copies of a text add
nothing to continuation counts. What tasks receive is pruned, as usual for n-gram
models: a class keeps its own figure for a word or bigram only where the classes
differ clearly, by a log-likelihood statistic of at least `CLEAR` and a factor of at least
`FACTOR`. All other words share one distribution, to which what is left of a class is given
in proportion, so that a text's language or subject says nothing about its
class. Counts and totals come from the whole table.

Every clear word and bigram counts. Up to `MODEL_WORDS` words and `MODEL_PAIRS` bigrams go to
the tasks as arrays (`Model`). Beyond that nothing is left out: a text's ratio is the sum of what
its words, the words before them and its bigrams add, so their figures stay a table (`Weights`)
that the texts' words and bigrams meet in a shuffled join; of those, tasks send only the ones whose
bit is set in a bitmap of the listed keys, which has a fixed size.

Words are those of tokens.py. Learning reads labels of rows whose crc32(doc_id as text)
mod 5 is not 0; the fold with remainder 4 fits scale and offset. Rows that repeat a doc_id
in the labels count as one, toxic if any of them is; null labels and null doc_ids teach
nothing.

Defined cases: a null or empty text, or one without a word, has evidence 0 and the training
rows' share of toxic labels as its score. Without training rows of both classes every
score is that share (0 without any). Texts of any length are scored whole; repeated rows
alike. Null doc_ids are not held out. An empty table gives an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nameprice.llm.common import checkpoint, share_package, shared_folder
from nameprice.llm.tokens import slices, terms

FOLDS, HELD_OUT, TUNING = 5, 0, 4
DISCOUNT = 0.75
MODEL_WORDS, MODEL_PAIRS = 1 << 17, 1 << 17
CLEAR, FACTOR = 20.0, 2.0
START = 1                  # word before the first one
ANY = 2                    # in a word's place: any word
BIT_KEYS = 26              # bits of a key that choose its place in the bitmap: 8 MB
SPREAD = 50.0              # evidence is fitted as asinh(SPREAD x): steep around 0, tame far out
BINS, REACH = 800, 8.0     # histogram of the spread evidence
BROADCAST_LABELS = 2_000_000
BUFFER = 2_000_000         # bigrams that a task holds before it sends their counts
MIX = np.uint64(0x9E3779B97F4A7C15)
PAIRS = "v long, w long, toxic long, plain long"


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == HELD_OUT, F.lit(False))


def word_hashes(words: pa.StringArray) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words.to_pylist()], dtype=np.uint64).view(np.int64)


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One 64-bit key of each bigram."""
    x = v.view(np.uint64) * MIX ^ (w.view(np.uint64) + (v.view(np.uint64) >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(30))).view(np.int64)


def bigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, v, w) of every word of a column behind the word before it."""
    found = terms(texts)
    w = word_hashes(found.words)[found.ids]
    v = np.full_like(w, START)
    v[1:] = np.where(found.row[1:] == found.row[:-1], w[:-1], START)
    return found.row, v, w


def known_labels(labels: DataFrame) -> DataFrame:
    """(label_id, toxic) of every labelled doc_id; a few of them go to where the texts are, beyond
    that the texts meet them in a shuffled join."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(
        F.col("doc_id").alias("label_id")).agg((F.max("toxic") > 0).alias("toxic"))
    return F.broadcast(known) if known.count() <= BROADCAST_LABELS else known


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(fold, text, toxic) of labelled rows outside the held-out fold."""
    known = known_labels(labels)
    return docs.select("doc_id", "text").where(~held_out(F.col("doc_id"))).join(known, F.col("doc_id") == F.col("label_id")).select(
        fold(F.col("doc_id")).cast("int").alias("fold"), "text", "toxic")


def count_bigrams(rows: DataFrame) -> DataFrame:
    """(v, w, toxic, plain): how often each bigram occurs in texts of either class."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0

        def sent() -> pa.RecordBatch:
            v, w, t = (np.concatenate(x) for x in zip(*kept))
            order = np.lexsort((w, v))
            v, w, t = v[order], w[order], t[order]
            first = np.nonzero(np.append(True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])))[0]
            toxic, every = np.add.reduceat(t, first), np.diff(np.append(first, len(v)))
            return pa.RecordBatch.from_arrays(
                [pa.array(v[first]), pa.array(w[first]), pa.array(toxic), pa.array(every - toxic)],
                names=["v", "w", "toxic", "plain"])

        for batch in batches:
            for part in slices(batch, 0):
                row, v, w = bigrams(part.column(0))
                kept.append((v, w, part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)[row]))
                held += len(v)
                if held >= BUFFER:
                    yield sent()
                    kept, held = [], 0
        if held:
            yield sent()

    share_package()
    return rows.select("text", "toxic").mapInArrow(count, PAIRS).groupBy("v", "w").agg(
        F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))


def _clear(toxic: str, plain: str, totals: tuple[int, int]) -> Column:
    """Log-likelihood statistic of two counts against their class totals; 0 where the classes
    do not differ clearly."""
    t, p, n = F.col(toxic), F.col(plain), float(sum(totals))
    both = F.greatest(t + p, F.lit(1))
    statistic = 2 * (t * F.log(F.greatest(t, F.lit(1e-9)) * n / (both * totals[0]))
                     + p * F.log(F.greatest(p, F.lit(1e-9)) * n / (both * totals[1])))
    ratio = ((t + 0.5) / (totals[0] + 1.0)) / ((p + 0.5) / (totals[1] + 1.0))
    return F.when((statistic >= CLEAR) & ((ratio >= FACTOR) | (ratio <= 1 / FACTOR)), statistic) \
        .otherwise(F.lit(0.0))


def _listed(rows: DataFrame, strength: Column, most: int) -> list | None:
    """Rows of a strength above 0, on the driver; None if they are more than `most`."""
    clear = rows.where(strength > 0)
    return clear.collect() if clear.count() <= most else None


@dataclass(frozen=True)
class Model:
    """Listed words and bigrams as sorted keys; two columns of figures, toxic and ordinary."""
    words: np.ndarray
    lower: np.ndarray          # P_c(w) of a listed word
    rest: np.ndarray           # what a class leaves to the distribution of all other words
    first: np.ndarray          # words before a listed bigram
    backoff: np.ndarray        # what they leave to P_c(w)
    pairs: np.ndarray
    upper: np.ndarray          # discounted share of a listed bigram
    scale: float = 1.0
    offset: float = 0.0
    share: float = 0.0

    def ratios(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Log of toxic over ordinary probability of every bigram."""
        def at(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
            place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            return np.where(keys[place] == wanted, place, -1) if len(keys) else np.full(len(wanted), -1)

        def of(figures: np.ndarray, place: np.ndarray, other) -> np.ndarray:
            return np.where(place >= 0, figures[:, place], other) if figures.shape[1] else \
                np.broadcast_to(other, (2, len(place)))
        # any word that is not listed has the same shared probability in both classes
        lower = of(self.lower, at(self.words, w), self.rest)
        p = of(self.upper, at(self.pairs, pair_keys(v, w)), np.zeros((2, 1))) \
            + of(self.backoff, at(self.first, v), np.ones((2, 1))) * lower
        return np.log(p[0] / p[1])

    def evidence(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(spread length-normalised log-likelihood ratio, number of words) of every text."""
        row, v, w = bigrams(texts)
        n = np.bincount(row, minlength=len(texts))
        total = np.bincount(row, self.ratios(v, w), len(texts)) if len(row) else np.zeros(len(texts))
        return np.arcsinh(SPREAD * total / np.maximum(n, 1)), n

    def scores(self, texts: pa.Array) -> np.ndarray:
        found, n = self.evidence(texts)
        return np.where(n > 0, 1 / (1 + np.exp(-np.clip(self.scale * found + self.offset, -500, 500))),
                        self.share)


def _summary(table: DataFrame) -> dict:
    """Totals of the bigram table: tokens, bigrams and words by class and together."""
    t, p = F.col("toxic") > 0, F.col("plain") > 0
    words = table.groupBy("w").agg(F.count_if(t).alias("st"), F.count_if(p).alias("sp"))
    row = table.agg(F.count_if(t).alias("S_t"), F.count_if(p).alias("S_p"), F.count(F.lit(1)).alias("S"),
                    F.sum("toxic").alias("n_t"), F.sum("plain").alias("n_p")).first().asDict()
    row |= words.agg(F.count_if(F.col("st") > 0).alias("T_t"), F.count_if(F.col("sp") > 0).alias("T_p"),
                     F.count(F.lit(1)).alias("W")).first().asDict()
    return {k: int(v or 0) for k, v in row.items()}


@dataclass(frozen=True)
class Weights:
    """What every listed word, word before a listed bigram and listed bigram adds to the ratio of a
    text beyond `common` a word: a table (v, w, weight) with ANY for a word that does not matter."""
    table: DataFrame
    common: float
    listed: np.ndarray         # bitmap of the keys of `table`
    scale: float = 1.0
    offset: float = 0.0
    share: float = 0.0

    def evidence(self, docs: DataFrame) -> DataFrame:
        """(doc_id, found, n): as Model.evidence, a row per row of `docs` (doc_id, text)."""
        listed = self.listed

        def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, 2):
                    own = part.column(0).to_numpy()
                    row, v, w = bigrams(part.column(2))
                    some = np.full_like(v, ANY)
                    row, v, w = np.tile(row, 3), np.concatenate([v, some, v]), np.concatenate([w, w, some])
                    n = np.bincount(row, minlength=len(own)) // 3
                    kept = _bits(listed, v, w)
                    row, v, w = row[kept], v[kept], w[kept]
                    order = np.lexsort((w, v, row))
                    row, v, w = row[order], v[order], w[order]
                    new = np.ones(len(row), dtype=bool)
                    new[1:] = (row[1:] != row[:-1]) | (v[1:] != v[:-1]) | (w[1:] != w[:-1])
                    first = np.nonzero(new)[0]
                    times = np.diff(np.append(first, len(row)))
                    none = pa.nulls(len(first), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own), part.column(1), pa.array(n), *[pa.nulls(len(own), pa.int64())] * 3], names=names)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[row[first]]), none, none, pa.array(v[first]), pa.array(w[first]), pa.array(times)],
                        names=names)

        names = ["row", "doc_id", "n", "v", "w", "times"]
        share_package()
        rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
        met = rows.mapInArrow(count, ", ".join(f"{c} long" for c in names)).join(self.table, ["v", "w"], "left")
        sums = met.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n").alias("n"),
                                      F.coalesce(F.sum(F.col("times") * F.col("weight")), F.lit(0.0)).alias("more"))
        total = F.col("n") * F.lit(self.common) + F.col("more")
        return sums.select("doc_id", F.asinh(SPREAD * total / F.greatest("n", F.lit(1))).alias("found"), "n")

    def scored(self, docs: DataFrame) -> DataFrame:
        """(doc_id, score) of every row of `docs`."""
        x = F.least(F.greatest(self.scale * F.col("found") + self.offset, F.lit(-500.0)), F.lit(500.0))
        return self.evidence(docs).select("doc_id", F.when(F.col("n") > 0, 1 / (1 + F.exp(-x))).otherwise(
            F.lit(float(self.share))).alias("score"))

    def evidence_counts(self, docs: DataFrame, known: DataFrame) -> np.ndarray:
        """`evidence_counts` of the rows of `docs` with a label in `known` (label_id, toxic)."""
        place = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("found") + REACH) / (2 * REACH) * BINS)))
        rows = self.evidence(docs).where("n > 0").join(known, F.col("doc_id") == F.col("label_id"))
        out = np.zeros((2, BINS))
        for r in rows.groupBy(F.col("toxic").cast("int").alias("toxic"), place.cast("int").alias("bin")).count().collect():
            out[r["toxic"], r["bin"]] = r["count"]
        return out


def _places(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return pair_keys(v, w).view(np.uint64) >> np.uint64(64 - BIT_KEYS)


def _bits(bitmap: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    at = _places(v, w)
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _bitmap(table: DataFrame) -> np.ndarray:
    """Bits of the keys (v, w) of a table: a bitmap a task, joined in a tree."""
    def bits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(1 << BIT_KEYS, dtype=bool)
        for batch in batches:
            found[_places(batch.column(0).to_numpy(), batch.column(1).to_numpy())] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(found, bitorder="little").tobytes()])], names=["bits"])

    share_package()
    found = table.select("v", "w").mapInArrow(bits, "bits binary").rdd.map(lambda r: np.frombuffer(r["bits"], dtype=np.uint8))
    return found.treeReduce(np.bitwise_or)


def _weights(table: DataFrame, ends: DataFrame, sums: dict) -> Weights:
    """The same figures as Model's, without a row of them on the driver."""
    def lower(c: str, size: str, kinds: str) -> Column:
        return F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / sums[size] + DISCOUNT * sums[kinds] / sums[size] * F.col("shared")

    def ratio(t: Column, p: Column) -> Column:
        return F.log(t / p)

    spark = table.sparkSession
    clear = _clear("st", "sp", (sums["S_t"], sums["S_p"])) > 0
    figures = checkpoint(ends.withColumn("shared", (F.col("s") + 1.0) / float(sums["S"] + sums["W"] + 1)).select(
        F.col("word").alias("w"), "shared", F.when(clear, lower("st", "S_t", "T_t")).alias("l_t"),
        F.when(clear, lower("sp", "S_p", "T_p")).alias("l_p")))
    own = F.col("l_t").isNotNull()
    left = figures.where(own).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("l_t", "l_p", "shared")]).first()
    rest = [max(1 - left[c], 1e-9) / max(1e-9, 1 - left["shared"]) for c in ("l_t", "l_p")]
    common = float(np.log(rest[0] / rest[1]))
    pairs = table.where(_clear("toxic", "plain", (sums["n_t"], sums["n_p"])) > 0)
    begins = table.join(pairs.select("v").distinct(), "v", "left_semi").groupBy("v").agg(
        F.greatest(F.sum("toxic"), F.lit(1)).alias("nt"), F.greatest(F.sum("plain"), F.lit(1)).alias("np"))
    upper = checkpoint(pairs.join(begins, "v").select(
        "v", "w", (F.greatest(F.col("toxic") - DISCOUNT, F.lit(0.0)) / F.col("nt")).alias("u_t"),
        (F.greatest(F.col("plain") - DISCOUNT, F.lit(0.0)) / F.col("np")).alias("u_p")))
    backoff = upper.groupBy("v").agg(*[F.greatest(1 - F.sum(u), F.lit(1e-9)).alias(b) for u, b in (("u_t", "b_t"), ("u_p", "b_p"))])
    known = figures.select("w", *[F.coalesce(c, F.lit(r) * F.col("shared")).alias(c) for c, r in zip(("l_t", "l_p"), rest)])
    u_t, u_p, b_t, b_p, l_t, l_p = (F.col(c) for c in ("u_t", "u_p", "b_t", "b_p", "l_t", "l_p"))
    whole = upper.join(backoff, "v").join(known, "w").select(
        "v", "w", (ratio(u_t + b_t * l_t, u_p + b_p * l_p) - ratio(b_t, b_p) - ratio(l_t, l_p)).alias("weight"))
    before = backoff.select("v", F.lit(ANY).cast("long").alias("w"), ratio(b_t, b_p).alias("weight"))
    words = figures.where(own).select(F.lit(ANY).cast("long").alias("v"), "w", (ratio(l_t, l_p) - common).alias("weight"))
    folder = shared_folder(spark, "weights")
    whole.unionByName(before).unionByName(words).write.parquet(folder)
    weights = spark.read.parquet(folder)
    return Weights(weights, common, _bitmap(weights))


def learn_model(table: DataFrame, most_words: int = MODEL_WORDS, most_pairs: int = MODEL_PAIRS) -> Model | Weights | None:
    """Figures of both classes from the bigram table (v, w, toxic, plain); None where a class is empty.
    Weights where more words or bigrams than these are clear."""
    spark, sums = table.sparkSession, _summary(table)
    if not sums["S_t"] or not sums["S_p"]:
        return None
    ends = table.groupBy(F.col("w").alias("word")).agg(
        F.count_if(F.col("toxic") > 0).alias("st"), F.count_if(F.col("plain") > 0).alias("sp"),
        F.count(F.lit(1)).alias("s"))
    clear = _listed(ends, _clear("st", "sp", (sums["S_t"], sums["S_p"])), most_words)
    pairs = None if clear is None else _listed(
        table, _clear("toxic", "plain", (sums["n_t"], sums["n_p"])), most_pairs)
    if pairs is None:
        return _weights(table, ends, sums)
    # at most `most_pairs` rows: the words of listed bigrams
    around = spark.createDataFrame([(r["v"], r["w"]) for r in pairs], "v long, w long")
    begins = table.join(F.broadcast(around.select("v").distinct()), "v", "left_semi").groupBy("v").agg(
        F.sum("toxic").alias("nt"), F.sum("plain").alias("np")).orderBy("v").collect()
    second = ends.join(F.broadcast(around.select(F.col("w").alias("word")).distinct()), "word", "left_semi")
    known = {r["word"]: r for r in [*second.collect(), *clear]}
    own = {r["word"] for r in clear}
    words = np.array(sorted(known), dtype=np.int64)
    counts = np.array([[known[w][c] for w in words.tolist()] for c in ("st", "sp", "s")], dtype=np.float64)
    listed = np.array([w in own for w in words.tolist()], dtype=bool)
    size = np.array([[sums["S_t"]], [sums["S_p"]]], dtype=np.float64)
    kinds = np.array([[sums["T_t"]], [sums["T_p"]]], dtype=np.float64)
    shared = (counts[2] + 1) / (sums["S"] + sums["W"] + 1)
    lower = np.maximum(counts[:2] - DISCOUNT, 0) / size + DISCOUNT * kinds / size * shared
    rest = np.maximum(1 - lower[:, listed].sum(1, keepdims=True), 1e-9) / max(1e-9, 1 - shared[listed].sum())
    lower = np.where(listed, lower, rest * shared)
    v, w = (np.array([r[c] for r in pairs], dtype=np.int64) for c in ("v", "w"))
    both = np.array([[r["toxic"] for r in pairs], [r["plain"] for r in pairs]], dtype=np.float64)
    first = np.array([r["v"] for r in begins], dtype=np.int64)
    seen = np.maximum(1, np.array([[r["nt"] for r in begins], [r["np"] for r in begins]], dtype=np.float64))
    place = np.searchsorted(first, v)
    upper = np.maximum(both - DISCOUNT, 0) / seen[:, place]
    taken = np.stack([np.bincount(place, u, len(first)) for u in upper])
    order = np.argsort(pair_keys(v, w))
    return Model(words, lower, rest, first, np.maximum(1 - taken, 1e-9), pair_keys(v, w)[order],
                 upper[:, order])


def evidence_counts(rows: DataFrame, model: Model) -> np.ndarray:
    """(2 x BINS) texts of a table (text, toxic) by class, ordinary first, and evidence."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = np.zeros((2, BINS), dtype=np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                found, n = model.evidence(part.column(0))
                place = np.clip((found + REACH) / (2 * REACH) * BINS, 0, BINS - 1).astype(np.int64)
                toxic = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                np.add.at(bins, (toxic[n > 0], place[n > 0]), 1)
        at = np.nonzero(bins)
        yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()),
                                          pa.array(bins[at])], names=["toxic", "bin", "n"])

    share_package()
    out = np.zeros((2, BINS))
    for r in rows.select("text", "toxic").mapInArrow(count, "toxic int, bin int, n long") \
            .groupBy("toxic", "bin").agg(F.sum("n").alias("n")).collect():
        out[r["toxic"], r["bin"]] = r["n"]
    return out


def logistic(counts: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> tuple[float, float]:
    """(scale, offset) by Newton steps over binned evidence; the ridge keeps them finite where
    the classes do not overlap."""
    x = (np.arange(BINS) + 0.5) / BINS * 2 * REACH - REACH
    n, positive = counts.sum(0), counts[1]
    theta = np.zeros(2)
    rows = np.stack([x, np.ones(BINS)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(theta @ rows, -500, 500)))
        gradient = rows @ (n * p - positive) + ridge * theta
        step = np.linalg.solve((rows * (n * p * (1 - p))) @ rows.T + ridge * np.eye(2), gradient)
        theta = theta - step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def learn(docs: DataFrame, labels: DataFrame, most_words: int = MODEL_WORDS,
          most_pairs: int = MODEL_PAIRS) -> tuple[Model | Weights | None, float]:
    """(model, share of toxic training rows)."""
    rows = training_rows(docs, labels)
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("toxic").alias("toxic")).first()
    share = totals["toxic"] / totals["n"] if totals["n"] else 0.0
    folder = shared_folder(docs.sparkSession, "bigrams")
    count_bigrams(rows.where(F.col("fold") != TUNING)).write.parquet(folder)
    model = learn_model(docs.sparkSession.read.parquet(folder), most_words, most_pairs)
    if model is None:
        return None, share
    if isinstance(model, Weights):
        counts = model.evidence_counts(docs.where(fold(F.col("doc_id")) == TUNING), known_labels(labels))
    else:
        counts = evidence_counts(rows.where(F.col("fold") == TUNING), model)
    scale, offset = logistic(counts)
    return replace(model, scale=scale, offset=offset, share=share), share


def score(docs: DataFrame, labels: DataFrame, most_words: int = MODEL_WORDS, most_pairs: int = MODEL_PAIRS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model, share = learn(docs, labels, most_words, most_pairs)
    if model is None:
        scored = docs.select("doc_id", F.lit(float(share)).alias("score"))
    elif isinstance(model, Weights):
        scored = model.scored(docs)
    else:
        def scores(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, 1):
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(model.scores(part.column(1)))], names=["doc_id", "score"])
        share_package()
        scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
            scores, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
