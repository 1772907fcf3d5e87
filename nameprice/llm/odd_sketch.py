"""Near-dedup of word shingles: MinHash bands, odd sketches, exact verification.

Per document (its set: the distinct five-word shingles as 64-bit hashes) one pass
makes the banded MinHash values, the sample of the `SAMPLE` smallest hashes folded
into a parity bitmap (the odd sketch) and a digest of the set. Documents with equal
sets form a class, of which one representative goes on.

Candidates share a band; the number of bands is set so that a pair at the
threshold is missed with probability below `MISS`. Inside a bucket the XOR
population count of two sketches bounds the difference of their samples: pairs
that cannot reach the threshold (beyond `SIGMAS` deviations of the sample for
large sets; without error for sets up to `SAMPLE`) are dropped there, the others
form groups that are verified on the full sets of whole texts.

Links are found in three steps, so that texts move in proportion to a cluster of
near copies and not to its square. The first takes the cells of `LEAD` bands and
connects most of every cluster. The second takes all other cells, but only pairs
of different components, and of two components that meet in a cell only their
nearest pair. The third takes every pair across components that the second left
out, so no link is lost. Buckets are cut into cells of bounded size and compared
cell by cell; a group emits a spanning set of verified links, and components of
the links are found with star steps.

Defined cases: null text, or text without words, has an empty set, links with
nothing and stays. With fewer than five words the whole sequence is the one
shingle. Texts of any length are taken whole. Classes of equal sets have keys of their own, so
rows with a null doc_id are linked like all others: their component_id is the smallest doc_id
of their component, null if it has none, and of such a component one class stays. Rows
repeating a doc_id count as one document with the links of each. An empty table gives
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nameprice.llm.common import checkpoint, release_memory, share_package, worker_udf
from nameprice.llm.components import components

WORDS = 5                  # words of a shingle
THRESHOLD = 80             # link: 100 * intersection >= THRESHOLD * union
ROWS = 5                   # MinHash values of a band
MISS = 1e-6
SAMPLE = 512               # hashes folded into a sketch
BITS = 2048
SIGMAS = 5.0
LEAD = 3                   # bands of the first step
CELL_DOCS, CELL_SHINGLES = 1024, 2_000_000
CACHE_WORDS = 200_000
SIGNATURE = "n long, digest binary, bands array<long>, sketch binary"

_RANDOM = np.random.default_rng(20240229)
FACTORS = _RANDOM.integers(1, 2 ** 63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACES = _RANDOM.integers(1, 2 ** 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands_for(threshold: int) -> int:
    """Bands at which a pair at the threshold is missed with probability MISS."""
    return math.ceil(math.log(MISS) / math.log(1 - (threshold / 100) ** ROWS))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


HASHES = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    w = np.fromiter(map(HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(w) < WORDS:
        if not len(w):
            return w
        return mixed((w * PLACES[:len(w)]).sum(keepdims=True) + np.uint64(len(w)))
    n = len(w) - WORDS + 1
    total = w[:n] * PLACES[0]
    for i in range(1, WORDS):
        total += w[i:i + n] * PLACES[i]
    return np.unique(mixed(total + np.uint64(WORDS)))


def minhashes(s: np.ndarray, k: int) -> np.ndarray:
    low = np.full(k, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(s), 1024):
        low = np.minimum(low, (s[i:i + 1024, None] * FACTORS[None, :k]).min(axis=0))
    return low


def band_keys(s: np.ndarray, bands: int) -> np.ndarray:
    rows = minhashes(s, bands * ROWS).reshape(bands, ROWS)
    return mixed((rows * PLACES[None, :ROWS]).sum(axis=1)
                 + mixed(np.arange(bands, dtype=np.uint64))).astype(np.int64)


def odd_sketch(s: np.ndarray) -> np.ndarray:
    """Parity bitmap of the SAMPLE smallest hashes, as 64-bit words."""
    low = s[:SAMPLE]                       # s is sorted
    parity = np.bincount((low % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.uint64)


def most_differing(n: np.ndarray, m: int, threshold: int) -> np.ndarray:
    """Largest XOR count of two sketches that sets of n and m shingles at the
    threshold can have; negative where their sizes already rule them out."""
    n = n.astype(np.float64)
    big, small = np.maximum(n, m), np.minimum(n, m)
    common = threshold / (100.0 + threshold) * (n + m)       # least intersection
    whole = np.floor(n + m - 2 * common)                     # both sets folded entirely
    share = np.minimum(1.0, common / big)
    expected = SAMPLE * share
    least = expected - SIGMAS * np.sqrt(SAMPLE * share * (1 - share)) - 1
    sampled = np.minimum(SAMPLE, n) + min(SAMPLE, m) - 2 * np.maximum(0.0, least)
    limit = np.where(big <= SAMPLE, whole, sampled)
    return np.where(100 * small >= threshold * big, limit, -1.0)


def partners(sketches: np.ndarray, n: np.ndarray, i: int, threshold: int) -> np.ndarray:
    """Members after i that the sketches do not rule out."""
    far = differing(sketches[i + 1:], sketches[i])
    return i + 1 + np.nonzero(far <= most_differing(n[i + 1:], int(n[i]), threshold))[0]


def differing(sketches: np.ndarray, one: np.ndarray) -> np.ndarray:
    """XOR counts of sketches and one."""
    return np.bitwise_count(sketches ^ one).sum(axis=1, dtype=np.int64)


def across(sketches: np.ndarray, n: np.ndarray, component: np.ndarray,
           threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Which members have a possible partner in another component, and which are an
    end of the nearest pair of two components (ties: the first pair)."""
    whole, nearest = np.zeros(len(n), dtype=bool), np.zeros(len(n), dtype=bool)
    _, code, size = np.unique(component, return_inverse=True, return_counts=True)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for i in range(len(n) - 1):
        j = partners(sketches, n, i, threshold)
        j = j[code[j] != code[i]]
        if not len(j):
            continue
        whole[i], whole[j] = True, True
        if size[code[i]] == 1:
            alone = size[code[j]] == 1         # two single members: their only pair
            if alone.any():
                nearest[i], nearest[j[alone]] = True, True
            j = j[~alone]
        far = differing(sketches[j], sketches[i])
        order = np.lexsort((j, far, code[j]))
        j, far = j[order], far[order]
        first = np.nonzero(np.diff(code[j], prepend=-1))[0]
        for at in first.tolist():
            pair = (min(code[i], code[j[at]]), max(code[i], code[j[at]]))
            found = (int(far[at]), i, int(j[at]))
            if pair not in best or found < best[pair]:
                best[pair] = found
    for _, i, j in best.values():
        nearest[i], nearest[j] = True, True
    return whole, nearest


def forget() -> None:
    """At a task's end: the words that it met, and their memory."""
    HASHES.clear()
    release_memory()


def linked(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= threshold * (len(a) + len(b) - common)


def groups(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Runs of equal keys in batches sorted by them; a run may span batches."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pd.concat([rest, batch], ignore_index=True)
        if not len(batch):
            continue
        k = batch[keys].to_numpy()
        cuts = np.nonzero((k[1:] != k[:-1]).any(axis=1))[0] + 1
        starts = [0, *cuts.tolist()]
        for a, b in zip(starts, starts[1:]):
            yield batch.iloc[a:b]
        rest = batch.iloc[starts[-1]:]
    if rest is not None and len(rest):
        yield rest


# ---- steps ---------------------------------------------------------------------------

def signature(text: Column, threshold: int) -> Column:
    bands = bands_for(threshold)

    @worker_udf(SIGNATURE)
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                s = shingles(text)
                if not len(s):
                    rows.append((0, b"", [], b""))
                    continue
                rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), band_keys(s, bands),
                             odd_sketch(s).tobytes()))
            yield pd.DataFrame(rows, columns=["n", "digest", "bands", "sketch"])
        forget()
    return sign(text)


def survivors(entries: DataFrame, sketches: DataFrame, threshold: int,
              left_out: bool = False) -> DataFrame:
    """(gid, rep, component): ends of the nearest pairs of components in each cell; with
    `left_out` instead all members with a partner, of cells where those are more.

    entries: (bucket, x, y, rep, component), one row per member of a pair of cells. As
    components only grow together, the nearest pairs of larger ones are among those of
    smaller ones: a cell that leaves nothing out later left nothing unverified before.
    """
    def filter_cells(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gids, reps, own = [], [], []

        def found() -> pd.DataFrame:
            return pd.DataFrame({name: np.array(x, dtype=np.int64) for name, x in
                                 (("gid", gids), ("rep", reps), ("component", own))})

        for cell in groups(batches, ["bucket", "x", "y"]):
            if len(cell) < 2:
                continue
            n, component = cell["n"].to_numpy(), cell["component"].to_numpy()
            s = np.stack([np.frombuffer(b, dtype=np.uint64) for b in cell["sketch"]])
            whole, hit = across(s, n, component, threshold)
            if left_out:
                hit = whole if (whole != hit).any() else np.zeros(len(n), dtype=bool)
            if hit.any():
                members = cell["rep"].to_numpy()[hit]          # cells are sorted by rep
                gid = xxhash.xxh64_intdigest(members.tobytes()) - (1 << 63)
                gids += [gid] * len(members)
                reps += members.tolist()
                own += component[hit].tolist()
                if len(reps) > 50_000:
                    yield found()
                    gids, reps, own = [], [], []
        yield found()
        release_memory()

    share_package()
    rows = entries.join(sketches, "rep").repartition("bucket", "x", "y").sortWithinPartitions(
        "bucket", "x", "y", "rep").select("bucket", "x", "y", "rep", "component", "n", "sketch")
    return rows.mapInPandas(filter_cells, "gid long, rep long, component long").distinct()


def verified_links(members: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """(a, b): verified links that connect all linked members of each group that are not
    in one component already."""
    def verify(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for group in groups(batches, ["gid"]):
            ids = group["rep"].tolist()
            sets = [shingles(t) for t in group["text"]]
            n = np.array([len(s) for s in sets])
            sketches = np.stack([odd_sketch(s) for s in sets])
            root = group["component"].to_numpy().copy()
            for i in range(len(ids) - 1):
                for j in partners(sketches, n, i, threshold):
                    if root[i] != root[j] and linked(sets[i], sets[j], threshold):
                        out.append((ids[i], ids[j]))
                        root[root == root[j]] = root[i]
        yield pd.DataFrame(out, columns=["a", "b"])
        forget()

    share_package()
    rows = members.join(texts, "rep").repartition("gid").sortWithinPartitions("gid", "rep")
    return rows.select("gid", "rep", "component", "text").mapInPandas(verify, "a long, b long").distinct()


def cells(reps: DataFrame) -> DataFrame:
    """(band, bucket, rep, c, own): members of shared buckets, each in one of the bucket's c
    cells of bounded size."""
    entries = reps.select("rep", "n", F.posexplode("bands").alias("band", "bucket"))
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("t")) \
        .where("m > 1").select("bucket", F.greatest(
            F.ceil(F.col("m") / CELL_DOCS), F.ceil(F.col("t") / CELL_SHINGLES)).alias("c"))
    return entries.select("band", "bucket", "rep").join(shared, "bucket").withColumn(
        "own", F.pmod(F.xxhash64("rep", "bucket"), F.col("c")))


def open_cells(placed: DataFrame, joined: DataFrame, repeats: bool) -> DataFrame:
    """(bucket, x, y, rep, component): pairs of cells, not compared in the first step, that
    hold several components; with `repeats` only those that hold two members of one.
    Buckets of one component go before their members meet every other cell."""
    now = placed.join(joined, F.col("rep") == F.col("node"), "left").select(
        "band", "bucket", "rep", "c", "own", F.coalesce("component", "rep").alias("component"))
    ends = [F.min("component").alias("l"), F.max("component").alias("h")]
    buckets = now.groupBy("bucket").agg(*ends).where("l < h").select("bucket")
    met = now.join(buckets, "bucket", "left_semi").select("band", "bucket", "rep", "component", "own", F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("c") - 1)).alias("other"))
    pairs = checkpoint(met.where((F.col("band") >= LEAD) | (F.col("own") != F.col("other"))).select(
        "bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "rep", "component"))
    cell = ["bucket", "x", "y"]
    several = pairs.groupBy(*cell, "component").agg(F.count(F.lit(1)).alias("k")).groupBy(*cell).agg(
        F.count(F.lit(1)).alias("d"), F.sum("k").alias("m")).where("d > 1")
    return pairs.join(several.where("d < m") if repeats else several, cell, "left_semi")


def joined_by(placed: DataFrame, sketches: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """(node, component) of all members with a verified link in the cells `placed`."""
    lead = placed.where(F.col("band") < LEAD).select(
        "bucket", F.col("own").alias("x"), F.col("own").alias("y"), "rep", F.col("rep").alias("component"))
    joined = components(verified_links(survivors(lead, sketches, threshold), texts, threshold))
    for left_out in (False, True):
        members = survivors(open_cells(placed, joined, left_out), sketches, threshold, left_out)
        joined = grown(joined, verified_links(members, texts, threshold))
    return joined


def grown(joined: DataFrame, links: DataFrame) -> DataFrame:
    """Components after some more links."""
    more = checkpoint(links)
    return joined if more.isEmpty() else components(joined.toDF("a", "b").unionByName(more))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, kept, text_hash): a row per row of `docs`;
    class_id is the smallest doc_id with an equal set."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), signature(F.col("text"), threshold).alias("s"))
    signed = checkpoint(rows.select("doc_id", "text_hash", "s.*"))
    first = Window.partitionBy("digest").orderBy(F.col("doc_id").asc_nulls_last(), "text_hash")
    reps = checkpoint(signed.where("n > 0").withColumn("r", F.row_number().over(first)).where("r = 1").select(
        "digest", "doc_id", "text_hash", "n", "bands", "sketch"))
    reps = reps.withColumn("rep", F.monotonically_increasing_id())     # fixed by the checkpoint
    placed = checkpoint(cells(reps))
    wanted = placed.select("rep").distinct().join(reps.select("rep", "doc_id", "text_hash"), "rep").select(
        "rep", F.col("doc_id").alias("r_doc"), F.col("text_hash").alias("r_hash"))
    # one text per class, however many rows repeat it
    texts = checkpoint(docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(
        wanted, F.col("doc_id").eqNullSafe(F.col("r_doc")) & (F.col("h") == F.col("r_hash")))
        .groupBy("rep").agg(F.first("text").alias("text")))
    classes = signed.select("doc_id", "text_hash", "n", "digest").join(
        reps.select(F.col("digest").alias("d"), "rep", F.col("doc_id").alias("class_id")),
        F.col("digest") == F.col("d"), "left").drop("d", "digest")
    repeated = classes.where("doc_id is not null and rep is not null").groupBy("doc_id").agg(
        F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z")
    shared = classes.join(repeated, "doc_id").where("a <> rep").select("a", F.col("rep").alias("b")).distinct()
    joined = grown(joined_by(placed, reps.select("rep", "n", "sketch"), texts, threshold), shared)
    placed = classes.join(joined, F.col("rep") == F.col("node"), "left").withColumn(
        "component", F.coalesce("component", "rep"))
    # classes by component, not rows: their smallest doc_id and, without one, their smallest key
    least = reps.join(joined, F.col("rep") == F.col("node"), "left").groupBy(
        F.coalesce("component", "rep").alias("c")).agg(F.min("doc_id").alias("least_doc"), F.min("rep").alias("least_rep"))
    found = placed.join(least, F.col("component") == F.col("c"), "left")
    by_id = F.coalesce(F.col("doc_id") == F.col("least_doc"), F.lit(False))
    stays = F.when(F.col("rep").isNull(), F.lit(True)).when(F.col("least_doc").isNotNull(), by_id).otherwise(
        F.col("rep") == F.col("least_rep"))
    own = F.col("rep").isNotNull()
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(own, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(own, F.col("least_doc")).otherwise(F.col("doc_id")).alias("component_id"), stays.alias("kept"), "text_hash")


def drop_near_copies(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of `docs` (all columns) that stay: one document per component."""
    stay = near_duplicates(docs, threshold).where("kept").select(
        F.col("doc_id").alias("__keep_doc"), F.col("text_hash").alias("__keep_text")).distinct()
    return docs.join(stay, docs.doc_id.eqNullSafe(F.col("__keep_doc"))
                     & (F.xxhash64(docs.text) == F.col("__keep_text")), "left_semi")
