"""Registered queries of the training-data operators: `opN_<name>`.

Each query applies its operator, with production parameters, to its whole table
and derives the digest columns from the operator's output. ORACLES holds DuckDB
SQL where SQL can express the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nameprice.llm import (bpe_tree, chunk_dedup, frames, hilbert_blocks, histogram_sort, kmeans_tree,
                           kneser_ney, langid, odd_sketch, pfair, pii_crf, stratified, warc)
from nameprice.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_histogram_sort(spark, sf_dir):
    """Shards 0 to 7 of near equal bytes in doc_id order."""
    plan = histogram_sort.shard_documents(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                       "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op5_chunk_recipes(spark, sf_dir):
    """Exact dedup of normalised texts by content-defined chunk recipes."""
    out = chunk_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLES["op5_chunk_recipes"] = r"""
with t as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm
  from documents)
select doc_id, min(doc_id) over same as keep_id, count(*) over same as group_size,
       doc_id = min(doc_id) over same as kept, sha256(norm) as text_sha256
from t window same as (partition by norm)
"""


@query
def op7_pfair(spark, sf_dir):
    """Pfair schedule of all documents, weights tempered to the root of the counts."""
    return pfair.mix(table(spark, sf_dir, "documents"))


ORACLES["op7_pfair"] = f"""
with recursive counts as (
  select source, count(*) as n from documents group by source),
weighted as (
  select source, n, greatest(1, floor({pfair.RESOLUTION} * sqrt(n) / (select sum(sqrt(n)) from counts)
         + 0.5))::bigint as weight,
         row_number() over (order by source nulls first) as i from counts),
lists as (
  select list(weight order by i) as w, sum(weight)::bigint as total, count(*) as k from weighted),
run as (
  select -1::bigint as slot, 0::bigint as pick, list_transform(w, lambda x: 0::bigint) as done
  from lists
  union all
  select slot + 1, pick,
         list_transform(done, lambda x, j: case when j = pick then x + 1 else x end)
  from (
    select run.slot, run.done, list_position(due, list_min(due))::bigint as pick, total
    from (
      select run.*, total, list_transform(w, lambda x, j:
        case when (done[j] * total) // x <= slot + 1
             then ((done[j] + 1) * total + x - 1) // x else 9000000000000000 end) as due
      from run, lists where slot + 1 < total) as run) as step),
period as (
  select slot, pick, row_number() over (partition by pick order by slot) - 1 as p_index
  from run where slot >= 0),
ends as (
  select min((b // weight) * total + p.slot) as stop
  from (select *, (n + {pfair.BLOCK_ROWS - 1}) // {pfair.BLOCK_ROWS} as b from weighted) as x, lists,
       period as p
  where p.pick = x.i and p.p_index = x.b % x.weight),
placed as (
  select doc_id, source,
         row_number() over (partition by source order by doc_id nulls first) - 1 as n
  from documents),
blocked as (
  select p.doc_id, p.source, x.weight, x.i, p.n // {pfair.BLOCK_ROWS} as block,
         p.n % {pfair.BLOCK_ROWS} as idx
  from placed as p join weighted as x on p.source is not distinct from x.source)
select b.doc_id, b.source, b.weight, b.block, b.idx,
       (b.block * l.total) // b.weight as release,
       ((b.block + 1) * l.total + b.weight - 1) // b.weight as deadline,
       (b.block // b.weight) * l.total + p.slot as slot,
       (b.block // b.weight) * l.total + p.slot < (select stop from ends) as in_mix
from blocked as b, lists as l, period as p
where p.pick = b.i and p.p_index = b.block % b.weight
"""


@query
def op8_zstd_frames(spark, sf_dir):
    """Token ids of all documents through files of independent zstandard frames."""
    manifest, folder = frames.encode_to_files(table(spark, sf_dir, "documents"))
    return frames.read_documents(spark, manifest, folder).select(
        "doc_id", "start", "n_tokens", "ids_crc32")


@query
def op10_bpe_tree(spark, sf_dir):
    """Byte-level BPE of all documents by tree reduction, and back."""
    return bpe_tree.digests(table(spark, sf_dir, "documents"))


@query
def op1_warc_salvage(spark, sf_dir):
    """Pages through WARC archives and the salvage reader."""
    out = warc.round_trip(table(spark, sf_dir, "pages"))
    return out.where(F.col("record_type").isin("response", "revisit")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op2_zstd_language(spark, sf_dir):
    """Language of every document by compression with per-language dictionaries."""
    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op6_semi_markov_pii(spark, sf_dir):
    """Personal data of every document: base patterns and semi-Markov CRF."""
    return pii_crf.find_personal_data(table(spark, sf_dir, "documents"))


ORACLES["op1_warc_salvage"] = r"""
with p as (
  select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as h from pages),
g as (
  select *, min(page_id) over (partition by payload) as first from p)
select page_id, strlen(payload)::bigint as payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int,
                1)), 'string_agg', '') as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id = first then null else first end as refers_to
from g
"""


@query
def op9_odd_sketch(spark, sf_dir):
    """Components of near copies (Jaccard of five-word shingles at least 0.85)."""
    out = odd_sketch.near_duplicates(table(spark, sf_dir, "documents"), threshold=85)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op4_kmeans_tree(spark, sf_dir):
    """The 20 nearest of every 20th embedding by a k-means tree, best bin first."""
    return kmeans_tree.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op12_stratified_index(spark, sf_dir):
    """The ten best documents of every benchmark item through the length-stratified index."""
    index = stratified.build(table(spark, sf_dir, "documents"))
    return stratified.search(index, table(spark, sf_dir, "benchmark"))


ORACLES["op12_stratified_index"] = r"""
with cut as (
  select doc_id, row_number() over () as row, regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents where text is not null),
sized as (select *, len(terms)::bigint as n from cut where len(terms) > 0),
total as (select count(*)::bigint as docs, sum(n)::bigint as all_terms from sized),
posting as (
  select doc_id, row, n, term, count(*)::bigint as tf
  from (select doc_id, row, n, unnest(terms) as term from sized) group by all),
weight as (
  select term, floor(1000 * ln((2.0::double * docs + 2) / (2.0::double * count(*) + 1)))::bigint as w
  from posting, total group by term, docs),
asked as (
  select distinct item_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark),
scored as (
  select item_id, doc_id, row, sum(w * ((1000000000 * tf) //
           (1000 * tf + 8 * (10 + (90 * n * docs) // all_terms))))::bigint as score
  from asked join weight using (term) join posting using (term), total
  group by item_id, doc_id, row),
ranked as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank,
         doc_id, score
  from scored where score > 0)
select * from ranked where rank <= 10
"""


@query
def op13_hilbert_blocks(spark, sf_dir):
    """Product-quantisation codes of all embeddings over Hilbert-sorted flat blocks."""
    coded, books = hilbert_blocks.encode(table(spark, sf_dir, "embeddings"))
    per_label = coded.groupBy("own_label").agg(F.sum("error").alias("label_error")) \
        .withColumnRenamed("own_label", "label")
    code = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    return coded.join(per_label, F.col("own_label").eqNullSafe(F.col("label"))).select(
        "vec_id", code.alias("code"), "error", "label_error",
        F.lit(books.digest()).alias("codebooks_sha256"))


def _quantiser_sql() -> str:
    """Chained rounds: parts of all vectors (v), books 0 to ROUNDS, assignments of each."""
    p, k, rounds = hilbert_blocks.PARTS, hilbert_blocks.ENTRIES, hilbert_blocks.ROUNDS
    text = f"""
with kept as (
  select vec_id, label, row_number() over (order by vec_id nulls last, ints) - 1 as row, ints
  from (select vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as ints
        from embeddings
        where embedding is not null and len(embedding) > 0
          and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)),
v as (
  select row, part, ints[1 + part * (len(ints) // {p}):(part + 1) * (len(ints) // {p})] as x
  from kept, range({p}) as parts(part)),
b0 as (select part, row as entry, x from v where row < {k})"""
    for i in range(rounds + 1):
        text += f""",
a{i} as materialized (
  select row, part, first(entry order by d, entry) as entry, min(d) as d, any_value(x) as x
  from (select v.row, v.part, b.entry, v.x,
               list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d
        from v join b{i} as b using (part)) group by row, part)"""
        if i < rounds:
            text += f""",
m{i} as (
  select part, entry, list(mean order by i) as x
  from (select part, entry, i, floor(sum(c)::hugeint / count(*))::bigint as mean
        from (select part, entry, unnest(x) as c, unnest(range(len(x))) as i from a{i})
        group by part, entry, i) group by part, entry),
b{i + 1} as materialized (
  select part, entry, coalesce(m.x, b.x) as x from b{i} as b left join m{i} as m using (part, entry))"""
    return text + f""",
coded as (
  select row, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' order by part) as code,
         sum(d)::bigint as error from a{rounds} group by row),
books as (
  select sha256(string_agg(array_to_string(x, ','), ',' order by part, entry)) as digest from b{rounds})
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error,
       digest as codebooks_sha256
from kept join coded using (row), books
"""


ORACLES["op13_hilbert_blocks"] = _quantiser_sql()


@query
def op11_kneser_ney(spark, sf_dir):
    """Toxicity of every document by class-conditional Kneser-Ney models."""
    return kneser_ney.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op9_odd_sketch"] = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
shingle as (
  select distinct doc_id, s from (
    select doc_id, unnest(case when len(w) = 0 then []::varchar[]
             when len(w) < 5 then [array_to_string(w, ' ')]
             else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s
    from words)),
sized as (select doc_id, count(*) as n from shingle group by doc_id),
common as (
  select a.doc_id as a, b.doc_id as b, count(*) as c
  from shingle as a join shingle as b on a.s = b.s and a.doc_id < b.doc_id group by all),
link as (
  select a, b from common join sized as x on x.doc_id = a join sized as y on y.doc_id = b
  where 100 * c >= 85 * (x.n + y.n - c)),
both_ways as (select a, b from link union all select b, a from link),
reach as (
  select doc_id as node, doc_id as other from documents
  union
  select node, b from reach join both_ways on other = a),
least as (select node, min(other) as component_id from reach group by node)
select d.doc_id, coalesce(s.n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
from documents as d left join sized as s using (doc_id) join least on node = d.doc_id
"""
