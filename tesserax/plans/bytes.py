"""Queries of byte sequences, blobs, sorted runs, front coding, comparisons and journals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import journal, maps, ordered, runs, sequences
from .registry import query

#: Both sides show bytes as hexadecimal text, two digits a byte: DuckDB cuts no BLOBs.
RAW = "raw as (select doc_id as doc, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents)"


def raw(t) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("doc"), sequences.encode(F.col("text")).alias("b"))


def digits(text: str) -> str:
    return text.encode().hex().upper()


def cut(size: int) -> str:
    return f"chunks as (select doc, i as seq, substr(h, i * {2 * size} + 1, {2 * size}) as chunk, i * {size} as s, least((i + 1) * {size}, n) as e, n from (select doc, h, n, unnest(range(0, (n + {size - 1}) // {size})) as i from raw))"


def chunked(t, size: int = 64) -> DataFrame:
    return sequences.chunks(raw(t), "doc", "b", size)


def shown(df: DataFrame, name: str = "chunk") -> DataFrame:
    return df.withColumn(name, F.hex(name))


def edited(t, new, least: int = 0) -> DataFrame:
    """(doc, text): documents of ``least`` bytes or more, each with an expression of its bytes."""
    return raw(t).where(F.octet_length("b") >= least).select("doc", F.hex(new(F.col("b"))).alias("text"))


@query("q_wt_total", f"with {RAW} select doc, n::bigint as total from raw where n > 0")
def _(t):
    return chunked(t).groupBy("doc").agg(F.sum(F.octet_length("chunk")).alias("total"))


@query("q_wt_locate", f"with {RAW}, {cut(64)} select doc, seq::int as seq, (200 - s)::bigint as \"inner\" from chunks where s <= 200 and 200 < e")
def _(t):
    return sequences.locate(chunked(t), F.lit(200)).select("doc", "seq", "inner")


@query("q_wt_scan", f"with {RAW}, {cut(64)} select doc, seq::int as seq, chunk, s::bigint as start, e::bigint as \"end\" from chunks")
def _(t):
    return shown(sequences.placed(chunked(t))).select("doc", "seq", "chunk", "start", "end")


@query("q_wt_scan_from", f"with {RAW}, {cut(64)} select doc, seq::int as seq, chunk from chunks where e > 1000 and n > 1000")
def _(t):
    return shown(sequences.placed(chunked(t)).where("end > 1000").select("doc", "seq", "chunk"))


@query("q_wt_insert_split", f"with {RAW} select doc, h[1:200] || '{digits('<néw>')}' || h[201:] as text from raw where n >= 100")
def _(t):
    made = sequences.whole(sequences.insert_split(chunked(t), 100, "<néw>"))
    return made.join(raw(t).where("octet_length(b) >= 100").select("doc"), "doc", "left_semi").select("doc", F.hex("bytes").alias("text"))


@query("q_wt_remove_entry", f"with {RAW}, {cut(64)} select doc, seq::int as seq, chunk from chunks where not (s <= 150 and 150 < e)")
def _(t):
    return shown(sequences.remove_entry(chunked(t), 150))


@query("q_wt_prev_entry", f"with {RAW}, {cut(64)} select doc, seq::int as seq, lag(chunk) over (partition by doc order by seq) as prev from chunks")
def _(t):
    return shown(chunked(t).select("doc", "seq", F.lag("chunk").over(Window.partitionBy("doc").orderBy("seq")).alias("prev")), "prev")


@query("q_wt_next_entry", f"with {RAW}, {cut(64)} select doc, seq::int as seq, lead(chunk) over (partition by doc order by seq) as next, lead(chunk) over (partition by doc order by seq) is null as off_end from chunks")
def _(t):
    after = F.lead("chunk").over(Window.partitionBy("doc").orderBy("seq"))
    return shown(chunked(t).select("doc", "seq", after.alias("next"), after.isNull().alias("off_end")), "next")


@query("q_seq_size", f"with {RAW} select sum(n)::bigint as bytes, count(*) as n from raw")
def _(t):
    return raw(t).agg(F.sum(F.octet_length("b")).alias("bytes"), F.count(F.lit(1)).alias("n"))


@query("q_seq_read_at", f"with {RAW} select doc, substr(h, 201, 300) as bytes from raw where n >= 100")
def _(t):
    return shown(sequences.read_at(chunked(t), 100, 150, 64), "bytes")


@query("q_seq_insert", f"with {RAW} select doc, h[1:100] || '{digits('XYZ')}' || h[101:] as text from raw where n >= 50")
def _(t):
    return edited(t, lambda b: sequences.insert(b, 50, "XYZ"), 50)


@query("q_seq_append", f"with {RAW} select doc, h || '{digits('täil')}' as text from raw")
def _(t):
    return edited(t, lambda b: F.concat(b, sequences.encode(F.lit("täil"))))


@query("q_seq_erase", f"with {RAW} select doc, h[1:100] || h[121:] as text from raw where n >= 60")
def _(t):
    return edited(t, lambda b: sequences.erase(b, 50, 10), 60)


@query("q_seq_replace", f"with {RAW} select doc, h[1:40] || '{digits('replaced')}' || h[51:] as text from raw where n >= 25")
def _(t):
    return edited(t, lambda b: sequences.replace(b, 20, 5, "replaced"), 25)


@query("q_seq_clear", f"with {RAW}, {cut(64)} select count(*) as chunks, coalesce(sum(e - s), 0)::bigint as bytes from chunks where doc % 2 <> 0")
def _(t):
    left = sequences.clear(chunked(t), F.col("doc") % 2 == 0)
    return left.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum(F.octet_length("chunk")), F.lit(0)).cast("long").alias("bytes"))


@query("q_seq_rechunk", f"with {RAW}, {cut(256)} select doc, seq::int as seq, chunk from chunks")
def _(t):
    return shown(chunked(t, 256))


@query("q_seq_chunk_sizes", f"with {RAW}, {cut(100)} select (e - s)::int as size, count(*) as n from chunks group by 1")
def _(t):
    return chunked(t, 100).groupBy(F.octet_length("chunk").alias("size")).agg(F.count(F.lit(1)).alias("n"))


@query("q_blob_size", "select user_id as blob, sum(strlen(props))::bigint as bytes from events group by 1")
def _(t):
    return t.events.groupBy(F.col("user_id").alias("blob")).agg(F.sum(F.octet_length("props")).alias("bytes"))


@query("q_blob_read_at", f"with {RAW} select doc, substr(h, 601, 128) as bytes from raw where n >= 300")
def _(t):
    return shown(sequences.read_at(chunked(t, 256), 300, 64, 256), "bytes")


@query("q_blob_read_next", f"with {RAW}, spot as (select doc, h, least(n, 40) as c, n from raw) select doc, substr(h, 2 * c + 1, 50) as bytes, least(n, c + 25)::bigint as cursor from spot")
def _(t):
    at = sequences.seek(F.octet_length("b"), 40)
    return shown(raw(t).select("doc", sequences.read_next(F.col("b"), at, 25).alias("r")).select("doc", "r.bytes", "r.cursor"), "bytes")


@query("q_blob_write_next", f"with {RAW}, spot as (select doc, h, least(n, 70) as c from raw) select doc, h[1:2 * c] || '{digits('wrïtten')}' || substr(h, 2 * c + {2 * len('wrïtten'.encode()) + 1}) as bytes, (c + {len('wrïtten'.encode())})::bigint as cursor from spot")
def _(t):
    at = sequences.seek(F.octet_length("b"), 70)
    return shown(raw(t).select("doc", sequences.write_next(F.col("b"), at, "wrïtten").alias("r")).select("doc", "r.bytes", "r.cursor"), "bytes")


@query("q_blob_write_at", f"with {RAW} select doc, case when n >= 90 then h[1:180] || '{digits('0123456789')}' || h[201:] end as text from raw")
def _(t):
    return edited(t, lambda b: sequences.write_at(b, 90, "0123456789"))


@query("q_blob_append_log", "select user_id as blob, string_agg(event_type, ',' order by event_id) as log from events group by 1")
def _(t):
    log = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]), ",")
    return t.events.groupBy(F.col("user_id").alias("blob")).agg(log.alias("log"))


@query("q_blob_append_chunk", f"with {RAW}, {cut(256)}, more as (select doc, seq, chunk from chunks union all select doc, max(seq) + 1, '{digits('sealed')}' from chunks group by doc) select doc, seq::int as seq, chunk from more")
def _(t):
    return shown(sequences.append_chunk(chunked(t, 256), "sealed"))


@query("q_blob_drop_last", f"with {RAW}, {cut(256)} select doc, seq::int as seq, chunk from chunks where e < n")
def _(t):
    return shown(sequences.drop_last(chunked(t, 256)))


@query("q_blob_truncate", f"with {RAW} select doc, case when n >= 128 then h[1:256] end as text from raw")
def _(t):
    return edited(t, lambda b: sequences.truncate(b, 128))


@query("q_blob_truncate_delta", f"with {RAW} select doc, case when n >= 128 then substr(h, 1, 2 * (n - 128)) end as text from raw")
def _(t):
    return edited(t, lambda b: sequences.truncate_by(b, 128))


@query("q_blob_extend", f"with {RAW} select doc, h || '{digits('        ')}' as text from raw")
def _(t):
    return edited(t, lambda b: sequences.extend(b, 8))


@query("q_blob_resize", f"with {RAW} select doc, rpad(h, 400, '20') as text from raw")
def _(t):
    return edited(t, lambda b: sequences.resize(b, 200))


@query("q_blob_locate", f"with {RAW}, {cut(256)} select doc, seq::int as seq, s::bigint as start, e < n as sealed from chunks where s <= 300 and 300 < e")
def _(t):
    spots = sequences.locate(chunked(t, 256), F.lit(300)).select("doc", "seq", F.col("start").cast("long").alias("start"), "end")
    total = raw(t).select("doc", F.octet_length("b").alias("n"))
    return spots.join(total, "doc").select("doc", "seq", "start", (F.col("end") < F.col("n")).alias("sealed"))


# Sorted runs.

ENTRY = "entry as (select user_id || '/' || json_extract_string(props, '$.k') as k, event_type as v, case when event_type = 'error' then 1 else 0 end as flag, event_id // 7 as lsn, event_id % 3 as run, event_id from events)"
RUNS = f"{ENTRY}, runs as (select k, v, flag, lsn, run from (select *, row_number() over (partition by run, k order by lsn desc, event_id desc) as r from entry) where r = 1)"
MERGED = f"{RUNS}, merged as (select k, v, flag, lsn, run from (select *, row_number() over (partition by k order by lsn desc, run) as r from runs) where r = 1)"
BLOCKS = f"{RUNS}, blocks as (select *, (row_number() over (partition by run order by k) - 1) as pos, (row_number() over (partition by run order by k) - 1) // 16 as block from runs)"


def entries(t) -> DataFrame:
    raw = t.events.select(
        F.concat_ws("/", "user_id", F.get_json_object("props", "$.k")).alias("k"), F.col("event_type").alias("v"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("flag"),
        F.expr("event_id div 7").alias("lsn"), (F.col("event_id") % 3).alias("run"), "event_id",
    )
    return raw.groupBy("run", "k").agg(F.max(F.struct("lsn", "event_id", "v", "flag")).alias("w")).select("k", "w.v", "w.flag", "w.lsn", "run")


def blocked(t) -> DataFrame:
    return runs.blocks(entries(t), 16)


@query("q_sst_build_stats", f"with {RUNS} select run, count(*) as entries, min(k) as first_key, max(k) as last_key, count(*) - count(distinct k) as duplicates from runs group by run")
def _(t):
    return entries(t).groupBy("run").agg(F.count(F.lit(1)).alias("entries"), F.min("k").alias("first_key"), F.max("k").alias("last_key"), (F.count(F.lit(1)) - F.count_distinct("k")).alias("duplicates"))


@query("q_sst_lsn_bounds", f"with {MERGED} select min(lsn) as min_lsn, max(lsn) as max_lsn, count(*) as entries from merged")
def _(t):
    return runs.merge(entries(t)).agg(F.min("lsn").alias("min_lsn"), F.max("lsn").alias("max_lsn"), F.count(F.lit(1)).alias("entries"))


@query("q_sst_tombstones", f"with {RUNS} select run, k, lsn from runs where flag = 1")
def _(t):
    return entries(t).where("flag = 1").select("run", "k", "lsn")


@query("q_sst_manifest", f"with {BLOCKS} select run, count(*) as entries, count(distinct block) as blocks, sum(strlen(k) + strlen(v))::bigint as bytes, min(lsn) as min_lsn, max(lsn) as max_lsn, max(strlen(k))::bigint as max_key from blocks group by run")
def _(t):
    size = F.octet_length("k") + F.octet_length("v")
    return blocked(t).groupBy("run").agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("block").alias("blocks"), F.sum(size).alias("bytes"), F.min("lsn").alias("min_lsn"), F.max("lsn").alias("max_lsn"), F.max(F.octet_length("k").cast("long")).alias("max_key"))


@query("q_sst_scan", f"with {BLOCKS} select run, pos, k, v, flag, lsn from blocks")
def _(t):
    return blocked(t).select("run", "pos", "k", "v", "flag", "lsn")


@query("q_sst_point_lookup", f"with {RUNS} select run, k, v, flag, lsn from runs where k = '1/5'")
def _(t):
    return entries(t).where("k = '1/5'").select("run", "k", "v", "flag", "lsn")


@query("q_fence_lower_bound", f"with {BLOCKS}, f as (select run, block, max(k) as fence from blocks group by run, block) select run, min(block) as block, arg_min(fence, block) as fence from f where fence >= '20/' group by run")
def _(t):
    return runs.fences(blocked(t)).where("fence >= '20/'").groupBy("run").agg(F.min("block").alias("block"), F.min_by("fence", "block").alias("fence"))


@query("q_sst_layout", f"with {BLOCKS}, b as (select run, block, sum(strlen(k) + strlen(v)) as bytes from blocks group by run, block) select run, count(*) as blocks, sum(bytes)::bigint as data_bytes, ((count(*) + 7) // 8)::bigint as index_pages from b group by run")
def _(t):
    b = blocked(t).groupBy("run", "block").agg(F.sum(F.octet_length("k") + F.octet_length("v")).alias("bytes"))
    return b.groupBy("run").agg(F.count(F.lit(1)).alias("blocks"), F.sum("bytes").alias("data_bytes")).withColumn("index_pages", F.expr("(blocks + 7) div 8"))


@query("q_sst_bad_flags", "select event_id, (event_id % 5)::bigint as flag from events where event_id % 5 not in (0, 1)")
def _(t):
    return t.events.select("event_id", (F.col("event_id") % 5).alias("flag")).where("flag not in (0, 1)")


@query("q_block_entry_counts", f"with {BLOCKS} select run, block, count(*) as entries from blocks group by run, block")
def _(t):
    return runs.fences(blocked(t)).select("run", "block", "entries")


@query("q_block_max_key", f"with {BLOCKS} select run, block, max(strlen(k))::int as max_key from blocks group by run, block")
def _(t):
    return runs.fences(blocked(t)).select("run", "block", "max_key")


@query("q_block_fences", f"with {BLOCKS} select run, block, max(k) as fence from blocks group by run, block")
def _(t):
    return runs.fences(blocked(t)).select("run", "block", "fence")


@query(
    "q_page_packing",
    f"with {BLOCKS}, b as (select run, block, sum(strlen(k) + strlen(v)) as bytes from blocks group by run, block) select run, block, ((sum(bytes) over (partition by run order by block) - bytes) // 1024)::bigint as page from b",
)
def _(t):
    b = blocked(t).groupBy("run", "block").agg(F.sum(F.octet_length("k") + F.octet_length("v")).alias("bytes"))
    return b.withColumn("s", F.sum("bytes").over(Window.partitionBy("run").orderBy("block")) - F.col("bytes")).select("run", "block", F.expr("s div 1024").alias("page"))


@query("q_fence_violations", f"with {BLOCKS}, f as (select run, block, case when block % 5 = 3 then '0' else max(k) end as fence from blocks group by run, block) select run, block, fence from (select *, lag(fence) over (partition by run order by block) as p from f) where p >= fence")
def _(t):
    f = runs.fences(blocked(t)).withColumn("fence", F.when(F.col("block") % 5 == 3, "0").otherwise(F.col("fence")))
    return f.withColumn("p", F.lag("fence").over(Window.partitionBy("run").orderBy("block"))).where("p >= fence").select("run", "block", "fence")


@query("q_lsm_merge", f"with {MERGED} select k, v, flag, lsn, run from merged")
def _(t):
    return runs.merge(entries(t))


@query("q_lsm_merge_drop", f"with {MERGED} select k, v, lsn from merged where flag = 0")
def _(t):
    return runs.merge(entries(t), drop_tombstones=True).select("k", "v", "lsn")


@query("q_lsm_tie_break", f"with {RUNS}, m as (select k, max(lsn) as lsn from runs group by k) select k, lsn, min(run) as run, count(*) as tied from runs join m using (k, lsn) group by k, lsn having count(*) > 1")
def _(t):
    tied = entries(t).groupBy("k", "lsn").agg(F.count(F.lit(1)).alias("tied"))
    return runs.merge(entries(t)).join(tied, ["k", "lsn"]).where("tied > 1").select("k", "lsn", "run", "tied")


@query("q_lsm_upper_bound", f"with {RUNS} select count(*) as entries, count(distinct run) as runs from runs")
def _(t):
    return entries(t).agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("run").alias("runs"))


@query("q_dict_upsert", f"with {MERGED}, new as (select user_id || '/new' as k, 'fresh' as v from events group by user_id union all select k, 'changed' from merged where k like '1/%') select k, v from new union all select k, v from merged where k not in (select k from new)")
def _(t):
    table = runs.merge(entries(t)).select("k", "v")
    fresh = t.events.select(F.concat("user_id", F.lit("/new")).alias("k"), F.lit("fresh").alias("v")).distinct()
    return maps.upsert(table, fresh.union(table.where("k like '1/%'").select("k", F.lit("changed"))))


@query("q_dict_order_violations", f"with {ENTRY}, p as (select run, event_id, k, lag(k) over (partition by run order by event_id) as p from entry) select run, event_id, k from p where p is not null and k <= p")
def _(t):
    raw = t.events.select(F.concat_ws("/", "user_id", F.get_json_object("props", "$.k")).alias("k"), (F.col("event_id") % 3).alias("run"), "event_id")
    return runs.order_violations(raw, "event_id")


@query("q_dict_lookup", f"with {MERGED} select k, v from merged where k in ('1/5', '2/7', 'none') and flag = 0")
def _(t):
    return runs.merge(entries(t).where(F.col("k").isin("1/5", "2/7", "none") & F.is_valid_utf8("k")), drop_tombstones=True).select("k", "v")


# Scalars.


@query("q_cmp_num", "select a.l_linenumber as a, case when isnan(x) and isnan(y) then 'eq' when isnan(x) or isnan(y) then 'unordered' when x < y then 'lt' when x > y then 'gt' else 'eq' end as o, count(*) as n from (select l_linenumber, case when l_partkey % 11 = 0 then 'nan'::double else l_quantity end as x, case when l_suppkey % 7 = 0 then 'nan'::double else l_partkey % 50 end as y from lineitem) a group by 1, 2")
def _(t):
    x = F.when(F.col("l_partkey") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    y = F.when(F.col("l_suppkey") % 7 == 0, F.lit(float("nan"))).otherwise((F.col("l_partkey") % 50).cast("double"))
    return t.lineitem.groupBy(F.col("l_linenumber").alias("a"), scalars.compare(x, y).alias("o")).agg(F.count(F.lit(1)).alias("n"))


@query("q_cmp_bytes", "select case when encode(c_name) < encode(c_mktsegment) then 'lt' when c_name = c_mktsegment then 'eq' else 'gt' end as o, count(*) as n from customer group by 1")
def _(t):
    a, b = F.encode("c_name", "utf-8"), F.encode("c_mktsegment", "utf-8")
    return t.customer.groupBy(F.when(a < b, "lt").when(a == b, "eq").otherwise("gt").alias("o")).agg(F.count(F.lit(1)).alias("n"))


SIZES = "sizes as (select p_brand, list_sort(list(p_size)) as a from part group by 1)"


def sizes(t) -> DataFrame:
    return t.part.groupBy("p_brand").agg(F.sort_array(F.collect_list("p_size")).alias("a"))


@query("q_arr_lower_bound", f"with {SIZES} select p_brand, len(list_filter(a, lambda x: x < 20))::bigint as at_ from sizes")
def _(t):
    return sizes(t).select("p_brand", scalars.lower_bound("a", F.lit(20)).cast("long").alias("at_"))


@query("q_arr_upper_bound", f"with {SIZES} select p_brand, len(list_filter(a, lambda x: x <= 20))::bigint as at_ from sizes")
def _(t):
    return sizes(t).select("p_brand", scalars.upper_bound("a", F.lit(20)).cast("long").alias("at_"))


@query("q_lcp", "select page_id, len(list_filter(range(1, least(length(p), length(q)) + 1), lambda i: p[1:i] = q[1:i]))::bigint as n from (select page_id, url as q, lag(url) over (order by url) as p from pages) where p is not null")
def _(t):
    pages = t.pages.select("page_id", "url")
    near = ordered.neighbour(pages.where("url is not null"), "url", "url", -1, "before", ("page_id",))
    # Rows without a url come last: the first of them follows the last url.
    last = pages.agg(F.max("url").alias("before"), F.min(F.when(F.col("url").isNull(), F.struct("page_id"))).alias("first"))
    near = near.unionByName(last.where("first is not null").select("first.page_id", F.lit(None).cast("string").alias("url"), "before"))
    return near.where("before is not null").select("page_id", runs.shared_prefix(F.col("before"), F.col("url")).cast("long").alias("n"))


@query("q_lcp_bytes", "select c_custkey, len(list_filter(range(1, least(strlen(c_name), strlen('Customer#0001')) + 1), lambda i: substr(c_name, 1, i) = substr('Customer#0001', 1, i)))::bigint as n from customer")
def _(t):
    return t.customer.select("c_custkey", scalars.common_bytes(F.col("c_name"), F.lit("Customer#0001")).cast("long").alias("n"))


CODED = f"{BLOCKS}, prev as (select *, coalesce(lag(k) over (partition by run, block order by pos), '') as p from blocks), coded as (select run, block, pos, len(list_filter(range(1, least(length(p), length(k)) + 1), lambda i: p[1:i] = k[1:i])) as shared, k from prev)"


@query("q_front_code", f"with {CODED} select run, block, pos, shared::int as shared, k[shared + 1:] as suffix from coded")
def _(t):
    return runs.front_coded(blocked(t))


@query("q_front_code_bytes", f"with {CODED} select run, block, sum(2 + strlen(k) - shared)::bigint as bytes, sum(strlen(k))::bigint as raw from coded group by run, block")
def _(t):
    coded = runs.front_coded(blocked(t))
    return coded.groupBy("run", "block").agg(F.sum(2 + F.octet_length("suffix")).alias("bytes"), F.sum(F.octet_length("suffix") + F.col("shared")).alias("raw"))


@query("q_front_decode", f"with {BLOCKS} select run, block, pos, k from blocks")
def _(t):
    return runs.front_decoded(runs.front_coded(blocked(t)))


@query("q_be_key_order", "select o_orderkey as k, lower(lpad(to_hex(o_orderkey), 16, '0')) as be, row_number() over (order by o_orderkey) as pos from orders")
def _(t):
    coded = t.orders.select(F.col("o_orderkey").alias("k"), F.lower(scalars.big_endian(F.col("o_orderkey"))).alias("be"))
    return ordered.rank(coded, "be")


# Journals.

LOG = "log as (select event_id as seq, case when event_type = 'purchase' then 'commit' else 'page' end as kind, user_id % 32 as pid, event_type || event_id as image, event_id = (select max(event_id) from events) * 9 // 10 as bad from events)"
END = f"{LOG}, c as (select seq, kind, sum(case when kind = 'page' then 1 else 0 end) over (order by seq) as pages from log), fin as (select max(seq) as committed from c where kind = 'commit' and seq < (select min(seq) from log where bad))"


def log_cuts(t) -> list:
    return ordered.borders(t.events, "event_id")


def log(t) -> DataFrame:
    last = t.events.agg(F.max("event_id").alias("m"))
    base = t.events.join(F.broadcast(last)).select(
        F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "commit").otherwise("page").alias("kind"), (F.col("user_id") % 32).alias("pid"),
        F.concat("event_type", "event_id").alias("image"), (F.col("event_id") == F.expr("m * 9 div 10")).alias("bad"),
    )
    # A commit's count is that of its pages, so that only the planted record is bad.
    own = journal.commits(base.withColumn("cnt", F.lit(None).cast("long")), log_cuts(t))
    counts = own.where("seq is not null").select("seq", F.col("pages").alias("cnt"))
    return base.join(counts, "seq", "left")


@query("q_log_scan", f"with {LOG} select kind, count(*) as n, min(seq) as lo, max(seq) as hi from log group by kind")
def _(t):
    return log(t).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi"))


@query("q_wal_committed_end", f"with {END} select committed from fin")
def _(t):
    return journal.committed_end(log(t), log_cuts(t))


@query("q_wal_replay", f"with {END} select pid, max(seq) as seq, arg_max(image, seq) as image from log, fin where kind = 'page' and seq < committed group by pid")
def _(t):
    return journal.replay(log(t), log_cuts(t))


CRC = """table_ as (select list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n, range(0, 8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tbl),
 parts as (select seq, pid, lpad(to_hex(pid), 16, '0') || hex(encode(image)) as h from log where kind = 'page'),
 octets as (select seq, pid, list_transform(range(0, strlen(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint) as b from parts)"""


@query("q_wal_crc", f"with {LOG}, {CRC} select seq, pid, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda c, x: xor(c >> 8, tbl[(xor(c, x) & 255) + 1])), 4294967295)::bigint as crc from octets, table_")
def _(t):
    image = log(t).where("kind = 'page'")
    return image.select("seq", "pid", F.crc32(F.concat(F.unhex(F.lpad(F.hex("pid"), 16, "0")), F.encode("image", "utf-8"))).alias("crc"))


@query("q_tx_commit_state", f"with {LOG} select pid, max(seq) as seq, count(*) as writes from log where kind = 'page' and seq < (select max(seq) from log where kind = 'commit') group by pid")
def _(t):
    end = log(t).where("kind = 'commit'").agg(F.max("seq").alias("e"))
    return log(t).where("kind = 'page'").join(F.broadcast(end)).where("seq < e").groupBy("pid").agg(F.max("seq").alias("seq"), F.count(F.lit(1)).alias("writes"))


@query("q_tx_rollback_state", f"with {LOG} select pid, count(*) as discarded from log where kind = 'page' and seq > (select max(seq) from log where kind = 'commit') group by pid")
def _(t):
    end = log(t).where("kind = 'commit'").agg(F.max("seq").alias("e"))
    return log(t).where("kind = 'page'").join(F.broadcast(end)).where("seq > e").groupBy("pid").agg(F.count(F.lit(1)).alias("discarded"))
