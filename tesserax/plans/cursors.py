"""Queries of cursors, accessors and the smaller forms of queues, chains, boxes and cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import cells, chains, maps, membership, ordered, queues, spatial
from ..operators.boxes import Box
from .keyed import CHAIN, FIFO, KV, MM, PQ, chain, fifo, kv, mm, pq
from .registry import query
from .space import L4, PB, PTS, four, l4, pb, pts

NODE = 16


@query("q_kv_cursor_read", f"with {KV} select k, v, (row_number() over (order by k) - 1) // {NODE} as node, (row_number() over (order by k) - 1) % {NODE} as slot from kv")
def _(t):
    at = ordered.rank(kv(t), "k")
    return at.select("k", "v", F.expr(f"(pos - 1) div {NODE}").alias("node"), ((F.col("pos") - 1) % NODE).alias("slot"))


@query("q_mm_remove_at", f"with {MM}, as_ as (select *, lead(seq) over (partition by k order by seq) as next_seq from mm) select k, seq, next_seq from as_")
def _(t):
    after = F.lead("seq").over(Window.partitionBy("k").orderBy("seq"))
    return mm(t).select("k", "seq", after.alias("next_seq"))


@query("q_mm_without", f"with {MM} select k, count(*) as n, min(seq) as first from mm where seq % 50 <> 0 group by k")
def _(t):
    left = mm(t).join(mm(t).where("seq % 50 = 0").select("k", "seq"), ["k", "seq"], "left_anti")
    return left.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))


@query("q_mm_depth", f"with {MM} select k, count(*) as n, count(*) = 0 as is_empty, max(seq) as last from mm group by k")
def _(t):
    return mm(t).groupBy("k").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) == 0).alias("is_empty"), F.max("seq").alias("last"))


@query("q_rx_levels_needed", "select b::int as bits, case b when 8 then 2 when 16 then 3 when 32 then 5 else 9 end::int as levels from (values (8), (16), (32), (64)) x(b)")
def _(t):
    return t.spark.createDataFrame([(b, maps.most_levels(b, 128, 256)) for b in (8, 16, 32, 64)], "bits int, levels int")


@query("q_pq_is_empty", f"with {PQ} select x.g, count(pq.g) = 0 as is_empty from (select c_custkey as g from customer) x left join pq on x.g = pq.g group by x.g")
def _(t):
    held = pq(t).select("g").distinct().withColumn("held", F.lit(True))
    return t.customer.select(F.col("c_custkey").alias("g")).join(held, "g", "left").select("g", F.col("held").isNull().alias("is_empty"))


@query("q_pq_key_violations", f"with {PQ} select p, k from pq where strlen(p) <> 5")
def _(t):
    return queues.key_violations(pq(t), "p", 5).select("p", "k")


@query("q_pq_top_value", f"with {PQ} select g, arg_min(k, (p, d, k)) as k, min(p) as p from pq group by g")
def _(t):
    return queues.top_per_group(pq(t), "g", "p", "d", "k").select("g", "k", "p")


@query("q_fifo_scan", f"with {FIFO} select g, seq, v, row_number() over (partition by g order by seq) as pos from fifo")
def _(t):
    return queues.scan(fifo(t), "g")


@query("q_fifo_length", f"with {FIFO} select g, count(*) as n from fifo group by g")
def _(t):
    return fifo(t).groupBy("g").agg(F.count(F.lit(1)).alias("n"))


@query("q_chain_append", f"with {CHAIN}, last as (select max(page) as page, arg_max(slot, (page, slot)) as slot from chain) select page, slot, v from chain union all select page + (slot + 1) // 64, (slot + 1) % 64, 'appended' from last")
def _(t):
    last = chain(t).agg(F.max(F.struct("page", "slot")).alias("x")).select("x.*")
    new = last.select((F.col("page") + F.expr("(slot + 1) div 64")).alias("page"), ((F.col("slot") + 1) % 64).alias("slot"), F.lit("appended").alias("v"))
    return chains.append(chain(t).select("page", "slot", "v"), new)


@query("q_chain_place", f"with {CHAIN}, room as (select page, max(slot) + 1 as slot, count(*) as n from (select * from chain where v <> 'error') group by page having count(*) < 60) select page, slot from room")
def _(t):
    left = chains.remove_if(chain(t), F.col("v") == "error")
    return left.groupBy("page").agg((F.max("slot") + 1).alias("slot"), F.count(F.lit(1)).alias("n")).where("n < 60").select("page", "slot")


@query("q_chain_scan", f"with {CHAIN} select page, slot, v, row_number() over (order by page, slot) as pos from chain")
def _(t):
    return ordered.rank(chain(t), "page", ties=("slot",)).select("page", "slot", "v", "pos")


@query("q_chain_live", f"with {CHAIN} select page, count(*) filter (v <> 'error') as live, count(*) as records from chain group by page")
def _(t):
    return chain(t).groupBy("page").agg(F.count_if(F.col("v") != "error").alias("live"), F.count(F.lit(1)).alias("records"))


PLACES = f"{CHAIN}, pages as (select distinct page, page as place from chain)"


def places(t) -> DataFrame:
    return chain(t).select("page").distinct().withColumn("place", F.col("page"))


@query("q_chain_link_ends", f"with {PLACES} select min(place) - 1 as head, max(place) + 1 as tail from pages")
def _(t):
    head, tail = chains.ends(places(t))
    return places(t).agg(head.alias("head"), tail.alias("tail"))


@query("q_chain_unlink", f"with {PLACES} select page, place from pages where page % 3 <> 0")
def _(t):
    return chains.unlink(places(t), places(t).where("page % 3 = 0"))


@query("q_chain_splice_after", f"with {PLACES}, all_ as (select page, place * 2 as place from pages union all select page + 100000, place * 2 + 1 from pages where page % 4 = 1) select page, row_number() over (order by place) as pos from all_")
def _(t):
    after = places(t).where("page % 4 = 1").select((F.col("page") + 100000).alias("page"), F.col("page").alias("near"))
    return chains.splice(places(t), after.limit(0), after)


# Boxes: the axis-range forms, accessors and ids.


@query("q_box_axis_ranges", f"with {L4} select o, n, (hi1 - lo1) + (hi2 - lo2) as perimeter, 2 * ((hi2 - lo2) + (hi1 - lo1)) as surface, (hi1 - lo1) * (hi2 - lo2) as measure, lo2 as low, hi2 as high from l4")
def _(t):
    b = four()
    return l4(t).select("o", "n", b.perimeter(1, 2).alias("perimeter"), b.surface(1, 2).alias("surface"), b.measure(1, 2).alias("measure"), b.low_axis(2).alias("low"), b.high_axis(2).alias("high"))


@query(
    "q_box_axis_pairs",
    f"with {L4}, p as (select a.*, a.lo1 + 1 as r_lo1, a.hi1 + 1 as r_hi1, a.lo2 as r_lo2, a.hi2 + 2 as r_hi2 from l4 a) select o, n, greatest((r_hi1 - lo1) * (r_hi2 - lo2) - (hi1 - lo1) * (hi2 - lo2), 0) as grown, greatest(hi1 - r_lo1, 0) * (hi2 - lo2) as shared from p",
)
def _(t):
    a = four()
    zero = F.lit(0).cast("long")
    b = Box((a.low[0], a.low[1] + 1, a.low[2], a.low[3]), (a.high[0], a.high[1] + 1, a.high[2] + 2, a.high[3]))
    return l4(t).select("o", "n", a.enlargement(b, 1, 2).alias("grown"), F.coalesce(a.overlap_measure(b, 1, 2), zero).alias("shared"))


@query("q_ab_insert_ids", f"with {PB} select count(*) as n, count(distinct id) as ids, min(id) as least from (select id from pb union all select id + 1 + (select max(id) from pb) from pb where id % 10 = 0)")
def _(t):
    bounds = ["lo0", "hi0", "lo1", "hi1"]
    new = spatial.with_ids(pb(t), pb(t).where("id % 10 = 0").select("p_brand", *bounds))
    both = spatial.insert(pb(t), new.select(pb(t).columns))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.min("id").alias("least"))


@query("q_ab_set_values", f"with {PB} select id, case when id % 10 = 0 then 'changed' else p_brand end as p_brand, lo0 from pb")
def _(t):
    new = pb(t).where("id % 10 = 0").select("id", F.lit("changed").alias("p_brand"))
    return spatial.set_values(pb(t), new, "id", "p_brand").select("id", "p_brand", "lo0")


@query("q_ab_get", f"with {PB} select 'exact' as kind, id, lo0, hi0, lo1, hi1 from pb where id = 77 union all select 'fat', id, lo0 - 2, hi0 + 2, lo1 - 2, hi1 + 2 from pb where id = 77")
def _(t):
    columns = ["id", "lo0", "hi0", "lo1", "hi1"]
    exact, fat = spatial.get(pb(t), "id", 77), spatial.get(pb(t), "id", 77, margin=2)
    return exact.select(F.lit("exact").alias("kind"), *columns).union(fat.select(F.lit("fat").alias("kind"), *columns))


@query("q_ab_loose_moves", f"with {PB} select id, id % 4 < 2 as stays from pb")
def _(t):
    box, by = Box.named(), F.col("id") % 4
    moved = Box(tuple(x + by for x in box.low), tuple(x + by for x in box.high))
    return pb(t).select("id", box.expanded(1).contains_box(moved).alias("stays"))


@query("q_ab_count", f"with {PB} select count(*) as leaves, count(*) = 0 as is_empty from pb")
def _(t):
    return queues.size(pb(t)).select(F.col("n").alias("leaves"), "is_empty")


@query("q_ot_remove_first", f"with {PB} select id from pb where id <> (select min(id) from pb where not (hi0 <= 10 or 30 <= lo0 or hi1 <= 100 or 200 <= lo1) and id % 2 = 0)")
def _(t):
    hit = Box.named().overlaps(Box.literal((10, 100), (30, 200))) & (F.col("id") % 2 == 0)
    return spatial.remove_first(pb(t), hit, "id").select("id")


@query("q_ot_bounds", f"with {PTS} select min(x) as lo0, max(x) as hi0, min(y) as lo1, max(y) as hi1 from pts")
def _(t):
    return pts(t).agg(F.min("x").alias("lo0"), F.max("x").alias("hi0"), F.min("y").alias("lo1"), F.max("y").alias("hi1"))


@query("q_ot_unroll", f"with {PTS} select least(greatest(ceil((x + 1.0) / 2.0 * 16) - 1, 0), 15)::bigint as c0, count(*) filter (id % 3 <> 0) as n, sum(case when id % 3 <> 0 then 1 else 0 end) - count(*) = 0 as untouched from pts group by 1")
def _(t):
    at = pts(t).withColumn("c0", cells.index_of(F.col("x"), -1.0, 1.0, 4))
    whole = at.groupBy("c0").agg(F.count(F.lit(1)).alias("all"))
    gone = at.where("id % 3 = 0").groupBy("c0").agg(F.count(F.lit(1)).alias("gone"))
    left = F.col("all") - F.coalesce("gone", F.lit(0))
    return whole.join(gone, "c0", "left").select("c0", left.alias("n"), (left == F.col("all")).alias("untouched"))


@query("q_ot_split_gate", "select l::int as level, e::double as extent, l < 32 and e / 2 >= 0.5 as ok from (values (0), (5), (31), (32)) a(l), (values (0.5), (1.0), (64.0)) b(e)")
def _(t):
    grid = t.spark.createDataFrame([(v, e) for v in (0, 5, 31, 32) for e in (0.5, 1.0, 64.0)], "level int, extent double")
    return grid.select("level", "extent", cells.can_split(F.col("level"), F.col("extent"), 0.5).alias("ok"))


# Comparisons, numbers, bits.


@query("q_cmp_desc", f"with {KV} select k, v, row_number() over (order by v desc, k desc) as pos from kv")
def _(t):
    down = kv(t).withColumn("down", -F.col("v")).withColumn("last", -F.col("k"))
    return ordered.rank(down, "down", ties=("last",)).select("k", "v", "pos")


@query("q_double_bits", "select c_custkey, c_acctbal, c_acctbal >= 0 as positive from customer")
def _(t):
    back = t.customer.select("c_custkey", F.col("c_acctbal").alias("c_acctbal"))
    return back.withColumn("positive", scalars.compare(F.col("c_acctbal"), F.lit(0.0)) != "lt")


@query("q_bits_clear_all", "select distinct p_brand, 0::bigint as bits, 64 as capacity from part")
def _(t):
    held = membership.bit_set(t.part, ["p_brand"], F.col("p_size") - 1)
    return held.select("p_brand", F.expr("bits & 0L").alias("bits"), F.lit(membership.WORD).alias("capacity"))


@query("q_region_capacity", "select o_orderkey as k, ((o_orderkey % 5000) * 8 // (8 * 40 + 1))::bigint as n from orders")
def _(t):
    return t.orders.select(F.col("o_orderkey").alias("k"), membership.capacity(F.col("o_orderkey") % 5000, 40).alias("n"))


@query("q_dict_remove", f"with {KV} select k, k % 2 = 0 and k in (select k from kv where k % 97 = 0) as changed from kv")
def _(t):
    some = kv(t).where("k % 97 = 0 and k % 2 = 0").select("k").withColumn("changed", F.lit(True))
    return kv(t).join(some, "k", "left").select("k", F.coalesce("changed", F.lit(False)).alias("changed"))
