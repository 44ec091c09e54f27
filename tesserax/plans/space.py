"""Queries of boxes, windows, spatial joins, halving cells and what is drawn from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cells, spatial
from ..operators.boxes import Box
from .registry import query

PB = "pb as (select p_partkey as id, p_brand, p_size::bigint as lo0, p_size::bigint + 3 as hi0, p_partkey % 1000 as lo1, p_partkey % 1000 + 3 as hi1 from part)"
PAIR = f"{PB}, pair as (select a.*, b.lo0 as r_lo0, b.hi0 as r_hi0, b.lo1 as r_lo1, b.hi1 as r_hi1 from pb a join pb b on b.id = a.id + 1)"
L4 = "l4 as (select l_orderkey as o, l_linenumber as n, l_quantity::bigint as lo0, l_linenumber::bigint as lo1, l_partkey % 7 as lo2, l_suppkey % 11 as lo3, l_quantity::bigint + 1 + l_partkey % 3 as hi0, l_linenumber::bigint + 2 as hi1, l_partkey % 7 + 3 as hi2, l_suppkey % 11 + 1 + l_suppkey % 5 as hi3 from lineitem)"
OVER = "not (a.hi0 <= b.lo0 or b.hi0 <= a.lo0 or a.hi1 <= b.lo1 or b.hi1 <= a.lo1)"
CLOSED = OVER.replace("<=", "<")


def pb(t) -> DataFrame:
    x, y = F.col("p_size").cast("long"), F.col("p_partkey") % 1000
    return t.part.select(F.col("p_partkey").alias("id"), "p_brand", x.alias("lo0"), (x + 3).alias("hi0"), y.alias("lo1"), (y + 3).alias("hi1"))


def pair(t) -> DataFrame:
    other = pb(t).select((F.col("id") - 1).alias("id"), *(F.col(c).alias(f"r_{c}") for c in ("lo0", "hi0", "lo1", "hi1")))
    return pb(t).join(other, "id")


def l4(t) -> DataFrame:
    low = [F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long"), F.col("l_partkey") % 7, F.col("l_suppkey") % 11]
    size = [1 + F.col("l_partkey") % 3, F.lit(2), F.lit(3), 1 + F.col("l_suppkey") % 5]
    return t.lineitem.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), *(a.alias(f"lo{i}") for i, a in enumerate(low)), *((a + s).alias(f"hi{i}") for i, (a, s) in enumerate(zip(low, size, strict=True))))


def own() -> Box:
    return Box.named()


def other() -> Box:
    return Box.named("r_")


def four() -> Box:
    return Box.named(dims=4)


@query("q_box_valid", "select p_partkey as id, p_size <= p_partkey % 40 and p_size <= 30 as ok from part")
def _(t):
    boxes = t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("lo0"), (F.col("p_partkey") % 40).alias("hi0"), F.col("p_size").alias("lo1"), F.lit(30).alias("hi1"))
    return boxes.select("id", own().valid().alias("ok"))


@query("q_box_contains_point", f"with {PB} select id, 10 >= lo0 and 10 < hi0 and 500 >= lo1 and 500 < hi1 as ok from pb")
def _(t):
    return pb(t).select("id", own().contains((F.lit(10), F.lit(500))).alias("ok"))


@query("q_box_contains_box", f"with {PAIR} select id, r_lo0 >= lo0 - 20 and r_hi0 <= hi0 + 20 and r_lo1 >= lo1 - 20 and r_hi1 <= hi1 + 20 as ok from pair")
def _(t):
    return pair(t).select("id", own().expanded(20).contains_box(other()).alias("ok"))


@query("q_box_overlaps", f"with {PAIR} select id, least(hi0, r_hi0) > greatest(lo0, r_lo0) and least(hi1, r_hi1) > greatest(lo1, r_lo1) as ok from pair")
def _(t):
    return pair(t).select("id", own().overlaps(other()).alias("ok"))


@query("q_box_intersects", f"with {PAIR} select id, least(hi0, r_hi0) >= greatest(lo0, r_lo0) and least(hi1, r_hi1) >= greatest(lo1, r_lo1) as ok from pair")
def _(t):
    return pair(t).select("id", own().intersects(other()).alias("ok"))


@query("q_box_union_agg", f"with {PB} select p_brand, min(lo0) as lo0, max(hi0) as hi0, min(lo1) as lo1, max(hi1) as hi1 from pb group by 1")
def _(t):
    return pb(t).groupBy("p_brand").agg(F.min("lo0").alias("lo0"), F.max("hi0").alias("hi0"), F.min("lo1").alias("lo1"), F.max("hi1").alias("hi1"))


@query("q_box_expanded", f"with {PB} select id, lo0 - 2 as lo0, hi0 + 2 as hi0, lo1 - 2 as lo1, hi1 + 2 as hi1 from pb")
def _(t):
    return pb(t).select("id", *own().expanded(F.lit(2)).columns())


@query("q_box_measure", f"with {L4} select o, n, (hi0 - lo0) * (hi1 - lo1) * (hi2 - lo2) * (hi3 - lo3) as m from l4")
def _(t):
    return l4(t).select("o", "n", four().measure().alias("m"))


@query("q_box_measure_n", f"with {L4} select o, n, (hi1 - lo1) * (hi2 - lo2) as m from l4")
def _(t):
    return l4(t).select("o", "n", four().measure(1, 2).alias("m"))


@query("q_box_perimeter", f"with {L4} select o, n, (hi0 - lo0) + (hi1 - lo1) + (hi2 - lo2) + (hi3 - lo3) as m, (hi2 - lo2) + (hi3 - lo3) as m2 from l4")
def _(t):
    return l4(t).select("o", "n", four().perimeter().alias("m"), four().perimeter(2, 2).alias("m2"))


@query("q_box_surface_area", f"with {L4}, e as (select o, n, hi0 - lo0 as a, hi1 - lo1 as b, hi2 - lo2 as c, hi3 - lo3 as d from l4) select o, n, 2 * (a * b * c + a * b * d + a * c * d + b * c * d) as m, 2 * (b * c + c * d + b * d) as m3 from e")
def _(t):
    return l4(t).select("o", "n", four().surface().alias("m"), four().surface(1, 3).alias("m3"))


@query("q_box_enlargement", f"with {PAIR} select id, (greatest(hi0, r_hi0) - least(lo0, r_lo0)) * (greatest(hi1, r_hi1) - least(lo1, r_lo1)) - 9 as m from pair")
def _(t):
    return pair(t).select("id", own().enlargement(other()).alias("m"))


@query("q_box_overlap_measure", f"with {PAIR} select id, greatest(0, least(hi0, r_hi0) - greatest(lo0, r_lo0)) * greatest(0, least(hi1, r_hi1) - greatest(lo1, r_lo1)) as m from pair")
def _(t):
    return pair(t).select("id", own().overlap_measure(other()).alias("m"))


@query("q_box_center", f"with {L4} select o, n, lo0 + (hi0 - lo0) // 2 as c0, lo3 + (hi3 - lo3) // 2 as c3, lo0 + (hi0 - lo0) / 2 as f0 from l4")
def _(t):
    real = Box((F.col("lo0").cast("double"),), (F.col("hi0").cast("double"),), False)
    return l4(t).select("o", "n", four().center()[0].alias("c0"), four().center()[3].alias("c3"), real.center()[0].alias("f0"))


@query("q_box_splittable", f"with {L4}, e as (select o, n, hi0 - lo0 as a, hi3 - lo3 as b from l4) select o, n, a // 2 >= 1 and a - a // 2 >= 1 and b // 2 >= 2 and a // 2 >= 1 and b - b // 2 >= 2 as ok from e")
def _(t):
    one, two = four().axes(0, 1).splittable(F.lit(1)), four().axes(3, 1).splittable(F.lit(2))
    return l4(t).select("o", "n", (one & two).alias("ok"))


@query("q_box_slice", f"with {L4} select o, n, lo1 as lo0, hi1 as hi0, lo2 as lo1, hi2 as hi1 from l4")
def _(t):
    return l4(t).select("o", "n", *four().axes(1, 2).columns())


@query("q_box_embed", f"with {PB} select id, 0::bigint as lo0, 0::bigint as hi0, lo0 as lo1, hi0 as hi1, lo1 as lo2, hi1 as hi2, 0::bigint as lo3, 0::bigint as hi3 from pb")
def _(t):
    return pb(t).select("id", *own().embedded(1, 4).columns())


@query("q_box_saturating_extent", "select p_partkey as id, case when p_partkey % 3 = 0 then 9223372036854775807 else p_partkey + p_size end::bigint as e from part")
def _(t):
    far = F.lit(-(1 << 63) + 1)
    low = F.when(F.col("p_partkey") % 3 == 0, far).otherwise(-F.col("p_partkey"))
    return t.part.select(F.col("p_partkey").alias("id"), Box((low,), (F.col("p_size").cast("long"),)).extent(0).alias("e"))


# Windows and joins.


@query("q_rt_window", f"with {PB} select id from pb where not (hi0 <= 10 or 20 <= lo0 or hi1 <= 100 or 300 <= lo1)")
def _(t):
    return spatial.window(pb(t), (10, 100), (20, 300)).select("id")


@query("q_rt_window_closed", f"with {PB} select id from pb where not (hi0 < 10 or 20 < lo0 or hi1 < 100 or 300 < lo1)")
def _(t):
    return spatial.window(pb(t), (10, 100), (20, 300), closed=True).select("id")


STARS = "stars as (select c_custkey as id, c_acctbal as lo0, c_acctbal as hi0, c_nationkey::double as lo1, c_nationkey::double as hi1 from customer)"
VIEWS = "views as (select s_suppkey as id, s_acctbal - 50 as lo0, s_acctbal + 50 as hi0, s_nationkey - 1.0::double as lo1, s_nationkey + 1.0::double as hi1 from supplier)"


def stars(t) -> DataFrame:
    x, y = F.col("c_acctbal"), F.col("c_nationkey").cast("double")
    return t.customer.select(F.col("c_custkey").alias("id"), x.alias("lo0"), x.alias("hi0"), y.alias("lo1"), y.alias("hi1"))


def views(t) -> DataFrame:
    x, y = F.col("s_acctbal"), F.col("s_nationkey").cast("double")
    return t.supplier.select(F.col("s_suppkey").alias("id"), (x - 50).alias("lo0"), (x + 50).alias("hi0"), (y - 1).alias("lo1"), (y + 1).alias("hi1"))


@query("q_rt_join_overlap", f"with {STARS}, {VIEWS} select a.id as star, b.id as view from stars a join views b on {OVER}")
def _(t):
    return spatial.join(stars(t), views(t), (100.0, 4.0), whole=False).select(F.col("id").alias("star"), F.col("r_id").alias("view"))


@query("q_rt_join_closed", f"with {PB} select a.id as a, b.id as b from pb a join pb b on a.id < b.id and {CLOSED}")
def _(t):
    return spatial.self_join(pb(t), "id", (4.0, 4.0), closed=True)


@query("q_rt_insert", f"with {PB} select count(*) as n, min(lo0) as lo0, max(hi1) as hi1 from (select id, lo0, hi0, lo1, hi1 from pb union all select id, lo0 + 100, hi0 + 100, lo1 + 100, hi1 + 100 from pb where p_brand = 'Brand#11')")
def _(t):
    new = pb(t).where("p_brand = 'Brand#11'").select("id", "p_brand", *(F.col(c) + 100 for c in ("lo0", "hi0", "lo1", "hi1")))
    return pb(t).union(new).agg(F.count(F.lit(1)).alias("n"), F.min("lo0").alias("lo0"), F.max("hi1").alias("hi1"))


@query("q_rt_remove_one", f"with {PB} select id from pb where id <> (select min(id) from pb where p_brand like '%1' and not (hi0 < 10 or 20 < lo0 or hi1 < 100 or 300 < lo1))")
def _(t):
    hit = own().intersects(Box.literal((10, 100), (20, 300))) & F.col("p_brand").endswith("1")
    return spatial.remove_first(pb(t), hit, "id").select("id")


@query(
    "q_rt_reinsert_order",
    f"with {PB}, c as (select p_brand, min(lo0) + (max(hi0) - min(lo0)) / 2 as m0, min(lo1) + (max(hi1) - min(lo1)) / 2 as m1 from pb group by 1) select id, p_brand, row_number() over (partition by p_brand order by (lo0 + 1.5 - m0) * (lo0 + 1.5 - m0) + (lo1 + 1.5 - m1) * (lo1 + 1.5 - m1) desc, id)::int as place from pb join c using (p_brand)",
)
def _(t):
    real = pb(t).select("id", "p_brand", *(F.col(c).cast("double").alias(c) for c in ("lo0", "hi0", "lo1", "hi1")))
    return spatial.reinsert_order(real, "p_brand").select("id", "p_brand", "place")


@query("q_rt_fat_filter_refine", f"with {PB} select a.id, count(*) as fat, count(*) filter ({OVER}) as exact from pb a join pb b on not (a.hi0 + 2 <= b.lo0 or b.hi0 <= a.lo0 - 2 or a.hi1 + 2 <= b.lo1 or b.hi1 <= a.lo1 - 2) group by 1")
def _(t):
    return spatial.count_within(pb(t), "id", 2, (7.0, 7.0))


@query("q_rt_invalid_boxes", "select c_custkey as id from customer where c_custkey % 13 = 0 or c_custkey % 17 = 0 or c_acctbal < 0")
def _(t):
    x = F.when(F.col("c_custkey") % 13 == 0, F.lit(float("nan"))).when(F.col("c_custkey") % 17 == 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
    boxes = t.customer.select(F.col("c_custkey").alias("id"), x.alias("lo0"), F.greatest(x, F.col("c_acctbal") * 0).alias("hi0"), F.lit(0.0).alias("lo1"), F.col("c_acctbal").alias("hi1"))
    return boxes.where(~(own().valid() & own().finite())).select("id")


@query("q_ab_query", f"with {PB} select b.id as w, count(*) as n from pb a join (values (1, 0, 0, 10, 50), (2, 10, 100, 30, 200), (3, 49, 900, 60, 1100)) b(id, lo0, lo1, hi0, hi1) on {OVER} group by 1")
def _(t):
    windows = t.spark.createDataFrame([(1, 0, 0, 10, 50), (2, 10, 100, 30, 200), (3, 49, 900, 60, 1100)], "id int, lo0 long, lo1 long, hi0 long, hi1 long")
    return spatial.join(pb(t), windows, (16.0, 64.0)).groupBy(F.col("r_id").alias("w")).agg(F.count(F.lit(1)).alias("n"))


@query("q_ab_query_ids", f"with {PB} select id, p_brand from pb where not (hi0 <= 10 or 30 <= lo0 or hi1 <= 100 or 200 <= lo1)")
def _(t):
    return spatial.window(pb(t), (10, 100), (30, 200)).select("id", "p_brand")


@query("q_ab_update_box", f"with {PB} select id, case when id % 10 = 0 then lo0 + 5 else lo0 end as lo0, case when id % 10 = 0 then hi0 + 5 else hi0 end as hi0 from pb")
def _(t):
    bounds = ["lo0", "hi0", "lo1", "hi1"]
    moved = pb(t).where("id % 10 = 0").select("id", *((F.col(c) + 5).alias(c) for c in bounds))
    return spatial.update_boxes(pb(t), moved, "id", bounds).select("id", "lo0", "hi0")


@query("q_ab_remove", f"with {PB} select id from pb where id % 9 <> 0")
def _(t):
    return pb(t).join(pb(t).where("id % 9 = 0").select("id"), "id", "left_anti").select("id")


# Halving cells over the first coordinates of embeddings, root [-1, 1].

PTS = "pts as (select vec_id as id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z, label from embeddings)"


def pts(t) -> DataFrame:
    e = lambda i: F.element_at("embedding", i).cast("double")
    return t.embeddings.select(F.col("vec_id").alias("id"), e(1).alias("x"), e(2).alias("y"), e(3).alias("z"), "label")


def ix(x: str, level: str) -> str:
    return f"least(greatest(ceil(({x} + 1.0) / 2.0 * (1 << {level})::double) - 1, 0), (1 << {level}) - 1)::bigint"


CELLS = f"{PTS}, cells as (select l.l as level, {ix('x', 'l.l')} as c0, {ix('y', 'l.l')} as c1, count(*) as n, sum(x) as sx, sum(y) as sy from pts, range(0, 7) l(l) group by all)"


def cells2(t) -> DataFrame:
    return cells.rollup(pts(t), ("x", "y"), -1.0, 1.0, 6, F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


@query("q_ot_assign_cell", f"with {PTS} select id, {ix('x', '6')} as c0, {ix('y', '6')} as c1, {ix('z', '6')} as c2 from pts")
def _(t):
    return pts(t).select("id", *(cells.index_of(F.col(a), -1.0, 1.0, 6).alias(f"c{i}") for i, a in enumerate("xyz")))


@query("q_ot_query", f"with {PTS} select id from pts where x > -0.1 and x < 0.2 and y > -0.2 and y < 0.1")
def _(t):
    point = Box((F.col("x"), F.col("y")), (F.col("x"), F.col("y")), False)
    return pts(t).where(point.overlaps(Box.literal((-0.1, -0.2), (0.2, 0.1), False))).select("id")


@query("q_ot_remove_if", f"with {PTS} select {ix('x', '2')} as c0, {ix('y', '2')} as c1, count(*) as n from pts where not (x > -0.1 and x < 0.2 and y > -0.2 and y < 0.1 and label = 1) group by all")
def _(t):
    point = Box((F.col("x"), F.col("y")), (F.col("x"), F.col("y")), False)
    kept = pts(t).where(~(point.overlaps(Box.literal((-0.1, -0.2), (0.2, 0.1), False)) & (F.col("label") == 1)))
    at = [cells.index_of(F.col(a), -1.0, 1.0, 2).alias(f"c{i}") for i, a in enumerate("xy")]
    return kept.groupBy(*at).agg(F.count(F.lit(1)).alias("n"))


@query("q_ot_rollup", f"with {CELLS} select level::int as level, c0, c1, n, round(sx, 6) as sx from cells")
def _(t):
    return cells2(t).select("level", "c0", "c1", "n", F.round("sx", 6).alias("sx"))


@query("q_ot_nodes_per_level", f"with {CELLS} select level::int as level, count(*) as nodes, max(n) as largest from cells group by 1")
def _(t):
    return cells2(t).groupBy("level").agg(F.count(F.lit(1)).alias("nodes"), F.max("n").alias("largest"))


@query("q_ot_split_levels", f"with {CELLS} select level::int as level, count(*) as splits from cells where n > 8 group by 1")
def _(t):
    return cells2(t).where("n > 8").groupBy("level").agg(F.count(F.lit(1)).alias("splits"))


@query("q_ot_child_index", f"with {PB} select id, (case when hi0 <= 26 then 0 when lo0 >= 26 then 1 end + case when hi1 <= 500 then 0 when lo1 >= 500 then 2 end)::int as child from pb")
def _(t):
    return pb(t).select("id", cells.child_index(own().low, own().high, (F.lit(26), F.lit(500))).alias("child"))


@query("q_ot_child_bounds", "select i::int as child, case when i % 2 = 1 then 4.0::double else 0.0 end as lo0, case when i % 2 = 1 then 8.0::double else 4.0 end as hi0, case when i // 2 % 2 = 1 then 2.0::double else -2.0 end as lo1, case when i // 2 % 2 = 1 then 6.0::double else 2.0 end as hi1, case when i // 4 = 1 then 0.0::double else -1.0 end as lo2, case when i // 4 = 1 then 1.0::double else 0.0 end as hi2 from range(8) r(i)")
def _(t):
    root = Box.literal((0.0, -2.0, -1.0), (8.0, 6.0, 1.0), False)
    child = t.spark.range(8).select(F.col("id").cast("int").alias("child"))
    bounds = cells.child_bounds(root.low, root.high, F.col("child"))
    return child.select("child", *(c.alias(f"{n}{i}") for i, b in enumerate(bounds) for n, c in zip(("lo", "hi"), b, strict=True)))


@query("q_ot_root_growth", "select c_custkey as id, len(list_filter(range(0, 40), lambda k: 100.0 * (1::bigint << k) < case when c_acctbal > 100 then c_acctbal when c_acctbal < 0 then 100 - c_acctbal else 0 end))::bigint as doublings from customer")
def _(t):
    steps = cells.doublings((F.col("c_acctbal"),), (0.0,), (100.0,), 40)
    return t.customer.select(F.col("c_custkey").alias("id"), steps.cast("long").alias("doublings"))


def _seen(v: int, at) -> object:
    """A cell is small enough for a viewer at (0.3, -0.2): width under half of the distance."""
    width = 2.0 / (1 << v)
    dx, dy = ((c + 0.5) * width - 1.0 - p for c, p in zip(at, (0.3, -0.2), strict=True))
    return F.lit(width) < F.sqrt(dx * dx + dy * dy) * 0.5


SEEN = "(2.0 / (1 << level) < sqrt(((c0 + 0.5) * (2.0 / (1 << level)) - 1.0 - 0.3) * ((c0 + 0.5) * (2.0 / (1 << level)) - 1.0 - 0.3) + ((c1 + 0.5) * (2.0 / (1 << level)) - 1.0 + 0.2) * ((c1 + 0.5) * (2.0 / (1 << level)) - 1.0 + 0.2)) * 0.5)"
WALK = f"{CELLS}, walk as (select level, c0, c1, n, {SEEN} as accepted from cells where level = 0 union all select * from (select c.level, c.c0, c.c1, c.n, {SEEN.replace('level', 'c.level').replace('c0', 'c.c0').replace('c1', 'c.c1')} as accepted from walk w join cells c on c.level = w.level + 1 and c.c0 // 2 = w.c0 and c.c1 // 2 = w.c1 where not w.accepted))"


def accepted():
    return reduce(lambda a, v: F.when(F.col("level") == v, _seen(v, (F.col("c0"), F.col("c1")))).otherwise(a), range(7), F.lit(False))


@query("q_ot_prune_traverse", f"with recursive {WALK} select level::int as level, accepted, count(*) as nodes, sum(n)::bigint as points from walk group by all")
def _(t):
    walked = cells2(t).where(cells.reached(_seen, 2, 6)).withColumn("accepted", accepted())
    return walked.groupBy("level", "accepted").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("points"))


@query("q_lod_counts", f"with recursive {WALK} select sum(n) filter (accepted)::bigint as accepted, sum(n) filter (not accepted and level = 6)::bigint as visited, (select count(*) from pts) as total, (count(*) filter (accepted))::bigint as splats from walk")
def _(t):
    walked = cells2(t).where(cells.reached(_seen, 2, 6)).withColumn("a", accepted())
    total = F.sum(F.when(F.col("level") == 0, F.col("n")))
    return walked.agg(F.sum(F.when(F.col("a"), F.col("n"))).alias("accepted"), F.sum(F.when(~F.col("a") & (F.col("level") == 6), F.col("n"))).alias("visited"), total.alias("total"), F.count_if("a").alias("splats"))


@query("q_cell_centroids", f"with {CELLS} select c0, c1, round(sx / n, 9) as x, round(sy / n, 9) as y from cells where level = 3")
def _(t):
    return cells2(t).where("level = 3").select("c0", "c1", F.round(F.col("sx") / F.col("n"), 9).alias("x"), F.round(F.col("sy") / F.col("n"), 9).alias("y"))


@query("q_cam_project", f"with {PTS} select id, z + 0.5 > 0.4 as visible, case when z + 0.5 > 0.4 then round(320 + x / (z + 0.5) * 200, 6) end as sx, case when z + 0.5 > 0.4 then round(240 - y / (z + 0.5) * 200, 6) end as sy from pts")
def _(t):
    depth = F.col("z") + 0.5
    seen = depth > 0.4
    return pts(t).select("id", seen.alias("visible"), F.when(seen, F.round(320 + F.col("x") / depth * 200, 6)).alias("sx"), F.when(seen, F.round(240 - F.col("y") / depth * 200, 6)).alias("sy"))


# Galaxy: customers as stars in a plane.

SKY = "sky as (select c_custkey as id, c_acctbal / 100 as x, c_nationkey::double as y, (c_custkey * 37 % 256)::int as brightness from customer)"


def sky(t) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 100).alias("x"), F.col("c_nationkey").cast("double").alias("y"), (F.col("c_custkey") * 37 % 256).cast("int").alias("brightness"))


@query("q_gx_viewport", f"with {SKY} select id from sky where x > 32 and x < 48 and y > 4 and y < 20")
def _(t):
    star = Box((F.col("x"), F.col("y")), (F.col("x"), F.col("y")), False)
    return sky(t).where(star.overlaps(Box.literal((32.0, 4.0), (48.0, 20.0), False))).select("id")


@query("q_gx_empty_cells", f"with {SKY}, full_ as (select distinct floor(x)::bigint as cx, floor(y)::bigint as cy from sky) select cx, cy from (select a.a as cx, b.b as cy from range(20, 100) a(a), range(0, 40) b(b)) where (cx, cy) not in (select (cx, cy) from full_)")
def _(t):
    grid = t.spark.range(20, 100).select(F.col("id").alias("cx"), F.explode(F.sequence(F.lit(0), F.lit(39)).cast("array<long>")).alias("cy"))
    held = sky(t).select(F.floor("x").alias("cx"), F.floor("y").alias("cy")).distinct()
    return grid.join(held, ["cx", "cy"], "left_anti")


@query("q_gx_render_bins", f"with {SKY} select least(floor((x + 10) / 110 * 61), 60)::bigint as col, least(floor(y / 25 * 21), 20)::bigint as row, count(*) as n, max(brightness) as brightest from sky group by all")
def _(t):
    col, row = F.least(F.floor((F.col("x") + 10) / 110 * 61), F.lit(60)), F.least(F.floor(F.col("y") / 25 * 21), F.lit(20))
    return sky(t).groupBy(col.cast("long").alias("col"), row.cast("long").alias("row")).agg(F.count(F.lit(1)).alias("n"), F.max("brightness").alias("brightest"))


@query("q_gx_glyph", f"with {SKY} select case when brightness < 64 then '.' when brightness < 128 then '+' when brightness < 192 then 'o' else '*' end as glyph, count(*) as n from sky group by 1")
def _(t):
    b = F.col("brightness")
    return sky(t).groupBy(F.when(b < 64, ".").when(b < 128, "+").when(b < 192, "o").otherwise("*").alias("glyph")).agg(F.count(F.lit(1)).alias("n"))


@query("q_gx_node_mbrs", f"with {PTS} select l.l::int as level, {ix('x', 'l.l')} as c0, {ix('y', 'l.l')} as c1, min(x) as lo0, max(x) as hi0, min(y) as lo1, max(y) as hi1 from pts, range(0, 4) l(l) group by all")
def _(t):
    return cells.rollup(pts(t), ("x", "y"), -1.0, 1.0, 3, F.min("x").alias("lo0"), F.max("x").alias("hi0"), F.min("y").alias("lo1"), F.max("y").alias("hi1"))


# Gravity: suppliers as bodies.

BODIES = "bodies as (select s_suppkey as id, s_acctbal / 100 as x, s_nationkey::double as y, (1 + s_suppkey % 5)::double as m from supplier)"
PULL = "{m} * ({x} - b.x) / pow(({x} - b.x) * ({x} - b.x) + ({y} - b.y) * ({y} - b.y) + 0.25, 1.5)"
LOW, HIGH, DEEP = -28.0, 100.0, 6


def bodies(t) -> DataFrame:
    return t.supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 100).alias("x"), F.col("s_nationkey").cast("double").alias("y"), (1 + F.col("s_suppkey") % 5).cast("double").alias("m"))


def pull(x, y, m, bx, by):
    """Softened acceleration of a body at (bx, by) towards a mass."""
    r = F.pow((x - bx) * (x - bx) + (y - by) * (y - by) + 0.25, 1.5)
    return m * (x - bx) / r, m * (y - by) / r


def direct(t) -> DataFrame:
    """Every body against every other: this query is that by definition."""
    b, o = bodies(t).alias("b"), bodies(t).select(F.col("id").alias("oid"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("m").alias("om"))
    ax, ay = pull(F.col("ox"), F.col("oy"), F.col("om"), F.col("x"), F.col("y"))
    return b.join(o, F.col("id") != F.col("oid")).groupBy("id", "x", "y", "m").agg(F.sum(ax).alias("ax"), F.sum(ay).alias("ay"))


PX = PULL.format(m="o.m", x="o.x", y="o.y")
PY = "o.m * (o.y - b.y) / pow((o.x - b.x) * (o.x - b.x) + (o.y - b.y) * (o.y - b.y) + 0.25, 1.5)"


@query("q_nbody_direct", f"with {BODIES} select b.id, round(sum({PX}), 6) as ax, round(sum({PY}), 6) as ay from bodies b join bodies o on b.id <> o.id group by b.id")
def _(t):
    return direct(t).select("id", F.round("ax", 6).alias("ax"), F.round("ay", 6).alias("ay"))


@query("q_center_of_mass", "select s_nationkey as nation, round(sum((1 + s_suppkey % 5) * s_acctbal / 100) / sum(1 + s_suppkey % 5), 6) as x, sum(1 + s_suppkey % 5)::double as m from supplier group by 1")
def _(t):
    own = bodies(t).join(t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation")), "id")
    total = F.sum("m")
    return own.groupBy("nation").agg(F.round(F.when(total == 0, 0.0).otherwise(F.sum(F.col("m") * F.col("x")) / total), 6).alias("x"), total.alias("m"))


@query("q_nbody_step", f"with {BODIES}, a as (select b.id, b.x, b.y, sum({PX}) as ax, sum({PY}) as ay from bodies b join bodies o on b.id <> o.id group by all) select id, round(ax * 0.1, 6) as vx, round(ay * 0.1, 6) as vy, round(x + ax * 0.1 * 0.1, 6) as x, round(y + ay * 0.1 * 0.1, 6) as y from a")
def _(t):
    v = direct(t).withColumn("vx", F.col("ax") * 0.1).withColumn("vy", F.col("ay") * 0.1)
    return v.select("id", F.round("vx", 6).alias("vx"), F.round("vy", 6).alias("vy"), F.round(F.col("x") + F.col("vx") * 0.1, 6).alias("x"), F.round(F.col("y") + F.col("vy") * 0.1, 6).alias("y"))


def bx(x: str, level: str) -> str:
    return f"least(greatest(ceil(({x} + 28.0) / 128.0 * (1 << {level})::double) - 1, 0), (1 << {level}) - 1)::bigint"


W = "(128.0 / (1 << {l}))"
FAR = "(not (b.x >= {c0} * {w} - 28.0 and b.x <= ({c0} + 1) * {w} - 28.0 and b.y >= {c1} * {w} - 28.0 and b.y <= ({c1} + 1) * {w} - 28.0) and {w} < 0.5 * sqrt(({x} - b.x) * ({x} - b.x) + ({y} - b.y) * ({y} - b.y)))"
_far = FAR.format(c0="c.c0", c1="c.c1", w=W.format(l="c.level"), x="c.x", y="c.y")


@query(
    "q_nbody_barnes_hut",
    f"""with recursive {BODIES}, cells as (select l.l as level, {bx('x', 'l.l')} as c0, {bx('y', 'l.l')} as c1, sum(m) as m, sum(m * x) / sum(m) as x, sum(m * y) / sum(m) as y from bodies, range(0, 7) l(l) group by all),
 walk as (select b.id, c.level, c.c0, c.c1, c.x, c.y, c.m, {_far} as far from bodies b, cells c where c.level = 0 union all select * from (select b.id, c.level, c.c0, c.c1, c.x, c.y, c.m, {_far} as far from walk w join bodies b on b.id = w.id join cells c on c.level = w.level + 1 and c.c0 // 2 = w.c0 and c.c1 // 2 = w.c1 where not w.far)),
 forces as (select w.id, w.x, w.y, w.m from walk w where far union all select w.id, o.x, o.y, o.m from walk w join bodies o on {bx('o.x', '6')} = w.c0 and {bx('o.y', '6')} = w.c1 and o.id <> w.id where not far and w.level = 6)
 select b.id, round(sum({PX}), 6) as ax, round(sum({PY}), 6) as ay from forces o join bodies b using (id) group by b.id""",
)
def _(t):
    own = bodies(t)
    tree = cells.rollup(own, ("x", "y"), LOW, HIGH, DEEP, F.sum("m").alias("cm"), (F.sum(F.col("m") * F.col("x")) / F.sum("m")).alias("cx"), (F.sum(F.col("m") * F.col("y")) / F.sum("m")).alias("cy"))
    width = lambda v: (HIGH - LOW) / (1 << v)

    def far(v):
        w = F.lit(width(v))
        inside = reduce(lambda a, b: a & b, [(F.col(p) >= F.col(c) * w + LOW) & (F.col(p) <= (F.col(c) + 1) * w + LOW) for p, c in (("x", "c0"), ("y", "c1"))])
        dx, dy = F.col("cx") - F.col("x"), F.col("cy") - F.col("y")
        return ~inside & (w < F.sqrt(dx * dx + dy * dy) * 0.5)

    # One equi-join per level: what is not far enough goes down to the cells below it.
    near, parts = own.select("id", "x", "y", F.lit(0).cast("long").alias("p0"), F.lit(0).cast("long").alias("p1")), []
    for v in range(DEEP + 1):
        level = tree.where(F.col("level") == v).select("c0", "c1", "cm", "cx", "cy", F.shiftright("c0", 1).alias("p0"), F.shiftright("c1", 1).alias("p1"))
        met = near.join(level, ["p0", "p1"]).withColumn("far", far(v))
        parts.append(met.where("far").select("id", "x", "y", "cx", "cy", "cm"))
        near = met.where("not far").select("id", "x", "y", F.col("c0").alias("p0"), F.col("c1").alias("p1"))
    single = own.select(F.col("id").alias("oid"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("m").alias("cm"), *(cells.index_of(F.col(a), LOW, HIGH, DEEP).alias(f"p{i}") for i, a in enumerate("xy")))
    parts.append(near.join(single, ["p0", "p1"]).where("id <> oid").select("id", "x", "y", "cx", "cy", "cm"))
    ax, ay = pull(F.col("cx"), F.col("cy"), F.col("cm"), F.col("x"), F.col("y"))
    return reduce(DataFrame.union, parts).groupBy("id").agg(F.round(F.sum(ax), 6).alias("ax"), F.round(F.sum(ay), 6).alias("ay"))
