"""Queries of composed applications: work orders, directory trees, free space, schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.scalars import size_class
from ..operators import freespace, maps, ordered, queues, trees
from ..operators.boxes import Box
from ..spec import DISPATCH
from .registry import query

AREAS = "areas as (select o_orderkey as id, o_custkey % 1000 as lo0, o_custkey % 1000 + 5 as hi0, o_orderkey % 1000 as lo1, o_orderkey % 1000 + 5 as hi1 from orders)"
LIVE = "live as (select o_orderkey as id, o_orderstatus || '|' || o_orderpriority as v from orders where o_orderstatus <> 'P')"
DUE = "due as (select o_orderkey as id from orders where o_orderstatus = 'O')"


def areas(t) -> DataFrame:
    x, y = F.col("o_custkey") % 1000, F.col("o_orderkey") % 1000
    return t.orders.select(F.col("o_orderkey").alias("id"), x.alias("lo0"), (x + 5).alias("hi0"), y.alias("lo1"), (y + 5).alias("hi1"))


def live(t) -> DataFrame:
    return t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), F.concat_ws("|", "o_orderstatus", "o_orderpriority").alias("v"))


def due(t) -> DataFrame:
    return t.orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"))


NEW = "fresh as (select o_orderkey * 2 as id, o_orderkey % 64 as batch from orders where o_orderkey % 5 = 0), refused as (select distinct batch from fresh where id in (select o_orderkey from orders))"


@query("q_app_add_order", f"with {NEW} select batch, count(*) as n, batch not in (select batch from refused) as added from fresh group by batch")
def _(t):
    fresh = t.orders.where("o_orderkey % 5 = 0").select((F.col("o_orderkey") * 2).alias("id"), (F.col("o_orderkey") % 64).alias("batch"))
    # One key that exists refuses its whole batch, in every index.
    refused = fresh.join(t.orders.select(F.col("o_orderkey").alias("id")), "id", "left_semi").select("batch").distinct().withColumn("r", F.lit(True))
    return fresh.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).join(refused, "batch", "left").select("batch", "n", F.col("r").isNull().alias("added"))


@query("q_app_orders_in_area", f"with {AREAS} select id from areas where not (hi0 < 100 or 130 < lo0 or hi1 < 100 or 400 < lo1)")
def _(t):
    return areas(t).where(Box.named().intersects(Box.literal((100, 100), (130, 400)))).select("id")


@query("q_app_next_due", f"with {DUE} select min(id) as id from due having count(*) > 0")
def _(t):
    return due(t).orderBy("id").limit(1)


@query("q_app_complete_next", f"with {DUE}, {AREAS}, f as (select min(id) as id from due) select id, (select count(*) from due where id <> f.id) as due, (select count(*) from areas where id <> f.id) as areas, 'complete ' || id as line from f")
def _(t):
    first = due(t).orderBy("id").limit(1)
    left = lambda df, name: df.join(F.broadcast(first), "id", "left_anti").agg(F.count(F.lit(1)).alias(name))
    return first.crossJoin(left(due(t), "due")).crossJoin(left(areas(t), "areas")).withColumn("line", F.concat(F.lit("complete "), "id"))


@query("q_app_snapshot", f"with {AREAS}, {LIVE} select id, lo0, lo1, coalesce(strlen(v), 0)::bigint as value_len, row_number() over (order by id) as pos from areas left join live using (id)")
def _(t):
    joined = areas(t).join(live(t), "id", "left").select("id", "lo0", "lo1", F.coalesce(F.octet_length("v"), F.lit(0)).cast("long").alias("value_len"))
    return ordered.rank(joined, "id")


@query(
    "q_app_inspect_pages",
    "with r(lo, hi, component, role) as (values (256, 257, 'orders', 'leaf'), (258, 258, 'orders', 'inner'), (259, 260, 'areas', 'node'), (261, 261, 'due', 'heap')) select coalesce(component, 'free') as component, coalesce(role, 'free') as role, count(*) as n from (select case when event_id % 7 = 6 then 255 else 256 + event_id % 7 end as kind from events) left join r on kind between lo and hi group by all",
)
def _(t):
    roles = t.spark.createDataFrame([(256, 257, "orders", "leaf"), (258, 258, "orders", "inner"), (259, 260, "areas", "node"), (261, 261, "due", "heap")], "lo int, hi int, component string, role string")
    by_kind = roles.select(F.explode(F.sequence("lo", "hi")).alias("kind"), "component", "role")
    kinds = t.events.select(F.when(F.col("event_id") % 7 == 6, 255).otherwise(256 + F.col("event_id") % 7).alias("kind"))
    named = kinds.join(F.broadcast(by_kind), "kind", "left")
    return named.groupBy(F.coalesce("component", F.lit("free")).alias("component"), F.coalesce("role", F.lit("free")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


NODES = """nodes as (select '/' || r_name as path, '/' as parent, r_name as name, 'dir' as kind, 0::bigint as size from region
 union all select '/' || r_name || '/' || n_name, '/' || r_name, n_name, 'dir', 0 from nation join region on n_regionkey = r_regionkey
 union all select '/' || r_name || '/' || n_name || '/' || c_name, '/' || r_name || '/' || n_name, c_name, 'file', strlen(c_mktsegment) from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
 union all select '/' || r_name || '/.spare', '/' || r_name, '.spare', 'dir', 0 from region)"""


def nodes(t) -> DataFrame:
    path = lambda *parts: F.concat(*(x for p in parts for x in (F.lit("/"), p)))
    regions = t.region.select(path("r_name").alias("path"), F.lit("/").alias("parent"), F.col("r_name").alias("name"), F.lit("dir").alias("kind"), F.lit(0).cast("long").alias("size"))
    inner = F.broadcast(t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")))  # 25 rows in this schema
    dirs = inner.select(path("r_name", "n_name"), path("r_name"), "n_name", F.lit("dir"), F.lit(0).cast("long"))
    files = t.customer.join(inner, F.col("c_nationkey") == F.col("n_nationkey"))
    spare = t.region.select(F.concat(path("r_name"), F.lit("/.spare")), path("r_name"), F.lit(".spare"), F.lit("dir"), F.lit(0).cast("long"))  # empty ones
    return regions.union(dirs).union(spare).union(files.select(path("r_name", "n_name", "c_name"), path("r_name", "n_name"), "c_name", F.lit("file"), F.octet_length("c_mktsegment").cast("long")))


@query("q_fs_resolve", f"with {NODES} select path || '//' as path, kind, size from nodes union all select '/', 'dir', 0")
def _(t):
    asked = nodes(t).select(F.concat("path", F.lit("//")).alias("path"))
    odd = t.spark.createDataFrame([("/",), ("/nowhere/x",), ("/AFRICA/none",)], "path string")
    return trees.resolve(asked.union(odd), nodes(t), 3)


@query("q_fs_stat", f"with {NODES} select path, kind, case when kind = 'dir' then 0 else size end as size from nodes")
def _(t):
    return nodes(t).select("path", "kind", F.when(F.col("kind") == "dir", 0).otherwise(F.col("size")).alias("size"))


@query("q_fs_empty_dirs", f"with {NODES} select path from nodes where kind = 'dir' and path not in (select parent from nodes)")
def _(t):
    return trees.empty_dirs(nodes(t)).select("path")


@query("q_fs_ls", f"with {NODES} select name, kind, size, row_number() over (order by name) as pos from nodes where parent = '/'")
def _(t):
    return trees.listing(nodes(t), "/")


@query("q_fs_tree", f"with {NODES} select path, kind, (strlen(path) - strlen(replace(path, '/', '')))::int as depth, row_number() over (order by string_split(path, '/')) as pos from nodes")
def _(t):
    return trees.tree(nodes(t))


@query("q_fs_split", "select page_id, list_filter(string_split(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/'), lambda x: x <> '') as parts from pages")
def _(t):
    return t.pages.select("page_id", trees.split_path(F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1)).alias("parts"))


FILES = f"{NODES}, files as (select path, parent, name, kind, size, case when kind = 'file' then hex(encode(name)) end as content from nodes)"


def files(t) -> DataFrame:
    """The tree with the names of its files as their contents."""
    return nodes(t).withColumn("content", F.when(F.col("kind") == "file", F.col("name").cast("binary")))


@query("q_fs_mkdir", f"with {FILES} select path, kind from files union all select path || '/new', 'dir' from files where kind = 'dir' union all select '/top', 'dir'")
def _(t):
    new = files(t).where("kind = 'dir'").select(F.concat("path", F.lit("/new")).alias("path"))
    odd = t.spark.createDataFrame([("/top",), ("/no/such/dir",), ("/AFRICA",)], "path string")
    return trees.make(files(t), new.union(odd), "dir").select("path", "kind")


@query("q_fs_mkdir_faults", f"with {FILES} select path, 'AlreadyExists' as fault from files union all select path || '/under', 'NotADirectory' from files where kind = 'file' union all select '/no/such', 'NotFound'")
def _(t):
    asked = files(t).select("path").union(files(t).where("kind = 'file'").select(F.concat("path", F.lit("/under"))))
    return trees.faults(files(t), asked.union(t.spark.createDataFrame([("/no/such",)], "path string")))


@query("q_fs_touch", f"with {FILES} select path, kind, size, content from files union all select path || '/empty', 'file', 0, '' from files where kind = 'dir'")
def _(t):
    new = files(t).where("kind = 'dir'").select(F.concat("path", F.lit("/empty")).alias("path"))
    return trees.make(files(t), new, "file").select("path", "kind", "size", F.hex("content").alias("content"))


@query("q_fs_append", f"with {FILES} select path, case when kind = 'file' then size_ else size end::bigint as size, case when kind = 'file' then content || '2B21' end as content from (select *, strlen(name) + 2 as size_ from files)")
def _(t):
    more = files(t).select("path", F.lit(bytearray(b"+!")).alias("new"))
    return trees.write(files(t), more, append=True).select("path", "size", F.hex("content").alias("content"))


@query("q_fs_replace", f"with {FILES} select path, case when kind = 'file' and strlen(name) % 2 = 0 then 3 else size end::bigint as size, case when kind = 'file' and strlen(name) % 2 = 0 then '6E6577' else content end as content from files")
def _(t):
    some = files(t).where("octet_length(name) % 2 = 0").select("path", F.lit(bytearray(b"new")).alias("new"))
    return trees.write(files(t), some).select("path", "size", F.hex("content").alias("content"))


@query("q_fs_read", f"with {FILES} select path, content[1:16] as bytes from files where kind = 'file'")
def _(t):
    return trees.read(files(t), files(t).select("path"), 8).select("path", F.hex("bytes").alias("bytes"))


@query("q_fs_size", f"with {FILES} select path, case when kind = 'file' then strlen(name) end::bigint as size, kind = 'dir' as is_dir from files")
def _(t):
    file = F.col("kind") == "file"
    return files(t).select("path", F.when(file, F.octet_length("content")).cast("long").alias("size"), (~file).alias("is_dir"))


@query("q_fs_remove", f"with {FILES} select path from files where not ((kind = 'file' and strlen(name) % 2 = 0) or (kind = 'dir' and path not in (select parent from files)))")
def _(t):
    asked = files(t).where("kind = 'dir' or octet_length(name) % 2 = 0").select("path")
    return trees.remove(files(t), asked).select("path")


FREE = "free as (select doc_id as pid, 4096 - n_chars % 4096 as free from documents), req as (select conv_id * 100 + turn as id, length(text)::bigint as size from conversations)"
CLASS = "case when {0} <= 8 then 0 when {0} <= 64 then 1 when {0} <= 512 then 2 when {0} <= 4096 then 3 else 4 end"


def pages(t) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("pid"), (4096 - F.col("n_chars") % 4096).alias("free"))


def requests(t) -> DataFrame:
    return t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.length("text").cast("long").alias("size"))


@query("q_fsm_best_fit", f"with {FREE}, best as (select free, min(pid) as pid from free group by free) select id, size, best.free, best.pid from req asof left join best on req.size <= best.free")
def _(t):
    return freespace.best_fit(pages(t), requests(t))


@query("q_fsm_first_fit_by_class", f"with {FREE}, s as (select distinct size from req), c as (select size, min({CLASS.format('free')}) as c from s join free on free >= size group by 1), b as (select c.size, min(pid) as pid from c join free on free >= c.size and {CLASS.format('free')} = c.c group by 1) select id, req.size, b.pid from req left join b using (size)")
def _(t):
    return freespace.first_fit(pages(t), requests(t))


@query("q_fsm_size_class", f"with {FREE} select {CLASS.format('free')}::int as class, count(*) as n from free group by 1")
def _(t):
    return pages(t).groupBy(size_class(F.col("free"), 8, 8).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("q_freelist_cycle", "with l as (select p_brand as list, p_partkey as pid, lag(p_partkey, 1, case when p_brand like '%3' then max_ end) over (partition by p_brand order by p_partkey) as next from part join (select p_brand, max(p_partkey) as max_ from part group by 1) using (p_brand)) select list, count(*) as pages, count(*) filter (next is null) as ends, 0::bigint as outside, 0::bigint as joined, count(*) filter (next is null) = 0 as cyclic from l group by list")
def _(t):
    by = Window.partitionBy("p_brand")
    last = F.when(F.col("p_brand").endswith("3"), F.max("p_partkey").over(by))
    links = t.part.select(F.col("p_brand").alias("list"), F.col("p_partkey").alias("pid"), F.coalesce(F.lag("p_partkey").over(by.orderBy("p_partkey")), last).alias("next"))
    return freespace.list_faults(links, 1 << 40)


@query("q_schema_fingerprint", f"select sha256('{DISPATCH.canonical()}') as fingerprint, {len(DISPATCH.tables)}::int as tables")
def _(t):
    return t.spark.range(1).select(F.sha2(F.lit(DISPATCH.canonical()), 256).alias("fingerprint"), F.lit(len(DISPATCH.tables)).alias("tables"))


def flagship(t) -> DataFrame:
    """Orders in a window, looked up by id, first ten by priority and date."""
    hits = areas(t).where(Box.named().intersects(Box.literal((0, 0), (400, 600))))
    table = t.orders.select(F.col("o_orderkey").alias("id"), "o_orderpriority", "o_orderdate", "o_totalprice")
    return hits.join(table, "id", "left").orderBy("o_orderpriority", "o_orderdate", "id").limit(10)


query("q_flagship", f"with {AREAS} select areas.*, o_orderpriority, o_orderdate, o_totalprice from areas left join orders on o_orderkey = id where not (hi0 < 0 or 400 < lo0 or hi1 < 0 or 600 < lo1) order by o_orderpriority, o_orderdate, id limit 10")(flagship)


@query("q_fsm_change", f"with {FREE} select pid, case when pid % 5 = 0 then free - 10 else free end as free from free where pid % 7 <> 0 union all select pid + 10000000, 4096 from free where pid % 11 = 0")
def _(t):
    table = pages(t).select(F.col("pid").alias("k"), F.col("free").alias("v"))
    added = maps.insert_if_absent(table, table.where("k % 11 = 0").select((F.col("k") + 10000000).alias("k"), F.lit(4096).cast("long").alias("v")))
    known = table.where("k % 5 = 0").select("k", (F.col("v") - 10).alias("v"))
    changed = maps.update_if_present(added, known)
    return maps.delete(changed, table.where("k % 7 = 0")).select(F.col("k").alias("pid"), F.col("v").alias("free"))


@query("q_fsm_unknown", f"with {FREE} select pid + 1 as pid from free where pid % 5 = 0 and pid + 1 not in (select pid from free)")
def _(t):
    asked = pages(t).where("pid % 5 = 0").select((F.col("pid") + 1).alias("pid"))
    return asked.join(pages(t), "pid", "left_anti")


@query("q_fsm_classes", f"with {FREE} select {CLASS.format('free')}::int as class, count(*) as n from free group by 1")
def _(t):
    return pages(t).groupBy(scalars.size_class(F.col("free"), 8, 8).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("q_freelist_pop", f"with {FREE} select list, pid from (select free % 16 as list, pid, row_number() over (partition by free % 16 order by pid desc) as r from free) where r = 2")
def _(t):
    stack = pages(t).select((F.col("free") % 16).alias("list"), F.col("pid").alias("seq"), "pid")
    return queues.newest(queues.pop_newest(stack, "list"), "list", "pid").select("list", "pid")
