"""Order statistics over a whole table without putting it in one partition.

A window without a partition sends every row to one task. Here the key's range is cut at
quantiles of a bounded, deterministic sample; windows run inside the buckets, and what must
cross a border comes from one row per bucket, which is small by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_BUCKETS, MOST_BUCKETS = 64, 1024
SAMPLE_PER_BUCKET = 32


def borders(df: DataFrame, key: str, buckets: int | None = None) -> list:
    """Ascending keys that cut the table into at most ``buckets`` parts of like size.

    By default there are as many as shuffles have partitions, within the limits above. The
    sample, the first different keys by hash, is the only thing that comes to the driver; a
    threshold on the hash keeps all others out of its sort.
    """
    if buckets is None:
        buckets = max(LEAST_BUCKETS, min(MOST_BUCKETS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    wanted, known = SAMPLE_PER_BUCKET * buckets, df.where(F.col(key).isNotNull()).select(key)
    different = known.agg(F.approx_count_distinct(key)).first()[0]
    if different > wanted:
        share = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / (1 << 30)
        known = known.where(share <= 1.5 * wanted / different)
    rows = known.distinct().orderBy(F.xxhash64(key), key).limit(wanted)
    keys = sorted(r[0] for r in rows.collect())
    return sorted({keys[len(keys) * i // buckets] for i in range(1, buckets)}) if keys else []


def bucket_of(key: Column, cuts: list) -> Column:
    """How many cuts a key reaches, by halving; null keys go first, to bucket 0."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        middle = (lo + hi) // 2
        return F.when(key >= F.lit(cuts[middle]), search(middle + 1, hi)).otherwise(search(lo, middle))

    return F.when(key.isNull(), 0).otherwise(search(0, len(cuts)))


def bucketed(df: DataFrame, key: str, cuts: list | None = None) -> DataFrame:
    """``cuts`` from a table with the same keys save a look at this one."""
    return df.withColumn("_b", bucket_of(F.col(key), borders(df, key) if cuts is None else cuts))


def _per_bucket(df: DataFrame, *aggregates: Column) -> DataFrame:
    """One row per bucket, the only table that a window without a partition sees."""
    return df.groupBy("_b").agg(*aggregates)


def prefix_sum(df: DataFrame, key: str, value: Column, out: str = "end", ties: tuple[str, ...] = (), cuts: list | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows up to and with this one."""
    cut = bucketed(df.withColumn("_v", value), key, cuts)
    totals = _per_bucket(cut, F.sum("_v").alias("_t"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"))
    along = Window.partitionBy("_b").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, 0)
    return cut.join(F.broadcast(offsets), "_b").withColumn(out, F.col("_o") + F.sum("_v").over(along)).drop("_b", "_v", "_o")


def rank(df: DataFrame, key: str, out: str = "pos", ties: tuple[str, ...] = ()) -> DataFrame:
    """Add ``out``: the place of the row in key order, from 1."""
    return prefix_sum(df, key, F.lit(1).cast("long"), out, ties)


def neighbour(df: DataFrame, key: str, take: str, step: int, out: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """Add ``out``: column ``take`` of the next (step 1) or previous (step -1) row.

    Keys are unique, or ``take`` is the key and ``ties`` orders the rows that share one.
    """
    cut = bucketed(df, key)
    pick = F.min_by if step > 0 else F.max_by
    edge = _per_bucket(cut, pick(take, key).alias("_e"))
    across = Window.orderBy("_b")
    edges = edge.select("_b", (F.lead("_e") if step > 0 else F.lag("_e")).over(across).alias("_n"))
    inside = Window.partitionBy("_b").orderBy(key, *ties)
    fn = F.lead if step > 0 else F.lag
    marked = cut.withColumn("_i", fn(F.struct(F.col(take).alias("v"))).over(inside))
    value = F.when(F.col("_i").isNotNull(), F.col("_i.v")).otherwise(F.col("_n"))
    return marked.join(F.broadcast(edges), "_b").withColumn(out, value).drop("_b", "_i", "_n")


def asof_forward(probes: DataFrame, probe: str, table: DataFrame, key: str, value: str) -> DataFrame:
    """Each probe with the first key at or above it and that key's value; nulls past the end."""
    cuts = borders(table, key)
    k = table.select(F.col(key).alias("_k"), F.struct(F.col(key).alias("k"), F.col(value).alias("v")).alias("_kv"), F.lit(None).cast(probes.schema[probe].dataType).alias("_p"))
    p = probes.select(F.col(probe).alias("_k"), F.lit(None).cast(k.schema["_kv"].dataType).alias("_kv"), F.col(probe).alias("_p"))
    both = k.union(p).withColumn("_b", bucket_of(F.col("_k"), cuts))
    # In descending order the smallest key so far is the first at or above the row.
    down = Window.partitionBy("_b").orderBy(F.desc("_k")).rangeBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_hit", F.min("_kv").over(down)).where("_p is not null")
    lowest = _per_bucket(both.where("_kv is not null"), F.min("_kv").alias("_low"))
    grid = table.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("_b")).join(lowest, "_b", "left")
    later = grid.select("_b", F.min("_low").over(Window.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)).alias("_later"))
    hit = F.coalesce("_hit", "_later")
    return near.join(F.broadcast(later), "_b", "left").select(F.col("_p").alias(probe), hit["k"].alias("k"), hit["v"].alias("v"))
