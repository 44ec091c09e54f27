"""Sorted runs of versioned entries (k, v, flag, lsn): merge, blocks, front coding.

flag 1 marks a tombstone. Of several versions of a key that of the highest lsn wins, and of
equal lsns that of the lowest run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(entries: DataFrame, drop_tombstones: bool = False) -> DataFrame:
    """(k, v, flag, lsn, run) of the winners of ``entries``, which has a column ``run``.

    One aggregation with a partial step: a hot key costs one row per task.
    """
    best = entries.groupBy("k").agg(F.max(F.struct(F.col("lsn"), (-F.col("run")).alias("nr"), F.col("v"), F.col("flag"))).alias("w"))
    out = best.select("k", "w.v", "w.flag", "w.lsn", (-F.col("w.nr")).alias("run"))
    return out.where("flag = 0") if drop_tombstones else out


def order_violations(entries: DataFrame, order: str) -> DataFrame:
    """Entries of a run, as written in ``order``, whose key is not above the one before."""
    before = F.lag(F.struct("k")).over(Window.partitionBy("run").orderBy(order))
    return entries.withColumn("prev", before).where("prev is not null and k <= prev.k").select("run", order, "k")


def blocks(entries: DataFrame, per_block: int) -> DataFrame:
    """Add ``pos`` (from 0, in key order within a run) and ``block``."""
    pos = F.row_number().over(Window.partitionBy("run").orderBy("k")) - 1
    return entries.withColumn("pos", pos.cast("long")).withColumn("block", F.expr(f"pos div {per_block}"))


def fences(blocked: DataFrame) -> DataFrame:
    return blocked.groupBy("run", "block").agg(F.max("k").alias("fence"), F.count(F.lit(1)).alias("entries"), F.max(F.octet_length("k")).alias("max_key"))


def shared_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two strings, in characters; null counts as empty."""
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    most = F.least(F.length(x), F.length(y))
    same = lambda i: F.left(x, i) == F.left(y, i)
    return F.when(most == 0, 0).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), same)))


def front_coded(blocked: DataFrame) -> DataFrame:
    """(run, block, pos, shared, suffix): each key as what it shares with the key before in
    its block, and the rest."""
    before = F.lag("k").over(Window.partitionBy("run", "block").orderBy("pos"))
    out = blocked.withColumn("_p", before).withColumn("shared", shared_prefix(F.col("_p"), F.col("k")))
    return out.select("run", "block", "pos", "shared", F.expr("substring(k, shared + 1)").alias("suffix"))


def front_decoded(coded: DataFrame) -> DataFrame:
    """The keys again, block by block; a block is small by construction."""
    rows = F.sort_array(F.collect_list(F.struct("pos", "shared", "suffix")))
    start = F.array().cast("array<struct<pos: bigint, k: string>>")

    def step(acc, x):
        before = F.when(F.size(acc) > 0, F.element_at(acc, -1)["k"]).otherwise("")
        key = F.concat(F.left(before, x["shared"]), x["suffix"])
        return F.concat(acc, F.array(F.struct(x["pos"].alias("pos"), key.alias("k"))))

    keys = coded.groupBy("run", "block").agg(F.aggregate(rows, start, step).alias("keys"))
    return keys.select("run", "block", F.explode("keys").alias("x")).select("run", "block", "x.pos", "x.k")
