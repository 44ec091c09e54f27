"""Priority queues, first-in first-out and last-in first-out, one queue or many.

Priority order is given columns with a tie-breaker last; equal keys are all kept. FIFO and
LIFO entries have ``seq``, growing with insertion. ``group`` makes one queue per group, and
a queue's head is then a window or an aggregation by group; without it the head is a top-k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def push(queue: DataFrame, new: DataFrame) -> DataFrame:
    """Duplicates stay."""
    return queue.unionByName(new)


def key_violations(queue: DataFrame, key: str, size: int) -> DataFrame:
    """Entries whose key has not exactly the size that the queue's keys have."""
    return queue.where(F.octet_length(key) != size)


def top(queue: DataFrame, *order, n: int = 1) -> DataFrame:
    """The first entries; none of an empty queue."""
    return queue.orderBy(*order).limit(n)


def pop(queue: DataFrame, key: str, *order, n: int = 1) -> DataFrame:
    """Without the first ``n`` (a small number) entries; ``key`` names an entry."""
    return queue.join(F.broadcast(top(queue, *order, n=n).select(key)), key, "left_anti")


def top_per_group(queue: DataFrame, group: str, *order, n: int = 1, out: str = "r") -> DataFrame:
    """The first ``n`` entries of each queue with their place; pruned before the shuffle."""
    ranked = queue.withColumn(out, F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long"))
    return ranked.where(F.col(out) <= n)


def pop_per_group(queue: DataFrame, group: str, *order, n: int = 1) -> DataFrame:
    ranked = queue.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.where(F.col("_r") > n).drop("_r")


def size(queue: DataFrame) -> DataFrame:
    """(n, is_empty)"""
    return queue.agg(F.count(F.lit(1)).alias("n")).withColumn("is_empty", F.col("n") == 0)


def front(queue: DataFrame, group: str, value: str) -> DataFrame:
    """The oldest entry of each queue."""
    return queue.groupBy(group).agg(F.min("seq").alias("seq"), F.min_by(value, "seq").alias(value))


def newest(queue: DataFrame, group: str, value: str) -> DataFrame:
    """The top of each stack."""
    return queue.groupBy(group).agg(F.max("seq").alias("seq"), F.max_by(value, "seq").alias(value))


def dequeue(queue: DataFrame, group: str, n: int = 1) -> DataFrame:
    return pop_per_group(queue, group, "seq", n=n)


def pop_newest(queue: DataFrame, group: str, n: int = 1) -> DataFrame:
    return pop_per_group(queue, group, F.desc("seq"), n=n)


def scan(queue: DataFrame, group: str, out: str = "pos") -> DataFrame:
    """Oldest to newest, for queues and stacks alike."""
    return queue.withColumn(out, F.row_number().over(Window.partitionBy(group).orderBy("seq")).cast("long"))


def next_seq(queue: DataFrame, new: DataFrame, order: Column) -> DataFrame:
    """New entries numbered after the newest; a batch is numbered in one task, the queue is not."""
    last = queue.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("_m"))
    numbered = new.withColumn("_r", F.row_number().over(Window.orderBy(order)))
    return numbered.join(F.broadcast(last)).withColumn("seq", (F.col("_m") + F.col("_r")).cast("long")).drop("_m", "_r")
