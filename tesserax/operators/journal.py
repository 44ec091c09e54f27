"""Replay of a redo log (seq, kind, pid, image, cnt, bad) up to its last valid commit.

kind 'page' carries an image of a page, kind 'commit' the number of pages since the commit
before. Replay stops at the first bad record, even if later commits are whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import borders, prefix_sum


def committed_end(log: DataFrame, cuts: list | None = None) -> DataFrame:
    """One row: the seq of the last valid commit, null without one."""
    batches = commits(log, cuts)
    stop = batches.agg(F.min(F.least("first_bad", F.when(F.col("cnt") != F.col("pages"), F.col("seq")))).alias("stop"))
    return batches.where("seq is not null").join(F.broadcast(stop)).where("stop is null or seq < stop").agg(F.max("seq").alias("committed"))


def commits(log: DataFrame, cuts: list | None = None) -> DataFrame:
    """(batch, seq, cnt, pages, first_bad): the records up to and with each commit; those
    after the last one have a null seq."""
    cuts = borders(log, "seq") if cuts is None else cuts
    commit = F.col("kind") == "commit"
    counted = prefix_sum(log, "seq", commit.cast("long"), "_nth", cuts=cuts).withColumn("batch", F.col("_nth") - commit.cast("long"))
    return counted.groupBy("batch").agg(
        F.max(F.when(commit, F.col("seq"))).alias("seq"), F.max(F.when(commit, F.col("cnt"))).alias("cnt"), F.count_if(F.col("kind") == "page").alias("pages"), F.min(F.when(F.col("bad"), F.col("seq"))).alias("first_bad"),
    )


def replay(log: DataFrame, cuts: list | None = None) -> DataFrame:
    """(pid, seq, image): the last image of each page up to the last valid commit."""
    end = committed_end(log, cuts)
    pages = log.where("kind = 'page'").join(F.broadcast(end)).where("seq < committed")
    return pages.groupBy("pid").agg(F.max("seq").alias("seq"), F.max_by("image", "seq").alias("image"))


def by_commit(log: DataFrame, group: str) -> DataFrame:
    """Committed state of many independent logs at once, each a partition of its own."""
    along = Window.partitionBy(group).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    good = log.withColumn("_bad", F.max(F.col("bad").cast("int")).over(along)).where("_bad = 0")
    last = good.where("kind = 'commit'").groupBy(group).agg(F.max("seq").alias("committed"))
    return good.where("kind = 'page'").join(last, group).where("seq < committed").groupBy(group, "pid").agg(F.max_by("image", "seq").alias("image"))
