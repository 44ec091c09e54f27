"""Chains of records on pages: (page, slot, ...), with soft deletes, and chains of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import rank


def append(chain: DataFrame, new: DataFrame) -> DataFrame:
    return chain.unionByName(new)


def mark_tombstones(chain: DataFrame, hit: Column) -> DataFrame:
    """Add or extend ``deleted``."""
    old = F.col("deleted") if "deleted" in chain.columns else F.lit(False)
    return chain.withColumn("deleted", old | F.coalesce(hit, F.lit(False)))


def purge(chain: DataFrame, page: int | None = None) -> DataFrame:
    """Without deleted records, of one page or of all."""
    gone = F.col("deleted") if page is None else F.col("deleted") & (F.col("page") == page)
    return chain.where(~gone)


def purged(chain: DataFrame) -> DataFrame:
    """Per page, how many records a purge leaves and takes."""
    return chain.groupBy("page").agg(F.count_if(~F.col("deleted")).alias("alive"), F.count_if("deleted").alias("purged"))


def remove_if(chain: DataFrame, hit: Column) -> DataFrame:
    return chain.where(~F.coalesce(hit, F.lit(False)))


def reverse(chain: DataFrame, out: str = "pos") -> DataFrame:
    """Last record first."""
    down = chain.withColumn("_p", -F.col("page")).withColumn("_s", -F.col("slot"))
    return rank(down, "_p", out, ("_s",)).drop("_p", "_s")


def splice(pages: DataFrame, before: DataFrame, after: DataFrame, out: str = "pos") -> DataFrame:
    """Pages (page, place) with new ones (page, near) put before or after the page ``near``;
    the places are numbered anew. One new page at most on each side of a page."""
    doubled = pages.select("page", (F.col("place") * 2).alias("place"))
    at = pages.select(F.col("page").alias("near"), (F.col("place") * 2).alias("_at"))
    left = before.join(at, "near").select("page", (F.col("_at") - 1).alias("place"))
    right = after.join(at, "near").select("page", (F.col("_at") + 1).alias("place"))
    return rank(doubled.union(left).union(right), "place", out, ("page",)).select("page", out)


def ends(pages: DataFrame) -> tuple[Column, Column]:
    """Aggregates that give the place of a new first and a new last page."""
    return F.min("place") - 1, F.max("place") + 1


def unlink(pages: DataFrame, ids: DataFrame) -> DataFrame:
    return pages.join(ids.select("page"), "page", "left_anti")
