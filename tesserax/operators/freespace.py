"""Free-space search: best fit, first fit by size class, free-list checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import size_class
from .ordered import asof_forward


def best_fit(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """(id, size, free, pid): the page with the least free bytes that suffices, lowest pid first."""
    table = pages.groupBy("free").agg(F.min("pid").alias("pid"))
    sizes = asof_forward(requests.select("size").distinct(), "size", table, "free", "pid")
    return requests.join(sizes, "size").select("id", "size", F.col("k").alias("free"), F.col("v").alias("pid"))


def first_fit(pages: DataFrame, requests: DataFrame, base: int = 8, least: int = 8) -> DataFrame:
    """(id, size, pid): from the request's size class upwards, the lowest pid that suffices."""
    table = pages.groupBy("free").agg(F.min("pid").alias("pid")).withColumn("class", size_class(F.col("free"), base, least))
    # Of all pages of a class with at least so much free, the lowest pid; free has few values.
    above = Window.partitionBy("class").orderBy(F.desc("free")).rowsBetween(Window.unboundedPreceding, 0)
    table = table.withColumn("pid", F.min("pid").over(above))
    sizes = asof_forward(requests.select("size").distinct(), "size", table, "free", "pid")
    return requests.join(sizes, "size").select("id", "size", F.col("v").alias("pid"))


def list_faults(links: DataFrame, most: int) -> DataFrame:
    """Per list of (list, pid, next): pages, ends, pages with two predecessors, ids out of
    range. A list without an end, or with a page reached twice, has a cycle."""
    twice = links.where("next is not null").groupBy("list", "next").agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy("list").agg(F.count(F.lit(1)).alias("joined"))
    out = links.groupBy("list").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("next").isNull()).alias("ends"), F.count_if((F.col("next") < 0) | (F.col("next") > most)).alias("outside"))
    joined = out.join(twice, "list", "left").withColumn("joined", F.coalesce("joined", F.lit(0)).cast("long"))
    return joined.withColumn("cyclic", (F.col("ends") == 0) | (F.col("joined") > 0))
