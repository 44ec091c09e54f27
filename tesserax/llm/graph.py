"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import materialize


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
    return tuple(row)


def components(spark: SparkSession, edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, root) for every node that an edge touches; root is the smallest node it reaches.

    Each round joins edges with a minimum per node (pre-aggregated before its shuffle),
    so no task ever holds a component; each round's edges go to the shared folder.
    Loops, repeated edges and edges in both directions are fine, null ends are ignored;
    no edges give no rows.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct()
    e = materialize(spark, e, "edges")
    before = _signature(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(spark, small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _signature(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
