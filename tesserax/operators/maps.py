"""Ordered maps with unique keys, multimaps with duplicates, and sparse integer maps.

A map is a DataFrame with a key and a value column; a change is a new DataFrame. Keys are
never null, and the caller's batches have unique keys (see ``key_violations``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def find(table: DataFrame, key) -> DataFrame:
    return table.where(F.col("k") == F.lit(key))


def first(table: DataFrame) -> DataFrame:
    return table.orderBy("k").limit(1)


def last(table: DataFrame) -> DataFrame:
    return table.orderBy(F.desc("k")).limit(1)


def multiget(table: DataFrame, probes: DataFrame) -> DataFrame:
    return probes.join(table, "k")


def lower_bound(table: DataFrame, key) -> DataFrame:
    """The first entry at or above a key, or none; a top-1 per partition, never a full sort."""
    return table.where(F.col("k") >= F.lit(key)).orderBy("k").limit(1)


def insert_if_absent(table: DataFrame, new: DataFrame) -> DataFrame:
    """Present keys keep their old value."""
    return table.unionByName(new.join(table.select("k"), "k", "left_anti").select(table.columns))


def update_if_present(table: DataFrame, new: DataFrame) -> DataFrame:
    """Absent keys are not added; a null is a value like any other."""
    hits = new.select("k", F.struct(F.col("v").alias("x")).alias("_n"))
    return table.join(hits, "k", "left").select("k", F.when(F.col("_n").isNotNull(), F.col("_n.x")).otherwise(F.col("v")).alias("v"))


def upsert(table: DataFrame, new: DataFrame) -> DataFrame:
    return table.join(new.select("k"), "k", "left_anti").unionByName(new)


def delete(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys.select("k"), "k", "left_anti")


def key_violations(table: DataFrame) -> DataFrame:
    """Keys that are null or occur more than once."""
    return table.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k is null or n > 1")


# Multimaps: (k, seq, v), seq growing with insertion; equal keys stand in insertion order.


def mm_positions(table: DataFrame) -> DataFrame:
    return table.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy("seq")))


def mm_find_latest(table: DataFrame, probes: DataFrame) -> DataFrame:
    """The most recent of the equal keys."""
    latest = table.join(probes.select("k"), "k", "left_semi").groupBy("k").agg(F.max("seq").alias("seq"), F.max_by("v", "seq").alias("v"))
    return latest


def mm_contains(probes: DataFrame, table: DataFrame) -> DataFrame:
    return probes.join(table.select("k"), "k", "left_semi")


def mm_insert(table: DataFrame, new: DataFrame) -> DataFrame:
    """Equal keys stay side by side; the caller numbers ``seq`` after the newest."""
    return table.unionByName(new)


def mm_remove_latest(table: DataFrame, keys: DataFrame) -> DataFrame:
    """One entry less for each key given: the most recent; absent keys change nothing."""
    newest = table.join(keys.select("k").distinct(), "k", "left_semi").groupBy("k").agg(F.max("seq").alias("seq"))
    return table.join(newest, ["k", "seq"], "left_anti")


# Sparse integer maps: keys as mixed-radix digits.


def digits(key: Column, leaf_base: int, inner_base: int, levels: int) -> Column:
    """Array of (level, digit, quotient), lowest digit first."""
    out, rest = [], key
    for level in range(levels):
        base = leaf_base if level == 0 else inner_base
        quotient = _div(rest, base)
        out.append(F.struct(F.lit(level).alias("level"), (rest - quotient * base).cast("long").alias("digit"), quotient.alias("quotient")))
        rest = quotient
    return F.array(*out)


def _div(value: Column, base: int) -> Column:
    """Whole division of a value that is not negative, exact over all of BIGINT."""
    return F.call_function("div", value, F.lit(base)).cast("long")


def level_of(key: Column, leaf_base: int, inner_base: int, most: int = 12) -> Column:
    """The highest level a key needs: 0 below the leaf base, and one more per inner base."""
    out, limit = F.lit(None).cast("int"), leaf_base
    conditions = []
    for level in range(most):
        conditions.append((level, limit))
        if limit > (1 << 62) // inner_base:
            break
        limit *= inner_base
    for level, top in reversed(conditions):
        out = F.when(key < F.lit(top), level).otherwise(out)
    return out


def most_levels(key_bits: int, leaf_base: int, inner_base: int) -> int:
    """How many levels the keys of a type need."""
    rest, levels = ((1 << key_bits) - 1) // leaf_base, 1
    while rest:
        rest, levels = rest // inner_base, levels + 1
    return levels


def set_all(table: DataFrame, writes: DataFrame) -> DataFrame:
    """Upsert of ordered writes (k, v, seq): the last write of a key stands."""
    return upsert(table, writes.groupBy("k").agg(F.max_by("v", "seq").alias("v")))
