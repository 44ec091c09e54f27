"""Bloom filters and bit sets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 64
#: 4 MB of words.
BROADCAST_BITS = 1 << 25


def bits_for(n: int, p: float) -> int:
    return max(1, math.ceil(-n * math.log(p) / math.log(2) ** 2)) if n else 1


def probes_for(bits: int, n: int) -> int:
    return max(1, round(bits / n * math.log(2))) if n else 1


def parameters(n: int, p: float) -> tuple[int, int]:
    """Bits, in whole words, and the number of probes."""
    bits = -(-bits_for(n, p) // WORD) * WORD
    return bits, probes_for(bits, n)


def positions(key: Column, bits: int, probes: int) -> Column:
    """Double hashing: where a key's bits are. The two hashes are parts of one MD5 of its text,
    which any engine can compute."""
    digest = F.md5(key.cast("string").cast("binary"))
    part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long") % bits
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(probes - 1)), lambda i: (part(1) + i * part(17)) % bits))


def build(keys: DataFrame, key: str, bits: int, probes: int) -> DataFrame:
    """(word, mask): the filter's non-zero words, combined before the shuffle."""
    at = keys.select(F.explode(positions(F.col(key), bits, probes)).alias("p"))
    return at.groupBy(F.expr(f"p div {WORD}").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(p % {WORD} as int))")).alias("mask"))


def might_contain(probes_df: DataFrame, key: str, bloom: DataFrame, bits: int, probes: int, broadcast_bits: int = BROADCAST_BITS) -> DataFrame:
    """Rows of ``probes_df`` whose bits are all set; none that was added is missing, and rows
    that repeat stay as often as they are there.

    A filter of ``broadcast_bits`` or less goes to all tasks as one array of words, and the bits
    are tested in the row. A larger one is joined by words.
    """
    if bits <= broadcast_bits:
        every = bloom.sparkSession.range(bits // WORD + 1).join(bloom, F.col("id") == F.col("word"), "left")
        words = every.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", F.coalesce("mask", F.lit(0)).alias("mask")))), lambda x: x["mask"]).alias("_w"))
        bit = lambda p: F.call_function("shiftright", F.get("_w", F.floor(p / WORD).cast("int")), (p % WORD).cast("int")).bitwiseAND(F.lit(1)) == 1
        found = probes_df.crossJoin(F.broadcast(words)).where(F.forall(positions(F.col(key), bits, probes), bit))
        return found.select(*probes_df.columns)
    asked = probes_df.withColumn("_r", F.monotonically_increasing_id()).select("*", F.explode(positions(F.col(key), bits, probes)).alias("_p"))
    words = asked.withColumn("word", F.expr(f"_p div {WORD}")).join(bloom, "word", "left")
    hit = F.coalesce(F.expr(f"shiftright(mask, cast(_p % {WORD} as int)) & 1"), F.lit(0))
    return words.groupBy("_r", *probes_df.columns).agg(F.min(hit).alias("_h")).where("_h = 1").drop("_h", "_r")


def bit_set(df: DataFrame, group: list[str], position: Column) -> DataFrame:
    """(group, bits): positions 0 to 63 of a group as one word."""
    return df.groupBy(*group).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), position.cast("int"))).alias("bits"))


def capacity(region: Column, object_bytes: int) -> Column:
    """How many objects fit into a region of bytes with one bit for each beside them."""
    return F.call_function("div", region * 8, F.lit(8 * object_bytes + 1)).cast("long")
