"""Near-dedup by the Jaccard similarity of word shingles, for the pipeline.

Texts with a similarity of ``NUM`` / ``DEN`` or more are near copies; groups are what such
pairs connect. First comes the method of ``simhash``: 64-bit fingerprints of the shingles,
segment popcounts, the grid range-join under Manhattan distance and the check on the
fingerprints; what it links is decided on the exact shingle sets. It reaches 2 bits, and at
0.8 fingerprints differ in about ten, so MinHash finds the rest: ``BANDS`` bands of ``ROWS``
minima each, where a pair at 0.8 shares no cell with probability 6e-5 and a closer pair less
often. What meets in a cell, and no link has joined yet, is decided on the exact sets too:
first each text with the heads of its cells, then, in cells that still hold more than one
group, all pairs of different groups. No cell is capped.

Only a bit map of each set is there for all of these pairs. It gives an upper bound of what
two sets have in common, so that a pair that it rules out is no near copy; whole sets travel
for the few pairs that it leaves. Neither is kept for texts that share no cell: their sets
are made again, from the texts that are asked for.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simhash
from .graph import components
from .runtime import finished, materialize

SHINGLE = 5
NUM, DEN = 4, 5
BANDS, ROWS = 32, 6
SEED = 42
BLOCK = 1 << 12
#: Bits of a set's map for each of its members, rounded up to a power of two, and at most.
SPREAD, WIDEST = 8, 1 << 17
#: Cells that hold more than one group are compared in blocks of about so many texts.
MEMBERS = 512
FEW = 64  # whole sets that a batch has at most
#: Bits of a filter for each of its values, rounded up to a power of two, and at most.
FILTER, LARGEST = 16, 1 << 27
BUCKET = 1 << 15  # bits of what bitmap_construct_agg makes
_RANDOM = np.random.default_rng(SEED)
_MIX = _RANDOM.integers(0, 1 << 63, (2, BANDS * ROWS, 1), dtype=np.uint64)
_XOR, _ODD = _MIX[0], _MIX[1] * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The different XXH64 values of all word shingles, sorted; words as in ``simhash``."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), dtype=np.uint64))


def bands(values: np.ndarray) -> list[int]:
    """One cell per band; texts without words have none."""
    if not len(values):
        return []
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(values), BLOCK):
        np.minimum(low, ((values[at : at + BLOCK] ^ _XOR) * _ODD).min(axis=1), out=low)
    return [xxhash.xxh3_64_intdigest(r.tobytes(), i) - (1 << 63) for i, r in enumerate(low.reshape(BANDS, ROWS))]


def bit_map(values: np.ndarray) -> bytes:
    """One bit for each value's remainder; the number of bits is a power of two."""
    bits = np.zeros(min(WIDEST, max(64, 1 << (SPREAD * len(values) - 1).bit_length())), dtype=bool)
    bits[(values & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def common(x: np.ndarray, m, ys: np.ndarray, n) -> np.ndarray:
    """At most so many members a set has in common with others, by their bit maps (bytes; one
    row each of ``ys``) and numbers of members: a bit that the other lacks is a member that it lacks."""
    width = min(len(x), ys.shape[1])
    x = np.bitwise_or.reduce(x.reshape(-1, width), axis=0)
    ys = np.bitwise_or.reduce(ys.reshape(len(ys), -1, width), axis=1)
    lacks = lambda p, q: np.bitwise_count(p & ~q).sum(axis=1, dtype=np.int64)
    return np.minimum(m - lacks(x, ys), n - lacks(ys, x))


def _key(values: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(values.tobytes()) - (1 << 63)


def shingled(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """(*carry, key, n, fp, cells) for (text, *carry): ``key`` stands for the whole set, ``fp`` is
    the SimHash fingerprint of its shingles."""

    def run(batches):
        for b in batches:
            rows = [(_key(s), len(s), simhash.majority(s), bands(s)) for s in (shingles(t.as_py()) for t in b.column(0))]
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate([*[pa.int64()] * 3, pa.list_(pa.int64())])]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *made], names=[*carry, "key", "n", "fp", "cells"])

    slim = docs.select(F.col("text").cast("binary").alias("text"), *carry)
    return slim.mapInArrow(run, ", ".join(f"{c} long" for c in carry) + ", key long, n long, fp long, cells array<long>")


def _whole(docs: DataFrame) -> DataFrame:
    """(key, n, bits, grams) for (text): the set's bit map and all of it."""

    def run(batches):
        for b in batches:
            for at in range(0, len(b), FEW):
                sets = [shingles(t.as_py()) for t in b.column(0)[at : at + FEW]]
                yield pa.RecordBatch.from_arrays([pa.array(map(_key, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(map(bit_map, sets), pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["key", "n", "bits", "grams"])

    return docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "key long, n long, bits binary, grams array<long>")


def among(values: DataFrame) -> Callable[[Column], Column]:
    """A test of a long column, false only where ``values`` (one long column) lacks the value.

    It keeps most rows from being dealt out; what must be exact is decided after it.
    """
    values = values.toDF("v").distinct()
    size = min(LARGEST, max(BUCKET, 1 << (FILTER * values.count() - 1).bit_length()))
    at = values.select(F.pmod("v", F.lit(size)).alias("at")).selectExpr(f"cast(at div {BUCKET} as int) as bucket", f"at % {BUCKET} as bit")
    # Dealt by bucket first: else each task would send a map of its own for each bucket.
    maps = at.repartition("bucket").groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map")).collect()
    bits = np.zeros((size // BUCKET, BUCKET // 8), dtype=np.uint8)
    for r in maps:
        bits[r["bucket"]] = np.frombuffer(r["map"], np.uint8)
    bits = bits.reshape(-1)

    def has(column: pa.Array) -> pa.Array:
        at = column.to_numpy(zero_copy_only=False) & (size - 1)
        return pa.array(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1)

    return F.arrow_udf(has, "boolean")


def _grid(spark: SparkSession, sets: DataFrame) -> DataFrame:
    """(src, dst, m, n): sets whose SimHash fingerprints are linked by the grid range-join over
    segment popcounts (see ``simhash.links``), each fingerprint by the smallest key that has it."""
    own = sets.select("fp", "key", "n").distinct()
    first = own.groupBy("fp").agg(F.min(F.struct("key", "n")).alias("first"))
    near = simhash.links(first.select("fp"))
    src, dst = first.toDF("src", "x"), first.toDF("dst", "y")
    met = near.join(src, "src").join(dst, "dst").select(F.col("x.key").alias("src"), F.col("y.key").alias("dst"), F.col("x.n").alias("m"), F.col("y.n").alias("n"))
    same = own.join(first, "fp").where("key <> first.key").select(F.col("first.key").alias("src"), F.col("key").alias("dst"), F.col("first.n").alias("m"), "n")
    return met.union(same)


def _possible(pairs: DataFrame) -> DataFrame:
    """Different pairs that the sizes of their sets allow, the smaller key first."""
    fits = pairs.where(f"{DEN} * least(m, n) >= {NUM} * greatest(m, n)")
    return fits.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def _fitting(known: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst): the pairs that the bit maps of their sets allow."""

    def run(batches):
        for b in batches:
            (src, dst), (m, n) = b.columns[:2], (c.to_pylist() for c in b.columns[2:4])
            maps = zip(*(c.to_pylist() for c in b.columns[4:]), strict=True)
            top = [common(np.frombuffer(x, np.uint8), m[i], np.frombuffer(y, np.uint8)[None], n[i])[0] for i, (x, y) in enumerate(maps)]
            fits = pa.array([(NUM + DEN) * k >= NUM * (m[i] + n[i]) for i, k in enumerate(top)], pa.bool_())
            yield pa.RecordBatch.from_arrays([src, dst], names=["src", "dst"]).filter(fits)

    bits = known.select("key", "n", "bits")
    both = pairs.join(bits.toDF("src", "m", "x"), "src").join(bits.toDF("dst", "n", "y"), "dst")
    return both.select("src", "dst", "m", "n", "x", "y").mapInArrow(run, "src long, dst long")


def _verified(spark: SparkSession, grams: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst): the pairs whose exact similarity is high enough."""
    asked = grams.where(among(pairs.select("src").union(pairs.select("dst")))("key"))
    both = pairs.join(asked.toDF("src", "x"), "src").join(asked.toDF("dst", "y"), "dst")
    close = both.where(f"{NUM + DEN} * size(array_intersect(x, y)) >= {NUM} * (size(x) + size(y))")
    return materialize(spark, close.select("src", "dst"), "links")


def _alike(met: DataFrame) -> DataFrame:
    """(src, dst, m, n): pairs of a cell's groups that the bit maps of their sets allow, for members
    (cell, key, n, root, bits). Blocks of members meet, so that rows don't grow with all pairs."""

    def run(batches):
        for b in batches:
            for one, other, same in zip(*b.columns, strict=True):
                (x, m, a, s), (y, n, c, t) = ([*(np.array([r[f] for r in rows]) for f in ("key", "n", "root")), [np.frombuffer(r["bits"], np.uint8) for r in rows]] for rows in (one.as_py(), other.as_py()))
                wide = np.array(list(map(len, t)))
                maps = {w: (np.flatnonzero(wide == w), np.stack([v for v in t if len(v) == w])) for w in set(wide)}
                for i in range(len(x)):
                    fits = (a[i] != c) & (DEN * np.minimum(m[i], n) >= NUM * np.maximum(m[i], n)) & (x[i] < y if same.as_py() else x[i] != y)
                    for places, rows in maps.values():
                        if (near := fits[places]).any():
                            k = places[near]
                            k = k[(NUM + DEN) * common(s[i], m[i], rows[near], n[k]) >= NUM * (m[i] + n[k])]
                            if len(k):
                                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), x[i])), pa.array(y[k]), pa.array(np.full(len(k), m[i])), pa.array(n[k])], names=["src", "dst", "m", "n"])

    sized = met.withColumn("block", F.pmod(F.xxhash64("key"), F.ceil(F.count(F.lit(1)).over(Window.partitionBy("cell")) / MEMBERS)))
    lists = sized.groupBy("cell", "block").agg(F.collect_list(F.struct("key", "n", "root", "bits")).alias("xs"))
    both = lists.join(lists.toDF("cell", "r_block", "ys"), "cell").where("block <= r_block")
    return both.select("xs", "ys", (F.col("block") == F.col("r_block")).alias("same")).mapInArrow(run, "src long, dst long, m long, n long")


def groups(spark: SparkSession, sets: DataFrame, whole: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root) for every key of ``sets`` (key, n, fp, cells) that has a near copy; ``whole``
    gives (key, n, bits, grams), one row each, for keys that are asked for, and maybe for others."""
    distinct = sets.select("key", "n", "cells").groupBy("key").agg(F.first("n").alias("n"), F.first("cells").alias("cells"))
    size = F.count(F.lit(1)).over(Window.partitionBy("cell"))
    met = materialize(spark, distinct.select("key", "n", F.explode("cells").alias("cell")).withColumn("size", size).where("size > 1"), "cells")
    pairs = materialize(spark, _possible(_grid(spark, sets)), "pairs")
    known = materialize(spark, whole(met.select("key").union(pairs.select("src")).union(pairs.select("dst")).distinct()), "sets")
    grams = known.select("key", "grams")
    links = _verified(spark, grams, pairs)
    roots = components(spark, links)

    def opened(members: DataFrame) -> DataFrame:
        """Members of cells with more than one group, with their groups and the cell's head."""
        rooted = members.join(roots, members.key == roots.node, "left").select(*members.columns, F.coalesce("root", "key").alias("root"))
        split = rooted.groupBy("cell").agg((F.min("root") < F.max("root")).alias("split"), F.max(F.struct("weight", "key", "n", "root")).alias("head")).where("split")
        return materialize(spark, rooted.join(split.select("cell", "head"), "cell"), "open")

    # Of a text and its copies the text itself shares most cells: the heads are those that meet most.
    weights = met.groupBy("key").agg(F.sum("size").alias("weight"))
    met = opened(met.join(weights, "key").select("cell", "key", "n", "weight"))
    near = met.where("root <> head.root").select(F.col("head.key").alias("src"), F.col("key").alias("dst"), F.col("head.n").alias("m"), "n")
    links = links.union(_verified(spark, grams, materialize(spark, _fitting(known, _possible(near)), "pairs")))
    roots = components(spark, links)
    # The heads were compared with all of their cells.
    met = opened(met.where("key <> head.key").select("cell", "key", "n", "weight"))
    near = _alike(met.select("cell", "key", "n", "root").join(known.select("key", "bits"), "key"))
    more = _verified(spark, grams, materialize(spark, _possible(near), "pairs"))
    return roots if more.isEmpty() else components(spark, links.union(more))


def keep_one(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, all columns: that of the smallest id.

    Texts without words are copies of each other. Null ids come after all others, then the
    hash of the text decides; of rows that repeat both id and text, one stays, the first by a
    hash of the other columns.
    """
    i, h = F.col(id_col).cast("long"), F.xxhash64(text_col)
    rank = F.struct(F.col(id_col).isNull().alias("n"), F.coalesce(i, F.lit(0)).alias("i"), h.alias("h"))
    hashed = lambda of: F.xxhash64(f"{of}.n", f"{of}.i", f"{of}.h")
    ranked = docs.select(rank.alias("_rank"), F.struct(*docs.columns).alias("_row"))

    def decided() -> DataFrame:
        """(n, i, h, stays): the ranks of all rows that have others in their group."""
        sets = shingled(docs.select(i.alias("doc_id"), F.col(text_col).alias("text"), h.alias("h")), ("doc_id", "h"))
        sets = materialize(spark, sets.select(F.struct(F.col("doc_id").isNull().alias("n"), F.coalesce("doc_id", F.lit(0)).alias("i"), "h").alias("rank"), "key", "n", "fp", "cells"), "shingles")
        first = sets.groupBy("key").agg(F.min("rank").alias("rank"))

        def whole(keys: DataFrame) -> DataFrame:
            asked = among(first.join(keys, "key", "left_semi").select(hashed("rank")))
            texts = ranked.where(asked(hashed("_rank"))).select(F.col(f"_row.`{text_col}`").alias("text"))
            return _whole(texts).groupBy("key").agg(*(F.first(c).alias(c) for c in ("n", "bits", "grams")))

        roots = groups(spark, sets, whole)
        rooted = sets.select("rank", "key").join(roots, sets.key == roots.node, "left").select("rank", F.coalesce("root", "key").alias("root"))
        best = rooted.groupBy("root").agg(F.min("rank").alias("best"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
        return rooted.join(best, "root").select("rank.*", F.expr("rank = best").alias("stays")).distinct()

    known, _ = finished(spark, decided, "decided")
    # Rows that are alone in their groups stay where they are: only the others are dealt out.
    met = among(known.select(F.xxhash64("n", "i", "h")))(hashed("_rank"))
    kept = ranked.where(met).select("_rank.*", "_row").join(known.where("not stays"), ["n", "i", "h"], "left_anti")
    others = [F.col(f"_row.`{f.name}`") for f in docs.schema if f.name not in (id_col, text_col) and f.dataType.typeName() != "map"]
    once = kept.withColumn("_k", F.row_number().over(Window.partitionBy("n", "i", "h").orderBy(F.xxhash64(F.lit(0), *others)))).where("_k = 1")
    return ranked.where(~met).select("_row.*").union(once.select("_row.*"))
