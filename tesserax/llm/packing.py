"""Conflict-constrained best-fit packing of documents into sequences.

Bins are kept in the order of their residual. Each carries two bitmaps, of the sources and
of the duplicate clusters it holds; a piece may share neither with the bin it joins. From
the smallest residual that is large enough, the successor search goes up until it meets a
compatible bin, the tightest one there is; without one, a new bin opens. Pieces come in
decreasing size.

Documents are dealt by hash to shards of bounded size, and each shard is packed by itself.
Then bins of all shards are dealt anew, again and again, and a bin joins the tightest
compatible one that it fits into as a whole, by the same search, until hardly any does.
Every hash is of what a row holds, so the order and the files that rows come in don't matter.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import n_words
from .runtime import materialize

CAPACITY = 2048
SHARD_ROWS = 4096
#: Bins are dealt anew as long as a round joins this share of those that have room.
LEAST_JOINED = 0.001
_BIN = 1 << 32


def best_fit(pieces: list[tuple[int, object, object]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece (size, source, cluster), taken in the given order."""
    seen: dict[object, int] = {}
    for _, _, cluster in pieces:
        seen[cluster] = seen.get(cluster, 0) + 1
    source_bits: dict[object, int] = {}
    cluster_bits: dict[object, int] = {}
    sources, clusters, free = [], [], []
    order: list[int] = []  # residual * 2 ** 32 + bin
    out = []
    for size, source, cluster in pieces:
        s = source_bits.setdefault(source, 1 << len(source_bits))
        c = cluster_bits.setdefault(cluster, 1 << len(cluster_bits)) if seen[cluster] > 1 else 0
        at = bisect_left(order, size * _BIN)
        while at < len(order) and (sources[order[at] % _BIN] & s or clusters[order[at] % _BIN] & c):
            at += 1
        if at < len(order):
            b = order.pop(at) % _BIN
        else:
            b = len(free)
            sources.append(0), clusters.append(0), free.append(capacity)
        out.append((b, capacity - free[b]))
        sources[b], clusters[b], free[b] = sources[b] | s, clusters[b] | c, free[b] - size
        insort(order, free[b] * _BIN + b)
    return out


def same_text(text: Column) -> Column:
    """The default duplicate cluster: texts equal but for case and white space."""
    return F.xxhash64(F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"\s+", " "))


def join_bins(bins: list[tuple[int, list, list]], capacity: int) -> list[tuple[int, int] | None]:
    """Of each bin (used, sources, clusters), the bin it joins as a whole and at which offset.

    Bins come in decreasing use. From the smallest residual that is large enough, the search
    goes up until it meets a compatible bin; a bin that was joined can be joined again, but
    joins no other. Only bins of half a capacity or less need to look for another.
    """
    held: dict[object, int] = {}
    for _, sources, clusters in bins:
        for x in (*(("s", v) for v in sources), *(("c", v) for v in clusters)):
            held[x] = held.get(x, 0) + 1
    place = {x: i for i, x in enumerate(x for x, n in held.items() if n > 1)}
    marks = []
    for _, sources, clusters in bins:
        mark = 0
        for x in (*(("s", v) for v in sources), *(("c", v) for v in clusters)):
            if x in place:
                mark |= 1 << place[x]
        marks.append(mark)
    used, out = [b[0] for b in bins], [None] * len(bins)
    order = sorted((capacity - u) * _BIN + i for i, u in enumerate(used))
    whole = set(range(len(bins)))
    for i in sorted(whole, key=lambda i: (-used[i], i)):
        if i not in whole or 2 * used[i] > capacity:
            continue
        at = bisect_left(order, used[i] * _BIN)
        while at < len(order) and (order[at] % _BIN == i or marks[order[at] % _BIN] & marks[i]):
            at += 1
        if at == len(order):
            continue
        b = order.pop(at) % _BIN
        order.remove((capacity - used[i]) * _BIN + i)
        out[i] = (b, used[b])
        used[b], marks[b] = used[b] + used[i], marks[b] | marks[i]
        whole -= {i, b}
        insort(order, (capacity - used[b]) * _BIN + b)
    return out


def _refit(spark: SparkSession, pieces: DataFrame, capacity: int, shard_rows: int) -> DataFrame:
    """(bin, root, shift): the bin that each bin ends in, and where."""
    bins = pieces.groupBy("bin").agg(F.sum("tokens").alias("used"), F.collect_set(F.xxhash64(F.struct("source"))).alias("s"), F.collect_set("cluster").alias("c"))
    bins = materialize(spark, bins.select("bin", "used", F.array_sort("s").alias("s"), F.array_sort("c").alias("c")), "bins")
    ends = bins.select("bin", F.col("bin").alias("root"), F.lit(0).cast("long").alias("shift"))

    def run(df):
        df = df.sort_values("bin", ignore_index=True)
        found = join_bins(list(zip(df.used.tolist(), df.s.tolist(), df.c.tolist(), strict=True)), capacity)
        moved = [(i, *f) for i, f in enumerate(found) if f is not None]
        names = lambda at: pd.Series([df.bin[m[at]] for m in moved], dtype=object)
        return pd.DataFrame({"root": names(0), "into": names(1), "by": pd.Series([m[2] for m in moved], dtype="int64")})

    turn = 0
    while True:
        room = bins.where(F.col("used") < capacity)
        n = room.count()
        shards = max(1, -(-n // shard_rows))
        moves = room.withColumn("shard", F.pmod(F.xxhash64("bin", F.lit(turn)), F.lit(shards))).groupBy("shard").applyInPandas(run, "root string, into string, by long")
        moves = materialize(spark, moves, "moves")
        joined = moves.count()
        if joined:
            ends = ends.join(moves, "root", "left").select("bin", F.coalesce("into", "root").alias("root"), (F.col("shift") + F.coalesce("by", F.lit(0))).alias("shift"))
            ends = materialize(spark, ends, "ends")
            moved = bins.join(moves.withColumnRenamed("root", "bin"), "bin", "left").withColumn("bin", F.coalesce("into", "bin"))
            bins = moved.groupBy("bin").agg(F.sum("used").alias("used"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("c")))).alias("c"))
            bins = materialize(spark, bins, "bins")
        turn += 1
        if shards == 1 and not joined or joined < LEAST_JOINED * n or not n:
            return ends


def pack(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster: Column | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(doc_id, piece, start, tokens, bin, at): where each piece of each document went.

    A document longer than a bin is cut into full pieces, a bin each, and a rest. Sizes are
    words; a text without words, or null, has one piece of size 0. A null source is a source
    of its own. Null ids are kept, rows that repeat are packed each, apart from each other,
    as they are one cluster; ties in size go by id, then text, then the number of the copy.
    The result is the same however the rows are ordered and dealt over files. Other columns
    are not read; an empty table gives an empty result. Bin names are unique over all shards.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), n_words(F.col(text_col)).alias("n"), F.col(source_col).cast("string").alias("source"), (same_text(F.col(text_col)) if cluster is None else cluster.cast("long")).alias("cluster"), F.xxhash64(F.col(text_col)).alias("th"))
    # Rows that repeat are counted, and numbered when they are listed again: none is in a window.
    slim = slim.groupBy("doc_id", "n", "source", "cluster", "th").agg(F.count(F.lit(1)).alias("c"))
    slim = slim.select("doc_id", "n", "source", "cluster", "th", F.explode(F.sequence(F.lit(1).cast("long"), "c")).alias("copy"))
    slim = materialize(spark, slim, "sizes")
    shards = max(1, -(-slim.count() // shard_rows))
    dealt = slim.withColumn("shard", F.pmod(F.xxhash64("doc_id", "th", "source", "cluster", "copy"), F.lit(shards)))

    def run(key, df):
        rows = list(zip(*(df[c].tolist() for c in ("doc_id", "n", "source", "cluster", "th", "copy")), strict=True))
        known = lambda x: None if x is None or x != x else x
        pieces = []
        for i, n, source, cl, th, copy in rows:
            i, source, cl = known(i), known(source), known(cl)
            for p in range(max(1, -(-n // capacity))):
                pieces.append((min(capacity, n - p * capacity), i is None, i or 0, th, p, copy, source is None, source or "", cl is None, cl or 0, i, source, cl))
        pieces.sort(key=lambda x: (-x[0], *x[1:10]))
        places = best_fit([(x[0], x[11], x[12]) for x in pieces], capacity)
        name = key[0]
        return pd.DataFrame(
            {
                "doc_id": pd.array([x[10] for x in pieces], dtype="Int64"), "piece": [x[4] for x in pieces], "start": [x[4] * capacity for x in pieces], "tokens": [x[0] for x in pieces],
                "bin": [f"{name}-{b}" for b, _ in places], "at": [a for _, a in places], "source": pd.Series([x[11] for x in pieces], dtype=object), "cluster": pd.array([x[12] for x in pieces], dtype="Int64"),
            }
        )

    ids = F.col("doc_id").cast("decimal(19,0)")  # nulls must not turn large ids into floats
    hashes = F.col("cluster").cast("decimal(19,0)")
    pieces = dealt.withColumn("doc_id", ids).withColumn("cluster", hashes).groupBy("shard").applyInPandas(_exact(run), "doc_id long, piece long, start long, tokens long, bin string, at long, source string, cluster long")
    pieces = materialize(spark, pieces, "pieces")
    if shards == 1:
        # Bins of one best-fit never fit into each other: the later one's first piece would have.
        return pieces.drop("source", "cluster")
    ends = _refit(spark, pieces, capacity, shard_rows)
    return pieces.join(ends, "bin").select("doc_id", "piece", "start", "tokens", F.col("root").alias("bin"), (F.col("at") + F.col("shift")).alias("at"))


def _exact(run):
    def ints(key, df):
        whole = lambda c: pd.Series([None if x is None else int(x) for x in df[c]], dtype=object)
        return run(key, df.assign(doc_id=whole("doc_id"), cluster=whole("cluster")))

    return ints
