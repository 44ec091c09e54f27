"""SimHash near-dedup over a segment-popcount embedding.

A 64-bit fingerprint is cut into equal segments and mapped to the number of ones in
each. The Manhattan distance of two such vectors is at most the Hamming distance of the
fingerprints, so points farther apart than the limit need no look. The range join runs on
the integer grid of these vectors: two points at Manhattan distance of 2 or less share a
grid cell at distance 1 or less from both, so each point enters its own cell and those one
step away, and an equi-join on cells meets every pair within range. What meets is then
verified on the exact fingerprints.

Segments of two bits keep cells small (chance meetings are about 5e-11 of all pairs). A
cell that still holds more than ``cell_limit`` fingerprints is embedded again with segments
of one bit, where a cell holds 65 fingerprints at most, all of them within the limit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import components
from .runtime import materialize

SHINGLE = 3
SEED = 42
MAX_BITS = 2
SEGMENT_BITS = 2
CELL_LIMIT = 64
BLOCK = 1 << 16


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 values of all word shingles, as a signed 64-bit number."""
    words = (text or b"").lower().split()  # of bytes: A-Z only, and the six ASCII white-space bytes
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + shingle - 1]
        k = min(BLOCK, n - at)
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
        h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), dtype="<u8", count=k)
        ones += np.unpackbits(h.view(np.uint8).reshape(k, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def majority(values: np.ndarray) -> int:
    """The fingerprint of 64-bit hash values, as a signed 64-bit number; of none: zero."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(values), BLOCK):
        part = np.ascontiguousarray(values[at : at + BLOCK], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) for every row, from whole texts; a null text counts as empty.

    ``carry`` names long columns to take along.
    """
    names = ["doc_id", *carry, "fp"]

    def run(batches):
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fps, pa.int64())], names=names)

    slim = docs.select(F.col(text_col).cast("binary").alias("t"), F.col(id_col).cast("long").alias("doc_id"), *carry)
    return slim.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _mask(unit: int, step: int) -> int:
    return _signed(sum(unit << i for i in range(0, 64, step)))


def segment_counts(fp: Column, bits: int) -> Column:
    """The popcount of each segment, in the segment's own bits (1, 2 or 4 of them)."""
    if bits == 1:
        return fp
    one = F.lit(_mask(1, 2))
    a, b = fp.bitwiseAND(one), F.shiftrightunsigned(fp, 1).bitwiseAND(one)
    two = a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))  # no sum: it could overflow the sign
    if bits == 2:
        return two
    if bits == 4:
        three = F.lit(_mask(3, 4))
        return two.bitwiseAND(three) + F.shiftrightunsigned(two, 2).bitwiseAND(three)
    raise ValueError("segments have 1, 2 or 4 bits")


def grid_cells(cell: Column, bits: int) -> Column:
    """The cell and all cells at Manhattan distance 1 that fingerprints can have."""
    around = [cell]
    for at in range(0, 64, bits):
        field = F.shiftrightunsigned(cell, at).bitwiseAND(F.lit((1 << bits) - 1))
        rest = cell.bitwiseAND(F.lit(_signed(~(((1 << bits) - 1) << at) & ((1 << 64) - 1))))
        around.append(F.when(field < bits, rest.bitwiseOR(F.shiftleft(field + F.lit(1), at))))
        around.append(F.when(field > 0, rest.bitwiseOR(F.shiftleft(field - F.lit(1), at))))
    return F.array(*around)


def _entries(points: DataFrame, bits: int) -> DataFrame:
    # A few MB of points become fifty times as many rows: deal them out first, as a small
    # exchange would otherwise be merged into a task or two. (By the bare column the planner
    # would drop the exchange as done already.)
    dealt = points.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    cells = dealt.withColumn("at", segment_counts(F.col("fp"), bits))
    return cells.select("fp", F.explode(grid_cells(F.col("at"), bits)).alias("cell")).where("cell is not null")


def links(points: DataFrame, max_bits: int = MAX_BITS, bits: int = SEGMENT_BITS, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """(src, dst): verified links between distinct fingerprints, enough to connect all that
    differ in ``max_bits`` (at most 2) bits or fewer. No cap: full cells are split exactly."""
    if max_bits not in (1, 2):
        raise ValueError("cells one step away meet distances of up to 2")
    sized = _entries(points, bits).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("cell")))
    near = F.expr(
        f"flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, size(m)), y -> bit_count(x ^ y) <= {max_bits}), y -> struct(x as src, y as dst))))"
    )
    small = sized.where(f"n between 2 and {cell_limit}").groupBy("cell").agg(F.sort_array(F.collect_list("fp")).alias("m"))
    found = small.select(F.explode(near).alias("p")).select("p.src", "p.dst")
    # A one-bit cell is a 64-bit value with its 65 neighbours: the group is bounded by nature.
    full = _entries(sized.where(f"n > {cell_limit}").select("fp").distinct(), 1)
    exact = full.groupBy("cell").agg(F.sort_array(F.collect_list("fp")).alias("m")).where("size(m) > 1")
    return found.union(exact.select(F.explode(near).alias("p")).select("p.src", "p.dst")).distinct()


def _smallest(spark: SparkSession, own: DataFrame, by: str, max_bits: int, segment_bits: int, cell_limit: int) -> DataFrame:
    """(fp, first): the smallest ``by`` among all rows that a fingerprint reaches."""
    classes = own.groupBy("fp").agg(F.min(by).alias("own"))
    roots = components(spark, links(classes.select("fp"), max_bits, segment_bits, cell_limit))
    linked = roots.join(classes, roots.node == classes.fp).select("root", "fp", "own")
    joined = linked.join(linked.groupBy("root").agg(F.min("own").alias("first")), "root").select("fp", "first")
    return classes.join(joined, "fp", "left").select("fp", F.coalesce("first", "own").alias("first"))


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, segment_bits: int = SEGMENT_BITS, cell_limit: int = CELL_LIMIT) -> DataFrame:
    """(doc_id, fp, component_id), one row per input row.

    Null and empty texts have fingerprint zero and link like any other. A null id keeps its
    row; component_id is the smallest id that is not null, null if there is none. Repeated
    rows repeat. An empty table gives an empty result. Other columns are not read.
    """
    own = materialize(spark, fingerprints(docs, id_col, text_col), "fingerprints")
    # From a table, both sides of the last join have exchanges of their own, and a fingerprint
    # with very many rows can be split.
    first = materialize(spark, _smallest(spark, own, "doc_id", max_bits, segment_bits, cell_limit), "groups")
    return own.join(first, "fp").select("doc_id", "fp", F.col("first").alias("component_id"))


def keep_one(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each near-duplicate group, all columns: that of the smallest id.

    Null ids come after all others, then the hash of the text decides; of rows that repeat
    both id and text, one stays.
    """
    rank = F.struct(F.col(id_col).isNull().alias("n"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("i"), F.xxhash64(text_col).alias("h"))
    own = fingerprints(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")), carry=("h",))
    own = materialize(spark, own.select("fp", F.struct(F.col("doc_id").isNull().alias("n"), F.coalesce("doc_id", F.lit(0)).alias("i"), "h").alias("rank")), "fingerprints")
    # A group's smallest rank belongs to one of its own rows, and equal ranks are equal texts.
    keep = _smallest(spark, own, "rank", max_bits, SEGMENT_BITS, CELL_LIMIT).select("first.*").distinct()
    keyed = docs.select(rank.alias("_rank"), F.struct(*docs.columns).alias("_row"))
    kept = keyed.select("_rank.*", "_row").join(keep, ["n", "i", "h"], "left_semi")
    once = kept.withColumn("_k", F.row_number().over(Window.partitionBy("n", "i", "h").orderBy(F.lit(0)))).where("_k = 1")
    return once.select("_row.*")
