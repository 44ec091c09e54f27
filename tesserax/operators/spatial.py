"""Window queries and joins of boxes, by overlap (open) or intersection (closed)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .boxes import Box


def window(table: DataFrame, low, high, closed: bool = False, whole: bool = True) -> DataFrame:
    """Entries whose box meets a literal window; the range tests reach the scan."""
    own, asked = Box.named(dims=len(low), whole=whole), Box.literal(low, high, whole)
    return table.where(own.intersects(asked) if closed else own.overlaps(asked))


def _cells(df: DataFrame, size: tuple[float, float], prefix: str) -> DataFrame:
    """A row per grid cell that a two-dimensional box touches."""
    for axis in (0, 1):
        index = lambda c, w=size[axis]: F.floor(F.col(c) / F.lit(w)).cast("long")
        df = df.withColumn(f"_c{axis}", F.explode(F.sequence(index(f"{prefix}lo{axis}"), index(f"{prefix}hi{axis}"))))
    return df


def join(left: DataFrame, right: DataFrame, size: tuple[float, float], closed: bool = False, whole: bool = True) -> DataFrame:
    """Pairs of boxes that meet: columns of ``left`` (lo0, hi0, lo1, hi1, ...) and of
    ``right`` with the prefix ``r_``.

    An equi-join on grid cells finds candidates; a pair counts only in the cell of its
    shared low corner, so none comes twice and no distinct is needed. ``size`` is about
    the extent of a typical box on each axis.
    """
    named = right.select([F.col(c).alias(f"r_{c}") for c in right.columns])
    pairs = _cells(left, size, "").join(_cells(named, size, "r_"), ["_c0", "_c1"])
    a, b = Box.named(whole=whole), Box.named("r_", whole=whole)
    own = [F.floor(F.greatest(F.col(f"lo{i}"), F.col(f"r_lo{i}")) / F.lit(size[i])).cast("long") == F.col(f"_c{i}") for i in (0, 1)]
    return pairs.where((a.intersects(b) if closed else a.overlaps(b)) & own[0] & own[1]).drop("_c0", "_c1")


BOUNDS = ["lo0", "hi0", "lo1", "hi1"]
#: Ids of one box that travel as one list; a box with more has several lists.
LIST = 1024


def different(table: DataFrame) -> DataFrame:
    """The different two-dimensional boxes of a table and how many rows have each (``n``)."""
    return table.groupBy(*BOUNDS).agg(F.count(F.lit(1)).alias("n"))


def count_within(table: DataFrame, key: str, margin: int, size: tuple[float, float], whole: bool = True) -> DataFrame:
    """(key, fat, exact): how many boxes of the table overlap each one's box, grown by a margin
    and as it is.

    Equal boxes meet the same boxes, so only different ones are joined, with their numbers.
    """
    boxes = different(table)
    fat = boxes.select(*BOUNDS, *Box.named(whole=whole).expanded(F.lit(margin)).columns("f_"))
    asked = fat.select(F.struct(*BOUNDS).alias("box"), *(F.col(f"f_{c}").alias(c) for c in BOUNDS))
    exact = Box(tuple(F.col(f"box.lo{i}") for i in (0, 1)), tuple(F.col(f"box.hi{i}") for i in (0, 1)), whole).overlaps(Box.named("r_", whole=whole))
    counted = join(asked, boxes, size, whole=whole).groupBy("box").agg(F.sum("r_n").alias("fat"), F.sum(F.when(exact, F.col("r_n")).otherwise(0)).alias("exact"))
    rows = table.select(key, *BOUNDS).join(counted.select("box.*", "fat", "exact"), BOUNDS)
    return rows.groupBy(key).agg(F.sum("fat").alias("fat"), F.sum("exact").alias("exact"))


def self_join(table: DataFrame, key: str, size: tuple[float, float], closed: bool = False, whole: bool = True) -> DataFrame:
    """(a, b): the keys, a below b, of rows whose boxes meet.

    Different boxes are joined first, each pair of them once; then the keys that have them,
    in lists of about ``LIST`` keys, so that a box of very many rows is shared out.
    """
    boxes = different(table)
    parted = table.select(key, *BOUNDS).join(boxes, BOUNDS).withColumn("part", F.pmod(F.xxhash64(key), F.ceil(F.col("n") / LIST)))
    lists = parted.groupBy(F.struct(*BOUNDS).alias("box"), "part").agg(F.collect_list(key).alias("keys"))
    met = join(boxes, boxes, size, closed, whole).select(F.struct(*BOUNDS).alias("box"), F.struct(*(F.col(f"r_{c}").alias(c) for c in BOUNDS)).alias("r_box")).where("box <= r_box")
    both = met.join(lists, "box").join(lists.toDF("r_box", "r_part", "r_keys"), "r_box").where("box < r_box or part <= r_part")
    # A few MB of lists become all the pairs: deal them out, or a task or two would list them.
    both = both.repartition(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("box", "r_box", "part", "r_part"))
    own = (F.col("box") == F.col("r_box")) & (F.col("part") == F.col("r_part"))
    pairs = both.select(own.alias("own"), "r_keys", F.explode("keys").alias("x")).select("own", "x", F.explode("r_keys").alias("y"))
    # A list meets itself in both orders, any two lists in one.
    once = pairs.where("if(own, x < y, x <> y)")
    return once.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def remove_first(table: DataFrame, hit: Column, order: str) -> DataFrame:
    """Without the one entry that matches and comes first in an explicit order."""
    first = table.where(hit).orderBy(order).limit(1).select(order)
    return table.join(F.broadcast(first), order, "left_anti")


def update_boxes(table: DataFrame, moved: DataFrame, key: str, bounds: list[str]) -> DataFrame:
    """Boxes by id take their new bounds; ids and all else stay."""
    new = moved.select(key, F.struct(*bounds).alias("_n"))
    joined = table.join(new, key, "left")
    return joined.select([F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(c)).alias(c) if c in bounds else F.col(c) for c in table.columns])


def reinsert_order(table: DataFrame, group: str, out: str = "place") -> DataFrame:
    """Entries of a node from the farthest to the nearest to the node's center."""
    box = Box.named(whole=False)
    whole = Window.partitionBy(group)
    mbr = Box(tuple(F.min(c).over(whole) for c in box.low), tuple(F.max(c).over(whole) for c in box.high), False)
    far = sum(((c - m) * (c - m) for c, m in zip(box.center(), mbr.center(), strict=True)), F.lit(0.0))
    return table.withColumn("_d", far).withColumn(out, F.row_number().over(whole.orderBy(F.desc("_d"), "id"))).drop("_d")


def insert(table: DataFrame, new: DataFrame) -> DataFrame:
    """Boxes and values, duplicates too."""
    return table.unionByName(new)


def with_ids(table: DataFrame, new: DataFrame, out: str = "id") -> DataFrame:
    """New boxes get ids above all present ones: unique and stable once written, not dense."""
    top = table.agg(F.coalesce(F.max(out), F.lit(-1)).alias("_m"))
    return new.withColumn("_i", F.monotonically_increasing_id()).join(F.broadcast(top)).withColumn(out, F.col("_m") + 1 + F.col("_i")).drop("_m", "_i")


def set_values(table: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Values by id take the new ones; boxes stay."""
    return update_boxes(table, new, key, [value])


def get(table: DataFrame, key: str, wanted, margin=None, dims: int = 2, whole: bool = True) -> DataFrame:
    """The entry of an id, with its box as it is or grown by a margin."""
    hit = table.where(F.col(key) == F.lit(wanted))
    if margin is None:
        return hit
    grown = Box.named(dims=dims, whole=whole).expanded(margin)
    rest = [c for c in table.columns if c not in {f"{n}{i}" for n in ("lo", "hi") for i in range(dims)}]
    return hit.select(*rest, *grown.columns())
