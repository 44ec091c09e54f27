"""Halving cells (quadtree, octree): assignment, roll-up, pruned traversal.

Level L cuts each axis of the root in 2**L. A point on a cut lies in the lower cell; a box
lies in the deepest cell that holds it. A cell's ancestors are its indexes shifted right, so
whether a traversal reaches a cell is an expression over its own row, and not a loop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def index_of(x: Column, low: float, high: float, level: int) -> Column:
    """The cell of a coordinate at a level."""
    t = (x - F.lit(low)) / F.lit(high - low) * F.lit(float(1 << level))
    return F.least(F.greatest(F.ceil(t) - 1, F.lit(0)), F.lit((1 << level) - 1)).cast("long")


def points_at(points: DataFrame, axes: tuple[str, ...], low: float, high: float, levels: int) -> DataFrame:
    """Each point once per level 0 to ``levels``, with its cell as c0, c1, ..."""
    cells = F.array(*(F.struct(F.lit(v).alias("level"), *(index_of(F.col(a), low, high, v).alias(f"c{i}") for i, a in enumerate(axes))) for v in range(levels + 1)))
    return points.withColumn("_x", F.explode(cells)).select(*points.columns, "_x.*")


def rollup(points: DataFrame, axes: tuple[str, ...], low: float, high: float, levels: int, *aggregates: Column) -> DataFrame:
    """Aggregates of every non-empty cell of every level.

    The finest level is aggregated from the rows; with sums and counts callers may fold it
    upwards, but here each row is dealt to all its cells and combined before the shuffle.
    """
    names = [f"c{i}" for i in range(len(axes))]
    return points_at(points, axes, low, high, levels).groupBy("level", *names).agg(*aggregates)


def box_cell(low_bounds: tuple[Column, ...], high_bounds: tuple[Column, ...], low: float, high: float, levels: int) -> Column:
    """(level, c0, c1, ...) of the deepest cell that holds a box."""
    out = None
    for v in range(levels + 1):
        t = lambda x, v=v: (x - F.lit(low)) / F.lit(high - low) * F.lit(float(1 << v))
        above = [index_of(h, low, high, v) for h in high_bounds]
        below = [F.floor(t(a)) for a in low_bounds]
        holds = reduce(lambda a, b: a & b, [lo >= hi for lo, hi in zip(below, above, strict=True)])
        cell = F.struct(F.lit(v).alias("level"), *(c.alias(f"c{i}") for i, c in enumerate(above)))
        out = cell if out is None else F.when(holds, cell).otherwise(out)
    return out


def child_index(low: tuple[Column, ...], high: tuple[Column, ...], center: tuple[Column, ...]) -> Column:
    """The child of a cell that holds a box, one bit per axis; null if it straddles."""
    bits = [F.when(h <= c, 0).when(a >= c, 1 << i) for i, (a, h, c) in enumerate(zip(low, high, center, strict=True))]
    return reduce(lambda a, b: a + b, bits)


def child_bounds(low: tuple[Column, ...], high: tuple[Column, ...], child: Column) -> list[tuple[Column, Column]]:
    out = []
    for i, (a, b) in enumerate(zip(low, high, strict=True)):
        middle = a + (b - a) / 2
        upper = F.shiftright(child, i).bitwiseAND(1) == 1
        out.append((F.when(upper, middle).otherwise(a), F.when(upper, b).otherwise(middle)))
    return out


def reached(accept, dims: int, levels: int) -> Column:
    """Whether no proper ancestor of a cell is accepted. ``accept(level, cells)`` is the
    decision for a cell at a literal level with index columns ``cells``."""
    out = F.lit(True)
    for v in range(levels):
        up = F.col("level") - F.lit(v)
        ancestor = tuple(F.when(up > 0, F.call_function("shiftright", F.col(f"c{i}"), up)).otherwise(F.lit(0).cast("long")) for i in range(dims))
        out = out & ((up <= 0) | ~accept(v, ancestor))
    return out


def doublings(point: tuple[Column, ...], low: tuple[float, ...], high: tuple[float, ...], most: int = 60) -> Column:
    """How often a root must double, each axis towards the point, until it holds it; null for a
    root without extent on some axis."""
    if any(b <= a for a, b in zip(low, high, strict=True)):
        return F.lit(None).cast("int")
    axes = []
    for p, a, b in zip(point, low, high, strict=True):
        need = F.when(p > b, p - a).when(p < a, F.lit(b) - p).otherwise(F.lit(0.0))
        axes.append(F.size(F.filter(F.sequence(F.lit(0), F.lit(most - 1)), _too_small(b - a, need))))
    return F.greatest(*axes) if len(axes) > 1 else axes[0]


def _too_small(width: float, need: Column):
    return lambda k: F.lit(float(width)) * F.pow(F.lit(2.0), k) < need


def can_split(level: Column, extent: Column, least, deepest: int = 32) -> Column:
    """A cell may be halved above the depth limit while both halves keep the least extent."""
    return (level < deepest) & (extent / 2 >= least)
