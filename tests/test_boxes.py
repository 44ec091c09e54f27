"""Box predicates and measures against loops over the axes."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tesserax.operators import spatial
from tesserax.operators.boxes import MAX_LONG, Box


@pytest.fixture
def value(spark):
    return lambda column: spark.range(1).select(column.alias("x")).first().x


def box(*c, whole=True):
    n = len(c) // 2
    return Box.literal(c[:n], c[n:], whole)


def drawn(seed, dims, n=12):
    """Pairs of boxes with corners on a small grid, so that edges often touch."""
    rng = random.Random(seed)
    corners = lambda: [sorted(rng.choices(range(-4, 7), k=2)) for _ in range(dims)]
    return [(corners(), corners()) for _ in range(n)]


def made(axes):
    return box(*(a for a, _ in axes), *(b for _, b in axes))


@pytest.mark.parametrize("dims", [1, 2, 3, 5])
def test_measures(value, dims):
    for one, other in drawn(dims, dims):
        a, b, sizes = made(one), made(other), [hi - lo for lo, hi in one]
        for start in range(dims):
            for count in range(1, dims - start + 1):
                part = range(start, start + count)
                faces = sum(math.prod(sizes[j] for j in part if j != i) for i in part)
                grown = math.prod(max(one[i][1], other[i][1]) - min(one[i][0], other[i][0]) for i in part)
                shared = math.prod(max(0, min(one[i][1], other[i][1]) - max(one[i][0], other[i][0])) for i in part)
                whole = math.prod(sizes[i] for i in part)
                want = (whole, sum(sizes[i] for i in part), 2 * faces, grown - whole, shared)
                got = F.array(a.measure(start, count), a.perimeter(start, count), a.surface(start, count), a.enlargement(b, start, count), a.overlap_measure(b, start, count))
                assert tuple(value(got)) == want


def test_measures_saturate(value):
    wide = Box((F.lit(-(1 << 63)),) * 2, (F.lit((1 << 63) - 1),) * 2)
    assert value(wide.measure()) == value(wide.perimeter()) == MAX_LONG


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_predicates(value, dims):
    for one, other in drawn(10 + dims, dims, 25):
        a, b = made(one), made(other)
        apart = [(hi <= c or d <= lo, hi < c or d < lo) for (lo, hi), (c, d) in zip(one, other, strict=True)]
        point = [c for c, _ in other]
        inside = all(lo <= p < hi for p, (lo, hi) in zip(point, one, strict=True))
        holds = all(lo <= c and d <= hi for (lo, hi), (c, d) in zip(one, other, strict=True))
        got = F.array(a.overlaps(b), a.intersects(b), a.contains(tuple(map(F.lit, point))), a.contains_box(b))
        assert value(got) == [not any(x for x, _ in apart), not any(y for _, y in apart), inside, holds]
        middle = [lo + (hi - lo) // 2 for lo, hi in one]
        assert value(F.array(*a.center())) == middle
        for least in (1, 2, 3):
            want = all(lo < m < hi and m - lo >= least and hi - m >= least for m, (lo, hi) in zip(middle, one, strict=True))
            assert value(a.splittable(F.lit(least))) == want


def test_not_a_number_is_no_reason_to_split(value):
    assert not value(box(float("nan"), -1.0, 6.5, 9.0, whole=False).splittable(F.lit(0.5)))


def test_grid_join_is_the_theta_join(spark):
    rows = [(i, (i * 7) % 25 - 12, (i * 11) % 25 - 12) for i in range(60)]
    table = spark.createDataFrame([(i, x, x + 3, y, y + 3) for i, x, y in rows], "id long, lo0 long, hi0 long, lo1 long, hi1 long")
    for closed in (False, True):
        for size in ((1.0, 1.0), (4.0, 7.0), (100.0, 100.0)):
            got = sorted((r.id, r.r_id) for r in spatial.join(table, table, size, closed).collect())
            meets = (lambda d: abs(d) <= 3) if closed else (lambda d: abs(d) < 3)
            assert got == sorted((i, j) for i, x, y in rows for j, u, v in rows if meets(x - u) and meets(y - v))
