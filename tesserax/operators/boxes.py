"""N-dimensional boxes as expressions, one column per bound.

``overlaps`` leaves touching edges out, ``intersects`` takes them in, and a point lies in a
box from low up to, but without, high. Measures saturate instead of overflowing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LONG = (1 << 63) - 1
MAX_DOUBLE = 1.7976931348623157e308


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


@dataclass(frozen=True)
class Box:
    """Bounds of a box; ``whole`` says that they are BIGINT and not DOUBLE."""

    low: tuple[Column, ...]
    high: tuple[Column, ...]
    whole: bool = True

    @staticmethod
    def named(prefix: str = "", dims: int = 2, whole: bool = True, alias: str | None = None) -> Box:
        """Columns ``<prefix>lo0, <prefix>hi0, ...``."""
        c = lambda n: F.col(f"{alias}.{prefix}{n}" if alias else f"{prefix}{n}")
        return Box(tuple(c(f"lo{i}") for i in range(dims)), tuple(c(f"hi{i}") for i in range(dims)), whole)

    @staticmethod
    def literal(low, high, whole: bool = True) -> Box:
        return Box(tuple(map(F.lit, low)), tuple(map(F.lit, high)), whole)

    @staticmethod
    def of_struct(column: str, dims: int, whole: bool = True) -> Box:
        """A struct<low: array, high: array> column."""
        return Box(tuple(F.element_at(f"{column}.low", i + 1) for i in range(dims)), tuple(F.element_at(f"{column}.high", i + 1) for i in range(dims)), whole)

    @property
    def dims(self) -> int:
        return len(self.low)

    def low_axis(self, axis: int) -> Column:
        return self.low[axis]

    def high_axis(self, axis: int) -> Column:
        return self.high[axis]

    def valid(self) -> Column:
        return _all([a <= b for a, b in zip(self.low, self.high, strict=True)])

    def finite(self) -> Column:
        """No bound is NaN or infinite."""
        return _all([~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")) for x in (*self.low, *self.high)])

    def contains(self, point: tuple[Column, ...]) -> Column:
        return _all([(p >= a) & (p < b) for p, a, b in zip(point, self.low, self.high, strict=True)])

    def contains_box(self, other: Box) -> Column:
        return _all([(c >= a) & (d <= b) for a, b, c, d in zip(self.low, self.high, other.low, other.high, strict=True)])

    def overlaps(self, other: Box) -> Column:
        return ~_any([(b <= c) | (d <= a) for a, b, c, d in zip(self.low, self.high, other.low, other.high, strict=True)])

    def intersects(self, other: Box) -> Column:
        return ~_any([(b < c) | (d < a) for a, b, c, d in zip(self.low, self.high, other.low, other.high, strict=True)])

    def merged(self, other: Box) -> Box:
        return Box(tuple(map(F.least, self.low, other.low)), tuple(map(F.greatest, self.high, other.high)), self.whole)

    def expanded(self, by) -> Box:
        return Box(tuple(a - by for a in self.low), tuple(b + by for b in self.high), self.whole)

    def _top(self) -> Column:
        return F.lit(MAX_LONG) if self.whole else F.lit(MAX_DOUBLE)

    def extent(self, axis: int) -> Column:
        """high - low, saturating."""
        if self.whole:
            return F.coalesce(F.try_subtract(self.high[axis], self.low[axis]), self._top())
        return F.least(self.high[axis] - self.low[axis], self._top())

    def _product(self, factors: list[Column]) -> Column:
        step = (lambda a, b: F.coalesce(F.try_multiply(a, b), self._top())) if self.whole else (lambda a, b: F.least(a * b, self._top()))
        return reduce(step, factors)

    def _sum(self, terms: list[Column]) -> Column:
        step = (lambda a, b: F.coalesce(F.try_add(a, b), self._top())) if self.whole else (lambda a, b: F.least(a + b, self._top()))
        return reduce(step, terms)

    def _axes(self, start: int, dims: int | None) -> range:
        return range(start, start + (self.dims - start if dims is None else dims))

    def measure(self, start: int = 0, dims: int | None = None) -> Column:
        return self._product([self.extent(i) for i in self._axes(start, dims)])

    def perimeter(self, start: int = 0, dims: int | None = None) -> Column:
        """The sum of the extents, not doubled."""
        return self._sum([self.extent(i) for i in self._axes(start, dims)])

    def surface(self, start: int = 0, dims: int | None = None) -> Column:
        """Twice the sum of the measures of the faces: for each axis the product of the others."""
        axes = list(self._axes(start, dims))
        one = F.lit(1).cast("long") if self.whole else F.lit(1.0)
        faces = [self._product([self.extent(j) for j in axes if j != i] or [one]) for i in axes]
        return self._sum([self._sum(faces), self._sum(faces)])

    def enlargement(self, other: Box, start: int = 0, dims: int | None = None) -> Column:
        grown = self.merged(other).measure(start, dims) - self.measure(start, dims)
        return F.greatest(grown, F.lit(0).cast("long") if self.whole else F.lit(0.0))

    def overlap_measure(self, other: Box, start: int = 0, dims: int | None = None) -> Column:
        """0 where they are apart or touch."""
        axes = list(self._axes(start, dims))
        shared = Box(tuple(map(F.greatest, self.low, other.low)), tuple(map(F.least, self.high, other.high)), self.whole)
        zero = F.lit(0).cast("long") if self.whole else F.lit(0.0)
        return F.when(_any([shared.high[i] <= shared.low[i] for i in axes]), zero).otherwise(shared.measure(start, dims))

    def center(self) -> tuple[Column, ...]:
        """low + half of the extent, truncated for whole numbers."""
        half = (lambda x: F.call_function("div", x, F.lit(2))) if self.whole else (lambda x: x / 2)
        return tuple(a + half(self.extent(i)) for i, a in enumerate(self.low))

    def splittable(self, least) -> Column:
        """The center lies strictly inside and both halves keep the least extent; NaN: false."""
        tests = [(c > a) & (c < b) & (c - a >= least) & (b - c >= least) for a, b, c in zip(self.low, self.high, self.center(), strict=True)]
        ok = _all(tests)
        return ok if self.whole else ok & ~_any([F.isnan(x) for x in (*self.low, *self.high)])

    def axes(self, start: int, dims: int) -> Box:
        return Box(self.low[start : start + dims], self.high[start : start + dims], self.whole)

    def embedded(self, start: int, dims: int) -> Box:
        """In more dimensions, from an axis on, zero elsewhere."""
        zero = F.lit(0).cast("long") if self.whole else F.lit(0.0)
        wide = lambda x: (zero,) * start + x + (zero,) * (dims - start - len(x))
        return Box(wide(self.low), wide(self.high), self.whole)

    def columns(self, prefix: str = "") -> list[Column]:
        return [c.alias(f"{prefix}{n}{i}") for i in range(self.dims) for n, c in (("lo", self.low[i]), ("hi", self.high[i]))]
