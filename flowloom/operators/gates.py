"""Gates: composable predicates over events (FLT-01 to FLT-14).

A gate is a value; `condition()` gives a Column, so that several gates are one filter that Spark pushes into the scan.
"""

from __future__ import annotations

import hashlib
import re
import warnings
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.numeric import all_of, finite


class GateWarning(UserWarning):
    """Something about a gate that is legal but probably unintended."""


@dataclass(frozen=True)
class Box:
    """low <= feature <= high (FLT-01). Equal bounds switch the gate off; swapped bounds are put right."""

    feature: str
    low: float | None = None
    high: float | None = None

    def __post_init__(self):
        if (self.low is None) != (self.high is None):
            raise ValueError(f"{self.feature}: both bounds must be given")
        if self.low is not None and self.low > self.high:
            warnings.warn(f"{self.feature}: bounds are swapped", GateWarning, stacklevel=3)
            low, high = self.high, self.low
            object.__setattr__(self, "low", low)
            object.__setattr__(self, "high", high)

    @property
    def off(self) -> bool:
        return self.low is None or self.low == self.high

    def condition(self) -> Column:
        if self.off:
            return F.lit(True)
        return F.col(self.feature).between(self.low, self.high)  # finite bounds leave NaN out


@dataclass(frozen=True)
class Finite:
    """Only events whose features are all finite (FLT-02)."""

    features: tuple[str, ...]

    def condition(self) -> Column:
        return all_of(finite(f) for f in self.features)


def _number(x: float) -> Column:
    return F.lit(float(x))


@dataclass(frozen=True)
class Polygon:
    """Even-odd test on two features (FLT-03, FLT-04): lower and left edges are inside, upper and right ones outside."""

    x: str
    y: str
    points: tuple[tuple[float, float], ...]
    inverted: bool = False
    name: str = ""

    def __post_init__(self):
        points = tuple((float(a), float(b)) for a, b in self.points)
        if len(points) < 3:
            raise ValueError("a polygon needs at least three points")
        object.__setattr__(self, "points", points)

    def copy(self, invert: bool = False) -> Polygon:
        return replace(self, inverted=self.inverted != invert)

    @property
    def digest(self) -> str:
        return hashlib.md5(repr((self.x, self.y, self.points, self.inverted)).encode()).hexdigest()

    def crossings(self, x: Column, y: Column) -> Column:
        """How many edges a ray to the right of (x, y) crosses; horizontal edges never count."""
        total = F.lit(0)
        for (xa, ya), (xb, yb) in zip(self.points, self.points[-1:] + self.points[:-1]):
            if ya == yb:
                continue
            low, high = min(ya, yb), max(ya, yb)
            at = _number((xb - xa) / (yb - ya)) * (y - _number(ya)) + _number(xa)
            total = total + F.when((y >= low) & (y < high) & (x < at), 1).otherwise(0)
        return total

    def condition(self) -> Column:
        x, y = F.col(self.x).cast("double"), F.col(self.y).cast("double")
        sane = ~F.isnan(x) & ~F.isnan(y)
        inside = sane & (self.crossings(x, y) % 2 == 1)
        if self.inverted:
            return F.coalesce(~inside, F.lit(True))
        xs, ys = zip(*self.points)  # the bounding box can be pushed into the scan
        return x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)) & inside


class PolygonIdWarning(UserWarning):
    """A polygon's id was taken."""


class PolygonRegistry:
    """Polygons by unique numbers (FLT-10); a number that was given once isn't given again before all are cleared."""

    def __init__(self):
        self._by_id: dict[int, Polygon] = {}
        self._next = 0

    def add(self, polygon: Polygon, unique_id: int | None = None) -> int:
        """Keep a polygon and give its number: the wanted one, or with a warning a new one if it is taken."""
        if unique_id is None:
            unique_id = self._next
        elif unique_id in self._by_id:
            new = max(self._next, unique_id + 1)
            warnings.warn(f"polygon {unique_id} exists; this one is {new}", PolygonIdWarning, stacklevel=2)
            unique_id = new
        self._next = max(self._next, unique_id + 1)
        self._by_id[unique_id] = polygon
        return unique_id

    def __getitem__(self, unique_id: int) -> Polygon:
        if unique_id not in self._by_id:
            raise KeyError(f"there is no polygon {unique_id}")
        return self._by_id[unique_id]

    def __contains__(self, unique_id: int) -> bool:
        return unique_id in self._by_id

    def __iter__(self):
        return iter(sorted(self._by_id))

    def __len__(self) -> int:
        return len(self._by_id)

    def copy(self, unique_id: int, invert: bool = False) -> int:
        return self.add(self[unique_id].copy(invert))

    def remove(self, unique_id: int) -> None:
        del self._by_id[self._known(unique_id)]

    def _known(self, unique_id: int) -> int:
        self[unique_id]
        return unique_id

    def clear(self) -> None:
        self._by_id.clear()
        self._next = 0

    def gates(self, unique_ids: Sequence[int]) -> list[Polygon]:
        """The polygons of a measurement's metadata [filtering] polygon filters."""
        return [self[i] for i in unique_ids]

    def import_text(self, text: str) -> list[int]:
        """Add all polygons of a polygon file, each under its own number if it is free."""
        from flowloom.sources.store import parse_polygons

        numbers = [int(m) for m in re.findall(r"^\[Polygon\s+(\d+)\]", text, re.M | re.I)]
        return [self.add(p, n) for p, n in zip(parse_polygons(text), numbers)]

    def export_text(self) -> str:
        """All of them as a polygon file, under their numbers."""
        from flowloom.sources.store import polygons_text

        out = []
        for i in self:
            out.append(polygons_text([self[i]]).replace(f"[Polygon {0:08d}]", f"[Polygon {i:08d}]", 1))
        return "\n".join(out)


def points_in_polygon(points: Sequence[tuple[float, float]], polygon: Sequence[tuple[float, float]]) -> list[bool]:
    """The same rule for a few points on the driver."""
    out = []
    for x, y in points:
        inside = False
        for (xa, ya), (xb, yb) in zip(polygon, list(polygon[-1:]) + list(polygon[:-1])):
            if ya != yb and min(ya, yb) <= y < max(ya, yb) and x < (xb - xa) / (yb - ya) * (y - ya) + xa:
                inside = not inside
        out.append(inside)
    return out


def grid_in_polygon(spark, shape: tuple[int, int], polygon: Sequence[tuple[float, float]]) -> DataFrame:
    """Raster mask (FLT-05): rows (r, c, inside) for each cell of a grid, vertices being (row, column)."""
    rows, cols = shape
    grid = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("double").alias("r"), (F.col("id") % cols).cast("double").alias("c"))
    gate = Polygon("c", "r", tuple((b, a) for a, b in polygon))
    return grid.select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.coalesce(gate.condition(), F.lit(False)).alias("inside"))


def combine(gates: Iterable, enabled: bool = True) -> Column:
    """All gates together (FLT-08); with gating disabled, everything passes."""
    return all_of(g.condition() for g in gates) if enabled else F.lit(True)


def exclude(df: DataFrame, rows: DataFrame, key: str = "event_idx") -> DataFrame:
    """Manual gate (FLT-06): df without the rows whose keys are listed, however many there are."""
    return df.join(rows.select(key).distinct(), key, "left_anti")


def with_masks(df: DataFrame, gates: dict[str, object]) -> DataFrame:
    """Each gate's mask, and all of them together, as columns (FLT-11)."""
    named = {f"gate_{k}": F.coalesce(g.condition(), F.lit(False)) for k, g in gates.items()}
    return df.withColumns(named | {"gate_all": F.coalesce(combine(gates.values()), F.lit(False))})


def drop_empty_boundary_images(df: DataFrame, image: str = "image", key: str = "event_idx") -> DataFrame:
    """Without the first or last event if its image is all zero (FLT-14); the ends are two aggregates, not a sort."""
    ends = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    empty = F.forall(F.col(image), lambda x: x == 0)
    return df.crossJoin(F.broadcast(ends)).where(~(empty & ((F.col(key) == F.col("lo")) | (F.col(key) == F.col("hi"))))).drop("lo", "hi")
