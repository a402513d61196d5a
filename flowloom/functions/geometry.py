"""Geometry of contours and images held in array columns (IMG-01 to IMG-12, AGG-18, WIN-06, SRC-15, SRC-16).

Sums over edges are higher-order functions that stay in the JVM; hulls and contour finding are Arrow-batched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.functions.numeric import NAN

_CONTOUR = "array<struct<x:int,y:int>>"


def rotated(a: Column) -> Column:
    """Each element's successor, the first following the last."""
    return F.when(F.size(a) > 0, F.concat(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 1, 1))).otherwise(a)


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _edges(x: Column, y: Column, term) -> Column:
    """Sum over a polygon's edges of term(xa, ya, xb, yb)."""
    a = F.arrays_zip(x.cast("array<double>").alias("x"), y.cast("array<double>").alias("y"))
    pairs = F.zip_with(a, rotated(a), lambda p, q: term(p["x"], p["y"], q["x"], q["y"]))
    return _total(pairs)


def moments(x: Column, y: Column) -> dict[str, Column]:
    """Area, centroid and central second moments of a polygon by Green's theorem; orientation doesn't matter, and an
    area of practically 0 gives null."""
    cross = lambda xa, ya, xb, yb: xa * yb - xb * ya
    double = _edges(x, y, cross)
    sign = F.when(double < 0, -1.0).otherwise(1.0)
    a00 = F.when(F.abs(double / 2) > 1.2e-7, sign * double / 2)
    a10 = sign * _edges(x, y, lambda xa, ya, xb, yb: cross(xa, ya, xb, yb) * (xa + xb)) / 6
    a01 = sign * _edges(x, y, lambda xa, ya, xb, yb: cross(xa, ya, xb, yb) * (ya + yb)) / 6
    a20 = sign * _edges(x, y, lambda xa, ya, xb, yb: cross(xa, ya, xb, yb) * (xa * (xa + xb) + xb * xb)) / 12
    a02 = sign * _edges(x, y, lambda xa, ya, xb, yb: cross(xa, ya, xb, yb) * (ya * (ya + yb) + yb * yb)) / 12
    a11 = sign * _edges(x, y, lambda xa, ya, xb, yb: cross(xa, ya, xb, yb) * (xa * (2 * ya + yb) + xb * (ya + 2 * yb))) / 24
    cx, cy = a10 / a00, a01 / a00
    return {"m00": a00, "cx": cx, "cy": cy, "mu20": a20 - a10 * cx, "mu02": a02 - a01 * cy, "mu11": a11 - a10 * cy}


def inert_ratio(mu20: Column, mu02: Column) -> Column:
    return F.when(mu02 > 0, F.sqrt(mu20 / mu02)).otherwise(F.lit(NAN))


def tilt(mu20: Column, mu02: Column, mu11: Column) -> Column:
    """Angle of the long axis to the x axis, between 0 and half a circle's quarter."""
    return F.abs(F.lit(0.5) * F.atan2(-2 * mu11, mu20 - mu02))


def principal_ratio(mu20: Column, mu02: Column, mu11: Column) -> Column:
    """Inertia ratio along the principal axes: what turning the contour by its tilt and taking the ratio gives."""
    half, rest = (mu20 + mu02) / 2, F.sqrt(F.pow((mu20 - mu02) / 2, 2) + mu11 * mu11)
    return F.when(half - rest > 0, F.sqrt((half + rest) / (half - rest))).otherwise(F.lit(NAN))


def revolve(r: Column, z: Column, pixel_um: float) -> Column:
    """Volume of the truncated cones that the edges of (r, z), r >= 0, sweep around the z axis."""
    cone = _edges(r, z, lambda ra, za, rb, zb: (zb - za) * (ra * ra + ra * rb + rb * rb))
    return cone * math.pi / 3 * pixel_um**3


def volume(x: Column, y: Column, pos_x: Column, pos_y: Column, pixel_um: float) -> Column:
    """Mean volume of the upper and the lower half swept around the x axis through the centroid; NaN below 4 points."""
    cx = F.transform(x.cast("array<double>"), lambda v: v - pos_x / pixel_um)
    cy = F.transform(y.cast("array<double>"), lambda v: v - pos_y / pixel_um)
    upper = F.transform(cy, lambda v: F.greatest(v, F.lit(0.0)))
    lower = F.transform(cy, lambda v: F.greatest(-v, F.lit(0.0)))
    both = F.abs(revolve(upper, cx, pixel_um)) + F.abs(revolve(lower, cx, pixel_um))
    return F.when(F.size(x) >= 4, both / 2).otherwise(F.lit(NAN))


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the hull in counter-clockwise order, by monotone chains."""
    pts = sorted(set(map(tuple, points.tolist())))
    if len(pts) < 3:
        return np.array(pts)

    def half(seq):
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


@F.pandas_udf(T.StructType([T.StructField(c, T.ArrayType(T.DoubleType())) for c in "xy"]))
def hull(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Convex hulls of contours (x, y); empty where there is none."""
    for xs, ys in batches:
        rows = []
        for x, y in zip(xs, ys):
            h = convex_hull(np.column_stack([x, y]).astype(float)) if x is not None and len(x) > 2 else np.zeros((0, 2))
            rows.append((h[:, 0].tolist(), h[:, 1].tolist()) if len(h) > 2 else ([], []))
        yield pd.DataFrame(rows, columns=["x", "y"])


def outline(mask: np.ndarray) -> np.ndarray:
    """The longest outline of a mask as integer (x, y): iso-line just under the mask's edge pixels, rounded, equal
    neighbours dropped. Without pixels, no points."""
    from flowloom.operators.density import iso_lines

    padded = np.pad(mask.astype(float), 1)
    lines = iso_lines(padded, 0.9999)
    if not lines:
        return np.zeros((0, 2), int)
    longest = max(enumerate(lines), key=lambda k: (len(k[1]), k[0]))[1]
    p = np.rint(longest - 1).astype(int)[:, ::-1]
    keep = (p != np.roll(p, 1, 0)).any(1)
    return p[keep]


def contour_of(mask: Column, height: Column, width: Column) -> Column:
    """Contours of flat masks as array<struct<x, y>>; masks without pixels have none (null)."""

    @F.pandas_udf(_CONTOUR)
    def find(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for masks, hs, ws in batches:
            out = []
            for m, h, w in zip(masks, hs, ws):
                p = outline(np.asarray(m, bool).reshape(h, w)) if m is not None else np.zeros((0, 2), int)
                out.append([{"x": int(a), "y": int(b)} for a, b in p] if len(p) else None)
            yield pd.Series(out)

    return find(mask, height, width)


def fill_contour(points: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Mask of a closed outline, border included (SRC-15): even-odd along each row, plus the outline itself."""
    h, w = shape
    mask = np.zeros(shape, bool)
    n = len(points)
    gx = np.arange(w)
    for y in range(h):
        inside = np.zeros(w, bool)
        for i in range(n):
            (xa, ya), (xb, yb) = points[i], points[(i + 1) % n]
            if ya != yb and min(ya, yb) <= y < max(ya, yb):
                inside ^= gx < xa + (xb - xa) * (y - ya) / (yb - ya)
        mask[y] = inside
    ok = (points[:, 0] >= 0) & (points[:, 0] < w) & (points[:, 1] >= 0) & (points[:, 1] < h)
    mask[points[ok, 1], points[ok, 0]] = True
    return mask


def masked_values(image: Column, mask: Column, background: Column | None = None) -> Column:
    """Values of the pixels that the mask keeps, less the background if there is one."""
    data = image.cast("array<double>")
    if background is not None:
        data = F.zip_with(data, background.cast("array<double>"), lambda a, b: a - b)
    pairs = F.zip_with(data, mask, lambda v, m: F.struct(v.alias("v"), m.alias("m")))
    return F.transform(F.filter(pairs, lambda p: p["m"]), lambda p: p["v"])


def array_mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, _total(a) / F.size(a)).otherwise(F.lit(NAN))


def array_sd(a: Column) -> Column:
    """Population standard deviation."""
    mean = array_mean(a)
    return F.when(F.size(a) > 0, F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(a))).otherwise(F.lit(NAN))


def array_percentile(a: Column, q: float) -> Column:
    """Linearly interpolated percentile of an array."""
    s = F.array_sort(a)
    place = F.lit(q) * (F.size(a) - 1)
    low = F.floor(place).cast("int")
    lower = F.element_at(s, low + 1)
    upper = F.element_at(s, F.least(low + 2, F.size(a)))
    return F.when(F.size(a) > 0, lower + (upper - lower) * (place - low)).otherwise(F.lit(NAN))


def brightness(image: Column, mask: Column, background: Column | None = None, offset: Column | float = 0.0) -> dict[str, Column]:
    """Mean (less the offset), population deviation and 10th and 90th percentiles (less the offset) of masked pixels."""
    v = masked_values(image, mask, background)
    off = offset if isinstance(offset, Column) else F.lit(float(offset))
    return {"avg": array_mean(v) - off, "sd": array_sd(v), "perc_10": array_percentile(v, 0.1) - off, "perc_90": array_percentile(v, 0.9) - off}


def split_trace(trace: Column, chunk: int) -> Column:
    """A long trace as equal pieces of `chunk` samples (SRC-16); a shorter rest is left out."""
    n = F.floor(F.size(trace) / chunk).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(trace, i * chunk + 1, chunk))).otherwise(F.array())
