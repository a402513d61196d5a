"""Densities on two features (AGG-09, AGG-12, JOIN-11, KDE-01 to KDE-11).

Events are reduced to histograms or to sums at the nodes of a grid where they lie; only the bounded grid is collected.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.numeric import NAN, finite, scaled
from flowloom.operators.stats import doane_bins, doane_width, exact_quantiles, percentile_widths

MAX_NODES = 250_000
#: Features that only grow; densities of two of them are refused.
MONOTONIC = {"frame", "index", "index_online", "time"}


def _both_finite(df: DataFrame, x: str, y: str, scale=("linear", "linear")) -> DataFrame:
    return df.select(scaled(F.col(x), scale[0]).cast("double").alias("x"), scaled(F.col(y), scale[1]).cast("double").alias("y")).where(finite("x") & finite("y"))


def check_features(x: str, y: str) -> None:
    if x == y or {x, y} <= MONOTONIC:
        raise ValueError(f"no density over {x} and {y}")


def histogram(df: DataFrame, x: str, y: str, bins: tuple[int, int], ranges: Sequence[float], scale=("linear", "linear")) -> DataFrame:
    """Counts (bx, by, n) on a regular grid over (x0, x1, y0, y1); the last bins are closed. Empty bins are left out."""
    x0, x1, y0, y1 = ranges

    def place(c: str, lo: float, hi: float, n: int) -> Column:
        if hi <= lo:
            return F.lit(0)
        return F.least(F.floor((F.col(c) - lo) / ((hi - lo) / n)), F.lit(n - 1)).cast("int")

    points = _both_finite(df, x, y, scale).where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    return points.groupBy(place("x", x0, x1, bins[0]).alias("bx"), place("y", y0, y1, bins[1]).alias("by")).agg(F.count("*").alias("n"))


def bounds(df: DataFrame, x: str, y: str, scale=("linear", "linear")) -> tuple[list[float], tuple[int, int]]:
    """Ranges of both features, and their numbers of bins, at least 5."""
    r = _both_finite(df, x, y, scale).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), doane_bins("x"), doane_bins("y")).first()
    return list(r[:4]), (max(5, r[4]), max(5, r[5]))


def cardinal_spline(knots: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Weights of the not-a-knot cubic spline through `knots`: row p gives the value at at[p] as a sum over knots.
    Outside, the ends hold."""
    n = len(knots)
    at = np.clip(at, knots[0], knots[-1])
    if n < 4:
        vander = np.vander(knots, n, increasing=True)
        return np.vander(at, n, increasing=True) @ np.linalg.inv(vander)
    h = np.diff(knots)
    a, b = np.zeros((n, n)), np.zeros((n, n))  # second derivatives m from values f: a m = b f
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i, i - 1 : i + 2] = 6 / h[i - 1], -6 / h[i - 1] - 6 / h[i], 6 / h[i]
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    m = np.linalg.solve(a, b)
    k = np.clip(np.searchsorted(knots, at, side="right") - 1, 0, n - 2)
    left, right, step = at - knots[k], knots[k + 1] - at, h[k]
    rows = np.arange(len(at))
    out = m[k] * ((right**3 / step - right * step) / 6)[:, None] + m[k + 1] * ((left**3 / step - left * step) / 6)[:, None]
    out[rows, k] += right / step
    out[rows, k + 1] += left / step
    return out


@dataclass
class Raster:
    """Density z at the nodes xs x ys."""

    xs: np.ndarray
    ys: np.ndarray
    z: np.ndarray

    def bilinear(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Values between nodes; NaN outside."""
        out = np.full(len(x), np.nan)
        ok = (x >= self.xs[0]) & (x <= self.xs[-1]) & (y >= self.ys[0]) & (y <= self.ys[-1])
        i = np.clip(np.searchsorted(self.xs, x[ok], side="right") - 1, 0, len(self.xs) - 2)
        j = np.clip(np.searchsorted(self.ys, y[ok], side="right") - 1, 0, len(self.ys) - 2)
        u = (x[ok] - self.xs[i]) / (self.xs[i + 1] - self.xs[i])
        v = (y[ok] - self.ys[j]) / (self.ys[j + 1] - self.ys[j])
        z = self.z
        out[ok] = z[i, j] * (1 - u) * (1 - v) + z[i + 1, j] * u * (1 - v) + z[i, j + 1] * (1 - u) * v + z[i + 1, j + 1] * u * v
        return out


def histogram_density(df: DataFrame, x: str, y: str, scale=("linear", "linear")):
    """Histogram density (KDE-01) as a function of positions: a bicubic spline through bin centres, not below 0."""
    (x0, x1, y0, y1), bins = bounds(df, x, y, scale)
    cells = histogram(df, x, y, bins, (x0, x1, y0, y1), scale).collect()
    z = np.zeros(bins)
    for r in cells:
        z[r.bx, r.by] = r.n
    wx, wy = (x1 - x0) / bins[0] or 1.0, (y1 - y0) / bins[1] or 1.0
    z /= max(z.sum(), 1) * wx * wy
    cx, cy = x0 + wx * (np.arange(bins[0]) + 0.5), y0 + wy * (np.arange(bins[1]) + 0.5)

    def at(px: np.ndarray, py: np.ndarray) -> np.ndarray:
        return np.maximum(0, np.einsum("pi,ij,pj->p", cardinal_spline(cx, px), z, cardinal_spline(cy, py)))

    return at


def node_sums(df: DataFrame, x: str, y: str, xs: np.ndarray, ys: np.ndarray, inverse: np.ndarray, norm: float, scale=("linear", "linear")) -> DataFrame:
    """Gaussian kernel sums (ix, iy, density) at the nodes: each task adds up its events, then the tasks' sums are added.
    `inverse` is the inverse covariance of the kernel; norm multiplies the sums."""
    if len(xs) * len(ys) > MAX_NODES:
        raise ValueError(f"at most {MAX_NODES} nodes")
    gx, gy = (g.ravel() for g in np.meshgrid(xs, ys, indexing="ij"))
    (a, b), (_, d) = inverse

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(gx))
        step = max(1, 4_000_000 // len(gx))
        for batch in batches:
            px, py = (batch.column(k).to_numpy() for k in (0, 1))
            for lo in range(0, len(px), step):
                dx, dy = gx[None] - px[lo : lo + step, None], gy[None] - py[lo : lo + step, None]
                total += np.exp(-0.5 * (a * dx * dx + 2 * b * dx * dy + d * dy * dy)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(gx)) // len(ys), pa.int32()), pa.array(np.arange(len(gx)) % len(ys), pa.int32()), pa.array(total)], ["ix", "iy", "s"])

    parts = _both_finite(df, x, y, scale).mapInArrow(run, "ix int, iy int, s double")
    return parts.groupBy("ix", "iy").agg((F.sum("s") * norm).alias("density"))


def gauss(df: DataFrame, x: str, y: str, xs: np.ndarray, ys: np.ndarray, scale=("linear", "linear")) -> DataFrame:
    """Gaussian density with full covariance and Scott's bandwidth (KDE-02); NaN if the covariance is singular."""
    p = _both_finite(df, x, y, scale)
    r = p.agg(F.count("*").alias("n"), F.var_samp("x"), F.covar_samp("x", "y"), F.var_samp("y")).first()
    cov = np.array([[r[1] or 0.0, r[2] or 0.0], [r[2] or 0.0, r[3] or 0.0]]) * max(r.n, 1) ** (-1 / 3)
    det = float(np.linalg.det(cov))
    if det <= 0:
        return node_sums(df, x, y, xs, ys, np.eye(2), NAN, scale)
    return node_sums(df, x, y, xs, ys, np.linalg.inv(cov), 1 / (r.n * 2 * math.pi * math.sqrt(det)), scale)


def multivariate(df: DataFrame, x: str, y: str, xs: np.ndarray, ys: np.ndarray, bandwidth: tuple[float, float] | None = None, scale=("linear", "linear")) -> DataFrame:
    """Product of Gaussian kernels with half of Doane's widths (KDE-03)."""
    p = _both_finite(df, x, y, scale)
    r = p.agg(F.count("*").alias("n"), doane_width("x"), doane_width("y")).first()
    bx, by = bandwidth or (r[1] / 2, r[2] / 2)
    return node_sums(df, x, y, xs, ys, np.diag([1 / bx**2, 1 / by**2]), 1 / (r.n * 2 * math.pi * bx * by), scale)


def raster(df: DataFrame, x: str, y: str, kind: str = "histogram", accuracy: tuple[float | None, float | None] = (None, None), scale=("linear", "linear")) -> Raster:
    """Density on a regular grid over the events' ranges (KDE-05); without events, 2 x 2 nodes of NaN."""
    check_features(x, y)
    p = _both_finite(df, x, y, scale)
    r = p.agg(F.count("*").alias("n"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if not r.n:
        return Raster(np.array([0.0, 1.0]), np.array([0.0, 1.0]), np.full((2, 2), np.nan))
    ax, ay = accuracy if all(accuracy) else (a or w for a, w in zip(accuracy, percentile_widths(p, ["x", "y"])))
    xs = np.linspace(r[1], r[2], max(2, math.ceil((r[2] - r[1]) / ax)))
    ys = np.linspace(r[3], r[4], max(2, math.ceil((r[4] - r[3]) / ay)))
    if len(xs) * len(ys) > MAX_NODES:
        raise ValueError(f"a raster of {len(xs)} x {len(ys)} nodes is too large; take a coarser accuracy")
    if kind == "none":
        return Raster(xs, ys, np.ones((len(xs), len(ys))))
    if kind == "histogram":
        at = histogram_density(df, x, y, scale)
        gx, gy = np.meshgrid(xs, ys, indexing="ij")
        return Raster(xs, ys, at(gx.ravel(), gy.ravel()).reshape(gx.shape))
    z = np.zeros((len(xs), len(ys)))
    for row in {"gauss": gauss, "multivariate": multivariate}[kind](df, x, y, xs, ys, scale=scale).collect():
        z[row.ix, row.iy] = row.density
    return Raster(xs, ys, z)


def raster_nodes(df: DataFrame, x: str, y: str, accuracy: tuple[float, float], scale=("linear", "linear")) -> DataFrame:
    """Rows (ix, iy, x, y), the nodes of a raster of given accuracy over the events' ranges: any number of them, made in tasks.
    Without events, 2 x 2 nodes without a place."""
    check_features(x, y)
    r = _both_finite(df, x, y, scale).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    nx, ny = (2 if lo is None else max(2, math.ceil((hi - lo) / a)) for lo, hi, a in ((r[0], r[1], accuracy[0]), (r[2], r[3], accuracy[1])))

    def place(lo: float | None, hi: float | None, i: str, n: int) -> Column:
        return F.lit(None).cast("double") if lo is None else F.lit(lo) + F.lit(hi - lo) * F.col(i) / (n - 1)

    cells = df.sparkSession.range(nx * ny).select(F.expr(f"cast(id div {ny} as int)").alias("ix"), (F.col("id") % ny).cast("int").alias("iy"))
    return cells.select("ix", "iy", place(r[0], r[1], "ix", nx).alias("x"), place(r[2], r[3], "iy", ny).alias("y"))


def density_at_events(df: DataFrame, x: str, y: str, r: Raster, name: str = "density", outside: float = NAN, scale=("linear", "linear")) -> DataFrame:
    """df with the raster's density at each event (KDE-06, KDE-07)."""

    @F.pandas_udf("double")
    def look_up(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            v = r.bilinear(a.to_numpy(float), b.to_numpy(float))
            yield pd.Series(v)

    value = look_up(scaled(F.col(x), scale[0]).cast("double"), scaled(F.col(y), scale[1]).cast("double"))
    return df.withColumn(name, F.coalesce(value, F.lit(outside)))  # pandas batches give NaN as null


def quantile_levels(df: DataFrame, x: str, y: str, r: Raster, qs: Sequence[float], scale=("linear", "linear")) -> list[float]:
    """Densities below which a share q of the events lies (AGG-12); events outside the raster count as 0."""
    seen = density_at_events(df, x, y, r, outside=0.0, scale=scale).where(finite(x) & finite(y))
    return exact_quantiles(seen, "density", qs)


def contours(r: Raster, level: float, closed: bool = True) -> list[np.ndarray]:
    """Lines where the raster crosses `level` times its maximum (KDE-09): marching squares, saddles by the cell's mean,
    pieces joined end to end. With closed, lines that leave the grid are closed along its border."""
    if not 0 < level < 1:
        raise ValueError("the level must lie between 0 and 1")
    z, xs, ys = r.z, r.xs, r.ys
    if closed:
        z = np.pad(z, 1)
        xs = np.concatenate([xs[:1], xs, xs[-1:]])
        ys = np.concatenate([ys[:1], ys, ys[-1:]])
    return [np.column_stack([np.interp(c[:, 0], np.arange(len(xs)), xs), np.interp(c[:, 1], np.arange(len(ys)), ys)]) for c in iso_lines(z, level * np.nanmax(z))]


def iso_lines(z: np.ndarray, level: float) -> list[np.ndarray]:
    """Iso-lines in index coordinates."""
    up = z > level
    links: dict[tuple, list[tuple]] = {}

    def cross(a: tuple[int, int], b: tuple[int, int]) -> tuple:
        return (min(a, b), max(a, b))

    for i, j in zip(*np.nonzero((up[:-1, :-1] != up[1:, :-1]) | (up[:-1, :-1] != up[:-1, 1:]) | (up[:-1, :-1] != up[1:, 1:]))):
        ring = [(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1)]
        cut = [cross(ring[k], ring[(k + 1) % 4]) for k in range(4) if up[ring[k]] != up[ring[(k + 1) % 4]]]
        if len(cut) == 4:  # a saddle: the mean tells which corners are joined
            high = np.mean([z[c] for c in ring]) > level
            pairs = [(cut[0], cut[1]), (cut[2], cut[3])] if up[ring[0]] == high else [(cut[3], cut[0]), (cut[1], cut[2])]
        else:
            pairs = [(cut[0], cut[1])]
        for a, b in pairs:
            links.setdefault(a, []).append(b)
            links.setdefault(b, []).append(a)

    def point(e: tuple) -> tuple[float, float]:
        (i, j), (k, m) = e
        t = (level - z[i, j]) / (z[k, m] - z[i, j])
        return (i + t * (k - i), j + t * (m - j))

    lines, used = [], set()
    for start in sorted(links, key=lambda e: (len(links[e]) != 1, e)):
        if start in used:
            continue
        path = [start]
        used.add(start)
        while nxt := [e for e in links[path[-1]] if e not in used]:
            path.append(nxt[0])
            used.add(nxt[0])
        if len(path) > 2 and start in links[path[-1]]:
            path.append(start)
        lines.append(np.array([point(e) for e in path]))
    return lines


def contour_lines(df: DataFrame, x: str, y: str, quantiles: Sequence[float], kind: str = "histogram", accuracy=(None, None), scale=("linear", "linear")) -> list[list[np.ndarray]]:
    """Lines around the densest 1 - q of the events, for each q (KDE-08)."""
    r = raster(df, x, y, kind, accuracy, scale)
    if min(r.z.shape) < 3 or not np.isfinite(r.z).any():
        return [[] for _ in quantiles]
    top = np.nanmax(r.z)
    return [contours(r, lv / top) if 0 < lv < top else [] for lv in quantile_levels(df, x, y, r, quantiles, scale)]


def opening_angles(line: np.ndarray) -> np.ndarray:
    """By how many degrees a closed line turns at each vertex (WIN-08)."""
    p = line[:-1] if len(line) > 1 and np.allclose(line[0], line[-1]) else line
    step = np.roll(p, -1, 0) - p
    heading = np.arctan2(step[:, 1], step[:, 0])
    turn = (heading - np.roll(heading, 1) + np.pi) % (2 * np.pi) - np.pi
    return np.degrees(np.abs(turn))


def smooth_spacing(df: DataFrame, x: str, y: str, quantile: float, max_angle: float = 23.0, max_vertices: int = 100, tries: int = 15, scale=("linear", "linear")) -> tuple[float, float]:
    """Grid spacing fine enough for smooth contours (KDE-10): halved until lines turn little or have many vertices. If the next
    raster would have more than MAX_NODES nodes, the finest possible spacing is given with a warning.

    The events are read for their ranges and their histogram once; each try then only places them on its raster."""
    p = _both_finite(df, x, y, scale)
    r = p.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if r.x0 is None:
        raise ValueError("there are no events with finite coordinates")
    ax, ay = percentile_widths(p, ["x", "y"])
    at = histogram_density(df, x, y, scale)
    for _ in range(tries):
        nx, ny = max(2, math.ceil((r.x1 - r.x0) / ax)), max(2, math.ceil((r.y1 - r.y0) / ay))
        if nx * ny > MAX_NODES:
            warnings.warn(f"contours aren't smooth at the finest spacing, of {MAX_NODES} nodes", SpacingWarning, stacklevel=2)
            return 2 * ax, 2 * ay
        lines = _lines_at(p, at, np.linspace(r.x0, r.x1, nx), np.linspace(r.y0, r.y1, ny), quantile)
        if lines:
            longest = max(lines, key=len)
            span = np.ptp(longest, axis=0)
            if len(longest) > max_vertices or opening_angles(longest / np.where(span > 0, span, 1)).max() < max_angle:
                break
        ax, ay = ax / 2, ay / 2
    return ax, ay


class SpacingWarning(UserWarning):
    """A contour is coarser than was asked for."""


def _lines_at(p: DataFrame, at, xs: np.ndarray, ys: np.ndarray, quantile: float) -> list[np.ndarray]:
    """Lines around the densest 1 - quantile of the events (x, y) on one raster."""
    gx, gy = np.meshgrid(xs, ys, indexing="ij")
    r = Raster(xs, ys, at(gx.ravel(), gy.ravel()).reshape(gx.shape))
    if min(r.z.shape) < 3:
        return []
    level, top = quantile_levels(p, "x", "y", r, [quantile])[0], np.nanmax(r.z)
    return contours(r, level / top) if 0 < level < top else []
