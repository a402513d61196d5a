"""Exact Gaussian kernel densities at events or at any positions (KDE-06), without pairs of events.

In coordinates in which the kernel is round, the plane is cut into square cells of STEP bandwidths. An event is known to its
cell by its moments; a cell's moments are translated to polynomials in the cells around it, and each event evaluates the
polynomial of its own cell. How many moments and how many cells around are enough follows from the wanted error, see `orders`.
Work is dealt by tiles of TILE x TILE cells, which a kernel reaches across at most once in each direction. What travels to the tiles
around is the smaller of two forms: the events themselves, or the moments of the cells of a crowded tile, whose events are
dealt by stripes of cells, those of a crowded cell salted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.numeric import NAN, finite, scaled
from flowloom.operators.stats import doane_width

STEP = 1.0
TILE_BITS = 5
TILE = 1 << TILE_BITS
#: Stripes of a crowded tile for each ROWS events, so that uneven ones stay small.
STRIPES = 16
#: Events of one tile in one task, unless more than MAX_HOT tiles would need several: their numbers are sent to all tasks.
ROWS, MAX_HOT = 1 << 16, 1 << 18


@dataclass(frozen=True)
class Orders:
    """Moments 0 .. p - 1 in each direction, and cells that a kernel reaches to either side."""

    p: int
    reach: int


def orders(n: int, tol: float) -> Orders:
    """What brings each sum over n events within tol of the sum of the event's own kernel (1), so within tol of itself.

    In one direction the kernel is g(d + a - b) for offsets a and b, at most STEP / 2, from centres d apart. Its Taylor terms about d are
    He_k(d) g(d) t^k / k! with |t| <= STEP, and |He_k(d) g(d)| <= 1.0865 sqrt(k!) by Cramer's inequality, so what follows order p is
    below e = 1.0865 * sum over k >= p of STEP^k / sqrt(k!); a product of two directions is off by 2 e + e^2 at most. Cells more than
    `reach` apart hold events at least reach * STEP apart, whose kernel is below exp(-(reach * STEP)^2 / 2).
    Each event may be off by tol / n.
    """
    allowed = tol / max(n, 1)
    p = 1
    while True:
        first = 1.0865 * STEP**p / math.sqrt(math.factorial(p))
        e = first / (1 - STEP / math.sqrt(p + 1))  # the terms fall faster than this geometric series
        if 2 * e + e * e <= allowed:
            break
        p += 1
    return Orders(p, math.ceil(math.sqrt(max(0.0, -2 * math.log(allowed))) / STEP))


def _powers(t: np.ndarray, p: int) -> np.ndarray:
    """t^k / k! for k below p, a row for each t."""
    out = np.ones((len(t), p))
    for k in range(1, p):
        out[:, k] = out[:, k - 1] * t / k
    return out


def translation(o: Orders) -> np.ndarray:
    """Matrix from the moments of a line of cells, TILE and `reach` more on either side, to the polynomials of TILE cells:
    coefficient i of a cell is the sum over sources and j of (-1)^i He_(i+j)(d) g(d) times moment j, i + j < p."""
    width = TILE + 2 * o.reach
    out = np.zeros((TILE, o.p, width, o.p))
    for shift in range(-o.reach, o.reach + 1):
        d = shift * STEP
        he = [1.0, d]
        for k in range(1, o.p):
            he.append(d * he[k] - k * he[k - 1])
        t = np.array([[(-1) ** i * he[i + j] if i + j < o.p else 0.0 for j in range(o.p)] for i in range(o.p)]) * math.exp(-d * d / 2)
        for target in range(TILE):
            out[target, :, target + o.reach - shift, :] = t
    return out.reshape(TILE * o.p, width * o.p)


def _placed(points: DataFrame, white: np.ndarray, middle: tuple[float, float]) -> DataFrame:
    """points (x, y, ...) with round coordinates, from there the cell and the offset from its centre, in bandwidths."""
    dx, dy = F.col("x") - middle[0], F.col("y") - middle[1]
    round_ = points.withColumns({"_u": dx * float(white[0, 0]) + dy * float(white[0, 1]), "_v": dy * float(white[1, 1])})
    celled = round_.withColumns({"_cx": F.floor(F.col("_u") / STEP), "_cy": F.floor(F.col("_v") / STEP)})
    offsets = {"_a": F.col("_u") - (F.col("_cx") + 0.5) * STEP, "_b": F.col("_v") - (F.col("_cy") + 0.5) * STEP}
    return celled.withColumns(offsets | {"_tx": F.shiftright("_cx", TILE_BITS), "_ty": F.shiftright("_cy", TILE_BITS)}).drop("_u", "_v", "x", "y")


#: What a row that a tile gets stands for.
_EVENT, _MOMENTS, _ASKED, _BOTH = range(4)


def _parted(placed: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """placed without and with the events of crowded tiles; these with a stripe, and a piece within a crowded cell."""
    most = max(ROWS, -(-n // MAX_HOT))
    tile, cell = ["_tx", "_ty"], ["_tx", "_ty", "_cx", "_cy"]
    hot = F.broadcast(placed.groupBy(*tile).agg(F.count("*").alias("_n")).where(F.col("_n") > most))  # at most n / most <= MAX_HOT rows of three numbers
    within = placed.join(hot, tile)
    many = F.broadcast(within.groupBy(*cell).agg(F.count("*").alias("_c")).where(F.col("_c") > most))  # no more rows than crowded tiles
    place = F.col("_cx").bitwiseAND(TILE - 1) * TILE + F.col("_cy").bitwiseAND(TILE - 1)
    stripes = F.least(F.lit(TILE * TILE), STRIPES * F.ceil(F.col("_n") / most))
    pieces = F.coalesce(F.ceil(F.col("_c") / most), F.lit(1))
    dealt = within.join(many, cell, "left").withColumns({"_stripe": F.floor(place * stripes / (TILE * TILE)), "_pieces": pieces})
    return placed.join(hot, tile, "left_anti"), dealt.withColumn("_piece", F.pmod(F.xxhash64("_a", "_b", "_id"), F.col("_pieces"))).drop("_n", "_c")


def sums_at(sources: DataFrame, targets: DataFrame | None, white: np.ndarray, middle: tuple[float, float], n: int, tol: float = 1e-6) -> DataFrame:
    """Rows (_id, s): for each target (_id, x, y), the sum over the n sources (x, y) of exp(-|white (target - source)|^2 / 2).
    Without targets the sources are theirs, and each s is within tol of itself; elsewhere s is within tol, absolutely."""
    o = orders(n, tol)
    p, width = o.p, TILE + 2 * o.reach
    own = targets is None
    calm, hot = _parted(_placed(sources, white, middle), n)
    asked, asked_hot = (calm, hot) if own else _parted(_placed(targets, white, middle), targets.count())
    id_type = asked.schema["_id"].dataType.simpleString()
    matrix = translation(o).reshape(TILE, p, width, p)

    def summed(cells: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The first of the rows of each cell, by its number, and the cell's moments."""
        order = np.argsort(cells, kind="stable")
        a, b = _powers(a[order], p), _powers(b[order], p)
        first = np.flatnonzero(np.append(True, np.diff(cells[order]) != 0))
        for i, k in zip(first, np.append(first[1:], len(cells))):
            yield order[i], a[i:k].T @ b[i:k]

    def moments(table: pd.DataFrame) -> pd.DataFrame:
        cx, cy = table._cx.to_numpy(), table._cy.to_numpy()  # all of one tile
        rows = list(summed((cx & (TILE - 1)) * TILE + (cy & (TILE - 1)), table._a.to_numpy(), table._b.to_numpy()))
        at = [i for i, _ in rows]
        return pd.DataFrame({"_cx": cx[at], "_cy": cy[at], "_m": [m.tobytes() for _, m in rows]})

    def polynomials(table: pd.DataFrame, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Coefficients for each of a tile's cells (x, y), from all sources that the tile got."""
        kind = table._kind.to_numpy()
        from_ = kind != _ASKED
        out = np.zeros((len(x), p, p))
        if not from_.any() or not len(x):
            return out
        tx, ty = int(table._tx.iloc[0]), int(table._ty.iloc[0])
        sx, sy = (table[c].to_numpy() - t * TILE + o.reach for c, t in (("_cx", tx), ("_cy", ty)))
        x0, y0 = sx[from_].min(), sy[from_].min()
        m = np.zeros((sx[from_].max() - x0 + 1, p, sy[from_].max() - y0 + 1, p))
        plain = np.flatnonzero((kind == _EVENT) | (kind == _BOTH))
        if len(plain):
            for i, sums in summed(sx[plain] * width + sy[plain], table._a.to_numpy()[plain], table._b.to_numpy()[plain]):
                m[sx[plain[i]] - x0, :, sy[plain[i]] - y0, :] += sums
        for i in np.flatnonzero(kind == _MOMENTS):
            m[sx[i] - x0, :, sy[i] - y0, :] += np.frombuffer(table._m.iloc[i]).reshape(p, p)
        nx, ny = m.shape[0] * p, m.shape[2] * p
        ux, uy = np.unique(x), np.unique(y)
        left, right = matrix[ux][:, :, x0 : x0 + m.shape[0]].reshape(-1, nx), matrix[uy][:, :, y0 : y0 + m.shape[2]].reshape(-1, ny)
        every = (left @ m.reshape(nx, ny) @ right.T).reshape(len(ux), p, len(uy), p)
        return every[np.searchsorted(ux, x), :, np.searchsorted(uy, y), :]

    def evaluated(table: pd.DataFrame, cell: np.ndarray, cells: np.ndarray, c: np.ndarray) -> pd.DataFrame:
        """Each event's sum, from the polynomials c of the sorted cells."""
        order = np.argsort(cell, kind="stable")
        a, b = _powers(table._a.to_numpy()[order], p), _powers(table._b.to_numpy()[order], p)
        ends = np.searchsorted(cell[order], cells, side="right")
        s = np.zeros(len(table))
        for k, (i, j) in enumerate(zip(np.append(0, ends[:-1]), ends)):
            s[order[i:j]] = ((a[i:j] @ c[k]) * b[i:j]).sum(1)
        return pd.DataFrame({"_id": table._id, "s": s})

    def in_tile(table: pd.DataFrame) -> pd.DataFrame:
        """The sums at the events of a tile that isn't crowded."""
        these = table[table._kind >= _ASKED]
        cell = (these._cx.to_numpy() & (TILE - 1)) * TILE + (these._cy.to_numpy() & (TILE - 1))
        cells = np.unique(cell)
        return evaluated(these, cell, cells, polynomials(table, cells // TILE, cells % TILE))

    def for_cells(table: pd.DataFrame) -> pd.DataFrame:
        """The polynomials of the cells with events of a crowded tile."""
        these = table[table._kind == _ASKED]
        x, y = these._cx.to_numpy(), these._cy.to_numpy()
        c = polynomials(table, x & (TILE - 1), y & (TILE - 1))
        return pd.DataFrame({"_tx": these._tx, "_ty": these._ty, "_stripe": these._stripe, "_pieces": these._pieces, "_cell": (x & (TILE - 1)) * TILE + (y & (TILE - 1)), "_c": [k.tobytes() for k in c]})

    def at_events(table: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        """The sums at a part of the events of a crowded tile."""
        if not len(table):
            return pd.DataFrame({"_id": table._id, "s": np.zeros(0)})
        sent = sent.sort_values("_cell")
        cell = (table._cx.to_numpy() & (TILE - 1)) * TILE + (table._cy.to_numpy() & (TILE - 1))
        return evaluated(table, cell, sent._cell.to_numpy(), np.stack([np.frombuffer(c).reshape(p, p) for c in sent._c]))

    def rows(table: DataFrame, kind: Column, **more: Column) -> DataFrame:
        """table in the form in which all kinds go to tiles."""
        empty = {"_a": "double", "_b": "double", "_id": id_type, "_m": "binary", "_stripe": "long", "_pieces": "long"}
        return table.select("_tx", "_ty", kind.cast("byte").alias("_kind"), "_cx", "_cy", *[more.get(c, F.lit(None)).cast(t).alias(c) for c, t in empty.items()])

    def around(table: DataFrame) -> DataFrame:
        """A row for each tile that is near the cell."""
        for axis in ("x", "y"):
            near = F.sequence(F.shiftright(F.col(f"_c{axis}") - o.reach, TILE_BITS), F.shiftright(F.col(f"_c{axis}") + o.reach, TILE_BITS))
            table = table.withColumn(f"_t{axis}", F.explode(near))
        return table

    at, part = {"_a": F.col("_a"), "_b": F.col("_b")}, ["_tx", "_ty", "_stripe", "_piece"]
    parts = hot.select(*part, "_cx", "_cy", "_a", "_b").groupBy(*part).applyInPandas(moments, "_cx long, _cy long, _m binary")
    heavy = rows(around(parts), F.lit(_MOMENTS), _m=F.col("_m"))
    home = (F.shiftright("_cx", TILE_BITS) == F.col("_tx")) & (F.shiftright("_cy", TILE_BITS) == F.col("_ty"))
    if own:
        light = rows(around(calm), F.when(home, _BOTH).otherwise(_EVENT), _id=F.when(home, F.col("_id")), **at)
        near = light.unionByName(heavy)
        quiet = near
    else:
        near = rows(around(calm), F.lit(_EVENT), **at).unionByName(heavy)
        quiet = near.unionByName(rows(asked, F.lit(_ASKED), _id=F.col("_id"), **at))
    cells = rows(asked_hot.groupBy("_tx", "_ty", "_cx", "_cy", "_stripe", "_pieces").count(), F.lit(_ASKED), _stripe=F.col("_stripe"), _pieces=F.col("_pieces"))
    crowded = F.broadcast(asked_hot.select("_tx", "_ty").distinct())
    light_sums = quiet.join(crowded, ["_tx", "_ty"], "left_anti").groupBy("_tx", "_ty").applyInPandas(in_tile, f"_id {id_type}, s double")
    sent = near.join(crowded, ["_tx", "_ty"], "left_semi").unionByName(cells).groupBy("_tx", "_ty").applyInPandas(for_cells, "_tx long, _ty long, _stripe long, _pieces long, _cell long, _c binary")
    dealt = sent.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_pieces") - 1))).select(*part, "_cell", "_c")
    grouped = asked_hot.select(*part, "_cx", "_cy", "_a", "_b", "_id").groupBy(*part)
    return light_sums.unionByName(grouped.cogroup(dealt.groupBy(*part)).applyInPandas(at_events, f"_id {id_type}, s double"))


def kernel(points: DataFrame, kind: str, bandwidth: tuple[float, float] | None = None) -> tuple[np.ndarray | None, tuple[float, float], int, float]:
    """For points (x, y): the matrix that makes the kernel round (None if it is singular), the mean, the number of points and the
    factor from sums to densities. "gauss" has the full covariance by Scott's rule, "multivariate" a product of kernels with
    half of Doane's widths."""
    r = points.agg(F.count("*").alias("n"), F.avg("x"), F.avg("y"), F.var_samp("x"), F.covar_samp("x", "y"), F.var_samp("y"), doane_width("x"), doane_width("y")).first()
    middle = (r[1] or 0.0, r[2] or 0.0)
    if kind == "gauss":
        cov = np.array([[r[3] or 0.0, r[4] or 0.0], [r[4] or 0.0, r[5] or 0.0]]) * max(r.n, 1) ** (-1 / 3)
    elif kind == "multivariate":
        bx, by = bandwidth or ((r[6] or 0.0) / 2, (r[7] or 0.0) / 2)
        cov = np.diag([bx * bx, by * by])
    else:
        raise ValueError(f"no kernel for {kind!r}")
    det = float(np.linalg.det(cov))
    if not det > 0:
        return None, middle, r.n, NAN
    return np.linalg.cholesky(np.linalg.inv(cov)).T, middle, r.n, 1 / (r.n * 2 * math.pi * math.sqrt(det))


def density_exact(df: DataFrame, x: str, y: str, kind: str = "gauss", key: str = "event_idx", positions: DataFrame | None = None, bandwidth: tuple[float, float] | None = None, scale=("linear", "linear"), tol: float = 1e-6) -> DataFrame:
    """Rows (key, density): the density of df's events at each of them, or at each row (key, x, y) of `positions`. Densities at
    events are within `tol` of themselves, others within tol of one kernel's peak. Where a coordinate isn't finite, and everywhere if the
    covariance is singular, the density is NaN; without events it is NaN too. One row for each row, repeated keys included."""

    def coordinates(table: DataFrame) -> DataFrame:
        return table.select(F.col(key).alias("_id"), scaled(F.col(x), scale[0]).cast("double").alias("x"), scaled(F.col(y), scale[1]).cast("double").alias("y"))

    events = coordinates(df)
    good = finite("x") & finite("y")
    white, middle, n, norm = kernel(events.where(good), kind, bandwidth)
    asked = events if positions is None else coordinates(positions)
    name = F.col("_id").alias(key)
    if white is None:
        return asked.select(name, F.lit(NAN).alias("density"))
    sums = sums_at(events.where(good), None if positions is None else asked.where(good), white, middle, n, tol)
    bad = asked.where(~F.coalesce(good, F.lit(False))).select(name, F.lit(NAN).alias("density"))
    return sums.select(name, (F.col("s") * norm).alias("density")).unionByName(bad)
