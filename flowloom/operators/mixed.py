"""Mixed-effects comparison of repeated experiments (AGG-13 to AGG-15, JOIN-13).

The model is x ~ group + (1 + group | repetition), linear or with Gamma errors and a log link. Count, sum, and sum of squares or
of logarithms of each group and repetition are all that its likelihood needs: Spark makes these sums, and a few numbers are
fitted on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions.numeric import finite
from flowloom.operators import ranks
from flowloom.sources.scratch import settled


def sufficient_sums(df: DataFrame, feature: str, groups: tuple[str, str] = ("group", "repetition")) -> DataFrame:
    """(group, repetition, n, sum_x, sum_x2) over finite values."""
    x = F.col(feature).cast("double")
    return df.where(finite(feature)).groupBy(*groups).agg(F.count("*").alias("n"), F.sum(x).alias("sum_x"), F.sum(x * x).alias("sum_x2"))


def minimise(f: Callable[[np.ndarray], float], start: np.ndarray, step: float = 0.5, rounds: int = 2000) -> tuple[np.ndarray, float]:
    """Nelder and Mead's simplex search."""
    n = len(start)
    points = [np.array(start, float)] + [np.array(start, float) + step * np.eye(n)[i] for i in range(n)]
    values = [f(p) for p in points]
    for _ in range(rounds):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) < 1e-12 * (1 + abs(values[0])):
            break
        centre = np.mean(points[:-1], axis=0)
        reflected = centre + (centre - points[-1])
        fr = f(reflected)
        if fr < values[0]:
            far = centre + 2 * (centre - points[-1])
            ff = f(far)
            points[-1], values[-1] = (far, ff) if ff < fr else (reflected, fr)
        elif fr < values[-2]:
            points[-1], values[-1] = reflected, fr
        else:
            near = centre + 0.5 * (points[-1] - centre)
            fn = f(near)
            if fn < values[-1]:
                points[-1], values[-1] = near, fn
            else:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    best = int(np.argmin(values))
    return points[best], values[best]


class _Likelihood:
    """Profiled likelihood of the model over sums; cells: rows (is treatment, n, sum, sum of squares) per repetition."""

    def __init__(self, cells: list[list[tuple[float, float, float, float]]], slope: bool):
        self.cells, self.slope = cells, slope
        self.n = sum(c[1] for rep in cells for c in rep)

    def __call__(self, theta: np.ndarray, restricted: bool) -> tuple[float, np.ndarray, float]:
        """Deviance, fixed effects, residual variance for a relative Cholesky factor of the random effects."""
        lam = np.array([[theta[0], 0.0], [theta[1], theta[2]]])
        p = 2 if self.slope else 1
        xtx, xty, yty, log = np.zeros((p, p)), np.zeros(p), 0.0, 0.0
        for rep in self.cells:
            ztz, zty, zx = np.zeros((2, 2)), np.zeros(2), np.zeros((2, p))
            for t, n, s, ss in rep:
                z = np.array([1.0, t])
                x = z[:p] if self.slope else z[:1]
                ztz += n * np.outer(z, z)
                zty += s * z
                zx += n * np.outer(z, x)
                xtx += n * np.outer(x, x)
                xty += s * x
                yty += ss
            m = lam.T @ ztz @ lam + np.eye(2)
            inner = lam @ np.linalg.solve(m, lam.T)
            log += math.log(np.linalg.det(m))
            xtx -= zx.T @ inner @ zx
            xty -= zx.T @ inner @ zty
            yty -= zty @ inner @ zty
        beta = np.linalg.solve(xtx, xty)
        rss = max(yty - xty @ beta, 1e-300)
        free = self.n - p if restricted else self.n
        dev = log + free * (1 + math.log(2 * math.pi * rss / free))
        if restricted:
            dev += math.log(np.linalg.det(xtx))
        return dev, beta, rss / free


def _fit(cells, slope: bool, restricted: bool) -> tuple[float, np.ndarray, float, np.ndarray]:
    like = _Likelihood(cells, slope)
    best = None
    for start in ([1.0, 0.0, 1.0], [0.1, 0.0, 0.1], [0.0, 0.0, 0.0], [3.0, -1.0, 0.5]):
        theta, _ = minimise(lambda t: like(t, restricted)[0], np.array(start))
        out = like(theta, restricted)
        if best is None or out[0] < best[0]:
            best = (*out, theta)
    return best


class _GammaLikelihood:
    """Laplace approximation of the log-link Gamma model's deviance; cells: rows (is treatment, n, sum, sum of logarithms) per
    repetition. With a log link the working weights are 1, so each repetition's random effects are found by Gauss-Newton
    steps on its own two unknowns, and the mean is one number a cell. The dispersion is the deviance per event."""

    def __init__(self, cells: list[list[tuple[float, float, float, float]]], slope: bool):
        self.cells = [np.array(rep, float).T for rep in cells]
        self.slope = slope
        self.n = sum(c[1].sum() for c in self.cells)

    def modes(self, lam: np.ndarray, beta: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float, float]]:
        """Of each repetition: random effects u, means of its cells, its deviance and the log determinant of the curvature."""
        out = []
        for t, n, s, logs in self.cells:
            z = np.column_stack([np.ones(len(t)), t]) @ lam
            fixed = beta[0] + beta[1] * t if self.slope else np.full(len(t), beta[0])
            curvature = z.T @ (n[:, None] * z) + np.eye(2)

            def deviance(u: np.ndarray) -> float:
                eta = np.clip(fixed + z @ u, -700, 700)
                return float(2 * (s * np.exp(-eta) - n - logs + n * eta).sum())

            u = np.zeros(2)
            now = deviance(u)
            for _ in range(100):
                step = np.linalg.solve(curvature, z.T @ (s * np.exp(-np.clip(fixed + z @ u, -700, 700)) - n) - u)
                size = 1.0
                while size > 1e-8 and deviance(u + size * step) + ((u + size * step) ** 2).sum() > now + (u**2).sum() + 1e-12 * abs(now):
                    size /= 2
                u = u + size * step
                now = deviance(u)
                if np.abs(size * step).max() < 1e-11:
                    break
            out.append((u, np.exp(np.clip(fixed + z @ u, -700, 700)), now, float(np.linalg.slogdet(curvature)[1])))
        return out

    def __call__(self, point: np.ndarray) -> float:
        found = self.modes(np.array([[point[0], 0.0], [point[1], point[2]]]), point[3:])
        spread = max(sum(f[2] for f in found) / self.n, 1e-300)
        shape, log = 1 / spread, 0.0
        for (_, n, s, logs), (_, mu, _, _) in zip(self.cells, found):
            scale = mu * spread
            log += float(((shape - 1) * logs - s / scale - n * shape * np.log(scale) - n * math.lgamma(shape)).sum())
        return -2 * log + sum(f[3] + f[0] @ f[0] for f in found)


def _fit_gamma(cells, slope: bool) -> tuple[float, np.ndarray, bool]:
    """Least deviance, where it is reached (three numbers of the random effects' factor, then fixed effects), and whether a new
    search from there stays there."""
    like = _GammaLikelihood(cells, slope)
    means = [math.log(sum(c[2] for rep in cells for c in rep if c[0] == g) / sum(c[1] for rep in cells for c in rep if c[0] == g)) for g in (0.0, 1.0)]
    start = [means[0], means[1] - means[0]] if slope else [sum(means) / 2]
    tries = [minimise(like, np.array([*theta, *start]), 0.3) for theta in ([1.0, 0.0, 1.0], [0.3, 0.0, 0.3], [2.0, -1.0, 0.5], [0.1, 0.0, 0.1])]
    point, value = min(tries, key=lambda r: r[1])
    for _ in range(20):
        again, less = minimise(like, point, 0.05)
        settled_ = value - less < 1e-9 * (1 + abs(value))
        point, value = (again, less) if less < value else (point, value)
        if settled_:
            break
    return value, point, settled_


def _linear_effects(cells, theta: np.ndarray, beta: np.ndarray) -> list[np.ndarray]:
    """Random effects (intercept, treatment) of each repetition of the linear model, given its factor."""
    lam = np.array([[theta[0], 0.0], [theta[1], theta[2]]])
    out = []
    for rep in cells:
        ztz, ztr = np.zeros((2, 2)), np.zeros(2)
        for t, n, s, _ in rep:
            z = np.array([1.0, t])
            ztz += n * np.outer(z, z)
            ztr += (s - n * (beta[0] + beta[1] * t)) * z
        out.append(lam @ np.linalg.solve(lam.T @ ztz @ lam + np.eye(2), lam.T @ ztr))
    return out


#: Models of `compare`.
MODELS = ("lmer", "glmer+loglink")


def compare(df: DataFrame, feature: str, treatment: str = "treatment", model: str = "lmer") -> dict:
    """Fixed effects, those of each repetition, and the p-value of a likelihood ratio test against the model without treatment.

    "lmer" has normal errors (effects by restricted likelihood), "glmer+loglink" Gamma errors and a log link, by Laplace's
    approximation; its effects are told on the feature's own scale, and values that aren't positive are an error.
    """
    if model not in MODELS:
        raise ValueError(f"the model must be one of {MODELS}")
    x = F.col(feature).cast("double")
    gamma = model == "glmer+loglink"
    if gamma:
        rows = df.where(finite(feature)).groupBy("group", "repetition").agg(F.count("*").alias("n"), F.sum(x).alias("sum_x"), F.sum(F.ln(F.when(x > 0, x))).alias("other"), F.min(x).alias("least")).collect()
        if any(r.least <= 0 for r in rows):
            raise ValueError("the Gamma model needs positive values")
        middle = 0.0
    else:
        middle = df.where(finite(feature)).agg(F.avg(x)).first()[0] or 0.0  # sums of squares around it, or the residual would cancel
        rows = sufficient_sums(df.withColumn(feature, x - middle), feature).withColumnRenamed("sum_x2", "other").collect()
    if len({r.group for r in rows}) != 2:
        raise ValueError("two groups are needed")
    reps = sorted({r.repetition for r in rows})
    cells = [[(float(r.group == treatment), float(r.n), r.sum_x, r.other) for r in rows if r.repetition == k] for k in reps]
    if gamma:
        (full, point, ok), (null, _, ok_null) = _fit_gamma(cells, True), _fit_gamma(cells, False)
        beta, lam = point[3:], np.array([[point[0], 0.0], [point[1], point[2]]])
        effects = [beta + lam @ m[0] for m in _GammaLikelihood(cells, True).modes(lam, beta)]
        own = lambda b: (math.exp(b[0]), math.exp(b[0] + b[1]) - math.exp(b[0]))
        out = {"intercept": own(beta)[0], "treatment": own(beta)[1], "converged": ok and ok_null}
        by_rep = {k: own(b) for k, b in zip(reps, effects)}
    else:
        (full, _, _), (null, _, _) = _fit(cells, True, False)[:3], _fit(cells, False, False)[:3]
        _, beta, variance, theta = _fit(cells, True, True)
        out = {"intercept": beta[0] + middle, "treatment": beta[1], "variance": variance, "converged": True}
        by_rep = {k: (beta[0] + middle + u[0], beta[1] + u[1]) for k, u in zip(reps, _linear_effects(cells, theta, beta))}
    chi = max(0.0, null - full)
    return out | {"chi_square": chi, "p_value": math.erfc(math.sqrt(chi / 2)), "repetitions": by_rep, "model": model}


def design(datasets: list[tuple[DataFrame, str, int, str]], feature: str) -> DataFrame:
    """Rows (group, repetition, region, feature) of measurements (events, group, repetition, region) for `compare` (JOIN-13). Groups are
    "control" and "treatment", regions "channel" and "reservoir"; no two measurements may share all three."""
    seen = set()
    parts = []
    for df, group, repetition, region in datasets:
        if group not in ("control", "treatment") or region not in ("channel", "reservoir"):
            raise ValueError(f"unknown group or region: {group!r}, {region!r}")
        if (group, repetition, region) in seen:
            raise ValueError(f"{group}, repetition {repetition}, {region} occurs twice")
        seen.add((group, repetition, region))
        parts.append(df.select(F.lit(group).alias("group"), F.lit(repetition).alias("repetition"), F.lit(region).alias("region"), F.col(feature).cast("double").alias(feature)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fit(df: DataFrame, feature: str, model: str = "lmer", iterations: int = 1000, seed: int = 117) -> dict:
    """`compare` of a design; if it has reservoir events, of the differential feature (AGG-14), channel less reservoir."""
    differs = not df.where("region = 'reservoir'").isEmpty()
    if not differs:
        return compare(df, feature, model=model) | {"differential": False}
    drawn = settled(differential(df, feature, iterations, seed))
    return compare(drawn.withColumnRenamed("x", feature), feature, model=model) | {"differential": True}


def bootstrapped_medians(a: np.ndarray, b: np.ndarray, iterations: int = 1000, seed: int = 117) -> tuple[np.ndarray, np.ndarray]:
    """Medians of resampled a and b, drawn in turn from one seeded generator."""
    rng = np.random.RandomState(seed)
    out = np.empty((iterations, 2))
    for k in range(iterations):
        for j, x in enumerate((a, b)):
            out[k, j] = np.median(x[rng.randint(0, len(x), len(x))])
    return out[:, 0], out[:, 1]


def median_draws(df: DataFrame, feature: str, keys: list[str], iterations: int = 1000, seed: int = 117) -> DataFrame:
    """Rows (keys, draw, median): medians of as many values as a group has, drawn from it with replacement, `iterations` times for
    each group, without drawing the values or gathering a group.

    The k-th smallest of n draws is the value at rank floor(n U) for U from Beta(k, n - k + 1); for even n the next one's U is that of the
    least of n - k uniform numbers above. So each draw is one or two ranks, and only values at these are looked up, for all groups at
    once. Draws depend on the seed, the group's keys and their number, and are spread over tasks. Values that aren't finite are left out.
    """
    values = df.where(finite(feature)).select(*keys, F.col(feature).cast("double").alias("x"))
    sizes = settled(values.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("rows")))
    mark = F.xxhash64(F.lit(seed), *keys)
    asked = sizes.select(*keys, "rows", mark.alias("_mark"), F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("draw")).repartition(*keys, F.floor(F.col("draw") / 256))

    @F.pandas_udf("struct<a: bigint, b: bigint>")
    def places(n: pd.Series, mark: pd.Series, draw: pd.Series) -> pd.DataFrame:
        out = np.empty((len(n), 2), np.int64)
        for i, (m, h, d) in enumerate(zip(n.tolist(), mark.tolist(), draw.tolist())):
            rng = np.random.default_rng([h & 0xFFFFFFFFFFFFFFFF, d])
            k = (m + 1) // 2
            u = rng.beta(k, m - k + 1)
            v = u if m % 2 else 1 - (1 - u) * rng.random() ** (1 / (m - k))
            out[i] = min(m - 1, int(m * u)), min(m - 1, int(m * v))
        return pd.DataFrame(out, columns=["a", "b"])

    drawn = settled(asked.withColumn("_p", places("rows", "_mark", "draw")).select(*keys, "draw", "_p.a", "_p.b"))
    each = drawn.select(*keys, F.explode(F.array("a", "b")).alias("rank")).distinct()
    wanted = ranks.meet(sizes, each.groupBy(*keys).agg(F.collect_list("rank").alias("ranks")), keys)
    found = settled(ranks.select_ranks(values, keys, wanted))
    at = lambda name, to: found.select(*keys, F.col("rank").alias(name), F.col("x").alias(to))
    both = ranks.meet(ranks.meet(drawn, at("a", "_x"), [*keys, "a"]), at("b", "_y"), [*keys, "b"])
    return both.select(*keys, "draw", ((F.col("_x") + F.col("_y")) / 2).alias("median"))


def differential(df: DataFrame, feature: str, iterations: int = 1000, seed: int = 117) -> DataFrame:
    """Bootstrapped channel medians less reservoir medians (AGG-14) of each group and repetition that has both:
    rows (group, repetition, draw, x). Draws have the distribution of resampled medians, see median_draws; those of a
    particular legacy generator, for arrays that fit one process, come from bootstrapped_medians."""
    drawn = settled(median_draws(df, feature, ["group", "repetition", "region"], iterations, seed))

    def of(region: str, name: str) -> DataFrame:
        return drawn.where(F.col("region") == region).select("group", "repetition", "draw", F.col("median").alias(name))

    both = ranks.meet(of("channel", "_channel"), of("reservoir", "_reservoir"), ["group", "repetition", "draw"])
    return both.select("group", "repetition", "draw", (F.col("_channel") - F.col("_reservoir")).alias("x"))
