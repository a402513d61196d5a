"""Queries of contours, images and traces; embeddings stand in for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.functions import geometry as G
from flowloom.plans.registry import query, table


def _contours(spark, sf_dir):
    """Star-shaped outlines of 32 points, radius 10 plus the embedding's values."""
    e = table(spark, sf_dir, "embeddings").withColumn("v", F.transform(F.slice("embedding", 1, 32), lambda x: F.round(x.cast("double"), 4)))
    turn = lambda f: F.transform("v", lambda r, i: F.round((r + 10) * f(i * 0.19634954084936207), 6))
    return e.select("vec_id", turn(F.cos).alias("x"), turn(F.sin).alias("y"))


_POINTS = "SELECT vec_id, i, round((round(embedding[i]::DOUBLE, 4) + 10) * cos((i - 1) * 0.19634954084936207), 6) AS x, round((round(embedding[i]::DOUBLE, 4) + 10) * sin((i - 1) * 0.19634954084936207), 6) AS y FROM embeddings, (SELECT unnest(range(1, 33)) AS i) t"
_EDGES = f"SELECT vec_id, i, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM ({_POINTS}) WINDOW w AS (PARTITION BY vec_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
_SUMS = f"SELECT vec_id, sum(c) / 2 AS m00, sum(c * (x + x2)) / 6 AS a10, sum(c * (y + y2)) / 6 AS a01, sum(c * (x * (x + x2) + x2 * x2)) / 12 AS a20, sum(c * (y * (y + y2) + y2 * y2)) / 12 AS a02, sum(c * (x * (2 * y + y2) + x2 * (y + 2 * y2))) / 24 AS a11 FROM (SELECT *, x * y2 - x2 * y AS c FROM ({_EDGES})) GROUP BY vec_id"
_MU = f"SELECT vec_id, m00, a10 / m00 AS cx, a01 / m00 AS cy, a20 - a10 * a10 / m00 AS mu20, a02 - a01 * a01 / m00 AS mu02, a11 - a10 * a01 / m00 AS mu11 FROM ({_SUMS})"


@query(f"SELECT vec_id, round(m00, 4) AS m00, round(cx, 5) AS cx, round(cy, 5) AS cy, round(mu20, 2) AS mu20, round(mu02, 2) AS mu02, round(mu11, 2) AS mu11 FROM ({_MU})")
def contour_moments(spark, sf_dir):
    digits = {"m00": 4, "cx": 5, "cy": 5, "mu20": 2, "mu02": 2, "mu11": 2}
    m = G.moments(F.col("x"), F.col("y"))
    return _contours(spark, sf_dir).select("vec_id", *[F.round(c, digits[k]).alias(k) for k, c in m.items()])


@query(f"SELECT vec_id, round(abs(0.5 * atan2(-2 * mu11, mu20 - mu02)), 5) AS tilt, round(sqrt(mu20 / mu02), 6) AS raw, round(sqrt(((mu20 + mu02) / 2 + sqrt(pow((mu20 - mu02) / 2, 2) + mu11 * mu11)) / ((mu20 + mu02) / 2 - sqrt(pow((mu20 - mu02) / 2, 2) + mu11 * mu11))), 6) AS principal FROM ({_MU})")
def tilt_and_inertia(spark, sf_dir):
    m = _contours(spark, sf_dir).select("vec_id", *[c.alias(k) for k, c in G.moments(F.col("x"), F.col("y")).items()])
    mu20, mu02, mu11 = F.col("mu20"), F.col("mu02"), F.col("mu11")
    return m.select("vec_id", F.round(G.tilt(mu20, mu02, mu11), 5).alias("tilt"), F.round(G.inert_ratio(mu20, mu02), 6).alias("raw"), F.round(G.principal_ratio(mu20, mu02, mu11), 6).alias("principal"))


def _half(sign: str) -> str:
    r, r2 = f"greatest({sign}y, 0)", f"greatest({sign}y2, 0)"
    return f"abs(sum((x2 - x) * ({r} * {r} + {r} * {r2} + {r2} * {r2})))"


@query(f"SELECT vec_id, round(({_half('')} + {_half('-')}) / 2 * pi() / 3 * pow(0.34, 3), 4) AS volume FROM ({_EDGES}) GROUP BY vec_id")
def volume_revolve(spark, sf_dir):
    v = G.volume(F.col("x"), F.col("y"), F.lit(0.0), F.lit(0.0), 0.34)
    return _contours(spark, sf_dir).select("vec_id", F.round(v, 4).alias("volume"))


_PIXELS = "SELECT vec_id, floor(abs(embedding[i]) * 1000) % 256 AS v, floor(abs(embedding[65 - i]) * 100) % 16 AS bg, i % 3 <> 0 AS m FROM embeddings, (SELECT unnest(range(1, 65)) AS i) t"


def _images(spark, sf_dir):
    pixel = lambda a, k, n: F.transform(a, lambda x: F.floor((F.abs(x) * k).cast("float")) % n)  # noqa: E731  # the SQL multiplies in single precision
    mask = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i % 3 != 0)
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", pixel(F.col("embedding"), 1000, 256).alias("image"), pixel(F.reverse("embedding"), 100, 16).alias("bg"), mask.alias("mask"))


@query(f"SELECT vec_id, round(avg(v), 4) AS bright_avg, round(stddev_pop(v), 4) AS bright_sd, round(avg(v - bg) - 1.5, 4) AS bright_bc_avg, round(stddev_pop(v - bg), 4) AS bright_bc_sd FROM ({_PIXELS}) WHERE m GROUP BY vec_id")
def masked_brightness(spark, sf_dir):
    x = _images(spark, sf_dir)
    plain = G.brightness(F.col("image"), F.col("mask"))
    less = G.brightness(F.col("image"), F.col("mask"), F.col("bg"), 1.5)
    return x.select("vec_id", F.round(plain["avg"], 4).alias("bright_avg"), F.round(plain["sd"], 4).alias("bright_sd"), F.round(less["avg"], 4).alias("bright_bc_avg"), F.round(less["sd"], 4).alias("bright_bc_sd"))


@query(f"SELECT vec_id, round(quantile_cont(v - bg, 0.1) - 1.5, 4) AS bright_perc_10, round(quantile_cont(v - bg, 0.9) - 1.5, 4) AS bright_perc_90 FROM ({_PIXELS}) WHERE m GROUP BY vec_id")
def masked_percentiles(spark, sf_dir):
    b = G.brightness(F.col("image"), F.col("mask"), F.col("bg"), 1.5)
    short = lambda k: F.round(b[k], 4).cast("float").alias(f"bright_{k}")  # noqa: E731  # as the SQL's
    return _images(spark, sf_dir).select("vec_id", short("perc_10"), short("perc_90"))


@query("SELECT vec_id, k::INTEGER AS piece, round(list_sum(list_transform(embedding[k * 10 + 1 : k * 10 + 10], lambda x: x::DOUBLE)), 5) AS total, len(embedding[k * 10 + 1 : k * 10 + 10])::INTEGER AS samples FROM embeddings, (SELECT unnest(range(6)) AS k) t")
def trace_split(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(G.split_trace(F.col("embedding"), 10)).alias("piece", "s"))
    return e.select("vec_id", "piece", F.round(F.aggregate(F.col("s").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.size("s").alias("samples"))


@query()
def contours_from_masks(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("mask", F.transform("embedding", lambda x: x > 0))
    found = e.select("vec_id", G.contour_of(F.col("mask"), F.lit(8), F.lit(8)).alias("contour"))
    xy = found.where("contour is not null").select("vec_id", F.col("contour.x").cast("array<double>").alias("x"), F.col("contour.y").cast("array<double>").alias("y"))
    hulls = xy.withColumn("hull", G.hull(F.col("x"), F.col("y")))
    m = G.moments(F.col("hull.x"), F.col("hull.y"))
    return hulls.select("vec_id", F.size("x").alias("points"), F.size("hull.x").alias("corners"), G.inert_ratio(m["mu20"], m["mu02"]).alias("inert_ratio_cvx"))
