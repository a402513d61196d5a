"""Contours from text files (SRC-14): blocks "Contour in frame <frame>" followed by points "(x, y)".

Spark cuts the files at that mark, so a large file is parsed in many tasks; a contour's place in its file is told by the
places of the pieces. Contours are matched with events by frame, then by geometry, else by place alone.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.functions.geometry import moments
from flowloom.operators.basins import frame_match
from flowloom.sources.scratch import settled

MARK = "Contour in frame"
#: How far a contour may be from an event: of its size and area, and of its place, in pixels.
SIZE_OFF, PLACE_OFF = 1e-5, 6.0


class ContourOffsetError(ValueError):
    """The first contour belongs neither to the first event nor to the second."""


def find_contour_file(names: Sequence[str], stem: str) -> str | None:
    """Of file names, the contour file of a measurement called `stem`: one that begins with it, else one whose first
    part, up to an underscore, is the stem's."""
    files = sorted(n for n in names if n.endswith("_contours.txt"))
    exact = [n for n in files if n.startswith(stem)]
    return next(iter(exact or [n for n in files if n.split("_")[0] == stem.split("_")[0]]), None)


def read_contours(spark: SparkSession, path: str) -> DataFrame:
    """Rows (place, contour_frame, x, y) of a file or, in the order of their names, of a folder's files: 0-based place and
    arrays of coordinates. A block without a frame or with an odd number of coordinates has a null frame."""
    raw = spark.read.option("lineSep", MARK).text(path).select("value", F.struct("_metadata.file_path", "_metadata.file_block_start").alias("_piece"), F.monotonically_increasing_id().alias("_id"))
    raw = settled(raw)
    pieces = raw.groupBy("_piece").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    # what comes before a file's first mark is no contour; one row for each piece that a task reads
    head = (F.col("_piece.file_block_start") == 0).cast("int")
    before = F.coalesce(F.sum(F.col("_n") - head).over(Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = pieces.select("_piece", "_first", before.alias("_before"), head.alias("_head"))
    placed = raw.join(at, "_piece").withColumn("place", F.col("_before") + F.col("_id") - F.col("_first") - F.col("_head")).where((F.col("_head") == 0) | (F.col("_id") > F.col("_first")))
    numbers = F.transform(F.regexp_extract_all(F.regexp_replace("value", r"^[^(]*", ""), F.lit(r"-?\d+"), 0), lambda s: s.cast("int"))
    frame = F.regexp_extract("value", r"^\s*(\d+)\s*(\(|$)", 1)
    even = F.size("_v") % 2 == 0
    odd = lambda k: F.transform(F.filter("_v", lambda v, i: i % 2 == k), lambda v: v)
    return placed.withColumn("_v", numbers).select(F.col("place").cast("bigint").alias("place"), F.when(even & (frame != ""), frame.try_cast("bigint")).alias("contour_frame"), odd(0).alias("x"), odd(1).alias("y"))


def event_offset(events: DataFrame, contours: DataFrame) -> int:
    """0 if the first contour belongs to the first event, 1 if to the second."""
    frames = {r.event_idx: r.frame for r in events.where("event_idx < 2").select("event_idx", "frame").collect()}
    first = contours.where("place = 0").first()
    for k in (0, 1):
        if first is not None and frames.get(k) == first.contour_frame:
            return k
    raise ContourOffsetError(f"the first contour is of frame {first.contour_frame if first else None}, the events begin with {sorted(frames.items())}")


def match_contours(events: DataFrame, contours: DataFrame, pixel_um: float | None = None) -> DataFrame:
    """Rows (event_idx, matched, contour_frame, x, y, status) for events (event_idx, frame, ...), numbered from 0.

    An event's contour is the one of its frame at its place or up to two places away ("frame"). Else the one at its place, if size,
    area and position of the event say so ("geometry"; needs a pixel size and size_x, size_y, pos_x, pos_y and area_msd), or
    for want of another ("guess"). Events before the first contour, and places beyond the last, have none ("none").
    """
    offset = event_offset(events, contours)
    known = settled(contours)
    shifted = events.select("event_idx", "frame", (F.col("event_idx") - offset).alias("place"))
    side = known.select("place", F.col("contour_frame").alias("frame"), F.struct("contour_frame", "x", "y").alias("c"))
    found = frame_match(shifted.where("place >= 0"), side, "place", "frame", "c").select("event_idx", F.col("matched"), F.col("matched_c").alias("c"))
    own = known.select((F.col("place") + offset).alias("event_idx"), F.col("place").alias("_place"), F.struct("contour_frame", "x", "y").alias("_own"))
    out = events.join(found, "event_idx", "left").join(own, "event_idx", "left")
    fits = F.lit(False)
    needed = {"size_x", "size_y", "pos_x", "pos_y", "area_msd"}
    if pixel_um and needed <= set(events.columns):
        x, y = F.col("_own.x"), F.col("_own.y")
        m = moments(x, y)
        close = lambda a, b, off: F.coalesce(F.abs(a - b) <= off, F.lit(False))
        width = lambda v: F.array_max(v) - F.array_min(v) + 1
        px = lambda f: F.col(f) / pixel_um
        fits = close(px("size_x"), width(x), SIZE_OFF) & close(px("size_y"), width(y), SIZE_OFF) & close(F.col("area_msd"), m["m00"], SIZE_OFF) & close(px("pos_x"), m["cx"], PLACE_OFF) & close(px("pos_y"), m["cy"], PLACE_OFF)
    status = F.when(F.col("c").isNotNull(), "frame").when(F.col("_own").isNull(), "none").when(fits, "geometry").otherwise("guess")
    c = F.coalesce("c", "_own")
    return out.select("event_idx", F.coalesce("matched", "_place").alias("matched"), c["contour_frame"].alias("contour_frame"), c["x"].alias("x"), c["y"].alias("y"), status.alias("status"))
