"""Contour files, shifted and with frames missing, against a sequential reading of the same rules."""

import numpy as np
import pytest

from flowloom.sources.contour_files import ContourOffsetError, find_contour_file, match_contours, read_contours


def box(k):
    """A rectangle whose size and place depend on k."""
    w, h, x, y = 3 + k % 5, 4 + k % 3, 10 + k % 17, 20 + k % 7
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def text(frames):
    return "made by hand\n" + "".join(f"Contour in frame {f}\n" + "\n".join(f"({x}, {y})" for x, y in box(k)) + "\n\n" for k, f in frames)


def brute(event_frames, contours, geometry):
    first = contours[0][1]
    offset = 0 if first == event_frames[0] else 1
    out = []
    for i, f in enumerate(event_frames):
        at = i - offset
        got = next((j for j in (at, at - 1, at + 1, at - 2, at + 2) if at >= 0 and 0 <= j < len(contours) and contours[j][1] == f), None)
        if got is not None:
            out.append((i, got, "frame"))
        elif not 0 <= at < len(contours):
            out.append((i, None, "none"))
        else:
            out.append((i, at, "geometry" if geometry and contours[at][0] == i else "guess"))
    return out


@pytest.mark.parametrize("shift,missing,renamed,geometry", [(0, (), (), True), (1, (7, 40), (20, 21), True), (0, (3,), (30, 31), False), (1, (5, 6, 60), (10,), True)])
def test_matches(spark, tmp_path, shift, missing, renamed, geometry):
    n = 90
    frames = [100 + 3 * i for i in range(n)]
    contours = [(i, frames[i] + (1 if i in renamed else 0)) for i in range(shift, n) if i not in missing]
    path = tmp_path / "M1_contours.txt"
    path.write_text(text(contours))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        read = read_contours(spark, str(path))
        rows = sorted(read.collect())
        assert spark.read.option("lineSep", "Contour in frame").text(str(path)).rdd.getNumPartitions() > 3
        assert [(r.place, r.contour_frame, list(zip(r.x, r.y))) for r in rows] == [(p, f, box(k)) for p, (k, f) in enumerate(contours)]
        px = 0.5
        data = []
        for i in range(n):
            b = np.array(box(i))
            w, h = np.ptp(b, axis=0)
            data.append((i, frames[i], (w + 1) * px, (h + 1) * px, b[:, 0].mean() * px + 1, b[:, 1].mean() * px - 1, float(w * h)))
        events = spark.createDataFrame([tuple(v.item() if hasattr(v, "item") else v for v in d) for d in data], "event_idx long, frame long, size_x double, size_y double, pos_x double, pos_y double, area_msd double")
        got = sorted(match_contours(events, read, px if geometry else None).collect())
        assert [(r.event_idx, r.matched, r.status) for r in got] == brute(frames, contours, geometry)
        assert all(list(zip(r.x, r.y)) == box(contours[r.matched][0]) for r in got if r.matched is not None)
        assert len({r.status for r in got}) > 1 or not missing
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_odd_files(spark, tmp_path):
    path = tmp_path / "x_contours.txt"
    path.write_text("Contour in frame 5 (1,2) (3,4)\nContour in frame\nContour in frame 9\n(1, 2)\n(3")
    assert [(r.place, r.contour_frame, r.x, r.y) for r in sorted(read_contours(spark, str(path)).collect())] == [(0, 5, [1, 3], [2, 4]), (1, None, [], []), (2, None, [1, 3], [2])]
    events = spark.createDataFrame([(0, 1), (1, 2)], "event_idx long, frame long")
    with pytest.raises(ContourOffsetError):
        match_contours(events, read_contours(spark, str(path)))
    (tmp_path / "e_contours.txt").write_text("")
    assert read_contours(spark, str(tmp_path / "e_contours.txt")).collect() == []


def test_names():
    names = ["M10_contours.txt", "M1_contours.txt", "M2_0.1_contours.txt", "M2_contours.txt", "x.txt"]
    assert find_contour_file(names, "M1_0.24") == "M1_contours.txt" and find_contour_file(names, "M2_0.1") == "M2_0.1_contours.txt" and find_contour_file(names, "M3_0") is None
