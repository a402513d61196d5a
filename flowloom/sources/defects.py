"""Stored features that are known to be wrong are hidden, so that they are derived anew (DQ-31)."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.types import FloatType

from flowloom.catalog import Metadata


@dataclass(frozen=True)
class Defect:
    """Features that are wrong where test(df, meta) holds, or with `by_logs` test(df, meta, names of logs)."""

    features: tuple[str, ...]
    test: Callable[..., bool]
    by_logs: bool = False


def _coarse_time(df: DataFrame, meta: Metadata) -> bool:
    """Times in single precision are too coarse, and frames and their rate give better ones."""
    return "frame" in df.columns and bool(meta.get("imaging", "frame rate")) and isinstance(df.schema["time"].dataType, FloatType)


def version_tuple(text: str) -> tuple[int, ...]:
    return tuple(int(x) for x in re.findall(r"\d+", text))


def written_by(program: str, before: str, at_least: str = "0", last: bool = True, wide: int | None = None) -> Callable[[DataFrame, Metadata], bool]:
    """A test for data that a program's versions from at_least to before (excluded) wrote: the last (or first) entry of
    the chain of programs in the metadata. wide: only images of more columns than that."""

    def test(df: DataFrame, meta: Metadata) -> bool:
        chain = [p.strip() for p in (meta.get("setup", "software version") or "").split("|") if p.strip()]
        if not chain or wide is not None and not (meta.get("imaging", "roi size x") or 0) > wide:
            return False
        name, _, version = chain[-1 if last else 0].partition(" ")
        return name == program and version_tuple(at_least) <= version_tuple(version) < version_tuple(before)

    return test


STANDARD = (Defect(("time",), _coarse_time),)


def _programs(meta: Metadata) -> list[tuple[str, str]]:
    """(name, version) of each program that the measurement went through, the recording one first."""
    chain = [p.strip() for p in (meta.get("setup", "software version") or "").split("|") if p.strip()]
    return [(name, version) if version else ("", name) for name, _, version in (p.partition(" ") for p in chain)]


def history(recorder: str, analyser: str, recorder_log: str = "", volume_log: str = "") -> tuple[Defect, ...]:
    """The known defects of one recording program and one analysing program, by the names that they leave in the chain of
    programs. recorder_log names a log that the recorder writes even where it gives a version only; volume_log one that tells
    that volumes were computed anew."""

    def last_before(meta: Metadata, version: str) -> bool:
        chain = _programs(meta)
        return bool(chain) and chain[-1][0] == analyser and version_tuple(chain[-1][1]) < version_tuple(version)

    def aspect(df: DataFrame, meta: Metadata) -> bool:
        """A wrong cast in two versions of the recorder; later programs compute it anew and are named in the chain."""
        return _programs(meta) in ([(recorder, "2.0.6")], [(recorder, "2.0.7")])

    def time(df: DataFrame, meta: Metadata) -> bool:
        """The analyser once kept the recorder's coarse times in double precision."""
        derivable = "frame" in df.columns and bool(meta.get("imaging", "frame rate"))
        return derivable and any(p == recorder for p, _ in _programs(meta)) and last_before(meta, "0.47.6")

    def volume(df: DataFrame, meta: Metadata, logs: Sequence[str]) -> bool:
        return volume_log not in logs and last_before(meta, "0.37.0")

    def overflow(meta: Metadata) -> bool:
        """Whole numbers ran over in moments of contours in wide images."""
        return (meta.get("imaging", "roi size x") or 0) > 500 and last_before(meta, "0.48.3")

    def inertia(df: DataFrame, meta: Metadata) -> bool:
        return overflow(meta)

    def recorded_inertia(df: DataFrame, meta: Metadata, logs: Sequence[str]) -> bool:
        """Ratios of a recorder from 2.0.5 on were computed by it, and rightly."""
        if not overflow(meta):
            return False
        name, version = _programs(meta)[0]
        if name == recorder or recorder_log and recorder_log in logs:
            return version_tuple(version) < version_tuple("2.0.5")
        return True

    return (
        Defect(("aspect",), aspect),
        Defect(("time",), time),
        Defect(("volume",), volume, True),
        Defect(("inert_ratio_prnc", "tilt"), inertia),
        Defect(("inert_ratio_cvx", "inert_ratio_raw"), recorded_inertia, True),
    )


def hide(df: DataFrame, meta: Metadata, defects: Sequence[Defect] = STANDARD, logs: Sequence[str] = ()) -> DataFrame:
    """df without its defective features."""
    wrong = {f for d in defects for f in d.features if f in df.columns and (d.test(df, meta, logs) if d.by_logs else d.test(df, meta))}
    return df.drop(*wrong)
