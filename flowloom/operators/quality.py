"""Data-quality report (DQ-01 to DQ-31): cues (level, category, section, key, msg), data checks from one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.catalog import Catalog, Metadata, key_type
from flowloom.functions.numeric import finite_or_null

CUE = "level string, category string, section string, key string, msg string"
# Keys that every measurement, and every one with fluorescence, must have.
REQUIRED = {
    "experiment": ["date", "event count", "run index", "sample", "time"],
    "imaging": ["flash device", "flash duration", "frame rate", "pixel size", "roi position x", "roi position y", "roi size x", "roi size y"],
    "setup": ["channel width", "chip region", "flow rate", "medium"],
}
REQUIRED_FLUORESCENCE = ["bit depth", "channel count", "channels installed", "laser count", "lasers installed", "sample rate", "samples per event", "signal max", "signal min", "trace median"]
POSITIVE = [("imaging", "frame rate"), ("imaging", "pixel size"), ("setup", "channel width"), ("setup", "flow rate")]
MAX_LOG_LINE = 100


def _cue(level: str, category: str, msg: str, section: str | None = None, key: str | None = None) -> tuple:
    return (level, category, section, key, msg)


def metadata_cues(meta: Metadata, has_fluorescence: bool) -> list[tuple]:
    """Rules on metadata alone: missing keys, values that must be positive, flow rates, channels, lasers, polygons."""
    out = []
    get = meta.get
    for section, keys in REQUIRED.items():
        level = "violation"
        if section not in meta.values:
            out.append(_cue(level, "metadata missing", f"section [{section}] is missing", section))
        else:
            out += [_cue(level, "metadata missing", f"[{section}] {k} is missing", section, k) for k in keys if get(section, k) is None]
    if has_fluorescence:
        out += [_cue("alert", "metadata missing", f"[fluorescence] {k} is missing", "fluorescence", k) for k in REQUIRED_FLUORESCENCE if get("fluorescence", k) is None]
        for what, one, total in (("channel", "name", "channel count"), ("laser", "lambda", "laser count")):
            named = sum(get("fluorescence", f"{what} {k} {one}") is not None for k in (1, 2, 3))
            if get("fluorescence", total) is not None and get("fluorescence", total) != named:
                out.append(_cue("violation", "metadata wrong", f"{total} isn't the number of {what}s", "fluorescence", total))
    for section, key in POSITIVE:
        v = get(section, key)
        if v is not None and not v > 0:
            out.append(_cue("violation", "metadata wrong", f"{key} must be positive", section, key))
    parts = [get("setup", k) for k in ("flow rate", "flow rate sample", "flow rate sheath")]
    if None not in parts and abs(parts[1] + parts[2] - parts[0]) > 1e-9 * max(1.0, abs(parts[0])):
        out.append(_cue("alert", "metadata wrong", "sample and sheath flow don't add up to the flow rate", "setup", "flow rate"))
    for k, v in meta.values.get("online_filter", {}).items():
        if k.endswith("polygon points") and (len(v) < 3 or any(len(p) != 2 for p in v)):
            out.append(_cue("violation", "metadata wrong", "a polygon needs at least three points of two numbers", "online_filter", k))
    return out


def channel_name_cues(columns: list[str], meta: Metadata) -> list[tuple]:
    """DQ-08: a channel has a name if and only if its peak maximum is there."""
    out = []
    for k in (1, 2, 3):
        there, named = f"fl{k}_max" in columns, meta.get("fluorescence", f"channel {k} name") is not None
        if there and not named:
            out.append(_cue("alert", "metadata missing", f"[fluorescence] channel {k} name is missing", "fluorescence", f"channel {k} name"))
        elif named and not there:
            out.append(_cue("alert", "metadata invalid", f"[fluorescence] channel {k} name is set without fl{k}_max", "fluorescence", f"channel {k} name"))
    return out


def wrong_index(index: str = "index", key: str = "event_idx"):
    """How many rows are not numbered from 1 in the order of events (WIN-07), as one aggregate; a null number is wrong too."""
    return F.count_if(~F.col(index).eqNullSafe(F.col(key) + 1))


def data_cues(df: DataFrame, meta: Metadata, catalog: Catalog | None = None) -> list[tuple]:
    """Rules on the events, from one aggregate over all of them."""
    catalog = catalog or Catalog()
    c, have = F.col, set(df.columns)
    checks = {"n": F.count("*")}
    if {"index", "event_idx"} <= have:
        checks["index"] = wrong_index()
    for f in [f for f in have if f.startswith("fl") and f.endswith(("_max", "_max_ctc"))]:
        checks[f"low:{f}"] = F.min(finite_or_null(f))
    for f in [f for f in have if f.startswith("ml_score_")]:
        checks[f"score:{f}"] = F.count_if((c(f) < 0) | ((c(f) > 1) & ~F.isnan(f)))
    if "temp" in have:
        checks["temp"] = F.count_if(c("temp") != 0)
    if "trace" in have and meta.get("fluorescence", "samples per event") is not None:
        checks["trace"] = F.count_if(F.exists(F.map_values("trace"), lambda t: F.size(t) != meta.get("fluorescence", "samples per event")))
    if {"image", "img_h", "img_w"} <= have:
        checks["roi"] = F.count_if((c("img_w") != F.lit(meta.get("imaging", "roi size x"))) | (c("img_h") != F.lit(meta.get("imaging", "roi size y"))))
    checks |= {f"null:{f}": F.count_if(c(f).isNull()) for f in have if catalog.exists(f)}
    r = df.agg(*[v.alias(k) for k, v in checks.items()]).first().asDict()
    out = []
    if r["n"] == 0:
        out.append(_cue("alert", "feature data", "there are no events"))
    if meta.get("experiment", "event count") not in (None, r["n"]):
        out.append(_cue("violation", "metadata wrong", "event count isn't the number of events", "experiment", "event count"))
    if r.get("index"):
        out.append(_cue("violation", "feature data", "index doesn't run from 1", None, "index"))
    out += [_cue("alert", "feature data", f"{k[4:]} goes down to {v:.3g}", None, k[4:]) for k, v in sorted(r.items()) if k.startswith("low:") and v is not None and v <= 0.1]
    out += [_cue("violation", "feature data", f"{k[6:]} has values outside [0, 1]", None, k[6:]) for k, v in sorted(r.items()) if k.startswith("score:") and v]
    if "temp" in r and r["temp"] == 0 and r["n"]:
        out.append(_cue("violation", "feature data", "temperatures are all zero", None, "temp"))
    if r.get("trace"):
        out.append(_cue("violation", "metadata wrong", "traces don't have the stated number of samples", "fluorescence", "samples per event"))
    if r.get("roi"):
        out.append(_cue("violation", "metadata wrong", "images don't have the stated size", "imaging", "roi size x"))
    out += [_cue("violation", "feature size", f"{k[5:]} is shorter than others", None, k[5:]) for k, v in sorted(r.items()) if k.startswith("null:") and v]
    unknown = sorted(f for f in have if not catalog.exists(f) and f not in ("event_idx", "root_idx", "parent_idx", "img_h", "img_w"))
    return out + [_cue("violation", "feature unknown", f"{f} isn't a known feature", None, f) for f in unknown]


def choice_cues(meta: Metadata, choices: dict[str, dict[str, list]]) -> list[tuple]:
    """DQ-20: values that aren't among the choices of their keys."""
    return [_cue("violation", "metadata wrong", f"{k} is {meta.get(s, k)!r}, none of {', '.join(map(str, allowed))}", s, k) for s, keys in choices.items() for k, allowed in keys.items() if meta.get(s, k) is not None and meta.get(s, k) not in allowed]


def type_cues(raw: dict[str, dict]) -> list[tuple]:
    """DQ-21: stored metadata (section -> key -> value) that its converter changes; unknown keys are left to others."""
    out = []
    for section, values in raw.items():
        for key, value in values.items():
            convert = key_type(section, key)
            if convert is None:
                continue
            try:
                expected = convert(value)
            except (TypeError, ValueError):
                out.append(_cue("alert", "metadata wrong", f"{key} can't be {value!r}", section, key))
                continue
            plain = lambda v: [plain(x) for x in v] if isinstance(v, (list, tuple)) else v  # noqa: B023, E731
            if plain(expected) != plain(value) or isinstance(expected, bool) != isinstance(value, bool):
                out.append(_cue("alert", "metadata wrong", f"{key} should be {expected!r}, but is {value!r}", section, key))
    return out


def check(df: DataFrame, meta: Metadata, logs: dict[str, list[str]] | None = None, catalog: Catalog | None = None, choices: dict[str, dict[str, list]] | None = None) -> DataFrame:
    """All cues of an ungated measurement as a DataFrame."""
    fluorescent = any(c.startswith("fl") and c.endswith("_max") for c in df.columns)
    rows = [_cue("info", "general", f"fluorescence: {fluorescent}"), _cue("info", "format", "parquet")]
    rows += metadata_cues(meta, fluorescent) + channel_name_cues(df.columns, meta) + data_cues(df, meta, catalog) + choice_cues(meta, choices or {})
    for name, lines in (logs or {}).items():
        if any(len(x) > MAX_LOG_LINE for x in lines):
            rows.append(_cue("alert", "format", f"log {name} has lines of more than {MAX_LOG_LINE} characters"))
    return df.sparkSession.createDataFrame(rows, CUE)


def summary(cues: DataFrame) -> DataFrame:
    return cues.groupBy("level").agg(F.count("*").alias("n"))


def exit_code(cues: DataFrame) -> int:
    """0: fine, 1: alerts, 2: violations, 3: both."""
    levels = {r.level for r in summary(cues).collect()}
    return ("alert" in levels) + 2 * ("violation" in levels)
