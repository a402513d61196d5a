"""Measurements behind a REST interface (SRC-23 to SRC-26, SRC-38).

The interface answers `<url>&version=2&query=<what>` with JSON {"success": true, "result": ...} or {"success": false, "error":
{"message": ...}}; what is metadata, size, feature_list, feature (with &feature=, and &event= for features of arrays), trace_list, logs,
tables or basins. A feature is a basin of its own: Spark reads it in tasks, in ranges of events, only if it is asked for.
"""

from __future__ import annotations

import json
import re
import ssl
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from flowloom.catalog import Catalog, Metadata
from flowloom.frame import EventFrame
from flowloom.operators.basins import Basin

FORMAT = "measurement_rest"


class AccessError(RuntimeError):
    """The interface refused a request, or didn't answer it."""


def full_url(url: str, host: str, route: str, tls: bool | None = None) -> str:
    """The URL of a resource from a full URL, one without scheme, or an identifier, which is put after the host and route.
    tls None follows the URL: plain http only where it says so."""
    scheme, _, rest = url.rpartition("://")
    if tls is None:
        tls = scheme != "http"
    if "/" not in rest:
        rest = f"{host.rpartition('://')[2]}/{route}{rest}"
    return f"{'https' if tls else 'http'}://{rest}"


def is_full_url(url: str, route: str) -> bool:
    """Whether a basin's location names a resource of such an interface with scheme, host and route (SRC-38)."""
    return re.match(rf"https?://[A-Za-z0-9.:-]+/{re.escape(route)}[A-Za-z0-9-]+$", url) is not None


@dataclass
class Client:
    """Requests with retries: each has two seconds more than the one before, and pauses where the answer isn't JSON.
    The tokens are tried in turn, none at first, and one that works is kept; answers of fixed questions are too."""

    url: str
    tokens: Sequence[str] = ()
    timeout: float = 1.0
    retries: int = 5
    pause: float = 1.0
    authority: str | None = None
    _known: dict = field(default_factory=dict)
    _works: str = ""

    def _ask(self, call: str, token: str) -> dict:
        why = []
        for k in range(self.retries):
            request = urllib.request.Request(call, headers={"Authorization": token} if token else {})
            context = ssl.create_default_context(cafile=self.authority) if call.startswith("https") else None
            try:
                try:
                    with urllib.request.urlopen(request, timeout=self.timeout + 2 * k, context=context) as answer:
                        return json.loads(answer.read())
                except urllib.error.HTTPError as e:  # a refusal has a body too
                    return json.loads(e.read())
            except ValueError:
                why.append("no JSON")
                time.sleep(self.pause)
            except (TimeoutError, OSError) as e:
                why.append(str(e))
        raise AccessError(f"{call}: {self.retries} tries failed: {why}")

    def get(self, query: str, **more):
        call = f"{self.url}&version=2&query={query}" + "".join(f"&{k}={urllib.parse.quote(str(v))}" for k, v in more.items())
        if call in self._known:
            return self._known[call]
        refused = {}
        for token in dict.fromkeys((self._works, "", *self.tokens)):
            answer = self._ask(call, token)
            if answer.get("success"):
                self._works = token
                break
            refused[answer.get("error", {}).get("message", "refused")] = None
        else:
            raise AccessError(f"{query}: {'; '.join(refused)}")
        if query in ("metadata", "size", "feature_list", "trace_list"):
            self._known[call] = answer["result"]
        return answer["result"]

    def size(self) -> int:
        stated = self.get("metadata").get("experiment", {}).get("event count")
        return int(self.get("size") if stated is None else stated)


@dataclass
class _Events(InputPartition):
    start: int
    stop: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.feature, self.kind = options["feature"], options["kind"]
        self.size, self.step = int(options["size"]), int(options["step"])
        self.client = Client(options["address"], [t for t in options.get("token", "").split(",") if t], float(options["timeout"]), int(options["retries"]), float(options["pause"]), options.get("authority") or None)

    def partitions(self) -> list[InputPartition]:
        if self.kind == "double":  # a scalar feature comes as a whole
            return [_Events(0, self.size)]
        return [_Events(k, min(self.size, k + self.step)) for k in range(0, self.size, self.step)]

    def read(self, part: _Events) -> Iterator[tuple]:
        if self.kind == "double":
            for i, v in enumerate(self.client.get("feature", feature=self.feature)):
                yield i, None if v is None else float(v)
            return
        traces = self.client.get("trace_list") if self.feature == "trace" else ()
        deep = lambda v: [deep(x) for x in v] if isinstance(v, list) else float(v)
        for i in range(part.start, part.stop):
            if traces:
                yield i, {t: deep(self.client.get("feature", feature="trace", trace=t, event=i)) for t in traces}
            else:
                yield i, deep(self.client.get("feature", feature=self.feature, event=i))


class FeatureSource(DataSource):
    """One feature of a resource: rows (event_idx, feature)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return f"event_idx long, `{self.options['feature']}` {self.options['kind']}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def kind_of(feature: str, catalog: Catalog) -> str:
    """The column type of a feature: a number, a series, a map of series, or rows of numbers."""
    if catalog.exists(feature, True):
        return "double"
    return "map<string, array<double>>" if feature == "trace" else "array<array<double>>"


def feature_basins(spark: SparkSession, client: Client, catalog: Catalog, features: Sequence[str] | None = None, step: int = 1000, mapping: str = "same", identifier: str | None = None) -> list[Basin]:
    """A basin of kind remote for each feature that the resource has and the catalogue knows."""
    spark.dataSource.register(FeatureSource)
    offered = [f for f in client.get("feature_list") if catalog.exists(f) and (features is None or f in features)]
    shared = {"address": client.url, "size": client.size(), "step": step, "timeout": client.timeout, "retries": client.retries, "pause": client.pause, "token": ",".join(client.tokens), "authority": client.authority or ""}
    return [Basin(spark.read.format(FORMAT).options(feature=f, kind=kind_of(f, catalog), **shared).load(), mapping=mapping, kind="remote", format="rest", features=(f,), identifier=identifier, name=f"{client.url}#{f}") for f in offered]


def basin_definitions(client: Client) -> list[dict]:
    """The resource's own basins; one whose URL expires is marked `perishable`, with the time (seconds since 1970). An
    interface that doesn't know the question has none."""
    try:
        found = client.get("basins")
    except AccessError:
        return []
    for b in found:
        times = [int(m[1]) for u in b.get("urls", []) if (m := re.search(r"expires=([0-9]+)$", u.lower()))]
        b["perishable"] = bool(b.get("perishable", times))
        if times:
            b.setdefault("time_expiration", times[0])
    return found


def open_rest(spark: SparkSession, url: str, host: str = "", route: str = "", tokens: Sequence[str] = (), tls: bool | None = None, catalog: Catalog | None = None, step: int = 1000, timeout: float = 1.0, retries: int = 5, pause: float = 1.0, authority: str | None = None) -> EventFrame:
    """A resource as a measurement: metadata, logs and tables now, features when they are asked for. Missing numbers in
    tables and features are null."""
    catalog = catalog or Catalog()
    client = Client(full_url(url, host, route, tls), tuple(tokens), timeout, retries, pause, authority)
    meta = Metadata()
    for section, values in client.get("metadata").items():
        for k, v in values.items():
            meta.set(section, k, v)
    tables = {}
    for name, (columns, data) in (client.get("tables") or {}).items():
        names = columns or [f"column_{k}" for k in range(len(data[0]) if data else 1)]
        tables[name] = spark.createDataFrame([tuple(None if v is None else float(v) for v in (row if isinstance(row, list) else [row])) for row in data], ", ".join(f"`{n}` double" for n in names))
    frame = EventFrame(spark.range(client.size()).withColumnRenamed("id", "event_idx"), meta, logs=client.get("logs") or {}, tables=tables, catalog=catalog)
    from dataclasses import replace

    return replace(frame, basins=tuple(feature_basins(spark, client, catalog, step=step)))
