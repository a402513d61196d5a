"""The REST source against a server on this machine whose first answers fail."""

import json
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from flowloom.catalog import Catalog
from flowloom.operators.basins import Basin
from flowloom.sources import rest

N = 25
DEFORM = [0.5 * k if k != 4 else None for k in range(N)]
ROUTE = "api/serve?id="


class Handler(BaseHTTPRequestHandler):
    def log_message(self, *a):
        pass

    def do_GET(self):
        q = dict(urllib.parse.parse_qsl(urllib.parse.urlparse(self.path).query))
        what = q.get("query")
        key = json.dumps(q, sort_keys=True)
        with self.server.lock:
            self.server.asked.append((what, q.get("feature"), q.get("event")))
            first = key not in self.server.seen
            self.server.seen.add(key)
        if first and self.server.fails:
            self.send_response(502)
            self.end_headers()
            self.wfile.write(b"<html>later</html>")  # no JSON
            return
        if q.get("id") == "closed" and self.headers.get("Authorization") != "good":
            return self.answer(403, {"success": False, "error": {"message": "not yours"}})
        event = int(q.get("event", 0))
        known = {
            "metadata": {"experiment": {"sample": "s", "run index": 2, "date": "2020-01-01"}, "imaging": {"frame rate": 2000.0}},
            "size": N, "feature_list": ["deform", "image", "trace", "no such feature"], "trace_list": ["fl1_raw", "fl2_raw"],
            "logs": {"log": ["a", "b"]}, "tables": {"t": [["x", "y"], [[1, 2], [3, None]]]},
            "basins": [{"name": "b", "urls": ["http://x/y?expires=123"]}, {"name": "c", "urls": ["http://x/z"]}],
        }
        if what == "feature":
            result = DEFORM if q["feature"] == "deform" else [[event, event + 1], [0, 9]] if q["feature"] == "image" else [event, len(q["trace"])]
        elif what in known:
            result = known[what]
        else:
            return self.answer(400, {"success": False, "error": {"message": "what?"}})
        self.answer(200, {"success": True, "result": result})

    def answer(self, code, body):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())


@pytest.fixture
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    s.lock, s.asked, s.seen, s.fails = threading.Lock(), [], set(), True
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s
    s.shutdown()


def test_features_are_read_in_ranges_when_asked_for(spark, server):
    f = rest.open_rest(spark, "res-1", f"127.0.0.1:{server.server_port}", ROUTE, tls=False, step=10, pause=0.0)
    assert f.count() == N and f.meta.get("experiment", "sample") == "s" and f.logs == {"log": ["a", "b"]}
    assert [tuple(r) for r in f.tables["t"].collect()] == [(1.0, 2.0), (3.0, None)]
    assert f.features("basin") == ["deform", "image", "trace"] and "deform" in f and "tilt" not in f
    assert not any(q == "feature" for q, _, _ in server.asked)
    got = {r.event_idx: r.deform for r in f.with_features("deform").df.collect()}
    assert got == dict(enumerate(DEFORM))
    assert {x for q, x, _ in server.asked if q == "feature"} == {"deform"}
    image = f.with_features("image").df
    assert image.rdd.getNumPartitions() >= 1 and {r.event_idx: r.image for r in image.collect()} == {k: [[k, k + 1], [0, 9]] for k in range(N)}
    assert {int(e) for q, x, e in server.asked if x == "image"} == set(range(N))
    traces = {r.event_idx: r.trace for r in f.with_features("trace").df.where("event_idx < 3").collect()}
    assert traces == {k: {"fl1_raw": [k, 7.0], "fl2_raw": [k, 7.0]} for k in range(3)}


def test_ranges_of_events(server):
    o = {"address": "http://x/", "feature": "image", "kind": "array<array<double>>", "size": "25", "step": "10", "timeout": "1", "retries": "1", "pause": "0"}
    assert [(p.start, p.stop) for p in rest._Reader(o).partitions()] == [(0, 10), (10, 20), (20, 25)]
    assert [(p.start, p.stop) for p in rest._Reader(o | {"kind": "double"}).partitions()] == [(0, 25)]
    assert rest._Reader(o | {"size": "0"}).partitions() == []


def test_tokens_and_refusals(server):
    at = f"http://127.0.0.1:{server.server_port}/{ROUTE}"
    with pytest.raises(rest.AccessError, match="not yours"):
        rest.Client(at + "closed", ["bad"], pause=0).get("size")
    c = rest.Client(at + "closed", ["bad", "good"], pause=0)
    assert c.get("size") == N and c._works == "good"
    n = len(server.asked)
    assert c.get("size") == N and len(server.asked) == n  # kept
    with pytest.raises(rest.AccessError, match="what"):
        c.get("nothing")
    with pytest.raises(rest.AccessError, match="2 tries failed"):
        rest.Client("http://127.0.0.1:9/x?id=1", retries=2, pause=0).get("size")
    found = rest.basin_definitions(rest.Client(at + "open", pause=0))
    assert [(b["name"], b["perishable"], b.get("time_expiration")) for b in found] == [("b", True, 123), ("c", False, None)]


def test_urls():
    for given, want in (("abc-1", "https://h.org/api/serve?id=abc-1"), ("h2/api/serve?id=x", "https://h2/api/serve?id=x"), ("http://h2/api/serve?id=x", "http://h2/api/serve?id=x"), ("https://h2/api/serve?id=x", "https://h2/api/serve?id=x")):
        assert rest.full_url(given, "https://h.org", ROUTE) == want
    assert rest.full_url("http://h/p?id=1", "", ROUTE, tls=True) == "https://h/p?id=1"
    assert rest.is_full_url("https://h.org/api/serve?id=ab-1", ROUTE) and not rest.is_full_url("h.org/api/serve?id=ab-1", ROUTE) and not rest.is_full_url("https://h.org/other?id=1", ROUTE)


def test_mapped_basin(spark, server):
    server.fails = False
    client = rest.Client(f"http://127.0.0.1:{server.server_port}/{ROUTE}r", pause=0)
    (b,) = rest.feature_basins(spark, client, Catalog(), ["deform"], mapping="basinmap0", identifier="run")
    assert isinstance(b, Basin) and b.kind == "remote" and b.format == "rest"
    from flowloom.frame import EventFrame

    df = spark.range(3).select(F.col("id").alias("event_idx"), (F.col("id") * 3 + 1).alias("basinmap0"))
    got = EventFrame(df, basins=(b,)).with_features("deform").df
    assert sorted((r.event_idx, r.deform) for r in got.collect()) == [(0, 0.5), (1, None), (2, 3.5)]
