"""A vector store behind HTTP: filters that reach the service, metadata conditions, nearest records."""

import http.server
import json
import threading
from urllib.parse import parse_qs, urlparse

import pytest

from quillspark.sources import connect

RECORDS = [(f"r{i}", f"text {i}", {"doc": i % 3, "n": i} if i % 5 else None, [float(i), 1.0]) for i in range(25)]
NAMES = ("documents", "metadatas", "embeddings")


@pytest.fixture
def store():
    """url, requests: a service over RECORDS that notes what it is asked."""
    seen = []

    def columns(rows, include):
        return {"ids": [r[0] for r in rows]} | {c: [r[i] for r in rows] for i, c in enumerate(NAMES, 1) if c in include}

    class Handler(http.server.BaseHTTPRequestHandler):
        def answer(self, body):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def do_GET(self):
            asked = urlparse(self.path)
            q = {k: v[0] for k, v in parse_qs(asked.query).items()}
            seen.append((asked.path, q))
            if asked.path == "/api/tags":
                return self.answer({"models": [{"name": "m1", "size": 5, "details": {"family": "x"}}, {"name": "m2"}]})
            self.answer(len(RECORDS) if asked.path == "/count" else columns(RECORDS[int(q["offset"]) :][: int(q["limit"])], q["include"]))

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, body))
            if self.path == "/api/show":
                return self.answer({"about": body["model"]}) if body["model"] != "m2" else self.send_error(404)
            if self.path == "/get":
                rows = [r for r in RECORDS if ("ids" not in body or r[0] in body["ids"]) and all((r[2] or {}).get(k) == v for k, v in (body.get("where") or {}).items())]
                at = body.get("offset", 0)
                self.answer(columns(rows[at : at + body.get("limit", len(rows))], body["include"]))
            else:
                best = [sorted(RECORDS, key=lambda r, v=v: (sum((a - b) ** 2 for a, b in zip(r[3], v)), r[0]))[: body["n_results"]] for v in body["query_embeddings"]]
                found = {"ids": [[r[0] for r in b] for b in best], "documents": [[r[1] if r[0] != "r4" else None for r in b] for b in best], "metadatas": [[r[2] for r in b] for b in best]}
                far = [[sum((a - b) ** 2 for a, b in zip(r[3], v)) for r in b] for v, b in zip(body["query_embeddings"], best)]
                self.answer(found | ({"distances": far} if body["n_results"] != 2 else {}))

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


def test_ids_reach_the_service(spark, store):
    url, seen = store
    rows = connect.read_paged(spark, url, page=2)
    got = rows.where("id IN ('r3', 'r7', 'r11', 'none') AND document <> 'text 7'").select("id", "document")
    assert sorted(map(tuple, got.collect())) == [("r11", "text 11"), ("r3", "text 3")]
    assert {p for p, _ in seen} == {"/get"} and sorted(i for _, b in seen for i in b["ids"]) == ["none", "r11", "r3", "r7"] and len(seen) == 2
    seen.clear()
    assert [r.id for r in rows.where("id = 'r5' AND id IN ('r5', 'r6')").collect()] == ["r5"]
    assert [b["ids"] for _, b in seen] == [["r5"]]
    assert rows.where("id = 'r5' AND id = 'r6'").count() == 0
    assert rows.where("document = 'text 9'").count() == 1
    assert rows.where("id > 'r7'").count() == 2


def test_metadata_conditions_are_the_services(spark, store):
    url, seen = store
    rows = connect.read_paged(spark, url, page=4, include="metadatas", where={"doc": 1})
    want = sorted(r[0] for r in RECORDS if r[2] and r[2]["doc"] == 1)
    assert sorted(r.id for r in rows.collect()) == want and all(r.document is None for r in rows.collect())
    assert all(b["where"] == {"doc": 1} and b["limit"] == 4 for _, b in seen)
    assert [r.id for r in rows.where("id IN ('r1', 'r2')").collect()] == ["r1"]
    assert connect.read_paged(spark, url, where={"doc": 9}).count() == 0
    with pytest.raises(Exception, match="1 to 1024"):
        connect.read_paged(spark, url, page=2000).count()


def test_nearest_records_of_a_service(spark, store):
    url, seen = store
    asked = spark.createDataFrame([("a", [4.2, 1.0]), ("b", [20.0, 1.0]), ("c", None), ("d", [0.0, 0.0])], "query_id string, embedding array<float>").coalesce(1)
    got = {(r.query_id, r.rank): r for r in connect.nearest_remote(asked, url, 3, batch=2).collect()}
    assert {k: r.id for k, r in got.items()} == {("a", 1): "r4", ("a", 2): "r5", ("a", 3): "r3", ("b", 1): "r20", ("b", 2): "r19", ("b", 3): "r21", ("d", 1): "r0", ("d", 2): "r1", ("d", 3): "r2"}
    assert got["a", 1].document == "" and got["a", 2].metadata == "{}" and json.loads(got["a", 3].metadata) == {"doc": 0, "n": 3} and got["d", 2].distance == 2.0
    assert [len(b["query_embeddings"]) for _, b in seen] == [2, 1]
    assert {r.distance for r in connect.nearest_remote(asked, url, 2).collect()} == {0.0}
    assert connect.nearest_remote(asked.limit(0), url).count() == 0


def test_models_of_a_service(spark, store):
    url, _ = store
    models = connect.list_models(spark, url)
    assert [(r.name, r.size, r.details) for r in models.orderBy("name").collect()] == [("m1", 5, '{"family": "x"}'), ("m2", None, "null")]
    shown = {r.name: r for r in connect.show_models(models.union(spark.createDataFrame([(None, 1, "", "")], models.schema)), url).collect()}
    assert json.loads(shown["m1"].shown) == {"about": "m1"} and shown["m2"].shown is None and "404" in shown["m2"].error and len(shown) == 2
