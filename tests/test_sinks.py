"""Vector databases against a local server that answers as they do."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from sedimenta.errors import CollectionError, IntegrityError, UserError
from sedimenta.operators import embedding, sinks
from sedimenta.operators.collection import ROWS
from sedimenta.plans.config import Config


class Server:
    """Keeps points by vendor and collection; ``fail`` answers that many writes with an error first."""

    def __init__(self):
        self.points, self.made, self.calls, self.fail, self.status = {}, {}, [], 0, 503
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *args):
                pass

            def handle_any(self):
                size = int(self.headers.get("Content-Length") or 0)
                body = json.loads(self.rfile.read(size)) if size else None
                outer.calls.append((self.command, self.path, body, dict(self.headers)))
                if self.command != "GET" and outer.fail > 0:
                    outer.fail -= 1
                    status, answer = outer.status, {}
                else:
                    status, answer = outer.answer(self.command, self.path.split("?")[0], body)
                raw = json.dumps(answer).encode()
                self.send_response(status)
                self.send_header("Content-Length", str(len(raw)))
                self.end_headers()
                self.wfile.write(raw)

            do_GET = do_PUT = do_POST = handle_any

        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.http.server_address[1]}"
        threading.Thread(target=self.http.serve_forever, daemon=True).start()

    def answer(self, method, path, body):
        parts = path.strip("/").split("/")
        if parts[0] == "collections":  # qdrant
            name = parts[1]
            if len(parts) == 2 and method == "GET":
                return (200, {"result": {"config": {"params": {"vectors": {"size": self.made[name]}}}}}) if name in self.made else (404, {})
            if len(parts) == 2:
                self.made[name] = body["vectors"]["size"]
            elif parts[-1] == "points":
                self.points.update({p["id"]: (p["vector"], p["payload"]) for p in body["points"]})
            elif parts[-1] == "batch":
                for o in body["operations"]:
                    for i in o["overwrite_payload"]["points"]:
                        self.points[i] = (self.points[i][0], o["overwrite_payload"]["payload"])
            else:
                for i in body["points"]:
                    self.points.pop(i, None)
        elif parts[0] == "indexes":  # pinecone, control
            if method == "GET":
                return (200, {"dimension": self.made[parts[1]], "host": self.url, "status": {"ready": True}}) if parts[1] in self.made else (404, {})
            self.made[body["name"]] = body["dimension"]
        elif parts[0] == "vectors":
            if parts[1] == "upsert":
                self.points.update({p["id"]: (p["values"], p["metadata"]) for p in body["vectors"]})
            elif parts[1] == "update":
                self.points[body["id"]] = (self.points[body["id"]][0], body["setMetadata"])
            else:
                for i in body["ids"]:
                    self.points.pop(i, None)
        else:  # chroma
            rest = parts[parts.index("collections") + 1 :]
            if method == "GET":
                return (200, {"id": "id-" + rest[0]}) if rest[0] in self.made else (404, {})
            if not rest:
                self.made[body["name"]] = body["metadata"]["dim"]
            elif rest[1] == "upsert":
                self.points.update({i: (v, {"document": d, **m}) for i, v, d, m in zip(body["ids"], body["embeddings"], body["documents"], body["metadatas"])})
            elif rest[1] == "update":
                for i, d, m in zip(body["ids"], body["documents"], body["metadatas"]):
                    self.points[i] = (self.points[i][0], {"document": d, **m})
            else:
                for i in body["ids"]:
                    self.points.pop(i, None)
        return 200, {}


@pytest.fixture
def server(monkeypatch):
    monkeypatch.setattr(embedding, "WAIT", 0.01)
    s = Server()
    yield s
    s.http.shutdown()


META = '{"path":["A","B"],"n":1,"o":{"x":[1]},"none":null}'


def rows(spark, n, text="t"):
    return spark.createDataFrame([(f"{k:016x}", [float(k), 0.5], f"{text}{k}", META) for k in range(n)], ROWS)


def stores(spark, url):
    return {"qdrant": sinks.Qdrant(url, "secret"), "pinecone": sinks.Pinecone("secret", control=url), "chroma": sinks.Chroma(url)}


@pytest.mark.parametrize("name", ("qdrant", "pinecone", "chroma"))
def test_contract(spark, server, name):
    store = sinks.RemoteCollections(spark, stores(spark, server.url)[name])
    assert store.describe("kb") is None
    store.ensure("kb", 2)
    store.ensure("kb", 2)
    assert store.describe("kb") == {"dim": 0 if name == "chroma" else 2}
    if name != "chroma":
        with pytest.raises(IntegrityError):
            store.ensure("kb", 3)
    store.apply("kb", rows(spark, 450))
    store.apply("kb", rows(spark, 450))
    assert len(server.points) == 450, "writing again changes nothing"
    writes = [b for m, p, b, _ in server.calls if b and ("upsert" in p or p.split("?")[0].endswith("/points"))]
    assert max(len(b.get("points") or b.get("vectors") or b.get("ids")) for b in writes) <= sinks.BATCHES[name]
    ids = rows(spark, 10).select("chunk_id")
    store.apply("kb", rows(spark, 1, "new"), ids)
    assert len(server.points) == 441, "an id that is written and deleted stays"
    key = sinks.point_id("0" * 16) if name == "qdrant" else "0" * 16
    vector, payload = server.points[key]
    assert vector == [0.0, 0.5]
    want = {"qdrant": {"path": ["A", "B"], "n": 1, "o": {"x": [1]}, "none": None, "_text": "new0", "_chunkId": "0" * 16}, "pinecone": {"path": ["A", "B"], "n": 1, "o": '{"x":[1]}', "_text": "new0"}, "chroma": {"path": "A/B", "n": 1, "o": '{"x":[1]}', "document": "new0"}}
    assert payload == want[name]
    store.restamp("kb", rows(spark, 1, "stamped").select("chunk_id", "content", "metadata"))
    assert server.points[key][0] == [0.0, 0.5] and "stamped0" in server.points[key][1].values()
    if name != "chroma":
        assert all(h.get("api-key", h.get("Api-Key")) == "secret" for *_, h in server.calls)
    store.apply("kb", rows(spark, 0), rows(spark, 0).select("chunk_id"))


def test_failures(spark, server):
    store = sinks.RemoteCollections(spark, sinks.Qdrant(server.url))
    store.ensure("kb", 2)
    server.fail = 2
    store.apply("kb", rows(spark, 3).coalesce(1))
    assert len(server.points) == 3, "a busy server is asked again"
    server.fail, server.status = 99, 400
    before = len(server.calls)
    with pytest.raises(CollectionError):
        sinks.send(sinks.Request("PUT", f"{server.url}/collections/kb", {}), {})
    assert len(server.calls) == before + 1, "a refusal isn't"
    with pytest.raises(CollectionError):
        sinks.RemoteCollections(spark, sinks.Chroma(server.url)).apply("none", rows(spark, 1))


class Database:
    """A connection that writes down what it is asked; vectors of 2 dimensions."""

    def __init__(self, log, dim):
        self.log, self.dim = log, dim

    def cursor(self):
        return self

    def execute(self, statement, values):
        with open(self.log, "a") as f:
            f.write(json.dumps([statement, values]) + "\n")

    def fetchall(self):
        return [] if self.dim is None else [(self.dim,)]

    def commit(self):
        pass

    close = commit


def test_pgvector(spark, tmp_path):
    log = str(tmp_path / "log")
    store = sinks.Pgvector(spark, lambda: Database(log, None))
    store.ensure("my-kb", 2)
    store.apply("my-kb", rows(spark, 3).coalesce(1), rows(spark, 5).select("chunk_id"))
    store.restamp("my-kb", rows(spark, 1).select("chunk_id", "content", "metadata"))
    asked = [json.loads(x) for x in open(log)]
    create = next(s for s, _ in asked if s.startswith("CREATE"))
    assert '"my_kb"' in create and "vector(2)" in create
    insert, values = next(x for x in asked if x[0].startswith("INSERT"))
    assert insert.count("::vector") == 3 and "ON CONFLICT (id) DO UPDATE" in insert and values[1] == "[0.0,0.5]"
    assert sorted(i for s, v in asked if s.startswith("DELETE") for i in v[0]) == [f"{k:016x}" for k in (3, 4)]
    assert any(s.startswith("UPDATE") for s, _ in asked)
    known = sinks.Pgvector(spark, lambda: Database(log, 3))
    assert known.describe("kb") == {"dim": 3}
    with pytest.raises(IntegrityError):
        known.ensure("kb", 2)
    with pytest.raises(UserError):
        store.table("x; drop")
    bad = spark.createDataFrame([("a", [float("nan")], "t", "{}")], ROWS)
    with pytest.raises(Exception, match="finite"):
        store.apply("kb", bad)


def test_registry(spark, tmp_path):
    config = Config(str(tmp_path / "none.json"))
    config.set("dbs.qdrant.url", "http://q:1/")
    made = lambda db, **env: sinks.collections(spark, db, env, config, str(tmp_path))
    assert made("parquet").name == "parquet" and made("qdrant").vendor.url == "http://q:1" and made("qdrant", QDRANT_URL="http://e:2").vendor.url == "http://e:2"
    assert made("chroma").vendor.base.startswith("http://localhost:8000/") and made("pinecone", PINECONE_API_KEY="k").name == "pinecone"
    for db in ("pinecone", "pgvector", "other"):
        with pytest.raises(UserError):
            made(db)
