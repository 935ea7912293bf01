"""Vector databases over the network, with the contract of a collection: describe, ensure, apply, restamp.

Executors write where the rows lie, in batches with retries; writes are upserts by id, so that a task that
runs again changes nothing.  Vendors differ in their requests only.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sedimenta.errors import CollectionError, IntegrityError, UserError
from sedimenta.operators.collection import ParquetCollections
from sedimenta.operators.embedding import RETRYABLE, with_retries

#: Rows per request, and the keys under which text and chunk id are stored.
BATCHES = {"qdrant": 200, "pinecone": 100, "chroma": 200, "pgvector": 200}
TEXT_KEY, ID_KEY = "_text", "_chunkId"
#: Seconds that a new index is waited for, in steps.
READY, STEP = 120.0, 1.0


def point_id(chunk_id: str) -> str:
    """A chunk id twice over in the shape of a UUID."""
    d = chunk_id * 2
    return f"{d[:8]}-{d[8:12]}-{d[12:16]}-{d[16:20]}-{d[20:32]}"


def flat(meta: dict) -> dict:
    """Plain values only: arrays joined by slashes, objects as JSON, nulls left out."""
    out = {}
    for k, v in meta.items():
        if v is not None:
            out[k] = "/".join("" if x is None else x if isinstance(x, str) else json.dumps(x) for x in v) if isinstance(v, list) else json.dumps(v, separators=(",", ":")) if isinstance(v, dict) else v
    return out


def listed(meta: dict) -> dict:
    """Plain values and arrays of strings (other arrays become such); objects as JSON, nulls left out."""
    out = {}
    for k, v in meta.items():
        if v is not None:
            out[k] = [x if isinstance(x, str) else json.dumps(x) for x in v] if isinstance(v, list) else json.dumps(v, separators=(",", ":")) if isinstance(v, dict) else v
    return out


@dataclass(frozen=True)
class Request:
    method: str
    url: str
    body: object = None


def send(request: Request, headers: dict[str, str], timeout: float = 60.0, missing_ok: bool = False):
    """The answer as JSON; None for what isn't there if that is no error."""

    def once():
        data = None if request.body is None else json.dumps(request.body).encode()
        call = urllib.request.Request(request.url, data, {"Content-Type": "application/json", **headers}, method=request.method)
        try:
            with urllib.request.urlopen(call, timeout=timeout) as answer:
                raw = answer.read()
                return [json.loads(raw) if raw else {}]
        except urllib.error.HTTPError as e:
            if e.code == 404 and missing_ok:
                return [None]
            error = CollectionError(f"{request.method} {urllib.parse.urlsplit(request.url).path} answered {e.code}")
            error.retryable = e.code in RETRYABLE or e.code >= 500
            raise error from None
        except (urllib.error.URLError, TimeoutError, ValueError) as e:
            raise CollectionError(f"{request.method} {urllib.parse.urlsplit(request.url).path}: {type(e).__name__}") from None

    return with_retries(once)[0]


class Qdrant:
    """Collections of cosine distance; ids in the shape of UUIDs, text and chunk id in the payload."""

    name = "qdrant"

    def __init__(self, url: str, key: str | None = None):
        self.url, self.headers = url.rstrip("/"), {"api-key": key} if key else {}

    def _at(self, collection: str, rest: str = "") -> str:
        return f"{self.url}/collections/{urllib.parse.quote(collection, safe='')}{rest}"

    def describe(self, collection: str) -> dict | None:
        got = send(Request("GET", self._at(collection)), self.headers, missing_ok=True)
        if got is None:
            return None
        vectors = (((got.get("result") or {}).get("config") or {}).get("params") or {}).get("vectors") or {}
        if "size" not in vectors:  # named vectors: the first counts
            vectors = next((v for v in vectors.values() if isinstance(v, dict)), {})
        return {"dim": vectors.get("size") or 0}

    def create(self, collection: str, dim: int) -> None:
        send(Request("PUT", self._at(collection), {"vectors": {"size": dim, "distance": "Cosine"}}), self.headers)

    def target(self, collection: str) -> str:
        return self._at(collection)

    def _payload(self, row: dict) -> dict:
        return {**row["metadata"], TEXT_KEY: row["content"], ID_KEY: row["chunk_id"]}

    def upsert(self, target: str, rows: list[dict]) -> list[Request]:
        return [Request("PUT", f"{target}/points?wait=true", {"points": [{"id": point_id(r["chunk_id"]), "vector": r["vector"], "payload": self._payload(r)} for r in rows]})]

    def stamp(self, target: str, rows: list[dict]) -> list[Request]:
        return [Request("POST", f"{target}/points/batch?wait=true", {"operations": [{"overwrite_payload": {"payload": self._payload(r), "points": [point_id(r["chunk_id"])]}} for r in rows]})]

    def delete(self, target: str, ids: list[str]) -> list[Request]:
        return [Request("POST", f"{target}/points/delete?wait=true", {"points": [point_id(i) for i in ids]})]


class Pinecone:
    """Serverless indices of cosine distance; text among the metadata."""

    name = "pinecone"

    def __init__(self, key: str, cloud: str = "aws", region: str = "us-east-1", control: str = "https://api.pinecone.io"):
        self.headers, self.cloud, self.region, self.control = {"Api-Key": key, "X-Pinecone-API-Version": "2025-01"}, cloud, region, control.rstrip("/")

    def _index(self, collection: str) -> dict | None:
        return send(Request("GET", f"{self.control}/indexes/{urllib.parse.quote(collection, safe='')}"), self.headers, missing_ok=True)

    def describe(self, collection: str) -> dict | None:
        got = self._index(collection)
        return None if got is None else {"dim": got.get("dimension") or 0}

    def create(self, collection: str, dim: int) -> None:
        spec = {"serverless": {"cloud": self.cloud, "region": self.region}}
        send(Request("POST", f"{self.control}/indexes", {"name": collection, "dimension": dim, "metric": "cosine", "spec": spec}), self.headers)
        until = time.monotonic() + READY
        while not (((self._index(collection) or {}).get("status") or {}).get("ready")):
            if time.monotonic() > until:
                raise CollectionError(f"index {collection} isn't ready")
            time.sleep(STEP)

    def target(self, collection: str) -> str:
        host = (self._index(collection) or {}).get("host")
        if not host:
            raise CollectionError(f"no index {collection}")
        return host if "://" in host else f"https://{host}"

    @staticmethod
    def _metadata(row: dict) -> dict:
        return {**listed(row["metadata"]), TEXT_KEY: row["content"]}

    def upsert(self, target: str, rows: list[dict]) -> list[Request]:
        return [Request("POST", f"{target}/vectors/upsert", {"vectors": [{"id": r["chunk_id"], "values": r["vector"], "metadata": self._metadata(r)} for r in rows]})]

    def stamp(self, target: str, rows: list[dict]) -> list[Request]:
        return [Request("POST", f"{target}/vectors/update", {"id": r["chunk_id"], "setMetadata": self._metadata(r)}) for r in rows]

    def delete(self, target: str, ids: list[str]) -> list[Request]:
        return [Request("POST", f"{target}/vectors/delete", {"ids": ids})]


class Chroma:
    """Collections by name; texts as documents, flat metadata.  The server doesn't tell a collection's dimensions: 0, unknown."""

    name = "chroma"

    def __init__(self, url: str, tenant: str = "default_tenant", database: str = "default_database"):
        self.base, self.headers = f"{url.rstrip('/')}/api/v2/tenants/{tenant}/databases/{database}/collections", {}

    def _found(self, collection: str) -> dict | None:
        return send(Request("GET", f"{self.base}/{urllib.parse.quote(collection, safe='')}"), self.headers, missing_ok=True)

    def describe(self, collection: str) -> dict | None:
        return None if self._found(collection) is None else {"dim": 0}

    def create(self, collection: str, dim: int) -> None:
        send(Request("POST", self.base, {"name": collection, "get_or_create": True, "metadata": {"dim": dim}}), self.headers)

    def target(self, collection: str) -> str:
        found = self._found(collection)
        if found is None:
            raise CollectionError(f"no collection {collection}")
        return f"{self.base}/{found['id']}"

    def upsert(self, target: str, rows: list[dict]) -> list[Request]:
        columns = {"ids": [r["chunk_id"] for r in rows], "embeddings": [r["vector"] for r in rows]}
        return [Request("POST", f"{target}/upsert", {**columns, **self._texts(rows)})]

    def stamp(self, target: str, rows: list[dict]) -> list[Request]:
        return [Request("POST", f"{target}/update", {"ids": [r["chunk_id"] for r in rows], **self._texts(rows)})]

    @staticmethod
    def _texts(rows: list[dict]) -> dict:
        return {"documents": [r["content"] for r in rows], "metadatas": [flat(r["metadata"]) for r in rows]}

    def delete(self, target: str, ids: list[str]) -> list[Request]:
        return [Request("POST", f"{target}/delete", {"ids": ids})]


class RemoteCollections:
    """A vendor's collections under the contract of the pipeline."""

    def __init__(self, spark: SparkSession, vendor):
        self.spark, self.vendor, self.name = spark, vendor, vendor.name

    def describe(self, collection: str) -> dict | None:
        return self.vendor.describe(collection)

    def ensure(self, collection: str, dim: int) -> None:
        """Create the collection, or check its dimensions where they are known."""
        known = self.describe(collection)
        if known is None:
            self.vendor.create(collection, dim)
        elif known["dim"] not in (0, dim):
            raise IntegrityError(f"collection {collection} holds vectors of {known['dim']} dimensions, not {dim}")

    def _run(self, rows: DataFrame, make: Callable[[list], list[Request]], column: str | None = None) -> int:
        headers, size = self.vendor.headers, BATCHES[self.name]

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = 0
            for batch in batches:
                for start in range(0, batch.num_rows, size):
                    part = batch.slice(start, size)
                    items = part.column(0).to_pylist() if column else [{**r, "metadata": json.loads(r["metadata"] or "{}")} for r in part.to_pylist()]
                    for request in make(items):
                        send(request, headers)
                    n += len(items)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

        return rows.mapInArrow(write, "n long").agg({"n": "sum"}).head()[0] or 0

    def apply(self, collection: str, rows: DataFrame, gone: DataFrame | None = None) -> None:
        """Upsert ``rows`` (chunk_id, vector, content, metadata), then delete the ids in ``gone``; an id in both stays."""
        vendor, target = self.vendor, self.vendor.target(collection)
        self._run(rows.select("chunk_id", "vector", "content", "metadata"), lambda items: vendor.upsert(target, items))
        if gone is not None:
            ids = gone.select("chunk_id").join(rows.select("chunk_id"), "chunk_id", "left_anti")
            self._run(ids, lambda items: vendor.delete(target, items), "chunk_id")

    def restamp(self, collection: str, rows: DataFrame) -> None:
        """Give stored ids (chunk_id, content, metadata) new content and metadata, with the vectors that they have."""
        vendor, target = self.vendor, self.vendor.target(collection)
        self._run(rows.select("chunk_id", "content", "metadata"), lambda items: vendor.stamp(target, items))

    def expire(self, collection: str, keep: int = 2) -> int:
        return 0


class Pgvector:
    """Tables of PostgreSQL with vectors, through a driver of the Python database API (``connect`` makes a connection in each task)."""

    name = "pgvector"

    def __init__(self, spark: SparkSession, connect: Callable[[], object]):
        self.spark, self.connect = spark, connect

    @staticmethod
    def table(collection: str) -> str:
        name = collection.replace("-", "_")
        if not re.fullmatch("[a-z_][a-z0-9_]*", name):
            raise UserError(f"invalid table name {collection!r}")
        return f'"{name}"'

    @staticmethod
    def _ask(connect, statement: str, values: list, fetch: bool = False):
        db = connect()
        try:
            cursor = db.cursor()
            cursor.execute(statement, values)
            rows = cursor.fetchall() if fetch else None
            db.commit()
            return rows
        except Exception as e:
            raise CollectionError(f"pgvector: {e}") from None
        finally:
            db.close()

    def describe(self, collection: str) -> dict | None:
        found = "SELECT a.atttypmod FROM pg_attribute a JOIN pg_class t ON t.oid = a.attrelid WHERE t.relname = %s AND a.attname = 'embedding'"
        rows = self._ask(self.connect, found, [self.table(collection).strip('"')], True)
        return {"dim": max(0, rows[0][0] or 0)} if rows else None

    def ensure(self, collection: str, dim: int) -> None:
        known = self.describe(collection)
        if known is None:
            self._ask(self.connect, f"CREATE TABLE IF NOT EXISTS {self.table(collection)} (id text PRIMARY KEY, embedding vector({int(dim)}) NOT NULL, content text NOT NULL, metadata jsonb NOT NULL DEFAULT '{{}}')", [])
        elif known["dim"] not in (0, dim):
            raise IntegrityError(f"table {collection} holds vectors of {known['dim']} dimensions, not {dim}")

    def _run(self, rows: DataFrame, statement: Callable[[list[dict]], tuple[str, list]]) -> None:
        connect, ask, size = self.connect, self._ask, BATCHES[self.name]

        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = 0
            for batch in batches:
                for start in range(0, batch.num_rows, size):
                    items = batch.slice(start, size).to_pylist()
                    ask(connect, *statement(items))
                    n += len(items)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

        rows.mapInArrow(write, "n long").agg({"n": "sum"}).head()

    def apply(self, collection: str, rows: DataFrame, gone: DataFrame | None = None) -> None:
        """Upsert ``rows``, then delete the ids in ``gone``; an id in both stays, a value that isn't finite is an error."""
        table = self.table(collection)

        def insert(items: list[dict]) -> tuple[str, list]:
            values: list = []
            for r in items:
                if any(x is None or x - x != 0 for x in r["vector"]):
                    raise IntegrityError(f"the vector of {r['chunk_id']} isn't finite")
                values += [r["chunk_id"], "[" + ",".join(map(repr, r["vector"])) + "]", r["content"], r["metadata"] or "{}"]
            places = ", ".join(["(%s, %s::vector, %s, %s::jsonb)"] * len(items))
            return f"INSERT INTO {table} (id, embedding, content, metadata) VALUES {places} ON CONFLICT (id) DO UPDATE SET embedding = excluded.embedding, content = excluded.content, metadata = excluded.metadata", values

        self._run(rows.select("chunk_id", "vector", "content", "metadata"), insert)
        if gone is not None:
            ids = gone.select("chunk_id").join(rows.select("chunk_id"), "chunk_id", "left_anti")
            self._run(ids, lambda items: (f"DELETE FROM {table} WHERE id = ANY(%s)", [[r["chunk_id"] for r in items]]))

    def restamp(self, collection: str, rows: DataFrame) -> None:
        table = self.table(collection)

        def update(items: list[dict]) -> tuple[str, list]:
            places = ", ".join(["(%s, %s, %s::jsonb)"] * len(items))
            return f"UPDATE {table} AS t SET content = n.content, metadata = n.metadata FROM (VALUES {places}) AS n(id, content, metadata) WHERE t.id = n.id", [x for r in items for x in (r["chunk_id"], r["content"], r["metadata"] or "{}")]

        self._run(rows.select("chunk_id", "content", "metadata"), update)

    def expire(self, collection: str, keep: int = 2) -> int:
        return 0


def _postgres(url: str) -> Callable[[], object]:
    try:
        import psycopg  # noqa: F401
    except ImportError:
        raise UserError("pgvector needs the driver psycopg") from None

    def connect():
        import psycopg

        return psycopg.connect(url)

    return connect


def collections(spark: SparkSession, db: str, env: dict, config, root: str = "vectors"):
    """The store named ``db``: its address and key from the environment, then the configuration, then the default."""
    pick = lambda name, path, default=None: env.get(name) or config.get(path) or default
    if db == "parquet":
        return ParquetCollections(spark, root)
    if db == "qdrant":
        return RemoteCollections(spark, Qdrant(pick("QDRANT_URL", "dbs.qdrant.url", "http://localhost:6333"), pick("QDRANT_API_KEY", "apiKeys.qdrant")))
    if db == "chroma":
        return RemoteCollections(spark, Chroma(pick("CHROMA_URL", "dbs.chroma.url", "http://localhost:8000")))
    if db == "pinecone":
        key = pick("PINECONE_API_KEY", "apiKeys.pinecone")
        if not key:
            raise UserError("pinecone needs a key: set PINECONE_API_KEY")
        return RemoteCollections(spark, Pinecone(key))
    if db == "pgvector":
        url = pick("DATABASE_URL", "dbs.pgvector.url")
        if not url:
            raise UserError("pgvector needs an address: set DATABASE_URL")
        return Pgvector(spark, _postgres(url))
    raise UserError(f"no vector database named {db}")
