"""Embedding of chunks by pluggable providers, in ordered batches with retries, inside the executors."""

from __future__ import annotations

import hashlib
import json
import math
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.errors import ProviderError, UserError
from sedimenta.plans.embed_plan import DIMENSIONS

#: Texts per call, retries, first wait in seconds (doubled each time), calls at once, statuses worth a retry.
BATCHES = {"openai": 64, "google": 100, "voyage": 128, "cohere": 96, "local": 32, "hash": 64}
RETRIES, WAIT, CONCURRENCY = 5, 0.5, 4
RETRYABLE = frozenset((408, 425, 429))


class Provider(Protocol):
    name: str
    batch: int

    def dimensions(self, model: str) -> int: ...

    def embed(self, texts: list[str], model: str) -> list[list[float]]: ...


@dataclass
class HashProvider:
    """Deterministic vectors from hashed words; for tests and offline runs."""

    dim: int = 64
    name: str = "hash"
    batch: int = BATCHES["hash"]

    def dimensions(self, model: str) -> int:
        return self.dim

    def embed(self, texts: list[str], model: str) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dim
            for word in text.lower().split():
                h = hashlib.blake2b(f"{model}\0{word}".encode(), digest_size=8).digest()
                v[int.from_bytes(h[:4], "big") % self.dim] += 1.0 if h[4] & 1 else -1.0
            norm = math.sqrt(sum(x * x for x in v))
            out.append([x / norm for x in v] if norm else [1.0] + [0.0] * (self.dim - 1))
        return out


@dataclass
class HttpProvider:
    """A provider behind HTTPS: how a request is built and how vectors are read from the answer is given per vendor."""

    name: str
    url: Callable[[str], str]
    headers: dict[str, str]
    request: Callable[[list[str], str], dict]
    read: Callable[[dict], list[list[float]]]
    batch: int = 64
    timeout: float = 60.0

    def dimensions(self, model: str) -> int:
        if model not in DIMENSIONS:
            raise UserError(f"unknown dimensions of model {model}")
        return DIMENSIONS[model]

    def embed(self, texts: list[str], model: str) -> list[list[float]]:
        body = json.dumps(self.request(texts, model)).encode()
        call = urllib.request.Request(self.url(model), data=body, headers={"Content-Type": "application/json", **self.headers})
        try:
            with urllib.request.urlopen(call, timeout=self.timeout) as answer:
                return self.read(json.loads(answer.read()))
        except urllib.error.HTTPError as e:
            raise ProviderError(f"{self.name} answered {e.code}", e.code in RETRYABLE or e.code >= 500, e.code) from None
        except (urllib.error.URLError, TimeoutError, ValueError, KeyError) as e:
            raise ProviderError(f"{self.name}: {type(e).__name__}", True) from None


def _by_index(data: list[dict]) -> list[list[float]]:
    return [x["embedding"] for x in sorted(data, key=lambda x: x["index"])]


def provider(name: str, key: str | None = None, dim: int = 64) -> Provider:
    """A provider by name: openai, google, voyage, cohere (with a key) or hash."""
    if name == "hash":
        return HashProvider(dim)
    if name not in BATCHES or name == "local":
        raise UserError(f"no provider named {name}")
    if not key:
        raise UserError(f"{name} needs a key")
    bearer = {"Authorization": f"Bearer {key}"}
    made = {
        "openai": lambda: (lambda m: "https://api.openai.com/v1/embeddings", bearer, lambda t, m: {"model": m, "input": t}, lambda a: _by_index(a["data"])),
        "voyage": lambda: (lambda m: "https://api.voyageai.com/v1/embeddings", bearer, lambda t, m: {"model": m, "input": t, "input_type": "document"}, lambda a: _by_index(a["data"])),
        "cohere": lambda: (lambda m: "https://api.cohere.com/v2/embed", bearer, lambda t, m: {"model": m, "texts": t, "input_type": "search_document", "embedding_types": ["float"]}, lambda a: a["embeddings"]["float"]),
        "google": lambda: (
            lambda m: f"https://generativelanguage.googleapis.com/v1beta/models/{m}:batchEmbedContents",
            {"x-goog-api-key": key},
            lambda t, m: {"requests": [{"model": f"models/{m}", "content": {"parts": [{"text": x}]}} for x in t]},
            lambda a: [x["values"] for x in a["embeddings"]],
        ),
    }[name]()
    return HttpProvider(name, *made, batch=BATCHES[name])


def with_retries(call: Callable[[], list], retries: int = RETRIES, wait: float = WAIT, sleep: Callable[[float], None] = time.sleep) -> list:
    """``call`` with doubling waits after failures; an error that says it isn't retryable ends at once."""
    for attempt in range(retries + 1):
        try:
            return call()
        except Exception as e:
            if attempt == retries or getattr(e, "retryable", True) is False:
                raise
            sleep(wait * 2**attempt)
    raise AssertionError


def embed_texts(texts: list[str], source: Provider, model: str, dim: int, concurrency: int = CONCURRENCY, retries: int = RETRIES, wait: float = WAIT) -> list[list[float]]:
    """Vectors in the order of the texts; some batches are in flight at once; counts and dimensions are checked."""

    def one(part: list[str]) -> list[list[float]]:
        got = with_retries(lambda: source.embed(part, model), retries, wait)
        if len(got) != len(part):
            raise ProviderError(f"{source.name} gave {len(got)} vectors for {len(part)} texts")
        if bad := next((len(v) for v in got if len(v) != dim), None):
            raise ProviderError(f"{source.name} gave a vector of {bad} dimensions, not {dim}")
        return got

    parts = [texts[i : i + source.batch] for i in range(0, len(texts), source.batch)]
    if len(parts) < 2 or concurrency < 2:
        return [v for p in parts for v in one(p)]
    with ThreadPoolExecutor(concurrency) as pool:
        return [v for got in pool.map(one, parts) for v in got]


def embed_chunks(chunks: DataFrame, source: Provider, model: str, **options) -> DataFrame:
    """``chunks`` with ``vector, model, dim``; partitions embed in parallel, nothing is shuffled.

    Tasks that run again call the provider again, which is safe because ids don't change and writes
    are upserts.  An empty table calls no provider.
    """
    dim = source.dimensions(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields)
    at = chunks.columns.index("text")

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = embed_texts(batch.column(at).to_pylist(), source, model, dim, **options) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.list_(pa.float32())), pa.array([model] * len(got), pa.string()), pa.array([dim] * len(got), pa.int32())], [*batch.schema.names, "vector", "model", "dim"])

    return chunks.mapInArrow(embed, f"{fields}, vector array<float>, model string, dim int")


def batch_numbers(chunks: DataFrame, size: int) -> DataFrame:
    """Adds batch_no: consecutive batches of ``size`` chunks within each source, in the order of chunk_index."""
    return chunks.withColumn("batch_no", F.floor(F.col("chunk_index") / size).cast("int"))
