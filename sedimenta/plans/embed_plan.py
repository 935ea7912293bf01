"""Plans: how a source is split, where its vectors go; heuristics, overrides, hashes, prices."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.errors import ProviderError, UserError
from sedimenta.functions.jstext import canonical

#: Splitter by extension, code language by extension.
SPLITTERS = {
    **dict.fromkeys(("md", "mdx", "markdown", "docx"), "markdown"), "pdf": "pdf", "html": "html", "htm": "html", "csv": "csv",
    **dict.fromkeys(("json", "txt", "text", "log"), "recursive"), "jsonl": "jsonl", "ndjson": "jsonl",
    **dict.fromkeys(("ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "go", "rs", "java"), "code"),
}
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "go": "go", "rs": "rust", "java": "java"}
NAMES = ("recursive", "markdown", "pdf", "html", "code", "jsonl", "csv")
#: Default sizes in tokens; records are kept whole up to a larger size.
SIZE, OVERLAP, RECORD_SIZE = 800, 100, 4096
COLLECTION = re.compile(r"[a-z0-9][a-z0-9_-]*\Z")
#: Dimensions of models; USD per million tokens; default model per provider.
DIMENSIONS = {
    "text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536, "gemini-embedding-001": 3072, "voyage-3": 1024, "voyage-3-lite": 512,
    "embed-english-v3.0": 1024, "embed-multilingual-v3.0": 1024, "bge-small-en-v1.5": 384, "bge-base-en-v1.5": 768, "bge-small-en": 384, "bge-base-en": 768, "all-MiniLM-L6-v2": 384, "multilingual-e5-large": 1024,
}
PRICES = {
    "text-embedding-3-small": 0.02, "text-embedding-3-large": 0.13, "text-embedding-ada-002": 0.10, "gemini-embedding-001": 0.15, "voyage-3": 0.06, "voyage-3-lite": 0.02, "embed-english-v3.0": 0.10, "embed-multilingual-v3.0": 0.10,
    **dict.fromkeys(("bge-small-en-v1.5", "bge-base-en-v1.5", "bge-small-en", "bge-base-en", "all-MiniLM-L6-v2", "multilingual-e5-large"), 0.0),
}
DEFAULT_MODELS = {"openai": "text-embedding-3-small", "google": "gemini-embedding-001", "voyage": "voyage-3", "cohere": "embed-english-v3.0", "local": "bge-small-en-v1.5"}


@dataclass(frozen=True)
class EmbedPlan:
    splitter: str
    chunk_size: int
    overlap: int
    collection: str
    embedding_model: str
    metadata: dict[str, str] = field(default_factory=dict)
    version: int = 1

    def __post_init__(self):
        problems = [
            (self.version != 1, "version must be 1"),
            (self.splitter not in NAMES, f"splitter must be one of {', '.join(NAMES)}"),
            (self.chunk_size <= 0, "chunk size must be positive"),
            (self.overlap < 0 or self.overlap >= self.chunk_size > 0, "overlap must be at least 0 and below the chunk size"),
            (not COLLECTION.match(self.collection), f"collection {self.collection!r} must match {COLLECTION.pattern[:-2]}"),
            (not self.embedding_model, "a model is needed"),
        ]
        if found := [text for wrong, text in problems if wrong]:
            raise UserError("; ".join(found))

    def to_json(self) -> str:
        return canonical({"version": self.version, "splitter": self.splitter, "chunkSize": self.chunk_size, "overlap": self.overlap, "metadata": self.metadata, "collection": self.collection, "embeddingModel": self.embedding_model})

    @property
    def hash(self) -> str:
        """SHA-256 of the canonical JSON."""
        return hashlib.sha256(self.to_json().encode()).hexdigest()


def content_extension(path: str) -> str:
    """Lower-case extension without dot; a numeric download suffix gives way to the extension before it, if that is known."""
    name = os.path.basename(path)
    ext = os.path.splitext(name)[1][1:].lower()
    if ext.isascii() and ext.isdigit():
        before = os.path.splitext(os.path.splitext(name)[0])[1][1:].lower()
        if before in SPLITTERS:
            return before
    return ext


def slug(path: str) -> str:
    base = os.path.splitext(os.path.basename(path))[0].lower()
    out = re.sub(r"^[^a-z0-9]+", "", re.sub(r"^-+|-+$", "", re.sub(r"[^a-z0-9_-]+", "-", base)))
    return out or "default"


def heuristic_plan(path: str, model: str, **overrides) -> EmbedPlan:
    """The plan a path suggests; ``overrides`` (splitter, chunk_size, overlap, collection, metadata) win."""
    given = {k: v for k, v in overrides.items() if v is not None}
    splitter = given.pop("splitter", None) or SPLITTERS.get(content_extension(path), "recursive")
    size = given.pop("chunk_size", None) or (RECORD_SIZE if splitter in ("csv", "jsonl") else SIZE)
    overlap = given.pop("overlap", min(OVERLAP, size - 1))
    return EmbedPlan(splitter, size, overlap, given.pop("collection", None) or slug(path), model, **given)


def load_plan(text: str) -> EmbedPlan:
    try:
        raw = json.loads(text)
        return EmbedPlan(raw["splitter"], raw["chunkSize"], raw["overlap"], raw["collection"], raw["embeddingModel"], raw.get("metadata") or {}, raw.get("version", 1))
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise UserError(f"invalid plan: {e}") from None


def merge_plan(saved: EmbedPlan, **overrides) -> EmbedPlan:
    """A saved plan with explicit overrides; metadata are merged, the override winning per key."""
    given = {k: v for k, v in overrides.items() if v is not None}
    if "metadata" in given:
        given["metadata"] = {**saved.metadata, **given["metadata"]}
    return replace(saved, **given)


def parse_metadata(text: str) -> dict[str, str]:
    """``k=v,k2=v2``: the first equals sign parts key and value."""
    out = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        key, sign, value = part.partition("=")
        if not sign or not key.strip():
            raise UserError(f"metadata {part!r} isn't of the form key=value")
        out[key.strip()] = value.strip()
    return out


def model_plan(sample: str, path: str, model: str, ask: Callable[[str], str]) -> EmbedPlan:
    """A plan proposed by a language model: ``ask`` maps a prompt to its answer; one retry names the error."""
    shape = '{"splitter": one of %s, "chunkSize": 64..4096, "overlap": up to a quarter of chunkSize, "collection": kebab-case name}' % "/".join(NAMES)
    prompt = f"Choose how to split this document for retrieval. Answer with JSON only: {shape}\nPath: {path}\nSample:\n{sample[:4096]}"
    problem = ""
    for _ in range(2):
        answer = ask(prompt + (f"\nThe last answer was refused: {problem}" if problem else ""))
        body = re.sub(r"^\s*```[a-z]*\s*|\s*```\s*$", "", answer)
        try:
            raw = json.loads(body)
            if not 64 <= raw["chunkSize"] <= 4096:
                raise UserError("chunkSize must be 64..4096")
            return EmbedPlan(raw["splitter"], raw["chunkSize"], raw["overlap"], raw["collection"], model, raw.get("metadata") or {})
        except (ValueError, KeyError, TypeError, UserError) as e:
            problem = str(e)
    raise ProviderError(f"no valid plan proposed: {problem}")


def plan_dict(plan: EmbedPlan) -> dict:
    return asdict(plan)


# -- as columns ----------------------------------------------------------------------------------


def extension_column(path: str) -> Column:
    """``content_extension`` of a path column."""
    name = F.regexp_extract(F.col(path), r"([^/]*)$", 1)
    ext = F.lower(F.regexp_extract(name, r"[^.]\.([^.]*)$", 1))
    before = F.lower(F.regexp_extract(name, r"[^.]\.([^.]+)\.[0-9]+$", 1))
    return F.when(ext.rlike("^[0-9]+$") & before.isin(*SPLITTERS), before).otherwise(ext)


def splitter_column(ext: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SPLITTERS.items() for x in kv])
    return F.coalesce(table[ext], F.lit("recursive"))


def size_column(splitter: Column) -> Column:
    return F.when(splitter.isin("csv", "jsonl"), RECORD_SIZE).otherwise(SIZE)


def slug_column(path: str) -> Column:
    """``slug`` of a path column."""
    base = F.lower(F.regexp_replace(F.regexp_extract(F.col(path), r"([^/]*)$", 1), r"(?<=[^.])\.[^.]*$", ""))
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(base, r"[^a-z0-9_-]+", "-"), r"^-+|-+$", ""), r"^[^a-z0-9]+", "")
    return F.when(out == "", "default").otherwise(out)


def plans_of(paths: DataFrame, path: str = "source_path") -> DataFrame:
    """``source_path, extension, splitter, chunk_size, overlap, collection``: heuristic plans of distinct paths; a null path has the plan of an unknown file."""
    return (
        paths.select(F.col(path).alias("source_path"))
        .distinct()
        .select("source_path", F.coalesce(extension_column("source_path"), F.lit("")).alias("extension"))
        .withColumn("splitter", splitter_column(F.col("extension")))
        .select("source_path", "extension", "splitter", size_column(F.col("splitter")).alias("chunk_size"), F.lit(OVERLAP).alias("overlap"), F.coalesce(slug_column("source_path"), F.lit("default")).alias("collection"))
    )


def cost_usd(tokens: Column, price: Column) -> Column:
    """USD of so many tokens; null if the price is unknown, 0 if it is free."""
    return tokens / F.lit(1_000_000.0) * price


def price_table(spark) -> DataFrame:
    return spark.createDataFrame(list(PRICES.items()), "model string, price double")


def format_usd(usd: Column) -> Column:
    """``unknown``, ``$0.0000``, ``<$0.0001`` or four decimals."""
    return F.when(usd.isNull(), "unknown").when(usd == 0, "$0.0000").when(usd < 0.0001, "<$0.0001").otherwise(F.concat(F.lit("$"), F.format_string("%.4f", usd)))
