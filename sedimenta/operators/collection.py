"""Vector collections kept as versioned Parquet tables, with the contract of a vector database.

ensure, describe, upsert by id, delete by id, restamp.  A change is written as a layer of its own size;
writing the same rows again changes nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.errors import CollectionError, IntegrityError, UserError
from sedimenta.operators.incremental import VersionedTarget
from sedimenta.session import materialise

ROWS = "chunk_id string, vector array<float>, content string, metadata string"


class ParquetCollections:
    """Collections below one folder."""

    name = "parquet"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _target(self, collection: str) -> VersionedTarget:
        if not re.fullmatch(r"[a-z0-9][a-z0-9_-]*", collection):
            raise UserError(f"invalid collection name {collection!r}")
        return VersionedTarget(self.spark, f"{self.root}/{collection}")

    def describe(self, collection: str) -> dict | None:
        """``{"dim": n}``; 0 while the collection is empty, None if there is none."""
        target = self._target(collection)
        now = target.current()
        if now is None:
            return None
        heads = (target.part(layer).select(F.size("vector").alias("d")).head() for layer in reversed(now["layers"]))
        return {"dim": next((row["d"] for row in heads if row), 0)}

    def ensure(self, collection: str, dim: int) -> None:
        """Create the collection, or check that its vectors have ``dim`` entries."""
        known = self.describe(collection)
        if known is None:
            self._target(collection).publish(self.spark.createDataFrame([], ROWS), None)
        elif known["dim"] not in (0, dim):
            raise IntegrityError(f"collection {collection} holds vectors of {known['dim']} dimensions, not {dim}")

    def read(self, collection: str) -> DataFrame:
        df = self._target(collection).read()
        if df is None:
            raise CollectionError(f"no collection {collection}")
        return df

    def apply(self, collection: str, rows: DataFrame, gone: DataFrame | None = None) -> None:
        """Upsert ``rows`` and delete the ids in ``gone`` as one new version; an id in both stays."""
        target = self._target(collection)
        ids = rows.select("chunk_id") if gone is None else rows.select("chunk_id").unionByName(gone.select("chunk_id"))
        target.publish_changes(rows.select("chunk_id", "vector", "content", "metadata"), ids, ["chunk_id"], target.version)

    def restamp(self, collection: str, rows: DataFrame) -> None:
        """Give stored ids (chunk_id, content, metadata) new content and metadata, with the vectors that they have."""
        kept = rows.select("chunk_id", "content", "metadata").join(self.read(collection).select("chunk_id", "vector"), "chunk_id")
        self.apply(collection, materialise(kept, "restamped"))

    def expire(self, collection: str, keep: int = 2) -> int:
        return self._target(collection).expire(keep)


def upserted(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """``stored`` with ``rows`` in place of rows of the same id."""
    return stored.join(rows.select("chunk_id"), "chunk_id", "left_anti").unionByName(rows.select(*stored.columns))


def deleted(stored: DataFrame, ids: DataFrame) -> DataFrame:
    return stored.join(ids.select("chunk_id"), "chunk_id", "left_anti")


def vector_problem(vector: Column, dim: Column) -> Column:
    """Why a vector can't be stored (``missing``, ``dimensions`` or ``not finite``), null if it can."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(vector.isNull(), "missing").when(F.size(vector) != dim, "dimensions").when(~finite, "not finite")


def vector_literal(vector: Column, digits: int = 6) -> Column:
    """``[1.5,2.0]``: the text form of a vector in SQL databases."""
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: F.format_string(f"%.{digits}f", x.cast("double"))), ","), F.lit("]"))


def point_uuid(chunk_id: Column) -> Column:
    """A chunk id twice over in the shape of a UUID, for databases that take no other ids."""
    twice = F.concat(chunk_id, chunk_id)
    return F.concat_ws("-", *[F.substring(twice, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def sql_name(collection: Column) -> Column:
    """A collection's name where only letters, digits and underscores are allowed."""
    return F.regexp_replace(collection, "-", "_")


def flat_metadata(values: dict[str, Column], kinds: dict[str, str]) -> Column:
    """Metadata as JSON of plain values: arrays joined by slashes, objects as JSON text, nulls left out.

    ``kinds`` tells per key ``plain``, ``array`` or ``object``.
    """
    flat = {k: F.array_join(v, "/") if kinds.get(k) == "array" else F.to_json(v) if kinds.get(k) == "object" else v for k, v in values.items()}
    return F.to_json(F.struct(*[v.alias(k) for k, v in flat.items()]))


def listed_metadata(values: dict[str, Column], kinds: dict[str, str]) -> Column:
    """Metadata as JSON where string arrays stay arrays (others become arrays of strings), objects JSON text, nulls left out."""
    kept = {k: v.cast("array<string>") if kinds.get(k) == "array" else F.to_json(v) if kinds.get(k) == "object" else v for k, v in values.items()}
    return F.to_json(F.struct(*[v.alias(k) for k, v in kept.items()]))
