"""What is stored of each source, and what a new version of it changes.

A ledger row names a chunk of a source in a collection: ``vector_db, collection, source_path,
source_hash, plan_hash, provider, model, dim, chunk_index, chunk_id, meta_json, recorded_at``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.errors import IntegrityError

LEDGER = (
    "vector_db string, collection string, source_path string, source_hash string, plan_hash string, provider string, model string, dim int, chunk_index int, chunk_id string, meta_json string, recorded_at string"
)
#: A collection's part of a source: what was stored under another collection or database says nothing about it.
PART = ["vector_db", "collection", "source_path"]


def diff_chunks(old: DataFrame, new: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``source_path, chunk_id, status``: added, kept or removed ids per source; an id counts once per source."""
    keys = keys or ["source_path", "chunk_id"]
    a = old.select(*keys).distinct().withColumn("_old", F.lit(True))
    b = new.select(*keys).distinct().withColumn("_new", F.lit(True))
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("kept")
    return a.join(b, keys, "full_outer").select(*keys, status.alias("status"))


def work_set(new: DataFrame, old: DataFrame, also: list[str] | None = None) -> DataFrame:
    """Rows of ``new`` that aren't stored at the same place of the same source (and of the same ``also``) under the same id."""
    keys = [*(also or []), "source_path", "chunk_index", "chunk_id"]
    return new.join(old.select(*keys), keys, "left_anti")


def remaining(target: DataFrame, progress: DataFrame) -> DataFrame:
    """Rows of ``target`` (job_key, chunk_id, ...) that no checkpoint names."""
    return target.join(progress.select("job_key", "chunk_id").distinct(), ["job_key", "chunk_id"], "left_anti")


def selected(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``chunks`` whose id is wanted."""
    return chunks.join(wanted.select("chunk_id").distinct(), "chunk_id", "left_semi")


def strangers(progress: DataFrame, target: DataFrame) -> DataFrame:
    """Checkpointed ids that aren't part of their job's target; there should be none."""
    return progress.join(target.select("job_key", "chunk_id"), ["job_key", "chunk_id"], "left_anti")


def outcome_counts(diff: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``source_path, added, kept, removed`` of a diff, or the counts by ``keys``."""
    one = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return diff.groupBy(*(keys or ["source_path"])).agg(one("added"), one("kept"), one("removed"))


def up_to_date(new: DataFrame, ledger: DataFrame) -> DataFrame:
    """``source_path`` of the sources whose hash and plan hash are those of the ledger.

    ``new``: one row per source of one collection (source_path, source_hash, plan_hash).  Ids are a
    function of content, plan and chunker, so that such sources need neither parsing nor chunking.
    """
    stored = ledger.groupBy("source_path").agg(F.max("source_hash").alias("source_hash"), F.max("plan_hash").alias("plan_hash"), F.min("source_hash").alias("_h"), F.min("plan_hash").alias("_p"))
    whole = stored.filter((F.col("source_hash") == F.col("_h")) & (F.col("plan_hash") == F.col("_p"))).drop("_h", "_p")
    return new.join(whole, ["source_path", "source_hash", "plan_hash"], "left_semi").select("source_path").distinct()


def unchanged_revisions(specs: DataFrame) -> DataFrame:
    """``source_path, revision`` of the revisions that up_to_date finds against the revision before, for every revision of a path that has one.

    ``specs``: source_path, revision, source_hash, plan_hash; rows without revision have none before them.
    """
    sides = [f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("source_hash", "plan_hash")]
    revisions = specs.filter(F.col("revision").isNotNull()).groupBy("source_path", "revision").agg(*sides, F.collect_set(F.struct("source_hash", "plan_hash")).alias("states"))
    whole = (F.col("min_source_hash") == F.col("max_source_hash")) & (F.col("min_plan_hash") == F.col("max_plan_hash"))
    state = F.when(whole, F.struct(F.col("min_source_hash").alias("source_hash"), F.col("min_plan_hash").alias("plan_hash")))
    before = revisions.withColumn("before", F.lag(state).over(Window.partitionBy("source_path").orderBy("revision")))
    return before.filter(F.array_contains("states", F.col("before"))).select("source_path", "revision")


def conflicts(ledger: DataFrame, provider: str, model: str, dim: int) -> DataFrame:
    """Ledger parts that were embedded otherwise: their vectors can't be compared with new ones."""
    other = (F.col("provider") != provider) | (F.col("model") != model) | (F.col("dim") != dim)
    return ledger.filter(other).select(*PART, "provider", "model", "dim").distinct()


def damaged(ledger: DataFrame) -> DataFrame:
    """Rows that no run can have written: hashes and ids of another form, or without place."""
    digest = lambda c, n: F.coalesce(F.col(c).rlike(f"^[0-9a-f]{{{n}}}$"), F.lit(False))
    fine = digest("source_hash", 64) & digest("plan_hash", 64) & digest("chunk_id", 16) & F.coalesce(F.col("chunk_index") >= 0, F.lit(False)) & F.coalesce(F.col("dim") > 0, F.lit(False))
    return ledger.filter(~fine)


def check_ledger(ledger: DataFrame, provider: str, model: str, dim: int, force: bool = False) -> None:
    """Raises if a stored part is damaged or conflicts, unless forced."""
    if force:
        return
    torn = damaged(ledger).head()
    if torn:
        raise IntegrityError(f"the ledger's entry {torn['chunk_index']} of {torn['source_path']} is damaged; use force to write it anew")
    bad = conflicts(ledger, provider, model, dim).head()
    if bad:
        raise IntegrityError(f"{bad['source_path']} in {bad['collection']} was embedded by {bad['provider']}/{bad['model']} ({bad['dim']} dimensions); use another collection or force")


def iso_now() -> Column:
    """The time of the query in ISO 8601, in universal time with milliseconds."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def job_key(columns: list[str]) -> Column:
    """SHA-256 over what identifies a job, as JSON in the order of ``columns``."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)
