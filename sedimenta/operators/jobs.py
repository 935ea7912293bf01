"""What a run has stored so far, batch by batch, so that a run that broke off is taken up where it ended.

A job is what one run does to one source: its key is the digest of source, plan, model and collection.
Each batch that is stored is recorded here; the records of a job go when its ledger entry is published.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.errors import IntegrityError
from sedimenta.operators.incremental import VersionedTarget
from sedimenta.operators.ledger import strangers

RECORDS = "job_key string, chunk_id string"


class Progress:
    """``job_key, chunk_id`` of what unfinished jobs have stored; a versioned table of small layers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.target = spark, VersionedTarget(spark, path)

    def read(self, jobs: DataFrame) -> DataFrame:
        """The records of the given jobs (job_key); an id recorded twice counts once."""
        known = self.target.read()
        if known is None:
            return self.spark.createDataFrame([], RECORDS)
        return known.join(jobs.select("job_key").distinct(), "job_key", "left_semi").select("job_key", "chunk_id").distinct()

    def record(self, stored: DataFrame) -> None:
        """Add what a batch has stored (job_key, chunk_id)."""
        rows = stored.select("job_key", "chunk_id")
        self.target.publish_changes(rows, rows.select("job_key").limit(0), ["job_key"], self.target.version)

    def forget(self, jobs: DataFrame) -> None:
        """Drop the records of the given jobs."""
        if self.target.version is not None:
            nothing = self.spark.createDataFrame([], RECORDS)
            self.target.publish_changes(nothing, jobs.select("job_key"), ["job_key"], self.target.version)
            self.target.expire()


def check_progress(progress: DataFrame, target: DataFrame) -> None:
    """Raises if a job has stored ids that aren't among its targets (job_key, chunk_id): it isn't the same job."""
    bad = strangers(progress, target).head()
    if bad:
        raise IntegrityError(f"job {bad['job_key'][:12]} has stored {bad['chunk_id']}, which isn't among its chunks; use force to begin anew")


def in_target_order(progress: DataFrame, target: DataFrame) -> DataFrame:
    """``job_key, chunk_id, chunk_index`` of what is stored, numbered as in the target (job_key, chunk_id, chunk_index)."""
    return target.join(progress.select("job_key", "chunk_id").distinct(), ["job_key", "chunk_id"], "left_semi").select("job_key", "chunk_id", "chunk_index")


def completed(progress: DataFrame, target: DataFrame) -> DataFrame:
    """``job_key, completed_chunk_ids`` per job, in the order of the target."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_id"))), lambda x: x["chunk_id"])
    return in_target_order(progress, target).groupBy("job_key").agg(ids.alias("completed_chunk_ids"))
