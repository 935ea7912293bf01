"""An incremental run: parse and chunk what changed, embed what is new, store, delete, record.

Chunks are embedded and stored in batches, each recorded as soon as it is stored: a run that broke off, by
failure or on request, is taken up by the next one, which embeds only what is left.  The ledger is
published last, and with it the records of the job go.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.errors import IntegrityError, Interrupted
from sedimenta.operators.chunking import chunk_sections
from sedimenta.operators.embedding import Provider, embed_chunks
from sedimenta.operators.incremental import VersionedTarget
from sedimenta.operators.jobs import Progress, check_progress
from sedimenta.operators.ledger import LEDGER, PART, check_ledger, iso_now, job_key, remaining, up_to_date, work_set
from sedimenta.plans.embed_plan import EmbedPlan
from sedimenta.session import materialise

#: Chunks that are embedded and stored before they are recorded; a run that dies embeds at most so many again.
CHECKPOINT = 200_000


@dataclass
class Outcome:
    sources: int
    unchanged: int
    embedded: int
    restamped: int
    removed: int
    #: Chunks that an earlier run of the same job had stored already.
    resumed: int = 0


def run(
    spark: SparkSession, sections: DataFrame | Callable[[DataFrame], DataFrame], hashes: DataFrame, plan: EmbedPlan, provider: Provider, store, ledger_path: str,
    force: bool = False, tokens: str = "byte_bpe_50k", checkpoint: int = CHECKPOINT, stop: Callable[[], bool] | None = None, tell: Callable[[int, int], None] | None = None,
) -> Outcome:
    """Bring a collection up to date with the given sources.

    ``sections``: as parsed (source_path, section_index, text, ...), or a function that gives the chunks
    of the sources (source_path) that changed; ``hashes``: one row per source (source_path,
    source_hash); sources that aren't among them are left alone.  Chunks whose metadata
    alone changed are stored anew with the vector they have.  ``force`` embeds everything and
    forgets what an unfinished run had stored.  ``checkpoint`` is the number of chunks per batch;
    ``stop`` is asked before each batch and ends the run with Interrupted, to be taken up later;
    ``tell`` gets the chunks stored and those to store after each batch.
    """
    dim = provider.dimensions(plan.embedding_model)
    store.ensure(plan.collection, dim)
    target = VersionedTarget(spark, ledger_path)
    at = target.version
    ledger = target.read() if at else spark.createDataFrame([], LEDGER)
    part = ledger.filter((F.col("vector_db") == store.name) & (F.col("collection") == plan.collection))
    sources = hashes.withColumn("plan_hash", F.lit(plan.hash))
    n_sources = sources.count()
    fixed = {"vector_db": store.name, "collection": plan.collection, "provider": provider.name, "model": plan.embedding_model, "dim": dim, "tokens": tokens}
    wanted = sources.select("*", *[F.lit(v).alias(k) for k, v in fixed.items()])
    wanted = wanted.withColumn("job_key", job_key(["source_path", "source_hash", "plan_hash", *fixed]))
    done = up_to_date(sources, part) if not force else sources.select("source_path").limit(0)
    changed = materialise(wanted.join(done, "source_path", "left_anti"), "changed")
    n_changed = changed.count()
    if not n_changed:
        return Outcome(n_sources, n_sources, 0, 0, 0)
    check_ledger(part, provider.name, plan.embedding_model, dim, force)
    # several branches read the chunks: written once, they survive lost executors
    if callable(sections):
        made = sections(changed.select("source_path"))
    else:
        made = chunk_sections(sections.join(changed.select("source_path"), "source_path", "left_semi"), plan, tokens)
    chunks = materialise(made.join(changed.select("source_path", "job_key"), "source_path"), "chunks")
    old = part.join(changed.select("source_path"), "source_path", "left_semi").select("source_path", "chunk_index", "chunk_id", "meta_json")
    todo = chunks if force else work_set(chunks, old)

    progress = Progress(spark, f"{ledger_path.rstrip('/')}-jobs")
    if force:
        progress.forget(changed)
    stored = materialise(progress.read(changed), "stored")
    check_progress(stored, todo)
    n_todo = todo.count()
    left = materialise(remaining(todo, stored), "left")
    n_left = left.count()
    batches = math.ceil(n_left / max(1, checkpoint))
    n_done = n_todo - n_left
    for k in range(batches):
        if stop is not None and stop():
            raise Interrupted(f"stopped with {n_done} of {n_todo} chunks stored; the next run goes on from there")
        batch = left.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(batches)) == k)
        vectors = materialise(embed_chunks(batch, provider, plan.embedding_model), "vectors")
        store.apply(plan.collection, vectors.select("chunk_id", "vector", F.col("text").alias("content"), F.col("meta_json").alias("metadata")))
        progress.record(vectors)
        n_done += vectors.count()
        if tell is not None:
            tell(n_done, n_todo)

    gone = materialise(old.select("chunk_id").join(chunks.select("chunk_id"), "chunk_id", "left_anti").distinct(), "gone")
    kept = chunks.join(todo.select("chunk_id"), "chunk_id", "left_anti").join(old.select("chunk_id", F.col("meta_json").alias("was")), "chunk_id").filter(~F.col("meta_json").eqNullSafe(F.col("was")))
    stamps = materialise(kept.select("chunk_id", F.col("text").alias("content"), F.col("meta_json").alias("metadata")), "stamps")
    n_stamped, n_gone = stamps.count(), gone.count()
    if n_stamped:
        store.restamp(plan.collection, stamps)
    if n_gone:
        nothing = spark.createDataFrame([], "chunk_id string, vector array<float>, content string, metadata string")
        store.apply(plan.collection, nothing, gone)
    entries = chunks.select("source_path", "chunk_index", "chunk_id", "meta_json").join(changed, "source_path").withColumn("recorded_at", iso_now())
    entries = entries.select(*[c.split()[0] for c in LEDGER.split(", ")])
    if target.publish_changes(entries, changed.select(*PART), PART, at) <= (at or 0):
        raise IntegrityError("the ledger didn't advance")
    progress.forget(changed)
    target.expire()
    store.expire(plan.collection)
    return Outcome(n_sources, n_sources - n_changed, n_left, n_stamped, n_gone, n_todo - n_left)
