"""Continuous ingestion: new versions of sources arrive in a folder or table and run through the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sedimenta.operators import pipeline
from sedimenta.operators.collection import ParquetCollections
from sedimenta.operators.embedding import Provider
from sedimenta.plans.embed_plan import EmbedPlan
from sedimenta.sources.files import parse_texts, text_hashes

#: What a source row of the stream looks like; of several versions of a path in one batch the latest counts.
SOURCE = "source_path string, text string, modified_at timestamp"


def source_stream(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Rows of the Parquet files that appear in ``folder``."""
    return spark.readStream.schema(SOURCE).option("maxFilesPerTrigger", max_files).parquet(folder)


def newest(batch: DataFrame) -> DataFrame:
    """Of each path the latest row (of equal times the largest text)."""
    return batch.groupBy("source_path").agg(F.max(F.struct("modified_at", "text")).alias("r")).select("source_path", "r.text", "r.modified_at")


def ingest(stream: DataFrame, plan: EmbedPlan, provider: Provider, store: ParquetCollections, ledger_path: str, checkpoint: str, once: bool = True, tokens: str = "byte_bpe_50k") -> StreamingQuery:
    """Start the ingestion; ``once`` takes what is there and ends.

    A batch that runs again after a failure finds in the ledger what it had recorded, so that nothing
    is embedded or stored twice; batches commit one after the other.
    """

    def step(batch: DataFrame, _: int) -> None:
        rows = newest(batch).filter(F.col("source_path").isNotNull())
        hashes = text_hashes(rows, "source_path")
        sections = parse_texts(rows).filter(F.col("text").isNotNull())
        pipeline.run(batch.sparkSession, sections, hashes, plan, provider, store, ledger_path, tokens=tokens)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
