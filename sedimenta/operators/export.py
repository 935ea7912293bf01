"""Vectors as JSON lines, and readable previews of chunks."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.errors import UserError
from sedimenta.plans.embed_plan import EmbedPlan, cost_usd, format_usd, price_table

#: Width of the rules in a report.
RULE = 80


def export_lines(vectors: DataFrame) -> DataFrame:
    """``source_path, chunk_index, value``: the JSON line of each embedded chunk."""
    line = F.to_json(F.struct(F.col("source_path").alias("sourcePath"), F.col("chunk_id").alias("id"), "text", F.col("meta_json").alias("metadata"), "model", F.col("dim").alias("dimensions"), "vector"))
    return vectors.select("source_path", "chunk_index", line.alias("value"))


def check_target(path: str, inputs: list[str]) -> None:
    """Raises if an export to ``path`` would overwrite one of the inputs, or what lies above or below it; links count as what they name."""
    target = os.path.realpath(path)
    for given in inputs:
        own = os.path.realpath(given)
        if own == target or own.startswith(target + os.sep) or os.path.exists(own) and os.path.exists(target) and os.path.samefile(own, target):
            raise UserError(f"the export {path} would overwrite the input {given}")


def export_vectors(vectors: DataFrame, path: str, files: int | None = None, inputs: list[str] | None = None) -> None:
    """Write the lines in order of source and chunk to the folder ``path`` (``*.jsonl``): all or nothing.

    Part files follow each other in order; ``files=1`` makes a single one.  The lines are written beside
    the target, which appears by a rename; a failed export leaves nothing.  An export that would
    overwrite one of ``inputs`` is refused.
    """
    if not path.endswith(".jsonl"):
        raise UserError("the export must be a .jsonl path")
    check_target(path, inputs or [])
    spark = vectors.sparkSession
    jvm = spark.sparkContext._jvm
    target, fresh = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    lines = export_lines(vectors)
    ordered = lines.coalesce(1).sortWithinPartitions("source_path", "chunk_index") if files == 1 else (lines.repartitionByRange(files, "source_path", "chunk_index") if files else lines.repartitionByRange("source_path", "chunk_index")).sortWithinPartitions("source_path", "chunk_index")
    try:
        ordered.select("value").write.text(fresh.toString())
        fs.delete(target, True)
        if not fs.rename(fresh, target):
            raise UserError(f"can't move the export to {path}")
    finally:
        fs.delete(fresh, True)


def report_lines(chunks: DataFrame, plan: EmbedPlan) -> DataFrame:
    """``source_path, chunk_index, part, value``: blocks of the preview, a heading per source and a block per chunk."""
    totals = chunks.groupBy("source_path").agg(F.count(F.lit(1)).alias("n"))
    head = F.concat_ws("\n", F.lit("=" * RULE), F.concat(F.lit("Source: "), F.col("source_path")), F.lit(f"Splitter: {plan.splitter}"), F.lit(f"Chunk size: {plan.chunk_size} tokens"), F.lit(f"Overlap: {plan.overlap} tokens"), F.concat(F.lit("Chunks: "), F.col("n").cast("string")), F.lit("=" * RULE), F.lit(""))
    heads = totals.select("source_path", F.lit(-1).alias("chunk_index"), head.alias("value"))
    body = F.concat_ws("\n", F.lit("-" * RULE), F.concat(F.lit("CHUNK "), (F.col("chunk_index") + 1).cast("string"), F.lit(" OF "), F.col("n").cast("string")), F.concat(F.lit("ID: "), F.col("chunk_id")), F.concat(F.lit("Tokens: "), F.col("n_tokens").cast("string")), F.concat(F.lit("Metadata: "), F.col("meta_json")), F.lit("-" * RULE), F.col("text"), F.lit(""))
    blocks = chunks.join(totals, "source_path").select("source_path", "chunk_index", body.alias("value"))
    return heads.unionByName(blocks)


def write_report(chunks: DataFrame, plan: EmbedPlan, path: str) -> str:
    """The preview as one local text file; blocks stream through the driver one partition at a time."""
    if not path.lower().endswith(".txt"):
        raise UserError(f"the preview must be a .txt file: {path}")
    path = os.path.abspath(path)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    sizes = chunks.agg(F.countDistinct("source_path").alias("files"), F.count(F.lit(1)).alias("chunks")).head()
    with open(path + ".tmp", "w", encoding="utf-8") as out:
        out.write(f"chunk preview\nFiles: {sizes['files']}\nChunks: {sizes['chunks']}\n\n")
        for row in report_lines(chunks, plan).orderBy("source_path", "chunk_index").toLocalIterator():
            out.write(row["value"] + "\n")
    os.replace(path + ".tmp", path)
    return path


#: Metadata shown first in a preview, and those that are shown otherwise or not at all.
SHOWN_FIRST = ("headerPath", "heading", "language", "keyPath", "row", "line", "pageNumber")


def preview(chunks: DataFrame, n: int, width: int = 60) -> None:
    """Print the first ``n`` chunks as a table: source, number, tokens, metadata, start of the text."""
    start = F.regexp_replace(F.substring("text", 1, width), r"\s+", " ")
    rows = chunks.orderBy("source_path", "chunk_index").limit(n).select("source_path", "chunk_index", "n_tokens", shown_metadata("meta_json", list(SHOWN_FIRST)).alias("metadata"), start.alias("text"))
    rows.show(n, truncate=width)


def shown_metadata(meta: str, keys: list[str]) -> Column:
    """``key=value`` of some keys of a JSON column, in that order, those that are there."""
    return F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), F.get_json_object(meta, f"$.{k}")) for k in keys])


def cost_summary(chunks: DataFrame, model: str) -> DataFrame:
    """``model, n_chunks, n_tokens, usd, shown``: what embedding the chunks would cost."""
    sums = chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens")).withColumn("model", F.lit(model))
    usd = cost_usd(F.col("n_tokens"), F.col("price"))
    return sums.join(F.broadcast(price_table(chunks.sparkSession)), "model", "left").select("model", "n_chunks", "n_tokens", usd.alias("usd"), format_usd(usd).alias("shown"))
