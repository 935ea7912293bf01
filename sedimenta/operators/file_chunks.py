"""Chunks of files: large kinds are read in byte ranges, documents that need to be seen whole as a whole."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.errors import ParseError
from sedimenta.functions.tokens import counter
from sedimenta.operators.chunking import chunk_id, chunk_sections, number_chunks, split_text
from sedimenta.plans.embed_plan import LANGUAGES, EmbedPlan, content_extension
from sedimenta.session import materialise
from sedimenta.sources import blocks
from sedimenta.sources.files import CONTENT, SNIFFED, parse_files, read_files, sniff

RECORDS = frozenset(("jsonl", "ndjson"))


def file_kinds(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """How each file is read: ``text``, ``code``, ``jsonl``, ``csv`` (in ranges) or ``whole``; told by its name and its first bytes."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = []
            for path in batch.column(0).to_pylist():
                try:
                    with blocks.open_file(path) as f:
                        kinds.append(sniff(f.read(SNIFFED)))
                except OSError as e:
                    raise ParseError(f"can't read {path}: {e.strerror or e}") from None
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.string())], ["source_path", "kind"])

    listed = spark.createDataFrame([(p,) for p in paths], "source_path string").repartition(max(1, min(len(paths), 4096)))
    # one row per path that the caller named
    found = {r["source_path"]: r["kind"] for r in listed.mapInArrow(look, "source_path string, kind string").collect()}
    out = {}
    for path in paths:
        ext, seen = content_extension(path), found[path]
        content = CONTENT.get(ext, "json" if seen == "json" else "text")
        if seen in ("pdf", "html", "binary"):
            out[path] = "whole"  # the content beats the name; binary files are refused there
        elif ext in RECORDS:
            out[path] = "jsonl"
        else:
            out[path] = content if content in ("text", "code", "csv") else "whole"
    return out


def _language(path: str) -> str:
    return LANGUAGES.get(os.path.splitext(path)[1][1:].lower(), "unknown")


def text_chunks(spark: SparkSession, paths: list[str], plan: EmbedPlan, tokens: str = "byte_bpe_50k", language: str | None = None, size: int = blocks.RANGE, grid: int = blocks.GRID) -> DataFrame:
    """Chunks of large text or code files, in the columns of ``chunk_sections``; a file is one section.

    Record splitters cut running text recursively.  The chunks don't depend on ``size``, the bytes per range.
    """
    splitter = "recursive" if plan.splitter in ("csv", "jsonl") else plan.splitter
    chunk_size, overlap = plan.chunk_size, plan.overlap

    def split(text: str) -> list[str]:
        return split_text(text, splitter, chunk_size, overlap, counter(tokens), language)

    pieces = blocks.text_pieces(spark, paths, chunk_size, split, lambda text: counter(tokens)(text), size, grid)
    # splitting is what costs: written once, as numbering reads the pieces twice
    numbered = number_chunks(materialise(pieces.withColumnRenamed("place", "section_index"), "pieces"))
    facts = {"contentType": F.lit("code" if language else "text")} | ({"language": F.lit(language)} if language else {})
    index = F.col("chunk_index")
    stamped = facts | {k: F.lit(v) for k, v in plan.metadata.items()} | {"sectionIndex": F.lit(0), "chunkInSection": index, "sourcePath": F.col("source_path"), "chunkIndex": index}
    meta = F.to_json(F.struct(*[v.alias(k) for k, v in stamped.items()]))
    return numbered.select(
        chunk_id(F.col("source_path"), index, F.col("text")).alias("chunk_id"), "source_path", F.lit(0).alias("section_index"), index.alias("chunk_in_section"), "chunk_index", "text", "n_tokens", meta.alias("meta_json"),
    )


def file_chunks(spark: SparkSession, paths: list[str], plan: EmbedPlan, tokens: str = "byte_bpe_50k", size: int = blocks.RANGE) -> DataFrame:
    """The chunks of files of any kind, in the columns of ``chunk_sections``; files without text have none."""
    kinds = file_kinds(spark, paths)
    of = lambda *wanted: [p for p in paths if kinds[p] in wanted]
    parts: list[DataFrame] = []
    if own := of("text"):
        parts.append(text_chunks(spark, own, plan, tokens, size=size))
    code = of("code")
    for language in sorted({_language(p) for p in code}):
        parts.append(text_chunks(spark, [p for p in code if _language(p) == language], plan, tokens, language, size))
    if own := of("jsonl"):
        parts.append(chunk_sections(blocks.line_records(spark, own, size).withColumn("content_type", F.lit("json")), plan, tokens))
    if own := of("csv"):
        parts.append(chunk_sections(blocks.csv_records(spark, own, size).withColumn("content_type", F.lit("csv")), plan, tokens))
    if own := of("whole"):
        parts.append(chunk_sections(parse_files(read_files(spark, own)), plan, tokens))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
