"""Chunks of sections, their numbers and their ids."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions.jstext import stringify, trim
from sedimenta.functions.markdown_chunks import split_section
from sedimenta.functions.splitting import PROSE, bounded, code_separators, recursive_split
from sedimenta.functions.tokens import Counter, counter
from sedimenta.plans.embed_plan import EmbedPlan
from sedimenta.session import materialise

#: Fixed value: goes into every chunk id; another one makes all ids new.
CHUNKER_VERSION = "5"
#: Sections of a source that one window numbers; sources with more are numbered block by block.
BLOCK = 1024
#: Up to so many sections (some 60 bytes each) their first chunk numbers are broadcast; beyond, the join shuffles the chunks once.
BROADCAST_SECTIONS = 300_000


def chunk_id(path: Column, index: Column, text: Column) -> Column:
    """16 hex digits of the SHA-256 over path, chunk index, chunker version and text, parted by NUL."""
    return F.substring(F.sha2(F.concat_ws("\0", path, index.cast("string"), F.lit(CHUNKER_VERSION), text), 256), 1, 16)


def split_text(text: str, splitter: str, size: int, overlap: int, count: Counter, language: str | None = None, path: list[str] | None = None, structural: bool = False) -> list[str]:
    """The chunks of one section, none above ``size`` tokens but for single code points, trimmed, none empty."""
    if splitter == "markdown" or structural and splitter == "html":
        pieces = split_section(text, size, overlap, count, path)
    elif splitter in ("csv", "jsonl"):
        pieces = [text]
    else:
        pieces = recursive_split(text, code_separators(language) if splitter == "code" else PROSE, size, overlap, count)
    out = [x for p in pieces for x in ([p] if count(p) <= size else bounded(p, size, count))]
    return [t for p in out if (t := trim(p))]


#: Columns of a section that are metadata, and the names under which they are stored.
META = {
    "content_type": "contentType", "language": "language", "key_path": "keyPath", "item": "index", "line": "line", "row": "row", "columns": "columns", "header_path": "headerPath", "header_depth": "headerDepth",
    "heading": "heading", "extraction_origin": "extractionOrigin", "page_number": "pageNumber", "page_count": "pageCount",
}


def split_sections(sections: DataFrame, plan: EmbedPlan, tokens: str = "byte_bpe_50k") -> DataFrame:
    """``source_path, section_index, section_hash, chunk_in_section, text, n_tokens, meta_json`` of sections.

    Needed columns: source_path, section_index, text; those of META are metadata if they are there.
    Metadata of the plan win over those of the section, reserved keys over both.  Narrow: sections are
    split where they lie.  Null and empty texts have no chunks.
    """
    have = set(sections.columns)
    facts = F.to_json(F.struct(*[F.col(c).alias(name) for c, name in META.items() if c in have])) if have & set(META) else F.lit("{}")
    chosen = sections.select("source_path", F.col("section_index").cast("int").alias("section_index"), "text", facts.alias("facts"), F.xxhash64("text").alias("section_hash"))
    splitter, size, overlap, stamped = plan.splitter, plan.chunk_size, plan.overlap, plan.metadata

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokens)
        for batch in batches:
            rows: list[tuple] = []
            for path, index, text, about, digest in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if not text:
                    continue
                own = json.loads(about)
                for k, piece in enumerate(split_text(text, splitter, size, overlap, count, own.get("language"), own.get("headerPath"), "extractionOrigin" in own)):
                    meta = own | stamped | {"sectionIndex": index, "chunkInSection": k, "sourcePath": path}
                    rows.append((path, index, digest, k, piece, count(piece), stringify(meta)))
            columns = list(zip(*rows)) or [()] * 7
            types = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["source_path", "section_index", "section_hash", "chunk_in_section", "text", "n_tokens", "meta_json"])

    return chosen.mapInArrow(split, "source_path string, section_index int, section_hash long, chunk_in_section int, text string, n_tokens int, meta_json string")


def number_chunks(chunks: DataFrame) -> DataFrame:
    """Adds chunk_index, counting a source's chunks from 0 over its sections.

    A chunk knows its place in its section, so only the sections are numbered: one row of each, in blocks,
    so that no window has to hold a whole source.  Sections are ordered by section_index (null first),
    of equal ones by section_hash, if there is one; the same section delivered twice counts once.
    """
    spread = chunks if "section_hash" in chunks.columns else chunks.withColumn("section_hash", F.lit(0).cast("long"))
    keys = ["source_path", "section_index", "section_hash"]
    sizes = spread.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), (F.max("chunk_in_section") + 1).alias("n"))
    sizes = sizes.withColumn("block", F.coalesce(F.floor(F.col("section_index") / BLOCK), F.lit(-1)))
    facts = sizes.agg(F.count(F.lit(1)).alias("sections"), F.max(F.col("rows") > F.col("n")).alias("twice")).head()
    blocks = sizes.groupBy("source_path", "block").agg(F.sum("n").alias("all"))
    start = F.sum("all").over(Window.partitionBy("source_path").orderBy("block")) - F.col("all")
    starts = blocks.select(F.col("source_path").alias("path"), F.col("block").alias("b"), start.alias("start"))
    inner = F.sum("n").over(Window.partitionBy("source_path", "block").orderBy("section_index", "section_hash")) - F.col("n")
    first = sizes.withColumn("inner", inner).join(starts, F.col("source_path").eqNullSafe(F.col("path")) & (F.col("block") == F.col("b")))
    first = first.select(*[F.col(k).alias(f"_{k}") for k in keys], (F.col("start") + F.col("inner")).alias("_first"))
    if facts["twice"]:
        spread = spread.dropDuplicates([*keys, "chunk_in_section"])
    if facts["sections"] <= BROADCAST_SECTIONS:
        first = F.broadcast(first)
    joined = spread.join(first, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return joined.withColumn("chunk_index", (F.col("_first") + F.col("chunk_in_section")).cast("int")).drop("_first", *[f"_{k}" for k in keys], *([] if "section_hash" in chunks.columns else ["section_hash"]))


def chunk_sections(sections: DataFrame, plan: EmbedPlan, tokens: str = "byte_bpe_50k") -> DataFrame:
    """Chunks with index and id: ``chunk_id, source_path, section_index, chunk_in_section, chunk_index, text, n_tokens, meta_json``.

    The split chunks are written to the shared folder first, as numbering reads them twice and splitting
    is what costs.
    """
    chunks = number_chunks(materialise(split_sections(sections, plan, tokens), "split"))
    meta = F.concat(F.expr("substring(meta_json, 1, length(meta_json) - 1)"), F.lit(',"chunkIndex":'), F.col("chunk_index").cast("string"), F.lit("}"))
    return chunks.select(
        chunk_id(F.col("source_path"), F.col("chunk_index"), F.col("text")).alias("chunk_id"), "source_path", "section_index", "chunk_in_section", "chunk_index", "text", "n_tokens", meta.alias("meta_json"),
    )
