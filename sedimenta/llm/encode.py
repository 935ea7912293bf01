"""Encoding of every text by a public byte-level BPE.

Speculate and verify: greedy longest match proposes the tokens of each distinct piece, all neighbouring
pairs are verified together, and only pieces with an incompatible pair are merged step by step.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm import bpe
from sedimenta.llm.text_batches import pieces


def encode_documents(docs: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, ids``: the token ids of each text, without special tokens.

    A null or empty text gives an empty list; text that spells a special token is ordinary text.  One
    row per input row, so repeated rows stay repeated; an empty table gives none; other columns are
    not read.  Narrow: no row is moved between partitions, long texts are held one at a time.
    """
    path = path or bpe.vocabulary_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.encoder(path)
        for part in pieces(batches):
            flat, at = coder.encode_flat(part.column(1).to_pylist())
            ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return chosen.mapInArrow(encode, "doc_id long, ids array<int>")
