"""Token budget per source, language and domain.

The pieces that a vocabulary doesn't hold as one token are collected over the corpus, each once, and
sorted into range partitions.  A partition is a forest of prefix tries: its pieces are walked in
order, and the tokenisation of every prefix (its last token and its number of tokens) stays on a stack
while pieces share it, so that only the bytes behind the shared prefix are worked on.  The counts at
the ends of pieces are joined to the documents that hold them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm import bpe
from sedimenta.llm.text_batches import pieces as cut
from sedimenta.session import materialise

#: Up to so many distinct pieces (some 60 bytes each) their counts are broadcast; beyond, the join shuffles.
BROADCAST_PIECES = 500_000
#: Beyond, pieces that make up more than this part of all look-ups are still broadcast (so at most its inverse of them).
FREQUENT = 1 / 10_000


class PrefixCounter:
    """Token counts of pieces given in byte order."""

    def __init__(self, model: bpe.Bpe):
        self.model = model
        self.suffixes = {b[k:] for b in model.ranks for k in range(len(b))}
        self.piece, self.last, self.count = b"", [-1], [0]

    def __call__(self, piece: bytes) -> int:
        """Number of tokens of ``piece``; the states of the prefix it shares with the one before are reused."""
        old, n = self.piece, len(piece)
        shared, most = 0, min(len(old), n)
        while shared < most and old[shared] == piece[shared]:
            shared += 1
        last, count, ranks, suffixes, compatible = self.last, self.count, self.model.ranks, self.suffixes, self.model.compatible
        del last[shared + 1 :], count[shared + 1 :]
        for stop in range(shared + 1, n + 1):
            # exactly one token ends the tokenisation of this prefix: the one that its own rest accepts
            for start in range(stop - 1, -1, -1):
                part = piece[start:stop]
                if part not in suffixes:
                    raise AssertionError("a prefix without tokenisation")
                token = ranks.get(part)
                if token is not None and (start == 0 or compatible(last[start], token)):
                    last.append(token)
                    count.append(count[start] + 1)
                    break
        self.piece = piece
        return count[n]


@lru_cache(maxsize=2)
def _splitter(path: str) -> "WordSplitter":
    return WordSplitter(bpe.load(path))


class WordSplitter:
    """Per word the number of pieces that are one token, and the other pieces."""

    def __init__(self, model: bpe.Bpe):
        self.ranks, self.words = model.ranks, {}

    def __call__(self, text: str) -> tuple[int, Counter]:
        if len(self.words) > bpe.CACHE_ENTRIES:
            self.words.clear()
        single, rest, known, ranks = 0, Counter(), self.words, self.ranks
        for word, times in Counter(bpe.words_of(text)).items():
            got = known.get(word)
            if got is None:
                parts = bpe.PIECES.findall(word)
                long = [p for p in parts if p.encode() not in ranks]
                got = known[word] = (len(parts) - len(long), long)
            single += got[0] * times
            for p in got[1]:
                rest[p] += times
        return single, rest


def _occurrences(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, piece, times``; the row with null piece holds the tokens that need no look-up."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = _splitter(path)
        for part in cut(batches):
            ids, names, times = [], [], []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                single, rest = splitter(text) if text else (0, ())
                ids += [doc] * (len(rest) + 1)
                names.append(None)
                times.append(single)
                names += rest
                times += rest.values() if rest else ()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(times, pa.int64())], ["doc_id", "piece", "times"])

    return docs.select("doc_id", "text").mapInArrow(split, "doc_id long, piece string, times long")


def piece_counts(pieces: DataFrame, path: str) -> DataFrame:
    """``piece, tokens, docs`` of distinct pieces (piece, docs), by prefix tries over ranges of the byte order."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(bpe.load(path))
        for batch in batches:
            names = batch.column(0)
            yield pa.RecordBatch.from_arrays([names, pa.array([counter(p.encode()) for p in names.to_pylist()], pa.int64()), batch.column(1)], ["piece", "tokens", "docs"])

    return pieces.select("piece", "docs").repartitionByRange("piece").sortWithinPartitions("piece").mapInArrow(walk, "piece string, tokens long, docs long")


def document_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, tokens`` for each distinct doc_id; null and empty texts have 0 tokens.

    Rows that repeat a doc_id would add up, so deliver each document once.  Null ids form one group.
    Counts are broadcast up to a bound; beyond it only those of the frequent pieces are, which are few,
    and the others are joined by piece, so that no piece makes a hot group.
    """
    path = path or bpe.vocabulary_path()
    found = materialise(_occurrences(docs, path), "occurrences")
    named = found.filter(F.col("piece").isNotNull())
    distinct = named.groupBy("piece").agg(F.count(F.lit(1)).alias("docs"))
    counts = materialise(piece_counts(distinct, path), "piece-counts")
    facts = counts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("docs"), F.lit(0)).alias("all")).head()
    tokens = (F.col("times") * F.coalesce("tokens", F.lit(1))).alias("tokens")
    if facts["n"] <= BROADCAST_PIECES:
        looked = found.join(F.broadcast(counts.select("piece", "tokens")), "piece", "left").select("doc_id", tokens)
    else:
        # null pieces need no look-up, frequent ones none over the network
        often = F.col("docs") > FREQUENT * facts["all"]
        marked = found.join(F.broadcast(counts.filter(often).select("piece", "tokens")), "piece", "left")
        rare = F.col("piece").isNotNull() & F.col("tokens").isNull()
        cold = marked.filter(rare).drop("tokens").join(counts.filter(~often).select("piece", "tokens"), "piece").select("doc_id", tokens)
        looked = marked.filter(~rare).select("doc_id", tokens).unionByName(cold)
    return looked.groupBy("doc_id").agg(F.sum("tokens").alias("tokens"))


def label(column: str, region: bool = False) -> Column:
    """One spelling of a label: case, blanks and separators don't matter; ``region`` drops a region suffix; null and blank become ``unknown``."""
    c = F.regexp_replace(F.lower(F.trim(F.col(column))), r"[\s_-]+", "-")
    if region:
        c = F.regexp_replace(c, "-.*$", "")
    return F.when(F.coalesce(c, F.lit("")) == "", "unknown").otherwise(c)


def token_budget(docs: DataFrame, path: str | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """``source, lang, doc_domain, n_docs, n_chars, n_tokens`` per normalised labels; rows without doc_id are left out, an empty table gives no rows.

    ``sizes`` (doc_id, tokens) gives the tokens of documents where they are known already.
    """
    facts = docs.select("doc_id", label("source").alias("source"), label("lang", True).alias("lang"), label("doc_domain").alias("doc_domain"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"))
    return (
        facts.join(document_tokens(docs, path) if sizes is None else sizes.select("doc_id", "tokens"), "doc_id")
        .groupBy("source", "lang", "doc_domain")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum("chars").alias("n_chars"), F.sum("tokens").alias("n_tokens"))
    )


def budget_against_estimates(docs: DataFrame, estimates: DataFrame, path: str | None = None) -> DataFrame:
    """``source_path, n_docs, n_tokens, n_estimated, estimated_tokens, ratio`` beside the earlier estimates.

    Of each document the newest estimate counts that is neither null nor negative (of equal times the
    largest estimate_id); n_estimated tells how many documents have one, and ratio compares the
    estimates with the tokens of just these documents.  Null source_paths form one row; documents
    without doc_id are left out.
    """
    newest = (
        estimates.filter(F.col("tokens") >= 0)
        .groupBy("doc_id")
        .agg(F.max(F.struct("estimated_at", "estimate_id", "tokens")).alias("e"))
        .select("doc_id", F.col("e.tokens").alias("estimate"))
    )
    rows = docs.select("doc_id", "source_path").join(document_tokens(docs, path), "doc_id").join(newest, "doc_id", "left")
    there = F.col("estimate").isNotNull()
    return rows.groupBy("source_path").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("tokens").alias("n_tokens"), F.count("estimate").alias("n_estimated"), F.coalesce(F.sum("estimate"), F.lit(0)).alias("estimated_tokens"),
        F.round(F.sum("estimate") / F.nullif(F.sum(F.when(there, F.col("tokens"))), F.lit(0)), 6).alias("ratio"),
    )
