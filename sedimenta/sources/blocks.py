"""Large text, JSON-lines and CSV files, read in byte ranges by many tasks, none as a whole.

A range owns what begins in it, so that everything is read once whatever the ranges are: lines of JSON
lines, records of CSV (line breaks in quotes are found by the number of quotes before a range), stretches
of text.  Stretches of text begin at the first line behind each point of a fixed grid, so that no chunk
depends on the size of the ranges; within a stretch, text goes on from block to block and the last piece is
carried over.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.errors import ParseError
from sedimenta.functions.jstext import parse, shown, trim
from sedimenta.sources.records import csv_rows

#: Bytes per range, characters per block of text, bytes read at once.
RANGE, BLOCK, READ = 8 * 1024 * 1024, 256 * 1024, 1 << 20
#: Bytes between the points of a file behind which stretches of text begin.
GRID = 4 * 1024 * 1024
#: Least characters that are held before text is cut, and how many per token of a chunk.
HELD, HELD_PER_TOKEN = 4096, 8


# -- files ------------------------------------------------------------------------------------------


def open_file(path: str):
    """A seekable binary file: a local path, or an address that the Arrow file systems know (hdfs, s3, gs, file)."""
    if "://" not in path:
        return open(path, "rb")
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    return pa.PythonFile(system.open_input_file(at), mode="r")


def file_size(path: str) -> int:
    with open_file(path) as f:
        f.seek(0, 2)
        return f.tell()


def _sized(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``source_path, size`` of files, asked by the executors."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0)
            try:
                sizes = [file_size(p) for p in names.to_pylist()]
            except OSError as e:
                raise ParseError(f"can't read {e.filename or names.to_pylist()}: {e.strerror or e}") from None
            yield pa.RecordBatch.from_arrays([names, pa.array(sizes, pa.int64())], ["source_path", "size"])

    listed = spark.createDataFrame([(p,) for p in paths], "source_path string").repartition(max(1, min(len(paths), 4096)))
    return listed.mapInArrow(ask, "source_path string, size long")


def ranges(spark: SparkSession, paths: list[str], size: int = RANGE) -> DataFrame:
    """``source_path, part, start, stop, size``; an empty file is one range."""
    parts = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("size") / size) - 1, F.lit(0)).cast("int")))
    rows = _sized(spark, paths).select("source_path", "size", parts.alias("part"))
    start = F.col("part").cast("long") * size
    rows = rows.select("source_path", "part", start.alias("start"), F.least(start + size, F.col("size")).alias("stop"), "size")
    # listing tells little about the work: ranges are dealt out evenly
    return rows.repartition(max(spark.sparkContext.defaultParallelism, min(len(paths), 10_000)), "source_path", "part")


def file_hashes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``source_path, source_hash``: SHA-256 of each file, read piece by piece."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                h = hashlib.sha256()
                with open_file(path) as f:
                    while piece := f.read(READ):
                        h.update(piece)
                out.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["source_path", "source_hash"])

    listed = spark.createDataFrame([(p,) for p in paths], "source_path string").repartition(max(1, min(len(paths), 4096)))
    return listed.mapInArrow(digest, "source_path string, source_hash string")


class _Lines:
    """The lines of a file from a place on, with their places; at most READ bytes and one line are held."""

    def __init__(self, f, at: int):
        self.f, self.at, self.held = f, at, b""
        f.seek(at)

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        """Place and bytes of each line, its end included."""
        while True:
            end = self.held.find(b"\n")
            if end < 0:
                pieces = [self.held]
                while end < 0 and (piece := self.f.read(READ)):
                    pieces.append(piece)
                    end = piece.find(b"\n")
                self.held = b"".join(pieces)
                end = self.held.find(b"\n", len(self.held) - len(pieces[-1])) if end >= 0 else len(self.held) - 1
                if not self.held:
                    return
            # lines of what is held are cut in one go
            *whole, rest = self.held.split(b"\n")
            if not whole:
                yield self.at, rest
                self.at, self.held = self.at + len(rest), b""
                continue
            self.held = rest
            for line in whole:
                yield self.at, line + b"\n"
                self.at += len(line) + 1


def _lines(f, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """The lines that begin in ``start`` .. ``stop``."""
    lines = iter(_Lines(f, start - 1 if start else 0))
    if start:
        next(lines, None)  # the line that began before belongs to the range before
    for at, line in lines:
        if at >= stop:
            return
        yield at, line


# -- text -------------------------------------------------------------------------------------------


def _opens(f, at: int, grid: int) -> bool:
    """Whether the line at ``at`` is the first behind a point of the grid."""
    point = at - at % grid
    if point == at:
        return True
    if point == 0:
        return False
    here = f.tell()
    f.seek(point - 1)
    left, found = at - point, False
    while left > 0 and not found and (piece := f.read(min(READ, left))):
        found, left = b"\n" in piece, left - len(piece)
    f.seek(here)
    return not found


def _stretches(f, start: int, stop: int, grid: int) -> Iterator[tuple[int, Iterator[bytes]]]:
    """The stretches that begin in ``start`` .. ``stop``: place and lines."""
    lines = iter(_Lines(f, start - 1 if start else 0))
    if start:
        next(lines, None)
    ahead: list[tuple[int, bytes]] = []

    def until_next(at: int, line: bytes) -> Iterator[bytes]:
        yield line
        for place, line in lines:
            if place // grid != at // grid:
                ahead.append((place, line))
                return
            at = place
            yield line

    before = None
    for at, line in lines:
        if at >= stop:
            return
        if at // grid != before // grid if before is not None else _opens(f, at, grid):
            ahead.append((at, line))
            break
        before = at
    while ahead and ahead[0][0] < stop:
        at, line = ahead.pop()
        stretch = until_next(at, line)
        yield at, stretch
        for _ in stretch:  # what the caller left unread
            pass


def _texts(lines: Iterator[bytes], block: int) -> Iterator[str]:
    """Lines joined to blocks of about ``block`` characters; invalid UTF-8 is replaced."""
    held, length = [], 0
    for line in lines:
        held.append(line.decode("utf-8", "replace"))
        length += len(held[-1])
        if length >= block:
            yield "".join(held)
            held, length = [], 0
    if held:
        yield "".join(held)


def carried(blocks: Iterator[str], size: int, split: Callable[[str], list[str]]) -> Iterator[str]:
    """The pieces of a text that comes in blocks: what is held is cut once it is long enough, the last piece is carried on.

    Only the text and its chunk ``size`` decide where it is cut, not how it comes: blocks are cut anew.
    """
    enough = max(HELD_PER_TOKEN * size, HELD)
    held, waiting = "", ""
    for block in blocks:
        waiting += block
        while len(waiting) >= enough:
            held, waiting = held + waiting[:enough], waiting[enough:]
            *done, last = split(held) or [""]
            if done:
                yield from done
                # pieces are trimmed: the blanks behind the last one part it from what follows
                held = last + held[len(held.rstrip()) :]
    yield from split(held + waiting)


def text_pieces(spark: SparkSession, paths: list[str], chunk_size: int, split: Callable[[str], list[str]], count: Callable[[str], int], size: int = RANGE, grid: int = GRID) -> DataFrame:
    """``source_path, place, chunk_in_section, text, n_tokens``: the pieces of large text files.

    ``place`` is where a stretch begins in its file, chunk_in_section numbers its pieces.  They are the
    same whatever ``size`` is.  Empty files have none.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, stop in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                with open_file(path) as f:
                    for at, lines in _stretches(f, start, stop, grid):
                        texts = _texts(lines, BLOCK)
                        if at == 0:
                            texts = _without_mark(texts)
                        rows: list[str] = []
                        n = 0
                        for piece in carried(texts, chunk_size, split):
                            rows.append(piece)
                            if len(rows) == 1000:
                                yield _pieces(path, at, n, rows, count)
                                n, rows = n + len(rows), []
                        yield _pieces(path, at, n, rows, count)

    return ranges(spark, paths, size).mapInArrow(read, PIECES)


#: Columns of pieces and blocks.
PIECES = "source_path string, place long, chunk_in_section int, text string, n_tokens int"


def _without_mark(texts: Iterator[str]) -> Iterator[str]:
    for k, text in enumerate(texts):
        yield text.removeprefix("﻿") if k == 0 else text


def _pieces(path: str, at: int, first: int, rows: list[str], count: Callable[[str], int]) -> pa.RecordBatch:
    n = len(rows)
    arrays = [pa.array([path] * n, pa.string()), pa.array([at] * n, pa.int64()), pa.array(range(first, first + n), pa.int32()), pa.array(rows, pa.string()), pa.array(map(count, rows), pa.int32())]
    return pa.RecordBatch.from_arrays(arrays, ["source_path", "place", "chunk_in_section", "text", "n_tokens"])


def text_blocks(spark: SparkSession, paths: list[str], size: int = RANGE, block: int = BLOCK, grid: int = GRID) -> DataFrame:
    """``source_path, place, chunk_in_section, text``: large text files in blocks of about ``block`` characters, numbered within their stretch; blank ones are left out.

    Blocks end with a stretch of the file or once they are full, so that they are the same whatever ``size`` is.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, stop in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                with open_file(path) as f:
                    for at, lines in _stretches(f, start, stop, grid):
                        for k, text in enumerate(_texts(lines, block)):
                            yield _pieces(path, at, k, [text], len)

    return ranges(spark, paths, size).mapInArrow(read, PIECES).filter(F.trim("text") != "").drop("n_tokens")


# -- records ----------------------------------------------------------------------------------------


def _numbered(found: DataFrame, columns: str) -> DataFrame:
    """Rows (source_path, part, at, ...) with ``number``, counted over the file; a row with null text tells how many a range holds."""
    ends = found.filter(F.col("text").isNull())
    before = F.sum("at").over(Window.partitionBy("source_path").orderBy("part")) - F.col("at")
    # one row per range
    starts = ends.select("source_path", "part", before.alias("before"))
    rows = found.filter(F.col("text").isNotNull()).join(F.broadcast(starts), ["source_path", "part"])
    return rows.withColumn("number", (F.col("before") + F.col("at")).cast("int")).select("source_path", "number", *columns.split())


def line_records(spark: SparkSession, paths: list[str], size: int = RANGE) -> DataFrame:
    """``source_path, section_index, line, text``: one section per non-blank JSON line, with its number in the file.

    A line that isn't JSON fails the query and is named by its range.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, part, start, stop in zip(*(batch.column(k).to_pylist() for k in range(4))):
                rows, held, n = [], 0, 0
                with open_file(path) as f:
                    for n, (_, line) in enumerate(_lines(f, start, stop), 1):
                        text = line.decode("utf-8", "replace")
                        if not trim(text):
                            continue
                        try:
                            rows.append((n, shown(parse(text.removeprefix("﻿") if part == 0 and n == 1 else text))))
                        except (ValueError, RecursionError) as e:
                            raise ParseError(f"{path}: malformed JSON in line {n} behind byte {start}: {e}") from None
                        held += len(text)
                        if held > BLOCK:
                            yield _records(path, part, rows, None)
                            rows, held = [], 0
                yield _records(path, part, rows, n)

    found = ranges(spark, paths, size).mapInArrow(read, "source_path string, part int, at int, text string")
    return _numbered(found, "text").select("source_path", (F.col("number") - 1).alias("section_index"), F.col("number").alias("line"), "text")


def _records(path: str, part: int, rows: list[tuple[int, str]], end: int | None) -> pa.RecordBatch:
    rows = rows + ([(end, None)] if end is not None else [])
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array([part] * n, pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string())], ["source_path", "part", "at", "text"])


_BREAK = re.compile(rb'["\r\n]')


def csv_stretches(f, at: int, quoted: bool = False) -> Iterator[tuple[int, bytes, bool]]:
    """Place, bytes without line end, and whether it was closed, of each record from ``at`` on; ``quoted``: ``at`` lies within quotes.

    A quote opens or closes a quoted stretch wherever it stands; records end at CR, LF or both outside of them.
    """
    f.seek(at)
    held, begin, look, ended = b"", at, 0, False
    while True:
        m = _BREAK.search(held, look)
        # a carriage return at the end of what is held may be followed by a line feed
        if m is None or m[0] == b"\r" and m.end() == len(held) and not ended:
            look = len(held) if m is None else m.start()
            piece = f.read(READ)
            if piece:
                held += piece
                continue
            if m is None:
                break
            ended = True
            continue
        look = m.end()
        if m[0] == b'"':
            quoted = not quoted
        elif not quoted:
            stop, look = m.start(), look + (m[0] == b"\r" and held[look : look + 1] == b"\n")
            yield begin, held[:stop], True
            begin, held, look = begin + look, held[look:], 0
    if held:
        yield begin, held, not quoted


def csv_records(spark: SparkSession, paths: list[str], size: int = RANGE) -> DataFrame:
    """``source_path, section_index, row, columns, text``: one section per data row of CSV files with a header.

    Rows of one empty cell are left out but numbered; missing cells are empty, further ones left out.  A
    quote that is never closed fails the query.
    """
    parts = ranges(spark, paths, size)

    def quotes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in range(5))))
            odd = []
            for path, _, start, stop, _ in rows:
                with open_file(path) as f:
                    f.seek(start)
                    n, left = 0, stop - start
                    while left > 0 and (piece := f.read(min(READ, left))):
                        n, left = n + piece.count(b'"'), left - len(piece)
                odd.append(n % 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(odd, pa.int32())], [*batch.schema.names, "odd"])

    counted = parts.mapInArrow(quotes, "source_path string, part int, start long, stop long, size long, odd int")
    # one row per range
    before = (F.sum("odd").over(Window.partitionBy("source_path").orderBy("part")) - F.col("odd")) % 2 == 1
    opened = counted.select("source_path", "part", "start", "stop", before.alias("quoted"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, part, start, stop, quoted in zip(*(batch.column(k).to_pylist() for k in range(5))):
                with open_file(path) as f:
                    head = next(csv_stretches(f, 0), None)
                    names = (csv_rows(head[1].decode("utf-8", "replace").removeprefix("﻿")) or [[]])[0] if head else []
                    rows, held, n = [], 0, 0
                    for at, raw, closed in _own_records(f, start, quoted):
                        if at >= stop:
                            break
                        if not closed:
                            raise ParseError(f"{path}: a quoted value isn't closed in the record at byte {at}")
                        if at == 0:
                            continue
                        n += 1
                        cells = (csv_rows(raw.decode("utf-8", "replace")) or [[""]])[0]
                        if len(cells) == 1 and not cells[0].strip():
                            continue
                        rows.append((n, cells + [""] * (len(names) - len(cells))))
                        held += len(raw)
                        if held > BLOCK:
                            yield _csv_batch(path, part, names, rows, None)
                            rows, held = [], 0
                yield _csv_batch(path, part, names, rows, n)

    found = opened.mapInArrow(read, "source_path string, part int, at int, text string, names array<string>, cells array<string>")
    rows = _numbered(found, "text names cells")
    # of columns of one name the last counts
    columns = F.map_from_entries(F.filter(F.arrays_zip("names", "cells"), lambda e, i: ~F.array_contains(F.slice(F.col("names"), i + 2, F.greatest(F.size("names"), F.lit(1))), e["names"])))
    return rows.select("source_path", (F.col("number") - 1).alias("section_index"), F.col("number").alias("row"), columns.alias("columns"), "text")


def _own_records(f, start: int, quoted: bool) -> Iterator[tuple[int, bytes, bool]]:
    """The records that begin at ``start`` or behind it; ``quoted``: whether ``start`` lies within quotes."""
    if start == 0:
        yield from csv_stretches(f, 0)
        return
    # one byte ahead: a line end there makes a record begin at start
    f.seek(start - 1)
    last = f.read(1)
    records = csv_stretches(f, start - 1, quoted != (last == b'"'))
    next(records, None)
    yield from (r for r in records if r[0] >= start)


def _csv_batch(path: str, part: int, names: list[str], rows: list[tuple[int, list[str]]], end: int | None) -> pa.RecordBatch:
    texts = ["\n".join(f"{h}: {v}" for h, v in zip(names, cells)) for _, cells in rows]
    more = end is not None
    n = len(rows) + more
    at = [r[0] for r in rows] + [end] * more
    cells = [r[1][: len(names)] for r in rows] + [None] * more
    strings = pa.list_(pa.string())
    return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array([part] * n, pa.int32()), pa.array(at, pa.int32()), pa.array(texts + [None] * more, pa.string()), pa.array([names] * n, strings), pa.array(cells, strings)], ["source_path", "part", "at", "text", "names", "cells"])
