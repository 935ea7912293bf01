"""Files: listing of inputs, type detection, and their sections as a table."""

from __future__ import annotations

import glob
import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sedimenta.errors import ParseError, UserError
from sedimenta.functions.jstext import BLANKS
from sedimenta.plans.embed_plan import LANGUAGES, SPLITTERS, content_extension
from sedimenta.sources import markdown, office, records, webpage
from sedimenta.sources.blocks import open_file

#: Folders that listings leave out; bytes looked at to tell a type; size limit of files read whole.
IGNORED = frozenset((".git", "node_modules", ".sedimenta", "dist", "chroma"))
SNIFFED, WHOLE_LIMIT = 8192, 100 * 1024 * 1024
#: Content type by extension.
CONTENT = {"md": "markdown", "mdx": "markdown", "markdown": "markdown", "pdf": "pdf", "html": "html", "htm": "html", "docx": "docx", "csv": "csv", "json": "json", "jsonl": "json", "ndjson": "json", "txt": "text", "text": "text", "log": "text"} | {k: "code" for k, v in SPLITTERS.items() if v == "code"}

SECTIONS = (
    "source_path string, content_type string, section_index int, text string, language string, key_path string, item int, line int, `row` int, columns map<string,string>, "
    "header_path array<string>, header_depth int, heading string, extraction_origin string, page_number int, page_count int, state_left_out int, error string"
)


def expand_inputs(inputs: list[str], cwd: str = ".") -> list[str]:
    """Absolute paths of files, of the files below folders and of those a glob pattern matches; sorted, each once.

    Dotfiles are included; links to folders are refused or not followed, links to files are files.
    Ignored folders are left out below folders and of globs, but not of files named outright.  An
    input that yields nothing is an error.
    """
    found: set[str] = set()
    for given in inputs:
        path = os.path.normpath(os.path.join(os.path.abspath(cwd), given))
        if os.path.islink(path) and os.path.isdir(path):
            raise UserError(f"{given} is a link to a folder")
        if os.path.isfile(path):
            new = {path}
        elif os.path.isdir(path):
            new = set()
            for at, folders, names in os.walk(path):
                folders[:] = [d for d in folders if d not in IGNORED and not os.path.islink(os.path.join(at, d))]
                new |= {os.path.join(at, n) for n in names if os.path.isfile(os.path.join(at, n))}
        elif re.search(r"[*?\[{]", given):
            new = {os.path.normpath(p) for q in _braces(path) for p in glob.glob(q, recursive=True, include_hidden=True) if os.path.isfile(p)}
            base = os.path.dirname(re.split(r"[*?\[{]", path)[0])
            new = {p for p in new if not IGNORED & set(p.split(os.sep)) and not _linked(p, base)}
        else:
            raise UserError(f"{given} doesn't exist")
        if not new:
            raise UserError(f"{given} matches no file")
        found |= new
    return sorted(found, key=lambda p: p.encode("utf-16-be", "surrogatepass"))


def _linked(path: str, base: str) -> bool:
    """Whether a folder between ``base`` and the file is a link."""
    at = os.path.dirname(path)
    while len(at) > len(base):
        if os.path.islink(at):
            return True
        at = os.path.dirname(at)
    return False


def _braces(pattern: str) -> list[str]:
    m = re.search(r"\{([^{}]*)\}", pattern)
    return [pattern] if not m else [q for part in m[1].split(",") for q in _braces(pattern[: m.start()] + part + pattern[m.end() :])]


def sniff(head: bytes) -> str:
    """What the first bytes of a file look like: pdf, binary, html, json or text."""
    head = head[:SNIFFED]
    if head.startswith(b"%PDF-"):
        return "pdf"
    if b"\0" in head:
        return "binary"
    try:
        text = head.decode("utf-8")
    except UnicodeDecodeError as e:
        # a character cut at the end of the stretch is no error
        if len(head) < SNIFFED or e.start < len(head) - 3 or e.reason != "unexpected end of data":
            return "binary"
        text = head[: e.start].decode("utf-8")
    start = text.lstrip("\ufeff \t\r\n\f\v")
    if re.match(r"<!doctype html|<html\b", start, re.I):
        return "html"
    if start[:1] in ("{", "["):
        return "json"
    odd = sum(1 for c in text if ord(c) < 32 and c not in "\t\n\r\f\b")
    return "binary" if odd > 0.02 * max(1, len(text)) else "text"


def sniff_column(text: Column) -> Column:
    """``sniff`` of a text column (which can't hold invalid UTF-8), as a native expression."""
    head = F.substring(text, 1, SNIFFED)
    start = F.regexp_replace(head, "^[\ufeff \\t\\r\\n\\f\\x0b]+", "")
    odd = F.length(head) - F.length(F.regexp_replace(head, r"[\x00-\x07\x0b\x0e-\x1f]", ""))
    return (
        F.when(head.startswith("%PDF-"), "pdf").when(F.instr(head, "\0") > 0, "binary")
        .when(F.lower(F.substring(start, 1, 14)).rlike(r"^(?:<!doctype html|<html\b)"), "html").when(start.rlike(r"^[\[{]"), "json")
        .when(odd > 0.02 * F.greatest(F.length(head), F.lit(1)), "binary").otherwise("text")
    )


def parse_file(path: str, data: bytes, limits: webpage.StateLimits = webpage.StateLimits()) -> tuple[str, list[dict]]:
    """Content type and sections of one file: the content beats the extension for PDF and HTML, binary files are refused."""
    ext, kind = content_extension(path), sniff(data)
    content = "pdf" if kind == "pdf" else "docx" if ext == "docx" else "html" if kind == "html" else CONTENT.get(ext, "json" if kind == "json" else "text")
    if kind == "binary" and content != "docx":
        raise ParseError(f"{path} is binary")
    if content == "pdf":
        pages = office.pdf_pages(data)
        return content, [{"text": p, "page_number": i, "page_count": len(pages)} for i, p in enumerate(pages, 1) if p]
    if content == "docx":
        return content, markdown.sections(office.docx_markdown(data))
    text = data.decode("utf-8", "replace")
    if content == "html":
        return content, webpage.page_sections(text, limits)
    if content == "markdown":
        return content, markdown.sections(text)
    if content == "csv":
        return content, records.csv_sections(text, strict=True)
    if content == "json":
        return content, records.jsonl_sections(text) if ext in ("jsonl", "ndjson") else records.json_sections(text) if ext == "json" or ext not in CONTENT else [{"text": text}]
    if content == "code":
        return content, [{"text": text, "language": LANGUAGES.get(os.path.splitext(path)[1][1:].lower(), "unknown")}]
    return content, [{"text": text}]


def read_files(spark: SparkSession, paths: list[str], limit: int = WHOLE_LIMIT) -> DataFrame:
    """``source_path, content, source_hash`` of listed files that are to be read whole.

    Spark's binary reader skips names that begin with a dot or an underscore, so the executors open the
    files themselves; they need to see the same file system.  A file above ``limit`` bytes or one that
    can't be read fails the query with a ParseError that names it; larger files of running text, code,
    CSV and JSON lines are read in ranges (``file_chunks``).
    """

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    with open_file(path) as f:
                        data = f.read(limit + 1)
                except OSError as e:
                    raise ParseError(f"can't read {path}: {e.strerror or e}") from None
                if len(data) > limit:
                    raise ParseError(f"{path} is larger than {limit} bytes; convert it to text, CSV or JSON lines")
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([data], pa.binary()), pa.array([hashlib.sha256(data).hexdigest()])], ["source_path", "content", "source_hash"])

    listed = spark.createDataFrame([(p,) for p in paths], "source_path string").repartition(max(1, min(len(paths), 4096)))
    return listed.mapInArrow(load, "source_path string, content binary, source_hash string")


def parse_files(files: DataFrame, on_error: str = "raise", limits: webpage.StateLimits = webpage.StateLimits()) -> DataFrame:
    """The sections of files (``source_path, content``), in the columns of ``SECTIONS``.

    ``on_error="keep"`` gives a file that can't be parsed one row with null text and the reason in
    ``error``; otherwise it fails the query.  Empty files have no section.  ``limits``: how far page
    state is searched; state_left_out tells what that left out.
    """
    schema = to_arrow_schema(files.sparkSession.createDataFrame([], SECTIONS).schema)
    names = schema.names

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    kind, found = parse_file(path, data or b"", limits)
                except ParseError as e:
                    if on_error != "keep":
                        raise
                    kind, found = None, [{"text": None, "error": str(e)}]
                for i, s in enumerate(found):
                    columns = s.get("columns")
                    rows.append({k: s[k] for k in s if k in names} | {"source_path": path, "content_type": kind, "section_index": i, "item": s.get("index"), "columns": columns and list(columns.items())})
                if len(rows) >= 1000:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("source_path", "content").mapInArrow(parse, SECTIONS)


def parse_texts(rows: DataFrame, path: str = "source_path", text: str = "text", on_error: str = "keep") -> DataFrame:
    """``parse_files`` of a table that holds the texts themselves; null texts are empty files."""
    return parse_files(rows.select(F.col(path).alias("source_path"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("content")), on_error)


def text_hashes(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, source_hash``: SHA-256 of texts as of files that hold them; a null text is an empty file."""
    return rows.select(key, F.sha2(F.coalesce(text, F.lit("")), 256).alias("source_hash"))


def text_lines(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, line, text``: the lines that aren't blank, with their numbers."""
    lines = rows.select(key, F.posexplode(F.split(text, "\n")).alias("at", "text"))
    return lines.filter(F.col("text").rlike(f"[^{BLANKS}]")).select(key, (F.col("at") + 1).alias("line"), "text")
