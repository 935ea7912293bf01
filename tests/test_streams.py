"""Files in byte ranges, against reading them whole; chunks that don't depend on the ranges."""

import hashlib
import json
import random
import re

import pytest

from sedimenta.errors import ParseError
from sedimenta.operators.chunking import chunk_sections, split_text
from sedimenta.operators.file_chunks import file_chunks, file_kinds, text_chunks
from sedimenta.plans.embed_plan import EmbedPlan
from sedimenta.sources import blocks
from sedimenta.sources.files import parse_files, read_files
from sedimenta.sources.records import csv_sections

PLAN = EmbedPlan("recursive", 60, 10, "kb", "m", {"team": "x"})


def in_ranges(data, size):
    return [(a, min(a + size, len(data))) for a in range(0, max(len(data), 1), size)]


def test_kernels_against_whole_files(monkeypatch):
    import io

    rng = random.Random(2)
    for _ in range(600):
        monkeypatch.setattr(blocks, "READ", rng.choice((1, 2, 3, 7, 50)))
        grid = rng.choice((3, 5, 9, 20))
        data = "".join(rng.choice(('a', 'bb', '"', "\n", "\r\n", ",", "é", "\r", '""', "longer line\n")) for _ in range(rng.randint(0, 40))).encode()
        f, size = io.BytesIO(data), rng.randint(1, 25)
        lines = [line for a, z in in_ranges(data, size) for _, line in blocks._lines(f, a, z)]
        assert lines == data.splitlines(True) if b"\r" not in data else b"".join(lines) == data
        parts = [(at, b"".join(ls)) for a, z in in_ranges(data, size) for at, ls in blocks._stretches(f, a, z, grid)]
        assert parts == [(at, b"".join(ls)) for at, ls in blocks._stretches(f, 0, len(data), grid)] and b"".join(p for _, p in parts) == data
        records, quoted = [], False
        for a, z in in_ranges(data, size):
            for r in blocks._own_records(f, a, quoted):
                if r[0] >= z:
                    break
                records.append(r)
            quoted ^= data[a:z].count(b'"') % 2 == 1
        assert records == list(blocks.csv_stretches(f, 0))


def test_carry():
    # blanks at the edge of a block part words
    spaced = "ab " * 5000
    for step in (1, 2, 4096, 4097):
        got = list(blocks.carried((spaced[i : i + step] for i in range(0, len(spaced), step)), 40, lambda t: split_text(t, "recursive", 40, 0, len)))
        assert {w for p in got for w in p.split()} == {"ab"}
    text = "".join(random.Random(3).choices(("word ", "x. ", "\n\n", "\n"), k=6000))
    split = lambda t: split_text(t, "recursive", 40, 0, len)
    whole = list(blocks.carried(iter([text]), 40, split))
    for step in (1, 13, 4095, 4096, 10**6):
        assert list(blocks.carried((text[i : i + step] for i in range(0, len(text), step)), 40, split)) == whole
    # separators between chunks are dropped
    kept = lambda t: re.sub(r"[\s.]", "", t)
    assert kept("".join(whole)) == kept(text) and list(blocks.carried(iter([]), 40, split)) == []


def test_chunks_dont_depend_on_ranges(spark, tmp_path):
    path = str(tmp_path / "t.txt")
    text = "﻿" + "\n".join(f"Line {i} é of the text." + "\n" * (i % 7 == 0) for i in range(400)) + "\n" + "long line " * 300
    (tmp_path / "t.txt").write_text(text)
    want = None
    for size in (97, 700, 1000, 10**6):
        got = [tuple(r) for r in text_chunks(spark, [path], PLAN, "words", size=size, grid=700).orderBy("chunk_index").collect()]
        want = want or got
        assert got == want
    assert [r[4] for r in want] == list(range(len(want))) and "".join("".join(r[5] for r in want).split()) != ""
    meta = json.loads(want[1][7])
    assert meta == {"contentType": "text", "team": "x", "sectionIndex": 0, "chunkInSection": 1, "sourcePath": path, "chunkIndex": 1}
    assert want[0][5].startswith("Line 0") and all(r[6] <= 60 for r in want)
    held = " ".join(r[5] for r in want)
    assert all(f"Line {i} é" in held for i in range(400))


def test_csv(spark, tmp_path):
    rng = random.Random(4)
    cells = ("plain", '"quoted, with comma"', '"two\nlines"', '"a ""quote"""', '"cr\rlf\r\n"', "", "é日")
    for k, ends in enumerate(("\n", "\r\n", "\r")):
        text = "a,b,a" + ends + "".join(",".join(rng.choices(cells, k=rng.choice((1, 2, 3, 4)))) + ends for _ in range(200))
        (tmp_path / f"{k}.csv").write_bytes(text.encode())
    paths = [str(tmp_path / f"{k}.csv") for k in range(3)]
    for size in (31, 500, 10**6):
        got = {}
        for r in blocks.csv_records(spark, paths, size).collect():
            got.setdefault(r["source_path"], []).append((r["row"], r["text"], r["columns"]))
        for path in paths:
            want = [(s["row"], s["text"], s["columns"]) for s in csv_sections(open(path, newline="").read(), True)]
            assert sorted(got[path]) == want
    (tmp_path / "open.csv").write_text('a,b\n1,"never closed\n2,3\n')
    with pytest.raises(Exception, match="isn't closed"):
        blocks.csv_records(spark, [str(tmp_path / "open.csv")], 5).collect()
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "head.csv").write_text("﻿a,b\n")
    assert blocks.csv_records(spark, [str(tmp_path / "none.csv"), str(tmp_path / "head.csv")]).count() == 0


def test_files_of_every_kind(spark, tmp_path):
    texts = {"a.md": "# A\n\none", "b.txt": "two", "c.csv": "h\nv\nw\n", "d.jsonl": '{"k": 1}\n\n{"k": 2}\n', "e.py": "def f():\n    return 1\n", "f.json": '[1, {"x": 2}]', "g.txt": "<!doctype html><body><main><h1>Page</h1><p>Words of a page, some of them, and long enough to be read as one.</p></main>", "h.txt": "", ".dot": "hidden"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    paths = [str(tmp_path / n) for n in texts]
    kinds = {p.rpartition("/")[2]: k for p, k in file_kinds(spark, paths).items()}
    assert kinds == {"a.md": "whole", "b.txt": "text", "c.csv": "csv", "d.jsonl": "jsonl", "e.py": "code", "f.json": "whole", "g.txt": "whole", "h.txt": "text", ".dot": "text"}
    got = file_chunks(spark, paths, PLAN, "words")
    rows = got.collect()
    by = {}
    for r in sorted(rows, key=lambda r: r["chunk_index"]):
        by.setdefault(r["source_path"].rpartition("/")[2], []).append(r["text"])
    assert by["c.csv"] == ["h: v", "h: w"] and by["d.jsonl"] == ['{\n  "k": 1\n}', '{\n  "k": 2\n}'] and by["b.txt"] == ["two"] and "h.txt" not in by and by[".dot"] == ["hidden"] and by["g.txt"][0].startswith("# Page")
    meta = {r["source_path"].rpartition("/")[2]: json.loads(r["meta_json"]) for r in rows}
    assert meta["e.py"]["language"] == "python" and meta["c.csv"]["columns"] and meta["d.jsonl"]["line"] == 3
    # records and documents have the ids that reading them whole gives
    whole = chunk_sections(parse_files(read_files(spark, [p for p in paths if not p.endswith((".txt", ".py", ".dot"))])), PLAN, "words")
    assert {r["chunk_id"] for r in whole.collect()} <= {r["chunk_id"] for r in rows}


def test_reading(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x" * 3_000_000)
    path = str(tmp_path / "a.txt")
    want = hashlib.sha256(b"x" * 3_000_000).hexdigest()
    assert [tuple(r) for r in blocks.file_hashes(spark, [path]).collect()] == [(path, want)]
    assert blocks.file_hashes(spark, [f"file://{path}"]).first()["source_hash"] == want, "addresses of file systems are read, too"
    with pytest.raises(Exception, match="larger than"):
        read_files(spark, [path], limit=100).collect()
    for read in (read_files, blocks.ranges, file_kinds):
        with pytest.raises(Exception, match="can't read"):
            got = read(spark, [str(tmp_path / "none.txt")])
            got.collect()
    assert issubclass(ParseError, Exception)
