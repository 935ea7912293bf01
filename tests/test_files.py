import os

import pytest

from sedimenta.errors import ParseError, UserError
from sedimenta.plans.embed_plan import EmbedPlan, content_extension, heuristic_plan, load_plan, merge_plan, model_plan, parse_metadata, plans_of, slug
from sedimenta.sources.files import expand_inputs, parse_file, parse_files, parse_texts, read_files, sniff
from tests.test_parsers import docx, pdf


def tree(root, names):
    for n in names:
        os.makedirs(os.path.dirname(f"{root}/{n}"), exist_ok=True)
        with open(f"{root}/{n}", "w") as f:
            f.write("x")


def test_expand(tmp_path):
    root = str(tmp_path)
    tree(root, ["a.md", "b/c.txt", "b/.hidden", "node_modules/x.md", "b/dist/y.md", "z.md"])
    os.symlink(f"{root}/b", f"{root}/link")
    os.symlink(f"{root}/a.md", f"{root}/b/alias.md")
    base = lambda got: [os.path.relpath(p, root) for p in got]
    assert base(expand_inputs(["."], root)) == ["a.md", "b/.hidden", "b/alias.md", "b/c.txt", "z.md"]
    assert base(expand_inputs(["*.md", "a.md", "**/*.{txt,md}"], root)) == ["a.md", "b/alias.md", "b/c.txt", "z.md"]
    assert base(expand_inputs(["node_modules/x.md"], root)) == ["node_modules/x.md"]
    for bad in ("none.md", "*.pdf", "link"):
        with pytest.raises(UserError):
            expand_inputs([bad], root)


def test_sniff():
    assert [sniff(x) for x in (b"%PDF-1", b"a\0b", b"\xff\xfe", b"  <!DOCTYPE html><p>", b"\xef\xbb\xbf[1]", b"plain", b"\x01\x02\x03abc", b"")] == ["pdf", "binary", "binary", "html", "json", "text", "binary", "text"]
    assert sniff("é".encode() * 4095 + b"x" + "é".encode()) == "text", "a character cut at the end is no error"


def test_extension_and_plan(spark):
    assert [content_extension(p) for p in ("a/B.MD", "x.md.1", "x.zip.1", ".profile", "noext")] == ["md", "md", "1", "", ""]
    assert slug("/x/Foo Bar.PDF") == "foo-bar" and slug("__.md") == "default" and slug("--A_b--.txt") == "a_b"
    p = heuristic_plan("t/Data.csv", "m", overlap=0)
    assert (p.splitter, p.chunk_size, p.collection) == ("csv", 4096, "data") and load_plan(p.to_json()) == p and len(p.hash) == 64
    assert merge_plan(p, chunk_size=99, metadata={"a": "b"}).metadata == {"a": "b"} and parse_metadata("a=b=c, d=") == {"a": "b=c", "d": ""}
    for bad in (lambda: EmbedPlan("x", 1, 0, "c", "m"), lambda: EmbedPlan("csv", 10, 10, "c", "m"), lambda: EmbedPlan("csv", 10, 1, "C", "m"), lambda: load_plan("{"), lambda: parse_metadata("x")):
        with pytest.raises(UserError):
            bad()
    answers = iter(["no json", '```json\n{"splitter":"markdown","chunkSize":400,"overlap":40,"collection":"kb"}\n```'])
    assert model_plan("text", "a.md", "m", lambda prompt: next(answers)).chunk_size == 400
    rows = plans_of(spark.createDataFrame([("a/x.md.2",), (None,), ("b/.env",)], "source_path string")).collect()
    assert {r["source_path"]: (r["splitter"], r["collection"]) for r in rows} == {"a/x.md.2": ("markdown", "x-md"), None: ("recursive", "default"), "b/.env": ("recursive", "env")}


def test_dispatch():
    assert parse_file("a.md", b"<!doctype html><body><p>" + b"words of a page, more of them " * 5)[0] == "html"
    assert parse_file("a.bin", b'{"a": 1}') == ("json", [{"text": "1", "key_path": "a"}]) and parse_file("x.mjs", b"a")[1][0]["language"] == "unknown"
    assert parse_file("a.docx", docx((None, "hi")))[1][0]["text"] == "hi" and [s["page_number"] for s in parse_file("a.pdf", pdf("p", "", "q"))[1]] == [1, 3]
    with pytest.raises(ParseError):
        parse_file("a.txt", b"\0\1")


def test_tables(spark, tmp_path):
    tree(str(tmp_path), ["a.md", ".dot.txt"])
    (tmp_path / "a.md").write_text("# A\n\nx\n\n## B\n\ny")
    (tmp_path / "c.csv").write_text("h\nv\n")
    rows = parse_files(read_files(spark, expand_inputs([str(tmp_path)]))).collect()
    got = sorted((os.path.basename(r["source_path"]), r["section_index"], r["text"]) for r in rows)
    assert got == [(".dot.txt", 0, "x"), ("a.md", 0, "# A\n\nx"), ("a.md", 1, "## B\n\ny"), ("c.csv", 0, "h: v")]
    bad = parse_texts(spark.createDataFrame([("x.json", "{"), ("y.json", None), ("z.txt", "")], "source_path string, text string")).collect()
    assert {r["source_path"]: r["error"] is not None for r in bad} == {"x.json": True, "y.json": True, "z.txt": False}


def test_blocks(spark, tmp_path):
    from sedimenta.sources.blocks import line_records, text_blocks

    text = "\n".join(f"line {i} é" + "\n" * (i % 3 == 0) for i in range(400)) + "\nlast without end"
    (tmp_path / "t.txt").write_text(text)
    for size, block in ((97, 40), (1000, 200), (10**6, 10**6)):
        rows = text_blocks(spark, [str(tmp_path / "t.txt")], size, block).orderBy("place", "chunk_in_section").collect()
        assert "".join("".join(r["text"] for r in rows).split()) == "".join(text.split()) and len({(r["place"], r["chunk_in_section"]) for r in rows}) == len(rows)
    lines = [f'{{"i": {i}}}' if i % 4 else "" for i in range(300)]
    (tmp_path / "t.jsonl").write_text("\n".join(lines))
    for size in (50, 10**6):
        got = {r["line"]: r["text"] for r in line_records(spark, [str(tmp_path / "t.jsonl")], size).collect()}
        assert got == {i + 1: '{\n  "i": %d\n}' % i for i in range(300) if i % 4}
    (tmp_path / "e.txt").write_text("")
    assert text_blocks(spark, [str(tmp_path / "e.txt")]).count() == 0 and line_records(spark, [str(tmp_path / "e.txt")]).count() == 0
