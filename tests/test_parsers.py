import io
import zipfile

import pytest

from sedimenta.errors import ParseError
from sedimenta.functions import jstext
from sedimenta.functions.htmltree import parse, render
from sedimenta.sources import markdown, office, records, webpage


def test_numbers_and_json():
    cases = [(1.0, "1"), (0.1, "0.1"), (1e21, "1e+21"), (1.5e-7, "1.5e-7"), (1e20, "100000000000000000000"), (-0.0, "0"), (1e-6, "0.000001"), (123456789012345678, "123456789012345680"), (float("inf"), "null")]
    assert [jstext.number(x) for x, _ in cases] == [y for _, y in cases]
    assert jstext.stringify({"b": [1, {}], "2": None, "1": "é\n"}, 2) == '{\n  "1": "é\\n",\n  "2": null,\n  "b": [\n    1,\n    {}\n  ]\n}'
    assert jstext.canonical({"b": 1.0, "a": {"d": [], "c": True}}) == '{"a":{"c":true,"d":[]},"b":1}'
    assert jstext.trim("\ufeff\u00a0 x\u2003") == "x" and jstext.trim("\x85x") == "\x85x" and jstext.collapse(" a \n b ") == "a b"


def test_csv():
    assert records.csv_rows('a,"b ""c"", d",e\r\n1,"two\nlines",3\r4') == [["a", 'b "c", d', "e"], ["1", "two\nlines", "3"], ["4"]]
    got = records.csv_sections("\ufeffh1,h2,h1\nx\n\ny,z,w,v\n")
    assert [(s["row"], s["text"], s["columns"]) for s in got] == [(1, "h1: x\nh2: \nh1: ", {"h1": "", "h2": ""}), (3, "h1: y\nh2: z\nh1: w", {"h1": "w", "h2": "z"})]
    assert records.csv_rows('a,"b') == [["a", "b"]] and records.csv_sections("") == []
    with pytest.raises(ParseError):
        records.csv_rows('a,"b', strict=True)


def test_json():
    assert [s["text"] for s in records.json_sections('["x", null, 1.0, {"a": 1}]')] == ["x", "", "1", '{\n  "a": 1\n}']
    assert [(s["key_path"], s["text"]) for s in records.json_sections('{"k": [1]}')] == [("k", "[\n  1\n]")] and records.json_sections("7") == [{"text": "7"}]
    assert [(s["line"], s["text"]) for s in records.jsonl_sections('{"a":1}\n\n"x"\r\n')] == [(1, '{\n  "a": 1\n}'), (3, "x")]
    with pytest.raises(ParseError, match="line 2"):
        records.jsonl_sections("1\n{")
    for bad in ("{", "NaN", "[" * 100_000):
        with pytest.raises(ParseError):
            records.json_sections(bad)


def test_markdown():
    raw = "before\n\n---\ntitle: x\ntags:\n  - a\n---\n\n# A *b* [c](d)\n\n## Empty\n\n### Deep\ntext\n\n```\n# no heading\n```\n\nSetext\n======\nend"
    got = markdown.sections(raw)
    assert [(s["header_path"], s["header_depth"]) for s in got] == [(["A b c"], 1), (["A b c", "Empty", "Deep"], 3), (["Setext"], 1)]
    assert got[0]["text"] == "# A *b* [c](d)\n\nbefore" and "# no heading" in got[1]["text"]
    assert markdown.sections("- item\n  # in item\n\n> # quoted\n\n<div>\n# in html\n</div>") == [{"text": "- item\n  # in item\n\n> # quoted\n\n<div>\n# in html\n</div>", "header_path": [], "header_depth": 0}]
    assert markdown.sections("") == [] and markdown.sections("# only") == [] and markdown.sections("## B\nx")[0]["header_path"] == ["B"]


PAGE = """<!doctype html><html><body><nav><ul><li><a href=/>Home page of the site</a></ul></nav>
<main><article><header><h1>Title</h1></header><p>First <b>bold</b> and <a href="/x">link [1]</a>, long enough to count.<p>Second
<pre class="language-js"><code>let a = `1`;
</code></pre><ul><li>one<ol><li>two</ol><li>three</ul><table><tr><th>h|1<td>b</tr><tr><td>c</table><blockquote>q<br>r</blockquote></article></main>
<footer>© me</footer></body></html>"""


def test_page():
    text, origin, _ = webpage.to_markdown(PAGE)
    assert origin == "document" and "Home page" not in text and "©" not in text
    for part in ("# Title", "First **bold** and [link \\[1\\]](/x), long", "```javascript\nlet a = `1`;\n```", "- one\n\n  1. two\n- three", "| h\\|1 | b |\n| --- | --- |\n| c |  |", "> q\n> r"):
        assert part in text, part
    assert webpage.page_sections(PAGE)[0]["heading"] == "Title"


def test_page_state():
    import json

    article = "<article><h1>State</h1>" + "<p>Words of the article, some of them.</p>" * 8 + "</article>"
    page = f"<html><body><div id=app></div><script type=application/json>{json.dumps({'a': [article], 'b': '<main><h1>Short</h1><p>x</main>'})}</script></body></html>"
    text, origin, left_out = webpage.to_markdown(page)
    assert origin == "embedded-json" and text.startswith("# State") and left_out == 1
    assert webpage.to_markdown(page, webpage.EXACT)[1:] == ("embedded-json", 0)
    assert webpage.state_pages(page, webpage.StateLimits(strings=0)) == ([], 2) and webpage.state_pages(page, webpage.StateLimits(characters=5)) == ([], 1) and webpage.state_pages(page, webpage.StateLimits(values=1)) == ([], 1)
    for bad in ("", "<p>short</p>", "<nav>" + "x" * 100 + "</nav>"):
        with pytest.raises(ParseError):
            webpage.to_markdown(bad)


def test_tree():
    got = render(parse("<div hidden>no</div><p>a<p>b<ul><li>x<li>y</ul><table><tr><td>1<td>22<tr><td>333<td>4</table></b></i>tail <!-- c --> &amp; end"))
    assert got == "a\n\nb\n\n- x\n- y\n\n1     22\n333   4\n\ntail & end"
    assert render(parse("<div>" * 5000 + "deep" + "</div>" * 5000)) == "deep" and render(parse("")) == ""


def test_tables_without_rows():
    assert render(parse("<table><td>cell text<td>two</table> after")) == "cell text   two\n\nafter"
    assert render(parse("<table>stray text<tr><td>x</table>")) == "stray text\n\nx"
    assert render(parse("<table><b>bold<tr><td>y<td><table><td>in</table></table>")) == "bold\n\ny   in"


def test_any_depth():
    assert render(parse("<ul><li><p>a</p><ul><li>b<ol><li>c<li>d</ol></ul><li>e</ul>")) == "- a\n  - b\n    1. c\n    2. d\n- e"
    for opened, lines in (("<ul><li>x", 2000), ("<blockquote>x", 2000), ("<b>x", 1), ("<table><tr><td>x", 1)):
        text = render(parse(opened * 2000))
        assert text.count("x") == 2000 and len([t for t in text.split("\n") if t.strip()]) == lines
    assert "(2000) - x" in render(parse("<ul><li>x" * 2000))
    text, *_ = webpage.to_markdown("<article><h1>Deep</h1><p>Words of the article, some of them.</p>" + "<ul><li>x" * 2000 + "</article>")
    assert text.count("- x") == 2000
    tree = parse("<div>" * 3000 + "<p>end")
    assert sum(1 for _ in tree.walk()) == 3002, "no node is lost, none stands beside its parent"


def docx(*paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p><w:pPr>{f"""<w:pStyle w:val="{style}"/>""" if style else ""}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>' for style, text in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def pdf(*pages):
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (3 + 2 * i) for i in range(len(pages))) + b"] /Count %d >>" % len(pages)}
    for i, text in enumerate(pages):
        stream = b"BT /F1 12 Tf 72 720 Td (" + text.encode("cp1252") + b") Tj ET"
        objects[3 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (4 + 2 * i)
        objects[4 + 2 * i] = b"<< /Length %d >>\nstream\n%s\nendstream" % (len(stream), stream)
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % kv for kv in objects.items()) + b"%%EOF"


def test_word_and_pdf():
    got = markdown.sections(office.docx_markdown(docx(("Heading1", "Top"), (None, "text"), ("Heading2", "Sub"), (None, "more"))))
    assert [(s["header_path"], s["text"]) for s in got] == [(["Top"], "# Top\n\ntext"), (["Top", "Sub"], "## Sub\n\nmore")]
    assert office.pdf_pages(pdf("One \\(1\\)", "", "Three é")) == ["One (1)", "", "Three é"]
    for read, bad in ((office.docx_markdown, b"no zip"), (office.pdf_pages, b"%PDF-1.4 junk"), (office.pdf_pages, b"")):
        with pytest.raises(ParseError):
            read(bad)


def test_pdf_with_a_map_to_unicode():
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <0048> <0002> <D83DDE00> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<00660069> <00E9>] endbfrange"
    stream = lambda b: b"<< /Length %d >>\nstream\n%s\nendstream" % (len(b), b)
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Resources << /Font << /F1 5 0 R /F2 7 0 R >> >> >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>",
        4: stream(b"BT /F1 12 Tf <00010010> Tj [<0020> -300 <0021> -20 <0012>] TJ T* <0002> Tj /F2 9 Tf (plain) Tj ET"), 5: b"<< /Type /Font /Subtype /Type0 /ToUnicode 6 0 R >>", 6: stream(cmap), 7: b"<< /Type /Font /Subtype /Type1 >>",
    }
    data = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % kv for kv in objects.items()) + b"%%EOF"
    assert office.pdf_pages(data) == ["Hafi éc\n😀plain"]


def test_every_sample_row_is_parsed(spark, data, tmp_path):
    import json

    from sedimenta.plans.catalogue import QUERIES

    table = spark.read.parquet(f"{data}/sample_rows.parquet")
    planted = [(-1, "a.jsonl", "jsonl", 2, '{"a": 1'), (-2, "a.jsonl", "jsonl", 3, '{"a": [1, "x"]}'), (-3, "a.jsonl", "jsonl", 4, " "), (-4, "a.jsonl", "jsonl", 5, "{'a': 1}"), (-5, "a.csv", "csv", 2, '1,"x,2')]
    planted = spark.createDataFrame(planted, "row_id long, source_path string, file_kind string, line_no int, raw_line string")
    data = str(tmp_path)
    table.select(planted.columns).union(planted).write.parquet(f"{data}/sample_rows.parquet")
    raw = {r["row_id"]: r for r in spark.read.parquet(f"{data}/sample_rows.parquet").collect()}

    def strict(text):
        def refuse(name):
            raise ValueError(name)

        try:
            json.loads(text, parse_constant=refuse)
            return True
        except ValueError:
            return False

    lines = {i: r["raw_line"].removeprefix("\ufeff") for i, r in raw.items() if r["file_kind"] == "jsonl"}
    got = {int(r["source_path"][4:-6]): r for r in QUERIES["jsonl_samples"](spark, data).collect()}
    assert set(got) == {i for i, t in lines.items() if t.strip()} and {i for i, r in got.items() if r["error"] is None} == {i for i, t in lines.items() if t.strip() and strict(t)}
    assert got[-1]["error"] and got[-4]["error"] and not got[-2]["error"] and -3 not in got
    cells = {i: r["raw_line"] for i, r in raw.items() if r["file_kind"] == "csv" and r["line_no"] != 1}
    found = {int(r["source_path"][4:-4]): r for r in QUERIES["csv_samples"](spark, data).collect()}
    assert {i for i, r in found.items() if r["error"]} == {i for i, t in cells.items() if t.count('"') % 2}
    assert {i for i, r in found.items() if not r["error"]} == {i for i, t in cells.items() if t.count('"') % 2 == 0 and t.strip()}
    names = "id name role department start_year active".split()
    for i, t in cells.items():
        if t.strip() and '"' not in t and "\r" not in t and "\n" not in t:
            assert found[i]["columns"] == dict(zip(names, t.split(",") + [""] * 6))
