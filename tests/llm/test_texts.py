"""Markup, main bodies, look-alikes."""

import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from sedimenta.llm import boilerplate, lookalike, markup

PROSE = [
    "Call snake_case_name or max_batch_size first.", "Set PATH=$HOME/bin:$PATH before it starts.", "Replace <project-id> by the id.", "Run it if [[ -f lock.json ]] is true.", "Reads from <stdin> & writes.", "The grid is 2 * 3 * 4 cells, see #4821 and C#.",
    "The fee is $5 to $10 per page, or $3.50 in bulk.", "A List<String> or Map<String, x> is returned.", "R&D and Q&A share one row.", "Copy *.txt and *.md files, then count them [sic].", r"The log sits in C:\begin\textfiles\x on that host.", "Ratio 3/4 ~ 0.75, i.e. 5%.",
    "The check a == b failed 52 times [1] and [2].", r"The pattern \d+\s\w matches 45 lines.", "He wrote: x^2 + y_1 = 6786, without units.", "Use a < b only when c > d holds.", "- one\n- two\n1. three\n(2) four", "name\tvalue\nx\t5", "He said 'it''s' twice.",
]


@pytest.mark.parametrize("text", PROSE)
def test_prose_stays(text):
    assert markup.clean_text(text) == (text, set())


CASES = [
    ("## Head ##\n\ntext **bold** and __b__ *i* _i_ ~~s~~", "Head\n\ntext bold and b i i s", {"markdown"}),
    ("Head\n====\n\nSub\n---\n\n> quoted **x**\n> more", "Head\n\nSub\n\n  quoted x more", {"markdown"}),
    ("a [label](http://x/y_(z) \"t\") ![alt](b.png) <https://x.example>", "a label alt https://x.example", {"markdown"}),
    ("see `<b>` and ``a ` b``", "see <b> and a ` b", {"markdown"}),
    ("```py\n# no heading <b>\n```\nend", "    # no heading <b>\n\nend", {"markdown"}),
    ("| a | b |\n| --- | :-: |\n| xxx | 1 |", "a     b\nxxx   1", {"markdown"}),
    ("== Head ==\n\n'''bold''' ''it'' [[Page|label]] [[Page]] [http://x text]{{note|x}}\n* a\n** b", "Head\n\nbold it label Page text\n\n- a\n  - b", {"wiki"}),
    ("{| class=\"t\"\n! h1 !! h2\n|-\n| a || [[b]]\n|}", "h1   h2\na    b", {"wiki"}),
    (r"\section*{Head} \textbf{bold \emph{it}} see~\ref{s} \href{http://x}{label} 5\% R\&D", "Head\n\nbold it see s label 5% R&D", {"latex"}),
    ("\\begin{itemize}\n  \\item one\n  \\item \\texttt{two}\n\\end{itemize}", "- one\n- two", {"latex"}),
    ("\\begin{tabular}{lr}\na & 1 \\\\\nbb & 22 \\\\\n\\end{tabular}", "a    1\nbb   22", {"latex"}),
    ("\\begin{verbatim}\n**x** <b>\n\\end{verbatim}", "    **x** <b>", {"latex"}),
    ("sum $a_i + b$ and\n\n$$\n\\frac{a}{b}\n$$", "sum a_i + b and\n\n    \\frac{a}{b}", {"latex"}),
    ("x &amp; y &#8212; z<!-- c --><br/>new", "x & y — z\nnew", {"html"}),
    ("<H2>Head</H2><p>a<p>b <i>c</i><ul><li>x<li>y</ul><pre><code>&lt;b&gt; **q**\n  z</code></pre>", "Head\n\na\n\nb c\n\n- x\n- y\n\n    <b> **q**\n      z", {"html"}),
    ("<table><tr><td>a<td>1<tr><td>bbb<td>2</table><script>x()</script><p hidden>no", "a     1\nbbb   2", {"html"}),
    ("# T\n\n<b>x</b> and $y$", "T\n\nx and y", {"html", "markdown", "latex"}),
]


@pytest.mark.parametrize("text,clean,found", CASES)
def test_markup(text, clean, found):
    assert markup.clean_text(text) == (clean, found)


@pytest.mark.parametrize("text", [c[0] for c in CASES if not any(x in c[0] for x in ("```", "verbatim", "`<b>`", "<pre>", "frac", "``a"))])
def test_clean_text_is_clean(text):
    assert markup.clean_text(markup.clean_text(text)[0])[1] == set()


def test_forms(spark):
    table = "| a | <b>x</b> |\n| --- | --- |"
    assert markup.clean_any(table, "table")[1] == ["html"] and markup.clean_any("| a |\n| --- |", "table")[1] == []
    text, found = markup.clean_any(json.dumps({"t": "a <b>x</b>", "n": [1, None, "\\d+"]}), "json")
    assert found == ["html"] and json.loads(text) == {"t": "a x", "n": [1, None, "\\d+"]}
    assert markup.clean_any("id: 1\nq: # Head\nanswer: x", "fields") == ("id: 1\nq: Head\nanswer: x", ["markdown"])
    assert markup.clean_any("**x**", "code") == ("**x**", [])
    rows = [(1, "a.md", "# H", "x"), (1, "a.md", "# H", "x"), (2, "b.ts", "x('<b>')", "x"), (3, None, None, "x"), (4, "c.json", "{", "x"), (5, None, "", "x"), (6, "d.txt", "**a " * 50_000, "x")]
    sections = spark.createDataFrame(rows, "section_id long, source_path string, text string, form string")
    units = spark.createDataFrame([(1, "prose", "<i>x</i> and **y**", "f"), (2, "code", "<i>", "f"), (3, None, None, "f")], "unit_id long, kind string, text string, form string")
    got = sorted(map(tuple, markup.markup_found(sections, units).collect()))
    assert got == [("markdown_units", 1, "html"), ("markdown_units", 1, "markdown"), ("sections", 1, "markdown")]
    assert markup.markup_found(sections.limit(0), units.limit(0)).count() == 0


CHROME = '<nav><ul><li><a href=/>KB-11111</a></ul></nav>'
NOTICE = "<div>We use small files on your device, see KB-22222. You can accept all of them.</div>"
FOOT = '<footer><p>© 2025 Works. REL-33333</footer>'
ARTICLE = '<h1>Title</h1><p>Words of the article, with some commas, and ADR-<b>44444</b> in it. FAQ&#45;55555 too.<ul><li>Item INC-66666 of the list, a long one.</ul><table><tr><td>REL-77777<td>cell</table>'
INSIDE = '<div class="share"><a href=1>Share</a> <a href=2>KB-88888</a></div><div><h3>Related pages</h3><ul><li><a href=3>KB-99999 Other page</a></ul></div><form><label>REL-00000</label></form>'
WANT = ["ADR-44444", "FAQ-55555", "INC-66666", "REL-77777"]


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body>{CHROME}<main><article>{ARTICLE}{INSIDE}</article></main>{FOOT}{NOTICE}</body></html>",
        f"<body><div id=menu>{CHROME[5:-6]}</div><div id=content>{ARTICLE}{INSIDE}</div><div id=sidebar><h3>Most read</h3><ul><li><a href=1>INC-12121: text of a link, long</a></ul></div>{NOTICE}</body>",
        f"<body><table><tr><td>{CHROME[5:-6]}<td>{ARTICLE}<td><h3>Read</h3><ul><li><a href=1>INC-12121 x</a></ul></table><p>© REL-33333</p></body>",
        f"<body>{CHROME[5:-6]}<a href=/>site</a> &rsaquo; <a href=1>KB-10101</a> &rsaquo; Title<hr>{ARTICLE}<hr><div><h3>Read</h3><ul><li><a href=1>INC-12121 x</a></ul></div><div><p>© REL-33333</div>{NOTICE}</body>",
        f"<body><div id=app></div>{CHROME}{FOOT}<script type=application/json>{json.dumps({'page': {'body': f'<article>{ARTICLE}</article>'}, 'ref': 'KB-13131'})}</script>{NOTICE}</body>",
        ARTICLE + INSIDE,
    ],
)
def test_main_body(page):
    text, codes = boilerplate.extract(page)
    assert codes == WANT and "Title" in text


def test_pages(spark):
    pages = [(1, ARTICLE, "x"), (1, ARTICLE, "x"), (2, None, "x"), (3, " ", "x"), (4, f"<body>{CHROME}<div id=content></div>{FOOT}{NOTICE}</body>", "x"), (5, "<div>" * 20_000 + ARTICLE, "x"), (None, ARTICLE, "x")]
    df = spark.createDataFrame(pages, "page_id long, html string, body string")
    got = {}
    for r in boilerplate.body_codes(df).collect():
        got.setdefault(r["page_id"], []).append(r["ref_code"])
    assert {k: sorted(v) for k, v in got.items()} == {1: WANT, 5: WANT, None: WANT}
    assert boilerplate.main_bodies(df).count() == 6 and boilerplate.main_bodies(df.limit(0)).count() == 0


def test_fold():
    same = [("ｆｕｌｌ　ｗｉｄｔｈ！", "full width!"), ("ﬁne oﬃce", "fine office"), ("a\u00a0b\u2009c", "a b c"), ("zero\u200bwid\u00adth\ufeff", "zerowidth"), ("раура", "paypa"), ("e\u0301", "é"), ("non\u2011breaking", "non-breaking"), ("Ⅷ", "VIII"), ("ёлка", "ëлka".replace("k", "к")), ("a\r\nb", "a\nb"), ("ΟΚ", "OK"), ("ｶﾞ", "ガ")]
    for a, b in same:
        assert lookalike.fold(a) == lookalike.fold(b), (a, b)
    for a, b in [("x²", "x2"), ("É", "E"), ("A", "a"), ("𝕏", "X"), ("1", "l"), ("–", "-"), ("a b", "ab")]:
        assert lookalike.fold(a) != lookalike.fold(b), (a, b)
    for t in ("plain text", "né à côté", "日本語", "\n\t x"):
        assert lookalike.fold(t) == t and lookalike.fold(lookalike.fold(t)) == t


def test_trie():
    trie = lookalike.Trie()
    for w, n in (("paypal", 5), ("раураl", 1), ("paypa", 2), ("épée", 1), ("office", 3)):
        trie.add(w, n)
    assert {w for w, _ in trie.match("рay\u200bpal")} == {"paypal", "раураl"} and {w for w, _ in trie.match("e\u0301pée")} == {"épée"} and trie.match("oﬃce") == [("office", 3)]
    assert trie.match("paypax") == [] and {w for w, _ in trie.match("paypax", 1)} == {"paypal", "paypa", "раураl"} and {w for w, _ in trie.match("ofice", 1)} == {"office"}
    assert lookalike.choose([("сервер", 9), ("cepвep", 1)], "cepвep") == "cepвep" and lookalike.choose([("сервер", 9), ("сервeр", 1)], "cepвep") == "сервер"


def test_search_is_bounded(monkeypatch):
    monkeypatch.setattr(lookalike, "TRIE_WORDS", 3)
    forms = [("office", [("office", 0, 5), ("oﬃce", 2, 1), ("оffice", 2, 2)]), ("cepвep", [("сервер", 1, 9), ("сервeр", 2, 1)]), ("zebra", [("zebra", 0, 1)]), ("zz", [("z\u200bz", 2, 4)])]
    rows = [(w, form, kind, n) for form, words in forms for w, kind, n in words]
    assert list(lookalike.search(iter(rows))) == [("oﬃce", "office", 1), ("оffice", "office", 2), ("сервер", "сервер", 9), ("сервeр", "сервер", 1)], "a word without match is left to the table"


def test_frequent_words_beyond_the_broadcast(spark, monkeypatch):
    rows = [(i, f"wоrd {'оther' if i % 3 else 'thіrd'} plain") for i in range(60)] + [(100 + i, f"word {'other' if i % 3 else 'third'} plain") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {tuple(r) for r in lookalike.lookalike_pairs(df).collect()}
    assert len(want) == 40 * 40 + 20 * 20
    monkeypatch.setattr(lookalike, "BROADCAST_WORDS", 0)
    assert {tuple(r) for r in lookalike.lookalike_pairs(df).collect()} == want
    monkeypatch.setattr(lookalike, "FREQUENT", 0.4)
    assert {tuple(r) for r in lookalike.lookalike_pairs(df).collect()} == want
    classes = {r["doc_id"]: r for r in lookalike.lookalike_classes(df).collect()}
    assert len(classes) == 120 and classes[100]["look_id"] == 0 and classes[100]["exact_id"] == 100 and classes[7]["exact_id"] == 1 and classes[7]["n_texts"] == 2


def test_pairs_against_brute_force(spark):
    rng = random.Random(7)
    base = ["the service checks each page", "служба проверяет каждый раздел", "la clé métrique", "日本語 ガイド", "office hours-", "", "   "]
    swap = {"e": "еｅ", "o": "οо", "a": "аａ", " ": "\u00a0\u3000", "é": ["e\u0301"], "-": "\u2011"}
    rows = []
    for i in range(400):
        t = rng.choice(base)
        t = "".join(rng.choice(list(swap[c])) if c in swap and rng.random() < 0.2 else c + ("\u200b" if rng.random() < 0.03 else "") for c in t)
        rows.append((i, t if rng.random() > 0.05 else None, "x", "y"))
    rows += [(1000 + i, base[0], "x", "y") for i in range(60)] + [(2000, base[0].upper(), "x", "y"), (2001, "\u200b \u200b", "x", "y"), (2002, "word " * 50_000, "x", "y"), (2003, "w\u043erd " * 50_000, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, look string, word string")
    want = set()
    seen = [(i, t, lookalike.fold(t)) for i, t, *_ in rows if t and any(unicodedata.category(c)[0] not in "ZC" for c in lookalike.fold(t))]
    groups = {}
    for i, t, f in seen:
        groups.setdefault(f, []).append((i, t))
    for g in groups.values():
        want |= {(i, j) for i, a in g for j, b in g if i < j and a != b}
    got = [tuple(r) for r in lookalike.lookalike_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and (2002, 2003) in want
    assert lookalike.lookalike_pairs(df.limit(0)).count() == 0


def test_canonical_texts_keep_the_script(spark):
    rows = [(1, "служба работает"), (2, "служба рaботает"), (3, "служба"), (4, "plain"), (5, "plаin"), (6, "a\u00a0b"), (7, None), (8, "")]
    got = {r["doc_id"]: r["canonical"] for r in lookalike.canonical_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "служба работает", 2: "служба работает", 3: "служба", 4: "plain", 5: "plain", 6: "a b", 8: ""}
    assert lookalike.canonical_texts(spark.createDataFrame(rows, "doc_id long, text string").filter(F.col("doc_id") > 99)).count() == 0


def test_short_bodies():
    index = "<html><body><nav><ul><li><a href=/>KB-00001</a></li></ul></nav><main><h1>Codes</h1><ul>" + "".join(f"<li>KB-{n}</li>" for n in (12345, 12346, 12347)) + "</ul></main><footer><p>KB-99999</p></footer></body></html>"
    text, codes = boilerplate.extract(index)
    assert codes == ["KB-12345", "KB-12346", "KB-12347"] and text.startswith("Codes")
    assert boilerplate.extract("<article><h1>Lock</h1><p>See KB-12345.</p></article>")[1] == ["KB-12345"]
    assert boilerplate.extract("<article><h1>A</h1><p>See KB-12345.</p></article>") == ("A\n\nSee KB-12345.", ["KB-12345"])
    # all that a page says is its body, however short
    assert boilerplate.extract("<div><p>See KB-12345.</p></div>") == ("See KB-12345.", ["KB-12345"])
    six = "<article>" + "".join(f"<p>Run KB-1234{k} now.</p>" for k in range(6)) + "</article>"
    assert boilerplate.extract(six)[1] == [f"KB-1234{k}" for k in range(6)]
    assert boilerplate.extract("<body><div class='cookie-banner'><h2>Cookies</h2><p>Accept cookies</p></div></body>")[1] == []
    state = json.dumps({"body": "<p>KB-12345</p>"})
    assert boilerplate.extract(f"<body><nav><a href=/>Home</a></nav><script type=application/json>{state}</script></body>")[1] == ["KB-12345"]


@pytest.mark.parametrize("words", ("accept all of them", "enjoy all of them"))
def test_words_dont_tell_a_notice(words):
    page = f"<body><article><h1>Baking cookies</h1><p>Small cookies, large cookies: readers {words}, see KB-12345.</p></article></body>"
    assert boilerplate.extract(page)[1] == ["KB-12345"] and words in boilerplate.extract(page)[0]


@pytest.mark.parametrize("box", ("<div>{}</div>", "<div class=x1><p>{}</p></div>", "<p><small>{}</small></p>", "<section><p>{}</p><a href=/ok>OK</a></section>"))
@pytest.mark.parametrize("first", (True, False))
def test_remarks_at_the_edge(box, first):
    remark = box.format("This text says nothing about its purpose, at great length, with commas, and names KB-22222 so that it scores.")
    body = "<div class=z9><h1>Title</h1><p>See KB-12345.</p></div><div><p>© 2025 Works KB-33333</p><p><a href=/i>Imprint</a></p></div>"
    assert boilerplate.extract(f"<body>{remark + body if first else body + remark}</body>")[1] == ["KB-12345"]
    empty = "<div class=m><ul><li><a href=/>KB-11111</a></ul></div><div id=content></div>"
    assert boilerplate.extract(f"<body>{remark + empty if first else empty + remark}</body>") == ("", [])


def test_deep_and_long_pages():
    deep = "<div>" * 5000 + "<span>" * 5000 + "<h1>T</h1>" + "<p>Words, KB-12345.</p>" * 50
    assert boilerplate.extract(deep)[1] == ["KB-12345"]
    assert boilerplate.extract("<body>" + "<div><p>Words of it, KB-12345, and more.</p></div>" * 5000)[1] == ["KB-12345"]
