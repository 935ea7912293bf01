"""Markup residue: HTML, Markdown, wiki and LaTeX out, headings, lists, code, tables and formulas kept.

What is code is set aside first.  Every mark of the four languages is then turned into a start or end
tag that names its language, marks without text of their own into empty elements.  The tags build one
tree (with implied ends), and a layout-aware renderer writes what is visible in it: blocks apart, items
marked, code indented, table cells aligned.  The languages reported are those of the tree's elements.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.text_batches import pieces as cut
from sedimenta.functions.htmltree import ELEMENTS, RAW, VOID, Builder, Node, attributes, render

LANGUAGES = ("html", "markdown", "wiki", "latex")

# noncharacters delimit the inner tags: OPEN number CLOSE (an element of _Reading.elements), END number CLOSE, KEPT number CLOSE
OPEN, CLOSE, END, KEPT = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"
_INNER = re.compile("[\ufdd0-\ufdef]")
_TAGS = re.compile(f"([{OPEN}{END}{KEPT}])([0-9]+){CLOSE}")

_CODE = re.compile(
    r"""
    ^[ \t]*(?P<fence>`{3,}|~{3,})(?P<info>[^\n`]*)\n(?P<fenced>.*?)(?:^[ \t]*(?P=fence)[`~]*[ \t]*$|\Z)
  | (?P<comment><!--.*?(?:-->|\Z))
  | <(?P<pre>pre|textarea|listing|xmp)\b[^<>]*>(?P<pretext>.*?)(?:</(?P=pre)\s*>|\Z)
  | <(?P<script>script|style|template)\b[^<>]*>.*?(?:</(?P=script)\s*>|\Z)
  | <(?P<code>code|kbd|samp|tt)\b[^<>]*>(?P<codetext>(?:(?!<(?:code|kbd|samp|tt)\b).)*?)</(?P=code)\s*>
  | <(?P<nowiki>nowiki|syntaxhighlight)\b[^<>]*>(?P<nowikitext>.*?)(?:</(?P=nowiki)\s*>|\Z)
  | \\begin\{(?P<verbatim>verbatim\*?|Verbatim|lstlisting|minted|alltt)\}(?:\[[^\]\n]*\]|\{[^}\n]*\})*(?P<verbatimtext>.*?)(?:\\end\{(?P=verbatim)\}|\Z)
  | \\verb\*?(?P<bar>[^\w\s*])(?P<verbtext>[^\n]*?)(?P=bar)
  | (?<![`\\])(?P<ticks>`+)(?!`)(?P<span>(?:(?!\n[ \t]*\n).)+?)(?<!`)(?P=ticks)(?!`)
    """,
    re.X | re.S | re.M | re.I,
)
_MATH = re.compile(
    r"""
    \$\$(?P<display>.+?)\$\$ | \\\[(?P<square>(?:(?!\\\[|\n[ \t]*\n).)+?)\\\] | \\\((?P<round>(?:(?!\\\(|\n[ \t]*\n).)+?)\\\)
  | \\begin\{(?P<env>(?:equation|align|gather|displaymath|math|eqnarray|multline|flalign)\*?)\}(?P<envtext>.*?)(?:\\end\{(?P=env)\}|\Z)
  | (?<![\w\\$])\$(?![\s$])(?P<inline>(?:[^$\n\\]|\\.)*?(?<![\s]))\$(?![\w$])
    """,
    re.X | re.S,
)
_HTML_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s+[\w:@.-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>=`]+))?)*)\s*/?>")
_DOCTYPE = re.compile(r"<![Dd][Oo][Cc][Tt][Yy][Pp][Ee]\b[^<>]*>")
_ENTITY = re.compile(r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")

_DELIMITER_ROW = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*\Z")
_ITEM = re.compile(r"([ \t]*)([-*+•‣◦·]|\d{1,9}[.)]|\(\d{1,9}\)|[*#]{2,6}|[:;]{1,6}(?=[ \t]))[ \t]+(?=\S)")
_ATX = re.compile(r"[ ]{0,3}(#{1,6})[ \t]+(.*?)(?:[ \t]+#+)?[ \t]*\Z")
_WIKI_HEADING = re.compile(r"[ \t]*(={1,6})[ \t]*([^=\s](?:.*?[^=\s])?)[ \t]*\1[ \t]*\Z")
_LATEX_HEADING = re.compile(r"\\(part|chapter|section|subsection|subsubsection|paragraph|subparagraph|title)\*?(?:\[[^\]\n]*\])?\{")
_LATEX_LEVEL = {"title": 1, "part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5, "subparagraph": 6}
_TABULAR = re.compile(r"\\begin\{(tabular[xy*]?|array|longtable)\}(?:\[[^\]\n]*\])?(?:\{[^\n]*?\})*[ \t]*\n?(.*?)(?:\\end\{\1\}|\Z)", re.S)
_UNDERLINE = re.compile(r"[ ]{0,3}(?:=+|-{2,})[ \t]*\Z")
_RULE = re.compile(r"[ ]{0,3}(?:(?:\*[ \t]*){3,}|(?:_[ \t]*){3,}|(?:-[ \t]*){3,})\Z")
_LATEX_ITEM = re.compile(r"[ \t]*\\item\b(?:\[([^\]\n]*)\])?[ \t]*")
_LIST_ENV = re.compile(r"[ \t]*\\(begin|end)\{(itemize|enumerate|description)\}(?:\[[^\]\n]*\])?[ \t]*")
_ANY_ENV = re.compile(r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]\n]*\])?")
_BARE = re.compile(r"\\(?:item|hline|toprule|midrule|bottomrule|maketitle|tableofcontents|noindent|centering|newline|newpage|par|LaTeX|TeX|ldots|dots|appendix|bigskip|medskip|smallskip)\b[ \t]?")
_COMMAND = re.compile(r"(~?)\\([a-zA-Z]+)\*?(?:\[[^\]\n]*\])?\{")
_CITED = frozenset(("cite", "citep", "citet"))
_UNSEEN = frozenset(("label", "vspace", "hspace", "pagestyle", "thispagestyle", "bibliographystyle", "usepackage", "documentclass", "input", "include", "setlength", "newcommand"))

_IMAGE = re.compile(r"!\[([^\]\n]*)\]\(([^()\s]*(?:\([^()\s]*\)[^()\s]*)*)(?:\s+[\"'][^\n]*?[\"'])?\)")
_LINK = re.compile(r"(?<![\w!])\[([^\[\]\n]+)\]\(([^()\s]*(?:\([^()\s]*\)[^()\s]*)*)(?:\s+[\"'][^\n]*?[\"'])?\)")
_DEFINITION = re.compile(r"^[ ]{0,3}\[([^\]\n]+)\]:[ \t]*<?((?:https?:|/|#|mailto:|\.)\S*?)>?(?:[ \t]+[\"'(].*?[\"')])?[ \t]*$", re.M)
_REFERENCE = re.compile(r"\[([^\[\]\n]+)\]\[([^\[\]\n]*)\]")
_AUTOLINK = re.compile(r"<((?:https?|ftp|mailto):[^<>\s]+|[\w.+-]+@[\w-]+\.[\w.-]+)>")
_WIKI_LINK = re.compile(r"(?<![\w\])])\[\[(?![\s\-!])([^\[\]\n|]*[^\s\[\]|])(?:\|([^\[\]\n]*))?\]\]")
_WIKI_URL = re.compile(r"\[((?:https?|ftp|mailto):[^\s\]]+)(?:[ \t]+([^\]\n]+))?\](?!\()")
_TEMPLATE = re.compile(r"\{\{\s*[#A-Za-z][^{}\n]*\}\}")
_MAGIC = re.compile(r"__(?:NO)?(?:TOC|INDEX|EDITSECTION|GALLERY)__")
_WIKI_QUOTES = re.compile(r"('{5}|'{3}|'{2})(?=[^\s'])((?:[^'\n]|'(?!'))*?[^\s'])\1(?!')")
_ESCAPED = re.compile(r"(?<!\\)\\(?=[%&])")
_QUOTED = re.compile(r"[ ]{0,3}>(?:[ \t]|\Z|>)")
_QUOTES = re.compile(r"[ ]{0,3}>[ \t]?(?:[ ]{0,3}>(?:[ \t]|(?=>)|\Z))*")


@dataclass(frozen=True)
class _Mark:
    """A mark around words: where it can open and close, what ends the search for its other half, and its element.

    The halves are paired by a stack, so that marks nest to any depth and each is looked at once.  A
    half that can neither open nor close parts what stands around it, as does a break.
    """

    sign: str
    token: re.Pattern
    opens: Callable[[str, str], bool]
    closes: Callable[[str, str], bool]
    element: str


def _word(c: str) -> bool:
    return c == "_" or c.isalnum()


_PARAGRAPH, _LINE = r"\n(?=[ \t]*\n)", r"\n"
_MARKS = (
    _Mark("***", re.compile(rf"(?<!\*)\*\*\*|{_PARAGRAPH}"), lambda a, b: a not in ("*", "\\") and bool(b) and not b.isspace() and b != "*", lambda a, b: bool(a) and not a.isspace() and a not in ("*", "\\") and b != "*", "strong"),
    _Mark("**", re.compile(rf"(?<!\*)\*\*|{_PARAGRAPH}"), lambda a, b: a not in ("*", "\\") and bool(b) and not b.isspace() and b != "*", lambda a, b: bool(a) and not a.isspace() and a not in ("*", "\\") and b != "*", "strong"),
    _Mark("__", re.compile(rf"(?<!_)__|{_PARAGRAPH}"), lambda a, b: not _word(a) and a != "\\" and bool(b) and not b.isspace() and b != "_", lambda a, b: bool(a) and not a.isspace() and a not in ("_", "\\") and not _word(b), "strong"),
    _Mark("~~", re.compile(rf"(?<!~)~~|{_PARAGRAPH}"), lambda a, b: a not in ("~", "\\") and bool(b) and not b.isspace() and b != "~", lambda a, b: bool(a) and not a.isspace() and a not in ("~", "\\") and b != "~", "del"),
    _Mark("*", re.compile(rf"\*|{_PARAGRAPH}"), lambda a, b: a != "*" and not _word(a) and a != "\\" and bool(b) and not b.isspace() and b != "*", lambda a, b: bool(a) and not a.isspace() and a not in ("*", "\\") and b != "*" and not _word(b), "em"),
    _Mark("_", re.compile(rf"_|{_LINE}"), lambda a, b: not _word(a) and a != "\\" and bool(b) and not b.isspace() and b != "_", lambda a, b: bool(a) and not a.isspace() and a not in ("_", "\\") and not _word(b), "em"),
)
_WIKI_QUOTES = re.compile(r"'{2,}|\n")


def _halves(mark: _Mark, text: str) -> list[tuple[int, int]]:
    """The places of the opening and closing halves of a mark in a text."""
    held: list[int] = []
    found = []
    n, width = len(text), len(mark.sign)
    for m in mark.token.finditer(text):
        at = m.start()
        if m[0] == "\n":
            held.clear()
            continue
        before, behind = text[at - 1] if at else "", text[at + width] if at + width < n else ""
        if held and mark.closes(before, behind):
            found.append((held.pop(), at))
        elif mark.opens(before, behind):
            held.append(at)
        else:
            held.clear()
    return found


def _braces(text: str) -> dict[int, int]:
    """Of each opening brace that is closed, where."""
    held, out = [], {}
    for m in _BRACE.finditer(text):
        if m[0] == "{":
            held.append(m.start())
        elif held:
            out[held.pop()] = m.start()
    return out


_BRACE = re.compile(r"[{}]")


class _Reading:
    """One text on its way to a tree."""

    def __init__(self, bare_tables: bool):
        self.bare_tables, self.kept = bare_tables, []
        #: Name, language ("" for structure without a mark) and attributes of the elements that tags name by number.
        self.elements: list[tuple[str, str, str]] = []
        self.numbers: dict[tuple[str, str, str], int] = {}

    # -- tags -----------------------------------------------------------------------------------
    def number(self, name: str, language: str = "", attrs: str = "") -> int:
        key = (name, language, attrs)
        n = self.numbers.get(key)
        if n is None:
            n = self.numbers[key] = len(self.elements)
            self.elements.append(key)
        return n

    def open(self, name: str, language: str = "", attrs: str = "") -> str:
        return f"{OPEN}{self.number(name, language, attrs)}{CLOSE}"

    def shut(self, name: str, language: str = "") -> str:
        return f"{END}{self.number(name, language)}{CLOSE}"

    def around(self, text: str, name: str, language: str = "", attrs: str = "") -> str:
        return self.open(name, language, attrs) + text + self.shut(name)

    def empty(self, language: str) -> str:
        """A mark without text of its own."""
        return f"{OPEN}{self.number('#mark', language)}{CLOSE}"

    # -- setting aside --------------------------------------------------------------------------
    def settled(self, text: str) -> tuple[str, str]:
        """A text without inner tags, and empty marks for those that were in it."""
        if not _INNER.search(text):
            return text, ""
        inside = {self.elements[int(m[2])][1] for m in _TAGS.finditer(text) if m[1] == OPEN} - {""}
        plain = _TAGS.sub(lambda m: self.kept[int(m[2])] if m[1] == KEPT else "", text)
        return plain, "".join(map(self.empty, sorted(inside)))

    def keep(self, text: str, element: str, language: str, attrs: str = "") -> str:
        plain, marks = self.settled(text)
        self.kept.append(plain)
        return self.around(f"{KEPT}{len(self.kept) - 1}{CLOSE}", element, language, attrs) + marks

    def gone(self, language: str, text: str) -> str:
        """A mark that leaves nothing of a text but the marks in it."""
        return self.empty(language) + self.settled(text)[1]

    def code(self, m: re.Match) -> str:
        g = m.groupdict()
        if g["fence"] is not None:
            return "\n" + self.keep(g["fenced"].rstrip("\n"), "pre", "markdown") + "\n"
        if g["ticks"] is not None:
            return self.keep(g["span"].strip("\n"), "code", "markdown")
        if g["verbatim"] is not None:
            return "\n" + self.keep(g["verbatimtext"].strip("\n"), "pre", "latex") + "\n"
        if g["bar"] is not None:
            return self.keep(g["verbtext"], "code", "latex")
        if g["nowiki"] is not None:
            return self.keep(html.unescape(g["nowikitext"]), "code" if g["nowiki"].lower() == "nowiki" else "pre", "wiki")
        for name, element in (("pre", "pre"), ("code", "code")):
            if g[name] is not None:
                inside = html.unescape(re.sub(r"</?[A-Za-z][^<>]*>", "", g[name + "text"]))
                return self.keep(inside.strip("\n") if name == "pre" else inside, element, "html")
        return self.empty("html")  # comment, script, style

    def math(self, m: re.Match) -> str:
        g = m.groupdict()
        if g["inline"] is not None or g["round"] is not None:
            return self.keep((g["inline"] if g["inline"] is not None else g["round"]).strip(), "code", "latex")
        text = next(g[k] for k in ("display", "square", "envtext") if g[k] is not None)
        return "\n" + self.keep(text.strip(), "pre", "latex") + "\n"

    # -- html -----------------------------------------------------------------------------------
    def tag(self, m: re.Match) -> str:
        name = m[2].lower()
        if name not in ELEMENTS:
            return m[0]
        attrs, marks = self.settled(m[3].strip())
        return self.shut(name, "html") if m[1] else self.open(name, "html", attrs) + marks

    def entity(self, m: re.Match) -> str:
        if m[1][0] != "#" and m[1] + ";" not in html5:
            return m[0]
        return self.keep(html.unescape(m[0]), "#entity", "html")

    # -- inline marks ---------------------------------------------------------------------------
    def commands(self, text: str) -> str:
        """LaTeX commands with arguments as elements around them, nested to any depth; arguments that a command hides are set aside as hidden."""
        if not _COMMAND.search(text):
            return text
        closed = _braces(text)
        edits: list[tuple[int, int, str]] = []
        for m in _COMMAND.finditer(text):
            first, name = m.end() - 1, m[2]
            if first not in closed or name in ("begin", "end"):
                continue
            stop, lead = closed[first], " " if m[1] else ""
            # a second argument right behind the first
            second = stop + 1 if text[stop + 1 : stop + 2] == "{" and stop + 1 in closed else None
            cited, unseen = name in _CITED, name in _UNSEEN
            if unseen or name == "href" and second is not None:
                end = closed[second] if unseen and second is not None else stop
                edits.append((m.start(), end + 1, lead + self.hidden(text[first:end], "latex")))
                if unseen:
                    continue
            else:
                edits.append((m.start(), m.end(), lead + self.open("#command", "latex") + "[" * cited))
                edits.append((stop, stop + 1, "]" * cited + self.shut("#command")))
            if second is not None:
                end = closed[second]
                if cited:
                    edits.append((second, end + 1, self.hidden(text[second:end], "latex")))
                else:
                    edits.append((second, second + 1, " " * (name != "href") + self.open("#command", "latex")))
                    edits.append((end, end + 1, self.shut("#command")))
        return self.edited(text, edits)

    def hidden(self, text: str, language: str) -> str:
        return self.keep(text, "#unseen", language, "hidden")

    @staticmethod
    def edited(text: str, edits: list[tuple[int, int, str]]) -> str:
        out, at = [], 0
        for start, stop, new in sorted(edits):
            if start >= at:  # what lies within something set aside is gone with it
                out += (text[at:start], new)
                at = stop
        return "".join(out) + text[at:] if out else text

    def quotes(self, text: str) -> str:
        """Wiki quotes: runs of two, three or five that open before a word and close behind one, paired by a stack on each line."""
        held: list[tuple[int, int]] = []
        edits: list[tuple[int, int, str]] = []
        for m in _WIKI_QUOTES.finditer(text):
            if m[0] == "\n":
                held.clear()
                continue
            at, stop, n = m.start(), m.end(), len(m[0])
            before, behind = text[at - 1 : at], text[stop : stop + 1]
            if n not in (2, 3, 5):
                held.clear()
            elif held and held[-1][1] == n and before.strip():
                first, _ = held.pop()
                element = "em" if n == 2 else "strong"
                edits.append((first, first + n, self.open(element, "wiki")))
                edits.append((at, stop, self.shut(element)))
            elif behind.strip():
                held.append((at, n))
        return self.edited(text, edits)

    def inline(self, text: str) -> str:
        if "\\" in text:
            text = self.commands(text)
            text = _ANY_ENV.sub(lambda m: self.empty("latex"), text)
            text = _BARE.sub(lambda m: self.empty("latex"), text)
            text = _ESCAPED.sub(lambda m: self.empty("latex"), text)
        if "[" in text:
            text = _IMAGE.sub(lambda m: self.around(m[1], "#image", "markdown") + self.settled(m[2])[1], text)
            text = _LINK.sub(lambda m: self.around(m[1], "a", "markdown") + self.settled(m[2])[1], text)
            text = _WIKI_LINK.sub(lambda m: self.around(m[2] or m[1], "a", "wiki"), text)
            text = _WIKI_URL.sub(lambda m: self.around(m[2] or m[1], "a", "wiki"), text)
        if "{{" in text:
            text = _TEMPLATE.sub(lambda m: self.gone("wiki", m[0]), text)
        if "<" in text:
            text = _AUTOLINK.sub(lambda m: self.around(m[1], "a", "markdown"), text)
        if "''" in text:
            text = self.quotes(text)
        if "__" in text:
            text = _MAGIC.sub(lambda m: self.empty("wiki"), text)
        for mark in _MARKS:
            if mark.sign in text and (pairs := _halves(mark, text)):
                width, one, two = len(mark.sign), self.open(mark.element, "markdown"), self.shut(mark.element)
                text = self.edited(text, [e for a, b in pairs for e in ((a, a + width, one), (b, b + width, two))])
        return text

    # -- blocks ---------------------------------------------------------------------------------
    def row(self, cells, kind: str = "td") -> str:
        return self.around("".join(self.around(self.inline(c.strip()), kind) for c in cells), "tr")

    def pipe_cells(self, line: str) -> list[str]:
        line = line.strip()
        line = line[1:] if line.startswith("|") else line
        line = line[:-1] if line.endswith("|") and not line.endswith("\\|") else line
        return [c.replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line)]

    def tabular(self, m: re.Match) -> str:
        rows = [r for r in re.split(r"\\\\(?:\[[^\]\n]*\])?", re.sub(r"\\(?:hline|toprule|midrule|bottomrule|cline\{[^}]*\})", "", m[2])) if r.strip()]
        return "\n" + self.around("".join(self.row(re.split(r"(?<!\\)&", r.replace("\n", " "))) for r in rows), "table", "latex") + "\n"

    def wiki_table(self, lines: list[str]) -> str:
        out, cells = [], []
        for line in lines[1:] + ["|-"]:
            s = line.strip()
            if s.startswith("|-") or s.startswith("|}"):
                if cells:
                    out.append(self.row(cells))
                    cells = []
            elif s.startswith("|+"):
                out.append(self.around(self.inline(s[2:].strip()), "caption"))
            elif s and s[0] in "|!":
                parts = re.split(r"\|\|" if s[0] == "|" else r"!!|\|\|", s[1:])
                cells += [re.sub(r"^[^|\[\]{}]*=[^|\[\]{}]*\|", "", p) for p in parts]
            elif s and cells:
                cells[-1] += " " + s
        return self.around("".join(out), "table", "wiki")

    def heading(self, language: str, level: int, text: str) -> str:
        return self.around(self.inline(text.strip()), f"h{min(level, 6)}", language)

    def latex_headings(self, text: str) -> str:
        """Heading commands whose argument ends on the same line, as blocks."""
        closed = _braces(text)
        out, at = [], 0
        for m in _LATEX_HEADING.finditer(text):
            stop = closed.get(m.end() - 1)
            if m.start() >= at and stop is not None and "\n" not in text[m.end() : stop]:
                out += (text[at : m.start()], "\n", self.heading("latex", _LATEX_LEVEL[m[1]], text[m.end() : stop]), "\n")
                at = stop + 1
        return "".join(out) + text[at:]

    def quotation(self, lines: list[str], i: int, out: list[str]) -> int:
        """Lines of a quotation from ``i`` on, as nested elements: lines of one depth are read together.  Returns the line behind it."""
        level, run = 0, []

        def write(depth: int) -> int:
            if run:
                out.append(self.blocks("\n".join(run)))
                run.clear()
            step = depth - level
            out.append((self.open("blockquote", "markdown") if step > 0 else self.shut("blockquote")) * abs(step))
            return depth

        while i < len(lines) and (m := _QUOTES.match(lines[i])):
            depth = m[0].count(">")
            if depth != level:
                level = write(depth)
            run.append(lines[i][m.end() :])
            i += 1
        level = write(0)
        return i

    def blocks(self, text: str) -> str:
        slashed = "\\" in text
        if slashed:
            text = _TABULAR.sub(self.tabular, text)
            text = self.latex_headings(text)
        if "[" in text and _DEFINITION.search(text):
            names = {m[1].lower() for m in _DEFINITION.finditer(text)}
            text = _DEFINITION.sub(lambda m: self.gone("markdown", m[0]), text)
            text = _REFERENCE.sub(lambda m: self.around(m[1], "a", "markdown") if (m[2] or m[1]).lower() in names else m[0], text)
        lines, out, prose, i = text.split("\n"), [], [], 0
        closing = [k for k, x in enumerate(lines) if x.lstrip().startswith("|}")] if "{|" in text else []

        def flush() -> None:
            if prose:
                out.append(self.inline("\n".join(prose)))
                prose.clear()

        while i < len(lines):
            line = lines[i]
            after = lines[i + 1] if i + 1 < len(lines) else ""
            bare = line.lstrip()
            # by what a line begins with most kinds of block are ruled out
            first, below = bare[:1], after.lstrip()[:1]
            fresh = not prose or not prose[-1].strip()
            env = _LIST_ENV.match(line) if first == "\\" else None
            if env:
                flush()
                name = "ol" if env[2] == "enumerate" else "ul"
                out.append(self.open(name, "latex") if env[1] == "begin" else self.shut(name, "latex"))
                lines[i] = line[env.end() :]
                i += not lines[i].strip()
                continue
            item = _LATEX_ITEM.match(line) if first == "\\" else None
            if item:
                flush()
                out.append(self.open("li", "latex") + (item[1] + " " if item[1] else "") + self.inline(line[item.end() :]))
            elif first == "{" and bare.startswith("{|"):
                flush()
                k = bisect_left(closing, i)
                stop = closing[k] if k < len(closing) else None
                if stop is None:
                    prose.append(line)
                else:
                    out.append(self.wiki_table(lines[i : stop + 1]))
                    i = stop
            elif "|" in line and "-" in after and "|" in after + line and _DELIMITER_ROW.match(after) and len(self.pipe_cells(line)) == len(self.pipe_cells(after)):
                flush()
                rows = [self.row(self.pipe_cells(line))]
                i += 1
                while i + 1 < len(lines) and "|" in lines[i + 1] and lines[i + 1].strip():
                    i += 1
                    rows.append(self.row(self.pipe_cells(lines[i])))
                out.append(self.around("".join(rows), "table", "" if self.bare_tables else "markdown"))
            elif first == "#" and (m := _ATX.match(line)):
                flush()
                out.append(self.heading("markdown", len(m[1]), m[2]))
            elif first == "=" and (m := _WIKI_HEADING.match(line)) and (len(m[1]) > 1 or fresh):
                flush()
                out.append(self.heading("wiki", len(m[1]), m[2]))
            elif below and below in "=-" and first and _UNDERLINE.match(after) and fresh and not _ITEM.match(line) and "|" not in line:
                flush()
                out.append(self.heading("markdown", 1 if "=" in after else 2, line))
                i += 1
            elif first and first in "*_-" and fresh and _RULE.match(line):
                flush()
                out.append(self.open("hr", "wiki" if line.strip() == "----" else "markdown"))
            elif first == ">" and _QUOTED.match(line):
                flush()
                i = self.quotation(lines, i, out)
                continue
            elif m := _ITEM.match(line):
                flush()
                level = max(len(m[1].expandtabs(4)) // 2, len(m[2]) - 1 if m[2][0] in "*#:;" else 0)
                mark = m[2] if m[2][0] not in "*+#:;•‣◦·" else "-"
                lists = self.open("ul") * (level + 1), self.shut("ul") * (level + 1)
                out.append(lists[0] + self.around(self.inline(line[m.end() :]), "li", "", f'mark="{mark}"') + lists[1])
            else:
                prose.append(line)
            i += 1
        flush()
        return "\n".join(out)

    # -- tree -----------------------------------------------------------------------------------
    def tree(self, marked: str) -> Node:
        """The tree of a text with inner tags; elements that stand for a mark name its language in ``of``."""
        b, at, skip = Builder(), 0, ""
        for m in _TAGS.finditer(marked):
            if not skip:
                b.text(marked[at : m.start()])
            at, kind = m.end(), m[1]
            if kind == KEPT:
                if not skip:
                    b.text(self.kept[int(m[2])])
                continue
            name, language, attrs = self.elements[int(m[2])]
            mark = {"of": language} if language else {}
            if kind == END and name == (skip or name):
                # an end tag that closes nothing is a mark, too
                if not b.end(name) and language:
                    b.start("#mark", mark, True)
                skip = ""
            elif kind == END or skip:
                if language:
                    b.start("#mark", mark, True)
            else:
                b.start(name, (attributes(attrs) | mark) if attrs else mark, name == "#mark")
                if name in RAW and name not in VOID:
                    skip = name
        if not skip:
            b.text(marked[at:])
        return b.root


_VERBATIM = frozenset(("pre", "code"))


def read(text: str, bare_tables: bool = False) -> Node | None:
    """The tree of a text; None if it has neither marks nor lists.

    ``bare_tables``: pipes and delimiter row are the structure of a table unit, not Markdown.
    """
    r = _Reading(bare_tables)
    text = _INNER.sub("", text).replace("\r\n", "\n")
    # each kind of mark is only looked for where the character it needs occurs
    slashed, angled = "\\" in text, "<" in text
    if slashed or angled or "`" in text or "~~~" in text:
        text = _CODE.sub(r.code, text)
    if slashed or "$" in text:
        text = _MATH.sub(r.math, text)
    if angled:
        text = _DOCTYPE.sub(lambda m: r.empty("html"), text)
        text = _HTML_TAG.sub(r.tag, text)
    if "&" in text:
        text = _ENTITY.sub(r.entity, text)
    marked = r.blocks(text)
    return r.tree(marked) if r.elements else None


def languages(root: Node) -> set[str]:
    """The languages of the marks that a tree holds."""
    return {n.attrs["of"] for n in root.walk() if "of" in n.attrs}


def clean_text(text: str, bare_tables: bool = False) -> tuple[str, set[str]]:
    """The text without markup, and the languages of the marks in it; see ``read``."""
    root = read(text, bare_tables)
    if root is None:
        return _INNER.sub("", text).replace("\r\n", "\n"), set()
    found = languages(root)
    if "latex" in found and "\\" in text:
        for n in root.walk():
            if n.tag not in _VERBATIM:
                n.children = [re.sub(r"\\([%&#_$])", r"\1", c) if isinstance(c, str) else c for c in n.children]
    return render(root, keep_lines=True), found


def clean_json(text: str) -> tuple[str, set[str]]:
    """JSON with the markup taken out of its strings; what isn't JSON is read as plain text."""
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return clean_text(text)
    found: set[str] = set()

    def clean(v):
        if isinstance(v, str):
            new, own = clean_text(v)
            found.update(own)
            return new if own else v
        if isinstance(v, list):
            return [clean(x) for x in v]
        if isinstance(v, dict):
            return {k: clean(x) for k, x in v.items()}
        return v

    try:
        new = clean(value)
    except RecursionError:
        return clean_text(text)
    return (json.dumps(new, ensure_ascii=False, indent=2), found) if found else (text, found)


_FIELD = re.compile(r"^([A-Za-z_][\w .-]*: )(.*)$")


def clean_fields(text: str) -> tuple[str, set[str]]:
    """``column: value`` lines: the values alone are read; lines that continue a value belong to it."""
    out, found, values = [], set(), []
    for line in text.split("\n"):
        m = _FIELD.match(line)
        if m:
            values.append([m[1], m[2]])
        elif values:
            values[-1][1] += "\n" + line
        else:
            values.append(["", line])
    for name, value in values:
        new, own = clean_text(value)
        found |= own
        out.append(name + (new if own else value))
    return "\n".join(out), found


def clean_any(text: str | None, form: str) -> tuple[str | None, list[str]]:
    """``form``: text, json, fields, table or code (bare code has no markup)."""
    if not text or form == "code":
        return text, []
    new, found = clean_json(text) if form == "json" else clean_fields(text) if form == "fields" else clean_text(text, form == "table")
    return new, [x for x in LANGUAGES if x in found]


def clean_markup(rows: DataFrame, key: Column, form: Column, text: str = "text") -> DataFrame:
    """``rec_id, clean, markup`` of each row: the text without markup, and the languages found (possibly none).

    Null and empty texts come out as they are, with no language; repeated rows stay repeated.  Rows are
    independent of each other: nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in cut(batches):
            got = [clean_any(t, f) for t, f in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.list_(pa.string()))], ["rec_id", "clean", "markup"])

    return rows.select(key.cast("long").alias("rec_id"), F.col(text).alias("text"), form.alias("form")).mapInArrow(run, "rec_id long, clean string, markup array<string>")


def section_form() -> Column:
    """How the text of a section is to be read, by its path."""
    ext = F.lower(F.regexp_extract(F.coalesce("source_path", F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("ts", "py"), "code").when(ext.isin("json", "jsonl"), "json").when(ext == "csv", "fields").otherwise("text")


def clean_sections(sections: DataFrame) -> DataFrame:
    """``clean_markup`` of each section_id once; what isn't used of the result isn't shuffled either."""
    return clean_markup(sections, F.col("section_id"), section_form()).dropDuplicates(["rec_id"])


def clean_units(units: DataFrame) -> DataFrame:
    """``clean_markup`` of each unit_id once."""
    form = F.when(F.col("kind") == "code", "code").when(F.col("kind") == "table", "table").otherwise("text")
    return clean_markup(units, F.col("unit_id"), form).dropDuplicates(["rec_id"])


def markup_found(sections: DataFrame, units: DataFrame) -> DataFrame:
    """``rec_table, rec_id, markup`` of the texts with residue."""
    both = clean_sections(sections).withColumn("rec_table", F.lit("sections")).unionByName(clean_units(units).withColumn("rec_table", F.lit("markdown_units")))
    return both.select("rec_table", "rec_id", F.explode("markup").alias("markup"))
