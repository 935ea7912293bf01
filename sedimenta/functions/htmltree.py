"""A tolerant HTML tree: implied end tags, void elements, stray end tags, visibility."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from dataclasses import dataclass, field

#: Element names of HTML, current and obsolete.
ELEMENTS = frozenset(
    "a abbr acronym address applet area article aside audio b base basefont bdi bdo big blink blockquote body br button canvas caption center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed "
    "fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins isindex kbd keygen label legend li link listing main map mark marquee menu meta meter nav nobr "
    "noframes noscript object ol optgroup option output p param picture plaintext pre progress q rp rt ruby s samp script search section select slot small source span strike strong style sub summary sup svg table tbody td "
    "template textarea tfoot th thead time title tr track tt u ul var video wbr xmp".split()
)
#: Elements without content; elements whose content is text only; elements that don't show.
VOID = frozenset("area base basefont br col embed frame hr img input isindex keygen link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
HIDDEN = frozenset("head script style template title noscript iframe object svg canvas audio video datalist select option textarea input".split())
#: Elements that end an open paragraph, and by start tag the open elements that it ends, and where the search for them stops.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption listing xmp".split()
)
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th", "caption", "colgroup"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"), "thead": ("caption", "colgroup"), "tfoot": ("tbody", "thead", "tr", "td", "th"), "option": ("option",), "optgroup": ("option", "optgroup")}
FENCES = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",), "option": ("select", "datalist"), "optgroup": ("select",)}
#: Elements beyond which an end tag doesn't close anything, and end tags that reach through them.
SCOPE = frozenset("table td th caption html body".split())
THROUGH = SCOPE | {"tr", "tbody", "thead", "tfoot"}
#: What may stand in a table outside its cells; anything else belongs before the table.
TABLE_PARTS = frozenset("caption colgroup col tbody thead tfoot tr td th script style template".split())
TABLE_ONLY = TABLE_PARTS - {"script", "style", "template"}
TABLE_FRAME = frozenset("table tbody thead tfoot tr colgroup".split())
PARAGRAPH_FENCES = ("table", "td", "th", "caption", "li", "blockquote", "div", "section", "article", "main", "body", "button")
#: List and quotation levels that are shown by indenting; deeper ones are numbered instead, so that text stays as long as its source.
INDENTED = 32

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^<>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>`]+)))?")


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: "Node | None" = None
    #: Nodes and strings.
    children: list = field(default_factory=list)

    def elements(self):
        return (c for c in self.children if isinstance(c, Node))

    def walk(self):
        """The node and all below, in document order."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    @property
    def hidden(self) -> bool:
        a = self.attrs
        if not a:
            return self.tag in HIDDEN
        return self.tag in HIDDEN or "hidden" in a or a.get("aria-hidden") == "true" or "style" in a and bool(_UNSEEN.search(a["style"]))


class Builder:
    """Builds the tree from start tags, end tags and texts, whatever the depth.

    Open elements are indexed by name, so that no tag has to search through them.
    """

    def __init__(self):
        self.root = Node("#root")
        self.open: list[Node] = [self.root]
        self._places: dict[str, list[int]] = {}
        self._scopes: list[int] = []

    @property
    def at(self) -> Node:
        return self.open[-1]

    def _close(self, place: int) -> None:
        """Close the open elements from ``place`` on."""
        while len(self.open) > place:
            name = self.open.pop().tag
            self._places[name].pop()
            if name in SCOPE:
                self._scopes.pop()

    def _last(self, names) -> int:
        return max((p[-1] for n in names if (p := self._places.get(n))), default=0)

    def _imply(self, names: tuple[str, ...], fences: tuple[str, ...]) -> None:
        """Close the outermost of ``names`` that is open within the innermost of ``fences``."""
        if not any(self._places.get(n) for n in names):
            return
        fence, first = self._last(fences), None
        for n in names:
            places = self._places.get(n)
            if places and places[-1] > fence:
                k = places[bisect_right(places, fence)]
                first = k if first is None else min(first, k)
        if first is not None:
            self._close(first)

    def _before_table(self, child) -> Node:
        """Put what can't stand in a table before it; returns its parent."""
        table = self.open[self._places["table"][-1]]
        parent = table.parent
        # the table is among the last children of its parent
        i = next(i for i in range(len(parent.children) - 1, -1, -1) if parent.children[i] is table)
        parent.children.insert(i, child)
        return parent

    def _in_frame(self) -> bool:
        return self.open[-1].tag in TABLE_FRAME and bool(self._places.get("table"))

    def start(self, name: str, attrs: dict[str, str] | None = None, empty: bool = False) -> Node:
        if name in BLOCKS:
            self._imply(("p",), PARAGRAPH_FENCES)
        if name in ENDS:
            self._imply(ENDS[name], FENCES[name])
        if name in TABLE_ONLY and self._places.get("table"):
            frame = self._last(TABLE_FRAME)
            if self._last(("td", "th", "caption")) < frame < len(self.open) - 1:
                self._close(frame + 1)  # what had to stand before the table
        at = self.open[-1].tag
        if name[0] == "h" and name[1:].isdigit() and at[0] == "h" and at[1:].isdigit():
            self._close(len(self.open) - 1)
        node = Node(name, attrs or {})
        if at != "#root" and self._in_frame() and name not in TABLE_PARTS:
            node.parent = self._before_table(node)
        else:
            if name in ("td", "th") and self._in_frame() and self.open[-1].tag != "tr":
                self.start("tr")
            node.parent = self.open[-1]
            node.parent.children.append(node)
        if name not in VOID and not empty:
            self._places.setdefault(name, []).append(len(self.open))
            if name in SCOPE:
                self._scopes.append(len(self.open))
            self.open.append(node)
        return node

    def drop(self, node: Node) -> None:
        """Close ``node`` if it is the innermost open element."""
        if self.open[-1] is node:
            self._close(len(self.open) - 1)

    def end(self, name: str) -> bool:
        """Whether the end tag closed an element."""
        places = self._places.get(name)
        if not places or name not in THROUGH and self._scopes and self._scopes[-1] > places[-1]:
            return False
        self._close(places[-1])
        return True

    def text(self, text: str) -> None:
        if not text:
            return
        if self._in_frame() and not text.isspace():
            self._before_table(text)
        else:
            self.open[-1].children.append(text)


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if not source or source.isspace():
        return out
    for m in _ATTRIBUTE.finditer(source):
        out.setdefault(m[1].lower(), html.unescape(next((g for g in m.groups()[1:] if g is not None), "")))
    return out


def parse(source: str) -> Node:
    """The tree of an HTML text; broken nesting is mended, nothing raises."""
    b, at, n = Builder(), 0, len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if not m:
            break
        b.text(html.unescape(source[at : m.start()]))
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            b.end(name)
            continue
        node = b.start(name, attributes(m[3]), False)
        if name in RAW:
            stop = re.compile(rf"</{name}\s*>", re.I).search(source, at)
            content = source[at : stop.start() if stop else n]
            at = stop.end() if stop else n
            node.children.append(content)
            b.drop(node)
    b.text(html.unescape(source[at:]))
    return b.root


def scripts(source: str) -> list[str]:
    """What stands between the script tags of a page."""
    out, at, low = [], 0, source.lower()
    while (start := low.find("<script", at)) >= 0:
        begin = low.find(">", start)
        stop = low.find("</script", begin)
        if begin < 0 or stop < 0:
            break
        out.append(source[begin + 1 : stop])
        at = stop
    return out


def drive(root: Node, sink) -> None:
    """Hand the tree to a sink: ``text(string)``, ``enter(node)`` (whether to go into it) and ``leave(node)``; no recursion."""
    path, at = [root], [iter(root.children)]
    while at:
        for c in at[-1]:
            if isinstance(c, str):
                sink.text(c)
            elif sink.enter(c):
                path.append(c)
                at.append(iter(c.children))
                break
        else:
            at.pop()
            node = path.pop()
            if at:
                sink.leave(node)


def text_of(node: Node) -> str:
    """All text below a node, in order."""
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        else:
            stack += reversed(n.children)
    return "".join(out)


def aligned(rows: list[list[str]]) -> str:
    """Cells side by side, three blanks apart, in columns as wide as their widest cell."""
    widths: list[int] = []
    for r in rows:
        widths += [0] * (len(r) - len(widths))
        for i, c in enumerate(r):
            widths[i] = max(widths[i], len(c))
    return "\n".join("   ".join(c.ljust(widths[i]) for i, c in enumerate(r)).rstrip() for r in rows)


_SPACE = re.compile(r"[ \t\n\r\f\v]+")
_AROUND_BREAKS, _AROUND_BLANKS, _BLANKS = re.compile(r"[ \t]*\n[ \t]*"), re.compile(r" *\n *"), re.compile(" {2,}")
_LISTS = frozenset(("ul", "ol", "menu", "dir"))
_VERBATIM = frozenset(("pre", "listing", "xmp"))


class _Plain:
    """Sink that writes visible text: blocks apart, list items marked, code untouched, table cells aligned.

    A frame collects the blocks of the text or of a table cell.  ``lead`` is the stack of marks and
    indents under which a block stands; a mark is written once, with the first block behind it.
    """

    def __init__(self, keep_lines: bool):
        self.keep_lines = keep_lines
        self.line: list[str] = []
        self.frames: list[list[list]] = [[]]
        self.lead: list[list] = []
        self.tables: list[list[list[str]]] = []
        self.saved: list[tuple] = []
        self.numbers: list[int] = []
        self.number = 0
        #: Depth of elements in which blanks of the source don't count; lists open in the frame; blank lines allowed between lists that belong together.
        self.flowing, self.lists, self.joined = 0, 0, None

    # -- writing --------------------------------------------------------------------------------
    def _prefix(self) -> tuple[str, str]:
        shown = self.lead[:INDENTED]
        rest = "".join([indent for _, indent in shown])
        first = "".join([indent if mark is None else mark for mark, indent in shown])
        for entry in shown:
            entry[0] = None
        if len(self.lead) > INDENTED:
            inmost = self.lead[-1]
            first += f"({len(self.lead)}) {inmost[0] or ''}"
            inmost[0] = None
        return first, rest

    def block(self, text: str, indent: str = "") -> None:
        if not text.strip():
            return
        first, rest = self._prefix()
        lines = text.split("\n")
        out = [(first if i == 0 else rest) + indent + x for i, x in enumerate(lines)]
        self.frames[-1].append([self.lists, "\n".join(out)])

    def flush(self) -> None:
        if self.line:
            text = "".join(self.line)
            self.line.clear()
            text = _AROUND_BREAKS.sub("\n", text) if self.keep_lines else _AROUND_BLANKS.sub("\n", _BLANKS.sub(" ", text))
            self.block(text.strip())

    def pop(self) -> str:
        """The blocks of the innermost frame: a blank line between them, but none between blocks of one list."""
        out, before = [], 0
        for inner, text in self.frames.pop():
            if out:
                out.append("\n" if inner and inner == before else "\n\n")
            out.append(text)
            before = inner
        return "".join(out)

    # -- events ---------------------------------------------------------------------------------
    def text(self, text: str) -> None:
        if self.joined is not None and (text.strip() or text.count("\n") > 2):
            self.joined = None
        self.line.append(text if self.keep_lines and not self.flowing else _SPACE.sub(" ", text))

    def enter(self, node: Node) -> bool:
        tag = node.tag
        if tag not in _LISTS and self.lists == 0:
            self.joined = None
        if node.hidden:
            return False
        if tag in _LISTS:
            self.flush()
            if self.lists == 0:
                self.number = self.number + 1 if self.joined is None else self.number
            self.lists = self.lists or self.number
            if node.parent is not None and node.parent.tag in _LISTS:
                self.lead.append([None, "  "])
            self.numbers.append(0)
            self.flowing += 1
            return True
        if tag == "li":
            self.flush()
            mark = node.attrs.get("mark")
            if self.numbers:
                self.numbers[-1] += 1
            if not mark:
                mark = f"{self.numbers[-1]}." if self.numbers and node.parent is not None and node.parent.tag == "ol" else "-"
            self.lead.append([mark + " ", " " * (len(mark) + 1)])
            self.flowing += 1
            return True
        if tag == "br":
            self.line.append("\n")
            return False
        if tag == "hr":
            self.flush()
            return False
        if tag == "img":
            self.line.append(node.attrs.get("alt", ""))
            return False
        if tag in _VERBATIM:
            self.flush()
            self.block(text_of(node).strip("\n"), "    ")
            return False
        if tag == "table":
            self.flush()
            self.tables.append([])
            self.frames.append([])
            self.saved.append((self.lead, self.lists, self.numbers, self.joined))
            self.lead, self.lists, self.numbers, self.joined = [], 0, [], None
            self.flowing += 1
            return True
        if tag == "tr" and self.tables:
            self.tables[-1].append([])
            return True
        if tag in ("td", "th") and self.tables:
            self.flush()
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.frames.append([])
            return True
        if tag in BLOCKS:
            self.flush()
            if tag in ("blockquote", "dd"):
                self.lead.append(["  ", "  "])
            self.flowing += 1
            return True
        self.flowing += node.attrs.get("of", "html") == "html"
        return True

    def leave(self, node: Node) -> None:
        tag = node.tag
        if tag in _LISTS:
            self.flush()
            self.numbers.pop()
            self.flowing -= 1
            if node.parent is not None and node.parent.tag in _LISTS:
                self.lead.pop()
            if not self.numbers:
                self.lists, self.joined = 0, True
        elif tag == "li":
            self.flush()
            self.lead.pop()
            self.flowing -= 1
        elif tag == "table":
            self.flush()
            rest = self.pop()
            rows = self.tables.pop()
            self.lead, self.lists, self.numbers, self.joined = self.saved.pop()
            self.flowing -= 1
            self.block(rest)
            self.block(aligned(rows))
        elif tag == "tr" and self.tables:
            self.flush()
        elif tag in ("td", "th") and self.tables:
            self.flush()
            self.tables[-1][-1].append(_SPACE.sub(" ", self.pop()).strip())
        elif tag in BLOCKS:
            self.flush()
            if tag in ("blockquote", "dd"):
                self.lead.pop()
            self.flowing -= 1
        else:
            self.flowing -= node.attrs.get("of", "html") == "html"


def render(root: Node, keep_lines: bool = False) -> str:
    """The visible text of a tree.

    ``keep_lines``: line breaks of texts directly in the root (or in inline elements there that aren't
    HTML) are kept, as in plain text.
    """
    sink = _Plain(keep_lines)
    drive(root, sink)
    sink.flush()
    return sink.pop()
