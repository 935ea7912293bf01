"""The main body of web pages, by tree scoring.

Paragraphs pass points for their length and commas to their ancestors, discounted by link density.  The
best container is kept with the siblings that belong to it; what a reader wouldn't count as the article
(menus, notices, forms, share lines, lists of related pages) is cut out of it.  HTML strings in the state
of a page compete with the page's own body.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.text_batches import pieces as cut
from sedimenta.functions.htmltree import BLOCKS, Node, parse, render, scripts

#: Elements, roles and names of page furniture.
CHROME = frozenset("nav aside footer form dialog menu button input select textarea label fieldset search".split())
ROLES = frozenset("navigation banner complementary contentinfo dialog alertdialog search menu menubar toolbar form alert".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:menu|nav|navbar|navigation|breadcrumbs?|crumbs?|sidebar|side|aside|footer|foot|ftr|header|hdr|masthead|banner|cookies?|consent|gdpr|notice|popup|modal|overlay|share|sharing|social|related|teaser|teasers|promo|recommend\w*|popular|trending|"
    r"most-?read|newsletter|subscribe|signup|advert\w*|ads?|sponsor\w*|comments?|widget|toolbar|pagination|pager|tags|imprint|legal|skip)(?:$|[\s_-])",
    re.I,
)
GOOD = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|entry|story|text|body)(?:$|[\s_-])", re.I)
#: Elements whose text scores; containers that can hold an article; elements of which running text is made.
SCORING = frozenset("p pre blockquote li td th dd dt h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("div section article main td body center #root".split())
WHOLE = frozenset("body html center #root".split())
FLOW = frozenset("p ul ol dl pre table blockquote figure h2 h3 h4 h5 h6 listing xmp".split())
#: Elements that show that a box holds more than a single remark.
HOLDING = frozenset("h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote article main".split())
#: A list or block is furniture if so much of its text is links.
LINKS = 0.5
#: Characters at which an element counts as a full paragraph; shorter ones count in proportion.
FULL = 25
RIGHTS = re.compile(r"^\s*(?:©|\(c\)\s|copyright\b)", re.I)
COMMAS = re.compile("[,\u060c\u3001\uff0c;]")
CODE = re.compile(r"(?<![A-Za-z0-9])(?:KB|REL|FAQ|ADR|INC)-[0-9]{5}(?![0-9])")


class _Page:
    """What lies below each node, furniture left out: text, link text, headline, texts that stand by themselves."""

    def __init__(self, root: Node):
        self.root, self.cut = root, set()
        self.size: dict[Node, int] = {}
        self.linked: dict[Node, int] = {}
        self.texts: dict[Node, int] = {}
        self.headed: set[Node] = set()
        self.holds: set[Node] = set()
        order, stack = [], [(root, False, False)]
        while stack:
            node, link, inside = stack.pop()
            tag, role = node.tag, node.attrs.get("role") if node.attrs else None
            if node.hidden or tag in CHROME or role in ROLES or tag == "header" and not inside:
                self.cut.add(node)
                continue
            link, inside = link or tag == "a", inside or tag in ("article", "main") or role == "main"
            order.append((node, link))
            stack += [(c, link, inside) for c in reversed(node.children) if isinstance(c, Node)]
        #: Nodes in document order.
        self.order = [n for n, _ in order]
        for node, link in reversed(order):
            size = linked = texts = own = 0
            for c in node.children:
                if isinstance(c, str):
                    own += len(c.strip())
                elif c in self.size:
                    size += self.size[c]
                    linked += self.linked[c]
                    texts += self.texts[c]
                    if c in self.headed:
                        self.headed.add(node)
                    if c in self.holds:
                        self.holds.add(node)
            size += own
            self.size[node] = size
            self.linked[node] = size if link else linked
            # a block whose own words aren't mostly links is one text
            if node.tag in BLOCKS and not texts and size and self.linked[node] <= LINKS * size:
                texts = 1
            self.texts[node] = texts
            if node.tag == "h1" and size:
                self.headed.add(node)
            if node.tag in HOLDING and size and self.linked[node] <= LINKS * size:
                self.holds.add(node)

    def density(self, node: Node) -> float:
        return self.linked.get(node, 0) / max(1, self.size.get(node, 0))

    def lead(self, node: Node, most: int = 60) -> str:
        """The first characters of a node's text."""
        out, have, stack = [], 0, [node]
        while stack and have < most:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
                have += len(n.strip())
            elif n not in self.cut:
                stack += reversed(n.children)
        return "".join(out)

    def text(self, node: Node) -> str:
        return self.lead(node, self.size.get(node, 0) + 1)

    def shown(self, node: Node) -> list[Node]:
        """The children with visible text."""
        return [c for c in node.elements() if c not in self.cut and self.size.get(c)]

    def rights(self, node: Node) -> bool:
        return bool(RIGHTS.match(self.lead(node)))


def _names(node: Node) -> str:
    return f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}" if node.attrs else ""


def _trim(page: _Page) -> None:
    """Cut the boxes at the edges of a page that aren't part of what lies between them.

    Going inwards from either end of the page: link boxes, lines of rights, and remarks.  A remark is a box
    of one text without heading, list, table or code, while another box of the page has the headline or,
    on pages without one, holds more.  So notices are told by where and how they stand, not by their words.
    """
    top = page.root
    while True:
        kids = page.shown(top)
        if len(kids) != 1 or any(isinstance(c, str) and c.strip() for c in top.children):
            break
        top = kids[0]
    main = next((c for c in kids if c in page.headed), None)
    if main is None:
        richest = max(kids, key=lambda c: (c in page.holds) * page.texts[c], default=None)
        main = richest if richest is not None and (richest in page.holds or page.texts[richest] > 1) else None
    # whether the headline stands in the running text itself, not in a box or in a cell
    flat = main is not None and main.tag in FLOW - {"table", "ul", "ol", "dl"} | {"h1"}
    for side in (kids, kids[::-1]):
        for c in side:
            if c is main:
                break
            if page.density(c) > LINKS or page.rights(c):
                page.cut.add(c)
            elif main is not None and c not in page.holds and page.texts[c] <= 1 and (c.tag not in FLOW or not flat or side is kids and main in page.headed):
                page.cut.add(c)
            else:
                break


def _score(page: _Page) -> dict[Node, float]:
    points: dict[Node, float] = {}
    weight: dict[Node, float] = {}
    above: dict[Node, tuple[Node | None, float]] = {}
    gone: set[Node] = set()
    for node in page.order:
        if node.parent in gone or node in page.cut:
            gone.add(node)
            continue
        # the nearest container above, so that elements without say aren't walked through
        up = node.parent
        above[node] = (None, 1.0) if up is None else (up, 0.0) if up.tag in CONTAINERS else above[up]
        if node.tag not in SCORING or not page.size[node] or any(c.tag in BLOCKS for c in node.elements()):
            continue
        text = page.text(node).strip()
        if RIGHTS.match(text):
            continue
        weight[node] = (min(1.0, len(text) / FULL) + len(COMMAS.findall(text)) + min(len(text) / 100, 4)) * (1 - page.density(node))
    for node, value in weight.items():
        up, share = above[node][0], 1.0
        # each container hands half of what it got to the one around it
        while up is not None and share > 0.1:
            points[up] = points.get(up, 0) + value * share
            share /= 2
            up = above[up][0]
    for node in points:
        names = _names(node)
        bonus = 1.25 if node.tag in ("article", "main") or node.attrs.get("role") == "main" or GOOD.search(names) else 0.3 if NAMES.search(names) else 1.0
        points[node] *= bonus * (1 - page.density(node))
    return points


def _container(page: _Page) -> tuple[Node | None, float]:
    points = _score(page)
    if not points:
        return None, 0.0
    best = max(points, key=points.get)
    # the headline belongs to the article: go up to where both are below
    lines = [n for n in page.order if n.tag == "h1" and n in page.headed and n not in page.cut]
    if lines and best not in page.headed:
        above, n = set(), best
        while n is not None:
            above.add(n)
            n = n.parent
        for line in lines:
            up = line
            while up not in above:
                up = up.parent
            if up.tag in CONTAINERS and up.tag not in ("#root", "body") or not any(x.tag in CONTAINERS - {"#root", "body"} for x in _between(best, up)):
                return up, points[best]
        # a headline in another box than the most points: the box of the headline, if any of its texts scored
        own = max((n for n in points if n in page.headed and n.tag not in WHOLE), key=points.get, default=None)
        if own is not None and points[own] * 2 > points[best]:
            return own, points[own]
    return best, points[best]


def _between(node: Node, up: Node) -> Iterator[Node]:
    while node is not None and node is not up:
        yield node
        node = node.parent


def _furniture(page: _Page, node: Node) -> bool:
    """Whether a block inside the container isn't part of the article."""
    if node in page.headed:
        return False
    if page.rights(node) or node.tag in BLOCKS and page.size.get(node) and page.density(node) > LINKS:
        return True
    names = _names(node)
    return bool(names and NAMES.search(names) and not GOOD.search(names))


def _prune(page: _Page, node: Node) -> None:
    """Cut furniture below ``node``; a heading goes with the list that it stands over."""
    stack = [node]
    while stack:
        n = stack.pop()
        before = None
        for c in n.elements():
            if c not in page.cut:
                if _furniture(page, c):
                    page.cut.add(c)
                    if c.tag in ("ul", "ol", "div", "dl") and before is not None and re.fullmatch("h[2-6]", before.tag):
                        page.cut.add(before)
                else:
                    stack.append(c)
            before = c


def _siblings(page: _Page, node: Node) -> None:
    """Where the whole page is the container, the headline's siblings are judged one by one.

    What stands before it is no part of the article.  Behind it running text is kept, and boxes that hold
    more than one text; rules part the page, and a part of boxes or links alone ends the article.
    """
    head = next((c for c in node.elements() if c in page.headed and c not in page.cut), None)
    if head is None:
        return
    drop, found, ended, ruled = [], False, False, False
    for k, c in enumerate(node.children):
        if c is head:
            found = True
        elif isinstance(c, str):
            if not found or ended:
                node.children[k] = ""
        elif c in page.cut:
            continue
        elif not found or ended:
            drop.append(c)
        elif c.tag == "hr":
            ruled = True
        elif page.size.get(c) or c.tag in FLOW:
            flow = c.tag in FLOW and page.density(c) <= LINKS
            if ruled and not flow:
                ended = True
                drop.append(c)
            elif not flow and c.tag in BLOCKS and c not in page.holds and page.texts.get(c, 0) <= 1 and page.density(c) > LINKS:
                drop.append(c)
            ruled = False
    page.cut.update(drop)


def main_body(source: str) -> tuple[Node | None, float]:
    """The tree of the main body, furniture taken out, and its score.

    A body has a headline or other structure, more than one text, or is all that the page says.
    """
    page = _Page(parse(source))
    said = page.size[page.root] if page.root in page.size else 0
    _trim(page)
    best, score = _container(page)
    if best is None:
        return None, 0.0
    if best.tag in WHOLE:
        _siblings(page, best)
    _prune(page, best)
    kept, stack, holds, texts, size = [best], [best], False, 0, 0
    while stack:
        n = stack.pop()
        n.children = [c for c in n.children if isinstance(c, str) or c not in page.cut]
        below = [c for c in n.elements()]
        holds = holds or n in page.holds and n.tag in HOLDING
        texts += page.texts.get(n, 0) == 1 and not any(page.texts.get(c) for c in below)
        size += sum(len(c.strip()) for c in n.children if isinstance(c, str))
        stack += below
    if not size or page.density(best) > LINKS and best not in page.headed or not holds and texts < 2 and size < said:
        return None, 0.0
    return best, score


def state_strings(source: str) -> list[str]:
    """HTML strings in the JSON that a page's scripts hold."""
    out: list[str] = []
    for body in map(str.strip, scripts(source)):
        at = re.search(r"[{\[]", body)
        if not at or "<" not in body and "\\u003c" not in body.lower() and "&lt;" not in body:
            continue
        try:
            value, _ = json.JSONDecoder().raw_decode(body[at.start() :])
        except (ValueError, RecursionError):
            continue
        stack = [value]
        while stack:
            v = stack.pop()
            if isinstance(v, str):
                if re.search(r"<(?:p|h[1-6]|ul|ol|div|article|section|table|pre|blockquote|main)\b", v, re.I):
                    out.append(v)
            elif isinstance(v, dict):
                stack += v.values()
            elif isinstance(v, list):
                stack += v
    return out


def extract(source: str | None) -> tuple[str, list[str]]:
    """The text of the main body (empty if there is none) and the distinct codes a reader sees in it.

    Bodies of any length count.  A body with a headline goes before one without, then points decide.
    """
    if not source or not source.strip():
        return "", []
    best, rank = None, (False, 0.0)
    for page in (source, *state_strings(source)):
        body, points = main_body(page)
        if body is not None:
            own = (any(n.tag == "h1" for n in body.walk()), points)
            if best is None or own > rank:
                best, rank = body, own
    if best is None:
        return "", []
    text = render(best)
    return text, sorted(set(CODE.findall(text)))


def main_bodies(pages: DataFrame) -> DataFrame:
    """``page_id, body, ref_codes`` of each page; null and empty pages have an empty body.

    A page delivered twice counts once.  Pages are independent of each other; only ids meet in a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in cut(batches):
            got = [extract(h) for h in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.list_(pa.string()))], ["page_id", "body", "ref_codes"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, body string, ref_codes array<string>").dropDuplicates(["page_id"])


def body_codes(pages: DataFrame) -> DataFrame:
    """``page_id, ref_code`` of the main bodies."""
    return main_bodies(pages).select("page_id", F.explode("ref_codes").alias("ref_code"))
