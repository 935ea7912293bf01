"""Sections of Markdown text: cut at headings of level 1 to 3, each with the headings above it."""

from __future__ import annotations

import re

from sedimenta.functions.jstext import trim

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*\Z")
_FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*\Z)|~{3,})")
_UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*\Z")
_NOT_PROSE = re.compile(r" {0,3}(?:>|[-*+][ \t]|\d{1,9}[.)][ \t]|<(?:/?(?:address|article|aside|details|div|dl|fieldset|figure|footer|form|header|hr|main|nav|ol|p|pre|script|section|style|summary|table|ul)\b|!--)|(?:[-*_][ \t]*){3,}\Z)", re.I)
_KEY = re.compile(r"[A-Za-z_][\w.-]*[\t ]*:")
_HEADING_ONLY = re.compile(r"#{1,6}[\t ]+[^\n]+\Z")


def plain(inline: str) -> str:
    """The text of inline Markdown: link labels, alternative texts, code and emphasised words without their marks."""
    out = re.sub(r"!\[([^\]]*)\]\([^)]*\)", r"\1", inline)
    out = re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", out)
    out = re.sub(r"(`+)\s?(.+?)\s?\1", r"\2", out)
    for mark in (r"\*\*", "__", r"\*", r"(?<!\w)_"):
        out = re.sub(rf"{mark}(?=\S)(.+?)(?<=\S){mark.replace('(?<!', '(?!', 1) if mark.startswith('(') else mark}", r"\1", out)
    return trim(re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", out))


#: A block of metadata in lines told by kind: between dashes, at least one key, else only keys, what belongs to them, and blanks.
_BLOCK = re.compile("D(?=[IBD]?[IB]*K)[KIBD][KIB]*[DE]")


def _line_kind(line: str) -> str:
    """H heading, D dashes, E dots, B blank, K a key, I what can stand below a key (indented, item or comment), O other."""
    bare = line.strip()
    if re.match(r"#{1,3}[\t ]+", line):
        return "H"
    if bare in ("---", "...", ""):
        return {"---": "D", "...": "E", "": "B"}[bare]
    return "K" if _KEY.match(bare) else "I" if line[0] in " \t" or bare[0] in "-#" else "O"


def without_frontmatter(raw: str) -> str:
    """The text without a YAML block that stands, between ``---`` lines, before the first heading."""
    lines = raw.split("\n")
    kinds = "".join(map(_line_kind, lines))
    block = _BLOCK.search(kinds.partition("H")[0])
    return "\n".join(lines[: block.start()] + lines[block.end() :]) if block else raw


def headings(raw: str) -> list[tuple[int, int, str]]:
    """(first line, level, title) of the headings that stand on their own, not in code, HTML, quotes or lists."""
    out, lines, i, prose_from = [], raw.split("\n"), 0, None
    in_list = False
    while i < len(lines):
        line = lines[i].rstrip("\r")
        if m := _FENCE.match(line):
            close = re.compile(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*\Z")
            i = next((k for k in range(i + 1, len(lines)) if close.match(lines[k].rstrip("\r"))), len(lines)) + 1
            prose_from = None
            continue
        if m := re.match(r" {0,3}<(pre|script|style|textarea)\b", line, re.I):
            i = next((k for k in range(i, len(lines)) if f"</{m[1].lower()}>" in lines[k].lower()), len(lines)) + 1
            prose_from = None
            continue
        if re.match(r" {0,3}<", line) and _NOT_PROSE.match(line):
            i = next((k for k in range(i, len(lines)) if not lines[k].strip()), len(lines))
            prose_from = None
            continue
        if not line.strip():
            prose_from = None
        elif in_list and line.startswith("  "):
            pass  # belongs to the item
        elif m := _ATX.match(line):
            out.append((i, len(m[1]), plain(m[2] or "")))
            prose_from, in_list = None, False
        elif prose_from is not None and (m := _UNDERLINE.match(line)):
            out.append((prose_from, 1 if m[1][0] == "=" else 2, plain(" ".join(x.strip() for x in lines[prose_from:i]))))
            prose_from = None
        elif _NOT_PROSE.match(line):
            in_list = bool(re.match(r" {0,3}(?:[-*+]|\d{1,9}[.)])[ \t]", line))
            prose_from = None
        elif prose_from is None and not line.startswith(("    ", "\t")):
            prose_from, in_list = i, False
        i += 1
    return out


def sections(raw: str) -> list[dict]:
    """``text``, ``header_path`` and ``header_depth`` of each section.

    Text before the first heading goes below that heading; headings without text of their own are left
    out, as the sections below them name them; without any heading the text is one section.
    """
    raw = without_frontmatter(raw)
    lines = raw.split("\n")
    cuts = [h for h in headings(raw) if h[1] <= 3]
    if not cuts:
        text = trim(raw)
        return [{"text": text, "header_path": [], "header_depth": 0}] if text and not _HEADING_ONLY.match(text) else []
    out, path = [], []
    ends = [c[0] for c in cuts[1:]] + [len(lines)]
    for (start, level, title), end in zip(cuts, ends):
        path = (path[: level - 1] + [None] * (level - 1 - len(path[: level - 1]))) + [title]
        text = trim("\n".join(lines[start:end]))
        if text:
            out.append({"text": text, "header_path": [p for p in path if p and p.strip()], "header_depth": level})
    if out and (before := trim("\n".join(lines[: cuts[0][0]]))):
        out[0]["text"] = _below_heading(out[0]["text"], before)
    return [s for s in out if not _HEADING_ONLY.match(trim(s["text"]))]


def _below_heading(section: str, text: str) -> str:
    """``text`` between the heading line of a section and the rest; before it if the heading isn't of one line."""
    head, body = "", section
    if _line_kind(section) == "H":
        head, _, body = section.partition("\n")
    return "\n\n".join(filter(None, (head.rstrip("\r"), text, body.lstrip() if head else body)))
