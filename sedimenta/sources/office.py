"""Word documents and PDF pages, by what the standard library can read."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.etree import ElementTree

from sedimenta.errors import ParseError

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_markdown(data: bytes) -> str:
    """Markdown of a Word document: headings by style, lists, bold and italic runs, tables."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        raise ParseError(f"not a Word document: {e}") from None
    out = []
    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            out.append(_paragraph(node))
        elif node.tag == f"{_W}tbl":
            rows = [[" ".join(_paragraph(p) for p in c.iter(f"{_W}p")).strip().replace("|", "\\|") for c in r.findall(f"{_W}tc")] for r in node.findall(f"{_W}tr")]
            if rows:
                width = max(map(len, rows))
                rows = [r + [""] * (width - len(r)) for r in rows]
                out.append("\n".join(f"| {' | '.join(r)} |" for r in [rows[0], ["---"] * width, *rows[1:]]))
    return "\n\n".join(x for x in out if x.strip())


def _paragraph(p) -> str:
    parts = []
    for run in p.iter(f"{_W}r"):
        text = "".join(x.text or "" if x.tag == f"{_W}t" else "\n" if x.tag == f"{_W}br" else "\t" if x.tag == f"{_W}tab" else "" for x in run.iter())
        props = run.find(f"{_W}rPr")
        for name, mark in (("b", "**"), ("i", "*")):
            flag = props.find(f"{_W}{name}") if props is not None else None
            if flag is not None and flag.get(f"{_W}val") not in ("0", "false") and text.strip():
                text = mark + text.strip() + mark + " " * (text != text.rstrip())
        parts.append(text)
    text = "".join(parts).strip()
    props = p.find(f"{_W}pPr")
    style = props.find(f"{_W}pStyle") if props is not None else None
    m = re.fullmatch(r"(?:heading|Heading|berschrift|Titre)\s?([1-6])|(Title)", style.get(f"{_W}val", "")) if style is not None else None
    if m and text:
        return "#" * int(m[1] or 1) + " " + text.strip("*")
    return f"- {text}" if props is not None and props.find(f"{_W}numPr") is not None and text else text


_STRING = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>", re.S)
_SHOW = re.compile(
    rb"/(?P<font>[^\s/<>\[\]()]+)\s+[-+.\d]+\s+Tf\b|\[(?P<many>(?:[^\[\]\\()]|\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\))*)\]\s*TJ|(?P<one>\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>)\s*(?:Tj|'|\")|(?P<line>T\*|(?:T[dDm]|ET)\b)",
    re.S,
)
_PART = re.compile(_STRING.pattern + rb"|(?P<shift>-\d+(?:\.\d+)?)", re.S)
#: Fixed value: a shift between strings, in thousandths, from which on it stands for a blank.
BLANK_SHIFT = -200


def _raw(raw: bytes) -> bytes:
    """The bytes of a string in parentheses or in hexadecimal."""
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    short = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
    return re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: short.get(m[1], b"" if m[1][:1] in b"\r\n" else bytes([int(m[1], 8) & 255]) if m[1].isdigit() else m[1]), raw[1:-1], flags=re.S)


class _Font:
    """Codes of a font and the text that they stand for; without a map, bytes of a western encoding."""

    def __init__(self, cmap: bytes = b"", wide: bool = False):
        self.text: dict[int, str] = {}
        spaces = re.findall(rb"begincodespacerange(.*?)endcodespacerange", cmap, re.S)
        first = re.search(rb"<([0-9A-Fa-f]+)>", spaces[0]) if spaces else None
        self.width = len(first[1]) // 2 if first else 2 if wide else 1
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
            for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f\s]*)>", block):
                self.text[int(code, 16)] = self._unicode(to)
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
            for low, high, to, each in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f\s]*)>|\[(.*?)\])", block, re.S):
                low, high = int(low, 16), min(int(high, 16), int(low, 16) + 0xFFFF)
                if each:
                    self.text |= dict(zip(range(low, high + 1), map(self._unicode, re.findall(rb"<([0-9A-Fa-f\s]*)>", each))))
                elif start := self._unicode(to):
                    self.text |= {c: start[:-1] + chr(min(ord(start[-1]) + c - low, 0x10FFFF)) for c in range(low, high + 1)}

    @staticmethod
    def _unicode(digits: bytes) -> str:
        return _raw(b"<" + digits + b">").decode("utf-16-be", "replace")

    def decode(self, data: bytes) -> str:
        if not self.text:
            return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("cp1252", "replace")
        n = max(1, self.width)
        codes = (int.from_bytes(data[i : i + n], "big") for i in range(0, len(data), n))
        return "".join(self.text.get(c, chr(c) if n == 1 and 32 <= c < 127 else "") for c in codes)


class _Objects(dict):
    """Objects by number, and the values of their dictionaries, followed through references."""

    def value(self, body: bytes, key: bytes) -> bytes:
        m = re.search(rb"/" + key + rb"(?![A-Za-z0-9])\s*", body)
        if not m:
            return b""
        ref = re.compile(rb"(\d+)\s+\d+\s+R").match(body, m.end())
        if ref:
            return self.get(int(ref[1]), b"")
        depth, at = 0, m.end()
        for mark in re.finditer(rb"<<|>>", body[m.end() :]):
            depth += 1 if mark[0] == b"<<" else -1
            if depth <= 0:
                return body[at : at + mark.end()]
        return body[at:]


def pdf_pages(data: bytes) -> list[str]:
    """The text of each page: uncompressed or deflated content streams, fonts with maps to Unicode or simple ones; anything else raises."""
    if not data.startswith(b"%PDF-"):
        raise ParseError("not a PDF")
    objects = _Objects((int(m[1]), m[2]) for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", data, re.S))

    def stream(body: bytes) -> bytes:
        m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
        if not m:
            return b""
        if b"FlateDecode" in body[: m.start()]:
            try:
                return zlib.decompressobj().decompress(m[1])
            except zlib.error as e:
                raise ParseError(f"damaged PDF stream: {e}") from None
        return m[1]

    for body in list(objects.values()):
        if b"/ObjStm" in body[:400]:
            content, first = stream(body), int(re.search(rb"/First\s+(\d+)", body)[1])
            numbers = list(map(int, content[:first].split()))
            spans = sorted(zip(numbers[1::2], numbers[::2]))
            for (at, name), (end, _) in zip(spans, [*spans[1:], (len(content), 0)]):
                objects.setdefault(name, content[first + at : first + end])
    pages: list[int] = []

    def walk(name: int, depth: int = 0) -> None:
        body = objects.get(name, b"")
        kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
        if kids and depth < 64:
            for k in re.findall(rb"(\d+)\s+\d+\s+R", kids[1]):
                walk(int(k), depth + 1)
        elif re.search(rb"/Type\s*/Page\b", body):
            pages.append(name)

    for name, body in objects.items():
        if re.search(rb"/Type\s*/Catalog\b", body) and (m := re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", body)):
            walk(int(m[1]))
            break
    if not pages:
        raise ParseError("the PDF has no readable pages (damaged, encrypted or scanned)")
    made: dict[bytes, _Font] = {}

    def fonts(page: bytes) -> dict[bytes, _Font]:
        """The fonts of a page by name; resources may be inherited."""
        body = page
        for _ in range(64):
            found = objects.value(objects.value(body, b"Resources"), b"Font")
            if found or not (body := objects.value(body, b"Parent")):
                break
        out = {}
        for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", found):
            font = objects.get(int(number), b"")
            if number not in made:
                made[number] = _Font(stream(objects.value(font, b"ToUnicode")), b"/Type0" in font)
            out[name] = made[number]
        return out

    out = []
    for name in pages:
        m = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", objects[name], re.S)
        content = b"\n".join(stream(objects.get(int(k), b"")) for k in re.findall(rb"(\d+)\s+\d+\s+R", m[1])) if m else b""
        known, font, text = fonts(objects[name]), _Font(), []
        for s in _SHOW.finditer(content):
            if s["font"] is not None:
                font = known.get(s["font"]) or _Font()
            elif s["line"] is not None:
                text.append("\n")
            elif s["one"] is not None:
                text.append(font.decode(_raw(s["one"])))
            else:
                for part in _PART.finditer(s["many"]):
                    text.append((" " if float(part["shift"]) <= BLANK_SHIFT else "") if part["shift"] else font.decode(_raw(part[0])))
        out.append(re.sub(r"\s*\n\s*", "\n", "".join(text)).strip())
    return out
