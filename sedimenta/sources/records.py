"""Sections of CSV, JSON and JSON lines."""

from __future__ import annotations

import re

from sedimenta.errors import ParseError
from sedimenta.functions.jstext import parse, shown, trim


def csv_rows(text: str, strict: bool = False) -> list[list[str]]:
    """Rows of cells: quoted values may hold commas, doubled quotes and line ends (CR, LF or both).

    A quote within an unquoted value opens a quoted stretch.  A quote that is never closed runs to the
    end, or raises if ``strict``.
    """
    rows, row, cell, at, n, quoted = [], [], [], 0, len(text), False
    stop = re.compile(r'[",\r\n]')
    while at < n:
        if quoted:
            end = text.find('"', at)
            if end < 0:
                if strict:
                    raise ParseError("a quoted value isn't closed")
                cell.append(text[at:])
                break
            cell.append(text[at:end])
            if text[end + 1 : end + 2] == '"':
                cell.append('"')
                at = end + 2
            else:
                quoted, at = False, end + 1
            continue
        m = stop.search(text, at)
        if not m:
            cell.append(text[at:])
            break
        cell.append(text[at : m.start()])
        at = m.end()
        if m[0] == '"':
            quoted = True
            if strict and at >= n:
                raise ParseError("a quoted value isn't closed")
            continue
        row.append("".join(cell))
        cell = []
        if m[0] != ",":
            at += m[0] == "\r" and text[at : at + 1] == "\n"
            rows.append(row)
            row = []
    if cell or row:
        rows.append([*row, "".join(cell)])
    return rows


def csv_sections(text: str, strict: bool = False) -> list[dict]:
    """One section per data row, ``column: value`` lines; rows of one empty cell are left out but numbered."""
    rows = csv_rows(text.removeprefix("\ufeff"), strict)
    if not rows:
        return []
    head, out = rows[0], []
    for i, row in enumerate(rows[1:], 1):
        if len(row) == 1 and not row[0].strip():
            continue
        values = row + [""] * (len(head) - len(row))
        out.append({"text": "\n".join(f"{h}: {v}" for h, v in zip(head, values)), "row": i, "columns": dict(zip(head, values))})
    return out


def json_sections(text: str) -> list[dict]:
    """A section per element of an array or per key of an object; a scalar is one section."""
    try:
        value = parse(text.removeprefix("\ufeff"))
    except (ValueError, RecursionError) as e:
        raise ParseError(f"malformed JSON: {e}") from None
    if isinstance(value, list):
        return [{"text": shown(v), "key_path": f"[{i}]", "index": i} for i, v in enumerate(value)]
    if isinstance(value, dict):
        return [{"text": shown(v), "key_path": k} for k, v in value.items()]
    return [{"text": shown(value)}]


def jsonl_sections(text: str) -> list[dict]:
    """A section per non-blank line, with its number among all lines."""
    out = []
    for i, line in enumerate(re.split(r"\r?\n", text.removeprefix("\ufeff")), 1):
        if not trim(line):
            continue
        try:
            out.append({"text": shown(parse(line)), "line": i})
        except (ValueError, RecursionError) as e:
            raise ParseError(f"malformed JSON in line {i}: {e}") from None
    return out
