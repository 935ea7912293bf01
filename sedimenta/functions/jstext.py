"""Text conventions that ids and stored metadata depend on: trimming, number and JSON spelling."""

from __future__ import annotations

import json
import math
import re

#: White space that trimming removes (Unicode blanks, line ends and the byte order mark).
BLANKS = "\t\n\x0b\x0c\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_EACH = "".join(c for c in map(chr, range(0x10000)) if re.match(f"[{BLANKS}]", c))
_RUNS = re.compile(f"[{BLANKS}]+")


def trim(text: str) -> str:
    return text.strip(_EACH)


def collapse(text: str) -> str:
    """Runs of white space become one space, none at the ends."""
    return trim(_RUNS.sub(" ", text))


def number(x: int | float) -> str:
    """Shortest decimal spelling of a double; exponents from 1e21 up and below 1e-6."""
    if isinstance(x, int) and abs(x) <= 2**53:
        return str(x)
    try:
        x = float(x)
    except OverflowError:
        return "null"
    if not math.isfinite(x):
        return "null"
    if x == 0:
        return "0"
    mantissa, _, exponent = f"{x!r}e".partition("e")
    mark = re.fullmatch(r"(-?)(\d+)(?:\.(\d+))?", mantissa)
    power = int(exponent.rstrip("e") or 0)
    digits = (mark[2] + (mark[3] or "")).lstrip("0")
    point = len(mark[2]) + power - (len(mark[2] + (mark[3] or "")) - len((mark[2] + (mark[3] or "")).lstrip("0")))
    digits = digits.rstrip("0") or "0"
    n = len(digits)
    if -6 < point <= 21:
        body = digits + "0" * (point - n) if point >= n else digits[:point] + "." + digits[point:] if point > 0 else "0." + "0" * -point + digits
    else:
        e = point - 1
        body = digits[0] + ("." + digits[1:] if n > 1 else "") + f"e{'+' if e > 0 else '-'}{abs(e)}"
    return mark[1] + body


def _quote(text: str) -> str:
    out = json.dumps(text, ensure_ascii=False)
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", out)


def _entries(value: dict) -> list:
    """Keys that are array indices come first, in order of size; the others as they were written."""
    index = [k for k in value if re.fullmatch(r"0|[1-9]\d{0,9}", k) and int(k) < 2**32 - 1]
    if not index:
        return list(value.items())
    return [(k, value[k]) for k in sorted(index, key=int)] + [(k, v) for k, v in value.items() if k not in set(index)]


def stringify(value, indent: int = 0, _level: int = 0) -> str:
    """JSON text of a value, compact or with ``indent`` blanks per level."""
    if value is None or value is True or value is False:
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, str):
        return _quote(value)
    if isinstance(value, (int, float)):
        return number(value)
    pad, end = ("\n" + " " * indent * (_level + 1), "\n" + " " * indent * _level) if indent else ("", "")
    if isinstance(value, dict):
        items = [f"{_quote(k)}:{' ' if indent else ''}{stringify(v, indent, _level + 1)}" for k, v in _entries(value)]
        return "{" + pad + ("," + pad).join(items) + end + "}" if items else "{}"
    items = [stringify(v, indent, _level + 1) for v in value]
    return "[" + pad + ("," + pad).join(items) + end + "]" if items else "[]"


def canonical(value) -> str:
    """Compact JSON with keys in UTF-16 order at every level."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{_quote(k)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    return stringify(value)


def shown(value) -> str:
    """A parsed JSON value as the text of a section: strings as they are, null empty, containers indented."""
    if value is None:
        return ""
    if isinstance(value, str):
        return value
    return stringify(value, 2) if isinstance(value, (dict, list)) else stringify(value)


def parse(text: str):
    """Strict JSON; raises ValueError."""

    def refuse(name: str):
        raise ValueError(f"{name} isn't JSON")

    return json.loads(text, parse_constant=refuse)
