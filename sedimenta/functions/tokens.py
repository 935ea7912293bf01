"""Token counters, by name.

``byte_bpe_50k`` and ``byte_bpe_multi_50k`` read public vocabulary files; ``cl100k_base`` is taken where
the library has it at hand; ``chars`` counts code points and ``words`` blank-separated words.  A counter
named ``file:PATH`` reads a vocabulary of ranks from PATH.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

from sedimenta.errors import UserError

Counter = Callable[[str], int]
#: Texts up to so many characters are remembered, so many at most.
REMEMBERED_LENGTH, REMEMBERED = 4096, 4096


def _bpe(path: str) -> Counter:
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    encode = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: len(encode(text)) if text else 0


def _make(name: str) -> Counter:
    if name == "chars":
        return len
    if name == "words":
        return lambda text: len(text.split())
    if name == "cl100k_base":
        import tiktoken

        encode = tiktoken.get_encoding(name).encode_ordinary
        return lambda text: len(encode(text)) if text else 0
    if name.startswith("file:"):
        return _bpe(name[5:])
    if name in ("byte_bpe_50k", "byte_bpe_multi_50k"):
        import public_tokenizers

        return _bpe(public_tokenizers.path(f"{name}.tiktoken"))
    raise UserError(f"no token counter named {name}")


@lru_cache(maxsize=4)
def counter(name: str = "byte_bpe_50k") -> Counter:
    """The counter of that name, one per worker process; text that spells a special token is ordinary text."""
    count = _make(name)
    if name in ("chars", "words"):
        return count
    known: dict[str, int] = {}

    def remembering(text: str) -> int:
        if len(text) > REMEMBERED_LENGTH:
            return count(text)
        n = known.get(text)
        if n is None:
            if len(known) >= REMEMBERED:
                known.clear()
            n = known[text] = count(text)
        return n

    return remembering
