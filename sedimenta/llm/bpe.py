"""Byte-level BPE by a vocabulary of ranks: compatibility of neighbouring tokens, exact merging, encoding.

A sequence of tokens is what BPE makes of its bytes exactly if each two neighbours are what BPE makes
of their own bytes.  Hence a sequence got in any way can be verified pair by pair: undo the merges of
the two tokens in order of rank and look whether one across the border would have come first.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import chain

import numpy as np
import regex

#: Fixed value: the pre-splitting pattern of the byte_bpe vocabularies.  White space is spelt out, as libraries differ in it.
_WS = "\\t-\\r \\x85\\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
PIECES = regex.compile(PATTERN)
#: A space that is neither at the border of a run of white space nor alone: splitting at every space would be wrong there.
_AWKWARD = regex.compile(rf"[{_WS}] (?:[{_WS}]|\Z)")
_BEFORE_WORD = regex.compile(rf"(?<=[^{_WS}])(?= [^{_WS}])")

#: Entries beyond which a cache of words is emptied (bounds a worker's memory, changes no result).
CACHE_ENTRIES = 400_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where a public vocabulary lies; on a machine without the package pass a path instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Bpe:
    """``ranks``: bytes to token id, ids in order of merging, the 256 single bytes included."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.bytes = [b""] * size
        for b, i in ranks.items():
            self.bytes[i] = b
        self.longest = max(map(len, ranks))
        self.left, self.right = np.arange(size, dtype=np.int64), np.arange(size, dtype=np.int64)
        self._l, self._r = list(range(size)), list(range(size))
        self.pair: dict[int, int] = {}
        self._undo()
        keys = np.fromiter(self.pair.keys(), np.int64, len(self.pair))
        order = np.argsort(keys)
        self._keys, self._merged = keys[order], np.fromiter(self.pair.values(), np.int64, len(self.pair))[order]

    @classmethod
    def load(cls, path: str) -> "Bpe":
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def _undo(self) -> None:
        """For each token the two it was merged from: the only split whose halves are compatible."""
        ranks = self.ranks
        for i, b in enumerate(self.bytes):
            if len(b) < 2:
                continue
            found = [(x, y) for k in range(1, len(b)) if (x := ranks.get(b[:k], i)) < i and (y := ranks.get(b[k:], i)) < i]
            for x, y in found:
                if len(found) == 1 or self.compatible(x, y):
                    self._l[i], self._r[i] = x, y
                    self.pair[x << 32 | y] = i
                    break
        self.left, self.right = np.array(self._l, np.int64), np.array(self._r, np.int64)

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves ``a`` and ``b`` as they are when they stand side by side."""
        pair, left, right, limit = self.pair, self._l, self._r, 1 << 31
        while True:
            if pair.get(a << 32 | b, limit) < limit:
                return False
            if a > b:
                limit, c = a, right[a]
                if c != a:
                    a = c
                    continue
                limit, c = b + 1, left[b]
                if c == b:
                    return True
                b = c
            else:
                limit, c = b + 1, left[b]
                if c != b:
                    b = c
                    continue
                limit, c = a, right[a]
                if c == a:
                    return True
                a = c

    def all_compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``compatible`` of many pairs at once."""
        n = len(a)
        good, a, b = np.ones(n, bool), a.astype(np.int64), b.astype(np.int64)
        live, limit = np.arange(n), np.full(n, 1 << 31, np.int64)
        keys, merged, left, right = self._keys, self._merged, self.left, self.right
        while len(live):
            x, y = a[live], b[live]
            k = x << 32 | y
            at = np.searchsorted(keys, k)
            at[at == len(keys)] = 0
            bad = (keys[at] == k) & (merged[at] < limit[live])
            good[live[bad]] = False
            lx, ly = right[x], left[y]
            # the later merge is undone first; a single byte can't be undone, then the other side's turn comes
            first = np.where(x > y, lx != x, ly == y)
            first &= lx != x
            second = ~first & (ly != y)
            limit[live] = np.where(first, x, y + 1)
            a[live] = np.where(first, lx, x)
            b[live] = np.where(second, ly, y)
            live = live[~bad & (first | second)]
        return good

    def merge(self, piece: bytes) -> list[int]:
        """Plain BPE: merge the neighbours of lowest rank until none is left."""
        import heapq

        n, ranks = len(piece), self.ranks
        if piece in ranks:
            return [ranks[piece]]
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= stop or end[end[i]] != stop:
                continue
            j = end[i]
            alive[j], end[i] = False, stop
            if stop < n:
                before[stop] = i
                if (q := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (q, i, end[stop]))
            if (h := before[i]) >= 0 and (q := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (q, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def greedy(self, piece: bytes) -> list[int]:
        """Speculation: from the left always the longest token."""
        out, at, n, ranks, longest = [], 0, len(piece), self.ranks, self.longest
        while at < n:
            for stop in range(min(n, at + longest), at, -1):
                if (t := ranks.get(piece[at:stop])) is not None:
                    out.append(t)
                    at = stop
                    break
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Token ids of many pieces: greedy proposals, all neighbours verified at once, the failing pieces merged."""
        ranks = self.ranks
        out: list = [(ranks[p],) if p in ranks else None for p in pieces]
        todo = [i for i, x in enumerate(out) if x is None]
        if not todo:
            return out
        proposed = [self.greedy(pieces[i]) for i in todo]
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(todo)), sizes)
        inner = owner[1:] == owner[:-1]
        good = self.all_compatible(flat[:-1][inner], flat[1:][inner])
        failed = set(owner[1:][inner][~good].tolist())
        for k, i in enumerate(todo):
            out[i] = tuple(self.merge(pieces[i])) if k in failed else tuple(proposed[k])
        return out


def words_of(text: str) -> list[str]:
    """The text cut into stretches that no piece crosses: before spaces that open a word."""
    if _AWKWARD.search(text):
        return _BEFORE_WORD.split(text)
    first, *rest = text.split(" ")
    words = [" " + w for w in rest]
    if first:
        words.insert(0, first)
    return words


class Encoder:
    """Encodes texts, remembering the words it met."""

    def __init__(self, bpe: Bpe, entries: int = CACHE_ENTRIES):
        self.bpe, self.entries = bpe, entries
        self.words: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}

    def learn(self, words: set[str]) -> None:
        """Encode the words not met before."""
        if len(self.words) > self.entries:
            self.words.clear()
        if len(self.pieces) > self.entries:
            self.pieces.clear()
        new = list(words.difference(self.words))
        parts = [PIECES.findall(w) for w in new]
        fresh = list(set().union(*parts).difference(self.pieces))
        pieces = self.pieces
        pieces.update(zip(fresh, self.bpe.encode_pieces([p.encode("utf-8", "surrogatepass") for p in fresh])))
        for w, p in zip(new, parts):
            self.words[w] = pieces[p[0]] if len(p) == 1 else tuple([t for x in p for t in pieces[x]])

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's ids begin (one more entry than texts)."""
        split = [words_of(t) if t else [] for t in texts]
        self.learn(set().union(*split))
        known, flat, at = self.words, [], [0]
        for words in split:
            flat.extend(chain.from_iterable(map(known.__getitem__, words)))
            at.append(len(flat))
        return np.array(flat, np.int32), np.array(at, np.int32)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; of a null or empty text none."""
        flat, at = self.encode_flat(texts)
        ids = flat.tolist()
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """One vocabulary per worker process."""
    return Bpe.load(path)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(load(path))
