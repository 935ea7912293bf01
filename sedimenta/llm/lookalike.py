"""One form for text that looks the same.

Every token that isn't in table form is looked up in tries over the corpus vocabulary by a weighted
edit automaton: exchanging look-alikes and dropping ignorable characters costs nothing, anything else
costs 1.  The canonical spelling of a token is chosen among the vocabulary words found at no cost, a
plain one before others; only tokens that match no word get the form of the table.  All words that
reach each other at no cost choose alike, so equal-looking texts come out equal.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.text_batches import pieces as cut
from sedimenta.session import materialise

#: Letters of other scripts and rare Latin letters that look like a basic Latin letter.
LOOKALIKES = {
    "a": "аɑ", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "і", "j": "јϳ", "l": "ӏ", "o": "оοօ", "p": "р", "q": "ԛ", "s": "ѕ", "v": "νѵ", "w": "ԝ", "x": "х", "y": "уү",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "F": "Ϝ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "M": "МΜϺ", "N": "Ν", "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "S": "Ѕ", "T": "ТΤ", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "УҮΥ", "Z": "ΖᏃ",
}
#: Format characters that do show, and ignorable characters that aren't format characters (first and last of each range).
VISIBLE_FORMAT = "\u0600-\u0605\u06dd\u070f\u0890-\u0891\u08e2\U000110bd\U000110cd"
IGNORABLE = "\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f\u034f\u115f-\u1160\u17b4-\u17b5\u180b-\u180f\u3164\ufe00-\ufe0f\uffa0\U000e0000-\U000e0fff"
#: Code points up to here are looked through for the table; none beyond has a form of its own.
LAST = 0x30000

#: Up to so many words with a spelling of their own (some 60 bytes each) are broadcast; beyond, the join shuffles.
BROADCAST_WORDS = 300_000
#: Words that one trie holds before the next one is begun (between words that don't look the same).
TRIE_WORDS = 20_000
#: Beyond BROADCAST_WORDS, words that make up more than this part of all tokens are still broadcast (so at most its inverse of them).
FREQUENT = 1 / 10_000

BLANK = regex.compile(r"[\t-\r \x85\p{Zs}\u2028\u2029]+")
#: Texts of these characters alone are in table form as they are (a Java pattern; ASCII and Latin-1 without blanks and invisible characters).
PLAIN = "\\A[\\t\\n -~\xa1-\xac\xae-\xff]*+\\z"


@lru_cache(maxsize=1)
def table() -> dict[int, str]:
    """Code point to table form, of all code points that have another than themselves."""
    letters = {ord(c): k for k, v in LOOKALIKES.items() for c in v}
    shows, drops = regex.compile(f"[{VISIBLE_FORMAT}]"), regex.compile(f"[{IGNORABLE}]")

    def one(c: str) -> str:
        if ord(c) in letters:
            return letters[ord(c)]
        kind, plan, name = unicodedata.category(c), unicodedata.decomposition(c), unicodedata.name(c, "")
        if drops.match(c) or kind == "Cf" and not shows.match(c):
            return ""
        if kind == "Zs":
            return " "
        if c in "\u2028\u2029\x85":
            return "\n"
        if kind == "Pd" and "HYPHEN" in name and "DOUBLE" not in name:
            return "-"
        if plan.startswith(("<wide>", "<narrow>")) or plan.startswith("<compat>") and ("LIGATURE" in name or "ROMAN NUMERAL" in name):
            return "".join(map(one, unicodedata.normalize("NFKC", c)))
        return c

    out = {}
    for code in range(LAST):
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code < 0xD7A4 or 0x20000 <= code < 0x2F800 or 0x3400 <= code < 0xA000:
            continue  # surrogates, Hangul syllables and ideographs have none
        c = chr(code)
        form = unicodedata.normalize("NFC", "".join(map(one, unicodedata.normalize("NFD", c))))
        if form != c:
            out[code] = form
    return out | {c: "" for c in range(0xE0000, 0xE1000)}


def fold(text: str) -> str:
    """Table form: every character in its ordinary form, ignorable ones dropped, canonically composed."""
    if text.isascii() and text.isprintable():
        return text
    text = unicodedata.normalize("NFC", text.replace("\r\n", "\n").replace("\r", "\n"))
    return unicodedata.normalize("NFC", text.translate(table()))


class Trie:
    """Vocabulary words, matched by a weighted edit automaton over the parts of their characters' table forms."""

    def __init__(self):
        self.root: dict = {}
        self._atoms: dict[str, tuple[str, ...]] = {}

    def atoms(self, c: str) -> tuple[str, ...]:
        got = self._atoms.get(c)
        if got is None:
            got = self._atoms[c] = tuple(unicodedata.normalize("NFD", fold(c)))
        return got

    def add(self, word: str, count: int) -> None:
        node = self.root
        for c in unicodedata.normalize("NFD", word):
            node = node.setdefault(c, {})
        node.setdefault("", []).append((word, count))

    def match(self, query: str, limit: int = 0) -> list[tuple[str, int]]:
        """Words within ``limit`` of ``query``: look-alikes exchange and ignorables drop at no cost, other edits cost 1."""
        want = tuple(unicodedata.normalize("NFD", fold(query)))
        n, found, seen = len(want), {}, {}
        stack = [(self.root, 0, 0)]
        while stack:
            node, at, cost = stack.pop()
            if limit and seen.setdefault((id(node), at), cost) < cost:
                continue
            if cost < limit and at < n:
                stack.append((node, at + 1, cost + 1))
            for c, child in node.items():
                if c == "":
                    if at == n:
                        found.update(child)
                    continue
                parts = self.atoms(c)
                if want[at : at + len(parts)] == parts:
                    stack.append((child, at + len(parts), cost))
                elif cost < limit:
                    stack.append((child, at, cost + 1))
                if cost < limit and parts and at < n:
                    stack.append((child, at + 1, cost + 1))
        return list(found.items())


@lru_cache(maxsize=1)
def _letters() -> frozenset[str]:
    return frozenset(c for v in LOOKALIKES.values() for c in v)


def proper(word: str) -> bool:
    """Whether a word can be a canonical spelling: composed, without characters that have an ordinary form, but for look-alike letters of one script."""
    if any(ord(c) in table() and unicodedata.normalize("NFD", c)[0] not in _letters() for c in word):
        return False
    scripts = {unicodedata.name(c, " ").split(" ", 1)[0] for c in word if c.isalpha()}
    return unicodedata.normalize("NFC", word) == word and len(scripts) < 2


def choose(words: list[tuple[str, int]], form: str) -> str:
    """Canonical spelling: the table form if it is a word itself, else the most frequent proper word (of equal ones the smallest), else the table form."""
    if any(w == form for w, _ in words):
        return form
    words = [x for x in words if proper(x[0])]
    return min(words, key=lambda x: (-x[1], x[0]))[0] if words else form


#: Kinds of vocabulary words, in the order in which they are read: in table form; another proper spelling; no spelling to choose.
PLAIN_WORD, PROPER_WORD, OTHER_WORD = 0, 1, 2


def _vocabulary(docs: DataFrame) -> DataFrame:
    """``word, form, kind, times`` of the distinct tokens, those of one form in one partition."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            words = list(held)
            forms = [fold(w) for w in words]
            kinds = [PLAIN_WORD if w == f else PROPER_WORD if proper(w) else OTHER_WORD for w, f in zip(words, forms)]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(forms, pa.string()), pa.array(kinds, pa.int8()), pa.array(list(held.values()), pa.int64())], ["word", "form", "kind", "times"])
            held.clear()
            return out

        for part in cut(batches, 0):
            for text in part.column(0).to_pylist():
                if text:
                    held.update(BLANK.split(text) if not text.isascii() else text.split())
            if len(held) > 300_000:
                yield flush()
        yield flush()

    counted = docs.select("text").mapInArrow(count, "word string, form string, kind byte, times long").filter(F.col("word") != "")
    # each task has summed up its own words; words of one form meet in one partition, for the sum and for the search
    return counted.repartition("form").groupBy("word", "form", "kind").agg(F.sum("times").alias("times"))


def search(rows: Iterator[tuple[str, str, int, int]]) -> Iterator[tuple[str, str, int]]:
    """``word, spelling, times`` of the words that aren't in table form, of vocabulary rows sorted by form and kind.

    Words that can be chosen come before the others of their form, so that the others are answered one by
    one and never held.  A trie is given up once it holds TRIE_WORDS and the form changes: memory is
    bounded by that and the proper spellings of one form.
    """
    trie, held, last, waiting = Trie(), 0, None, []

    def answers() -> Iterator[tuple[str, str, int]]:
        for word, times in waiting:
            if found := trie.match(word):
                yield word, choose(found, last), times
        waiting.clear()

    for word, form, kind, times in rows:
        if form != last:
            yield from answers()
            if held >= TRIE_WORDS:
                trie, held = Trie(), 0
            last = form
        if kind == OTHER_WORD:
            waiting.append((word, times))
            yield from answers()
            continue
        trie.add(word, times)
        held += 1
        if kind == PROPER_WORD:
            waiting.append((word, times))
    yield from answers()


def spellings(docs: DataFrame) -> DataFrame:
    """``word, spelling, times`` of every token that isn't in table form and looks like a word of the vocabulary.

    Words that look the same share their table form, so hashing by it puts them into one partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in range(4))))
        found = search(rows)
        while some := list(islice(found, 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.string()), pa.array([x[1] for x in some], pa.string()), pa.array([x[2] for x in some], pa.int64())], ["word", "spelling", "times"])

    return _vocabulary(docs).sortWithinPartitions("form", "kind", "word").mapInArrow(run, "word string, spelling string, times long")


def _spelt(tokens: DataFrame, choice: DataFrame) -> DataFrame:
    """``doc_id, word, spelling`` of the tokens (doc_id, word) that have a spelling."""
    facts = choice.agg(F.count(F.lit(1)).alias("n"), F.sum("times").alias("all")).head()
    pairs = choice.select("word", "spelling")
    if facts["n"] <= BROADCAST_WORDS:
        return tokens.join(F.broadcast(pairs), "word")
    # a word of a third of all documents would make one huge group: frequent words are few, and looked up where the tokens lie
    often = choice.filter(F.col("times") > FREQUENT * facts["all"]).select("word", "spelling")
    marked = materialise(tokens.join(F.broadcast(often), "word", "left"), "tokens")
    rest = marked.filter(F.col("spelling").isNull()).drop("spelling").join(pairs, "word")
    return marked.filter(F.col("spelling").isNotNull()).unionByName(rest)


def canonical_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text, canonical`` of each row with a non-null text.

    Blanks become spaces, line ends line feeds, tokens their canonical spelling.  Empty texts stay
    empty.  One row per input row; repeated rows of one doc_id must hold one text.
    """
    chosen = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    plain = chosen.filter(F.col("text").rlike(PLAIN))
    odd = chosen.filter(~F.col("text").rlike(PLAIN))
    choice = materialise(spellings(chosen), "spellings")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in cut(batches):
            ids, words = [], []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                new = [w for w in set(BLANK.split(text)) if w and not (w.isascii() and w.isprintable())]
                ids += [doc] * len(new)
                words += new
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.string())], ["doc_id", "word"])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in cut(batches):
            out = []
            for text, own in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                if own:
                    known = {x["word"]: x["spelling"] for x in own}
                    text = "".join(known.get(w) or fold(w) for w in regex.split(f"({BLANK.pattern})", text.replace("\r\n", "\n")))
                out.append(fold(text) if not own else unicodedata.normalize("NFC", text))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string())], ["doc_id", "text", "canonical"])

    needed = _spelt(odd.mapInArrow(tokens, "doc_id long, word string"), choice).groupBy("doc_id").agg(F.collect_list(F.struct("word", "spelling")).alias("own"))
    rewritten = odd.join(needed, "doc_id", "left").select("doc_id", "text", "own").mapInArrow(rewrite, "doc_id long, text string, canonical string")
    return plain.withColumn("canonical", F.col("text")).unionByName(rewritten)


def _looks(docs: DataFrame) -> DataFrame:
    """``doc_id, look, exact``: digests of the canonical form and of the text, of documents with a visible character."""
    seen = (
        canonical_texts(docs)
        .filter(F.col("canonical").rlike(r"[^\s\p{Z}\p{Cc}\p{Cf}]"))
        .select("doc_id", F.unhex(F.md5("canonical")).alias("look"), F.unhex(F.md5("text")).alias("exact"))
    )
    return materialise(seen, "looks")


def lookalike_classes(docs: DataFrame) -> DataFrame:
    """``doc_id, look_id, exact_id, n_texts``: one row per document that looks like another with a different text.

    look_id is the smallest doc_id of those that look the same, exact_id that of those with the same text,
    n_texts the number of different texts of the look.  The same links as the pairs, without writing
    out every pair of copies.
    """
    seen = _looks(docs)
    # texts are counted in two steps, so that copies are summed up before they meet
    texts = seen.groupBy("look", "exact").agg(F.min("doc_id").alias("exact_id"))
    looks = texts.groupBy("look").agg(F.count(F.lit(1)).alias("n_texts"), F.min("exact_id").alias("look_id")).filter(F.col("n_texts") > 1)
    return seen.join(looks, "look").join(texts, ["look", "exact"]).select("doc_id", "look_id", "exact_id", "n_texts")


def lookalike_pairs(docs: DataFrame, salts: int = 16) -> DataFrame:
    """``doc_id_a, doc_id_b`` of documents that look the same and differ in a code point.

    Null texts and texts without a visible character have no partner; exact copies aren't a pair.  Pairs
    are formed between classes of exact copies and then expanded; classes and their members are salted,
    as one look or one text may have many.
    """
    seen = _looks(docs)
    several = seen.groupBy("look").agg(F.min("exact").alias("x"), F.max("exact").alias("y")).filter(F.col("x") != F.col("y")).select("look")
    members = seen.join(several, "look", "left_semi")
    classes = members.select("look", "exact").distinct()
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(salts)).cast("int")
    every = F.explode(F.array(*[F.lit(k) for k in range(salts)]))
    others = classes.withColumnRenamed("exact", "other").withColumn("salt", every)
    pairs = classes.withColumn("salt", salt("exact")).join(others, ["look", "salt"]).filter(F.col("exact") < F.col("other")).drop("salt")
    first = members.withColumn("salt", salt("doc_id")).join(pairs.withColumn("salt", every), ["look", "exact", "salt"]).select("look", F.col("other").alias("exact"), F.col("doc_id").alias("a"))
    first = first.withColumn("salt", salt("a"))
    both = first.join(members.select("look", "exact", F.col("doc_id").alias("b")).withColumn("salt", every), ["look", "exact", "salt"])
    return both.select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b")).distinct()
