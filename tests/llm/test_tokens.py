"""Encoding, token budget, mixing: against public libraries and brute force."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("public_tokenizers")

import numpy as np

from sedimenta.llm import bpe, budget, encode, mixing

LONG = "word " * 40_000 + "x" * 50_000
ODD = [None, "", " ", "\n \n  x", "a" * 3000, "日本語テキスト é́ 👩‍🔧 \x07\x1b", "don't  we'll\t\tgo\r\n", "<|endoftext|> text", LONG, "same", "same", "\x85\x1c \u3000 x   "]


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load(bpe.vocabulary_path()).ranks, special_tokens={})
    return lambda t: enc.encode_ordinary(t) if t else []


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(texts)], "doc_id long, text string, ids string, piece string, tokens string")


def test_ids(spark, reference):
    got = {r["doc_id"]: r["ids"] for r in encode.encode_documents(frame(spark, ODD)).collect()}
    assert [got[i] for i in range(len(ODD))] == [reference(t) for t in ODD]
    assert encode.encode_documents(frame(spark, [])).count() == 0


def test_ids_of_repeated_rows_and_null_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, len(r["ids"])) for r in encode.encode_documents(df).collect()) == [(0, 1), (1, 1), (1, 1)]


def test_decodes_to_the_text():
    model = bpe.load(bpe.vocabulary_path())
    coder = bpe.Encoder(model, entries=3)
    for t in filter(None, ODD):
        assert b"".join(model.bytes[i] for i in coder.encode([t])[0]).decode("utf-8", "surrogatepass") == t


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_same_as_library(text):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    global _hf
    try:
        hf = _hf
    except NameError:
        hf = _hf = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        hf.encode_special_tokens = True
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    assert bpe.encoder(bpe.vocabulary_path()).encode([text])[0] == hf.encode(text, add_special_tokens=False).ids


def test_verification():
    model = bpe.load(bpe.vocabulary_path())
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 50_000, 3000), rng.integers(0, 50_000, 3000)
    want = [model.merge(model.bytes[x] + model.bytes[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert model.all_compatible(a, b).tolist() == want == [model.compatible(x, y) for x, y in zip(a.tolist(), b.tolist())]
    assert any(want) and not all(want)


def test_prefix_counts():
    model, rng = bpe.load(bpe.vocabulary_path()), random.Random(2)
    pieces = sorted({"".join(rng.choice("abrtheing日é ") for _ in range(rng.randint(1, 14))).encode() for _ in range(2000)} | {b"a" * 5000})
    counter = budget.PrefixCounter(model)
    assert [counter(p) for p in pieces] == [len(model.merge(p)) for p in pieces]


def test_budget(spark, reference):
    rows = [(i, t, s, g, d) for i, (t, s, g, d) in enumerate([(ODD[4], "FAQ ", "en-US", None), (ODD[5], "faq", " EN", ""), (None, None, None, "a_b"), ("", "api_docs", "de", "A-b"), (LONG, "Api-Docs", "de_AT", "a b")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, doc_domain string")
    got = {r[:3]: r[3:] for r in map(tuple, budget.token_budget(docs).collect())}
    n = lambda *ts: sum(len(reference(t)) for t in ts)
    assert got == {("faq", "en", "unknown"): (2, len(ODD[4]) + len(ODD[5]), n(ODD[4], ODD[5])), ("unknown", "unknown", "a-b"): (1, 0, 0), ("api-docs", "de", "a-b"): (2, len(LONG), n(LONG))}
    assert budget.token_budget(docs.limit(0)).count() == 0
    per = {r["doc_id"]: r["tokens"] for r in budget.document_tokens(frame(spark, ODD)).collect()}
    assert [per[i] for i in range(len(ODD))] == [len(reference(t)) for t in ODD]


def test_join_beyond_the_broadcast_limit(spark, reference, monkeypatch):
    monkeypatch.setattr(budget, "BROADCAST_PIECES", 0)
    per = {r["doc_id"]: r["tokens"] for r in budget.document_tokens(frame(spark, ODD)).collect()}
    assert [per[i] for i in range(len(ODD))] == [len(reference(t)) for t in ODD]


def test_estimates(spark, reference):
    docs = spark.createDataFrame([(1, "some words here", "p"), (2, "more", "p"), (3, None, None)], "doc_id long, text string, source_path string")
    from datetime import datetime as d

    est = [(1, 1, 10, d(2025, 1, 1)), (2, 1, 9, d(2025, 1, 2)), (3, 1, 8, d(2025, 1, 2)), (3, 1, 8, d(2025, 1, 2)), (4, 2, -5, d(2025, 1, 1)), (5, 2, None, d(2025, 1, 1)), (6, 9, 1, None)]
    got = {r[0]: r[1:] for r in map(tuple, budget.budget_against_estimates(docs, spark.createDataFrame(est, "estimate_id long, doc_id long, tokens long, estimated_at timestamp")).collect())}
    assert got == {"p": (2, 4, 1, 8, round(8 / 3, 6)), None: (1, 0, 0, 0, None)}


def test_exponents():
    natural, target = {"a": 0.9, "b": 0.1}, {"a": 0.5, "b": 0.5}
    assert mixing.temper(natural, 0.0, target) == target and mixing.temper(natural, 1.0, target) == pytest.approx(natural)
    t = mixing.exponent_for_entropy(natural, 0.6)
    assert mixing.entropy(mixing.temper(natural, t)) == pytest.approx(0.6, abs=1e-9)
    assert mixing.exponent_for_entropy(natural, 9.0) == 0.0
    e = mixing.exponent_for_repeats(natural, {"a": 900, "b": 100}, {"a": 2, "b": 2}, 1000, target)
    assert 0 < e < 1 and mixing.temper(natural, e, target)["b"] * 1000 == pytest.approx(200)
    assert mixing.exponent_for_repeats(natural, {"a": 900, "b": 100}, {"a": 1, "b": 1}, 2000, target) is None
    assert mixing.plan_mixture({"a": 100}, {"b": (1.0, 2)}) == {} and mixing.plan_mixture({"a": 100}, {"a": (0.2, 3), "b": (0.8, 1)}) == {"a": 300}


def test_mixture(spark):
    rng = random.Random(5)
    texts = [(i, "word " * rng.randint(1, 9), s) for i, s in enumerate(["big"] * 600 + ["Small "] * 30 + ["none"] * 5 + [None] * 5)]
    texts += [texts[0], (9999, None, "big"), (9998, "", "small")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 5), ("absent", 0.1, 3)], "source string, target_share double, max_repeats int")
    mix = mixing.mix_sources(docs, targets)
    rows = mix.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) and {r["source"] for r in rows} == {"big", "small"}
    assert all(r["uses"] <= {"big": 1, "small": 5}[r["source"]] and r["uses"] > 0 and r["tokens"] > 0 for r in rows)
    shares = {r["source"]: r for r in mixing.reached_shares(mix, targets).collect()}
    assert shares["absent"]["n_tokens"] == 0 and shares["big"]["reached_share"] == pytest.approx(2 / 3, abs=0.02) and shares["small"]["most_uses"] == 5
    assert sorted(map(tuple, mixing.mix_sources(docs, targets).collect())) == sorted(map(tuple, rows)), "the same rows each time"
    small = mixing.mix_sources(docs, targets, budget=200.0)
    assert sum(r["tokens"] * r["uses"] for r in small.collect()) == pytest.approx(200, abs=12)
    assert mixing.mix_sources(docs.limit(0), targets).count() == 0


def test_registered_mixture_of_all_tokens(spark, data):
    from sedimenta.llm.catalogue import QUERIES

    exact, tempered = ({r["source"]: r for r in QUERIES[n](spark, data).collect()} for n in ("p9_exact_shares", "p9_shares"))
    total = lambda rows: sum(r["n_tokens"] for r in rows.values())
    docs, targets = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/mix_targets.parquet")
    per = {r["doc_id"]: r["tokens"] for r in budget.document_tokens(docs.dropDuplicates(["doc_id"])).collect()}
    of = {r["doc_id"]: r["source"] for r in docs.select("doc_id", budget.label("source").alias("source")).collect()}
    held = {s: sum(n for i, n in per.items() if of.get(i) == s) for s in tempered}
    assert total(tempered) == pytest.approx(sum(held.values()), rel=0.05) and total(tempered) > total(exact)
    assert all(tempered[r["source"]]["most_uses"] <= r["max_repeats"] for r in targets.collect())


def test_entropy_of_a_mixture(spark):
    tokens, targets = {"a": 900, "b": 100}, {"a": (0.5, 2), "b": (0.5, 2)}
    plan = mixing.plan_mixture(tokens, targets, wanted_entropy=0.6)
    assert mixing.entropy({s: n / sum(plan.values()) for s, n in plan.items()}) == pytest.approx(0.6) and plan["b"] == pytest.approx(200)
    assert sum(mixing.plan_mixture(tokens, targets, budget=300.0, wanted_entropy=0.6).values()) == pytest.approx(300)
    assert sum(mixing.plan_mixture(tokens, targets, epochs=1.0).values()) == pytest.approx(1000)
    # equal shares lie between target and natural, not at an end
    t = mixing.exponent_for_entropy({"a": 0.9, "b": 0.1}, 0.69, {"a": 0.1, "b": 0.9})
    assert mixing.entropy(mixing.temper({"a": 0.9, "b": 0.1}, t, {"a": 0.1, "b": 0.9})) == pytest.approx(0.69)
    docs = spark.createDataFrame([(i, "word " * 5, "a" if i % 10 else "b") for i in range(400)], "doc_id long, text string, source string")
    rows = mixing.mix_sources(docs, spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 2)], "source string, target_share double, max_repeats int"), wanted_entropy=0.6).collect()
    used = {s: sum(r["tokens"] * r["uses"] for r in rows if r["source"] == s) for s in "ab"}
    assert mixing.entropy({s: n / sum(used.values()) for s, n in used.items()}) == pytest.approx(0.6, abs=0.02)


def test_frequent_and_rare_pieces(spark, reference, monkeypatch):
    rng = random.Random(3)
    words = [f"hyperquantised{k}" for k in range(40)]
    texts = [" ".join(["everywhereword", *rng.choices(words, k=rng.randrange(30))]) for _ in range(80)] + ["", None]
    df = frame(spark, texts)
    want = {i: len(reference(t)) for i, t in enumerate(texts)}
    for pieces, frequent in ((500_000, 1e-4), (0, 1e-4), (0, 0.02), (0, 1.0)):
        monkeypatch.setattr(budget, "BROADCAST_PIECES", pieces)
        monkeypatch.setattr(budget, "FREQUENT", frequent)
        assert {r["doc_id"]: r["tokens"] for r in budget.document_tokens(df).collect()} == want
