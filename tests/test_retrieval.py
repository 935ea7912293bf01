import math

import pytest

from sedimenta.errors import IntegrityError, UserError
from sedimenta.operators import retrieval as r
from sedimenta.sources import markdown


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", "x", 0.9, 1), ("q", "a", 0.8, 2), ("q", "b", 0.7, 3), ("p", "x", 0.1, 1)], "query_id string, chunk_id string, score double, rank int")
    relevant = spark.createDataFrame([("q", "a"), ("q", "b")], "query_id string, chunk_id string")
    got = {x["query_id"]: x for x in r.query_metrics(ranked, relevant, 3).collect()}
    q = got["q"]
    assert (q["hit_rate"], q["recall"], q["mrr"]) == (1, 1, 0.5) and q["precision"] == pytest.approx(2 / 3) and q["ndcg"] == pytest.approx(0.6934264036172708)
    assert all(got["p"][m] == 0 for m in r.METRICS)
    means = r.mean_metrics(r.query_metrics(ranked, relevant, 3))
    assert means.first()["mrr"] == 0.25
    assert {x["metric"]: x["ok"] for x in r.passes(means, {"mrr": 0.25, "recall": 0.9}).collect()} == {"mrr": True, "recall": False}


def brute(queries, chunks, k):
    stop = set(r.STOP_WORDS)
    import regex

    words = lambda t: [w for w in regex.findall(r"[\p{L}\p{N}]+", (t or "").lower()) if w not in stop]
    df = {}
    for _, t in chunks:
        for w in set(words(t)):
            df[w] = df.get(w, 0) + 1

    def vec(t):
        tf = {}
        for w in words(t):
            tf[w] = tf.get(w, 0) + 1
        return {w: (1 + math.log(n)) * (math.log((len(chunks) + 1) / (df.get(w, 0) + 1)) + 1) for w, n in tf.items()}

    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = []
    for q, t in queries:
        a, scored = vec(t), []
        for c, u in chunks:
            b = vec(u)
            s = sum(x * b.get(w, 0) for w, x in a.items())
            scored.append((-(s / (norm(a) * norm(b)) if s else 0.0), c))
        out += [(q, c, i + 1) for i, (_, c) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_ranking(spark):
    chunks = [(f"c{i:02}", t) for i, t in enumerate(["red apple pie", "apple", "the pie is red", "", None, "Apple apple tree", "zebra", "red"])]
    queries = [("q1", "red apple"), ("q2", "unknown words"), ("q3", "PIE, and the zebra")]
    df = r.rank_tfidf(spark.createDataFrame(queries, "query_id string, text string"), spark.createDataFrame(chunks, "chunk_id string, text string"), 5)
    assert sorted((x["query_id"], x["chunk_id"], x["rank"]) for x in df.collect()) == brute(queries, chunks, 5)
    assert r.rank_tfidf(spark.createDataFrame(queries, "query_id string, text string"), spark.createDataFrame([], "chunk_id string, text string"), 5).count() == 0


def test_frequent_terms(spark, monkeypatch):
    from sedimenta.operators import lookups

    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4), (None, 5), ("z", 6)], "k string, v int")
    values = spark.createDataFrame([("a", 70, "A"), ("b", 20, "B"), ("c", 10, "C"), ("d", 1, "D")], "k string, n long, w string")
    want = [(1, "A"), (2, "A"), (3, "B"), (4, "C"), (5, None), (6, None)]
    for most, frequent in ((10, 0.5), (0, 0.5), (0, 0.0), (0, 1.0)):
        got = lookups.look_up(rows, values, "k", "n", most, frequent)
        assert sorted((r["v"], r["w"]) for r in got.collect()) == want
    monkeypatch.setattr(lookups, "MOST", 0)
    monkeypatch.setattr(lookups, "FREQUENT", 0.2)
    test_ranking(spark)


def test_smallest(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "a", "a", "a", "a", "a", "a", "a", "c", None, "d"]], "v string")
    assert r.smallest(df, "v", 2) == ["a", "b"] and r.smallest(df, "v", 9) == ["a", "b", "c", "d"] and r.smallest(df.limit(0), "v", 3) == []


CORPUS = {"ops.md": "# Deploys\n\nRoll out on Mondays.\n\n## Rollback\n\nUse the previous image.", "keys.md": "# Keys\n\nRotate keys every quarter."}


def test_evaluation(spark):
    rows = [(p, i, s["text"], s["header_path"]) for p, t in CORPUS.items() for i, s in enumerate(markdown.sections(t))]
    sections = spark.createDataFrame(rows, "source_path string, section_index int, text string, header_path array<string>")
    manifest = {"version": 1, "name": "small", "topK": 2, "baselineExperiment": "m", "experiments": [{"id": "m", "splitter": "markdown", "chunkSize": 80, "overlap": 0}], "thresholds": {"hitRate": 1.0, "mrr": 0.9}}
    queries = [{"id": "q", "text": "how often rotate keys", "relevant": [{"source": "keys.md", "contains": "EVERY quarter"}]}]
    got = r.evaluate(spark, manifest, sections, queries, "words")
    assert got["ok"] and got["experiments"][0]["chunks"] == 3 and "small" in r.report_html(got)
    with pytest.raises(IntegrityError):
        r.evaluate(spark, manifest, sections, [{"id": "q", "text": "x", "relevant": [{"source": "keys.md", "contains": "nowhere"}]}], "words")
    with pytest.raises(UserError):
        r.evaluate(spark, manifest | {"baselineExperiment": "z"}, sections, queries, "words")
