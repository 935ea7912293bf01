"""Offline evaluation of retrieval: TF-IDF ranking of chunks, relevance labels, ranking metrics."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.errors import IntegrityError, UserError
from sedimenta.functions.jstext import canonical
from sedimenta.operators.chunking import chunk_sections
from sedimenta.operators.lookups import MOST, look_up
from sedimenta.plans.embed_plan import EmbedPlan
from sedimenta.session import materialise

#: Words that say nothing about a text.
STOP_WORDS = "a an and are as at be by do for from how in is it of on or the to what when which with".split()
METRICS = ("hit_rate", "recall", "precision", "mrr", "ndcg")


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, stop words left out."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*STOP_WORDS))


def term_frequency(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, term, tf``; null and empty texts have no terms."""
    return docs.select(F.col(key), F.explode(terms(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(tf: DataFrame) -> DataFrame:
    """``term, df``: in how many documents a term occurs (``tf`` has one row per document and term)."""
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def weighted(tf: DataFrame, df: DataFrame, n: Column) -> DataFrame:
    """Adds ``w``: (1 + ln tf) times (ln((n + 1) / (df + 1)) + 1); terms the corpus lacks have df 0.  Frequent terms make no hot groups."""
    idf = F.log((n + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    return look_up(tf, df, "term", "df").withColumn("w", (1 + F.log("tf")) * idf)


def norms(weights: DataFrame, key: str) -> DataFrame:
    return weights.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def text_norms(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, norm`` of the weights of every text; terms are taken out of the texts once."""
    tf = materialise(term_frequency(docs, key, text), "terms")
    return norms(weighted(tf, materialise(document_frequency(tf), "frequencies"), F.lit(docs.count())), key)


def smallest(rows: DataFrame, column: str, k: int) -> list:
    """The ``k`` smallest distinct values of a column; only values near the smallest come to the driver, nothing is shuffled."""
    out: list = []
    while len(out) < k:
        more = rows.select(column).filter(F.col(column).isNotNull() if not out else F.col(column) > out[-1]).orderBy(column).limit(4 * k).collect()
        out += sorted({r[0] for r in more})
        if len(more) < 4 * k:
            break
    return out[:k]


def rank_tfidf(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """``query_id, chunk_id, score, rank``: the ``k`` chunks of the highest cosine per query, of equal ones the smallest id.

    ``queries``: query_id, text; ``chunks``: chunk_id, text.  Chunks that share no term score 0 and fill
    up the ranks in order of id.  Scores come from the terms of the queries alone, not from all pairs;
    queries with many matches are cut to the best ``k`` per part before the final ranking.
    """
    # frequencies, weights and norms all read the terms: taken out of the texts once
    tf = materialise(term_frequency(chunks, "chunk_id"), "terms")
    df = materialise(document_frequency(tf), "frequencies")
    n = F.lit(chunks.count())
    asked = materialise(term_frequency(queries, "query_id"), "asked")
    few = asked.count() <= MOST
    query_w = weighted(asked, df, n).select("query_id", "term", F.col("w").alias("qw"))
    query_norm = query_w.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    # only rows with a term of a query count for the products
    wanted = asked.select("term").distinct()
    hits = weighted(tf.join(F.broadcast(wanted) if few else wanted, "term", "left_semi"), df, n).select("chunk_id", "term", F.col("w").alias("cw"))
    dot = hits.join(F.broadcast(query_w) if few else query_w, "term").groupBy("query_id", "chunk_id").agg(F.sum(F.col("qw") * F.col("cw")).alias("dot"))
    chunk_norm = norms(weighted(tf, df, n), "chunk_id").withColumnRenamed("norm", "cn")
    scored = dot.join(chunk_norm, "chunk_id").join(query_norm, "query_id").select("query_id", "chunk_id", (F.col("dot") / (F.col("cn") * F.col("qn"))).alias("score"))
    # k chunks of the smallest ids fill the ranks behind those that match; 2k of them suffice, as k at most are taken
    fill = [F.lit(c) for c in smallest(chunks, "chunk_id", 2 * k)]
    spare = F.explode(F.array(*fill)) if fill else F.explode(F.lit(None).cast("array<string>"))
    zero = queries.select("query_id", spare.alias("chunk_id")).join(scored.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").withColumn("score", F.lit(0.0))
    pool = scored.unionByName(zero).withColumn("order", F.round("score", 12))
    part = Window.partitionBy("query_id", F.pmod(F.xxhash64("chunk_id"), F.lit(64))).orderBy(F.desc("order"), "chunk_id")
    best = pool.withColumn("p", F.row_number().over(part)).filter(F.col("p") <= k)
    whole = Window.partitionBy("query_id").orderBy(F.desc("order"), "chunk_id")
    return best.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k).select("query_id", "chunk_id", "score", "rank")


def relevant_chunks(chunks: DataFrame, labels: DataFrame) -> DataFrame:
    """``query_id, chunk_id`` of the chunks (chunk_id, source, text) that hold a label's text in the label's source, whatever the case.

    ``labels``: query_id, source, contains.  Equal sources are joined, the text is tested in the join.
    """
    hit = F.contains(F.lower("text"), F.lower("contains"))
    # few labels go to the chunks, however many chunks a source has
    labels = F.broadcast(labels) if labels.count() <= MOST else labels
    return chunks.select("chunk_id", "source", "text").join(labels, "source").filter(hit).select("query_id", "chunk_id").distinct()


def query_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """``query_id, hit_rate, recall, precision, mrr, ndcg`` of the first ``k`` ranks of every query that has ranks.

    Precision divides by ``k``; without relevant chunks all are 0.
    """
    marked = ranked.filter(F.col("rank") <= k).join(relevant.select("query_id", "chunk_id").withColumn("rel", F.lit(1)), ["query_id", "chunk_id"], "left")
    hit = F.col("rel").isNotNull()
    found = marked.groupBy("query_id").agg(
        F.max(hit.cast("int")).alias("hit"), F.sum(hit.cast("int")).alias("hits"), F.min(F.when(hit, F.col("rank"))).alias("first"), F.sum(F.when(hit, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    wanted = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    some = F.coalesce("n_rel", F.lit(0)) > 0
    return found.join(wanted, "query_id", "left").select(
        "query_id", F.col("hit").cast("double").alias("hit_rate"), F.when(some, F.col("hits") / F.col("n_rel")).otherwise(0.0).alias("recall"), (F.col("hits") / F.lit(float(k))).alias("precision"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), F.when(some, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"),
    )


def mean_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.agg(*[F.avg(m).alias(m) for m in METRICS])


def passes(means: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """``metric, value, minimum, ok`` per threshold."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), F.lit(float(t)).alias("minimum")) for m, t in sorted(thresholds.items())])
    return means.select(F.explode(rows).alias("r")).select("r.*").withColumn("ok", F.coalesce(F.col("value") >= F.col("minimum"), F.lit(False)))


def evaluate(spark: SparkSession, manifest: dict, sections: DataFrame, queries: list[dict], tokens: str = "byte_bpe_50k") -> dict:
    """Run every experiment (id, splitter, chunkSize, overlap) of a manifest over the corpus' sections.

    ``queries``: id, text, relevant (source, contains).  A query for which no chunk is relevant is an
    error.  The gate holds for the baseline experiment.
    """
    if manifest.get("version") != 1 or not manifest.get("experiments"):
        raise UserError("the manifest needs version 1 and experiments")
    if manifest["baselineExperiment"] not in [e["id"] for e in manifest["experiments"]]:
        raise UserError("the baseline isn't among the experiments")
    asked = spark.createDataFrame([(q["id"], q["text"]) for q in queries], "query_id string, text string")
    labels = spark.createDataFrame([(q["id"], x["source"], x["contains"]) for q in queries for x in q["relevant"]], "query_id string, source string, contains string")
    k, results = manifest["topK"], []
    for e in manifest["experiments"]:
        plan = EmbedPlan(e["splitter"], e["chunkSize"], e["overlap"], "evaluation", "tfidf")
        chunks = chunk_sections(sections, plan, tokens).withColumn("source", F.col("source_path"))
        relevant = relevant_chunks(chunks, labels)
        lacking = asked.join(relevant, "query_id", "left_anti").head()
        if lacking:
            raise IntegrityError(f"no chunk is relevant for query {lacking['query_id']} in experiment {e['id']}")
        means = mean_metrics(query_metrics(rank_tfidf(asked, chunks, k), relevant, k)).head().asDict()
        results.append({"id": e["id"], "chunks": chunks.count(), "metrics": means})
    base = next(r for r in results if r["id"] == manifest["baselineExperiment"])
    failures = [m for m, least in manifest.get("thresholds", {}).items() if base["metrics"][{"hitRate": "hit_rate"}.get(m, m)] < least]
    return {"name": manifest.get("name"), "manifestSha256": hashlib.sha256(canonical(manifest).encode()).hexdigest(), "topK": k, "experiments": results, "failures": failures, "ok": not failures}


def report_html(result: dict) -> str:
    """A self-contained page of an evaluation's result."""
    import html

    rows = "".join(f"<tr><td>{html.escape(str(e['id']))}</td><td>{e['chunks']}</td>" + "".join(f"<td>{e['metrics'][m]:.4f}</td>" for m in METRICS) + "</tr>" for e in result["experiments"])
    head = "".join(f"<th>{m}</th>" for m in ("experiment", "chunks", *METRICS))
    state = "passed" if result["ok"] else "failed: " + ", ".join(result["failures"])
    return f'<!doctype html><html lang="en"><meta charset="utf-8"><title>{html.escape(str(result["name"]))}</title><h1>{html.escape(str(result["name"]))}</h1><p>Gate {html.escape(state)}</p><table><tr>{head}</tr>{rows}</table><pre>{html.escape(json.dumps(result, indent=2))}</pre></html>'


def evaluate_files(spark: SparkSession, manifest: str, queries: str, paths: list[str], root: str, parse_files, read_files, tokens: str = "byte_bpe_50k") -> dict:
    """``evaluate`` over a manifest, a query set and a corpus that lie in files; sources are named by their path below ``root``."""
    read = []
    for path in (manifest, queries):
        try:
            with open(path, encoding="utf-8") as f:
                read.append(json.load(f))
        except (OSError, ValueError) as e:
            raise UserError(f"can't read {path}: {e}") from None
    wanted = read[1].get("queries") if isinstance(read[1], dict) else None
    if not isinstance(read[0], dict) or read[1].get("version") != 1 or not wanted:
        raise UserError(f"{queries} needs version 1 and queries")
    base = os.path.abspath(root).rstrip(os.sep) + os.sep
    sections = parse_files(read_files(spark, paths))
    named = sections.withColumn("source_path", F.when(F.col("source_path").startswith(base), F.substring("source_path", len(base) + 1, 1 << 20)).otherwise(F.col("source_path")))
    return evaluate(spark, read[0], named, wanted, tokens)


def write_result(result: dict, out: str) -> None:
    """``out.json`` and ``out.html``, each written beside its place and moved there."""
    os.makedirs(os.path.dirname(os.path.abspath(out)), exist_ok=True)
    for path, text in ((f"{out}.json", json.dumps(result, indent=2) + "\n"), (f"{out}.html", report_html(result))):
        with open(path + ".tmp", "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(path + ".tmp", path)
