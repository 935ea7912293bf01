"""The registered queries of the core and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.functions import jstext
from sedimenta.operators import chunking, collection, embedding, export, incremental, ledger, malformed, retrieval, snapshots
from sedimenta.plans import embed_plan
from sedimenta.plans.embed_plan import EmbedPlan
from sedimenta.sources import files
from sedimenta.sources.tables import spread_table, table

Query = Callable[[SparkSession, str], DataFrame]


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return incremental.outstanding_chunks(table(spark, folder, "job_specs"), table(spark, folder, "job_runs"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, folder, "chunk_snapshots"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return malformed.failed_records(table(spark, folder, "sample_rows"))


def p7_valid(spark: SparkSession, folder: str) -> DataFrame:
    return malformed.valid_records(table(spark, folder, "sample_rows"))


# -- inputs shared by several queries --------------------------------------------------------------

#: Questions over the documents, and what marks a document as relevant: its source and a word it holds.
QUESTIONS = [
    ("q1", "which lockfile is stale after the restart"), ("q2", "how large may a token budget be"), ("q3", "truncated price table and retry window"), ("q4", "owner of the metadata key"),
    ("q5", "cache was warm on the host"), ("q6", "wird die Überlappung doppelt gezählt"), ("q7", "seuil dépassé par le modèle"), ("q8", "query set with nothing in common zzzz"),
]
LABELS = [
    ("q1", "handbook", "Lockfile"), ("q1", "runbook", "lockfile"), ("q2", "faq", "token budget"), ("q3", "support", "PRICE TABLE"), ("q3", "runbook", "retry window"), ("q4", "api-docs", "metadata key"),
    ("q5", "incident", "cache"), ("q6", "handbook", "Überlappung"), ("q7", "changelog", "seuil"), ("q8", "glossary", "query set"),
]
TOP = 10


def _values(rows: list[tuple], names: str) -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + f") AS {names}"


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def _sections(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a source of one section."""
    docs = spread_table(spark, folder, "documents", "doc_id", "text")
    return docs.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("source_path"), F.lit(0).alias("section_index"), "text")


def _questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "query_id string, text string")


def _labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LABELS, "query_id string, source string, contains string")


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as units of retrieval."""
    docs = spread_table(spark, folder, "documents", "doc_id", "source", "text")
    return docs.select(F.concat(F.lit("doc/"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("chunk_id"), "source", "text")


def _last_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk list of the newest snapshot, each key once (latest row)."""
    rows = table(spark, folder, "chunk_snapshots")
    last = rows.agg(F.max("snapshot_no")).head()[0]
    return rows.filter(F.col("snapshot_no") == last).groupBy("source_path", "chunk_index").agg(F.max(F.struct("loaded_at", "chunk_id")).alias("r")).select("source_path", "chunk_index", "r.chunk_id")


def _snapshot_steps(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Every snapshot but the first, and under its number the one before it, each key once (latest row)."""
    rows = table(spark, folder, "chunk_snapshots").filter(F.col("snapshot_no").isNotNull())
    latest = rows.groupBy("snapshot_no", "source_path", "chunk_index").agg(F.max(F.struct("loaded_at", "chunk_id")).alias("r")).select("snapshot_no", "source_path", "chunk_index", "r.chunk_id")
    # one row per snapshot
    steps = rows.select("snapshot_no").distinct().withColumn("before", F.lag("snapshot_no").over(Window.orderBy("snapshot_no"))).filter(F.col("before").isNotNull())
    new = latest.join(F.broadcast(steps.select("snapshot_no")), "snapshot_no")
    old = latest.withColumnRenamed("snapshot_no", "before").join(F.broadcast(steps), "before").drop("before")
    return old, new


# -- chunks and ids --------------------------------------------------------------------------------


def chunk_ids(spark: SparkSession, folder: str) -> DataFrame:
    s = _sections(spark, folder)
    return s.select("source_path", chunking.chunk_id(F.col("source_path"), F.col("section_index"), F.coalesce("text", F.lit(""))).alias("chunk_id"))


def source_hashes(spark: SparkSession, folder: str) -> DataFrame:
    return files.text_hashes(_documents(spark, folder), "doc_id")


def line_sections(spark: SparkSession, folder: str) -> DataFrame:
    return files.text_lines(_documents(spark, folder), "doc_id")


def chunk_numbering(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    # ids of documents are longs, and so are their sections here
    rows = docs.select("source_path", F.col("doc_id").alias("section_index"), F.posexplode(F.split("text", "\n")).alias("chunk_in_section", "text"))
    return chunking.number_chunks(rows.drop("text")).select("source_path", "section_index", "chunk_in_section", "chunk_index")


def embed_batches(spark: SparkSession, folder: str) -> DataFrame:
    return embedding.batch_numbers(chunk_numbering(spark, folder), 64).groupBy("source_path", "batch_no").agg(F.count(F.lit(1)).alias("n_chunks"))


def recursive_chunks(spark: SparkSession, folder: str) -> DataFrame:
    plan = EmbedPlan("recursive", 800, 100, "documents", "text-embedding-3-small")
    return chunking.chunk_sections(_sections(spark, folder), plan).select("chunk_id", "source_path", "chunk_index", "n_tokens")


def code_chunks(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "sections").filter(F.col("source_path").rlike(r"\.(ts|py)$"))
    ext = F.regexp_extract("source_path", r"\.([a-z]+)$", 1)
    plan = EmbedPlan("code", 200, 20, "code", "text-embedding-3-small")
    named = rows.select("source_path", "section_index", "text", F.when(ext == "py", "python").otherwise("typescript").alias("language"))
    return chunking.chunk_sections(named, plan).select("chunk_id", "source_path", "chunk_index", "n_tokens")


def markdown_chunks(spark: SparkSession, folder: str) -> DataFrame:
    plan = EmbedPlan("markdown", 200, 40, "sections", "text-embedding-3-small")
    rows = table(spark, folder, "sections").dropDuplicates(["section_id"]).select("source_path", "section_index", "text", "header_path", "header_depth")
    return chunking.chunk_sections(rows, plan).select("chunk_id", "source_path", "section_index", "chunk_index", "n_tokens")


#: Texts whose chunks are written out in the SQL: name, splitter, size in characters, overlap, text.
EXAMPLES = [
    ("short", "recursive", 20, 0, "  hello world \n"),
    ("paragraphs", "recursive", 8, 0, "one.\n\ntwo.\n\nthree."),
    ("sentences", "recursive", 12, 6, "alpha. beta. gamma. delta."),
    ("word", "recursive", 4, 0, "abcdefghij"),
    ("packed", "recursive", 9, 0, "a b c d e f g h"),
    ("code", "code", 24, 0, "import x\n\ndef f():\n    return 1\n\ndef g():\n    return 2\n"),
    ("records", "csv", 5, 0, "id: 1\nname: long enough"),
    ("markdown", "markdown", 40, 12, "# T\n\nfirst words\n\n```py\nx = 1\n```\n\nlast words"),
    ("table", "markdown", 45, 0, "| a | b |\n| --- | --- |\n| 1 | 2 |\n| 333333 | 444444 |"),
    ("blank", "recursive", 10, 0, " \n\t"),
]


def split_examples(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of written-out texts, by the counter of characters."""
    out = None
    for name, splitter, size, overlap, text in EXAMPLES:
        rows = spark.createDataFrame([(name, 0, text, "python")], "source_path string, section_index int, text string, language string")
        part = chunking.chunk_sections(rows, EmbedPlan(splitter, size, overlap, "examples", "m"), "chars").select("source_path", "chunk_index", "text")
        out = part if out is None else out.unionByName(part)
    return out


#: Files whose sections are written out in the SQL.
PAGES = [
    ("a.md", "intro\n\n---\ntitle: x\ntags:\n  - a\n---\n\n# A *b*\n\n## Empty\n\n### Deep\ntext\n\n```\n# no heading\n```\n\nSetext\n======\nend"),
    ("b.md", "no heading at all"),
    ("c.md", "# Only\n"),
    ("d.html", "<!doctype html><html><body><nav><a href=/>Home of the site and more</a></nav><main><article><h1>Title</h1><p>First <b>bold</b> words and a <a href=\"/x\">link</a> to follow.</p><ul><li>one<li>two</ul></article></main><footer>Imprint</footer></body></html>"),
    ("e.csv", "h1,h2\nv,\"w, \"\"x\"\"\"\n\ny\n"),
    ("f.jsonl", '{"a": 1}\n\n"x"\n'),
    ("g.json", '{"k": [1, null], "s": "t"}'),
]


def section_examples(spark: SparkSession, folder: str) -> DataFrame:
    """The sections of written-out files of several kinds."""
    rows = spark.createDataFrame(PAGES, "source_path string, text string")
    return files.parse_texts(rows).select("source_path", "section_index", F.concat_ws(" > ", "header_path").alias("header_path"), "text", "error")


def csv_chunks(spark: SparkSession, folder: str) -> DataFrame:
    plan = EmbedPlan("csv", 4096, 100, "customers", "text-embedding-3-small")
    return chunking.chunk_sections(_csv(spark, folder), plan, "words").select("source_path", "chunk_index", "text", "n_tokens")


# -- parsing ---------------------------------------------------------------------------------------


def sniffed_types(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "html_candidates").select(F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("item"), F.col("html").alias("text")).distinct()
    docs = _documents(spark, folder).select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("item"), "text")
    raw = table(spark, folder, "sample_rows").select(F.concat(F.lit("row/"), F.col("row_id").cast("string")).alias("item"), F.col("raw_line").alias("text")).distinct()
    return pages.union(docs).union(raw).filter(F.col("text").isNotNull()).select("item", files.sniff_column(F.col("text")).alias("kind"))


def json_sections(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select(F.concat(F.lit("event/"), F.col("event_id").cast("string"), F.lit(".json")).alias("source_path"), F.col("props").alias("text"))
    return files.parse_texts(rows).select("source_path", "section_index", "key_path", "text")


def jsonl_sections(spark: SparkSession, folder: str) -> DataFrame:
    line = F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")))
    rows = table(spark, folder, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", line.alias("l")))), lambda x: x["l"]), "\n\n").alias("text"))
    return files.parse_texts(rows.select(F.concat(F.lit("region/"), F.col("n_regionkey").cast("string"), F.lit(".jsonl")).alias("source_path"), "text")).select("source_path", "line", "text")


def _csv(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as one CSV text per customer, with a quoted name that holds a comma and a quote."""
    c = table(spark, folder, "customer")
    row = F.concat(F.lit("key,name,segment\n"), F.col("c_custkey").cast("string"), F.lit(',"'), F.col("c_name"), F.lit(', ""x""",'), F.col("c_mktsegment"), F.lit("\n"))
    return files.parse_texts(c.select(F.concat(F.lit("customer/"), F.col("c_custkey").cast("string"), F.lit(".csv")).alias("source_path"), row.alias("text")))


def csv_sections(spark: SparkSession, folder: str) -> DataFrame:
    return _csv(spark, folder).select("source_path", "row", F.col("columns")["name"].alias("name"), "text")


def _samples(spark: SparkSession, folder: str, kind: str, text: Column) -> DataFrame:
    """Every sample row of a kind as a text of its own, parsed; what can't be parsed has an error."""
    rows = table(spark, folder, "sample_rows").filter(F.col("file_kind") == kind).dropDuplicates(["row_id"])
    return files.parse_texts(rows.select(F.concat(F.lit("row/"), F.col("row_id").cast("string"), F.lit(f".{kind}")).alias("source_path"), text.alias("text")), on_error="keep")


def jsonl_samples(spark: SparkSession, folder: str) -> DataFrame:
    return _samples(spark, folder, "jsonl", F.col("raw_line")).select("source_path", "line", "text", "error")


def csv_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Rows below the header of their kind of file; a header itself has no section."""
    text = F.when(F.col("line_no") == 1, F.col("raw_line")).otherwise(F.concat(F.lit("id,name,role,department,start_year,active\n"), F.col("raw_line")))
    return _samples(spark, folder, "csv", text).select("source_path", "row", "columns", "text", "error")


def html_sections(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "html_candidates").dropDuplicates(["page_id"]).filter(F.length("html") > 0)
    rows = pages.select(F.concat(F.lit("page/"), F.col("page_id").cast("string"), F.lit(".html")).alias("source_path"), F.col("html").alias("text"))
    return files.parse_texts(rows).select("source_path", "section_index", "heading", F.concat_ws(" > ", "header_path").alias("header_path"), "extraction_origin", F.length("text").alias("n_chars"), "error")


def markdown_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Every section's text read as Markdown."""
    rows = table(spark, folder, "sections").dropDuplicates(["section_id"])
    rows = rows.select(F.concat(F.coalesce("source_path", F.lit("")), F.lit("/"), F.col("section_id").cast("string"), F.lit(".md")).alias("source_path"), "text")
    return files.parse_texts(rows).select("source_path", "section_index", F.concat_ws(" > ", "header_path").alias("header_path"), "header_depth", F.length("text").alias("n_chars"))


# -- plans and cost --------------------------------------------------------------------------------


def heuristic_plans(spark: SparkSession, folder: str) -> DataFrame:
    return embed_plan.plans_of(table(spark, folder, "sections").select("source_path").union(_documents(spark, folder).select("source_path")))


def estimated_cost(spark: SparkSession, folder: str) -> DataFrame:
    prices = spark.createDataFrame([("tern-compact-64", 0.02), ("nimbus-embed-64", 0.13), ("fjord-local-64", 0.0)], "model string, price double")
    rows = table(spark, folder, "cost_estimates").filter(F.col("tokens") >= 0).select("estimate_id", "model", "tokens").distinct()
    sums = rows.groupBy("model").agg(F.sum("tokens").alias("n_tokens"))
    usd = embed_plan.cost_usd(F.col("n_tokens"), F.col("price"))
    # three prices
    return sums.join(F.broadcast(prices), "model", "left").select("model", "n_tokens", F.round(usd, 6).alias("usd"), embed_plan.format_usd(usd).alias("shown"))


def chunk_cost(spark: SparkSession, folder: str) -> DataFrame:
    plan = EmbedPlan("recursive", 800, 0, "documents", "text-embedding-3-small")
    return export.cost_summary(chunking.chunk_sections(_sections(spark, folder), plan), plan.embedding_model)


# -- differences and state -------------------------------------------------------------------------


def chunk_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Every snapshot against the one before."""
    return ledger.diff_chunks(*_snapshot_steps(spark, folder), ["snapshot_no", "source_path", "chunk_id"])


def diff_counts(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.outcome_counts(chunk_diff(spark, folder), ["snapshot_no", "source_path"])


def work_set(spark: SparkSession, folder: str) -> DataFrame:
    """Of every snapshot what the one before hadn't."""
    old, new = _snapshot_steps(spark, folder)
    return ledger.work_set(new, old, ["snapshot_no"]).select("snapshot_no", "source_path", "chunk_index", "chunk_id")


def _targets(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    specs = table(spark, folder, "job_specs")
    ids = lambda c: specs.select("job_key", F.explode(c).alias("chunk_id")).filter(F.col("chunk_id").isNotNull()).distinct()
    return ids("target_chunk_ids"), ids("completed_chunk_ids")


def resume_remaining(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.remaining(*_targets(spark, folder))


def checkpoint_strangers(spark: SparkSession, folder: str) -> DataFrame:
    target, done = _targets(spark, folder)
    return ledger.strangers(done, target)


def checkpoint_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Per job what it targets, what of it is stored and left, and what is stored that it doesn't target."""
    target, done = _targets(spark, folder)
    parts = {"stored": done, "left": ledger.remaining(target, done), "strange": ledger.strangers(done, target)}
    out = target.groupBy("job_key").agg(F.count(F.lit(1)).alias("targets"))
    for name, rows in parts.items():
        out = out.join(rows.groupBy("job_key").agg(F.count(F.lit(1)).alias(name)), "job_key", "full_outer")
    return out.na.fill(0, ["targets", *parts])


def selected_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """In which snapshots the chunks stand that the newest one holds."""
    return ledger.selected(table(spark, folder, "chunk_snapshots").select("chunk_id", "snapshot_no").distinct(), _last_snapshot(spark, folder))


def plan_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    specs = table(spark, folder, "job_specs").select("vector_db", F.col("collection_name").alias("collection"), "source_path", F.col("embedding_provider").alias("provider"), F.col("embedding_model").alias("model"), F.col("dimensions").alias("dim"))
    return ledger.conflicts(specs, "tern", "tern-compact-64", 64)


def unchanged_revisions(spark: SparkSession, folder: str) -> DataFrame:
    """Every revision of a source at which source and plan stayed as they were."""
    return ledger.unchanged_revisions(table(spark, folder, "job_specs").select("source_path", "revision", "source_hash", "plan_hash"))


def job_keys(spark: SparkSession, folder: str) -> DataFrame:
    names = ["source_path", "source_hash", "plan_hash", "embedding_provider", "embedding_model", "dimensions", "collection_name", "vector_db"]
    return table(spark, folder, "job_specs").select("job_id", *names).distinct().select("job_id", ledger.job_key(names).alias("job_key"))


# -- vectors ---------------------------------------------------------------------------------------


def vector_problems(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "chunk_vectors").select("vec_id", collection.vector_problem(F.col("vector"), F.col("dim")).alias("problem"))
    return v.filter(F.col("problem").isNotNull()).distinct()


def vector_literals(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", collection.vector_literal(F.col("embedding"), 4).alias("literal"))


def point_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunk_vectors").select("chunk_id", collection.point_uuid(F.col("chunk_id")).alias("point_id")).distinct()


def vector_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Every point: stored are those embedded up to the middle of the time that the table covers, then come those embedded later and, once more, the stored ids below '4'."""
    points = table(spark, folder, "chunk_vectors").select("chunk_id", F.unix_micros("embedded_at").alias("at"))
    middle = points.agg(F.expr("(min(at) + max(at)) div 2")).head()[0]
    sided = points.select("chunk_id", F.coalesce(F.col("at") > F.lit(middle), F.lit(False)).alias("late"))
    stored = sided.filter(~F.col("late")).select("chunk_id", F.lit("first").alias("content")).distinct()
    rows = sided.filter(F.col("late") | (F.col("chunk_id") < "4")).select("chunk_id", F.lit("second").alias("content")).distinct()
    return collection.upserted(stored, rows)


def vector_delete(spark: SparkSession, folder: str) -> DataFrame:
    points = table(spark, folder, "chunk_vectors").select("chunk_id", "model").distinct()
    return collection.deleted(points.select("chunk_id").distinct(), points.filter(F.col("model").isNull()))


def flat_metadata(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "sections").dropDuplicates(["section_id"])
    meta = collection.flat_metadata({"contentType": F.col("content_type"), "headerPath": F.col("header_path"), "headerDepth": F.col("header_depth")}, {"headerPath": "array"})
    return s.select("section_id", meta.alias("metadata"))


def listed_metadata(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "sections").dropDuplicates(["section_id"])
    meta = collection.listed_metadata({"contentType": F.col("content_type"), "headerPath": F.col("header_path")}, {"headerPath": "array"})
    return s.select("section_id", meta.alias("metadata"))


def hash_vectors(spark: SparkSession, folder: str) -> DataFrame:
    chunks = _sections(spark, folder).filter(F.length("text") > 0).select("source_path", "text")
    return embedding.embed_chunks(chunks, embedding.HashProvider(32), "hash-32").select("source_path", "vector", "dim")


def export_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every field of every exported line, read back; of a vector how many entries it has and its first."""
    v = table(spark, folder, "chunk_vectors").dropDuplicates(["vec_id"]).select("source_path", F.lit(0).alias("chunk_index"), "chunk_id", "text", F.col("metadata").alias("meta_json"), "model", "dim", "vector")
    get = lambda k: F.get_json_object("value", f"$.{k}")
    vector = F.from_json(get("vector"), "array<string>")
    return export.export_lines(v).select(
        get("id").alias("chunk_id"), get("sourcePath").alias("source_path"), get("text").alias("text"), get("metadata").alias("metadata"), get("model").alias("model"), get("dimensions").cast("int").alias("dim"),
        F.coalesce(F.size(vector), F.lit(-1)).alias("entries"), F.round(F.try_element_at(vector, F.lit(1)).try_cast("float").cast("double"), 5).alias("first_entry"),
    )


# -- retrieval -------------------------------------------------------------------------------------


def term_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.term_frequency(spread_table(spark, folder, "documents", "doc_id", "text"))


def document_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.document_frequency(term_frequency(spark, folder))


def tfidf_norms(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.text_norms(spread_table(spark, folder, "documents", "doc_id", "text")).select("doc_id", F.round("norm", 6).alias("norm"))


def tfidf_top(spark: SparkSession, folder: str) -> DataFrame:
    ranked = retrieval.rank_tfidf(_questions(spark), _chunks(spark, folder), TOP)
    return ranked.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def relevant_documents(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.relevant_chunks(_chunks(spark, folder), _labels(spark))


def retrieval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    m = retrieval.query_metrics(tfidf_top(spark, folder), relevant_documents(spark, folder), TOP)
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in retrieval.METRICS])


def metric_means(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.mean_metrics(retrieval_metrics(spark, folder)).select(*[F.round(c, 5).alias(c) for c in retrieval.METRICS])


def threshold_gate(spark: SparkSession, folder: str) -> DataFrame:
    gate = retrieval.passes(metric_means(spark, folder), {"hit_rate": 0.5, "precision": 0.9})
    return gate


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p3_found, p4_found, p7_found, p7_valid, chunk_ids, source_hashes, line_sections, chunk_numbering, embed_batches, recursive_chunks, code_chunks, markdown_chunks, split_examples, section_examples, csv_chunks, sniffed_types, json_sections, jsonl_sections,
        csv_sections, jsonl_samples, csv_samples, html_sections, markdown_sections, heuristic_plans, estimated_cost, chunk_cost, chunk_diff, diff_counts, work_set, resume_remaining, checkpoint_strangers, checkpoint_counts, selected_chunks, plan_conflicts, unchanged_revisions, job_keys,
        vector_problems, vector_literals, point_ids, vector_upsert, vector_delete, flat_metadata, listed_metadata, hash_vectors, export_lines, term_frequency, document_frequency, tfidf_norms, tfidf_top, relevant_documents,
        retrieval_metrics, metric_means, threshold_gate,
    )
}

#: What the examples come to, worked out by hand.
_CHUNKS = [
    ("short", 0, "hello world"), ("paragraphs", 0, "one."), ("paragraphs", 1, "two."), ("paragraphs", 2, "three."), ("sentences", 0, "alpha. beta"), ("sentences", 1, "beta. gamma"), ("sentences", 2, "delta."),
    ("word", 0, "abcd"), ("word", 1, "efgh"), ("word", 2, "ij"), ("packed", 0, "a b c d e"), ("packed", 1, "f g h"),
    ("code", 0, "import x"), ("code", 1, "f():\n    return 1"), ("code", 2, "g():\n    return 2"), ("records", 0, "id: 1"), ("records", 1, "name:"), ("records", 2, "long"), ("records", 3, "enoug"), ("records", 4, "h"),
    ("markdown", 0, "first words\n\n```py\nx = 1\n```\n\nlast words"),
    ("table", 0, "| a | b |\n| --- | --- |\n| 1 | 2 |"), ("table", 1, "| a | b |\n| --- | --- |\n| 333333 | 444444 |"),
]
_SECTIONS = [
    ("a.md", 0, "A b", "# A *b*\n\nintro"), ("a.md", 1, "A b > Empty > Deep", "### Deep\ntext\n\n```\n# no heading\n```"), ("a.md", 2, "Setext", "Setext\n======\nend"), ("b.md", 0, "", "no heading at all"),
    ("d.html", 0, "Title", "# Title\n\nFirst **bold** words and a [link](/x) to follow.\n\n- one\n- two"), ("e.csv", 0, "", "h1: v\nh2: w, \"x\""), ("e.csv", 1, "", "h1: y\nh2: "),
    ("f.jsonl", 0, "", "{\n  \"a\": 1\n}"), ("f.jsonl", 1, "", "x"), ("g.json", 0, "", "[\n  1,\n  null\n]"), ("g.json", 1, "", "t"),
]

_STEPS = "latest AS (SELECT *, row_number() OVER (PARTITION BY snapshot_no, source_path, chunk_index ORDER BY loaded_at DESC, chunk_id DESC) AS rn FROM chunk_snapshots), steps AS (SELECT s, lag(s) OVER (ORDER BY s) AS b FROM (SELECT DISTINCT snapshot_no AS s FROM chunk_snapshots WHERE snapshot_no IS NOT NULL)), old AS (SELECT s AS snapshot_no, source_path, chunk_index, chunk_id FROM latest JOIN steps ON snapshot_no = b WHERE rn = 1), new AS (SELECT snapshot_no, source_path, chunk_index, chunk_id FROM latest JOIN steps ON snapshot_no = s WHERE b IS NOT NULL AND rn = 1)"
_STEP_DIFF = f"WITH {_STEPS}, b AS (SELECT snapshot_no, source_path, chunk_id, bool_or(o) AS o, bool_or(n) AS n FROM (SELECT snapshot_no, source_path, chunk_id, true AS o, false AS n FROM old UNION ALL SELECT snapshot_no, source_path, chunk_id, false, true FROM new) GROUP BY ALL), d AS (SELECT snapshot_no, source_path, chunk_id, CASE WHEN o AND n THEN 'kept' WHEN n THEN 'added' ELSE 'removed' END AS status FROM b)"
_JOBS = "t AS (SELECT DISTINCT job_key, chunk_id FROM (SELECT job_key, unnest(target_chunk_ids) AS chunk_id FROM job_specs) WHERE chunk_id IS NOT NULL), c AS (SELECT DISTINCT job_key, chunk_id FROM (SELECT job_key, unnest(completed_chunk_ids) AS chunk_id FROM job_specs) WHERE chunk_id IS NOT NULL)"
_STOP = "('a', 'an', 'and', 'are', 'as', 'at', 'be', 'by', 'do', 'for', 'from', 'how', 'in', 'is', 'it', 'of', 'on', 'or', 'the', 'to', 'what', 'when', 'which', 'with')"
#: Splitters by extension, as the SQL knows them (not the operator's table).
_BY_EXTENSION = (
    "CASE WHEN extension IN ('md', 'mdx', 'markdown', 'docx') THEN 'markdown' WHEN extension = 'pdf' THEN 'pdf' WHEN extension IN ('html', 'htm') THEN 'html' WHEN extension = 'csv' THEN 'csv' "
    "WHEN extension IN ('jsonl', 'ndjson') THEN 'jsonl' WHEN extension IN ('ts', 'tsx', 'js', 'jsx', 'mjs', 'cjs', 'py', 'go', 'rs', 'java') THEN 'code' ELSE 'recursive' END"
)
_KNOWN = "'md', 'mdx', 'markdown', 'docx', 'pdf', 'html', 'htm', 'csv', 'json', 'txt', 'text', 'log', 'jsonl', 'ndjson', 'ts', 'tsx', 'js', 'jsx', 'mjs', 'cjs', 'py', 'go', 'rs', 'java'"
_LINES = "SELECT source_path, CAST(doc_id AS INT) AS section_index, generate_subscripts(l, 1) - 1 AS chunk_in_section FROM (SELECT source_path, doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)"
_TERMS = f"SELECT {{key}}, term, count(*) AS tf FROM (SELECT {{key}}, unnest(regexp_extract_all(lower(text), '[\\p{{{{L}}}}\\p{{{{N}}}}]+')) AS term FROM {{rel}}) WHERE term NOT IN {_STOP} GROUP BY ALL"
_TF = _TERMS.replace("{{{{", "{{").replace("}}}}", "}}").format(key="doc_id", rel="documents")
_RANK = (
    "chunks AS (SELECT 'doc/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS chunk_id, source, text FROM documents), questions AS (SELECT * FROM " + _values(QUESTIONS, "q(query_id, text)") + "), "
    "ct AS (" + _TERMS.replace("{{{{", "{{").replace("}}}}", "}}").format(key="chunk_id", rel="chunks") + "), qt AS (" + _TERMS.replace("{{{{", "{{").replace("}}}}", "}}").format(key="query_id", rel="questions") + "), "
    "df AS (SELECT term, count(*) AS df FROM ct GROUP BY term), n AS (SELECT count(*) AS n FROM chunks), "
    "cw AS (SELECT chunk_id, ct.term, (1 + ln(tf)) * (ln((n + 1) / (coalesce(df, 0) + 1)) + 1) AS w FROM ct LEFT JOIN df USING (term), n), "
    "qw AS (SELECT query_id, qt.term, (1 + ln(tf)) * (ln((n + 1) / (coalesce(df, 0) + 1)) + 1) AS w FROM qt LEFT JOIN df USING (term), n), "
    "cn AS (SELECT chunk_id, sqrt(sum(w * w)) AS v FROM cw GROUP BY 1), qn AS (SELECT query_id, sqrt(sum(w * w)) AS v FROM qw GROUP BY 1), "
    "dots AS (SELECT query_id, chunk_id, sum(qw.w * cw.w) AS d FROM qw JOIN cw USING (term) GROUP BY 1, 2), "
    "scored AS (SELECT q.query_id, c.chunk_id, coalesce(d / (cn.v * qn.v), 0.0) AS score FROM questions q CROSS JOIN chunks c LEFT JOIN dots USING (query_id, chunk_id) LEFT JOIN cn USING (chunk_id) LEFT JOIN qn USING (query_id)), "
    f"ranked AS (SELECT * FROM (SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, chunk_id) AS rank FROM scored) WHERE rank <= {TOP}), "
    "rel AS (SELECT DISTINCT query_id, chunk_id FROM chunks JOIN " + _values(LABELS, "l(query_id, source, contains)") + " USING (source) WHERE contains(lower(text), lower(contains))), "
    f"m AS (SELECT r.query_id, max(CASE WHEN rel.chunk_id IS NOT NULL THEN 1 ELSE 0 END) AS hit, count(rel.chunk_id) AS hits, min(CASE WHEN rel.chunk_id IS NOT NULL THEN rank END) AS first, sum(CASE WHEN rel.chunk_id IS NOT NULL THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM ranked r LEFT JOIN rel ON r.query_id = rel.query_id AND r.chunk_id = rel.chunk_id GROUP BY 1), "
    f"w AS (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY 1), metrics AS (SELECT m.query_id, round(CAST(hit AS DOUBLE), 6) AS hit_rate, round(coalesce(hits / n_rel, 0.0), 6) AS recall, round(hits / {float(TOP)}, 6) AS precision, round(coalesce(1.0 / first, 0.0), 6) AS mrr, "
    f"round(coalesce(dcg / list_sum(list_transform(range(1, least(n_rel, {TOP}) + 1), lambda i: 1 / log2(i + 1))), 0.0), 6) AS ndcg FROM m LEFT JOIN w USING (query_id))"
)
_MEANS = "means AS (SELECT " + ", ".join(f"round(avg({m}), 5) AS {m}" for m in retrieval.METRICS) + " FROM metrics)"
_EXT = "CASE WHEN regexp_matches(e, '^[0-9]+$') AND b IN ({known}) THEN b ELSE e END"

_SAMPLES = r"""
        WITH d AS (SELECT DISTINCT ON (row_id) row_id, file_kind, line_no, raw_line, regexp_replace(raw_line, '\r?\n?$', '') AS l0 FROM sample_rows),
        e AS (SELECT *, CASE WHEN line_no = 1 THEN regexp_replace(l0, '^\x{FEFF}', '') ELSE l0 END AS l FROM d),
        f AS (SELECT * FROM e WHERE l IS NOT NULL AND regexp_matches(l, '[^\s\x{A0}\x{FEFF}]')),
        c AS (SELECT row_id, regexp_full_match(l, '(?s)(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*') AS well,
                     list_transform(regexp_extract_all(',' || l, '(?s),(?:"(?:[^"]|"")*"|[^",]*)'), lambda x: regexp_replace(x[2:], '(?s)^"(.*)"$', '\1')) AS cells
              FROM f WHERE file_kind = 'csv' AND line_no <> 1),
        j AS (SELECT row_id, CASE WHEN json_valid(l) AND NOT regexp_matches(l, ',\s*[}\]]\s*$') THEN json_type(l) = 'OBJECT' ELSE false END AS obj, CASE WHEN json_valid(l) THEN l END AS l FROM f WHERE file_kind = 'jsonl'),
        k AS (SELECT row_id, obj, json_type(l, '$.event') AS te, json_type(l, '$.user_id') AS tu, json_type(l, '$.ts') AS tt,
                     l ->> '$.event' AS ev, l ->> '$.user_id' AS us, l ->> '$.ts' AS ts FROM j),
        s AS (SELECT row_id, CASE WHEN NOT well THEN 'quoting' WHEN len(cells) <> 6 THEN 'columns'
                     WHEN regexp_full_match(trim(cells[1]), '0*[1-9][0-9]*') AND try_cast(trim(cells[1]) AS BIGINT) IS NOT NULL
                          AND regexp_full_match(cells[5], '19[0-9]{2}|20[0-9]{2}|2100') AND cells[6] IN ('true', 'false') THEN NULL ELSE 'value' END AS reason FROM c
              UNION ALL SELECT row_id, CASE WHEN NOT obj THEN 'quoting' WHEN te IS NULL OR tu IS NULL OR tt IS NULL THEN 'columns'
                     WHEN te = 'VARCHAR' AND tu = 'VARCHAR' AND tt = 'VARCHAR' AND trim(ev) <> '' AND trim(us) <> ''
                          AND regexp_full_match(ts, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})')
                          AND try_cast(substr(ts, 1, 10) AS DATE) IS NOT NULL AND try_cast(substr(ts, 12, 8) AS TIME) IS NOT NULL THEN NULL ELSE 'value' END FROM k)
        """

SQL: dict[str, str] = {
    "p3_found": """
        WITH done AS (SELECT DISTINCT batch_no FROM job_runs WHERE status = 'succeeded'),
        specs AS (SELECT *, batch_no IS NOT NULL AND batch_no IN (SELECT batch_no FROM done WHERE batch_no IS NOT NULL) AS is_done FROM job_specs),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY source_path, is_done ORDER BY revision DESC, job_id) AS rn FROM specs),
        state AS (SELECT * FROM ranked WHERE is_done AND rn = 1),
        news AS (SELECT p.* FROM ranked p LEFT JOIN state s ON p.source_path IS NOT DISTINCT FROM s.source_path AND s.rn = 1
                 WHERE NOT p.is_done AND p.rn = 1 AND (s.rn IS NULL OR NOT (s.revision >= p.revision
                       OR (s.source_hash IS NOT DISTINCT FROM p.source_hash AND s.plan_hash IS NOT DISTINCT FROM p.plan_hash)))),
        committed AS (SELECT DISTINCT job_key, unnest(completed_chunk_ids) AS chunk_id FROM specs WHERE NOT is_done),
        ups AS (SELECT source_path, job_key, unnest(target_chunk_ids) AS chunk_id FROM news)
        SELECT DISTINCT source_path, chunk_id, 'upsert' AS op FROM ups u WHERE chunk_id IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM committed c WHERE c.job_key = u.job_key AND c.chunk_id = u.chunk_id)
        UNION SELECT source_path, chunk_id, 'delete' AS op FROM (SELECT source_path, unnest(removed_chunk_ids) AS chunk_id FROM news) WHERE chunk_id IS NOT NULL""",
    "p4_found": """
        WITH r AS (SELECT *, row_number() OVER (PARTITION BY snapshot_no, source_path, chunk_index ORDER BY loaded_at DESC, chunk_id DESC, meta_json DESC) AS rn FROM chunk_snapshots),
        cur AS (SELECT snapshot_no, source_path, chunk_index, chunk_id, meta_json,
                list_sort(list_transform(json_keys(meta_json), lambda k: k || '=' || CAST(json_extract(json(meta_json), '$."' || k || '"') AS VARCHAR))) AS meta FROM r WHERE rn = 1),
        ord AS (SELECT s, lag(s) OVER (ORDER BY s) AS b FROM (SELECT DISTINCT snapshot_no AS s FROM chunk_snapshots)),
        a AS (SELECT o.s, c.* FROM cur c JOIN ord o ON c.snapshot_no = o.s WHERE o.b IS NOT NULL),
        b AS (SELECT o.s, c.* FROM cur c JOIN ord o ON c.snapshot_no = o.b)
        SELECT coalesce(a.s, b.s) AS snapshot_no, coalesce(a.source_path, b.source_path) AS source_path, coalesce(a.chunk_index, b.chunk_index) AS chunk_index,
               CASE WHEN b.s IS NULL THEN 'added' WHEN a.s IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
        FROM a FULL JOIN b ON a.s = b.s AND a.source_path = b.source_path AND a.chunk_index = b.chunk_index
        WHERE a.s IS NULL OR b.s IS NULL OR a.chunk_id IS DISTINCT FROM b.chunk_id OR a.meta IS DISTINCT FROM b.meta""",
    "p7_found": _SAMPLES + "SELECT row_id, reason FROM s WHERE reason IS NOT NULL",
    "p7_valid": _SAMPLES + r"""
        , ok AS (SELECT d.row_id, d.file_kind, d.line_no, d.raw_line FROM d JOIN s USING (row_id) WHERE s.reason IS NULL),
        v AS (SELECT row_id, list_transform(cells, lambda x: replace(x, '""', '"')) AS x FROM c),
        i AS (SELECT row_id, ev, us, CAST(replace(substr(ts, 1, 19), 'T', ' ') AS TIMESTAMP) + to_microseconds(CAST(rpad(substr(regexp_extract(ts, '[.,]([0-9]+)', 1), 1, 6), 6, '0') AS BIGINT))
                     - to_minutes(coalesce(CASE WHEN ts[-1] <> 'Z' THEN CAST(regexp_extract(ts, '([+-])[0-9]{2}:?([0-9]{2})?$', 1) || '1' AS INTEGER)
                        * (60 * CAST(regexp_extract(ts, '[+-]([0-9]{2}):?([0-9]{2})?$', 1) AS INTEGER) + CAST('0' || regexp_extract(ts, '[+-]([0-9]{2}):?([0-9]{2})?$', 2) AS INTEGER)) END, 0)) AS ts FROM k SEMI JOIN ok USING (row_id))
        SELECT ok.row_id, file_kind, line_no, raw_line, CAST(trim(x[1]) AS BIGINT) AS id, x[2] AS name, x[3] AS role, x[4] AS department, CAST(x[5] AS INTEGER) AS start_year, x[6] = 'true' AS active,
               CAST(NULL AS VARCHAR) AS event, CAST(NULL AS VARCHAR) AS user_id, CAST(NULL AS TIMESTAMP) AS ts FROM ok JOIN v USING (row_id)
        UNION ALL SELECT ok.row_id, file_kind, line_no, raw_line, NULL, NULL, NULL, NULL, NULL, NULL, ev, us, ts FROM ok JOIN i USING (row_id)""",
    "chunk_ids": "SELECT 'doc/' || doc_id AS source_path, substr(sha256('doc/' || doc_id || chr(0) || '0' || chr(0) || '5' || chr(0) || coalesce(text, '')), 1, 16) AS chunk_id FROM documents",
    "source_hashes": "SELECT doc_id, sha256(coalesce(text, '')) AS source_hash FROM documents",
    "line_sections": "SELECT doc_id, line, l[line] AS text FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)) WHERE regexp_matches(l[line], '[^" + jstext.BLANKS + "]')",
    "chunk_numbering": f"SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY section_index, chunk_in_section) - 1 AS chunk_index FROM ({_LINES})",
    "embed_batches": f"SELECT source_path, batch_no, count(*) AS n_chunks FROM (SELECT source_path, (row_number() OVER (PARTITION BY source_path ORDER BY section_index, chunk_in_section) - 1) // 64 AS batch_no FROM ({_LINES})) GROUP BY ALL",
    "split_examples": "SELECT * FROM " + _values(_CHUNKS, "t(source_path, chunk_index, text)"),
    "section_examples": "SELECT source_path, section_index, header_path, text, CAST(NULL AS VARCHAR) AS error FROM " + _values(_SECTIONS, "t(source_path, section_index, header_path, text)"),
    "csv_chunks": "SELECT 'customer/' || c_custkey || '.csv' AS source_path, 0 AS chunk_index, 'key: ' || c_custkey || chr(10) || 'name: ' || c_name || ', \"x\"' || chr(10) || 'segment: ' || c_mktsegment AS text, len(regexp_extract_all('key: ' || c_custkey || chr(10) || 'name: ' || c_name || ', \"x\"' || chr(10) || 'segment: ' || c_mktsegment, '\\S+')) AS n_tokens FROM customer",
    "sniffed_types": """
        WITH i AS (SELECT DISTINCT 'page/' || page_id AS item, html AS text FROM html_candidates UNION ALL SELECT 'doc/' || doc_id, text FROM documents UNION ALL SELECT DISTINCT 'row/' || row_id, raw_line FROM sample_rows),
        h AS (SELECT item, substr(text, 1, 8192) AS head FROM i WHERE text IS NOT NULL),
        s AS (SELECT item, head, ltrim(head, chr(65279) || ' ' || chr(9) || chr(13) || chr(10) || chr(12) || chr(11)) AS start FROM h)
        SELECT item, CASE WHEN starts_with(head, '%PDF-') THEN 'pdf' WHEN contains(head, chr(0)) THEN 'binary'
            WHEN starts_with(lower(start), '<!doctype html') OR regexp_matches(lower(substr(start, 1, 14)), '^<html\\b') THEN 'html' WHEN start[1] IN ('{', '[') THEN 'json'
            WHEN length(head) - length(regexp_replace(head, '[\\x00-\\x07\\x0b\\x0e-\\x1f]', '', 'g')) > 0.02 * greatest(length(head), 1) THEN 'binary' ELSE 'text' END AS kind FROM s""",
    "json_sections": "SELECT 'event/' || event_id || '.json' AS source_path, i - 1 AS section_index, k[i] AS key_path, props ->> ('$.' || k[i]) AS text FROM (SELECT event_id, props, k, unnest(range(1, len(k) + 1)) AS i FROM (SELECT event_id, props, json_keys(props) AS k FROM events))",
    "jsonl_sections": "SELECT 'region/' || n_regionkey || '.jsonl' AS source_path, 2 * row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS line, '{' || chr(10) || '  \"id\": ' || n_nationkey || ',' || chr(10) || '  \"name\": \"' || n_name || '\"' || chr(10) || '}' AS text FROM nation",
    "csv_sections": "SELECT 'customer/' || c_custkey || '.csv' AS source_path, 1 AS row, c_name || ', \"x\"' AS name, 'key: ' || c_custkey || chr(10) || 'name: ' || c_name || ', \"x\"' || chr(10) || 'segment: ' || c_mktsegment AS text FROM customer",
    "heuristic_plans": f"""
        WITH p AS (SELECT DISTINCT source_path, regexp_extract(source_path, '([^/]*)$', 1) AS n FROM (SELECT source_path FROM sections UNION ALL SELECT source_path FROM documents)),
        x AS (SELECT source_path, n, lower(regexp_extract(n, '[^.]\\.([^.]*)$', 1)) AS e, lower(regexp_extract(n, '[^.]\\.([^.]+)\\.[0-9]+$', 1)) AS b FROM p),
        y AS (SELECT source_path, n, coalesce({_EXT.format(known=_KNOWN)}, '') AS extension FROM x),
        z AS (SELECT *, {_BY_EXTENSION} AS splitter FROM y)
        SELECT source_path, extension, splitter, CASE WHEN splitter IN ('csv', 'jsonl') THEN 4096 ELSE 800 END AS chunk_size, 100 AS overlap,
            coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(n, '([^.])\\.[^.]*$', '\\1')), '[^a-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), '^[^a-z0-9]+', ''), ''), 'default') AS collection FROM z""",
    "estimated_cost": """
        WITH s AS (SELECT model, CAST(sum(tokens) AS BIGINT) AS n_tokens FROM (SELECT DISTINCT estimate_id, model, tokens FROM cost_estimates WHERE tokens >= 0) GROUP BY model),
        u AS (SELECT s.model, n_tokens, n_tokens / 1000000.0 * price AS usd FROM s LEFT JOIN (VALUES ('tern-compact-64', 0.02), ('nimbus-embed-64', 0.13), ('fjord-local-64', 0.0)) AS p(model, price) ON s.model = p.model)
        SELECT model, n_tokens, round(CAST(usd AS DOUBLE), 6) AS usd, CASE WHEN usd IS NULL THEN 'unknown' WHEN usd = 0 THEN '$0.0000' WHEN usd < 0.0001 THEN '<$0.0001' ELSE printf('$%.4f', CAST(usd AS DOUBLE)) END AS shown FROM u""",
    "chunk_diff": _STEP_DIFF + " SELECT * FROM d",
    "diff_counts": _STEP_DIFF + " SELECT snapshot_no, source_path, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'kept') AS kept, count(*) FILTER (status = 'removed') AS removed FROM d GROUP BY 1, 2",
    "work_set": f"WITH {_STEPS} SELECT snapshot_no, source_path, chunk_index, chunk_id FROM new EXCEPT SELECT snapshot_no, source_path, chunk_index, chunk_id FROM old",
    "resume_remaining": f"WITH {_JOBS} SELECT job_key, chunk_id FROM t EXCEPT SELECT job_key, chunk_id FROM c",
    "checkpoint_strangers": f"WITH {_JOBS} SELECT job_key, chunk_id FROM c EXCEPT SELECT job_key, chunk_id FROM t",
    "checkpoint_counts": f"""
        WITH {_JOBS}, a AS (SELECT job_key, chunk_id, max(x) AS target, max(y) AS done FROM (SELECT job_key, chunk_id, 1 AS x, 0 AS y FROM t UNION ALL SELECT job_key, chunk_id, 0, 1 FROM c) GROUP BY ALL)
        SELECT job_key, CAST(sum(target) AS BIGINT) AS targets, CAST(sum(done) AS BIGINT) AS stored, CAST(sum(target * (1 - done)) AS BIGINT) AS left, CAST(sum(done * (1 - target)) AS BIGINT) AS strange FROM a GROUP BY job_key""",
    "selected_chunks": "WITH l AS (SELECT source_path, chunk_index, chunk_id, row_number() OVER (PARTITION BY source_path, chunk_index ORDER BY loaded_at DESC, chunk_id DESC) AS rn FROM chunk_snapshots WHERE snapshot_no = (SELECT max(snapshot_no) FROM chunk_snapshots)) SELECT DISTINCT chunk_id, snapshot_no FROM chunk_snapshots WHERE chunk_id IN (SELECT chunk_id FROM l WHERE rn = 1)",
    "plan_conflicts": "SELECT DISTINCT vector_db, collection_name AS collection, source_path, embedding_provider AS provider, embedding_model AS model, dimensions AS dim FROM job_specs WHERE embedding_provider <> 'tern' OR embedding_model <> 'tern-compact-64' OR dimensions <> 64",
    "unchanged_revisions": """
        WITH r AS (SELECT source_path, revision, CASE WHEN min(source_hash) = max(source_hash) AND min(plan_hash) = max(plan_hash) THEN {'h': min(source_hash), 'p': min(plan_hash)} END AS state
                   FROM job_specs WHERE revision IS NOT NULL GROUP BY ALL),
        l AS (SELECT source_path, revision, lag(state) OVER (PARTITION BY source_path ORDER BY revision) AS b FROM r)
        SELECT DISTINCT l.source_path, l.revision FROM l JOIN job_specs s ON s.source_path IS NOT DISTINCT FROM l.source_path AND s.revision = l.revision AND s.source_hash = l.b.h AND s.plan_hash = l.b.p""",
    "job_keys": "SELECT DISTINCT job_id, sha256('{' || " + " || ',' || ".join(f"'\"{n}\":' || {n}" if n == "dimensions" else f"'\"{n}\":\"' || {n} || '\"'" for n in ("source_path", "source_hash", "plan_hash", "embedding_provider", "embedding_model", "dimensions", "collection_name", "vector_db")) + " || '}') AS job_key FROM job_specs",
    "vector_problems": "SELECT DISTINCT vec_id, problem FROM (SELECT vec_id, CASE WHEN vector IS NULL THEN 'missing' WHEN len(vector) <> dim THEN 'dimensions' WHEN len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) > 0 THEN 'not finite' END AS problem FROM chunk_vectors) WHERE problem IS NOT NULL",
    "vector_literals": "SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.4f', CAST(x AS DOUBLE))), ',') || ']' AS literal FROM embeddings",
    "point_ids": "SELECT DISTINCT chunk_id, substr(chunk_id, 1, 8) || '-' || substr(chunk_id, 9, 4) || '-' || substr(chunk_id, 13, 4) || '-' || substr(chunk_id, 1, 4) || '-' || substr(chunk_id, 5, 12) AS point_id FROM chunk_vectors",
    "vector_upsert": "WITH m AS (SELECT (min(epoch_us(embedded_at)) + max(epoch_us(embedded_at))) // 2 AS middle FROM chunk_vectors) SELECT chunk_id, CASE WHEN chunk_id < '4' OR bool_or(coalesce(epoch_us(embedded_at) > middle, false)) THEN 'second' ELSE 'first' END AS content FROM chunk_vectors, m GROUP BY chunk_id",
    "vector_delete": "SELECT chunk_id FROM chunk_vectors EXCEPT SELECT chunk_id FROM chunk_vectors WHERE model IS NULL",
    "flat_metadata": "SELECT DISTINCT section_id, '{' || concat_ws(',', '\"contentType\":\"' || content_type || '\"', '\"headerPath\":' || to_json(array_to_string(header_path, '/')), '\"headerDepth\":' || header_depth) || '}' AS metadata FROM sections",
    "listed_metadata": "SELECT DISTINCT section_id, '{' || concat_ws(',', '\"contentType\":\"' || content_type || '\"', '\"headerPath\":' || to_json(header_path)) || '}' AS metadata FROM sections",
    "export_lines": "SELECT chunk_id, source_path, text, metadata, model, dim, coalesce(len(vector), -1) AS entries, CASE WHEN isfinite(vector[1]) THEN round(CAST(vector[1] AS DOUBLE), 5) ELSE CAST(vector[1] AS DOUBLE) END AS first_entry FROM (SELECT DISTINCT ON (vec_id) * FROM chunk_vectors)",
    "term_frequency": _TF,
    "document_frequency": f"SELECT term, count(*) AS df FROM ({_TF}) GROUP BY term",
    "tfidf_norms": f"WITH tf AS ({_TF}), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term) SELECT doc_id, round(sqrt(sum(pow((1 + ln(tf)) * (ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1), 2))), 6) AS norm FROM tf JOIN df USING (term) GROUP BY doc_id",
    "tfidf_top": f"WITH {_RANK} SELECT query_id, chunk_id, score, rank FROM ranked",
    "relevant_documents": f"WITH {_RANK} SELECT query_id, chunk_id FROM rel",
    "retrieval_metrics": f"WITH {_RANK} SELECT * FROM metrics",
    "metric_means": f"WITH {_RANK}, {_MEANS} SELECT * FROM means",
    "threshold_gate": f"WITH {_RANK}, {_MEANS} SELECT 'hit_rate' AS metric, hit_rate AS value, CAST(0.5 AS DOUBLE) AS minimum, hit_rate >= 0.5 AS ok FROM means UNION ALL SELECT 'precision', precision, CAST(0.9 AS DOUBLE), precision >= 0.9 FROM means",
}

#: The query of the smoke check.
FLAGSHIP = "recursive_chunks"
