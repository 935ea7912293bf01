"""Ledger, collections, pipeline, export, streaming, embedding, configuration, command line."""

import json
import os
import stat

import pytest
from pyspark.sql import functions as F

from sedimenta.errors import CollectionError, IntegrityError, Interrupted, ProviderError, UserError
from sedimenta.operators import collection, export, ledger, pipeline
from sedimenta.operators.chunking import chunk_sections, number_chunks
from sedimenta.operators.collection import ParquetCollections
from sedimenta.operators.embedding import HashProvider, batch_numbers, embed_chunks, embed_texts, provider, with_retries
from sedimenta.operators.jobs import Progress, check_progress, completed
from sedimenta.plans.config import Config, mask_key, mask_url, resolve
from sedimenta.plans.embed_plan import EmbedPlan
from sedimenta.sources.files import parse_texts
from sedimenta.streaming.ingest import SOURCE, ingest, source_stream

PLAN = EmbedPlan("markdown", 50, 5, "kb", "m")
PROVIDER = HashProvider(8)


def texts(spark, rows):
    df = spark.createDataFrame(rows, "source_path string, text string")
    return parse_texts(df).filter("text is not null"), df.select("source_path", F.sha2("text", 256).alias("source_hash"))


def test_numbers(spark):
    rows = [("a", s, k) for s in (0, 3, 1024, 5000) for k in range(3)] + [("b", 7, 0), (None, 0, 0)]
    got = number_chunks(spark.createDataFrame(rows, "source_path string, section_index int, chunk_in_section int")).collect()
    assert sorted(r["chunk_index"] for r in got if r["source_path"] == "a") == list(range(12))
    at = {(r["source_path"], r["section_index"], r["chunk_in_section"]): r["chunk_index"] for r in got}
    assert at["a", 1024, 1] == 7 and at["b", 7, 0] == 0 and at[None, 0, 0] == 0
    assert batch_numbers(spark.createDataFrame([("a", 130)], "source_path string, chunk_index int"), 64).first()["batch_no"] == 2


def test_chunks_and_metadata(spark):
    sections, _ = texts(spark, [("a.md", "# A\n\none\n\n## B\n\ntwo"), ("b.md", "")])
    plan = EmbedPlan("markdown", 50, 5, "kb", "m", {"team": "x", "chunkIndex": "no"})
    got = sorted(chunk_sections(sections, plan, "words").collect(), key=lambda r: r["chunk_index"])
    meta = [json.loads(r["meta_json"]) for r in got]
    assert [r["text"] for r in got] == ["# A\n\none", "# A\n\n## B\n\ntwo"] and [m["chunkIndex"] for m in meta] == [0, 1]
    assert meta[1]["headerPath"] == ["A", "B"] and meta[1]["team"] == "x" and meta[1]["sourcePath"] == "a.md"
    again = chunk_sections(sections, plan, "words").collect()
    assert {r["chunk_id"] for r in again} == {r["chunk_id"] for r in got} and all(len(r["chunk_id"]) == 16 for r in got)


def test_diff(spark):
    frame = lambda ids: spark.createDataFrame([("s", i, k) for i, k in enumerate(ids)], "source_path string, chunk_index int, chunk_id string")
    old, new = frame(["a", "b", "b", "c"]), frame(["b", "d", "d", "c"])
    assert {r["chunk_id"]: r["status"] for r in ledger.diff_chunks(old, new).collect()} == {"a": "removed", "b": "kept", "c": "kept", "d": "added"}
    assert tuple(ledger.outcome_counts(ledger.diff_chunks(old, new)).first())[1:] == (1, 2, 1)
    assert sorted(r["chunk_id"] for r in ledger.work_set(new, old).collect()) == ["b", "d", "d"]
    assert ledger.diff_chunks(frame([]), frame([])).count() == 0
    jobs = spark.createDataFrame([("k", "a"), ("k", "b"), ("l", "a")], "job_key string, chunk_id string")
    done = spark.createDataFrame([("k", "a"), ("k", "z"), ("k", "a")], "job_key string, chunk_id string")
    assert sorted(map(tuple, ledger.remaining(jobs, done).collect())) == [("k", "b"), ("l", "a")]
    assert {tuple(r) for r in ledger.strangers(done, jobs).collect()} == {("k", "z")}


def test_pipeline(spark, tmp_path):
    store, at = ParquetCollections(spark, f"{tmp_path}/store"), f"{tmp_path}/ledger"
    run = lambda rows, plan=PLAN, **k: tuple(vars(pipeline.run(spark, *texts(spark, rows), plan, PROVIDER, store, at, tokens="words", **k)).values())
    rows = [("a.md", "# A\n\none\n\n# B\n\ntwo"), ("b.md", "# C\n\nthree")]
    assert run(rows) == (2, 0, 3, 0, 0, 0)
    assert run(rows) == (2, 2, 0, 0, 0, 0), "nothing changed, nothing done"
    rows[0] = ("a.md", "# A\n\none\n\n# B\n\nTWO")
    assert run(rows) == (2, 1, 1, 0, 1, 0)
    assert sorted(r["content"] for r in store.read("kb").collect()) == ["# A\n\none", "# B\n\nTWO", "# C\n\nthree"]
    stamped = EmbedPlan("markdown", 50, 5, "kb", "m", {"team": "x"})
    assert run(rows, stamped) == (2, 0, 0, 3, 0, 0), "metadata are stored anew with the vectors there are"
    assert store.read("kb").filter("metadata like '%team%'").count() == 3
    assert run(rows, stamped, force=True, checkpoint=2) == (2, 0, 3, 0, 0, 0)
    assert run(rows, EmbedPlan("markdown", 50, 5, "other", "m")) == (2, 0, 3, 0, 0, 0), "another collection starts empty"
    with pytest.raises(IntegrityError):
        run(rows, EmbedPlan("markdown", 50, 5, "kb", "m2"))


def test_damaged_ledger(spark):
    good = {"vector_db": "parquet", "collection": "kb", "source_path": "a", "source_hash": "a" * 64, "plan_hash": "b" * 64, "provider": "hash", "model": "m", "dim": 8, "chunk_index": 0, "chunk_id": "c" * 16, "meta_json": None, "recorded_at": None}
    make = lambda **k: spark.createDataFrame([tuple({**good, **k}.values())], ledger.LEDGER)
    ledger.check_ledger(make(), "hash", "m", 8)
    for bad in ({"chunk_id": "x"}, {"source_hash": None}, {"chunk_index": -1}, {"dim": 0}, {"plan_hash": "B" * 64}):
        with pytest.raises(IntegrityError, match="damaged"):
            ledger.check_ledger(make(**bad), "hash", "m", 8)
        ledger.check_ledger(make(**bad), "hash", "m", 8, force=True)
    stamp = spark.range(1).select(ledger.iso_now().alias("t")).first()["t"]
    assert len(stamp) == 24 and stamp[10] == "T" and stamp[-1] == "Z"


def test_failed_run_is_taken_up_again(spark, tmp_path):
    class Failing(HashProvider):
        def embed(self, texts, model):
            raise ProviderError("no", retryable=False)

    store, at = ParquetCollections(spark, f"{tmp_path}/store"), f"{tmp_path}/ledger"
    rows = [("a.md", "# A\n\none")]
    with pytest.raises(Exception, match="no"):
        pipeline.run(spark, *texts(spark, rows), PLAN, Failing(8), store, at, tokens="words")
    assert store.read("kb").count() == 0
    assert pipeline.run(spark, *texts(spark, rows), PLAN, PROVIDER, store, at, tokens="words").embedded == 1


class Counting(HashProvider):
    """Writes down every text it embeds; fails once it has been called ``most`` times."""

    def __init__(self, log, most=10**9):
        super().__init__(8)
        self.log, self.most = str(log), most

    def embed(self, texts, model):
        known = open(self.log).read().splitlines() if os.path.exists(self.log) else []
        if len(known) >= self.most:
            raise ProviderError("no more", retryable=False)
        with open(self.log, "a") as f:
            f.writelines(json.dumps(t) + "\n" for t in texts)
        return super().embed(texts, model)

    def seen(self):
        return [json.loads(x) for x in open(self.log)] if os.path.exists(self.log) else []


def test_resume_embeds_only_the_rest(spark, tmp_path):
    store, at, log = ParquetCollections(spark, f"{tmp_path}/store"), f"{tmp_path}/ledger", tmp_path / "log"
    rows = [("a.md", "\n\n".join(f"# H{k}\n\ntext {k}" for k in range(12)))]
    run = lambda source, **k: pipeline.run(spark, *texts(spark, rows), PLAN, source, store, at, tokens="words", checkpoint=2, **k)
    with pytest.raises(Exception, match="no more"):
        run(Counting(log, 5))
    first = Counting(log).seen()
    assert 5 <= len(first) < 12 and not os.path.exists(f"{at}/_versions"), "the ledger comes last"
    kept = store.read("kb").count()
    assert 0 < kept <= len(first)
    # a failed run leaves what it stored; the next one embeds the rest only
    got = run(Counting(log))
    assert (got.embedded, got.resumed) == (12 - kept, kept) and len(Counting(log).seen()) - len(first) == 12 - kept
    assert store.read("kb").count() == 12 and run(Counting(log)).embedded == 0
    assert Progress(spark, f"{at}-jobs").target.read().count() == 0, "a finished job leaves no records"


def test_stop_between_batches(spark, tmp_path):
    store, at, log = ParquetCollections(spark, f"{tmp_path}/store"), f"{tmp_path}/ledger", tmp_path / "log"
    rows, told = [("a.md", "\n\n".join(f"# H{k}\n\ntext {k}" for k in range(8)))], []
    run = lambda **k: pipeline.run(spark, *texts(spark, rows), PLAN, Counting(log), store, at, tokens="words", checkpoint=2, tell=lambda *x: told.append(x), **k)
    with pytest.raises(Interrupted):
        run(stop=lambda: bool(told))
    done = len(Counting(log).seen())
    assert 0 < done < 8 and told == [(done, 8)]
    assert run().resumed == done and told[-1] == (8, 8)
    # force forgets what was stored
    rows[0] = ("a.md", rows[0][1] + " more")
    with pytest.raises(Interrupted):
        run(stop=lambda: True)
    assert run(force=True).embedded == 8


def test_another_job_isnt_resumed(spark, tmp_path):
    progress = Progress(spark, f"{tmp_path}/jobs")
    frame = lambda *rows: spark.createDataFrame(rows, "job_key string, chunk_id string, chunk_index int")
    progress.record(frame(("k", "b", 1), ("k", "a", 0)))
    progress.record(frame(("l", "z", 0), ("k", "b", 1)))
    stored = progress.read(frame(("k", None, None)))
    assert sorted(r["chunk_id"] for r in stored.collect()) == ["a", "b"]
    target = frame(("k", "c", 2), ("k", "b", 1), ("k", "a", 0))
    check_progress(stored, target)
    assert [r["completed_chunk_ids"] for r in completed(stored, target).collect()] == [["a", "b"]]
    with pytest.raises(IntegrityError):
        check_progress(stored, target.filter("chunk_id <> 'a'"))
    progress.forget(frame(("k", None, None)))
    assert [tuple(r) for r in progress.target.read().collect()] == [("l", "z")]


def test_sections_delivered_twice(spark):
    rows = [("a", 1, 7, k) for k in range(3)] * 2 + [("a", 1, 9, 0), ("a", None, 1, 0), ("a", 5, 1, 0), ("a", 5, 1, 1)]
    df = spark.createDataFrame(rows, "source_path string, section_index int, section_hash long, chunk_in_section int")
    got = sorted((r["chunk_index"], r["section_index"], r["section_hash"], r["chunk_in_section"]) for r in number_chunks(df).collect())
    assert got == [(0, None, 1, 0), (1, 1, 7, 0), (2, 1, 7, 1), (3, 1, 7, 2), (4, 1, 9, 0), (5, 5, 1, 0), (6, 5, 1, 1)]


def test_collections(spark, tmp_path):
    store = ParquetCollections(spark, str(tmp_path))
    assert store.describe("kb") is None
    with pytest.raises(CollectionError):
        store.read("kb")
    store.ensure("kb", 2)
    rows = spark.createDataFrame([("a", [1.0, 2.0], "x", "{}"), ("b", [1.0, 2.0], "y", "{}")], collection.ROWS)
    store.apply("kb", rows)
    store.apply("kb", rows.filter("chunk_id = 'a'").withColumn("content", F.lit("z")), rows.select("chunk_id"))
    assert [(r["chunk_id"], r["content"]) for r in store.read("kb").collect()] == [("a", "z")] and store.describe("kb") == {"dim": 2}
    with pytest.raises(IntegrityError):
        store.ensure("kb", 3)
    with pytest.raises(UserError):
        store.describe("../x")


def test_vector_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 2.5], 2), (2, [1.0], 2), (3, None, 2), (4, [1.0, float("nan")], 2), (5, [float("inf"), None], 2)], "i int, v array<float>, d int")
    got = {r["i"]: r["p"] for r in df.select("i", collection.vector_problem(F.col("v"), F.col("d")).alias("p")).collect()}
    assert got == {1: None, 2: "dimensions", 3: "missing", 4: "not finite", 5: "not finite"}
    one = df.filter("i = 1").select(collection.vector_literal(F.col("v"), 1).alias("l"), collection.point_uuid(F.lit("0123456789abcdef")).alias("u"), collection.sql_name(F.lit("a-b")).alias("n")).first()
    assert tuple(one) == ("[1.0,2.5]", "01234567-89ab-cdef-0123-456789abcdef", "a_b")
    meta = {"a": F.array(F.lit("x"), F.lit("y")), "n": F.lit(None).cast("string"), "o": F.struct(F.lit(1).alias("k")), "i": F.lit(3)}
    kinds = {"a": "array", "o": "object"}
    flat, listed = df.limit(1).select(collection.flat_metadata(meta, kinds), collection.listed_metadata(meta, kinds)).first()
    assert json.loads(flat) == {"a": "x/y", "o": '{"k":1}', "i": 3} and json.loads(listed)["a"] == ["x", "y"]


def test_embedding(spark):
    calls, waits = [], []

    class Slow(HashProvider):
        def embed(self, t, model):
            calls.append(len(t))
            if len(calls) == 1:
                raise ProviderError("busy", retryable=True, status=429)
            return super().embed(t, model)

    source = Slow(4)
    source.batch = 3
    got = embed_texts([f"w{i}" for i in range(10)], source, "m", 4, concurrency=1, wait=0)
    assert calls == [3, 3, 3, 3, 1] and got == HashProvider(4).embed([f"w{i}" for i in range(10)], "m")

    def fail():
        raise ProviderError("busy", retryable=True)

    with pytest.raises(ProviderError):
        with_retries(fail, 3, 0.5, waits.append)
    assert waits == [0.5, 1.0, 2.0]
    with pytest.raises(ProviderError):
        embed_texts(["a"], HashProvider(4), "m", 5)
    for name, key in (("none", "k"), ("openai", None)):
        with pytest.raises(UserError):
            provider(name, key)
    assert provider("openai", "k").dimensions("text-embedding-3-small") == 1536
    df = spark.createDataFrame([("a", "x y"), ("b", "")], "chunk_id string, text string")
    rows = embed_chunks(df, PROVIDER, "m").collect()
    assert all(len(r["vector"]) == r["dim"] == 8 and r["model"] == "m" for r in rows) and embed_chunks(df.limit(0), PROVIDER, "m").count() == 0


def test_export(spark, tmp_path):
    sections, _ = texts(spark, [("b.md", "# B\n\ntwo"), ("a.md", "# A\n\none\n\n# C\n\nthree")])
    chunks = chunk_sections(sections, PLAN, "words")
    out = f"{tmp_path}/v.jsonl"
    export.export_vectors(embed_chunks(chunks, PROVIDER, "m"), out, files=1)
    lines = [json.loads(x) for f in sorted(os.listdir(out)) if f.startswith("part") for x in open(f"{out}/{f}")]
    assert [(x["sourcePath"], x["text"]) for x in lines] == [("a.md", "# A\n\none"), ("a.md", "# C\n\nthree"), ("b.md", "# B\n\ntwo")]
    assert all(len(x["vector"]) == x["dimensions"] == 8 for x in lines) and os.listdir(tmp_path) == ["v.jsonl"]
    for call in (lambda: export.export_vectors(chunks, f"{tmp_path}/v.csv"), lambda: export.write_report(chunks, PLAN, f"{tmp_path}/r.md")):
        with pytest.raises(UserError):
            call()
    report = open(export.write_report(chunks, PLAN, f"{tmp_path}/r.txt")).read()
    os.symlink(f"{tmp_path}/r.txt", f"{tmp_path}/alias.txt")
    for target, given in ((f"{tmp_path}/r.txt", f"{tmp_path}/alias.txt"), (f"{tmp_path}/v.jsonl", f"{tmp_path}/v.jsonl/part")):
        with pytest.raises(UserError, match="overwrite"):
            export.check_target(target, [given])
    export.check_target(f"{tmp_path}/new.jsonl", [f"{tmp_path}/r.txt"])
    assert "Files: 2\nChunks: 3" in report and report.index("Source: a.md") < report.index("CHUNK 2 OF 2") < report.index("Source: b.md")
    cost = export.cost_summary(chunks, "text-embedding-3-small").first()
    assert cost["n_chunks"] == 3 and cost["shown"] == "<$0.0001" and export.cost_summary(chunks, "nobody").first()["shown"] == "unknown"


def test_stream(spark, tmp_path):
    store = ParquetCollections(spark, f"{tmp_path}/store")

    def step(rows):
        spark.createDataFrame(rows, SOURCE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = ingest(source_stream(spark, f"{tmp_path}/in"), PLAN, PROVIDER, store, f"{tmp_path}/ledger", f"{tmp_path}/checkpoint", tokens="words")
        q.awaitTermination()
        return sorted(r["content"] for r in store.read("kb").collect())

    assert step([("a.md", "# A\n\none", None), ("b.md", "# B\n\ntwo", None)]) == ["# A\n\none", "# B\n\ntwo"]
    assert step([("a.md", "# A\n\nnew", None)]) == ["# A\n\nnew", "# B\n\ntwo"]


def test_configuration(tmp_path):
    path = f"{tmp_path}/c/config.json"
    c = Config(path)
    c.set("apiKeys.openai", "sk-123456789")
    c.set("dbs.pgvector.url", "postgres://someone:secret@host/db")
    c.save()
    assert stat.S_IMODE(os.stat(path).st_mode) == 0o600
    assert Config(path).shown() == {"apiKeys.openai": "sk-1…6789", "dbs.pgvector.url": "postgres://so…:***@host/db"}
    assert mask_key("") == "(unset)" and mask_key("short") == "***" and mask_url("nonsense-text") == "nons…text"
    with pytest.raises(UserError):
        c.set("no.such", "x")
    got = resolve({"model": None}, {"SEDIMENTA_PROVIDER": "openai"}, Config(path))
    assert got["model"] == "text-embedding-3-small" and got["key"] == "sk-123456789"
    with open(path, "w") as f:
        f.write("[")
    with pytest.raises(UserError):
        Config(path)


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    import sedimenta.__main__ as cli

    monkeypatch.setattr(cli, "CONFIG", f"{tmp_path}/config.json")
    for name in ("OPENAI_API_KEY", "PINECONE_API_KEY", "DATABASE_URL"):
        monkeypatch.delenv(name, raising=False)
    (tmp_path / "a.md").write_text("# A\n\nx")
    assert cli.main(["plan", f"{tmp_path}/a.md", "--chunk-size", "99", "--metadata", "k=v"]) == 0
    assert json.loads(capsys.readouterr().out)["chunkSize"] == 99
    assert cli.main(["plan", f"{tmp_path}/a.md", "--out", f"{tmp_path}/plan.json"]) == 0 and json.load(open(f"{tmp_path}/plan.json"))["splitter"] == "markdown"
    assert cli.main(["plan", f"{tmp_path}/none.md"]) == 1 and cli.main(["init", "--provider", "openai", "--db", "pinecone"]) == 0 and cli.main(["config", "get", "defaults.provider"]) == 0
    assert "openai" in capsys.readouterr().out and cli.main(["providers"]) == 0
    assert cli.main(["check"]) == 1 and capsys.readouterr().out.count("set ") == 2 and cli.main(["check", "--provider", "hash", "--db", "parquet"]) == 0
    assert cli.main(["embed", f"{tmp_path}/a.md"]) == 1, "what is lacking is told before anything is read"
    work = ["--provider", "hash", "--db", "parquet", "--model", "m", "--tokens", "words", "--store", f"{tmp_path}/store"]
    (tmp_path / "b.txt").write_text("some words of a text")
    both = [f"{tmp_path}/a.md", f"{tmp_path}/b.txt"]
    assert cli.main(["embed", *both, *work, "--collection", "kb", "--dry-run"]) == 0 and not os.path.exists(f"{tmp_path}/store")
    assert "some words" in capsys.readouterr().out and cli.main(["embed", *both, *work, "--dry-run", "--force"]) == 1
    assert cli.main(["embed", *both, *work, "--collection", "kb", "--out", f"{tmp_path}/v.jsonl"]) == 0
    out = capsys.readouterr()
    assert "embedded=1" in out.out and "1/1" in out.err and os.path.isdir(f"{tmp_path}/v.jsonl")
    assert cli.main(["embed", *both, *work, "--collection", "kb"]) == 0 and "embedded=0" in capsys.readouterr().out
    (tmp_path / "in.jsonl").write_text("{}")
    assert cli.main(["embed", f"{tmp_path}/in.jsonl", *work, "--out", f"{tmp_path}/in.jsonl"]) == 1 and (tmp_path / "in.jsonl").read_text() == "{}"
    (tmp_path / "bad.jsonl").write_text("{")
    assert cli.main(["chunks", f"{tmp_path}/bad.jsonl", *work, "--out", f"{tmp_path}/c.txt"]) == 2 and "malformed JSON" in capsys.readouterr().err


def test_evaluation_from_files(spark, tmp_path, capsys, monkeypatch):
    import sedimenta.__main__ as cli

    monkeypatch.setattr(cli, "CONFIG", f"{tmp_path}/config.json")
    (tmp_path / "corpus").mkdir()
    (tmp_path / "corpus/keys.md").write_text("# Keys\n\nRotate keys every quarter.")
    (tmp_path / "corpus/ops.md").write_text("# Deploys\n\nRoll out on Mondays.")
    manifest = {"version": 1, "name": "small", "topK": 1, "baselineExperiment": "m", "experiments": [{"id": "m", "splitter": "markdown", "chunkSize": 80, "overlap": 0}], "thresholds": {"hitRate": 1.0}}
    (tmp_path / "manifest.json").write_text(json.dumps(manifest))
    queries = [{"id": "q", "text": "how often rotate keys", "relevant": [{"source": "keys.md", "contains": "every quarter"}]}]
    (tmp_path / "queries.json").write_text(json.dumps({"version": 1, "queries": queries}))
    call = ["eval", f"{tmp_path}/manifest.json", f"{tmp_path}/corpus", f"{tmp_path}/queries.json", "--out", f"{tmp_path}/out/result", "--tokens", "words"]
    assert cli.main(call) == 0
    assert json.load(open(f"{tmp_path}/out/result.json"))["ok"] and "small" in open(f"{tmp_path}/out/result.html").read() and len(os.listdir(f"{tmp_path}/out")) == 2
    (tmp_path / "queries.json").write_text("{}")
    assert cli.main(call) == 1


def test_planner(tmp_path, monkeypatch):
    from sedimenta.plans import planner

    (tmp_path / "a.md").write_text("# A " + "x" * 9000)
    answer = json.dumps({"splitter": "markdown", "chunkSize": 400, "overlap": 40, "collection": "kb", "metadata": {"a": "1", "b": "2"}})
    shapes = {"anthropic": {"content": [{"type": "text", "text": answer}]}, "openai": {"choices": [{"message": {"content": answer}}]}, "google": {"candidates": [{"content": {"parts": [{"text": answer}]}}]}}
    for name, reply in shapes.items():
        v = planner.vendor(name, "secret", planner.MODELS[name], "prompt")
        assert v.read(reply) == answer and "secret" in str(v.headers) and "secret" not in v.url and "prompt" in json.dumps(v.body)
    got = planner.proposed_plan(str(tmp_path / "a.md"), "m", lambda prompt: answer, {"b": "3"})
    assert (got.splitter, got.chunk_size, got.metadata) == ("markdown", 400, {"a": "1", "b": "3"}) and len(planner.head_of(str(tmp_path / "a.md"))) == 4096
    config = Config(str(tmp_path / "c.json"))
    assert planner.choose({"OPENAI_API_KEY": "o", "ANTHROPIC_API_KEY": "a"}, config) == ("anthropic", "a")
    assert planner.choose({"OPENAI_API_KEY": "o", "ANTHROPIC_API_KEY": "a", "SEDIMENTA_PLANNER": "openai"}, config) == ("openai", "o")
    for env, name in (({}, None), ({}, "openai"), ({"OPENAI_API_KEY": "o"}, "nobody")):
        with pytest.raises(UserError):
            planner.choose(env, config, name)
    config.set("apiKeys.google", "g")
    assert planner.choose({}, config) == ("google", "g")
    with pytest.raises(ProviderError):
        planner.asker("openai", "k", base="http://127.0.0.1:9", timeout=2)("x")


def test_shared_folder(spark):
    from sedimenta.session import materialise, release, shared_dir

    df = materialise(spark.range(5).toDF("a"), "t")
    assert sorted(r["a"] for r in df.collect()) == list(range(5)) and df.columns == ["a"]
    at = df.inputFiles()[0].removeprefix("file:").removeprefix("//")
    assert at.startswith(shared_dir(spark).removeprefix("file://")) and os.path.exists(at) and release(spark) >= 1
    assert not os.path.exists(at)


def test_every_revision_against_the_one_before(spark):
    specs = [("a", 1, "h", "p"), ("a", 2, "i", "p"), ("a", 5, "i", "p"), ("a", 5, "i", "p"), ("a", 6, "i", "q"), ("a", 7, "i", "q"), ("b", 3, "h", "p"), ("c", 1, None, "p"), ("c", 2, None, "p"), ("d", 1, "h", "p"), ("d", 1, "i", "p"), ("d", 2, "h", "p"), ("d", None, "h", "p")]
    got = ledger.unchanged_revisions(spark.createDataFrame(specs, "source_path string, revision int, source_hash string, plan_hash string"))
    assert sorted(map(tuple, got.collect())) == [("a", 5), ("a", 7)]


def test_upsert_of_every_point(spark, data):
    from sedimenta.plans.catalogue import QUERIES

    ids = {r[0] for r in spark.read.parquet(f"{data}/chunk_vectors.parquet").select("chunk_id").distinct().collect()}
    rows = [tuple(r) for r in QUERIES["vector_upsert"](spark, data).select("chunk_id", "content").collect()]
    assert len(rows) == len(ids) and {r[0] for r in rows} == ids and {r[1] for r in rows} == {"first", "second"}


def test_a_chunk_that_comes_and_goes_between_the_ends(spark, tmp_path):
    from sedimenta.plans.catalogue import QUERIES

    rows = [(n, "a", i, c, "2025-01-01") for n, c in ((1, "x"), (2, "y"), (5, "x")) for i in [0]]
    spark.createDataFrame(rows, "snapshot_no int, source_path string, chunk_index int, chunk_id string, loaded_at string").write.parquet(f"{tmp_path}/chunk_snapshots.parquet")
    got = lambda name, *columns: sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).select(*columns).collect()))
    assert got("chunk_diff", "snapshot_no", "chunk_id", "status") == [(2, "x", "removed"), (2, "y", "added"), (5, "x", "added"), (5, "y", "removed")]
    assert got("diff_counts", "snapshot_no", "added", "kept", "removed") == [(2, 1, 0, 1), (5, 1, 0, 1)]
    assert got("work_set", "snapshot_no", "chunk_id") == [(2, "y"), (5, "x")]
