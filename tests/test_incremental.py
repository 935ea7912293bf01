import pytest
from pyspark.sql import functions as F

from sedimenta.errors import IntegrityError
from sedimenta.operators import incremental
from sedimenta.operators.incremental import VersionedTarget, outstanding_chunks, run_increment

SPECS = "job_id long, batch_no int, job_key string, source_path string, revision int, source_hash string, plan_hash string, target_chunk_ids array<string>, removed_chunk_ids array<string>, completed_chunk_ids array<string>, source string, op string"
RUNS = "run_id long, batch_no int, attempt_no int, status string, op string"


def found(spark, specs, runs):
    rows = [(*s, "extra", "extra") for s in specs]
    df = outstanding_chunks(spark.createDataFrame(rows, SPECS), spark.createDataFrame([(*r, "extra") for r in runs], RUNS))
    return sorted(tuple(r) for r in df.collect())


def test_cases(spark):
    runs = [(1, 1, 1, "failed"), (2, 1, 2, "succeeded"), (2, 1, 2, "succeeded"), (3, 2, 1, "failed")]
    done = (1, 1, "k1", "a", 1, "h1", "p", ["x"], None, ["x"])
    assert found(spark, [done], runs) == []
    new = (2, 2, "k2", "a", 2, "h2", "p", ["y", "y", None, "z"], ["x"], ["z"])
    assert found(spark, [done, new, new], runs) == [("a", "x", "delete"), ("a", "y", "upsert")]
    # neither an older revision nor one that changes nothing is a case
    assert found(spark, [done, (2, 2, "k2", "a", 1, "h2", "p", ["y"], ["x"], None)], runs) == []
    assert found(spark, [done, (2, 2, "k2", "a", 2, "h1", "p", ["y"], ["x"], None)], runs) == []
    # no state at all; a batch that nobody attempted, and one without number, aren't done
    assert found(spark, [(3, 9, "k3", "b", 1, None, None, ["q"], None, None)], runs) == [("b", "q", "upsert")]
    assert found(spark, [(3, None, "k3", None, 1, None, None, ["q"], None, None)], runs) == [(None, "q", "upsert")]
    # of equal revisions the smallest job counts; what another row of the job had committed is left out
    twin = [(5, 2, "k5", "c", 3, "h", "p", ["m", "n"], [], None), (6, 4, "k6", "c", 3, "h9", "p", ["o"], [], None), (7, 2, "k5", "d", 1, "h", "p", [], [], ["m"])]
    assert found(spark, twin, runs) == [("c", "n", "upsert")]


def test_empty(spark):
    assert found(spark, [], []) == []
    assert found(spark, [], [(1, 1, 1, "succeeded")]) == []


def test_versions(spark, tmp_path):
    t = VersionedTarget(spark, f"{tmp_path}/t")
    assert t.read() is None and t.current() is None
    one = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("b", 1, "y")], "key string, version int, v string")
    keep = lambda df: df.withColumn("v", F.upper("v"))
    assert run_increment(spark, t, one, ["key"], "version", keep) == 1
    assert run_increment(spark, t, one, ["key"], "version", keep) == 1, "nothing new publishes nothing"
    two = one.union(spark.createDataFrame([("a", 3, "z"), ("a", 2, "w"), ("c", 1, "n")], one.schema))
    assert run_increment(spark, t, two, ["key"], "version", keep) == 2
    assert sorted(map(tuple, t.read().collect())) == [("a", 3, "Z"), ("b", 1, "Y"), ("c", 1, "N")]


def test_failure_leaves_the_published_version(spark, tmp_path):
    t = VersionedTarget(spark, f"{tmp_path}/t")
    one = spark.createDataFrame([("a", 1)], "key string, version int")
    run_increment(spark, t, one, ["key"], "version", lambda df: df)

    def broken(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        run_increment(spark, t, spark.createDataFrame([("a", 2)], one.schema), ["key"], "version", broken)
    assert t.current()["version"] == 1
    with pytest.raises(IntegrityError):
        t.publish(one, None)
    assert [tuple(r) for r in t.read().collect()] == [("a", 1)]


def test_null_keys_and_versions(spark, tmp_path):
    t = VersionedTarget(spark, f"{tmp_path}/t")
    schema = "a string, b string, version int, v string"
    run = lambda *rows: run_increment(spark, t, spark.createDataFrame(rows, schema), ["a", "b"], "version", lambda df: df)
    one = [(None, "x", 1, "old"), (None, "x", 2, "new"), ("k", None, None, "none"), ("k", None, None, "none"), ("k", "x", None, "none"), ("k", "x", 1, "one")]
    assert run(*one) == 1
    assert sorted(map(tuple, t.read().collect()), key=repr) == [("k", "x", 1, "one"), ("k", None, None, "none"), (None, "x", 2, "new")]
    assert run(*one) == 1, "nothing new publishes nothing"
    assert run(*one, ("k", None, 0, "zero"), ("k", "x", None, "late")) == 2
    assert sorted(map(tuple, t.read().collect()), key=repr) == [("k", "x", 1, "one"), ("k", None, 0, "zero"), (None, "x", 2, "new")]


def bytes_below(path):
    return sum(f.stat().st_size for f in path.rglob("*") if f.is_file())


def test_an_increment_writes_in_proportion(spark, tmp_path):
    t = VersionedTarget(spark, f"{tmp_path}/t")
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("key"), F.lit(1).alias("version"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    same = lambda df: df
    run_increment(spark, t, rows, ["key"], "version", same)
    before = bytes_below(tmp_path)
    change = rows.filter("cast(key as int) % 2000 = 0")
    for n in range(2, 6):
        run_increment(spark, t, rows.unionByName(change.withColumn("version", F.lit(n))), ["key"], "version", same)
        assert t.version == n and t.read().count() == 20_000 and t.read().filter(F.col("version") == n).count() == 10
    assert bytes_below(tmp_path) - before < 0.1 * before, "not a fifth of the target for each ten rows"
    assert len(t.current()["layers"]) <= incremental.LAYERS, "small layers are merged"
    assert t.layer(5).count() == 10


@pytest.mark.parametrize("layers", (1, 4))
def test_changes_and_deletions(spark, tmp_path, monkeypatch, layers):
    monkeypatch.setattr(incremental, "LAYERS", layers)
    t = VersionedTarget(spark, f"{tmp_path}/t")
    make = lambda *rows: spark.createDataFrame(rows, "k string, n int")
    shown = lambda: sorted(map(tuple, t.read().collect()), key=repr)
    model = {}
    import random

    rng = random.Random(5)
    for step in range(9):
        rows = {rng.choice("abcdefgh") if rng.random() > 0.1 else None: step for _ in range(rng.randint(0, 3 if step else 8))}
        gone = {rng.choice("abcdefgh") for _ in range(rng.randint(0, 2))}
        for k in gone:
            model.pop(k, None)
        model |= rows
        t.publish_changes(make(*rows.items()), make(*[(k, 0) for k in {*rows, *gone}]), ["k"], t.version)
        assert shown() == sorted(model.items(), key=repr)
    with pytest.raises(IntegrityError):
        t.publish_changes(make(("a", 1)), make(("a", 1)), ["n"], t.version)
    t.publish(make(("z", 1)), t.version)
    assert shown() == [("z", 1)]


def test_two_publishers(spark, tmp_path):
    one, two = VersionedTarget(spark, f"{tmp_path}/t"), VersionedTarget(spark, f"{tmp_path}/t")
    rows = spark.createDataFrame([("a", 1)], "k string, n int")
    assert one.publish(rows, None) == 1
    layer = two._write(rows.withColumn("n", F.lit(2)), rows.select("k"))
    assert one.publish_changes(rows.withColumn("n", F.lit(3)), rows.select("k"), ["k"], 1) == 2
    # the second passes its own check of the version and still can't take the number
    type(two).version, known = property(lambda self: 1), VersionedTarget.version
    try:
        with pytest.raises(IntegrityError):
            two._publish([layer], ["k"], layer, 1)
    finally:
        VersionedTarget.version = known
    assert one.version == 2 and [tuple(r) for r in two.read().collect()] == [("a", 3)]
    assert not [p for p in (tmp_path / "t" / "_versions").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_expiry(spark, tmp_path):
    t = VersionedTarget(spark, f"{tmp_path}/t")
    for n in range(4):
        t.publish(spark.createDataFrame([("a", n)], "k string, n int"), t.version)
    assert t.expire(keep=2) == 0, "files may still be in use"
    for n in range(4, 6):
        t.publish(spark.createDataFrame([("a", n)], "k string, n int"), t.version)
    assert t.expire(keep=2, grace=-5) >= 2 and [tuple(r) for r in t.read().collect()] == [("a", 5)] and t._numbers() == [5, 6]


def test_null_revisions(spark):
    done = (1, 1, "k1", "a", 1, "h1", "p", ["x"], None, ["x"])
    assert found(spark, [done, (2, 2, "k2", "a", None, "h2", "p", ["y"], None, None)], [(1, 1, 1, "succeeded")]) == []
    assert found(spark, [(2, 2, "k2", "a", None, "h2", "p", ["y"], None, None)], []) == [("a", "y", "upsert")]
