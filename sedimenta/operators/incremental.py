"""Processing only new or changed records, with the target itself as the state.

Every output row of a target carries the key and version of the source row it came from.  A run
anti-joins the source against those columns, so that a record is taken exactly if the target doesn't
show it yet, and publishes the next version of the target by one marker file that only one publisher can
create.  A run that dies before that leaves the published version untouched; the next run sees the same
state and takes the same records again, none skipped and none repeated.

A version is a list of layers.  A run writes one new layer, of the rows it made and the keys it
settled; rows of a key in older layers no longer count.  What is written is in proportion to what
changed: beyond a few layers, one is merged with the one below it once it has half its rows.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sedimenta.errors import IntegrityError
from sedimenta.session import materialise, scratch

VERSIONS = "_versions"
#: Layers that are kept side by side before they are merged.
LAYERS = 4
#: Seconds for which files that no kept version names may still be in use by a reader or a publisher.
GRACE = 24 * 3600.0


class VersionedTarget:
    """A table in a folder of immutable layers; ``_versions/N.json`` names the layers of version N, the highest N counts.

    ``read`` of a target that was never published gives None.  Publishing writes all files first and
    then moves the marker of the next number into place, which fails if that number is taken: of two
    publishers that started from one version the second gets an IntegrityError and has changed nothing.
    (The file system's rename must not replace files, as that of HDFS and of local file systems; a store
    without such a rename needs a single publisher.)
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._Path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(self._conf)

    # -- versions -------------------------------------------------------------------------------
    def _numbers(self) -> list[int]:
        at = self._Path(f"{self.path}/{VERSIONS}")
        if not self._fs.exists(at):
            return []
        names = (f.getPath().getName() for f in self._fs.listStatus(at))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _marker(self, number: int) -> dict:
        stream = self._fs.open(self._Path(f"{self.path}/{VERSIONS}/{number:020d}.json"))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def current(self) -> dict | None:
        """The newest version: ``version`` and ``layers``, the oldest first."""
        numbers = self._numbers()
        return self._marker(numbers[-1]) if numbers else None

    @property
    def version(self) -> int | None:
        numbers = self._numbers()
        return numbers[-1] if numbers else None

    def read(self) -> DataFrame | None:
        now = self.current()
        return None if now is None else self._rows(now["layers"], now["keys"])

    def layer(self, number: int) -> DataFrame:
        """The rows that version ``number`` brought."""
        return self.part(self._marker(number)["added"], "rows")

    def part(self, layer: dict, name: str = "rows") -> DataFrame:
        """The rows, or the settled keys, of one layer."""
        return self.spark.read.parquet(f"{self.path}/{layer['folder']}/{name}")

    def _rows(self, layers: list[dict], keys: list[str]) -> DataFrame:
        """The rows of the layers: those of each whose key no later layer settled."""
        out = settled = None
        for layer in reversed(layers):
            rows = self.part(layer, "rows")
            if settled is not None:
                rows = unseen(rows, settled, keys).select(*rows.columns)
            out = rows if out is None else rows.unionByName(out)
            if layer is not layers[0]:
                own = self.part(layer, "keys")
                settled = own if settled is None else settled.unionByName(own)
        return out

    # -- publishing -----------------------------------------------------------------------------
    def _write(self, rows: DataFrame, keys: DataFrame | None) -> dict:
        layer = {"folder": f"layer-{uuid.uuid4().hex}"}
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.path}/{layer['folder']}/rows")
        if keys is not None:
            keys.distinct().write.parquet(f"{self.path}/{layer['folder']}/keys")
        layer["rows"] = seen.get.get("n") or 0  # only tells when layers are merged
        return layer

    def _publish(self, layers: list[dict], keys: list[str], added: dict, based_on: int | None) -> int:
        number = (based_on or 0) + 1
        folder = f"{self.path}/{VERSIONS}"
        self._fs.mkdirs(self._Path(folder))
        if self.version != based_on:
            raise IntegrityError(f"target moved from version {based_on} to {self.version} during the run")
        fresh, marker = self._Path(f"{folder}/.{uuid.uuid4().hex}"), self._Path(f"{folder}/{number:020d}.json")
        out = self._fs.create(fresh, False)
        out.write(bytearray(json.dumps({"version": number, "layers": layers, "keys": keys, "added": added}).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fresh, marker, none)  # one step; fails if the marker is there
        except Exception as e:
            self._fs.delete(fresh, False)
            if self._fs.exists(marker):
                raise IntegrityError(f"target moved on from version {based_on} during the run") from None
            raise e
        return number

    def publish(self, df: DataFrame, based_on: int | None) -> int:
        """Publish ``df`` in place of all that is there; ``based_on`` is the version that the caller saw."""
        layer = self._write(df, None)
        return self._publish([layer], [], layer, based_on)

    def publish_changes(self, rows: DataFrame, settled: DataFrame, keys: list[str], based_on: int | None) -> int:
        """Publish ``rows`` in place of all rows of the ``settled`` keys; null keys match each other.

        Keys of ``rows`` need not be settled, then rows are added.  Layers of a target must share their keys.
        """
        now = self.current() if based_on is not None else None
        if (now or {}).get("version") != based_on:
            raise IntegrityError(f"target moved from version {based_on} during the run")
        if now is not None and now["keys"] not in ([], keys):
            raise IntegrityError(f"the target is keyed by {now['keys']}, not by {keys}")
        added = self._write(rows, settled.select(*keys))
        layers = [*(now["layers"] if now else []), added]
        while len(layers) > LAYERS and 2 * layers[-1]["rows"] >= layers[-2]["rows"]:
            below, above = layers[-2:]
            whole = len(layers) == 2
            merged = self._rows(layers[-2:] if not whole else layers, keys)
            both = None if whole else self.part(below, "keys").unionByName(self.part(above, "keys"))
            layers[-2:] = [self._write(merged, both)]
        return self._publish(layers, keys, added, based_on)

    def expire(self, keep: int = 2, grace: float = GRACE) -> int:
        """Remove the files that none of the newest ``keep`` versions names and that are older than ``grace`` seconds; returns how many layers."""
        numbers = self._numbers()
        named: set[str] = set()
        for n in numbers[-keep:]:
            marker = self._marker(n)
            named |= {layer["folder"] for layer in [*marker["layers"], marker["added"]]}
        before, removed = (time.time() - grace) * 1000, 0
        for n in numbers[:-keep]:
            self._fs.delete(self._Path(f"{self.path}/{VERSIONS}/{n:020d}.json"), False)
        if self._fs.exists(self._Path(self.path)):
            for f in self._fs.listStatus(self._Path(self.path)):
                name = f.getPath().getName()
                if name.startswith("layer-") and name not in named and f.getModificationTime() <= before:
                    self._fs.delete(f.getPath(), True)
                    removed += 1
        return removed


def unseen(source: DataFrame, state: DataFrame | None, keys: list[str], covered: Column | None = None) -> DataFrame:
    """Rows of ``source`` that no row of ``state`` covers.

    Rows match on ``keys`` (null keys match each other); ``covered`` is a further condition over the
    aliases ``s`` (source) and ``t`` (state).  No state at all means that every row is unseen.
    """
    if state is None:
        return source
    on = [F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    return source.alias("s").join(state.alias("t"), on + ([covered] if covered is not None else []), "left_anti")


def run_increment(spark: SparkSession, target: VersionedTarget, source: DataFrame, keys: list[str], version: str, transform: Callable[[DataFrame], DataFrame], covered: Column | None = None) -> int:
    """Bring the target up to date with ``source``; returns the number of the published version.

    ``transform`` maps source rows to output rows and must keep ``keys`` and ``version``.  Per key the
    source row of the highest version counts (repeated rows once).  Output rows of a key whose version
    grew replace the older ones; a run without news publishes nothing.  Null keys match each other; a
    null version is below every other, so that such a row is taken only while its key isn't in the
    target.  ``covered``: further condition over ``s`` and ``t`` under which a row is no news.
    """
    at = target.version
    state = target.read() if at is not None else None
    newest = source.groupBy(*keys).agg(F.max(version).alias(version))
    on = [F.col(f"s.{c}").eqNullSafe(F.col(f"n.{c}")) for c in [*keys, version]]
    rows = source.alias("s").join(newest.alias("n"), on, "left_semi").dropDuplicates([*keys, version])
    shown = F.col(f"s.{version}").isNull() | F.coalesce(F.col(f"t.{version}") >= F.col(f"s.{version}"), F.lit(False))
    # looked at, transformed and settled: worked out once
    fresh = materialise(unseen(rows, state, keys, shown if covered is None else shown | covered), "fresh")
    if at is not None and fresh.isEmpty():
        return at
    return target.publish_changes(transform(fresh), fresh.select(*keys), keys, at)


def _latest(specs: DataFrame, columns: list[str]) -> DataFrame:
    """Per source_path the spec of the highest revision, of equal revisions the smallest job_id."""
    best = F.max_by(F.struct(*columns), F.struct(F.col("revision"), -F.col("job_id")))
    return specs.groupBy("source_path").agg(best.alias("x")).select("source_path", *[F.col(f"x.{c}").alias(c) for c in columns])


def outstanding_chunks(specs: DataFrame, runs: DataFrame) -> DataFrame:
    """Chunk ids the next run has to upsert or delete: ``source_path, chunk_id, op``.

    A batch is done if one of its attempts succeeded.  The processed state is the newest spec of a
    path in done batches, the pending one the newest in all others (a null batch_no is not done).
    A pending spec is covered, and yields nothing, if the state's revision is at least as high (a null
    revision is below every other) or if source_hash and plan_hash are both the same.  Upserts already committed under the same job_key by
    an unfinished batch are left out.  Null lists are empty, null and repeated ids count not at all
    and once; specs delivered twice change nothing.

    The state is a target below the shared folder whose rows carry key (source_path) and version
    (revision); the pending specs are run against it, and the result is what the new version brought.
    """
    spark = specs.sparkSession
    done = runs.filter(F.col("status") == "succeeded").select("batch_no").distinct()
    wanted = specs.select("job_id", "batch_no", "job_key", "source_path", "revision", "source_hash", "plan_hash", "target_chunk_ids", "removed_chunk_ids", "completed_chunk_ids")
    finished = wanted.join(done, "batch_no", "left_semi")
    open_ = wanted.join(done, "batch_no", "left_anti")
    hashes = ["source_path", "revision", "source_hash", "plan_hash"]
    nothing = [F.lit(None).cast("string").alias(c) for c in ("chunk_id", "op")]
    target = VersionedTarget(spark, scratch(spark, "outstanding"))
    at = target.publish(_latest(finished, hashes[1:]).select(*hashes, *nothing), None)
    committed = open_.select("job_key", F.explode("completed_chunk_ids").alias("chunk_id")).distinct().withColumn("op", F.lit("upsert"))

    def ids(news: DataFrame) -> DataFrame:
        ops = F.array(
            F.struct(F.lit("upsert").alias("op"), F.col("target_chunk_ids").alias("ids")),
            F.struct(F.lit("delete").alias("op"), F.col("removed_chunk_ids").alias("ids")),
        )
        todo = news.select(*hashes, "job_key", F.explode(ops).alias("o")).select(*hashes, "job_key", "o.op", F.explode("o.ids").alias("chunk_id")).filter(F.col("chunk_id").isNotNull())
        return unseen(todo, committed, ["job_key", "chunk_id", "op"]).select(*hashes, "chunk_id", "op").distinct()

    pending = _latest(open_, [*hashes[1:], "job_key", "target_chunk_ids", "removed_chunk_ids"])
    same = F.col("s.source_hash").eqNullSafe(F.col("t.source_hash")) & F.col("s.plan_hash").eqNullSafe(F.col("t.plan_hash"))
    number = run_increment(spark, target, pending, ["source_path"], "revision", ids, same)
    if number == at:
        return spark.createDataFrame([], "source_path string, chunk_id string, op string")
    return target.layer(number).select("source_path", "chunk_id", "op")
