"""What changed between full snapshots of a keyed table.

Keys are bucketed into ranges of their hash.  The digests of the buckets are the leaves of one Merkle
tree per snapshot; trees of consecutive snapshots are compared from the root down, and rows are only
moved and compared within leaves whose digests differ.
"""

from __future__ import annotations

import json
import math
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.session import materialise

#: Rows of a snapshot that a leaf is to hold: few enough that most leaves stay as they are if few rows change.
LEAF_ROWS = 16
#: Leaves are ranges of 2**-bits of the hash space, at most so many bits; each inner node has 2**FAN_BITS children.
MOST_BITS, FAN_BITS = 40, 8
#: Up to so many differing leaves (12 bytes each) are broadcast.
BROADCAST_LEAVES = 1 << 20


def same_json(a: str, b: str) -> bool:
    """Whether two JSON texts denote the same value; texts that aren't JSON are compared as they are."""
    try:
        x, y = (json.loads(t, parse_float=Decimal, parse_int=Decimal) for t in (a, b))
    except (ValueError, RecursionError, ArithmeticError):
        return a == b
    stack = [(x, y)]
    while stack:
        p, q = stack.pop()
        if type(p) is not type(q):
            return False
        if isinstance(p, dict):
            if p.keys() != q.keys():
                return False
            stack += [(p[k], q[k]) for k in p]
        elif isinstance(p, list):
            if len(p) != len(q):
                return False
            stack += zip(p, q)
        elif p != q:
            return False
    return True


@F.arrow_udf(T.BooleanType())
def _same_json(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else same_json(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.bool_())


def _standing(rows: DataFrame, *also: str) -> DataFrame:
    """Per snapshot and key the row that stands for it; ``also``: columns that are the same for a snapshot's leaf."""
    return (
        rows.groupBy("snapshot", "source_path", "chunk_index", "leaf", *also)
        .agg(F.max(F.struct("loaded_at", "chunk_id", "meta_json")).alias("r"))
        .select("snapshot", "source_path", "chunk_index", "leaf", *also, "r.chunk_id", "r.meta_json")
    )


def leaf_bits_for(named: DataFrame) -> int:
    """Bits of the leaves, by the rows of the largest snapshot."""
    most = named.groupBy("snapshot").count().agg(F.max("count")).head()[0] or 1
    return max(1, min(MOST_BITS, math.ceil(math.log2(max(2, most / LEAF_ROWS)))))


def leaf_digests(named: DataFrame) -> DataFrame:
    """``snapshot, leaf, digest``: count, xor and sum of the hashes of the standing rows, independent of their order.

    Only hashes and times are moved, once.  Where rows of one key contend with equal times, which of
    them stands isn't told by hashes: the digest is then of its own, so that the rows are compared.
    """
    filled = [F.coalesce("source_path", F.lit("\0")), F.coalesce("chunk_index", F.lit(-1))]
    row = F.xxhash64(*filled, F.coalesce("chunk_id", F.lit("\0")), F.coalesce("meta_json", F.lit("\0")))
    light = named.select("snapshot", "leaf", F.xxhash64(*filled).alias("k1"), F.xxhash64(*filled[::-1], F.lit(1)).alias("k2"), "loaded_at", row.alias("row_hash")).repartition("snapshot", "leaf")
    latest = lambda c: F.max(F.struct("loaded_at", c.alias("h")))["h"]
    each = light.groupBy("snapshot", "leaf", "k1", "k2").agg(latest(F.col("row_hash")).alias("high"), latest(F.bitwise_not("row_hash")).alias("low"))
    own = F.when(F.col("high") == F.bitwise_not("low"), F.col("high")).otherwise(F.xxhash64("snapshot", "high", "low"))
    return each.select("snapshot", "leaf", own.alias("row_hash")).groupBy("snapshot", "leaf").agg(
        F.xxhash64(F.count(F.lit(1)), F.bit_xor("row_hash"), F.sum(F.col("row_hash").bitwiseAND(0xFFFFFFFF))).alias("digest"),
    )


def differing_leaves(leaves: DataFrame, order: DataFrame, leaf_bits: int) -> DataFrame:
    """``snapshot, leaf`` of the leaves that differ from those of the preceding snapshot.

    ``leaves``: snapshot, leaf, digest.  ``order``: snapshot, before.  Compares level by level; a node
    is only looked at if its parent differed.  A node missing on one side differs.
    """
    levels = [leaves.select("snapshot", F.col("leaf").alias("node"), "digest")]
    bits, steps = leaf_bits, []
    while bits > 0:
        step = min(FAN_BITS, bits)
        bits -= step
        steps.append(step)
        levels.append(
            levels[-1]
            .groupBy("snapshot", F.shiftright("node", step).alias("node"))
            .agg(F.xxhash64(F.bit_xor(F.xxhash64("node", "digest")), F.sum(F.xxhash64("digest", "node").bitwiseAND(0xFFFFFFFF))).alias("digest"))
        )
    differ, step = None, 0
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        now = level.join(order.select("snapshot"), "snapshot", "left_semi")
        before = level.join(order.select(F.col("before").alias("snapshot"), F.col("snapshot").alias("later")), "snapshot").select(F.col("later").alias("snapshot"), "node", F.col("digest").alias("was"))
        if differ is not None:
            parents = differ.select("snapshot", F.col("node").alias("parent"))
            now, before = (x.withColumn("parent", F.shiftright("node", step)).join(parents, ["snapshot", "parent"], "left_semi").drop("parent") for x in (now, before))
        differ = now.join(before, ["snapshot", "node"], "full_outer").filter(~F.col("digest").eqNullSafe(F.col("was"))).select("snapshot", "node")
        # how many bits the level below has more
        step = steps[k - 1] if k else 0
    return differ.withColumnRenamed("node", "leaf")


def snapshot_changes(snapshots: DataFrame, leaf_bits: int | None = None) -> DataFrame:
    """Keys added, removed or changed from each snapshot to the next: ``snapshot_no, source_path, chunk_index, change_kind``.

    Within a snapshot the row with the latest loaded_at stands for its key (null first; of equal times
    the largest chunk_id, then meta_json).  Changed means another chunk_id or metadata that isn't the
    same JSON value; null equals null only.  Rows without snapshot_no are left out; the first snapshot
    yields nothing.  Repeated rows change nothing.
    """
    named = snapshots.filter(F.col("snapshot_no").isNotNull()).select(F.col("snapshot_no").alias("snapshot"), "source_path", "chunk_index", "chunk_id", "meta_json", "loaded_at")
    bits = leaf_bits or leaf_bits_for(named)
    named = named.withColumn("leaf", F.shiftrightunsigned(F.xxhash64("source_path", "chunk_index"), 64 - bits))
    # digests are taken of the texts as written: other spelling of the same metadata only means that rows are compared
    leaves = materialise(leaf_digests(named), "leaves")
    numbers = leaves.select("snapshot").distinct()
    # one row per snapshot: a window without partition is small whatever the table holds
    order = numbers.withColumn("before", F.lag("snapshot").over(Window.orderBy("snapshot"))).filter(F.col("before").isNotNull())
    differ = materialise(differing_leaves(leaves, order, bits), "differing")
    if differ.count() <= BROADCAST_LEAVES:
        differ = F.broadcast(differ)
    # one row per snapshot
    around = F.broadcast(numbers.select("snapshot", F.lag("snapshot").over(Window.orderBy("snapshot")).alias("before"), F.lead("snapshot").over(Window.orderBy("snapshot")).alias("later")))
    here = differ.withColumn("here", F.lit(True))
    ahead = differ.select(F.col("snapshot").alias("later"), "leaf", F.lit(True).alias("ahead"))
    # a row matters if its leaf differs from the snapshot before or from the one behind
    near = named.join(around, "snapshot").join(here, ["snapshot", "leaf"], "left").join(ahead, ["later", "leaf"], "left").filter(F.col("here") | F.col("ahead"))
    # dealt out by key once: the rows of a key and of its snapshots stay together for all that follows
    kept = _standing(near.repartition("source_path", "chunk_index"), "before", "later", "here", "ahead")
    own = Window.partitionBy("source_path", "chunk_index").orderBy("snapshot")
    was = F.lag(F.struct("snapshot", "chunk_id", "meta_json")).over(own)
    pairs = kept.withColumn("was", was).withColumn("next", F.lead("snapshot").over(own))
    had = F.coalesce(F.col("was.snapshot") == F.col("before"), F.lit(False))
    open_ = F.col("here") & had & F.col("chunk_id").eqNullSafe(F.col("was.chunk_id")) & (F.col("meta_json") != F.col("was.meta_json"))
    judged = pairs.withColumn("same", _same_json(F.when(open_, F.col("meta_json")), F.when(open_, F.col("was.meta_json"))))
    kind = (
        F.when(F.col("before").isNull() | F.col("here").isNull(), None).when(~had, "added")
        .when(~F.col("chunk_id").eqNullSafe(F.col("was.chunk_id")), "changed")
        .when(F.col("meta_json").eqNullSafe(F.col("was.meta_json")) | F.col("same"), None).otherwise("changed")
    )
    gone = F.when(F.col("ahead") & F.col("later").isNotNull() & ~F.coalesce(F.col("next") == F.col("later"), F.lit(False)), "removed")
    events = F.array(F.struct(F.col("snapshot").alias("at"), kind.alias("kind")), F.struct(F.col("later").alias("at"), gone.alias("kind")))
    return (
        judged.select("source_path", F.col("chunk_index").cast("int").alias("chunk_index"), F.explode(events).alias("e"))
        .filter(F.col("e.kind").isNotNull())
        .select(F.col("e.at").cast("int").alias("snapshot_no"), "source_path", "chunk_index", F.col("e.kind").alias("change_kind"))
    )
