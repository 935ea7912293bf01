"""Mixing sources to target weights.

Weights lie on the path ``target**(1 - t) * natural**t``: at t = 0 every source has its target share, at
t = 1 the share of its own tokens, which needs no repetition.  Without targets the natural shares are
exponentiated alone (``natural**t``).  The exponent is bisected to meet a wanted entropy or, for a given
budget, the limit of repetitions; without either the targets stay exact.  Where no budget is given it is
the largest that the limits allow.  Each source's budget is then realised as whole passes over its documents and
one partial pass over blocks of a pseudo-random permutation.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.llm.budget import document_tokens, label
from sedimenta.session import materialise

#: Blocks of a source's permutation; the partial pass is cut inside one of them, by a window over that block alone.
BLOCKS = 4096
#: Stretches of 0..1 that are searched for a wanted entropy.
STEPS = 256


def temper(natural: dict[str, float], exponent: float, target: dict[str, float] | None = None) -> dict[str, float]:
    """Normalised weights at ``exponent`` (see the module)."""
    raw = {s: (natural[s] ** exponent) * (target[s] ** (1 - exponent) if target else 1.0) for s in natural}
    total = sum(raw.values())
    return {s: w / total for s, w in raw.items()} if total else raw


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def _bisect(holds, low: float, high: float) -> float:
    """The end of the stretch, seen from ``high``, on which ``holds``."""
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if holds(mid) else (mid, high)
    return high


def exponent_for_entropy(natural: dict[str, float], wanted: float, target: dict[str, float] | None = None) -> float:
    """The smallest exponent in 0..1 found at which the weights' entropy is ``wanted``; the nearest if none is.  On the way from target to natural it may rise and fall."""
    at = [entropy(temper(natural, i / STEPS, target)) for i in range(STEPS + 1)]
    for i in range(STEPS):
        if min(at[i : i + 2]) <= wanted <= max(at[i : i + 2]):
            falling = at[i + 1] <= at[i]
            return _bisect(lambda t: (entropy(temper(natural, t, target)) <= wanted) == falling, i / STEPS, (i + 1) / STEPS)
    return min(range(STEPS + 1), key=lambda i: abs(at[i] - wanted)) / STEPS


def exponent_for_repeats(natural: dict[str, float], tokens: dict[str, int], repeats: dict[str, float], budget: float, target: dict[str, float] | None = None) -> float | None:
    """The smallest exponent at which no source needs more than its repetitions; None if even natural shares do."""
    fits = lambda t: all(w * budget <= tokens[s] * repeats[s] * (1 + 1e-12) for s, w in temper(natural, t, target).items())
    if fits(0.0):
        return 0.0
    return _bisect(fits, 0.0, 1.0) if fits(1.0) else None


def plan_mixture(tokens: dict[str, int], targets: dict[str, tuple[float, int]], budget: float | None = None, epochs: float | None = None, wanted_entropy: float | None = None) -> dict[str, float]:
    """Tokens wanted of each source.  Sources without tokens or with no positive share or repetition get none; the other shares are scaled up.

    ``epochs`` states the budget as a multiple of the tokens of the sources that get some.  A wanted
    entropy settles the weights, and a budget beyond what the limits allow at them is lowered.
    """
    usable = {s: t for s, t in targets.items() if tokens.get(s, 0) > 0 and (t[0] or 0) > 0 and (t[1] or 0) > 0}
    if not usable:
        return {}
    share = sum(t[0] for t in usable.values())
    target = {s: t[0] / share for s, t in usable.items()}
    total = sum(tokens[s] for s in usable)
    natural = {s: tokens[s] / total for s in usable}
    repeats = {s: float(t[1]) for s, t in usable.items()}
    if epochs is not None:
        budget = epochs * total
    if budget is None or wanted_entropy is not None:
        weights = target if wanted_entropy is None else temper(natural, exponent_for_entropy(natural, wanted_entropy, target), target)
        most = min(tokens[s] * repeats[s] / weights[s] for s in usable)
        budget = most if budget is None else min(budget, most)
    else:
        exponent = exponent_for_repeats(natural, tokens, repeats, budget, target)
        if exponent is None:
            exponent, budget = 1.0, min(budget, min(tokens[s] * repeats[s] / natural[s] for s in usable))
        weights = temper(natural, exponent, target)
    return {s: w * budget for s, w in weights.items()}


def mix_sources(docs: DataFrame, targets: DataFrame, budget: float | None = None, path: str | None = None, seed: int = 7, epochs: float | None = None, wanted_entropy: float | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """``doc_id, source, tokens, uses``: the documents of the mixture and how often each is used.

    A source's budget buys ``k`` whole passes and part of a further one, cut where the permutation of
    its documents has cost the rest: a document is taken if at least half of it still fits, so that a
    source misses its budget by at most half a document.  Uses never exceed max_repeats.  Labels are
    compared in their normalised spelling; of two targets that mean the same label the shares add up
    and the smaller limit holds.  Documents of sources without target, and those without tokens, are
    not used, nor are rows without doc_id; rows repeating a doc_id count once.  ``budget``, ``epochs``
    and ``wanted_entropy`` as of plan_mixture; ``sizes`` (doc_id, tokens) gives the sizes of documents
    where they are known already.
    """
    spark: SparkSession = docs.sparkSession
    once = docs.select("doc_id", "source", *(["text"] if sizes is None else [])).filter(F.col("doc_id").isNotNull())
    if not once.groupBy("doc_id").count().filter("count > 1").isEmpty():  # texts are only moved if an id really repeats
        once = once.dropDuplicates(["doc_id"])
    wanted = targets.select(label("source").alias("source"), "target_share", "max_repeats").groupBy("source").agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("repeats"))
    labelled = once.select("doc_id", label("source").alias("source")).join(wanted.select("source"), "source", "left_semi")
    rows = materialise(labelled.join(document_tokens(once, path) if sizes is None else sizes.select("doc_id", "tokens"), "doc_id").filter(F.col("tokens") > 0).select("doc_id", "source", "tokens"), "mixture")
    # one row per target on the driver: mix_targets is configuration
    limits = {r["source"]: (r["share"], r["repeats"]) for r in wanted.collect()}
    tokens = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    plan = plan_mixture(tokens, limits, budget, epochs, wanted_entropy)
    passes = {s: min(int(b // tokens[s]), limits[s][1]) for s, b in plan.items()}
    table = [(s, passes[s], float(b - passes[s] * tokens[s]) if passes[s] < limits[s][1] else 0.0) for s, b in plan.items()]
    shares = F.broadcast(spark.createDataFrame(table, "source string, passes int, rest double"))
    # a pseudo-random permutation that other engines can follow
    order = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(seed), "source", "doc_id")), 1, 15), 16, 10).cast("long")
    placed = rows.join(shares, "source").withColumn("order", order).withColumn("block", F.pmod("order", F.lit(BLOCKS)))
    blocks = placed.groupBy("source", "block").agg(F.sum("tokens").alias("cost"))
    before = F.sum("cost").over(Window.partitionBy("source").orderBy("block")) - F.col("cost")
    # at most BLOCKS rows per target
    starts = F.broadcast(blocks.select("source", "block", before.alias("start"), "cost"))
    placed = placed.join(starts, ["source", "block"])
    whole = F.col("start") + F.col("cost") <= F.col("rest")
    outside = placed.filter(whole | (F.col("start") >= F.col("rest"))).withColumn("more", whole.cast("int"))
    inside = placed.filter(~whole & (F.col("start") < F.col("rest")))
    spent = F.col("start") + F.sum("tokens").over(Window.partitionBy("source", "block").orderBy("order", "doc_id")) - F.col("tokens") / 2
    inside = inside.withColumn("more", (spent <= F.col("rest")).cast("int"))
    used = outside.unionByName(inside).select("doc_id", "source", "tokens", (F.col("passes") + F.col("more")).alias("uses"))
    return used.filter(F.col("uses") > 0)


def reached_shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, n_docs, n_tokens, reached_share, most_uses`` for every target, reached or not."""
    wanted = targets.select(label("source").alias("source"), "target_share").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    got = mixture.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("tokens") * F.col("uses")).alias("n_tokens"), F.max("uses").alias("most_uses"))
    # one row per target: a window over all of them is small
    rows = wanted.join(got, "source", "left").withColumn("all_tokens", F.sum("n_tokens").over(Window.partitionBy()))
    return rows.select(
        "source", "target_share", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
        F.round(F.coalesce(F.col("n_tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("reached_share"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
    )
