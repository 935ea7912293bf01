"""Looking up values by keys of which some are very frequent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many keys (some 60 bytes each) are broadcast with their values.
MOST = 300_000
#: Beyond, keys that make up more than this part of all rows are still broadcast (so at most its inverse of them).
FREQUENT = 1 / 10_000


def look_up(rows: DataFrame, values: DataFrame, key: str, times: str, most: int | None = None, frequent: float | None = None) -> DataFrame:
    """``rows`` left-joined with ``values`` on ``key``; ``times`` is the column of ``values`` that tells how often a key occurs.

    Few values are broadcast.  Of many, the frequent ones are, so that no key makes a hot group, and the
    rows that are left are joined by key.  ``values`` has each key once and is read several times, so
    hand over a written table; rows with a null key find nothing.
    """
    most, frequent = MOST if most is None else most, FREQUENT if frequent is None else frequent
    facts = values.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(times), F.lit(0)).alias("all")).head()
    if facts["n"] <= most:
        return rows.join(F.broadcast(values), key, "left")
    often = F.col(times) > frequent * facts["all"]
    hot, cold = values.filter(often), values.filter(~often)
    # which rows have a frequent key is told by the broadcast keys alone
    keys = F.broadcast(hot.select(key).withColumn("_hot", F.lit(True)))
    marked = rows.join(keys, key, "left")
    found = marked.filter("_hot").drop("_hot").join(F.broadcast(hot), key)
    return found.unionByName(marked.filter(F.col("_hot").isNull()).drop("_hot").join(cold, key, "left").select(*found.columns))
