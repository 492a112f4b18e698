"""The lane of cached vectors: what is usable of the cache, similarity to a probe, and what the cache still needs.

All JVM-side: vectors are arrays of doubles, cosines are folds over them. Defined results: lists that cannot be read,
of another length than `dimensions`, with a number that is not finite, or of zeros only are corrupt; vectors without a
record are orphans; a null hash is not stale; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """The cosine of two vectors of one length; each is scaled by its greatest number first, so no square overflows."""
    unit = lambda v: F.transform(v, lambda x: x / F.array_max(F.transform(v, F.abs)))
    x, y = unit(a), unit(b)
    return dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))


def probe_lane(ready: DataFrame, k: int) -> DataFrame:
    """The `k` vectors most similar to the first of each store and fingerprint: store_id, fingerprint, probe_no, vec_no, score, rank.

    `ready`: vec_no, store_id, path, fingerprint, v. One probe a lane, so work grows with the vectors; only
    similarities above 0 count, and equal ones are ordered by path and number.
    """
    keys = ["store_id", "fingerprint"]
    probe = ready.groupBy(*keys).agg(F.min_by(F.struct("vec_no", "v"), "vec_no").alias("p"))
    score = F.round(cosine(F.col("v"), F.col("p.v")), 9)
    scored = ready.join(probe, keys).where(F.col("vec_no") != F.col("p.vec_no")).withColumn("score", score).where(F.col("score") > 0)
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "path", "vec_no")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        *keys, F.col("p.vec_no").alias("probe_no"), "vec_no", F.round("score", 4).alias("score"), "rank"
    )


def status(states: DataFrame) -> DataFrame:
    """The state of each fingerprint's cache, the worst first: corrupt, stale, orphan, ready; with the counts."""
    n = lambda s: F.count_if(F.col("state") == s)
    ladder = F.when(n("corrupt") > 0, "corrupt").when(n("stale") > 0, "stale").when(n("orphan") > 0, "orphan").otherwise("ready")
    return states.groupBy("store_id", "fingerprint").agg(
        ladder.alias("status"), *[n(s).alias(f"{s}_rows") for s in ("corrupt", "stale", "orphan", "ready")]
    )
