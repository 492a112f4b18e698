"""p3: stamps of mixed formats and zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import timestamps
from palimpsest.sources.tables import spread, table

FIELDS = ("created", "last_accessed", "expires")


def _stamps(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "memories").select("mem_no", "store_id", *FIELDS)
    return timestamps.normalise(spread(rows), FIELDS, table(spark, base, "stores"), ["mem_no", "store_id"])


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return _stamps(spark, base).select("mem_no", "field", "kind", "norm")


def p3_quality_by_store(spark: SparkSession, base: str) -> DataFrame:
    """How the stamps of each store came out, by field and kind."""
    return (
        _stamps(spark, base)
        .groupBy("store_id", "field", "kind")
        .agg(F.count("*").alias("stamps"), F.min("norm").alias("first_norm"), F.max("norm").alias("last_norm"))
    )


def p3_learnt_orders(spark: SparkSession, base: str) -> DataFrame:
    """The date order each store's own stamps tell, as if none were declared: its posterior against the other order.

    `order` is `open` where neither order has a posterior of `MIN_POSTERIOR`.
    """
    rows = table(spark, base, "memories").select("store_id", F.explode(F.array(*FIELDS)).alias("value"))
    stores = table(spark, base, "stores").select("store_id", F.lit(None).cast("string").alias("date_order"))
    read = timestamps.parts(spread(rows.where(F.col("value").rlike(timestamps.NUMERIC))), "value")
    weights = timestamps.fit(read, stores, "store_id")
    m, d, b = F.col("weights")[0], F.col("weights")[1], F.col("weights")[6]
    shares = weights.select("store_id", (m / (m + d + b)).alias("m"), (d / (m + d + b)).alias("d"))
    least = timestamps.MIN_POSTERIOR
    order = F.when(F.col("m") >= least, "mdy").when(F.col("d") >= least, "dmy").otherwise("open")
    return shares.select("store_id", order.alias("order"), F.round("m", 5).alias("mdy"), F.round("d", 5).alias("dmy"))


_DAYS = """CASE WHEN {m} IN (1, 3, 5, 7, 8, 10, 12) THEN 31 WHEN {m} IN (4, 6, 9, 11) THEN 30
  WHEN y % 4 = 0 AND (y % 100 <> 0 OR y % 400 = 0) THEN 29 ELSE 28 END"""
_CALENDAR = "y >= 1 AND {m} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND " + _DAYS
_ORDERS = rf"""
WITH RECURSIVE v AS (SELECT store_id, trim(unnest([created, last_accessed, expires]), ' ' || chr(9) || chr(10) || chr(13)) AS v FROM memories),
g AS (SELECT store_id, regexp_extract(v, '^(\d{{1,2}})(?:/(\d{{1,2}})/|-(\d{{1,2}})-|\.(\d{{1,2}})\.)(\d{{4}})(?:$|[ T,])', ['a', 's', 'h', 'p', 'y']) AS x FROM v
  WHERE regexp_matches(v, '^(\d{{1,2}})(?:/(\d{{1,2}})/|-(\d{{1,2}})-|\.(\d{{1,2}})\.)(\d{{4}})(?:$|[ T,])')),
n AS (SELECT store_id, CAST(x.a AS INT) AS a, CAST(x.s || x.h || x.p AS INT) AS b, CAST(x.y AS INT) AS y FROM g),
r AS (SELECT store_id, {_CALENDAR.format(m='a', d='b')} AS m, {_CALENDAR.format(m='b', d='a')} AS d FROM n),
c AS (SELECT store_id, CAST(count(*) FILTER (m AND NOT d) AS DOUBLE) AS nm, CAST(count(*) FILTER (d AND NOT m) AS DOUBLE) AS nd,
  CAST(count(*) FILTER (m AND d) AS DOUBLE) AS nb FROM r GROUP BY store_id),
em AS (SELECT store_id, nm, nd, nb, 0 AS i, 1e0 AS m, 1e0 AS d, 1e0 AS x FROM c
  UNION ALL SELECT store_id, nm, nd, nb, i + 1,
    {timestamps.SMOOTH} + nm * m / (m + x * {timestamps.BROKEN}) + nb * m / (m + d + x * {timestamps.BROKEN}),
    {timestamps.SMOOTH} + nd * d / (d + x * {timestamps.BROKEN}) + nb * d / (m + d + x * {timestamps.BROKEN}),
    {timestamps.SMOOTH} + nm * x * {timestamps.BROKEN} / (m + x * {timestamps.BROKEN}) + nd * x * {timestamps.BROKEN} / (d + x * {timestamps.BROKEN})
      + nb * x * {timestamps.BROKEN} / (m + d + x * {timestamps.BROKEN})
  FROM em WHERE i < {timestamps.ROUNDS}),
p AS (SELECT store_id, m / (m + d + x * {timestamps.BROKEN}) AS m, d / (m + d + x * {timestamps.BROKEN}) AS d FROM em WHERE i = {timestamps.ROUNDS})
SELECT store_id, CASE WHEN m >= {timestamps.MIN_POSTERIOR} THEN 'mdy' WHEN d >= {timestamps.MIN_POSTERIOR} THEN 'dmy' ELSE 'open' END AS "order",
  round(m, 5) AS mdy, round(d, 5) AS dmy FROM p"""

QUERIES = {"p3_found": p3_found, "p3_quality_by_store": p3_quality_by_store, "p3_learnt_orders": p3_learnt_orders}
SQL: dict[str, str] = {"p3_learnt_orders": _ORDERS}
