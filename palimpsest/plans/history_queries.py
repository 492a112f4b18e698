"""p1: history of changing attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import history
from palimpsest.sources.tables import table


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    view = history.periods(history.satellite(table(spark, base, "revisions")))
    return view.select(
        "store_id", "memory_id", "valid_from_us", "valid_until_us", F.col("hash").alias("semantic_hash")
    ).dropDuplicates()


def p1_bookkeeping_versions(spark: SparkSession, base: str) -> DataFrame:
    view = history.periods(history.satellite(table(spark, base, "revisions"), "raw_hash"))
    return view.groupBy("store_id").agg(
        F.count("*").alias("versions"),
        F.sum(F.when(F.col("valid_until_us") == -1, 1).otherwise(0)).alias("open_versions"),
        F.sum(F.when(F.col("gap"), 1).otherwise(0)).alias("after_gap"),
    )


def p1_as_of(spark: SparkSession, base: str) -> DataFrame:
    """Versions valid at 2025-07-01T00:00:00Z, counted by store."""
    view = history.periods(history.satellite(table(spark, base, "revisions")))
    return (
        history.as_of(view, 1_751_328_000_000_000)
        .groupBy("store_id")
        .agg(F.count("*").alias("records"), F.max("valid_from_us").alias("latest_from_us"))
    )


def _versions_sql(col: str) -> str:
    return f"""
WITH p AS (
  SELECT store_id, memory_id, lower({col}) AS hash, revision, coalesce(unknown_gap, false) AS gap,
         CASE WHEN regexp_full_match(upper(trim(recorded_at)),
                '\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d(\\.\\d+)?(Z|[+-]\\d\\d:\\d\\d)')
              THEN epoch_us(try_cast(regexp_replace(upper(trim(recorded_at)), '(\\.\\d{{6}})\\d+', '\\1') AS TIMESTAMPTZ)) END AS at_us
  FROM revisions
), o AS (
  SELECT store_id, memory_id, at_us, hash, min(revision) AS revision, bool_or(gap) AS gap
  FROM p WHERE at_us IS NOT NULL AND hash IS NOT NULL AND hash <> '' GROUP BY ALL
), l AS (
  SELECT *, lag(hash) OVER (PARTITION BY store_id, memory_id ORDER BY at_us, revision NULLS FIRST, hash) AS prev FROM o
), s AS (SELECT * FROM l WHERE prev IS NULL OR prev <> hash OR gap),
v AS (
  SELECT store_id, memory_id, at_us AS valid_from_us,
         coalesce(lead(at_us) OVER (PARTITION BY store_id, memory_id ORDER BY at_us, revision NULLS FIRST, hash), -1) AS valid_until_us,
         hash, gap
  FROM s
)"""


QUERIES = {
    "p1_found": p1_found,
    "p1_bookkeeping_versions": p1_bookkeeping_versions,
    "p1_as_of": p1_as_of,
}

SQL = {
    "p1_found": _versions_sql("semantic_hash")
    + " SELECT DISTINCT store_id, memory_id, valid_from_us, valid_until_us, hash AS semantic_hash FROM v",
    "p1_bookkeeping_versions": _versions_sql("raw_hash")
    + """ SELECT store_id, count(*) AS versions, count(*) FILTER (valid_until_us = -1) AS open_versions,
  count(*) FILTER (gap) AS after_gap FROM v GROUP BY store_id""",
    "p1_as_of": _versions_sql("semantic_hash")
    + """ SELECT store_id, count(*) AS records, max(valid_from_us) AS latest_from_us FROM v
  WHERE valid_from_us <= 1751328000000000 AND (valid_until_us = -1 OR valid_until_us > 1751328000000000) GROUP BY store_id""",
}
