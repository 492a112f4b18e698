"""Stream and file-format queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources import markdown
from palimpsest.sources.tables import table
from palimpsest.streaming import turns as st


def stream_activity(spark: SparkSession, base: str) -> DataFrame:
    """Turns per host and week of arrival (null: not known), from a stream over the turns' files."""
    return st.all_activity(st.stream_table(spark, base, "turns")).select(
        F.unix_micros("window_from").alias("from_us"), "host", "turns", "chars"
    )


def stream_turns_once(spark: SparkSession, base: str) -> DataFrame:
    """Turns per transcript without deliveries repeated within 48 hours, from a stream."""
    once = st.all_delivered_once(st.stream_table(spark, base, "turns"))
    return once.groupBy("transcript").agg(F.count("*").alias("turns"))


def markdown_round_trip(spark: SparkSession, base: str) -> DataFrame:
    """Records written as Markdown and read again, counted by whether all fields came back."""
    m = table(spark, base, "memories")
    names = [n for n, _ in markdown.FIELDS]
    back = markdown.decode(m.select("mem_no", "store_id", F.struct(*names, "body").alias("was"), markdown.encode(m).alias("content")))
    same = F.coalesce("was.body", F.lit("")).eqNullSafe(F.col("body"))
    for n in names:
        same = same & F.col(f"was.{n}").eqNullSafe(F.col(n))
    return back.groupBy("store_id").agg(F.count("*").alias("records"), F.count_if(same).alias("unchanged"))


QUERIES = {
    "stream_activity": stream_activity,
    "stream_turns_once": stream_turns_once,
    "markdown_round_trip": markdown_round_trip,
}
SQL = {
    "markdown_round_trip": "SELECT store_id, count(*) AS records, count(*) AS unchanged FROM memories GROUP BY store_id",
    "stream_activity": """
SELECT CAST(floor(epoch_us(received_at) / 604800000000) AS BIGINT) * 604800000000 AS from_us, coalesce(host, '') AS host, count(*) AS turns,
  CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars FROM turns GROUP BY ALL""",
    "stream_turns_once": """
WITH g AS (SELECT transcript, ord, role, sha256(coalesce(text, '')) AS h, list_sort(list(DISTINCT epoch_us(received_at)) FILTER (received_at IS NOT NULL)) AS seen FROM turns GROUP BY ALL),
k AS (SELECT transcript, CASE WHEN seen IS NULL OR len(seen) = 0 THEN 1
  ELSE len(list_reduce(seen, lambda kept, x: CASE WHEN x - kept[-1] >= 172800000000 THEN list_append(kept, x) ELSE kept END, [seen[1]])) END AS n
  FROM (SELECT transcript, ord, role, h, seen FROM g))
SELECT transcript, CAST(sum(n) AS BIGINT) AS turns FROM k GROUP BY transcript""",
}
