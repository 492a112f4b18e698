"""Queries of transcript formats, findings and incremental reading, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import SPACE
from palimpsest.operators import findings
from palimpsest.operators import turns as tn
from palimpsest.sources import transcripts
from palimpsest.sources.tables import spread, table

#: What had been read before the last reading.
READ_UNTIL = "2025-06-01"
#: The types of findings that are taken.
TYPES = ("pitfall", "codebase", "arch_decision", "preference", "session_summary")

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


_STRIP = rf"'^[{SPACE}]+|[{SPACE}]+$', '', 'g'"


@_query(rf"""
WITH t AS (SELECT transcript, ascii(right(transcript, 1)) % 5 AS f, role, text FROM turns WHERE role IN ('user', 'assistant') AND text IS NOT NULL),
x AS (SELECT transcript, role, ['claude-jsonl', 'codex-jsonl', 'grok-jsonl', 'role-jsonl', 'text'][f + 1] AS format,
  CASE WHEN f < 4 THEN regexp_replace(text, {_STRIP}) ELSE regexp_replace(text, '[\r\n]+', ' ', 'g') END AS x FROM t)
SELECT format, role, count(DISTINCT transcript) AS transcripts, count(*) AS turns, CAST(sum(length(x)) AS BIGINT) AS chars FROM x
WHERE regexp_replace(x, {_STRIP}) <> '' GROUP BY ALL""")
def transcript_formats(spark: SparkSession, base: str) -> DataFrame:
    """All transcripts written in the five formats and read again: turns and characters by format and role."""
    rows = table(spark, base, "turns").where(F.col("role").isin("user", "assistant") & F.col("text").isNotNull())
    named = F.element_at(F.array(*[F.lit(f) for f in transcripts.FORMATS]), F.ascii(F.substring("transcript", -1, 1)) % 5 + 1)
    lines = rows.select("transcript", F.col("turn_no").alias("line_no"), transcripts.encode(rows, named).alias("line"))
    return transcripts.turns(lines).groupBy("format", "role").agg(
        F.countDistinct("transcript").alias("transcripts"), F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars")
    )


@_query(rf"""
WITH t AS (SELECT transcript, ord, turn_no, role, regexp_replace(coalesce(text, ''), {_STRIP}) AS x FROM turns),
k AS (SELECT *, lower(x) AS l, regexp_extract(lower(x), '{tn.ERROR}') AS e, regexp_extract(lower(x), '{tn.FIX}') AS f FROM t),
c AS (SELECT transcript, ord, turn_no, left(x, 60) AS title, CASE
  WHEN role = 'user' AND length(x) <= 200 AND regexp_matches(l, '{tn.PREFERENCE.replace("'", "''")}') THEN 'preference'
  WHEN role = 'assistant' AND length(x) <= 280 AND NOT regexp_matches(x, '{tn.STEP}') AND e <> '' AND f <> ''
    AND abs(strpos(l, e) - strpos(l, f)) <= 50 THEN 'pitfall' END AS kind FROM k)
SELECT transcript, turn_no, kind, CASE WHEN kind = 'preference' THEN 65 ELSE 75 END AS importance, title FROM (
  SELECT *, row_number() OVER (PARTITION BY transcript ORDER BY ord, turn_no) AS n FROM c WHERE kind IS NOT NULL) WHERE n <= 5""")
def transcript_findings(spark: SparkSession, base: str) -> DataFrame:
    """The first findings of each transcript by the wording of its turns."""
    return tn.findings(table(spark, base, "turns"))


_PREFIX = """SELECT transcript, (place - 1) // {b} AS block, count(*) AS n,
  sha256(string_agg(sha256(coalesce(role, '') || chr(0) || coalesce(text, '')), '' ORDER BY place)) AS b FROM {t} GROUP BY ALL"""


@_query(f"""
WITH now AS (SELECT *, row_number() OVER (PARTITION BY transcript ORDER BY ord, turn_no) AS place FROM turns),
was AS (SELECT *, row_number() OVER (PARTITION BY transcript ORDER BY ord, turn_no) AS place FROM turns WHERE received_at < TIMESTAMPTZ '{READ_UNTIL} 00:00:00+00'),
wb AS ({_PREFIX.format(b=tn.BLOCK, t='was')}),
wd AS (SELECT transcript, CAST(sum(n) AS BIGINT) AS known, sha256(string_agg(b, '' ORDER BY block)) AS d FROM wb GROUP BY transcript),
np AS (SELECT now.* FROM now JOIN wd USING (transcript) WHERE place <= known),
nb AS ({_PREFIX.format(b=tn.BLOCK, t='np')}),
nd AS (SELECT transcript, sha256(string_agg(b, '' ORDER BY block)) AS d FROM nb GROUP BY transcript)
SELECT t.transcript, coalesce(known, 0) AS known, turns, CASE WHEN wd.d = nd.d THEN known ELSE 0 END AS resume_at
FROM (SELECT transcript, count(*) AS turns FROM turns GROUP BY transcript) t LEFT JOIN wd USING (transcript) LEFT JOIN nd USING (transcript)""")
def transcript_resume(spark: SparkSession, base: str) -> DataFrame:
    """Where reading each transcript goes on after the last reading, if what was read then is still its beginning."""
    t = table(spark, base, "turns")
    return tn.resume_points(t.where(F.col("received_at") < F.lit(f"{READ_UNTIL}T00:00:00Z").cast("timestamp")), t)


_TYPES = ", ".join(f"'{t}'" for t in TYPES)


@_query(f"""
WITH f AS (SELECT store_id, type, left(regexp_replace(canonical_summary, {_STRIP}), 80) AS title, regexp_replace(body, {_STRIP}) AS content,
  greatest(0, least(100, strength * 2 - 40)) AS importance, left(regexp_replace(coalesce(injection_summary, ''), {_STRIP}), 200) AS evidence
  FROM memories WHERE type IN ({_TYPES}))
SELECT store_id, type, count(*) AS findings, CAST(sum(coalesce(importance, 50)) AS BIGINT) AS importance, CAST(sum(length(title)) AS BIGINT) AS title_chars,
  CAST(sum(length(content)) AS BIGINT) AS content_chars, CAST(sum(length(evidence)) AS BIGINT) AS evidence_chars
FROM f WHERE title <> '' AND content <> '' GROUP BY ALL""")
def findings_parsed(spark: SparkSession, base: str) -> DataFrame:
    """Records handed in as findings inside a text, read again: their number, importance and lengths by store and type."""
    m = spread(table(spark, base, "memories").select("store_id", "type", "canonical_summary", "injection_summary", "body", "strength"))
    one = F.struct(
        "type", F.col("canonical_summary").alias("title"), F.col("body").alias("content"),
        (F.col("strength") * 2 - 40).cast("string").alias("importance"), F.col("injection_summary").alias("evidence"),
    )
    texts = m.select("store_id", F.concat(F.lit("Found:\n"), F.to_json(F.array(one)), F.lit("\nDone.")).alias("text"))
    return findings.parsed(texts, "text", TYPES).groupBy("store_id", "type").agg(
        F.count("*").alias("findings"),
        F.sum("importance").alias("importance"),
        F.sum(F.length("title")).alias("title_chars"),
        F.sum(F.length("content")).alias("content_chars"),
        F.sum(F.length("evidence")).alias("evidence_chars"),
    )


@_query(SQL["findings_parsed"].replace("regexp_replace(canonical_summary,", "regexp_replace(regexp_replace(canonical_summary, '[\\r\\n]+', ' ', 'g'),").replace(
    "regexp_replace(body,", "regexp_replace(regexp_replace(body, '[\\r\\n]+', ' ', 'g'),").replace("regexp_replace(coalesce(injection_summary, ''),", "regexp_replace(regexp_replace(coalesce(injection_summary, ''), '[\\r\\n]+', ' ', 'g'),"))
def findings_blocks(spark: SparkSession, base: str) -> DataFrame:
    """Records handed in as Markdown blocks of findings, with more behind the end of a block, read again: as `findings_parsed`."""
    flat = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " ")
    m = spread(table(spark, base, "memories").select("store_id", "type", "canonical_summary", "injection_summary", "body", "strength"))
    one = F.concat(
        F.lit("- type: "), F.coalesce("type", F.lit("")), F.lit("\n- title: "), flat("canonical_summary"), F.lit("\n- importance: "),
        F.coalesce((F.col("strength") * 2 - 40).cast("string"), F.lit("")), F.lit("\n- evidence: "), flat("injection_summary"), F.lit("\n- content: |\n    "), flat("body"), F.lit("\n"),
    )
    texts = m.select("store_id", F.concat(F.lit("Notes.\n**Findings:**\n"), one, F.lit("- type: nothing\n**End**\n"), one).alias("text"))
    return findings.parsed_blocks(texts, "text", TYPES).groupBy("store_id", "type").agg(
        F.count("*").alias("findings"),
        F.sum("importance").alias("importance"),
        F.sum(F.length("title")).alias("title_chars"),
        F.sum(F.length("content")).alias("content_chars"),
        F.sum(F.length("evidence")).alias("evidence_chars"),
    )
