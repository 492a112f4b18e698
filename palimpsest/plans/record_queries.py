"""Queries of record upkeep: manifests, expiry rules, dependents, applicability, consolidation, history checks; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators import graph, history, records
from palimpsest.operators.running import placed
from palimpsest.plans import core_queries as core
from palimpsest.plans.history_queries import _versions_sql
from palimpsest.sources.tables import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@_query("""
WITH f AS (SELECT store_id, path, sha256(coalesce(body, '')) AS h, mem_no, coalesce(archived, false) AS archived FROM memories WHERE path IS NOT NULL),
l AS (SELECT store_id, path, arg_min(h, mem_no) AS listed FROM f GROUP BY ALL),
d AS (SELECT store_id, path, arg_max(h, mem_no) AS held FROM f WHERE NOT archived GROUP BY ALL)
SELECT store_id, CASE WHEN held IS NULL THEN 'missing' WHEN listed IS NULL THEN 'unlisted' WHEN held = listed THEN 'same' ELSE 'changed' END AS state,
  count(*) AS files FROM l FULL JOIN d USING (store_id, path) GROUP BY ALL""")
def manifest_differences(spark: SparkSession, base: str) -> DataFrame:
    """Files as first loaded, the manifest, against the open files as loaded last."""
    m = table(spark, base, "memories").where("path is not null")
    f = m.select("store_id", "path", F.sha2(F.coalesce("body", F.lit("")), 256).alias("h"), "mem_no", F.coalesce("archived", F.lit(False)).alias("archived"))
    listed = f.groupBy("store_id", "path").agg(F.min_by("h", "mem_no").alias("print"))
    held = f.where(~F.col("archived")).groupBy("store_id", "path").agg(F.max_by("h", "mem_no").alias("print"))
    return records.manifest_states(listed, held).groupBy("store_id", "state").agg(F.count("*").alias("files"))


@_query(rf"""
WITH e AS (SELECT store_id, coalesce(expires, '') AS x, regexp_replace(coalesce(expires, ''), '^[{tx.SPACE}]+|[{tx.SPACE}]+$', '', 'g') AS t FROM memories),
d AS (SELECT store_id, CASE WHEN regexp_full_match(x, '\d{{4}}-\d{{2}}-\d{{2}}') THEN try_cast(x AS DATE) END AS plain,
  CASE WHEN regexp_full_match(t, '\d{{4}}-\d{{2}}-\d{{2}}') THEN try_cast(t AS DATE) END AS trimmed FROM e)
SELECT store_id, count(*) FILTER (plain < DATE '{core.DAY}') AS expired_exactly, count(*) FILTER (trimmed < DATE '{core.DAY}') AS expired_trimmed,
  count(*) FILTER (plain < DATE '{core.DAY}' + 1) AS expired_a_day_on FROM d GROUP BY store_id""")
def expiry_rules(spark: SparkSession, base: str) -> DataFrame:
    """Records expired by the three rules: the value as it stands, without blanks around it, and on a later zone's day."""
    day = F.lit(core.DAY).cast("date")
    plain, trimmed = F.col("expires"), tx.stripped(F.col("expires"))
    return table(spark, base, "memories").groupBy("store_id").agg(
        F.count_if(tx.expired(plain, day)).alias("expired_exactly"),
        F.count_if(tx.expired(trimmed, day)).alias("expired_trimmed"),
        F.count_if(tx.expired(plain, F.date_add(day, 1))).alias("expired_a_day_on"),
    )


@_query(f"""
WITH {core._LINKS}, t AS (SELECT DISTINCT id FROM memories WHERE status = 'superseded' AND id IS NOT NULL)
SELECT store_id, rel, count(*) AS dependents FROM (SELECT DISTINCT store_id, mem_no, rel FROM links
  WHERE target IN (SELECT id FROM t) AND id NOT IN (SELECT id FROM t)) GROUP BY ALL""")
def dependents(spark: SparkSession, base: str) -> DataFrame:
    """Records that link to a superseded one and are none themselves, by store and relation."""
    m = table(spark, base, "memories")
    targets = m.where("status = 'superseded' and id is not null").select("id").distinct()
    return graph.dependents(graph.links(m), targets).groupBy("store_id", "rel").agg(F.count("*").alias("dependents"))


@_query("""
WITH l AS (SELECT coalesce(role, '') AS role, list_sort(list(length(coalesce(text, '')))) AS v, count(*) AS n FROM turns GROUP BY ALL)
SELECT role, n AS turns, v[CAST(1 + round((n - 1) * 0.5) AS BIGINT)] AS p50, v[CAST(1 + round((n - 1) * 0.95) AS BIGINT)] AS p95,
  v[CAST(1 + least(n - 1, floor(n * 0.95)) AS BIGINT)] AS p95_indexed FROM l""")
def length_percentiles(spark: SparkSession, base: str) -> DataFrame:
    """Lengths of turns at two percentile rules, exactly, from counts by length: no role is ordered in one task."""
    t = table(spark, base, "turns").groupBy(F.coalesce("role", F.lit("")).alias("role"), F.length(F.coalesce("text", F.lit(""))).alias("v"))
    n = F.col("n")
    places = {
        "p50": F.round((n - 1) * 0.5),
        "p95": F.round((n - 1) * 0.95),
        "p95_indexed": F.least(n - 1, F.floor(n * 0.95)),
    }
    return records.values_at(t.agg(F.count("*").alias("c")), "role", "v", "c", places).withColumnRenamed("n", "turns")


def _paths(c: str) -> str:
    return f"list_distinct(regexp_extract_all({c}, '{core._PATH}'))"


@_query(f"""
WITH m AS (SELECT mem_no, type, {_paths("coalesce(body, '')")} AS paths FROM memories),
w AS (SELECT DISTINCT unnest({_paths('text')}) AS path FROM documents WHERE text IS NOT NULL),
p AS (SELECT mem_no, count(*) AS declared, count(w.path) AS present FROM (SELECT mem_no, unnest(paths) AS path FROM m) LEFT JOIN w USING (path) GROUP BY mem_no)
SELECT type, CASE WHEN declared IS NULL THEN 'unknown' WHEN present = declared THEN 'applicable' ELSE 'not_applicable' END AS applicability,
  CASE WHEN declared IS NULL THEN 'no_path_declared' WHEN present = declared THEN 'all_paths_present' WHEN present = 0 THEN 'no_path_present' ELSE 'path_missing' END AS reason,
  count(*) AS records FROM m LEFT JOIN p USING (mem_no) GROUP BY ALL""")
def applicability(spark: SparkSession, base: str) -> DataFrame:
    """Whether the paths a record declares are still there (in the documents): applicable, not, or unknown, and why."""
    found = lambda c: F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(f"({core._PATH})"), 1))
    m = table(spark, base, "memories").select("mem_no", "type", found(F.col("body")).alias("paths"))
    there = table(spark, base, "documents").where("text is not null").select(F.explode(found(F.col("text"))).alias("path")).distinct()
    return records.applicability(m, "mem_no", "paths", there).groupBy("type", "applicability", "reason").agg(F.count("*").alias("records"))


@_query(f"""
WITH m AS (SELECT DISTINCT mem_no, unnest({_paths('body')}) AS path FROM memories WHERE body IS NOT NULL),
d AS (SELECT DISTINCT unnest({_paths('text')}) AS path FROM documents WHERE text IS NOT NULL),
u AS (SELECT path, count(*) AS records FROM m GROUP BY path),
t AS (SELECT path, records, path IN (SELECT path FROM d) AS exact,
  split_part(path, '/', 1) IN (SELECT split_part(path, '/', 1) FROM d) AS folder, split_part(path, '/', 2) IN (SELECT split_part(path, '/', 2) FROM d) AS name FROM u)
SELECT CASE WHEN exact THEN 1 WHEN folder AND name THEN 2 WHEN folder THEN 3 WHEN name THEN 4 ELSE 5 END AS tier, count(*) AS paths, CAST(sum(records) AS BIGINT) AS records
FROM t GROUP BY ALL""")
def path_tiers(spark: SparkSession, base: str) -> DataFrame:
    """Paths of records by how documents mention them: 1 the path, 2 its folder and its file name, 3 the folder, 4 the name, 5 neither."""
    found = lambda c: F.array_distinct(F.regexp_extract_all(F.col(c), F.lit(f"({core._PATH})"), 1))
    m = table(spark, base, "memories").where("body is not null").select(F.explode(found("body")).alias("path"))
    used = m.groupBy("path").agg(F.count("*").alias("records"))
    there = table(spark, base, "documents").where("text is not null").select(F.explode(found("text")).alias("path")).distinct()
    return records.path_tiers(used, there).groupBy("tier").agg(F.count("*").alias("paths"), F.sum("records").alias("records"))


@_query("""
SELECT store_id, mem_no, strength, CAST(place AS INT) AS place FROM (SELECT store_id, mem_no, strength,
  row_number() OVER (PARTITION BY store_id ORDER BY last_accessed DESC NULLS LAST, path, mem_no) AS place FROM memories) WHERE place <= 3""")
def latest_records(spark: SparkSession, base: str) -> DataFrame:
    """The three records of each store whose stamp of last access comes last as written."""
    w = Window.partitionBy("store_id").orderBy(F.col("last_accessed").desc_nulls_last(), "path", "mem_no")
    m = table(spark, base, "memories").select("store_id", "mem_no", "strength", "last_accessed", "path")
    return m.withColumn("place", F.row_number().over(w)).where("place <= 3").select("store_id", "mem_no", "strength", "place")


@_query(
    _versions_sql("semantic_hash")
    + f""", r AS (SELECT store_id, memory_id, arg_min(reason, rev_row) AS first_reason FROM revisions GROUP BY ALL),
x AS (SELECT store_id, memory_id, max(hash) FILTER (valid_from_us <= {core.INSTANT_US} AND (valid_until_us = -1 OR valid_until_us > {core.INSTANT_US})) AS at_hash,
  max(valid_until_us) FILTER (valid_from_us <= {core.INSTANT_US} AND valid_until_us > {core.INSTANT_US}) AS ends,
  coalesce(bool_or(valid_until_us = -1 AND valid_from_us <= {core.INSTANT_US}), false) AS last FROM v GROUP BY ALL),
g AS (SELECT DISTINCT store_id, memory_id, valid_from_us AS ends, true AS unseen FROM v WHERE gap),
k AS (SELECT DISTINCT store_id, id AS memory_id FROM memories WHERE id IS NOT NULL AND NOT coalesce(archived, false)),
a AS (SELECT coalesce(k.store_id, x.store_id) AS store_id, x.memory_id IS NULL AS no_history, at_hash, coalesce(unseen, false) AS unseen, last, first_reason, k.memory_id IS NULL AS vanished
  FROM k FULL JOIN x ON k.store_id = x.store_id AND k.memory_id = x.memory_id LEFT JOIN r ON r.store_id = x.store_id AND r.memory_id = x.memory_id
  LEFT JOIN g ON g.store_id = x.store_id AND g.memory_id = x.memory_id AND g.ends = x.ends)
SELECT store_id, CASE WHEN no_history THEN 'no_recorded_history' WHEN at_hash IS NULL AND first_reason <> 'created' THEN 'before_coverage_start'
  WHEN at_hash IS NULL THEN 'not_yet_created' WHEN unseen THEN 'unobserved_edits' WHEN last AND vanished THEN 'vanished_after_last_observation' ELSE 'complete' END AS reason,
  count(*) AS records FROM a GROUP BY ALL"""
)
def coverage_reasons(spark: SparkSession, base: str) -> DataFrame:
    """Why the state of a record at an instant is not fully known, by store."""
    revisions = table(spark, base, "revisions")
    first = revisions.groupBy("store_id", "memory_id").agg(F.min_by("reason", "rev_row").alias("first_reason"))
    m = table(spark, base, "memories").where(F.col("id").isNotNull() & ~F.coalesce("archived", F.lit(False)))
    known = m.select("store_id", F.col("id").alias("memory_id")).distinct()
    found = history.coverage(history.periods(history.satellite(revisions)), first, known, core.INSTANT_US)
    return found.groupBy("store_id", "reason").agg(F.count("*").alias("records"))


@_query("""
WITH d AS (SELECT DISTINCT store_id, memory_id, revision FROM revisions WHERE revision IS NOT NULL),
g AS (SELECT store_id, memory_id, count(*) AS n, min(revision) AS lo, max(revision) AS hi FROM d GROUP BY ALL)
SELECT store_id, count(*) AS records, count(*) FILTER (lo <> 1) AS not_from_one, count(*) FILTER (hi - lo + 1 <> n) AS with_missing_numbers,
  CAST(sum(hi - lo + 1 - n) AS BIGINT) AS missing_numbers FROM g GROUP BY store_id""")
def numbering_faults(spark: SparkSession, base: str) -> DataFrame:
    """Histories whose revisions are not numbered from one without a gap. Counts only, so no history is ordered."""
    r = table(spark, base, "revisions").where("revision is not null").select("store_id", "memory_id", "revision").distinct()
    one = r.groupBy("store_id", "memory_id").agg(F.count("*").alias("n"), F.min("revision").alias("lo"), F.max("revision").alias("hi"))
    missing = F.col("hi") - F.col("lo") + 1 - F.col("n")
    return one.groupBy("store_id").agg(
        F.count("*").alias("records"),
        F.count_if(F.col("lo") != 1).alias("not_from_one"),
        F.count_if(missing != 0).alias("with_missing_numbers"),
        F.sum(missing).alias("missing_numbers"),
    )


@_query(f"""
WITH m AS (SELECT store_id, type, list_sort(list_distinct({core._tokens('body')})) AS tk, min(mem_no) AS mem_no, count(*) AS copies FROM memories
  WHERE {core._ELIGIBLE} AND body IS NOT NULL AND type IS NOT NULL GROUP BY store_id, type, tk),
p AS (SELECT a.store_id, a.mem_no AS keep_no, b.mem_no AS candidate_no, len(list_intersect(a.tk, b.tk)) AS s, len(a.tk) AS x, len(b.tk) AS y
  FROM m a JOIN m b ON a.store_id = b.store_id AND a.type = b.type AND a.mem_no < b.mem_no AND len(a.tk) > 0 AND len(b.tk) > 0
    AND len(a.tk) >= 0.8 * len(b.tk) AND len(b.tk) >= 0.8 * len(a.tk))
SELECT store_id, keep_no, candidate_no, round(s / (x + y - s), 6) AS similarity FROM p WHERE s >= 0.8 * (x + y - s)""")
def consolidation_pairs(spark: SparkSession, base: str) -> DataFrame:
    """Open records of one store and type whose bodies share 0.8 of their tokens, one record for each set of tokens."""
    m = core._eligible(table(spark, base, "memories")).where("body is not null and type is not null")
    tokens = F.array_sort(F.array_distinct(tx.tokens(F.col("body"))))
    sets = spread(m.select("store_id", "type", "mem_no", "body"), "mem_no").groupBy("store_id", "type", tokens.alias("tokens")).agg(F.min("mem_no").alias("no"))
    pairs = records.token_pairs(sets, ["store_id", "type"], 0.8)
    return pairs.select("store_id", F.col("a").alias("keep_no"), F.col("b").alias("candidate_no"), F.round("similarity", 6).alias("similarity"))


@_query(f"""
WITH t AS (SELECT transcript, ord, turn_no, {core._estimate("coalesce(text, '')")} AS e FROM turns),
o AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY transcript ORDER BY ord, turn_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM t)
SELECT transcript, CAST(off // 4000 AS BIGINT) AS chunk, count(*) AS turns, CAST(sum(e) AS BIGINT) AS tokens FROM o GROUP BY ALL""")
def transcript_chunks(spark: SparkSession, base: str) -> DataFrame:
    """Chunks of some 4,000 estimated tokens of each transcript, in order, however long it is."""
    t = table(spark, base, "turns")
    e = t.select("transcript", "ord", "turn_no", tx.token_estimate(F.coalesce("text", F.lit(""))).alias("e"))
    p = placed(e, ["transcript"], [F.col("ord"), F.col("turn_no")], F.col("e"))
    return p.groupBy("transcript", F.floor(F.col("before") / 4000).alias("chunk")).agg(F.count("*").alias("turns"), F.sum("e").alias("tokens"))


@_query(f"""
WITH m AS (SELECT mem_no, store_id, id, type, sha256(coalesce(body, chr(0))) AS h, {core._ELIGIBLE} AS active FROM memories WHERE id IS NOT NULL),
f AS (SELECT store_id, id, min(mem_no) AS first_no, arg_min(h, mem_no) AS first_h FROM m GROUP BY ALL),
a AS (SELECT store_id, type, h, min(mem_no) AS before FROM m WHERE active GROUP BY ALL)
SELECT m.store_id, CASE WHEN m.mem_no <> first_no THEN CASE WHEN m.h = first_h THEN 'duplicate' ELSE 'conflict' END
  WHEN before < m.mem_no THEN 'supported' ELSE 'created' END AS verdict, count(*) AS records
FROM m JOIN f ON m.store_id = f.store_id AND m.id = f.id
LEFT JOIN a ON m.store_id = a.store_id AND m.type IS NOT DISTINCT FROM a.type AND m.h = a.h GROUP BY ALL""")
def write_classes(spark: SparkSession, base: str) -> DataFrame:
    """Records in order of arrival: created, in support of an active one that says the same, repeated, or in conflict."""
    m = table(spark, base, "memories").where("id is not null")
    gone = tx.expired(F.col("expires"), F.lit(core.DAY).cast("date"))
    active = ~F.coalesce("archived", F.lit(False)) & (F.coalesce("status", F.lit("")) != "superseded") & ~gone
    rows = m.select("mem_no", "store_id", "id", "type", F.sha2(F.coalesce("body", F.lit(chr(0))), 256).alias("h"), active.alias("live"))
    out = records.write_classes(rows, ["store_id", "id"], ["store_id", "type", "h"], F.col("h"), "mem_no", F.col("live"))
    return out.groupBy("store_id", "verdict").agg(F.count("*").alias("records"))


@_query(f"""
WITH m AS (SELECT store_id, path, {core._SEARCH_TEXT} AS t FROM memories WHERE path IS NOT NULL),
x AS (SELECT store_id, path, count(DISTINCT sha256(t)) AS v, bool_or(trim(t) <> '') AS f FROM m GROUP BY ALL),
c AS (SELECT DISTINCT store_id, path, fingerprint, 1 AS c FROM vectors WHERE coalesce(content_hash, 'stale') <> 'stale'),
s AS (SELECT p.fingerprint, CASE WHEN c IS NOT NULL THEN 'current' WHEN NOT f THEN 'invalid' WHEN v > 1 THEN 'skipped_stale' ELSE 'written' END AS s
  FROM x CROSS JOIN (SELECT DISTINCT fingerprint FROM vectors) p LEFT JOIN c ON c.store_id = x.store_id AND c.path = x.path AND c.fingerprint = p.fingerprint)
SELECT fingerprint, count(*) FILTER (s = 'written') AS written, count(*) FILTER (s = 'skipped_stale') AS skipped_stale,
  count(*) FILTER (s = 'invalid') AS invalid, count(*) FILTER (s = 'current') AS current FROM s GROUP BY fingerprint""")
def backfill_counts(spark: SparkSession, base: str) -> DataFrame:
    """What filling the vector cache would do, by fingerprint."""
    return records.backfill(records.with_search_text(table(spark, base, "memories")), table(spark, base, "vectors"))


@_query(f"""
WITH m AS (SELECT mem_no, sha256(concat_ws(chr(31), store_id, coalesce(type, chr(0)), coalesce(CASE WHEN trim(source) <> '' THEN lower(trim(source)) END, 'agent'),
  coalesce(body, chr(0)), coalesce(expires, ''), array_to_string(coalesce(tags, []), ','))) AS d FROM memories WHERE {core._ELIGIBLE}),
c AS (SELECT d, min(mem_no) AS keep_no, count(*) AS copies FROM m GROUP BY d HAVING count(*) > 1)
SELECT keep_no, copies FROM c""")
def live_duplicates(spark: SparkSession, base: str) -> DataFrame:
    """Groups of open records of a store that are alike in type, source, body, expiry and tags: the one to keep and their number."""
    m = core._eligible(table(spark, base, "memories"))
    source = F.coalesce(F.when(F.trim(F.col("source")) != "", F.lower(F.trim(F.col("source")))), F.lit("agent"))
    d = records.digest(
        F.col("store_id"), F.col("type"), source, F.col("body"), F.coalesce("expires", F.lit("")), F.array_join(F.coalesce("tags", F.array()), ",")
    )
    classes = m.groupBy(d.alias("d")).agg(F.min("mem_no").alias("keep_no"), F.count("*").alias("copies"))
    return classes.where("copies > 1").select("keep_no", "copies")


@_query(
    _versions_sql("semantic_hash")
    + """, org AS (SELECT store_id, memory_id, arg_min(hash, (at_us, coalesce(revision, -9223372036854775808), hash)) AS original FROM o GROUP BY ALL),
held AS (SELECT o.store_id, o.memory_id, max(at_us) AS last_us FROM o JOIN org ON o.store_id = org.store_id AND o.memory_id = org.memory_id AND o.hash = org.original GROUP BY ALL),
r AS (SELECT store_id, memory_id, lower(semantic_hash) AS hash, CASE WHEN regexp_full_match(upper(trim(recorded_at)),
    '\\d{4}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d(\\.\\d+)?(Z|[+-]\\d\\d:\\d\\d)')
    THEN epoch_us(try_cast(regexp_replace(upper(trim(recorded_at)), '(\\.\\d{6})\\d+', '\\1') AS TIMESTAMPTZ)) END AS at_us,
  bool_or(reason IN ('correction', 'revise')) AS allowed FROM revisions GROUP BY ALL),
w AS (SELECT s.store_id, s.memory_id, bool_or(s.gap) AS gaps, bool_and(coalesce(allowed, false)) AS allowed FROM s
  JOIN held ON s.store_id = held.store_id AND s.memory_id = held.memory_id AND s.at_us > held.last_us
  LEFT JOIN r ON s.store_id = r.store_id AND s.memory_id = r.memory_id AND s.at_us = r.at_us AND s.hash = r.hash GROUP BY ALL)
SELECT held.store_id, CASE WHEN gaps IS NULL THEN 'unchanged' WHEN gaps THEN 'unobserved_edits' WHEN allowed THEN 'supported' ELSE 'changed_otherwise' END AS support,
  count(*) AS records FROM held LEFT JOIN w ON held.store_id = w.store_id AND held.memory_id = w.memory_id GROUP BY ALL"""
)
def recorded_support(spark: SparkSession, base: str) -> DataFrame:
    """Whether what a record first said still supports it: no version since, corrections only, other changes, or unseen edits."""
    found = history.recorded_support(table(spark, base, "revisions"), ("correction", "revise"))
    return found.groupBy("store_id", "support").agg(F.count("*").alias("records"))
