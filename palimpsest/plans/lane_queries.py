"""Queries of the search lanes: candidate rules, link hops, stale sources, cached vectors; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators import graph, records, retrieval, vectors
from palimpsest.plans import core_queries as core
from palimpsest.sources.tables import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@_query(
    core._bm25_sql(core._MEMORY, 20)
    + f", pcorpus AS (SELECT * FROM corpus){core._PHRASE_SQL}"
    + f""", sd AS (SELECT query_no, doc, count(*) AS hits FROM (SELECT case_no AS query_no, unnest({core._tokens('query')}) AS term FROM eval_cases) q
  JOIN corpus ON contains(text, term) WHERE length(term) < 3 AND regexp_matches(term, '^[{core._D}]') GROUP BY ALL),
ix AS (SELECT query_no, doc, round(coalesce(psc.score + coalesce(strength, 0) / 1000, 0) + coalesce(hits + coalesce(strength, 0) / 1000, 0), 6) AS score
  FROM psc FULL JOIN sd USING (query_no, doc) JOIN (SELECT mem_no AS doc, strength FROM memories) USING (doc)),
al AS (SELECT query_no, doc, 'indexed' AS lane, score FROM ix UNION ALL
  SELECT query_no, doc, 'bm25', score FROM s WHERE score > 0 AND query_no NOT IN (SELECT query_no FROM ix))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, doc) AS rank FROM al) WHERE rank <= 20"""
)
def candidate_search(spark: SparkSession, base: str) -> DataFrame:
    """The candidates of every query: what the index finds, and by BM25 only where it finds nothing."""
    m = records.with_search_text(core._eligible(table(spark, base, "memories")))
    corpus = spread(m.select(F.col("mem_no").alias("doc"), F.col("search_text").alias("text"), "strength"), "doc")
    return retrieval.candidates(corpus, core._asked(spark, base), 20)


def _hop_sql(h: int, source: str, before: str) -> str:
    part = f"CASE WHEN rel = 'contradicts' THEN 0e0 ELSE round(score * weight * {0.5**h}, 12) END"
    return f"""
h{h} AS (SELECT query_no, dst AS doc, CAST(sum(CAST({part} AS DECIMAL(28, 12))) AS DOUBLE) AS s, arg_min({part}, key || '|' || rel) AS first,
  min(key || '|' || rel) AS key, list_sort(list_distinct(list(CAST(src AS VARCHAR)) FILTER (rel = 'contradicts'))) AS against
  FROM {source} JOIN ew USING (src) GROUP BY ALL),
b{h} AS (SELECT query_no, doc, base, boost, hop, contra, s, first, key, against, cap FROM {before} FULL JOIN h{h} USING (query_no, doc) JOIN cap USING (query_no)),
n{h} AS (SELECT query_no, doc AS src, least(first, cap) AS score, key || '|' || lpad(CAST(doc AS VARCHAR), 20, '0') AS key FROM b{h} WHERE hop IS NULL),
a{h} AS (SELECT query_no, doc, coalesce(base, 0) AS base, least(coalesce(boost, 0) + coalesce(s, 0), cap) AS boost, coalesce(hop, {h + 1}) AS hop,
  list_sort(list_distinct(list_concat(coalesce(contra, []), coalesce(against, [])))) AS contra FROM b{h})"""


@_query(
    core._FUSED
    + f""", {core._EDGES}, {core._REL},
ew AS (SELECT DISTINCT l.mem_no AS src, f.mem_no AS dst, l.rel, coalesce(weight, 0.5) AS weight FROM links l JOIN first f ON l.target = f.id
  JOIN memories m ON m.mem_no = f.mem_no LEFT JOIN rels ON rels.rel = l.rel
  WHERE l.mem_no <> f.mem_no AND NOT coalesce(archived, false) AND NOT {core._EXPIRED} AND (coalesce(weight, 0.5) > 0 OR l.rel = 'contradicts')),
cap AS (SELECT query_no, max(score) * 0.8 AS cap FROM fused GROUP BY query_no),
s0 AS (SELECT query_no, doc, score AS base, 0e0 AS boost, 0 AS hop, CAST([] AS VARCHAR[]) AS contra FROM fused),
f0 AS (SELECT query_no, doc AS src, score, lpad(CAST(rank AS VARCHAR), 6, '0') AS key FROM fused WHERE rank <= 10),
{_hop_sql(0, 'f0', 's0')}, {_hop_sql(1, 'n0', 'a0')}
SELECT query_no, doc, round(base + boost, 9) AS score, hop, array_to_string(contra, ',') AS contradicts_with FROM a1"""
)
def expanded_search(spark: SparkSession, base: str) -> DataFrame:
    """Hybrid search with two hops along links, contradictions marked."""
    m = table(spark, base, "memories")
    gone = F.coalesce("archived", F.lit(False)) | tx.expired(F.col("expires"), F.lit(core.DAY).cast("date"))
    open_ = m.where(~gone).select(F.col("mem_no").alias("dst"))
    target = graph.first_by_id(m).select(F.col("id").alias("target"), F.col("mem_no").alias("dst")).join(open_, "dst", "left_semi")
    e = graph.links(m).join(target, "target").select(F.col("mem_no").alias("src"), "dst", "rel").where("src <> dst").distinct()
    found = retrieval.expand_hops(core._fused(spark, base), e, graph.relations(spark).select("rel", "weight"))
    return found.withColumn("contradicts_with", F.array_join("contradicts_with", ","))


@_query(
    core._FUSED
    + f""", sv AS (SELECT DISTINCT mem_no AS doc FROM memories JOIN vectors USING (store_id, path) WHERE content_hash = 'stale'),
g AS (SELECT query_no, doc, rank AS old_rank, doc IN (SELECT doc FROM sv) AS warned FROM fused)
SELECT query_no, doc, old_rank, warned, row_number() OVER (PARTITION BY query_no ORDER BY warned, old_rank) AS rank,
  CASE WHEN NOT warned THEN title END AS knowledge FROM g JOIN (SELECT mem_no AS doc, {core._TITLE} AS title FROM memories) USING (doc)"""
)
def guarded_search(spark: SparkSession, base: str) -> DataFrame:
    """Hybrid search in which records whose cached vector is stale come last and keep their knowledge to themselves."""
    m = table(spark, base, "memories")
    old = table(spark, base, "vectors").where("content_hash = 'stale'").select("store_id", "path").distinct()
    stale = m.join(old, ["store_id", "path"], "left_semi").select(F.col("mem_no").alias("doc"))
    found = retrieval.stale_last(core._fused(spark, base), stale)
    t = tx.title(*[F.col(c) for c in ("body", "injection_summary", "canonical_summary", "id")])
    titles = m.select(F.col("mem_no").alias("doc"), t.alias("title"))
    return found.join(titles, "doc").select(
        "query_no", "doc", "old_rank", "warned", "rank", F.when(~F.col("warned"), F.col("title")).alias("knowledge")
    )


_STATES = """
WITH v AS (SELECT *, try_cast(vector_json AS DOUBLE[]) AS v FROM vectors),
g AS (SELECT *, coalesce(len(v) = dimensions AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(v, lambda x: x <> 0)) > 0, false) AS sound FROM v),
k AS (SELECT DISTINCT store_id, path, true AS known FROM memories WHERE path IS NOT NULL),
states AS (SELECT g.*, CASE WHEN NOT sound THEN 'corrupt' WHEN known IS NULL THEN 'orphan' WHEN content_hash = 'stale' THEN 'stale' ELSE 'ready' END AS state
  FROM g LEFT JOIN k ON g.store_id = k.store_id AND g.path = k.path)"""


def _states(spark: SparkSession, base: str) -> DataFrame:
    known = table(spark, base, "memories").where("path is not null").select("store_id", "path").distinct()
    return records.vector_states(table(spark, base, "vectors"), known)


@_query(f"""{_STATES}
SELECT store_id, fingerprint, CASE WHEN count(*) FILTER (state = 'corrupt') > 0 THEN 'corrupt' WHEN count(*) FILTER (state = 'stale') > 0 THEN 'stale'
  WHEN count(*) FILTER (state = 'orphan') > 0 THEN 'orphan' ELSE 'ready' END AS status, count(*) FILTER (state = 'corrupt') AS corrupt_rows,
  count(*) FILTER (state = 'stale') AS stale_rows, count(*) FILTER (state = 'orphan') AS orphan_rows, count(*) FILTER (state = 'ready') AS ready_rows
FROM states GROUP BY ALL""")
def vector_status(spark: SparkSession, base: str) -> DataFrame:
    """The state of each store's vector cache by fingerprint."""
    return vectors.status(_states(spark, base))


@_query(f"""{_STATES},
o AS (SELECT DISTINCT store_id, path FROM memories WHERE NOT coalesce(archived, false) AND NOT {core._EXPIRED}),
r AS (SELECT vec_no, store_id, path, fingerprint, v FROM states WHERE state = 'ready' AND (store_id, path) IN (SELECT (store_id, path) FROM o)),
p AS (SELECT store_id, fingerprint, min(vec_no) AS probe_no, arg_min(v, vec_no) AS pv FROM r GROUP BY ALL),
c AS (SELECT store_id, fingerprint, probe_no, vec_no, path, round(list_cosine_similarity(v, pv), 9) AS s FROM r JOIN p USING (store_id, fingerprint) WHERE vec_no <> probe_no)
SELECT store_id, fingerprint, probe_no, vec_no, round(s, 4) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY store_id, fingerprint ORDER BY s DESC, path, vec_no) AS rank FROM c WHERE s > 0) WHERE rank <= 10""")
def vector_lane(spark: SparkSession, base: str) -> DataFrame:
    """The 10 ready vectors of open records most similar to the first one of each store and fingerprint."""
    gone = F.coalesce("archived", F.lit(False)) | tx.expired(F.col("expires"), F.lit(core.DAY).cast("date"))
    open_ = table(spark, base, "memories").where(~gone).select("store_id", "path").distinct()
    ready = _states(spark, base).where("state = 'ready'").join(open_, ["store_id", "path"], "left_semi")
    ready = ready.select("vec_no", "store_id", "path", "fingerprint", F.from_json("vector_json", "array<double>").alias("v"))
    return vectors.probe_lane(ready, 10)


#: The SQL of `vector_states`, which core_queries registers.
SQL["vector_states"] = f"{_STATES} SELECT fingerprint, dimensions, state, count(*) AS vectors FROM states GROUP BY ALL"
