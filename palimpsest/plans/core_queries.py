"""Queries of the record, retrieval, graph and transcript operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators import graph, history, records, retrieval
from palimpsest.operators import turns as tn
from palimpsest.operators.running import placed
from palimpsest.sources.tables import spread, table

#: The day and the instant the queries look from.
DAY, INSTANT_US = "2026-01-01", 1_751_328_000_000_000

# --- SQL pieces ----------------------------------------------------------------------------------------

_D = r"\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ac00}-\x{d7af}"
_W = r"_0-9a-z\x{c0}-\x{24f}"
_C = r"\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7a3}"


def _tokens(c: str) -> str:
    return f"""flatten(list_transform(regexp_extract_all(lower({c}), '([{_D}]+|[{_W}]+)'), lambda r:
      CASE WHEN regexp_matches(r, '^[{_D}]') AND length(r) > 1
           THEN list_transform(range(1, length(r)), lambda i: substring(r, i, 2)) ELSE [r] END))"""


def _phrases(c: str) -> str:
    return f"""list_sort(list_distinct(flatten(list_transform(regexp_extract_all(lower({c}), '([{_D}]+|[{_W}]+)'), lambda r:
      CASE WHEN NOT regexp_matches(r, '^[{_D}]') THEN [r]
           WHEN length(r) < 3 THEN []
           WHEN length(r) = 3 THEN [r]
           ELSE list_concat(list_transform(range(1, length(r) - 1), lambda i: substring(r, i, 3)), [r]) END))))"""


def _estimate(c: str) -> str:
    k = f"length(regexp_replace({c}, '[^{_C}]', '', 'g'))"
    return f"CASE WHEN {c} = '' THEN 0 ELSE greatest(1, CAST(round(({k} * 12 + (length({c}) - {k}) * 5) / 20.0) AS BIGINT)) END"


_SEARCH_TEXT = """array_to_string(list_filter([canonical_summary, injection_summary, body,
  array_to_string(coalesce(tags, []), ' '), type, id], lambda x: x IS NOT NULL AND x <> ''), chr(10))"""
_EXPIRED = f"""coalesce(CASE WHEN regexp_full_match(expires, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast(expires AS DATE) < DATE '{DAY}' END, false)"""
_ELIGIBLE = f"NOT coalesce(archived, false) AND coalesce(status, '') <> 'superseded' AND NOT {_EXPIRED}"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _memories(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "memories")


def _eligible(df: DataFrame) -> DataFrame:
    return df.where(
        ~F.coalesce("archived", F.lit(False))
        & (F.coalesce("status", F.lit("")) != "superseded")
        & ~tx.expired(F.col("expires"), F.lit(DAY).cast("date"))
    )


# --- text ----------------------------------------------------------------------------------------------


@_query(f"""
SELECT store_id, count(*) AS records, sum(len({_tokens('body')})) AS tokens, sum(len(list_distinct({_tokens('body')}))) AS distinct_tokens
FROM memories WHERE body IS NOT NULL GROUP BY store_id""")
def tokens_by_store(spark: SparkSession, base: str) -> DataFrame:
    t = spread(_memories(spark, base).where("body is not null").select("store_id", "body")).select("store_id", tx.tokens(F.col("body")).alias("t"))
    return t.groupBy("store_id").agg(
        F.count("*").alias("records"),
        F.sum(F.size("t")).alias("tokens"),
        F.sum(F.size(F.array_distinct("t"))).alias("distinct_tokens"),
    )


@_query(f"""
SELECT doc_type, p AS phrase, count(*) AS documents FROM (
  SELECT doc_id, doc_type, unnest({_phrases('text')}) AS p FROM documents WHERE text IS NOT NULL)
GROUP BY ALL HAVING count(*) >= 20""")
def frequent_phrases(spark: SparkSession, base: str) -> DataFrame:
    """Phrases of the full-text form that 20 or more documents of a type hold."""
    p = table(spark, base, "documents").where("text is not null").select(
        "doc_type", F.explode(tx.phrases(F.col("text"))).alias("phrase")
    )
    return p.groupBy("doc_type", "phrase").agg(F.count("*").alias("documents")).where("documents >= 20")


@_query(f"""
SELECT coalesce(role, '') AS role, count(*) AS turns, sum({_estimate('text')}) AS tokens, max({_estimate('text')}) AS longest
FROM turns WHERE text IS NOT NULL GROUP BY ALL""")
def token_estimates(spark: SparkSession, base: str) -> DataFrame:
    e = table(spark, base, "turns").where("text is not null").select(
        F.coalesce("role", F.lit("")).alias("role"), tx.token_estimate(F.col("text")).alias("e")
    )
    return e.groupBy("role").agg(F.count("*").alias("turns"), F.sum("e").alias("tokens"), F.max("e").alias("longest"))


@_query(f"SELECT mem_no, sha256({_SEARCH_TEXT}) AS content_hash FROM memories")
def content_hashes(spark: SparkSession, base: str) -> DataFrame:
    return records.with_search_text(_memories(spark, base)).select("mem_no", F.sha2("search_text", 256).alias("content_hash"))


@_query(r"""
SELECT mem_no, coalesce(nullif(trim(regexp_extract(body, '(?m)^[ \t]*#+[ \t]*(.*?)[ \t\r]*$', 1)), ''),
  nullif(injection_summary, ''), nullif(canonical_summary, ''), id) AS title FROM memories""")
def titles(spark: SparkSession, base: str) -> DataFrame:
    t = tx.title(*[F.col(c) for c in ("body", "injection_summary", "canonical_summary", "id")])
    return _memories(spark, base).select("mem_no", t.alias("title"))


@_query(f"""
SELECT scope, store_id, count(*) AS records, count(*) FILTER ({_ELIGIBLE}) AS eligible, count(*) FILTER ({_EXPIRED}) AS expired,
  count(*) FILTER (trim(coalesce(id, '')) <> '' AND trim(coalesce(body, '')) <> '') AS with_evidence
FROM memories GROUP BY ALL""")
def eligibility(spark: SparkSession, base: str) -> DataFrame:
    gone = tx.expired(F.col("expires"), F.lit(DAY).cast("date"))
    kept = ~F.coalesce("archived", F.lit(False)) & (F.coalesce("status", F.lit("")) != "superseded") & ~gone
    full = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return _memories(spark, base).groupBy("scope", "store_id").agg(
        F.count("*").alias("records"),
        F.count_if(kept).alias("eligible"),
        F.count_if(gone).alias("expired"),
        F.count_if(full("id") & full("body")).alias("with_evidence"),
    )


@_query(r"""
SELECT source, count(*) AS documents, count(*) FILTER (
  regexp_matches(lower(text), '(?m)^[ \t]*(?:api_key|access_token|client_secret|password)[ \t]*[=:]')
  OR contains(lower(text), 'authorization: bearer ') OR regexp_matches(lower(text), '-----begin[^\n]*private key')) AS with_credential,
  sum(octet_length(encode(text))) AS bytes, max(octet_length(encode(text))) AS largest
FROM documents WHERE text IS NOT NULL GROUP BY source""")
def credential_scan(spark: SparkSession, base: str) -> DataFrame:
    d = table(spark, base, "documents").where("text is not null")
    return d.groupBy("source").agg(
        F.count("*").alias("documents"),
        F.count_if(tx.credential(F.col("text"))).alias("with_credential"),
        F.sum(F.octet_length("text")).alias("bytes"),
        F.max(F.octet_length("text")).cast("bigint").alias("largest"),
    )


# --- records -------------------------------------------------------------------------------------------


@_query("""
WITH m AS (SELECT mem_no, sha256(concat_ws(chr(31), coalesce(type, chr(0)),
  coalesce(CASE WHEN trim(source) <> '' THEN lower(trim(source)) END, 'agent'), coalesce(body, chr(0)), coalesce(expires, ''),
  array_to_string(coalesce(tags, []), ','))) AS d FROM memories),
c AS (SELECT d, min(mem_no) AS class_no, count(*) AS copies FROM m GROUP BY d HAVING count(*) > 1)
SELECT mem_no, class_no, copies FROM m JOIN c USING (d)""")
def exact_duplicates(spark: SparkSession, base: str) -> DataFrame:
    return records.exact_duplicates(_memories(spark, base))


@_query("""
SELECT type, count(DISTINCT d) AS distinct_contents, count(*) AS records FROM (
  SELECT type, sha256(concat_ws(chr(31), coalesce(id, chr(0)), coalesce(type, chr(0)), coalesce(source, chr(0)), coalesce(canonical_summary, chr(0)),
    coalesce(injection_summary, chr(0)), coalesce(status, chr(0)), coalesce(body, chr(0)), coalesce(expires, chr(0)),
    coalesce(array_to_string(list_transform(tags, lambda x: coalesce(x, chr(0))), ','), chr(0)),
    coalesce(array_to_string(list_transform(links, lambda x: concat_ws('>', x.rel, x.id)), ','), chr(0)))) AS d FROM memories)
GROUP BY type""")
def semantic_digests(spark: SparkSession, base: str) -> DataFrame:
    m = _memories(spark, base)
    d = records.semantic_digest(m.withColumn("links", F.col("links")))
    return m.select("mem_no", "type").join(d, "mem_no").groupBy("type").agg(
        F.countDistinct("digest").alias("distinct_contents"), F.count("*").alias("records")
    )


@_query("""
WITH r AS (SELECT *, first_value(lower(raw_hash)) OVER w AS f, row_number() OVER w AS n FROM revisions
  WINDOW w AS (PARTITION BY store_id, memory_id, recorded_at, revision ORDER BY rev_row))
SELECT reason, CASE WHEN n = 1 THEN 'first' WHEN lower(raw_hash) IS NOT DISTINCT FROM f THEN 'duplicate' ELSE 'conflict' END AS verdict, count(*) AS n
FROM r GROUP BY ALL""")
def delivery_verdicts(spark: SparkSession, base: str) -> DataFrame:
    """Revision rows by identity: first delivery, repeated delivery, or same identity with another payload."""
    r = table(spark, base, "revisions").select("rev_row", "store_id", "memory_id", "recorded_at", "revision", "reason", "raw_hash")
    out = records.source_identity(r, ["store_id", "memory_id", "recorded_at", "revision"], F.lower("raw_hash"), "rev_row")
    return out.groupBy("reason", "verdict").agg(F.count("*").alias("n"))


@_query("""
WITH v AS (SELECT store_id, path, max(content_hash) AS f FROM vectors WHERE content_hash <> 'stale' GROUP BY ALL),
m AS (SELECT DISTINCT store_id, path FROM memories WHERE path IS NOT NULL)
SELECT CASE WHEN v.path IS NULL THEN 'insert' WHEN m.path IS NULL THEN 'delete' ELSE 'keep' END AS action, count(*) AS n
FROM v FULL JOIN m ON v.store_id = m.store_id AND v.path = m.path GROUP BY ALL""")
def cache_sync(spark: SparkSession, base: str) -> DataFrame:
    """What the vector cache must do to follow the records."""
    held = table(spark, base, "vectors").where("content_hash <> 'stale'").groupBy("store_id", "path").agg(F.lit("x").alias("print"))
    now = _memories(spark, base).where("path is not null").select("store_id", "path").distinct().withColumn("print", F.lit("x"))
    return records.sync_actions(held, now, ["store_id", "path"], "print").groupBy("action").agg(F.count("*").alias("n"))


@_query("""
SELECT store_id, count(*) AS files, sum(size) AS bytes, CAST(sum(CAST(('0x' || h[1:15]) AS HUGEINT)) AS VARCHAR) AS content_mark FROM (
  SELECT store_id, octet_length(encode(coalesce(body, ''))) AS size,
    sha256(concat_ws(chr(31), path, octet_length(encode(coalesce(body, ''))), sha256(coalesce(body, '')))) AS h FROM memories WHERE path IS NOT NULL)
GROUP BY store_id""")
def snapshot_manifest(spark: SparkSession, base: str) -> DataFrame:
    m = _memories(spark, base).where("path is not null")
    return records.manifest(m.select("store_id", "path", F.coalesce("body", F.lit("")).alias("content")))


@_query()
def cache_sync_prints(spark: SparkSession, base: str) -> DataFrame:
    """What the vector cache must do to follow the records, by fingerprint: the cached content hash against the record's.

    `cache_sync` and its SQL compare only which paths there are; here stale rows stay, and what a record says
    now decides between keep and update. A path cached several times is kept only if every row is current.
    """
    now = records.with_search_text(_memories(spark, base).where("path is not null"))
    return records.cache_actions(table(spark, base, "vectors"), now).groupBy("action").agg(F.count("*").alias("n"))


@_query("""
WITH s AS (SELECT store_id, path, mem_no, octet_length(encode(coalesce(body, ''))) AS size FROM memories),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY store_id ORDER BY path, mem_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM s)
SELECT store_id, CAST(off // 65536 AS BIGINT) AS page, count(*) AS records, sum(size) AS bytes, min(path) AS first_path FROM o GROUP BY ALL""")
def export_pages(spark: SparkSession, base: str) -> DataFrame:
    """Pages of 64 KiB per store, in order of path."""
    size = F.octet_length(F.coalesce("body", F.lit(""))).cast("bigint")
    m = _memories(spark, base).select("store_id", "path", "mem_no", size.alias("size"))
    paged = records.byte_pages(m, "store_id", ["path", "mem_no"], F.col("size"), 65_536)
    return paged.groupBy("store_id", "page").agg(
        F.count("*").alias("records"), F.sum("size").alias("bytes"), F.min("path").alias("first_path")
    )


@_query()
def vector_states(spark: SparkSession, base: str) -> DataFrame:
    known = _memories(spark, base).where("path is not null").select("store_id", "path").distinct()
    s = records.vector_states(table(spark, base, "vectors"), known)
    return s.groupBy("fingerprint", "dimensions", "state").agg(F.count("*").alias("vectors"))


@_query("""
SELECT store_id, type, count(*) AS records, max(strength) AS top_strength, sum(strength) AS strength,
  sum(least(100, strength + 5)) AS credited, count(DISTINCT (path, status)) AS distinct_places
FROM memories GROUP BY ALL""")
def strength_summary(spark: SparkSession, base: str) -> DataFrame:
    return _memories(spark, base).groupBy("store_id", "type").agg(
        F.count("*").alias("records"),
        F.max("strength").alias("top_strength"),
        F.sum("strength").alias("strength"),
        F.sum(F.least(F.lit(100), F.col("strength") + 5)).alias("credited"),
        F.countDistinct(F.struct("path", "status")).alias("distinct_places"),
    )


# --- history -------------------------------------------------------------------------------------------


@_query(
    """
WITH r AS (SELECT store_id, memory_id, lower(semantic_hash) AS h, rev_row FROM revisions WHERE semantic_hash IS NOT NULL)
SELECT h AS semantic_hash, count(DISTINCT (store_id, memory_id)) AS records, count(*) AS rows_seen FROM r GROUP BY h HAVING count(*) > 1"""
)
def shared_contents(spark: SparkSession, base: str) -> DataFrame:
    r = table(spark, base, "revisions").where("semantic_hash is not null")
    return (
        r.groupBy(F.lower("semantic_hash").alias("semantic_hash"))
        .agg(F.countDistinct(F.struct("store_id", "memory_id")).alias("records"), F.count("*").alias("rows_seen"))
        .where("rows_seen > 1")
    )


from palimpsest.plans.history_queries import _versions_sql  # noqa: E402


@_query(
    _versions_sql("semantic_hash")
    + f""", a AS (SELECT store_id, memory_id, hash, valid_from_us FROM v WHERE valid_from_us <= {INSTANT_US} AND (valid_until_us = -1 OR valid_until_us > {INSTANT_US})),
f AS (SELECT store_id, memory_id, min(valid_from_us) AS first_us, bool_or(gap AND valid_from_us > {INSTANT_US}) AS later_gap FROM v GROUP BY ALL)
SELECT f.store_id, CASE WHEN a.hash IS NOT NULL THEN CASE WHEN later_gap THEN 'known_then_unobserved' ELSE 'known' END ELSE 'before_coverage' END AS coverage,
  count(*) AS records FROM f LEFT JOIN a ON f.store_id = a.store_id AND f.memory_id = a.memory_id GROUP BY ALL"""
)
def history_coverage(spark: SparkSession, base: str) -> DataFrame:
    """What can be said about each record at an instant: known, known with unseen edits later, before its coverage."""
    view = history.periods(history.satellite(table(spark, base, "revisions")))
    until = F.col("valid_until_us")
    valid = (F.col("valid_from_us") <= INSTANT_US) & ((until == -1) | (until > INSTANT_US))
    one = view.groupBy("store_id", "memory_id").agg(
        F.max(valid).alias("known"), F.max(F.col("gap") & (F.col("valid_from_us") > INSTANT_US)).alias("later_gap")
    )
    name = F.when(F.col("known"), F.when(F.col("later_gap"), "known_then_unobserved").otherwise("known")).otherwise("before_coverage")
    return one.groupBy("store_id", name.alias("coverage")).agg(F.count("*").alias("records"))


@_query(
    _versions_sql("semantic_hash")
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY store_id, memory_id ORDER BY at_us, revision NULLS FIRST, hash) AS number FROM s)
SELECT number, count(*) AS versions, count(*) FILTER (gap) AS after_gap FROM n GROUP BY number"""
)
def version_numbers(spark: SparkSession, base: str) -> DataFrame:
    """How many records have an n-th version. Numbers are ranks in a record's version list."""
    sat = history.satellite(table(spark, base, "revisions"))
    order = [F.col("at_us"), F.col("revision").asc_nulls_first(), F.col("hash")]
    numbered = placed(sat, ["store_id", "memory_id"], order).withColumnRenamed("place", "number")
    return numbered.groupBy("number").agg(F.count("*").alias("versions"), F.count_if("gap").alias("after_gap"))


# --- graph ---------------------------------------------------------------------------------------------

_FIRST = """first AS (SELECT id, mem_no, store_id FROM (SELECT *, row_number() OVER (PARTITION BY id
  ORDER BY CASE WHEN scope = 'global' THEN 0 ELSE 1 END, store_id, path, mem_no) AS n FROM memories WHERE id IS NOT NULL) WHERE n = 1)"""
_LINKS = """links AS (SELECT DISTINCT mem_no, store_id, id, l.id AS target, l.rel AS rel FROM
  (SELECT mem_no, store_id, id, unnest(links) AS l FROM memories) WHERE l.id IS NOT NULL AND l.rel IS NOT NULL AND id IS NOT NULL)"""
_EDGES = f"""{_FIRST}, {_LINKS}, edges AS (SELECT DISTINCT id AS src, target AS dst, rel FROM links
  WHERE id <> target AND target IN (SELECT id FROM first))"""


@_query(f"WITH {_FIRST} SELECT id, mem_no, store_id FROM first")
def first_by_id(spark: SparkSession, base: str) -> DataFrame:
    return graph.first_by_id(_memories(spark, base))


@_query(f"""WITH {_FIRST}, {_LINKS} SELECT store_id, rel, count(*) AS links FROM links
WHERE target NOT IN (SELECT id FROM first) GROUP BY ALL""")
def unresolved_links(spark: SparkSession, base: str) -> DataFrame:
    m = _memories(spark, base)
    known = graph.first_by_id(m).select(F.col("id").alias("target"))
    return graph.links(m).join(known, "target", "left_anti").groupBy("store_id", "rel").agg(F.count("*").alias("links"))


_REL = "rels(rel, reverse, weight) AS (VALUES " + ", ".join(f"('{a}', '{b}', {w})" for a, b, w in graph.RELATIONS) + ")"


@_query(f"""WITH {_EDGES}, {_REL}, e2 AS (SELECT src, dst, rel FROM edges UNION SELECT dst, src, reverse FROM edges JOIN rels USING (rel))
SELECT src AS id, count(*) AS edges, count(DISTINCT dst) AS neighbours, count(*) FILTER (rel = 'contradicts') AS contradicts FROM e2 GROUP BY src""")
def link_degrees(spark: SparkSession, base: str) -> DataFrame:
    e = graph.both_ways(graph.edges(_memories(spark, base)), graph.relations(spark))
    return e.groupBy(F.col("src").alias("id")).agg(
        F.count("*").alias("edges"),
        F.countDistinct("dst").alias("neighbours"),
        F.count_if(F.col("rel") == "contradicts").alias("contradicts"),
    )


@_query(f"""WITH RECURSIVE {_EDGES}, walk(id, depth) AS (
  SELECT id, 0 FROM first JOIN (SELECT DISTINCT id FROM memories WHERE type = 'handoff') USING (id)
  UNION SELECT dst, depth + 1 FROM walk JOIN edges ON src = walk.id WHERE depth < 3)
SELECT id, min(depth) AS depth FROM walk GROUP BY id""")
def reach_from_handoffs(spark: SparkSession, base: str) -> DataFrame:
    """Records within 3 links of any handoff."""
    m = _memories(spark, base)
    return graph.reach(graph.edges(m), m.where("type = 'handoff' and id is not null").select("id"), 3)


@_query(f"""WITH {_EDGES}, e AS (SELECT DISTINCT src, dst FROM edges WHERE rel = 'supersedes'),
w2 AS (SELECT DISTINCT a.src AS start, b.dst AS pt FROM e a JOIN e b ON a.dst = b.src),
w3 AS (SELECT DISTINCT start, dst AS pt FROM w2 JOIN e ON pt = src WHERE start <> pt),
w4 AS (SELECT DISTINCT start, dst AS pt FROM w3 JOIN e ON pt = src WHERE start <> pt)
SELECT start AS id, min(l) AS length FROM (SELECT start, 2 AS l FROM w2 WHERE start = pt UNION ALL SELECT start, 3 FROM w3 WHERE start = pt
  UNION ALL SELECT start, 4 FROM w4 WHERE start = pt) GROUP BY start""")
def supersede_cycles(spark: SparkSession, base: str) -> DataFrame:
    """Records that supersede themselves through others, however many; the SQL goes to 4 edges."""
    return graph.on_cycles(graph.edges(_memories(spark, base)).where("rel = 'supersedes'"))


# --- retrieval -----------------------------------------------------------------------------------------


def _asked(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "eval_cases").select(F.col("case_no").alias("query_no"), "query")


def _documents(spark: SparkSession, base: str) -> DataFrame:
    return spread(table(spark, base, "documents").select(F.col("doc_id").alias("doc"), "text"), "doc")


def _bm25_sql(corpus: str, k: int) -> str:
    return f"""
WITH corpus AS ({corpus}), t AS (SELECT doc, coalesce({_tokens('text')}, []) AS tk FROM corpus),
st AS (SELECT count(*) AS docs, avg(len(tk)) AS al FROM t),
q AS (SELECT query_no, term, count(*) AS r FROM (SELECT case_no AS query_no, unnest({_tokens('query')}) AS term FROM eval_cases) GROUP BY ALL),
p AS (SELECT doc, len, term, count(*) AS f FROM (SELECT doc, len(tk) AS len, unnest(tk) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS d FROM p GROUP BY term),
w AS (SELECT term, doc, CAST(round(ln(1e0 + (docs - d + 0.5e0) / (d + 0.5e0)) * f * 2.5e0 / (f + 1.5e0 * (0.25e0 + 0.75e0 * len / greatest(al, 1e0))), 6) AS DECIMAL(28, 6)) AS w
  FROM p JOIN df USING (term), st),
s AS (SELECT query_no, doc, CAST(sum(w * r) AS DOUBLE) AS score FROM w JOIN q USING (term) GROUP BY ALL),
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, doc) AS rank FROM s) WHERE rank <= {k})"""


@_query(_bm25_sql("SELECT doc_id AS doc, text FROM documents", 5) + " SELECT query_no, doc, score, rank FROM found")
def bm25_multi_query(spark: SparkSession, base: str) -> DataFrame:
    return retrieval.bm25(_documents(spark, base), _asked(spark, base), 5)


_GATE = "SELECT id AS doc, text FROM eval_seeds UNION ALL SELECT 'doc-' || doc_id, text FROM documents"


@_query(
    _bm25_sql(_GATE, 5)
    + """, e AS (SELECT DISTINCT case_no AS query_no, unnest(expected_ids) AS doc FROM eval_cases),
r AS (SELECT query_no, count(*) AS n, count(rank) AS hits, min(rank) AS first FROM e LEFT JOIN found USING (query_no, doc) GROUP BY query_no)
SELECT question_type, count(*) AS cases, round(avg(round(hits / n, 6)), 6) AS recall_at_5, round(avg(round(coalesce(1 / first, 0), 6)), 6) AS mrr
FROM r JOIN (SELECT case_no AS query_no, coalesce(question_type, '') AS question_type FROM eval_cases) USING (query_no) GROUP BY question_type"""
)
def eval_gate(spark: SparkSession, base: str) -> DataFrame:
    """Recall at 5 and mean reciprocal rank of the held-out items, hidden among all documents."""
    seeds = table(spark, base, "eval_seeds").select(F.col("id").alias("doc"), "text")
    docs = table(spark, base, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("doc"), "text")
    found = retrieval.bm25(seeds.unionByName(spread(docs, "doc")), _asked(spark, base), 5)
    cases = table(spark, base, "eval_cases")
    expected = cases.select(F.col("case_no").alias("query_no"), F.explode("expected_ids").alias("doc"))
    scored = retrieval.recall(found, expected, 5).join(
        cases.select(F.col("case_no").alias("query_no"), F.coalesce("question_type", F.lit("")).alias("question_type")), "query_no"
    )
    return scored.groupBy("question_type").agg(
        F.count("*").alias("cases"),
        F.round(F.avg("recall"), 6).alias("recall_at_5"),
        F.round(F.avg("reciprocal_rank"), 6).alias("mrr"),
    )


_PHRASE_SQL = f"""
, pq AS (SELECT case_no AS query_no, unnest({_phrases('query')}) AS phrase FROM eval_cases),
pp AS (SELECT DISTINCT phrase FROM pq WHERE length(phrase) >= 3),
pd AS (SELECT doc, lower(coalesce(text, '')) AS t FROM pcorpus),
pc AS (SELECT doc, phrase, length(t) AS len, len(list_filter(range(1, length(t) - length(phrase) + 2), lambda i: substring(t, i, length(phrase)) = phrase)) AS f
  FROM pd JOIN pp ON contains(t, phrase)),
ps AS (SELECT count(*) AS docs, avg(greatest(length(coalesce(text, '')) - 2, 0)) AS al FROM pcorpus),
pf AS (SELECT phrase, count(*) AS d FROM pc GROUP BY phrase),
pw AS (SELECT phrase, doc, CAST(round((CASE WHEN ln((docs - d + 0.5e0) / (d + 0.5e0)) <= 0 THEN 1e-6 ELSE ln((docs - d + 0.5e0) / (d + 0.5e0)) END)
  * f * 2.2e0 / (f + 1.2e0 * (0.25e0 + 0.75e0 * greatest(len - 2, 0) / al)), 6) AS DECIMAL(28, 6)) AS w FROM pc JOIN pf USING (phrase), ps),
psc AS (SELECT query_no, doc, CAST(sum(w) AS DOUBLE) AS score FROM pw JOIN pq USING (phrase) GROUP BY ALL),
pfound AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, doc) AS rank FROM psc) WHERE rank <= 20)"""


def _memory_corpus(spark: SparkSession, base: str) -> DataFrame:
    m = records.with_search_text(_eligible(_memories(spark, base)))
    return spread(m.select(F.col("mem_no").alias("doc"), F.col("search_text").alias("text")), "doc")


_MEMORY = f"SELECT mem_no AS doc, {_SEARCH_TEXT} AS text FROM memories WHERE {_ELIGIBLE}"


@_query(f"WITH pcorpus AS ({_MEMORY}){_PHRASE_SQL} SELECT query_no, doc, score, rank FROM pfound")
def phrase_rank(spark: SparkSession, base: str) -> DataFrame:
    """The 20 best eligible records of every query by the trigram index's rank."""
    return retrieval.phrase_rank(_memory_corpus(spark, base), _asked(spark, base), 20)


_FUSED = (
    _bm25_sql(_MEMORY, 20)
    + f", pcorpus AS (SELECT * FROM corpus){_PHRASE_SQL}"
    + """, lanes AS (SELECT query_no, doc, rank, 'bm25' AS lane FROM found UNION ALL SELECT query_no, doc, rank, 'phrase' FROM pfound),
rs AS (SELECT query_no, doc, round(CAST(sum(CAST(round(1 / (60 + rank), 12) AS DECIMAL(20, 12))) AS DOUBLE), 10) AS score,
  max(rank) FILTER (lane = 'bm25') AS bm25_rank, max(rank) FILTER (lane = 'phrase') AS phrase_rank FROM lanes GROUP BY ALL),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, doc) AS rank FROM rs) WHERE rank <= 10)"""
)


def _fused(spark: SparkSession, base: str) -> DataFrame:
    corpus, asked = _memory_corpus(spark, base), _asked(spark, base)
    lanes = {"bm25": retrieval.bm25(corpus, asked, 20), "phrase": retrieval.phrase_rank(corpus, asked, 20)}
    return retrieval.fuse(lanes, 10)


@_query(_FUSED + " SELECT query_no, doc, score, rank, bm25_rank, phrase_rank FROM fused")
def hybrid_search(spark: SparkSession, base: str) -> DataFrame:
    """Two lexical lanes over the eligible records, fused by reciprocal ranks."""
    return _fused(spark, base).select("query_no", "doc", "score", "rank", "bm25_rank", "phrase_rank")


@_query(
    _FUSED
    + f""", {_EDGES}, {_REL},
ne AS (SELECT DISTINCT l.mem_no AS src, f.mem_no AS dst, rel FROM links l JOIN first f ON l.target = f.id WHERE l.mem_no <> f.mem_no),
cap AS (SELECT query_no, max(score) * 0.8 AS cap FROM fused GROUP BY query_no),
pb AS (SELECT query_no, dst AS doc, CAST(sum(CAST(round(score * weight, 12) AS DECIMAL(28, 12))) AS DOUBLE) AS s
  FROM fused JOIN ne ON fused.doc = ne.src JOIN rels USING (rel) WHERE weight > 0 GROUP BY ALL)
SELECT query_no, doc, coalesce(score, 0.0) AS base, round(least(coalesce(s, 0.0), cap), 9) AS boost,
  round(coalesce(score, 0.0) + least(coalesce(s, 0.0), cap), 9) AS score
FROM (SELECT query_no, doc, score FROM fused) FULL JOIN pb USING (query_no, doc) JOIN cap USING (query_no)"""
)
def linked_search(spark: SparkSession, base: str) -> DataFrame:
    """Hybrid search with one hop along the found records' links."""
    m = _memories(spark, base)
    target = graph.first_by_id(m).select(F.col("id").alias("target"), F.col("mem_no").alias("dst"))
    e = graph.links(m).join(target, "target").select(F.col("mem_no").alias("src"), "dst", "rel").where("src <> dst").distinct()
    return retrieval.expand(_fused(spark, base), e, graph.relations(spark).select("rel", "weight"))


@_query(
    _FUSED.replace("WITH", "WITH RECURSIVE", 1)
    + f""", cost AS (SELECT mem_no AS doc, {_estimate("coalesce(body, '')")} AS cost FROM memories),
items AS (SELECT query_no, doc, rank, cost, row_number() OVER (PARTITION BY query_no ORDER BY rank) AS n FROM fused JOIN cost USING (doc)),
fold AS (SELECT query_no, doc, rank, cost, n, cost <= 600 AS taken, CASE WHEN cost <= 600 THEN cost ELSE 0 END AS used FROM items WHERE n = 1
  UNION ALL SELECT i.query_no, i.doc, i.rank, i.cost, i.n, f.used + i.cost <= 600, f.used + CASE WHEN f.used + i.cost <= 600 THEN i.cost ELSE 0 END
  FROM fold f JOIN items i ON i.query_no = f.query_no AND i.n = f.n + 1)
SELECT query_no, doc, CAST(rank AS INTEGER) AS rank, cost, CASE WHEN taken THEN 'selected' ELSE 'budget' END AS status FROM fold"""
)
def packed_context(spark: SparkSession, base: str) -> DataFrame:
    """The found records of every query packed under a budget of 600 estimated tokens."""
    cost = tx.token_estimate(F.coalesce("body", F.lit("")))
    sized = _memories(spark, base).select(F.col("mem_no").alias("doc"), cost.alias("cost"))
    ranked = _fused(spark, base).select("query_no", "doc", F.col("rank").cast("int").alias("rank")).join(sized, "doc")
    return retrieval.pack_budget(ranked, 600)


_TITLE = r"""coalesce(nullif(trim(regexp_extract(body, '(?m)^[ \t]*#+[ \t]*(.*?)[ \t\r]*$', 1)), ''), nullif(injection_summary, ''), nullif(canonical_summary, ''), id)"""


@_query(
    _FUSED
    + f""", sc AS (SELECT query_no, doc, rank AS old_rank,
  CAST(len(list_intersect(list_distinct({_tokens('query')}), list_distinct({_tokens('title')}))) AS DOUBLE) AS rerank_score
  FROM fused JOIN (SELECT mem_no AS doc, {_TITLE} AS title FROM memories) USING (doc) JOIN (SELECT case_no AS query_no, query FROM eval_cases) USING (query_no))
SELECT query_no, doc, old_rank, coalesce(rerank_score, 0.0) AS rerank_score, row_number() OVER (PARTITION BY query_no
  ORDER BY CASE WHEN old_rank <= 6 THEN 0 ELSE 1 END, CASE WHEN old_rank <= 6 THEN coalesce(rerank_score, 0.0) END DESC NULLS LAST, old_rank) AS rank FROM sc"""
)
def reranked_search(spark: SparkSession, base: str) -> DataFrame:
    """Hybrid search, its first 6 results in the order of the query's tokens in the title."""
    found = _fused(spark, base).select("query_no", "doc", "rank")
    t = tx.title(*[F.col(c) for c in ("body", "injection_summary", "canonical_summary", "id")])
    titles_ = _memories(spark, base).select(F.col("mem_no").alias("doc"), tx.tokens(t).alias("title"))
    asked = _asked(spark, base).select("query_no", tx.tokens(F.col("query")).alias("asked"))
    score = F.size(F.array_intersect("asked", "title")).cast("double")
    scores = found.join(titles_, "doc").join(asked, "query_no").select("query_no", "doc", score.alias("rerank_score"))
    return retrieval.rerank(found, scores, 3)


@_query(
    _versions_sql("semantic_hash")
    + f""", live AS (SELECT DISTINCT store_id, memory_id FROM v WHERE valid_from_us <= {INSTANT_US} AND (valid_until_us = -1 OR valid_until_us > {INSTANT_US})),
m AS (SELECT mem_no AS doc, list_distinct({_tokens("concat_ws(' ', canonical_summary, body, array_to_string(tags, ' '))")}) AS tk
  FROM memories JOIN live ON memories.store_id = live.store_id AND memories.id = live.memory_id),
q AS (SELECT DISTINCT case_no AS query_no, unnest({_tokens('query')}) AS term FROM eval_cases),
sc AS (SELECT query_no, doc, count(*) AS score FROM (SELECT doc, unnest(tk) AS term FROM m) JOIN q USING (term) GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, doc) AS rank FROM sc) WHERE rank <= 5"""
)
def as_of_search(spark: SparkSession, base: str) -> DataFrame:
    """The records valid at an instant that hold most of each query's tokens."""
    view = history.periods(history.satellite(table(spark, base, "revisions")))
    live = history.as_of(view, INSTANT_US).select("store_id", F.col("memory_id").alias("id")).distinct()
    text = F.concat_ws(" ", "canonical_summary", "body", F.array_join("tags", " "))
    m = _memories(spark, base).join(live, ["store_id", "id"], "left_semi").select(F.col("mem_no").alias("doc"), text.alias("text"))
    return retrieval.overlap(m, _asked(spark, base), 5)


@_query("""
SELECT store_id, row_number() OVER (PARTITION BY store_id ORDER BY strength DESC, path, mem_no) AS line_no,
  '- [' || coalesce(type, '') || '] ' || coalesce(id, '') || ' (' || coalesce(strength, 0) || ')' AS line FROM memories""")
def index_listing(spark: SparkSession, base: str) -> DataFrame:
    """The lines of each store's index, strongest records first."""
    e = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0" if c == "strength" else ""))
    line = F.concat(F.lit("- ["), e("type"), F.lit("] "), e("id"), F.lit(" ("), e("strength"), F.lit(")"))
    m = _memories(spark, base).select("store_id", "strength", "path", "mem_no", line.alias("line"))
    listed = placed(m, ["store_id"], [F.col("strength").desc_nulls_last(), F.col("path"), F.col("mem_no")])
    return listed.select("store_id", F.col("place").alias("line_no"), "line")


@_query("""
SELECT store_id, arg_min(reason, rev_row) AS first_reason, count(*) AS rows_seen, count(DISTINCT memory_id) AS records,
  count(*) FILTER (coalesce(unknown_gap, false)) AS with_gap, count(*) FILTER (revision IS NULL) AS unnumbered FROM revisions GROUP BY store_id""")
def provenance_by_store(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "revisions").groupBy("store_id").agg(
        F.min_by("reason", "rev_row").alias("first_reason"),
        F.count("*").alias("rows_seen"),
        F.countDistinct("memory_id").alias("records"),
        F.count_if(F.coalesce("unknown_gap", F.lit(False))).alias("with_gap"),
        F.count_if(F.col("revision").isNull()).alias("unnumbered"),
    )


_PATH = r"[a-z]+/[a-z0-9_]+\.[a-z]{1,4}"


@_query(f"""
WITH m AS (SELECT DISTINCT mem_no, unnest(regexp_extract_all(body, '{_PATH}')) AS path FROM memories WHERE body IS NOT NULL),
d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{_PATH}')) AS path FROM documents WHERE text IS NOT NULL),
mp AS (SELECT path, count(*) AS records FROM m GROUP BY path), dp AS (SELECT path, count(*) AS documents FROM d GROUP BY path),
dd AS (SELECT split_part(path, '/', 1) AS folder, count(DISTINCT path) AS siblings FROM d GROUP BY 1)
SELECT path, records, coalesce(documents, 0) AS documents, CASE WHEN documents IS NOT NULL THEN 'exact' WHEN siblings IS NOT NULL THEN 'folder' ELSE 'none' END AS tier
FROM mp LEFT JOIN dp USING (path) LEFT JOIN dd ON split_part(path, '/', 1) = folder""")
def path_matches(spark: SparkSession, base: str) -> DataFrame:
    """Paths that records mention, by how closely documents mention them: the path, its folder, or neither."""
    paths = lambda df, key, c: df.where(F.col(c).isNotNull()).select(
        key, F.explode(F.array_distinct(F.regexp_extract_all(F.col(c), F.lit(f"({_PATH})"), 1))).alias("path")
    )
    m = paths(_memories(spark, base), "mem_no", "body").groupBy("path").agg(F.count("*").alias("records"))
    d = paths(table(spark, base, "documents"), "doc_id", "text").groupBy("path").agg(F.count("*").alias("documents"))
    folder = F.substring_index("path", "/", 1)
    f = d.groupBy(folder.alias("folder")).agg(F.count("*").alias("siblings"))
    tier = F.when(F.col("documents").isNotNull(), "exact").when(F.col("siblings").isNotNull(), "folder").otherwise("none")
    return (
        m.join(d, "path", "left")
        .withColumn("folder", folder)
        .join(f, "folder", "left")
        .select("path", "records", F.coalesce("documents", F.lit(0)).alias("documents"), tier.alias("tier"))
    )


@_query("""
WITH v AS (SELECT DISTINCT store_id, path, fingerprint FROM vectors WHERE content_hash <> 'stale'), m AS (SELECT mem_no, store_id, path, type FROM memories)
SELECT type, count(*) AS records, count(*) FILTER (EXISTS (SELECT 1 FROM v WHERE v.store_id = m.store_id AND v.path = m.path)) AS embedded FROM m GROUP BY type""")
def embedding_coverage(spark: SparkSession, base: str) -> DataFrame:
    """Records with and without a current vector, by type."""
    v = table(spark, base, "vectors").where("content_hash <> 'stale'").select("store_id", "path").distinct().withColumn("has", F.lit(1))
    m = _memories(spark, base).select("store_id", "path", "type").join(v, ["store_id", "path"], "left")
    return m.groupBy("type").agg(F.count("*").alias("records"), F.count("has").alias("embedded"))


@_query("""
WITH t AS (SELECT host, role, received_at, text FROM turns WHERE received_at IS NOT NULL)
SELECT epoch_us(date_trunc('month', received_at)) AS month_us, coalesce(host, '') AS host, coalesce(role, '') AS role, count(*) AS turns,
  CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars FROM t GROUP BY CUBE (1, 2, 3)""")
def turn_cube(spark: SparkSession, base: str) -> DataFrame:
    """Turns by month, host and role with all subtotals."""
    t = table(spark, base, "turns").where("received_at is not null").select(
        F.unix_micros(F.date_trunc("month", "received_at")).alias("month_us"),
        F.coalesce("host", F.lit("")).alias("host"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.length(F.coalesce("text", F.lit(""))).alias("n"),
    )
    return t.cube("month_us", "host", "role").agg(F.count("*").alias("turns"), F.sum("n").alias("chars"))


# --- transcripts ---------------------------------------------------------------------------------------


@_query("""
SELECT transcript, count(*) AS turns, sum(deliveries) AS deliveries, min(turn_no) AS first_turn FROM (
  SELECT transcript, ord, role, coalesce(text, '') AS x, min(turn_no) AS turn_no, count(*) AS deliveries FROM turns GROUP BY ALL)
GROUP BY transcript""")
def turns_once(spark: SparkSession, base: str) -> DataFrame:
    once = tn.delivered_once(table(spark, base, "turns"))
    return once.groupBy("transcript").agg(
        F.count("*").alias("turns"), F.sum("deliveries").alias("deliveries"), F.min("turn_no").alias("first_turn")
    )


@_query(f"""
WITH b AS (SELECT transcript, ord // {tn.BLOCK} AS block, count(*) AS n, sha256(string_agg(sha256(coalesce(role, '') || chr(0) || coalesce(text, '')), '' ORDER BY ord, turn_no)) AS b
  FROM turns GROUP BY ALL)
SELECT transcript, CAST(sum(n) AS BIGINT) AS turns, sha256(string_agg(b, '' ORDER BY block)) AS digest FROM b GROUP BY transcript""")
def transcript_digests(spark: SparkSession, base: str) -> DataFrame:
    return tn.digest(table(spark, base, "turns"))


@_query("""
WITH g AS (SELECT coalesce(host, '') AS host, transcript, received_at, CASE WHEN received_at >= lag(received_at) OVER w + INTERVAL 48 HOUR THEN 1 ELSE 0 END AS new
  FROM turns WHERE received_at IS NOT NULL WINDOW w AS (PARTITION BY coalesce(host, ''), transcript ORDER BY received_at)),
s AS (SELECT *, sum(new) OVER (PARTITION BY host, transcript ORDER BY received_at) AS n FROM g)
SELECT host, transcript, epoch_us(min(received_at)) AS from_us, epoch_us(max(received_at) + INTERVAL 48 HOUR) AS until_us, count(*) AS turns FROM s GROUP BY host, transcript, n""")
def host_sessions(spark: SparkSession, base: str) -> DataFrame:
    s = tn.sessions(table(spark, base, "turns"))
    return s.select("host", "transcript", F.unix_micros("session_from").alias("from_us"), F.unix_micros("session_until").alias("until_us"), "turns")
