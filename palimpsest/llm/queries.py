"""Registered queries of the subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import knn, leakage, neardup, packing, pii, splitting
from palimpsest.sources.tables import spread, table


def _documents(spark: SparkSession, base: str) -> DataFrame:
    return spread(table(spark, base, "documents").select("doc_id", "text"), "doc_id")


def _mentions(spark: SparkSession, base: str) -> DataFrame:
    parts = []
    for name, key, text in (("memories", "mem_no", "body"), ("turns", "turn_no", "text")):
        rows = table(spark, base, name).select(F.lit(name).alias("tbl"), F.col(key).alias("row_no"), F.col(text).alias("text"))
        parts.append(pii.find(spread(rows, "row_no"), "text", ["tbl", "row_no"]))
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return _mentions(spark, base).select("tbl", "row_no", "kind", "char_start", "char_end")


def p2_redacted(spark: SparkSession, base: str) -> DataFrame:
    """The texts with placeholders, of the rows that changed."""
    parts = []
    for name, key, text in (("memories", "mem_no", "body"), ("turns", "turn_no", "text")):
        rows = table(spark, base, name).select(F.lit(name).alias("tbl"), F.col(key).alias("row_no"), F.col(text).alias("text"))
        parts.append(pii.redacted_rows(spread(rows, "row_no"), "text", ["tbl", "row_no"]))
    return parts[0].unionByName(parts[1])


def p2_kinds(spark: SparkSession, base: str) -> DataFrame:
    """How many mentions of each kind each table holds, and in how many rows."""
    return _mentions(spark, base).groupBy("tbl", "kind").agg(
        F.count("*").alias("mentions"), F.countDistinct("row_no").alias("rows")
    )


def _vectors(spark: SparkSession, base: str) -> DataFrame:
    cols = ("vec_no", "fingerprint", "dimensions", "vector_json")
    return spread(table(spark, base, "vectors").select(*cols), "vec_no")


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    near = knn.neighbours(_vectors(spark, base))
    return near.select(
        F.least("id", "neighbour").alias("vec_no_a"),
        F.greatest("id", "neighbour").alias("vec_no_b"),
        F.col("id").alias("of_vec"),
    )


def p4_recall(spark: SparkSession, base: str) -> DataFrame:
    """Recall against brute force over the rows whose id is divisible by 20, by rank."""
    rows = _vectors(spark, base)
    exact = knn.brute_force(rows, rows.where(F.col("vec_no") % 20 == 0))
    near = knn.neighbours(rows).select("id", "neighbour", F.lit(1).alias("hit"))
    return (
        exact.join(near, ["id", "neighbour"], "left")
        .groupBy("rank")
        .agg(F.count("*").alias("neighbours"), F.count("hit").alias("found"))
    )


def _near_duplicates(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "memories").select("mem_no", "body", "canonical_summary")
    return neardup.pairs(spread(rows, "mem_no"), ("body", "canonical_summary"), "mem_no")


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return _near_duplicates(spark, base).select(
        F.col("a").alias("mem_no_a"), F.col("b").alias("mem_no_b"), "field"
    )


def p5_groups(spark: SparkSession, base: str) -> DataFrame:
    """The groups of records that near-duplicate bodies or summaries link: every member with its group."""
    rows = spread(table(spark, base, "memories").select("mem_no", "body", "canonical_summary"), "mem_no")
    found = neardup.components(neardup.links(rows, ("body", "canonical_summary"), "mem_no"))
    sizes = found.groupBy("component").agg(F.count("*").alias("members"))
    return found.join(sizes, "component").select(F.col("id").alias("mem_no"), F.col("component").alias("group_no"), "members")


def p6_containers(spark: SparkSession, base: str) -> DataFrame:
    """Every document's items with their container of at most 2,048 tokens."""
    return packing.pack(_documents(spark, base)).select(
        "doc_id", "part_no", "token_start", "tokens", "container", "container_tokens"
    )


def p6_fill(spark: SparkSession, base: str) -> DataFrame:
    """Containers and unused room, by how full they are (in twentieths)."""
    bins = packing.pack(_documents(spark, base)).groupBy("container").agg(
        F.sum("tokens").alias("tokens"), F.count("*").alias("items")
    )
    return bins.groupBy(F.floor(F.col("tokens") * 20 / 2048).alias("twentieth")).agg(
        F.count("*").alias("containers"),
        F.sum("items").alias("items"),
        F.sum("tokens").alias("tokens"),
        F.sum(2048 - F.col("tokens")).alias("unused"),
    )


def p8_pieces(spark: SparkSession, base: str) -> DataFrame:
    return splitting.split(_documents(spark, base))


def _leaks(spark: SparkSession, base: str, **how) -> DataFrame:
    return leakage.leaks(_documents(spark, base), table(spark, base, "eval_seeds").select("id", "text"), **how)


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    """Passages of 12 words with at most one edit, of which those without one are the cases."""
    return _leaks(spark, base, edits=1).where(F.col("run") >= 12).select("doc_id", "seed_id")


def p7_leaked_items(spark: SparkSession, base: str) -> DataFrame:
    """Per test item: how many documents hold a passage of it, and the longest passage in words."""
    found = _leaks(spark, base, edits=1).where(F.col("run") >= 12)
    return found.groupBy("seed_id").agg(F.count("*").alias("documents"), F.max("run").alias("longest_run"))


def p7_edited(spark: SparkSession, base: str) -> DataFrame:
    """Documents with 20 consecutive words of a test item but for up to 4 edits: the least edits, the longest run of equal words."""
    return _leaks(spark, base, words=20, edits=4).select("doc_id", "seed_id", "edits", "run")


_WORDS = """regexp_extract_all(regexp_replace(lower(text), '([\\x{3400}-\\x{9FFF}])', ' \\1 ', 'g'), '[\\p{L}\\p{N}]+')"""

_P7 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT id, {_WORDS} AS w FROM eval_seeds WHERE text IS NOT NULL AND id IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i+11], ' '))) AS g FROM d WHERE len(w) >= 12),
sg AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i+11], ' '))) AS g FROM s WHERE len(w) >= 12)
SELECT DISTINCT doc_id, id AS seed_id FROM dg JOIN sg USING (g)"""


QUERIES = {
    "p2_found": p2_found,
    "p2_redacted": p2_redacted,
    "p2_kinds": p2_kinds,
    "p4_found": p4_found,
    "p4_recall": p4_recall,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_containers": p6_containers,
    "p6_fill": p6_fill,
    "p7_found": p7_found,
    "p7_leaked_items": p7_leaked_items,
    "p7_edited": p7_edited,
    "p8_pieces": p8_pieces,
}
_P7_ITEMS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT id, {_WORDS} AS w FROM eval_seeds WHERE text IS NOT NULL AND id IS NOT NULL),
dg AS (SELECT doc_id, unnest(range(1, len(w) - 10)) AS i, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i+11], ' '))) AS g FROM d WHERE len(w) >= 12),
sg AS (SELECT id, unnest(range(1, len(w) - 10)) AS j, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i+11], ' '))) AS g FROM s WHERE len(w) >= 12),
m AS (SELECT DISTINCT doc_id, id, i - j AS diagonal, i FROM dg JOIN sg USING (g)),
r AS (SELECT doc_id, id, diagonal, i - row_number() OVER (PARTITION BY doc_id, id, diagonal ORDER BY i) AS island FROM m),
n AS (SELECT doc_id, id, count(*) + 11 AS run FROM r GROUP BY doc_id, id, diagonal, island)
SELECT id AS seed_id, count(DISTINCT doc_id) AS documents, CAST(max(run) AS INTEGER) AS longest_run FROM n GROUP BY id"""

#: The exact neighbours, of which the operator may miss a few.
_P4 = """
WITH p AS (SELECT vec_no, coalesce(fingerprint, chr(0)) AS fp, dimensions AS dm, CASE WHEN json_valid(vector_json) AND json_type(vector_json) = 'ARRAY'
    AND json_array_length(vector_json) = dimensions
    AND len(list_filter(json_extract(vector_json, '$[*]'), lambda x: json_type(x) NOT IN ('DOUBLE', 'BIGINT', 'UBIGINT'))) = 0
    THEN try_cast(vector_json AS DOUBLE[]) END AS v FROM vectors),
q AS (SELECT vec_no, fp, dm, list_transform(v, lambda x: x / list_max(list_transform(v, lambda y: abs(y)))) AS v FROM p
  WHERE len(v) = dm AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
u AS (SELECT vec_no, fp, dm, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM q),
c AS (SELECT a.vec_no AS of_vec, b.vec_no AS other, round(list_dot_product(a.v, b.v), 12) AS s FROM u a JOIN u b ON a.fp = b.fp AND a.dm = b.dm AND a.vec_no <> b.vec_no)
SELECT least(of_vec, other) AS vec_no_a, greatest(of_vec, other) AS vec_no_b, of_vec FROM (
  SELECT *, row_number() OVER (PARTITION BY of_vec ORDER BY s DESC, other) AS n FROM c) WHERE n <= 5"""

_NORMAL = "trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
#: Candidates by the rarest 5-grams (prefixes, and the overlap their places still allow), verified on whole sets.
_P5 = f"""
WITH t AS (SELECT mem_no, 'body' AS field, {_NORMAL.format(c='body')} AS x FROM memories
  UNION ALL SELECT mem_no, 'canonical_summary', {_NORMAL.format(c='canonical_summary')} FROM memories),
d AS (SELECT row_number() OVER () AS id, field, x, list_distinct(list_transform(range(1, length(x) - 3), lambda i: hash(substring(x, i, 5)))) AS g
  FROM (SELECT DISTINCT field, x FROM t WHERE length(x) >= 5)),
e AS (SELECT id, field, len(g) AS n, unnest(g) AS w FROM d),
f AS (SELECT field, w, count(*) AS c FROM e GROUP BY ALL),
r AS (SELECT id, field, n, w, row_number() OVER (PARTITION BY id ORDER BY c, w) AS k FROM e JOIN f USING (field, w)),
p AS (SELECT * FROM r WHERE k <= n - CAST(ceil(0.7 * n - 1e-9) AS BIGINT) + 1),
k AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.field = b.field AND a.w = b.w AND a.id < b.id AND a.n >= 0.7 * b.n AND b.n >= 0.7 * a.n
  AND 1 + least(a.n - a.k, b.n - b.k) >= (a.n + b.n) * 0.7 / 1.7 - 1e-6),
s AS (SELECT a, b, len(list_intersect(x.g, y.g)) AS s, len(x.g) + len(y.g) AS n FROM k JOIN d x ON x.id = a JOIN d y ON y.id = b),
l AS (SELECT a, b FROM s WHERE s >= 0.7 * (n - s) UNION ALL SELECT id, id FROM d),
m AS (SELECT mem_no, id, t.field FROM t JOIN d ON t.field = d.field AND t.x = d.x)
SELECT DISTINCT least(u.mem_no, v.mem_no) AS mem_no_a, greatest(u.mem_no, v.mem_no) AS mem_no_b, u.field
FROM l JOIN m u ON u.id = a JOIN m v ON v.id = b AND u.field = v.field WHERE u.mem_no <> v.mem_no"""

SQL: dict[str, str] = {"p4_found": _P4, "p5_found": _P5, "p7_found": _P7, "p7_leaked_items": _P7_ITEMS}
