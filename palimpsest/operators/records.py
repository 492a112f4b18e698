"""Operators on record tables: digests, duplicates, index synchronisation, manifests, vector cache states.

Defined results: nulls compare equal where rows are grouped or matched; empty tables give empty results;
columns of other names are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators.running import placed

#: Between the parts of a digest; null parts are told apart from empty ones.
UNIT, MISSING = "\x1f", "\x00"


def digest(*parts: Column) -> Column:
    """SHA-256 over the parts, order and nulls included."""
    return F.sha2(F.concat_ws(UNIT, *[F.coalesce(p.cast("string"), F.lit(MISSING)) for p in parts]), 256)


def with_search_text(memories: DataFrame) -> DataFrame:
    return memories.withColumn(
        "search_text",
        tx.search_text(*[F.col(c) for c in ("canonical_summary", "injection_summary", "body", "tags", "type", "id")]),
    )


def semantic_digest(memories: DataFrame) -> DataFrame:
    """mem_no, digest: a hash of what a record says; strength and access do not enter it."""
    tags = F.array_join(F.col("tags"), ",", "\x00")
    links = F.array_join(F.transform("links", lambda x: F.concat_ws(">", x["rel"], x["id"])), ",")
    cols = [F.col(c) for c in ("id", "type", "source", "canonical_summary", "injection_summary", "status", "body", "expires")]
    return memories.select("mem_no", digest(*cols, tags, links).alias("digest"))


def exact_duplicates(memories: DataFrame) -> DataFrame:
    """mem_no, class_no, copies: records alike in type, source, body, expiry and tags, with their class.

    Rows are grouped by a digest with map-side combine, so a class of any size is one row in the shuffle;
    a class is named by its least number. Records without a copy are left out.
    """
    source = F.coalesce(F.when(F.trim(F.col("source")) != "", F.lower(F.trim(F.col("source")))), F.lit("agent"))
    d = digest(F.col("type"), source, F.col("body"), F.coalesce("expires", F.lit("")), F.array_join(F.coalesce("tags", F.array()), ","))
    marked = memories.select("mem_no", d.alias("digest"))
    classes = (
        marked.groupBy("digest").agg(F.min("mem_no").alias("class_no"), F.count("*").alias("copies")).where(F.col("copies") > 1)
    )
    return marked.join(classes, "digest").select("mem_no", "class_no", "copies")


def source_identity(events: DataFrame, identity: list[str], payload: Column, arrival: str) -> DataFrame:
    """Every event with `verdict`: first of its identity, duplicate of the first's payload, or conflict.

    The first payload comes from an aggregate with map-side combine rather than a window, so an identity
    that a third of all events carry is no hot partition before the join, and adaptive execution splits it there.
    """
    marked = events.withColumn("_payload", payload)
    first = marked.groupBy(*identity).agg(
        F.min(arrival).alias("first_arrival"), F.min_by("_payload", arrival).alias("first_payload")
    )
    cond = None
    right = first.select(*[F.col(c).alias(f"f_{c}") for c in identity], "first_arrival", "first_payload")
    for c in identity:
        one = F.col(c).eqNullSafe(F.col(f"f_{c}"))
        cond = one if cond is None else cond & one
    verdict = (
        F.when(F.col(arrival) == F.col("first_arrival"), "first")
        .when(F.col("_payload").eqNullSafe(F.col("first_payload")), "duplicate")
        .otherwise("conflict")
    )
    return marked.join(right, cond).select(*events.columns, verdict.alias("verdict"))


def sync_actions(held: DataFrame, current: DataFrame, keys: list[str], print_: str) -> DataFrame:
    """What an index must do to follow its source: keys, action (insert, update, delete, keep).

    A full join of fingerprints; both sides have `keys` (unique, not null) and the fingerprint `print_`.
    """
    old = held.select(*keys, F.col(print_).alias("old"), F.lit(True).alias("has_old"))
    new = current.select(*keys, F.col(print_).alias("new"), F.lit(True).alias("has_new"))
    action = (
        F.when(F.col("has_old").isNull(), "insert")
        .when(F.col("has_new").isNull(), "delete")
        .when(F.col("old").eqNullSafe(F.col("new")), "keep")
        .otherwise("update")
    )
    return old.join(new, keys, "full").select(*keys, action.alias("action"))


def cache_actions(vectors: DataFrame, memories: DataFrame) -> DataFrame:
    """store_id, path, action: `sync_actions` of cached content hashes and the hashes of the records' search text.

    Several records of one path stand for the one with the least number. Rows of one path that differ in their
    hash are no current cache, whichever of them the record agrees with.
    """
    held = vectors.groupBy("store_id", "path").agg(
        F.when(F.min("content_hash").eqNullSafe(F.max("content_hash")) & (F.count("content_hash") == F.count("*")), F.min("content_hash"))
        .otherwise("stale")
        .alias("print")
    )
    now = memories.groupBy("store_id", "path").agg(F.min_by(F.sha2("search_text", 256), "mem_no").alias("print"))
    return sync_actions(held, now, ["store_id", "path"], "print")


def manifest(files: DataFrame) -> DataFrame:
    """Per store: files, bytes and a hash over all (path, size, sha256); `files`: store_id, path, content.

    The hash is the sum of the files' hashes, so it needs no order and is combined on the map side.
    """
    sized = files.select(
        "store_id", "path", F.octet_length("content").cast("bigint").alias("size"), F.sha2(F.col("content"), 256).alias("sha256")
    )
    mark = F.conv(F.substring(digest(F.col("path"), F.col("size"), F.col("sha256")), 1, 15), 16, 10).cast("decimal(38,0)")
    return sized.groupBy("store_id").agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum(mark).cast("string").alias("content_mark")
    )


def byte_pages(rows: DataFrame, group: str, order: list[str], size: Column, page_bytes: int) -> DataFrame:
    """`rows` with `offset`, the bytes before a row in its group, and `page`, the page it begins in."""
    placed_ = placed(rows, [group], [F.col(c) for c in order], size)
    return placed_.drop("place").withColumnRenamed("before", "offset").withColumn("page", F.floor(F.col("offset") / page_bytes))


def vector_states(vectors: DataFrame, records: DataFrame) -> DataFrame:
    """Every cached vector with its state: corrupt, orphan (no such record), stale, or ready.

    A vector is sound if its list has `dimensions` finite numbers, not all 0. `records`: store_id, path (unique).
    """
    v = F.from_json("vector_json", "array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = v.isNotNull() & (F.size(v) == F.col("dimensions")) & finite & F.exists(v, lambda x: x != 0)
    known = records.select("store_id", "path", F.lit(True).alias("known"))
    state = (
        F.when(~F.coalesce(sound, F.lit(False)), "corrupt")
        .when(F.col("known").isNull(), "orphan")
        .when(F.col("content_hash") == "stale", "stale")
        .otherwise("ready")
    )
    return vectors.join(known, ["store_id", "path"], "left").select(*vectors.columns, state.alias("state"))


def manifest_states(listed: DataFrame, held: DataFrame) -> DataFrame:
    """store_id, path, state of every file of a manifest or a store: same, changed, missing or unlisted; both have `print`."""
    joined = listed.withColumnRenamed("print", "_l").join(held.withColumnRenamed("print", "_h"), ["store_id", "path"], "full")
    state = (
        F.when(F.col("_h").isNull(), "missing")
        .when(F.col("_l").isNull(), "unlisted")
        .when(F.col("_h") == F.col("_l"), "same")
        .otherwise("changed")
    )
    return joined.select("store_id", "path", state.alias("state"))


def values_at(counts: DataFrame, group: str, value: str, count: str, places: dict[str, Column]) -> DataFrame:
    """The values at places (from 0, of the number of rows `n`) of each group's ordered values: `group`, n, one column a place.

    `counts` has a row per group and distinct value. Only these are ordered, so a group's rows never meet in one task.
    """
    w = Window.partitionBy(group).orderBy(value)
    upto = F.sum(count).over(w.rowsBetween(Window.unboundedPreceding, 0))
    whole = Window.partitionBy(group)
    ranked = counts.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col(count)).withColumn("n", F.sum(count).over(whole))
    inside = lambda p: (F.col("_from") <= p) & (p < F.col("_to"))
    return ranked.groupBy(group, "n").agg(*[F.max(F.when(inside(p), F.col(value))).alias(name) for name, p in places.items()])


def applicability(rows: DataFrame, key: str, paths: str, there: DataFrame) -> DataFrame:
    """`rows` with applicability and reason: whether all of a row's `paths` (an array) are in `there` (path, unique)."""
    declared = rows.select(key, F.explode(paths).alias("path")).join(there.withColumn("_t", F.lit(1)), "path", "left")
    counts = declared.groupBy(key).agg(F.count("*").alias("_d"), F.count("_t").alias("_p"))
    verdict = F.when(F.col("_d").isNull(), "unknown").when(F.col("_p") == F.col("_d"), "applicable").otherwise("not_applicable")
    reason = (
        F.when(F.col("_d").isNull(), "no_path_declared")
        .when(F.col("_p") == F.col("_d"), "all_paths_present")
        .when(F.col("_p") == 0, "no_path_present")
        .otherwise("path_missing")
    )
    return rows.join(counts, key, "left").select(*rows.columns, verdict.alias("applicability"), reason.alias("reason"))


def path_tiers(used: DataFrame, there: DataFrame) -> DataFrame:
    """`used` (path and others) with `tier`: 1 the path is `there`, 2 its folder and its name are, 3 the folder, 4 the name, 5 neither."""
    folder, name = F.substring_index("path", "/", 1), F.substring_index("path", "/", -1)
    has = lambda c, label: there.select(c.alias(label)).distinct().withColumn(f"_{label}", F.lit(True))
    joined = used.withColumn("folder", folder).withColumn("name", name)
    joined = joined.join(there.withColumn("_path", F.lit(True)), "path", "left").join(has(folder, "folder"), "folder", "left").join(has(name, "name"), "name", "left")
    tier = (
        F.when(F.col("_path"), 1)
        .when(F.col("_folder") & F.col("_name"), 2)
        .when(F.col("_folder"), 3)
        .when(F.col("_name"), 4)
        .otherwise(5)
    )
    return joined.select(*used.columns, tier.alias("tier"))


def token_pairs(sets: DataFrame, within: list[str], threshold: float) -> DataFrame:
    """Pairs of token sets of one group that share `threshold` of all their tokens: `within`, a, b (numbers, a < b), similarity.

    `sets`: `within`, no (unique), tokens (distinct, sorted). Of a set's tokens, rarest first, only the first
    n - ceil(threshold * n) + 1 are joined: two sets that reach the threshold share one of them. Rare tokens meet few
    sets, so no group is compared pair by pair; the candidates are verified on whole sets.
    """
    full = sets.where(F.size("tokens") > 0)
    frequency = full.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("f"))
    ranked = (
        full.select(*within, "no", F.size("tokens").alias("n"), F.explode("tokens").alias("t"))
        .join(frequency, "t")
        .groupBy(*within, "no", "n")
        .agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("o"))
    )
    first = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    prefix = ranked.select(*within, "no", "n", F.explode(F.slice("o", F.lit(1), first.cast("int"))["t"]).alias("t"))
    other = prefix.select(*within, F.col("no").alias("b"), F.col("n").alias("m"), "t")
    near = (F.col("n") >= threshold * F.col("m") - 1e-9) & (F.col("m") >= threshold * F.col("n") - 1e-9)
    candidates = prefix.withColumnRenamed("no", "a").join(other, [*within, "t"]).where((F.col("a") < F.col("b")) & near).select(*within, "a", "b").distinct()
    left = full.select(F.col("no").alias("a"), F.col("tokens").alias("x"))
    right = full.select(F.col("no").alias("b"), F.col("tokens").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    similarity = shared / (F.size("x") + F.size("y") - shared)
    return candidates.join(left, "a").join(right, "b").select(*within, "a", "b", similarity.alias("similarity")).where(F.col("similarity") >= threshold - 1e-9)


def write_classes(rows: DataFrame, identity: list[str], fact: list[str], payload: Column, arrival: str, active: Column) -> DataFrame:
    """`rows` with `verdict`: of a row whose identity came before, duplicate (the first one's payload) or conflict; of a
    first one, supported (an active record before it says the same: equal in `fact`) or created.

    Both looks back are aggregates with map-side combine, so no identity or fact is a hot window.
    """
    marked = source_identity(rows.withColumn("_active", active), identity, payload, arrival)
    earliest = marked.where("_active").groupBy(*[F.col(c).alias(f"f_{c}") for c in fact]).agg(F.min(arrival).alias("_before"))
    cond = F.lit(True)
    for c in fact:
        cond = cond & F.col(c).eqNullSafe(F.col(f"f_{c}"))
    verdict = (
        F.when(F.col("verdict") != "first", F.col("verdict")).when(F.col("_before") < F.col(arrival), "supported").otherwise("created")
    )
    return marked.join(earliest, cond, "left").select(*rows.columns, verdict.alias("verdict"))


def backfill(records_: DataFrame, vectors: DataFrame) -> DataFrame:
    """What a run over the records (store_id, path, mem_no, search_text) does for each cached fingerprint: fingerprint, written,
    skipped_stale (the text changed between the loads of a path), invalid (nothing to embed), current.

    A vector is current if its hash is not marked stale; records without a path are none.
    """
    texts = records_.where(F.col("path").isNotNull()).groupBy("store_id", "path").agg(
        F.countDistinct(F.sha2("search_text", 256)).alias("_v"), F.max(F.trim("search_text") != "").alias("_full")
    )
    cached = vectors.where(F.coalesce("content_hash", F.lit("stale")) != "stale").select("store_id", "path", "fingerprint").distinct()
    wanted = texts.crossJoin(F.broadcast(vectors.select("fingerprint").distinct()))  # a cache has a handful of fingerprints
    joined = wanted.join(cached.withColumn("_c", F.lit(1)), ["store_id", "path", "fingerprint"], "left")
    state = (
        F.when(F.col("_c").isNotNull(), "current").when(~F.col("_full"), "invalid").when(F.col("_v") > 1, "skipped_stale").otherwise("written")
    )
    return joined.withColumn("_s", state).groupBy("fingerprint").agg(
        *[F.count_if(F.col("_s") == n).alias(n) for n in ("written", "skipped_stale", "invalid", "current")]
    )
