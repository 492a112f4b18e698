"""The links of records as a labelled graph: edges, unresolved targets, reach, cycles.

Links name bare ids; a bare id stands for the first record of that id, by scope (global first), store and
path. Walks are bounded by a depth and carry least depths only, one row per vertex and round, so work grows
with the edges, not with the paths.

Defined results: null links and null ids are no links; links repeated in a record count once; links of a
record to itself are no edges; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.sources.tables import cut

# Each relation's reverse name and the share of score it passes on.
RELATIONS = (
    ("caused_by", "causes", 0.6),
    ("refines", "refined_by", 0.7),
    ("supersedes", "superseded_by", 0.0),
    ("contradicts", "contradicts", 0.0),
    ("related", "related", 0.5),
)


def relations(spark) -> DataFrame:
    return spark.createDataFrame(list(RELATIONS), "rel string, reverse string, weight double")


def first_by_id(memories: DataFrame) -> DataFrame:
    """One record per bare id: id, mem_no, store_id; first by scope, store, path and number."""
    order = [F.when(F.col("scope") == "global", 0).otherwise(1), "store_id", "path", "mem_no"]
    w = Window.partitionBy("id").orderBy(*order)
    return (
        memories.where(F.col("id").isNotNull())
        .withColumn("place", F.row_number().over(w))
        .where(F.col("place") == 1)
        .select("id", "mem_no", "store_id")
    )


def links(memories: DataFrame) -> DataFrame:
    """mem_no, store_id, id, target, rel; once each."""
    return (
        memories.select("mem_no", "store_id", "id", F.explode("links").alias("l"))
        .select("mem_no", "store_id", "id", F.col("l.id").alias("target"), F.col("l.rel").alias("rel"))
        .where(F.col("target").isNotNull() & F.col("rel").isNotNull() & F.col("id").isNotNull())
        .distinct()
    )


def edges(memories: DataFrame) -> DataFrame:
    """src, dst, rel between bare ids that exist."""
    known = first_by_id(memories).select(F.col("id").alias("dst"))
    one = links(memories).select(F.col("id").alias("src"), F.col("target").alias("dst"), "rel").distinct()
    return one.where(F.col("src") != F.col("dst")).join(known, "dst", "left_semi").select("src", "dst", "rel")


def dependents(links_: DataFrame, targets: DataFrame) -> DataFrame:
    """store_id, mem_no, rel: records outside `targets` (id, unique) that link to one of them."""
    to = links_.join(targets.withColumnRenamed("id", "target"), "target", "left_semi")
    return to.join(targets, "id", "left_anti").select("store_id", "mem_no", "rel").distinct()


def both_ways(edges_: DataFrame, relations_: DataFrame) -> DataFrame:
    """Edges with their reverses under the reverse's name, once each."""
    back = edges_.join(F.broadcast(relations_), "rel").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("reverse").alias("rel"))
    return edges_.select("src", "dst", "rel").unionByName(back).distinct()


def reach(edges_: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """id, depth: the vertices within `depth` steps of any start, with their least distance."""
    steps = edges_.select("src", "dst").distinct()
    seen = starts.select("id").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for d in range(1, depth + 1):
        new = (
            frontier.select(F.col("id").alias("src"))
            .join(steps, "src")
            .select(F.col("dst").alias("id"))
            .distinct()
            .join(seen, "id", "left_anti")
            .withColumn("depth", F.lit(d))
        )
        if d < depth:
            new = cut(new)
        seen, frontier = seen.unionByName(new), new
    return seen


def _peeled(core: DataFrame) -> DataFrame:
    """The edges that go on and have come from somewhere, until no more can be taken away."""
    rows = core.count()
    while rows:
        before = rows
        for _ in range(3):
            core = core.join(core.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(
                core.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"
            ).select("src", "dst")
        core = cut(core)
        rows = core.count()
        if rows == before:
            break
    return core


def _spread_least(core: DataFrame, labels: DataFrame) -> DataFrame:
    """id, label: the least label of all vertices that lead to a vertex, itself included; `labels`: id, label."""
    while True:
        came = labels.join(core, labels["id"] == core["src"]).select(F.col("dst").alias("id"), "label")
        new = cut(labels.select("id", "label").unionByName(came).groupBy("id").agg(F.min("label").alias("label")))
        changed = new.withColumnRenamed("label", "now").join(labels, "id").where("now <> label").limit(1).count()
        labels = new
        if not changed:
            return labels


def _components(core: DataFrame) -> DataFrame:
    """The edges of `core` that lie on cycles, that is inside a strongly connected component.

    Edges between vertices with different least forward or backward labels lie in no common component and go;
    edges whose ends share a root's component (the root's label came both ways) are done and leave the rest.
    """
    done = core.limit(0)
    core = _peeled(core)
    while core.count():
        ids = core.select(F.col("src").alias("id")).unionByName(core.select(F.col("dst").alias("id"))).distinct()
        start = ids.withColumn("label", F.col("id"))
        ahead = _spread_least(core, start).withColumnRenamed("label", "ahead")
        back = _spread_least(core.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start).withColumnRenamed("label", "back")
        both = cut(ahead.join(back, "id"))
        ends = lambda end: both.select(F.col("id").alias(end), F.col("ahead").alias(f"{end}_a"), F.col("back").alias(f"{end}_b"))
        same = core.join(ends("src"), "src").join(ends("dst"), "dst").where("src_a = dst_a and src_b = dst_b")
        done = done.unionByName(same.where("src_a = src_b").select("src", "dst"))
        core = _peeled(cut(same.where("src_a <> src_b").select("src", "dst")))
    return cut(done)


def on_cycles(edges_: DataFrame, depth: int | None = None) -> DataFrame:
    """id, length: vertices that return to themselves along the edges, with the edges of their shortest way back.

    With a `depth`, only cycles of at most so many edges. Vertices without both an incoming and an outgoing edge
    are peeled off, then all edges outside strongly connected components; walks stay in the components and
    carry one row per start and vertex reached, with the first distance, until none is new.
    """
    core = _components(cut(edges_.select("src", "dst").distinct()))
    walk = cut(core.select(F.col("src").alias("start"), F.col("dst").alias("at")).distinct().withColumn("length", F.lit(1)))
    seen = walk
    while (depth is None or walk.first() and walk.first().length < depth) and walk.count():
        walk = cut(
            walk.where("start <> at")
            .join(core.select(F.col("src").alias("at"), F.col("dst").alias("next")), "at")
            .select("start", F.col("next").alias("at"), (F.col("length") + 1).alias("length"))
            .distinct()
            .join(seen.select("start", "at"), ["start", "at"], "left_anti")
            .join(seen.where("start = at").select("start"), "start", "left_anti")
        )
        seen = cut(seen.unionByName(walk))
    return seen.where("start = at").groupBy(F.col("start").alias("id")).agg(F.min("length").alias("length"))
