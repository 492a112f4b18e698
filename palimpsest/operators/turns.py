"""Operators on transcripts: deliveries, digests of any length, findings, sessions.

Defined results: null texts are empty texts; null roles are roles of their own; empty tables give empty
results; columns of other names are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import stripped
from palimpsest.operators.running import placed

#: Turns whose hashes one digest block holds.
BLOCK = 500

# The words of the finding rules.
ERROR = r"(错误|报错|traceback|exception|error|failed|失败)"
FIX = r"(根因|原因是|修复|改成|改为|fixed|the fix|因为)"
PREFERENCE = r"(不要用|别用|不用|改用|下次用|下次记得|don't use|use .* instead)"
STEP = r"(第[一二三四五六七八九十百\d]+步|阶段\s*[一二三四五六七八九十\d]+|##\s*阶段|Step\s*\d)"


def delivered_once(turns: DataFrame) -> DataFrame:
    """One row per turn as delivered first: transcript, ord, role, text, turn_no, deliveries.

    Deliveries of one turn agree in transcript, ord, role and text. Text is grouped by its hash; the
    least turn number and the text ride along in the map-side combine.
    """
    return (
        turns.groupBy("transcript", "ord", "role", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"))
        .agg(F.min("turn_no").alias("turn_no"), F.count("*").alias("deliveries"), F.first("text").alias("text"))
        .select("transcript", "ord", "role", "text", "turn_no", "deliveries", "text_hash")
    )


def digest(turns: DataFrame) -> DataFrame:
    """transcript, turns, digest: a hash of all turns in order, in two levels.

    Turns are hashed in blocks of their own and the blocks' hashes are hashed, so no task holds
    more of a transcript than a block of hashes or the list of its blocks.
    """
    one = F.sha2(F.concat_ws("\x00", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))), 256)
    ordered = lambda key, val: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, val))), lambda x: x[val]), "")
    blocks = (
        turns.select("transcript", F.floor(F.col("ord") / BLOCK).alias("block"), "ord", "turn_no", one.alias("h"))
        .groupBy("transcript", "block")
        .agg(
            F.count("*").alias("n"),
            F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "turn_no", "h"))), lambda x: x["h"]), ""), 256).alias("b"),
        )
    )
    return blocks.groupBy("transcript").agg(F.sum("n").alias("turns"), F.sha2(ordered("block", "b"), 256).alias("digest"))


def findings(turns: DataFrame, per_transcript: int = 5, reach: int = 50) -> DataFrame:
    """The first findings of each transcript by the wording of its turns: transcript, turn_no, kind, importance, title.

    A pitfall names an error and a fix that begin at most `reach` characters apart.
    """
    text = stripped(F.coalesce("text", F.lit("")))
    low = F.lower(text)
    at = lambda rx: F.when(low.rlike(rx), F.length(F.regexp_replace(low, f"(?s)^(.*?){rx}.*$", "$1")))
    pitfall = F.abs(at(ERROR) - at(FIX)) <= reach
    kind = F.when(
        (F.col("role") == "user") & (F.length(text) <= 200) & low.rlike(PREFERENCE), "preference"
    ).when((F.col("role") == "assistant") & (F.length(text) <= 280) & ~text.rlike(STEP) & pitfall, "pitfall")
    w = Window.partitionBy("transcript").orderBy("ord", "turn_no")
    return (
        turns.select("transcript", "ord", "turn_no", kind.alias("kind"), F.substring(text, 1, 60).alias("title"))
        .where(F.col("kind").isNotNull())
        .withColumn("place", F.row_number().over(w))
        .where(F.col("place") <= per_transcript)
        .select(
            "transcript",
            "turn_no",
            "kind",
            F.when(F.col("kind") == "preference", 65).otherwise(75).alias("importance"),
            "title",
        )
    )


def prefix_digests(placed_turns: DataFrame) -> DataFrame:
    """transcript, turns, digest of turns with their `place` in the transcript, in two levels as `digest`."""
    one = F.sha2(F.concat_ws("\x00", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))), 256)
    joined = lambda key, val: F.sha2(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, val))), lambda x: x[val]), ""), 256
    )
    blocks = (
        placed_turns.select("transcript", F.floor((F.col("place") - 1) / BLOCK).alias("block"), "place", one.alias("h"))
        .groupBy("transcript", "block")
        .agg(F.count("*").alias("n"), joined("place", "h").alias("b"))
    )
    return blocks.groupBy("transcript").agg(F.sum("n").alias("turns"), joined("block", "b").alias("digest"))


def resume_points(known: DataFrame, turns: DataFrame) -> DataFrame:
    """Where reading each transcript goes on: transcript, known, turns, resume_at.

    `known` are the turns as they were at the last reading. Where the transcript still begins with them, reading goes
    on behind them; where its beginning is another now, or there was no reading, at 0.
    """
    order = [F.col("ord"), F.col("turn_no")]
    was = placed(known, ["transcript"], order)
    now = placed(turns, ["transcript"], order)
    then = prefix_digests(was).select(F.col("transcript").alias("t"), F.col("turns").alias("known"), F.col("digest").alias("was"))
    prefix = now.join(then.select("t", "known"), F.col("transcript").eqNullSafe(F.col("t"))).where(F.col("place") <= F.col("known"))
    still = prefix_digests(prefix).select(F.col("transcript").alias("p"), "digest")
    totals = turns.groupBy("transcript").agg(F.count("*").alias("turns"))
    joined = totals.join(then, F.col("transcript").eqNullSafe(F.col("t")), "left").join(
        still, F.col("transcript").eqNullSafe(F.col("p")), "left"
    )
    same = F.col("was") == F.col("digest")
    return joined.select(
        "transcript",
        F.coalesce("known", F.lit(0)).alias("known"),
        "turns",
        F.when(same, F.col("known")).otherwise(0).alias("resume_at"),
    )


def sessions(turns: DataFrame, gap: str = "48 hours") -> DataFrame:
    """Sessions of each host: runs of turns no more than `gap` apart; host, session_from, session_until, turns."""
    return (
        turns.where(F.col("received_at").isNotNull())
        .groupBy(F.coalesce("host", F.lit("")).alias("host"), "transcript", F.session_window("received_at", gap).alias("s"))
        .agg(F.count("*").alias("turns"))
        .select("host", "transcript", F.col("s.start").alias("session_from"), F.col("s.end").alias("session_until"), "turns")
    )
