"""Transcripts and revisions as streams.

Each function takes a streaming (or static) DataFrame and returns one of the same kind; `run_available`
processes what a source holds now, writes it once per batch into a sink directory in the shared folder, and
returns the sink as a DataFrame. State is keyed and expires with the watermark, so it stays bounded by the
arrival window, not by the history.

`windowed_activity` and `delivered_once` are for live streams: what comes later than the watermark is left
out, and so are rows without an event time, which a watermark cannot place. `all_activity` and
`all_delivered_once` are for a source that is read to its end: each batch leaves partial results in the sink,
without state and watermark, and these are merged exactly, so the result does not depend on how rows lie in
files or come in batches.

Defined results: repeated deliveries within the horizon come out once; rows without an event time have a
window of their own (null), and count as repeats where their turn has a timed delivery, else once; an empty
source gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.tables import shared_folder


def stream_table(spark: SparkSession, base: str, name: str, files_per_batch: int = 16) -> DataFrame:
    """A table of the data directory as a stream of files; its schema is that of the files."""
    path = f"{base}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # As a pattern, the path may be one file as well as a folder.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{base}/{name}.parque[t]")


def windowed_activity(turns: DataFrame, window: str = "7 days", late: str = "2 days") -> DataFrame:
    """Turns and their characters per host and window of arrival, closed by the watermark."""
    timed = turns.where(F.col("received_at").isNotNull()).withWatermark("received_at", late)
    return (
        timed.groupBy(F.window("received_at", window).alias("w"), F.coalesce("host", F.lit("")).alias("host"))
        .agg(F.count("*").alias("turns"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
        .select(F.col("w.start").alias("window_from"), F.col("w.end").alias("window_until"), "host", "turns", "chars")
    )


def delivered_once(turns: DataFrame, horizon: str = "48 hours") -> DataFrame:
    """Turns without the deliveries repeated within `horizon`."""
    keyed = turns.where(F.col("received_at").isNotNull()).withColumn("text_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    return (
        keyed.withWatermark("received_at", horizon)
        .dropDuplicatesWithinWatermark(["transcript", "ord", "role", "text_hash"])
        .select("transcript", "ord", "role", "turn_no", "received_at")
    )


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns its output.

    The sink and the checkpoint lie in the folder `spark.checkpoint.dir` names; a local one is taken only
    where that is unset.
    """
    spark = stream.sparkSession
    root = _folder(spark)
    q = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def run_partial(stream: DataFrame, partial: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs a stream over what is there and returns `partial` of every batch, all together.

    A batch's rows lie in a folder of its number and replace those of an earlier attempt.
    """
    spark = stream.sparkSession
    root, schema, written = _folder(spark), partial(stream).schema, []

    def keep(batch: DataFrame, number: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{root}/out/{number}")
        written.append(number)

    q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if not written:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/out")


def all_activity(turns: DataFrame, window: str = "7 days") -> DataFrame:
    """Turns and their characters per host and window of arrival, of all rows of a stream; null window: untimed rows."""

    def partial(rows: DataFrame) -> DataFrame:
        # window() would leave out the untimed rows.
        timed = rows.where(F.col("received_at").isNotNull()).select(F.window("received_at", window).alias("w"), "host", "text")
        timed = timed.select(F.col("w.start").alias("window_from"), F.col("w.end").alias("window_until"), "host", "text")
        untimed = rows.where(F.col("received_at").isNull())
        untimed = untimed.select(*[F.lit(None).cast(timed.schema[c].dataType).alias(c) for c in ("window_from", "window_until")], "host", "text")
        return (
            timed.unionByName(untimed)
            .groupBy("window_from", "window_until", F.coalesce("host", F.lit("")).alias("host"))
            .agg(F.count("*").alias("turns"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
        )

    return run_partial(turns, partial).groupBy("window_from", "window_until", "host").agg(
        F.sum("turns").alias("turns"), F.sum("chars").alias("chars")
    )


def all_delivered_once(turns: DataFrame, horizon_us: int = 48 * 3_600_000_000) -> DataFrame:
    """The deliveries of all rows of a stream that repeat none of less than `horizon_us` before: transcript, turn, at_us.

    `turn` is a hash of ord, role and text. A kept delivery hides those within the horizon after it; the next one is
    kept. Deliveries of a turn are read in order of arrival from a sorted partition, so a turn of any number of
    deliveries needs no memory.
    """
    text_hash = F.sha2(F.coalesce("text", F.lit("")), 256)
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\x00"))
    turn = F.sha2(F.concat_ws("\x1f", part("ord"), part("role"), text_hash), 256)

    def partial(rows: DataFrame) -> DataFrame:
        return rows.select("transcript", turn.alias("turn"), F.unix_micros("received_at").alias("at_us")).distinct()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for pdf in batches:
            keep = []
            for transcript, t, at, timed in zip(pdf["transcript"], pdf["turn"], pdf["at_us"], pdf["timed"]):
                one = (None if pd.isna(transcript) else transcript, t)
                if one != key:
                    key, last = one, at if timed else None
                    keep.append(True)
                elif timed and at - last >= horizon_us:
                    last = at
                    keep.append(True)
                else:
                    keep.append(False)
            yield pdf.loc[keep, ["transcript", "turn", "at_us", "timed"]]

    seen = run_partial(turns, partial)
    # Untimed rows come last, so that a timed one before them makes them repeats.
    ordered = seen.select("transcript", "turn", F.coalesce("at_us", F.lit(0)).alias("at_us"), F.col("at_us").isNotNull().alias("timed"))
    ordered = ordered.repartition("transcript", "turn").sortWithinPartitions("transcript", "turn", F.col("timed").desc(), "at_us")
    types = f"transcript {seen.schema['transcript'].dataType.simpleString()}, turn string, at_us bigint, timed boolean"
    return ordered.mapInPandas(fold, types).select("transcript", "turn", F.when(F.col("timed"), F.col("at_us")).alias("at_us"))
