"""History of changing attributes: insert-only satellites and the periods their versions were valid.

A satellite keeps one group of attributes that change together. Rows are only ever appended, and only
when the hash of the group differs from the row before, so the end of a period is never stored: a view
computes it with `lead`. Two satellites are provided over the same observations, split by change rate:
knowledge (`semantic_hash`, slow) and bookkeeping (`raw_hash`, fast).

Records of any size are handled: a record with more than `slice_rows` observations is cut along time
into slices, each slice is ordered by its own task, and only one row per slice is looked at across
slices. No task ever orders a whole hot record.

Defined results:
  * null or unreadable instant, null or empty hash: the row is left out; null gap flag: no gap;
  * null key columns: a record of its own (nulls compare equal), as in SQL grouping;
  * rows equal in record, instant and hash: one observation, with a gap if any of them has one and
    the smallest revision that is not null;
  * observations of one instant: by revision, nulls first, then by hash;
  * empty input: empty output with the same columns; columns of other names are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.sources.tables import cut

#: Observations of one record that one task may order.
SLICE_ROWS = 200_000
#: Records of more observations than that whose slice bounds are broadcast; beyond, they are joined by shuffle.
BROADCAST_RECORDS = 1_000
#: Most slices of a record, which hold equal numbers of its observations.
MAX_SLICES = 1_000

_RFC3339 = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"


def rfc3339_micros(stamp: Column) -> Column:
    """Microseconds since 1970 of an RFC 3339 stamp, finer digits cut; null if it cannot be read."""
    s = F.upper(F.trim(stamp))
    return F.when(s.rlike(_RFC3339), F.unix_micros(s.try_cast("timestamp")))


def _readable(revisions: DataFrame, hash_col: str, keys: tuple[str, ...]) -> DataFrame:
    """The rows with a readable instant and a hash: `keys`, at_us, hash, revision, gap."""
    return revisions.select(
        *keys,
        rfc3339_micros(F.col("recorded_at")).alias("at_us"),
        F.lower(F.col(hash_col)).alias("hash"),
        F.col("revision").cast("bigint").alias("revision"),
        F.coalesce(F.col("unknown_gap"), F.lit(False)).alias("gap"),
    ).where(F.col("at_us").isNotNull() & F.col("hash").isNotNull() & (F.col("hash") != ""))


def observations(
    revisions: DataFrame,
    hash_col: str = "semantic_hash",
    keys: tuple[str, ...] = ("store_id", "memory_id"),
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """One row per (record, instant, hash): `keys`, slice, slices, at_us, hash, revision, gap.

    The grouping key holds the instant, so a hot record spreads over all reducers and rows delivered
    again are merged before the shuffle. Slices are set before that, so that a later filter on `slices`
    reaches the scan and the look across slices costs nothing where no record is hot.
    """
    rows = _sliced(_readable(revisions, hash_col, keys), keys, slice_rows)
    return rows.groupBy(*keys, "slice", "slices", "at_us", "hash").agg(
        F.min("revision").alias("revision"), F.max("gap").alias("gap")
    )


def _sliced(rows: DataFrame, keys: tuple[str, ...], slice_rows: int, broadcast_records: int = BROADCAST_RECORDS) -> DataFrame:
    """`rows` with `slice` (0 for ordinary records) and `slices`, how many the record has.

    Hot records are counted first: where there are none, nothing is joined and the look across slices falls out of
    the plan. Their slices are cut at approximate quantiles of the instant, so a burst is cut as well as a lull.
    """
    names = [f"h_{k}" for k in keys]
    hot = rows.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(F.count("*").alias("n")).where(F.col("n") > slice_rows)
    hot = cut(hot)
    records = hot.count()
    if records == 0:
        return rows.withColumn("slice", F.lit(0).cast("bigint")).withColumn("slices", F.lit(1).cast("bigint"))
    # A hot record's rows would meet in one task of a shuffle join, so they carry a salt of their instant.
    few = records <= broadcast_records
    salts = 1 if few else 64
    cond = F.col("salt") == F.col("h_salt") if salts > 1 else F.lit(True)
    for k, n in zip(keys, names):
        cond = cond & F.col(k).eqNullSafe(F.col(n))

    def side(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df.withColumn("h_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    salted = rows if few else rows.withColumn("salt", F.pmod(F.xxhash64("at_us"), F.lit(salts)).cast("int"))
    quantiles = F.percentile_approx("at_us", [i / MAX_SLICES for i in range(1, MAX_SLICES)], 10 * MAX_SLICES)
    bounds = cut(salted.join(side(hot), cond).groupBy(*names, "n").agg(quantiles.alias("q")))
    wanted = F.least(F.lit(MAX_SLICES), F.ceil(F.col("n") / slice_rows))
    chosen = F.transform(F.sequence(F.lit(1), wanted - 1), lambda i: F.col("q")[F.floor(i * MAX_SLICES / wanted).cast("int") - 1])
    bounds = bounds.select(*names, F.array_distinct(chosen).alias("bounds"))
    part = F.size(F.filter("bounds", lambda b: b < F.col("at_us")))
    return salted.join(side(bounds), cond, "left").select(
        *rows.columns,
        F.coalesce(F.when(F.col("bounds").isNotNull(), part), F.lit(0)).cast("bigint").alias("slice"),
        F.coalesce(F.when(F.col("bounds").isNotNull(), F.size("bounds") + 1), F.lit(1)).cast("bigint").alias("slices"),
    )


def _across(df: DataFrame, per_slice: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """Left join of `per_slice` (keys, slice, value) to `df` by record and slice; nulls compare equal."""
    right = per_slice.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col("slice").alias("r_slice"), value)
    cond = F.col("slice") == F.col("r_slice")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"r_{k}"))
    return df.join(right, cond, "left").select(*df.columns, value)


def satellite(
    revisions: DataFrame,
    hash_col: str = "semantic_hash",
    keys: tuple[str, ...] = ("store_id", "memory_id"),
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """The rows of an insert-only satellite: `keys`, at_us, hash, revision, gap, slice, slices.

    A row stands where the hash differs from the observation before, or where edits went unseen.
    """
    obs = observations(revisions, hash_col, keys, slice_rows)
    order = [F.col("at_us"), F.col("revision").asc_nulls_first(), F.col("hash")]
    w = Window.partitionBy(*keys, "slice").orderBy(*order)
    rows = obs.withColumn("prev", F.lag("hash").over(w))
    ends = (
        obs.where(F.col("slices") > 1)
        .groupBy(*keys, "slice")
        .agg(F.max_by("hash", F.struct("at_us", F.coalesce("revision", F.lit(-(2**63))), "hash")).alias("last"))
        .withColumn("carried", F.lag("last").over(Window.partitionBy(*keys).orderBy("slice")))
    )
    rows = _across(rows, ends, keys, "carried")
    before = F.coalesce("prev", "carried")
    starts = rows.where(before.isNull() | (before != F.col("hash")) | F.col("gap"))
    return starts.select(*keys, "at_us", "hash", "revision", "gap", "slice", "slices")


def periods(sat: DataFrame, keys: tuple[str, ...] = ("store_id", "memory_id")) -> DataFrame:
    """The view over a satellite: `keys`, valid_from_us, valid_until_us (-1: still valid), hash, gap.

    Period ends come from `lead` within a slice; the last version of a slice ends where the next slice
    that has a version begins.
    """
    order = [F.col("at_us"), F.col("revision").asc_nulls_first(), F.col("hash")]
    w = Window.partitionBy(*keys, "slice").orderBy(*order)
    rows = sat.withColumn("next_us", F.lead("at_us").over(w))
    begins = (
        sat.where(F.col("slices") > 1)
        .groupBy(*keys, "slice")
        .agg(F.min("at_us").alias("first_us"))
        .withColumn("after_us", F.lead("first_us").over(Window.partitionBy(*keys).orderBy("slice")))
    )
    rows = _across(rows, begins, keys, "after_us")
    return rows.select(
        *keys,
        F.col("at_us").alias("valid_from_us"),
        F.coalesce("next_us", "after_us", F.lit(-1)).alias("valid_until_us"),
        "hash",
        "gap",
    )


def append_rows(existing: DataFrame, batch: DataFrame, keys: tuple[str, ...] = ("store_id", "memory_id")) -> DataFrame:
    """The rows a batch of satellite rows adds to `existing`: those not held yet (insert only).

    Both sides have `keys`, at_us and hash. Late rows are appended like others, since `periods` orders
    by instant, not by arrival. Null keys compare equal. Rows repeated in the batch are added once.
    """
    cols = [*keys, "at_us", "hash"]
    held = existing.select(*[F.col(c).alias(f"e_{c}") for c in cols])
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).eqNullSafe(F.col(f"e_{c}"))
    return batch.join(held, cond, "left_anti").dropDuplicates(cols)


def as_of(view: DataFrame, instant_us: int) -> DataFrame:
    """The versions of `periods` valid at an instant: from <= instant < until."""
    until = F.col("valid_until_us")
    return view.where((F.col("valid_from_us") <= instant_us) & ((until == -1) | (until > instant_us)))


def coverage(view: DataFrame, first: DataFrame, known: DataFrame, instant_us: int) -> DataFrame:
    """store_id, memory_id, reason: what is known of each record at an instant, and why not all of it.

    `view` is that of `periods`, `first` has the reason of each record's first row, `known` the records there are now.
    Edits went unobserved within a version if one that follows a gap begins where it ends.
    """
    keys = ["store_id", "memory_id"]
    from_, until = F.col("valid_from_us"), F.col("valid_until_us")
    valid = (from_ <= instant_us) & ((until == -1) | (until > instant_us))
    one = view.groupBy(*keys).agg(
        F.max(F.when(valid, F.col("hash"))).alias("at_hash"),
        F.max(F.when(valid & (until != -1), until)).alias("ends"),
        F.coalesce(F.max((until == -1) & (from_ <= instant_us)), F.lit(False)).alias("last"),
    )
    gaps = view.where("gap").select(*keys, from_.alias("ends"), F.lit(True).alias("unseen")).distinct()
    both = one.join(gaps, [*keys, "ends"], "left").withColumn("_h", F.lit(True))
    both = both.join(known.withColumn("_k", F.lit(True)), keys, "full").join(first, keys, "left")
    reason = (
        F.when(F.col("_h").isNull(), "no_recorded_history")
        .when(F.col("at_hash").isNull() & (F.col("first_reason") != "created"), "before_coverage_start")
        .when(F.col("at_hash").isNull(), "not_yet_created")
        .when(F.col("unseen"), "unobserved_edits")
        .when(F.col("last") & F.col("_k").isNull(), "vanished_after_last_observation")
        .otherwise("complete")
    )
    return both.select(*keys, reason.alias("reason"))


def recorded_support(revisions: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """store_id, memory_id, support: how each record went on after it last held its first content.

    Versions that begin later must carry an `allowed` reason (any row of that instant and hash) and no gap.
    """
    keys = ["store_id", "memory_id"]
    obs = observations(revisions)
    first = obs.groupBy(*keys).agg(F.min_by("hash", F.struct("at_us", F.coalesce("revision", F.lit(-(2**63))), "hash")).alias("hash"))
    last = obs.join(first, [*keys, "hash"]).groupBy(*keys).agg(F.max("at_us").alias("last_us"))
    reasons = (
        revisions.select(*keys, rfc3339_micros(F.col("recorded_at")).alias("at_us"), F.lower("semantic_hash").alias("hash"), "reason")
        .groupBy(*keys, "at_us", "hash")
        .agg(F.max(F.col("reason").isin(list(allowed))).alias("fine"))
    )
    later = satellite(revisions).join(last, keys).where(F.col("at_us") > F.col("last_us"))
    later = later.join(reasons, [*keys, "at_us", "hash"], "left").groupBy(*keys).agg(
        F.max("gap").alias("gaps"), F.min(F.coalesce("fine", F.lit(False))).alias("fine")
    )
    support = (
        F.when(F.col("gaps").isNull(), "unchanged").when(F.col("gaps"), "unobserved_edits").when(F.col("fine"), "supported").otherwise("changed_otherwise")
    )
    return last.join(later, keys, "left").select(*keys, support.alias("support"))


def change_rates(revisions: DataFrame) -> DataFrame:
    """How often each attribute group changes: attribute, observations, versions, rate.

    This is what decides which attributes share a satellite.
    """
    out = None
    for col in ("semantic_hash", "raw_hash"):
        obs = observations(revisions, col).agg(F.count("*").alias("observations"))
        sat = satellite(revisions, col).agg(F.count("*").alias("versions"))
        one = obs.crossJoin(sat).select(
            F.lit(col).alias("attribute"),
            "observations",
            "versions",
            F.round(F.col("versions") / F.greatest(F.col("observations"), F.lit(1)), 6).alias("rate"),
        )
        out = one if out is None else out.unionByName(one)
    return out
