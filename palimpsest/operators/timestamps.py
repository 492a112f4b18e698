"""Stamps of many formats, precisions and zones, brought to one UTC instant or one calendar day.

A value can be read in several ways: `03/04/2025` by two date orders, a bare number in several units.
Per source, a mixture over those readings is fitted by expectation-maximisation: every value gives each
of its valid readings a share of one count, the shares follow the current weights times the likelihood of
the value under the reading, and the weights are the summed shares. A date may also be broken, with the
likelihood `BROKEN`: digits of no order. Values of a source are first summed up by the set of their valid
readings, so the iterations see a handful of rows per source and run as one expression; nothing is
collected. What a source declares about itself is a prior on each value: `UNDECLARED` is the likelihood
that a value departs from the declared order, below that of a broken date, so `25/12/2025` of a source that
declares the month first is `none`, whereas without a declaration it is evidence for the day first.
The posterior picks the reading; below `MIN_POSTERIOR` the value is reported as ambiguous.

Kinds: `instant` (norm is UTC with microseconds), `day` (norm is a date), `ambiguous` (the wall time
occurs twice, or the readings stay undecided), `gap` (the wall time does not occur), `none` (no time, or
an impossible one). norm is empty for the last three.

Defined results: null, empty and blank values give no row; a value of any length is matched as a whole,
so a long text is `none`; a stamp without zone whose source or home zone is unknown is `ambiguous`, with
an unknown zone name `none`; repeated rows give repeated rows; an empty table gives an empty result.
All arithmetic is on microseconds since 1970, so the session's time zone does not matter.
"""

from __future__ import annotations

import zoneinfo
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least posterior of a reading to be taken.
MIN_POSTERIOR = 0.9
#: Rounds of expectation-maximisation.
ROUNDS = 60
#: Readings, in the order of the weights' array.
READINGS = ("mdy", "dmy", "s", "ms", "us", "ns", "broken")
#: Likelihood of a numeric date as digits of no order, and of one in another order than its source declares.
BROKEN, UNDECLARED = 0.01, 1e-4
#: What every reading's weight begins with and keeps.
SMOOTH = 1e-3
#: Bounds of the decade bare numbers must fall into, in seconds: 2020-01-01 and 2030-01-01 UTC.
DECADE = (1_577_836_800, 1_893_456_000)

# Offsets in minutes of the zone abbreviations of mail and log headers.
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "NPT": 345, "JST": 540, "KST": 540,
    "AEST": 600, "AEDT": 660, "NST": -210, "BRT": -180, "EST": -300, "EDT": -240, "CST": -360,
    "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}

_MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
_BLANK = r"[\s\u0000\u0085   -​    　﻿]+"
_DAYNAME = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
_DATE = (
    r"(?:(\d{4})[-/](\d{1,2})[-/](\d{1,2})"  # 1-3 year first
    r"|(\d{4})(\d{2})(\d{2})"  # 4-6 compact
    r"|(\d{4})-(\d{3})"  # 7-8 day of the year
    r"|(\d{4})-?w(\d{2})-?(\d)"  # 9-11 week date
    r"|(\d{1,2})([/.-])(\d{1,2})\13(\d{4})"  # 12-15 numeric, year last
    rf"|{_DAYNAME}(\d{{1,2}})[\s-]([a-z]{{3,9}})\.?,?[\s-](\d{{4}})"  # 16-18 day, month's name
    rf"|{_DAYNAME}([a-z]{{3,9}})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}))"  # 19-21 month's name, day
)
_TIME = r"(\d{1,2}):?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?(?:\s*([ap])\.?m\.?(?![a-z]))?"  # 22-26
_ZONE = r"(?:\s*(z|[+-]\d{2}(?::?\d{2})?|[a-z]{2,5})(?![a-z/]))?(?:\s*\[?([a-z]+(?:/[a-z0-9_+-]+)+)\]?)?"  # 27-28
_STAMP = rf"(?is)^{_DATE}(?:(?:t|\s*,\s*|\s+)(?:at\s+)?{_TIME}{_ZONE})?$"
#: A numeric date with the year last.
NUMERIC = r"^\W*\d{1,2}[/.-]\d{1,2}[/.-]\d{4}"
#: What only values with something to decide look like: a numeric date with the year last, a bare number.
_SEVERAL = r"^\W*(?:\d{1,2}[/.-]\d{1,2}[/.-]\d{4}|\d+\W*$)"
_GROUPS = 28
_SEP = "\x01"


def _date(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970 of a calendar date, null if there is none."""
    first = F.make_date(y, F.when((m >= 1) & (m <= 12), m), F.lit(1))
    return F.when((y >= 1) & (d >= 1) & (d <= F.day(F.last_day(first))), F.unix_date(first) + d - 1)


def _month(name: Column) -> Column:
    short = F.upper(F.substring(name, 1, 3))
    table = F.create_map(*[F.lit(x) for i, n in enumerate(_MONTHS) for x in (n, i + 1)])
    return F.try_element_at(table, short)


def _ordinal(y: Column, n: Column) -> Column:
    jan1 = F.make_date(F.when((y >= 1) & (y <= 9998), y), F.lit(1), F.lit(1))
    last = F.unix_date(F.make_date(F.when((y >= 1) & (y <= 9998), y) + 1, F.lit(1), F.lit(1))) - F.unix_date(jan1)
    return F.when((n >= 1) & (n <= last), F.unix_date(jan1) + n - 1)


def _weekdate(y: Column, w: Column, d: Column) -> Column:
    jan4 = F.make_date(F.when((y >= 1) & (y <= 9998), y), F.lit(1), F.lit(4))
    day = F.unix_date(jan4) - F.weekday(jan4) + (w - 1) * 7 + d - 1
    # The Thursday of a week lies in the year the week belongs to.
    thursday = F.date_from_unix_date((F.unix_date(jan4) - F.weekday(jan4) + (w - 1) * 7 + 3).cast("int"))
    return F.when((w >= 1) & (d >= 1) & (d <= 7) & (F.year(thursday) == y), day)


def _zone_names() -> list[str]:
    return sorted(z for z in zoneinfo.available_timezones() if "/" in z or z in ("UTC", "GMT"))


def _local_to_utc(local_us: Column, zone: Column) -> Column:
    """Struct(kind, us): the instant of a wall time in a named zone, or that it is doubled or missing."""
    us = lambda c: F.unix_micros(c)
    early = us(F.to_utc_timestamp(F.timestamp_micros(local_us), zone))
    wall = lambda u: us(F.from_utc_timestamp(F.timestamp_micros(u), zone))
    # Where clocks go back, the offset shrinks within the next hours; the later instant is as much later.
    ahead = early + 3 * 3_600_000_000
    shrink = (wall(early) - early) - (wall(ahead) - ahead)
    return (
        F.when(wall(early) != local_us, F.struct(F.lit("gap").alias("kind"), F.lit(None).cast("bigint").alias("us")))
        .when((shrink > 0) & (wall(early + shrink) == local_us), F.struct(F.lit("ambiguous").alias("kind"), F.lit(None).cast("bigint").alias("us")))
        .otherwise(F.struct(F.lit("instant").alias("kind"), early.alias("us")))
    )


def parts(values: DataFrame, value: str = "value") -> DataFrame:
    """`values` with the fields of each stamp and `readings`, the indices of its valid readings.

    One regular expression is run once per value; its groups are split apart afterwards.
    """
    v = F.regexp_replace(F.col(value), f"^{_BLANK}|{_BLANK}$", "")
    groups = F.split(F.regexp_replace(v, _STAMP, _SEP.join(f"${i}" for i in range(1, _GROUPS + 1))), _SEP)
    df = values.where(F.col(value).rlike(f"[^{_BLANK[1:-2]}]")).withColumn("_v", v).withColumn("_g", groups)
    df = df.withColumn("_hit", (F.size("_g") == _GROUPS))
    g = lambda i: F.when(F.col("_hit"), F.col("_g")[i - 1])
    n = lambda i: g(i).try_cast("int")
    has = lambda i: g(i) != ""
    plain = (
        F.when(has(1), _date(n(1), n(2), n(3)))
        .when(has(4), _date(n(4), n(5), n(6)))
        .when(has(7), _ordinal(n(7), n(8)))
        .when(has(9), _weekdate(n(9), n(10), n(11)))
        .when(has(16), _date(n(18), _month(g(17)), n(16)))
        .when(has(19), _date(n(21), _month(g(19)), n(20)))
    )
    hour = F.when(
        has(26),
        F.when((n(22) >= 1) & (n(22) <= 12), n(22) % 12 + F.when(F.upper(g(26)) == "P", 12).otherwise(0)),
    ).otherwise(F.when(n(22) <= 23, n(22)))
    minute, second = F.when(n(23) <= 59, n(23)), F.when(has(24), F.when(n(24) <= 59, n(24))).otherwise(0)
    micro = F.when(has(25), F.rpad(F.substring(g(25), 1, 6), 6, "0").try_cast("int")).otherwise(0)
    clock = ((hour.cast("bigint") * 60 + minute) * 60 + second) * 1_000_000 + micro
    bare = F.when(F.col("_v").rlike(r"^\d{1,19}$"), F.col("_v").try_cast("bigint"))
    df = df.select(
        *values.columns,
        plain.alias("_day"),
        _date(n(15), n(12), n(14)).alias("_mdy"),
        _date(n(15), n(14), n(12)).alias("_dmy"),
        F.coalesce(has(12), F.lit(False)).alias("_numeric"),
        F.coalesce(has(22), F.lit(False)).alias("_timed"),
        clock.alias("_clock"),
        F.when(has(27), g(27)).alias("_zone"),
        F.when(has(28), g(28)).alias("_region"),
        F.when(~F.col("_hit") | (has(4) & ~has(22) & plain.isNull()), bare).alias("_bare"),
    )
    unit = [(2, 1), (3, 1_000), (4, 1_000_000), (5, 1_000_000_000)]
    valid = [
        F.when(F.col("_mdy").isNotNull(), F.lit(0)),
        F.when(F.col("_dmy").isNotNull(), F.lit(1)),
        *[
            F.when((F.floor(F.col("_bare") / k) >= DECADE[0]) & (F.floor(F.col("_bare") / k) < DECADE[1]), F.lit(i))
            for i, k in unit
        ],
        F.when(F.col("_mdy").isNotNull() | F.col("_dmy").isNotNull(), F.lit(len(READINGS) - 1)),
    ]
    return df.withColumn("readings", F.array_compact(F.array(*valid)))


def fit(read: DataFrame, sources: DataFrame, source: str, order: str = "date_order") -> DataFrame:
    """Weights of the readings per source, times their likelihoods: `source`, weights (array in the order of READINGS).

    `read` has `source` and `readings`; `sources` has `source` (unique) and the declared `order`, which
    may be null. Only counts by (source, set of readings) reach the fit.
    """
    # Values of no reading count as well, under the empty set: a filter on `readings` would be pushed below
    # the parse and run it once more for every term.
    counts = read.groupBy(source, "readings").agg(F.count("*").cast("double").alias("n"))
    sets = counts.groupBy(source).agg(F.collect_list(F.struct("readings", "n")).alias("sets"))
    declared = F.col(order)
    likely = F.array(
        F.when(declared == "dmy", UNDECLARED).otherwise(1.0),
        F.when(declared == "mdy", UNDECLARED).otherwise(1.0),
        *[F.lit(1.0)] * 4,
        F.lit(BROKEN),
    )
    share = f"""
      transform(aggregate(sequence(1, {ROUNDS}), transform(likely, x -> 1D), (th, i) ->
        transform(th, (t, k) -> aggregate(sets, counts[k], (acc, g) -> acc +
          CASE WHEN array_contains(g.readings, k)
               THEN g.n * t * likely[k] / aggregate(g.readings, 0D, (a, j) -> a + th[j] * likely[j]) ELSE 0D END))),
        (t, k) -> t * likely[k])"""
    known = sources.select(F.col(source).alias("_s"), F.col(order).alias(order)).dropDuplicates(["_s"])
    fitted = sets.join(known, F.col(source).eqNullSafe(F.col("_s")), "left").withColumn("likely", likely)
    # The declared order begins with as many counts as the source has values, so many broken dates do not outweigh it.
    held = F.aggregate("sets", F.lit(SMOOTH), lambda acc, g: acc + g["n"])
    counts = [F.when(declared == READINGS[k], held).otherwise(SMOOTH) if k < 2 else F.lit(SMOOTH) for k in range(len(READINGS))]
    fitted = fitted.withColumn("counts", F.array(*counts))
    return fitted.select(source, F.expr(share).alias("weights"))


def normalise(
    rows: DataFrame,
    fields: Sequence[str],
    sources: DataFrame,
    keep: Sequence[str],
    source: str = "store_id",
    zone: str = "home_zone",
    order: str = "date_order",
) -> DataFrame:
    """One row per stamp: `keep`, field, kind, norm, at_us (of instants)."""
    named = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]
    values = rows.select(
        *[F.col(k).alias(f"k_{k}") for k in keep], F.col(source).alias("_src"), F.explode(F.array(*named)).alias("_x")
    ).select("*", F.col("_x.field").alias("_field"), F.col("_x.value").alias("_value")).drop("_x")
    read = parts(values.where(F.col("_value").isNotNull()), "_value")
    known = sources.select(F.col(source).alias("_src"), zone, order).dropDuplicates(["_src"])
    several = values.where(F.col("_value").rlike(_SEVERAL)).select("_src", "_value")
    weights = fit(parts(several, "_value"), known, "_src", order)
    about = known.select(F.col("_src").alias("_a"), F.col(zone).alias("_home"))
    weights = weights.select(F.col("_src").alias("_w"), "weights")
    df = read.join(about, F.col("_src").eqNullSafe(F.col("_a")), "left").join(
        weights, F.col("_src").eqNullSafe(F.col("_w")), "left"
    )
    total = F.aggregate("readings", F.lit(0.0), lambda a, k: a + F.col("weights")[k])
    best = F.array_max(
        F.transform("readings", lambda k: F.struct(F.col("weights")[k].alias("w"), k.alias("k")))
    )
    df = df.withColumn("_total", total).withColumn("_best", best)
    picked = F.when(F.col("_total") > 0, F.when(F.col("_best.w") / F.col("_total") >= MIN_POSTERIOR, F.col("_best.k")))
    same = F.col("_mdy") == F.col("_dmy")
    df = df.withColumn("_pick", F.when(F.col("_numeric") & same & (F.col("_total") > 0), F.lit(0)).otherwise(picked))
    undecided = (F.col("_total") > 0) & F.col("_pick").isNull()
    day = F.when(F.col("_numeric"), F.when(F.col("_pick") == 0, F.col("_mdy")).when(F.col("_pick") == 1, F.col("_dmy"))).otherwise(F.col("_day"))
    bare = (
        F.when(F.col("_pick") == 2, F.col("_bare") * 1_000_000)
        .when(F.col("_pick") == 3, F.col("_bare") * 1_000)
        .when(F.col("_pick") == 4, F.col("_bare"))
        .when(F.col("_pick") == 5, F.floor(F.col("_bare") / 1_000))
    )
    z = F.upper("_zone")
    abbreviations = F.create_map(*[F.lit(x) for k, m in ABBREVIATIONS.items() for x in (k, m)])
    digits = F.regexp_replace(z, "[^0-9]", "")
    minutes = F.when(
        z.rlike("^[+-]"),
        (F.substring(digits, 1, 2).try_cast("int") * 60 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0)))
        * F.when(z.startswith("-"), -1).otherwise(1),
    ).otherwise(F.try_element_at(abbreviations, z))
    df = df.withColumn("_day", day).withColumn("_at", bare).withColumn("_minutes", minutes)
    df = df.withColumn("_local", F.col("_day").cast("bigint") * 86_400_000_000 + F.col("_clock"))
    place = F.coalesce("_region", "_home")
    at = F.when(place.isin(_zone_names()), _local_to_utc(F.col("_local"), place))
    df = df.withColumn("_z", F.when(F.col("_timed") & F.col("_local").isNotNull() & F.col("_zone").isNull(), at))
    offset_ok = F.abs("_minutes") < 18 * 60
    kind = (
        F.when(F.col("_at").isNotNull(), "instant")
        .when(undecided, "ambiguous")
        .when(F.col("_day").isNull(), "none")
        .when(~F.col("_timed"), "day")
        .when(F.col("_clock").isNull(), "none")
        .when(F.col("_zone").isNotNull(), F.when(offset_ok, "instant").otherwise("none"))
        .when(place.isNull(), "ambiguous")
        .otherwise(F.coalesce(F.col("_z.kind"), F.lit("none")))
    )
    df = df.withColumn("kind", kind).withColumn(
        "at_us",
        F.when(
            F.col("kind") == "instant",
            F.coalesce("_at", F.when(F.col("_zone").isNotNull(), F.col("_local") - F.col("_minutes").cast("bigint") * 60_000_000).otherwise(F.col("_z.us"))),
        ),
    )
    on = F.floor(F.col("at_us") / 86_400_000_000)
    rest = F.pmod(F.col("at_us"), F.lit(86_400_000_000))
    sec = F.floor(rest / 1_000_000)
    text = F.format_string(
        "%sT%02d:%02d:%02d.%06dZ",
        F.date_from_unix_date(on.cast("int")).cast("string"),
        F.floor(sec / 3600),
        F.floor(sec / 60) % 60,
        sec % 60,
        rest % 1_000_000,
    )
    norm = F.when(F.col("kind") == "instant", text).when(
        F.col("kind") == "day", F.date_from_unix_date("_day").cast("string")
    )
    return df.select(
        *[F.col(f"k_{k}").alias(k) for k in keep],
        F.col("_field").alias("field"),
        "kind",
        F.coalesce(norm, F.lit("")).alias("norm"),
        "at_us",
    )
