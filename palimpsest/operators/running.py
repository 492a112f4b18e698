"""Places and running sums within groups of any size.

A window over a whole group runs in one task, so one group of a third of all rows would. Here rows are partitioned
by range of group and order first; each partition counts its own rows, the few counts per group and partition are
summed up in order, and only their sums are added: no task holds more of a group than one partition.

Defined results: rows equal in group and order share no place, their order is arbitrary, and they lie in one
partition; null groups are groups of their own; nulls in the order come first unless it says otherwise; null values
count as 0; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.sources.tables import cut


def placed(rows: DataFrame, group: Sequence[str], order: Sequence[Column], value: Column | None = None) -> DataFrame:
    """`rows` with `place`, from 1, and with `value` also `before`, the sum of the rows before in the group."""
    amount = F.coalesce(value, F.lit(0)).cast("bigint") if value is not None else F.lit(0).cast("bigint")
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    split = rows.withColumn("_amount", amount).repartitionByRange(parts, *[F.col(g) for g in group], *order)
    split = cut(split.withColumn("_part", F.spark_partition_id()))
    sums = split.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.sum("_amount").alias("_s"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_part").alias("_p"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_rows"),
        F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_sum"),
    )
    on = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    own = Window.partitionBy(*group, "_part").orderBy(*order)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    local = split.withColumn("_place", F.row_number().over(own))
    if value is not None:
        local = local.withColumn("_before", F.coalesce(F.sum("_amount").over(before), F.lit(0)))
    out = [(F.col("_place") + F.col("_rows")).alias("place")]
    if value is not None:
        out.append((F.col("_before") + F.col("_sum")).cast("bigint").alias("before"))
    return local.join(sums, on).select(*rows.columns, *out)
