"""Places in a total order, and windows cut from them, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_seq(df: DataFrame, *order: str, name: str = "seq", total: str | None = None) -> DataFrame:
    """Adds each row's place (from 0) in the order of the given columns, which must tell all rows apart.

    Rows are range-partitioned and sorted; a row's place is its number in its partition plus the sizes of the
    partitions before, of which there are as many as shuffle partitions, so that table is small at any size.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(width, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).persist()
    part = F.shiftrightunsigned("_at", 33)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(everything).alias("_total"))
    out = dealt.join(F.broadcast(offsets), part == F.col("_part")).withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_at", "_part", "_n", "_before", "_total")


def k_window(seq: Column, n: Column, k: int) -> Column:
    """Windows of n div k rows (at least one), the last of k takes the rest."""
    return F.least(F.lit(k - 1), F.floor(seq / F.greatest(F.lit(1), F.floor(n / k)))).cast("bigint")


def early(seq: Column, n: Column) -> Column:
    """Whether a row is in the first half, of n div 2 rows and at least one."""
    return seq < F.greatest(F.lit(1), F.floor(n / 2))


def recent_third(seq: Column, n: Column) -> Column:
    return seq >= n - F.greatest(F.lit(1), F.floor(n / 3))


def soft_inverse(x: Column, k: float) -> Column:
    """1 / (1 + k x)"""
    return 1 / (1 + F.lit(k) * x)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))
