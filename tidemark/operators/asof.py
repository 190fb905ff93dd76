"""Joins by order: the last row at or before a place, the nearest of several, sums over spans. No side is crossed or broadcast.

Both sides are put together, sorted within stretches of equal width, and the last row of each stretch is carried to
the next ones; a stretch is one task's work, and the table of stretches is as long as the range of the places. Equal
places on the left are looked up once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A day, in the microseconds that times are compared in.
DAY = 86_400_000_000


def micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def last_before(left: DataFrame, right: DataFrame, keys: list[str], width: int, order: str | None = None, at_once: bool = True) -> DataFrame:
    """Left rows (keys, at) with ``hit``, a struct of the right row (keys, at, ...) of the greatest ``at`` not beyond theirs; null if there is none.

    ``at`` are whole numbers, sorted in stretches of ``width``. Of right rows at one place the last by ``order`` counts; ``at_once`` says
    whether a right row at the very place counts.
    """
    stretch = F.floor(F.col("at") / width)
    rank = [F.col(order)] if order else []
    payload = F.struct("at", *[c for c in right.columns if c not in ("at", *keys)])
    points = right.filter("at IS NOT NULL").select(*keys, "at", F.lit(0 if at_once else 1).alias("_side"), *[r.alias("_o") for r in rank], payload.alias("_row"))
    asked = left.filter("at IS NOT NULL").select(*keys, "at").distinct().withColumn("_side", F.lit(1 if at_once else 0))
    both = points.unionByName(asked, allowMissingColumns=True).withColumn("_s", stretch)
    so_far = Window.partitionBy(*keys, "_s").orderBy("at", "_side", *(["_o"] if order else [])).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.withColumn("_hit", F.last("_row", ignorenulls=True).over(so_far))
    order_key = F.struct("at", *(["_o"] if order else []))
    ends = both.groupBy(*keys, "_s").agg(F.max_by("_row", F.when(F.col("_row").isNotNull(), order_key)).alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_s", F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    found = inside.filter("_row IS NULL").join(carried, [*keys, "_s"]).select(*keys, "at", F.coalesce("_hit", "_carry").alias("hit"))
    return left.join(found, [*keys, "at"], "left")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], width: int, order: str | None = None) -> DataFrame:
    """Left rows with ``hit``, the right row nearest to them on either side and ``gap``; of several as near the first by ``order``, or the one before."""
    flip = lambda df: df.withColumn("at", -F.col("at"))
    least = right if order is None else right.groupBy(*keys, "at").agg(F.min_by(F.struct(*[c for c in right.columns if c not in (*keys, "at")]), order).alias("_r")).select(*keys, "at", "_r.*")
    back = last_before(left, least, keys, width).withColumnRenamed("hit", "_back")
    ahead = flip(last_before(flip(back), flip(least), keys, width)).withColumnRenamed("hit", "_ahead")
    gap_back, gap_ahead = F.col("at") - F.col("_back.at"), -F.col("_ahead.at") - F.col("at")
    even = (gap_back == gap_ahead) & (F.lit(True) if order is None else F.col(f"_back.{order}") <= F.col(f"_ahead.{order}"))
    nearer = F.col("_ahead").isNull() | (gap_back < gap_ahead) | even
    turned = F.col("_ahead").withField("at", -F.col("_ahead.at"))
    return ahead.withColumns({"hit": F.when(F.col("_back").isNotNull() & nearer, F.col("_back")).otherwise(turned), "gap": F.when(F.col("_back").isNotNull() & nearer, gap_back).otherwise(gap_ahead)}).drop("_back", "_ahead")


def running(rows: DataFrame, columns: list[str], width: int) -> DataFrame:
    """(at, n, columns): how many rows, and the sums of the columns, lie at or before each place of rows (at, columns)."""
    places = rows.groupBy("at").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in columns]).withColumn("_s", F.floor(F.col("at") / width))
    each = ["n", *columns]
    whole = places.groupBy("_s").agg(*[F.sum(c).alias(c) for c in each])
    before = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # one row for each stretch
    bases = whole.select("_s", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in each])
    own = Window.partitionBy("_s").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return places.withColumns({c: F.sum(c).over(own) for c in each}).join(bases, "_s").select("at", *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in each])


def within(spans: DataFrame, rows: DataFrame, columns: list[str], width: int) -> DataFrame:
    """Spans (start, due; null ends are open) with ``n`` and the sums of the columns of rows (at, columns) inside, both ends included.

    The difference of two running sums, so spans may overlap and be as many as they like.
    """
    sums = running(rows.filter("at IS NOT NULL"), columns, width)
    each = ["n", *columns]
    top = sums.agg(*[F.max(c).alias(c) for c in ["at"]]).first()[0]  # the last place, one row
    numbered = spans.withColumns({"_due": F.coalesce("due", F.lit(top)), "_start": F.col("start")})
    upto = last_before(numbered.withColumn("at", F.col("_due")), sums, [], width).withColumnRenamed("hit", "_to").drop("at")
    since = last_before(upto.withColumn("at", F.col("_start")), sums, [], width, at_once=False).withColumnRenamed("hit", "_from")
    value = lambda c: F.greatest(F.coalesce(F.col(f"_to.{c}"), F.lit(0)) - F.coalesce(F.col(f"_from.{c}"), F.lit(0)), F.lit(0))
    inside = (F.col("_due") >= F.col("_start")) | F.col("_start").isNull()
    return since.select(*spans.columns, *[F.when(inside, value(c)).otherwise(0).alias(c) for c in each])
