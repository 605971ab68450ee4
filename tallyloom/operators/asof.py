"""As-of joins without a nested loop.

``asof`` puts both sides in one ordered stream per key and carries the last (or next) right row
along: one shuffle and one sort, linear in both sides. ``band`` and ``nearest`` are equi joins on
the key and a time bucket, so that a key with a long history is split over buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _days(c: Column) -> Column:
    return F.unix_date(c.cast("date"))


def asof(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, values: list[str], direction: str = "backward", tolerance: int | None = None, strict: bool = False) -> DataFrame:
    """Left rows with ``values`` (and the time, as ``match_time``) of the nearest right row.

    backward: the last right row at or before the left time; forward: the first at or after it;
    strict: not at it. ``tolerance`` in days. Right rows that tie on key and time: the greatest by
    values. Left rows without a match keep nulls; null keys or times match nothing.
    """
    back = direction == "backward"
    best = right.filter(F.col(right_time).isNotNull()).groupBy(*on, right_time).agg(F.max(F.struct(*values)).alias("_v"))
    r = best.select(*on, F.col(right_time).alias("_t"), F.struct(F.col(right_time).alias("t"), "_v").alias("_right"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("_left"))
    stream = left.select(*on, F.col(left_time).alias("_t"), F.lit(None).cast(r.schema["_right"].dataType).alias("_right"), F.struct("*").alias("_left")).unionByName(r)
    is_left = F.col("_left").isNotNull().cast("int")
    # read from the end for forward; in both directions a right row at the same time comes first
    # if it counts and last if it doesn't
    order = [F.col("_t") if back else F.col("_t").desc(), 1 - is_left if strict else is_left]
    w = Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = stream.withColumn("_m", F.last("_right", ignorenulls=True).over(w)).filter(F.col("_left").isNotNull())
    known = F.lit(True)
    for key in on:
        known &= F.col(f"_left.{key}").isNotNull()
    ok = known & F.col(f"_left.{left_time}").isNotNull() & F.col("_m").isNotNull()
    if tolerance is not None:
        ok &= F.abs(_days(F.col("_m.t")) - _days(F.col(f"_left.{left_time}"))) <= tolerance
    return found.select("_left.*", F.when(ok, F.col("_m.t")).alias("match_time"), *(F.when(ok, F.col(f"_m._v.{v}")).alias(v) for v in values))


def band_pairs(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, low: int, high: int) -> DataFrame:
    """(row of left as ``_l``, row of right as ``_r``) with right_time - left_time in [low, high] days.

    Both sides carry buckets as wide as the band; a left row looks into the two that its band can
    touch, so the join is on equality of keys and bucket.
    """
    width = max(high - low, 1)
    bucket = lambda d: F.floor(d / F.lit(width))
    l = left.select(F.struct("*").alias("_l"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(on)), _days(F.col(left_time)).alias("_lt"))
    l = l.withColumn("_b", F.explode(F.array_distinct(F.array(bucket(F.col("_lt") + low), bucket(F.col("_lt") + high)))))
    r = right.select(F.struct("*").alias("_r"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(on)), _days(F.col(right_time)).alias("_rt"))
    r = r.withColumn("_b", bucket(F.col("_rt")))
    keys = [f"_k{i}" for i in range(len(on))] + ["_b"]
    return l.join(r, keys).filter((F.col("_rt") - F.col("_lt")).between(low, high))


def band(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, low: int, high: int, values: list[str], target: int) -> DataFrame:
    """Left rows (told apart by ``on`` and ``left_time``) with ``values`` of the right row in the band
    whose distance is nearest to ``target`` days; the earlier one of two as near."""
    pairs = band_pairs(left.select(*on, left_time).distinct(), right, on, left_time, right_time, low, high)
    off = F.col("_rt") - F.col("_lt")
    best = F.min_by(F.struct("_r", "_rt"), F.struct(F.abs(off - target), off))
    keys = [F.col(f"_l.{c}").alias(c) for c in [*on, left_time]]
    chosen = pairs.groupBy(*keys).agg(best.alias("_best"))
    chosen = chosen.select(*on, left_time, F.col(f"_best._r.{right_time}").alias("match_time"), *(F.col(f"_best._r.{v}").alias(v) for v in values))
    return left.join(chosen, [*on, left_time], "left")


def nearest(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, within: int, values: list[str], shift: int = 0) -> DataFrame:
    """Left rows with ``values`` of the right row nearest to left_time + shift, at most ``within`` days off."""
    return band(left, right, on, left_time, right_time, shift - within, shift + within, values, shift)
