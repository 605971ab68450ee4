"""Reported facts by two times: the period that a fact is about and the day it was filed.

A fact (entity, period, tag, value) can be filed again with another value. ``newest`` takes what
was filed last; ``versions`` and ``known`` keep the days apart, so that a question asked on a day
sees only what had been filed by then. ``quarters`` takes sums over several quarters apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import band


def newest(facts: DataFrame, keys: list[str], value: str = "value", filed: str = "filed") -> DataFrame:
    """(keys, value): of each key the value filed last, the greatest of one day; null values say nothing."""
    return facts.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, F.struct(filed, value)).alias(value))


def quarters(facts: DataFrame, entity: str, period: str = "ddate", tag: str = "tag", qtrs: str = "qtrs", value: str = "value", most: int = 4) -> DataFrame:
    """(entity, period, tag, value): the flow of the quarter that ends each period.

    facts have one row for an entity, tag, period and number of quarters. A fact over one quarter
    is it; else a fact over n quarters less the one over n - 1 that ended a quarter (80 to 100 days)
    before, the smallest n first. Where that one is missing the quarter has no value: a gap stays one.
    """
    before = facts.select(entity, tag, (F.col(qtrs) + 1).alias(qtrs), F.col(period).alias("_p"), F.col(value).alias("_before"))
    several = facts.filter((F.col(qtrs) > 1) & (F.col(qtrs) <= most))
    less = band(several, before, [entity, tag, qtrs], period, "_p", -100, -80, ["_before"], -90).withColumn(value, F.col(value) - F.col("_before"))
    every = facts.filter(F.col(qtrs) == 1).select(entity, period, tag, qtrs, value).unionByName(less.select(entity, period, tag, qtrs, value))
    return every.filter(F.col(value).isNotNull()).groupBy(entity, period, tag).agg(F.min_by(value, qtrs).alias(value))


def versions(facts: DataFrame, keys: list[str], tags: list[str], tag: str = "tag", value: str = "value", filed: str = "filed") -> DataFrame:
    """(keys, filed, one column a tag): what was known of a key after each day on which something was filed."""
    days = facts.filter(F.col(tag).isin(tags) & F.col(value).isNotNull()).groupBy(*keys, filed).agg(*(F.max(F.when(F.col(tag) == t, F.col(value))).alias(t) for t in tags))
    so_far = Window.partitionBy(*keys).orderBy(filed).rowsBetween(Window.unboundedPreceding, 0)
    return days.select(*keys, filed, *(F.last(t, True).over(so_far).alias(t) for t in tags))


def known(asked: DataFrame, told: DataFrame, entity: str, when: str, period: str, values: list[str], filed: str = "filed") -> DataFrame:
    """Rows of ``asked`` with the newest period known on their day, and its values as known then.

    ``told``: (entity, period, filed, values). What is filed on the day itself counts. Both sides are
    one stream per entity in the order of days; the greatest (period, filed) so far is the answer, so
    nothing filed later can change it. Rows with a null entity or day know nothing.
    """
    fact = F.struct(F.col(period).alias("period"), F.col(filed).alias("filed"), *(F.col(v).alias(v) for v in values))
    facts = told.filter(F.col(period).isNotNull() & F.col(filed).isNotNull()).select(entity, F.col(filed).alias("_day"), fact.alias("_fact"))
    kind = facts.schema["_fact"].dataType
    rows = asked.select(entity, F.col(when).alias("_day"), F.lit(None).cast(kind).alias("_fact"), F.struct("*").alias("_row"))
    stream = rows.unionByName(facts, allowMissingColumns=True)
    so_far = Window.partitionBy(entity).orderBy("_day", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = stream.withColumn("_best", F.max("_fact").over(so_far)).filter(F.col("_row").isNotNull())
    ok = F.col(f"_row.{entity}").isNotNull() & F.col("_day").isNotNull()
    names = {"period": period, "filed": filed} | {v: v for v in values}
    return found.select("_row.*", *(F.when(ok, F.col(f"_best.{c}")).alias(n) for c, n in names.items()))
