"""Aggregations that the built-in functions do not name."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_sum(value: Column) -> Column:
    """A sum that does not depend on the order of its terms: decimal inside, double outside."""
    return F.sum(value.cast("decimal(24,6)")).cast("double")


def rounded(value: Column, digits: int = 6) -> Column:
    """Rounded, and never minus zero."""
    return F.round(value, digits) + F.lit(0.0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null."""
    return a / F.nullif(b, F.lit(0.0))


def weighted_mean(value: Column, weight: Column, where: Column | None = None) -> Column:
    """Mean of the non-null values under ``where``, by weight; null without weight."""
    valid = value.isNotNull() & weight.isNotNull() & (F.lit(True) if where is None else where)
    return ratio(exact_sum(F.when(valid, value * weight)), exact_sum(F.when(valid, weight)))


def share(amount: Column, where: Column) -> Column:
    """The part of the total amount that stands under ``where``."""
    return ratio(F.coalesce(exact_sum(F.when(where, amount)), F.lit(0.0)), exact_sum(amount))


def latest(value: Column, *by: Column) -> Column:
    """The value with the greatest ``by`` among rows whose value is not null."""
    return F.max_by(value, F.when(value.isNotNull(), F.struct(*by)))


def pivot_facts(facts: DataFrame, keys: list[str], tag: str, value: str, sums: Iterable[str] = (), peaks: Iterable[str] = (), lasts: Iterable[str] = (), by: str | None = None) -> DataFrame:
    """Entity-attribute-value rows to one row per key.

    ``sums`` add the distinct values of a tag (a value reported twice counts once), ``peaks`` take
    the greatest, ``lasts`` the one with the greatest ``by``. The distinct step is one shuffle for
    all tags, instead of one expansion per tag that sum(DISTINCT) would need.
    """
    wanted = [*sums, *peaks, *lasts]
    keep = [F.max(by).alias(by)] if by else []
    once = facts.filter(F.col(tag).isin(wanted)).groupBy(*keys, tag, value).agg(*keep, F.count("*").alias("_n"))
    on = lambda t: F.when(F.col(tag) == t, F.col(value))
    columns = [exact_sum(on(t)).alias(t) for t in sums] + [F.max(on(t)).alias(t) for t in peaks]
    columns += [latest(on(t), F.col(by), F.col(value)).alias(t) for t in lasts]
    return once.groupBy(*keys).agg(*columns)


def most_frequent(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n): the value that occurs most often, the least of those that tie."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), value))
    return counts.withColumn("_rn", best).filter("_rn = 1").drop("_rn")


def leave_one_out(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    """Adds the mean of the group's other rows; null for a group of one."""
    w = Window.partitionBy(*group)
    n, total = F.count(value).over(w), F.sum(F.col(value).cast("decimal(24,6)")).over(w).cast("double")
    return df.withColumn(out, F.when((n > 1) & F.col(value).isNotNull(), (total - F.col(value)) / (n - 1)))


def leave_group_out(df: DataFrame, group: list[str], own: str, value: str, weight: str, out: str) -> DataFrame:
    """Adds the weighted mean over the group's rows with another ``own``; null if there are none."""
    sums = lambda w: [F.sum((F.col(c)).cast("decimal(24,6)")).over(w).cast("double") for c in ("_vw", weight)]
    df = df.withColumn("_vw", F.col(value) * F.col(weight))
    (vw, wt), (own_vw, own_wt) = sums(Window.partitionBy(*group)), sums(Window.partitionBy(*group, own))
    return df.withColumn(out, ratio(vw - own_vw, wt - own_wt)).drop("_vw")


def at_grains(df: DataFrame, grains: list[list[str]], aggs: list[Column]) -> DataFrame:
    """The same aggregates at several grains in one pass, with the columns of all and a ``grain`` id."""
    columns = list(dict.fromkeys(c for g in grains for c in g))
    return df.groupingSets([[F.col(c) for c in g] for g in grains], *columns).agg(F.grouping_id().cast("bigint").alias("grain"), *aggs)
