"""Features, lifts, scores and point-in-time fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .agg import ratio

# Fixed values of the lift model: least rows of a feature, and the greatest weight.
LEAST, CAP = 30, 3.0


def unpivoted(rows: DataFrame, keep: list[str], features: list[str], name: str = "feature", value: str = "fires") -> DataFrame:
    """One row per feature, so that all are fitted by one aggregation."""
    pairs = F.array(*(F.struct(F.lit(f).alias("n"), F.col(f).alias("v")) for f in features))
    return rows.select(*keep, F.explode(pairs).alias("_p")).select(*keep, F.col("_p.n").alias(name), F.col("_p.v").alias(value))


def weight(hit: Column, base: Column, n: Column) -> Column:
    """ln(hit / base) between 0 and ``CAP``; 0 for few rows."""
    lift = F.when((n >= LEAST) & (hit > 0) & (base > 0), hit / base).otherwise(F.lit(1.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(CAP), F.log(lift)))


def fit_lifts(rows: DataFrame, features: list[str], label: str, by: list[str] | None = None) -> DataFrame:
    """(by, feature, n, n_bad, base, hit, w) over the rows whose label is known."""
    by = by or []
    y = F.col(label).cast("int")
    known = rows.filter(F.col(label).isNotNull())
    long = unpivoted(known.select(*by, y.alias("_y"), *features), [*by, "_y"], features)
    sums = long.groupBy(*by, "feature").agg(F.count("*").alias("_all"), F.sum("_y").alias("_bad"), F.count_if("fires").alias("n"), F.coalesce(F.sum(F.when(F.col("fires"), F.col("_y"))), F.lit(0)).alias("n_bad"))
    hit, base = F.col("n_bad") / F.nullif(F.col("n"), F.lit(0)), F.col("_bad") / F.nullif(F.col("_all"), F.lit(0))
    return sums.select(*by, "feature", "n", "n_bad", base.alias("base"), hit.alias("hit"), weight(hit, base, F.col("n")).alias("w"))


def scored(rows: DataFrame, lifts: DataFrame, features: list[str], bad: str, by: list[str] | None = None) -> DataFrame:
    """rows with ``score`` (0 to 100) and ``reasons``: the features that fire, the heaviest first.

    The weights are one row (per ``by``) with a map, at most as long as the list of features.
    """
    by = by or []
    packed = lifts.groupBy(*by).agg(F.max("base").alias("_base"), F.map_from_entries(F.collect_list(F.struct("feature", "w"))).alias("_w"))
    rows = rows.join(F.broadcast(packed), by) if by else rows.crossJoin(F.broadcast(packed))  # one row per ``by``
    fired = F.filter(F.array(*(F.struct((-F.coalesce(F.try_element_at("_w", F.lit(f)), F.lit(0.0))).alias("o"), F.lit(f).alias("f"), F.col(f).alias("v")) for f in features)), lambda p: F.coalesce(p["v"], F.lit(False)) & (p["o"] < 0))
    total = sum(F.when(F.col(f), F.coalesce(F.try_element_at("_w", F.lit(f)), F.lit(0.0))).otherwise(0.0) for f in features)
    logit = F.log(F.col("_base") / (1 - F.col("_base"))) + total
    score = F.when(F.col(bad), F.lit(100.0)).otherwise(100.0 / (1 + F.exp(-logit)))
    return rows.withColumn("score", score).withColumn("reasons", F.transform(F.array_sort(fired), lambda p: p["f"])).drop("_base", "_w")


def walk_forward(zs: DataFrame, ics: DataFrame, date: str, least: int = 4, floor: float = 0.03) -> DataFrame:
    """(name, date, score, n_signals): z-scores weighted by the mean of earlier periods' ICs.

    zs (name, date, signal, z); ics (signal, date, ic). A period's weight uses periods before it
    only, ``least`` of them at least, and counts from ``floor`` on.
    """
    before = Window.partitionBy("signal").orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    w = ics.select("signal", date, F.avg("ic").over(before).alias("w"), F.count("ic").over(before).alias("n"))
    w = w.filter((F.col("n") >= least) & (F.abs("w") >= floor)).select("signal", date, "w")
    j = zs.join(w, ["signal", date]).filter("z IS NOT NULL")
    return j.groupBy("name", date).agg(ratio(F.sum(F.col("w") * F.col("z")), F.sum(F.abs("w"))).alias("score"), F.count("*").alias("n_signals"))
