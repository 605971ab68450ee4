"""Window operators: offsets, ranks, percentiles and cross-sectional scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def offsets(df: DataFrame, keys: list[str], order: str, lags: dict[str, list[int]]) -> DataFrame:
    """Adds ``<column>_lag<n>`` by row offset; all share one sort."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumns({f"{c}_lag{n}": F.lag(c, n).over(w) for c, ns in lags.items() for n in ns})


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rn).filter(F.col("_rn") <= n).drop("_rn")


def zscore(value: str, group: list[str], clip: float | None = 3.0, least: int = 1) -> Column:
    """(value - mean) / sample deviation in the group, clipped; null for fewer values or no spread."""
    w = Window.partitionBy(*group)
    spread = F.stddev_samp(value).over(w)
    z = F.when((F.count(value).over(w) >= least) & (spread > 0), (F.col(value) - F.avg(value).over(w)) / spread)
    return z if clip is None else F.when(z.isNotNull(), F.greatest(F.lit(-clip), F.least(F.lit(clip), z)))


def mean_rank(value: str, group: list[str]) -> Column:
    """Rank from 1 among the group's non-null values; ties share the mean of their ranks."""
    null = F.col(value).isNull()
    at = Window.partitionBy(*group, null).orderBy(value)
    ties = F.count("*").over(Window.partitionBy(*group, value))
    return F.when(~null, F.rank().over(at) + (ties - 1) / F.lit(2.0))


def mid_percentile(value: str, group: list[str]) -> Column:
    """Share of the group's other non-null values below, ties counting half; null for a lone value."""
    null = F.col(value).isNull()
    at = Window.partitionBy(*group, null).orderBy(value)
    ties, n = F.count("*").over(Window.partitionBy(*group, value)), F.count(value).over(Window.partitionBy(*group))
    return F.when(~null & (n > 1), (F.rank().over(at) - 1 + F.lit(0.5) * (ties - 1)) / (n - 1))


def complete(df: DataFrame, x: str, y: str, group: list[str]) -> DataFrame:
    """The complete pairs, dealt to their groups once for all windows over the group and more."""
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*group, x, y).repartition(*group)


def spearman(df: DataFrame, x: str, y: str, group: list[str], least: int = 6) -> DataFrame:
    """(group, n, ic): rank correlation over complete pairs; null for few pairs or a constant side."""
    pairs = complete(df, x, y, group)
    ranked = pairs.select(*group, mean_rank(x, group).alias("_x"), mean_rank(y, group).alias("_y"))
    # ranks are halves of integers, so these sums are exact
    s = lambda e: F.sum(e)
    n = F.count("*").cast("double")
    a, b = F.col("_x"), F.col("_y")
    sums = ranked.groupBy(*group).agg(n.alias("n"), s(a * b).alias("xy"), s(a).alias("sx"), s(b).alias("sy"), s(a * a).alias("xx"), s(b * b).alias("yy"))
    vx, vy = F.col("n") * F.col("xx") - F.col("sx") * F.col("sx"), F.col("n") * F.col("yy") - F.col("sy") * F.col("sy")
    ic = F.when((F.col("n") >= least) & (vx > 0) & (vy > 0), (F.col("n") * F.col("xy") - F.col("sx") * F.col("sy")) / F.sqrt(vx) / F.sqrt(vy))
    return sums.select(*group, F.col("n").cast("bigint").alias("n"), ic.alias("ic"))


def fifths(df: DataFrame, signal: str, outcome: str, group: list[str], least: int = 12, at_least: int = 2) -> DataFrame:
    """(group, n, k, spread): mean outcome of the top fifth by signal minus that of the bottom fifth."""
    w = Window.partitionBy(*group)
    pairs = complete(df, signal, outcome, group)
    up = F.row_number().over(w.orderBy(signal, outcome))
    placed = pairs.select(*group, F.col(outcome).alias("_y"), up.alias("_up"), F.count("*").over(w).alias("_n"))
    placed = placed.withColumn("_k", F.greatest(F.lit(at_least), F.floor(F.col("_n") / 5)).cast("bigint"))
    y = F.col("_y").cast("decimal(24,9)")
    top, low = F.sum(F.when(F.col("_up") > F.col("_n") - F.col("_k"), y)), F.sum(F.when(F.col("_up") <= F.col("_k"), y))
    out = placed.groupBy(*group).agg(F.max("_n").alias("n"), F.max("_k").alias("k"), (top.cast("double") - low.cast("double")).alias("_d"))
    return out.filter(F.col("n") >= least).select(*group, F.col("n").cast("bigint").alias("n"), "k", (F.col("_d") / F.col("k")).alias("spread"))


def t_stat(value: Column, least: int = 3) -> Column:
    """mean / (sd / sqrt n), null for few values or none that differ."""
    sd, n = F.stddev_samp(value), F.count(value)
    return F.when((n >= least) & (sd > 0), F.avg(value) / (sd / F.sqrt(n)))


def overlap_t(df: DataFrame, keys: list[str], order: str, value: str, lags: str, most: int, least: int = 6) -> DataFrame:
    """(keys, n, mean, t): mean of a series and its t-statistic corrected for overlap.

    Neighbouring values of a forward window of h periods share h - 1 of them. The variance of the
    mean adds the autocovariances up to ``lags`` (a column, constant in the keys, ``most`` at most),
    the l-th weighted by 1 - l / (lags + 1). Null for few values or a variance that isn't above zero.
    """
    rows = df.filter(F.col(value).isNotNull())
    off = rows.select(*keys, order, F.col(lags).alias("_lags"), F.col(value).alias("_v"), (F.col(value) - F.avg(value).over(Window.partitionBy(*keys))).alias("_e"))
    along = Window.partitionBy(*keys).orderBy(order)
    both = off.select("*", *(F.coalesce(F.lag("_e", n).over(along), F.lit(0.0)).alias(f"_e{n}") for n in range(1, most + 1)))
    weight = lambda n: F.greatest(F.lit(0.0), 1 - F.lit(n) / (F.col("_lags") + 1))
    term = F.col("_e") * F.col("_e") + sum((2 * weight(n) * F.col("_e") * F.col(f"_e{n}") for n in range(1, most + 1)), F.lit(0.0))
    sums = both.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), F.sum(term).alias("_s"))
    # the variance of the mean is _s / n / n
    t = F.when((F.col("n") >= least) & (F.col("_s") > 1e-12), F.col("mean") * F.col("n") / F.sqrt("_s"))
    return sums.select(*keys, "n", "mean", t.alias("t"))
