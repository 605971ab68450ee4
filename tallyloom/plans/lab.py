"""Each signal on its own: what follows it over one, two and four quarters, period by period and in sum.

Outcomes are changes of the lender's book and of its net asset value a share, found by date, so a
missing quarter gives no outcome. Windows of several quarters overlap, which the t-statistics of the
summary allow for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.agg import ratio, rounded
from ..operators.asof import band
from ..operators.models import unpivoted
from ..operators.window import fifths, overlap_t, spearman
from ..session import cut
from .binding import holdings
from .fundamentals import EQUITY, NAV, REPORTED, SHARES, navs, reported
from .models import SIGNALS
from .signals import LENDER_QUARTERS, lender_quarters, loan_quarters

#: Days ahead of each horizon in quarters.
HORIZONS = {1: (75, 105), 2: (165, 200), 4: (345, 385)}
OUTCOMES = ["book", "nav"]
KEYS = ["signal", "outcome", "horizon"]


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """(lender, period, signal, x, outcome, horizon, y)."""
    b = lender_quarters(loan_quarters(holdings(spark, sf, dealt=True))).select("lender", "period", *SIGNALS, F.col("cost").alias("book"))
    b = cut(b.join(navs(reported(spark, sf, only_stocks=True)).withColumnRenamed("nav_ps", "nav"), ["lender", "period"], "left"))
    then = b.select("lender", F.col("period").alias("_p"), *(F.col(c).alias(f"_{c}") for c in OUTCOMES))
    each = []
    for h, (low, high) in HORIZONS.items():
        ahead = band(b, then, ["lender"], "period", "_p", low, high, ["_book", "_nav"], (low + high) // 2)
        each += [ahead.select("lender", "period", *SIGNALS, F.lit(c).alias("outcome"), F.lit(h).alias("horizon"), (ratio(F.col(f"_{c}"), F.col(c)) - 1).alias("y")) for c in OUTCOMES]
    return unpivoted(reduce(DataFrame.unionByName, each), ["lender", "period", "outcome", "horizon", "y"], SIGNALS, "signal", "x")


def periods(long: DataFrame) -> DataFrame:
    """(signal, outcome, horizon, period, n, ic, spread): rank correlation, and top less bottom fifth, of each period."""
    ic = spearman(long, "x", "y", [*KEYS, "period"])
    spread = fifths(long, "x", "y", [*KEYS, "period"]).select(*KEYS, "period", "spread")
    return ic.join(spread, [*KEYS, "period"], "left")


def summary(by_period: DataFrame) -> DataFrame:
    """Means over the periods, t-statistics corrected for the overlap of windows, and the share of periods above zero."""
    p = cut(by_period.withColumn("lags", F.col("horizon") - 1))
    most = max(HORIZONS) - 1
    of = lambda c: overlap_t(p, KEYS, "period", c, "lags", most).select(*KEYS, F.col("n").alias(f"n_{c}"), F.col("mean").alias(f"mean_{c}"), F.col("t").alias(f"t_{c}"))
    hits = p.groupBy(*KEYS).agg(F.avg((F.round("ic", 9) > 0).cast("double")).alias("hit_rate"))
    return of("ic").join(of("spread"), KEYS, "full").join(hits, KEYS, "left")


def signal_periods(spark: SparkSession, sf: str) -> DataFrame:
    p = periods(outcomes(spark, sf))
    return p.select(*KEYS, "period", "n", rounded(F.col("ic")).alias("ic"), rounded(F.col("spread")).alias("spread"))


SQL_PERIODS = LENDER_QUARTERS + f""", {REPORTED},
latest AS (SELECT lender, ddate, tag, arg_max(value, (filed, value)) AS value FROM reported WHERE qtrs = 0 GROUP BY 1, 2, 3),
wide AS (SELECT lender, ddate AS period, {", ".join(f"max(value) FILTER (WHERE tag = '{t}') AS {t}" for t in [*EQUITY, *SHARES, NAV])} FROM latest GROUP BY 1, 2),
b AS MATERIALIZED (SELECT q.lender, q.period, {", ".join(SIGNALS)}, q.cost AS book, coalesce({NAV}, coalesce({", ".join(EQUITY)}) / nullif(coalesce({", ".join(SHARES)}), 0)) AS nav FROM lender_quarters q LEFT JOIN wide USING (lender, period)),
ahead AS ({" UNION ALL ".join(f"SELECT b.*, {h} AS horizon, a.book AS book_then, a.nav AS nav_then FROM b LEFT JOIN b a ON a.lender = b.lender AND date_diff('day', b.period, a.period) BETWEEN {low} AND {high}" for h, (low, high) in HORIZONS.items())}),
signal_long AS MATERIALIZED ({" UNION ALL ".join(f"SELECT lender, period, '{s}' AS signal, {s} AS x, '{c}' AS outcome, horizon, {c}_then / nullif({c}, 0) - 1 AS y FROM ahead" for s in SIGNALS for c in OUTCOMES)}),
pairs AS (SELECT * FROM signal_long WHERE x IS NOT NULL AND y IS NOT NULL),
ranked AS (SELECT signal, outcome, horizon, period, rank() OVER (PARTITION BY signal, outcome, horizon, period ORDER BY x) + (count(*) OVER (PARTITION BY signal, outcome, horizon, period, x) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (PARTITION BY signal, outcome, horizon, period ORDER BY y) + (count(*) OVER (PARTITION BY signal, outcome, horizon, period, y) - 1) / 2.0::DOUBLE AS ry FROM pairs),
ics AS (SELECT signal, outcome, horizon, period, count(*) AS n, CASE WHEN count(*) >= 6 AND count(DISTINCT rx) > 1 AND count(DISTINCT ry) > 1 THEN corr(rx, ry) END AS ic FROM ranked GROUP BY 1, 2, 3, 4),
placed AS (SELECT *, row_number() OVER (PARTITION BY signal, outcome, horizon, period ORDER BY x, y) AS up, count(*) OVER (PARTITION BY signal, outcome, horizon, period) AS n FROM pairs),
spreads AS (SELECT signal, outcome, horizon, period, (CAST(sum(CAST(y AS DECIMAL(24,9))) FILTER (WHERE up > n - k) AS DOUBLE) - CAST(sum(CAST(y AS DECIMAL(24,9))) FILTER (WHERE up <= k) AS DOUBLE)) / max(k) AS spread
  FROM (SELECT *, greatest(2, n // 5) AS k FROM placed) GROUP BY 1, 2, 3, 4 HAVING max(n) >= 12),
by_period AS MATERIALIZED (SELECT ics.*, spread FROM ics LEFT JOIN spreads USING (signal, outcome, horizon, period))"""
SIGNAL_PERIODS = f"WITH {SQL_PERIODS} SELECT signal, outcome, horizon, period, n, round(ic, 6) + 0.0 AS ic, round(spread, 6) + 0.0 AS spread FROM by_period"


def signal_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = summary(periods(outcomes(spark, sf)))
    return s.select(*KEYS, "n_ic", rounded(F.col("mean_ic")).alias("mean_ic"), rounded(F.col("t_ic"), 4).alias("t_ic"), "n_spread", rounded(F.col("mean_spread")).alias("mean_spread"), rounded(F.col("t_spread"), 4).alias("t_spread"), rounded(F.col("hit_rate")).alias("hit_rate"))


def _overlap_sql(c: str) -> str:
    most = max(HORIZONS) - 1
    terms = "".join(f" + 2 * greatest(0.0::DOUBLE, 1 - {n} / CAST(horizon AS DOUBLE)) * e * coalesce(e{n}, 0)" for n in range(1, most + 1))
    return f"""(SELECT signal, outcome, horizon, count(*) AS n_{c}, avg(v) AS mean_{c}, CASE WHEN count(*) >= 6 AND sum(e * e{terms}) > 1e-12 THEN avg(v) * count(*) / sqrt(sum(e * e{terms})) END AS t_{c}
  FROM (SELECT *, {", ".join(f"lag(e, {n}) OVER w AS e{n}" for n in range(1, most + 1))} FROM (SELECT signal, outcome, horizon, period, {c} AS v, {c} - avg({c}) OVER (PARTITION BY signal, outcome, horizon) AS e FROM by_period WHERE {c} IS NOT NULL)
        WINDOW w AS (PARTITION BY signal, outcome, horizon ORDER BY period)) GROUP BY 1, 2, 3)"""


SIGNAL_SUMMARY = f"""WITH {SQL_PERIODS} SELECT signal, outcome, horizon, n_ic, round(mean_ic, 6) + 0.0 AS mean_ic, round(t_ic, 4) + 0.0 AS t_ic, n_spread, round(mean_spread, 6) + 0.0 AS mean_spread, round(t_spread, 4) + 0.0 AS t_spread, round(hit_rate, 6) + 0.0 AS hit_rate
FROM {_overlap_sql("ic")} FULL JOIN {_overlap_sql("spread")} USING (signal, outcome, horizon) LEFT JOIN (SELECT signal, outcome, horizon, avg(CAST(round(ic, 9) > 0 AS INT)) AS hit_rate FROM by_period GROUP BY 1, 2, 3) USING (signal, outcome, horizon)"""

QUERIES = {"signal_periods": signal_periods, "signal_summary": signal_summary}
SQL = {"signal_periods": SIGNAL_PERIODS, "signal_summary": SIGNAL_SUMMARY}
