"""Prices, as-of joins and the screen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.agg import leave_one_out, ratio, rounded
from ..operators.asof import asof, band, band_pairs, nearest
from .binding import FACTS, PRICES, facts, holdings, prices
from .signals import LENDER_QUARTERS, lender_quarters, loan_quarters


def price_points(spark: SparkSession, sf: str) -> DataFrame:
    """Last price of each ticker, what traded in the year before, and prices 91, 182, 365 days before."""
    p = prices(spark, sf)
    year = Window.partitionBy("ticker").orderBy(F.unix_date("date")).rangeBetween(-365, 0)
    p = p.withColumn("volume_ttm", F.sum(F.col("volume").cast("decimal(24,6)")).over(year).cast("double"))
    last = p.groupBy("ticker").agg(F.max_by(F.struct("date", "close", "volume_ttm"), "date").alias("l"))
    out = last.select("ticker", F.col("l.date").alias("last_date"), F.col("l.close").alias("last_close"), F.col("l.volume_ttm").alias("volume_ttm"))
    for days in (91, 182, 365):
        r = p.select("ticker", F.col("date").alias("d"), F.col("close").alias(f"close_{days}"))
        out = asof(out.withColumn("at", F.date_sub("last_date", days)), r, ["ticker"], "at", "d", [f"close_{days}"]).drop("at", "match_time")
    return out.select("ticker", "last_date", *(rounded(F.col(c), 4).alias(c) for c in ("last_close", "volume_ttm", "close_91", "close_182", "close_365")))


PRICE_POINTS = f"""WITH {PRICES}, p AS (SELECT *, CAST(sum(CAST(volume AS DECIMAL(24,6))) OVER (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND CURRENT ROW) AS DOUBLE) AS volume_ttm FROM prices),
l AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1)
SELECT l.ticker, l.date AS last_date, round(l.close, 4) + 0.0 AS last_close, round(l.volume_ttm, 4) + 0.0 AS volume_ttm,
  {", ".join(f"round((SELECT arg_max(close, date) FROM prices p WHERE p.ticker = l.ticker AND p.date <= l.date - INTERVAL {d} DAY), 4) + 0.0 AS close_{d}" for d in (91, 182, 365))} FROM l"""


def asof_last(spark: SparkSession, sf: str) -> DataFrame:
    """Each purchase with the user's last view at or before it, at most 10 days old."""
    f = facts(spark, sf)
    buys = f.filter("tag = 'purchase'").select("event_id", "entity", "ts")
    views = f.filter("tag = 'view'").select("entity", F.col("ts").alias("seen"), F.col("value").alias("viewed"))
    return asof(buys, views, ["entity"], "ts", "seen", ["viewed"], tolerance=10).select("event_id", "entity", "ts", "match_time", "viewed")


ASOF_LAST = f"""WITH {FACTS}, v AS (SELECT entity, ts AS seen, max(value) AS viewed FROM facts WHERE tag = 'view' GROUP BY 1, 2), b AS (SELECT event_id, entity, ts FROM facts WHERE tag = 'purchase')
SELECT event_id, b.entity, ts, CASE WHEN date_diff('day', CAST(seen AS DATE), CAST(ts AS DATE)) <= 10 THEN seen END AS match_time, CASE WHEN date_diff('day', CAST(seen AS DATE), CAST(ts AS DATE)) <= 10 THEN viewed END AS viewed
FROM b ASOF LEFT JOIN v ON b.entity = v.entity AND b.ts >= v.seen"""


def event_entry(spark: SparkSession, sf: str) -> DataFrame:
    """Each purchase entered at the user's first view strictly after it, against the others of the day."""
    f = facts(spark, sf)
    buys = f.filter("tag = 'purchase'").select("event_id", "entity", "ts", "ddate")
    views = f.filter("tag = 'view'").select("entity", F.col("ts").alias("seen"), F.col("value").alias("entry"))
    e = asof(buys, views, ["entity"], "ts", "seen", ["entry"], direction="forward", tolerance=7, strict=True).filter("entry IS NOT NULL")
    e = leave_one_out(e, ["ddate"], "entry", "others")
    return e.select("event_id", "entity", "match_time", "entry", "others", (F.col("entry") - F.col("others")).alias("excess"))


EVENT_ENTRY = f"""WITH {FACTS}, v AS (SELECT entity, ts AS seen, max(value) AS entry FROM facts WHERE tag = 'view' GROUP BY 1, 2),
e AS (SELECT event_id, b.entity, ddate, seen AS match_time, entry FROM (SELECT * FROM facts WHERE tag = 'purchase') b ASOF JOIN v ON b.entity = v.entity AND b.ts < v.seen WHERE date_diff('day', ddate, CAST(seen AS DATE)) <= 7),
o AS (SELECT *, CASE WHEN count(entry) OVER w > 1 THEN (CAST(sum(CAST(entry AS DECIMAL(24,6))) OVER w AS DOUBLE) - entry) / (count(entry) OVER w - 1) END AS others FROM e WINDOW w AS (PARTITION BY ddate))
SELECT event_id, entity, match_time, entry, others, entry - others AS excess FROM o"""


def pnav_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """Quarter ends with the price nearest to 45 days later and the last one before."""
    p = prices(spark, sf).select("ticker", F.col("date").alias("d"), F.col("close").alias("price"))
    q = p.select("ticker", F.last_day(F.add_months(F.date_trunc("quarter", "d").cast("date"), 2)).alias("period")).distinct()
    near = nearest(q, p, ["ticker"], "period", "d", 20, ["price"], shift=45).select("ticker", "period", F.col("match_time").alias("near_date"), F.col("price").alias("near_price"))
    both = asof(near, p.withColumnRenamed("price", "end_price"), ["ticker"], "period", "d", ["end_price"], tolerance=14)
    return both.select("ticker", "period", "near_date", rounded(F.col("near_price"), 4).alias("near_price"), F.col("match_time").alias("end_date"), rounded(F.col("end_price"), 4).alias("end_price"))


PNAV_NEAREST = f"""WITH {PRICES}, q AS (SELECT DISTINCT ticker, CAST(last_day(date_trunc('quarter', date) + INTERVAL 2 MONTH) AS DATE) AS period FROM prices),
n AS (SELECT q.ticker, q.period, p.date, p.close FROM q JOIN prices p ON p.ticker = q.ticker AND date_diff('day', q.period, p.date) BETWEEN 25 AND 65
  QUALIFY row_number() OVER (PARTITION BY q.ticker, q.period ORDER BY abs(date_diff('day', q.period, p.date) - 45), p.date) = 1)
SELECT q.ticker, q.period, n.date AS near_date, round(n.close, 4) + 0.0 AS near_price,
  CASE WHEN date_diff('day', e.date, q.period) <= 14 THEN e.date END AS end_date, CASE WHEN date_diff('day', e.date, q.period) <= 14 THEN round(e.close, 4) + 0.0 END AS end_price
FROM q LEFT JOIN n USING (ticker, period) ASOF LEFT JOIN prices e ON e.ticker = q.ticker AND q.period >= e.date"""


def fundamentals_band(spark: SparkSession, sf: str) -> DataFrame:
    """Lender-quarters with their book one quarter and one year before, by date and not by row."""
    b = lender_quarters(loan_quarters(holdings(spark, sf, dealt=True))).select("lender", "period", "cost", "book_mark")
    r = b.select("lender", F.col("period").alias("p"), F.col("cost").alias("cost_1q"), F.col("book_mark").alias("mark_1q"))
    out = band(b, r, ["lender"], "period", "p", -105, -75, ["cost_1q", "mark_1q"], -105).drop("match_time")
    r4 = r.select("lender", "p", F.col("cost_1q").alias("cost_4q"))
    out = band(out, r4, ["lender"], "period", "p", -385, -345, ["cost_4q"], -385).drop("match_time")
    return out.select("lender", "period", rounded(F.col("cost"), 4).alias("cost"), rounded(F.col("book_mark") - F.col("mark_1q")).alias("mark_chg_1q"), rounded(ratio(F.col("cost"), F.col("cost_1q")) - 1, 5).alias("growth_1q"), rounded(ratio(F.col("cost"), F.col("cost_4q")) - 1, 5).alias("growth_4q"))


FUNDAMENTALS_BAND = f"""WITH {LENDER_QUARTERS}, b AS (SELECT lender, period, cost, book_mark FROM lender_quarters)
SELECT b.lender, b.period, round(b.cost, 4) + 0.0 AS cost, round(b.book_mark - q.book_mark, 6) + 0.0 AS mark_chg_1q, round(b.cost / nullif(q.cost, 0) - 1, 5) + 0.0 AS growth_1q, round(b.cost / nullif(y.cost, 0) - 1, 5) + 0.0 AS growth_4q
FROM b LEFT JOIN b q ON q.lender = b.lender AND date_diff('day', b.period, q.period) BETWEEN -105 AND -75 LEFT JOIN b y ON y.lender = b.lender AND date_diff('day', b.period, y.period) BETWEEN -385 AND -345"""


def universe(spark: SparkSession, sf: str) -> DataFrame:
    """Rebalance dates (75 days after quarters) by tickers, with entry price and trailing liquidity.

    The dates are a calendar, a few a year whatever the data's size; they are joined to each
    ticker's prices by buckets of days.
    """
    p = prices(spark, sf)
    dates = p.select(F.last_day(F.add_months(F.date_trunc("quarter", "date").cast("date"), 2)).alias("period")).distinct().select("period", F.date_add("period", 75).alias("rebal"))
    names = p.select("ticker").distinct()
    u = names.crossJoin(F.broadcast(dates))
    r = p.select("ticker", F.col("date").alias("d"), F.col("close").alias("entry"))
    u = asof(u, r, ["ticker"], "rebal", "d", ["entry"], tolerance=10).withColumnRenamed("match_time", "entry_date")
    liquid = band_pairs(u.select("ticker", "rebal"), p, ["ticker"], "rebal", "date", -179, 0).groupBy(F.col("_l.ticker").alias("ticker"), F.col("_l.rebal").alias("rebal"))
    liquid = liquid.agg(F.median(F.col("_r.close") * F.col("_r.volume")).alias("dollar_volume"), F.count("*").alias("n_days"))
    out = u.join(liquid, ["ticker", "rebal"]).filter("n_days >= 20 AND entry IS NOT NULL")
    nxt = F.lead("entry").over(Window.partitionBy("ticker").orderBy("rebal"))
    return out.withColumn("fwd", ratio(nxt, F.col("entry")) - 1).select("ticker", "period", "rebal", "entry_date", "entry", "dollar_volume", "n_days", "fwd")


UNIVERSE = PRICES + """, dates AS (SELECT DISTINCT CAST(last_day(date_trunc('quarter', date) + INTERVAL 2 MONTH) AS DATE) AS period FROM prices),
d AS (SELECT period, CAST(period + INTERVAL 75 DAY AS DATE) AS rebal FROM dates),
liquid AS (SELECT ticker, rebal, median(close * volume) AS dollar_volume, count(*) AS n_days FROM d JOIN prices ON date_diff('day', rebal, date) BETWEEN -179 AND 0 GROUP BY 1, 2),
e AS (SELECT t.ticker, period, rebal, p.date AS entry_date, p.close AS entry FROM (SELECT DISTINCT ticker FROM prices) t CROSS JOIN d ASOF JOIN prices p ON p.ticker = t.ticker AND d.rebal >= p.date WHERE date_diff('day', p.date, rebal) <= 10),
universe AS (SELECT ticker, period, rebal, entry_date, entry, dollar_volume, n_days, lead(entry) OVER (PARTITION BY ticker ORDER BY rebal) / nullif(entry, 0) - 1 AS fwd FROM e JOIN liquid USING (ticker, rebal) WHERE n_days >= 20)"""


def bt_universe(spark: SparkSession, sf: str) -> DataFrame:
    u = universe(spark, sf)
    mean = F.avg("fwd").over(Window.partitionBy("rebal"))
    return u.select("ticker", "period", "rebal", "entry_date", "entry", rounded(F.col("dollar_volume"), 3).alias("dollar_volume"), "n_days", rounded(F.col("fwd"), 5).alias("fwd"), rounded(F.col("fwd") - mean, 5).alias("excess"))


BT_UNIVERSE = f"WITH {UNIVERSE} SELECT ticker, period, rebal, entry_date, entry, round(dollar_volume, 3) + 0.0 AS dollar_volume, n_days, round(fwd, 5) + 0.0 AS fwd, round(fwd - avg(fwd) OVER (PARTITION BY rebal), 5) + 0.0 AS excess FROM universe"


def screen_quadrant(spark: SparkSession, sf: str) -> DataFrame:
    """Latest lenders ranked by book mark, stress and its yearly change, with quadrant and scores."""
    b = lender_quarters(loan_quarters(holdings(spark, sf, dealt=True)))
    newest = b.agg(F.max("period").alias("top"))
    base = b.withColumn("_rn", F.row_number().over(Window.partitionBy("lender").orderBy(F.desc("period")))).filter("_rn = 1")
    base = base.crossJoin(F.broadcast(newest)).filter(F.datediff("top", "period") <= 200)  # one row
    alone = Window.partitionBy(F.lit(0))
    rank = lambda c: F.percent_rank().over(alone.orderBy(F.col(c).asc_nulls_last()))
    r = base.select("lender", "period", "book_mark", "sh_stress", "d4_sh_stress", rank("book_mark").alias("mark_pct"), rank("sh_stress").alias("stress_pct"), rank("d4_sh_stress").alias("trend_pct"), F.median("book_mark").over(alone).alias("mark_mid"), F.median("sh_stress").over(alone).alias("stress_mid"))
    quadrant = F.when((F.col("d4_sh_stress") > 0.1) & (F.col("book_mark") >= F.col("mark_mid")), "short_candidate").when((F.col("sh_stress") < F.col("stress_mid")) & (F.col("mark_pct") <= 0.3), "long_candidate").when(F.col("d4_sh_stress") > 0.1, "deteriorating_priced").when(F.col("mark_pct") <= 0.3, "cheap_but_messy").otherwise("neutral")
    return r.select("lender", "period", *(rounded(F.col(c)).alias(c) for c in ("mark_pct", "stress_pct", "trend_pct")), quadrant.alias("quadrant"), rounded(F.coalesce("stress_pct", F.lit(0.5)) + F.coalesce("trend_pct", F.lit(0.5)) + F.coalesce("mark_pct", F.lit(0.5)), 5).alias("short_score"))


SCREEN_QUADRANT = f"""WITH {LENDER_QUARTERS}, base AS (SELECT * FROM lender_quarters QUALIFY row_number() OVER (PARTITION BY lender ORDER BY period DESC) = 1),
r AS (SELECT lender, period, book_mark, sh_stress, d4_sh_stress, percent_rank() OVER (ORDER BY book_mark) AS mark_pct, percent_rank() OVER (ORDER BY sh_stress) AS stress_pct, percent_rank() OVER (ORDER BY d4_sh_stress) AS trend_pct,
  median(book_mark) OVER () AS mark_mid, median(sh_stress) OVER () AS stress_mid FROM base WHERE date_diff('day', period, (SELECT max(period) FROM lender_quarters)) <= 200)
SELECT lender, period, round(mark_pct, 6) + 0.0 AS mark_pct, round(stress_pct, 6) + 0.0 AS stress_pct, round(trend_pct, 6) + 0.0 AS trend_pct,
  CASE WHEN d4_sh_stress > 0.1 AND book_mark >= mark_mid THEN 'short_candidate' WHEN sh_stress < stress_mid AND mark_pct <= 0.3 THEN 'long_candidate' WHEN d4_sh_stress > 0.1 THEN 'deteriorating_priced' WHEN mark_pct <= 0.3 THEN 'cheap_but_messy' ELSE 'neutral' END AS quadrant,
  round(stress_pct + trend_pct + mark_pct, 5) + 0.0 AS short_score FROM r"""

QUERIES = {"price_points": price_points, "asof_last": asof_last, "event_entry": event_entry, "pnav_nearest": pnav_nearest, "fundamentals_band": fundamentals_band, "bt_universe": bt_universe, "screen_quadrant": screen_quadrant}
SQL = {"price_points": PRICE_POINTS, "asof_last": ASOF_LAST, "event_entry": EVENT_ENTRY, "pnav_nearest": PNAV_NEAREST, "fundamentals_band": FUNDAMENTALS_BAND, "bt_universe": BT_UNIVERSE, "screen_quadrant": SCREEN_QUADRANT}
