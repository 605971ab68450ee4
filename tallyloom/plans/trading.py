"""Holds of event entries, ten variants of the long-short book with their costs, and lenders to watch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.agg import exact_sum, leave_one_out, ratio, rounded
from ..operators.asof import asof
from ..operators.window import t_stat
from ..session import table
from .binding import PRICES, prices
from .market import SCREEN_QUADRANT, screen_quadrant
from .models import FORWARD, _forward
from .peers import STALE_GENEROSITY, stale_generosity

# Days between entry and exit, days an entry may be late, round-trip cost of a side,
# and what borrowing costs a year by size of the name (up to which size, rate).
HOLD, LATE, ROUND_TRIP = (20, 200), 7, 0.004
BORROW = [(1_000_000, 0.15), (5_000_000, 0.05), (None, 0.01)]


def _holds(spark: SparkSession, sf: str) -> DataFrame:
    """Each order's entry at its nation's first price after it, with the customer's next entry 20 to 200
    days on as exit, and the mean of the others' returns in the quarter."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    filed = o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("entity"), F.col("c_nationkey").alias("ticker"), F.to_date("o_orderdate").alias("filed"))
    quotes = prices(spark, sf).select("ticker", F.col("date").alias("day"), F.col("close").alias("entry"))
    e = asof(filed, quotes, ["ticker"], "filed", "day", ["entry"], direction="forward", tolerance=LATE, strict=True).filter("entry IS NOT NULL")
    w = Window.partitionBy("entity").orderBy("match_time", "event_id")
    e = e.select("event_id", "entity", "match_time", "entry", F.lead("entry").over(w).alias("exit"), F.date_diff(F.lead("match_time").over(w), F.col("match_time")).alias("days"))
    e = e.filter(F.col("days").between(*HOLD)).withColumn("quarter", F.date_trunc("quarter", "match_time").cast("date")).withColumn("ret", ratio(F.col("exit"), F.col("entry")) - 1)
    return leave_one_out(e, ["quarter"], "ret", "others")


HOLDS = PRICES + f""", entries AS (SELECT o_orderkey AS event_id, o_custkey AS entity, p.date AS match_time, p.close AS entry FROM (SELECT *, CAST(o_orderdate AS DATE) AS filed FROM orders JOIN customer ON o_custkey = c_custkey) o
  ASOF JOIN prices p ON o.c_nationkey = p.ticker AND o.filed < p.date WHERE date_diff('day', filed, p.date) <= {LATE}),
next AS (SELECT event_id, entity, match_time, entry, lead(entry) OVER w AS exit, lead(match_time) OVER w AS left_at FROM entries WINDOW w AS (PARTITION BY entity ORDER BY match_time, event_id)),
kept AS (SELECT *, date_diff('day', match_time, left_at) AS days, CAST(date_trunc('quarter', match_time) AS DATE) AS quarter, exit / nullif(entry, 0) - 1 AS ret FROM next WHERE date_diff('day', match_time, left_at) BETWEEN {HOLD[0]} AND {HOLD[1]}),
holds AS (SELECT *, CASE WHEN ret IS NOT NULL AND count(ret) OVER q > 1 THEN (CAST(sum(CAST(ret AS DECIMAL(24,6))) OVER q AS DOUBLE) - ret) / (count(ret) OVER q - 1) END AS others FROM kept WINDOW q AS (PARTITION BY quarter))"""


def event_holds(spark: SparkSession, sf: str) -> DataFrame:
    return _holds(spark, sf).select("event_id", "entity", "quarter", F.col("days").cast("bigint").alias("days"), rounded(F.col("ret"), 5).alias("ret"), rounded(F.col("ret") - F.col("others"), 5).alias("excess"))


EVENT_HOLDS = f"WITH {HOLDS} SELECT event_id, entity, quarter, days, round(ret, 5) + 0.0 AS ret, round(ret - others, 5) + 0.0 AS excess FROM holds"


def event_periods(spark: SparkSession, sf: str) -> DataFrame:
    """Per quarter of entry: holds, mean days, mean return, and its t."""
    h = _holds(spark, sf).withColumn("r", rounded(F.col("ret"), 6))
    return h.groupBy("quarter").agg(F.count("*").alias("n"), rounded(F.avg("days"), 3).alias("days"), rounded(exact_sum(F.col("r")) / F.count("r"), 5).alias("ret"), rounded(t_stat(F.col("r")), 3).alias("t"))


EVENT_PERIODS = f"""WITH {HOLDS} SELECT quarter, count(*) AS n, round(avg(days), 3) + 0.0 AS days, round(CAST(sum(CAST(r AS DECIMAL(24,6))) AS DOUBLE) / count(r), 5) + 0.0 AS ret,
  CASE WHEN count(r) >= 3 AND stddev_samp(r) > 0 THEN round(avg(r) / (stddev_samp(r) / sqrt(count(r))), 3) + 0.0 END AS t FROM (SELECT *, round(ret, 6) + 0.0 AS r FROM holds) GROUP BY 1"""


def event_summary(spark: SparkSession, sf: str) -> DataFrame:
    """How many quarters had entries that rose, and the mean of the quarters' means."""
    p = event_periods(spark, sf)
    return p.agg(F.count("*").alias("n_periods"), F.count_if(F.col("ret") > 0).alias("n_up"), F.sum("n").alias("n"), rounded(exact_sum(F.col("ret")) / F.count("ret"), 5).alias("ret"))


EVENT_SUMMARY = f"SELECT count(*) AS n_periods, count(*) FILTER (WHERE ret > 0) AS n_up, CAST(sum(n) AS BIGINT) AS n, round(CAST(sum(CAST(ret AS DECIMAL(24,6))) AS DOUBLE) / count(ret), 5) + 0.0 AS ret FROM ({EVENT_PERIODS})"

#: Scores by name: which inputs are ranked, and the one whose linear effect is taken out first.
SCORES = {
    "stress": ["sh_stress"],
    "stress_mark": ["sh_stress", "book_mark"],
    "plus_pik": ["sh_stress", "sh_on_pik"],
    "plus_below": ["sh_stress", "sh_below_95"],
    "plus_drift": ["sh_stress", "mark_drift"],
}
#: (variant, score, least size, whether dollars follow the score).
VARIANTS = [
    ("base", "stress", 0, False), ("floor_1", "stress", 20_000, False), ("floor_2", "stress", 50_000, False), ("floor_3", "stress", 100_000, False), ("with_mark", "stress_mark", 0, False),
    ("conviction", "stress", 0, True), ("plus_pik", "plus_pik", 0, False), ("plus_below", "plus_below", 0, False), ("plus_drift", "plus_drift", 0, False), ("combined", "plus_pik", 20_000, True),
]


def _borrow(size: Column) -> Column:
    out = F.lit(BORROW[-1][1])
    for cap, rate in reversed(BORROW[:-1]):
        out = F.when(size < cap, rate).otherwise(out)
    return out


def strategy_lab(spark: SparkSession, sf: str) -> DataFrame:
    """Ten variants of the book per period: gross, costs of trading and borrowing, net, and turnover of both sides.

    A score is the mean percent rank of its inputs within the period; the low fifth is held, the high
    fifth sold. Variants are a small table that meets every lender-quarter once.
    """
    b = _forward(spark, sf).filter("fwd IS NOT NULL")
    period = Window.partitionBy("period")
    inputs = sorted({i for names in SCORES.values() for i in names})
    b = b.withColumns({f"_r_{i}": F.when(F.col(i).isNotNull(), rounded(F.percent_rank().over(period.orderBy(F.col(i).asc_nulls_last())), 6)) for i in inputs})
    score = {name: rounded(sum(F.col(f"_r_{i}") for i in names) / len(names), 6) for name, names in SCORES.items()}
    each = [F.struct(F.lit(v).alias("variant"), F.lit(float(floor)).alias("floor"), F.lit(conviction).alias("conviction"), score[s].alias("score")) for v, s, floor, conviction in VARIANTS]
    b = b.select("lender", "period", "cost", "fwd", F.explode(F.array(*each)).alias("v")).select("lender", "period", "cost", "fwd", "v.*").filter((F.col("cost") >= F.col("floor")) & F.col("score").isNotNull())
    of = Window.partitionBy("variant", "period")
    b = b.withColumns({"n": F.count("*").over(of), "at": F.row_number().over(of.orderBy("score", "lender"))}).filter("n >= 12").withColumn("k", F.greatest(F.lit(2), F.floor(F.col("n") / 5)))
    middle = F.max(F.when(F.col("at") == F.floor(F.col("n") / 2) + 1, F.col("score"))).over(of)
    side = F.when(F.col("at") <= F.col("k"), 1).when(F.col("at") > F.col("n") - F.col("k"), -1)
    b = b.withColumns({"side": side, "w": F.when(F.col("conviction"), F.abs(F.col("score") - middle) + 1e-6).otherwise(1.0)}).filter("side IS NOT NULL")
    mean = lambda value, s: ratio(exact_sum(F.when(F.col("side") == s, value * F.col("w"))), exact_sum(F.when(F.col("side") == s, F.col("w"))))
    names = lambda s: F.collect_set(F.when(F.col("side") == s, F.col("lender")))
    p = b.groupBy("variant", "period").agg(F.max("n").alias("n"), F.max("k").cast("bigint").alias("k"), mean(F.col("fwd"), 1).alias("long"), mean(F.col("fwd"), -1).alias("short"), (mean(_borrow(F.col("cost")), -1) * 91 / 365).alias("borrow"), names(1).alias("l"), names(-1).alias("s"))
    w = Window.partitionBy("variant").orderBy("period")
    fresh = lambda c: 1 - F.size(F.array_intersect(c, F.lag(c).over(w))) / F.col("k")
    p = p.withColumn("turnover", F.when(F.lag("period").over(w).isNotNull(), 0.5 * (fresh("l") + fresh("s"))))
    gross = F.col("long") - F.col("short")
    return p.select("variant", "period", "n", "k", rounded(gross, 5).alias("gross"), rounded(F.col("borrow"), 5).alias("borrow"), rounded(gross - 2 * ROUND_TRIP - F.col("borrow"), 5).alias("net"), rounded(F.col("turnover"), 5).alias("turnover"))


def _mean_sql(value: str, side: int) -> str:
    return f"CAST(sum(CAST({value} * w AS DECIMAL(24,6))) FILTER (WHERE side = {side}) AS DOUBLE) / nullif(CAST(sum(CAST(w AS DECIMAL(24,6))) FILTER (WHERE side = {side}) AS DOUBLE), 0)"


_INPUTS = sorted({i for names in SCORES.values() for i in names})
_BORROW_SQL = "CASE " + " ".join(f"WHEN cost < {cap} THEN {rate}::DOUBLE" for cap, rate in BORROW[:-1]) + f" ELSE {BORROW[-1][1]}::DOUBLE END"
_SCORE_SQL = {name: f"round(({' + '.join(f'r_{i}' for i in names)}) / {len(names)}, 6)" for name, names in SCORES.items()}
STRATEGY_LAB = f"""WITH {FORWARD}, r AS (SELECT *, {", ".join(f"CASE WHEN {i} IS NOT NULL THEN round(percent_rank() OVER (PARTITION BY period ORDER BY {i} NULLS LAST), 6) END AS r_{i}" for i in _INPUTS)} FROM fwd WHERE fwd IS NOT NULL),
v AS ({" UNION ALL ".join(f"SELECT lender, period, cost, fwd, '{v}' AS variant, {str(c).lower()} AS conviction, {_SCORE_SQL[s]} AS score FROM r WHERE cost >= {f}" for v, s, f, c in VARIANTS)}),
a AS (SELECT *, count(*) OVER g AS n, row_number() OVER (PARTITION BY variant, period ORDER BY score, lender) AS pos FROM v WHERE score IS NOT NULL WINDOW g AS (PARTITION BY variant, period)),
b AS (SELECT *, greatest(2, n // 5) AS k, CASE WHEN pos <= greatest(2, n // 5) THEN 1 WHEN pos > n - greatest(2, n // 5) THEN -1 END AS side, max(score) FILTER (WHERE pos = n // 2 + 1) OVER (PARTITION BY variant, period) AS middle FROM a WHERE n >= 12),
c AS (SELECT *, CASE WHEN conviction THEN abs(score - middle) + 1e-6::DOUBLE ELSE 1.0::DOUBLE END AS w FROM b WHERE side IS NOT NULL),
p AS (SELECT variant, period, max(n) AS n, max(k) AS k, {_mean_sql("fwd", 1)} AS long, {_mean_sql("fwd", -1)} AS short, {_mean_sql(f"({_BORROW_SQL})", -1)} * 91 / 365 AS borrow, list(lender) FILTER (WHERE side = 1) AS l, list(lender) FILTER (WHERE side = -1) AS s FROM c GROUP BY 1, 2),
q AS (SELECT *, lag(l) OVER w AS l0, lag(s) OVER w AS s0 FROM p WINDOW w AS (PARTITION BY variant ORDER BY period))
SELECT variant, period, n, k, round(long - short, 5) + 0.0 AS gross, round(borrow, 5) + 0.0 AS borrow, round(long - short - {2 * ROUND_TRIP}::DOUBLE - borrow, 5) + 0.0 AS net,
  CASE WHEN l0 IS NOT NULL THEN round(0.5 * (1 - len(list_intersect(l, l0)) / k + 1 - len(list_intersect(s, s0)) / k), 5) + 0.0 END AS turnover FROM q"""

#: (reason, test) of the lenders' watch list, in the order in which they are told.
REASONS = [
    ("book deteriorating over 4 quarters", "trend_pct >= 0.8"), ("more stress than most", "stress_pct >= 0.8"), ("marked richer than most", "mark_pct >= 0.8"), ("marked cheaper than most", "mark_pct <= 0.2"),
    ("marks above other lenders", "generosity > 0.02"), ("marks below other lenders", "generosity < -0.02"), ("little of the book has a second opinion", "no_second > 0.9"), ("clean, stable book", "stress_pct <= 0.2 AND trend_pct <= 0.5"),
]
_SIDE = "CASE WHEN quadrant = 'short_candidate' THEN 'short' WHEN quadrant = 'long_candidate' THEN 'long' WHEN short_score >= 2.2 THEN 'short' WHEN short_score <= 0.6 THEN 'long' END"


def watchlist_lenders(spark: SparkSession, sf: str) -> DataFrame:
    """Lenders with a side to take and the reasons for it."""
    j = screen_quadrant(spark, sf).join(stale_generosity(spark, sf), ["lender", "period"], "left")
    reasons = F.concat_ws("; ", *(F.when(F.expr(test), F.lit(name)) for name, test in REASONS))
    return j.select("lender", "period", "quadrant", F.expr(_SIDE).alias("side"), reasons.alias("reasons")).filter("side IS NOT NULL")


WATCHLIST_LENDERS = f"""SELECT * FROM (SELECT lender, period, quadrant, {_SIDE} AS side, concat_ws('; ', {", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in REASONS)}) AS reasons
FROM ({SCREEN_QUADRANT}) LEFT JOIN ({STALE_GENEROSITY}) USING (lender, period)) WHERE side IS NOT NULL"""

QUERIES = {"event_holds": event_holds, "event_periods": event_periods, "event_summary": event_summary, "strategy_lab": strategy_lab, "watchlist_lenders": watchlist_lenders}
SQL = {"event_holds": EVENT_HOLDS, "event_periods": EVENT_PERIODS, "event_summary": EVENT_SUMMARY, "strategy_lab": STRATEGY_LAB, "watchlist_lenders": WATCHLIST_LENDERS}
