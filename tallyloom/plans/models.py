"""Risk model, rank tests, composites and strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.agg import exact_sum, ratio, rounded, weighted_mean
from ..operators.models import fit_lifts, scored, unpivoted, walk_forward
from ..operators.window import fifths, mid_percentile, spearman, t_stat, zscore
from .binding import holdings
from .signals import LENDER_QUARTERS, LOAN_QUARTERS, lender_quarters, loan_quarters, loan_summary, with_ends

BAD_DAYS = 380
FEATURES = {"f_soft": "mark < 0.97", "f_weak": "mark < 0.95", "f_drop": "mark_chg1 < -0.02", "f_drop2": "mark_chg2 < -0.03", "f_pik": "pik", "f_new_pik": "new_pik", "f_spread": "spread_up", "f_extended": "maturity_extended", "f_new": "is_new"}
BAD = "(nonaccrual AND mark < 0.95)"


def loan_features(spark: SparkSession, sf: str, dealt: bool = True) -> DataFrame:
    """Loan-quarters with features and whether they turn bad within ``BAD_DAYS``.

    Null if already bad, or if the window is not over and nothing happened yet. What comes later is
    found by windows over the loan and its lender, so the holdings are computed and dealt once.
    """
    lq = loan_quarters(holdings(spark, sf, dealt)).withColumns({n: F.coalesce(F.expr(e), F.lit(False)) for n, e in FEATURES.items()}).withColumn("bad", F.expr(BAD))
    ahead = Window.partitionBy("lender", "borrower").orderBy(F.unix_date("period")).rangeBetween(1, BAD_DAYS)
    j = with_ends(lq).withColumn("bad_later", F.bool_or("bad").over(ahead))
    lost = (F.col("last_mark") < 0.9) & (F.col("last_period") < F.col("top")) & (F.col("last_period") > F.col("period")) & (F.datediff("last_period", "period") <= BAD_DAYS)
    happened = F.coalesce("bad_later", F.lit(False)) | F.coalesce(lost, F.lit(False))
    label = F.when(F.col("bad"), None).when(~happened & (F.datediff("top", "period") < BAD_DAYS), None).otherwise(happened)
    return j.select("lender", "borrower", "period", "cost", "mark", "bad", *FEATURES, label.alias("bad_4q"))


LOAN_FEATURES = LOAN_QUARTERS + f""", lf AS (SELECT *, {BAD} AS bad, {", ".join(f"coalesce({e}, false) AS {n}" for n, e in FEATURES.items())} FROM loan_quarters),
later AS (SELECT DISTINCT a.lender, a.borrower, a.period FROM lf a JOIN lf b ON a.lender = b.lender AND a.borrower = b.borrower AND date_diff('day', a.period, b.period) BETWEEN 1 AND {BAD_DAYS} WHERE b.bad),
ends AS (SELECT lender, borrower, max(period) AS last_period, max(top) AS top, max(period) < max(top) AND arg_max(mark, period) < 0.9 AS lost FROM lf JOIN (SELECT lender, max(period) AS top FROM lf GROUP BY 1) USING (lender) GROUP BY 1, 2),
loan_features AS (SELECT lender, borrower, period, cost, mark, bad, {", ".join(FEATURES)},
  CASE WHEN bad THEN NULL WHEN NOT happened AND date_diff('day', period, top) < {BAD_DAYS} THEN NULL ELSE happened END AS bad_4q
  FROM (SELECT lf.*, top, later.lender IS NOT NULL OR (lost AND last_period > lf.period AND date_diff('day', lf.period, last_period) <= {BAD_DAYS}) AS happened
    FROM lf LEFT JOIN later USING (lender, borrower, period) JOIN ends USING (lender, borrower)))"""


def forward_label(spark: SparkSession, sf: str) -> DataFrame:
    return loan_features(spark, sf).groupBy("lender", "period").agg(F.count("*").alias("n"), F.count("bad_4q").alias("n_known"), F.count_if("bad_4q").alias("n_bad"))


FORWARD_LABEL = f"WITH {LOAN_FEATURES} SELECT lender, period, count(*) AS n, count(bad_4q) AS n_known, count(*) FILTER (WHERE bad_4q) AS n_bad FROM loan_features GROUP BY 1, 2"


def lift_fit(spark: SparkSession, sf: str) -> DataFrame:
    f = fit_lifts(loan_features(spark, sf), list(FEATURES), "bad_4q")
    return f.select("feature", "n", "n_bad", *(rounded(F.col(c)).alias(c) for c in ("base", "hit", "w")))


_UNPIVOT = " UNION ALL ".join(f"SELECT lender, period, '{f}' AS feature, {f} AS fires, bad_4q FROM loan_features WHERE bad_4q IS NOT NULL" for f in FEATURES)
LIFTS = LOAN_FEATURES + f""", lifts AS (SELECT feature, n, n_bad, base, hit, greatest(0.0, least(3.0, CASE WHEN n >= 30 AND hit > 0 AND base > 0 THEN ln(hit / base) ELSE 0.0 END)) AS w FROM (
  SELECT feature, count(*) FILTER (WHERE fires) AS n, count(*) FILTER (WHERE fires AND bad_4q) AS n_bad, count(*) FILTER (WHERE bad_4q) / count(*) AS base,
    count(*) FILTER (WHERE fires AND bad_4q) / nullif(count(*) FILTER (WHERE fires), 0) AS hit FROM ({_UNPIVOT}) GROUP BY 1))"""
LIFT_FIT = f"WITH {LIFTS} SELECT feature, n, n_bad, round(base, 6) + 0.0 AS base, round(hit, 6) + 0.0 AS hit, round(w, 6) + 0.0 AS w FROM lifts"


def risk_score(spark: SparkSession, sf: str) -> DataFrame:
    rows = loan_features(spark, sf)
    s = scored(rows, fit_lifts(rows, list(FEATURES), "bad_4q"), list(FEATURES), "bad")
    return s.select("lender", "borrower", "period", rounded(F.col("score"), 4).alias("score"), F.array_join("reasons", ",").alias("reasons"))


RISK = LIFTS + f""", w AS (SELECT max(base) AS base, {", ".join(f"max(w) FILTER (WHERE feature = '{f}') AS w_{f}" for f in FEATURES)} FROM lifts),
risk AS (SELECT lf.*, CASE WHEN bad THEN 100.0 ELSE 100.0 / (1 + exp(-(ln(base / (1 - base)) + {" + ".join(f"CASE WHEN {f} THEN w_{f} ELSE 0.0 END" for f in FEATURES)}))) END AS score,
  array_to_string([x.f for x in list_sort(list_filter([{", ".join(f"{{'o': -w_{f}, 'f': '{f}', 'v': {f}}}" for f in FEATURES)}], lambda x: x.v AND x.o < 0))], ',') AS reasons FROM loan_features lf CROSS JOIN w)"""
RISK_SCORE = f"WITH {RISK} SELECT lender, borrower, period, round(score, 4) + 0.0 AS score, reasons FROM risk"


def wf_lift_fit(spark: SparkSession, sf: str) -> DataFrame:
    """The model refitted each quarter on rows whose window was over by then.

    Sums per period come first; what is known at a date is then a running sum over periods.
    """
    known = loan_features(spark, sf).filter("bad_4q IS NOT NULL")
    long = unpivoted(known.select("period", F.col("bad_4q").cast("int").alias("y"), *FEATURES), ["period", "y"], list(FEATURES))
    sums = long.groupBy("feature", "period").agg(F.count("*").alias("a"), F.sum("y").alias("b"), F.count_if("fires").alias("c"), F.coalesce(F.sum(F.when(F.col("fires"), F.col("y"))), F.lit(0)).alias("d"))
    upto = Window.partitionBy("feature").orderBy(F.unix_date("period")).rangeBetween(Window.unboundedPreceding, -BAD_DAYS)
    run = sums.select("feature", "period", *(F.sum(c).over(upto).alias(c) for c in "abcd")).filter("a >= 500")
    hit, base = F.col("d") / F.nullif(F.col("c"), F.lit(0)), F.col("b") / F.col("a")
    w = F.when((F.col("c") >= 30) & (hit > 0) & (base > 0), F.greatest(F.lit(0.0), F.least(F.lit(3.0), F.log(hit / base)))).otherwise(0.0)
    return run.select("feature", "period", F.col("a").alias("n_fit"), rounded(w).alias("w"))


WF_LIFT_FIT = f"""WITH {LOAN_FEATURES}, long AS ({_UNPIVOT}), q AS (SELECT DISTINCT period FROM long),
f AS (SELECT feature, q.period, count(*) AS a, count(*) FILTER (WHERE bad_4q) AS b, count(*) FILTER (WHERE fires) AS c, count(*) FILTER (WHERE fires AND bad_4q) AS d FROM q JOIN long ON date_diff('day', long.period, q.period) >= {BAD_DAYS} GROUP BY 1, 2)
SELECT feature, period, a AS n_fit, round(CASE WHEN c >= 30 AND d > 0 AND b > 0 THEN greatest(0.0, least(3.0, ln((d / c) / (b / a)))) ELSE 0.0 END, 6) + 0.0 AS w FROM f WHERE a >= 500"""

SIGNALS = ["book_mark", "sh_below_95", "sh_stress", "sh_on_pik", "mark_drift"]


def _forward(spark: SparkSession, sf: str) -> DataFrame:
    """Lender-quarters with their signals and the next period's growth of the book."""
    b = lender_quarters(loan_quarters(holdings(spark, sf, dealt=True)))
    nxt = F.lead("cost").over(Window.partitionBy("lender").orderBy("period"))
    return b.select("lender", "period", *SIGNALS, "cost", (ratio(nxt, F.col("cost")) - 1).alias("fwd"))


FORWARD = LENDER_QUARTERS + f""", fwd AS (SELECT lender, period, {", ".join(SIGNALS)}, cost, lead(cost) OVER (PARTITION BY lender ORDER BY period) / nullif(cost, 0) - 1 AS fwd FROM lender_quarters),
long AS ({" UNION ALL ".join(f"SELECT lender, period, '{s}' AS signal, {s} AS x, fwd AS y FROM fwd" for s in SIGNALS)})"""


def _long(spark: SparkSession, sf: str) -> DataFrame:
    return unpivoted(_forward(spark, sf), ["lender", "period", "fwd"], SIGNALS, "signal", "x")


_RANKED = """pairs AS (SELECT * FROM long WHERE x IS NOT NULL AND y IS NOT NULL),
ranked AS (SELECT signal, period, rank() OVER (PARTITION BY signal, period ORDER BY x) + (count(*) OVER (PARTITION BY signal, period, x) - 1) / 2.0::DOUBLE AS rx,
  rank() OVER (PARTITION BY signal, period ORDER BY y) + (count(*) OVER (PARTITION BY signal, period, y) - 1) / 2.0::DOUBLE AS ry FROM pairs),
ics AS (SELECT signal, period, count(*) AS n, CASE WHEN count(*) >= 6 AND count(DISTINCT rx) > 1 AND count(DISTINCT ry) > 1 THEN corr(rx, ry) END AS ic FROM ranked GROUP BY 1, 2)"""


def spearman_ic(spark: SparkSession, sf: str) -> DataFrame:
    """Rank correlation of each signal with the outcome, per period."""
    ic = spearman(_long(spark, sf), "x", "fwd", ["signal", "period"])
    return ic.select("signal", "period", "n", rounded(F.col("ic")).alias("ic"))


SPEARMAN_IC = f"WITH {FORWARD}, {_RANKED} SELECT signal, period, n, round(ic, 6) + 0.0 AS ic FROM ics"


def ic_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Mean, t-statistic and hit rate of the ICs of each signal."""
    ic = spearman(_long(spark, sf), "x", "fwd", ["signal", "period"])
    return ic.groupBy("signal").agg(F.count("ic").alias("n_periods"), rounded(F.avg("ic")).alias("mean_ic"), rounded(t_stat(F.col("ic")), 4).alias("t"), rounded(F.avg((F.col("ic") > 0).cast("double"))).alias("hit_rate"))


IC_SUMMARY = f"""WITH {FORWARD}, {_RANKED} SELECT signal, count(ic) AS n_periods, round(avg(ic), 6) + 0.0 AS mean_ic,
  round(CASE WHEN count(ic) >= 3 AND stddev_samp(ic) > 0 THEN avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) END, 4) + 0.0 AS t, round(avg(CAST(ic > 0 AS INT)), 6) + 0.0 AS hit_rate FROM ics GROUP BY 1"""


def quintile_spread(spark: SparkSession, sf: str) -> DataFrame:
    q = fifths(_long(spark, sf), "x", "fwd", ["signal", "period"])
    return q.select("signal", "period", "n", "k", rounded(F.col("spread")).alias("spread"))


QUINTILE_SPREAD = f"""WITH {FORWARD}, p AS (SELECT signal, period, y, row_number() OVER (PARTITION BY signal, period ORDER BY x, y) AS up, count(*) OVER (PARTITION BY signal, period) AS n FROM long WHERE x IS NOT NULL AND y IS NOT NULL),
k AS (SELECT *, greatest(2, n // 5) AS k FROM p)
SELECT signal, period, max(n) AS n, max(k) AS k, round((CAST(sum(CAST(y AS DECIMAL(24,9))) FILTER (WHERE up > n - k) AS DOUBLE) - CAST(sum(CAST(y AS DECIMAL(24,9))) FILTER (WHERE up <= k) AS DOUBLE)) / max(k), 6) + 0.0 AS spread FROM k GROUP BY 1, 2 HAVING max(n) >= 12"""


def walk_forward_composite(spark: SparkSession, sf: str) -> DataFrame:
    """Composite of z-scores weighted by what the signals' ICs were before each period."""
    long = _long(spark, sf)
    ics = spearman(long, "x", "fwd", ["signal", "period"])
    zs = long.select(F.col("lender").alias("name"), "period", "signal", zscore("x", ["signal", "period"], least=3).alias("z"))
    return walk_forward(zs, ics, "period").select(F.col("name").alias("lender"), "period", "n_signals", rounded(F.col("score"), 5).alias("score"))


WALK_FORWARD_COMPOSITE = f"""WITH {FORWARD}, {_RANKED},
w AS (SELECT signal, period, avg(ic) OVER b AS w, count(ic) OVER b AS n FROM ics WINDOW b AS (PARTITION BY signal ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
z AS (SELECT lender, period, signal, CASE WHEN count(x) OVER g >= 3 AND stddev_samp(x) OVER g > 0 THEN greatest(-3.0, least(3.0, (x - avg(x) OVER g) / stddev_samp(x) OVER g)) END AS z FROM long WINDOW g AS (PARTITION BY signal, period))
SELECT lender, period, count(*) AS n_signals, round(sum(w * z) / nullif(sum(abs(w)), 0), 5) + 0.0 AS score FROM z JOIN w USING (signal, period) WHERE n >= 4 AND abs(w) >= 0.03 AND z IS NOT NULL GROUP BY 1, 2"""


def peer_percentile_live(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of each signal among the period's lenders and their mean, if two exist."""
    b = _forward(spark, sf)
    ps = {f"p_{s}": mid_percentile(s, ["period"]) for s in SIGNALS}
    b = b.select("lender", "period", *(p.alias(n) for n, p in ps.items()))
    there = sum(F.col(n).isNotNull().cast("int") for n in ps)
    health = F.when(there >= 2, sum(F.coalesce(F.col(n), F.lit(0.0)) for n in ps) / there)
    return b.select("lender", "period", *(rounded(F.col(n)).alias(n) for n in ps), rounded(health).alias("health"))


PEER_PERCENTILE_LIVE = f"""WITH {FORWARD}, p AS (SELECT lender, period, {", ".join(f"CASE WHEN {s} IS NOT NULL AND count({s}) OVER q > 1 THEN (rank() OVER (PARTITION BY period ORDER BY {s} NULLS LAST) - 1 + 0.5::DOUBLE * (count(*) OVER (PARTITION BY period, {s}) - 1)) / (count({s}) OVER q - 1) END AS p_{s}" for s in SIGNALS)} FROM fwd WINDOW q AS (PARTITION BY period))
SELECT lender, period, {", ".join(f"round(p_{s}, 6) + 0.0 AS p_{s}" for s in SIGNALS)}, CASE WHEN {" + ".join(f"(p_{s} IS NOT NULL)::INT" for s in SIGNALS)} >= 2 THEN round(({" + ".join(f"coalesce(p_{s}, 0)" for s in SIGNALS)}) / ({" + ".join(f"(p_{s} IS NOT NULL)::INT" for s in SIGNALS)}), 6) + 0.0 END AS health FROM p"""


def peer_percentile_event(spark: SparkSession, sf: str) -> DataFrame:
    """For each book the share of other lenders' last earlier marks (at most 200 days old) below it.

    A mark stands for the quarter ends after it, up to its lender's next one. So each lender has one
    standing mark a period at most, and books are counted among these in one sort of the period;
    the lender's own earlier mark is taken out again.
    """
    b = lender_quarters(loan_quarters(holdings(spark, sf, dealt=True))).select("lender", "period", F.col("book_mark").alias("mark"))
    following = F.lead("period").over(Window.partitionBy("lender").orderBy("period"))
    ends = F.array(*(F.last_day(F.add_months("period", 3 * i)) for i in (1, 2)))
    stands = b.withColumn("until", following).select("lender", "mark", "period", "until", F.explode(ends).alias("at"))
    stands = stands.filter((F.date_diff("at", "period") <= 200) & F.coalesce(F.col("at") <= F.col("until"), F.lit(True)))
    books = b.join(stands.select("lender", F.col("at").alias("period"), F.struct("mark").alias("before")), ["lender", "period"], "left")
    both = books.withColumn("peer", F.lit(0)).unionByName(stands.select(F.col("at").alias("period"), "mark", F.lit(1).alias("peer")), allowMissingColumns=True)
    period, standing = Window.partitionBy("period"), F.when(F.col("mark").isNotNull(), F.col("peer"))
    upto = F.coalesce(F.sum(standing).over(period.orderBy("mark").rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))
    ties = F.coalesce(F.sum(standing).over(Window.partitionBy("period", "mark")), F.lit(0))
    counted = both.select("*", F.sum("peer").over(period).alias("n"), ties.alias("ties"), (upto - ties).alias("less")).filter("peer = 0")
    own = F.col("before.mark")
    below = F.col("less") - (own < F.col("mark")).cast("int") + 0.5 * (F.col("ties") - (own == F.col("mark")).cast("int"))
    below = F.when(own.isNull() | F.col("mark").isNull(), F.col("less") + 0.5 * F.col("ties")).otherwise(below)
    n = F.col("n") - F.col("before").isNotNull().cast("int")
    return counted.select("lender", "period", n.alias("n_peers"), below.alias("below")).filter("n_peers > 0").select("lender", "period", "n_peers", rounded(F.col("below") / F.col("n_peers")).alias("pctl"))


PEER_PERCENTILE_EVENT = f"""WITH {LENDER_QUARTERS}, l AS (SELECT a.lender, a.period, b.lender AS other, max(a.book_mark) AS own, arg_max(b.book_mark, b.period) AS theirs FROM lender_quarters a JOIN lender_quarters b ON a.lender <> b.lender AND date_diff('day', a.period, b.period) BETWEEN -200 AND -1 GROUP BY 1, 2, 3)
SELECT lender, period, count(*) AS n_peers, round(avg(CASE WHEN theirs < own THEN 1.0::DOUBLE WHEN theirs = own THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END), 6) + 0.0 AS pctl FROM l GROUP BY 1, 2"""


def ols_residual(spark: SparkSession, sf: str) -> DataFrame:
    """What of the stress share the book mark does not explain, per period."""
    b = _forward(spark, sf).filter("book_mark IS NOT NULL AND sh_stress IS NOT NULL")
    fit = b.groupBy("period").agg(F.count("*").alias("n"), F.when(F.var_pop("book_mark") > 0, F.covar_pop("sh_stress", "book_mark") / F.var_pop("book_mark")).alias("slope"), F.avg("sh_stress").alias("my"), F.avg("book_mark").alias("mx")).filter("n >= 8")
    return b.join(fit, "period").select("lender", "period", "n", rounded(F.col("sh_stress") - F.col("my") - F.col("slope") * (F.col("book_mark") - F.col("mx")), 5).alias("residual"))


OLS_RESIDUAL = f"""WITH {FORWARD}, f AS (SELECT period, count(*) AS n, regr_slope(sh_stress, book_mark) AS slope, avg(sh_stress) AS my, avg(book_mark) AS mx FROM fwd GROUP BY 1 HAVING count(*) >= 8)
SELECT lender, period, n, round(sh_stress - my - slope * (book_mark - mx), 5) + 0.0 AS residual FROM fwd JOIN f USING (period)"""


def validated(spark: SparkSession, sf: str) -> DataFrame:
    """Components weighted by how well they ranked lower growth; zero for those that did not."""
    long = _long(spark, sf)
    ic = spearman(long.withColumn("all", F.lit(1)), "x", "fwd", ["signal", "all"], least=30)
    w = ic.select("signal", F.greatest(F.lit(0.0), -F.col("ic")).alias("w"))
    zs = long.select("lender", "period", "signal", zscore("x", ["signal", "period"]).alias("z"))
    return zs.join(w, "signal").filter("z IS NOT NULL").groupBy("lender", "period").agg(rounded(ratio(F.sum(F.col("w") * F.col("z")), F.sum("w")), 5).alias("validated"))


BDC_VALIDATED = f"""WITH {FORWARD}, pairs AS (SELECT * FROM long WHERE x IS NOT NULL AND y IS NOT NULL),
r AS (SELECT signal, rank() OVER (PARTITION BY signal ORDER BY x) + (count(*) OVER (PARTITION BY signal, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY signal ORDER BY y) + (count(*) OVER (PARTITION BY signal, y) - 1) / 2.0::DOUBLE AS ry FROM pairs),
w AS (SELECT signal, greatest(0.0, -corr(rx, ry)) AS w FROM r GROUP BY 1),
z AS (SELECT lender, period, signal, CASE WHEN stddev_samp(x) OVER g > 0 THEN greatest(-3.0, least(3.0, (x - avg(x) OVER g) / stddev_samp(x) OVER g)) END AS z FROM long WINDOW g AS (PARTITION BY signal, period))
SELECT lender, period, round(sum(w * z) / nullif(sum(w), 0), 5) + 0.0 AS validated FROM z JOIN w USING (signal) WHERE z IS NOT NULL GROUP BY 1, 2"""


def _book(b: DataFrame) -> DataFrame:
    """Long the top fifth and short the bottom fifth of a period by stress share."""
    w = Window.partitionBy("period")
    b = b.filter("sh_stress IS NOT NULL AND fwd IS NOT NULL").withColumn("n", F.count("*").over(w)).withColumn("k", F.greatest(F.lit(2), F.floor(F.col("n") / 5)))
    b = b.withColumn("up", F.row_number().over(w.orderBy("sh_stress", "lender"))).filter("n >= 12")
    side = F.when(F.col("up") <= F.col("k"), 1).when(F.col("up") > F.col("n") - F.col("k"), -1)
    return b.withColumn("side", side).filter("side IS NOT NULL")


BOOK = FORWARD + """, ranked AS (SELECT *, count(*) OVER (PARTITION BY period) AS n, row_number() OVER (PARTITION BY period ORDER BY sh_stress, lender) AS up FROM fwd WHERE sh_stress IS NOT NULL AND fwd IS NOT NULL),
picks AS (SELECT *, CASE WHEN up <= greatest(2, n // 5) THEN 1 ELSE -1 END AS side FROM ranked WHERE n >= 12 AND (up <= greatest(2, n // 5) OR up > n - greatest(2, n // 5)))"""


def strategy_book(spark: SparkSession, sf: str) -> DataFrame:
    return _book(_forward(spark, sf)).select("lender", "period", "side", rounded(F.col("fwd"), 5).alias("fwd"))


STRATEGY_BOOK = f"WITH {BOOK} SELECT lender, period, side, round(fwd, 5) + 0.0 AS fwd FROM picks"

VARIANTS = [("base", 0.0, "equal"), ("large", 100000.0, "equal"), ("conviction", 0.0, "stress"), ("large_conviction", 100000.0, "stress")]
COST = 0.004


def strategy_variants(spark: SparkSession, sf: str) -> DataFrame:
    """The book under floors on size and ways to weigh, net of costs; variants are a small table."""
    v = F.explode(F.array(*(F.struct(F.lit(n).alias("variant"), F.lit(f).alias("floor"), F.lit(w).alias("weigh")) for n, f, w in VARIANTS))).alias("v")
    b = _book(_forward(spark, sf)).select("*", v).filter(F.col("cost") >= F.col("v.floor"))
    w = F.when(F.col("v.weigh") == "equal", F.lit(1.0)).otherwise(F.abs("sh_stress") + 0.01)
    s = b.withColumn("w", w).groupBy(F.col("v.variant").alias("variant"), "period").agg(
        weighted_mean(F.col("fwd"), F.col("w"), F.col("side") == 1).alias("long"), weighted_mean(F.col("fwd"), F.col("w"), F.col("side") == -1).alias("short"), F.count("*").alias("n"))
    gross = F.col("long") - F.col("short")
    return s.select("variant", "period", "n", rounded(gross, 5).alias("gross"), rounded(gross - 2 * COST, 5).alias("net"))


_W = lambda side: f"CAST(sum(CAST(fwd * w AS DECIMAL(24,6))) FILTER (WHERE side = {side}) AS DOUBLE) / nullif(CAST(sum(CAST(w AS DECIMAL(24,6))) FILTER (WHERE side = {side}) AS DOUBLE), 0)"
STRATEGY_VARIANTS = f"""WITH {BOOK}, v(variant, floor, weigh) AS (VALUES {", ".join(f"('{n}', {f}::DOUBLE, '{w}')" for n, f, w in VARIANTS)}),
b AS (SELECT *, CASE WHEN weigh = 'equal' THEN 1.0::DOUBLE ELSE abs(sh_stress) + 0.01::DOUBLE END AS w FROM picks CROSS JOIN v WHERE cost >= floor)
SELECT variant, period, n, round(gross, 5) + 0.0 AS gross, round(gross - {2 * COST}::DOUBLE, 5) + 0.0 AS net FROM (SELECT variant, period, count(*) AS n, {_W(1)} - {_W(-1)} AS gross FROM b GROUP BY 1, 2)"""


def turnover(spark: SparkSession, sf: str) -> DataFrame:
    """Share of each side's names that were not in the book of the period before."""
    sets = _book(_forward(spark, sf)).groupBy("side", "period").agg(F.array_sort(F.collect_set("lender")).alias("names"))
    before = F.lag("names").over(Window.partitionBy("side").orderBy("period"))
    new = F.size(F.array_except("names", F.coalesce(before, F.array().cast("array<bigint>"))))
    return sets.select("side", "period", F.size("names").cast("bigint").alias("n"), rounded(new / F.size("names")).alias("turnover"))


TURNOVER = f"""WITH {BOOK}, s AS (SELECT side, period, list(DISTINCT lender) AS names FROM picks GROUP BY 1, 2), b AS (SELECT *, lag(names) OVER (PARTITION BY side ORDER BY period) AS before FROM s)
SELECT side, period, len(names) AS n, round(1 - len(list_intersect(names, coalesce(before, []))) / len(names), 6) + 0.0 AS turnover FROM b"""


def live_composite(spark: SparkSession, sf: str) -> DataFrame:
    """The newest z-scores weighted by the mean IC of all periods, with the three greatest drags."""
    long = _long(spark, sf)
    ic = spearman(long, "x", "fwd", ["signal", "period"]).groupBy("signal").agg(F.avg("ic").alias("w"))
    top = long.agg(F.max("period").alias("period"))
    z = long.join(top, "period", "left_semi").select("lender", "signal", zscore("x", ["signal", "period"]).alias("z")).filter("z IS NOT NULL")
    j = z.join(F.broadcast(ic), "signal").withColumn("c", rounded(F.col("w") * F.col("z")))  # one row a signal
    drags = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("c", "signal"))), 1, 3), lambda s: s["signal"])
    return j.groupBy("lender").agg(rounded(ratio(exact_sum(F.col("w") * F.col("z")), exact_sum(F.abs("w"))), 4).alias("score"), F.array_join(drags, ",").alias("drags"))


LIVE_COMPOSITE = f"""WITH {FORWARD}, {_RANKED}, w AS (SELECT signal, avg(ic) AS w FROM ics GROUP BY 1),
z AS (SELECT lender, signal, CASE WHEN stddev_samp(x) OVER g > 0 THEN greatest(-3.0, least(3.0, (x - avg(x) OVER g) / stddev_samp(x) OVER g)) END AS z FROM long WHERE period = (SELECT max(period) FROM long) WINDOW g AS (PARTITION BY signal)),
c AS (SELECT lender, signal, w, z, round(w * z, 6) + 0.0 AS c FROM z JOIN w USING (signal) WHERE z IS NOT NULL)
SELECT lender, round(CAST(sum(CAST(w * z AS DECIMAL(24,6))) AS DOUBLE) / nullif(CAST(sum(CAST(abs(w) AS DECIMAL(24,6))) AS DOUBLE), 0), 4) + 0.0 AS score, array_to_string(list_slice(list(signal ORDER BY c, signal), 1, 3), ',') AS drags FROM c GROUP BY 1"""


def lender_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    """Late and early marks, loss exits a year, over loans that went bad; gated by counts."""
    f = loan_features(spark, sf, dealt=True)
    s = loan_summary(holdings(spark, sf, dealt=True))
    rates = f.groupBy("lender").agg(F.count("*").alias("n"), F.count_if("bad_4q").alias("n_bad"), F.count_if(F.col("bad_4q") & (F.col("mark") >= 0.97)).alias("n_late"), F.count_if(F.col("bad_4q") & (F.col("f_drop") | F.col("f_weak"))).alias("n_early"))
    exits = s.groupBy("lender").agg(F.count_if("exited").alias("n_exits"), F.count_if(F.col("exit_type") == "loss").alias("n_loss"))
    part = lambda a, b, least: F.when(F.col(b) >= least, rounded(F.col(a) / F.col(b)))
    return rates.join(exits, "lender").select("lender", "n", "n_bad", part("n_late", "n_bad", 50).alias("late_rate"), part("n_early", "n_bad", 50).alias("early_rate"), part("n_loss", "n_exits", 5).alias("loss_rate"))


LENDER_SCORECARD = f"""WITH {LOAN_FEATURES}, r AS (SELECT lender, count(*) AS n, count(*) FILTER (WHERE bad_4q) AS n_bad, count(*) FILTER (WHERE bad_4q AND mark >= 0.97) AS n_late, count(*) FILTER (WHERE bad_4q AND (f_drop OR f_weak)) AS n_early FROM loan_features GROUP BY 1),
x AS (SELECT lender, count(*) FILTER (WHERE last_period < top) AS n_exits, count(*) FILTER (WHERE lost) AS n_loss FROM ends GROUP BY 1)
SELECT lender, n, n_bad, CASE WHEN n_bad >= 50 THEN round(n_late / n_bad, 6) + 0.0 END AS late_rate, CASE WHEN n_bad >= 50 THEN round(n_early / n_bad, 6) + 0.0 END AS early_rate, CASE WHEN n_exits >= 5 THEN round(n_loss / n_exits, 6) + 0.0 END AS loss_rate FROM r JOIN x USING (lender)"""


def watchlists(spark: SparkSession, sf: str) -> DataFrame:
    """Loans of the newest period under four heads, with what put them there."""
    lq = loan_quarters(holdings(spark, sf))
    now = lq.join(lq.agg(F.max("period").alias("period")), "period", "left_semi")
    heads = {"marked_down": "mark_chg1 < -0.05", "newly_bad": "new_nonaccrual", "distressed": "mark < 0.91", "extended": "maturity_extended AND pik"}
    out = None
    for name, test in heads.items():
        rows = now.filter(test).select(F.lit(name).alias("list"), "lender", "borrower", F.concat_ws("; ", F.when(F.col("nonaccrual"), "non-accrual"), F.when(F.col("pik"), "in kind"), F.when(F.col("mark") < 0.91, "low mark")).alias("reasons"))
        out = rows if out is None else out.unionByName(rows)
    return out


WATCHLISTS = f"""WITH {LOAN_QUARTERS}, now AS (SELECT * FROM loan_quarters WHERE period = (SELECT max(period) FROM loan_quarters)) """ + " UNION ALL ".join(
    f"SELECT '{n}' AS list, lender, borrower, concat_ws('; ', CASE WHEN nonaccrual THEN 'non-accrual' END, CASE WHEN pik THEN 'in kind' END, CASE WHEN mark < 0.91 THEN 'low mark' END) AS reasons FROM now WHERE {t}"
    for n, t in {"marked_down": "mark_chg1 < -0.05", "newly_bad": "new_nonaccrual", "distressed": "mark < 0.91", "extended": "maturity_extended AND pik"}.items()
)

QUERIES = {
    "forward_label": forward_label, "lift_fit": lift_fit, "risk_score": risk_score, "wf_lift_fit": wf_lift_fit, "spearman_ic": spearman_ic, "ic_summary": ic_summary, "quintile_spread": quintile_spread,
    "walk_forward_composite": walk_forward_composite, "peer_percentile_live": peer_percentile_live, "peer_percentile_event": peer_percentile_event, "ols_residual": ols_residual, "bdc_validated": validated,
    "strategy_book": strategy_book, "strategy_variants": strategy_variants, "turnover": turnover, "live_composite": live_composite, "lender_scorecard": lender_scorecard, "watchlists": watchlists,
}
SQL = {
    "forward_label": FORWARD_LABEL, "lift_fit": LIFT_FIT, "risk_score": RISK_SCORE, "wf_lift_fit": WF_LIFT_FIT, "spearman_ic": SPEARMAN_IC, "ic_summary": IC_SUMMARY, "quintile_spread": QUINTILE_SPREAD,
    "walk_forward_composite": WALK_FORWARD_COMPOSITE, "peer_percentile_live": PEER_PERCENTILE_LIVE, "peer_percentile_event": PEER_PERCENTILE_EVENT, "ols_residual": OLS_RESIDUAL, "bdc_validated": BDC_VALIDATED,
    "strategy_book": STRATEGY_BOOK, "strategy_variants": STRATEGY_VARIANTS, "turnover": TURNOVER, "live_composite": LIVE_COMPOSITE, "lender_scorecard": LENDER_SCORECARD, "watchlists": WATCHLISTS,
}
