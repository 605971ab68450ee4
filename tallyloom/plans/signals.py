"""Loan-quarter and lender-quarter signals over the holdings view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.agg import exact_sum, latest, leave_one_out, ratio, rounded, share, weighted_mean
from ..operators.window import offsets, zscore
from .binding import HOLDINGS, LENDERS, holdings, lenders

# Marks below which a holding is par, soft, weak, stressed or distressed.
BUCKETS = [(0.97, "a_par"), (0.95, "b_soft"), (0.93, "c_weak"), (0.91, "d_stressed")]


def bucket(mark: Column) -> Column:
    out = F.when(mark.isNull(), F.lit("none"))
    for least, name in BUCKETS:
        out = out.when(mark >= least, F.lit(name))
    return out.otherwise(F.lit("e_distressed"))


BUCKET_SQL = "CASE WHEN {0} IS NULL THEN 'none' " + " ".join(f"WHEN {{0}} >= {m} THEN '{n}'" for m, n in BUCKETS) + " ELSE 'e_distressed' END"


LAGS = {"mark": [1, 2, 3, 4], "fv": [1], "cost": [1], "nonaccrual": [1], "pik": [1], "rate": [1], "spread": [1], "maturity": [1], "period": [1]}


def loan_quarters(h: DataFrame) -> DataFrame:
    """Each holding with what changed since the loan's last observed period (one sort for all lags)."""
    lq = offsets(h, ["lender", "borrower"], "period", LAGS)
    before = F.coalesce("mark_lag1", F.lit(1.0))
    return lq.select(
        "lender", "borrower", "period", "itype", "sector", "cost", "fv", "mark", "nonaccrual", "pik", *(f"{c}_lag{n}" for c, ns in LAGS.items() for n in ns),
        bucket(F.col("mark")).alias("bucket"),
        bucket(F.col("mark_lag1")).alias("from_bucket"),
        (F.col("mark") - F.col("mark_lag1")).alias("mark_chg1"),
        (F.col("mark") - F.col("mark_lag2")).alias("mark_chg2"),
        (F.col("mark") - F.col("mark_lag4")).alias("mark_chg4"),
        ((F.col("mark") < 0.95) & (before >= 0.95)).alias("crossed_95"),
        ((F.col("mark") < 0.91) & (before >= 0.91)).alias("crossed_91"),
        (F.col("nonaccrual") & ~F.coalesce("nonaccrual_lag1", F.lit(False)) & F.col("period_lag1").isNotNull()).alias("new_nonaccrual"),
        (F.col("pik") & ~F.coalesce("pik_lag1", F.lit(False)) & F.col("period_lag1").isNotNull()).alias("new_pik"),
        (F.col("pik") & F.coalesce("pik_lag1", F.lit(False)) & F.coalesce(F.col("rate") > F.col("rate_lag1") + 0.0001, F.lit(False))).alias("pik_rate_up"),
        (F.col("spread") > F.col("spread_lag1") + 0.0001).alias("spread_up"),
        (F.datediff("maturity", "maturity_lag1") > 45).alias("maturity_extended"),
        F.col("period_lag1").isNull().alias("is_new"),
        (F.col("nonaccrual") | (F.col("mark") < 0.91)).alias("stressed"),
    )


LOAN_QUARTERS = HOLDINGS + f""", loan_quarters AS (
  SELECT lender, borrower, period, itype, sector, cost, fv, mark, nonaccrual, pik, m1 AS mark_lag1, m2 AS mark_lag2, m3 AS mark_lag3, m4 AS mark_lag4, f1 AS fv_lag1, c1 AS cost_lag1,
    n1 AS nonaccrual_lag1, k1 AS pik_lag1, r1 AS rate_lag1, s1 AS spread_lag1, t1 AS maturity_lag1, p1 AS period_lag1, pik AND coalesce(k1, false) AND coalesce(rate > r1 + 0.0001, false) AS pik_rate_up,
    {BUCKET_SQL.format("mark")} AS bucket, {BUCKET_SQL.format("m1")} AS from_bucket,
    mark - m1 AS mark_chg1, mark - m2 AS mark_chg2, mark - m4 AS mark_chg4,
    mark < 0.95 AND coalesce(m1, 1.0) >= 0.95 AS crossed_95, mark < 0.91 AND coalesce(m1, 1.0) >= 0.91 AS crossed_91,
    nonaccrual AND NOT coalesce(n1, false) AND p1 IS NOT NULL AS new_nonaccrual,
    pik AND NOT coalesce(k1, false) AND p1 IS NOT NULL AS new_pik,
    spread > s1 + 0.0001 AS spread_up, date_diff('day', t1, maturity) > 45 AS maturity_extended,
    p1 IS NULL AS is_new, nonaccrual OR mark < 0.91 AS stressed
  FROM (SELECT *, lag(mark) OVER w AS m1, lag(mark, 2) OVER w AS m2, lag(mark, 3) OVER w AS m3, lag(mark, 4) OVER w AS m4, lag(fv) OVER w AS f1, lag(cost) OVER w AS c1, lag(rate) OVER w AS r1, lag(nonaccrual) OVER w AS n1,
          lag(pik) OVER w AS k1, lag(spread) OVER w AS s1, lag(maturity) OVER w AS t1, lag(period) OVER w AS p1
        FROM holdings WINDOW w AS (PARTITION BY lender, borrower ORDER BY period)))"""


ROUNDED = ("cost", "fv", "mark", "mark_lag1", "mark_lag2", "mark_lag3", "mark_lag4", "fv_lag1", "cost_lag1", "rate_lag1", "spread_lag1", "mark_chg1", "mark_chg2", "mark_chg4")


def with_coverage(lq: DataFrame, reconciliation: DataFrame) -> DataFrame:
    """Adds how far the lender's holdings of the period cover its reported total, and ``data_ok``:
    within a tenth of it, or nothing to compare with but the assets."""
    known = reconciliation.select("lender", "period", "coverage", (F.coalesce(F.col("coverage").between(0.9, 1.1), F.lit(False)) | (F.col("status") == "by_assets")).alias("data_ok"))
    return lq.join(known, ["lender", "period"], "left").fillna(False, ["data_ok"])


def loan_quarter(spark: SparkSession, sf: str) -> DataFrame:
    lq = loan_quarters(holdings(spark, sf))
    return lq.withColumns({c: rounded(F.col(c)) for c in ROUNDED})


LOAN_QUARTER = f"""WITH {LOAN_QUARTERS} SELECT * REPLACE ({", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ROUNDED)}) FROM loan_quarters"""

SHARES = {"below_95": "mark < 0.95", "below_91": "mark < 0.91", "on_nonaccrual": "nonaccrual", "on_pik": "pik", "crossed": "crossed_95", "newly_nonaccrual": "new_nonaccrual", "fresh": "is_new", "stress": "stressed"}


def with_ends(lq: DataFrame) -> DataFrame:
    """Adds the loan's last period and last known mark, and the lender's last period, as ``top``; by windows, so that rows are computed once."""
    whole = Window.partitionBy("lender", "borrower").orderBy("period").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = lq.withColumns({"last_period": F.max("period").over(whole), "last_mark": F.last("mark", ignorenulls=True).over(whole)})
    return ends.withColumn("top", F.max("period").over(Window.partitionBy("lender")))


def lender_quarters(lq: DataFrame) -> DataFrame:
    """Lender-quarter book: sums, shares, weighted means, exits, and row-offset changes."""
    cost = F.col("cost")
    gone = (F.col("period") == F.col("last_period")) & (F.col("last_period") < F.col("top"))
    book = with_ends(lq).groupBy("lender", "period").agg(
        F.count("*").alias("n_loans"), F.countDistinct("itype").alias("n_types"), exact_sum(cost).alias("cost"), exact_sum(F.col("fv")).alias("fv"),
        *(share(cost, F.expr(e)).alias(f"sh_{n}") for n, e in SHARES.items()),
        weighted_mean(F.col("mark_chg1"), cost).alias("mark_drift"),
        F.count_if(gone).alias("n_exits"), F.count_if(gone & (F.col("last_mark") < 0.9)).alias("n_loss_exits"),
    )
    book = book.withColumn("book_mark", ratio(F.col("fv"), cost))
    w = Window.partitionBy("lender").orderBy("period")
    return book.withColumns({f"d{n}_{c}": F.col(c) - F.lag(c, n).over(w) for c in ("book_mark", "sh_stress") for n in (1, 4)})


LENDER_QUARTERS = LOAN_QUARTERS + f""", book AS (
  SELECT lender, period, count(*) AS n_loans, count(DISTINCT itype) AS n_types,
    CAST(sum(CAST(cost AS DECIMAL(24,6))) AS DOUBLE) AS cost, CAST(sum(CAST(fv AS DECIMAL(24,6))) AS DOUBLE) AS fv,
    {", ".join(f"coalesce(CAST(sum(CAST(cost AS DECIMAL(24,6))) FILTER (WHERE {e}) AS DOUBLE), 0) / nullif(CAST(sum(CAST(cost AS DECIMAL(24,6))) AS DOUBLE), 0) AS sh_{n}" for n, e in SHARES.items())},
    CAST(sum(CAST(mark_chg1 * cost AS DECIMAL(24,6))) AS DOUBLE) / nullif(CAST(sum(CAST(cost AS DECIMAL(24,6))) FILTER (WHERE mark_chg1 IS NOT NULL) AS DOUBLE), 0) AS mark_drift
  FROM loan_quarters GROUP BY 1, 2),
gone AS (SELECT lender, borrower, max(period) AS period, arg_max(mark, period) AS mark FROM loan_quarters GROUP BY 1, 2),
exits AS (SELECT lender, period, count(*) AS n_exits, count(*) FILTER (WHERE mark < 0.9) AS n_loss_exits
  FROM gone JOIN (SELECT lender, max(period) AS last FROM loan_quarters GROUP BY 1) USING (lender) WHERE period < last GROUP BY 1, 2),
lender_quarters AS (
  SELECT *, {", ".join(f"{c} - lag({c}, {n}) OVER w AS d{n}_{c}" for c in ("book_mark", "sh_stress") for n in (1, 4))}
  FROM (SELECT book.*, coalesce(n_exits, 0) AS n_exits, coalesce(n_loss_exits, 0) AS n_loss_exits, fv / nullif(cost, 0) AS book_mark
        FROM book LEFT JOIN exits USING (lender, period))
  WINDOW w AS (PARTITION BY lender ORDER BY period))"""
QUALITY = ["sh_below_95", "sh_below_91", "sh_on_nonaccrual", "sh_on_pik", "sh_crossed", "sh_newly_nonaccrual", "sh_stress", "mark_drift"]
BOOK_DOUBLES = ["cost", "fv", "mark_drift", "book_mark", *(f"sh_{n}" for n in SHARES), *(f"d{n}_{c}" for c in ("book_mark", "sh_stress") for n in (1, 4))]


def with_quality(lq: DataFrame, least: int = 3) -> DataFrame:
    """Adds the quality score: the mean of the oriented cross-sectional z-scores that exist, clipped
    to 3, if at least ``least`` do."""
    zs = [zscore(c, ["period"]) * (1.0 if c == "mark_drift" else -1.0) for c in QUALITY]
    lq = lq.withColumns({f"_z{i}": z for i, z in enumerate(zs)})
    n = sum(F.col(f"_z{i}").isNotNull().cast("int") for i in range(len(zs)))
    total = sum(F.coalesce(f"_z{i}", F.lit(0.0)) for i in range(len(zs)))
    return lq.withColumn("quality", F.when(n >= least, total / n)).drop(*(f"_z{i}" for i in range(len(zs))))


def bdc_quarter(spark: SparkSession, sf: str) -> DataFrame:
    out = with_quality(lender_quarters(loan_quarters(holdings(spark, sf, dealt=True))))
    return out.withColumns({c: rounded(F.col(c), 6) for c in BOOK_DOUBLES} | {"quality": rounded(F.col("quality"), 4)})


def _z_sql(c: str) -> str:
    return f"CASE WHEN stddev_samp({c}) OVER p > 0 THEN greatest(-3.0, least(3.0, ({c} - avg({c}) OVER p) / stddev_samp({c}) OVER p)) END"


BDC_QUARTER = f"""WITH {LENDER_QUARTERS}, z AS (
  SELECT *, {", ".join(f"{'' if c == 'mark_drift' else '-'}({_z_sql(c)}) AS z{i}" for i, c in enumerate(QUALITY))} FROM lender_quarters WINDOW p AS (PARTITION BY period))
SELECT * EXCLUDE ({", ".join(f"z{i}" for i in range(len(QUALITY)))}) REPLACE ({", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in BOOK_DOUBLES)}),
  CASE WHEN {" + ".join(f"(z{i} IS NOT NULL)::INT" for i in range(len(QUALITY)))} >= 3
    THEN round(({" + ".join(f"coalesce(z{i}, 0)" for i in range(len(QUALITY)))}) / ({" + ".join(f"(z{i} IS NOT NULL)::INT" for i in range(len(QUALITY)))}), 4) + 0.0 END AS quality
FROM z"""


def migration(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and cost by bucket before and after, per period."""
    lq = loan_quarters(holdings(spark, sf)).filter("NOT is_new")
    return lq.groupBy("period", "from_bucket", "bucket").agg(F.count("*").alias("n"), rounded(exact_sum(F.col("cost")), 4).alias("cost"))


MIGRATION = f"""WITH {LOAN_QUARTERS} SELECT period, from_bucket, bucket, count(*) AS n, round(CAST(sum(CAST(cost AS DECIMAL(24,6))) AS DOUBLE), 4) + 0.0 AS cost
FROM loan_quarters WHERE NOT is_new GROUP BY 1, 2, 3"""


def migration_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """The newest period's migration as a matrix with row totals."""
    m = migration(spark, sf)
    newest = m.agg(F.max("period").alias("period"))
    names = [n for _, n in BUCKETS] + ["e_distressed"]
    return m.join(newest, "period", "left_semi").groupBy("from_bucket").agg(*(F.coalesce(F.sum(F.when(F.col("bucket") == n, F.col("n"))), F.lit(0)).alias(n) for n in names), F.sum("n").alias("total"))


MIGRATION_MATRIX = f"""WITH {LOAN_QUARTERS} SELECT from_bucket, {", ".join(f"count(*) FILTER (WHERE bucket = '{n}') AS {n}" for n in [n for _, n in BUCKETS] + ["e_distressed"])}, count(*) AS total
FROM loan_quarters WHERE NOT is_new AND period = (SELECT max(period) FROM loan_quarters WHERE NOT is_new) GROUP BY 1"""


def shared_marks(h: DataFrame) -> DataFrame:
    """Marks of what several lenders hold of a borrower in a period, against the others' mean."""
    out = leave_one_out(h, ["borrower", "period"], "mark", "peer_mark").filter("peer_mark IS NOT NULL")
    n = F.count("*").over(Window.partitionBy("borrower", "period"))
    return out.select("lender", "borrower", "period", "itype", "cost", "nonaccrual", "mark", "peer_mark", (F.col("mark") - F.col("peer_mark")).alias("vs_peers"), n.alias("n_lenders"), F.sum(F.col("nonaccrual").cast("int")).over(Window.partitionBy("borrower", "period")).alias("n_nonaccrual"))


SHARED_MARKS = HOLDINGS + """, shared_marks AS (
  SELECT lender, borrower, period, itype, cost, nonaccrual, mark, (total - mark) / (n - 1) AS peer_mark, mark - (total - mark) / (n - 1) AS vs_peers, n AS n_lenders, n_nonaccrual
  FROM (SELECT *, count(mark) OVER p AS n, CAST(sum(CAST(mark AS DECIMAL(24,6))) OVER p AS DOUBLE) AS total, CAST(sum(nonaccrual::INT) OVER p AS BIGINT) AS n_nonaccrual
        FROM holdings WINDOW p AS (PARTITION BY borrower, period)) WHERE n > 1 AND mark IS NOT NULL)"""


def borrower_marks(spark: SparkSession, sf: str) -> DataFrame:
    s = shared_marks(holdings(spark, sf))
    return s.select("lender", "borrower", "period", "n_lenders", "n_nonaccrual", "mark", "peer_mark", (F.col("vs_peers") + F.lit(0.0)).alias("vs_peers"))


BORROWER_MARKS = f"WITH {SHARED_MARKS} SELECT lender, borrower, period, n_lenders, n_nonaccrual, mark, peer_mark, vs_peers + 0.0 AS vs_peers FROM shared_marks"


def generosity(spark: SparkSession, sf: str) -> DataFrame:
    """How far a lender marks above the others on what they share, weighted by cost."""
    s = shared_marks(holdings(spark, sf))
    return s.groupBy("lender", "period").agg(
        F.count("*").alias("n_shared"), rounded(weighted_mean(F.col("vs_peers"), F.col("cost"))).alias("generosity"),
        F.count_if(F.col("vs_peers") > 0.03).alias("n_above"), F.count_if(F.col("vs_peers") < -0.03).alias("n_below"),
        F.count_if(~F.col("nonaccrual") & (F.col("n_nonaccrual") > 0)).alias("n_peers_nonaccrual"),
    )


GENEROSITY = f"""WITH {SHARED_MARKS} SELECT lender, period, count(*) AS n_shared,
  round(CAST(sum(CAST(vs_peers * cost AS DECIMAL(24,6))) AS DOUBLE) / nullif(CAST(sum(CAST(cost AS DECIMAL(24,6))) AS DOUBLE), 0), 6) + 0.0 AS generosity,
  count(*) FILTER (WHERE vs_peers > 0.03) AS n_above, count(*) FILTER (WHERE vs_peers < -0.03) AS n_below,
  count(*) FILTER (WHERE NOT nonaccrual AND n_nonaccrual > 0) AS n_peers_nonaccrual FROM shared_marks GROUP BY 1, 2"""


def loan_summary(h: DataFrame) -> DataFrame:
    """One row per loan: first and last sight, last and lowest mark, and how it left."""
    last = h.groupBy("lender").agg(F.max("period").alias("_last"))
    loans = h.groupBy("lender", "borrower").agg(
        F.min("period").alias("first_period"), F.max("period").alias("last_period"), F.count("*").alias("n_periods"),
        latest(F.col("mark"), F.col("period")).alias("last_mark"), F.min("mark").alias("min_mark"),
        F.bool_or("nonaccrual").alias("ever_nonaccrual"), F.bool_or("pik").alias("ever_pik"),
    ).join(last, "lender")
    exited = F.col("last_period") < F.col("_last")
    return loans.select("lender", "borrower", "first_period", "last_period", "n_periods", rounded(F.col("last_mark")).alias("last_mark"), rounded(F.col("min_mark")).alias("min_mark"), "ever_nonaccrual", "ever_pik", exited.alias("exited"), F.when(exited, F.when(F.col("last_mark") < 0.9, "loss").otherwise("repaid_or_sold")).alias("exit_type"))


def loan_history_summary(spark: SparkSession, sf: str) -> DataFrame:
    return loan_summary(holdings(spark, sf))


LOAN_HISTORY_SUMMARY = f"""WITH {HOLDINGS}, last AS (SELECT lender, max(period) AS last FROM holdings GROUP BY 1)
SELECT lender, borrower, min(period) AS first_period, max(period) AS last_period, count(*) AS n_periods, round(arg_max(mark, period), 6) + 0.0 AS last_mark,
  round(min(mark), 6) + 0.0 AS min_mark, bool_or(nonaccrual) AS ever_nonaccrual, bool_or(pik) AS ever_pik, max(period) < max(last) AS exited,
  CASE WHEN max(period) < max(last) THEN CASE WHEN arg_max(mark, period) < 0.9 THEN 'loss' ELSE 'repaid_or_sold' END END AS exit_type
FROM holdings JOIN last USING (lender) GROUP BY 1, 2"""


def exits_by_period(spark: SparkSession, sf: str) -> DataFrame:
    """Loans by the period in which they were last seen, if their lender reports later ones."""
    s = loan_summary(holdings(spark, sf)).filter("exited")
    return s.groupBy(F.col("last_period").alias("period"), "exit_type").agg(F.count("*").alias("n"), F.countDistinct("lender").alias("n_lenders"))


EXITS_BY_PERIOD = f"SELECT last_period AS period, exit_type, count(*) AS n, count(DISTINCT lender) AS n_lenders FROM ({LOAN_HISTORY_SUMMARY}) WHERE exited GROUP BY 1, 2"


def rollup(spark: SparkSession, sf: str, key: Column, name: str) -> DataFrame:
    lq = loan_quarters(holdings(spark, sf))
    first = F.min("period").over(Window.partitionBy("lender", "borrower"))
    lq = lq.withColumn("vintage", F.year(first).cast("bigint"))
    return lq.groupBy(key.alias(name), "period").agg(F.count("*").alias("n"), rounded(exact_sum(F.col("cost")), 4).alias("cost"), rounded(weighted_mean(F.col("mark"), F.col("cost"))).alias("mark"), rounded(share(F.col("cost"), F.col("stressed"))).alias("sh_stress"), F.countDistinct(F.struct("lender", "borrower")).alias("n_distinct"))


def _rollup_sql(key: str, name: str) -> str:
    c = "CAST(sum(CAST(cost AS DECIMAL(24,6))) AS DOUBLE)"
    return f"""WITH {LOAN_QUARTERS} SELECT {key} AS {name}, period, count(*) AS n, round({c}, 4) + 0.0 AS cost,
  round(CAST(sum(CAST(mark * cost AS DECIMAL(24,6))) AS DOUBLE) / nullif({c}, 0), 6) + 0.0 AS mark,
  round(coalesce(CAST(sum(CAST(cost AS DECIMAL(24,6))) FILTER (WHERE stressed) AS DOUBLE), 0) / nullif({c}, 0), 6) + 0.0 AS sh_stress, count(DISTINCT (lender, borrower)) AS n_distinct
FROM (SELECT *, year(min(period) OVER (PARTITION BY lender, borrower)) AS vintage FROM loan_quarters) GROUP BY 1, 2"""


def bdc_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The newest book of each lender, with its name and manager."""
    b = lender_quarters(loan_quarters(holdings(spark, sf, dealt=True)))
    newest = F.row_number().over(Window.partitionBy("lender").orderBy(F.desc("period")))
    b = b.withColumn("_rn", newest).filter("_rn = 1")
    return lenders(spark, sf).join(b, "lender", "left").select("lender", "name", "manager", "period", "n_loans", rounded(F.col("cost"), 4).alias("cost"), rounded(F.col("book_mark")).alias("book_mark"), rounded(F.col("sh_stress")).alias("sh_stress"))


BDC_LATEST = f"""WITH {LENDER_QUARTERS}, {LENDERS}, newest AS (SELECT * FROM lender_quarters QUALIFY row_number() OVER (PARTITION BY lender ORDER BY period DESC) = 1)
SELECT lender, name, manager, period, n_loans, round(cost, 4) + 0.0 AS cost, round(book_mark, 6) + 0.0 AS book_mark, round(sh_stress, 6) + 0.0 AS sh_stress FROM lenders LEFT JOIN newest USING (lender)"""

QUERIES = {
    "loan_quarter": loan_quarter,
    "bdc_quarter": bdc_quarter,
    "bdc_latest": bdc_latest,
    "migration": migration,
    "migration_matrix": migration_matrix,
    "borrower_marks": borrower_marks,
    "generosity": generosity,
    "loan_history_summary": loan_history_summary,
    "exits_by_period": exits_by_period,
    "sector_rollup": lambda spark, sf: rollup(spark, sf, F.col("sector"), "sector"),
    "borrower_rollup": lambda spark, sf: rollup(spark, sf, F.col("borrower"), "borrower"),
    "vintage_rollup": lambda spark, sf: rollup(spark, sf, F.col("vintage"), "vintage"),
}
SQL = {
    "loan_quarter": LOAN_QUARTER,
    "bdc_quarter": BDC_QUARTER,
    "bdc_latest": BDC_LATEST,
    "migration": MIGRATION,
    "migration_matrix": MIGRATION_MATRIX,
    "borrower_marks": BORROWER_MARKS,
    "generosity": GENEROSITY,
    "loan_history_summary": LOAN_HISTORY_SUMMARY,
    "exits_by_period": EXITS_BY_PERIOD,
    "sector_rollup": _rollup_sql("sector", "sector"),
    "borrower_rollup": _rollup_sql("borrower", "borrower"),
    "vintage_rollup": _rollup_sql("vintage", "vintage"),
}
