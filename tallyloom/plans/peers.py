"""Second opinions between managers, pressure to sell, and borrowers like those that went bad."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.agg import at_grains, exact_sum, leave_group_out, ratio, rounded, weighted_mean
from ..operators.asof import band
from ..operators.resample import bootstrap_difference, bootstrap_sql, controls, nearest_profiles, uniform_sql
from ..session import cut, table
from .binding import HOLDINGS, LENDERS, holdings, lenders
from .signals import LENDER_QUARTERS, LOAN_QUARTERS, SHARED_MARKS, lender_quarters, loan_quarters, loan_summary, shared_marks


def _opinions(spark: SparkSession, sf: str) -> DataFrame:
    return holdings(spark, sf).join(lenders(spark, sf).select("lender", "manager"), "lender").filter("cost > 0")


OPINIONS = HOLDINGS + ", " + LENDERS + ", op AS (SELECT holdings.*, manager FROM holdings JOIN lenders USING (lender) WHERE cost > 0)"


def stale_borrowers(spark: SparkSession, sf: str) -> DataFrame:
    """Borrowers that two or more managers hold: the gap between their marks and who is at the ends."""
    keys = ["borrower", "period"]
    one = _opinions(spark, sf).groupBy(*keys, "manager").agg(ratio(exact_sum(F.col("fv")), exact_sum(F.col("cost"))).alias("mark"), exact_sum(F.col("cost")).alias("cost"), F.bool_or("nonaccrual").alias("nonaccrual"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("mark", "manager"))), lambda s: F.concat_ws(" ", s["manager"], F.round(s["mark"], 2).cast("string"))), ", ")
    out = one.groupBy(*keys).agg(
        F.count("*").alias("n_managers"), F.min("mark").alias("low"), F.max("mark").alias("high"),
        F.min(F.struct("mark", "manager")).alias("lo"), F.max(F.struct("mark", "manager")).alias("hi"),
        rounded(weighted_mean(F.col("mark"), F.col("cost")), 5).alias("wavg"), F.bool_or("nonaccrual").alias("any_nonaccrual"), F.count_if("nonaccrual").alias("n_nonaccrual"), listed.alias("marks"),
    ).filter("n_managers >= 2")
    return out.select(*keys, "n_managers", (F.col("high") - F.col("low")).alias("gap"), F.col("lo.manager").alias("low_manager"), F.col("hi.manager").alias("high_manager"), "wavg", "any_nonaccrual", "n_nonaccrual", F.length("marks").cast("bigint").alias("marks_length"))


STALE_BORROWERS = f"""WITH {OPINIONS}, one AS (SELECT borrower, period, manager, CAST(sum(CAST(fv AS DECIMAL(24,6))) AS DOUBLE) / nullif(CAST(sum(CAST(cost AS DECIMAL(24,6))) AS DOUBLE), 0) AS mark, CAST(sum(CAST(cost AS DECIMAL(24,6))) AS DOUBLE) AS cost, bool_or(nonaccrual) AS nonaccrual FROM op GROUP BY 1, 2, 3)
SELECT borrower, period, count(*) AS n_managers, max(mark) - min(mark) AS gap, arg_min(manager, (mark, manager)) AS low_manager, arg_max(manager, (mark, manager)) AS high_manager,
  round(CAST(sum(CAST(mark * cost AS DECIMAL(24,6))) AS DOUBLE) / nullif(CAST(sum(CAST(cost AS DECIMAL(24,6))) AS DOUBLE), 0), 5) + 0.0 AS wavg, bool_or(nonaccrual) AS any_nonaccrual, count(*) FILTER (WHERE nonaccrual) AS n_nonaccrual,
  length(string_agg(manager || ' ' || CAST(round(mark, 2) AS VARCHAR), ', ' ORDER BY mark, manager)) AS marks_length FROM one GROUP BY 1, 2 HAVING count(*) >= 2"""


def _stale(spark: SparkSession, sf: str) -> DataFrame:
    o = leave_group_out(_opinions(spark, sf), ["borrower", "period"], "manager", "mark", "cost", "peer")
    gap = F.when(F.col("peer").isNotNull(), F.col("mark") - F.col("peer"))
    return o.groupBy("lender", "period").agg(
        F.count("*").alias("n"), F.count("peer").alias("n_shared"), weighted_mean(gap, F.col("cost")).alias("generosity"),
        F.coalesce(ratio(exact_sum(F.when(F.col("peer").isNull(), F.col("cost"))), exact_sum(F.col("cost"))), F.lit(0.0)).alias("no_second"),
        F.count_if(gap > 0.05).alias("n_above"), F.count_if(gap < -0.05).alias("n_below"))


def stale_generosity(spark: SparkSession, sf: str) -> DataFrame:
    """How far a lender marks above other managers, and how much of its book has no second opinion."""
    return _stale(spark, sf).select("lender", "period", "n", "n_shared", rounded(F.col("generosity"), 5).alias("generosity"), rounded(F.col("no_second"), 5).alias("no_second"), "n_above", "n_below")


_S = lambda e, w: f"CAST(sum(CAST({e} AS DECIMAL(24,6))) OVER (PARTITION BY borrower, period{w}) AS DOUBLE)"
STALE = OPINIONS + f""", peer AS (SELECT *, ({_S("mark * cost", "")} - {_S("mark * cost", ", manager")}) / nullif({_S("cost", "")} - {_S("cost", ", manager")}, 0) AS peer FROM op),
stale AS (SELECT lender, period, count(*) AS n, count(peer) AS n_shared, CAST(sum(CAST((mark - peer) * cost AS DECIMAL(24,6))) AS DOUBLE) / nullif(CAST(sum(CAST(cost AS DECIMAL(24,6))) FILTER (WHERE peer IS NOT NULL) AS DOUBLE), 0) AS generosity,
  coalesce(CAST(sum(CAST(cost AS DECIMAL(24,6))) FILTER (WHERE peer IS NULL) AS DOUBLE) / nullif(CAST(sum(CAST(cost AS DECIMAL(24,6))) AS DOUBLE), 0), 0) AS no_second,
  count(*) FILTER (WHERE mark - peer > 0.05) AS n_above, count(*) FILTER (WHERE mark - peer < -0.05) AS n_below FROM peer GROUP BY 1, 2)"""
STALE_GENEROSITY = f"WITH {STALE} SELECT lender, period, n, n_shared, round(generosity, 5) + 0.0 AS generosity, round(no_second, 5) + 0.0 AS no_second, n_above, n_below FROM stale"


def stale_test(spark: SparkSession, sf: str) -> DataFrame:
    """Do lenders that mark above others mark down more within the next quarter? Fifths per period."""
    s = _stale(spark, sf).filter("n_shared >= 5")
    b = lender_quarters(loan_quarters(holdings(spark, sf, dealt=True))).select("lender", "period", "book_mark")
    ahead = b.select("lender", F.col("period").alias("p"), F.col("book_mark").alias("later"))
    j = band(s.join(b, ["lender", "period"]), ahead, ["lender"], "period", "p", 75, 105, ["later"], 90).filter("later IS NOT NULL AND generosity IS NOT NULL")
    w = Window.partitionBy("period")
    j = j.select("period", (F.col("later") - F.col("book_mark")).alias("fwd"), F.row_number().over(w.orderBy("generosity", "lender")).alias("rn"), F.count("*").over(w).alias("n")).filter("n >= 10")
    k = F.greatest(F.lit(2), F.floor(F.col("n") / 5))
    mean = lambda c: exact_sum(F.when(c, F.col("fwd"))) / F.count_if(c)
    return j.withColumn("k", k).groupBy("period").agg(F.max("n").alias("n"), rounded(mean(F.col("rn") > F.col("n") - F.col("k")), 5).alias("generous"), rounded(mean(F.col("rn") <= F.col("k")), 5).alias("strict"))


STALE_TEST = f"""WITH {STALE}, b AS (SELECT lender, period, CAST(sum(CAST(fv AS DECIMAL(24,6))) AS DOUBLE) / nullif(CAST(sum(CAST(cost AS DECIMAL(24,6))) AS DOUBLE), 0) AS book_mark FROM holdings GROUP BY 1, 2),
j AS (SELECT s.period, a.book_mark - b.book_mark AS fwd, row_number() OVER (PARTITION BY s.period ORDER BY generosity, s.lender) AS rn, count(*) OVER (PARTITION BY s.period) AS n
  FROM stale s JOIN b USING (lender, period) JOIN b a ON a.lender = s.lender AND date_diff('day', s.period, a.period) BETWEEN 75 AND 105 WHERE n_shared >= 5 AND generosity IS NOT NULL)
SELECT period, max(n) AS n, round(CAST(sum(CAST(fwd AS DECIMAL(24,6))) FILTER (WHERE rn > n - greatest(2, n // 5)) AS DOUBLE) / count(*) FILTER (WHERE rn > n - greatest(2, n // 5)), 5) + 0.0 AS generous,
  round(CAST(sum(CAST(fwd AS DECIMAL(24,6))) FILTER (WHERE rn <= greatest(2, n // 5)) AS DOUBLE) / count(*) FILTER (WHERE rn <= greatest(2, n // 5)), 5) + 0.0 AS strict FROM j WHERE n >= 10 GROUP BY 1"""


def _forced(spark: SparkSession, sf: str) -> DataFrame:
    """Lender-quarters near their coverage limit or with two rises of stress within 200 days."""
    b = lender_quarters(loan_quarters(holdings(spark, sf, dealt=True)))
    w = Window.partitionBy("lender").orderBy("period")
    b = b.select("lender", "period", "sh_stress", "cost", "fv", F.lag("sh_stress", 1).over(w).alias("s1"), F.lag("sh_stress", 2).over(w).alias("s2"), F.lag("period", 2).over(w).alias("p2"))
    coverage = 1 + ratio(F.col("fv") - 0.6 * F.col("cost"), 0.6 * F.col("cost"))
    rises = F.coalesce((F.col("sh_stress") > F.col("s1")) & (F.col("s1") > F.col("s2")) & (F.datediff("period", "p2") <= 200), F.lit(False))
    return b.select("lender", "period", "sh_stress", coverage.alias("coverage"), (coverage <= 1.57).alias("near"), rises.alias("rises"))


def forced_flags(spark: SparkSession, sf: str) -> DataFrame:
    return _forced(spark, sf).select("lender", "period", rounded(F.col("coverage"), 5).alias("coverage"), "near", "rises", (F.col("near") & F.col("rises")).alias("flagged"))


FORCED_FLAGS = f"""WITH {LENDER_QUARTERS}, b AS (SELECT lender, period, sh_stress, 1 + (fv - 0.6::DOUBLE * cost) / nullif(0.6::DOUBLE * cost, 0) AS coverage, lag(sh_stress) OVER w AS s1, lag(sh_stress, 2) OVER w AS s2, lag(period, 2) OVER w AS p2 FROM lender_quarters WINDOW w AS (PARTITION BY lender ORDER BY period)),
f AS (SELECT *, coverage <= 1.57 AS near, coalesce(sh_stress > s1 AND s1 > s2 AND date_diff('day', p2, period) <= 200, false) AS rises FROM b)
SELECT lender, period, round(coverage, 5) + 0.0 AS coverage, near, rises, near AND rises AS flagged FROM f"""


def forced_test_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Loss exits in the two quarters after a flag against those without, with an interval over lenders."""
    f = _forced(spark, sf)
    lost = loan_summary(holdings(spark, sf)).filter("exit_type = 'loss'").select("lender", F.col("last_period").alias("p"))
    per = lost.groupBy("lender", "p").agg(F.count("*").cast("double").alias("losses"))
    j = band(f, per, ["lender"], "period", "p", 75, 200, ["losses"], 90).fillna(0.0, ["losses"])
    b = bootstrap_difference(j, "lender", "rises", "losses", replicates=500, seed=7)
    return b.select(*(rounded(F.col(c), 7).alias(c) for c in b.columns))


_FORCED_SQL = FORCED_FLAGS[: FORCED_FLAGS.rindex("SELECT lender, period, round(coverage")]
FORCED_TEST_BOOTSTRAP = _FORCED_SQL + f""", last_seen AS (SELECT lender, borrower, max(period) AS p, arg_max(mark, period) AS last_mark FROM holdings GROUP BY 1, 2),
lost AS (SELECT lender, p, CAST(count(*) AS DOUBLE) AS losses FROM last_seen JOIN (SELECT lender, max(period) AS newest FROM holdings GROUP BY 1) USING (lender) WHERE p < newest AND last_mark < 0.9 GROUP BY 1, 2),
met AS (SELECT f.lender, f.period, rises, coalesce(arg_min(losses, (abs(date_diff('day', f.period, p) - 90), date_diff('day', f.period, p))), 0) AS losses
  FROM f LEFT JOIN lost ON lost.lender = f.lender AND date_diff('day', f.period, p) BETWEEN 75 AND 200 GROUP BY 1, 2, 3),
{bootstrap_sql("met", "lender", "rises", "losses", 500, 7)}
SELECT {", ".join(f"round({c}, 7) + 0.0 AS {c}" for c in ("diff", "low", "high", "ratio", "ratio_low", "ratio_high"))} FROM spread"""


def _features(spark: SparkSession, sf: str) -> DataFrame:
    """Borrower profiles of the newest period, standardised."""
    # all periods' profiles are few rows, and finding the newest one first would take the holdings twice
    p = loan_quarters(holdings(spark, sf, dealt=True)).groupBy("period", "borrower").agg(F.min("sector").alias("sector"), ratio(exact_sum(F.col("fv")), exact_sum(F.col("cost"))).alias("mark"), F.log10(exact_sum(F.col("cost"))).alias("size"), F.avg(F.col("pik").cast("double")).alias("pik"), weighted_mean(F.col("mark_chg1"), F.col("cost")).alias("drift"), F.bool_or("new_nonaccrual").alias("event"))
    p = cut(p)
    p = p.join(p.agg(F.max("period").alias("period")), "period", "left_semi")
    features = ["mark", "size", "pik", "drift"]
    norm = p.agg(*(F.avg(c).alias(f"{c}_avg") for c in features), *(F.stddev_pop(c).alias(f"{c}_sd") for c in features))
    p = p.crossJoin(F.broadcast(norm))  # one row
    z = lambda c: (F.col(c) - F.col(f"{c}_avg")) / F.nullif(F.col(f"{c}_sd"), F.lit(0.0))
    return p.select(F.lit(1).alias("all"), "borrower", "sector", "event", *(z(c).alias(c) for c in features))


def knn_borrowers(spark: SparkSession, sf: str) -> DataFrame:
    """The ten borrowers most like each that just went bad, and seeded controls beside them."""
    f = cut(_features(spark, sf))  # one row a borrower, and many steps begin with it
    events = f.filter("event").select("all", F.col("borrower").alias("event"), "sector", "mark", "size", "pik", "drift")
    pool = f.select("all", "borrower", "sector", "mark", "size", "pik", "drift")
    near = nearest_profiles(events, pool, ["all"], "event", "borrower", ["mark", "size", "pik", "drift"], 10, same="sector")
    drawn = controls(events.withColumn("own", F.col("event")), pool, ["all"], "event", "borrower", 10, seed=3, own="own").select("event", "borrower", F.lit("control").alias("kind"))
    return near.select("event", "borrower", F.lit("near").alias("kind")).unionByName(drawn)


FEATURES = f"""now AS (SELECT * FROM loan_quarters WHERE period = (SELECT max(period) FROM loan_quarters)),
raw AS (SELECT borrower, min(sector) AS sector, CAST(sum(CAST(fv AS DECIMAL(24,6))) AS DOUBLE) / nullif(CAST(sum(CAST(cost AS DECIMAL(24,6))) AS DOUBLE), 0) AS mark, log10(CAST(sum(CAST(cost AS DECIMAL(24,6))) AS DOUBLE)) AS size, avg(CAST(pik AS DOUBLE)) AS pik,
  CAST(sum(CAST(mark_chg1 * cost AS DECIMAL(24,6))) FILTER (mark_chg1 IS NOT NULL) AS DOUBLE) / nullif(CAST(sum(CAST(cost AS DECIMAL(24,6))) FILTER (mark_chg1 IS NOT NULL) AS DOUBLE), 0) AS drift, bool_or(new_nonaccrual) AS event FROM now GROUP BY 1),
profiles AS (SELECT borrower, sector, event, {", ".join(f"({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0) AS {c}" for c in ("mark", "size", "pik", "drift"))} FROM raw)"""
KNN_BORROWERS = f"""WITH {LOAN_QUARTERS}, {FEATURES},
pairs AS (SELECT event, borrower, other, list_sum([power(x.a - x.b, 2) FOR x IN gaps IF x.a IS NOT NULL AND x.b IS NOT NULL]) AS s, len([x FOR x IN gaps IF x.a IS NOT NULL AND x.b IS NOT NULL]) AS n
  FROM (SELECT e.borrower AS event, p.borrower AS borrower, e.sector <> p.sector AS other, [struct_pack(a := p.mark, b := e.mark), struct_pack(a := p.size, b := e.size), struct_pack(a := p.pik, b := e.pik), struct_pack(a := p.drift, b := e.drift)] AS gaps FROM profiles e JOIN profiles p ON e.event AND e.borrower <> p.borrower) AS t),
near AS (SELECT event, borrower FROM pairs WHERE n >= 3 QUALIFY row_number() OVER (PARTITION BY event ORDER BY other, sqrt(s / n), borrower) <= 10),
ring AS (SELECT borrower, row_number() OVER (ORDER BY {uniform_sql("3", "'pool'", "borrower")}, borrower) AS place, count(*) OVER () AS n FROM profiles),
turns AS (SELECT borrower AS event, (SELECT count(*) FROM profiles p WHERE {uniform_sql("3", "'pool'", "p.borrower")} <= {uniform_sql("3", "'event'", "e.borrower")}) AS place FROM profiles e WHERE event),
steps AS (SELECT event, ring.borrower, k FROM turns, range(1, 12) AS t(k) JOIN ring ON ring.place = (turns.place + k - 1) % ring.n + 1 WHERE k <= ring.n AND ring.borrower <> event)
SELECT event, borrower, 'near' AS kind FROM near UNION ALL SELECT event, borrower, 'control' FROM steps QUALIFY row_number() OVER (PARTITION BY event ORDER BY k) <= 10"""


#: Components of the test tables' vectors.
PARTS = 64


def knn_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """The five vectors nearest to each fiftieth one by root mean square, its own label's first."""
    v = table(spark, sf, "embeddings")
    names = [f"x{i}" for i in range(PARTS)]
    pool = v.select(F.lit(1).alias("all"), "vec_id", "label", *(F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)))
    events = pool.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "event")
    k = nearest_profiles(events, pool, ["all"], "event", "vec_id", names, 5, same="label")
    return k.select("event", "vec_id", F.col("rank").cast("bigint").alias("rank"), rounded(F.col("distance"), 7).alias("distance"))


KNN_PROFILES = f"""WITH d AS (SELECT e.vec_id AS event, p.vec_id, e.label <> p.label AS other, sqrt(list_sum([power(CAST(p.embedding[i] AS DOUBLE) - CAST(e.embedding[i] AS DOUBLE), 2) FOR i IN range(1, {PARTS + 1})]) / {PARTS}) AS distance FROM embeddings e JOIN embeddings p ON e.vec_id % 50 = 0 AND e.vec_id <> p.vec_id)
SELECT event, vec_id, row_number() OVER (PARTITION BY event ORDER BY other, distance, vec_id) AS rank, round(distance, 7) + 0.0 AS distance FROM d QUALIFY rank <= 5"""


def knn_test_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    """The same rates over all loans, by sector and by year, in one pass."""
    lq = loan_quarters(holdings(spark, sf)).withColumn("year", F.year("period").cast("string"))
    return at_grains(lq, [["sector", "year"], ["sector"], ["year"], []], [F.count("*").alias("n"), F.count_if("new_nonaccrual").alias("n_bad"), rounded(exact_sum(F.col("cost")), 3).alias("cost")])


KNN_TEST_GROUPING_SETS = f"""WITH {LOAN_QUARTERS} SELECT sector, year, grouping(sector, year) AS grain, count(*) AS n, count(*) FILTER (WHERE new_nonaccrual) AS n_bad, round(CAST(sum(CAST(cost AS DECIMAL(24,6))) AS DOUBLE), 3) + 0.0 AS cost
FROM (SELECT *, CAST(year(period) AS VARCHAR) AS year FROM loan_quarters) GROUP BY GROUPING SETS ((sector, year), (sector), (year), ())"""


def peer_nonaccrual(spark: SparkSession, sf: str) -> DataFrame:
    """What others already hold as non-accrual and the lender does not."""
    s = shared_marks(holdings(spark, sf)).filter(~F.col("nonaccrual") & (F.col("n_nonaccrual") > 0))
    return s.select("lender", "borrower", "period", "n_lenders", "n_nonaccrual", (F.col("vs_peers") + F.lit(0.0)).alias("vs_peers"))


PEER_NONACCRUAL = f"WITH {SHARED_MARKS} SELECT lender, borrower, period, n_lenders, n_nonaccrual, vs_peers + 0.0 AS vs_peers FROM shared_marks WHERE NOT nonaccrual AND n_nonaccrual > 0"

QUERIES = {"stale_borrowers": stale_borrowers, "stale_generosity": stale_generosity, "stale_test": stale_test, "forced_flags": forced_flags, "forced_test_bootstrap": forced_test_bootstrap, "knn_borrowers": knn_borrowers, "knn_profiles": knn_profiles, "knn_test_grouping_sets": knn_test_grouping_sets, "peer_nonaccrual": peer_nonaccrual}
SQL = {"stale_borrowers": STALE_BORROWERS, "stale_generosity": STALE_GENEROSITY, "stale_test": STALE_TEST, "forced_flags": FORCED_FLAGS, "forced_test_bootstrap": FORCED_TEST_BOOTSTRAP, "knn_borrowers": KNN_BORROWERS, "knn_profiles": KNN_PROFILES, "knn_test_grouping_sets": KNN_TEST_GROUPING_SETS, "peer_nonaccrual": PEER_NONACCRUAL}
