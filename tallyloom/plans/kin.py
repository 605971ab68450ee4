"""Do borrowers like one that just fell fall next? Neighbours of events against drawn controls.

An event is a borrower whose mark over all lenders falls below ``FALLEN`` from above. Its neighbours
are the ten borrowers of the same period most like it that still stand above, its controls ten drawn
ones that are no neighbours. A pair is a hit if the other falls within ``OUTCOME`` days; it counts if
it is a hit or was seen ``OBSERVED`` days later. The interval of difference and ratio draws events
with their neighbours and controls together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.agg import exact_sum, ratio, rounded
from ..operators.asof import band_pairs
from ..operators.resample import bootstrap_difference, bootstrap_sql, controls, nearest_profiles, uniform_sql
from ..session import cut
from .binding import HOLDINGS, holdings

# Neighbours an event, the mark that counts as fallen, and the days within which it is waited for.
K, FALLEN, OUTCOME, OBSERVED, RECENT = 10, 0.95, 380, 270, 200
FEATURES = ["size", "pik", "rate", "lenders"]
REPLICATES, SEED = 200, 5


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    """(borrower, period): sector, mark, whether it just fell, and features standardised within the period."""
    h = holdings(spark, sf)
    p = h.groupBy("borrower", "period").agg(
        F.min("sector").alias("sector"), ratio(exact_sum(F.col("fv")), exact_sum(F.col("cost"))).alias("mark"), F.log10(exact_sum(F.col("cost"))).alias("size"), F.avg(F.col("pik").cast("double")).alias("pik"),
        F.max("rate").alias("rate"), F.count("*").cast("double").alias("lenders"),
    )
    before = F.lag("mark").over(Window.partitionBy("borrower").orderBy("period"))
    p = p.withColumn("fell", F.coalesce((F.col("mark") < FALLEN) & (before >= FALLEN), F.lit(False)))
    norm = p.groupBy("period").agg(*(f(c).alias(f"{c}_{n}") for c in FEATURES for f, n in ((F.avg, "avg"), (F.stddev_pop, "sd"))))
    z = lambda c: rounded((F.col(c) - F.col(f"{c}_avg")) / F.nullif(F.col(f"{c}_sd"), F.lit(0.0)), 9)
    return p.join(norm, "period").select("borrower", "period", "sector", "mark", "fell", *(z(c).alias(c) for c in FEATURES))


PROFILES = HOLDINGS + f""",
raw AS (SELECT borrower, period, min(sector) AS sector, CAST(sum(CAST(fv AS DECIMAL(24,6))) AS DOUBLE) / nullif(CAST(sum(CAST(cost AS DECIMAL(24,6))) AS DOUBLE), 0) AS mark, log10(CAST(sum(CAST(cost AS DECIMAL(24,6))) AS DOUBLE)) AS size,
  avg(CAST(pik AS DOUBLE)) AS pik, max(rate) AS rate, CAST(count(*) AS DOUBLE) AS lenders FROM holdings GROUP BY 1, 2),
profiles AS MATERIALIZED (SELECT borrower, period, sector, mark, coalesce(mark < {FALLEN} AND lag(mark) OVER (PARTITION BY borrower ORDER BY period) >= {FALLEN}, false) AS fell,
  {", ".join(f"round(({c} - avg({c}) OVER (PARTITION BY period)) / nullif(stddev_pop({c}) OVER (PARTITION BY period), 0), 9) + 0.0 AS {c}" for c in FEATURES)} FROM raw)"""


def pairs(p: DataFrame) -> DataFrame:
    """(event, borrower, period, key, same_sector, control, hit, observed) of all events."""
    p = cut(p)
    name = F.concat_ws("|", "borrower", "period")
    events = p.filter("fell").select(name.alias("event"), F.col("borrower").alias("own"), "period", "sector", *FEATURES)
    pool = p.filter(~F.col("fell") & (F.col("mark") >= FALLEN)).select(F.col("borrower").alias("key"), "period", "sector", *FEATURES)
    near = cut(nearest_profiles(events, pool, ["period"], "event", "key", FEATURES, K, same="sector").select("event", "period", "key"))
    drawn = controls(events, pool, ["period"], "event", "key", K, seed=SEED, apart=near, most=K, own="own").select("event", "period", "key")
    both = near.withColumn("control", F.lit(False)).unionByName(drawn.withColumn("control", F.lit(True)))
    both = both.join(events.select("event", F.col("own").alias("borrower"), F.col("sector").alias("_of")), "event").join(pool.select("key", "period", F.col("sector").alias("_its")), ["key", "period"])
    later = p.select(F.col("borrower").alias("key"), F.col("period").alias("later"), F.col("mark").alias("_mark"))
    seen = band_pairs(both.select("key", "period").distinct(), later, ["key"], "period", "later", 1, OUTCOME)
    seen = seen.groupBy(F.col("_l.key").alias("key"), F.col("_l.period").alias("period")).agg(F.bool_or(F.col("_r._mark") < FALLEN).alias("_hit"), F.max(F.datediff("_r.later", "_l.period")).alias("_days"))
    hit = F.coalesce("_hit", F.lit(False))
    return both.join(seen, ["key", "period"], "left").select("event", "borrower", "period", "key", (F.col("_of") == F.col("_its")).alias("same_sector"), "control", hit.alias("hit"), (hit | F.coalesce(F.col("_days") >= OBSERVED, F.lit(False))).alias("observed"))


PAIRS = PROFILES + f""",
events AS (SELECT concat_ws('|', borrower, CAST(period AS DATE)) AS event, * FROM profiles WHERE fell),
pool AS (SELECT borrower AS key, * FROM profiles WHERE NOT fell AND mark >= {FALLEN}),
gaps AS (SELECT e.event, e.period, p.key, e.sector <> p.sector AS other, [g FOR g IN [{", ".join(f"p.{c} - e.{c}" for c in FEATURES)}] IF g IS NOT NULL] AS g FROM events e JOIN pool p ON e.period = p.period),
near AS MATERIALIZED (SELECT event, period, key FROM gaps WHERE len(g) >= 3 QUALIFY row_number() OVER (PARTITION BY event ORDER BY other, sqrt(({" + ".join(f"coalesce(g[{i}] * g[{i}], 0)" for i in range(1, len(FEATURES) + 1))}) / len(g)), key) <= {K}),
ring AS (SELECT key, period, row_number() OVER (PARTITION BY period ORDER BY {uniform_sql(str(SEED), "'pool'", "key")}, key) AS place, {uniform_sql(str(SEED), "'pool'", "key")} AS u, count(*) OVER (PARTITION BY period) AS n FROM pool),
turns AS (SELECT event, e.period, e.borrower AS own, any_value(n) AS n, count(*) FILTER (u <= {uniform_sql(str(SEED), "'event'", "event")}) AS place FROM events e JOIN ring USING (period) GROUP BY 1, 2, 3),
steps AS (SELECT t.event, t.period, r.key, k FROM turns t, range(1, {2 * K + 2}) AS s(k) JOIN ring r ON r.period = t.period AND r.place = (t.place + k - 1) % t.n + 1 WHERE k <= t.n AND r.key <> t.own),
drawn AS (SELECT event, period, key FROM steps ANTI JOIN near USING (event, key) QUALIFY row_number() OVER (PARTITION BY event ORDER BY k) <= {K}),
either AS (SELECT *, false AS control FROM near UNION ALL SELECT *, true FROM drawn),
seen AS (SELECT b.key, b.period, bool_or(p.mark < {FALLEN}) AS hit, max(date_diff('day', b.period, p.period)) AS days FROM (SELECT DISTINCT key, period FROM either) b JOIN profiles p ON p.borrower = b.key AND date_diff('day', b.period, p.period) BETWEEN 1 AND {OUTCOME} GROUP BY 1, 2),
pairs AS MATERIALIZED (SELECT b.event, e.borrower, b.period, b.key, e.sector = p.sector AS same_sector, control, coalesce(hit, false) AS hit, coalesce(hit, false) OR coalesce(days >= {OBSERVED}, false) AS observed
  FROM either b JOIN events e ON e.event = b.event JOIN pool p ON p.key = b.key AND p.period = b.period LEFT JOIN seen s ON s.key = b.key AND s.period = b.period)"""


def neighbor_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(profiles(spark, sf))


NEIGHBOR_PAIRS = f"WITH {PAIRS} SELECT * FROM pairs"


def outcome(found: DataFrame, newest: DataFrame) -> DataFrame:
    """Hit rates of neighbours and controls, over all events and by year: difference and ratio with intervals.

    Only events old enough to be waited for count; ``newest`` has one row, the last period.
    """
    old = found.filter("observed").join(F.broadcast(newest), F.col("period") <= F.date_sub("newest", OBSERVED))  # of one row
    old = old.select("event", (~F.col("control")).alias("near"), F.col("hit").cast("int").alias("hit"), F.explode(F.array(F.lit("all"), F.year("period").cast("string"))).alias("group"))
    rates = old.groupBy("group").agg(F.countDistinct("event").alias("n_events"), F.count_if("near").alias("n_near"), F.avg(F.when(F.col("near"), F.col("hit"))).alias("near_rate"), F.count_if(~F.col("near")).alias("n_controls"), F.avg(F.when(~F.col("near"), F.col("hit"))).alias("control_rate"))
    return rates.join(bootstrap_difference(old, "event", "near", "hit", REPLICATES, SEED, ["group"]), "group")


def neighbor_test(spark: SparkSession, sf: str) -> DataFrame:
    p = cut(profiles(spark, sf))
    t = outcome(cut(pairs(p)), p.agg(F.max("period").alias("newest")))
    return t.select("group", "n_events", "n_near", "n_controls", *(rounded(F.col(c), 7).alias(c) for c in ("near_rate", "control_rate", "diff", "low", "high", "ratio", "ratio_low", "ratio_high")))


NEIGHBOR_TEST = f"""WITH {PAIRS}, old AS (SELECT event, NOT control AS near, CAST(hit AS INTEGER) AS hit, unnest(['all', CAST(year(period) AS VARCHAR)]) AS "group" FROM pairs WHERE observed AND date_diff('day', period, (SELECT max(period) FROM profiles)) >= {OBSERVED}),
rates AS (SELECT "group", count(DISTINCT event) AS n_events, count(*) FILTER (near) AS n_near, avg(hit) FILTER (near) AS near_rate, count(*) FILTER (NOT near) AS n_controls, avg(hit) FILTER (NOT near) AS control_rate FROM old GROUP BY 1),
{bootstrap_sql("old", "event", "near", "hit", REPLICATES, SEED, ['"group"'])}
SELECT "group", n_events, n_near, n_controls, {", ".join(f"round({c}, 7) + 0.0 AS {c}" for c in ("near_rate", "control_rate", "diff", "low", "high", "ratio", "ratio_low", "ratio_high"))} FROM rates JOIN spread USING ("group")"""


def neighbor_watchlist(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours of the events of the last ``RECENT`` days, with their mark today and who holds them."""
    p = cut(profiles(spark, sf))
    newest = p.agg(F.max("period").alias("newest"))
    found = pairs(p).filter("NOT control").join(F.broadcast(newest), F.col("period") >= F.date_sub("newest", RECENT))  # of one row
    today = p.groupBy(F.col("borrower").alias("key")).agg(F.max_by("mark", "period").alias("mark_now"), F.max("period").alias("seen_now"))
    held = holdings(spark, sf).groupBy(F.col("borrower").alias("key"), "period").agg(F.array_join(F.array_sort(F.collect_set(F.col("lender").cast("string"))), ", ").alias("holders"), F.count("*").alias("n_holders"))
    out = found.join(today, "key").join(held, ["key", "period"], "left")
    return out.select("event", "borrower", "period", "key", "same_sector", rounded(F.col("mark_now")).alias("mark_now"), "seen_now", "holders", "n_holders")


NEIGHBOR_WATCHLIST = f"""WITH {PAIRS}, today AS (SELECT borrower AS key, arg_max(mark, period) AS mark_now, max(period) AS seen_now FROM profiles GROUP BY 1),
held AS (SELECT borrower AS key, period, string_agg(DISTINCT CAST(lender AS VARCHAR), ', ' ORDER BY CAST(lender AS VARCHAR)) AS holders, count(*) AS n_holders FROM holdings GROUP BY 1, 2)
SELECT event, borrower, period, key, same_sector, round(mark_now, 6) + 0.0 AS mark_now, seen_now, holders, n_holders FROM pairs JOIN today USING (key) LEFT JOIN held USING (key, period)
WHERE NOT control AND date_diff('day', period, (SELECT max(period) FROM profiles)) <= {RECENT}"""

QUERIES = {"neighbor_pairs": neighbor_pairs, "neighbor_test": neighbor_test, "neighbor_watchlist": neighbor_watchlist}
SQL = {"neighbor_pairs": NEIGHBOR_PAIRS, "neighbor_test": NEIGHBOR_TEST, "neighbor_watchlist": NEIGHBOR_WATCHLIST}
