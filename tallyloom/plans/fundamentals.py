"""What lenders earn and how they are funded, from reported facts; net asset values by the day they were known.

The facts are the star schema's: a lender's quarters are its order lines, reported by single
quarters, by sums since the year's start, or by single quarters and a year, by the lender's number;
some are filed again a year later with other values, and some quarters are not reported at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import quarter_end
from ..operators.agg import exact_sum, ratio, rounded
from ..operators.asof import band, band_pairs
from ..operators.reported import known, newest, quarters, versions
from ..session import cut, table

# The taxonomy's names of what a filing reports; later ones of a list stand in for earlier ones.
FLOWS = {
    "nii": ["NetInvestmentIncome", "InvestmentIncomeNet"], "gross_income": ["GrossInvestmentIncomeOperating"], "interest_expense": ["InterestExpense"],
    "realized": ["RealizedInvestmentGainsLosses"], "pik_income": ["InterestIncomePaidInKind"], "wavg_shares": ["WeightedAverageNumberOfSharesOutstandingBasic"],
}
EQUITY, SHARES, NAV = ["StockholdersEquity", "NetAssets"], ["CommonStockSharesOutstanding", "SharesOutstanding"], "NetAssetValuePerShare"
DEBT, LINES, NOTES = "LongTermDebt", "LineOfCredit", "NotesPayable"
STOCKS = [*EQUITY, *SHARES, NAV, DEBT, LINES, NOTES]
#: How far a tagged number of shares may be off the one implied.
OFF = 0.25


def reported(spark: SparkSession, sf: str, only_stocks: bool = False) -> DataFrame:
    """(lender, ddate, qtrs, tag, value, filed). ``only_stocks``: what is reported of a day (qtrs 0), without the flows."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    price, lender = F.col("l_extendedprice"), F.col("l_suppkey")
    q = li.join(o, li.l_orderkey == o.o_orderkey).groupBy(lender.alias("lender"), quarter_end(F.col("o_orderdate")).alias("ddate")).agg(
        exact_sum(price * F.col("l_discount")).alias("nii"), exact_sum(price * 0.125).alias("gross_income"), exact_sum(price * F.col("l_tax") * 0.5).alias("interest_expense"),
        exact_sum(F.when(F.col("l_returnflag") == "R", price * -0.0625).otherwise(0.0)).alias("realized"), exact_sum(F.when(F.col("l_tax") >= 0.07, price * 0.125).otherwise(0.0)).alias("pik_income"), exact_sum(price).alias("equity"),
    )
    lender, n = F.col("lender"), F.quarter("ddate")
    since = Window.partitionBy("lender", "tag", F.year("ddate")).orderBy("ddate")
    named = F.create_map(*(x for c in ("nii", "gross_income", "interest_expense", "realized", "pik_income") for x in (F.when(lender % 5 == 2, FLOWS[c][-1]).otherwise(FLOWS[c][0]), F.col(c))))
    flows = q.select("lender", "ddate", F.explode(named).alias("tag", "value")).withColumn("ytd", F.sum(F.col("value").cast("decimal(24,6)")).over(since).cast("double"))
    fact = lambda qtrs, value: F.struct(qtrs.cast("int").alias("qtrs"), value.alias("value"))
    single, sums = fact(F.lit(1), F.col("value")), fact(n, F.col("ytd"))
    style = F.when(lender % 3 == 0, F.array(sums)).when((lender % 3 == 1) | (n < 3), F.array(single)).when(n == 3, F.array(single, sums)).otherwise(F.array(sums))
    flows = flows.select("lender", "ddate", "tag", F.explode(style).alias("f")).select("lender", "ddate", "f.qtrs", "tag", "f.value")
    shares = F.floor(F.col("equity") / (10 + lender % 7)).cast("double")
    stocks = F.array(
        *(F.struct(F.lit(k).alias("qtrs"), F.lit(t).alias("tag"), v.alias("value")) for k, t, v in (
            (0, EQUITY[0], F.when(lender % 5 != 1, F.col("equity"))), (0, EQUITY[1], F.when(lender % 5 == 1, F.col("equity"))), (0, SHARES[0], F.when(lender % 11 == 0, shares / 1000).otherwise(shares)),
            (0, NAV, F.when(lender % 4 != 0, F.col("equity") / F.nullif(shares, F.lit(0.0)))), (0, DEBT, F.when(lender % 2 == 0, F.col("equity") * 0.75)), (0, LINES, F.when(lender % 8 == 1, F.col("equity") * 0.25)),
            (0, NOTES, F.when(lender % 8 < 6, F.col("equity") * 0.5)), (1, FLOWS["wavg_shares"][0], F.when(lender % 3 == 1, shares * 0.9375)),
        ))
    )
    stocks = q.select("lender", "ddate", F.explode(stocks).alias("f")).select("lender", "ddate", "f.qtrs", "f.tag", "f.value").filter("value IS NOT NULL")
    first = F.date_add("ddate", 40 + (lender % 30).cast("int"))
    again = F.when((lender + F.month("ddate")) % 5 == 0, F.array(F.struct(first.alias("filed"), F.lit(1.0).alias("times")), F.struct(F.date_add(first, 365).alias("filed"), F.lit(1.25).alias("times"))))
    told = (lender * 7 + F.year("ddate") * 4 + n) % 19 != 0
    every = (stocks.filter("qtrs = 0") if only_stocks else flows.unionByName(stocks)).filter(told).withColumn("v", F.explode(F.coalesce(again, F.array(F.struct(first.alias("filed"), F.lit(1.0).alias("times"))))))
    return every.select("lender", "ddate", "qtrs", "tag", (F.col("value") * F.col("v.times")).alias("value"), "v.filed")


REPORTED = f"""q AS MATERIALIZED (SELECT l_suppkey AS lender, CAST(last_day(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH) AS DATE) AS ddate, CAST(sum(CAST(l_extendedprice * l_discount AS DECIMAL(24,6))) AS DOUBLE) AS nii,
    CAST(sum(CAST(l_extendedprice * 0.125::DOUBLE AS DECIMAL(24,6))) AS DOUBLE) AS gross_income, CAST(sum(CAST(l_extendedprice * l_tax * 0.5::DOUBLE AS DECIMAL(24,6))) AS DOUBLE) AS interest_expense,
    CAST(sum(CAST(CASE WHEN l_returnflag = 'R' THEN l_extendedprice * -0.0625::DOUBLE ELSE 0 END AS DECIMAL(24,6))) AS DOUBLE) AS realized, CAST(sum(CAST(CASE WHEN l_tax >= 0.07 THEN l_extendedprice * 0.125::DOUBLE ELSE 0 END AS DECIMAL(24,6))) AS DOUBLE) AS pik_income,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(24,6))) AS DOUBLE) AS equity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
long AS ({" UNION ALL ".join(f"SELECT lender, ddate, CASE WHEN lender % 5 = 2 THEN '{FLOWS[c][-1]}' ELSE '{FLOWS[c][0]}' END AS tag, {c} AS value FROM q" for c in ("nii", "gross_income", "interest_expense", "realized", "pik_income"))}),
since AS (SELECT *, CAST(sum(CAST(value AS DECIMAL(24,6))) OVER (PARTITION BY lender, tag, year(ddate) ORDER BY ddate) AS DOUBLE) AS ytd FROM long),
flows AS (SELECT lender, ddate, 1 AS qtrs, tag, value FROM since WHERE lender % 3 = 1 OR lender % 3 = 2 AND quarter(ddate) < 4
  UNION ALL SELECT lender, ddate, quarter(ddate), tag, ytd FROM since WHERE lender % 3 = 0 OR lender % 3 = 2 AND quarter(ddate) > 2),
sized AS (SELECT *, floor(equity / (10 + lender % 7)) AS shares FROM q),
stocks AS (SELECT lender, ddate, 0 AS qtrs, CASE WHEN lender % 5 = 1 THEN 'NetAssets' ELSE 'StockholdersEquity' END AS tag, equity AS value FROM q
  UNION ALL SELECT lender, ddate, 0, 'CommonStockSharesOutstanding', CASE WHEN lender % 11 = 0 THEN shares / 1000 ELSE shares END FROM sized
  UNION ALL SELECT lender, ddate, 0, '{NAV}', equity / nullif(shares, 0) FROM sized WHERE lender % 4 <> 0
  UNION ALL SELECT lender, ddate, 0, 'LongTermDebt', equity * 0.75::DOUBLE FROM q WHERE lender % 2 = 0
  UNION ALL SELECT lender, ddate, 0, 'LineOfCredit', equity * 0.25::DOUBLE FROM q WHERE lender % 8 = 1
  UNION ALL SELECT lender, ddate, 0, 'NotesPayable', equity * 0.5::DOUBLE FROM q WHERE lender % 8 < 6
  UNION ALL SELECT lender, ddate, 1, '{FLOWS["wavg_shares"][0]}', shares * 0.9375::DOUBLE FROM sized WHERE lender % 3 = 1),
told AS (SELECT * FROM (SELECT * FROM flows UNION ALL SELECT * FROM stocks) WHERE value IS NOT NULL AND (lender * 7 + year(ddate) * 4 + quarter(ddate)) % 19 <> 0),
reported AS MATERIALIZED (SELECT lender, ddate, qtrs, tag, value, ddate + CAST(40 + lender % 30 AS INTEGER) AS filed FROM told
  UNION ALL SELECT lender, ddate, qtrs, tag, value * 1.25::DOUBLE, ddate + CAST(405 + lender % 30 AS INTEGER) FROM told WHERE (lender + month(ddate)) % 5 = 0)"""


def _first(tags: list[str]) -> Column:
    return F.coalesce(*(F.col(t) for t in tags))


def _wide(facts: DataFrame, tags: list[str]) -> DataFrame:
    return facts.groupBy("lender", "ddate").agg(*(F.max(F.when(F.col("tag") == t, F.col("value"))).alias(t) for t in tags))


def nav_per_share() -> Column:
    """The tagged value, else equity by shares."""
    return F.coalesce(F.col(NAV), ratio(_first(EQUITY), _first(SHARES)))


def navs(facts: DataFrame) -> DataFrame:
    """(lender, period, nav_ps) as filed last."""
    latest = newest(facts.filter((F.col("qtrs") == 0) & F.col("tag").isin([*EQUITY, *SHARES, NAV])), ["lender", "ddate", "tag"])
    return _wide(latest, [*EQUITY, *SHARES, NAV]).select("lender", F.col("ddate").alias("period"), nav_per_share().alias("nav_ps"))


def dividends(spark: SparkSession, sf: str) -> DataFrame:
    """(lender, date, dividend): cash a share by day."""
    return table(spark, sf, "lineitem").filter("l_linenumber = 1 AND l_quantity >= 30 AND l_discount > 0").select(F.col("l_suppkey").alias("lender"), F.to_date("l_shipdate").alias("date"), F.col("l_discount").alias("dividend"))


def measures(facts: DataFrame, paid: DataFrame) -> DataFrame:
    """Per lender and period: income of the quarter, book and debt, and what follows from them.

    facts: (lender, ddate, qtrs, tag, value, filed), undimensioned; paid: (lender, date, dividend). The
    value filed last holds. Dividends a quarter are a fourth of the last 365 days', of two payments or
    more. Numbers of shares more than ``OFF`` away from equity by net asset value are replaced by it.
    Comparisons go by date (75 to 105, 345 to 385 days), so a missing quarter is no neighbour.
    """
    # many steps begin with these, and all of them go by lender
    latest = cut(newest(facts, ["lender", "ddate", "qtrs", "tag"]))
    income = quarters(latest.filter((F.col("qtrs") > 0) & F.col("tag").isin([t for ts in FLOWS.values() for t in ts])), "lender")
    income = _wide(income, [t for ts in FLOWS.values() for t in ts]).select("lender", "ddate", *(_first(ts).alias(c) for c, ts in FLOWS.items()))
    book = _wide(latest.filter("qtrs = 0"), STOCKS)
    debt = F.coalesce(DEBT, F.when(F.col(LINES).isNotNull() | F.col(NOTES).isNotNull(), F.coalesce(LINES, F.lit(0.0)) + F.coalesce(NOTES, F.lit(0.0))))
    book = book.select("lender", "ddate", _first(EQUITY).alias("net_assets"), debt.alias("debt"), _first(SHARES).alias("tagged"), nav_per_share().alias("nav_ps"))
    implied = (F.col("nav_ps") > 0) & (F.col("net_assets") > 0) & (F.col("tagged").isNull() | (F.abs(F.col("tagged") * F.col("nav_ps") / F.col("net_assets") - 1) > OFF))
    book = cut(book.withColumn("shares", F.when(implied, F.col("net_assets") / F.col("nav_ps")).otherwise(F.col("tagged"))).drop("tagged"))
    year = band_pairs(book.select("lender", "ddate"), paid.filter("dividend > 0"), ["lender"], "ddate", "date", -364, 0).groupBy(F.col("_l.lender").alias("lender"), F.col("_l.ddate").alias("ddate"))
    year = year.agg((exact_sum(F.col("_r.dividend")) / 4).alias("div_ps"), F.count("*").alias("_n")).filter("_n >= 2").drop("_n")
    b = cut(book.join(income, ["lender", "ddate"], "left").join(year, ["lender", "ddate"], "left"))
    then = b.select("lender", F.col("ddate").alias("_p"), *(F.col(c).alias(f"{c}_then") for c in ("nav_ps", "shares", "nii")))
    b = band(b, then.select("lender", "_p", F.col("nav_ps_then").alias("nav_ps_1q")), ["lender"], "ddate", "_p", -105, -75, ["nav_ps_1q"], -75).drop("match_time")
    b = band(b, then, ["lender"], "ddate", "_p", -385, -345, ["nav_ps_then", "shares_then", "nii_then"], -345).drop("match_time")
    weighted = F.when(F.abs(F.col("wavg_shares") / F.col("shares") - 1) <= OFF, F.col("wavg_shares")).otherwise(F.col("shares"))
    nii_ps = ratio(F.col("nii"), weighted)
    change = lambda c, then: ratio(F.col(c), F.col(then)) - 1
    return b.select(
        "lender", F.col("ddate").alias("period"), "nii", "gross_income", "interest_expense", "realized", "pik_income", "net_assets", "debt", "shares", "nav_ps", "div_ps", nii_ps.alias("nii_ps"), ratio(nii_ps, F.col("div_ps")).alias("div_coverage"),
        ratio(4 * F.col("nii"), F.col("net_assets")).alias("roe"), ratio(F.col("debt"), F.col("net_assets")).alias("leverage"), ratio(4 * F.col("interest_expense"), F.col("debt")).alias("cost_of_debt"),
        ratio(4 * F.col("gross_income"), F.col("net_assets") + F.coalesce("debt", F.lit(0.0))).alias("gross_yield"), ratio(F.col("realized"), F.col("net_assets")).alias("realized_rate"), ratio(F.col("pik_income"), F.col("gross_income")).alias("pik_share"),
        change("nav_ps", "nav_ps_1q").alias("nav_chg_1q"), change("nav_ps", "nav_ps_then").alias("nav_chg_4q"), change("shares", "shares_then").alias("share_chg_4q"), change("nii", "nii_then").alias("nii_chg_4q"),
    )


AMOUNTS = ["nii", "gross_income", "interest_expense", "realized", "pik_income", "net_assets", "debt", "shares"]
RATES = ["nav_ps", "div_ps", "nii_ps", "div_coverage", "roe", "leverage", "cost_of_debt", "gross_yield", "realized_rate", "pik_share", "nav_chg_1q", "nav_chg_4q", "share_chg_4q", "nii_chg_4q"]


def fundamentals(spark: SparkSession, sf: str) -> DataFrame:
    """Income, funding, yields and their changes for every lender and quarter."""
    m = measures(reported(spark, sf), dividends(spark, sf))
    return m.select("lender", "period", *(rounded(F.col(c), 8).alias(c) for c in AMOUNTS), *(rounded(F.col(c), 7).alias(c) for c in RATES))


FUNDAMENTALS = f"""WITH {REPORTED},
latest AS MATERIALIZED (SELECT lender, ddate, qtrs, tag, arg_max(value, (filed, value)) AS value FROM reported GROUP BY 1, 2, 3, 4),
single AS (SELECT a.lender, a.ddate, a.tag, a.qtrs, CASE WHEN a.qtrs = 1 THEN a.value ELSE a.value - b.value END AS value FROM latest a
  LEFT JOIN latest b ON b.lender = a.lender AND b.tag = a.tag AND b.qtrs = a.qtrs - 1 AND a.qtrs > 1 AND date_diff('day', a.ddate, b.ddate) BETWEEN -100 AND -80 WHERE a.qtrs > 0),
income AS (SELECT lender, ddate, {", ".join(f"coalesce({', '.join(f'max(value) FILTER (WHERE tag = {t!r})' for t in ts)}) AS {c}" for c, ts in FLOWS.items())}
  FROM (SELECT lender, ddate, tag, arg_min(value, qtrs) AS value FROM single WHERE value IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
wide AS (SELECT lender, ddate, {", ".join(f"max(value) FILTER (WHERE tag = '{t}') AS {t}" for t in STOCKS)} FROM latest WHERE qtrs = 0 GROUP BY 1, 2),
book0 AS (SELECT lender, ddate, coalesce({", ".join(EQUITY)}) AS net_assets, coalesce({DEBT}, CASE WHEN {LINES} IS NOT NULL OR {NOTES} IS NOT NULL THEN coalesce({LINES}, 0) + coalesce({NOTES}, 0) END) AS debt,
  coalesce({", ".join(SHARES)}) AS tagged, coalesce({NAV}, coalesce({", ".join(EQUITY)}) / nullif(coalesce({", ".join(SHARES)}), 0)) AS nav_ps FROM wide),
book AS (SELECT lender, ddate, net_assets, debt, nav_ps, CASE WHEN nav_ps > 0 AND net_assets > 0 AND (tagged IS NULL OR abs(tagged * nav_ps / net_assets - 1) > {OFF}) THEN net_assets / nav_ps ELSE tagged END AS shares FROM book0),
paid AS (SELECT l_suppkey AS lender, CAST(l_shipdate AS DATE) AS date, l_discount AS dividend FROM lineitem WHERE l_linenumber = 1 AND l_quantity >= 30 AND l_discount > 0),
divs AS (SELECT b.lender, b.ddate, CAST(sum(CAST(dividend AS DECIMAL(24,6))) AS DOUBLE) / 4 AS div_ps FROM book b JOIN paid p ON p.lender = b.lender AND p.date > b.ddate - 365 AND p.date <= b.ddate GROUP BY 1, 2 HAVING count(*) >= 2),
b AS MATERIALIZED (SELECT * FROM book LEFT JOIN income USING (lender, ddate) LEFT JOIN divs USING (lender, ddate)),
d AS (SELECT b.*, b.nii / nullif(CASE WHEN abs(b.wavg_shares / b.shares - 1) <= {OFF} THEN b.wavg_shares ELSE b.shares END, 0) AS nii_ps, q.nav_ps AS nav_1q, y.nav_ps AS nav_4q, y.shares AS shares_4q, y.nii AS nii_4q
  FROM b LEFT JOIN b q ON q.lender = b.lender AND date_diff('day', b.ddate, q.ddate) BETWEEN -105 AND -75 LEFT JOIN b y ON y.lender = b.lender AND date_diff('day', b.ddate, y.ddate) BETWEEN -385 AND -345),
m AS (SELECT lender, ddate AS period, nii, gross_income, interest_expense, realized, pik_income, net_assets, debt, shares, nav_ps, div_ps, nii_ps, nii_ps / nullif(div_ps, 0) AS div_coverage, 4 * nii / nullif(net_assets, 0) AS roe, debt / nullif(net_assets, 0) AS leverage,
  4 * interest_expense / nullif(debt, 0) AS cost_of_debt, 4 * gross_income / nullif(net_assets + coalesce(debt, 0), 0) AS gross_yield, realized / nullif(net_assets, 0) AS realized_rate, pik_income / nullif(gross_income, 0) AS pik_share,
  nav_ps / nullif(nav_1q, 0) - 1 AS nav_chg_1q, nav_ps / nullif(nav_4q, 0) - 1 AS nav_chg_4q, shares / nullif(shares_4q, 0) - 1 AS share_chg_4q, nii / nullif(nii_4q, 0) - 1 AS nii_chg_4q FROM d)
SELECT lender, period, {", ".join(f"round({c}, 8) + 0.0 AS {c}" for c in AMOUNTS)}, {", ".join(f"round({c}, 7) + 0.0 AS {c}" for c in RATES)} FROM m"""


def nav_known(spark: SparkSession, sf: str) -> DataFrame:
    """75 and 500 days after each quarter of a lender: the newest period with a net asset value known on that day, as it was known then."""
    told = versions(reported(spark, sf, only_stocks=True), ["lender", "ddate"], [*EQUITY, *SHARES, NAV]).select("lender", "ddate", "filed", nav_per_share().alias("nav_ps"))
    asked = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("lender"), quarter_end(F.col("l_shipdate")).alias("quarter")).distinct()
    asked = asked.select("lender", "quarter", F.explode(F.array(F.date_add("quarter", 75), F.date_add("quarter", 500))).alias("day"))
    return known(asked, told, "lender", "day", "ddate", ["nav_ps"]).select("lender", "quarter", "day", F.col("ddate").alias("period"), "filed", rounded(F.col("nav_ps"), 7).alias("nav_ps"))


NAV_KNOWN = f"""WITH {REPORTED}, asked AS (SELECT DISTINCT l_suppkey AS lender, CAST(last_day(date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH) AS DATE) AS quarter FROM lineitem),
days AS (SELECT lender, quarter, quarter + unnest([75, 500]) AS day FROM asked),
seen AS (SELECT d.lender, d.quarter, d.day, r.ddate, {", ".join(f"arg_max(value, filed) FILTER (WHERE tag = '{t}') AS {t}" for t in [*EQUITY, *SHARES, NAV])}, max(filed) FILTER (WHERE tag IN ({", ".join(f"'{t}'" for t in [*EQUITY, *SHARES, NAV])})) AS filed
  FROM days d JOIN reported r ON r.lender = d.lender AND r.filed <= d.day AND r.qtrs = 0 GROUP BY 1, 2, 3, 4),
best AS (SELECT * FROM seen WHERE filed IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lender, quarter, day ORDER BY ddate DESC) = 1)
SELECT d.lender, d.quarter, d.day, b.ddate AS period, b.filed, round(coalesce({NAV}, coalesce({", ".join(EQUITY)}) / nullif(coalesce({", ".join(SHARES)}), 0)), 7) + 0.0 AS nav_ps FROM days d LEFT JOIN best b USING (lender, quarter, day)"""

QUERIES = {"fundamentals": fundamentals, "nav_known": nav_known}
SQL = {"fundamentals": FUNDAMENTALS, "nav_known": NAV_KNOWN}
