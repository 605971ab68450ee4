"""Plain relational queries: sets, tuples, ranks, strings, lists, dates, aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import first_replaced
from ..operators.agg import exact_sum, ratio, rounded
from ..operators.asof import band
from ..operators.window import first_rows
from ..session import table
from .binding import PRICES, prices


def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    """Nations of customers and suppliers: in either, in both, in one only."""
    c, s = table(spark, sf, "customer").select(F.col("c_nationkey").alias("n")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("n"))
    parts = {"either": c.union(s).distinct(), "both": c.intersect(s), "customers_only": c.subtract(s), "all_rows": c.unionAll(s)}
    out = None
    for name, df in parts.items():
        one = df.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.coalesce(F.sum(F.col("n").cast("bigint")), F.lit(0)).alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


_C, _S = "SELECT c_nationkey AS n FROM customer", "SELECT s_nationkey AS n FROM supplier"
SET_OPERATIONS = " UNION ALL ".join(f"SELECT '{k}' AS part, count(*) AS n, coalesce(CAST(sum(n) AS BIGINT), 0) AS total FROM ({q})" for k, q in {"either": f"{_C} UNION {_S}", "both": f"{_C} INTERSECT {_S}", "customers_only": f"{_C} EXCEPT {_S}", "all_rows": f"{_C} UNION ALL {_S}"}.items())


def tuple_membership(spark: SparkSession, sf: str) -> DataFrame:
    """Lines whose part and supplier also met in another order, and lines whose order has no such line."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    again = li.groupBy("l_partkey", "l_suppkey").agg(F.countDistinct("l_orderkey").alias("n")).filter("n >= 2").select("l_partkey", "l_suppkey")
    inside = li.join(again, ["l_partkey", "l_suppkey"], "left_semi")
    outside = li.join(inside.select("l_orderkey").distinct(), "l_orderkey", "left_anti")
    return inside.groupBy("l_suppkey").agg(F.count("*").alias("n_in")).join(outside.groupBy("l_suppkey").agg(F.count("*").alias("n_out")), "l_suppkey", "full").select("l_suppkey", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))


TUPLE_MEMBERSHIP = """WITH i AS (SELECT * FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT (l_partkey, l_suppkey) FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(DISTINCT l_orderkey) >= 2)),
o AS (SELECT * FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.l_orderkey = l.l_orderkey))
SELECT l_suppkey, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out FROM (SELECT l_suppkey, count(*) AS n_in FROM i GROUP BY 1) FULL JOIN (SELECT l_suppkey, count(*) AS n_out FROM o GROUP BY 1) USING (l_suppkey)"""


def top_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The last four orders of each customer, and of these the hundred largest."""
    last = first_rows(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 4)
    return last.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_custkey", "o_orderkey", "o_totalprice")


TOP_ORDERS = """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 4) ORDER BY o_totalprice DESC, o_orderkey LIMIT 100"""


def ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Rank, share of ranks, distance to the first and the next, by segment."""
    c = table(spark, sf, "customer")
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return c.select("c_custkey", F.rank().over(w).cast("bigint").alias("rank"), rounded(F.percent_rank().over(w)).alias("part"), rounded(F.max("c_acctbal").over(Window.partitionBy("c_mktsegment")) - F.col("c_acctbal"), 4).alias("behind"), F.coalesce(F.lead("c_custkey").over(w), F.lit(-1).cast("bigint")).alias("next"))


RANKS = """SELECT c_custkey, rank() OVER w AS rank, round(percent_rank() OVER w, 6) + 0.0 AS part, round(max(c_acctbal) OVER (PARTITION BY c_mktsegment) - c_acctbal, 4) + 0.0 AS behind, coalesce(lead(c_custkey) OVER w, -1) AS next
FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey)"""


def strings(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    n = F.col("p_name")
    return p.select("p_partkey", F.upper(n).alias("up"), F.split_part(n, F.lit(" "), F.lit(2)).alias("second"), F.instr(n, "e").cast("bigint").alias("at"), F.startswith(n, F.lit("red")).alias("red"), F.concat_ws("-", n, F.lower("p_brand")).alias("joined"), first_replaced(n, "e", "E").alias("once"), F.regexp_extract("p_brand", r"#(\d+)$", 1).alias("digits"), F.trim(F.substring(n, 1, 5)).alias("head"), F.length(n).cast("bigint").alias("size"), n.ilike("%RING").alias("ring"), F.format_string("%.2f", "p_retailprice").alias("price"))


STRINGS = r"""SELECT p_partkey, upper(p_name) AS up, split_part(p_name, ' ', 2) AS second, position('e' IN p_name) AS at, starts_with(p_name, 'red') AS red, concat_ws('-', p_name, lower(p_brand)) AS joined, regexp_replace(p_name, 'e', 'E') AS once,
  regexp_extract(p_brand, '#(\d+)$', 1) AS digits, trim(substr(p_name, 1, 5)) AS head, length(p_name) AS size, p_name ILIKE '%RING' AS ring, format('{:.2f}', p_retailprice) AS price FROM part"""


def lists(spark: SparkSession, sf: str) -> DataFrame:
    """Lists of an order's quantities: sorted, filtered, transformed, folded, compared."""
    l = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_quantity")).alias("q"))
    big = F.filter("q", lambda x: x > 25)
    return l.select("l_orderkey", F.size("q").cast("bigint").alias("n"), F.size(big).cast("bigint").alias("n_big"), F.aggregate(F.transform("q", lambda x: x * 2), F.lit(0.0), lambda a, x: a + x).alias("twice"), F.array_contains("q", 7.0).alias("seven"), (F.size(F.array_except(F.array(F.lit(1.0), F.lit(2.0)), "q")) == 0).alias("both"), F.array_join(F.transform("q", lambda x: x.cast("int").cast("string")), ",").alias("text"))


LISTS = """WITH l AS (SELECT l_orderkey, list_sort(list(l_quantity)) AS q FROM lineitem GROUP BY 1)
SELECT l_orderkey, len(q) AS n, len(list_filter(q, lambda x: x > 25)) AS n_big, list_sum(list_transform(q, lambda x: x * 2)) AS twice, list_contains(q, 7.0) AS seven, list_has_all(q, [1.0, 2.0]) AS both, array_to_string(list_transform(q, lambda x: CAST(CAST(x AS INT) AS VARCHAR)), ',') AS text FROM l"""


def dates(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumn("d", F.to_date("o_orderdate"))
    return o.select("o_orderkey", F.date_trunc("quarter", "d").cast("date").alias("quarter"), F.last_day("d").alias("month_end"), F.datediff(F.last_day("d"), "d").cast("bigint").alias("left"), F.year("d").cast("bigint").alias("year"), F.month("d").cast("bigint").alias("month"), F.date_add("d", 105).alias("later"), F.try_to_date(F.when(F.col("o_orderkey") % 2 == 0, F.date_format("d", "yyyyMMdd")).otherwise("junk"), "yyyyMMdd").alias("parsed"))


DATES = """SELECT o_orderkey, CAST(date_trunc('quarter', d) AS DATE) AS quarter, last_day(d) AS month_end, date_diff('day', d, last_day(d)) AS left, year(d) AS year, month(d) AS month, CAST(d + INTERVAL 105 DAY AS DATE) AS later,
  CAST(try_strptime(CASE WHEN o_orderkey % 2 = 0 THEN strftime(d, '%Y%m%d') ELSE 'junk' END, '%Y%m%d') AS DATE) AS parsed FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders)"""


def aggregates(spark: SparkSession, sf: str) -> DataFrame:
    """Medians, distinct pairs, any, all, ordered lists, conditional sums, by supplier."""
    li = table(spark, sf, "lineitem")
    flags = F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",")
    return li.groupBy("l_suppkey").agg(
        F.count("*").alias("n"), F.count_distinct(F.struct("l_returnflag", "l_linestatus")).alias("n_pairs"), F.median("l_quantity").alias("mid"), F.bool_or(F.col("l_discount") > 0.09).alias("any_high"),
        flags.alias("flags"), rounded(exact_sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice"))), 3).alias("returned"), F.max_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey")).alias("largest"), rounded(F.avg("l_tax")).alias("tax"))


AGGREGATES = """SELECT l_suppkey, count(*) AS n, count(DISTINCT (l_returnflag, l_linestatus)) AS n_pairs, median(l_quantity) AS mid, bool_or(l_discount > 0.09) AS any_high, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags,
  round(CAST(sum(CAST(l_extendedprice AS DECIMAL(24,6))) FILTER (WHERE l_returnflag = 'R') AS DOUBLE), 3) + 0.0 AS returned, arg_max(l_orderkey, (l_extendedprice, l_orderkey)) AS largest, round(avg(l_tax), 6) + 0.0 AS tax FROM lineitem GROUP BY 1"""


def quarter_flows(spark: SparkSession, sf: str) -> DataFrame:
    """Flows of a quarter out of year-to-date sums: the sum itself in the first, else less the one
    80 to 100 days before (by date, so a missing quarter gives none)."""
    p = prices(spark, sf).withColumn("period", F.last_day(F.add_months(F.date_trunc("quarter", "date").cast("date"), 2)))
    q = p.groupBy("ticker", "period").agg(exact_sum(F.col("close") * F.col("volume")).alias("flow"))
    ytd = Window.partitionBy("ticker", F.year("period")).orderBy("period")
    y = q.select("ticker", "period", F.sum(F.col("flow").cast("decimal(24,6)")).over(ytd).cast("double").alias("ytd"))
    before = y.select("ticker", F.col("period").alias("p"), F.col("ytd").alias("before"))
    j = band(y, before, ["ticker"], "period", "p", -100, -80, ["before"], -90).drop("match_time")
    flow = F.when(F.month("period") == 3, F.col("ytd")).otherwise(F.col("ytd") - F.col("before"))
    return j.select("ticker", "period", rounded(F.col("ytd"), 3).alias("ytd"), rounded(flow, 3).alias("flow"))


QUARTER_FLOWS = f"""WITH {PRICES}, q AS (SELECT ticker, CAST(last_day(date_trunc('quarter', date) + INTERVAL 2 MONTH) AS DATE) AS period, CAST(sum(CAST(close * volume AS DECIMAL(24,6))) AS DOUBLE) AS flow FROM prices GROUP BY 1, 2),
y AS (SELECT ticker, period, CAST(sum(CAST(flow AS DECIMAL(24,6))) OVER (PARTITION BY ticker, year(period) ORDER BY period) AS DOUBLE) AS ytd FROM q)
SELECT y.ticker, y.period, round(y.ytd, 3) + 0.0 AS ytd, round(CASE WHEN month(y.period) = 3 THEN y.ytd ELSE y.ytd - b.ytd END, 3) + 0.0 AS flow FROM y LEFT JOIN y b ON b.ticker = y.ticker AND date_diff('day', y.period, b.period) BETWEEN -100 AND -80"""


def coverage_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Orders to read again: detail is 50 to 97 % of the total, and no urgent order is done already."""
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    detail = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(exact_sum(F.col("l_extendedprice")).alias("detail"))
    done = o.filter("o_orderpriority = '1-URGENT'").select("o_orderkey")
    c = ratio(F.col("detail"), F.col("o_totalprice"))
    return o.join(detail, "o_orderkey").filter(c.between(0.5, 0.97)).join(done, "o_orderkey", "left_anti").select("o_orderkey", rounded(c).alias("coverage"))


COVERAGE_GAPS = """SELECT o_orderkey, round(detail / nullif(o_totalprice, 0), 6) + 0.0 AS coverage FROM orders JOIN (SELECT l_orderkey AS o_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(24,6))) AS DOUBLE) AS detail FROM lineitem GROUP BY 1) USING (o_orderkey)
WHERE detail / nullif(o_totalprice, 0) BETWEEN 0.5 AND 0.97 AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')"""

QUERIES = {"set_operations": set_operations, "tuple_membership": tuple_membership, "top_orders": top_orders, "ranks": ranks, "strings": strings, "lists": lists, "dates": dates, "aggregates": aggregates, "quarter_flows": quarter_flows, "coverage_gaps": coverage_gaps}
SQL = {"set_operations": SET_OPERATIONS, "tuple_membership": TUPLE_MEMBERSHIP, "top_orders": TOP_ORDERS, "ranks": RANKS, "strings": STRINGS, "lists": LISTS, "dates": DATES, "aggregates": AGGREGATES, "quarter_flows": QUARTER_FLOWS, "coverage_gaps": COVERAGE_GAPS}
