"""The star-schema tables seen as a credit book, and the same views in SQL.

Lender is the supplier, borrower the part's name, a holding is what a lender has of a borrower at a
quarter's end; prices are orders by nation and day; facts are events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import quarter_end
from ..operators.agg import exact_sum, ratio
from ..session import table


#: Where a build has written the holdings of a folder of tables, by session and folder.
WRITTEN: dict[tuple[str, str], str] = {}


def holdings(spark: SparkSession, sf: str, dealt: bool = False) -> DataFrame:
    """(lender, period, borrower): itype, sector, cost, fv, mark, nonaccrual, pik, rate, spread, maturity.

    Inside a build, the table that its first stage wrote; else from the base tables. ``dealt``: lines are
    dealt to lenders once, so that all that goes by lender and more stays there.
    """
    written = WRITTEN.get((spark.sparkContext.applicationId, sf))
    return spark.read.parquet(written) if written else computed_holdings(spark, sf, dealt)


def computed_holdings(spark: SparkSession, sf: str, dealt: bool = False) -> DataFrame:
    li, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    price = F.col("l_extendedprice")
    j = li.join(part, li.l_partkey == part.p_partkey).withColumn("lender", F.col("l_suppkey"))
    j = (j.repartition("lender") if dealt else j).withColumn("period", quarter_end(F.col("l_shipdate")))
    h = j.groupBy("lender", "period", F.col("p_name").alias("borrower")).agg(
        F.min("p_type").alias("itype"),
        F.min("p_brand").alias("sector"),
        exact_sum(price).alias("cost"),
        exact_sum(price * (1 - F.col("l_discount"))).alias("fv"),
        F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("nonaccrual"),
        (F.coalesce(exact_sum(F.when(F.col("l_tax") >= 0.07, price)), F.lit(0.0)) > 0.5 * exact_sum(price)).alias("pik"),
        F.max("l_tax").alias("rate"),
        F.max("l_discount").alias("spread"),
        F.max(F.add_months(F.col("l_shipdate").cast("date"), F.col("p_size"))).alias("maturity"),
    )
    return h.withColumn("mark", ratio(F.col("fv"), F.col("cost")))


HOLDINGS = """holdings AS (
  SELECT *, fv / nullif(cost, 0) AS mark FROM (
    SELECT l_suppkey AS lender, CAST(last_day(date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH) AS DATE) AS period, p_name AS borrower,
           min(p_type) AS itype, min(p_brand) AS sector,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(24,6))) AS DOUBLE) AS cost,
           CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(24,6))) AS DOUBLE) AS fv,
           bool_or(l_returnflag = 'R' AND l_linestatus = 'F') AS nonaccrual,
           coalesce(CAST(sum(CAST(CASE WHEN l_tax >= 0.07 THEN l_extendedprice END AS DECIMAL(24,6))) AS DOUBLE), 0)
             > 0.5 * CAST(sum(CAST(l_extendedprice AS DECIMAL(24,6))) AS DOUBLE) AS pik,
           max(l_tax) AS rate, max(l_discount) AS spread, max(CAST(CAST(l_shipdate AS DATE) + to_months(p_size) AS DATE)) AS maturity
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3))"""


def facts(spark: SparkSession, sf: str) -> DataFrame:
    """Entity-attribute-value rows: entity, tag, ddate, ts, value."""
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("entity"), F.col("event_type").alias("tag"), F.to_date("ts").alias("ddate"), "ts", "value", "event_id", "props")


FACTS = "facts AS (SELECT user_id AS entity, event_type AS tag, CAST(ts AS DATE) AS ddate, ts, value, event_id, props FROM events)"


def prices(spark: SparkSession, sf: str) -> DataFrame:
    """(ticker, date): close, volume."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    p = j.groupBy(F.col("c_nationkey").alias("ticker"), F.to_date("o_orderdate").alias("date")).agg(exact_sum(F.col("o_totalprice")).alias("amount"), F.count("*").alias("volume"))
    return p.select("ticker", "date", (F.col("amount") / F.col("volume")).alias("close"), F.col("volume").cast("double").alias("volume"))


PRICES = """prices AS (
  SELECT c_nationkey AS ticker, CAST(o_orderdate AS DATE) AS date,
         CAST(sum(CAST(o_totalprice AS DECIMAL(24,6))) AS DOUBLE) / count(*) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def lenders(spark: SparkSession, sf: str) -> DataFrame:
    """Lender, its name and its manager (the nation)."""
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("lender"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("manager"), F.col("s_acctbal").alias("balance"))


LENDERS = "lenders AS (SELECT s_suppkey AS lender, s_name AS name, s_nationkey AS manager, s_acctbal AS balance FROM supplier)"


def line_items(spark: SparkSession, sf: str) -> DataFrame:
    """Free-text line items of every shipped line: lender, order, text, cost."""
    li, part, s = table(spark, sf, "lineitem"), table(spark, sf, "part"), table(spark, sf, "supplier")
    j = li.join(part, li.l_partkey == part.p_partkey).join(s, li.l_suppkey == s.s_suppkey)
    text = F.concat(F.col("s_name"), F.lit(" Inc. | "), F.initcap("p_type"), F.lit(" loan "), F.col("l_linenumber").cast("string"), F.lit(" due "), F.date_format("l_shipdate", "M/yyyy"))
    return j.select(F.col("l_suppkey").alias("lender"), F.col("l_orderkey").alias("order"), text.alias("text"), F.col("l_extendedprice").alias("cost"))


LINE_ITEMS = """line_items AS (
  SELECT l_suppkey AS lender, l_orderkey AS "order",
         s_name || ' Inc. | ' || upper(p_type[1]) || lower(p_type[2:]) || ' loan ' || l_linenumber || ' due ' || month(l_shipdate) || '/' || year(l_shipdate) AS text,
         l_extendedprice AS cost
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""
