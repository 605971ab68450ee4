"""Streams over the star-schema tables, run to their end; results stand in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import issuer_key, line_key
from ..operators.agg import exact_sum, rounded
from ..session import shared_folder, table
from ..sources.bulk import conformed, delimited, load
from ..streaming.streams import enter, ingest, link_stream, restate, restated, retry
from .binding import FACTS, PRICES, holdings, prices


def _folder(spark: SparkSession) -> str:
    """A new folder under the one that the cluster shares."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _landed(spark: SparkSession, sf: str, at: str) -> tuple[str, T.StructType]:
    """The events as files in a landing folder."""
    events = table(spark, sf, "events")
    events.repartition(4, "event_id").write.parquet(f"{at}/in")
    return f"{at}/in", events.schema


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Events appended by a file stream, run twice: the second run finds nothing new."""
    at = _folder(spark)
    source, schema = _landed(spark, sf, at)
    for _ in range(2):
        ingest(spark, source, schema, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("event_type").agg(F.count("*").alias("n"), rounded(exact_sum(F.col("value")), 2).alias("value"))


STREAM_INGEST = "SELECT event_type, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(24,6))) AS DOUBLE), 2) + 0.0 AS value FROM events GROUP BY 1"


def stream_restate(spark: SparkSession, sf: str) -> DataFrame:
    """The value filed last for each user and type, kept up by a stream."""
    at = _folder(spark)
    source, schema = _landed(spark, sf, at)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(source)
    query = restate(stream, ["user_id", "event_type"], "value", "ts", f"{at}/out", f"{at}/checkpoint")
    query.awaitTermination()
    last = max((p["batchId"] for p in query.recentProgress if p["numInputRows"]), default=0)
    return restated(spark, f"{at}/out", last).select("user_id", "event_type", "value")


STREAM_RESTATE = "SELECT user_id, event_type, arg_max(value, (ts, value)) AS value FROM events WHERE value IS NOT NULL GROUP BY 1, 2"


def stream_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Events per day and type by tumbling windows with a watermark, complete at the end."""
    at = _folder(spark)
    source, schema = _landed(spark, sf, at)
    stream = spark.readStream.schema(schema).parquet(source).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = stream.withWatermark("ts", "2 days").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))

    def keep(batch: DataFrame, n: int) -> None:
        batch.select(F.to_date("w.start").alias("day"), "event_type", "n").write.mode("overwrite").parquet(f"{at}/out")

    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")


STREAM_DAILY = f"WITH {FACTS} SELECT ddate AS day, tag AS event_type, count(*) AS n FROM facts GROUP BY 1, 2"


def stream_link(spark: SparkSession, sf: str) -> DataFrame:
    """Holdings linked by a stream that keeps each lender's last period; counts by stage."""
    at, h = _folder(spark), holdings(spark, sf)
    ident = F.concat(F.col("borrower"), F.when(F.quarter("period") % 2 == 0, " | term loan").otherwise(" | loan"))
    rows = h.select("lender", "period", ident.alias("identifier"), F.lit("").alias("entity"), line_key(ident).alias("key"), issuer_key(F.col("borrower")).alias("issuer"), F.col("itype").alias("kind"), F.lit("").alias("subtype"), F.lit("").alias("maturity"), F.lit(True).alias("debt"), F.col("cost").alias("amount"))
    rows.write.parquet(f"{at}/in")
    linked = link_stream(spark.readStream.schema(rows.schema).parquet(f"{at}/in"))
    linked.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("lender", "match_method").agg(F.count("*").alias("n"), F.countDistinct("loan_id").alias("n_loans"))


def stream_entry(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as they arrive, each entered at its nation's first price after it, a week later at most."""
    at, o, c = _folder(spark), table(spark, sf, "orders"), table(spark, sf, "customer")
    filed = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", F.col("c_nationkey").alias("ticker"), F.to_date("o_orderdate").alias("filed"))
    filed.repartition(3, "o_orderkey").write.parquet(f"{at}/in")
    quotes = prices(spark, sf).select("ticker", F.col("date").alias("day"), F.col("close").alias("entry"))
    stream = spark.readStream.schema(filed.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    enter(stream, quotes, ["ticker"], "filed", "day", "entry", f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/out").select("o_orderkey", F.col("match_time").alias("day"), rounded(F.col("entry"), 4).alias("entry"))


STREAM_ENTRY = f"""WITH {PRICES} SELECT o_orderkey, p.date AS day, round(p.close, 4) + 0.0 AS entry FROM (SELECT *, CAST(o_orderdate AS DATE) AS filed FROM orders JOIN customer ON o_custkey = c_custkey) o
  ASOF JOIN prices p ON o.c_nationkey = p.ticker AND o.filed < p.date WHERE date_diff('day', filed, p.date) <= 7"""


def stream_letters(spark: SparkSession, sf: str) -> DataFrame:
    """Events whose JSON holds a number, and those that stay without one after every try."""
    at = _folder(spark)
    source, schema = _landed(spark, sf, at)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    odd = F.when(F.col("event_id") % 7 == 0, F.lit("{")).otherwise(F.col("props"))
    retry(stream.select("event_id", "event_type", odd.alias("props")), lambda rows: rows.withColumn("parsed", F.get_json_object("props", "$.k").cast("bigint")), "parsed", f"{at}/out", f"{at}/checkpoint", tries=2).awaitTermination()
    whole = lambda name: spark.read.parquet(f"{at}/out/{name}").select("event_id", "event_type", F.lit(name).alias("kind"))
    dead = whole("dead").unionByName(whole("waiting").withColumn("kind", F.lit("dead"))).distinct()
    return whole("good").unionByName(dead).groupBy("event_type", "kind").agg(F.count("*").alias("n"))


STREAM_LETTERS = """SELECT event_type, CASE WHEN event_id % 7 <> 0 AND json_extract_string(props, '$.k') IS NOT NULL THEN 'good' ELSE 'dead' END AS kind, count(*) AS n FROM events GROUP BY 1, 2"""


def tsv_load(spark: SparkSession, sf: str) -> DataFrame:
    """Parts written as tab-separated text with blanks and odd columns, read back by name and cast."""
    at, part = _folder(spark), table(spark, sf, "part")
    odd = part.select(F.col("p_size").alias("P_SIZE"), "p_partkey", F.concat(F.lit('"'), F.col("p_name")).alias("p_name"), F.when(F.col("p_partkey") % 10 == 0, " ").otherwise(F.col("p_retailprice").cast("string")).alias("p_retailprice"), F.lit("x").alias("extra"))
    odd.write.option("sep", "\t").option("header", True).option("quote", "\u0000").option("escapeQuotes", False).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{at}/in")
    schema = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_name", T.StringType()), T.StructField("p_size", T.IntegerType()), T.StructField("p_retailprice", T.DoubleType()), T.StructField("missing", T.DateType()), T.StructField("source_file", T.StringType())])
    for _ in range(2):  # loading again replaces the file's own partition
        load(conformed(delimited(spark, f"{at}/in"), schema, F.lit("part.tsv")), f"{at}/out")
    back = spark.read.parquet(f"{at}/out")
    return back.select("p_partkey", "p_name", "p_size", "p_retailprice", F.col("missing").isNull().alias("absent"), F.col("source_file").cast("string").alias("source_file"))


TSV_LOAD = """SELECT p_partkey, '"' || p_name AS p_name, p_size, CASE WHEN p_partkey % 10 <> 0 THEN p_retailprice END AS p_retailprice, true AS absent, 'part.tsv' AS source_file FROM part"""

QUERIES = {"stream_ingest": stream_ingest, "stream_restate": stream_restate, "stream_daily": stream_daily, "stream_link": stream_link, "stream_entry": stream_entry, "stream_letters": stream_letters, "tsv_load": tsv_load}
SQL = {"stream_ingest": STREAM_INGEST, "stream_restate": STREAM_RESTATE, "stream_daily": STREAM_DAILY, "stream_entry": STREAM_ENTRY, "stream_letters": STREAM_LETTERS, "tsv_load": TSV_LOAD}
