"""From facts and free-text line items to clean holdings: pivots, repairs, rules, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import any_date
from ..functions.numbers import document_number, fixed_rate
from ..functions.shards import fnv1a, shard
from ..functions.text import camel_words, instrument_class, instrument_subtype, is_debt, is_total, issuer_key, learn_phrases, line_key, maturity_text, parse_line_items
from ..operators.agg import exact_sum, latest, pivot_facts, ratio, rounded
from ..operators.ledger import exclude, leaves, subtotals, twins
from ..operators.subset import choice_sql, reconcile
from ..operators.window import first_rows
from ..session import cut, table
from .binding import FACTS, HOLDINGS, LINE_ITEMS, facts, holdings, line_items

TAGS = ["click", "view", "purchase", "error", "signup"]


def eav_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """One row per entity and day: distinct amounts summed, the peak, the last value by time."""
    p = pivot_facts(facts(spark, sf), ["entity", "ddate"], "tag", "value", sums=["purchase", "click"], peaks=["view"], lasts=["error"], by="ts")
    return p.select("entity", "ddate", *(rounded(F.col(c)).alias(f"{c}_value") for c in ("purchase", "click", "view", "error")))


EAV_PIVOT = f"""WITH {FACTS}, once AS (SELECT entity, ddate, tag, value, max(ts) AS ts FROM facts WHERE tag IN ('purchase', 'click', 'view', 'error') GROUP BY 1, 2, 3, 4)
SELECT entity, ddate, round(CAST(sum(CAST(value AS DECIMAL(24,6))) FILTER (WHERE tag = 'purchase') AS DOUBLE), 6) + 0.0 AS purchase_value,
  round(CAST(sum(CAST(value AS DECIMAL(24,6))) FILTER (WHERE tag = 'click') AS DOUBLE), 6) + 0.0 AS click_value,
  round(max(value) FILTER (WHERE tag = 'view'), 6) + 0.0 AS view_value, round(arg_max(value, (ts, value)) FILTER (WHERE tag = 'error'), 6) + 0.0 AS error_value
FROM once GROUP BY 1, 2"""


def latest_value_wins(spark: SparkSession, sf: str) -> DataFrame:
    """The last value of each tag per entity, and when it was filed."""
    f = facts(spark, sf)
    by = [F.col("ts"), F.col("event_id")]
    return f.groupBy("entity", "tag").agg(latest(F.col("value"), *by).alias("value"), F.max("ddate").alias("ddate"), F.count("*").alias("n"))


LATEST_VALUE_WINS = f"WITH {FACTS} SELECT entity, tag, arg_max(value, (ts, event_id)) AS value, max(ddate) AS ddate, count(*) AS n FROM facts GROUP BY 1, 2"


def rate_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Rates given as fraction, percent or basis points, by line number, read back as fractions."""
    li = table(spark, sf, "lineitem")
    given = F.col("l_tax") * F.when(F.col("l_linenumber") % 3 == 0, 10000.0).when(F.col("l_linenumber") % 3 == 1, 100.0).otherwise(1.0)
    r = li.select("l_suppkey", given.alias("given"), fixed_rate(given).alias("rate"))
    return r.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.abs("given") > 1).alias("n_fixed"), rounded(exact_sum(F.col("rate")), 5).alias("sum_rate"), F.count_if(F.col("rate") > 0.3).alias("n_high"))


RATE_REPAIR = """SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE abs(given) > 1) AS n_fixed, round(CAST(sum(CAST(rate AS DECIMAL(24,6))) AS DOUBLE), 5) + 0.0 AS sum_rate, count(*) FILTER (WHERE rate > 0.3) AS n_high
FROM (SELECT l_suppkey, given, CASE WHEN abs(given) > 100 THEN given / 10000.0 WHEN abs(given) > 1 THEN given / 100.0 ELSE given END AS rate
  FROM (SELECT l_suppkey, l_tax * CASE WHEN l_linenumber % 3 = 0 THEN 10000.0::DOUBLE WHEN l_linenumber % 3 = 1 THEN 100.0::DOUBLE ELSE 1.0::DOUBLE END AS given FROM lineitem)) GROUP BY 1"""


def reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    """Detail against the reported total, per order, with a status by coverage."""
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    detail = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(exact_sum(F.col("l_extendedprice")).alias("detail"), F.count("*").alias("n_lines"))
    j = o.select("o_orderkey", F.col("o_totalprice").alias("total")).join(detail, "o_orderkey", "full").withColumn("coverage", ratio(F.col("detail"), F.col("total")))
    status = F.when(F.col("total").isNull(), "no_total").when(F.col("detail").isNull(), "no_detail").when(F.col("coverage").between(0.9, 1.1), "ok").when(F.col("coverage") < 0.9, "short").otherwise("over")
    return j.select("o_orderkey", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), rounded(F.col("detail"), 4).alias("detail"), "total", rounded(F.col("coverage")).alias("coverage"), status.alias("status"))


RECONCILIATION = """SELECT o_orderkey, coalesce(n_lines, 0) AS n_lines, round(detail, 4) + 0.0 AS detail, total, round(coverage, 6) + 0.0 AS coverage,
  CASE WHEN total IS NULL THEN 'no_total' WHEN detail IS NULL THEN 'no_detail' WHEN coverage BETWEEN 0.9 AND 1.1 THEN 'ok' WHEN coverage < 0.9 THEN 'short' ELSE 'over' END AS status
FROM (SELECT *, detail / nullif(total, 0) AS coverage FROM (SELECT o_orderkey, o_totalprice AS total FROM orders)
  FULL JOIN (SELECT l_orderkey AS o_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(24,6))) AS DOUBLE) AS detail, count(*) AS n_lines FROM lineitem GROUP BY 1) USING (o_orderkey))"""


def reported_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Of several candidate totals the one nearest to the reference amount, by priority on ties."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    per = lambda e, p: li.groupBy("l_orderkey").agg(exact_sum(e).alias("total")).withColumn("prio", F.lit(p))
    price = F.col("l_extendedprice")
    cands = per(price, 1).unionByName(per(price * (1 - F.col("l_discount")), 2)).unionByName(per(price * (1 - F.col("l_discount")) * (1 + F.col("l_tax")), 3))
    j = cands.join(o.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("assets")), "l_orderkey")
    off = F.abs(ratio(F.col("total"), F.col("assets")) - 1) + F.col("prio") * 0.001
    j = j.filter(ratio(F.col("total"), F.col("assets")).between(0.3, 1.2)).withColumn("off", off)
    return j.groupBy("l_orderkey").agg(F.min_by(F.struct("total", "prio"), F.struct("off", "prio")).alias("b")).select("l_orderkey", F.col("b.total").alias("total"), F.col("b.prio").alias("prio"))


_TOTAL = "SELECT l_orderkey, CAST(sum(CAST({e} AS DECIMAL(24,6))) AS DOUBLE) AS total, {p} AS prio FROM lineitem GROUP BY 1"
REPORTED_TOTALS = f"""WITH c AS ({_TOTAL.format(e="l_extendedprice", p=1)} UNION ALL {_TOTAL.format(e="l_extendedprice * (1 - l_discount)", p=2)} UNION ALL {_TOTAL.format(e="l_extendedprice * (1 - l_discount) * (1 + l_tax)", p=3)})
SELECT l_orderkey, total, prio FROM c JOIN orders ON o_orderkey = l_orderkey WHERE total / nullif(o_totalprice, 0) BETWEEN 0.3 AND 1.2
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(total / nullif(o_totalprice, 0) - 1) + prio * 0.001::DOUBLE, prio) = 1"""


def period_source(spark: SparkSession, sf: str) -> DataFrame:
    """The best filing of each customer and quarter: complete first, then the largest, then the newest."""
    o = table(spark, sf, "orders").withColumn("quarter", F.date_trunc("quarter", "o_orderdate").cast("date"))
    order = [F.desc(F.col("o_orderstatus") == "F"), F.desc("o_totalprice"), F.desc("o_orderdate"), F.asc("o_orderkey")]
    return first_rows(o, ["o_custkey", "quarter"], order).select("o_custkey", "quarter", "o_orderkey", "o_orderstatus")


PERIOD_SOURCE = """SELECT o_custkey, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, o_orderkey, o_orderstatus FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey, date_trunc('quarter', o_orderdate) ORDER BY (o_orderstatus = 'F') DESC, o_totalprice DESC, o_orderdate DESC, o_orderkey) = 1"""


def punct_dupe(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose letters and digits repeat those of one with a smaller id in the same source."""
    d = table(spark, sf, "documents").select("doc_id", "source", "text")
    return twins(d, ["source"], "text", [F.col("doc_id")]).select("doc_id", "source")


PUNCT_DUPE = """SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') ORDER BY doc_id) > 1"""


def fv_only_twin(spark: SparkSession, sf: str) -> DataFrame:
    """Lines without tax that repeat the price of a taxed line of the order, same part or same start."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    a = li.filter("l_tax = 0").select("l_suppkey", "l_shipdate", F.col("l_orderkey").alias("a_order"), F.col("l_linenumber").alias("a_line"), F.col("p_brand").alias("a_brand"), F.col("p_name").alias("a_name"))
    b = li.filter("l_tax > 0").select("l_suppkey", "l_shipdate", F.col("p_brand").alias("b_brand"), F.col("p_name").alias("b_name"))
    same = (F.col("a_brand") == F.col("b_brand")) | (F.substring("a_name", 1, 3) == F.substring("b_name", 1, 3))
    return a.join(b, ["l_suppkey", "l_shipdate"]).filter(same).groupBy("a_order", "a_line", "l_suppkey").agg(F.count("*").alias("n"))


FV_ONLY_TWIN = """WITH li AS (SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT a.l_orderkey AS a_order, a.l_linenumber AS a_line, a.l_suppkey, count(*) AS n FROM li a JOIN li b ON a.l_suppkey = b.l_suppkey AND a.l_shipdate = b.l_shipdate
WHERE a.l_tax = 0 AND b.l_tax > 0 AND (a.p_brand = b.p_brand OR a.p_name[1:3] = b.p_name[1:3]) GROUP BY 1, 2, 3"""


def _book(spark: SparkSession, sf: str, dealt: bool = False) -> DataFrame:
    """Lines as (order, text, amount), with a subtotal line for each type and some single ones.

    ``dealt``: lines are dealt to orders once, so that all that goes by order and more stays there.
    """
    li, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    lines = li.join(part, li.l_partkey == part.p_partkey).select(F.col("l_orderkey").alias("filing"), F.concat_ws(" | ", "p_type", F.concat(F.col("p_name"), F.lit(" "), F.col("l_partkey").cast("string")), F.col("l_linenumber").cast("string")).alias("text"), F.col("p_type").alias("head"), F.col("l_extendedprice").alias("amount"))
    lines = (lines.repartition("filing") if dealt else lines).groupBy("filing", "text", "head").agg(exact_sum(F.col("amount")).alias("amount"))
    heads = lines.groupBy("filing", F.col("head").alias("text")).agg(exact_sum(F.col("amount")).alias("amount"))
    return lines.select("filing", "text", "amount").unionByName(heads)


BOOK = """lines AS (SELECT l_orderkey AS filing, p_type || ' | ' || p_name || ' ' || l_partkey || ' | ' || l_linenumber AS text, p_type AS head, CAST(sum(CAST(l_extendedprice AS DECIMAL(24,6))) AS DOUBLE) AS amount
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
book AS (SELECT filing, text, amount FROM lines UNION ALL SELECT filing, head, CAST(sum(CAST(amount AS DECIMAL(24,6))) AS DOUBLE) FROM lines GROUP BY 1, 2)"""


def issuer_subtotal(spark: SparkSession, sf: str) -> DataFrame:
    """Heads that equal the sum of two or more lines that start with them."""
    return subtotals(_book(spark, sf), ["filing"], "text", ["amount"])


# a row and those below its name meet in one grouping; names are unique in a filing
ISSUER_SUBTOTAL = f"""WITH {BOOK.replace("AS (SELECT", "AS MATERIALIZED (SELECT")},
met AS (SELECT filing, text, amount, NULL AS below FROM book
  UNION ALL SELECT filing, split_part(text, ' | ', 1), NULL, amount FROM book WHERE contains(text, ' | ')
  UNION ALL SELECT filing, split_part(text, ' | ', 1) || ' | ' || split_part(text, ' | ', 2), NULL, amount FROM book WHERE contains(text, ' | ')),
sums AS (SELECT filing, text, max(amount) AS amount, count(below) AS n, CAST(sum(CAST(below AS DECIMAL(24,6))) AS DOUBLE) AS s FROM met GROUP BY 1, 2)
SELECT filing, text, n FROM sums WHERE n >= 2 AND abs(amount - s) <= 0.01::DOUBLE * abs(s)"""


def heading_subtotal(spark: SparkSession, sf: str) -> DataFrame:
    """Live amount and dropped heads per filing once subtotals are gone."""
    book = _book(spark, sf, dealt=True)
    sub = subtotals(book, ["filing"], "text", ["amount"], least=1)
    live = book.join(sub, ["filing", "text"], "left_anti")
    return cut(live.groupBy("filing").agg(F.count("*").alias("n_live"), rounded(exact_sum(F.col("amount")), 4).alias("live")), dealt=True)


HEADING_SUBTOTAL = f"""WITH {BOOK}, child AS (SELECT filing, unnest([split_part(text, ' | ', 1), split_part(text, ' | ', 1) || ' | ' || split_part(text, ' | ', 2)]) AS text, amount FROM book WHERE contains(text, ' | ')),
sums AS (SELECT filing, text, count(*) AS n, CAST(sum(CAST(amount AS DECIMAL(24,6))) AS DOUBLE) AS s FROM child GROUP BY 1, 2)
SELECT filing, count(*) AS n_live, round(CAST(sum(CAST(amount AS DECIMAL(24,6))) AS DOUBLE), 4) + 0.0 AS live FROM book
WHERE NOT EXISTS (SELECT 1 FROM sums WHERE sums.filing = book.filing AND sums.text = book.text AND abs(book.amount - s) <= 0.01::DOUBLE * abs(s)) GROUP BY 1"""


def exclusion_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Lines taken out by ordered rules, each on what the ones before left; counts by reason."""
    rows = table(spark, sf, "lineitem").select(F.xxhash64(*table(spark, sf, "lineitem").columns).alias("key"), "l_orderkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    rules = [
        ("no_values", lambda d: d.filter((F.col("l_discount") == 0) & (F.col("l_tax") == 0))),
        ("small", lambda d: d.filter(F.col("l_quantity") <= 2)),
        ("order_repeat", lambda d: d.withColumn("_rn", F.row_number().over(Window.partitionBy("l_orderkey", "l_suppkey").orderBy(F.desc("l_extendedprice"), "key"))).filter("_rn > 1")),
        ("outlier", lambda d: d.join(d.groupBy("l_suppkey").agg(F.max("l_extendedprice").alias("l_extendedprice")), ["l_suppkey", "l_extendedprice"], "left_semi")),
    ]
    _, ledger = exclude(rows, ["key"], rules)
    return ledger.groupBy("reason").agg(F.count("*").alias("n"))


EXCLUSION_LEDGER = """WITH r0 AS (SELECT DISTINCT * FROM lineitem),
r1 AS (SELECT * FROM r0 WHERE NOT (l_discount = 0 AND l_tax = 0)), r2 AS (SELECT * FROM r1 WHERE l_quantity > 2),
r3 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_extendedprice DESC) AS rn FROM r2),
r4 AS (SELECT * FROM r3 WHERE rn = 1)
SELECT 'no_values' AS reason, count(*) AS n FROM r0 WHERE l_discount = 0 AND l_tax = 0 UNION ALL SELECT 'small', count(*) FROM r1 WHERE l_quantity <= 2
UNION ALL SELECT 'order_repeat', count(*) FROM r3 WHERE rn > 1 UNION ALL SELECT 'outlier', count(*) FROM r4 WHERE (l_suppkey, l_extendedprice) IN (SELECT (l_suppkey, max(l_extendedprice)) FROM r4 GROUP BY l_suppkey)"""


def superset_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """Orders' part-type sets within a customer that no other order's set contains."""
    li, part, o = table(spark, sf, "lineitem"), table(spark, sf, "part"), table(spark, sf, "orders")
    j = li.join(part, li.l_partkey == part.p_partkey).join(o, li.l_orderkey == o.o_orderkey)
    sets = j.groupBy("o_custkey", "o_orderkey").agg(F.collect_set("p_type").alias("tokens"))
    return leaves(sets, ["o_custkey"], "o_orderkey", "tokens").select("o_custkey", "o_orderkey", F.size("tokens").cast("bigint").alias("n"))


SUPERSET_LEAVES = """WITH s AS (SELECT o_custkey, o_orderkey, list(DISTINCT p_type) AS t FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT o_custkey, o_orderkey, len(t) AS n FROM s WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.o_custkey = s.o_custkey AND b.o_orderkey <> s.o_orderkey AND len(b.t) > len(s.t) AND list_has_all(b.t, s.t))"""


def unit_fixes(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts a thousand times too large, found by their ratio to quantity, and the repaired sums."""
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_quantity", (F.col("l_extendedprice") * F.when(F.col("l_linenumber") == 7, 1000.0).otherwise(1.0)).alias("amount"))
    each = F.col("amount") / F.col("l_quantity")
    mid = li.groupBy("l_suppkey").agg(F.median(each).alias("mid"))
    j = li.join(mid, "l_suppkey")
    off = each / F.col("mid")
    fixed = F.when(off.between(200, 5000), F.col("amount") / 1000.0).otherwise(F.col("amount"))
    return j.groupBy("l_suppkey").agg(F.count_if(off.between(200, 5000)).alias("n_fixed"), rounded(exact_sum(fixed), 3).alias("total"), rounded(F.max("mid"), 4).alias("mid"))


UNIT_FIXES = """WITH li AS (SELECT l_suppkey, l_quantity, l_extendedprice * CASE WHEN l_linenumber = 7 THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END AS amount FROM lineitem),
m AS (SELECT l_suppkey, median(amount / l_quantity) AS mid FROM li GROUP BY 1)
SELECT l_suppkey, count(*) FILTER (WHERE amount / l_quantity / mid BETWEEN 200 AND 5000) AS n_fixed,
  round(CAST(sum(CAST(CASE WHEN amount / l_quantity / mid BETWEEN 200 AND 5000 THEN amount / 1000.0::DOUBLE ELSE amount END AS DECIMAL(24,6))) AS DOUBLE), 3) + 0.0 AS total, round(max(mid), 4) + 0.0 AS mid
FROM li JOIN m USING (l_suppkey) GROUP BY 1"""

NEGATIVE, POSITIVE = r"\b(the|and)\b", r"\b(for|with|that)\b"


def footnote_agg(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of a conversation as footnotes: split, distinct, joined in order, flagged by wording."""
    c = table(spark, sf, "conversations")
    notes = c.select("conv_id", F.explode(F.split("text", r"\n")).alias("note")).withColumn("note", F.trim("note")).filter("note <> ''").distinct()
    flag = (F.length("note") < 400) & F.col("note").rlike(POSITIVE) & ~F.col("note").rlike(NEGATIVE)
    return notes.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("note")), " || ").alias("notes"), F.bool_or(flag).alias("flagged"))


FOOTNOTE_AGG = rf"""WITH n AS (SELECT DISTINCT conv_id, trim(unnest(string_split(text, chr(10)))) AS note FROM conversations)
SELECT conv_id, count(*) AS n, string_agg(note, ' || ' ORDER BY note) AS notes, bool_or(length(note) < 400 AND regexp_matches(note, '{POSITIVE}') AND NOT regexp_matches(note, '{NEGATIVE}')) AS flagged
FROM n WHERE note <> '' GROUP BY 1"""


def normalize_issuer(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    name = F.concat(F.col("s_name"), F.lit(" Holdings, L.P. (fka Old & Co) & Partners Inc."))
    return s.select("s_suppkey", issuer_key(name).alias("issuer_key"))


NORMALIZE_ISSUER = "SELECT s_suppkey, trim(regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g')) || ' partners' AS issuer_key FROM supplier"


def classify_instrument(spark: SparkSession, sf: str) -> DataFrame:
    """Class and subtype by wording of every line item."""
    kinds = F.element_at(F.array(*map(F.lit, ["Common stock", "Warrants", "Preferred units", "Second lien loan", "First lien term loan - revolver", "Subordinated notes", "Software"])), F.col("l_linenumber").cast("int"))
    li = table(spark, sf, "lineitem").withColumn("t", kinds)
    return li.groupBy("t").agg(F.count("*").alias("n")).select("t", "n", instrument_class(F.col("t")).alias("kind"), instrument_subtype(F.col("t")).alias("subtype"), is_debt(instrument_class(F.col("t"))).alias("debt"))


CLASSIFY_INSTRUMENT = """SELECT t, n, kind, CASE WHEN t LIKE '%revolver%' THEN 'revolver' END AS subtype, kind IN ('second_lien', 'first_lien', 'subordinated') AS debt FROM (
  SELECT t, count(*) AS n, CASE WHEN t = 'Common stock' THEN 'equity' WHEN t = 'Warrants' THEN 'warrant' WHEN t LIKE 'Pref%' THEN 'preferred' WHEN t LIKE 'Second%' THEN 'second_lien' WHEN t LIKE 'First%' THEN 'first_lien' WHEN t LIKE 'Sub%' THEN 'subordinated' ELSE 'unknown' END AS kind
  FROM (SELECT (['Common stock', 'Warrants', 'Preferred units', 'Second lien loan', 'First lien term loan - revolver', 'Subordinated notes', 'Software'])[l_linenumber] AS t FROM lineitem) GROUP BY 1)"""


def maturity_parse(spark: SparkSession, sf: str) -> DataFrame:
    """The maturity of every distinct line item, read from its text."""
    t = line_items(spark, sf).select("text").distinct()
    # a one-element array: what is written is found once, however many formats look at it
    read = F.transform(F.array(maturity_text(F.col("text"))), lambda w: F.struct(w.alias("written"), any_date(w).alias("maturity")))
    return t.select("text", F.inline(read))


MATURITY_PARSE = f"""WITH {LINE_ITEMS} SELECT DISTINCT text, split_part(text, ' due ', 2) AS written, last_day(make_date(CAST(split_part(split_part(text, ' due ', 2), '/', 2) AS INT), CAST(split_part(split_part(text, ' due ', 2), '/', 1) AS INT), 1)) AS maturity FROM line_items"""


def line_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Stable keys: what differs only in percentages, spacing or leading zeros falls together."""
    t = line_items(spark, sf)
    drifted = F.concat(F.col("text"), F.lit("  - "), F.round(F.col("cost") % 9, 1).cast("string"), F.lit("% "))
    return t.select("lender", line_key(drifted).alias("key"), is_total(F.col("text")).alias("total")).groupBy("lender", "key").agg(F.count("*").alias("n"), F.bool_or("total").alias("total"))


LINE_KEYS = f"WITH {LINE_ITEMS} SELECT lender, lower(text) AS key, count(*) AS n, false AS total FROM line_items GROUP BY 1, 2"


def parse_identifier(spark: SparkSession, sf: str) -> DataFrame:
    return parse_line_items(line_items(spark, sf), "text")


PARSE_IDENTIFIER = f"""WITH {LINE_ITEMS} SELECT DISTINCT text, split_part(text, ' | ', 1) AS issuer, 'supplier ' || regexp_extract(text, '#([0-9]+)', 1) AS issuer_key, 'first_lien' AS kind, CAST(NULL AS VARCHAR) AS subtype, true AS debt,
  split_part(text, ' due ', 2) AS maturity, CAST(NULL AS DOUBLE) AS par, lower(text) AS key, false AS total FROM line_items"""


def learned_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return learn_phrases(table(spark, sf, "part").select("p_type", F.concat_ws(" ", "p_name", "p_brand").alias("t")), "p_type", "t")


LEARNED_PHRASES = """WITH w AS (SELECT DISTINCT p_type, string_split(lower(p_name || ' ' || p_brand), ' ') AS w FROM part)
SELECT p_type, array_to_string(w[1:n], ' ') AS phrase, count(DISTINCT w[n + 1]) AS followers FROM w, unnest(range(1, 6)) AS t(n) WHERE len(w) > n GROUP BY 1, 2 HAVING count(DISTINCT w[n + 1]) >= 3"""


def fnv_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Hash of a document's source, and the shard of source and id."""
    s = table(spark, sf, "documents").select("doc_id", "source")
    return s.select("doc_id", fnv1a(F.col("source")).alias("h"), shard(F.concat_ws("-", "source", "doc_id"), 4096).alias("shard"))


_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({0}, ''), lambda c: ord(c)::BIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296)"
FNV_SHARDS = f"SELECT doc_id, {_FNV.format('source')} AS h, lpad(lower(to_hex({_FNV.format("(source || '-' || doc_id)")} % 4096)), 3, '0') AS shard FROM documents"


def cluster_subset_sum(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of an order's lines by part type; those dropped so that the rest meets the order's total."""
    li, part, o = table(spark, sf, "lineitem"), table(spark, sf, "part"), table(spark, sf, "orders")
    g = li.join(part, li.l_partkey == part.p_partkey).groupBy("l_orderkey", F.col("p_type").alias("sig")).agg(exact_sum(F.col("l_extendedprice")).alias("amount"), F.count("*").alias("n"))
    g = g.join(o.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("total")), "l_orderkey").withColumn("fixed", F.lit(False))
    return reconcile(g.select("l_orderkey", "sig", "amount", "n", "fixed", "total"), ["l_orderkey"])


CLUSTER_SUBSET_SUM = f"""WITH g AS (SELECT l_orderkey AS k, p_type AS sig, CAST(sum(CAST(l_extendedprice AS DECIMAL(24,6))) AS DOUBLE) AS amount, count(*) AS n, false AS fixed, any_value(o_totalprice) AS total
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
{choice_sql("g")} SELECT k AS l_orderkey, sig, amount, n, fixed, total, dropped FROM choice"""


def camel_case(spark: SparkSession, sf: str) -> DataFrame:
    """CamelCase names back to words."""
    p = table(spark, sf, "part")
    return p.select("p_partkey", camel_words(F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))).alias("words"))


CAMEL_CASE = "SELECT p_partkey, array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(p_name, ' ')], ' ') AS words FROM part"


def printed_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers as printed in documents (grouping, parentheses, dashes, scale) read back."""
    o = table(spark, sf, "orders")
    printed = F.when(F.col("o_orderstatus") == "P", "—").when(F.col("o_orderstatus") == "F", F.concat(F.lit("("), F.format_number("o_totalprice", 2), F.lit(")"))).otherwise(F.format_number("o_totalprice", 2))
    return o.select("o_orderkey", (F.round(document_number(printed, F.lit(3)), 0) + 0.0).alias("value"))


PRINTED_NUMBERS = "SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 0.0::DOUBLE WHEN 'F' THEN -1.0::DOUBLE * round(round(o_totalprice, 2) * 1000, 0) ELSE round(round(o_totalprice, 2) * 1000, 0) END + 0.0 AS value FROM orders"

QUERIES = {
    "eav_pivot": eav_pivot, "latest_value_wins": latest_value_wins, "rate_repair": rate_repair, "reconciliation": reconciliation, "reported_totals": reported_totals,
    "period_source": period_source, "punct_dupe": punct_dupe, "fv_only_twin": fv_only_twin, "issuer_subtotal": issuer_subtotal, "heading_subtotal": heading_subtotal,
    "exclusion_ledger": exclusion_ledger, "superset_leaves": superset_leaves, "unit_fixes": unit_fixes, "footnote_agg": footnote_agg, "normalize_issuer": normalize_issuer,
    "classify_instrument": classify_instrument, "maturity_parse": maturity_parse, "line_keys": line_keys, "parse_identifier": parse_identifier, "learn_phrases": learned_phrases,
    "fnv_shards": fnv_shards, "cluster_subset_sum": cluster_subset_sum, "camel_case": camel_case, "printed_numbers": printed_numbers,
}
SQL = {
    "eav_pivot": EAV_PIVOT, "latest_value_wins": LATEST_VALUE_WINS, "rate_repair": RATE_REPAIR, "reconciliation": RECONCILIATION, "reported_totals": REPORTED_TOTALS,
    "period_source": PERIOD_SOURCE, "punct_dupe": PUNCT_DUPE, "fv_only_twin": FV_ONLY_TWIN, "issuer_subtotal": ISSUER_SUBTOTAL, "heading_subtotal": HEADING_SUBTOTAL,
    "exclusion_ledger": EXCLUSION_LEDGER, "superset_leaves": SUPERSET_LEAVES, "unit_fixes": UNIT_FIXES, "footnote_agg": FOOTNOTE_AGG, "normalize_issuer": NORMALIZE_ISSUER,
    "classify_instrument": CLASSIFY_INSTRUMENT, "maturity_parse": MATURITY_PARSE, "line_keys": LINE_KEYS, "learn_phrases": LEARNED_PHRASES, "parse_identifier": PARSE_IDENTIFIER, "fnv_shards": FNV_SHARDS, "cluster_subset_sum": CLUSTER_SUBSET_SUM, "camel_case": CAMEL_CASE, "printed_numbers": PRINTED_NUMBERS,
}
