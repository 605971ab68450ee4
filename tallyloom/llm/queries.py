"""The registered queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import contamination
from .hmm import scores
from .licenses import licenses
from .negatives import hard_negatives
from .neighbours import neighbours
from .packing import packed
from .personal import personal_data
from .resampling import resampled
from .secrets import secrets
from .sharding import byte_shards
from .simhash import near_duplicates
from .suffixes import repeated_passages
from .toxicity import toxicity

LOW = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


OP1_SQL = f"""
WITH d AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents),
i AS (SELECT item_id, {WORDS.format("text")} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, s, s + least(len(w), 10) - 1) AS g
       FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(s) WHERE len(w) > 0),
dw AS (SELECT doc_id, n, s, list_slice(w, s, s + n - 1) AS g
       FROM d, (SELECT DISTINCT n FROM iw) AS k, unnest(range(1, greatest(len(w) - n + 2, 1))) AS t(s)),
hit AS (SELECT DISTINCT doc_id, item_id, s, n FROM dw JOIN iw USING (n, g)),
words_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(s, s + n)) AS t(p) GROUP BY doc_id),
ids AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS l FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(l), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words_hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))


def op6_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_shards(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP10_SQL = """
WITH v AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
           AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
own AS (SELECT * FROM v WHERE len(v) = (SELECT len(v) FROM v GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)),
s AS (SELECT q.vec_id AS query_id, o.vec_id AS vec_id, list_inner_product(q.v, o.v) AS score FROM own q JOIN own o ON q.vec_id <> o.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""

def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


# the checksum goes byte by byte over a table made by its polynomial
OP12_SQL = f"""
WITH steps AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS s),
d AS (SELECT doc_id, row_number() OVER () AS row, {WORDS.format("text")} AS w FROM documents),
dw AS (SELECT row, unnest(w) AS f FROM d), bw AS (SELECT unnest({WORDS.format("text")}) AS f FROM benchmark),
crc AS (SELECT f, xor(list_reduce(list_transform(range(CAST(octet_length(encode(f)) AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT)),
                                  lambda c, b: xor(c >> 8, s[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
        FROM (SELECT f FROM dw UNION SELECT f FROM bw), steps),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN crc USING (f) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM bw JOIN crc USING (f) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM dw) + 10000) / ((s + 1.0::DOUBLE) * ((SELECT count(*) FROM bw) + 10000)))) AS g
         FROM s LEFT JOIN t USING (bucket)),
m AS (SELECT row, floor(sum(g) / count(*)) AS weight FROM dw JOIN crc USING (f) JOIN gain USING (bucket) GROUP BY row),
r AS (SELECT doc_id, len(w) AS n, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
             CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
      FROM d LEFT JOIN m USING (row)),
k AS (SELECT *, n >= 20 AS fit, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) AS place FROM r)
SELECT doc_id, CAST(n AS BIGINT) AS n_features, weight, score, CAST(CASE WHEN fit AND place <= (SELECT 10 * count(*) // 100 FROM r WHERE n >= 20) THEN place END AS BIGINT) AS rank FROM k
"""

def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


OP13_SQL = """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
q AS (SELECT vec_id, label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM v),
own AS (SELECT * FROM q WHERE len(q) = (SELECT len(q) FROM q GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)),
s AS (SELECT a.vec_id AS anchor_id, o.vec_id AS id, a.label = o.label AS same, CAST(list_inner_product(a.q, o.q) AS BIGINT) AS score FROM own a JOIN own o ON a.vec_id <> o.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s AS n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) QUALIFY row_number() OVER w <= 3
"""

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_simhash": op2_simhash,
    "op3_secrets": op3_secrets,
    "op4_toxicity": op4_toxicity,
    "op5_licenses": op5_licenses,
    "op6_personal": op6_personal,
    "op7_sharding": op7_sharding,
    "op8_packing": op8_packing,
    "op9_suffixes": op9_suffixes,
    "op10_neighbours": op10_neighbours,
    "op11_language": op11_language,
    "op12_resampling": op12_resampling,
    "op13_negatives": op13_negatives,
}
ORACLE_SQL = {"op1_decontaminate": OP1_SQL, "op10_neighbours": OP10_SQL, "op12_resampling": OP12_SQL, "op13_negatives": OP13_SQL}
