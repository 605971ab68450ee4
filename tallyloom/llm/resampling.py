"""Importance resampling of documents towards the word distribution of another table.

A table of positions has every word of every document with its place. For runs of two words and
more, ``lead()`` over each document's positions names the words that follow; a run is their
concatenation. Every run is hashed to a bucket. The buckets' counts over all documents and over
the target give each bucket a gain, the floored log ratio of the two smoothed shares; the mean gain
of a document's runs is its weight, and weight plus Gumbel noise from a hash of its id its score.
The highest scores are a draw without replacement in proportion to exp(weight).

Scores are whole numbers of a bounded range (gains and noise are logarithms), so how many documents
stand at each score is a bounded table. It tells the least score that is drawn and at which rank
each score begins; only documents of one score are ranked by their ids together.

Documents meet in no group: counts of a document's runs are summed by its id and a checksum of its
text, so rows that repeat both are one row with a number of copies until the draw. Everything is
DataFrame functions.

Defined results: a null or wordless text has no features, weight 0 and its noise as score; it has
fewer words than ``least`` and is never drawn unless ``least`` is 0; a null id is hashed as the
empty text and ranked before others of its score; rows that repeat id and text have the same
numbers and ranks that follow each other; rows of one id and several texts are told apart by the
texts' checksum; empty tables have no rows (documents) or no counts (target); other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, named, words

ORDER, BUCKETS = 1, 10_000
SEED = 2024
#: Copies of a row that are written at once when rows are told apart again.
COPIES = 1_000


def with_key(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, w): the rows' ids, checksums and words."""
    key, text = named([id_col, text_col])
    return documents.select(key.alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"), words(text).alias("w"))


def runs(keyed: DataFrame, order: int) -> DataFrame:
    """(id, text_key, words, head, run, n): the runs of 1 to ``order`` words that begin at each position.

    ``words`` is how many the row has; a row without words has a null run. ``n`` is the number of
    equal rows that the line stands for, ``head`` marks the first line of a row.
    """
    positions = keyed.select("id", "text_key", F.size("w").alias("words"), F.posexplode_outer("w").alias("position", "word"))
    head = F.coalesce("position", F.lit(0)) == 0
    if order == 1:  # nothing follows
        return positions.select("id", "text_key", "words", head.alias("head"), F.col("word").alias("run"), F.lit(1).alias("n"))
    # equal rows have the same positions; one of each, counted, leaves lead() a single line a place
    positions = positions.groupBy("id", "text_key", "words", "position", "word").agg(F.count("*").alias("n"))
    place = Window.partitionBy("id", "text_key").orderBy("position")
    following = [F.col("word"), *(F.lead("word", k).over(place) for k in range(1, order))]
    positions = positions.select("*", *(f.alias(f"w{k}") for k, f in enumerate(following)))
    # a run that would pass the last word is null
    each = F.array(*(F.when(F.col(f"w{k}").isNotNull(), F.concat_ws(" ", *(f"w{j}" for j in range(k + 1)))) for k in range(order)))
    long_enough = F.filter(each, lambda run: run.isNotNull())
    return positions.select("id", "text_key", "words", head.alias("at_head"), "n", F.posexplode_outer(long_enough).alias("k", "run")).select(
        "id", "text_key", "words", (F.col("at_head") & (F.coalesce("k", F.lit(0)) == 0)).alias("head"), "run", "n"
    )


def bucket(run: Column, buckets: int) -> Column:
    return (F.crc32(run.cast("binary")) % buckets).cast("int")


def bucket_counts(keyed: DataFrame, order: int, buckets: int, name: str) -> DataFrame:
    found = runs(keyed, order).filter(F.col("run").isNotNull())
    return found.groupBy(bucket(F.col("run"), buckets).alias("bucket")).agg(F.sum("n").alias(name))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of all buckets that the source holds; ``buckets`` rows at most."""
    source, target = cut(source), cut(target)
    in_source, in_target = (float(df.agg(F.sum(c)).first()[0] or 0) + buckets for df, c in ((source, "s"), (target, "t")))
    s, t = F.col("s").cast("double"), F.coalesce("t", F.lit(0)).cast("double")
    ratio = (t + 1) * F.lit(in_source) / ((s + 1) * F.lit(in_target))
    return source.join(F.broadcast(target), "bucket", "left").select("bucket", F.floor(1000 * F.log(ratio)).cast("bigint").alias("gain"))


def noise(id_: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("bigint")


def resampled(
    documents: DataFrame,
    target: DataFrame,
    percent: int = 10,
    least: int = 20,
    order: int = ORDER,
    buckets: int = BUCKETS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every input row, and its number of words.

    Features are runs of 1 to ``order`` words. Of the rows with ``least`` words or more ``percent``
    hundredths, rounded down, have a rank: the highest scores, ties to the smaller id. Defined
    results for odd rows are in the module's text.
    """
    keyed = with_key(documents, id_col, text_col)
    wanted = with_key(target.select(F.lit(None).cast("string").alias("id"), *(c.alias("text") for c in named([target_col]))), "id", "text")
    gain = cut(gains(bucket_counts(keyed, order, buckets, "s"), bucket_counts(wanted, order, buckets, "t"), buckets))
    features = runs(keyed, order).withColumn("bucket", bucket(F.col("run"), buckets))
    features = features.join(F.broadcast(gain), "bucket", "left")  # ``buckets`` rows
    # equal rows are added up, so each sum is as many times one row's as there are copies
    weighed = features.groupBy("id", "text_key").agg(
        F.sum(F.when(F.col("head"), F.col("n"))).alias("copies"), F.max("words").alias("words"), F.sum(F.when(F.col("run").isNotNull(), F.col("n")).otherwise(0)).alias("features"),
        F.sum(F.col("gain") * F.col("n")).alias("gains"),
    )
    weight = F.when(F.col("features") > 0, F.floor(F.col("gains") / F.col("features"))).otherwise(0).cast("bigint")
    weighed = cut(weighed.select("id", "text_key", "copies", "words", (F.col("features") / F.col("copies")).cast("bigint").alias("n_features"), weight.alias("weight")))
    weighed = weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed))

    fit = F.col("words") >= least
    # as many rows as scores are possible: gains and noise are bounded logarithms
    steps = weighed.filter(fit).groupBy("score").agg(F.sum("copies").alias("n"))
    higher = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    drawn = F.floor(F.sum("n").over(Window.partitionBy()) * percent / 100)
    steps = steps.select("score", higher.alias("higher"), drawn.alias("drawn")).filter(F.col("higher") < F.col("drawn"))
    ranked = weighed.filter(fit).join(F.broadcast(steps), "score")
    equal = Window.partitionBy("score").orderBy(F.asc_nulls_first("id"), "text_key").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.select("*", (F.col("higher") + F.coalesce(F.sum("copies").over(equal), F.lit(0))).alias("before"))
    rest = weighed.join(F.broadcast(steps.select("score", F.lit(True).alias("stands"))), "score", "left").filter(~(fit & F.coalesce("stands", F.lit(False))))
    both = ranked.unionByName(rest.drop("stands"), allowMissingColumns=True)

    # copies become rows again, some at a time
    some = both.select("*", F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(COPIES))).alias("from"))
    some = some.repartition("id", "text_key", "from")
    each = some.select("*", F.explode(F.sequence("from", F.least(F.col("from") + COPIES, F.col("copies")) - 1)).alias("copy"))
    rank = F.col("before") + F.col("copy") + 1
    return each.select(
        F.col("id").alias("doc_id"), "n_features", "weight", "score", F.when(rank <= F.col("drawn"), rank).cast("bigint").alias("rank"), F.col("words").cast("bigint").alias("n_words")
    )
