"""Benchmark decontamination by winnowing.

Every run of ``window`` words that a document shares with a benchmark item holds, on both sides,
the same smallest k-gram hash of its ``window - k + 1`` k-grams. So it is enough to join those
minima, and to extend each seed word by word to see whether a whole window stands around it.

Only DataFrame functions run here; no Python touches a row.

Defined results: a null or empty text has no words and is never hit. Items without words take no
part. Items of fewer words than a window are one window, found through all document grams of that
length. Repeated item rows count once. Documents that repeat both id and text are one document;
the same id with different texts gives a row for each text. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words

#: Not an index of any word: marks the row that keeps a document without seeds in the result.
NOWHERE = -1


def grams(h: Column, k: int) -> Column:
    """Hash of each k consecutive entries of the array of word hashes ``h``."""
    rolled = F.transform(h, lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, k))))
    return F.when(F.size(h) >= k, F.slice(rolled, 1, F.greatest(F.size(h) - (k - 1), F.lit(1)))).otherwise(F.array().cast("array<bigint>"))


def lowest(g: Column, w: int) -> Column:
    """The least of the w entries that start at each place (fewer at the end)."""
    return F.transform(g, lambda x, i: F.least(x, *(F.get(g, i + j) for j in range(1, w))) if w > 1 else x)


def kept(g: Column, m: Column, w: int) -> Column:
    """(fingerprint, place) of the entries of ``g`` that are the least of some window."""
    return F.array_compact(
        F.transform(
            g,
            lambda x, i: F.when(
                x == (F.greatest(F.get(m, i), *(F.get(m, i - j) for j in range(1, w))) if w > 1 else F.get(m, i)),
                F.struct(x.alias("fp"), i.cast("int").alias("at")),
            ),
        )
    )


def fingerprints(df: DataFrame, k: int, w: int, short: list[int]) -> DataFrame:
    """Adds ``seeds``: array of (fp, at, len), len being the words a match must have.

    df has ``words``; ``short`` are the item lengths below a window. Unnest with explode_outer:
    for explode, Catalyst adds a filter on the array's size, pushes it below these projections
    and so would compute the nested arrays anew for each entry.
    """
    df = df.withColumn("h", F.transform("words", lambda x: F.xxhash64(x)))
    df = df.withColumn("g", grams(F.col("h"), k))
    df = df.withColumn("m", lowest(F.col("g"), w))
    full = k + w - 1
    seeds = F.transform(kept(F.col("g"), F.col("m"), w), lambda s: F.struct(s["fp"], s["at"], F.lit(full).alias("len")))
    for n in short:
        seeds = F.concat(seeds, F.transform(grams(F.col("h"), n), lambda x, i: F.struct(F.xxhash64(x, F.lit(n)).alias("fp"), i.cast("int").alias("at"), F.lit(n).alias("len"))))
    return df.withColumn("seeds", seeds).drop("h", "g", "m")


def same_run(step: int, most: int) -> Column:
    """How many of the next ``most`` words before (step -1) or after the seed are equal."""
    edge = F.col("k") if step > 0 else F.lit(1)
    equal = [F.coalesce(F.get("words", F.col("at") + step * (edge + j)) == F.get("item_words", F.col("item_at") + step * (edge + j)), F.lit(False)) for j in range(most)]
    return reduce(lambda rest, j: F.when(equal[j], rest).otherwise(j), reversed(range(most)), F.lit(most))


def extended(seeds: DataFrame, k: int, w: int) -> DataFrame:
    """Keeps the seeds around which a whole window matches, with its ``span`` of document words."""
    full = k + w - 1
    s = seeds.withColumn("k", F.when(F.col("len") == full, F.lit(k)).otherwise(F.col("len")))
    s = s.withColumn("left", F.when(F.col("len") == full, same_run(-1, full - k)).otherwise(0)).withColumn("right", F.when(F.col("len") == full, same_run(1, full - k)).otherwise(0))
    seed = F.slice("words", F.col("at") + 1, F.col("k")) == F.slice("item_words", F.col("item_at") + 1, F.col("k"))
    hit = (F.col("at") != NOWHERE) & seed & (F.col("left") + F.col("k") + F.col("right") >= F.col("len"))
    return s.withColumn("span", F.when(hit, F.struct((F.col("at") - F.col("left")).alias("from"), (F.col("at") + F.col("k") + F.col("right")).alias("to"))))


def covered(spans: Column) -> Column:
    """Words in the union of sorted spans."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["to"] - F.greatest(a["end"], s["from"]))).alias("n"),
            F.greatest(a["end"], s["to"]).alias("end"),
        ),
        lambda a: a["n"],
    )


def contamination(
    documents: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    k: int = 5,
    broadcast_seeds: int = 200_000,
    broadcast_bytes: int = 64 << 20,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, text_hash.

    The items' seeds are counted first. Up to ``broadcast_seeds`` of them, if their words and ids
    make ``broadcast_bytes`` at most, are broadcast, so the documents are read once and never
    shuffled; more are joined by shuffling thin seed rows and going back to the documents that
    have any.
    """
    w = window - k + 1
    own = (
        items.select(F.col(item_id_col).cast("string").alias("item"), words(F.col(item_text_col)).alias("words"))
        .filter(F.size("words") > 0)
        .groupBy("words")
        .agg(F.collect_set("item").alias("items"))
        .withColumn("class", F.sha2(F.concat_ws(" ", "words"), 256))
    )
    short = sorted(r[0] for r in own.select(F.size("words").alias("n")).filter(F.col("n") < window).distinct().collect())
    item_seeds = (
        fingerprints(own, k, w, short)
        .select("class", "items", F.col("words").alias("item_words"), F.explode_outer("seeds").alias("s"))
        .select("class", "items", "item_words", F.col("s.fp").alias("fp"), F.col("s.at").alias("item_at"), F.col("s.len").alias("len"))
        .filter((F.size("item_words") == F.col("len")) | (F.col("len") == window))
        .filter((F.col("len") != window) | (F.size("item_words") >= window))
        # a seed keeps only the words that a window around it can reach
        .withColumn("first", F.greatest(F.col("item_at") - (window - k), F.lit(0)))
        .withColumn("item_words", F.slice("item_words", F.col("first") + 1, F.lit(2 * window - k)))
        .withColumn("item_at", F.col("item_at") - F.col("first"))
        .drop("first")
    )
    docs = fingerprints(documents.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("words"), F.xxhash64(text_col).alias("text_hash")), k, w, short)
    doc = ["doc_id", "text_hash", "n_words"]
    docs = docs.withColumn("n_words", F.size("words").cast("bigint"))
    weight = F.octet_length(F.concat_ws(" ", "item_words")) + F.octet_length(F.concat_ws(" ", "items"))
    size = item_seeds.limit(broadcast_seeds + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(weight), F.lit(0)).alias("bytes")).first()
    few = size.n <= broadcast_seeds and size.bytes <= broadcast_bytes
    nowhere = F.struct(F.lit(0).cast("bigint").alias("fp"), F.lit(NOWHERE).alias("at"), F.lit(NOWHERE).alias("len"))
    if few:
        blank = items.sparkSession.range(1).select(
            F.lit(None).cast("string").alias("class"), F.array().cast("array<string>").alias("items"), F.array().cast("array<string>").alias("item_words"), F.lit(0).cast("bigint").alias("fp"), F.lit(NOWHERE).alias("item_at"), F.lit(NOWHERE).alias("len")
        )
        seeds = (
            docs.select(*doc, "words", F.explode_outer(F.concat(F.array(nowhere), "seeds")).alias("s"))
            .select(*doc, "words", F.col("s.fp").alias("fp"), F.col("s.at").alias("at"), F.col("s.len").alias("len"))
            .join(F.broadcast(item_seeds.unionByName(blank)), ["fp", "len"])
        )
        found = extended(seeds, k, w).filter(F.col("span").isNotNull() | (F.col("at") == NOWHERE))
    else:
        thin = docs.select("doc_id", "text_hash", F.explode_outer("seeds").alias("s")).select("doc_id", "text_hash", F.col("s.fp").alias("fp"), F.col("s.at").alias("at"), F.col("s.len").alias("len"))
        seeds = thin.join(item_seeds, ["fp", "len"])
        texts = docs.select(*doc, "words").dropDuplicates(["doc_id", "text_hash"])
        same = F.col("t.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("t.text_hash") == F.col("s.text_hash"))
        found = extended(texts.alias("t").join(seeds.alias("s"), same, "left").drop(F.col("s.doc_id")).drop(F.col("s.text_hash")), k, w)
        found = found.withColumn("at", F.coalesce("at", F.lit(NOWHERE)))
    hit = F.col("span").isNotNull()
    return (
        found.groupBy(*doc)
        .agg(F.collect_set("span").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(hit, F.col("items")))))).alias("ids"))
        .select(
            "doc_id",
            "n_words",
            covered(F.array_sort("spans")).alias("n_hit"),
            F.size("ids").cast("bigint").alias("n_items"),
            F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"),
            (F.size("spans") > 0).alias("contaminated"),
            "text_hash",
        )
    )


def without_contaminated(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The input rows whose text holds no window of an item, with their columns."""
    hit = contamination(documents, items, id_col, text_col, **parameters).filter("contaminated").select(F.col("doc_id").alias("_hit"), "text_hash")
    same = documents[id_col].eqNullSafe(hit["_hit"]) & (F.xxhash64(documents[text_col]) == hit["text_hash"])
    return documents.join(hit, same, "left_anti")
