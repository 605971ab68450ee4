"""Byte-balanced shards by Karmarkar-Karp differencing.

Rows with equal texts form one indivisible group. Groups are dealt by hash into chunks of bounded
length; within a chunk, partial partitions (at first one group each) are combined two by two, those
with the largest spread first and in opposite order, until one partition into ``shards`` sums is
left. The chunks' partitions are combined the same way, level by level, so no task ever holds more
than ``chunk`` of them. Every level is written to the shared checkpoint folder.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, keyed_join


def differencing(parts: list[list[int]], k: int) -> list[list[int]]:
    """For each part (up to k sums), the place of each of its sums in the common partition."""
    n = len(parts)
    starts = [sorted(range(len(p)), key=lambda i, p=p: -p[i]) for p in parts]
    sums = [[p[i] for i in s] + [0] * (k - len(p)) for p, s in zip(parts, starts)]
    heap = [(s[-1] - s[0], i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        c = [x + y for x, y in zip(sums[a], reversed(sums[b]))]
        order = sorted(range(k), key=c.__getitem__, reverse=True)
        sums[a] = sums[b] = None
        sums.append([c[i] for i in order])
        merges.append((a, b, order))
        heapq.heappush(heap, (sums[-1][-1] - sums[-1][0], len(sums) - 1))
    places: list = [None] * len(sums)
    if n:
        places[-1] = list(range(k))
    for node in range(len(merges) - 1, -1, -1):
        a, b, order = merges[node]
        here = places[n + node]
        left, right = [0] * k, [0] * k
        for t, i in enumerate(order):
            left[i], right[k - 1 - i] = here[t], here[t]
        places[a], places[b], places[n + node] = left, right, None
    out = []
    for s, place, p in zip(starts, places, parts):
        own = [0] * len(p)
        for t, i in enumerate(s):
            own[i] = place[t]
        out.append(own)
    return out


def _level(parts: DataFrame, k: int, chunk: int) -> DataFrame:
    """parts (id, sums) to (parent, id, slot, place, amount)."""
    parents = max(1, -(-parts.count() // chunk))

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        sums = [[int(x) for x in s] for s in pdf["sums"]]
        rows = [(int(p), int(i), t, place, s[t]) for p, i, s, own in zip(pdf["parent"], pdf["id"], sums, differencing(sums, k)) for t, place in enumerate(own)]
        return pd.DataFrame(rows, columns=["parent", "id", "slot", "place", "amount"])

    keyed = parts.withColumn("parent", F.pmod(F.xxhash64("id"), F.lit(parents)))
    return cut(keyed.groupBy("parent").applyInPandas(combine, "parent bigint, id bigint, slot int, place int, amount bigint"))


def byte_shards(documents: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", chunk: int = 5_000, run: int = 2_000) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 1. Equal texts share a shard, whatever their bytes: a
    group larger than a fair share leaves its shard that much heavier. A null text counts as the
    empty one. slot runs gapless from 0 in each shard; it comes from the counts of ``run``-sized
    buckets and each row's place in its bucket, so no task holds a shard. Repeated rows stay
    repeated, null ids are allowed, an empty table gives no rows, other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(
        documents.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text).cast("bigint") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("id"),
        )
    )
    parts = rows.groupBy("id").agg(F.array(F.sum("size")).alias("sums"))
    levels = []
    while True:
        level = _level(parts, shards, chunk)
        levels.append(level)
        sums = level.groupBy("parent", "place").agg(F.sum("amount").alias("amount"))
        parts = sums.groupBy(F.col("parent").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "amount"))), lambda s: s["amount"]).alias("sums"))
        parts = cut(parts)
        if parts.limit(2).count() < 2:
            break
    placed = levels[0].select("id", "parent", "place")
    for level in levels[1:]:
        up = level.select(F.col("id").alias("parent"), F.col("slot").alias("place"), F.col("parent").alias("upper"), F.col("place").alias("to"))
        placed = placed.join(up, ["parent", "place"]).select("id", F.col("upper").alias("parent"), F.col("to").alias("place"))
    counts = rows.groupBy("id").agg(F.count("*").alias("n"))
    sharded = keyed_join(rows, placed.select("id", F.col("place").alias("shard")), "id", counts, "n")
    buckets = max(16, -(-rows.count() // (shards * run)))
    sharded = cut(sharded.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.rand(7)), F.lit(buckets))))
    counts = sharded.groupBy("shard", "bucket").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id"))
    return (
        sharded.withColumn("n", place)
        .join(offsets, ["shard", "bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("n") - 1).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
