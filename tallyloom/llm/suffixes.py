"""Repeated passages by sparse suffix arrays.

Of all suffixes only those are kept that start at a minimiser: the place of the least hash of
``K`` words within a window of ``least - K + 1`` places, which depends on the words alone. A
passage of ``least`` words or more holds the same minimisers wherever it stands. Suffixes whose
first K words stand in no other document are dropped; the others are sorted by the words that
follow, with the words before them as a tie-break, and each is compared with the nearest suffix of
another document on either side: as many equal words as there are to the right and, from there,
to the left. If these are ``least`` or more, both documents repeat a passage there. Both sides are
looked at for ``least`` words; longer passages hold several minimisers, whose matches are merged.

The nearest suffix agrees longest to the right, but another may agree less to the right and more
to the left. So of a suffix that has more words before it than its neighbours account for, the
remaining windows of ``least`` words around it, which start at most ``least - K`` words before it,
are hashed, and so are those of the suffixes that begin with the same K words; windows that meet in
two documents are repeated passages as well. The same is done where a neighbour can't be seen: at
the border of a partition, and every ``HELD`` suffixes of one beginning. The result is that of
comparing all windows of all documents, on any partitioning.

The sort is a range partitioning on the hash of the first K words, a few bytes of what follows and
a hash, so a passage that very many documents share is spread over partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, keyed_join, small_batches, tidy
from .simhash import shingle_hashes

LEAST, K = 50, 12
#: Bytes behind the first K words that partitions are ranged by, and suffixes of one beginning that a task holds.
HEAD, HELD = 24, 4_096


def minimisers(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the (first) least hash of each window."""
    if len(hashes) < window:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.concatenate([views[i : i + 8192].argmin(1) + np.arange(i, min(i + 8192, len(views))) for i in range(0, len(views), 8192)]))


def anchors(documents: DataFrame, least: int) -> DataFrame:
    """(doc_id, text_hash, gram, at) of every minimiser; documents has doc_id, text_hash, t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, grams, places = [], [], []
            for row, t in enumerate(batch.column(2)):
                hashes = shingle_hashes(t.as_py(), K)
                at = minimisers(hashes, least - K + 1)
                rows.append(np.full(len(at), row))
                grams.append(hashes[at].view(np.int64))
                places.append(at)
            pick = pa.array(np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64))
            columns = [np.concatenate([*grams, np.zeros(0, np.int64)]), np.concatenate([*places, np.zeros(0, np.int64)]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), *map(pa.array, columns)], ["doc_id", "text_hash", "gram", "at"])

    return documents.mapInArrow(tidy(run), "doc_id bigint, text_hash bigint, gram bigint, at int")


def suffixes(documents: DataFrame, least: int) -> DataFrame:
    """(doc_id, text_hash, at, right, left, gram, head): the words from each place on and, backwards, before it.

    gram hashes the first K words to the right, head is how the words behind these begin.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                words = batch.column(2)[row].as_py().lower().split()
                at = batch.column(3).slice(row, 1).flatten().to_numpy()
                right = [b" ".join(words[i : i + least]) for i in at.tolist()]
                left = [b" ".join(words[max(0, i - least) : i][::-1]) for i in at.tolist()]
                first = [b" ".join(words[i : i + K]) for i in at.tolist()]
                gram = np.array([xxhash.xxh64_intdigest(f, 42) for f in first], np.uint64).view(np.int64)
                head = [r[len(f) : len(f) + HEAD] for r, f in zip(right, first)]
                pick = pa.array(np.full(len(at), row, np.int64))
                columns = [pa.array(at.astype(np.int32)), pa.array(right, pa.binary()), pa.array(left, pa.binary()), pa.array(gram), pa.array(head, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), *columns], ["doc_id", "text_hash", "at", "right", "left", "gram", "head"])

    return documents.mapInArrow(tidy(run), "doc_id bigint, text_hash bigint, at int, right binary, left binary, gram bigint, head binary")


def common(a: bytes, b: bytes) -> int:
    """Equal words at the start of both."""
    if a == b:
        return a.count(b" ") + 1 if a else 0
    same, n = 0, min(len(a), len(b))
    while same < n:  # the first sign that differs, by halves
        half = (same + n + 1) // 2
        if a[same:half] == b[same:half]:
            same = half
        else:
            n = half - 1
    # the word that holds it counts if both end there
    whole = same > 0 and a[same : same + 1] in (b"", b" ") and b[same : same + 1] in (b"", b" ")
    return a.count(b" ", 0, same) + whole


def of_others(docs: list[tuple]) -> tuple[list[int], list[int]]:
    """For each place of a list the nearest ones before and after it with another document, -1 and n without."""
    n = len(docs)
    before, after = [-1] * n, [n] * n
    for i in range(1, n):
        before[i] = i - 1 if docs[i - 1] != docs[i] else before[i - 1]
    for i in range(n - 2, -1, -1):
        after[i] = i + 1 if docs[i + 1] != docs[i] else after[i + 1]
    return before, after


class Suffix(NamedTuple):
    doc_id: int | None
    text_hash: int
    at: int
    right: bytes
    left: bytes
    gram: int
    head: bytes


def windows(x: Suffix, first: int, last: int, least: int) -> Iterator[tuple[bytes, int]]:
    """(digest, first word) of the windows that start ``first`` to ``last`` words before the suffix."""
    right, left = x.right.split(b" "), x.left.split(b" ") if x.left else []
    for d in range(max(first, least - len(right)), min(last, len(left)) + 1):
        yield xxhash.xxh3_128_digest(b" ".join([*left[:d][::-1], *right[: least - d]])), x.at - d


def compared(run: list[Suffix], open_before: bool, open_after: bool, ends: set[tuple], least: int) -> tuple[list[tuple], list[tuple]]:
    """Spans and hashed windows of sorted suffixes that begin with the same K words.

    Spans are (doc_id, text_hash, from, to), windows (doc_id, text_hash, digest, from). open_before,
    open_after: others of this beginning may stand before or after; ends: (gram, head) of which
    others may stand anywhere.
    """
    n, docs = len(run), [x[:2] for x in run]
    before, after = of_others(docs)
    spans, asked, reach = [], {}, []
    met: dict[tuple[int, int], tuple[int, int]] = {}
    for i, x in enumerate(run):
        # what stands beyond a border could agree to any length
        unseen = (before[i] < 0 and open_before) or (after[i] == n and open_after) or (x.gram, x.head) in ends
        right, left = (least, -1) if unseen else (0, -1)
        for j in (before[i], after[i]):
            if 0 <= j < n:
                pair = (min(i, j), max(i, j))
                if pair not in met:
                    y = run[j]
                    r = common(x.right, y.right)
                    met[pair] = r, common(x.left, y.left) if r else 0
                r, l = met[pair]
                if r + l >= least:
                    spans.append((*docs[i], x.at - l, x.at + r))
                right, left = max((right, left), (r, l))
        # windows that start ``left`` words before or less are within a span
        reach.append(least - right)
        low = max(reach[i], left + 1) if right + left >= least else reach[i]
        if low <= min(least - K, x.left.count(b" ") + 1 if x.left else 0):
            asked[i] = low
    border, hashed = open_before or open_after, []
    if not asked and not border:
        return spans, hashed
    # how many words before it a suffix can share with another document; anything at a border
    farthest = [least - K] * n
    if not border:
        order = sorted(range(n), key=lambda i: run[i].left)
        lower, upper = of_others([docs[i] for i in order])
        for place, i in enumerate(order):
            farthest[i] = max((common(run[i].left, run[order[j]].left) for j in (lower[place], upper[place]) if 0 <= j < n), default=0)
        asked = {i: low for i, low in asked.items() if low <= farthest[i]}
    low = 0 if border else min(asked.values(), default=least)
    kinds: dict[tuple[bytes, bytes], set] = {}
    for i, x in enumerate(run):
        same = kinds.setdefault((x.right, x.left), set())
        if max(low, reach[i]) <= farthest[i] and (i in asked or (len(same) < 2 and docs[i] not in same)):
            hashed += [(*docs[i], w, at) for w, at in windows(x, max(low, reach[i]), min(farthest[i], least - K), least)]
        same.add(docs[i])
    return spans, hashed


def neighbours(least: int, most: int):
    """Sorted suffixes to spans (doc_id, text_hash, from, to, null) and windows (.., from, null, window)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        held: list[Suffix] = []
        start, border = None, True  # the first (gram, head), and whether others may stand before those held

        ready: list[tuple] = []

        def compare(last: bool) -> None:
            if len(held) > 1 or border or last:
                ends = {start, (held[-1].gram, held[-1].head)} if last else {start}
                spans, hashed = compared(held, border, last, ends, least)
                ready.extend((*s, None) for s in dict.fromkeys(spans))
                ready.extend((*h[:2], h[3], None, h[2]) for h in hashed)

        def done() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ready) if ready else [()] * 5, types)], ["doc_id", "text_hash", "from", "to", "window"])
            ready.clear()
            return out

        for batch in batches:
            for x in map(Suffix._make, zip(*(c.to_pylist() for c in batch.columns))):
                start = start or (x.gram, x.head)
                if held and x.gram != held[-1].gram:
                    compare(False)
                    held, border = [], False
                elif len(held) >= most:
                    compare(True)
                    held, border = [], True
                held.append(x)
            yield done()
        if held:
            compare(True)
            yield done()

    return run


def repeated_passages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row per repeated stretch: doc_id, from_word, to_word (end exclusive), n_words, text_hash.

    A stretch is a union of passages of ``least`` or more white-space-separated words (A-Z read in
    lower case) that stand in another document as well. Documents without one have no row. Rows
    that repeat both id and text are one document; null and empty texts have no passages; null
    ids are allowed; other columns are ignored.
    """
    text = F.col(text_col).cast("binary")
    docs = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), text.alias("t")).filter(F.octet_length("t") >= 2 * least - 1)
    small_batches(documents)
    found = cut(anchors(docs, least))

    def of_several(rows: DataFrame, key: str) -> DataFrame:
        """(key, n): how many rows stand under each key that two documents or more have."""
        doc = F.xxhash64("doc_id", "text_hash")
        return cut(rows.groupBy(key).agg(F.count("*").alias("n"), F.min(doc).alias("a"), F.max(doc).alias("b")).filter("a < b").select(key, "n"))

    again = of_several(found, "gram")
    places = keyed_join(found, again.select("gram"), "gram", again, "n").groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("at")).alias("places"))
    p = places.select(F.col("doc_id").alias("p_id"), F.col("text_hash").alias("p_hash"), "places")
    texts = docs.join(p, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("text_hash") == F.col("p_hash"))).select("doc_id", "text_hash", "t", "places")
    array = suffixes(texts, least).repartitionByRange("gram", "head", F.xxhash64("doc_id", "text_hash", "at")).sortWithinPartitions("gram", "right", "left", "doc_id", "text_hash", "at")
    met = cut(array.mapInArrow(tidy(neighbours(least, HELD)), "doc_id bigint, text_hash bigint, from int, to int, window binary"))
    hashed = met.filter(F.col("window").isNotNull()).select("doc_id", "text_hash", "from", "window")
    shared = of_several(hashed, "window")
    matched = keyed_join(hashed, shared.select("window"), "window", shared, "n").select("doc_id", "text_hash", "from", (F.col("from") + least).alias("to"))
    spans = met.filter(F.col("window").isNull()).select("doc_id", "text_hash", "from", "to").unionByName(matched).distinct()
    own = Window.partitionBy("doc_id", "text_hash")
    reached = F.max("to").over(own.orderBy("from", "to").rowsBetween(Window.unboundedPreceding, -1))
    begins = spans.withColumn("begins", F.coalesce(F.col("from") > reached, F.lit(True)).cast("int"))
    stretch = begins.withColumn("stretch", F.sum("begins").over(own.orderBy("from", "to").rowsBetween(Window.unboundedPreceding, 0)))
    merged = stretch.groupBy("doc_id", "text_hash", "stretch").agg(F.min("from").alias("from_word"), F.max("to").alias("to_word"))
    return merged.select("doc_id", "from_word", "to_word", (F.col("to_word") - F.col("from_word")).alias("n_words"), "text_hash")
