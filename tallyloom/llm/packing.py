"""Packing of token sequences by patterns fitted with non-negative least squares.

Only the histogram of piece lengths (at most ``limit`` numbers) reaches the driver. There,
patterns of a few length classes that fill a sequence are enumerated, their repeat counts are
fitted to the histogram by non-negative least squares and rounded down, and what is left is packed
best fit, longest first, into the patterns' gaps and new sequences. Everything works on lengths
with multiplicities, so the plan's length depends on the number of distinct lengths, not of
documents. Pieces then find their place from their length and their rank among equal lengths.
"""

from __future__ import annotations

import bisect
import functools
import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import cut, small_batches, tidy

#: Words whose ids a worker keeps, in two generations of half as many.
MEMO = 400_000
#: Bytes of texts that are tokenized at once.
AT_ONCE = 4 << 20
#: Pieces of one length in a bucket, about, if all pieces had that length.
BUCKET = 20_000
END_ID = 1
#: Parts of texts whose words can be told without the tokenizer: no case, composition or white space
#: that two libraries could see in two ways, and no sign of a special token.
PLAIN = r"^[\x21-\x3b\x3d-\x7e\x{a1}-\x{12f}\x{131}-\x{17f}]*$"
# How the tokenizer cuts lower-cased text before its merges, for these signs only; a
# line end is a mark of ours.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\na-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f0-9\xb2\xb3\xb9\xbc-\xbe]+|\n")


def byte_signs() -> dict[int, int]:
    """The signs that stand for bytes in a byte-level vocabulary if not visible themselves: from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in visible)}


def joined(values: pa.Array, places: pa.Array, edges: np.ndarray) -> pa.Array:
    """``values`` (binary) at ``places``, those between two edges put together as one."""
    found = values.take(places)
    offsets = np.frombuffer(found.buffers()[1], np.int64)[found.offset :][edges]
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(offsets), found.buffers()[2]])


class Encoder:
    """The ids of texts, worked out once for each distinct word of a batch.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its
    parts between white space, in order. Most parts are cut into words here, and each word that
    is not remembered is merged by the tokenizer's model; all other parts (other scripts, special
    tokens) go through the whole tokenizer.
    """

    def __init__(self, path: str, memo: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.signs = self.tokenizer.model, byte_signs()
        self.half, self.young, self.old = max(1, memo // 2), {"\n": b""}, {}

    def merged(self, word: str) -> bytes:
        signs = word if word.isascii() else word.encode().decode("latin-1").translate(self.signs)
        return array("I", [t.id for t in self.model.tokenize(signs)]).tobytes()

    def lookup(self, words: list[str]) -> list[bytes]:
        """The ids of each word. What neither this generation nor the one before has met is forgotten."""
        young, old = self.young, self.old
        new = {w: old[w] if w in old else self.merged(w) for w in words if w not in young}
        out = [new[w] if w in new else young[w] for w in words]
        if len(young) + len(new) > self.half:
            self.old, self.young = young, {"\n": b""} | new
        else:
            young |= new
        return out

    def plain(self, parts: pa.Array) -> pa.Array:
        """The ids of each of the parts, all of them plain."""
        text = pc.binary_join(pa.LargeListArray.from_arrays([0, len(parts)], parts), "\n")[0].as_py() + "\n"
        words = WORDS.findall(text.lower())
        distinct = list(dict.fromkeys(words))
        place = dict(zip(distinct, range(len(distinct))))
        places = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        edges = np.concatenate(([0], np.flatnonzero(places == place["\n"])))
        return joined(pa.array(self.lookup(distinct), pa.large_binary()), pa.array(places), edges)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Little-endian 32-bit ids of each text (null: none), each with ``END_ID`` at its end."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        parts = split.flatten().dictionary_encode()
        is_plain = pc.match_substring_regex(parts.dictionary, PLAIN)
        odd = parts.dictionary.filter(pc.invert(is_plain))
        encoded = self.tokenizer.encode_batch_fast(odd.to_pylist(), add_special_tokens=False)
        odd_ids = pa.array([array("I", e.ids).tobytes() for e in encoded], pa.large_binary())
        plain = parts.dictionary.filter(is_plain)
        known = pa.concat_arrays([self.plain(plain), odd_ids]) if len(plain) else odd_ids
        # where each part of the dictionary stands among the known ones
        order = np.argsort(np.argsort(~is_plain.to_numpy(zero_copy_only=False), kind="stable"))
        edges = np.asarray(split.offsets) - split.offsets[0].as_py()
        end = END_ID.to_bytes(4, "little")
        return [b.as_py() + end for b in joined(known, pa.array(order[parts.indices.to_numpy()]), edges)]


@functools.lru_cache(maxsize=2)
def encoder(path: str, memo: int) -> Encoder:
    """A worker's encoder, kept for its later tasks."""
    return Encoder(path, memo)


def slices(batch: pa.RecordBatch, sizes: pa.Array, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose sizes sum up to ``most`` or, of one row, more."""
    total = np.cumsum(sizes.to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def pieces(documents: DataFrame, tokenizer: str, limit: int, id_col: str, text_col: str, memo: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, memo)
        for batch in batches:
            for part in slices(batch, pc.fill_null(pc.binary_length(batch.column(1)), 0), AT_ONCE):
                rows = []
                for row, ids in enumerate(own.encode(part.column(1))):
                    for piece, at in enumerate(range(0, len(ids), 4 * limit)):
                        b = ids[at : at + 4 * limit]
                        rows.append((row, piece, at // 4, len(b) // 4, zlib.crc32(b)))
                row, piece, start, length, crc = (np.array(c, np.int64) for c in zip(*rows))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    chosen = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    small_batches(documents)
    return chosen.mapInArrow(tidy(run), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 with least |a x - b|, by the active-set method of Lawson and Hanson."""
    x = np.zeros(a.shape[1])
    on: list[int] = []
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[on] = -np.inf
        j = int(np.argmax(slope))
        if slope[j] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        on.append(j)
        while True:
            z = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if (z > 0).all():
                break
            old = x[on]
            low = z <= 0
            step = np.min(old[low] / np.maximum(old[low] - z[low], 1e-300))
            x[on] = old + step * (z - old)
            on = [i for i in on if x[i] > 1e-12]
            x[[i for i in range(len(x)) if i not in set(on)]] = 0
            if not on:
                z = np.zeros(0)
                break
        x[:] = 0
        x[on] = z
    return x


def patterns(tops: list[int], limit: int, slack: int, most: int) -> list[tuple[int, ...]]:
    """Non-increasing tuples of up to ``most`` class indices whose top lengths fill all but ``slack``."""
    found: list[tuple[int, ...]] = []

    def grow(so_far: tuple[int, ...], left: int, last: int) -> None:
        if left <= slack and so_far:
            found.append(so_far)
        if len(so_far) < most:
            for i in range(min(last, bisect.bisect_right(tops, left) - 1), -1, -1):
                if left - tops[i] > slack and tops[i] * (most - len(so_far)) < left - slack:
                    break
                grow((*so_far, i), left - tops[i], i)

    grow((), limit, len(tops) - 1)
    return found


def plan(histogram: dict[int, int], limit: int, classes: int = 40, most: int = 4, filler: int = 16) -> list[tuple[int, tuple[int, ...]]]:
    """(repeats, lengths) of sequences that hold each length as often as the histogram has it.

    Lengths under ``limit // filler`` are kept out of the patterns; they fill gaps.
    """
    left = {n: c for n, c in sorted(histogram.items()) if c}
    runs = [(left.pop(limit), (limit,))] if limit in left else []
    long = [n for n in left if n >= limit // filler]
    packed: list[tuple[int, tuple[int, ...]]] = []
    if long:
        weight = np.cumsum([left[n] for n in long])
        cuts = sorted({long[int(np.searchsorted(weight, weight[-1] * (i + 1) / classes))] for i in range(classes)})
        members = [[n for n in long if lo < n <= hi] for lo, hi in zip([0, *cuts], cuts)]
        counts = np.array([sum(left[n] for n in m) for m in members], float)
        found = patterns(cuts, limit, limit // 64, most)
        if found:
            a = np.zeros((len(cuts), len(found)))
            for j, p in enumerate(found):
                for i in p:
                    a[i, j] += 1
            x = np.floor(nnls(a, counts) + 1e-6)
            room = counts.copy()
            for j in sorted(np.flatnonzero(x), key=lambda j: -x[j]):
                n = int(min(x[j], *(room[i] // a[i, j] for i in set(found[j]))))
                if n:
                    room -= n * a[:, j]
                    packed += _runs(n, found[j], members, left)
    return runs + best_fit(packed, left, limit)


def _runs(n: int, pattern: tuple[int, ...], members: list[list[int]], left: dict[int, int]) -> list[tuple[int, tuple[int, ...]]]:
    """n repeats of a pattern of classes as runs of actual lengths, the longest first, taken from ``left``."""
    slots = []
    for i in pattern:
        need, runs = n, []
        for length in reversed(members[i]):
            k = min(need, left.get(length, 0))
            if k:
                runs.append([k, length])
                left[length] -= k
                need -= k
            if not need:
                break
        slots.append(runs)
    out, at = [], [0] * len(slots)
    while n:
        k = min(runs[i][0] for runs, i in zip(slots, at))
        out.append((k, tuple(runs[i][1] for runs, i in zip(slots, at))))
        for s, runs in enumerate(slots):
            runs[at[s]][0] -= k
            at[s] += runs[at[s]][0] == 0
        n -= k
    return out


def best_fit(runs: list[tuple[int, tuple[int, ...]]], left: dict[int, int], limit: int) -> list[tuple[int, tuple[int, ...]]]:
    """Adds the lengths in ``left``, longest first, each to the fullest sequences that have room."""
    by_gap: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    for n, lengths in runs:
        by_gap[limit - sum(lengths)].append((n, lengths))
    gaps = sorted(by_gap)

    def put(gap: int, run: tuple[int, tuple[int, ...]]) -> None:
        if not by_gap[gap]:
            i = bisect.bisect_left(gaps, gap)
            if i == len(gaps) or gaps[i] != gap:
                gaps.insert(i, gap)
        by_gap[gap].append(run)

    for length in sorted(left, reverse=True):
        need = left[length]
        while need:
            i = bisect.bisect_left(gaps, length)
            if i == len(gaps):
                fit = limit // length
                n = max(1, need // fit)
                k = min(fit, need)
                put(limit - k * length, (n, (length,) * k))
                need -= n * k
                continue
            gap = gaps[i]
            n, lengths = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps.pop(i)
            fit = gap // length
            if need >= n * fit:
                k, m = fit, n
            else:
                k, m = (fit, need // fit) if need >= fit else (need, 1)
            if m < n:
                put(gap, (n - m, lengths))
            put(gap - k * length, (m, lengths + (length,) * k))
            need -= m * k
    return [run for gap in sorted(by_gap) for run in by_gap[gap]]


def slots(runs: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the first rank, first sequence and offset of each run of places, by rank."""
    out: dict[int, list[list[int]]] = defaultdict(lambda: [[0], [], []])
    sequence = 0
    for n, lengths in runs:
        at = 0
        for length in lengths:
            ranks, sequences, offsets = out[length]
            ranks.append(ranks[-1] + n)
            sequences.append(sequence)
            offsets.append(at)
            at += length
        sequence += n
    return {length: (np.array(r[:-1]), np.array(s), np.array(o)) for length, (r, s, o) in out.items()}


def packed(documents: DataFrame, tokenizer: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", memo: int = MEMO) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids end with ``END_ID``, so an empty or null text is a piece of one token. Texts
    of more than ``limit`` ids are cut every ``limit``. Repeated rows are packed each; null ids are
    allowed; an empty table gives no rows; other columns are ignored. ``memo`` bounds the words whose
    ids a worker keeps: memory against time, the result is the same.
    """
    own = pieces(documents, tokenizer, limit, id_col, text_col, memo)
    # the place in its partition, which cut() fixes, deals copies of one row to all buckets
    own = cut(own.withColumn("deal", F.xxhash64("doc_id", "piece", F.monotonically_increasing_id())))
    own = own.withColumn("bucket", F.pmod("deal", F.lit(max(64, -(-own.count() // BUCKET)))).cast("int"))
    counts = cut(own.groupBy("length", "bucket").count())
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}
    before = F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "deal"))
    ranked = own.withColumn("n", place).join(offsets, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("n") - 1)
    places = documents.sparkSession.sparkContext.broadcast(slots(plan(histogram, limit)))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                ranks, sequences, offs = table[int(n)]
                i = np.searchsorted(ranks, rank[at], "right") - 1
                sequence[at] = sequences[i] + rank[at] - ranks[i]
                offset[at] = offs[i]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    chosen = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(tidy(locate), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
