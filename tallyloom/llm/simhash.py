"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits of each other have a point halfway, so it is enough that
every fingerprint emits the points within half the radius of itself and that rows meet on equal
points. Emitting the whole ball of a 64-bit fingerprint (2081 points for radius 4) would write
about eight times the documents' own bytes. So the fingerprint is first cut in ``BLOCKS`` blocks:
of 4 differing bits, at most 2 are left once the block with most of them is masked out, and the
ball of half that radius around each masked fingerprint has only 1 + 43 points (131 in all).

A point where many fingerprints meet is not expanded into pairs: fingerprints that share a point
with more than ``REACH`` others go through the whole ball instead, where all that meet on a point
are linked by construction and each is tied to the first of them.

Removal of near-duplicates takes these links as well: an exact comparison of shingle sets follows
them, and prefix filtering finds the similar pairs that lie further apart than the radius.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, keyed_join, named, small, small_batches, tidy
from .components import components

BITS, BLOCKS, REACH = 64, 3, 32
#: Words of a shingle of fingerprints.
SHINGLE = 4
#: Keys of 16 bytes that may be broadcast, after counting; more are joined by shuffling.
BROADCAST = 500_000
#: Shingles whose bits are added up at once.
STEP = 1 << 16
#: Counters of shingles for each text, the bits of the number of the fewest and of the most counters, and of those that go together.
COUNTERS, FEWEST, MOST, TOGETHER = 8, 16, 24, 16
#: Candidate pairs that a task holds before it passes them on.
PASS_ON = 100_000
#: Bits of the parities that go to the points with a set.
SKETCH = 1_024


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: bytes | None, n: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of n words, the whole text if it has fewer; none without words."""
    parts = (text or b"").lower().split()  # bytes: lowers A-Z, splits on space and \t\n\v\f\r
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) <= n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), 42)], np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(parts) - n + 1].tolist()
    stops = (ends[n - 1 :] - 1).tolist()
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[i:j], 42) for i, j in zip(starts, stops)]), ">u8").astype(np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes; zero for none."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), STEP):
        counts += np.unpackbits(hashes[i : i + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(documents: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc_id, fp) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(shingle_hashes(t.as_py(), shingle)) for t in batch.column(1)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    chosen = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    small_batches(documents)
    return chosen.mapInArrow(tidy(run), "doc_id bigint, fp bigint")


def masked_balls() -> list[tuple[int, list[int]]]:
    """(mask, flips) for each masked-out block; a flip also marks the block, whose bits are free."""
    edges = [BITS * i // BLOCKS for i in range(BLOCKS + 1)]
    out = []
    for low, high in zip(edges, edges[1:]):
        block = ((1 << high) - 1) ^ ((1 << low) - 1)
        mask = ((1 << BITS) - 1) ^ block
        out.append((mask, [(1 << low)] + [(1 << low) | (1 << b) for b in range(BITS) if mask >> b & 1]))
    return out


def whole_ball(half: int = 2) -> list[int]:
    """Flips of up to ``half`` (2 at most) of all bits."""
    one = [1 << b for b in range(BITS)]
    return [0, *one, *(a | b for i, a in enumerate(one) for b in one[:i])][: None if half == 2 else 1 + BITS * half]


def points(fps: DataFrame, balls: list[tuple[int, list[int]]]) -> DataFrame:
    """(point, fp) for each point that each fingerprint emits, sorted by point within partitions."""

    def ball(mask: int, flips: list[int]) -> Column:
        return F.transform(F.array(*(F.lit(signed(v)) for v in flips)), lambda v: F.col("fp").bitwiseAND(F.lit(signed(mask))).bitwiseXOR(v))

    sets = [ball(mask, flips) for mask, flips in balls]
    emitted = fps.select("fp", F.explode_outer(F.concat(*sets)).alias("point"))
    return emitted.repartition("point").sortWithinPartitions("point", "fp").select("point", "fp")


def first_point(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the points on which two fingerprints of ``masked_balls`` meet, the one that speaks for the pair:
    the least under the first mask that leaves them two or fewer differing bits."""
    out, unset = np.zeros(len(x), np.int64), np.ones(len(x), bool)
    for mask, flips in masked_balls():
        a, b = x & np.int64(signed(mask)), y & np.int64(signed(mask))
        apart = a ^ b
        n, low = np.bitwise_count(apart.view(np.uint64)), apart & -apart
        point = np.where(n == 2, np.minimum(a ^ low, b ^ low), np.minimum(a, b)) ^ np.int64(signed(flips[0]))
        take = unset & (n <= 2)
        out[take] = point[take]
        unset &= ~take
    return out


def meetings(radius: int, reach: int):
    """Batches sorted by (point, fp) to rows (a, b): links, or b null where a meets too many."""

    def unique(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        keep = np.ones(len(a), bool)
        keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return a[keep], b[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        point, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            old = len(point)
            point = np.concatenate((point, batch.column(0).to_numpy()))
            fp = np.concatenate((fp, batch.column(1).to_numpy()))
            n, busy = len(point), np.zeros(len(point), bool)
            far = np.flatnonzero(point[reach:] == point[:-reach]) if n > reach else np.zeros(0, np.int64)
            busy[far], busy[far + reach] = True, True
            # the place of a row that each is tied to by the links so far; those of one need no more links
            group = np.arange(n)
            a, b = [], []
            for j in range(1, min(reach, n - 1) + 1):
                at = np.arange(max(old, j), n)
                at = at[point[at] == point[at - j]]
                if not len(at):
                    break
                at = at[~(busy[at] & busy[at - j])]
                x, y = fp[at - j], fp[at]
                near = at[(np.bitwise_count((x ^ y).view(np.uint64)) <= radius) & (x != y) & (group[at - j] != group[at])]
                near = near[first_point(fp[near - j], fp[near]) == point[near]]  # each pair once, not on all its points
                if len(near):
                    a.append(fp[near - j])
                    b.append(fp[near])
                    low = np.minimum(group[near - j], group[near])
                    np.minimum.at(group, near, low)
                    np.minimum.at(group, near - j, low)
                    for _ in range(reach.bit_length()):
                        group = group[group]
            a, b = unique(np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])
            hot = np.unique(fp[busy])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((a, hot))), pa.array(np.concatenate((b, hot)), mask=np.arange(len(a) + len(hot)) >= len(a))], ["a", "b"])
            point, fp = point[-reach:], fp[-reach:]

    return run


def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (point, fp) to links between each fp and the first one on its point."""
    last, head = None, 0
    for batch in batches:
        point, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(point):
            continue
        new = np.ones(len(point), bool)
        new[1:] = point[1:] != point[:-1]
        new[0] = last is None or point[0] != last
        start = np.maximum.accumulate(np.where(new, np.arange(len(point)), -1))
        first = np.where(start >= 0, fp[start], head)
        last, head = point[-1], first[-1]
        pairs = np.unique(np.stack((first, fp), 1)[first != fp], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def fingerprint_links(fps: DataFrame, radius: int = 4, reach: int = REACH) -> DataFrame:
    """Links (a, b) that connect just the fingerprints within ``radius`` (4 at most) bits.

    Not every such pair is among them, but every such pair is connected through them.
    """
    met = cut(points(fps, masked_balls()).mapInArrow(tidy(meetings(radius, reach)), "a bigint, b bigint").distinct())
    hot = met.filter(F.col("b").isNull()).select(F.col("a").alias("fp"))
    ball = [((1 << BITS) - 1, whole_ball())]
    return met.filter(F.col("b").isNotNull()).unionByName(points(hot, ball).mapInArrow(tidy(firsts), "a bigint, b bigint")).distinct()


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the least doc_id among all rows whose fingerprints can be reached by steps of
    4 or fewer bits. Null and blank texts have fingerprint zero and are linked like any other.
    A null id gets a row and counts for no component_id (null where a component has no other).
    Repeated rows stay repeated. Other columns are ignored; an empty table gives no rows.
    """
    docs = cut(fingerprints(documents, id_col, text_col, shingle))
    nodes = docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    roots = components(fingerprint_links(nodes.select("fp")))
    labelled = cut(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    lowest = labelled.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
    named = keyed_join(labelled.select("fp", "root"), lowest.select("root", "component_id"), "root", lowest, "m").select("fp", "component_id")
    return keyed_join(docs, named, "fp", labelled, "n").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, n))


def parities(hashes: np.ndarray, bits: int | None = None) -> np.ndarray:
    """Packed bits, a power of two of them: whether an odd number of hashes end in each bit's number."""
    bits = bits or (max(8, 1 << (len(hashes) - 1).bit_length()) if len(hashes) else 8)
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def least_apart(x: np.ndarray, y: np.ndarray) -> int:
    """No more than the hashes that stand in one of two sets only, from their parities."""
    if len(x) > len(y):
        x, y = y, x
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def rounded_up(x: float) -> int:
    """The least whole number that isn't below ``x`` but for errors of rounding."""
    return math.ceil(x - 1e-9)


def prefix(hashes: np.ndarray, often: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest of a set's hashes, as many as it takes to meet every similar set in one of them.

    often: how often the hashes of each counter are met. Any fixed order would do.
    """
    count = often[counter(hashes, len(often))]
    return hashes[np.lexsort((hashes, count))[: len(hashes) - rounded_up(similarity * len(hashes)) + 1]]


def counter(hashes: np.ndarray, counters: int) -> np.ndarray:
    """The numbers of the hashes' counters; there are a power of two of them."""
    return (hashes & np.uint64(counters - 1)).astype(np.int64)


def frequent(own: DataFrame, shingle: int) -> np.ndarray:
    """By counter, how often its shingles stand in all texts, in eighths of a power of two; own has t.

    Every shingle of every text is counted. Counters are as many as ``COUNTERS`` a text ask for, within
    2 ** ``FEWEST`` and 2 ** ``MOST``; shingles that share one are taken for as frequent as both together.
    """
    counters = 1 << min(MOST, max(FEWEST, (own.count() * COUNTERS).bit_length()))
    part = 1 << TOGETHER

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(counters, np.int64)
        for batch in batches:
            found = [shingle_set(t.as_py(), shingle) for t in batch.column(0)]
            at, n = np.unique(counter(np.concatenate([np.zeros(0, np.uint64), *found]), counters), return_counts=True)
            counts[at] += n
        for i in range(0, counters, part):
            if counts[i : i + part].any():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([counts[i : i + part].tobytes()], pa.binary())], ["i", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, n in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts[i] = counts.get(i, 0) + np.frombuffer(n.as_py(), np.int64)
        for i, n in counts.items():
            level = np.round(8 * np.log2(n + 1)).clip(max=255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([level.tobytes()], pa.binary())], ["i", "n"])

    schema = "i bigint, n binary"
    often = np.zeros(counters, np.uint8)
    for r in own.select("t").mapInArrow(tidy(count), schema).repartition("i").mapInArrow(tidy(add), schema).collect():  # a byte a counter
        often[r.i : r.i + part] = np.frombuffer(r.n, np.uint8)
    return often


def crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches sorted by (point, node), without repeated rows and those alone on their point."""
    last: pa.RecordBatch | None = None
    for batch in batches:
        if last is not None:
            batch = pa.concat_batches([last, batch])
        if batch.num_rows < 2:
            last = batch
            continue
        # the rows of the last point wait for the next batch
        point, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        end = int(np.searchsorted(point, point[-1]))
        last = batch.slice(end)
        yield _shared(batch.slice(0, end), point[:end], node[:end])
    if last is not None:
        yield _shared(last, last.column(0).to_numpy(), last.column(1).to_numpy())


def _shared(batch: pa.RecordBatch, point: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    fresh = np.ones(len(point), bool)
    fresh[1:] = (point[1:] != point[:-1]) | (node[1:] != node[:-1])
    at = np.flatnonzero(fresh)
    point = point[at]
    same = np.zeros(len(at) + 1, bool)
    same[1:-1] = point[1:] == point[:-1]
    return batch.take(pa.array(at[same[:-1] | same[1:]]))


def meeting_pairs(similarity: float, neighbours: bool):
    """Rows (point, node, n, root, sketch) in order of points to distinct pairs (a, b) that meet on one.

    Pairs of one root are left out, as are those whose sizes, places on the point or sketches forbid
    the similarity; a negative n marks a row that only larger sets' rule needs. ``neighbours``: of
    each point just the pairs that stand next to each other, and those of the first with all others.
    """

    def pairs_of(point: np.ndarray, node: np.ndarray, n: np.ndarray, root: np.ndarray, sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        size, short = np.abs(n).astype(np.int64), n > 0

        def met(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            small_x = (size[x] < size[y]) | ((size[x] == size[y]) & short[x])
            less, more = np.where(small_x, x, y), np.where(small_x, y, x)
            good = (root[x] != root[y]) & short[less] & (size[less] >= similarity * size[more] - 1e-9)
            x, y = x[good], y[good]
            apart = np.bitwise_count(sketch[x] ^ sketch[y]).sum(1, dtype=np.int64)
            good = apart * (1 + similarity) <= (1 - similarity) * (size[x] + size[y]) + 1e-6
            x, y = node[x[good]], node[y[good]]
            return np.stack((np.minimum(x, y), np.maximum(x, y)), 1)

        def places() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            at, j = np.arange(1, len(point)), 1
            while len(at):
                at = at[point[at] == point[at - j]]
                yield at, at - j
                if neighbours:
                    first = np.searchsorted(point, point)
                    rest = np.flatnonzero(first < np.arange(len(point)) - 1)
                    yield rest, first[rest]
                    return
                j += 1
                at = at[at >= j]

        for x, y in places():
            for lo in range(0, len(x), PASS_ON):  # a slice bounds what the comparisons hold
                found.append(met(x[lo : lo + PASS_ON], y[lo : lo + PASS_ON]))
                held += len(found[-1])
                if held > PASS_ON:
                    yield rows(found)
                    found, held = [], 0
        yield rows(found)

    def rows(found: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int64)] + [np.zeros((0, SKETCH // 64), np.uint64)]
        for batch in batches:
            sketch = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint64).reshape(-1, SKETCH // 64)
            new = [*(c.to_numpy() for c in batch.columns[:4]), sketch]
            columns = [np.concatenate((c, x)) for c, x in zip(columns, new)]
            if len(columns[0]):
                end = int(np.searchsorted(columns[0], columns[0][-1]))
                yield from pairs_of(*(c[:end] for c in columns))
                columns = [c[end:] for c in columns]
        yield from pairs_of(*columns)

    return run


def verified(pairs: DataFrame, marks: DataFrame, own: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are as similar as asked; marks: node, n, odd, k1, k2.

    The parities of two sets bound from below how many shingles they don't share; what passes is
    compared shingle by shingle.
    """

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y, n, m in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                apart = least_apart(np.frombuffer(x.as_py(), np.uint8), np.frombuffer(y.as_py(), np.uint8))
                good.append(apart * (1 + similarity) <= (1 - similarity) * (n + m) + 1e-6)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    def both_ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()

    pairs = cut(pairs)
    marks = cut(marks.join(small(both_ends(pairs), BROADCAST), "node").select("node", "n", "odd", "k1", "k2"))
    left, right = marks.select(F.col("node").alias("a"), F.col("odd").alias("x"), F.col("n").alias("n")), marks.select(F.col("node").alias("b"), F.col("odd").alias("y"), F.col("n").alias("m"))
    pairs = cut(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", "n", "m").mapInArrow(tidy(possible), "a bigint, b bigint"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t.as_py(), shingle).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "s"])

    keys = cut(marks.join(both_ends(pairs), "node").select("node", "k1", "k2"))
    sets_of = cut(own.join(small(keys, BROADCAST), ["k1", "k2"]).dropDuplicates(["node"]).select("node", "t").mapInArrow(tidy(sets), "node bigint, s binary"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    left, right = sets_of.select(F.col("node").alias("a"), F.col("s").alias("x")), sets_of.select(F.col("node").alias("b"), F.col("s").alias("y"))
    return cut(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(tidy(verify), "a bigint, b bigint"))


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that connect all whose fingerprints are equal or within the radius; docs: node, fp."""
    nodes = cut(docs.select("fp", "node").distinct())
    heads = cut(nodes.groupBy("fp").agg(F.min("node").alias("head"), F.count("*").alias("n")))
    links = fingerprint_links(heads.select("fp"))
    left, right = heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), heads.select(F.col("fp").alias("b"), F.col("head").alias("y"))
    near = links.join(left, "a").join(right, "b").select("x", "y")
    same = keyed_join(nodes, heads.select("fp", "head"), "fp", heads, "n").select(F.col("head").alias("x"), F.col("node").alias("y"))
    return near.unionByName(same.filter("x <> y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def similar_roots(docs: DataFrame, own: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node, root) of the groups of nodes connected by pairs as similar as asked; none is left out.

    docs: node, fp, n, odd, sketch, first, k1, k2 of every text; own: k1, k2, t. Nodes whose fingerprints
    link are compared exactly; those of similar sets that are further apart meet otherwise. Two sets of
    similarity s share one of the rarest 1 - s of their shingles (prefix filtering), and one of the rarest
    1 - 2s / (1 + s) of the smaller. So nodes meet on these, whatever the size of their groups. In
    a first pass, with the linked fingerprints, only neighbours on a point and the first of them with all
    others are compared, which connects nearly all of a dense group; in the second every pair that meets and
    isn't connected yet. Sketches of the sets go with the points and rule out most pairs where they meet.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            if len(seen) > PASS_ON:
                seen.clear()
            points, nodes, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for node, n, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if node in seen or not n:
                    continue
                seen.add(node)
                point = np.frombuffer(first.as_py(), np.int64)
                points.append(point)
                nodes.append(np.full(len(point), node, np.int64))
                short = n - rounded_up(2 * similarity / (1 + similarity) * n) + 1
                sizes.append(np.where(np.arange(len(point)) < short, n, -n).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (points, nodes, sizes)], ["point", "node", "n"])

    emitted = docs.select("node", "n", "first").mapInArrow(tidy(emit), "point bigint, node bigint, n int").repartition("point").sortWithinPartitions("point", "node")
    shared = cut(emitted.mapInArrow(tidy(crowded), "point bigint, node bigint, n int"))
    # of how many points a set stands on with others; one that many are copies of stands on most
    often = shared.groupBy("node").agg(F.count("*").alias("often"))
    marks = cut(docs.dropDuplicates(["node"]).select("node", F.col("n").alias("size"), "odd", "sketch", "k1", "k2").join(often, "node"))
    shared = cut(shared.join(marks.select("node", "sketch", "often"), "node"))
    marks = marks.select("node", F.col("size").alias("n"), "odd", "k1", "k2")
    meet = lambda rows, near: rows.select("point", "node", "n", "root", "sketch").mapInArrow(tidy(meeting_pairs(similarity, near)), "a bigint, b bigint").distinct()
    # those that are often met first, all others in another order on each point
    alone = shared.withColumn("root", F.col("node")).repartition("point").sortWithinPartitions("point", F.desc("often"), F.xxhash64("point", "node"))
    links = verified(fingerprint_pairs(docs).unionByName(meet(alone, True)).distinct(), marks, own, shingle, similarity)
    roots = small(cut(components(links)), BROADCAST)
    rooted = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).repartition("point").sortWithinPartitions("point", "node")
    return components(links.unionByName(verified(meet(rooted, False), marks, own, shingle, similarity)))


def without_near_duplicates(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    similarity: float = 0.8,
) -> DataFrame:
    """The input rows without all but one of each group of near-duplicates, with their columns.

    Groups are connected by all links of at least ``similarity`` (Jaccard of ``shingle``-word
    sets), found by fingerprints within the radius first and by prefix filtering beyond it. Texts of equal sets are one node, and of all texts without words one stays. The row with
    the least id stays (a null id only if its group has no other; one of rows that repeat id and
    text).
    """
    key = [F.xxhash64(id_col, text_col), F.xxhash64(text_col, F.lit(1))]
    text = F.col(text_col).cast("binary")
    own = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), key[0].alias("k1"), key[1].alias("k2"), text.alias("t"))
    small_batches(documents)
    often = frequent(own, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, fp, n, odd, sketch, first = [], [], [], [], [], []
            for t in batch.column(3):
                t = t.as_py()
                h = shingle_set(t, shingle)
                fp.append(fingerprint(shingle_hashes(t, SHINGLE)))
                node.append(signed(xxhash.xxh64_intdigest(h.tobytes(), 42)))
                n.append(len(h))
                odd.append(parities(h).tobytes())
                sketch.append(parities(h, SKETCH).tobytes())
                first.append(prefix(h, often, similarity).tobytes())
            columns = [pa.array(node, pa.int64()), pa.array(fp, pa.int64()), pa.array(n, pa.int32()), *(pa.array(c, pa.binary()) for c in (odd, sketch, first))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *columns], ["doc_id", "k1", "k2", "node", "fp", "n", "odd", "sketch", "first"])

    docs = cut(own.mapInArrow(tidy(run), "doc_id bigint, k1 bigint, k2 bigint, node bigint, fp bigint, n int, odd binary, sketch binary, first binary"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2"))
    nodes = cut(docs.groupBy("node").agg(least.alias("least")))
    roots = similar_roots(docs, own, shingle, similarity)
    tied = cut(nodes.join(roots, "node", "left").select("least", "node", F.coalesce("root", "node").alias("root")))
    heads = tied.groupBy("root").agg(F.min(F.struct("least", "node")).alias("head")).select("head.node", "head.least.k1", "head.least.k2")
    # a text that stays is the first of its node; all other rows of docs go
    gone = docs.join(heads, ["k1", "k2", "node"], "left_anti").select("k1", "k2").distinct()
    twice = docs.groupBy("k1", "k2").agg(F.count("*").alias("n")).filter("n > 1").select("k1", "k2").join(heads, ["k1", "k2"], "left_semi")
    keyed = documents.select(F.struct(*named(documents.columns)).alias("_row"), key[0].alias("k1"), key[1].alias("k2"))
    keyed = keyed.join(small(cut(gone), BROADCAST), ["k1", "k2"], "left_anti")
    twice = cut(twice)
    if not twice.limit(1).count():
        return keyed.select("_row.*")
    twice = small(twice, BROADCAST)
    one = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("k1"))
    repeated = keyed.join(twice, ["k1", "k2"], "left_semi").withColumn("_n", one).filter("_n = 1")
    return keyed.join(twice, ["k1", "k2"], "left_anti").select("_row.*").unionByName(repeated.select("_row.*"))
