"""Hard negatives by distributed radix selection.

A window is an anchor, whether it takes the anchor's label or the others, and a range of whole
scores; the k rows of a window that come first (higher score, then smaller id) are wanted. Scores
are never stored, nor is a window's list of rows: every block of rows counts, for each window, how
many of its scores lie in each of ``DIGITS`` equal parts of the range; Spark adds the histograms of
the blocks up, and running sums over a window's parts locate the one that holds the k-th row. A
block counts no part beyond the one that holds its own k-th row, since the table's k-th row lies at
or before it, so a histogram has k parts at most. The window shrinks to that part and the next digit refines it, until no more than ``FEW`` rows lie at
or before the part. Where a single score is left and more rows hold it, the digits of the ids go
on. Then one pass gathers the rows up to each window's bound, ``FEW`` a window at most, and these
are ranked.

An anchor's first window takes its own label and gives its positives; each positive opens a window
on the other labels, between its score's hundredths. Rows lie in blocks of one binary each, and
blocks of rows meet blocks of anchors: products grow with rows x anchors, as they must, what is
shuffled for a digit with rows x anchors / block. A task holds ``SCORES`` scores at once.

Defined results: rows with a null label, id or vector, an empty vector, any null or non-finite
component, or another dimension than most rows take no part; rows that repeat id, label and vector
are one; rows of one id that differ are rows of their own, also as anchors, and tie by a hash of
label and vector; scaled components are held within the square root of 2**62 / dimension, so that
scores fit 64 bits; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, named, tidy

DIGITS, FEW = 256, 64
#: Bytes of the vectors of a block, and the most rows and the least number of blocks.
BLOCK_BYTES, BLOCK_ROWS, BLOCKS = 8 << 20, 1 << 16, 32
#: The most anchors of a block, and scores of a block's rows and anchors that are computed at once.
ANCHORS, SCORES = 1 << 12, 1 << 20
#: Ids are refined in two halves.
LOW = (1 << 32) - 1


def finite(v: Column) -> Column:
    """Vectors of one component or more, none of them null, NaN or infinite."""
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))), F.lit(False))


def largest(q: np.ndarray) -> int:
    """The largest amount of whole numbers."""
    return max(int(q.max(initial=0)), -int(q.min(initial=0)))


class Block:
    """Rows of a block: keys in the order of a selection, all ascending. The first key, the score with its sign turned, depends on the anchor."""

    def __init__(self, block: pd.Series):
        read = lambda c: np.frombuffer(block[c], np.int64)
        self.ids, self.tags, self.labels = read("ids"), read("tags"), read("labels")
        self.q = np.frombuffer(block["q"], f"i{block['width']}").reshape(len(self.ids), -1)
        self.doubles, self.most = self.q.astype(np.float64), largest(self.q)
        self.later = [self.ids >> 32, self.ids & LOW, self.tags]

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products of whole numbers, exact: in doubles where these hold them, (anchors, rows)."""
        if self.most * largest(anchors) * anchors.shape[1] < 1 << 53:
            return (anchors.astype(np.float64) @ self.doubles.T).astype(np.int64)
        return anchors @ self.q.T.astype(np.int64)


class Asked:
    """An anchor and its windows, met with a block."""

    def __init__(self, block: Block, score: np.ndarray, anchor: dict):
        self.block, self.score, self.anchor = block, score, anchor
        own = block.labels == anchor["label"]
        self.kinds = {True: own & ~((block.ids == anchor["aid"]) & (block.tags == anchor["atag"])), False: ~own}
        self.sorted: dict[bool, np.ndarray] = {}

    def windows(self) -> Iterator[tuple]:
        a = self.anchor
        return zip(a["w"], a["same"], a["start"], a["level"], a["fixed"], a["lo"], a["hi"], a["shift"], a["before"])

    def counts(self, same: bool, level: int, fixed: np.ndarray, lo: int, hi: int, shift: int, need: int) -> tuple[np.ndarray, np.ndarray]:
        """The parts of [lo, hi] of the window's key with rows in them, and how many; none beyond that of row ``need``."""
        if level == 0:
            if same not in self.sorted:
                self.sorted[same] = np.sort(-self.score[self.kinds[same]])
            key = self.sorted[same]
        else:
            there = self.kinds[same] & (-self.score == fixed[0])
            for key, f in zip(self.block.later, fixed[1:level]):
                there &= key == f
            key = np.sort(self.block.later[level - 1][there])
        key = key[np.searchsorted(key, lo) : np.searchsorted(key, hi, side="right")]
        parts = ((key - lo).view(np.uint64) >> np.uint64(shift)).astype(np.int64)
        if len(parts) > need:
            parts = parts[: np.searchsorted(parts, parts[need - 1], side="right")]
        return np.unique(parts, return_counts=True)

    def reached(self, same: bool, start: int, level: int, fixed: np.ndarray, hi: int) -> np.ndarray:
        """Places of the rows up to the window's bound."""
        keys = [-self.score, *self.block.later]
        there, before = keys[level] <= hi, keys[level] < hi
        for key, f in zip(reversed(keys[:level]), reversed(list(fixed[:level]))):
            there = (key < f) | ((key == f) & there)
        return np.flatnonzero(there & self.kinds[same] & (keys[0] >= start))


def of_blocks(block: pd.DataFrame, anchors: pd.DataFrame, run: Callable[[Asked], list[tuple]]) -> list[tuple]:
    if block.empty or anchors.empty:
        return []
    rows, out = Block(block.iloc[0]), []
    step = max(1, SCORES // len(rows.ids))
    for at in range(0, len(anchors), step):
        some = anchors.iloc[at : at + step]
        scores = rows.scores(np.frombuffer(b"".join(some["q"]), np.int64).reshape(len(some), -1))
        for score, anchor in zip(scores, some.to_dict("records")):
            out += run(Asked(rows, score, anchor))
    return out


class Table:
    """Rows in blocks, anchors, and what windows need to know of all rows."""

    def __init__(self, vectors: DataFrame, anchor: Column, label: Column, id_col: str, vector_col: str, scale: float, block_bytes: int):
        key, vector = named([id_col, vector_col])
        rows = vectors.select(key.cast("bigint").alias("id"), label.cast("bigint").alias("label"), vector.cast("array<double>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("asks"))
        rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("v")))
        most = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
        d = most.d if most else 1
        held = math.isqrt((1 << 62) // d)

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                with np.errstate(over="ignore"):
                    q = np.clip(np.floor(scale * x), -held, held).astype(np.int64)
                norm = np.sqrt((q.astype(np.float64) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([r.tobytes() for r in q], pa.binary()), pa.array(norm)], ["id", "tag", "label", "asks", "q", "norm"])

        tag = F.shiftrightunsigned(F.xxhash64("label", "v"), 2)
        rows = rows.filter(F.size("v") == d).select("id", tag.alias("tag"), "label", "asks", "v")
        rows = rows.mapInArrow(tidy(whole), "id bigint, tag bigint, label bigint, asks boolean, q binary, norm double")
        rows = cut(rows.groupBy("id", "tag", "label", "q", "norm").agg(F.bool_or("asks").alias("asks")))
        known = rows.agg(F.count("*"), F.count_if("asks"), F.min("id"), F.max("id"), F.coalesce(F.max("norm"), F.lit(0.0))).first()
        n, n_anchors, least, greatest, self.norm = known
        self.block = max(1, min(BLOCK_ROWS, block_bytes // (8 * d)))
        n_blocks, self.anchor_blocks = max(BLOCKS, -(-n // self.block)), max(1, -(-n_anchors // min(self.block, ANCHORS)))
        # ranges of the keys after the score
        high = (least >> 32, greatest >> 32) if n else (0, 0)
        self.ranges = [high, (least & LOW, greatest & LOW) if n and high[0] == high[1] else (0, LOW), (0, (1 << 62) - 1)]

        def pack(part: pd.DataFrame) -> pd.DataFrame:
            as_bytes = lambda c: part[c].to_numpy(np.int64).tobytes()
            q = np.frombuffer(b"".join(part["q"]), np.int64)
            width = next(w for w in (2, 4, 8) if largest(q) < 1 << (8 * w - 1))
            return pd.DataFrame({"rb": part["rb"].iloc[:1], "ids": [as_bytes("id")], "tags": [as_bytes("tag")], "labels": [as_bytes("label")], "q": [q.astype(f"i{width}").tobytes()], "width": width})

        dealt = rows.select("id", "tag", "label", "q", F.pmod(F.xxhash64("id", "tag"), F.lit(n_blocks)).cast("int").alias("rb"))
        self.blocks = cut(dealt.groupBy("rb").applyInPandas(pack, "rb int, ids binary, tags binary, labels binary, q binary, width int"))
        self.n_blocks = n_blocks
        ab = F.pmod(F.xxhash64("id", "tag", F.lit(1)), F.lit(self.anchor_blocks)).cast("int")
        self.anchors = rows.filter("asks").select(F.col("id").alias("aid"), F.col("tag").alias("atag"), "label", "q", "norm", ab.alias("ab"))

    def meet(self, windows: DataFrame, run: Callable[[Asked], list[tuple]], schema: str) -> DataFrame:
        """``run`` for every anchor with windows and every block of rows."""
        names = [f.split()[0] for f in schema.split(", ")]
        fields = ["w", "same", "start", "level", "fixed", "lo", "hi", "shift", "before"]
        # an anchor has as many windows as positives
        asked = windows.groupBy("aid", "atag").agg(F.collect_list(F.struct(*fields)).alias("of")).join(self.anchors.drop("norm"), ["aid", "atag"])
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        asked = asked.select("aid", "atag", "label", "q", "ab", each(self.n_blocks).alias("rb"), *(F.col(f"of.{f}").alias(f) for f in fields))
        blocks = self.blocks.select("*", each(self.anchor_blocks).alias("ab"))

        def met(block: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
            found = of_blocks(block, anchors, run)
            return pd.DataFrame({c: np.array([r[i] for r in found], np.int64) for i, c in enumerate(names)})

        return blocks.groupBy("rb", "ab").cogroup(asked.groupBy("rb", "ab")).applyInPandas(met, schema)

    def select(self, windows: DataFrame, k: int) -> DataFrame:
        """The first ``k`` rows of each window: its columns, then id, tag, score and place from 1 on.

        ``windows`` has aid, atag, same and the scores' bounds least and most, and any columns besides.
        """
        own = windows.columns
        bits = lambda lo, hi: F.greatest(F.lit(0), F.ceil(F.log2((hi - lo + 1).cast("double"))) - int(math.log2(DIGITS))).cast("int")
        # what is cut has its rows in place for good, so a number of a row stays its own
        state = cut(windows.filter(F.col("least") <= F.col("most"))).withColumn("w", F.monotonically_increasing_id())
        state = state.select(
            *own, "w", (-F.col("most")).alias("start"), F.lit(0).alias("level"), F.array(F.lit(0).cast("bigint")).alias("fixed"), (-F.col("most")).alias("lo"), (-F.col("least")).alias("hi"),
            F.lit(0).cast("bigint").alias("before"), F.lit(False).alias("done"),
        )

        def counted(asked: Asked) -> list[tuple]:
            out = []
            for w, same, _, level, fixed, lo, hi, shift, before in asked.windows():
                out += [(w, part, n) for part, n in zip(*asked.counts(bool(same), level, fixed, lo, hi, shift, k - before))]
            return out

        state = cut(state)
        while not (still := state.filter(~F.col("done")).withColumn("shift", bits(F.col("lo"), F.col("hi")))).isEmpty():
            parts = self.meet(still, counted, "w bigint, part bigint, n bigint").groupBy("w", "part").agg(F.sum("n").alias("n"))
            so_far = F.sum("n").over(Window.partitionBy("w").orderBy("part"))
            parts = still.join(parts.withColumn("so_far", so_far), "w").withColumn("first", F.col("before") + F.col("so_far") - F.col("n"))
            located = parts.filter((F.col("first") < k) & (F.col("first") + F.col("n") >= k))
            lo = F.col("lo") + F.expr("shiftleft(part, shift)")
            located = located.select("w", lo.alias("_lo"), F.least("hi", lo + F.expr("shiftleft(1L, shift)") - 1).alias("_hi"), "first", "n")
            following = state.filter(~F.col("done")).join(located, "w", "left")
            # without such a part the window has fewer rows than k, and all of them are reached
            there, few = F.col("_lo").isNotNull(), F.col("first") + F.col("n") <= FEW
            single = there & ~few & (F.col("_lo") == F.col("_hi"))
            bound = lambda side: F.element_at(F.array(*(F.lit(r[side]).cast("bigint") for r in self.ranges)), F.col("level") + 1)
            fixed = F.concat(F.slice("fixed", 1, F.col("level")), F.array("_lo"))
            following = following.select(
                *own, "w", "start", (F.col("level") + single.cast("int")).alias("level"), F.when(single, fixed).otherwise(F.col("fixed")).alias("fixed"),
                F.when(single, bound(0)).otherwise(F.coalesce("_lo", "lo")).alias("lo"), F.when(single, bound(1)).otherwise(F.coalesce("_hi", "hi")).alias("hi"),
                F.coalesce("first", "before").alias("before"), (~there | few).alias("done"),
            )
            state = cut(state.filter("done").unionByName(following))

        def gathered(asked: Asked) -> list[tuple]:
            out = []
            for w, same, start, level, fixed, _, hi, _, _ in asked.windows():
                places = asked.reached(bool(same), start, level, fixed, hi)
                out += [(w, asked.block.ids[p], asked.block.tags[p], asked.score[p]) for p in places]
            return out

        rows = self.meet(state.withColumn("shift", F.lit(0)), gathered, "w bigint, id bigint, tag bigint, score bigint")
        place = F.row_number().over(Window.partitionBy("w").orderBy(F.desc("score"), "id", "tag"))
        return state.select(*own, "w").join(rows.withColumn("place", place).filter(F.col("place") <= k), "w").drop("w")


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    label: Column,
    positives: int = 5,
    negatives: int = 3,
    least: int = 50,
    most: int = 95,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components times ``scale`` are rounded down; a score is their inner product with the anchor's.
    ``anchor`` says which rows are anchors, ``label`` is their label. An anchor's positives are the
    first rows of its label but itself; its negatives those of other labels with
    ``least`` x positive score <= 100 x negative score <= ``most`` x positive score, first rows first.
    Defined results for odd rows are in the module's text.
    """
    table = Table(vectors, anchor, label, id_col, vector_col, scale, block_bytes)
    reach = F.least(F.ceil(F.col("norm") * F.lit(table.norm) * (1 + 1e-9)) + 1, F.lit(1 << 62)).cast("bigint")
    first = table.anchors.select("aid", "atag", F.lit(True).alias("same"), (-reach).alias("least"), reach.alias("most"))
    chosen = table.select(first, positives).select("aid", "atag", F.col("id").alias("pid"), F.col("tag").alias("ptag"), F.col("score").alias("ps"))
    hundredths = lambda n: F.col("ps").cast("decimal(20,0)") * F.lit(n) / 100
    second = chosen.select("aid", "atag", "pid", "ptag", "ps", F.lit(False).alias("same"), F.ceil(hundredths(least)).cast("bigint").alias("least"), F.floor(hundredths(most)).cast("bigint").alias("most"))
    return table.select(second, negatives).select(
        F.col("aid").alias("anchor_id"), F.col("pid").alias("positive_id"), F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("ps").alias("positive_score"), F.col("score").alias("negative_score")
    )
