"""Toxicity scores over text restored by a noisy-channel decoder.

Obfuscated spellings ("1d10t", "i d i o t", "idiooot", "id*ot") are read as the output of a noisy
channel. Each is a lattice: a character may stand for itself or, at a cost, for the letter that it
looks like; a run of one letter may be one or two; a mark between letters or a gap between single
letters may be nothing. Viterbi finds the cheapest path under a character trigram model whose
counts come from every text of the corpus. The restored words are then scored by a classifier:
words and word beginnings that lean to the label, weighted by logistic regression.

The classifier is fitted on at most ``TRAIN_ROWS`` labelled rows (the first by a hash of their
id); the language model and the scores cover all rows whole.

Defined results: a null text is empty and scored like one; every input row gives one row; labels
without a document, null labels and labels of held-out ids teach nothing; if several labels share
an id the greatest holds; a null id is not held out; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, named, small_batches, tidy

TRAIN_ROWS = 20_000
#: Most features that the classifier may use, and the least documents and lean of one.
FEATURES, LEAST, LEAN = 20_000, 5, 4.0
THRESHOLD = 0.3
#: Toxic rows and rows that are taken as seen before any label is; with fewer than ``LEAST`` labels
#: of either kind every score is the rate that follows.
PRIOR = (2, 20)
#: Letters of the language model: word end 0, a-z, then U+00DF-U+00FF, then all others.
SIZE = 64
# What a sign may stand for.
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c"}
LOOK_COST, DROP_COST, RUN_COST, GAP_COST = 0.5, 0.5, 0.3, 0.2
#: Tokens a worker remembers, and features it counts before it passes them on.
MEMO, PASS_ON = 100_000, 200_000
SPACED = re.compile(r"(?<!\S)(?:[^\W_][\s.\-_*]++)+[^\W_](?![^\W_])")


def code(c: str) -> int:
    n = ord(c)
    if 97 <= n <= 122:
        return n - 96
    if 0xDF <= n <= 0xFF:
        return 27 + n - 0xDF
    return 60 if c.isalpha() else 0


def code_table() -> np.ndarray:
    """Codes of the first characters of Unicode; those beyond are letters as well."""
    return np.array([code(chr(i).lower()[:1]) for i in range(0x250)] + [60], np.int32)


def gram_counts(documents: DataFrame, text_col: str) -> DataFrame:
    """(gram, n): how often each trigram of letters and word ends stands in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = code_table(), np.zeros(SIZE**3, np.int64)
        waiting: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for t in batch.column(0):
                if t.is_valid:
                    c = table[np.minimum(np.frombuffer(t.as_py().encode("utf-32-le"), "<u4"), 0x250)]
                    c = np.concatenate(([0, 0], c, [0]))
                    waiting.append(c[:-2] * SIZE * SIZE + c[1:-1] * SIZE + c[2:])
                    size += len(c)
                if size > SIZE**3:
                    total += np.bincount(np.concatenate(waiting), minlength=SIZE**3)
                    waiting, size = [], 0
        if waiting:
            total += np.bincount(np.concatenate(waiting), minlength=SIZE**3)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], ["gram", "n"])

    return documents.select(F.col(text_col).alias("t")).mapInArrow(tidy(run), "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def costs(counts: np.ndarray) -> np.ndarray:
    """-log P(c | a b), each trigram interpolated with its bigram and letter."""
    three = counts.reshape(SIZE, SIZE, SIZE).astype(float)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + SIZE)
    p2 = (two + 50 * p1) / (two.sum(1, keepdims=True) + 50)
    p3 = (three + 50 * p2[None]) / (three.sum(2, keepdims=True) + 50)
    return -np.log(p3)


class Restorer:
    def __init__(self, cost: np.ndarray):
        self.cost = cost.tolist()

    def lattice(self, token: str) -> list[list[tuple[str, float]]]:
        """For each stretch of the token what it may have been, and at what cost."""
        steps, i = [], 0
        while i < len(token):
            c, j = token[i], i
            while j < len(token) and token[j] == c:
                j += 1
            if c.isalpha():
                n = j - i
                steps.append([(c * n, 0.0)] if n == 1 else [(c, RUN_COST), (c * 2, 0.0 if n == 2 else RUN_COST)])
            elif c == " ":
                steps.append([("", GAP_COST), (" ", GAP_COST)])
            else:
                options = [(x, LOOK_COST) for x in LOOKS.get(c, "")]
                options += [(x * 2, LOOK_COST + RUN_COST) for x in LOOKS.get(c, "")] if j - i > 1 else []
                if not c.isalnum():
                    options.append(("", DROP_COST))
                steps.append(options or [("", DROP_COST)])
            i = j
        return steps

    def decode(self, token: str) -> str:
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for step in self.lattice(token):
            following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (so_far, back) in best.items():
                for piece, extra in step:
                    x, y, total = a, b, so_far + extra
                    for ch in piece:
                        z = code(ch)
                        total += self.cost[x][y][z]
                        x, y = y, z
                    if (x, y) not in following or total < following[x, y][0]:
                        following[x, y] = (total, (back, piece))
            best = following
        ends = [(total + self.cost[a][b][0], back) for (a, b), (total, back) in best.items()]
        least = min(total for total, _ in ends)
        texts = []
        for back in (back for total, back in ends if total == least):
            pieces = []
            while back:
                back, piece = back
                pieces.append(piece)
            texts.append("".join(reversed(pieces)))
        return min(texts)

    def words(self, token: str) -> list[str]:
        """The words that a white-space-free token in lower case stands for."""
        if token.isalpha() and not re.search(r"(.)\1\1", token):
            return [token]
        core = re.sub(r"^[^\w@$!|+(]+|[^\w@$!|+(]+$|[@$!|+(]{2,}$|[.,;:!?]+$", "", token)
        if core.isalpha() and not re.search(r"(.)\1\1", core):
            return [core]
        letters = sum(c.isalpha() for c in core)
        if letters < 2:
            return [w for w in re.split(r"[\W\d_]+", core) if w]
        return self.decode(core).split()

    def text_words(self, low: str) -> set[str]:
        """Raw tokens of a lower-cased text, and what its spaced-out spellings stand for."""
        tokens = set(low.split())
        for m in SPACED.finditer(low):
            tokens.update(self.decode(re.sub(r"[\s.\-_*]+", " ", m[0])).split())
        return tokens


def features(word: str) -> list[str]:
    return [f"={word}", *(word[:n] for n in range(4, min(len(word), 8)))]


def document_features(restorer: Restorer, text: str | None, memo: dict[str, list[str]]) -> Counter:
    """How many distinct tokens of the text have each feature."""
    if len(memo) > MEMO:
        memo.clear()
    found: Counter = Counter()
    for token in restorer.text_words((text or "").lower()):
        if token not in memo:
            memo[token] = [f for w in restorer.words(token) for f in features(w)]
        found.update(memo[token])
    return found


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weights of a logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) / len(y) - l2 * w
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(y) + (l2 + 1e-9) * np.eye(x.shape[1])
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def summary(counts: list[tuple[float, int]], distinct: int) -> list[float]:
    """What the last regression sees: (lean, count) of the features found, and how many tokens."""
    total = sum(w * min(n, 5) for w, n in counts)
    size = math.log(distinct + 2)
    return [1.0, total / 10, total / (10 * size), total / (distinct + 20), math.sqrt(max(total, 0.0)), max((w for w, _ in counts), default=0.0) / 5, len(counts) / (10 * size), size / 10]


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def scored(
    documents: DataFrame,
    labels: DataFrame,
    carried: list[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    train_rows: int = TRAIN_ROWS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The input rows as a struct ``row``, with held_out, score (0 to 1) and predicted (1 from ``threshold`` on)."""
    small_batches(documents)
    grams = gram_counts(documents, text_col).collect()  # SIZE ** 3 numbers at most
    counts = np.zeros(SIZE**3, np.int64)
    for gram, n in grams:
        counts[gram] = n
    cost = costs(counts)

    taught = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    taught = taught.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(train_rows)
    own = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    train = cut(own.join(F.broadcast(taught), "id").select("t", "y"))  # train_rows ids at most

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, memo = Restorer(cost), {}
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def counts() -> pa.RecordBatch:
            names = list({**seen[0], **seen[1]})
            out = [pa.array(names, pa.string()), pa.array([seen[1][f] for f in names], pa.int64()), pa.array([seen[0][f] for f in names], pa.int64())]
            seen[0].clear()
            seen[1].clear()
            return pa.RecordBatch.from_arrays(out, ["f", "a", "b"])

        for batch in batches:
            for t, y in zip(batch.column(0), batch.column(1)):
                seen[y.as_py() > 0].update(document_features(restorer, t.as_py(), memo).keys())
                if len(seen[0]) + len(seen[1]) > PASS_ON:
                    yield counts()
        yield counts()

    rows, bad = train.agg(F.count("*"), F.count_if(F.col("y") > 0)).first()
    rate = (bad + PRIOR[0]) / (rows + PRIOR[1])
    expected = (F.col("a") + F.col("b")) * F.lit(rate)
    leaning = (
        train.mapInArrow(tidy(lean), "f string, a bigint, b bigint").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        .filter((F.col("a") >= LEAST) & ((F.col("a") - expected) / F.sqrt(expected) >= LEAN))
        .orderBy(F.desc((F.col("a") - expected) / F.sqrt(expected)), "f").limit(FEATURES).collect()
    )
    base = math.log(rate / (1 - rate))
    weights = {r.f: math.log((r.a + 0.1) / (r.b + 0.1)) - base for r in leaning}

    def summaries(texts: pa.Array, restorer: Restorer, memo: dict[str, tuple[str, ...]]) -> np.ndarray:
        rows = []
        for t in texts:
            if len(memo) > MEMO:
                memo.clear()
            tokens, found = restorer.text_words((t.as_py() or "").lower()), Counter()
            for token in tokens:
                if token not in memo:
                    memo[token] = tuple(f for w in restorer.words(token) for f in features(w) if f in weights)
                found.update(memo[token])
            rows.append(summary([(weights[f], n) for f, n in found.items()], len(tokens)))
        return np.array(rows or np.zeros((0, len(summary([], 0)))))

    def train_summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, memo = Restorer(cost), {}
        for batch in batches:
            rows = summaries(batch.column(0), restorer, memo)
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    fitted = train.mapInArrow(tidy(train_summary), "x array<double>, y int").collect()  # train_rows rows at most
    if min(bad, rows - bad) >= LEAST:
        w = logistic(np.array([r.x for r in fitted]), np.array([r.y > 0 for r in fitted], float))
    else:
        w = np.zeros(len(summary([], 0)))
        w[0] = base

    fields = list(dict.fromkeys([*carried, text_col]))
    chosen = documents.select(F.struct(*named(fields)).alias("row"), held_out(F.col(id_col)).alias("held_out"))
    row_type = T.StructType([f for f in documents.select(*named(carried)).schema.fields])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, memo = Restorer(cost), {}
        for batch in batches:
            columns = batch.column(0).flatten()
            p = 1 / (1 + np.exp(-np.clip(summaries(columns[fields.index(text_col)], restorer, memo) @ w, -30, 30)))
            row = pa.StructArray.from_arrays(columns[: len(carried)], carried)
            yield pa.RecordBatch.from_arrays([row, batch.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["row", "held_out", "score", "predicted"])

    return chosen.mapInArrow(tidy(score), T.StructType([T.StructField("row", row_type), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def toxicity(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (0 or 1)."""
    found = scored(documents, labels, [id_col], id_col, text_col, **parameters)
    return found.select(F.col("row").getField(id_col).alias("doc_id"), "held_out", "score", "predicted")


def without_toxic(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The input rows that are not predicted toxic, with their columns."""
    return scored(documents, labels, documents.columns, id_col, text_col, **parameters).filter(F.col("predicted") == 0).select("row.*")
