"""Approximate nearest neighbours with randomly rotated one-bit codes.

Vectors are centred, turned by a random rotation and kept as the signs of their coordinates
(packed bits) with correction scalars; every row is encoded once, before it meets any query. A
query is turned the same way and rounded to ``PLANES`` bits a coordinate, so that its inner product
with a sign code is a weighted sum of population counts of ANDed bits, which one product of small whole
numbers gives for many queries and rows at once. Divided by the cosine
between a turned vector and its code it estimates their inner product without bias, with an error
of at most ``bound`` times a spread that is known for each pair, but for a tail that shrinks with
``bound``. The best estimates are reranked by the exact inner product; the k-th best of these is a
floor, and every vector whose estimate plus error reaches the floor is reranked as well.

Queries and rows meet block by block: each block of queries goes to each block of rows once, and
each meeting keeps k candidates a query. Blocks are of ``block_bytes`` at most, so what is shuffled
grows with rows x queries / block. Coarse cells would save comparisons only where vectors lie in
clusters (README has figures), so none are used. Every row is indexed; only the centre is
estimated, from ``CENTRE_ROWS`` rows, and any centre gives right results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, tidy

CENTRE_ROWS = 2_000
SEED = 17
PLANES = 4
#: Queries whose estimates are held at once.
AT_ONCE = 256


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1 as 64-bit words, the last filled up with zeros."""
    n, d = bits.shape
    words = np.zeros((n, -(-d // 64) * 8), np.uint8)
    words[:, : -(-d // 8)] = np.packbits(bits, axis=1)
    return words.view(np.uint64)


def codes(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed sign codes, scalars) of the rows of ``x``.

    Scalars: distance to the centre, cosine between the turned vector and its code, inner product
    with the centre, set bits.
    """
    off = x - centre
    norm = np.sqrt((off * off).sum(1))
    unit = (off / np.maximum(norm, 1e-300)[:, None]) @ turn.T
    bits = unit > 0
    cosine = np.maximum(np.abs(unit).sum(1) / np.sqrt(x.shape[1]), 1e-12)
    return packed(bits), np.stack((norm, cosine, x @ centre, bits.sum(1)), 1)


class Query:
    """Turned queries as bit planes: coordinate = low + step * sum of 2**j plane_j, rounded."""

    def __init__(self, q: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        self.off = np.sqrt(((q - centre) ** 2).sum(1))
        self.along = q @ centre - centre @ centre
        turned = (q - centre) @ turn.T
        self.low = turned.min(1)
        self.step = np.maximum((turned.max(1) - self.low) / (2**PLANES - 1), 1e-300)
        whole = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        self.whole = whole.astype(np.float32)
        rounded = self.low[:, None] + self.step[:, None] * whole
        self.sum, self.missed = rounded.sum(1), np.sqrt(((turned - rounded) ** 2).sum(1))

    def estimates(self, bits: np.ndarray, scalars: np.ndarray, d: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """(estimate, error) of the inner products with all rows coded as ``unpacked`` bits, each (queries, rows)."""
        norm, cosine, along, ones = scalars.T
        # whole numbers below 2**24, so exact; all planes' counts at once
        met = (self.whole @ bits.T).astype(np.float64)
        # signs are 2 * bit - 1
        dots = (2 * (self.low[:, None] * ones + self.step[:, None] * met) - self.sum[:, None]) / np.sqrt(d)
        # <q, x> = <q - c, x - c> + <q, c> + <x, c> - <c, c>
        estimate = dots * (norm / cosine) + self.along[:, None] + along
        coded = np.sqrt(np.maximum(1 - cosine**2, 0) / max(d - 1, 1))
        error = bound * np.hypot(self.off[:, None] * coded, self.missed[:, None] / np.sqrt(d)) * (norm / cosine)
        return estimate, error + 1e-9 * (1 + np.abs(estimate))


def unpacked(words: np.ndarray, d: int) -> np.ndarray:
    """Codes as numbers 0 and 1, row by row."""
    return np.unpackbits(words.view(np.uint8), axis=1)[:, :d].astype(np.float32)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added up from the first component on."""
    return np.cumsum(x * q, axis=1)[:, -1]


def nearest(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, coded: tuple[np.ndarray, np.ndarray], centre: np.ndarray, turn: np.ndarray, k: int, bound: float) -> list[tuple[int, int, float]]:
    """(query_id, vec_id, score) of the k best rows of ``x`` for each query, itself left out."""
    out = []
    n = min(k + 1, len(x))  # one of them may be the query itself
    bits, d = unpacked(coded[0], x.shape[1]), x.shape[1]
    longest = np.sqrt((x * x).sum(1).max(initial=0.0))
    for lo in range(0, len(queries), AT_ONCE):
        q = queries[lo : lo + AT_ONCE]
        estimate, error = Query(q, centre, turn).estimates(bits, coded[1], d, bound)
        first = np.argpartition(estimate, len(x) - n, axis=1)[:, len(x) - n :]
        estimate += error
        for row in range(len(q)):
            floor = products(x[first[row]], q[row]).min()
            able = estimate[row] >= floor
            able[first[row]] = True
            picked = np.flatnonzero(able)
            picked = picked[ids[picked] != query_ids[lo + row]]
            near = x[picked]
            about = near @ q[row]
            if len(picked) > k:  # what the order of additions can't bring among the k best goes
                slack = 4e-16 * d * longest * np.sqrt(q[row] @ q[row]) + 1e-300
                stays = ~(about < np.partition(about, len(about) - k)[len(about) - k] - slack)
                picked, near = picked[stays], near[stays]
            score = products(near, q[row])
            best = np.lexsort((ids[picked], -score))[:k]
            out += [(int(query_ids[lo + row]), int(ids[picked[i]]), float(score[i])) for i in best]
    return out


def usable(v: Column) -> Column:
    """Vectors without null, NaN or infinite components, and not all zero."""
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(good, F.lit(False)) & F.exists(v, lambda x: x != 0)


def neighbours(
    vectors: DataFrame,
    query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    bound: float = 4.0,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for each row where ``query`` holds.

    score is the inner product of the original vectors in double precision; ties go to the smaller
    vec_id. Vectors that are null, empty, all zero or hold a null or non-finite component take no
    part, nor do rows with a null id or of another dimension than most rows. Rows that repeat an id
    and a vector count once; of the rows with one vector only the k + 1 with the smallest ids can be
    among the nearest, so no others are candidates. Other columns are ignored; an empty table gives
    no rows.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v"), query.alias("asks")).filter(usable(F.col("v")) & F.col("vec_id").isNotNull())
    most = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    d = most.d if most else 1
    rows = rows.filter(F.size("v") == d)
    first = rows.limit(CENTRE_ROWS)
    centre = np.array(first.select(*(F.avg(F.get("v", F.lit(i))).alias(f"c{i}") for i in range(d))).first() or [0.0] * d, float)
    centre, turn = np.nan_to_num(centre), rotation(d)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, d)
            bits, scalars = codes(x, centre, turn)
            as_bytes = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (x, bits, scalars)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *as_bytes, batch.column(2)], ["vec_id", "v", "bits", "scalars", "asks"])

    coded = rows.select("vec_id", "v", F.coalesce("asks", F.lit(False)).alias("asks")).mapInArrow(tidy(encode), "vec_id bigint, v binary, bits binary, scalars binary, asks boolean")
    # copies of a row and of a vector are thinned out before they meet in one place
    coded = cut(coded.groupBy("vec_id", "v", "bits", "scalars").agg(F.bool_or("asks").alias("asks")))
    copy = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    base = cut(coded.withColumn("copy", copy).filter(F.col("copy") <= k + 1).select("vec_id", "v", "bits", "scalars"))
    asked = coded.filter("asks").select("vec_id", "v")
    block = max(1, block_bytes // (8 * d))
    row_blocks, query_blocks = max(16, -(-base.count() // block)), max(1, -(-asked.count() // block))
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keyed = base.select("*", blocks(query_blocks).alias("qb"), F.pmod(F.xxhash64("vec_id", "v", F.lit(1)), F.lit(row_blocks)).cast("int").alias("rb"))
    asked = asked.select("*", F.pmod(F.xxhash64("vec_id", "v", F.lit(2)), F.lit(query_blocks)).cast("int").alias("qb"), blocks(row_blocks).alias("rb"))

    def meet(block: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if block.empty or asks.empty:
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in zip(columns, ("int64", "int64", "float64"))})
        matrix = lambda s, kind: np.frombuffer(b"".join(s), kind).reshape(len(s), -1)
        own = matrix(block["bits"], np.uint64), matrix(block["scalars"], np.float64)
        out = nearest(matrix(asks["v"], np.float64), asks["vec_id"].to_numpy(), matrix(block["v"], np.float64), block["vec_id"].to_numpy(), own, centre, turn, k, bound)
        return pd.DataFrame(out, columns=columns).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    met = keyed.groupBy("qb", "rb").cogroup(asked.groupBy("qb", "rb")).applyInPandas(meet, "query_id bigint, vec_id bigint, score double").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
