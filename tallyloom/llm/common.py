"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut as cut, small as small  # for the operators of this subpackage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of letters and digits: everything but ASCII punctuation, controls and capitals.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def named(columns: list[str]) -> list[Column]:
    """The columns of these names, whatever marks the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else; null is the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words(text: Column) -> Column:
    """The lower-cased words of a text; none for null."""
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of one key that a task may get; keys with more are joined apart.
HOT = 20_000


def keyed_join(rows: DataFrame, per_key: DataFrame, key: str, counts: DataFrame, n: str, most: int = 500_000) -> DataFrame:
    """``rows`` joined with the one row that ``per_key`` has for each ``key``.

    ``counts`` has how many rows stand under each key in its column ``n``. The keys with more than
    ``HOT`` are few, at most one in HOT of the rows; they are broadcast if counted to be ``most`` at
    most, so that their rows stay where they are. All others shuffle. ``rows`` is read twice.
    """
    hot = cut(counts.filter(F.col(n) > HOT).select(key))
    if not 0 < hot.count() <= most:
        return rows.join(per_key, key)
    hot = F.broadcast(hot)
    apart = rows.join(F.broadcast(per_key.join(hot, key, "left_semi")), key)
    return apart.unionByName(rows.join(hot, key, "left_anti").join(per_key, key))


#: Bytes of texts that go to a Python worker at once.
BATCH = 2 << 20


def small_batches(df: DataFrame) -> None:
    """Lets the session hand rows to Python in batches of ``BATCH`` bytes at most.

    The usual bound (64 MB) is held several times over, in the JVM and in the worker, by every
    task; whole texts need no such batches. A smaller bound that is already set stays.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", str(conf.get(key)))
    if not now or int(now[1]) <= 0 or int(now[1]) > BATCH:
        conf.set(key, str(BATCH))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for mapInArrow, after which the worker gives the memory of its task back.

    Workers stay for the next task; what Arrow's pool and the C library keep of freed batches and
    texts would otherwise count against the executor while they wait.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped
