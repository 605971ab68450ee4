"""Structured Streaming forms: ingestion, restatements and stateful linkage."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.asof import asof
from ..operators.linkage import COLUMNS, link


def ingest(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str) -> StreamingQuery:
    """Files that are new since the last run are appended to the target, each once."""
    files = spark.readStream.schema(schema).parquet(source)
    return files.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)


def _versions(spark: SparkSession, target: str, n: int) -> dict[int, int]:
    """The batch that wrote each bucket last, as of batch n."""
    return {r.bucket: r.version for r in spark.read.parquet(f"{target}/versions/v{n}").collect()} if n >= 0 else {}


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def restate(stream: DataFrame, keys: list[str], value: str, filed: str, target: str, checkpoint: str, buckets: int = 32) -> StreamingQuery:
    """Keeps under the target the value filed last for each key, whatever the order of arrival.

    What is kept lies in ``buckets`` by the keys' hash. A batch rewrites the buckets that it touches,
    as ``v<batch>/bucket=<b>``, and then says which batch's folder holds for each; a batch that runs
    again replaces its own result. Folders that the batch before replaced are deleted.
    """

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        at, older = _versions(spark, target, n - 1), _versions(spark, target, n - 2) if n >= 2 else {}
        for b, version in older.items():
            if at[b] != version:
                _delete(spark, f"{target}/v{version}/bucket={b}")
        placed = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        rows = batch.select(*keys, value, filed).filter(F.col(value).isNotNull()).withColumn("bucket", placed)
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]
        old = [f"{target}/v{at[b]}/bucket={b}" for b in touched if b in at]
        if old:
            rows = rows.unionByName(spark.read.parquet(*old).select(*keys, value, filed).withColumn("bucket", placed))
        best = rows.groupBy("bucket", *keys).agg(F.max(F.struct(filed, value)).alias("_b")).select(*keys, F.col(f"_b.{value}").alias(value), F.col(f"_b.{filed}").alias(filed), "bucket")
        best.write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/v{n}")
        holds = sorted({**at, **dict.fromkeys(touched, n)}.items())
        spark.createDataFrame(holds, "bucket int, version bigint").coalesce(1).write.mode("overwrite").parquet(f"{target}/versions/v{n}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def restated(spark: SparkSession, target: str, n: int) -> DataFrame:
    """What ``restate`` keeps after batch n: keys, value, filed. There must be something."""
    return spark.read.parquet(*(f"{target}/v{v}/bucket={b}" for b, v in _versions(spark, target, n).items()))


def enter(stream: DataFrame, quotes: DataFrame, on: list[str], filed: str, day: str, price: str, target: str, checkpoint: str, late: int = 7) -> StreamingQuery:
    """Each arriving filing with the first quote after its day, at most ``late`` days later, under ``batch=<n>``."""

    def write(batch: DataFrame, n: int) -> None:
        met = asof(batch, quotes, on, filed, day, [price], direction="forward", tolerance=late, strict=True)
        met.filter(F.col("match_time").isNotNull()).write.mode("overwrite").parquet(f"{target}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retry(stream: DataFrame, parse: Callable[[DataFrame], DataFrame], result: str, target: str, checkpoint: str, tries: int = 3) -> StreamingQuery:
    """Rows that ``parse`` gives a ``result`` under good/; others wait and are tried again with the next
    batch, and go to dead/ after ``tries``. waiting/ holds what waits after each batch."""
    columns = stream.columns

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("tried", F.lit(0))
        if n:
            rows = rows.unionByName(spark.read.parquet(f"{target}/waiting/batch={n - 1}").select(*columns, "tried"))
        done = parse(rows).withColumn("tried", F.col("tried") + 1)
        failed = done.filter(F.col(result).isNull()).select(*columns, "tried")
        done.filter(F.col(result).isNotNull()).write.mode("overwrite").parquet(f"{target}/good/batch={n}")
        failed.filter(F.col("tried") >= tries).write.mode("overwrite").parquet(f"{target}/dead/batch={n}")
        failed.filter(F.col("tried") < tries).write.mode("overwrite").parquet(f"{target}/waiting/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_counts(stream: DataFrame, time: str, key: str, late: str = "2 days") -> DataFrame:
    """Events per day and key; events later than the watermark are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 day"), key).agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def link_stream(stream: DataFrame, lender: str = "lender") -> DataFrame:
    """Loan ids for periods as they arrive; a lender's state is its last period's rows and a count.

    A lender's periods must arrive in order; rows of one batch may hold several.
    """
    columns = stream.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    out = f"{fields}, loan_id string, match_method string"
    kept = [*COLUMNS, "loan_id"]  # what the next period is matched with

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        previous, used = (json.loads(state.get[0]), state.get[1]) if state.exists else ([], 0)
        rows = pd.concat(list(frames))
        linked, previous, used = link(rows[columns], str(key[0]), previous, used)
        state.update((json.dumps([{c: r[c] for c in kept} for r in previous]), used))
        yield linked

    return stream.groupBy(lender).applyInPandasWithState(step, out, "rows string, used bigint", "append", GroupStateTimeout.NoTimeout)
