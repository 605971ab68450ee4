"""Bulk files: candidates, delimited scans with schema reconciliation, idempotent loads, upserts."""

from __future__ import annotations

import datetime as dt
import io
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import any_date


@dataclass(frozen=True, order=True)
class BulkFile:
    """A file by the first day of what it covers."""

    start: dt.date
    name: str


def candidates(first: tuple[int, int] = (2022, 4), monthly_from: dt.date = dt.date(2026, 1, 1), today: dt.date | None = None) -> list[BulkFile]:
    """Quarterly names up to the month from which files are monthly, then one a month to today."""
    today, out = today or dt.date.today(), []
    year, quarter = first
    while (day := dt.date(year, 3 * quarter - 2, 1)) < min(monthly_from, today):
        out.append(BulkFile(day, f"{year}q{quarter}"))
        year, quarter = (year, quarter + 1) if quarter < 4 else (year + 1, 1)
    day = monthly_from
    while day <= today:
        out.append(BulkFile(day, f"{day.year}_{day.month:02d}"))
        day = (day.replace(day=28) + dt.timedelta(days=7)).replace(day=1)
    return out


def chosen(files: list[BulkFile], since: str | None = None, only: str | None = None, loaded: set[str] = frozenset(), force: bool = False) -> list[BulkFile]:
    """Files from the one named ``since`` on, or just ``only``, that are not loaded yet (all if forced)."""
    start = next((f.start for f in files if f.name == since), None)
    if since and start is None:
        raise ValueError(f"no file is named {since}")
    return [f for f in files if (not only or f.name == only) and (not start or f.start >= start) and (force or f.name not in loaded)]


def delimited(spark: SparkSession, path: str | list[str], sep: str = "\t", quoted: bool = False) -> DataFrame:
    """A headed file, all text. Without quoting a quote is a character like any other; short lines
    are filled with null, extra fields are dropped."""
    reader = spark.read.option("sep", sep).option("header", True).option("mode", "PERMISSIVE")
    if not quoted:
        reader = reader.option("quote", "").option("escape", "")
    return reader.csv(path)


def zip_members(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(file, member, line_no, line) of the named members of all zip files under the path."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in set(names) & set(z.namelist()):
                        with z.open(name) as f:
                            lines, at = [], 0
                            for line in io.TextIOWrapper(f, encoding="utf-8", errors="replace"):
                                lines.append(line.rstrip("\r\n"))
                                if len(lines) == 50_000:
                                    yield pd.DataFrame({"file": file, "member": name, "line_no": range(at, at + len(lines)), "line": lines})
                                    at, lines = at + len(lines), []
                            yield pd.DataFrame({"file": file, "member": name, "line_no": range(at, at + len(lines)), "line": lines})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, member string, line_no bigint, line string")


def conformed(raw: DataFrame, schema: T.StructType, source: Column | None = None) -> DataFrame:
    """Text columns matched to the schema by name and cast where they can be; blank or unreadable
    values and columns that are not there are null, others are left out."""
    there = {c.lower(): c for c in raw.columns}

    def column(field: T.StructField) -> Column:
        if field.name == "source_file" and source is not None:
            return source.alias(field.name)
        if field.name.lower() not in there:
            return F.lit(None).cast(field.dataType).alias(field.name)
        text = F.nullif(F.trim(F.col(f"`{there[field.name.lower()]}`")), F.lit(""))
        return (any_date(text) if isinstance(field.dataType, T.DateType) else text.try_cast(field.dataType)).alias(field.name)

    return raw.select(*map(column, schema.fields))


def load(df: DataFrame, path: str, by: str = "source_file") -> None:
    """Writes df under the path; partitions of ``by`` that it holds are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


LOG = "name string, batch string, rows bigint, hash bigint, loaded timestamp"


class Loads:
    """A table of loaded files and its log.

    A file's rows go to a folder of their own batch; the log's line for it (name, batch, rows, a hash
    of the rows whatever their order) is written after them and makes them count. What has no line,
    a load that broke off, is no part of the table and is written anew. The log is asked which files
    are loaded; no data are scanned for that.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.log_path = spark, path, f"{path}/_log"

    def _there(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def log(self) -> DataFrame:
        """(name, batch, rows, hash, loaded): the load that counts of each file."""
        lines = self.spark.read.schema(LOG).json(self.log_path) if self._there(self.log_path) else self.spark.createDataFrame([], LOG)
        return lines.groupBy("name").agg(F.max_by(F.struct("batch", "rows", "hash", "loaded"), F.struct("loaded", "batch")).alias("r")).select("name", "r.*")

    def names(self) -> set[str]:
        return {r.name for r in self.log().collect()}  # a line for each file

    def load(self, name: str, rows: DataFrame) -> dict:
        """Replaces the file's rows by these; returns its line of the log."""
        batch = uuid.uuid4().hex
        at = f"{self.path}/source_file={name}/batch={batch}"
        rows.write.parquet(at)
        written = self.spark.read.parquet(at)
        n, of_rows = written.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*(F.col(f"`{c}`") for c in written.columns)).cast("decimal(20,0)")) % F.lit(1 << 62), F.lit(0)).cast("bigint")).first()
        line = self.spark.range(1).select(F.lit(name).alias("name"), F.lit(batch).alias("batch"), F.lit(n).cast("bigint").alias("rows"), F.lit(of_rows).cast("bigint").alias("hash"), F.current_timestamp().alias("loaded"))
        line.coalesce(1).write.mode("append").json(self.log_path)
        self.tidy(name, batch)
        return {"name": name, "batch": batch, "rows": n, "hash": of_rows}

    def tidy(self, name: str, batch: str) -> None:
        """Removes what other loads of the file left, whole or half written."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/source_file={name}")
        store = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for s in store.listStatus(p):
            if s.getPath().getName() != f"batch={batch}":
                store.delete(s.getPath(), True)

    def table(self) -> DataFrame:
        """All rows that count, with their ``source_file``."""
        paths = [f"{self.path}/source_file={r.name}/batch={r.batch}" for r in self.log().collect()]
        if not paths:
            raise FileNotFoundError(f"nothing is loaded under {self.path}")
        return self.spark.read.option("basePath", self.path).option("mergeSchema", True).parquet(*paths).drop("batch")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose keys are not in the new batch, and the batch. The batch may have more columns."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def todo(all_rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is not done yet."""
    return all_rows.join(done.select(*keys).distinct(), keys, "left_anti")


def first_of_each(spark: SparkSession, path: str, key: str = "cik") -> DataFrame:
    """A JSON object of objects as rows in their order; the first row of each key."""
    text = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "map<string, map<string, string>>")
    rows = text.select(F.posexplode(F.map_entries(entries)).alias("pos", "e")).select(F.col("e.key").alias("name"), F.col("e.value").alias("fields"), F.col("e.key").try_cast("bigint").alias("n"), "pos")
    rows = rows.withColumn("_k", F.try_element_at("fields", F.lit(key)))
    return rows.groupBy("_k").agg(F.min_by(F.struct("name", "fields"), F.struct(F.coalesce("n", "pos"), "pos")).alias("r")).select(F.col("_k").alias(key), "r.name", "r.fields")
