"""Session and tables."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(name: str = "tallyloom", **conf: str) -> SparkSession:
    """A session with adaptive execution on and UTC times; the cluster's own settings stay."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a session on one machine that
    names none (a test) gets a temporary one; on a cluster other machines would not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return named or tempfile.mkdtemp(prefix="checkpoint-")


#: Results of adaptive execution don't say by which keys their rows lie together; joins take fewer keys than all only if told.
DEALT = {"spark.sql.adaptive.enabled": "false", "spark.sql.requireAllClusterKeysForCoPartition": "false"}


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it was counted to have ``rows`` rows at most; else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def cut(df: DataFrame, dealt: bool = False) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, so that its lineage ends here.

    ``dealt``: with the settings of ``DEALT``, so that rows that lie together by some keys stay there
    where windows and joins go by these keys and more.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(spark))
    before = {key: spark.conf.get(key) for key in DEALT} if dealt else {}
    for key, value in DEALT.items() if dealt else ():
        spark.conf.set(key, value)
    try:
        return df.checkpoint(eager=True)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
