"""Reading of the input tables and durable cut points for long plans."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; zone-less timestamps stay as they are."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir.

    Only a local session without that setting (tests, bench) gets a temporary folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="melisma-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialise(df: DataFrame, name: str = "cut") -> DataFrame:
    """Writes `df` as a Parquet table in the shared folder and reads it back.

    Cuts the lineage durably: a lost executor costs only the tasks it was running, and readers prune columns.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def current_rows(df: DataFrame, key: str, version: str) -> DataFrame:
    """The row with the greatest `version` of each `key`, as a partial (map-side) aggregate.

    Ties go to the row that is greatest over all columns, so the result doesn't depend on row order.
    A null version loses against any other; rows with a null key are dropped.
    """
    rest = [c for c in df.columns if c not in (key, version)]
    pick = F.max(F.struct(F.col(version), *[F.col(c) for c in rest])).alias("_row")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(pick).select(key, *[F.col("_row")[c].alias(c) for c in df.columns if c != key])
