"""Lineage cuts, ordering and guards shared by the catalogue operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(session: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of this machine only where all tasks run on it."""
    sc = session.sparkContext
    if top := sc.getConf().get("spark.checkpoint.dir"):
        return top
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: it names the folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp("checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` in the checkpoint folder, so its lineage ends here."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def dense_ids(df: DataFrame, *order: Column | str, name: str = "id", parts: int | None = None) -> DataFrame:
    """Ids 1..n in a total order, without sorting all rows in one task.

    Rows are dealt by range; each range counts its rows, and an id is the rows of all lower
    ranges plus the place in the own one. Only one number a range meets in one task.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_place", place).join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")


def dense_ranks(df: DataFrame, keys: list[str], *order: Column | str, name: str = "rank") -> DataFrame:
    """Ranks 1..n under an order within each key; a key's rows need not meet in one task."""
    dealt = dense_ids(df, *keys, *order, name="_id")
    if not keys:
        return dealt.withColumnRenamed("_id", name).withColumn(name, F.col(name).cast("int"))
    first = dealt.groupBy(*keys).agg(F.min("_id").alias("_first"))
    return dealt.join(first, keys).withColumn(name, (F.col("_id") - F.col("_first") + 1).cast("int")).drop("_id", "_first")


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key under an order."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


class TooFewRows(ValueError):
    """A guard failed before anything was overwritten."""


def require_rows(df: DataFrame, least: int, what: str) -> DataFrame:
    """``df`` if it has ``least`` rows; only that many are counted."""
    found = df.limit(least).count()
    if found < least:
        raise TooFewRows(f"{what}: {found} rows, {least} needed")
    return df


def require_no_shrink(now: int, before: int, most: float = 0.3) -> None:
    """Fails if a snapshot lost more than a share of its rows."""
    if before and (before - now) / before > most:
        raise TooFewRows(f"{now} rows after {before}")
