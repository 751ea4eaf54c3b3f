"""Shared helpers: the cluster's shared folder, materialised tables, and value buckets in a stated order."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.operators.lineage import shared_folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a local one of our own only where that is unset and Spark runs on one machine."""
    return shared_folder(spark)


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a reliable checkpoint in the shared folder (for small tables)."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back, so that it isn't computed twice."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    # the finished job's shuffle files go as soon as the driver has forgotten its plan
    df.sparkSession.sparkContext._jvm.java.lang.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


_caches: list[tuple[str, Callable[[], None]]] = []


def cached_for(operator: str, drop: Callable[[], None]) -> None:
    """Registers how to drop what an operator keeps in a worker process between its tasks."""
    _caches.append((operator, drop))


def begin(operator: str) -> None:
    """At the start of a task: a worker process serves many stages, so what other operators keep in it is dropped."""
    for other, drop in _caches:
        if other != operator:
            drop()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_bounds(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n - 1 ascending cut values of a long column, from a distributed quantile summary of all rows."""
    probs = [i / n for i in range(1, n)]
    found = df.agg(F.percentile_approx(key, probs, 10_000).alias("q")).first()["q"] if probs else None
    return sorted(set(found or []))


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """How many of the bounds are at or below the key; null keys go first. Buckets follow the order of the keys."""
    cuts = np.array(bounds, dtype=np.int64)

    @F.pandas_udf(T.IntegerType())
    def place(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, v.to_numpy(dtype=np.int64), side="right"))

    return F.when(key.isNull(), F.lit(0)).otherwise(place(F.coalesce(key, F.lit(0)).cast("long")))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """(id as text, text with null as empty) for Python tasks, where a null id must not turn the others into floats, and the id's type."""
    return docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), dict(docs.select(id_col).dtypes)[id_col]


def unkeyed(df: DataFrame, id_col: str, kind: str) -> DataFrame:
    """The id in its own type and under its own name again."""
    return df.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)
