"""Loops over DataFrames that cut lineage in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The application's folder in spark.checkpoint.dir, or in the warehouse where that is unset: both are shared by all executors."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/wayloom-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a table in the shared folder, in folders by a column where one is named: later jobs survive lost executors and don't recompute it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """df with n, its rows' numbers from 0 in an order (columns, none equal for two rows): counted from ranges, no row is numbered in one task."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    ranged = written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), name)
    before = F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = ranged.groupBy("__part").count().select("__part", before.alias("__before"))  # a row for each partition
    local = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return ranged.withColumn("n", local).join(F.broadcast(sizes), "__part").withColumn("n", F.col("n") + F.col("__before")).drop("__part", "__before")


def minimise(start: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], value: str, name: str, limit: int = 100_000) -> DataFrame:
    """Least value by keys reachable from start: step maps the rows improved last to new offers; ends when none improves and raises beyond limit rounds.

    Only improved rows enter a round, so the work of a round follows what changed.
    """
    from pyspark.sql import functions as F

    best = written(start.groupBy(*keys).agg(F.min(value).alias(value)), name)
    fresh = best
    for _ in range(limit):
        offers = step(fresh).groupBy(*keys).agg(F.min(value).alias(value))
        old = best.select(*keys, F.col(value).alias("__old"))
        fresh = written(offers.join(old, keys, "left").where(F.col("__old").isNull() | (F.col(value) < F.col("__old"))).drop("__old"), name)
        if fresh.isEmpty():
            return best
        best = written(best.unionByName(fresh).groupBy(*keys).agg(F.min(value).alias(value)), name)
    raise RuntimeError(f"{name} didn't converge")
