"""Structured Streaming: requests arrive in small files or a topic and are answered by the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def answer(requests: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of requests goes through plan; a batch that is repeated overwrites its own folder."""

    def one(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return requests.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def demand(requests: DataFrame, minutes: int = 60, late: str = "2 hours") -> DataFrame:
    """Requests by origin and hour; rows later than the watermark are left out."""
    return requests.withWatermark("depart", late).groupBy(F.window("depart", f"{minutes} minutes"), "origin").agg(F.count("*").alias("requests"))
