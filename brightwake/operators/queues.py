"""Bounded queues of messages and their retries, as plans over a table of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def kept(messages: DataFrame, n: int = 20, by: list[str] | None = None, time: str = "time") -> DataFrame:
    """The n newest messages of each queue; Spark keeps n in each task before it shuffles."""
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc(time))
    return messages.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= n).drop("__rank")


def sendable(messages: DataFrame, most: int = 3) -> DataFrame:
    """Messages that weren't given up."""
    return messages.filter(F.col("retry_count") < most)


def drained(messages: DataFrame, sent: Column, most: int = 3) -> DataFrame:
    """The queue after a round: what was sent goes, the rest counts one more try, and goes at the last."""
    return messages.filter(~sent).withColumn("retry_count", F.col("retry_count") + 1).filter(F.col("retry_count") < most)


def fresh(alerts: DataFrame, sent: DataFrame, asof: Column, seconds: int = 600) -> DataFrame:
    """Alerts younger than the limit whose message wasn't sent; the key is a hash that all processes share."""
    keyed = alerts.withColumn("key", F.sha2("message", 256)).filter(F.col("time") > asof - F.make_dt_interval(secs=F.lit(seconds)))
    return keyed.join(sent.select("key"), "key", "left_anti")
