"""Request-log aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latency(log: DataFrame) -> DataFrame:
    """Count, sum and mean of duration_s by route and status, with quantiles."""
    return log.groupBy("route", "status").agg(
        F.count("*").alias("requests"), F.sum("duration_s").alias("total_s"), F.avg("duration_s").alias("mean_s"), F.approx_percentile("duration_s", [0.5, 0.95, 0.99]).alias("quantiles")
    )


def latency_buckets(log: DataFrame, bounds: list[float]) -> DataFrame:
    """Requests of each route at or under each bound."""
    le = F.explode(F.array(*[F.lit(float(b)) for b in bounds]))
    each = log.select("route", "duration_s", le.alias("le"))
    return each.groupBy("route", "le").agg(F.count_if(F.col("duration_s") <= F.col("le")).alias("requests"))


def failures(log: DataFrame) -> DataFrame:
    """Unhandled failures by route, and of all routes (null)."""
    return log.rollup("route").agg(F.count_if((F.col("status") >= 500) & F.col("unhandled")).alias("failures"))


def rejections(log: DataFrame) -> DataFrame:
    return log.where("status = 429").groupBy("key_type").agg(F.count("*").alias("rejections"))


def overall(log: DataFrame) -> DataFrame:
    """All requests and the mean in milliseconds, by route and status with totals."""
    return log.rollup("route", "status").agg(F.count("*").alias("requests"), (F.avg("duration_s") * 1000).alias("mean_ms"))
