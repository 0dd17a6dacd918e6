"""Robust statistics per group. Percentiles come from places in a range-partitioned order, so a group that holds much of
the table is divided like any other; a group's own percentile is joined back to its rows (one row per group)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import BLOCK, percentile_of, ranked


def medians(df: DataFrame, key: str, x: str, name: str) -> DataFrame:
    return percentile_of(ranked(df, key, x), key, x, 0.5, name)


def madn(df: DataFrame, key: str, x: str) -> DataFrame:
    """Median absolute deviation over 0.675."""
    away = df.join(medians(df, key, x, "__m"), key).select(key, F.abs(F.col(x) - F.col("__m")).alias("away"))
    return medians(away, key, "away", "__d").select(key, (F.col("__d") / 0.675).alias("madn"))


def trim_median(df: DataFrame, key: str, x: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Median of the values between two exact percentiles."""
    ranks = ranked(df, key, x)
    bounds = percentile_of(ranks, key, x, low, "__l").join(percentile_of(ranks, key, x, high, "__h"), key)
    inner = df.join(bounds, key).where((F.col(x) >= F.col("__l")) & (F.col(x) <= F.col("__h"))).select(key, x)
    return medians(inner, key, x, "trim_median")


def median_std(df: DataFrame, key: str, x: str) -> DataFrame:
    """Root of half the mean squared deviation from the median."""
    away = F.col(x) - F.col("__m")
    return df.join(medians(df, key, x, "__m"), key).groupBy(key).agg(F.sqrt(F.avg(away * away) / 2).alias("median_std"))


def demarcation(df: DataFrame, key: str, x: str, ratio: float = 3.0, jump: float = 1000.0, fallback: float = 0.98) -> DataFrame:
    """First value of the upper quartile that the next exceeds by over `jump` and `ratio` times; else a percentile."""
    ranks = ranked(df, key, x)
    bounds = percentile_of(ranks, key, x, 0.75, "__q").join(percentile_of(ranks, key, x, fallback, "__f"), key)
    # the next value by blocks of places; a block's first row also ends the block before
    block = F.floor(F.col("__at") / BLOCK)
    blocks = F.when((F.col("__at") % BLOCK == 0) & (F.col("__at") > 0), F.array(block - 1, block)).otherwise(F.array(block))
    rows = ranks.withColumn("__block", F.explode(blocks))
    rows = rows.withColumn("__n", F.lead(x).over(Window.partitionBy(key, "__block").orderBy("__at"))).where(F.col("__n").isNotNull())
    hit = (F.col(x) >= F.col("__q")) & (F.col("__n") - F.col(x) > jump) & (F.col("__n") > ratio * F.col(x))
    first = rows.join(bounds, key).where(hit).groupBy(key).agg(F.min(x).alias("__first"))
    return bounds.join(first, key, "left").select(key, F.coalesce("__first", "__f").alias("demarcation"))
