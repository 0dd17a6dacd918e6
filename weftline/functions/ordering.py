"""Row numbers, running sums and exact percentiles over a whole table or large groups, without sending it to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.components import checkpointed

#: Lines (or ranks) of one block: each block is summed in one task, one row of each is ordered globally.
BLOCK = 1 << 20


def numbered(df: DataFrame, *order: Column | str, name: str = "n") -> DataFrame:
    """Row numbers from 1 in `order` (a total order, or ties in any order).

    The rows are range-partitioned, sorted and written once; each partition's start comes from the partitions' counts,
    which are as few as the partitions.
    """
    part, offset = f"__part_{name}", f"__offset_{name}"
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())
    placed = checkpointed(placed).withColumn(part, F.shiftright(name, 33))
    counts = placed.groupBy(part).agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select(part, before.alias(offset)))
    within = F.col(name).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(starts, part).withColumn(name, (within + F.col(offset)).cast("long")).drop(part, offset)


def running_sum(df: DataFrame, value: str, line: str, name: str, block: int = BLOCK) -> DataFrame:
    """Sum of `value` over all rows up to and with each one, in order of `line` (equal ones in any order).

    Rows are numbered first, so that blocks are of equal length however sparse `line` is; blocks are summed, and only one
    row of each block is ordered globally.
    """
    rows = numbered(df, line, name="__nth").withColumn("__block", F.floor(F.col("__nth") / block))
    sums = rows.groupBy("__block").agg(F.sum(value).alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("__block", before.alias("__before"))
    own = F.sum(value).over(Window.partitionBy("__block").orderBy("__nth").rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(sums, "__block").withColumn(name, own + F.col("__before")).drop("__block", "__before", "__nth")


def ranked(df: DataFrame, key: str, x: str) -> DataFrame:
    """key, x, __at (place of x in its group from 0), __k (size of the group); null x are left out."""
    rows = numbered(df.select(key, x).where(F.col(x).isNotNull()), key, x, name="__n")
    groups = rows.groupBy(key).agg(F.min("__n").alias("__first"), F.count("*").alias("__k"))
    return rows.join(groups, key).select(key, x, (F.col("__n") - F.col("__first")).alias("__at"), "__k")


def percentile_of(ranks: DataFrame, key: str, x: str, p: float, name: str) -> DataFrame:
    """key and the exact percentile of ranked(): linear between the two rows around place p (k - 1)."""
    place = F.lit(float(p)) * (F.col("__k") - 1)
    low, share = F.floor(place), place - F.floor(place)
    near = ranks.where((F.col("__at") == low) | (F.col("__at") == F.least(low + 1, F.col("__k") - 1)))
    weight = F.when(F.col("__at") == low, 1 - share).otherwise(share)
    weight = F.when(F.col("__k") - 1 == low, F.lit(1.0)).otherwise(weight)
    return near.groupBy(key).agg(F.sum(F.when(weight > 0, F.col(x) * weight).otherwise(0.0)).alias(name))


def percentile(df: DataFrame, x: str, p: float) -> DataFrame:
    """One row: the exact percentile of a column with few different values, counted per value first; null if there are none."""
    values = df.groupBy(x).agg(F.count("*").alias("__f"))
    return values.agg(F.percentile(x, F.lit(float(p)), F.col("__f")).alias("percentile"))
