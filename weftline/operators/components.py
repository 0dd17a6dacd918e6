"""Connected components by alternating large-star and small-star rounds on an edge table."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame, forget: bool = False) -> DataFrame:
    """df, cut from its lineage in the shared checkpoint folder. Its files go once nothing on the driver refers to them.

    A checkpoint keeps the size that was estimated for df, and a join's is the product of its sides': in a loop of joins its
    digits multiply each round, until the driver does nothing but multiply them. With forget it starts anew.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        configured = sc.getConf().get("spark.checkpoint.dir")
        if not configured and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="weftline-checkpoint-"))
    sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if forget:
        df = DataFrame(df.sparkSession._jsparkSession.createDataFrame(df._jdf.javaRDD(), df._jdf.schema()), df.sparkSession)
    return df.checkpoint(eager=True)


#: Edges of one task: rounds over few edges run as few tasks, whatever the number of shuffle partitions.
TASK_EDGES = 250_000


def narrowed(df: DataFrame, rows: int, per_task: int = TASK_EDGES) -> DataFrame:
    """A written df of so many rows, read in no more partitions than these fill. (Not for what a shuffle gives: the sorts of
    all merged partitions would share one task's memory.)"""
    return df.coalesce(max(1, -(-rows // per_task)))


def dealt(df: DataFrame, rows: int, per_task: int = TASK_EDGES) -> DataFrame:
    """df of about so many rows by a shuffle of its own, to be written in no more files than these fill. A local store without
    Hadoop's native library forks processes off the executor for every file, and each holds the executor's memory for a moment."""
    return df.repartition(max(1, -(-rows // per_task)))


def _signed(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written once, with their number and a sum of hashes."""
    out = checkpointed(edges, forget=True)
    return out, tuple(out.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("lo", "hi"), F.lit(1 << 40)))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rows: int | None = None) -> DataFrame:
    """(node, component) for every node of the edge list; component is the smallest node of its component. rows: about how
    many edges there are, if that is known.

    Each round rewires every node to the smallest of its neighbourhood with aggregates that combine before
    the shuffle and joins that adaptive execution can split, so stars with very many leaves stay divided;
    the number of rounds grows with the logarithm of the node count. Self-loops give single nodes.
    """
    all_edges = edges.select(F.least(src, dst).alias("lo"), F.greatest(src, dst).alias("hi"))
    loops = all_edges.where("lo = hi").select(F.col("lo").alias("node")).distinct()
    e = all_edges.where("lo < hi").distinct()
    e, before = _signed(e if rows is None else dealt(e, rows))
    while before[0]:
        e = narrowed(e, before[0])
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("m < v").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(low, "hi").where("m < lo").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
        e, after = _signed(dealt(moved.unionByName(low.select(F.col("m").alias("lo"), "hi")).distinct(), before[0]))
        if after == before:
            break
        before = after
    stars = e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = e.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("component"))
    found = stars.unionByName(roots)
    single = loops.join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.unionByName(single)
