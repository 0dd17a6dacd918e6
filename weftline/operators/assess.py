"""Assessing given scaffolds: residuals of the link evidence, and breaks where the support falls apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components


def positions(parts: DataFrame) -> DataFrame:
    """Start of each part (scaffold_id, ord, contig_id, len, n_gap): the lengths and gaps before it."""
    w = Window.partitionBy("scaffold_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("pos", F.coalesce(F.sum(F.col("len") + F.col("n_gap")).over(w), F.lit(0)))


def residuals(rows: DataFrame, layout: DataFrame) -> DataFrame:
    """Residual (pos2 - pos1) - y of every same-orientation row inside a scaffold (contig_id, scaffold_id, pos)."""
    a = layout.select(F.col("contig_id").alias("c1"), "scaffold_id", F.col("pos").alias("pos1"))
    b = layout.select(F.col("contig_id").alias("c2"), F.col("scaffold_id").alias("s2"), F.col("pos").alias("pos2"))
    r = rows.where("cons = 1").join(a, "c1").join(b, "c2").where("scaffold_id = s2")
    return r.withColumn("residual", F.col("pos2") - F.col("pos1") - F.col("y")).drop("s2", "pos1", "pos2")


def broken_parts(res: DataFrame, layout: DataFrame, tolerance: float = 200) -> DataFrame:
    """scaffold_id, part_id (smallest contig), broken, contigs (sorted) after rows beyond the tolerance are dropped."""
    kept = res.where(F.abs("residual") < tolerance)
    comp = connected_components(kept.select(F.col("c1").alias("src"), F.col("c2").alias("dst")))
    parts = layout.select("scaffold_id", "contig_id").join(comp, F.col("contig_id") == F.col("node"), "left")
    parts = parts.groupBy("scaffold_id", F.coalesce("component", "contig_id").alias("part_id")).agg(F.array_sort(F.collect_list("contig_id")).alias("contigs"))
    return parts.withColumn("broken", F.count("*").over(Window.partitionBy("scaffold_id")) > 1)
