"""Layouts: gaps, projections, conflicts, candidate windows, and the split into conflict-free strands."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.runs import by_runs


def by_place():
    """Window over a scaffold's fragments in layout order."""
    return Window.partitionBy("scaffold_id").orderBy("start", "end", "contig_id")


def gaps(layout: DataFrame) -> DataFrame:
    """Gap to the next fragment by (start, end); the last has 0."""
    return layout.withColumn("gap", F.coalesce(F.lead("start").over(by_place()) - F.col("end"), F.lit(0.0)).cast("long"))


def gap_breaks(layout: DataFrame, longest: float) -> DataFrame:
    """Piece number per scaffold: a gap over `longest` starts a new piece."""
    g = layout.withColumn("__cut", F.when(F.col("start") - F.lag("end").over(by_place()) > longest, 1).otherwise(0))
    return g.withColumn("piece", F.sum("__cut").over(by_place().rowsBetween(Window.unboundedPreceding, 0))).drop("__cut")


def normalised(layout: DataFrame) -> DataFrame:
    """Shift each scaffold so that its first start is 0."""
    w = Window.partitionBy("scaffold_id")
    return layout.withColumn("__m", F.min("start").over(w)).withColumn("start", F.col("start") - F.col("__m")).withColumn("end", F.col("end") - F.col("__m")).drop("__m")


def project(solved: DataFrame) -> DataFrame:
    """Solved coordinate x and orientation to an interval: forward [x, x+len], reverse [x-len, x]."""
    fwd = F.col("orient") > 0
    return (
        solved.withColumn("start", F.when(fwd, F.col("x")).otherwise(F.col("x") - F.col("len")))
        .withColumn("end", F.when(fwd, F.col("x") + F.col("len")).otherwise(F.col("x")))
        .withColumn("direct", F.when(fwd, "F").otherwise("R"))
        .drop("x", "orient")
    )


def singletons(contigs: DataFrame) -> DataFrame:
    """One-fragment layouts: forward from 0, no spread."""
    return contigs.select(F.col("contig_id").alias("scaffold_id"), "contig_id", F.lit(0.0).alias("start"), F.col("len").cast("double").alias("end"), F.lit("F").alias("direct"), F.lit(0.0).alias("std"), "len")


def unplaced(contigs: DataFrame, placed: DataFrame, min_len: int = 300) -> tuple[DataFrame, DataFrame]:
    """(singleton layouts, small fragments) of what is in no layout."""
    rest = contigs.join(placed.select("contig_id"), "contig_id", "left_anti")
    return singletons(rest.where(F.col("len") >= min_len)), rest.where(F.col("len") < min_len)


def flip(direct: Column) -> Column:
    return F.when(direct == "F", "R").otherwise("F")


def reversed_layout(layout: DataFrame) -> DataFrame:
    """Each scaffold read from its other end: [end - until, end - from] with the orientation flipped."""
    w = Window.partitionBy("scaffold_id")
    last = F.max("end").over(w)
    return layout.select(*[c for c in layout.columns if c not in ("start", "end", "direct")], (last - F.col("end")).alias("start"), (last - F.col("start")).alias("end"), flip(F.col("direct")).alias("direct")).select(layout.columns)


def shift_flip(layout: DataFrame, placement: DataFrame) -> DataFrame:
    """Put layouts at solved places (scaffold_id, orient, pos): +pos, or mirrored to pos - end .. pos - start."""
    p = layout.join(placement, "scaffold_id")
    same = F.col("orient") == 1
    return (
        p.withColumn("__s", F.when(same, F.col("start") + F.col("pos")).otherwise(F.col("pos") - F.col("end")))
        .withColumn("__e", F.when(same, F.col("end") + F.col("pos")).otherwise(F.col("pos") - F.col("start")))
        .withColumn("direct", F.when(same, F.col("direct")).otherwise(flip(F.col("direct"))))
        .withColumn("start", F.col("__s")).withColumn("end", F.col("__e")).drop("__s", "__e", "orient", "pos")
    )


def overlapping(s1: Column, e1: Column, s2: Column, e2: Column, sd: float) -> Column:
    """The earlier interval reaches over 3 spreads into the later one; equal starts do not count."""
    return ((s1 < s2) & (e1 - s2 > 3 * sd)) | ((s2 < s1) & (e2 - s1 > 3 * sd))


def neighbourhood(layout: DataFrame, reach: Column | float) -> DataFrame:
    """Pairs i before j of a scaffold with start_j < end_i + reach; joined by bins of starts, not all pairs.

    An interval goes to the one or two bins of the width (a power of two) that fits its own extent, and a start to its bin of
    every width in use (at most 64, the one list the driver sees), so a long fragment widens no other's bins.
    """
    rows = layout.withColumn("ord", F.row_number().over(by_place())).withColumn("until", F.col("end") + reach)
    extent = F.greatest(F.col("until") - F.col("start"), F.lit(1.0))
    rows = rows.withColumn("level", F.ceil(F.log2(extent)).cast("int"))
    used = sorted(r["level"] for r in rows.select("level").distinct().collect())
    width = F.pow(F.lit(2.0), F.col("level"))
    a = rows.select("scaffold_id", "level", *[F.col(c).alias(f"{c}_i") for c in ("contig_id", "ord", "start", "end", "until")])
    a = a.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start_i") / width), F.floor(F.greatest("start_i", "until_i") / width))))
    b = rows.select("scaffold_id", F.explode(F.array(*map(F.lit, used or [0]))).alias("level"), *[F.col(c).alias(f"{c}_j") for c in ("contig_id", "ord", "start", "end")])
    b = b.withColumn("bin", F.floor(F.col("start_j") / width))
    return a.join(b, ["scaffold_id", "level", "bin"]).where("ord_i < ord_j and start_j < until_i").drop("level", "bin", "until_i")


def overlap_conflicts(layout: DataFrame, sd: float) -> DataFrame:
    """Pairs of a scaffold that overlap by over 3 spreads."""
    n = neighbourhood(layout, F.lit(0.0))
    return n.where(overlapping(F.col("start_i"), F.col("end_i"), F.col("start_j"), F.col("end_j"), sd)).select("scaffold_id", F.col("contig_id_i").alias("c1"), F.col("contig_id_j").alias("c2"))


def window_candidates(layout: DataFrame, counts: DataFrame, max_insert: float, max_sd: float) -> DataFrame:
    """Fragments that an insert can reach (start_j < end_i + insert + 3 spreads), with their links (0 if none)."""
    n = neighbourhood(layout, F.lit(float(max_insert + 3 * max_sd)))
    c = counts.select(F.col("c1").alias("contig_id_i"), F.col("c2").alias("contig_id_j"), "n")
    return n.join(c, ["contig_id_i", "contig_id_j"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def best_partner(candidates: DataFrame) -> DataFrame:
    """Each fragment's most-linked candidate; of a tie the first in the layout."""
    best = F.max_by(F.struct("contig_id_j", "n"), F.struct(F.col("n"), -F.col("ord_j")))
    return candidates.groupBy("scaffold_id", "contig_id_i").agg(best.alias("b")).select("scaffold_id", F.col("contig_id_i").alias("c1"), F.col("b.contig_id_j").alias("c2"), F.col("b.n").alias("n"))


def strands_of(ids: list[int], start: list[float], end: list[float], links: dict[int, dict[int, int]], reach: float, sd: float, min_links: int) -> list[list[int]]:
    """Greedy chains by most links inside the window, then single strands join where nothing overlaps.

    Fragments are sorted by place; links: of each fragment, its linked ones and their number. The first remaining fragment
    starts a chain; it goes on with the candidate that has most links (over min_links; ties: nearer) until there is none; the
    rest is chained again. A chain of one then joins the chain of its most-linked fragment, unless it overlaps a member by
    over 3 spreads. Only linked fragments are looked at, never the whole window.
    """
    n = len(ids)
    at = {c: k for k, c in enumerate(ids)}
    near = [sorted((at[c], w) for c, w in links.get(k, {}).items() if c in at and c != k) for k in ids]
    chain_of, chains = [-1] * n, []
    for first in range(n):
        if chain_of[first] >= 0:
            continue
        chain, now = [first], first
        chain_of[first] = len(chains)
        while True:
            best, most = -1, min_links
            for j, w in near[now]:
                if j > now and chain_of[j] < 0 and start[j] < end[now] + reach and w > most:
                    best, most = j, w
            if best < 0:
                break
            chain.append(best)
            chain_of[best] = len(chains)
            now = best
        chains.append(chain)

    def clash(i: int, j: int) -> bool:
        return (start[i] < start[j] and end[i] - start[j] > 3 * sd) or (start[j] < start[i] and end[j] - start[i] > 3 * sd)

    for k, chain in enumerate(chains):
        if len(chain) == 1 and near[chain[0]]:
            (i,) = chain
            j, w = max(near[i], key=lambda x: (x[1], -x[0]))
            target = chain_of[j]
            if w > min_links and not any(clash(i, m) for m in chains[target]):
                chains[target].append(i)
                chain_of[i], chains[k] = target, []
    return [sorted(c) for c in chains if c]


def split_strands(layout: DataFrame, counts: DataFrame, min_links: int, max_insert: float, max_sd: float) -> DataFrame:
    """The layout with strand_id (smallest fragment) as scaffold_id: conflict-free chains of linked fragments."""
    own = layout.select("scaffold_id", "contig_id")
    inner = counts.join(own.withColumnRenamed("contig_id", "c1"), "c1").join(own.select(F.col("scaffold_id").alias("s2"), F.col("contig_id").alias("c2")), "c2").where("scaffold_id = s2")
    zero = F.lit(0.0)
    rows = layout.select("scaffold_id", F.lit(0).alias("kind"), F.col("contig_id").alias("c1"), F.lit(0).cast("long").alias("c2"), "start", F.col("end").alias("until"), F.lit(0).cast("long").alias("n"))
    rows = rows.unionByName(inner.select("scaffold_id", F.lit(1).alias("kind"), "c1", "c2", zero.alias("start"), zero.alias("until"), F.col("n").cast("long").alias("n")))
    reach = float(max_insert + 3 * max_sd)

    def run(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        node, link = g["kind"] == 0, g["kind"] == 1
        ids, links = g["c1"][node], {}
        for a, b, n in zip(g["c1"][link].tolist(), g["c2"][link].tolist(), g["n"][link].tolist()):
            links.setdefault(a, {})[b] = n
        strand = np.zeros(len(ids), np.int64)
        for s in strands_of(ids.tolist(), g["start"][node].tolist(), g["until"][node].tolist(), links, reach, max_sd, min_links):
            strand[s] = ids[s].min()
        return {"contig_id": ids, "strand": strand}

    found = by_runs(rows, ["scaffold_id"], ["kind", "start", "until", "c1"], run, "contig_id long, strand long")
    return layout.join(found, "contig_id").withColumn("scaffold_id", F.col("strand")).select(layout.columns)


def scaffold_ids(layout: DataFrame) -> DataFrame:
    """Scaffolds renamed to their smallest fragment, so numbering does not depend on who solved what first."""
    return layout.withColumn("scaffold_id", F.min("contig_id").over(Window.partitionBy("scaffold_id")))


def last_wins(layout: DataFrame, *order: str) -> DataFrame:
    """One row for each fragment: of several, that of the layout that comes last by `order` (then by scaffold and place)."""
    rank = F.struct(*order, "scaffold_id", "start", "end")
    return layout.groupBy("contig_id").agg(F.max_by(F.struct(*layout.columns), rank).alias("row")).select("row.*")
