"""One-dimensional clustering of a pair's observed offsets, and the regression rows made of clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.runs import by_runs
from weftline.model import LONG_READ_SD

KEY = ["lib", "c1", "c2", "cons"]


def spread(with_lib: DataFrame) -> DataFrame:
    return with_lib.withColumn("sd", F.when(F.col("lib_type") == "3GS", F.lit(LONG_READ_SD)).otherwise(F.col("sd")))


def jump_clusters(obs: DataFrame, libraries: DataFrame, exact_band: bool = False) -> DataFrame:
    """Observations with a cluster number per (lib, c1, c2, cons).

    Sorted offsets are split where a gap exceeds max(10, sd), never where it is under half of that; a group whose
    variance is below sd^2 is one cluster. In the band between, a density minimum decides: with exact_band the
    groups that have such a gap are re-clustered by `density_splits`, otherwise the band does not split.
    """
    o = spread(obs.drop("lib_type").join(F.broadcast(libraries.select("lib", "lib_type", "sd")), "lib"))
    w = Window.partitionBy(*KEY)
    order = w.orderBy("diff")
    wide = F.greatest(F.col("sd"), F.lit(10.0))
    o = o.withColumn("gap", F.col("diff") - F.lag("diff").over(order)).withColumn("one", F.sqrt(F.var_pop("diff").over(w)) < F.col("sd"))
    cut = F.when(F.col("gap") > wide, 1).otherwise(0)
    o = o.withColumn("cut", F.when(F.col("one"), 0).otherwise(cut))
    o = o.withColumn("cluster", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cols = ["lib", "lib_type", "c1", "c2", "cons", "diff", "sd", "cluster"]
    if not exact_band:
        return o.select(cols)
    band = (~F.col("one")) & (F.col("gap") >= wide / 2) & (F.col("gap") <= wide)
    o = o.withColumn("unclear", F.max(F.coalesce(band, F.lit(False))).over(w))
    clear = o.where(~F.col("unclear")).select(cols)

    def split(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return g | {"cluster": density_splits(g["diff"], float(max(10.0, g["sd"][0])))}

    return clear.unionByName(by_runs(o.where("unclear").select(cols), KEY, ["diff"], split, clear.schema))


def density_peaks(y: np.ndarray, distance: int = 3) -> np.ndarray:
    """Indices of local maxima (middle of a plateau, not at the ends), the higher winning within `distance`."""
    found, i, n = [], 1, len(y)
    while i < n - 1:
        if y[i] > y[i - 1]:
            j = i
            while j < n - 1 and y[j + 1] == y[i]:
                j += 1
            if j < n - 1 and y[j + 1] < y[i]:
                found.append((i + j) // 2)
            i = j + 1
        else:
            i += 1
    found = np.array(found, int)
    keep = np.ones(len(found), bool)
    for at in np.argsort(-y[found], kind="stable").tolist() if len(found) else []:
        if keep[at]:
            for step in (-1, 1):
                near = at + step
                while 0 <= near < len(found) and abs(found[near] - found[at]) < distance:
                    keep[near] = False
                    near += step
    return found[keep]


#: Offsets of a group whose density is summed directly; beyond, by expansions about cells of CELL widths, with TERMS terms, over
#: cells within REACH widths. What lies further away weighs less than exp(-REACH^2 / 2) = 2e-18 of a sample each; the terms
#: left out, with z = (REACH + CELL) CELL / 2 the largest product of the two distances, less than z^TERMS / TERMS! = 1e-16.
DIRECT, CELL, REACH, TERMS = 2000, 0.5, 9.0, 32


def kernel_sums(x: np.ndarray, h: float) -> np.ndarray:
    """Sum over all samples v of exp(-((x - v) / h)^2 / 2) at each sample x (sorted)."""
    if len(x) <= DIRECT:
        return np.array([np.exp(-0.5 * ((x - v) / h) ** 2).sum() for v in x])
    cell, start, back = np.unique(np.floor((x - x[0]) / (h * CELL)), return_index=True, return_inverse=True)
    centre = x[0] + (cell + 0.5) * (h * CELL)
    off = (x - centre[back]) / h  # at most CELL / 2
    # exp(-(d - off)^2 / 2) = exp(-d^2 / 2) sum_k d^k off^k / k! exp(-off^2 / 2), with d the distance from the cell's centre
    moments, term = np.zeros((TERMS, len(cell))), np.exp(-0.5 * off * off)
    for k in range(TERMS):
        moments[k] = np.add.reduceat(term, start)
        term = term * off / (k + 1)
    out = np.zeros(len(x))
    for step in range(-int(REACH / CELL) - 1, int(REACH / CELL) + 2):
        at = np.minimum(np.searchsorted(cell, cell + step), len(cell) - 1)
        met = cell[at] == cell + step
        use = np.flatnonzero(met[back])
        if len(use):
            source = at[back[use]]
            d = (x[use] - centre[source]) / h
            value = np.zeros(len(use))
            for k in range(TERMS - 1, -1, -1):
                value = value * d + moments[k, source]
            out[use] += np.exp(-0.5 * d * d) * value
    return out


def density_splits(x: np.ndarray, sd: float) -> np.ndarray:
    """Cluster numbers of sorted offsets: gaps over sd split; gaps from sd/2 split where a border of the kernel
    density's neighbouring peaks (Gaussian, width min(sd/2, 100)) falls into them."""
    peak = x[density_peaks(kernel_sums(x, min(sd / 2, 100.0)))]
    borders = np.sort(np.r_[(peak[1:] + peak[:-1]) / 2, x[:-1][np.diff(x) > sd] + sd / 2])
    gap = np.diff(x)
    inside = np.searchsorted(borders, x[1:]) > np.searchsorted(borders, x[:-1])
    return np.r_[0, np.cumsum((gap >= sd / 2) & inside)].astype(int)


def observation_rows(clusters: DataFrame, min_cluster: int = 2, min_for_variance: int = 6, weighting: str = "variance") -> DataFrame:
    """Regression rows per cluster: n, y (median), v, w.

    v is max(variance, 1) from min_for_variance links on, else sd^2, and w = 100 n / v; weighting='sqrt' takes
    v = standard deviation + 1 and w = sqrt(n) / v.
    """
    g = clusters.groupBy(*KEY, "lib_type", "cluster").agg(F.count("*").alias("n"), F.median("diff").alias("y"), F.var_pop("diff").alias("var"), F.max("sd").alias("sd")).where(F.col("n") >= min_cluster)
    if weighting == "sqrt":
        v = F.sqrt("var") + 1
        w = F.sqrt("n") / v
    else:
        v = F.when(F.col("n") >= min_for_variance, F.greatest("var", F.lit(1.0))).otherwise(F.col("sd") * F.col("sd"))
        w = 100 * F.col("n") / v
    return g.select(*KEY, "cluster", "n", "y", v.alias("v"), w.alias("w"))
