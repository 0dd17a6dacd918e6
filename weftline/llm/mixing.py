"""Mixing sources to target weights by balanced (cube-method) sampling.

Each source gets a share of all words by its weight, at most CAP times what it has; the excess is shared
again by weight (water filling). A source's rate = target / size splits into whole copies that every
document gets and a fraction that the cube method samples: inclusion probabilities walk through the null
space of the two constraints (documents, words) until at most two per group are fractional. Documents are
dealt into blocks of bounded size inside their source, so a source that holds a third of all rows is many
groups; what the blocks leave fractional is merged 1024 blocks at a time and walks on. Only the last one or
two documents of a source land: the document total is given up first, so that the two walk on along the words
until one is whole, and a draw by its probability decides the last.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_text, cut, packed, quoted, table

CAP = 3.0
WEIGHTS = (1.0, 2.0, 3.0)
BLOCK = 4096
MERGE = 1024
#: Up to so many sources their table is broadcast; beyond, rows are joined to it by shuffle.
BROADCAST_SOURCES = 10_000
EPS = 1e-9

UNITS = "sid long, block long, doc_id long, k long, size long, base long, p double"


def word_sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, k (a hash of the text), size (words between ASCII white space; null text: 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pa.array([len(t.as_py().split()) for t in b.column(3)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), size], names=["doc_id", "source", "k", "size"])

    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(source_col)).cast("string").alias("source"), F.xxhash64(F.col(quoted(text_col)).cast("string")).alias("k"), binary_text(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, source string, k long, size long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Per source: sid, source, source_size, n_docs, target. Works on one row per source.

    With w_i the weights and s_i the sizes, the targets are min(t * w_i, cap * s_i) where t makes them sum
    to all words; t follows from prefix sums in order of cap * s_i / w_i.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by = by.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("w", w).withColumn("limit", cap * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("w"))
    order = Window.orderBy("ratio", "sid")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    by = by.withColumn("full", F.coalesce(F.sum("limit").over(before), F.lit(0.0))).withColumn("left_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    by = by.withColumn("t", (F.sum("source_size").over(everything) - F.col("full")) / F.col("left_w"))
    # the first source, in order of ratio, that the level does not fill fixes the level
    level = F.min(F.when(F.col("t") <= F.col("ratio"), F.struct("ratio", "sid", "t"))).over(everything)["t"]
    by = by.withColumn("level", level)
    return by.select("sid", "source", "source_size", "n_docs", F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least(F.col("level") * F.col("w"), F.col("limit"))).alias("target"))


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Walk the probabilities through the null space of (1, size); at most two stay fractional."""
    out = p.astype(float).tolist()
    mean = float(size.mean()) or 1.0
    x = (size / mean).tolist()
    draws = iter(rng.random(len(out) * 2 + 8).tolist())
    queue = iter([i for i, v in enumerate(out) if EPS < v < 1 - EPS])
    active: list[int] = []
    while True:
        while len(active) < 3 and (i := next(queue, None)) is not None:
            active.append(i)
        if len(active) == 3:
            a, b, c = (x[i] for i in active)
            u = (c - b, a - c, b - a)
            if max(map(abs, u)) < 1e-12:
                u = (1.0, -1.0, 0.0)
        elif len(active) == 2 and abs(x[active[0]] - x[active[1]]) < 1e-12:
            u = (1.0, -1.0)
        else:
            return np.array(out)
        up = down = math.inf
        for i, d in zip(active, u):
            if d > 1e-15:
                up, down = min(up, (1 - out[i]) / d), min(down, out[i] / d)
            elif d < -1e-15:
                up, down = min(up, -out[i] / d), min(down, (out[i] - 1) / d)
        step = up if next(draws, 0.5) * (up + down) < down else -down
        for i, d in zip(active, u):
            v = out[i] + step * d
            out[i] = 0.0 if v < EPS else 1.0 if v > 1 - EPS else v
        active = [i for i in active if 0.0 < out[i] < 1.0]


def land(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Solve the landing problem of the one or two units that the walk left fractional; all others stay as they are.

    Two units walk along (size of the other, minus own size), which keeps the words and gives up the number of documents,
    until one is whole; the last is drawn by its probability. Expectations stay the inclusion probabilities, and words
    differ from the target by less than the last unit's.
    """
    p = p.copy()
    at = np.flatnonzero((p > 0) & (p < 1))
    if len(at) == 2:
        (a, b), (u, v) = at, (size[at[1]], -size[at[0]])
        if not u and not v:
            u, v = 1.0, -1.0
        ends = []
        for sign in (1.0, -1.0):
            room = [((1 - p[i]) if sign * d > 0 else p[i]) / abs(d) for i, d in ((a, u), (b, v)) if d]
            ends.append(min(room))
        step = ends[0] if rng.random() * sum(ends) < ends[1] else -ends[1]
        for i, d in ((a, u), (b, v)):
            x = p[i] + step * d
            p[i] = 0.0 if x < EPS else 1.0 if x > 1 - EPS else x
        at = np.flatnonzero((p > 0) & (p < 1))
    for i in at:
        p[i] = float(rng.random() < p[i])
    return p


def _walk(last: bool):
    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        # long documents walk first, so what stays fractional and must be landed is short
        g = g.sort_values(["size", "k", "doc_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        size, rng = g["size"].to_numpy(np.float64), np.random.default_rng([int(key[0]), int(key[1]), int(last), 7])
        p = flight(g["p"].to_numpy(np.float64), size, rng)
        g["p"] = land(p, size, rng) if last else p
        return g

    return run


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, k (a hash of its text).

    Sources in code-point order, null last, take the weights in turn. Null texts have size 0; a document of
    size 0 takes no words; null ids and repeated rows are documents like any other; a source without words
    has target 0. Very long texts count with all their words and are no special case. Reruns agree. An empty table gives no rows.
    """
    sizes = cut(word_sizes(docs, id_col, text_col, source_col))
    plan = cut(targets(sizes, weights, cap))
    n_sources, most = plan.agg(F.count("*"), F.max("n_docs")).first()
    side = plan.withColumnRenamed("source", "__s")
    side = F.broadcast(side) if n_sources <= BROADCAST_SOURCES else side
    rows = sizes.join(side, F.col("source").eqNullSafe(F.col("__s")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("base", F.floor(rate + EPS).cast("long")).withColumn("p", F.greatest(rate - F.col("base"), F.lit(0.0)))
    blocks = F.ceil(F.col("n_docs") / BLOCK).cast("long")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "k"), blocks))
    units = rows.select(*[c.split()[0] for c in UNITS.split(", ")])
    parts, n = [], math.ceil((most or 1) / BLOCK)
    while True:
        last = n <= 1
        walked = units.groupBy("sid", "block").applyInPandas(_walk(last), UNITS)
        if last:
            parts.append(walked)
            break
        walked = cut(walked)
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        parts.append(walked.where(~open_))
        units = walked.where(open_).withColumn("block", F.floor(F.col("block") / MERGE).cast("long"))
        n = math.ceil(n / MERGE)
    done = parts[0]
    for x in parts[1:]:
        done = done.unionByName(x)
    done = done.withColumn("copies", F.col("base") + F.round("p").cast("long"))
    side = plan.select("sid", "source_size", "target")
    side = F.broadcast(side) if n_sources <= BROADCAST_SOURCES else side
    return done.join(side, "sid").select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "k")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixture itself: every document as often as the mix takes it, with its own columns, whatever these are named.

    Rows that repeat both id and text share the copies that the mix gives them all. Null texts, ids and sources are as
    in mix(); a document that the mix takes no copy of is left out. Very long texts are rows like any other. An empty table
    gives no rows.
    """
    plan = mix(docs, id_col, text_col, source_col).groupBy("doc_id", "k").agg(F.sum("copies").alias("copies"), F.count("*").alias("n"))
    plan = plan.where("copies > 0").select(F.col("doc_id").alias("id"), F.col("k").alias("own"), "copies", "n")
    rows = packed(docs, doc_id=F.col(quoted(id_col)).cast("long"), k=F.xxhash64(F.col(quoted(text_col)).cast("string")))
    rows = rows.join(plan, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("k") == F.col("own")))
    one = rows.where("n = 1").select("__row", "copies")
    rest = rows.where("n > 1").withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "k").orderBy(F.lit(1))))
    share = F.floor(F.col("copies") / F.col("n")) + F.when(F.col("nth") <= F.col("copies") % F.col("n"), 1).otherwise(0)
    rest = rest.select("__row", share.cast("long").alias("copies")).where("copies > 0")
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return one.unionByName(rest).select("__row", copies.alias("copy")).select("__row.*")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("k")
