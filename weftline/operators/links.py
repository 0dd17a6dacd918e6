"""Read pairs to link evidence: span filters, offsets, counts, votes and graph edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.ordering import percentile
from weftline.model import LONG_READ_SD


def with_library(pairs: DataFrame, libraries: DataFrame) -> DataFrame:
    """Pairs with their library's type, insert size and spread; the library table is a handful of configured rows."""
    return pairs.join(F.broadcast(libraries), "lib")


def with_lengths(pairs: DataFrame, contigs: DataFrame) -> DataFrame:
    """Pairs with both fragments' lengths; adaptive execution broadcasts the lengths when they are small."""
    a = contigs.select(F.col("contig_id").alias("c1"), F.col("len").alias("len1"))
    b = contigs.select(F.col("contig_id").alias("c2"), F.col("len").alias("len2"))
    return pairs.join(a, "c1").join(b, "c2")


def span(inward: bool) -> Column:
    """The larger distance from a read to the fragment end its mate lies beyond."""
    if inward:  # short inserts: reads point to each other
        d1 = F.when(F.col("p1") < F.col("m1"), F.col("len1") - F.col("p1")).otherwise(F.col("p1"))
        d2 = F.when(F.col("p2") > F.col("m2"), F.col("p2")).otherwise(F.col("len2") - F.col("p2"))
    else:
        d1 = F.when(F.col("p1") > F.col("m1"), F.col("len1") - F.col("m1")).otherwise(F.col("m1"))
        d2 = F.when(F.col("p2") < F.col("m2"), F.col("m2")).otherwise(F.col("len2") - F.col("m2"))
    return F.greatest(d1, d2)


def span_filter(pairs: DataFrame, libraries: DataFrame, contigs: DataFrame) -> DataFrame:
    """Drop self links, and pairs that no insert of the library (size + 3 spreads) can explain; ties p = m stay."""
    p = with_lengths(with_library(pairs.where("c1 <> c2"), libraries), contigs)
    bound = F.col("insert_size") + 3 * F.col("sd")
    tie = (F.col("p1") == F.col("m1")) | (F.col("p2") == F.col("m2"))
    far = F.when(F.col("lib_type") == "PE", span(True)).otherwise(span(False)) > bound
    return p.where(tie | ~far).select(pairs.columns)


def link_observations(pairs: DataFrame, libraries: DataFrame, gap_corrected: bool = False) -> DataFrame:
    """lib, lib_type, c1, c2, cons (+1 same orientation), diff (start of c2 minus start of c1, in c1's frame).

    Rows with p = m have no orientation and are dropped. gap_corrected adds sd^2 / (1 + size) to the insert size.
    """
    p = with_library(pairs.where("p1 <> m1 and p2 <> m2"), libraries)
    size = F.col("insert_size")
    if gap_corrected:
        size = size + gap_correction(F.col("insert_size"), F.col("sd"))
    p1, m1, p2, m2 = (F.col(c) for c in ("p1", "m1", "p2", "m2"))
    fwd1, fwd2, pe = p1 < m1, p2 < m2, F.col("lib_type") == "PE"
    inner = size - F.abs(p1 - m1) - F.abs(p2 - m2)
    # a read that points away from its fragment's start puts the start at +p, otherwise at -p; likewise the mate
    reach = F.when(pe, size).otherwise(inner)
    away1 = F.when(pe, fwd1).otherwise(~fwd1)
    away2 = F.when(pe, fwd2).otherwise(~fwd2)
    diff = F.when(away1 & ~away2, reach - p2 + p1).when(away1 & away2, reach + p2 + p1).when(~away1 & ~away2, p1 + p2 - reach).otherwise(p1 - p2 - reach)
    cons = F.when(fwd1 != fwd2, 1).otherwise(-1)
    return p.select("lib", "lib_type", "c1", "c2", cons.cast("int").alias("cons"), diff.cast("double").alias("diff"))


def gap_correction(size: Column, sd: Column) -> Column:
    return (sd * sd / (1 + size)).cast("long")


def long_link_observations(links: DataFrame) -> DataFrame:
    """Links of long reads (lib, c1, c2, dir, diff) as observations; dir 1 is opposite orientation."""
    return links.select("lib", F.lit("3GS").alias("lib_type"), "c1", "c2", (1 - 2 * F.col("dir")).cast("int").alias("cons"), F.col("diff").cast("double").alias("diff"))


def both_ways(obs: DataFrame, *extra: str) -> DataFrame:
    """Every observation from either end, by one pass over the input."""
    ends = F.explode(F.array(F.struct(F.col("c1").alias("a"), F.col("c2").alias("b")), F.struct(F.col("c2").alias("a"), F.col("c1").alias("b"))))
    return obs.withColumn("__e", ends).select(F.col("__e.a").alias("c1"), F.col("__e.b").alias("c2"), *extra)


def link_counts(obs: DataFrame) -> DataFrame:
    """Symmetric number of links of each pair over all libraries; counted before it is mirrored."""
    one_way = obs.groupBy("c1", "c2").agg(F.count("*").alias("k"))
    return both_ways(one_way, "k").groupBy("c1", "c2").agg(F.sum("k").alias("n"))


def orientation_votes(obs: DataFrame) -> DataFrame:
    """Symmetric votes: n_pos and n_neg over all libraries, and of short and long ones; each link votes once."""
    short = F.col("lib_type") == "PE"
    one_way = obs.groupBy("c1", "c2").agg(
        *[F.sum(F.when((F.col("cons") == s) & k, 1).otherwise(0)).alias(n) for n, s, k in (("short_pos", 1, short), ("short_neg", -1, short), ("long_pos", 1, ~short), ("long_neg", -1, ~short))]
    )
    cols = ("short_pos", "short_neg", "long_pos", "long_neg")
    v = both_ways(one_way, *cols).groupBy("c1", "c2").agg(*[F.sum(c).alias(c) for c in cols])
    return v.select("c1", "c2", (F.col("short_pos") + F.col("long_pos")).alias("n_pos"), (F.col("short_neg") + F.col("long_neg")).alias("n_neg"), *cols)


def auto_threshold(counts: DataFrame, p: float = 0.1) -> DataFrame:
    """One row: the exact percentile of the symmetric link counts other than 1, cut to an integer."""
    return percentile(counts.where("n <> 1"), "n", p).select(F.col("percentile").cast("long").alias("min_links"))


def auto_threshold_sqrt(counts: DataFrame, contigs: DataFrame, least: float = 0.7) -> DataFrame:
    """One row: the threshold that goes with the weighting 'sqrt': the exact percentile p of all symmetric counts, with
    p = 1 - 2 fragments / pairs, at least `least`."""
    p = max(1 - 2 * contigs.count() / max(1, counts.count()), least)
    return percentile(counts, "n", p).select(F.col("percentile").alias("min_links"))


def contig_edges(votes: DataFrame, contigs: DataFrame, min_links: int, min_len: int = 300) -> DataFrame:
    """Edges (c1 < c2): the stronger orientation has over min_links votes, votes do not balance, both are long enough."""
    v = votes.where("c1 < c2 and n_pos <> n_neg").where(F.greatest("n_pos", "n_neg") > min_links)
    return with_lengths(v, contigs).where((F.col("len1") > min_len) & (F.col("len2") > min_len)).select("c1", "c2", F.greatest("n_pos", "n_neg").alias("weight"), (F.col("n_pos") - F.col("n_neg")).alias("direct_sum"))


def loose_edges(votes: DataFrame, contigs: DataFrame, min_len: int = 300) -> DataFrame:
    """Pairs with any link, both long enough."""
    return with_lengths(votes.where("c1 < c2 and n_pos + n_neg > 0"), contigs).where((F.col("len1") > min_len) & (F.col("len2") > min_len)).select("c1", "c2")


def conflict_links(votes: DataFrame, min_links: int) -> DataFrame:
    """Pairs whose weaker orientation has min_links votes or more."""
    return votes.where("c1 < c2").where(F.least("n_pos", "n_neg") >= min_links).select("c1", "c2", "n_pos", "n_neg")


def recalibrate(self_pairs: DataFrame, libraries: DataFrame, contigs: DataFrame) -> DataFrame:
    """Insert size (median, cut to an integer) and sample spread from pairs inside one long fragment.

    Libraries with one such pair or none are dropped; long-read libraries pass with zeros.
    """
    p = with_library(self_pairs.where("c1 = c2"), libraries.where("lib_type <> '3GS'"))
    p = p.join(contigs.select(F.col("contig_id").alias("c1"), "len"), "c1").where(F.col("len") >= 3 * F.col("insert_size"))
    x = F.greatest("p1", "m1", "p2", "m2") - F.least("p1", "m1", "p2", "m2")
    p = p.withColumn("x", x).where(F.abs(F.col("x") - F.col("insert_size")) <= 3 * F.col("sd"))
    new = p.groupBy("lib", "lib_type").agg(F.median("x").cast("long").alias("insert_size"), F.stddev_samp("x").alias("sd"), F.count("*").alias("n")).where("n > 1").drop("n")
    long = libraries.where("lib_type = '3GS'").select("lib", "lib_type", F.lit(0).cast("long").alias("insert_size"), F.lit(0.0).alias("sd"))
    return new.unionByName(long)


def library_limits(libraries: DataFrame) -> DataFrame:
    """Largest insert size and spread, of mate-pair libraries (at least 1000 and 10), and largest spread of all."""
    mp = F.col("lib_type") == "MP"
    return libraries.agg(
        F.greatest(F.coalesce(F.max(F.when(mp, F.col("insert_size"))), F.lit(0)), F.lit(1000)).cast("long").alias("max_in"),
        F.greatest(F.coalesce(F.max(F.when(mp, F.col("sd"))), F.lit(0.0)), F.lit(10.0)).alias("max_sd"),
        F.greatest(F.max("sd"), F.when(F.min(F.col("lib_type") == "3GS"), F.lit(LONG_READ_SD)).otherwise(F.lit(1.0))).alias("any_sd"),
    )
