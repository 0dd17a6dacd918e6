"""The whole scaffolding run as DataFrame stages; what is used more than once is written to the shared folder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import sequence
from weftline.operators import assess, cluster, layout, links, longread, merge, regress, superscaffold
from weftline.operators.components import checkpointed, connected_components
from weftline.sources import readers, sinks
from weftline.sources.readers import Config


@dataclass
class Options:
    """min_links 0: chosen from the counts. The defaults are those of a generated run."""

    min_links: int = 12
    max_error: float = 100.0
    min_cluster: int = 2
    min_for_variance: int = 6
    min_len: int = 300
    component_cap: int = 3000
    scaffold_cap: int = 500
    rounds: int = 2
    weighting: str = "variance"
    gap_corrected: bool = False
    min_score: int = 40
    hang: int = 20

    @classmethod
    def of(cls, config: Config, **more) -> "Options":
        """The options that a configuration sets (its threads are the cluster's business), and others by name."""
        return cls(**({k: v for k, v in config.options().items() if k != "threads"} | more))


def chosen_threshold(counts: DataFrame, contigs: DataFrame, o: Options) -> int:
    """min_links, or what the counts say where it is 0."""
    if o.min_links:
        return o.min_links
    auto = links.auto_threshold_sqrt(counts, contigs) if o.weighting == "sqrt" else links.auto_threshold(counts)
    return int(auto.first()[0] or 0)


def contig_layout(obs: DataFrame, libraries: DataFrame, contigs: DataFrame, o: Options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(layout, counts, small fragments) from link observations."""
    counts = checkpointed(links.link_counts(obs))
    votes = checkpointed(links.orientation_votes(obs))
    least = chosen_threshold(counts, contigs, o)
    edges = links.contig_edges(votes, contigs, least, o.min_len)
    comp = checkpointed(connected_components(edges.select(F.col("c1").alias("src"), F.col("c2").alias("dst"))))
    rows = cluster.observation_rows(cluster.jump_clusters(obs, libraries, exact_band=True), o.min_cluster, o.min_for_variance, o.weighting)
    solved = regress.regress(comp, rows, votes, o.max_error, least, cap=o.component_cap, contigs=contigs)
    placed = checkpointed(layout.scaffold_ids(layout.project(solved.join(contigs, "contig_id"))))
    alone, small = layout.unplaced(contigs, placed, o.min_len)
    return placed.unionByName(alone.select(placed.columns)), counts, small


def superscaffold_round(obs: DataFrame, placed: DataFrame, max_sd: float, least: int, tolerance: float, cap: int) -> DataFrame:
    """One round: orient and place scaffolds by the links between them; the others stay as they are."""
    flat = checkpointed(layout.normalised(placed))
    offsets = checkpointed(superscaffold.scaffold_offsets(obs, flat))
    votes = checkpointed(superscaffold.scaffold_votes(offsets))
    edges = superscaffold.scaffold_edges(votes, least)
    comp = checkpointed(connected_components(edges.select(F.col("s1").alias("src"), F.col("s2").alias("dst"))))
    pooled = superscaffold.scaffold_observations(offsets, least)
    sd = pooled.sparkSession.createDataFrame([("ALL", "ALL", 0, float(max_sd))], "lib string, lib_type string, insert_size long, sd double")
    rows = cluster.observation_rows(cluster.jump_clusters(pooled, sd, exact_band=True), 3, 1 << 30)
    rows = rows.withColumn("v", F.lit(float(max_sd))).withColumn("w", F.col("n") / float(max_sd))
    sizes = flat.groupBy(F.col("scaffold_id").alias("contig_id")).agg(F.max("end").alias("len"))
    v = votes.select(F.col("s1").alias("c1"), F.col("s2").alias("c2"), "n_pos", "n_neg")
    solved = regress.regress(comp, rows, v, tolerance, min(20, least), strict=False, cap=cap, contigs=sizes, draws=False)
    place = solved.select(F.col("contig_id").alias("scaffold_id"), F.col("scaffold_id").alias("super_id"), "orient", F.col("x").alias("pos"))
    moved = layout.shift_flip(flat, place).withColumn("scaffold_id", F.col("super_id")).drop("super_id")
    kept = flat.join(place.select("scaffold_id"), "scaffold_id", "left_anti")
    return checkpointed(layout.scaffold_ids(moved.select(flat.columns).unionByName(kept.select(flat.columns))))


def scaffold(pairs: DataFrame, libraries: DataFrame, contigs: DataFrame, options: Options | None = None, long_links: DataFrame | None = None) -> dict[str, DataFrame]:
    """layout (with gap and piece), small fragments, counts. Pairs are filtered with the nominal library values and,
    where a library has pairs inside fragments, measured with recalibrated ones."""
    o = options or Options()
    filtered = links.span_filter(pairs, libraries, contigs)
    new = links.recalibrate(pairs, libraries, contigs)
    libs = checkpointed(new.unionByName(libraries.join(new.select("lib"), "lib", "left_anti").select(new.columns)))
    obs = links.link_observations(filtered, libs, o.gap_corrected)
    if long_links is not None:
        obs = obs.unionByName(links.long_link_observations(long_links))
    obs = checkpointed(obs)
    placed, counts, small = contig_layout(obs, libs, contigs, o)
    limit = links.library_limits(libs).first()
    least = chosen_threshold(counts, contigs, o)
    for i in range(1, o.rounds):
        placed = layout.split_strands(placed, counts, least // 2, limit["max_in"], limit["max_sd"])
        placed = superscaffold_round(obs, placed, limit["any_sd"], least, 100.0 + 50 * i, o.scaffold_cap)
    placed = checkpointed(layout.split_strands(placed, counts, least // 2, limit["max_in"], limit["max_sd"]))
    final = layout.gap_breaks(layout.gaps(placed), limit["max_in"] + limit["max_sd"])
    return {"layout": final, "small": small, "counts": counts, "limits": limit}


def sequences(placed: DataFrame, small: DataFrame, seqs: DataFrame, max_insert: float, max_sd: float, o: Options) -> dict[str, DataFrame]:
    """From a layout to what is written: units (fragments and merged fragments, with name, gap and piece), fasta, log and
    evidence lines. Small fragments follow the scaffolds, each as one of its own; numbers go by the smallest fragment."""
    units = merge.merged_units(placed, seqs, max_sd, o.min_score, o.hang)
    units = checkpointed(layout.gap_breaks(layout.gaps(units), max_insert + max_sd))
    pieces = units.select("scaffold_id", "piece", F.lit(0).alias("kind")).distinct()
    single = small.select(F.col("contig_id").alias("scaffold_id"), F.lit(0).cast("long").alias("piece"), F.lit(1).alias("kind"))
    names = sinks.renumbered(pieces.unionByName(single), "kind", "scaffold_id", "piece")
    units = units.join(names.where("kind = 0").drop("kind"), ["scaffold_id", "piece"])
    alone = small.join(names.where("kind = 1").select(F.col("scaffold_id").alias("contig_id"), "name"), "contig_id")
    pieces = sequence.placed(units).join(names.where("kind = 0").drop("kind"), ["scaffold_id", "piece"]).select("name", "offset", "seq")
    pieces = pieces.unionByName(alone.join(seqs, "contig_id").select("name", F.lit(0).cast("long").alias("offset"), "seq"))
    lines = sinks.fasta_rows(pieces, names)
    parts = F.array_sort(F.collect_list(F.struct("offset", "seq")))
    text = pieces.groupBy("name").agg(F.array_join(F.transform(parts, lambda x: x["seq"]), "").alias("seq"))
    log = sinks.scaffold_log_lines(units, alone)
    # evidence lists the layout's fragments, merged or not, in the pieces that were written
    number = lambda t: t.withColumn("number", F.substring("name", 9, 20).cast("long"))
    own = number(units).select("number", F.explode(F.split("ids", "\\+")).alias("contig_id")).withColumn("contig_id", F.col("contig_id").cast("long"))
    told = placed.join(own, "contig_id").drop("scaffold_id", "gap", "piece").withColumnRenamed("number", "scaffold_id")
    evidence = sinks.evidence_lines(layout.gaps(told), small=number(alone).select(F.col("number").alias("scaffold_id"), "contig_id", "len"))
    return {"units": units, "fasta": text, "fasta_rows": lines, "log": log, "evidence": evidence}


def run(pairs: DataFrame, config: Config, seqs: DataFrame, alignments: DataFrame | None = None, **more) -> dict[str, DataFrame]:
    """The whole run from read pairs (lib names as in the configuration), fragments (contig_id, seq) and long-read alignments
    to layout, units, fasta (whole texts) and fasta_rows (its lines), log and evidence."""
    o = Options.of(config, **more)
    contigs = seqs.select("contig_id", F.length("seq").cast("long").alias("len"))
    links3 = longread.read_links(alignments, config.classes()["3GS"][0] if config.classes()["3GS"] else "3GS") if alignments is not None else None
    got = scaffold(pairs, config.frame(pairs.sparkSession), contigs, o, links3)
    return got | sequences(got["layout"].drop("gap", "piece"), got["small"], seqs, got["limits"]["max_in"], got["limits"]["max_sd"], o)


def write_run(got: dict[str, DataFrame], folder: str) -> None:
    """Layout as Parquet; FASTA, log and evidence as text, in order of their scaffolds."""
    got["layout"].write.parquet(f"{folder}/layout")
    at = F.substring("name", 9, 20).cast("long")
    # line by line: no row holds a whole scaffold
    got["fasta_rows"].repartitionByRange(at, "line").sortWithinPartitions(at, "line").select("value").write.text(f"{folder}/fasta")
    got["log"].repartitionByRange(at, "ord").sortWithinPartitions(at, "ord").select("value").write.text(f"{folder}/log")
    got["evidence"].repartitionByRange("scaffold_id", "ord").sortWithinPartitions("scaffold_id", "ord").select("value").write.text(f"{folder}/evidence")


def assess_scaffolds(pairs: DataFrame, libraries: DataFrame, contigs: DataFrame, positions: DataFrame, tolerance: float = 200.0) -> DataFrame:
    """Verdict per scaffold part: links against given positions (scaffold_id, contig_id, pos)."""
    obs = links.link_observations(links.span_filter(pairs, libraries, contigs), libraries)
    rows = cluster.observation_rows(cluster.jump_clusters(obs.where("cons = 1"), libraries, exact_band=True))
    return assess.broken_parts(assess.residuals(rows, positions), positions, tolerance)


def assess_text(pairs: DataFrame, libraries: DataFrame, contigs: DataFrame, evidence: DataFrame, tolerance: float = 200.0) -> DataFrame:
    """Verdicts as text from the evidence lines (line_no, value) of scaffolds: scaffold_id, value."""
    return sinks.assessment_lines(assess_scaffolds(pairs, libraries, contigs, readers.parse_evidence(evidence), tolerance))
