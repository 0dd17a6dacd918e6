"""Readers of the text formats, each with its schema given; config files are read on the driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.ordering import numbered, running_sum
from weftline.model import ALIGNMENTS, HEADLINE, LIBRARIES
from weftline.operators.components import checkpointed


#: Names of a configuration's parameters that the engine uses, and of its options (fixed values).
PARAMETERS = {"reg_m": "min_links", "ScafIter": "rounds", "thread": "threads"}


@dataclass
class Config:
    """Libraries (name, type PE / MP / 3GS, insert size, deviation, paths) and parameters of a run, as they are named there."""

    libraries: list[tuple] = field(default_factory=list)
    parameters: dict[str, str] = field(default_factory=lambda: {"thread": "4", "reg_m": "12", "ScafIter": "2"})

    def frame(self, spark: SparkSession) -> DataFrame:
        """The library table. Long-read libraries carry neither size nor deviation."""
        return spark.createDataFrame([(n, t, int(float(i)), float(d)) for n, t, i, d, *_ in self.libraries], LIBRARIES)

    def classes(self) -> dict[str, list[str]]:
        """Names of the libraries of each type."""
        return {t: [x[0] for x in self.libraries if x[1] == t] for t in ("PE", "MP", "3GS")}

    def options(self) -> dict[str, int]:
        """The parameters that are options of a run, by their names there."""
        return {PARAMETERS[k]: int(float(v)) for k, v in self.parameters.items() if k in PARAMETERS}


def parse_config(text: str) -> Config:
    """Two sections, headed by lines whose second word is 'library_name' or 'parameters', whatever follows it (a list of
    fields, an explanation); fields are separated by commas and trimmed, empty lines are left out."""
    out, section = Config(), ""
    for line in map(str.strip, text.splitlines()):
        fields = [f.strip() for f in line.split(",")]
        if line.startswith("#"):
            section = (line.lstrip("#").split() or [""])[0].rstrip(",")
        elif fields[0] and section == "library_name":
            out.libraries.append(tuple(fields))
        elif fields[0] and section == "parameters":
            out.parameters[fields[0]] = fields[1] if len(fields) > 1 else ""
    return out


def read_config(path: str) -> Config:
    with open(path, encoding="utf-8") as f:
        return parse_config(f.read())


def contig_number(name: Column) -> Column:
    """The number behind the prefix 'contig'."""
    return F.substring(name, 7, 20).cast("long")


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated contig<N>, 1, length."""
    d = spark.read.csv(path, sep="\t", schema="name string, one int, len long")
    return d.select(contig_number(F.col("name")).alias("contig_id"), "len")


def read_libraries(spark: SparkSession, path: str) -> DataFrame:
    """Space-separated lib, type, tab file, insert size, sd (rounded to two decimals)."""
    d = spark.read.csv(path, sep=" ", schema="lib string, lib_type string, tab string, insert_size double, sd double")
    return d.select("lib", "lib_type", F.col("insert_size").cast("long").alias("insert_size"), F.round("sd", 2).alias("sd"))


def read_pairs(spark: SparkSession, path: str, lib: str) -> DataFrame:
    """Tab-separated contig1, p1, m1, contig2, p2, m2."""
    d = spark.read.csv(path, sep="\t", schema="a string, p1 long, m1 long, b string, p2 long, m2 long")
    return d.select(F.lit(lib).alias("lib"), contig_number(F.col("a")).alias("c1"), "p1", "m1", contig_number(F.col("b")).alias("c2"), "p2", "m2")


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """Space-separated long-read alignments in twelve columns."""
    schema = ALIGNMENTS.replace("qname long", "qname string").replace("tname long", "tname string")
    d = spark.read.csv(path, sep=" ", schema=schema)
    return d.withColumn("tname", contig_number(F.col("tname")))


def read_long_links(spark: SparkSession, path: str, lib: str) -> DataFrame:
    """Space-separated c1, c2, dir, diff, s1, s2."""
    return spark.read.csv(path, sep=" ", schema="c1 long, c2 long, dir int, diff long, s1 long, s2 long").withColumn("lib", F.lit(lib))


def read_layouts(spark: SparkSession, path: str) -> DataFrame:
    """Layout files, a scaffold or several each, a headline before every one; the smallest fragment names the scaffold. modified and
    file tell which of a fragment's rows is the newest, where several files hold it."""
    meta = F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    lines = spark.read.text(path).select(*meta, F.monotonically_increasing_id().alias("nth"), F.trim("value").alias("value"))
    lines = lines.withColumn("head", F.col("value").startswith(HEADLINE).cast("int"))
    # headlines up to a line: within its split of the file, and in the splits before (one row each)
    lines = lines.withColumn("own", F.sum("head").over(Window.partitionBy("file", "block").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)))
    splits = lines.groupBy("file", "block").agg(F.max("own").alias("heads"))
    before = F.sum("heads").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    lines = lines.join(splits.select("file", "block", F.coalesce(before, F.lit(0)).alias("before")), ["file", "block"])
    lines = lines.select("modified", "file", (F.col("own") + F.col("before")).alias("part"), F.split("value", " +").alias("f")).where(F.size("f") == 7)
    rows = lines.select("modified", "file", "part", *[F.element_at("f", i + 1).cast(t).alias(n) for i, (n, t) in enumerate((("contig_id", "long"), ("start", "double"), ("end", "double"), ("direct", "string"), ("std", "double"), ("gap", "double"), ("len", "long")))])
    rows = rows.where(F.col("direct").isin("F", "R"))
    return rows.withColumn("scaffold_id", F.min("contig_id").over(Window.partitionBy("file", "part"))).drop("gap", "part")


#: Bases of one piece of a record.
PIECE = 1 << 20


def fasta_pieces(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """Records in pieces of about `piece` bases at most: file, record (from 1 in each file), name (all of the heading), offset (of
    the piece in its record), seq. A record without bases has one empty piece.

    Lines are read in Spark's own splits, so a record that is longer than a split is read by several tasks. Each task
    tells where its lines stand within the split; what the splits before it in the file add (records, the last one's name and
    bases) is one row a split. '>' counts at the start of a line only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, record, offset, held, size, fresh, name = None, 0, 0, [], 0, False, None
        out: list[tuple] = []

        def close() -> None:
            nonlocal offset, held, size, fresh
            if held or fresh:
                out.append((*split, record, name, offset, "".join(held)))
            offset, held, size, fresh = offset + size, [], 0, False

        def batch() -> pa.RecordBatch:
            columns = [pa.array(c, type=t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()))]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["file", "block", "record", "name", "offset", "seq"])

        for b in batches:
            for file, block, line in zip(*(c.to_pylist() for c in b.columns)):
                if (file, block) != split:
                    if split:
                        close()
                    split, record, offset, name = (file, block), 0, 0, None
                if line.startswith(">"):
                    close()
                    record, offset, name, fresh = record + 1, 0, line[1:].strip(), True
                    continue
                bases = "".join(line.split())
                while size + len(bases) > piece:
                    room = piece - size
                    held.append(bases[:room])
                    size, bases = piece, bases[room:]
                    close()
                if bases:
                    held.append(bases)
                    size += len(bases)
            if len(out) * piece > 1 << 24:
                yield batch()
        if split:
            close()
        if out:
            yield batch()

    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    pieces = checkpointed(lines.mapInArrow(run, "file string, block long, record long, name string, offset long, seq string"))
    # of each split: how many records begin in it, and the last one's name and bases (or bases that go on from before)
    last = F.max_by(F.struct("name", (F.col("offset") + F.length("seq")).alias("bases")), F.struct("record", "offset"))
    splits = pieces.groupBy("file", "block").agg(F.max("record").alias("records"), last.alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.coalesce(F.sum("records").over(before), F.lit(0))
    splits = splits.withColumn("begun", begun).withColumn("went_on", F.last(F.when(F.col("records") > 0, F.col("last.name")), ignorenulls=True).over(before))
    # bases since the record began: of the split where it began, and of those after it
    same = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("run", F.sum((F.col("records") > 0).cast("int")).over(Window.partitionBy("file").orderBy("block")))
    known = splits.withColumn("upto", F.coalesce(F.sum("last.bases").over(same), F.lit(0)) + F.col("last.bases"))
    known = known.withColumn("reached", F.coalesce(F.lag("upto").over(Window.partitionBy("file").orderBy("block")), F.lit(0)))
    side = known.select("file", "block", "begun", "went_on", "reached")
    out = pieces.join(side, ["file", "block"])
    carried = F.col("record") == 0
    out = out.select("file", (F.col("begun") + F.col("record")).alias("record"), F.when(carried, F.col("went_on")).otherwise(F.col("name")).alias("name"), (F.col("offset") + F.when(carried, F.col("reached")).otherwise(0)).alias("offset"), "seq")
    return out.where("record > 0")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, seq: whole records, for those that fit a row."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "seq")))
    whole = fasta_pieces(spark, path).groupBy("file", "record", "name").agg(F.array_join(F.transform(parts, lambda x: x["seq"]), "").alias("seq"))
    return whole.select("name", "seq")


def parse_evidence(lines: DataFrame) -> DataFrame:
    """Evidence lines (line_no, value): a row of fewer than six tab-separated fields heads a scaffold, six fields are
    a fragment with its gap; '~' separates. Returns scaffold_id, ord, contig_id, len, n_gap, pos."""
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("~") & (F.trim("value") != "")).select("line_no", f.alias("f"))
    rows = rows.withColumn("head", (F.size("f") < 6).cast("int"))
    rows = running_sum(rows, "head", "line_no", "scaffold_id").where("head = 0").select("scaffold_id", "line_no", F.col("f")[0].cast("long").alias("contig_id"), F.col("f")[2].cast("long").alias("len"), F.col("f")[4].cast("long").alias("n_gap"))
    w = Window.partitionBy("scaffold_id").orderBy("line_no")
    before = F.coalesce(F.sum(F.col("len") + F.col("n_gap")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("pos", before).withColumn("ord", F.row_number().over(w) - 1).drop("line_no")


def parse_scaffold_log(lines: DataFrame) -> DataFrame:
    """Log lines (line_no, value): '>' heads a scaffold, 'contigN' or 'NewCtga+b' places fragments, 'N* gap' a gap. One row
    per fragment: scaffold_id (from 1), line_no, kind ('contig' or 'merged'), contig_id."""
    rows = lines.withColumn("head", F.col("value").startswith(">").cast("int"))
    kind = F.when(F.col("value").startswith("contig"), "contig").when(F.col("value").startswith("NewCtg"), "merged")
    rows = running_sum(rows, "head", "line_no", "scaffold_id").withColumn("kind", kind).where(F.col("kind").isNotNull())
    ids = F.explode(F.split(F.regexp_replace(F.trim("value"), "^(contig|NewCtg)", ""), "\\+"))
    return rows.select("scaffold_id", "line_no", "kind", ids.alias("id")).select("scaffold_id", "line_no", "kind", F.col("id").cast("long").alias("contig_id"))


def of_log(layout: DataFrame, log: DataFrame) -> DataFrame:
    """The layout's fragments that a scaffold log places, under the log's scaffolds (a broken scaffold has several there)."""
    return layout.join(log.select("contig_id", F.col("scaffold_id").alias("log_id")).distinct(), "contig_id").withColumn("scaffold_id", F.col("log_id")).select(layout.columns)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 1, in order of files and of places in them) and value of text files."""
    at = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    lines = spark.read.text(path).select(at[0].alias("file"), at[1].alias("block"), F.monotonically_increasing_id().alias("nth"), "value")
    return numbered(lines, "file", "block", "nth", name="line_no").select("line_no", "value")
