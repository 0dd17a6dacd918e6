"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space bytes that the contracts name: space and \t to \r.
WHITE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; without one, a folder of its own on a single machine only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = sc.getConf().get("spark.checkpoint.dir")
        if not configured and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="weftline-checkpoint-"))


def quoted(name: str) -> str:
    """A column's name as F.col takes it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """All of docs in one struct, __row, beside the given columns: names inside cannot clash with those of a stage's
    own work, and select("__row.*") brings the rows back as they were."""
    return docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("__row"), *[c.alias(n) for n, c in columns.items()])


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and continue from there (survives lost executors). The files go once nothing
    on the driver refers to them any more, like shuffle files (see release)."""
    ensure_checkpoint_dir(df.sparkSession)
    df.sparkSession.sparkContext._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return df.checkpoint(eager=True)


def give_back() -> None:
    """Freed memory goes back to the system, at the end of a task's work in Python: workers live on, and what the allocators keep
    counts as the executor's memory in all later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def release(spark: SparkSession) -> None:
    """Let executors delete the shuffle files of steps that are cut off: Spark does so once the driver has collected
    the plans that refer to them, by default every half hour, so without this all steps' files add up."""
    gc.collect()
    give_back()
    spark.sparkContext._jvm.System.gc()


#: Rows of a batch that Spark hands to Python.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Hand texts to Python in batches of at most so many rows; Arrow's buffers lie outside the executor's heap."""
    if int(spark.conf.get(ARROW_ROWS)) > rows or int(spark.conf.get(ARROW_ROWS)) <= 0:
        spark.conf.set(ARROW_ROWS, str(rows))


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def py_remainder(value, modulus: int) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode()) % modulus


def squeeze(text: bytes) -> bytes:
    """Replace each run of ASCII white space by one space; leading and trailing runs stay as one space."""
    core = b" ".join(text.split())
    if not core:
        return b" " if text else b""
    return (b" " if text[0] in WHITE else b"") + core + (b" " if text[-1] in WHITE else b"")


def binary_text(text_col: str = "text") -> Column:
    """The text's UTF-8 bytes; null counts as the empty text."""
    return F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).cast("binary")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, per_class: int, text_col: str = "text", max_bytes: int = 48 << 20) -> list[tuple[bytes, int]]:
    """A bounded sample of labelled training rows for the driver: at most about per_class rows of each class.

    Only labels whose id's crc32 modulo `modulus` is not `held_out` are used. Rows are chosen by a hash of
    the id against a threshold computed from the class's count, so the choice is the same on every run and
    does not depend on row order. The chosen ids (at most 2.5 x per_class) are broadcast: a bounded table.
    A label row with a null id or null label is not used; of several label rows of one id the largest counts.
    Of several texts with one id, the smallest is taken. max_bytes bounds the texts that are kept and that reach the driver.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder("doc_id", modulus) != held_out))
    ids = ids.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("__y"))
    counts = {r["__y"]: r["n"] for r in ids.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    scale = F.create_map(*[x for y, n in counts.items() for x in (F.lit(y), F.lit(per_class / n))]) if counts else None
    if scale is None:
        return []
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = ids.where(unit < F.element_at(scale, F.col("__y"))).orderBy(F.xxhash64("doc_id")).limit(int(2.5 * per_class))
    picked = docs.select("doc_id", binary_text(text_col).alias("__t")).join(F.broadcast(chosen), "doc_id")
    picked = picked.groupBy("doc_id").agg(F.min("__t").alias("__t"), F.max("__y").alias("__y"))
    # sizes come first: texts reach the driver only once it is known that they fit
    sizes = picked.select("doc_id", F.length("__t").alias("size"), F.xxhash64("doc_id").alias("__o")).collect()
    order = {r["doc_id"]: (r["__o"], r["doc_id"]) for r in sizes}
    kept = fitting(sorted(((*order[r["doc_id"]], r["size"]) for r in sizes)), max_bytes)
    wanted = docs.sparkSession.createDataFrame([(i,) for _, i, _ in kept], picked.select("doc_id").schema)
    rows = picked.join(F.broadcast(wanted), "doc_id").collect()
    return [(bytes(r["__t"]), int(r["__y"])) for r in sorted(rows, key=lambda r: order[r["doc_id"]])]


def fitting(rows: list[tuple], max_bytes: int) -> list[tuple]:
    """Those of the rows, whose last entry is a size, that fit max_bytes, taken in order; one that does not fit is passed over."""
    out, used = [], 0
    for r in rows:
        if used + r[-1] <= max_bytes:
            used += r[-1]
            out.append(r)
    return out


def lookup(rows: DataFrame, key: str, side: DataFrame, side_key: str, weight: str, total: int, spread: Column, share: float = 1 / 200) -> DataFrame:
    """Left join of rows to side (one row per key, weight = rows with that key) without a hot partition.

    Keys with over `share` of all rows are joined by broadcast (fewer than 1/share of them can exist); their
    rows take a key of their own, made from `spread`, in the shuffled join for the rest. Null keys find nothing.
    """
    rest = [c for c in side.columns if c not in (side_key, weight)]
    cold = side.select(F.col(side_key).cast("string").alias("__ck"), *[F.col(c).alias(f"__c_{c}") for c in rest])
    hot = side.where(F.col(weight) > total * share).select(F.col(side_key).cast("string").alias("__hk"), *[F.col(c).alias(f"__h_{c}") for c in rest])
    own = F.col(key).cast("string")
    out = rows.join(F.broadcast(hot), own == F.col("__hk"), "left")
    out = out.withColumn("__k", F.when(F.col("__hk").isNull(), own).otherwise(F.concat(F.lit("#"), F.xxhash64(spread).cast("string"))))
    out = out.join(cold, F.col("__k") == F.col("__ck"), "left")
    for c in rest:
        out = out.withColumn(c, F.coalesce(f"__h_{c}", f"__c_{c}"))
    return out.drop("__k", "__hk", "__ck", *[f"__{s}_{c}" for s in "hc" for c in rest])
