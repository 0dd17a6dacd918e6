"""Exact deduplication by Grace hashing.

Texts are equal when they are identical after each run of ASCII white space became one space (null counts
as empty). Every map task first merges the equal texts it meets (so a text that a third of all rows share
reaches the shuffle once per task), the distinct texts are dealt out by 64 bits of their SHA-256, and each
bucket goes through `grace`: an open-addressing table that compares complete contents takes the records;
when it outgrows its memory the records are split to spill files by further hash bits, recursively, until
each file's distinct texts fit. Only (digest, smallest id, counts) leave the buckets; rows find their
class by digest, with the few classes that hold over 1/200 of all rows in a broadcast of at most 200 rows.
"""

from __future__ import annotations

import hashlib
import marshal
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_text, cut, lookup, packed, quoted, squeeze, table

#: Bytes of distinct text that one table holds before records go to spill files.
TABLE_BYTES = 64 << 20
FANOUT_BITS = 4

REPS = "sha binary, k long, id long, n long, n_min long, body binary"
CLASSES = "sha string, keep_id long, group_size long, n_min long"


class ContentTable:
    """Open addressing with linear probing; equality is decided on the complete content."""

    def __init__(self, slots: int = 1024):
        self.slot = np.full(slots, -1, np.int64)
        self.mask = slots - 1
        self.rows: list[list] = []
        self.bytes = 0

    def _grow(self) -> None:
        self.slot = np.full(2 * len(self.slot), -1, np.int64)
        self.mask = len(self.slot) - 1
        for at, row in enumerate(self.rows):
            i = row[1] & self.mask
            while self.slot[i] >= 0:
                i = (i + 1) & self.mask
            self.slot[i] = at

    def add(self, sha: bytes, k: int, doc_id, n: int, n_min: int, body: bytes) -> None:
        i, slot, mask = k & self.mask, self.slot, self.mask
        while (at := slot[i]) >= 0:
            row = self.rows[at]
            if row[1] == k and row[5] == body:
                row[3] += n
                if doc_id == row[2]:
                    row[4] += n_min
                elif row[2] is None or (doc_id is not None and doc_id < row[2]):
                    row[2], row[4] = doc_id, n_min
                return
            i = (i + 1) & mask
        slot[i] = len(self.rows)
        self.rows.append([sha, k, doc_id, n, n_min, body])
        self.bytes += len(body) + 200
        if 2 * len(self.rows) > len(slot):
            self._grow()


def grace(records: Iterable[tuple], limit: int = TABLE_BYTES, depth: int = 0) -> Iterator[list]:
    """Merge records (sha, k, id, n, n_min, body) of equal body; spill by hash bits when a table outgrows limit."""
    t = ContentTable()
    records = iter(records)
    for r in records:
        t.add(*r)
        if t.bytes > limit and len(t.rows) > 1 and (depth + 1) * FANOUT_BITS <= 60:
            break
    else:
        yield from t.rows
        return
    # the low bits address the slots, so the files are chosen by the high ones
    shift, fan = 64 - (depth + 1) * FANOUT_BITS, (1 << FANOUT_BITS) - 1
    files = [tempfile.TemporaryFile() for _ in range(fan + 1)]
    try:
        for row in t.rows:
            marshal.dump(tuple(row), files[(row[1] >> shift) & fan])
        del t
        for row in records:
            marshal.dump(tuple(row), files[(row[1] >> shift) & fan])
        for f in files:
            end = f.tell()
            f.seek(0)
            yield from grace(_spilled(f, end), limit, depth + 1)
            f.close()
    finally:
        for f in files:
            f.close()


def _spilled(f, end: int) -> Iterator[tuple]:
    while f.tell() < end:
        yield marshal.load(f)


def _rep_batch(rows: list[list]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 6
    signed = np.array(cols[1], np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.binary()), pa.array(signed, pa.int64()), *(pa.array(c, pa.int64()) for c in cols[2:5]), pa.array(cols[5], pa.binary())],
        names=["sha", "k", "id", "n", "n_min", "body"],
    )


def _chunks(rows: Iterable[list], size: int = 8 << 20) -> Iterator[list[list]]:
    out, held = [], 0
    for r in rows:
        out.append(r)
        held += len(r[5]) + 100
        if held > size:
            yield out
            out, held = [], 0
    if out:
        yield out


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge equal texts within one task before the shuffle; memory is bounded by one table."""
    t = ContentTable()
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
            body = squeeze(text.as_py())
            sha = hashlib.sha256(body).digest()
            t.add(sha, int.from_bytes(sha[:8], "big"), doc_id, 1, 1, body)
            if t.bytes > TABLE_BYTES // 2:
                yield from map(_rep_batch, _chunks(t.rows))
                t = ContentTable()
    yield from map(_rep_batch, _chunks(t.rows))


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records():
        for b in batches:
            k = b.column(1).to_numpy().view(np.uint64).tolist()
            ids, n, m = (b.column(i).to_pylist() for i in (2, 3, 4))
            for i, (sha, body) in enumerate(zip(b.column(0), b.column(5))):
                yield sha.as_py(), k[i], ids[i], n[i], m[i], body.as_py()

    out: list[tuple] = []
    for sha, _, doc_id, n, n_min, _ in grace(records()):
        out.append((sha.hex(), doc_id, n, n_min))
        if len(out) >= 20000:
            yield _class_batch(out)
            out = []
    if out:
        yield _class_batch(out)


def _class_batch(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), *(pa.array(x, pa.int64()) for x in c[1:])], names=["sha", "keep_id", "group_size", "n_min"])


def duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct text: sha (hex), keep_id, group_size, n_min (rows that carry keep_id)."""
    reps = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), binary_text(text_col).alias("t")).mapInArrow(_combine, REPS)
    return reps.repartition("k").mapInArrow(_bucket, CLASSES)


def decided(docs: DataFrame, id_col: str, text_col: str, rows: bool) -> DataFrame:
    """doc_id (and with rows=True the packed row, __row), sha, keep_id, group_size, n_min for every row."""
    classes = cut(duplicate_classes(docs, id_col, text_col).withColumn("n", F.col("group_size")))
    total = classes.agg(F.sum("n")).first()[0] or 0
    norm = F.regexp_replace(F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")
    own = {"doc_id": F.col(quoted(id_col)).cast("long"), "sha": F.sha2(norm.cast("binary"), 256)}
    given = packed(docs, **own) if rows else docs.select(*[c.alias(n) for n, c in own.items()])
    return lookup(given, "sha", classes, "sha", "n", total, F.col("doc_id"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Decide for every row whether it stays: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; a null id is larger than any other. Rows that repeat both id and text all count in
    group_size and are marked alike (deduplicate() leaves one of them). Very long texts are compared whole. Other columns are not read. An empty table
    gives an empty result.
    """
    rows = decided(docs, id_col, text_col, rows=False)
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with their own columns, whatever these are named; exactly one row per distinct text.

    Null text counts as empty and a null id is the largest; of rows that repeat the kept id with an equal text one
    stays. An empty table gives no rows.
    """
    rows = decided(docs, id_col, text_col, rows=True).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    single = rows.where("n_min = 1").select("__row")
    tied = rows.where("n_min > 1").dropDuplicates(["sha"]).select("__row")
    return single.unionByName(tied).select("__row.*")


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM d
"""
