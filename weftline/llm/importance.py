"""Target-distribution importance resampling over hashed runs of words.

Every document is normalised to its words joined by one space and scanned once; the CRC of the text up to the end of each
word is kept. CRCs are linear over GF(2): crc(AB) = shift(crc(A), |B|) ^ crc(B), where shift appends |B| zero bytes. So the
CRC of any run of words follows from the two prefixes at its ends, without another look at its bytes. Runs fall into
buckets by their CRC; a bucket's gain is the log ratio of its shares in the target and in the documents, a document's
weight the sum of its runs' gains, and Gumbel noise from a hash of its id turns the highest scores into a weighted draw
without replacement.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.ordering import numbered

from .common import binary_text, cut, packed, quoted, table

#: Words in a run (1 to ORDERS), buckets, least words of a document that may be drawn, share drawn (percent), seed of the noise.
ORDERS, BUCKETS, LEAST_WORDS, PERCENT, SEED = 3, 10_000, 20, 5, 42
#: Words whose runs are worked on at a time, and bytes of a text that are split into words at a time.
WORDS, SLICE = 1 << 16, 1 << 20
#: A-Z to lower case; every ASCII byte but letters and digits separates words.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Shifts by fewer bytes than this have their own tables; longer ones add one table for each further bit of the length.
NEAR = 64


def byte_table() -> np.ndarray:
    """What one byte does to the CRC-32 register (reflected polynomial EDB88320)."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ np.where(t & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return t


STEP = byte_table()


def tables_of(columns: np.ndarray) -> np.ndarray:
    """Lookup tables (4 x 256) of the linear map whose images of the 32 single bits are given."""
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            has = (np.arange(256) >> bit) & 1 == 1
            out[byte, has] ^= columns[8 * byte + bit]
    return out


def apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The map with these tables on every element of x."""
    return tables[0][x & 255] ^ tables[1][(x >> 8) & 255] ^ tables[2][(x >> 16) & 255] ^ tables[3][x >> 24]


def shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables of the shifts by 0 .. NEAR - 1 bytes, and of those by NEAR, 2 NEAR, 4 NEAR, ... bytes up to a gigabyte."""
    unit = np.left_shift(np.uint32(1), np.arange(32, dtype=np.uint32))
    near, columns = [], unit
    for _ in range(NEAR):
        near.append(tables_of(columns))
        columns = STEP[columns & np.uint32(255)] ^ (columns >> np.uint32(8))
    far, reach = [], NEAR
    while reach <= 1 << 30:
        far.append(tables_of(columns))
        columns = apply(far[-1], columns)
        reach *= 2
    return np.array(near).reshape(-1), far


NEAR_TABLES, FAR_TABLES = shift_tables()


def shift(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRCs (conditioned, as zlib gives them) moved past `size` bytes: what they add to the CRC of a longer text."""
    at = (size & np.uint32(NEAR - 1)) * np.uint32(1024)
    t = NEAR_TABLES
    out = t[at + (crc & 255)] ^ t[at + 256 + ((crc >> 8) & 255)] ^ t[at + 512 + ((crc >> 16) & 255)] ^ t[at + 768 + (crc >> 24)]
    high = size // np.uint32(NEAR)
    if high.any():
        for bit, tables in enumerate(FAR_TABLES):
            on = np.flatnonzero((high >> np.uint32(bit)) & np.uint32(1))
            if len(on):
                out[on] = apply(tables, out[on])
    return out


def past_space(crc: np.ndarray) -> np.ndarray:
    """CRCs after one more space."""
    x = ~crc
    return ~(STEP[(x ^ np.uint32(32)) & np.uint32(255)] ^ (x >> np.uint32(8)))


def scan(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of a text's words, and the CRC of its normalised form up to the end of each."""
    plain = text.translate(FOLD)
    sizes, ends, crc, at = array("I"), array("I"), 0, 0
    while at < len(plain):
        stop = plain.find(b" ", at + SLICE)
        stop = len(plain) if stop < 0 else stop
        words = plain[at:stop].split()
        sizes.extend(map(len, words))
        push = ends.append
        for w in words:
            crc = crc32(w, crc)
            push(crc)
            crc = crc32(b" ", crc)
        at = stop
    return np.frombuffer(sizes, np.uint32), np.frombuffer(ends, np.uint32)


def runs(texts: list[bytes], orders: int = ORDERS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text's number, CRC) of every run of 1 to `orders` words of the texts, in arrays of bounded size."""
    held, n = [], 0
    for i, text in enumerate(texts):
        sizes, ends = scan(text)
        starts = np.zeros(len(ends), np.uint32)
        starts[1:] = past_space(ends[:-1])
        for low in range(0, len(sizes), WORDS):
            lead = min(orders - 1, low)  # words of the part before, whose runs end in this one
            part = slice(low - lead, low + WORDS)
            held.append((i, sizes[part], ends[part], starts[part], lead))
            n += len(sizes[part])
            if n >= WORDS:
                yield from _runs(held, orders)
                held, n = [], 0
    if held:
        yield from _runs(held, orders)


def _runs(held: list[tuple], orders: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    text = np.concatenate([np.full(len(s), i, np.int64) for i, s, _, _, _ in held])
    part = np.concatenate([np.full(len(s), k, np.int32) for k, (_, s, _, _, _) in enumerate(held)])
    new = np.concatenate([np.arange(len(s)) >= lead for _, s, _, _, lead in held])
    sizes, ends, starts = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3))
    moved = shift(starts, sizes)
    yield text[new], (ends ^ moved)[new]
    for k in range(1, orders):
        if len(sizes) <= k:
            return
        moved = shift(moved[: len(sizes) - k], sizes[k:] + np.uint32(1))
        whole = (part[k:] == part[:-k]) & new[k:]
        yield text[k:][whole], (ends[k:] ^ moved)[whole]


def bucket_counts(texts: DataFrame, text_col: str = "text", orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: runs of all the texts in each bucket. One pass; a task hands on one row a bucket, whatever it has read."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, crc in runs([t.as_py() for t in b.column(0)], orders):
                total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    return texts.select(binary_text(text_col).alias("t")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", orders: int = ORDERS, buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's gain: a thousand times the log of the smoothed share in the target over that in the documents, floored.
    At most one row a bucket comes to the driver; without any text all gains are 0."""
    both = bucket_counts(docs, text_col, orders, buckets).withColumnRenamed("n", "s").join(bucket_counts(target, target_col, orders, buckets).withColumnRenamed("n", "t"), "bucket", "full")
    rows = both.fillna(0, ["s", "t"]).collect()
    all_s, all_t = (float(sum(r[c] for r in rows) + buckets) for c in ("s", "t"))
    out = np.full(buckets, math.floor(1000 * math.log(all_s / all_t)), np.int64)
    for r in rows:
        out[r["bucket"]] = math.floor(1000 * math.log((r["t"] + 1.0) * all_s / ((r["s"] + 1.0) * all_t)))
    return out


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", orders: int = ORDERS) -> DataFrame:
    """doc_id, n_words, n_features, weight (sum of gains over all runs, repeats counted); one narrow pass."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, features = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            words = np.zeros(b.num_rows, np.int64)
            first = orders
            for text, crc in runs([t.as_py() for t in b.column(1)], orders):
                features += np.bincount(text, minlength=b.num_rows)
                g, at = gain[crc % np.uint32(len(gain))], np.flatnonzero(np.diff(text, prepend=-1))
                if len(at):
                    np.add.at(total, text[at], np.add.reduceat(g, at))
            # w words make w + (w - 1) + ... runs: the number of words follows from theirs
            for w in range(1, orders):
                words[features == w * (w + 1) // 2] = w
            many = features >= first * (first + 1) // 2
            words[many] = (features[many] + first * (first - 1) // 2) // first
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(features), pa.array(total)], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), binary_text(text_col).alias("t"))
    return rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(id_col: str, seed: int = SEED):
    """Gumbel noise in thousandths from the first 32 bits of sha256("<seed>:<id>"); a null id counts as the empty text."""
    own = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(own, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """Every document with its weight, score and, if it is drawn, its rank: doc_id, n_words, n_features, weight, score, rank.

    Of the documents with at least `least_words` words, the `percent` of them (rounded down) with the highest scores are
    drawn; ties go to the smaller id, a null id comes last. Null and empty texts, and texts without a word, have no
    features, weight 0 and no rank. Very long texts are split into words a megabyte at a time. Repeated rows are documents
    like any other: each counts and each can be drawn. Other columns are not read, whatever their names. Without documents
    there are no rows; without a target all shares of the target are equal. Two passes over the texts; what reaches the
    driver is one number a bucket.
    """
    gain = gains(docs, target, text_col, target_col, orders, buckets)
    scored = weights(docs, gain, id_col, text_col, orders).withColumn("score", F.col("weight") + noise("doc_id", seed))
    scored = cut(scored)
    may = F.col("n_words") >= least_words
    drawn = percent * scored.where(may).count() // 100
    placed = numbered(scored.where(may), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), name="rank")
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return placed.unionByName(scored.where(~may).withColumn("rank", F.lit(None).cast("long")))


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of docs that resample() draws, with all their columns. Rows that share an id are drawn together if one is."""
    ids = resample(docs, target, id_col, **how).where(F.col("rank").isNotNull()).select(F.col("doc_id").alias("__drawn")).distinct()
    rows = packed(docs, __id=F.col(quoted(id_col)).cast("long"))
    return rows.join(ids, F.col("__id").eqNullSafe(F.col("__drawn")), "left_semi").select("__row.*")


def op13_importance(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


#: The same in DuckDB: the CRC of every different run from its own bytes, one table step a byte.
SQL = r"""
WITH crc_table AS (
    SELECT list(c ORDER BY i) AS tab FROM (
        SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM range(256) r(i))),
words AS (
    SELECT 'd' AS side, doc_id, rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM (SELECT doc_id, text, row_number() OVER () AS rid FROM documents)
    UNION ALL
    SELECT 'b', NULL, NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
grams AS (
    SELECT side, doc_id, rid, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
    FROM words, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k),
counted AS (SELECT side, doc_id, rid, g, count(*) AS c FROM grams GROUP BY ALL),
bytes AS (
    SELECT g, list_transform(range(1, octet_length(encode(g)) + 1), lambda i: (strpos('0123456789ABCDEF', substr(h, 2 * i - 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(h, 2 * i, 1)) - 1) AS b
    FROM (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM counted))),
bucketed AS (
    SELECT g, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
    FROM bytes, crc_table),
per_bucket AS (
    SELECT bucket, coalesce(sum(c) FILTER (side = 'd'), 0) AS s, coalesce(sum(c) FILTER (side = 'b'), 0) AS t FROM counted JOIN bucketed USING (g) GROUP BY bucket),
gain AS (
    SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM per_bucket),
weight AS (SELECT rid, sum(c)::BIGINT AS n_features, sum(c * gain)::BIGINT AS weight FROM counted JOIN bucketed USING (g) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY rid),
scored AS (
    SELECT doc_id, len(w) >= 20 AS may, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM words LEFT JOIN weight USING (rid) WHERE side = 'd'),
placed AS (SELECT *, row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id NULLS LAST) AS n, count(*) OVER (PARTITION BY may) AS k FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN may AND n <= 5 * k // 100 THEN n END::BIGINT AS rank FROM placed
"""
