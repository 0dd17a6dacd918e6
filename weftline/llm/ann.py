"""Approximate nearest neighbours by additive quantisation.

Vectors are coded as sums of full-dimensional codewords, one from each of several codebooks. Codebooks are
trained on a bounded sample (residual k-means, then alternating least squares over all codebooks together
with beam-search codes). Every distinct vector is encoded by beam search and keeps its code, the squared norm of
its reconstruction and the distance to it. Rows are dealt out by the range of their first codeword, so that a
task holds few cells. A query scores codes with one table of inner products per codebook (|x|^2 - 2 sum <q, c>)
and ranks exactly, on the original vectors, whatever the score and the distance to the reconstruction leave in
reach of its best: there is no number of candidates after which the rest is dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lookup, quoted, table

#: Training sample (vectors, at most about), codebooks, codewords in each, beam.
SAMPLE, BOOKS, WORDS, BEAM = 10_000, 16, 256, 4
#: A vector's error is nearly orthogonal to its way to the query: the cosine between them is taken to be at most MARGIN over
#: the root of the dimensions (so many standard deviations of a random direction). None: at most 1, which is always true.
MARGIN = 4.0
#: Queries in one broadcast block (BLOCK x dimensions x 8 bytes: the bound of what is broadcast), and scored at a time.
BLOCK, QUERIES = 1 << 16, 512
#: Pairs of vectors compared exactly at a time.
PAIRS = 1 << 16


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = (c * c).sum(1) - 2 * x @ c.T
        a = near.argmin(1)
        n = np.bincount(a, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, a, x)
        c[n > 0] = s[n > 0] / n[n > 0, None]
        if (n == 0).any():
            c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


class AdditiveQuantizer:
    def __init__(self, dims: int, books: int = BOOKS, words: int = WORDS, seed: int = 3):
        self.dims, self.books, self.words = dims, books, words
        self.c = np.zeros((books, words, dims), np.float32)
        self.rng = np.random.default_rng(seed)

    def fit(self, x: np.ndarray, rounds: int = 2) -> "AdditiveQuantizer":
        x = x.astype(np.float32)
        rest = x.copy()
        for m in range(self.books):
            self.c[m] = kmeans(rest, self.words, self.rng)
            rest -= self.c[m][((self.c[m] ** 2).sum(1) - 2 * rest @ self.c[m].T).argmin(1)]
        for _ in range(rounds):
            codes = self.encode(x)
            # least squares for all codewords at once: B'B C = B'x with B the 0/1 code matrix
            at = codes.astype(np.int64) + np.arange(self.books) * self.words
            n = self.books * self.words
            gram = np.zeros((n, n), np.float32)
            for i in range(self.books):
                for j in range(self.books):
                    pair = np.bincount(codes[:, i].astype(np.int64) * self.words + codes[:, j], minlength=self.words**2)
                    gram[i * self.words : (i + 1) * self.words, j * self.words : (j + 1) * self.words] = pair.reshape(self.words, self.words)
            right = np.zeros((n, self.dims), np.float32)
            for i in range(self.books):
                np.add.at(right, at[:, i], x)
            gram[np.diag_indices(n)] += 0.1
            self.c = np.linalg.solve(gram, right).astype(np.float32).reshape(self.c.shape)
        return self

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Beam search over the codebooks: the `beam` best partial sums go on to the next codebook."""
        out = np.empty((len(x), self.books), np.uint8)
        norm = (self.c**2).sum(2)
        for at in range(0, len(x), 512):
            part = x[at : at + 512].astype(np.float32)
            n = len(part)
            rest, codes, cost = part[:, None, :], np.zeros((n, 1, 0), np.uint8), (part**2).sum(1)[:, None]
            for m in range(self.books):
                d = cost[:, :, None] + norm[m] - 2 * rest @ self.c[m].T
                flat = d.reshape(n, -1)
                b = min(beam, flat.shape[1])
                best = np.argpartition(flat, b - 1, axis=1)[:, :b]
                from_, word = best // self.words, best % self.words
                cost = np.take_along_axis(flat, best, 1)
                rest = np.take_along_axis(rest, from_[:, :, None], 1) - self.c[m][word]
                codes = np.concatenate([np.take_along_axis(codes, from_[:, :, None], 1), word[:, :, None].astype(np.uint8)], axis=2)
            out[at : at + 512] = codes[np.arange(n), cost.argmin(1)]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.c[m][codes[:, m]] for m in range(self.books))

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, books, words): -2 <q, c>."""
        return -2 * np.einsum("qd,mwd->qmw", q.astype(np.float32), self.c)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance of each row of a to the same row of b, also where squares over- or underflow."""
    gap = a - b
    with np.errstate(over="ignore", under="ignore"):
        out = np.sqrt((gap * gap).sum(axis=1))
        most = np.abs(gap).max(axis=1, initial=0.0)
        odd = np.flatnonzero((most > 0) & ((out > 1e150) | (out < 1e-150)))
        if len(odd):
            out[odd] = most[odd] * np.sqrt(((gap[odd] / most[odd, None]) ** 2).sum(axis=1))
    return out


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """Rows that take part (id and vector present, all components finite, not all zero) and their dimension.

    If lengths differ, the commonest counts (the smaller of a tie) and the others take no part.
    """
    v = vectors.select(F.col(quoted(id_col)).cast("long").alias("vec_id"), F.col(quoted(vec_col)).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    v = v.where((F.size("v") > 0) & ok)
    top = v.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    dims = top["d"] if top else 0
    return v.where(F.size("v") == dims), dims


class Search:
    """One task's search of its vectors for a block of queries: the `k` nearest distinct vectors of each query.

    `within` bounds the k-th smallest distance from above (from the training sample, then from what was found). A cell
    (rows with one first codeword) is passed over for queries to which all of it is farther away, a row where its score
    and error put it farther away. All lengths are divided by `scale`, a power of two, so that no square overflows.
    """

    def __init__(self, aq: AdditiveQuantizer, queries: np.ndarray, within: np.ndarray, k: int, scale: float, margin: float | None):
        self.aq, self.q, self.k, self.scale = aq, queries, k, scale
        self.cosine = 1.0 if margin is None else min(1.0, margin / math.sqrt(aq.dims))
        self.within = within.copy()
        self.small = queries / scale
        self.norm = (self.small**2).sum(axis=1)
        self.tables = aq.tables(self.small)
        c0 = aq.c[0].astype(np.float64)
        self.to_cell = np.sqrt(np.maximum(0.0, self.norm[:, None] - 2 * self.small @ c0.T + (c0**2).sum(axis=1)))
        self.found = np.zeros(0, [("q", "i8"), ("d", "f8"), ("id", "i8"), ("at", "i8")])
        self.compared = 0

    def add(self, x: np.ndarray, codes: np.ndarray, norm: np.ndarray, error: np.ndarray, first_id: np.ndarray, at: np.ndarray) -> None:
        """Rows sorted by cell (their first codeword); at: numbers by which `found` names them."""
        cell = codes[:, 0]
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(cell)]):
            word = int(cell[i])
            c0 = self.aq.c[0][word].astype(np.float64)
            radius = float(np.sqrt(((x[i:j] / self.scale - c0) ** 2).sum(axis=1)).max())
            near = np.flatnonzero(self.to_cell[:, word] - radius <= self.within + 1e-5 * (1 + self.to_cell[:, word] + radius))
            for b in range(0, len(near), QUERIES):
                self._cell(near[b : b + QUERIES], x[i:j], codes[i:j], norm[i:j], error[i:j], first_id[i:j], at[i:j])

    def _cell(self, own, x, codes, norm, error, first_id, at) -> None:
        for lo in range(0, len(x), 4096):
            part = slice(lo, lo + 4096)
            square = np.tile(norm[part].astype(np.float32), (len(own), 1))
            for m in range(self.aq.books):
                square += self.tables[own, m][:, codes[part, m]]
            square = np.maximum(square + self.norm[own, None], 0)
            # float32 tables: what rounding can take from a small difference of large squares
            slack = 1e-5 * (self.norm[own, None] + norm[None, part] + error[None, part] ** 2)
            within, err = self.within[own, None], error[None, part]
            row, col = np.nonzero(square <= within * within + err * err + 2 * self.cosine * within * err + slack)
            for p in range(0, len(row), PAIRS):
                qs, xs = own[row[p : p + PAIRS]], lo + col[p : p + PAIRS]
                d = distances(self.q[qs], x[xs])
                ok = np.flatnonzero(d / self.scale <= self.within[qs])
                self.compared += len(qs)
                self._keep(qs[ok], d[ok], first_id[xs[ok]], at[xs[ok]])

    def _keep(self, q, d, first_id, at) -> None:
        new = np.zeros(len(q), self.found.dtype)
        new["q"], new["d"], new["id"], new["at"] = q, d, first_id, at
        f = np.concatenate([self.found, new])
        f = f[np.lexsort((f["id"], f["d"], f["q"]))]
        start = np.flatnonzero(np.r_[True, f["q"][1:] != f["q"][:-1]]) if len(f) else np.zeros(0, int)
        nth = np.arange(len(f)) - np.repeat(start, np.diff(np.r_[start, len(f)]))
        last = np.flatnonzero(nth == self.k - 1)
        self.within[f["q"][last]] = np.minimum(self.within[f["q"][last]], f["d"][last] / self.scale)
        self.found = f[nth < self.k]


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, margin: float | None = MARGIN, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest, queries being the rows whose id is divisible by `every`.

    Distances are Euclidean on the original vectors in double precision, ties go to the smaller vec_id, a row is
    not its own neighbour; with fewer candidates than k all are returned. Rows that repeat an id are rows of their
    own, as candidates and as queries. Null, zero and non-finite vectors, rows without an id and vectors of another
    length than the commonest take no part. Other columns are not read. An empty table gives no rows.

    Equal vectors are searched once: one row stands for them, with the k + 1 smallest ids among them.
    """
    spark = vectors.sparkSession
    v, dims = usable(vectors, id_col, vec_col)
    result = "query_id long, rank int, vec_id long, score double"
    if not dims:
        return spark.createDataFrame([], result)
    v = cut(v.withColumn("rid", F.monotonically_increasing_id()))
    few = Window.partitionBy("v").orderBy("vec_id", "rid")
    kept = v.withColumn("nth", F.row_number().over(few)).where(F.col("nth") <= k + 1)  # cut in every task before the shuffle
    reps = kept.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("vec_id", "rid"))).alias("ids"))
    reps = cut(reps.select("v", F.col("ids.vec_id").alias("ids"), F.col("ids.rid").alias("rids")))
    total, most = reps.agg(F.count("*"), F.max(F.array_max(F.transform("v", F.abs)))).first()
    scale = 2.0 ** math.frexp(most)[1]
    x = np.zeros((0, dims))
    share = SAMPLE / total
    while not len(x):  # a few rows can all miss a small share
        picked = reps.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, share))).limit(2 * SAMPLE).select("v").toPandas()
        x, share = (np.stack(picked["v"].to_numpy()).astype(np.float64) if len(picked) else x), 4 * share
    model = AdditiveQuantizer(dims, words=min(WORDS, max(2, len(x) // 8))).fit(x / scale)
    aq, sample = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(x / scale)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = matrix(b.column(0), dims) / scale
            codes = aq.value.encode(y)
            back = aq.value.decode(codes).astype(np.float64)
            cols = pa.array(codes[:, 0].astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array((back**2).sum(axis=1)), pa.array(np.sqrt(((y - back) ** 2).sum(axis=1)))
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=["v", "ids", "rids", "cell", "code", "norm", "error"])

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The (k+1)-th smallest distance to the sample: no larger than that to all vectors."""
        s = sample.value
        square = (s**2).sum(axis=1)
        for b in batches:
            q, within = matrix(b.column(1), dims) / scale, np.full(b.num_rows, 1e100)
            for at in range(0, len(q) if len(s) > k else 0, QUERIES):
                part = q[at : at + QUERIES]
                own = (part**2).sum(axis=1)
                d = own[:, None] + square - 2 * part @ s.T + 1e-9 * (own[:, None] + square)
                within[at : at + QUERIES] = np.sqrt(np.maximum(0, np.partition(d, k, axis=1)[:, k])) * (1 + 1e-9) + 1e-12
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(within)], names=["qkey", "v", "within"])

    coded = reps.mapInArrow(encode, "v array<double>, ids array<long>, rids array<long>, cell int, code binary, norm double, error double")
    # ranges of cells; the hash divides a cell that holds much of the table
    coded = cut(coded.withColumn("h", F.xxhash64("v")).repartitionByRange("cell", "h").sortWithinPartitions("cell").drop("h"))
    asked = v.where(F.col("vec_id") % every == 0)
    distinct = asked.groupBy("v").agg(F.count("*").alias("n")).withColumn("qkey", F.monotonically_increasing_id())
    distinct = cut(distinct)
    n_queries = distinct.count()
    if not n_queries:
        return spark.createDataFrame([], result)
    blocks = math.ceil(n_queries / BLOCK)
    asks = cut(distinct.select("qkey", "v").mapInArrow(bounds, "qkey long, v array<double>, within double"))
    hits = None
    for i in range(blocks):
        own = asks.where(F.pmod(F.xxhash64("qkey"), F.lit(blocks)) == i).toPandas()
        if len(own):
            block = spark.sparkContext.broadcast((own["qkey"].to_numpy(np.int64), np.stack(own["v"].to_numpy()).astype(np.float64), own["within"].to_numpy(np.float64)))
            piece = cut(_search(coded, block, aq, k + 1, scale, margin))
            hits = piece if hits is None else hits.unionByName(piece)
    best = hits.withColumn("nth", F.row_number().over(Window.partitionBy("qkey").orderBy("score", "vec_id", "rid"))).where(F.col("nth") <= k + 1)
    best = best.groupBy("qkey").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id", "rid"))).alias("hits"))
    best = cut(best.join(distinct.select("qkey", "n"), "qkey"))
    rows = asked.join(distinct.select("v", "qkey"), "v").select("vec_id", "rid", "qkey")
    rows = lookup(rows, "qkey", best, "qkey", "n", rows.count(), F.col("rid")).where("hits is not null")
    others = F.slice(F.filter("hits", lambda h: h["rid"] != F.col("rid")), 1, k)
    out = rows.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("pos", "h"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("h.vec_id").alias("vec_id"), F.col("h.score").alias("score"))


def _search(coded: DataFrame, block, aq, k: int, scale: float, margin: float | None) -> DataFrame:
    """Each task's k nearest rows of every query of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, q, within = block.value
        search, lists = Search(aq.value, q, within, k, scale, margin), {}
        for n, b in enumerate(batches):
            codes = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(-1, aq.value.books)
            ids = b.column("ids")
            first = ids.flatten().to_numpy()[np.asarray(ids.offsets)[:-1] - ids.offsets[0].as_py()] if len(ids) else np.zeros(0, np.int64)
            at = np.arange(b.num_rows) + (n << 32)
            search.add(matrix(b.column("v"), len(q[0])), codes, b.column("norm").to_numpy(), b.column("error").to_numpy(), first, at)
            used = set(search.found["at"].tolist())
            lists = {i: x for i, x in lists.items() if i in used}
            for i in used - lists.keys():
                lists[i] = b.column("ids")[i & 0xFFFFFFFF].as_py(), b.column("rids")[i & 0xFFFFFFFF].as_py()
        rows = [(qi, vec_id, rid, d) for qi, d, _, i in search.found.tolist() for vec_id, rid in zip(*lists[i])]
        r = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(keys[np.array(r[0], np.int64)]), pa.array(r[1], pa.int64()), pa.array(r[2], pa.int64()), pa.array(r[3], pa.float64())], names=["qkey", "vec_id", "rid", "score"])

    return coded.mapInArrow(run, "qkey long, vec_id long, rid long, score double")


def op6_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
