"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text: one on the windows of ordinary documents, one on the
telling windows of toxic ones (runs of byte 5-grams that are RATIO times as frequent in toxic documents as in
ordinary ones; the rest of a toxic document is ordinary text, which would drown them). A whole text is cut into
windows; each window is compressed with the ordinary dictionary alone and with the toxic one before it, and the
differences in length (their largest, sum, count and sum over the root of the windows) go through a logistic
calibration fitted on training documents that the dictionaries have not seen.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, labelled_sample, packed, quoted, remainder, table

#: Training rows taken of each class at most (about); half fit the dictionaries, half the calibration.
PER_CLASS = 2000
WINDOW, LEVEL, GRAM, BASE_BYTES, TOXIC_BYTES = 256, 16, 5, 4096, 8192
#: How much likelier a gram must be in toxic documents to be telling.
RATIO = 30.0
THRESHOLD = 0.7


def windows(text: bytes, size: int = WINDOW) -> list[bytes]:
    """Consecutive windows that cover the text, cut at spaces where there is one in the second half."""
    out, i, n = [], 0, len(text)
    while i < n:
        j = min(n, i + size)
        if j < n:
            k = text.rfind(b" ", i + size // 2, j)
            j = k if k > 0 else j
        out.append(text[i:j])
        i = j
    return out


def prepare(text: str | bytes | None) -> bytes:
    if text is None:
        return b""
    return (text if isinstance(text, str) else text.decode("utf-8", "replace")).lower().encode()


def grams(text: bytes) -> np.ndarray:
    a = np.frombuffer(text, np.uint8).astype(np.uint64)
    out = np.zeros(max(0, len(a) - GRAM + 1), np.uint64)
    for i in range(GRAM if len(out) else 0):
        out = out << np.uint64(8) | a[i : len(a) - GRAM + 1 + i]
    return out


def telling_windows(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Runs of grams (with at most a gram's length between them) that are RATIO times as frequent, by documents, in toxic
    texts as in ordinary ones, from every toxic text; grams of a single toxic text tell nothing."""

    def frequency(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate([np.unique(grams(t)) for t in texts] or [grams(b"")]), return_counts=True)

    own, n_own = frequency(toxic)
    other, n_other = frequency(ordinary)
    at = np.minimum(np.searchsorted(other, own), max(0, len(other) - 1))
    elsewhere = np.where(other[at] == own, n_other[at], 0) if len(other) else np.zeros(len(own))
    ratio = (n_own + 0.5) / (len(toxic) + 1) / ((elsewhere + 0.5) / (len(ordinary) + 1))
    telling = own[(ratio > RATIO) & (n_own > 1)]
    out = []
    for t in toxic:
        at = np.flatnonzero(np.isin(grams(t), telling))
        if len(at):
            breaks = np.flatnonzero(np.diff(at) > GRAM)
            out += [t[i : j + GRAM] for i, j in zip(at[np.r_[0, breaks + 1]].tolist(), at[np.r_[breaks, len(at) - 1]].tolist())]
    return out


def dictionary(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """A dictionary of `size` bytes trained by zstandard; all the samples where the trainer finds them too few."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)


class CompressionModel:
    """The two dictionaries' contents and the calibration; picklable, a few tens of kB."""

    def __init__(self, ordinary: bytes, toxic: bytes, weights: np.ndarray | None = None, mean=None, scale=None):
        self.ordinary, self.toxic, self.weights, self.mean, self.scale = ordinary, toxic, weights, mean, scale

    def compressors(self):
        p = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=WINDOW, dict_size=len(self.ordinary) + len(self.toxic), write_content_size=False, write_checksum=False, write_dict_id=False, min_match=4)
        return [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=p).compress for d in (self.ordinary, self.toxic + b"\n" + self.ordinary)]

    def features(self, text: bytes, pair) -> list[float]:
        plain, toxic = pair
        d = np.array([len(plain(w)) - len(toxic(w)) for w in windows(text)] or [0], np.float64)
        return [d.max(), d.sum(), d.sum() / np.sqrt(len(d)), float((d >= 3).sum()), np.log1p(len(d))]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression by Newton steps with a small ridge."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        w = np.zeros(z.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(w))
            w = w - np.linalg.solve(h, z.T @ (p - y) + 0.1 * w)
        self.weights = w

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(x))
        return 1 / (1 + np.exp(-np.clip(np.c_[(x - self.mean) / self.scale, np.ones(len(x))] @ self.weights, -30, 30)))


def train(rows: list[tuple[bytes, int]]) -> CompressionModel:
    """Fit on (text, label) rows. Without rows of both classes the model scores everything 0."""
    texts = [(prepare(t), y) for t, y in rows]
    part = [[], []]
    for y in (0, 1):
        own = [t for t, label in texts if label == y]
        part[0] += [(t, y) for t in own[::2]]
        part[1] += [(t, y) for t in own[1::2]]
    toxic, ordinary = ([t for t, label in part[0] if label == y] for y in (1, 0))
    if not toxic or not ordinary or len({y for _, y in part[1]}) < 2:
        return CompressionModel(b"", b"")
    base = dictionary([w for t in ordinary for w in windows(t)], BASE_BYTES, k=64, d=8)
    model = CompressionModel(base, dictionary(telling_windows(toxic, ordinary), TOXIC_BYTES, k=16, d=6))
    pair = model.compressors()
    model.calibrate(np.array([model.features(t, pair) for t, _ in part[1]]), np.array([y for _, y in part[1]], float))
    return model


@functools.lru_cache(maxsize=2)
def _loaded(blob: bytes):
    model = pickle.loads(blob)
    return model, model.compressors()


def score_texts(model: CompressionModel, texts: list) -> np.ndarray:
    m, pair = _loaded(pickle.dumps(model))
    return m.score(np.array([m.features(prepare(t), pair) for t in texts]).reshape(len(texts), -1))


def scores(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id", text_col: str = "text", rows: bool = False) -> DataFrame:
    """doc_id and score of each whole text, or with rows=True the packed rows (__row) and score."""
    blob = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, pair = _loaded(blob.value)
            x = np.array([m.features(prepare(t.as_py()), pair) for t in b.column(1)]).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.score(x), pa.float64())], names=[b.schema.names[0], "score"])
        give_back()

    text = F.col(quoted(text_col)).cast("string")
    given = packed(docs, t=text) if rows else docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), text.alias("t"))
    return given.mapInArrow(run, given.drop("t").withColumn("score", F.lit(0.0)).schema)


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; fitted on labels.toxic of the other rows.

    Only rows whose crc32(doc_id) mod 3 is not 1 are learnt from. Null and empty texts get the score of a
    text without windows; repeated rows get equal scores; other columns are not read. Without labels of both
    classes all scores are 0. Very long texts are scored over all their windows. An empty table gives no rows.
    """
    model = train(labelled_sample(docs, labels, "toxic", 3, 1, per_class))
    return scores(docs, model).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """The documents that are not predicted toxic, with their own columns, whatever these are named.

    Null and empty texts score like a text without windows; of repeated rows all stay or none; without labels of
    both classes all stay. An empty table gives no rows.
    """
    model = train(labelled_sample(docs, labels, "toxic", 3, 1, per_class))
    return scores(docs, model, rows=True).where(F.col("score") < THRESHOLD).select("__row.*")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
