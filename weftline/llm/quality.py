"""Quality by a byte-level convolutional network in numpy.

Bytes are embedded, learned filters run over overlapping chunks that cover the whole document, each filter
is max-pooled per chunk, and the chunks' features are combined (mean and maximum over chunks) into one
probability. Training (Adam on a bounded sample) and scoring are numpy only.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_text, labelled_sample, remainder, table

#: Training rows taken of each class at most (about), and chunks of each of them (evenly spaced). Scoring reads every chunk.
PER_CLASS, TRAIN_CHUNKS = 1500, 8
CHUNK, STEP, WIDTH, STRIDE, EMBED, FILTERS = 256, 224, 8, 2, 6, 16
POSITIONS = (CHUNK - WIDTH) // STRIDE + 1
THRESHOLD = 0.7


def chunk_starts(n: int) -> np.ndarray:
    """Starts of overlapping chunks that cover n bytes; one chunk for a text that fits one, empty texts too."""
    if n <= CHUNK:
        return np.zeros(1, np.int64)
    return np.minimum(np.arange(0, n - CHUNK + STEP, STEP), n - CHUNK)


def chunked(texts: list[bytes], pick: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(chunks x CHUNK bytes, document of each chunk); pick: evenly spaced chunks of each text (in training)."""
    rows, owner = [], []
    for i, t in enumerate(texts):
        at = chunk_starts(len(t))
        if pick and len(at) > pick:
            at = at[np.linspace(0, len(at) - 1, pick).astype(int)]
        a = np.frombuffer(t, np.uint8)
        if len(a) < CHUNK:
            a = np.pad(a, (0, CHUNK - len(a)))
        rows.append(np.lib.stride_tricks.sliding_window_view(a, CHUNK)[at])
        owner.append(np.full(len(at), i))
    return np.concatenate(rows), np.concatenate(owner)


class ByteCnn:
    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        f32 = np.float32
        self.p = {
            "e": (r.normal(size=(256, EMBED)) * 0.5).astype(f32),
            "w": (r.normal(size=(WIDTH * EMBED, FILTERS)) / np.sqrt(WIDTH * EMBED)).astype(f32),
            "b": np.zeros(FILTERS, f32),
            "v": (r.normal(size=2 * FILTERS) * 0.1).astype(f32),
            "c": np.zeros(1, f32),
        }
        self.fitted = False

    def patches(self, x: np.ndarray) -> np.ndarray:
        emb = self.p["e"][x]
        s = emb.strides
        return np.lib.stride_tricks.as_strided(emb, (len(x), POSITIONS, WIDTH * EMBED), (s[0], s[1] * STRIDE, s[2]))

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """Filters' maxima per chunk, after the rectifier."""
        out = np.empty((len(x), FILTERS), np.float32)
        for i in range(0, len(x), 256):
            part = np.ascontiguousarray(self.patches(x[i : i + 256])).reshape(-1, WIDTH * EMBED) @ self.p["w"]
            out[i : i + 256] = part.reshape(-1, POSITIONS, FILTERS).max(axis=1)
        return np.maximum(out + self.p["b"], 0)

    @staticmethod
    def combine(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Mean and maximum over each document's chunks (owner is sorted and without gaps)."""
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        n = np.diff(np.r_[first, len(owner)])[:, None]
        return np.concatenate([np.add.reduceat(h, first, axis=0) / n, np.maximum.reduceat(h, first, axis=0)], axis=1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        if not self.fitted:
            return np.full(len(texts), 0.5)
        x, owner = chunked(texts)
        z = self.combine(self.pooled(x), owner) @ self.p["v"] + self.p["c"]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def fit(self, rows: list[tuple[bytes, int]], epochs: int = 6, batch: int = 48, pick: int = TRAIN_CHUNKS, seed: int = 11) -> None:
        """Adam on the log loss; classes weigh the same in a batch's draw but keep their share in the loss."""
        y = np.array([label for _, label in rows], np.float32)
        if len(set(y.tolist())) < 2:
            return
        r, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for epoch in range(epochs):
            order = r.permutation(len(rows))
            for at in range(0, len(order), batch):
                ids = order[at : at + batch]
                g = self.gradient([rows[i][0] for i in ids], y[ids], pick)
                step += 1
                rate = 0.01 * (0.5 ** (epoch / 2))
                for k, v in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * v
                    s[k] = 0.999 * s[k] + 0.001 * v * v
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        self.fitted = True

    def gradient(self, texts: list[bytes], y: np.ndarray, pick: int) -> dict[str, np.ndarray]:
        p = self.p
        x, owner = chunked(texts, pick)
        flat = np.ascontiguousarray(self.patches(x))
        a = (flat.reshape(-1, WIDTH * EMBED) @ p["w"]).reshape(len(x), POSITIONS, FILTERS)
        best = a.argmax(axis=1)
        top = np.take_along_axis(a, best[:, None, :], axis=1)[:, 0] + p["b"]
        h = np.maximum(top, 0)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        n = np.diff(np.r_[first, len(owner)])
        u = self.combine(h, owner)
        q = 1 / (1 + np.exp(-np.clip(u @ p["v"] + p["c"], -30, 30)))
        d = ((q - y) / len(y)).astype(np.float32)
        du = d[:, None] * p["v"][None]
        share = (h == u[owner, FILTERS:]).astype(np.float32)
        share /= np.maximum(np.add.reduceat(share, first, axis=0)[owner], 1)
        dh = (du[owner, :FILTERS] / n[owner, None] + du[owner, FILTERS:] * share) * (top > 0)
        picked = flat[np.arange(len(x))[:, None], best]  # chunks x filters x patch
        dpatch = (dh[:, :, None] * p["w"].T[None]).reshape(-1, EMBED)
        pos = best[:, :, None] * STRIDE + np.arange(WIDTH)
        bytes_ = x[np.arange(len(x))[:, None, None], pos].reshape(-1)
        de = np.stack([np.bincount(bytes_, dpatch[:, k], 256) for k in range(EMBED)], axis=1)
        return {"v": u.T @ d, "c": d.sum(keepdims=True), "b": dh.sum(axis=0), "w": np.einsum("cf,cfp->pf", dh, picked), "e": de.astype(np.float32)}


def train(rows: list[tuple[bytes, int]]) -> ByteCnn:
    model = ByteCnn()
    model.fit(rows)
    return model


@functools.lru_cache(maxsize=2)
def _loaded(blob: bytes) -> ByteCnn:
    return pickle.loads(blob)


def quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; fitted on labels.quality of the other rows.

    Only rows whose crc32(doc_id) mod 4 is not 2 are learnt from. Null texts score as empty ones (one chunk of
    padding); repeated rows get equal scores; other columns are not read. Without labels of both classes all scores
    are 0.5. Very long texts are scored over chunks that cover them whole. An empty table gives no rows.
    """
    model = train(labelled_sample(docs, labels, "quality", 4, 2, per_class))
    blob = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score, held, texts = [], 0, []
            for t in b.column(1):
                texts.append(t.as_py())
                held += len(texts[-1])
                if held > 1 << 20:
                    score.append(_loaded(blob.value).score(texts))
                    held, texts = 0, []
            score.append(_loaded(blob.value).score(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(score), pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), binary_text().alias("t")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
