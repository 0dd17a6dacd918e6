"""Language identification by words first, with back-off to shorter and shorter character n-grams.

A word that the training sample knows scores the logarithm of its frequency in each language; an unseen word
scores by its longest character n-grams that are known (five characters, then four, down to one). A text's
scores are sums over its words; the best language wins.
"""

from __future__ import annotations

import functools
import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_text, fitting, remainder, table

#: Bounds of the training sample: documents per language, documents in all, bytes in all. They bound the tables too: all its
#: words and n-grams are kept.
PER_LANG, SAMPLE_DOCS, SAMPLE_BYTES = 1000, 8000, 32 << 20
#: Languages that are learned, by rows.
MOST_LANGS = 1000
#: Longest n-gram; rows of unseen words that a scorer holds at a time; words of a text that count as independent evidence.
LONGEST, UNSEEN, EVIDENCE = 5, 150_000, 20
letters = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall


class BackoffModel:
    def __init__(self, rows: list[tuple[str, str]]):
        self.langs = sorted({lang for _, lang in rows})
        at = {lang: i for i, lang in enumerate(self.langs)}
        words = [Counter() for _ in self.langs]
        for text, lang in rows:
            words[at[lang]].update(letters(text.lower()))
        self.word = self.table(words)
        self.gram = {}
        for n in range(LONGEST, 0, -1):
            grams = [Counter() for _ in self.langs]
            for g, known in zip(grams, words):
                for w, c in known.items():
                    w = f" {w} "
                    for i in range(len(w) - n + 1):
                        g[w[i : i + n]] += c
            self.gram[n] = self.table(grams)

    def table(self, counts: list[Counter]) -> dict[str, np.ndarray]:
        """Log frequency per language of every entry."""
        total = Counter()
        for c in counts:
            total.update(c)
        kept = sorted(total)
        x = np.array([[c[w] for c in counts] for w in kept], float).reshape(len(kept), len(counts)) + 0.1
        x = np.log(x / (np.array([sum(c.values()) for c in counts]) + 0.1 * max(1, len(total))))
        return dict(zip(kept, x.astype(np.float32)))

    def unseen(self, w: str) -> np.ndarray:
        w = f" {w} "
        for n in range(min(LONGEST, len(w)), 0, -1):
            g = self.gram[n]
            hit = [g[w[i : i + n]] for i in range(len(w) - n + 1) if w[i : i + n] in g and (n > 1 or w[i] != " ")]
            if hit:
                return np.mean(hit, axis=0)
        return np.zeros(len(self.langs), np.float32)


class Scorer:
    """The model with one row per word met; rows of unseen words are dropped when there are too many."""

    def __init__(self, model: BackoffModel):
        self.m = model
        self.rows = np.zeros((len(model.word) + 2 * UNSEEN, len(model.langs)), np.float32)
        for i, v in enumerate(model.word.values()):
            self.rows[i] = v
        self.known = {w: i for i, w in enumerate(model.word)}
        self.at = dict(self.known)

    def score(self, text: str | None) -> tuple[str, float]:
        words = letters(text.lower()) if text else []
        langs = self.m.langs
        if not words or not langs:
            return "und", 0.0
        total, n = np.zeros(len(langs)), len(words)
        for i in range(0, n, UNSEEN):
            total += self._sum(words[i : i + UNSEEN])
        mean = total / n * min(n, EVIDENCE)  # the words of a text depend on each other; more add no certainty (nor change the choice)
        best = int(np.argmax(mean))
        p = np.exp(mean - mean[best])
        return langs[best], float(1 / p.sum())

    def _sum(self, words: list[str]) -> np.ndarray:
        try:
            at = list(map(self.at.__getitem__, words))
        except KeyError:
            new = {w for w in words if w not in self.at}
            if len(self.at) + len(new) > len(self.rows):
                self.at = dict(self.known)
                new = {w for w in words if w not in self.at}
            for w in new:
                self.rows[len(self.at)] = self.m.unseen(w)
                self.at[w] = len(self.at)
            at = list(map(self.at.__getitem__, words))
        return self.rows[at].sum(axis=0, dtype=np.float64)


@functools.lru_cache(maxsize=1)
def _scorer(blob: bytes) -> Scorer:
    return Scorer(pickle.loads(blob))


def training_sample(docs: DataFrame, modulus: int = 5, held_out: int = 0) -> list[tuple[str, str]]:
    """A bounded sample of (text, lang), chosen by a hash of the id against each language's count: of the MOST_LANGS languages
    with most rows, at most about 2 x SAMPLE_DOCS rows and SAMPLE_BYTES of text. Sizes reach the driver first, then the texts
    that fit; a very long text that does not is passed over. Repeated rows count as often as they fit."""
    rows = docs.where(F.col("lang").isNotNull() & (remainder("doc_id", modulus) != held_out))
    most = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGS)
    counts = {r["lang"]: r["n"] for r in most.collect()}
    if not counts:
        return []
    each = min(PER_LANG, SAMPLE_DOCS / len(counts))
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(each / n))])
    unit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.where(unit < F.try_element_at(share, F.col("lang"))).select("lang", binary_text().alias("__t"), F.xxhash64("doc_id", "text").alias("__o"))
    sizes = picked.select("__o", "lang", F.length("__t").alias("size")).orderBy("__o", "lang", "size").limit(2 * SAMPLE_DOCS).collect()
    kept = Counter((o, lang) for o, lang, _ in fitting([tuple(r) for r in sizes], SAMPLE_BYTES))
    wanted = docs.sparkSession.createDataFrame(list(kept), "__o long, lang string")
    # repeated rows come once
    texts = picked.join(F.broadcast(wanted), ["__o", "lang"]).groupBy("__o", "lang").agg(F.min("__t").alias("__t")).collect()
    out = []
    for r in sorted(texts, key=lambda r: (r["__o"], r["lang"])):
        out += [(bytes(r["__t"]).decode("utf-8", "replace"), r["lang"])] * kept[r["__o"], r["lang"]]
    return out


def language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every whole text.

    Learns from rows with a lang whose crc32(doc_id) mod 5 is not 0. Null texts and texts without letters (Unicode
    category L; numerals are none) are `und` with score 0; ties go to the first language in order; without training
    rows everything is `und`. Very long texts are scored by all their words. Repeated rows get equal rows; other columns are not read. An empty table gives no rows.
    """
    blob = docs.sparkSession.sparkContext.broadcast(pickle.dumps(BackoffModel(training_sample(docs))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _scorer(blob.value)
            got = [s.score(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return rows.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op8_langid(spark, sf_dir: str) -> DataFrame:
    return language(table(spark, sf_dir, "documents"))
