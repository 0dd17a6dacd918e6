"""Byte-level BPE encoding and decoding by speculation and verification.

Words (the pre-tokens of the vocabulary's pattern) that the worker has not met are first cut by greedy
longest match. A tokenisation is the one that the merges give exactly when every token is what its own
bytes merge to and every adjacent pair of tokens is what the pair's bytes merge to; so one vectorised
lookup tests all adjacent pairs of a batch against the pairs already decided, pairs never met are decided
by merging the pair's bytes, and only words with a failing pair undergo exact merging.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, quoted, table

#: Pre-token pattern of the byte-level vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for Latin-1 texts without characters that the two regex libraries class differently; re takes half the time.
PLAIN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""
CACHE_WORDS = 200_000
KNOWN_PAIRS = 1_000_000


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: printable Latin-1 stands for itself, the rest for 256, 257, ..."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def odd_latin1() -> bytes:
    """The Latin-1 characters that PLAIN classes otherwise than PATTERN (found by asking both)."""
    tests = [(regex.compile(p), re.compile(q)) for p, q in ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s"), (r"[^\s\p{L}\p{N}]", r"[^\s\w]|_"))]
    return bytes(i for i in range(256) if any(bool(a.match(chr(i))) != bool(b.match(chr(i))) for a, b in tests))


class SpeculativeBpe:
    """Encoder and decoder for one vocabulary file of the tokenizers library's JSON form."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        sign = byte_alphabet()
        model = spec["model"]
        size = 1 + max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])
        self.token: list[bytes] = [b""] * size
        for text, i in model["vocab"].items():
            self.token[i] = bytes(sign[c] for c in text) if all(c in sign for c in text) else text.encode()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.special.items():
            self.token[i] = text.encode()
        ordinary = [i for text, i in model["vocab"].items() if text not in self.special]
        self.id = {self.token[i]: i for i in ordinary}
        self.byte_id = [self.id[bytes([b])] for b in range(256)]
        self.merge: dict[int, int] = {}  # pair (a << 32 | b) to rank
        self.born: list[int] = []  # rank to the token that the merge makes
        for rank, m in enumerate(model["merges"]):
            a, b = m if not isinstance(m, str) else m.split(" ")
            x, y = self.id[bytes(sign[c] for c in a)], self.id[bytes(sign[c] for c in b)]
            self.merge[x << 32 | y] = rank
            self.born.append(self.id[self.token[x] + self.token[y]])
        none = len(self.born)
        self.byte_rank = [self.merge.get(a << 32 | b, none) for a in self.byte_id for b in self.byte_id]
        #: the longest token that begins with these bytes: without an entry it has three bytes at most
        self.longest4: dict[bytes, int] = {}
        for t in self.id:
            if len(t) > 3:
                self.longest4[t[:4]] = max(self.longest4.get(t[:4], 0), len(t))
        self.alone = np.full(size, -1, np.int8)  # does the token's own text merge to it? -1: not asked yet
        self.known = np.zeros(0, np.int64)
        self.fits = np.zeros(0, bool)
        self.recent: dict[int, bool] = {}
        self.find_any, self.find_plain = regex.compile(PATTERN).findall, re.compile(PLAIN).findall
        self.odd = odd_latin1()
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.cache: dict[str, bytes] = {}
        self.exact_words = self.words = 0

    def exact(self, word: bytes) -> list[int]:
        """Merge by rank, leftmost first; a heap makes long words take n log n."""
        ids, merge = [self.byte_id[b] for b in word], self.merge
        if len(ids) <= 64:
            get, born, none, first = merge.get, self.born, len(self.born), self.byte_rank
            ranks = [first[a << 8 | b] for a, b in zip(word, word[1:])]
            while ranks and (rank := min(ranks)) < none:
                i = ranks.index(rank)
                ids[i] = born[rank]
                del ids[i + 1], ranks[i]
                if i:
                    ranks[i - 1] = get(ids[i - 1] << 32 | ids[i], none)
                if i < len(ranks):
                    ranks[i] = get(ids[i] << 32 | ids[i + 1], none)
            return ids
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merge.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = self.born[rank], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (m := merge.get(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (m, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def greedy(self, word: bytes) -> list[int]:
        out, i, n, get, longest = [], 0, len(word), self.id.get, self.longest4.get
        if (t := get(word)) is not None:
            return [t]
        while i < n:
            size = longest(word[i : i + 4], 3)
            while (t := get(word[i : i + size])) is None:
                size -= 1
            out.append(t)
            i = min(i + size, n)
        return out

    def _decide(self, keys: np.ndarray) -> np.ndarray:
        """Which of these distinct pairs (a << 32 | b) merge to themselves."""
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
            seen = self.known[at] == keys
            out = np.where(seen, self.fits[at], False)
        else:
            seen, out = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        recent, exact, token = self.recent, self.exact, self.token
        for at in np.flatnonzero(~seen).tolist():
            k = int(keys[at])
            ok = recent.get(k)
            if ok is None:
                a, b = k >> 32, k & 0xFFFFFFFF
                ok = recent[k] = exact(token[a] + token[b]) == [a, b]
            out[at] = ok
        if len(recent) > 8192:  # decided pairs move to the sorted arrays in batches
            if len(self.known) > KNOWN_PAIRS:
                self.known, self.fits = np.zeros(0, np.int64), np.zeros(0, bool)
            known = np.concatenate([self.known, np.fromiter(recent, np.int64, len(recent))])
            fits = np.concatenate([self.fits, np.fromiter(recent.values(), bool, len(recent))])
            order = np.argsort(known, kind="stable")
            self.known, self.fits = known[order], fits[order]
            recent.clear()
        return out

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        out = [self.greedy(w) for w in words]
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        if not len(sizes) or not sizes.sum():
            return out
        flat = np.fromiter((t for w in out for t in w), np.int64, int(sizes.sum()))
        word = np.repeat(np.arange(len(out)), sizes)
        used = np.unique(flat)
        for t in used[self.alone[used] < 0].tolist():
            self.alone[t] = self.exact(self.token[t]) == [t]
        bad = np.zeros(len(out), bool)
        bad[word[self.alone[flat] == 0]] = True
        inner = word[:-1] == word[1:]
        pairs, back = np.unique((flat[:-1] << 32 | flat[1:])[inner], return_inverse=True)
        bad[word[:-1][inner][~self._decide(pairs)[back]]] = True
        failing = np.flatnonzero(bad).tolist()
        for i in failing:
            out[i] = self.exact(words[i])
        self.words += len(words)
        self.exact_words += len(failing)
        return out

    def find(self, text: str) -> list[str]:
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return self.find_any(text)
        return self.find_plain(text) if len(raw.translate(None, self.odd)) == len(raw) else self.find_any(text)

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens; special tokens stand alone."""
        if self.split and any(s in text for s in self.special):
            out: list[str] = []
            for part in self.split(text):
                out += [part] if part in self.special else self.find(part)
            return out
        return self.find(text)

    def learn(self, lists: list[list[str]]) -> None:
        """Put the ids of all these words into the cache."""
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
            cache.update((s, np.uint32(i).tobytes()) for s, i in self.special.items())
        elif not cache:
            cache.update((s, np.uint32(i).tobytes()) for s, i in self.special.items())
        new: set[str] = set()
        for ws in lists:
            new.update(ws)
        words = [w for w in new if w not in cache]
        for w, ids in zip(words, self.encode_words([w.encode() for w in words])):
            cache[w] = pack(ids)

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, in chunks of bounded size."""
        for chunk in chunks(texts):
            lists = [self.pieces(t) for t in chunk]
            self.learn(lists)
            get = self.cache.__getitem__
            for ws in lists:
                yield b"".join(map(get, ws))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def pack(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def chunks(texts: list[str], size: int = 1 << 18) -> Iterator[list[str]]:
    out, held = [], 0
    for t in texts:
        out.append(t)
        held += len(t)
        if held > size:
            yield out
            out, held = [], 0
    if out:
        yield out


@functools.lru_cache(maxsize=2)
def codec(path: str) -> SpeculativeBpe:
    """One encoder per worker process and vocabulary."""
    return SpeculativeBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _texts(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit integers) of every whole text.

    Null text counts as empty (no ids); repeated rows give repeated rows; other columns are not read. An empty table
    gives no rows.
    """
    at = path or default_path()

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codec(at).encode_batch(_texts(b.column(1))), pa.binary())], names=["doc_id", "ids"])
        codec(at).cache.clear()  # a worker goes on to other work; the next task's words fill it again
        give_back()

    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids give null."""
    at = path or default_path()

    def run(batches):
        for b in batches:
            text = [None if x is None else codec(at).decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text in one pass and return digests of both; narrow, no shuffle.

    Null text counts as empty (no tokens); repeated rows give repeated rows; other columns are not read. An empty
    table gives no rows.
    """
    at = path or default_path()

    def run(batches):
        for b in batches:
            c, n, sha, back = codec(at), [], [], []
            for ids in c.encode_batch(_texts(b.column(1))):
                n.append(len(ids) // 4)
                sha.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
