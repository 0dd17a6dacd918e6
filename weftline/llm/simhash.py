"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint's 64 bits are cut into segments of 22, 21 and 21 bits. The perfect (23,12) Golay code has a
codeword within 3 bits of every 23-bit word, so two words at most 2 bits apart are both within 4 bits of the
codeword nearest to a word between them: a segment's keys are the indices of all codewords within 4 bits
(5.3 on average), and such words share one. Of at most 4 differing bits in three segments, either one
segment has none and another has two at most, or the three have 2, 1 and 1 at most. So the keys

* segment s exactly, with a codeword index of another segment t (6 choices of s and t), and
* a codeword index of segment t, with one exact half of each of the others (3 choices of t, 4 of halves)

bring every linked pair of fingerprints together, about 96 keys of 33 bits for a fingerprint. Pairs are
verified bit by bit, only a spanning set of each bucket's links leaves it, and components follow from those.
Only distinct fingerprints take part, so copies cost nothing.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.components import connected_components, dealt, narrowed

from .common import ARROW_ROWS, binary_text, cut, give_back, lookup, packed, quoted, release, small_batches, table

#: Generator polynomial of the (23,12) Golay code (fixed value).
GOLAY = 0b101011100011
SEGMENTS = ((0, 22), (22, 21), (43, 21))
MAX_BITS = 4


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles of the text with A-Z lowered; no words: 0."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    body = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(body, seed)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest, n = xxhash.xxh64_intdigest, len(tokens) - words + 1
    count = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        s, e = starts[at : min(at + (1 << 16), n)].tolist(), ends[at + words - 1 : min(at + (1 << 16), n) + words - 1].tolist()
        h = np.array([digest(body[i:j], seed) for i, j in zip(s, e)], "<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words, seed) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), binary_text(text_col).alias("t")).mapInArrow(run, "doc_id long, fp long")


@functools.cache
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the high 11 and low 12 bits; per syndrome the error patterns of weight <= 4, and their number."""

    def syndrome(x: int) -> int:
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= GOLAY << (bit - 11)
        return x

    unit = [syndrome(1 << i) for i in range(23)]
    low, high = (np.array([functools.reduce(lambda a, i: a ^ unit[i + at], (i for i in range(n) if x >> i & 1), 0) for x in range(1 << n)], np.int64) for at, n in ((0, 12), (12, 11)))
    lists: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            lists[functools.reduce(lambda a, i: a ^ unit[i], bits, 0)].append(sum(1 << i for i in bits))
    sizes = np.array([len(x) for x in lists], np.int64)
    patterns = np.zeros((2048, sizes.max()), np.int64)
    for i, x in enumerate(lists):
        patterns[i, : len(x)] = x
    return high, low, patterns, sizes


def codeword_indices(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) for every codeword within 4 bits of the 23-bit word x[row]."""
    high, low, patterns, sizes = golay_tables()
    s = high[x >> 12] ^ low[x & 4095]
    n = sizes[s]
    row = np.repeat(np.arange(len(x)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, (x[row] ^ patterns[s[row], nth]) >> 11


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for all keys of the unsigned 64-bit fingerprints; keys are exact packings, not hashes."""
    seg = [((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    half = [(x & 1023, x >> 10) for x in seg]
    rows, keys, kind = [], [], 0
    for t in range(3):
        row, index = codeword_indices(seg[t])
        others = [s for s in range(3) if s != t]
        for s in others:
            rows.append(row)
            keys.append(np.int64(kind) << 40 | seg[s][row] << 12 | index)
            kind += 1
        a, b = others
        for i in range(2):
            for j in range(2):
                rows.append(row)
                keys.append(np.int64(kind) << 40 | half[a][i][row] << 24 | half[b][j][row] << 12 | index)
                kind += 1
    return np.concatenate(rows), np.concatenate(keys)


def bucket_links(key: np.ndarray, fp: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, within each run of equal keys, what bits or fewer differing bits connect.

    Runs of up to 16 are compared position against position, all runs at once. In longer runs a pivot is
    compared with everything that is not yet in its component, so a tight group of near copies costs one
    comparison a member and a run never yields more links than members.
    """
    if len(key) < 2:
        return fp[:0], fp[:0]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    left, right = [], []
    small = np.repeat(size <= 16, size)
    for lag in range(1, min(16, int(size.max()))):
        ok = np.flatnonzero((key[lag:] == key[:-lag]) & small[lag:])
        if not len(ok):
            break
        ok = ok[np.bitwise_count(fp[ok] ^ fp[ok + lag]) <= bits]
        left.append(fp[ok])
        right.append(fp[ok + lag])
    for at, n in zip(first[size > 16].tolist(), size[size > 16].tolist()):
        run = fp[at : at + n]
        comp = np.arange(n)
        for i in range(n):
            other = np.flatnonzero(comp != comp[i])
            if not len(other):
                break
            other = other[np.bitwise_count(run[other] ^ run[i]) <= bits]
            fresh, pick = np.unique(comp[other], return_index=True)
            if len(fresh):
                left.append(np.full(len(pick), run[i]))
                right.append(run[other[pick]])
                comp[np.isin(comp, fresh)] = comp[i]
    if not left:
        return fp[:0], fp[:0]
    return np.concatenate(left), np.concatenate(right)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        all_fp = b.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(all_fp), 2000):
            fp = all_fp[at : at + 2000]
            row, key = fuzzy_keys(fp)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row].view(np.int64))], names=["key", "fp"])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def out(k, f):
        a, b = bucket_links(k, f.view(np.uint64))
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair[:, i])) for i in (0, 1)], names=["src", "dst"])

    for b in batches:
        if not b.num_rows:
            continue
        key, fp = np.concatenate([key, b.column(0).to_numpy()]), np.concatenate([fp, b.column(1).to_numpy()])
        if key[0] == key[-1]:
            continue
        end = int(np.searchsorted(key, key[-1]))  # the last run may go on in the next batch
        yield out(key[:end], fp[:end])
        key, fp = key[end:], fp[end:]
    yield out(key, fp)


def links(distinct: DataFrame) -> DataFrame:
    """(src, dst): links that connect what fingerprints within MAX_BITS connect; distinct has the column fp."""
    keyed = distinct.select("fp").mapInArrow(_keys, "key long, fp long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_links, "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) for every row.

    Texts with fewer words than a shingle are one shingle; null and wordless texts have fingerprint zero and
    are linked like any other. Null ids are larger than others (a component of null ids has a null id).
    Very long texts are hashed whole. Repeated rows get equal rows; other columns are not read. An empty table gives no rows.
    """
    rows = fingerprints(docs, id_col, text_col, words).select(F.col("doc_id").alias("__id"), F.col("fp").alias("__fp"))
    rows = cut(rows)
    distinct = cut(rows.groupBy("__fp").agg(F.min("__id").alias("first_id"), F.count("*").alias("n")).withColumnRenamed("__fp", "fp"))
    comp = connected_components(cut(links(distinct)))
    member = distinct.join(comp, F.col("fp") == F.col("node"), "left").withColumn("component", F.coalesce("component", "fp"))
    ids = cut(member.groupBy("component").agg(F.min("first_id").alias("__component_id"), F.count("*").alias("prints")))
    prints = distinct.count()
    side = cut(lookup(member.select("fp", "n", "component"), "component", ids, "component", "prints", prints, F.col("fp")).select("fp", "n", "__component_id"))
    total = side.agg(F.sum("n")).first()[0] or 0
    out = lookup(rows, "__fp", side, "fp", "n", total, F.col("__id"))
    return out.select(F.col("__id").alias("doc_id"), F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), F.col("__component_id").alias("component_id"))


# ---- the pipeline's stage: fingerprints, then similarity of five-word shingles -----------------------------------
#: Shingle length; similarity as a fraction; rows in a bucket from which all pairs are no longer listed at once; least 64-bit
#: words of a set's parity bits; bits of a filter of ids or shingles.
SHINGLE, SIMILAR, SMALL, PARITY, FILTER = 5, (4, 5), 16, 4, 1 << 24
#: Only shingles with hashes below this (40 %) are counted: the others come after the uncommon ones of these, of which a set has
#: enough as a rule. From how many documents on a shingle is common, and very common.
COUNTED, OFTEN = int(0.4 * 2**64), (SMALL, 512)
#: Rows of the stage's input for each file of its small tables.
FILE_ROWS = 50_000
#: Partners that a row of a long bucket lists in the first round, and how many times more in each further one; pairs that a task
#: looks at together (these bound its memory).
FEW, MORE, PAIRS_AT_ONCE = 4, 8, 200_000
_word_hash: dict[bytes, int] = {}


def _mix(h: np.ndarray, c: int) -> np.ndarray:
    h = (h ^ np.uint64(c)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def shingles(text: bytes) -> np.ndarray:
    """Sorted 64-bit hashes of all distinct five-word shingles (fewer words: the whole sequence); no words: empty."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    if len(_word_hash) > 300_000:
        _word_hash.clear()
    for w in tokens:
        if w not in _word_hash:
            _word_hash[w] = xxhash.xxh64_intdigest(w, 42)
    h = np.array(list(map(_word_hash.__getitem__, tokens)), np.uint64)
    n = max(1, len(h) - SHINGLE + 1)
    shingle = np.zeros(n, np.uint64)
    for i in range(min(SHINGLE, len(h))):
        shingle = _mix(shingle ^ h[i : i + n], i + 11)
    return np.unique(shingle)


def parity(h: np.ndarray) -> bytes:
    """Bits (a power of two, about one a shingle, at least 64 x PARITY) that each shingle on them flips: two sets differ in at
    least as many shingles as bits, also after folding."""
    size = max(64 * PARITY, 1 << (len(h) - 1).bit_length()) if len(h) else 64 * PARITY
    odd = np.bincount((h >> np.uint64(20) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


class ParityTable:
    """Parity bits of many sets, folded to every width in use, for comparing many pairs at once."""

    def __init__(self, bits: list[bytes], most: int = 64):
        full = [fold(np.frombuffer(x, "<u8"), most) for x in bits]
        self.width = np.array([len(x) for x in full], np.int64)
        self.at: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist() + [PARITY]:
            table = np.zeros((len(full), w), np.uint64)
            for i in np.flatnonzero(self.width >= w).tolist():
                table[i] = fold(full[i], w)
            self.at[w] = table

    def differ(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Bits in which the sets of each pair differ: in PARITY words, and where these leave it possible, in as many as both have."""
        out = np.bitwise_count(self.at[PARITY][x] ^ self.at[PARITY][y]).sum(axis=1, dtype=np.int64)
        width = np.minimum(self.width[x], self.width[y])
        left = (out <= most) & (width > PARITY)
        for w in np.unique(width[left]).tolist():
            pick = np.flatnonzero(left & (width == w))
            for i in range(0, len(pick), PAIRS_AT_ONCE // w):
                p = pick[i : i + PAIRS_AT_ONCE // w]
                out[p] = np.bitwise_count(self.at[w][x[p]] ^ self.at[w][y[p]]).sum(axis=1, dtype=np.int64)
        return out


def possible(a: bytes, b: bytes, x: int, y: int) -> bool:
    """False only if the parity bits of sets of x and y elements prove that they are not similar."""
    p, q = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    words = min(len(p), len(q))
    differ = int(np.bitwise_count(fold(p, words) ^ fold(q, words)).sum())
    return differ <= x + y - 2 * -(-SIMILAR[0] * (x + y) // sum(SIMILAR))


def alike_enough(common, x, y):
    """Whether sets of x and y elements with so many in common have a similarity of SIMILAR or more, in whole numbers."""
    return (SIMILAR[0] + SIMILAR[1]) * common >= SIMILAR[0] * (x + y)


def sizes_fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return SIMILAR[1] * np.minimum(x, y) >= SIMILAR[0] * np.maximum(x, y)


def reach(x: np.ndarray, p: np.ndarray, y: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether ordered sets of x and y elements whose first common one is the p-th and the q-th (from 0) can be similar. Of
    similar sets this holds at their first common shingle, and they meet in its bucket."""
    return (SIMILAR[0] + SIMILAR[1]) * np.minimum(x - p, y - q) >= SIMILAR[0] * (x + y)


def similar(a: bytes, b: bytes) -> bool:
    """The exact test on two whole shingle sets."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    both = np.sort(np.concatenate([x, y]))
    return bool(alike_enough(int((both[1:] == both[:-1]).sum()), len(x), len(y)))


def _bit(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte of a filter and the bit in it."""
    at = _mix(h, 7) & np.uint64(FILTER - 1)
    return (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)


def marked(h: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Whether the filter has h (and rarely so if it was not put in)."""
    byte, bit = _bit(h)
    return (seen[byte] & bit) > 0


def prefix(h: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first shingles of a set, in an order that all sets share, one of which every similar set has among its own first
    ones: the others are too few for the similarity. Counted shingles that are not common come first, then those not counted,
    then common and very common ones (filters, so some others too), each by hash."""
    n = len(h)
    counted = h[: np.searchsorted(h, np.uint64(COUNTED))]
    rank = np.ones(n, np.int8)
    rank[: len(counted)] = 0
    for k, seen in enumerate(often):
        rank[: len(counted)][marked(counted, seen)] = 2 + k
    h = h[np.argsort(rank, kind="stable")]
    return h[: n - -(-SIMILAR[0] * n // SIMILAR[1]) + 1] if n else h


def _runs(batches: Iterator[pa.RecordBatch], out) -> Iterator[pa.RecordBatch]:
    """out(table) for whole runs of the sorted first column."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        if held and held[-1].column(0)[-1].as_py() == key[-1]:
            held.append(b)  # one run goes on
            continue
        end = int(np.searchsorted(key, key[-1]))  # the last run may go on in the next batch
        yield from out(pa.Table.from_batches([*held, b.slice(0, end)]).combine_chunks())
        held = [b.slice(end)]
    if held:
        yield from out(pa.Table.from_batches(held).combine_chunks())
    give_back()


def _pairs(left: list, right: list) -> np.ndarray:
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, right))
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)


def _first_pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """All pairs of runs of up to SMALL rows; of longer ones some pairs, and the rows themselves (dst -1)."""
    key, rid, n, pos = (t.column(i).to_numpy() for i in range(4))
    if not len(key):
        return
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    small = np.repeat(size <= SMALL, size)
    left, right = [], []

    def add(i: np.ndarray, j: np.ndarray) -> None:
        ok = sizes_fit(n[i], n[j]) & reach(n[i], pos[i], n[j], pos[j])
        left.append(rid[i[ok]])
        right.append(rid[j[ok]])

    for lag in range(1, min(SMALL, int(size.max()))):
        at = np.flatnonzero((key[lag:] == key[:-lag]) & small[lag:])
        add(at, at + lag)
    for at, m in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist()):
        # another order in every run, so that a document meets other neighbours in each
        order = at + np.argsort(_mix(rid[at : at + m].view(np.uint64) ^ np.uint64(int(key[at]) & (2**63 - 1)), 5))
        add(order[:-1], order[1:])
        add(order[:-2], order[2:])
    pair, hot = _pairs(left, right), np.flatnonzero(~small)
    cols = np.concatenate([np.zeros(len(pair), np.int64), key[hot]]), np.concatenate([pair[:, 0], rid[hot]]), np.concatenate([pair[:, 1], np.full(len(hot), -1)]), np.concatenate([np.zeros(len(pair), np.int32), pos[hot]]).astype(np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "src", "dst", "pos"])


def _cross_pairs(few: int):
    """For each row of a run outside the run's largest component: of all rows that are in another component and that sizes, places
    and parity bits do not rule out, the `few` that differ from it in the fewest parity bits; dst -1 where there are more."""

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, rid, comp, n, pos = (t.column(i).to_numpy() for i in range(5))
        if not len(key):
            return
        bits = ParityTable([x.as_py() for x in t.column(5)])
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        left, right, more = [], [], []
        for at, end in zip(first.tolist(), [*first[1:].tolist(), len(key)]):
            ids, which, members = np.unique(comp[at:end], return_inverse=True, return_counts=True)
            if len(ids) < 2:
                continue
            turns = at + np.flatnonzero(which != members.argmax())
            every = slice(at, end)
            step = max(1, PAIRS_AT_ONCE // (end - at))
            for i in range(0, len(turns), step):
                own = turns[i : i + step]
                ok = (comp[own, None] != comp[None, every]) & sizes_fit(n[own, None], n[None, every]) & reach(n[own, None], pos[own, None], n[None, every], pos[None, every])
                x, y = np.nonzero(ok)
                total = n[own[x]] + n[at + y]
                most = total - 2 * -(-SIMILAR[0] * total // sum(SIMILAR))
                differ = bits.differ(own[x], at + y, most)
                ok = differ <= most
                x, y, differ = x[ok], y[ok], differ[ok]
                order = np.lexsort((rid[at + y], differ, x))
                x, y = x[order], y[order]
                start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, int)
                nth = np.arange(len(x)) - np.repeat(start, np.diff(np.r_[start, len(x)]))
                left.append(rid[own[x[nth < few]]])
                right.append(rid[at + y[nth < few]])
                more.append(rid[own[x[nth == few]]])
        pair, open_ = _pairs(left, right), np.unique(np.concatenate([np.zeros(0, np.int64), *more]))
        cols = np.concatenate([pair[:, 0], open_]), np.concatenate([pair[:, 1], np.full(len(open_), -1)])
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["src", "dst"])

    return run


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's filters of the first column, one for each level (second column)."""
    seen: dict[int, np.ndarray] = {}
    for b in batches:
        h, level = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
        for k in np.unique(level).tolist():
            byte, bit = _bit(h[level == k])
            np.bitwise_or.at(seen.setdefault(k, np.zeros(FILTER // 8, np.uint8)), byte, bit)
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array([x.tobytes() for x in seen.values()], pa.binary())], names=["level", "seen"])


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One filter for each level from those of several tasks."""
    seen: dict[int, np.ndarray] = {}
    for b in batches:
        for k, x in zip(b.column(0).to_pylist(), b.column(1)):
            seen.setdefault(k, np.zeros(FILTER // 8, np.uint8))
            seen[k] |= np.frombuffer(x.as_py(), np.uint8)
    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array([x.tobytes() for x in seen.values()], pa.binary())], names=["level", "seen"])


def filters(rows: DataFrame, n: int) -> np.ndarray:
    """n filters of FILTER bits of (h long, level int); six tasks unite those of all tasks, the driver theirs."""
    parts = rows.select("h", F.col("level").cast("int").alias("level")).mapInArrow(_marks, "level int, seen binary")
    out = np.zeros((n, FILTER // 8), np.uint8)
    for r in parts.repartition(6).mapInArrow(_united, "level int, seen binary").toLocalIterator():
        out[r["level"]] |= np.frombuffer(r["seen"], np.uint8)
    return out


def _common(rows: DataFrame) -> np.ndarray:
    """Filters of the counted shingles that are common and very common, over all documents. They only order the shingles:
    any choice gives the same result, a good one short buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.frombuffer(b"".join(b.column(0).to_pylist()), "<u8")
            yield pa.RecordBatch.from_arrays([pa.array(h[h < np.uint64(COUNTED)].view(np.int64))], names=["h"])

    counts = rows.select("s").mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > OFTEN[0])
    found = filters(counts.select("h", (F.col("n") > OFTEN[1]).cast("int").alias("level")), len(OFTEN))
    release(rows.sparkSession)
    return found


def _dealt(df: DataFrame, total: int) -> DataFrame:
    """df, written in files for total rows of input (see dealt)."""
    return cut(dealt(df, total, FILE_ROWS))


def print_pairs(rows: DataFrame, total: int) -> DataFrame:
    """Pairs (src < dst) of row numbers that span what fingerprints link: each row of a fingerprint with the first of it, and the
    first rows of two fingerprints within MAX_BITS (links). rows has rid and fp, total of them."""
    first = _dealt(rows.groupBy("fp").agg(F.min("rid").alias("first"), F.count("*").alias("m")), total)
    a, b = (first.select(F.col("fp").alias(c), F.col("first").alias(f"r_{c}")) for c in ("src", "dst"))
    near = links(first).join(a, "src").join(b, "dst").select(F.least("r_src", "r_dst").alias("src"), F.greatest("r_src", "r_dst").alias("dst"))
    same = lookup(rows.select("rid", "fp"), "fp", first.where("m > 1"), "fp", "m", total, F.col("rid")).where("first < rid")
    return near.unionByName(same.select(F.col("first").alias("src"), F.col("rid").alias("dst")))


def similar_pairs(rows: DataFrame, total: int) -> DataFrame:
    """Links (src, dst) that connect what pairs of similar sets connect; rows has rid, n, bits, s and fp
    (the whole set, its size, its parity bits and the text's fingerprint), total of them.

    Fingerprints within MAX_BITS give the first pairs (print_pairs). Fingerprints of similar sets can differ in more bits, so
    buckets follow for the rest: every similar pair shares a key (see prefix), so it meets in a bucket. Short buckets list all
    their pairs, long ones first some. Once those are decided and connected, each row of a long bucket lists the likeliest
    partners in other components, FEW in the first round and MORE times as many in each further one, until no row has a possible partner
    left that was not decided: rows that find their group at once never list the others. All links are decided on the
    whole sets.
    """
    spark = rows.sparkSession
    common = spark.sparkContext.broadcast(_common(rows))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                sets = [np.frombuffer(x, "<u8") for x in b.column(1).slice(at, 500).to_pylist()]
                found = [prefix(h, common.value) for h in sets]
                many, n = np.array([len(x) for x in found], np.int64), np.array([len(x) for x in sets], np.int64)
                key = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
                rid = np.repeat(b.column(0).slice(at, 500).to_numpy(), many)
                pos = np.arange(len(key)) - np.repeat(np.cumsum(many) - many, many)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(rid), pa.array(np.repeat(n, many).astype(np.int32)), pa.array(pos.astype(np.int32))], names=["key", "rid", "n", "pos"])

    @F.pandas_udf("boolean")
    def may(a: pd.Series, b: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([possible(*v) for v in zip(a, b, x.tolist(), y.tolist())], dtype=bool)

    @F.pandas_udf("boolean")
    def same(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([similar(p, q) for p, q in zip(x, y)], dtype=bool)

    def decided(pairs: DataFrame, ruled_out: bool = False) -> DataFrame:
        """The similar ones of pairs; ruled_out: those whose parity bits exclude it are not among them."""
        if not ruled_out:
            a, b = (rows.select(F.col("rid").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"b_{c}")) for c in ("src", "dst"))
            pairs = _dealt(pairs.join(a, "src").join(b, "dst").where(may("b_src", "b_dst", "n_src", "n_dst")).select("src", "dst"), total)
            release(spark)
        if not (n := pairs.count()):
            return pairs.select("src", "dst")
        pairs = narrowed(pairs, n)
        # only sets that take part are dealt out: a filter of fixed size, whose false hits cost a row each
        wanted = spark.sparkContext.broadcast(filters(pairs.select(F.explode(F.array("src", "dst")).alias("h"), F.lit(0).alias("level")), 1)[0])

        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(marked(b.column(0).to_numpy().view(np.uint64), wanted.value)))

        used = cut(rows.select("rid", "s").mapInArrow(chosen, "rid long, s binary").coalesce(max(24, -(-total // FILE_ROWS))))
        a, b = (used.select(F.col("rid").alias(c), F.col("s").alias(f"s_{c}")) for c in ("src", "dst"))
        out = _dealt(pairs.join(a, "src").join(b, "dst").where(same("s_src", "s_dst")).select("src", "dst"), total)
        release(spark)
        return out

    linked = _dealt(print_pairs(rows.where("n > 0").select("rid", "fp"), total).distinct(), total)
    release(spark)
    keyed = rows.select("rid", "s").mapInArrow(keys, "key long, rid long, n int, pos int")
    met = _dealt(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: _runs(b, _first_pairs), "key long, src long, dst long, pos int").distinct(), total)
    release(spark)
    tried = _dealt(linked.unionByName(met.where("dst >= 0").select("src", "dst")).distinct(), total)
    found = decided(tried)
    hot = met.where("dst < 0").select("key", F.col("src").alias("rid"), "pos")
    if hot.isEmpty():
        return found
    hot = narrowed(hot, hot.count())
    side = _dealt(rows.select("rid", "n", "bits").join(hot.select("rid").distinct(), "rid"), total)
    few, new, comp = FEW, found, None
    while True:
        # what is connected already counts as links to the component's smallest number
        edges = new if comp is None else new.unionByName(comp.select(F.col("node").alias("src"), F.col("component").alias("dst")))
        comp = connected_components(edges, rows=total)
        release(spark)
        now = side.join(comp, F.col("rid") == F.col("node"), "left").select("rid", F.coalesce("component", "rid").alias("component"), "n", "bits")
        crowd = hot.join(_dealt(now, total), "rid").select("key", "rid", "component", "n", "pos", "bits")
        listed = _dealt(crowd.repartition("key").sortWithinPartitions("key").mapInArrow(lambda b, f=_cross_pairs(few): _runs(b, f), "src long, dst long").distinct(), total)
        release(spark)
        fresh = _dealt(listed.where("dst >= 0").join(tried, ["src", "dst"], "left_anti"), total)
        new = decided(fresh, ruled_out=True)
        found = found.unionByName(new)
        if listed.where("dst < 0").isEmpty():
            return found
        tried, few = tried.unionByName(fresh), few * MORE


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with their own columns: of each group of near duplicates the smallest id.

    Near duplicates have a similarity (Jaccard, all distinct five-word shingles) of SIMILAR or more. SimHash (the fingerprints,
    keys and links of near_duplicates) names the first pairs, a join on shingles those that fingerprints miss, and all are decided
    on the whole sets (similar_pairs); groups are connected components. Null and wordless texts are equal to each other. Null ids
    count as largest; of repeated rows one stays. Very long texts are compared by all their shingles. Columns may have any name.
    An empty table gives no rows.
    """

    spark = docs.sparkSession
    before = spark.conf.get(ARROW_ROWS)
    small_batches(spark, 1000)  # sets travel to Python and back; only the join with the documents is left for later
    try:
        member = _members(docs, id_col, text_col)
    finally:
        spark.conf.set(ARROW_ROWS, before)
    # rows in no link are in no component and stay; rows that repeat id and text are in one with each other
    fate = member.groupBy(F.col("id").alias("its"), F.col("k").alias("own")).agg(F.max("stays").alias("stays"), F.count("*").alias("n"))
    out = packed(docs, **_own(id_col, text_col)).join(fate, F.col("id").eqNullSafe(F.col("its")) & F.col("k").eqNullSafe(F.col("own")), "left")
    out = out.where("stays is null or stays")
    once = out.where("n is null or n = 1").select("__row")
    return once.unionByName(out.where("n > 1").dropDuplicates(["its", "own"]).select("__row")).select("__row.*")


def _own(id_col: str, text_col: str) -> dict[str, Column]:
    return {"id": F.col(quoted(id_col)).cast("long"), "k": F.xxhash64(F.col(quoted(text_col)).cast("string"))}


def _members(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, k (a hash of the text) and whether it stays, of every row that is in a component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py()) for t in b.column(2)]
            fp = np.array([fingerprint(t.as_py()) for t in b.column(2)], np.uint64).view(np.int64)
            cols = pa.array([len(h) for h in sets], pa.int64()), pa.array([parity(h) for h in sets], pa.binary()), pa.array([h.tobytes() for h in sets], pa.binary()), pa.array(fp)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["id", "k", "n", "bits", "s", "fp"])
        _word_hash.clear()  # a worker goes on to other work
        give_back()

    spark = docs.sparkSession
    rows = docs.select(*[c.alias(n) for n, c in _own(id_col, text_col).items()], binary_text(text_col).alias("t"))
    release(spark)
    rows = cut(rows.mapInArrow(run, "id long, k long, n long, bits binary, s binary, fp long").withColumn("rid", F.monotonically_increasing_id()))
    release(spark)
    ids = rows.select("id", "k", "rid", (F.col("n") == 0).alias("empty"))
    total = ids.count()
    comp = connected_components(similar_pairs(rows.select("rid", "n", "bits", "s", "fp"), total), rows=total)
    member = ids.where("not empty").join(comp, F.col("rid") == F.col("node")).select("id", "k", "rid", "component")
    member = _dealt(member.unionByName(ids.where("empty").select("id", "k", "rid", F.lit(-1).cast("long").alias("component"))), total)
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("rid"))
    first = _dealt(member.groupBy("component").agg(F.min(order).alias("o"), F.count("*").alias("n")).select("component", "n", F.col("o.rid").alias("first")), total)
    member = lookup(member, "component", first, "component", "n", first.agg(F.sum("n")).first()[0] or 0, F.col("rid"))
    member = _dealt(member.select("id", "k", (F.col("rid") == F.col("first")).alias("stays")), total)
    release(spark)
    return member


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
