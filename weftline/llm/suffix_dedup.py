"""Removal of repeated byte strings by partitioned suffix sorting.

Every LENGTH-byte window of a document has an anchor: the leftmost smallest hash of its 24-byte heads, which
its content alone decides. Consecutive windows with one anchor form a run (about 1 in 40 bytes begins one),
and equal windows sit at equal offsets in runs with equal anchors. So only the suffixes at anchors are sorted:

1. Runs are keyed by (the suffix's leading bytes as a number, a hash of the anchor's whole head, a hash of the whole
   run's content, document, start). Splitters sampled from the corpus range-partition them, a bucket sorts its keys by
   multikey quicksort and compares neighbours, and the first key of a bucket is compared with the last one of the bucket
   before. A run whose content has been seen is a repeat as a whole. The splitters contain document and start, so
   copies of one content, however many, are divided between buckets. A head that only one content has is dropped here.
2. Runs that are the first of their content, while others share the anchor (the ends of repeats), look at
   their documents again: for four ranges of offsets the bytes that all windows of the range share (81) are
   hashed (128 bits), with the 19 bytes on either side. Windows of runs that share those bytes are compared exactly in
   the bytes on either side, earliest first, in buckets by that hash. The windows of heads that over HOT_ROWS such runs
   share go one by one through a second partitioned sort instead, so that no bucket grows with a passage's copies.
3. The spans found are brought to their documents, merged and cut out.

Equal hashes stand for equal content: of n runs with one head, two different contents meet in 64 bits with a
probability below n^2 / 2^65. Keys, spans and runs travel as packed arrays (34 bytes a run), texts twice by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ARROW_ROWS, binary_text, cut, quoted, release, small_batches, table

LENGTH, HEAD = 100, 24
SPAN = LENGTH - HEAD + 1  # heads in a window
ZONE = 19  # offsets 0-18, 19-37, 38-56, 57-76
PIECE = 1 << 19
SAMPLE_DOCS, SAMPLE_KEYS = 400, 60_000
FLUSH = 1 << 18
#: Windows of heads that more runs than this share go through a second partitioned sort, window by window. The list of such
#: heads, sent to all tasks, is shorter than the runs divided by this.
HOT_ROWS = 200_000
#: Text for which there is one partition at least.
PART_BYTES = 64 << 20

RUN = np.dtype([("k", "<u8"), ("r", "<u4"), ("c", "<u8"), ("did", "<i8"), ("lo", "<i4"), ("n", "u1"), ("oa", "u1")])
KEY = ("k", "r", "c", "did", "lo")
HEADS = np.dtype([("k", "<u8"), ("r", "<u4"), ("n", "<i8")])
SPANS = np.dtype([("did", "<i8"), ("lo", "<i4"), ("hi", "<i4")])
EDGE = np.dtype([("z1", "<u8"), ("z2", "<u8"), ("did", "<i8"), ("a", "<i4"), ("z", "u1"), ("olo", "u1"), ("ohi", "u1"), ("side", "u1", 2 * ZONE)])


def head_hashes(a: np.ndarray) -> np.ndarray:
    n = len(a)
    word = np.zeros(n - 7, np.uint64)
    for i in range(8):
        word |= a[i : n - 7 + i].astype(np.uint64) << np.uint64(8 * i)
    m = n - HEAD + 1
    h = np.full(m, 0x51ED270B, np.uint64)
    for i in range(0, HEAD, 8):
        h = (h ^ word[i : i + m]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def runs(text: bytes, did: int) -> np.ndarray:
    """The document's runs: windows lo..lo+n share the anchor at lo+n+oa."""
    if len(text) < LENGTH:
        return np.zeros(0, RUN)
    whole, parts = np.frombuffer(text, np.uint8), []
    for at in range(0, len(text) - LENGTH + 1, PIECE):
        a = whole[at : at + PIECE + LENGTH - 1]
        h = head_hashes(a)
        low = np.uint64((1 << 20) - 1)
        x, size = h & ~low | np.arange(len(h), dtype=np.uint64), 1
        while 2 * size <= SPAN:
            x, size = np.minimum(x[:-size], x[size:]), 2 * size
        if size < SPAN:
            x = np.minimum(x[: len(x) - (SPAN - size)], x[SPAN - size :])
        anchor = (x & low).astype(np.int64)
        lo = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        hi = np.r_[lo[1:], len(anchor)] - 1
        out = np.zeros(len(lo), RUN)
        at_head = anchor[lo]
        lead = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(a, 8)[at_head]).view(">u8")[:, 0]
        out["k"], out["r"], out["did"], out["lo"], out["n"], out["oa"] = lead, h[at_head].astype(np.uint32), did, lo + at, hi - lo, at_head - hi
        digest = xxhash.xxh3_64_intdigest
        out["c"] = np.array([digest(text[i:j]) for i, j in zip((lo + at).tolist(), (hi + at + LENGTH).tolist())], np.uint64)
        parts.append(out)
    return np.concatenate(parts)


def multikey_quicksort(columns: list[np.ndarray]) -> np.ndarray:
    """Order of rows by several words: partition by the first word around a pivot into less, equal and greater,
    go on with the next word inside equal; segments that fit the cache are finished by one sort of their words left."""
    order = np.arange(len(columns[0]))
    stack = [(0, len(order), 0)]
    while stack:
        lo, hi, word = stack.pop()
        if hi - lo < 2 or word == len(columns):
            continue
        part = order[lo:hi]
        v = columns[word][part]
        if hi - lo > 1 << 16:
            pivot = np.sort(v[:: max(1, len(v) // 63)])[len(v[:: max(1, len(v) // 63)]) // 2]
            less, equal = v < pivot, v == pivot
            more = ~(less | equal)
            n, e = int(less.sum()), int(equal.sum())
            order[lo:hi] = np.concatenate([part[less], part[equal], part[more]])
            stack += [(lo, lo + n, word), (lo + n, lo + n + e, word + 1), (lo + n + e, hi, word)]
            continue
        order[lo:hi] = part[np.lexsort([c[part] for c in columns[: word - 1 if word else None : -1]])]
    return order


def _deal(did: np.ndarray, parts: int) -> np.ndarray:
    """Partition of each document: Fibonacci hashing of its number."""
    return ((did.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(parts)).astype(np.int32)


def packets(kind: int, to: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """Rows (kind, to, did, payload) with the packed rows for each partition."""
    order = np.argsort(to, kind="stable")
    to, rows = to[order], rows[order]
    first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, int)
    ends = np.r_[first[1:], len(to)] if len(to) else first
    blobs = [rows[i:j].tobytes() for i, j in zip(first.tolist(), ends.tolist())]
    n = len(blobs)
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array(to[first].tolist(), pa.int32()), pa.array([None] * n, pa.int64()), pa.array([None] * n, pa.int64()), pa.array(blobs, pa.binary())], names=["kind", "part", "did", "doc_id", "payload"])


PACKET = "kind int, part int, did long, doc_id long, payload binary"


def route(rows: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """Number of splitters at or below each key."""
    at = np.searchsorted(splitters["k"], rows["k"], "left")
    tied = np.flatnonzero(np.isin(rows["k"], splitters["k"]))
    tied = tied[np.argsort(rows["k"][tied], kind="stable")]
    ks = rows["k"][tied]
    for s in splitters if len(tied) else ():
        same = tied[np.searchsorted(ks, s["k"], "left") : np.searchsorted(ks, s["k"], "right")]
        if len(same):
            over, equal = np.zeros(len(same), bool), np.ones(len(same), bool)
            for c in KEY[1:]:
                over |= equal & (rows[c][same] > s[c])
                equal &= rows[c][same] == s[c]
            at[same] += over | equal
    return at.astype(np.int32)


def in_order(rows: np.ndarray) -> np.ndarray:
    return rows[multikey_quicksort([rows[c] for c in KEY])]


def _runs(splitters: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            for did, text in zip(b.column(0).to_pylist(), b.column(1)):
                r = runs(text.as_py(), did)
                held.append(r)
                n += len(r)
                if n > FLUSH:
                    rows = np.concatenate(held)
                    yield packets(0, route(rows, splitters), rows)
                    held, n = [], 0
        if n:
            rows = np.concatenate(held)
            yield packets(0, route(rows, splitters), rows)

    return run


def compare_neighbours(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(repeated, shared) of sorted rows: content seen before in the bucket; head that several contents have.

    The first and last head of a bucket count as shared, as they may go on in the bucket before or behind.
    """
    k, r, c = rows["k"], rows["r"], rows["c"]
    new_k = np.r_[True, (k[1:] != k[:-1]) | (r[1:] != r[:-1])]
    new_c = new_k | np.r_[True, c[1:] != c[:-1]]
    group = np.cumsum(new_k) - 1
    contents = np.bincount(group, new_c)
    shared = contents[group] > 1
    shared |= (group == 0) | (group == group[-1])
    return ~new_c, shared


def heads_of(rows: np.ndarray, least: int) -> np.ndarray:
    """Heads of sorted rows with how many rows have them: those with `least` or more, the first and the last."""
    if not len(rows):
        return np.zeros(0, HEADS)
    at = np.flatnonzero(np.r_[True, (rows["k"][1:] != rows["k"][:-1]) | (rows["r"][1:] != rows["r"][:-1])])
    out = np.zeros(len(at), HEADS)
    out["k"], out["r"], out["n"] = rows["k"][at], rows["r"][at], np.diff(np.r_[at, len(rows)])
    keep = out["n"] >= least
    keep[[0, -1]] = True
    return out[keep]


def _bucket(parts: int, hot_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = {}
        for b in batches:
            for part, x in zip(b.column(1).to_pylist(), b.column(4).to_pylist()):
                blobs.setdefault(part, []).append(x)
        for part, xs in blobs.items():
            rows = in_order(np.frombuffer(b"".join(xs), RUN))
            repeated, shared = compare_neighbours(rows)
            yield packets(2, np.full(1, part, np.int32), np.array([rows[[0, -1]].tobytes()], dtype=f"V{2 * RUN.itemsize}"))
            spans = spans_of(rows[repeated])
            yield packets(0, _deal(spans["did"], parts), spans)
            firsts = rows[~repeated & shared]
            firsts = firsts[~((firsts["did"] == rows["did"][0]) & (firsts["lo"] == rows["lo"][0]))]  # the bucket's first row is decided at its boundary
            heads = heads_of(firsts, hot_rows)
            yield packets(4, np.full(len(heads), part, np.int32), heads)
            yield packets(1, _deal(firsts["did"], parts), firsts)

    return run


def spans_of(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), SPANS)
    out["did"], out["lo"], out["hi"] = rows["did"], rows["lo"], rows["lo"] + rows["n"] + LENGTH
    return out


def boundaries(ends: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Compare each bucket's first row with the last row before it: (repeats, firsts). One row per bucket."""
    repeats, firsts, last = [], [], None
    for _, two in sorted(ends, key=lambda x: x[0]):
        same = last is not None and all(last[c] == two[0][c] for c in ("k", "r", "c"))
        (repeats if same else firsts).append(two[0])
        last = two[1]
    return np.array(repeats, RUN), np.array(firsts, RUN)


def edges(text: bytes, rows: np.ndarray) -> np.ndarray:
    """The run's windows by ranges of offsets, with the shared bytes' hash and the bytes on either side."""
    out, digest = [], xxhash.xxh3_128_intdigest
    for r in rows:
        lo, n, oa = int(r["lo"]), int(r["n"]), int(r["oa"])
        a, olo, ohi = lo + n + oa, oa, oa + n
        for z in range(4):
            o1, o2 = max(olo, ZONE * z), min(ohi, ZONE * z + (ZONE - 1 if z < 3 else ZONE))
            if o1 > o2:
                continue
            i, j = a - ZONE * z, a - ZONE * z + LENGTH - ZONE  # in every window of the range, whose first starts at i - ZONE
            d = digest(text[i:j], seed=z)
            left, right = text[max(0, i - ZONE) : i].rjust(ZONE, b"\0"), text[j : j + ZONE].ljust(ZONE, b"\0")
            out.append((d >> 64, d & (1 << 64) - 1, int(r["did"]), a, z, o1 - ZONE * z, o2 - ZONE * z, np.frombuffer(left + right, np.uint8)))
    return np.array(out, EDGE)


def _with_documents(use):
    """Packets of a partition first (kind below 9), then its documents one by one through use(did, doc_id, text, rows)."""

    def run(batches: Iterator[pa.RecordBatch], dtype: np.dtype):
        blobs, rows = [], None
        for b in batches:
            for kind, did, doc_id, payload in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4)):
                if kind < 9:
                    blobs.append(payload.as_py())
                    continue
                if rows is None:
                    rows = np.frombuffer(b"".join(blobs), dtype)
                    rows = rows[multikey_quicksort([rows["did"], rows["lo"]])] if len(rows) else rows
                    blobs = []
                i, j = np.searchsorted(rows["did"], [did, did + 1])
                yield from use(did, doc_id, payload.as_py(), rows[i:j])

    return run


def _edges(parts: int, hot: np.ndarray):
    """Packets of kind 0: edges by their shared bytes; of kind 3: the windows of hot heads."""

    def use(did, doc_id, text, rows):
        if len(rows):
            common = np.isin(rows["k"] ^ rows["r"], hot)
            yield 0, edges(text, rows[~common])
            if common.any():
                yield 3, single_windows(edges(text, rows[common]))

    def run(batches):
        held, n = {0: [], 3: []}, {0: 0, 3: 0}

        def out(kind):
            rows = np.concatenate(held[kind])
            held[kind], n[kind] = [], 0
            return packets(kind, (rows["z1"] % np.uint64(parts)).astype(np.int32) if kind == 0 else np.zeros(len(rows), np.int32), rows)

        for kind, e in _with_documents(use)(batches, RUN):
            held[kind].append(e)
            n[kind] += len(e)
            if n[kind] > FLUSH // 2:
                yield out(kind)
        for kind in held:
            if n[kind]:
                yield out(kind)

    return run


def compare_windows(rows: np.ndarray) -> np.ndarray:
    """Spans of windows whose content occurs at an earlier row (by document and place) of the same shared bytes."""
    rows = rows[multikey_quicksort([rows["z1"], rows["z2"], rows["did"], rows["a"]])]
    new = np.r_[True, (rows["z1"][1:] != rows["z1"][:-1]) | (rows["z2"][1:] != rows["z2"][:-1])]
    group = np.cumsum(new) - 1
    many = np.bincount(group)[group] > 1
    rows, group = rows[many], group[many]
    if not len(rows):
        return np.zeros(0, SPANS)
    side = np.pad(rows["side"], ((0, 0), (0, 5)))
    out = []
    for i in range(ZONE + 1):
        ok = np.flatnonzero((rows["olo"] <= i) & (rows["ohi"] >= i))
        if not len(ok):
            continue
        word = np.ascontiguousarray(np.pad(side[ok, ZONE - i : 2 * ZONE - i], ((0, 0), (0, 24 - ZONE)))).view("<u8")
        order = multikey_quicksort([group[ok].astype(np.uint64), word[:, 0], word[:, 1], word[:, 2], np.arange(len(ok))])
        g, w = group[ok][order], word[order]
        again = order[np.r_[False, (g[1:] == g[:-1]) & (w[1:] == w[:-1]).all(axis=1)]]
        hit = rows[ok[again]]
        s = np.zeros(len(hit), SPANS)
        s["did"], s["lo"] = hit["did"], hit["a"] - ZONE * hit["z"].astype(np.int32) - i
        s["hi"] = s["lo"] + LENGTH
        out.append(s)
    return merged(np.concatenate(out)) if out else np.zeros(0, SPANS)


def single_windows(rows: np.ndarray) -> np.ndarray:
    """Every window of these rows as a run of its own, keyed by its content: the shared bytes' hash and its own bytes."""
    out = []
    for i in range(ZONE + 1):
        r = rows[(rows["olo"] <= i) & (rows["ohi"] >= i)]
        w = np.zeros(len(r), RUN)
        word = np.ascontiguousarray(np.pad(r["side"][:, ZONE - i : 2 * ZONE - i], ((0, 0), (0, 24 - ZONE)))).view("<u8").reshape(len(r), 3)
        h = r["z2"] ^ np.uint64(i)
        for j in range(3):
            h = (h ^ word[:, j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        w["k"], w["c"], w["did"], w["lo"] = r["z1"], h, r["did"], r["a"] - ZONE * r["z"].astype(np.int32) - i
        out.append(w)
    return np.concatenate(out)


def merged(spans: np.ndarray) -> np.ndarray:
    """Union of the spans of each document, sorted; touching spans become one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["lo"], spans["did"]))]
    did, lo, hi = spans["did"], spans["lo"].astype(np.int64), spans["hi"].astype(np.int64)
    doc = np.cumsum(np.r_[0, did[1:] != did[:-1]])
    reach = np.maximum.accumulate(hi + doc * (1 << 33)) - doc * (1 << 33)
    first = np.r_[True, (did[1:] != did[:-1]) | (lo[1:] > reach[:-1])]
    at = np.flatnonzero(first)
    out = spans[at].copy()
    out["hi"] = reach[np.r_[at[1:], len(spans)] - 1]
    return out


def _compare(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[bytes]] = {}
        for b in batches:
            for part, x in zip(b.column(1).to_pylist(), b.column(4).to_pylist()):
                blobs.setdefault(part, []).append(x)
        for xs in blobs.values():
            spans = compare_windows(np.frombuffer(b"".join(xs), EDGE))
            yield packets(0, _deal(spans["did"], parts), spans)

    return run


FINAL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans binary"


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def use(did, doc_id, text, rows):
        s = merged(rows)
        kept, at = [], 0
        for lo, hi in zip(s["lo"].tolist(), s["hi"].tolist()):
            kept.append(text[at:lo])
            at = hi
        kept.append(text[at:])
        left = b"".join(kept)
        yield doc_id, len(text), len(text) - len(left), len(s), hashlib.sha256(left).hexdigest(), np.stack([s["lo"], s["hi"]], 1).tobytes()

    def batch(rows):
        c = list(zip(*rows))
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in c[:4]), pa.array(c[4], pa.string()), pa.array(c[5], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    out = []
    for r in _with_documents(use)(batches, SPANS):
        out.append(r)
        if len(out) >= 5000:
            yield batch(out)
            out = []
    if out:
        yield batch(out)


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(did, doc_id, t): did orders the documents. It is the id where ids are unique and not null; otherwise rows
    are range-partitioned and sorted by id (null last), then by text, numbered partition by partition and written once."""
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), binary_text(text_col).alias("t"))
    odd = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count()
    if not odd:
        return rows.select(F.col("doc_id").alias("did"), "doc_id", "t")
    order = F.col("doc_id").asc_nulls_last(), F.col("t")
    return cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("did"), "doc_id", "t"))


def sample_splitters(docs: DataFrame, total: int, parts: int) -> np.ndarray:
    """parts - 1 quantiles of the keys of about SAMPLE_DOCS documents (they balance buckets; results don't depend on them)."""
    if not total or parts < 2:
        return np.zeros(0, RUN)
    few = docs.where(F.pmod(F.xxhash64("did"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE_DOCS / total))).select("did", "t")

    def run(batches):
        for b in batches:
            for did, text in zip(b.column(0).to_pylist(), b.column(1)):
                r = runs(text.as_py(), did)
                yield pa.RecordBatch.from_arrays([pa.array([r[:: 1 + len(r) // 150].tobytes()], pa.binary())], names=["r"])

    got = few.mapInArrow(run, "r binary").limit(4 * SAMPLE_DOCS).collect()
    keys = np.frombuffer(b"".join(bytes(x["r"]) for x in got), RUN)[:SAMPLE_KEYS]
    return quantiles(keys, parts)


def quantiles(keys: np.ndarray, parts: int) -> np.ndarray:
    if not len(keys) or parts < 2:
        return np.zeros(0, RUN)
    keys = in_order(keys)
    return keys[np.unique((np.arange(1, parts) * len(keys)) // parts)]


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for x in b.column(4):
            r = np.frombuffer(x.as_py(), RUN)
            r = r[:: 1 + len(r) // 2000]
            yield packets(3, np.zeros(len(r), np.int32), r)


def _rerouted(splitters: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(4):
                r = np.frombuffer(x.as_py(), RUN)
                yield packets(0, route(r, splitters), r)

    return run


def _sorted(keyed: DataFrame, splitters: np.ndarray, parts: int, hot_rows: int) -> tuple[DataFrame, np.ndarray]:
    """Sort range-partitioned runs in their buckets and compare within and across buckets: packets of kind 0
    (spans of repeats) and 1 (first of their content, with others at the same head); the hot heads of these."""
    found = cut(keyed.repartitionById(len(splitters) + 1, "part").mapInArrow(_bucket(parts, hot_rows), PACKET))
    told = found.where("kind in (2, 4)").select("kind", "part", "payload").collect()  # two keys and a few heads of each bucket
    repeats, firsts = boundaries([(r["part"], np.frombuffer(bytes(r["payload"]), RUN)) for r in told if r["kind"] == 2])
    heads = np.frombuffer(b"".join(bytes(r["payload"]) for r in told if r["kind"] == 4), HEADS)
    name, at = np.unique(heads["k"] ^ heads["r"], return_inverse=True)
    hot = name[np.bincount(at, heads["n"], len(name)) > hot_rows] if len(name) else name
    more = []
    for kind, rows in ((0, spans_of(repeats)), (1, firsts)):
        more += [tuple(x.values()) for x in packets(kind, _deal(rows["did"], parts), rows).to_pylist()]
    return (found.unionByName(keyed.sparkSession.createDataFrame(more, PACKET)) if more else found), hot


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (int32 pairs) for every document.

    A byte goes if some LENGTH-byte string that covers it also starts earlier: in a document with a smaller id,
    or earlier in its own. Null texts are empty; shorter texts lose nothing. Rows that share an id, or have none,
    are documents of their own, ordered by text. Very long texts are judged whole. Other columns are not read. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    before = spark.conf.get(ARROW_ROWS)
    small_batches(spark)
    try:
        return _remove_repeats(spark, numbered(docs, id_col, text_col), hot_rows)
    finally:
        spark.conf.set(ARROW_ROWS, before)


def _remove_repeats(spark, docs: DataFrame, hot_rows: int) -> DataFrame:
    total, size = docs.agg(F.count("*"), F.sum(F.octet_length("t"))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // PART_BYTES))
    splitters = sample_splitters(docs, total, parts)
    found, hot = _sorted(docs.select("did", "t").mapInArrow(_runs(splitters), PACKET), splitters, parts, hot_rows)
    release(spark)  # each step's shuffle files go before the next deals out texts
    texts = docs.mapInArrow(_as_packets(parts), PACKET)
    together = found.where("kind = 1").unionByName(texts).repartitionById(parts, "part").sortWithinPartitions("kind")
    compared = together.mapInArrow(_edges(parts, hot), PACKET)
    spans = found.where("kind = 0")
    if len(hot):
        compared = cut(compared)
        windows = compared.where("kind = 3")
        few = windows.mapInArrow(_thinned, PACKET).limit(4 * SAMPLE_DOCS).select("payload").collect()
        splitters = quantiles(np.frombuffer(b"".join(bytes(r["payload"]) for r in few), RUN), parts)
        spans = spans.unionByName(_sorted(windows.mapInArrow(_rerouted(splitters), PACKET), splitters, parts, hot_rows)[0].where("kind = 0"))
    spans = spans.unionByName(cut(compared.where("kind = 0").repartitionById(parts, "part").mapInArrow(_compare(parts), PACKET)))
    release(spark)
    together = spans.unionByName(texts).repartitionById(parts, "part").sortWithinPartitions("kind")
    return cut(together.mapInArrow(_finish, FINAL))


def _as_packets(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            did = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(did), 9, np.int32)), pa.array(_deal(did, parts)), b.column(0), b.column(1), b.column(2)], names=["kind", "part", "did", "doc_id", "payload"])

    return run


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


#: Every 100-byte string of every document, by its place; hexadecimal digits stand for bytes.
SQL = """
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, text) AS did, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
places AS (SELECT did, x, unnest(range(0, greatest(length(x) // 2 - 99, 0))) AS p FROM d),
strings AS (SELECT did, p, md5_number(substr(x, 2 * p + 1, 200)) AS k FROM places),
again AS (SELECT did, p FROM strings QUALIFY row_number() OVER (PARTITION BY k ORDER BY did, p) > 1),
starts AS (SELECT did, p, CASE WHEN p > lag(p) OVER (PARTITION BY did ORDER BY p) + 100 THEN 1 ELSE 0 END AS fresh FROM again),
runs AS (SELECT did, p, sum(fresh) OVER (PARTITION BY did ORDER BY p) AS run FROM starts),
spans AS (SELECT did, min(p) AS lo, max(p) + 100 AS hi FROM runs GROUP BY did, run),
bounds AS (SELECT did, lo, hi FROM spans UNION ALL SELECT did, length(x) // 2, length(x) // 2 FROM d),
kept AS (SELECT did, coalesce(lag(hi) OVER (PARTITION BY did ORDER BY lo, hi), 0) AS a, lo AS b FROM bounds),
texts AS (SELECT did, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS y FROM kept JOIN d USING (did) GROUP BY did),
cut AS (SELECT did, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY did)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(y)) AS kept_sha256
FROM d JOIN texts USING (did) LEFT JOIN cut USING (did)
"""
