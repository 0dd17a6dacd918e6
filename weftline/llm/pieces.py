"""SentencePiece (BPE with byte fallback): encoding that keeps the place of every piece in the original text.

A text is normalised from left to right by the longest key of the model's compiled character map (a double-array trie)
that fits at each place; for every byte of the result the byte of the original that it comes from is kept. Segments
between which no piece of the vocabulary can lie are merged on their own and remembered per worker: adjacent symbols
whose join is the piece with the highest score, leftmost first. Characters that are no piece fall back to their bytes.
The pieces' byte lengths, summed up and looked up in the alignment, give every piece its span of the original bytes.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import pack
from .common import binary_text, quoted, table

SPACE = "▁"
CACHE_SEGMENTS = 200_000
#: Segments of up to so many characters are merged many at a time, in groups of alike length; characters of texts worked on together.
LONGEST, GROUPS, CHUNK = 32, (4, 8, 16, 32), 1 << 20
#: Kinds of pieces in a model file (fixed values).
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE_MODEL = 2


class CharMap:
    """The compiled character map: the length of a double-array trie, the trie, then the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        self.units, self.text = [], b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units, self.text = np.frombuffer(blob, "<u4", size // 4, 4).tolist(), blob[4 + size :]

    @staticmethod
    def child(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Length of the longest key that data has at this place, and its replacement; 0 if there is none."""
        units, best, place = self.units, (0, b""), 0
        if not units:
            return best
        place = self.child(units[0])
        for i in range(at, len(data)):
            place ^= data[i]
            if place >= len(units) or units[place] & 0x800000FF != data[i]:
                break
            unit = units[place]
            place ^= self.child(unit)
            if unit & 256:
                start = units[place] & 0x7FFFFFFF
                best = i + 1 - at, self.text[start : self.text.index(b"\0", start)]
        return best

    def leads(self) -> set[int]:
        """The bytes that keys begin with."""
        if not self.units:
            return set()
        root = self.child(self.units[0])
        return {b for b in range(256) if root ^ b < len(self.units) and self.units[root ^ b] & 0x800000FF == b}


class Pieces:
    """Encoder and decoder for one model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = {p.type for p in model.pieces}
        if model.trainer_spec.model_type != BPE_MODEL or not model.trainer_spec.byte_fallback or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models with byte fallback, without user-defined or unused pieces, are encoded")
        if model.trainer_spec.treat_whitespace_as_suffix or model.denormalizer_spec.precompiled_charsmap:
            raise ValueError("models with white space as a suffix, or with a map for decoding, are not encoded")
        spec = model.normalizer_spec
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.map = CharMap(spec.precompiled_charsmap)
        self.kind = [p.type for p in model.pieces]
        self.piece = [p.piece for p in model.pieces]
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.byte = [0] * 256
        unknown = model.trainer_spec.unk_surface.encode()
        #: what each id takes of the normalised text (bytes), and what it gives when decoded (inside a text)
        self.size, self.surface = np.ones(len(self.piece), np.int64), []
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.byte[int(p.piece[1:-1], 16)] = i
                self.surface.append(bytes([int(p.piece[1:-1], 16)]))
            else:
                self.size[i] = len(p.piece.encode())
                self.surface.append({CONTROL: b"", UNKNOWN: unknown}.get(p.type, p.piece.replace(SPACE, " ").encode()))
        self.controls = {i for i, k in enumerate(self.kind) if k == CONTROL}
        self.decimal = [str(i) for i in range(len(self.piece))]
        joined = [p for p in self.score if len(p) > 1]
        inner = {c for p in joined for c in p} - {SPACE}
        if any(SPACE in p.lstrip(SPACE) for p in joined) or not inner:
            self.segments, self.short = (lambda text: [text]), False  # pieces reach over word ends
        else:
            chars = "".join(re.escape(c) for c in sorted(inner))
            self.short = True
            self.segments = re.compile(f"{SPACE}*[{chars}]+|{SPACE}+|[^{SPACE}{chars}]").findall
        #: the map's keys, spaces to be squeezed and other text, for models that have a map or squeeze spaces
        leads = bytes(sorted(self.map.leads()))
        plain = rb"(?:(?![" + re.escape(leads) + rb" ])[\x00-\x7f]|(?![" + re.escape(leads) + rb"])[\xc0-\xff][\x80-\xbf]*)+" if leads else rb"[^ ]+"
        self.plain = re.compile(plain)
        self.cache: dict[str, bytes] = {}
        self._pairs()

    def _pairs(self) -> None:
        """Every way to put a piece together from two symbols (pieces, or characters that are none): sorted keys, each with
        the rank of the piece's score and the piece."""
        self.char = np.full(0x110000, -1, np.int32)
        symbol = dict(self.id)
        for c in sorted({c for p in self.id for c in p}):
            self.char[ord(c)] = symbol.setdefault(c, len(self.piece) + len(symbol) - len(self.id))
        ranks = {v: k for k, v in enumerate(sorted(set(self.score.values()), reverse=True))}
        found = [(symbol[p[:k]] << 32 | symbol[p[k:]], ranks[v], self.id[p]) for p, v in self.score.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        found.sort()
        self.keys, rank, born = (np.array([f[k] for f in found], np.int64) for k in range(3))
        self.rank, self.born = np.r_[rank, len(ranks)].astype(np.int32), np.r_[born, -1].astype(np.int32)  # the last: no piece

    def _found(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places of the pairs (a, b) among the keys; one past the last where they make no piece."""
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((a >= 0) & (b >= 0) & (self.keys[at] == key), at, len(self.keys)) if len(self.keys) else np.zeros(key.shape, np.int64)

    def merge_many(self, words: list[str]) -> list[bytes]:
        """merge() of many short segments: one step joins the best pair of each."""
        n, sizes = len(words), np.fromiter(map(len, words), np.int64, len(words))
        wide, none = int(sizes.max()), self.rank[-1]
        ids = np.full((n, wide + 1), -1, np.int32)
        ids[np.arange(wide + 1) < sizes[:, None]] = self.char[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")]
        out, live = ids.copy(), np.arange(n)
        pair = self._found(ids[:, :-1], ids[:, 1:])
        column = np.arange(wide + 1)
        while True:
            rank = self.rank[pair]
            at = rank.argmin(axis=1)
            on = rank[np.arange(len(live)), at] < none
            out[live[~on]] = ids[~on]
            if not on.any():
                break
            live, ids, pair, at = live[on], ids[on], pair[on], at[on]
            row = np.arange(len(live))
            joined = self.born[pair[row, at]]
            after = column > at[:, None]
            ids[:, :-1] = np.where(after[:, :-1], ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ids[row, at] = joined
            pair[:, :-1] = np.where(after[:, :-2], pair[:, 1:], pair[:, :-1])
            pair[:, -1] = len(self.keys)
            pair[row, at] = self._found(joined, ids[row, at + 1])
            left = np.flatnonzero(at)
            pair[left, at[left] - 1] = self._found(ids[left, at[left] - 1], joined[left])
        kept = out >= 0
        ends = (4 * np.cumsum(kept.sum(axis=1))).tolist()
        flat = out[kept].astype("<u4").tobytes()
        packed = [flat[a:b] for a, b in zip([0, *ends], ends)]
        for i in np.flatnonzero((out >= len(self.piece)).any(axis=1)).tolist():  # characters that fall back to bytes
            packed[i] = self.merge(words[i])
        return packed

    def learn(self, segments: set[str]) -> None:
        """Put the ids of all these segments into the cache."""
        cache = self.cache
        if len(cache) > CACHE_SEGMENTS:
            cache.clear()
        groups: list[list[str]] = [[] for _ in GROUPS]
        for s in segments:
            if s in cache:
                continue
            if 1 < len(s) <= LONGEST and self.short:
                groups[0 if len(s) <= GROUPS[0] else 1 if len(s) <= GROUPS[1] else 2 if len(s) <= GROUPS[2] else 3].append(s)
            else:
                cache[s] = self.merge(s)
        for words in groups:
            if words:
                cache.update(zip(words, self.merge_many(words)))

    def mapped(self, data: bytes) -> Iterator[tuple[int, int, bytes]]:
        """(start, end, what these bytes of the original become) from left to right."""
        at = 0
        while at < len(data):
            m = self.plain.match(data, at)
            if m:
                yield at, m.end(), m.group()
                at = m.end()
                continue
            size, new = self.map.longest(data, at)
            if not size:
                size = 1
                while at + size < len(data) and data[at + size] & 0xC0 == 0x80:
                    size += 1
                new = data[at : at + size]
            yield at, at + size, new
            at += size

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text (UTF-8), and for each of its bytes, and its end, the byte of the original that it comes from."""
        if not data:
            return b"", np.zeros(1, np.int32)
        space = SPACE.encode() if self.escape else b" "
        if not self.map.units and not self.squeeze:
            raw = np.frombuffer(data, np.uint8)
            at = np.arange(len(raw), dtype=np.int32)
            at[raw & 0xC0 == 0x80] = 0  # later bytes of a character come from its first
            at = np.maximum.accumulate(at)
            if self.escape:
                at = np.repeat(at, np.where(raw == 32, len(space), 1))
            head = len(space) if self.prefix else 0
            return space * self.prefix + data.replace(b" ", space), np.concatenate([np.zeros(head, np.int32), at, np.array([len(data)], np.int32)])
        out, places, skip, start = [], [], self.squeeze, None
        for a, b, new in self.mapped(data):
            if start is None:  # spaces at the head go, whatever they were
                if self.squeeze and new == b" ":
                    continue
                start = a
                if self.prefix:
                    out.append(space)
                    places.append(np.full(len(space), a, np.int32))
            if skip:
                new = new.lstrip(b" ")
            if new:
                verbatim = new == data[a:b]
                raw = np.frombuffer(new, np.uint8)
                at = np.full(len(new), a, np.int32)
                if verbatim:
                    at = np.arange(a, b, dtype=np.int32)
                    at[raw & 0xC0 == 0x80] = 0
                    at = np.maximum.accumulate(at)
                if self.escape:
                    at, new = np.repeat(at, np.where(raw == 32, len(space), 1)), new.replace(b" ", space)
                out.append(new)
                places.append(at)
                skip = self.squeeze and raw[-1] == 32
        if start is None:
            return b"", np.zeros(1, np.int32)
        text, at, end = b"".join(out), np.concatenate(places), len(data)
        while self.squeeze and text.endswith(space):
            text = text[: -len(space)]
            end = int(at[len(text)])
        return text, np.append(at[: len(text)], np.int32(end))

    def merge(self, segment: str) -> bytes:
        """Ids of one segment (unsigned 32-bit): the join with the highest score first, leftmost among equals."""
        parts, score = list(segment), self.score
        if len(parts) <= 64:
            low = -np.inf
            gain = [score.get(a + b, low) for a, b in zip(parts, parts[1:])]
            while gain and (best := max(gain)) > low:
                i = gain.index(best)
                parts[i] += parts[i + 1]
                del parts[i + 1], gain[i]
                if i:
                    gain[i - 1] = score.get(parts[i - 1] + parts[i], low)
                if i < len(gain):
                    gain[i] = score.get(parts[i] + parts[i + 1], low)
        else:
            n = len(parts)
            after, before = list(range(1, n + 1)), list(range(-1, n - 1))
            heap = [(-s, i, p) for i in range(n - 1) if (s := score.get(p := parts[i] + parts[i + 1])) is not None]
            heapq.heapify(heap)
            while heap:
                _, i, p = heapq.heappop(heap)
                j = after[i]
                if not parts[i] or j >= n or parts[i] + parts[j] != p:
                    continue
                parts[i], parts[j], after[i] = p, "", after[j]
                if after[j] < n:
                    before[after[j]] = i
                for x, y in ((before[i], i), (i, after[i])):
                    if x >= 0 and y < n and (s := score.get(q := parts[x] + parts[y])) is not None:
                        heapq.heappush(heap, (-s, x, q))
            parts = [p for p in parts if p]
        ids: list[int] = []
        for p in parts:
            i = self.id.get(p)
            ids += [i] if i is not None else [self.byte[b] for b in p.encode()]
        return pack(ids)

    def encode_many(self, texts: Iterable[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids and the places of the original (bytes) where its pieces begin, and the last one ends."""
        held, size = [], 0
        for data in texts:
            normal, at = self.normalise(_whole(data))
            held.append((self.segments(normal.decode()), at))
            size += len(normal)
            if size > CHUNK:
                yield from self._encoded(held)
                held, size = [], 0
        yield from self._encoded(held)

    def _encoded(self, held: list[tuple[list[str], np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.learn(set().union(*(parts for parts, _ in held)))
        get = self.cache.__getitem__
        for parts, at in held:
            ids = np.frombuffer(b"".join(map(get, parts)), "<u4")
            edges = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(self.size[ids], out=edges[1:])
            yield ids, at[edges]

    def encode(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """encode_many() of one text."""
        return next(self.encode_many([data]))

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids; bytes that form no character become one replacement character each."""
        ids = ids.tolist()
        if self.controls.isdisjoint(ids):
            out = b"".join(map(self.surface.__getitem__, ids))
        else:  # they end a run of bytes
            out = b"".join(_whole(b"".join(map(self.surface.__getitem__, run))) for _, run in itertools.groupby(ids, self.controls.__contains__))
        if self.prefix or self.squeeze:
            cut = 0
            for i in ids:  # the space before the first word, or all leading ones, is not of the text
                if self.kind[i] == NORMAL and self.piece[i].startswith(SPACE):
                    cut += 1
                    if len(self.piece[i]) > 1 or not self.squeeze:
                        break
                elif self.kind[i] != CONTROL:
                    break
            out = out[cut:]
        return _whole(out)


def _whole(data: bytes) -> bytes:
    """UTF-8 as it is; each byte that belongs to no character becomes one replacement character."""
    try:
        data.decode()
    except UnicodeDecodeError:
        data = data.decode("utf-8", "weftline-bytewise").encode()
    return data


def _bytewise(error: UnicodeError):
    return "�", error.start + 1


def _register() -> None:
    import codecs

    codecs.register_error("weftline-bytewise", _bytewise)


@functools.lru_cache(maxsize=2)
def codec(path: str | None) -> Pieces:
    """One encoder per worker process and model; without a path, the worker's own copy of the public model."""
    _register()
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return Pieces(path)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), binary_text(text_col).alias("text"))


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, begins, ends (arrays of ints): every whole text's pieces and the bytes of the original each stands for.

    The spans of consecutive pieces follow each other without gaps but where normalisation drops characters; the bytes of
    one character that falls back share its span (all but the last are empty). Null text counts as empty (no pieces); very
    long texts are one row each; repeated rows give repeated rows; other columns are not read. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for i, (ids, at) in enumerate(c.encode_many(t.as_py() for t in b.column(1))):
                lists = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(x.astype(np.int32))) for x in (ids, at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), *lists], names=["doc_id", "ids", "begins", "ends"])
        c.cache.clear()

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, begins array<int>, ends array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows (doc_id, ids array<int>); null ids give null, null entries are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            text = [None if x is None else c.decode(np.array([i for i in x if i is not None], np.int64)).decode() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"


def round_trip(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text in one narrow pass and return digests of ids, decoded text and spans (their edges
    as little-endian 32-bit integers). Nulls, long texts, repeated rows, other columns and empty tables as in encode()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sha = codec(path), hashlib.sha256
        for b in batches:
            n, ids_sha, back, spans = [], [], [], []
            for ids, at in c.encode_many(t.as_py() for t in b.column(1)):
                n.append(len(ids))
                ids_sha.append(sha(",".join(map(c.decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                back.append(sha(c.decode(ids)).hexdigest())
                spans.append(sha(at.astype("<i4").tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.string()) for x in (ids_sha, back, spans))], names=[x.split()[0] for x in DIGEST.split(", ")])
        c.cache.clear()

    return _rows(docs, id_col, text_col).mapInArrow(run, DIGEST)


def op11_pieces(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
