"""Edit-aware token counts.

Each document has a tree over its pre-tokens: leaves hold up to LEAF pre-tokens with their lengths and token
counts, inner nodes hold sums of characters and tokens. An edit looks up the leaves it touches by characters,
cuts the text again from a pre-token that ends far enough before the edit for its match not to have seen it,
until a new boundary meets an old one behind the edit, re-encodes only those pre-tokens and updates the sums
on the paths above. Matching the pattern needs no look-behind, so from a common boundary on the rest agrees.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SpeculativeBpe, chunks, codec, default_path
from .common import quoted, table

LEAF = 64


class CountTree:
    """Sums of characters and tokens over a document's pre-tokens; level 0 are leaves of (lengths, counts)."""

    def __init__(self, lengths: Sequence[int], counts: Sequence[int], fan: int = LEAF):
        self.fan = fan
        self.leaves = [(list(lengths[i : i + fan]), list(counts[i : i + fan])) for i in range(0, len(lengths), fan)]
        self._rebuild()

    def _rebuild(self) -> None:
        level = [(sum(a), sum(b)) for a, b in self.leaves]
        self.levels = [level]
        while len(level) > 1:
            level = [(level[i][0] + level[i + 1][0], level[i][1] + level[i + 1][1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
            self.levels.append(level)

    @property
    def chars(self) -> int:
        return self.levels[-1][0][0] if self.leaves else 0

    @property
    def tokens(self) -> int:
        return self.levels[-1][0][1] if self.leaves else 0

    def leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds this character (the last leaf for the end), and the characters before it."""
        at, before = 0, 0
        for level in reversed(self.levels[:-1]):
            at *= 2
            if at + 1 < len(level) and before + level[at][0] <= position:
                before += level[at][0]
                at += 1
        return at, before

    def replace(self, first: int, last: int, lengths: list[int], counts: list[int]) -> None:
        """Put new pre-tokens in place of leaves first..last; path sums only, unless the leaves' number changes."""
        fan = self.fan
        n = max(1, -(-len(lengths) // fan))
        if n <= last - first + 1 or len(lengths) <= 2 * fan * (last - first + 1):
            n = last - first + 1
            cuts = [len(lengths) * i // n for i in range(n + 1)]
            for i in range(n):
                self.leaves[first + i] = (lengths[cuts[i] : cuts[i + 1]], counts[cuts[i] : cuts[i + 1]])
            touched = range(first, last + 1)
            for i in touched:
                self.levels[0][i] = (sum(self.leaves[i][0]), sum(self.leaves[i][1]))
            for below, level in zip(self.levels, self.levels[1:]):
                for i in sorted({j // 2 for j in touched}):
                    pair = below[2 * i : 2 * i + 2]
                    level[i] = (sum(x[0] for x in pair), sum(x[1] for x in pair))
                touched = range(touched[0] // 2, touched[-1] // 2 + 1)
        else:
            self.leaves[first : last + 1] = [(lengths[i : i + fan], counts[i : i + fan]) for i in range(0, len(lengths), fan)]
            self._rebuild()


class CountedText:
    """A text with its tree; edit() keeps both in step."""

    def __init__(self, text: str, bpe: SpeculativeBpe, pieces: list[str] | None = None):
        self.text, self.bpe = text, bpe
        pieces = bpe.pieces(text) if pieces is None else pieces
        self.tree = CountTree([len(p) for p in pieces], self._counts(pieces))
        self.reencoded = 0
        # how far behind a pre-token its match can have looked: two characters, or a special token's length
        self.reach = 2 + max(map(len, bpe.special), default=0)

    def _counts(self, pieces: list[str]) -> list[int]:
        cache = self.bpe.cache
        if any(p not in cache for p in pieces):
            self.bpe.learn([pieces])
        return [len(cache[p]) // 4 for p in pieces]

    @property
    def tokens(self) -> int:
        return self.tree.tokens

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace text[start:end] by new."""
        start = max(0, min(start, len(self.text)))
        end = max(start, min(end, len(self.text)))
        old, self.text = self.text, self.text[:start] + new + self.text[end:]
        tree, reach, shift = self.tree, self.reach, len(new) - (end - start)
        if not tree.leaves:
            self.__init__(self.text, self.bpe)
            return
        # leaves from one that ends before what a match could have seen, to one that begins behind the edit
        first, begin = tree.leaf_at(max(0, start - reach - 1))
        ends, at = [], begin  # old boundaries from the first leaf on
        last = first
        wide = max(end + reach, start)
        while last < len(tree.leaves):
            for n in tree.leaves[last][0]:
                at += n
                ends.append(at)
            if at > wide:
                # re-cut and see whether a new boundary meets this leaf's end
                stop = at + shift
                pieces = self.bpe.pieces(self.text[begin : stop + 64])
                got, pos = [], begin
                for p in pieces:
                    if pos >= stop:
                        break
                    pos += len(p)
                    got.append(p)
                if pos == stop or stop + 64 >= len(self.text) and last == len(tree.leaves) - 1:
                    break
            last += 1
        else:
            last = len(tree.leaves) - 1
            got = self.bpe.pieces(self.text[begin:])
        # pre-tokens before the edit's reach and behind the meeting point keep their counts
        held_l = [n for i in range(first, last + 1) for n in tree.leaves[i][0]]
        held_c = [n for i in range(first, last + 1) for n in tree.leaves[i][1]]
        head = 0
        limit = bisect_right(ends, start - reach) if ends else 0
        while head < limit and head < len(got) and len(got[head]) == held_l[head]:
            head += 1
        tail, room = 0, min(len(got), len(held_l)) - head
        right = len(self.text) if last == len(tree.leaves) - 1 else None
        pos = right if right is not None else ends[-1] + shift
        while tail < room and len(got[-1 - tail]) == held_l[-1 - tail] and pos - len(got[-1 - tail]) >= start + len(new) + reach:
            pos -= len(got[-1 - tail])
            tail += 1
        middle = got[head : len(got) - tail]
        counts = held_c[:head] + self._counts(middle) + (held_c[len(held_c) - tail :] if tail else [])
        self.reencoded += len(middle)
        tree.replace(first, last, [len(p) for p in got], counts)


def standard_edits(n: int) -> list[tuple[int, int, str]]:
    """The edits that op2 applies to a text of n characters: insert in the middle, delete at a third, append."""
    return [(n // 2, n // 2, " edited 2 times"), (n // 3, n // 3 + 7, ""), (n + 8, n + 8, "\n\nThe end.")]


def count_tokens(docs: DataFrame, edits=standard_edits, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts before and after edits: doc_id, n_tokens, n_pieces, n_tokens_edited, n_reencoded. Narrow, no shuffle.

    edits(n_chars) lists (start, end, replacement), applied in turn; positions beyond the text are clipped.
    Null text counts as empty (0 tokens before the edits); repeated rows give repeated rows; other columns are not
    read. An empty table gives no rows.
    """
    at = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, cols = codec(at), ([], [], [], [])
            for chunk in chunks(["" if t is None else t for t in b.column(1).to_pylist()]):
                lists = [c.pieces(t) for t in chunk]
                c.learn(lists)
                for text, pieces in zip(chunk, lists):
                    doc = CountedText(text, c, pieces)
                    before = doc.tokens
                    for e in edits(len(text)):
                        doc.edit(*e)
                    for col, v in zip(cols, (before, len(pieces), doc.tokens, doc.reencoded)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in cols)], names=["doc_id", "n_tokens", "n_pieces", "n_tokens_edited", "n_reencoded"])

    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, n_pieces long, n_tokens_edited long, n_reencoded long")


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
