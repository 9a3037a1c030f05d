"""Token counts of a sentence-piece BPE model by rank-synchronous merging.

No piece has a word mark (U+2581) after another character, and a character
without a piece never merges, so a text can be cut before each run of word
marks and around newlines (bytes without a piece of their own) without
changing its tokens.  A batch's distinct parts stand as one ragged numpy
array of symbols; each round finds the lowest-ranked neighbouring pair of
every part at once and applies it in all of them, until no part has a pair.
The count of a part is its surviving symbols, where a character without a
piece counts one token for each UTF-8 byte.

Of several equal pairs the left one goes first, as in the library.  All
occurrences in a part merge in one round, unless the merged piece can
take part in a pair of no higher rank; then only the leftmost does.

Null and empty texts have no tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from credo.llm.common import held

#: Parts whose count a worker remembers, and their longest length.
PARTS_KEPT, PART_CHARS_KEPT = 600_000, 48
#: Symbols that one ragged array holds; a longer part gets an array of its own.
SYMBOLS_AT_ONCE = 2_000_000
NONE = np.iinfo(np.int64).max


class Pieces:
    """Pieces as numbered symbols; a table of the pairs that merge, with ranks."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size())
               if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        pieces = {model.id_to_piece(i): n for n, i in enumerate(ids)}
        if any("▁" in p.lstrip("▁") for p in pieces) or "\n" in "".join(pieces):
            raise ValueError("a piece spans words; parts can't be counted separately")
        if model.normalize("ﬁ  x　") != "▁ﬁ▁▁x　":
            raise ValueError("the model normalises texts, which this operator doesn't")
        # equal scores share a rank
        order = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in ids}, reverse=True))}
        rank = np.array([order[model.get_score(i)] for i in ids], dtype=np.int64)
        self.single = {p: n for p, n in pieces.items() if len(p) == 1}
        pairs = [(pieces[p[:k]], pieces[p[k:]], n) for p, n in pieces.items()
                 for k in range(1, len(p)) if p[:k] in pieces and p[k:] in pieces]
        table = np.array(pairs, dtype=np.int64).reshape(-1, 3)
        key = table[:, 0] << 32 | table[:, 1]
        by = np.argsort(key)
        self.keys, self.merged, self.rank = key[by], table[by, 2], rank
        self.alone = np.zeros(len(ids), dtype=bool)  # merge one occurrence at a time
        for side in (0, 1):
            self.alone[table[rank[table[:, 2]] <= rank[table[:, side]], side]] = True

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged piece of each pair, or -1."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.merged[at], -1)


class Counts(dict):
    """From a part to its count; ``find`` computes those of new parts together."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces

    def find(self, wanted: set[str]) -> dict[str, int]:
        """Counts of ``wanted``; the short parts are remembered."""
        found = {p: self[p] for p in wanted if p in self}
        new: dict[str, int] = {}
        batch, size = [], 0
        for part in wanted - found.keys():
            batch.append(part)
            size += len(part)
            if size >= SYMBOLS_AT_ONCE:
                new.update(zip(batch, self.count(batch)))
                batch, size = [], 0
        new.update(zip(batch, self.count(batch)))
        if len(self) + len(new) > PARTS_KEPT:
            self.clear()
        self.update((p, n) for p, n in new.items() if len(p) <= PART_CHARS_KEPT)
        return found | new

    def count(self, parts: list[str]) -> list[int]:
        if not parts:
            return []
        single = self.pieces.single
        lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        symbols = np.fromiter((single.get(c, -1) for p in parts for c in p), dtype=np.int64, count=lengths.sum())
        unknown = [(n, len(c.encode()) - 1) for n, p in enumerate(parts) for c in p if c not in single]
        counts = np.zeros(len(parts), dtype=np.int64)
        for n, extra in unknown:
            counts[n] += extra
        self.merge(symbols, np.repeat(np.arange(len(parts)), lengths), counts)
        return counts.tolist()

    def merge(self, symbols: np.ndarray, owner: np.ndarray, counts: np.ndarray) -> None:
        """Add each part's surviving symbols to ``counts``."""
        pieces = self.pieces
        while len(symbols):
            made = np.full(len(symbols), -1, dtype=np.int64)
            made[:-1] = np.where(owner[:-1] == owner[1:], pieces.look_up(symbols[:-1], symbols[1:]), -1)
            rank = np.where(made >= 0, pieces.rank[made], NONE)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            ended = lowest == NONE
            counts[owner[starts[ended]]] += sizes[ended]
            hit = (rank == np.repeat(lowest, sizes)) & (made >= 0)
            at = np.flatnonzero(hit)
            # only the first occurrence where the merged piece asks for it
            first = np.r_[True, owner[at][1:] != owner[at][:-1]] if len(at) else np.zeros(0, dtype=bool)
            single = np.zeros(len(counts), dtype=bool)
            single[owner[at[pieces.alone[made[at]]]]] = True
            at = at[first | ~single[owner[at]]]
            # of overlapping occurrences every second one, from the left
            if len(at):
                run = np.cumsum(np.r_[True, (np.diff(at) != 1) | (owner[at][1:] != owner[at][:-1])])
                begin = at[np.r_[0, np.flatnonzero(np.diff(run)) + 1]]
                at = at[(at - begin[run - 1]) % 2 == 0]
            symbols[at] = made[at]
            keep = ~np.repeat(ended, sizes)
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]


def counts(path: str) -> Counts:
    return held(("pieces", path), lambda: Counts(Pieces(path)))


def cut(text: str) -> tuple[list[str], int]:
    """The parts of a non-empty text, and its newlines (a token each).

    Blanks become word marks and one mark is put in front, so a part is a run
    of marks with the characters after it; the parts of a line that follow a
    newline have no mark in front.
    """
    parts: list[str] = []
    lines = ("▁" + text.replace(" ", "▁")).split("\n")
    for line in lines:
        words = line.split("▁")
        if words[0]:
            parts.append(words[0])
        marks = 0
        for word in words[1:]:
            marks += 1
            if word:
                parts.append("▁" * marks + word)
                marks = 0
        if marks:
            parts.append("▁" * marks)
    return parts, len(lines) - 1


def count_tokens(text: Column, path: str) -> Column:
    """Number of tokens of each text; ``path`` names the model on every executor."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = counts(path)
        for batch in batches:
            out = [0] * len(batch)
            texts = batch.tolist()
            group, size = [], 0
            for n, text in enumerate(texts):
                if text:
                    group.append(n)
                    size += len(text)
                if size > SYMBOLS_AT_ONCE or n == len(texts) - 1:
                    cuts = [cut(texts[i]) for i in group]
                    found = known.find(set().union(*(parts for parts, _ in cuts)))
                    for i, (parts, newlines) in zip(group, cuts):
                        out[i] = newlines + sum(map(found.__getitem__, parts))
                    group, size = [], 0
            yield pd.Series(out, dtype="int64")

    return run(text)
