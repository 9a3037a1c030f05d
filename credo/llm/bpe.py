"""Byte-level BPE encoding and decoding by a lazily determinised transducer.

The merges are compiled into a nondeterministic transducer whose arcs spell
the tokens byte by byte.  A path is a valid encoding exactly when each two
neighbouring tokens are the encoding of their joined bytes, so a path only
has to remember its last token.  ``Transducer`` determinises it lazily: a
state is the set of live paths, and an arc says which token ends there (only
one path can be at a token border after any byte).  As soon as one path is
left, all tokens so far are certain and emitted; that takes a bounded number
of further bytes, as a path dies when no token can complete it.

Decoding runs the token bytes through an incremental UTF-8 state machine whose
states are the (at most three) pending bytes; its arcs are tokens, also built
on demand.

Null texts encode as empty texts; an empty text gives no ids.  Ids that the
vocabulary lacks, null ids and bytes that are not UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from credo.llm.common import give_back, held, slices

#: Words whose encoding a worker remembers; longer words and further ones are
#: encoded again each time they occur.
WORDS_KEPT, WORD_BYTES_KEPT = 600_000, 48
#: States and pairs of tokens that a worker remembers before it starts anew.
STATES_KEPT, PAIRS_KEPT = 80_000, 400_000
#: Texts of an Arrow batch that are taken out of it together.
TEXTS_AT_ONCE = 256
#: Bytes of texts whose ids leave the worker together; longer texts alone.
BYTES_AT_ONCE = 1 << 20


class Merges:
    """The rank file as a trie of token bytes, and the merge that made each token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.length = {i: len(b) for b, i in ranks.items()}
        self.arcs: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, i in ranks.items():
            node = 0
            for byte in token:
                nxt = self.arcs[node].get(byte)
                if nxt is None:
                    nxt = self.arcs[node][byte] = len(self.arcs)
                    self.arcs.append({})
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = i
        self._parts: dict[int, tuple[int, int] | None] = {}

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a single byte."""
        if token not in self._parts:
            pieces = self.merge(self.bytes_of[token], token)
            self._parts[token] = (pieces[0], pieces[1]) if len(pieces) == 2 else None
        return self._parts[token]

    def merge(self, data: bytes, below: int) -> list[int]:
        """Lowest rank first, leftmost first, using ranks under ``below`` only."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def neighbours(self, left: int, right: int) -> bool:
        """Whether ``left`` then ``right`` is how their joined bytes are encoded.

        The merges of both are undone, latest first.  What faces the border at
        any time must not have been merged across it before the merge undone
        last would take place; a merge of the same rank goes to the left.
        """
        bytes_of, rank_of, known = self.bytes_of, self.ranks.get, self._parts
        a, b = left, right
        # a border merge must rank under `limit` to come first
        limit = 1 << 62
        while True:
            joined = rank_of(bytes_of[a] + bytes_of[b])
            if joined is not None and joined < limit:
                return False
            pa = known[a] if a in known else self.parts(a)
            pb = known[b] if b in known else self.parts(b)
            if pb is None or (pa is not None and a > b):
                if pa is None:
                    return True
                # a was made last, by merging its halves; at equal rank the
                # halves of a, which lie to the left, come first
                limit, a = a, pa[1]
            else:
                # at equal rank the border merge lies left of b's halves
                limit, b = b + 1, pb[0]


class State:
    """A set of live paths; ``arcs`` lead to (token that ends there, next state)."""

    __slots__ = ("arcs", "paths", "sole")

    def __init__(self, paths: tuple):
        self.paths = paths
        self.arcs: dict[int, tuple[int, State]] = {}
        self.sole = len(paths) == 1  # all live paths agree on all tokens so far


class Transducer:
    """States are sets of paths.  A path is (trie node, how it may go on).

    The second part is the last token (-1 at the start), or, below a node with
    at most ``FEW`` tokens, the tuple of those that can follow it: paths with
    the same future are one path, and those without any are dropped.
    """

    FEW = 8

    def __init__(self, merges: Merges, share: float = 1.0):
        self.merges, self.share = merges, share
        self.valid: dict[int, bool] = {}
        self.below: dict[int, tuple[int, ...] | None] = {}
        self.clear()

    def clear(self) -> None:
        start = ((0, -1),)
        self.states = {start: State(start)}
        self.start = self.states[start]

    def fits(self, left: int, right: int) -> bool:
        if left < 0:
            return True
        key = left << 32 | right
        found = self.valid.get(key)
        if found is None:
            if len(self.valid) > PAIRS_KEPT * self.share:
                self.valid.clear()
            found = self.valid[key] = self.merges.neighbours(left, right)
        return found

    def few_below(self, node: int) -> tuple[int, ...] | None:
        """The tokens strictly below ``node``, or None for more than ``FEW``."""
        if node not in self.below:
            found: list[int] = []
            todo = [node]
            while todo and len(found) <= self.FEW:
                for nxt in self.merges.arcs[todo.pop()].values():
                    if self.merges.token_at[nxt] >= 0:
                        found.append(self.merges.token_at[nxt])
                    todo.append(nxt)
            self.below[node] = tuple(sorted(found)) if len(found) <= self.FEW else None
        return self.below[node]

    def step(self, state: State, byte: int) -> tuple[int, State]:
        """Build the arc of ``state`` for ``byte``."""
        arcs, token_at, paths, ended = self.merges.arcs, self.merges.token_at, set(), -1
        for node, after in state.paths:
            nxt = arcs[node].get(byte)
            if nxt is None:
                continue
            token = token_at[nxt]
            if token >= 0 and (token in after if type(after) is tuple else self.fits(after, token)):
                ended = token
                paths.add((0, token))
            if arcs[nxt]:
                below = self.few_below(nxt)
                if below is None:
                    paths.add((nxt, after))
                elif type(after) is tuple:
                    if left := tuple(t for t in after if t in below):
                        paths.add((nxt, left))
                elif left := tuple(t for t in below if self.fits(after, t)):
                    paths.add((nxt, left))
        key = tuple(sorted(paths, key=repr)) if len(paths) > 1 else tuple(paths)
        target = self.states.get(key)
        if target is None:
            target = self.states[key] = State(key)
        arc = state.arcs[byte] = (ended, target)
        return arc

    def encode(self, data: bytes) -> list[int]:
        if len(self.states) > STATES_KEPT * self.share:
            self.clear()
        lengths = self.merges.length
        out: list[int] = []
        ends: list[int] = []  # the token that ends at each byte not emitted yet
        state = self.start
        for byte in data:
            arc = state.arcs.get(byte)
            if arc is None:
                arc = self.step(state, byte)
            ends.append(arc[0])
            state = arc[1]
            if state.sole:
                out += back(ends, lengths)
                ends = []
        out += back(ends, lengths)
        return out


def back(ends: list[int], lengths: dict[int, int]) -> list[int]:
    """The one path that ends after the last byte: each token tells where the one before ends."""
    found, at = [], len(ends) - 1
    while at >= 0:
        found.append(ends[at])
        at -= lengths[ends[at]]
    return found[::-1]


class Words(dict):
    """From a word to its ids, packed as little-endian unsigned 32-bit integers."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, word: str) -> bytes:
        data = word.encode()
        packed = packed_ids(self.transducer.encode(data))
        if len(data) <= WORD_BYTES_KEPT:
            if len(self) >= WORDS_KEPT * self.transducer.share:
                self.clear()
            self[word] = packed
        return packed


def packed_ids(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if packed.itemsize != 4:
        raise OverflowError("array type I must have four bytes")
    return packed.tobytes()


class Utf8Machine:
    """Incremental decoding: (pending bytes, token) leads to (characters, pending bytes)."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        #: Characters of the tokens that begin and end between characters.
        self.whole = {i: s for i, b in bytes_of.items() if (s := self.clean(b)) is not None}
        self.arcs: dict[tuple[bytes, int], tuple[str, bytes]] = {}

    @staticmethod
    def clean(data: bytes) -> str | None:
        try:
            return data.decode()
        except UnicodeDecodeError:
            return None

    def step(self, pending: bytes, token: int) -> tuple[str, bytes]:
        arc = self.arcs.get((pending, token))
        if arc is None:
            arc = self.arcs[pending, token] = self.run(pending, self.bytes_of.get(token, b"\xff"))
        return arc

    @staticmethod
    def run(pending: bytes, data: bytes) -> tuple[str, bytes]:
        """Byte by byte: a lead byte fixes how many follow and the range of the second."""
        out: list[str] = []
        have = bytearray(pending)
        for byte in data:
            if have:
                lead, second = have[0], len(have) == 1
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80) if second else 0x80
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF) if second else 0xBF
                if low <= byte <= high:
                    have.append(byte)
                    if len(have) == (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4):
                        out.append(have.decode())
                        have.clear()
                    continue
                out.append("�")
                have.clear()
            if byte < 0x80:
                out.append(chr(byte))
            elif 0xC2 <= byte <= 0xF4:
                have.append(byte)
            else:
                out.append("�")
        return "".join(out), bytes(have)

    def decode(self, ids) -> str:
        whole, step, out, pending = self.whole, self.step, [], b""
        for token in ids:
            chars = whole.get(token) if not pending else None
            if chars is None:
                chars, pending = step(pending, token)
            out.append(chars)
        if pending:
            out.append("�")
        return "".join(out)


def rank_file(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def encoder(path: str, share: float = 1.0) -> Words:
    return Words(Transducer(Merges(rank_file(path)), share))


def decoder(path: str) -> Utf8Machine:
    return Utf8Machine({i: b for b, i in rank_file(path).items()})


@lru_cache(maxsize=4)
def splitter(pattern: str):
    return regex.compile(pattern)


def encoded(text: str | None, words: Words, split) -> bytes:
    return b"".join([words[m] for m in split.findall(text)]) if text else b""


def encoded_batch(texts: pa.Array, words: Words, split) -> pa.Array:
    """Ids of a batch of texts, of which only ``TEXTS_AT_ONCE`` are Python objects at a time."""
    parts = [pa.array([encoded(t, words, split) for t in texts.slice(at, TEXTS_AT_ONCE).to_pylist()], pa.binary())
             for at in range(0, len(texts), TEXTS_AT_ONCE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.binary())


def encoded_slices(texts: pa.Array, words: Words, split) -> Iterator[pa.Array]:
    """Ids of a batch of texts, handed on after ``BYTES_AT_ONCE`` bytes of text."""
    for low, high in slices(texts, BYTES_AT_ONCE):
        yield encoded_batch(texts.slice(low, high - low), words, split)


def decoded(ids: bytes | None, machine: Utf8Machine) -> str:
    return machine.decode(array("I", ids[:len(ids) // 4 * 4])) if ids else ""


def encode(text: Column, path: str, pattern: str, share: float = 1.0) -> Column:
    """Ids of each text as little-endian unsigned 32-bit integers (binary).

    ``path`` names the rank file on every executor; ``pattern`` cuts a text
    into words that are encoded separately; ``share`` scales what a worker
    remembers (less memory, more work, the same ids).
    """

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words, split = held(("bpe encoder", path, share), lambda: encoder(path, share)), splitter(pattern)
        for batch in batches:
            yield from encoded_slices(batch, words, split)
        give_back()

    return run(text)


def decode(ids: Column, path: str) -> Column:
    """Text of each packed id sequence; the inverse of ``encode``."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = held(("bpe decoder", path), lambda: decoder(path))
        for batch in batches:
            yield pd.Series([decoded(x, machine) for x in batch], dtype=object)

    return run(ids)


def round_trip(text: Column, path: str, pattern: str) -> Column:
    """struct of ``ids``, as ``encode`` gives them, and ``text``, as ``decode`` gives it, in one pass."""

    @F.pandas_udf("ids binary, text string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words, machine = held(("bpe", path), lambda: (encoder(path), decoder(path)))
        split = splitter(pattern)
        for batch in batches:
            ids = [encoded(t, words, split) for t in batch]
            yield pd.DataFrame({"ids": ids, "text": [decoded(x, machine) for x in ids]}, dtype=object)

    return run(text)
