"""Language-model scores by a Katz backoff bigram model.

Counts up to ``LARGEST`` are discounted by the Good-Turing ratios; the mass
that a context's seen successors lose goes to the words it hasn't been seen
with, by their (discounted) unigram probability, under a weight that makes
each context's probabilities sum to exactly 1.  Unseen words are one type,
which gets the unigram mass that discounting frees.

    P(w | h) = d(c(h,w)) c(h,w) / c(h)      if c(h,w) > 0
             = alpha(h) P(w)                otherwise (alpha = 1 for unseen h)

The tables are partitioned by the hash of the context into buckets; a context
with so many tokens that it would outgrow a bucket has its successors dealt to
buckets of its own by the hash of the word, and the sums over them (discounted
mass, covered unigram mass) meet afterwards.  Documents are tokenised once, into blocks of some million tokens; a
block sends each bucket its distinct bigrams (not its tokens) and gets back
their counts and their contexts' weights, so the shuffles carry a few bytes
for each distinct bigram of a block.

The numbers of types seen 1, 2, ... times are smoothed by a line through their
logarithms before the Good-Turing ratios are taken, so that the ratios lie
between 0 and 1 for every corpus: raw ones leave that range where copies or a
small vocabulary make the numbers irregular.

Words are compared by 64-bit hashes.  Null texts count as empty: just the end
token.  The text's start has the end token as its context.  A null id hashes
like the empty text.  Where nothing is discounted (no type is seen up to
``LARGEST`` times), one count is added for what is unseen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credo.llm.common import held, stored, text_or_empty

#: Counts up to this one are discounted.
LARGEST = 5
#: Slope of the counts of counts where fewer than two are known, and the flattest that discounts.
DEFAULT_SLOPE, MOST_SLOPE = -2.0, -1.1
#: Tokens of a block, tokens for each bucket of contexts.
BLOCK_TOKENS, BUCKET_TOKENS = 1_000_000, 3_000_000
WORDS_KEPT = 200_000
#: White space can't be in a word, so this is no word's hash.
END = xxhash.xxh64_intdigest(b"\n")


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


def hashes() -> Hashes:
    return held("model words", Hashes)


def tokens(text: str | None) -> np.ndarray:
    """Hashes of a text's words, A-Z in lower case, and of the end."""
    known = hashes()
    words = [known[w] for w in text.encode().lower().split()] if text else []
    return np.array([*words, END], dtype=np.uint64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of non-negative integers or floats, compressed; increasing integers as differences."""
    parts = []
    for x in arrays:
        rises = x.dtype.kind != "f" and len(x) > 1 and bool((x[1:] >= x[:-1]).all())
        if rises:
            x = np.r_[x[:1], np.diff(x)]
        if x.dtype.kind != "f":
            top = int(x.max()) if len(x) else 0
            x = x.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if top <= np.iinfo(t).max))
        parts.append(np.array([len(x), x.dtype.itemsize, x.dtype.kind == "f", rises], dtype="<i8").tobytes())
        # first bytes, second bytes, ...: high bytes are mostly zero
        parts.append(np.ascontiguousarray(x).view("u1").reshape(len(x), x.dtype.itemsize).T.tobytes())
    return zstandard.compress(b"".join(parts), 3)


def unpack(data: bytes) -> list[np.ndarray]:
    raw, out, at = zstandard.decompress(data), [], 0
    while at < len(raw):
        n, size, real, rises = np.frombuffer(raw, "<i8", 4, at).tolist()
        x = np.frombuffer(raw, "u1", n * size, at + 32).reshape(size, n).T
        x = np.ascontiguousarray(x).view(f"<f{size}" if real else f"<u{size}").reshape(n)
        at += 32 + n * size
        if rises:
            x = np.cumsum(x.astype(np.uint64), dtype=np.uint64)
        out.append(x)
    return out


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    return (row for batch in batches for row in batch.to_pylist())


def one_row(schema: pa.Schema, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(values, schema)], schema=schema)


def table_of(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(schema)], schema=schema)


BLOCK = pa.schema([("block", pa.int64()), ("size", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("data", pa.binary())])
PART = pa.schema([("bucket", pa.int64()), ("kind", pa.int64()), ("block", pa.int64()), ("data", pa.binary()), ("stats", pa.list_(pa.int64()))])
SENT = pa.schema([("bucket", pa.int64()), ("sender", pa.int64()), ("data", pa.binary())])
BACK = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("data", pa.binary())])
SCORE = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
DDL = {pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean", pa.float64(): "double", pa.list_(pa.int64()): "array<long>", pa.list_(pa.bool_()): "array<boolean>"}


def ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {DDL[f.type]}" for f in schema)


def make_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vocabulary (most frequent first), token numbers in it and document lengths of each block."""
    ids, held, found, size, number = [], [], [], 0, TaskContext.get().partitionId() << 32

    def flush() -> pa.RecordBatch:
        vocabulary, inverse, counts = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), dtype=np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        data = pack(vocabulary[order], rank[inverse], np.array([len(x) for x in found]))
        return one_row(BLOCK, number, size, ids, held, data)

    for batch in batches:
        for doc_id, out, text in zip(*batch.columns):
            found.append(tokens(text.as_py()))
            ids.append(doc_id.as_py())
            held.append(out.as_py())
            size += len(found[-1])
            if size >= BLOCK_TOKENS:
                yield flush()
                ids, held, found, size, number = [], [], [], 0, number + 1
    if found:
        yield flush()


def bigrams(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted vocabulary, token numbers, lengths, distinct context * size + word codes, and each token's place among them."""
    vocabulary, numbers, lengths = unpack(row["data"])
    order = np.argsort(vocabulary)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    vocabulary, numbers = vocabulary[order], place[numbers]
    context = np.r_[0, numbers[:-1]]
    context[np.r_[0, np.cumsum(lengths.astype(np.int64))[:-1]]] = np.searchsorted(vocabulary, np.uint64(END))
    codes, place = np.unique(context * len(vocabulary) + numbers, return_inverse=True)
    return vocabulary, numbers, lengths.astype(np.int64), codes, place


def bucket_edges(sorted_hashes: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket begins in sorted hashes, and the end; buckets are ranges of hashes."""
    firsts = (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.empty(0, np.uint64)
    return np.r_[0, np.searchsorted(sorted_hashes, firsts), len(sorted_hashes)]


WORD_COUNT = pa.schema([("word", pa.int64()), ("n", pa.int64())])
PART_SUM = pa.schema([("bucket", pa.int64()), ("lost", pa.float64()), ("covered", pa.float64())])


def frequent_words(least: float):
    """Words with so many tokens in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            vocabulary, numbers, _ = unpack(row["data"])
            counts = np.bincount(numbers.astype(np.int64), minlength=len(vocabulary))
            often = counts >= least
            yield pa.RecordBatch.from_arrays([pa.array(vocabulary[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], schema=WORD_COUNT)

    return run


class Buckets:
    """Buckets of contexts, and after them (from ``own`` on) those of each frequent context's successors."""

    def __init__(self, bits: int, frequent: list[tuple[int, int]]):
        """``frequent``: words (as signed numbers) and their tokens."""
        self.bits, self.own = bits, 1 << bits
        frequent = sorted((w % (1 << 64), n) for w, n in frequent)
        self.words = np.array([w for w, _ in frequent], dtype=np.uint64)
        self.part_bits = np.array([max(1, (-(-2 * n // BUCKET_TOKENS) - 1).bit_length()) for _, n in frequent], dtype=np.int64)
        self.firsts = self.own + np.r_[0, np.cumsum(1 << self.part_bits)].astype(np.int64)

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Which frequent context each is, or -1."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1)

    def of_bigrams(self, vocabulary: np.ndarray, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The bucket of each bigram; context and word are places in the sorted vocabulary."""
        out = np.repeat(np.arange(self.own), np.diff(bucket_edges(vocabulary, self.bits)))[context]
        number = self.number(vocabulary)[context]
        at = np.flatnonzero(number >= 0)
        number = number[at]
        out[at] = self.firsts[number] + (vocabulary[word[at]] >> (64 - self.part_bits[number]).astype(np.uint64)).astype(np.int64)
        return out


def send_bigrams(buckets: Buckets):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            vocabulary, _, lengths, codes, place = bigrams(row)
            train = np.repeat(~np.array(row["held"], dtype=bool), lengths)
            counts = np.bincount(place[train], minlength=len(codes))
            context, word = np.divmod(codes, len(vocabulary))
            target = buckets.of_bigrams(vocabulary, context, word)
            own = np.flatnonzero(target >= buckets.own)
            own = own[np.argsort(target[own], kind="stable")]
            none = np.empty(0, np.int64)
            for at in np.split(own, np.flatnonzero(np.diff(target[own])) + 1) if len(own) else []:
                data = pack(vocabulary[context[at[:1]]], np.array([len(at)]), vocabulary[word[at]], np.arange(len(at)), counts[at], none, none)
                yield one_row(SENT, target[at[0]], row["block"], data)
            frequent = np.flatnonzero(buckets.number(vocabulary) >= 0)
            often = np.bincount(context, weights=counts, minlength=len(vocabulary)).astype(np.int64)[frequent]
            rest = target < buckets.own
            context, word, counts = context[rest], word[rest], counts[rest]
            edges = bucket_edges(vocabulary, buckets.bits)
            cuts, tops = np.searchsorted(context, edges), np.searchsorted(frequent, edges)
            for bucket in range(buckets.own):
                at, top = slice(cuts[bucket], cuts[bucket + 1]), slice(tops[bucket], tops[bucket + 1])
                if edges[bucket] == edges[bucket + 1]:
                    continue
                # every word is a context, if only of the end; of a frequent one only its count is here
                each = np.bincount(context[at] - edges[bucket], minlength=edges[bucket + 1] - edges[bucket])
                used, index = np.unique(word[at], return_inverse=True)
                data = pack(vocabulary[edges[bucket]:edges[bucket + 1]], each, vocabulary[used], index, counts[at], frequent[top] - edges[bucket], often[top])
                yield one_row(SENT, bucket, row["block"], data)

    return run


def count_bucket(table: pa.Table) -> pa.Table:
    """The bucket's bigram table (kind 0), and each block's counts (kind 1)."""
    bucket = table.column("bucket")[0].as_py()
    blocks = table.column("sender").to_pylist()
    sent = [unpack(x.as_py()) for x in table.column("data")]
    contexts = np.unique(np.concatenate([s[0] for s in sent]))
    words = np.unique(np.concatenate([s[2] for s in sent]))
    own = [np.searchsorted(contexts, s[0]) for s in sent]
    codes = np.concatenate([np.repeat(o, s[1].astype(np.int64)) * len(words) + np.searchsorted(words, s[2])[s[3].astype(np.int64)] for o, s in zip(own, sent)])
    distinct, place = np.unique(codes, return_inverse=True)
    totals = np.bincount(place, weights=np.concatenate([s[4] for s in sent]), minlength=len(distinct)).astype(np.int64)
    out, at = [], 0
    for block, o, s in zip(blocks, own, sent):
        out.append((bucket, 1, block, pack(o, s[1], totals[place[at:at + len(s[4])]]), None))
        at += len(s[4])
    seen = totals > 0
    distinct, totals = distinct[seen], totals[seen]
    context, word = np.divmod(distinct, len(words))
    count = np.bincount(context, weights=totals, minlength=len(contexts)).astype(np.int64)
    for o, s in zip(own, sent):
        np.add.at(count, o[s[5].astype(np.int64)], s[6].astype(np.int64))
    each = np.bincount(context, minlength=len(contexts))
    used, index = np.unique(word, return_inverse=True)
    stats = [*np.bincount(count, minlength=LARGEST + 2)[1:LARGEST + 2], *np.bincount(totals, minlength=LARGEST + 2)[1:LARGEST + 2], count.sum(), (count > 0).sum()]
    out.append((bucket, 0, -1, pack(contexts, count, each, words[used], index, totals), [int(x) for x in stats]))
    return table_of(PART, out)


def send_requests(buckets: Buckets, own: bool):
    """A bucket's unigram counts (sender -1) stay; the words it asks for go to their buckets.

    Either frequent contexts' ``own`` buckets ask, or the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            contexts, count, _, words, _, _ = unpack(row["data"])
            if row["bucket"] < buckets.own:
                yield one_row(SENT, row["bucket"], -1, pack(contexts, count))
            if own != (row["bucket"] >= buckets.own):
                continue
            edges = bucket_edges(words, buckets.bits)
            for bucket in range(buckets.own):
                if edges[bucket] < edges[bucket + 1]:
                    yield one_row(SENT, bucket, row["bucket"], pack(words[edges[bucket]:edges[bucket + 1]]))

    return run


def answer(table: pa.Table) -> pa.Table:
    """Counts of the words that other buckets asked for: kind 2, ``block`` is the answering bucket."""
    bucket = table.column("bucket")[0].as_py()
    rows = dict(zip(table.column("sender").to_pylist(), table.column("data").to_pylist()))
    contexts, count = unpack(rows.pop(-1))
    out = []
    for sender, data in rows.items():
        out.append((sender, 2, bucket, pack(count[np.searchsorted(contexts, unpack(data)[0])]), None))
    return table_of(PART, out)


class Discounts:
    """Good-Turing ratios of one order, from the numbers of types seen 1, 2, ... times.

    The smoothed number of types seen r times is proportional to r ** slope,
    by least squares on the logarithms of those that aren't 0.  With a slope
    below -1, all of Katz's ratios lie between 0 and 1.
    """

    def __init__(self, counts_of_counts: list[int]):
        seen = [(np.log(r), np.log(n)) for r, n in enumerate(counts_of_counts[:LARGEST + 1], 1) if n]
        slope = float(np.polyfit(*zip(*seen), 1)[0]) if len(seen) > 1 else DEFAULT_SLOPE
        self.slope = min(slope, MOST_SLOPE)
        ratio = np.ones(LARGEST + 2)
        rest = (LARGEST + 1) ** (self.slope + 1)
        for r in range(1, LARGEST + 1):
            ratio[r] = (((r + 1) / r) ** (self.slope + 1) - rest) / (1 - rest)
        self.ratio = ratio

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        counts = counts.astype(np.int64)
        return counts * self.ratio[np.minimum(counts, LARGEST + 1)]


class Unigrams:
    """Probabilities by training count; ``unseen`` is that of all unseen words together."""

    def __init__(self, counts_of_counts: list[int], total: int, types: int):
        self.discounts, self.total, self.types = Discounts(counts_of_counts), total, types
        r = np.arange(1, LARGEST + 1)
        lost = float((np.array(counts_of_counts[:LARGEST]) * (r - self.discounts(r))).sum())
        self.plain = lost == 0  # nothing is discounted
        self.unseen = 1 / (total + 1) if self.plain else lost / total

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        seen = counts / (self.total + 1) if self.plain else self.discounts(counts) / max(self.total, 1)
        return np.where(counts > 0, seen, self.unseen)


def masses(rows: list[dict], unigrams: Unigrams, discounts: Discounts) -> tuple[np.ndarray, ...]:
    """A bucket's contexts, their counts, what discounting frees and the unigram mass of their successors."""
    contexts, count, each, _, index, totals = unpack(next(r["data"] for r in rows if r["kind"] == 0))
    answers = sorted((r["block"], r["data"]) for r in rows if r["kind"] == 2)
    word_counts = np.concatenate([unpack(d)[0].astype(np.int64) for _, d in answers]) if answers else np.empty(0, np.int64)
    context = np.repeat(np.arange(len(contexts)), each.astype(np.int64))
    covered = np.bincount(context, weights=unigrams(word_counts)[index.astype(np.int64)], minlength=len(contexts))
    lost = np.bincount(context, weights=totals - discounts(totals), minlength=len(contexts))
    # of no rows, bincount gives integers
    return contexts, count, lost.astype(float), covered.astype(float)


def sum_part(unigrams: Unigrams, discounts: Discounts):
    """Masses of one part of a frequent context."""

    def run(table: pa.Table) -> pa.Table:
        _, _, lost, covered = masses(table.to_pylist(), unigrams, discounts)
        return table_of(PART_SUM, [(table.column("bucket")[0].as_py(), float(lost.sum()), float(covered.sum()))])

    return run


def return_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of a frequent context's bigrams go back as they are."""
    none = np.empty(0, np.int64)
    for row in rows_of(batches):
        yield one_row(BACK, row["block"], row["bucket"], pack(none, np.empty(0), none, unpack(row["data"])[2]))


def weigh_bucket(unigrams: Unigrams, discounts: Discounts, buckets: Buckets, more_lost: np.ndarray, more_covered: np.ndarray):
    """For each block: its contexts' counts, backoff weights and whether they are plain, and its bigrams' counts.

    ``more_lost`` and ``more_covered`` are the masses of the frequent contexts.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        contexts, count, lost, covered = masses(rows, unigrams, discounts)
        number = buckets.number(contexts)
        frequent = number >= 0
        lost[frequent], covered[frequent] = more_lost[number[frequent]], more_covered[number[frequent]]
        count = count.astype(np.int64)
        plain = (lost == 0) & (count > 0)
        left = np.where(plain, 1 / (count + 1), lost / np.maximum(count, 1))
        alpha = np.where(count > 0, left / np.maximum(1 - covered, unigrams.unseen), 1.0)
        out = []
        for r in rows:
            if r["kind"] == 1:
                own, each, bigram = unpack(r["data"])
                own = own.astype(np.int64)
                # a weight only where the block has a bigram without a count
                new = np.bincount(np.repeat(np.arange(len(own)), each.astype(np.int64)), weights=bigram == 0, minlength=len(own)) + frequent[own]
                out.append((r["block"], r["bucket"], pack(count[own], np.where(new > 0, alpha[own], 0.0), plain[own].astype(np.uint8), bigram)))
        return table_of(BACK, out)

    return run


def score_block(unigrams: Unigrams, discounts: Discounts, buckets: Buckets):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        row = next(r for r in rows if r["bucket"] is None)
        parts = [unpack(r["data"]) for r in sorted((r for r in rows if r["bucket"] is not None), key=lambda r: r["bucket"])]
        count, alpha, plain, seen = (np.concatenate([p[i] for p in parts]) for i in range(4))
        vocabulary, numbers, lengths, codes, place = bigrams(row)
        count = count.astype(np.int64)
        context, word = np.divmod(codes, len(vocabulary))
        sent = np.argsort(buckets.of_bigrams(vocabulary, context, word), kind="stable")
        back, seen = seen, np.empty(len(codes), np.int64)
        seen[sent] = back
        del sent, back
        direct = np.where(plain[context] > 0, seen / (count[context] + 1), discounts(seen) / np.maximum(count[context], 1))
        p = np.where(seen > 0, direct, alpha[context] * unigrams(count[word]))
        del context, word, direct, codes
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        base = np.log10((count + 0.1) / (unigrams.total + 0.1 * (unigrams.types + 1)))
        sums = [np.add.reduceat(x, starts) for x in ((count > 0).astype(np.int64)[numbers], base[numbers], np.log10(p)[place])]
        n = len(lengths)
        return pa.table([pa.array(x, t.type) for x, t in zip((row["ids"], row["held"], lengths, sums[0], np.full(n, unigrams.total), sums[1], sums[2]), SCORE)], schema=SCORE)

    return run


def score_texts(docs: DataFrame, held_out: Column) -> DataFrame:
    """Scores of each row of ``docs`` (doc_id, text) by a model of the rows that aren't ``held_out``.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score (additive
    unigrams) and score, log10 probabilities of the whole text.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out, F.lit(False)), text_or_empty("text"))
    blocks = stored(rows.mapInArrow(make_blocks, ddl(BLOCK)), "lm-blocks")
    size, number = blocks.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    bits = max(0, -(-size // BUCKET_TOKENS) - 1).bit_length()
    # in all blocks where it has fewer tokens, a word has less than half a bucket's
    often = blocks.select("data").mapInArrow(frequent_words(BUCKET_TOKENS / (2 * max(number, 1))), ddl(WORD_COUNT))
    often = often.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") > BUCKET_TOKENS / 2).collect()
    buckets = Buckets(bits, [tuple(r) for r in often])
    sent = blocks.select("block", "held", "data").mapInArrow(send_bigrams(buckets), ddl(SENT))
    counted = stored(sent.groupBy("bucket").applyInArrow(count_bucket, ddl(PART)), "lm-counts")
    tables = counted.filter("kind = 0")
    stats = tables.select("bucket", F.posexplode("stats"))
    # a frequent context's own buckets count its bigrams only
    stats = stats.filter((F.col("bucket") < buckets.own) | F.col("pos").between(LARGEST + 1, 2 * LARGEST + 1))
    stats = stats.groupBy("pos").agg(F.sum("col").alias("n")).collect()
    stats = [n for _, n in sorted((r["pos"], r["n"]) for r in stats)] or [0] * (2 * LARGEST + 4)
    unigrams = Unigrams(stats[:LARGEST + 1], stats[-2], stats[-1])
    discounts = Discounts(stats[LARGEST + 1:2 * LARGEST + 2])

    def answers(own: bool) -> DataFrame:
        asked = tables.select("bucket", "data").mapInArrow(send_requests(buckets, own), ddl(SENT))
        return asked.groupBy("bucket").applyInArrow(answer, ddl(PART))

    lost, covered = np.zeros(len(buckets.words)), np.zeros(len(buckets.words))
    if often:
        parts = tables.filter(F.col("bucket") >= buckets.own).unionByName(answers(True)).drop("stats")
        for bucket, a, b in sorted(tuple(r) for r in parts.groupBy("bucket").applyInArrow(sum_part(unigrams, discounts), ddl(PART_SUM)).collect()):
            at = np.searchsorted(buckets.firsts, bucket, "right") - 1
            lost[at] += a
            covered[at] += b
    homes = counted.filter(F.col("bucket") < buckets.own).unionByName(answers(False)).drop("stats")
    back = homes.groupBy("bucket").applyInArrow(weigh_bucket(unigrams, discounts, buckets, lost, covered), ddl(BACK))
    if often:
        own_parts = counted.filter((F.col("bucket") >= buckets.own) & (F.col("kind") == 1)).select("bucket", "block", "data")
        back = back.unionByName(own_parts.mapInArrow(return_parts, ddl(BACK)))
    own = blocks.select("block", F.lit(None).cast("long").alias("bucket"), "data", "ids", "held")
    both = own.unionByName(back, allowMissingColumns=True)
    return both.groupBy("block").applyInArrow(score_block(unigrams, discounts, buckets), ddl(SCORE))
