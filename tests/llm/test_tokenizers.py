"""Byte-level BPE and token counts against the public libraries."""

import hashlib
import random
from array import array

import public_tokenizers as P
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from credo.llm import bpe, token_count
from credo.llm.queries import BPE_RANKS, PIECES, op3_byte_bpe, op8_token_counts
from tests.llm.cases import TEXTS, documents, write_documents

RANKS = bpe.rank_file(BPE_RANKS)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def texts():
    rng = random.Random(3)
    pools = ["abcdefghij ", " \n\t\r　▁", "éèñüßabc ", "汉字日本語あ", "😀🎉👩a ", "aaaaab", "0123456789 .,", "<s></s><unk>\x00\x1c ", "thinerandre "]
    made = ["".join(rng.choice(rng.choice(pools) + rng.choice(pools)) for _ in range(rng.choice((3, 10, 40, 200)))) for _ in range(800)]
    return [t for t in TEXTS if t] + made + ["a" * 3000, "the" * 1500, " " * 2500, "▁" * 500, "é" * 1500]


def test_transducer_gives_the_library_ids_for_any_text(library):
    words, split = bpe.encoder(BPE_RANKS), bpe.splitter(P.PATTERN)
    for t in texts():
        assert list(array("I", bpe.encoded(t, words, split))) == library.encode_ordinary(t)


def test_transducer_forgets_without_changing_results(library, monkeypatch):
    monkeypatch.setattr(bpe, "STATES_KEPT", 5)
    monkeypatch.setattr(bpe, "PAIRS_KEPT", 5)
    monkeypatch.setattr(bpe, "WORDS_KEPT", 3)
    words, split = bpe.Words(bpe.Transducer(bpe.Merges(RANKS))), bpe.splitter(P.PATTERN)
    for t in texts()[:60]:
        assert list(array("I", bpe.encoded(t, words, split))) == library.encode_ordinary(t)


def test_neighbours_agree_with_plain_merging():
    merges, rng = bpe.Merges(RANKS), random.Random(4)
    for _ in range(3000):
        a, b = rng.randrange(len(RANKS)), rng.randrange(len(RANKS))
        joined = merges.bytes_of[a] + merges.bytes_of[b]
        assert merges.neighbours(a, b) == (merges.merge(joined, 1 << 60) == [a, b])


def test_utf8_machine_agrees_with_the_library_on_any_ids(library):
    machine, rng = bpe.decoder(BPE_RANKS), random.Random(5)
    for _ in range(2000):
        ids = [rng.randrange(len(RANKS)) if rng.random() < 0.5 else rng.randrange(94, 256) for _ in range(rng.randrange(12))]
        assert machine.decode(ids) == library.decode(ids, errors="replace")
    assert machine.decode([10**9]) == "�"


def test_columns_round_trip(spark):
    docs = documents(spark)
    ids = docs.select("text", bpe.encode(F.col("text"), BPE_RANKS, P.PATTERN).alias("ids"))
    for r in ids.select("text", bpe.decode(F.col("ids"), BPE_RANKS).alias("back")).collect():
        assert r["back"] == (r["text"] or "")


def test_query_byte_bpe(spark, tmp_path, library):
    path = write_documents(spark, tmp_path)
    rows = op3_byte_bpe(spark, path).collect()
    want = []
    for r in documents(spark).collect():
        ids, text = library.encode_ordinary(r["text"] or ""), (r["text"] or "").encode()
        want.append((r["doc_id"], len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)


def test_counts_agree_with_the_library():
    model, known = sentencepiece.SentencePieceProcessor(model_file=PIECES), token_count.counts(PIECES)
    for t in texts():
        parts, newlines = token_count.cut(t)
        found = known.find(set(parts))
        assert newlines + sum(found[p] for p in parts) == len(model.encode(t))


def test_query_token_counts(spark, tmp_path):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    path = write_documents(spark, tmp_path)
    rows = op8_token_counts(spark, path).collect()
    want = [(r["doc_id"], len((r["text"] or "").encode()), n := len(model.encode(r["text"] or "")), n > 4096) for r in documents(spark).collect()]
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)


def test_empty_tables(spark, tmp_path):
    path = write_documents(spark, tmp_path, empty=True)
    assert op3_byte_bpe(spark, path).count() == 0
    assert op8_token_counts(spark, path).count() == 0


def test_a_batch_is_encoded_in_slices(library, monkeypatch):
    """Few texts of an Arrow batch are Python objects at a time, so a worker's memory doesn't grow with the batch."""
    import pyarrow as pa

    class Batch:
        def __init__(self, data):
            self.data, self.taken = data, []

        def __len__(self):
            return len(self.data)

        def slice(self, at, n):
            self.taken.append(n)
            return self.data.slice(at, n)

    monkeypatch.setattr(bpe, "TEXTS_AT_ONCE", 7)
    some = [None, "", *texts()[:60]]
    batch = Batch(pa.array(some, pa.string()))
    out = bpe.encoded_batch(batch, bpe.encoder(BPE_RANKS), bpe.splitter(P.PATTERN))
    assert set(batch.taken) == {7} and len(batch.taken) == 9
    assert [list(array("I", x)) for x in out.to_pylist()] == [library.encode_ordinary(t or "") for t in some]
    assert len(bpe.encoded_batch(pa.array([], pa.string()), bpe.encoder(BPE_RANKS), bpe.splitter(P.PATTERN))) == 0


def test_ids_leave_in_slices(library):
    """A worker doesn't hold the ids of a whole Arrow batch."""
    import pyarrow as pa

    some = [None, "", *texts()[:40], "word and word " * 90_000, *(["some words of a text " * 100] * 1500)]
    out = list(bpe.encoded_slices(pa.array(some, pa.string()), bpe.encoder(BPE_RANKS), bpe.splitter(P.PATTERN)))
    at = 0
    for part in out:
        assert len(part) == 1 or sum(len((t or "").encode()) for t in some[at:at + len(part)]) <= 1 << 20
        at += len(part)
    assert at == len(some) and len(out) == 6
    wanted = {t: library.encode_ordinary(t or "") for t in set(some)}
    assert [list(array("I", x)) for part in out for x in part.to_pylist()] == [wanted[t] for t in some]
    assert not list(bpe.encoded_slices(pa.array([], pa.string()), bpe.encoder(BPE_RANKS), bpe.splitter(P.PATTERN)))
