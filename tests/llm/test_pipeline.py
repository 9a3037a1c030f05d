"""The corpus pipeline end to end, and the registry."""

import random

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from credo.llm import bpe, quality
from credo.llm.queries import BPE_RANKS
from tests.llm.cases import documents, with_extra
from tests.llm.test_near_duplicates import groups


def corpus(spark, folder):
    """Good documents, junk, near copies and personal data."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    rows, labels = [], []
    for i in range(160):
        text = [word() for _ in range(rng.randrange(30, 90))]
        if i % 5 == 0:
            text[5:] = [w.upper() + "!!" for w in text[5:]]
        elif i % 11 == 3:
            text[7] = "ab.c@example.org"
        rows.append((i, " ".join(text), "en", f"s{i % 4}", 0))
        labels.append((i, int(i % 5 != 0), 0))
        if i % 7 == 2:
            text[-1] = word()
            rows.append((1000 + i, " ".join(text), "en", f"s{i % 3}", 0))
    rows += [(3000, None, None, None, None), (3001, "", "en", "s1", 0), (None, "no id here", "en", "s1", 0)] + rows[3:5]
    with_extra(spark.createDataFrame(rows, documents(spark).schema)).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages_take_effect(spark, tmp_path):
    rows = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mixing", "encoding"]
    seen = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if n < 4:
            assert out.columns == names
        out.write.parquet(f"{tmp_path}/out-{n}")
        docs = spark.read.parquet(f"{tmp_path}/out-{n}")
        seen[name] = docs.collect()
    junk = {r[0] for r in rows if r[0] is not None and r[0] < 1000 and r[0] % 5 == 0}
    kept = {r["doc_id"] for r in seen["quality"]}
    assert not kept & junk
    assert kept >= {r[0] for r in rows if r[0] is not None and r[0] < 160 and r[0] % 5}
    named = dict((r["doc_id"], r["text"]) for r in seen["quality"] if r["doc_id"] is not None)
    heads = {g for i, g in groups(list(named.items())).items()}
    assert sorted(r["doc_id"] for r in seen["near_duplicates"] if r["doc_id"] is not None) == sorted(heads)
    for r in seen["personal_data"]:
        assert "@" not in (r["text"] or "") and r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    assert any("<EMAIL>" in (r["text"] or "") for r in seen["personal_data"])
    assert {r["doc_id"] for r in seen["mixing"]} <= {r["doc_id"] for r in seen["personal_data"]}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.rank_file(BPE_RANKS), special_tokens={})
    texts = {r["doc_id"]: r["text"] or "" for r in seen["mixing"]}
    assert len(seen["encoding"]) == len(seen["mixing"])
    for r in seen["encoding"]:
        assert r["n_tokens"] == len(library.encode_ordinary(texts[r["doc_id"]]))
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, whole), key=repr) == sorted(map(tuple, seen["encoding"]), key=repr)


def test_stages_take_empty_and_awkward_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for empty in (True, False):
        docs = with_extra(documents(spark, empty))
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            out.write.parquet(f"{tmp_path}/{empty}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{empty}-{name}")
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()
    assert quality.KEEP_FROM == 0.3


def test_registry_has_the_queries():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
