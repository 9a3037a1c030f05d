"""How often rows are moved, and that moving them less gives the same rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from credo.operators.dedup import dedup_contradictory, dedup_exact, deduplicate
from credo.plans import catalog
from credo.plans import fixtures as fx
from credo.plans.chain import Chain
from tests.conftest import SF0001
from tests.test_plan_shapes import plan_of


def moves(df) -> int:
    return plan_of(df).count("Exchange hashpartitioning")


def test_deduplicate_is_its_two_steps_in_one_shuffle(spark):
    rng = random.Random(5)
    data = [(rng.choice([None, *"abcdefgh"]), rng.choice([None, "true", "true", "true", "false"]), rng.choice([None, f"k{i}", f"k{i // 2}"]),
             rng.choice([None, "s", "t"])) for i in range(60)]
    df = spark.createDataFrame(data, "statement string, label string, row_key string, speaker_name string")
    assert moves(deduplicate(df)) == 1
    got = deduplicate(df)
    assert got.columns == df.columns
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, dedup_contradictory(dedup_exact(df)).collect()), key=key)


def test_default_rate_moves_no_keys_of_lookups(spark):
    narrow, full = Chain(spark, SF0001), Chain(spark, SF0001)
    full.splitted()
    assert narrow.default_cred().first() == full.default_cred().first()
    assert "o_orderpriority" in plan_of(full.default_cred())
    assert "o_orderpriority" not in plan_of(Chain(spark, SF0001).default_cred())


def test_evaluation_scores_once(spark):
    from credo.plans.evaluation import evaluate
    from credo.sources.statements import normalize_statements

    _, art = catalog._given_artifacts(spark, SF0001)
    out = evaluate(normalize_statements(fx.f2(spark, SF0001)), art, split="test")
    for name in ("scored", "predictions", "report", "confusion"):
        assert "speaker" not in plan_of(out[name])


def _lines(spark, *rows_):
    return spark.createDataFrame(rows_, "l_orderkey long, row_key string, label string, statement string, speaker_affiliation string")


def test_rows_meet_those_of_their_key(spark):
    f2 = _lines(spark, (1, "1-1", "true", "a", "X"), (1, "1-1", "false", None, "Y"), (1, "1-2", "true", "c", None), (-7, "-7-1", None, "d", "X"))
    joined = fx.f3_joined(f2, "statement")
    assert joined.count() == 6
    plain = fx.f3_from(f2).join(f2.select("row_key", "statement"), "row_key")
    text = lambda df: sorted(str(r) for r in df.select(*plain.columns).collect())
    assert text(joined) == text(plain)


@pytest.mark.parametrize("name", ["metrics_by_group", "rule_based_explanation", "explanation_prompt"])
def test_no_shuffle_by_row_key(spark, name):
    """Rows with a key meet in their order, with broadcasts off as for large tables."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(catalog.QUERIES[name](spark, SF0001))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    keys = re.findall(r"hashpartitioning\(([a-z_]+)#\d+L?, \d+\)", plan)
    assert "l_orderkey" in keys and "_order" not in keys
    assert name != "metrics_by_group" or "row_key" not in keys


def test_words_of_an_order(spark, tmp_path):
    """An order's words go to all its rows; a negative order's name is not before the first dash."""
    import shutil
    from pathlib import Path

    for t in ("supplier", "nation"):
        shutil.copyfile(f"{SF0001}/{t}.parquet", tmp_path / f"{t}.parquet")
    some = spark.read.parquet(f"{SF0001}/lineitem.parquet").filter("l_orderkey < 40")
    both = some.unionByName(some.limit(3)).unionByName(some.withColumn("l_orderkey", -F.col("l_orderkey")).limit(20))
    both.write.parquet(str(tmp_path / "lineitem.parquet"))
    o = spark.read.parquet(f"{SF0001}/orders.parquet").filter("o_orderkey < 40")
    o.unionByName(o.withColumn("o_orderkey", -F.col("o_orderkey"))).write.parquet(str(tmp_path / "orders.parquet"))
    sf = str(Path(tmp_path))
    out = [tuple(r) for r in catalog.rule_based_explanation(spark, sf).select("row_key", "top_words").collect()]
    f2 = fx.f2(spark, sf)
    words = {r["row_key"]: r["top_words"] for r in catalog.at.words_list(catalog._top_f4(spark, sf)).collect()}
    want = [(r[0], words.get("o" + r[0].split("-")[0])) for r in
            f2.select("row_key").join(f2.select("row_key"), "row_key").collect()]
    as_text = lambda xs: sorted(map(str, xs))
    assert as_text(out) == as_text(want)
    assert any(k.startswith("-") for k, _ in out)


def test_evidence_code_is_short_enough_to_compile(spark):
    """The JVM leaves methods of more than 8,000 bytes of code uncompiled."""
    from credo.operators.explain import evidence_lines

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = evidence_lines(fx.f3(spark, SF0001), F.lit(0.4))
        parts = out._jdf.queryExecution().debug().codegenToSeq()
        sizes = [parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes and max(sizes) < 8000


@pytest.mark.parametrize("name", ["explanation_prompt", "score_requests"])
def test_explanation_code_is_short_enough_to_compile(spark, name):
    from credo.plans.scoring import score_requests

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        if name == "score_requests":
            out = score_requests(fx.f2(spark, SF0001), catalog._given_artifacts(spark, SF0001)[1])
        else:
            out = catalog.explanation_prompt(spark, SF0001)
        parts = out._jdf.queryExecution().debug().codegenToSeq()
        sizes = [parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes and max(sizes) < 8000


def test_evidence_lines_of_odd_rows(spark):
    """Ranks that several features share (NULL attributions) and rows with few kept features: as ``evidence_lines`` has them."""
    from credo.operators.explain import evidence_lines, with_evidence

    rng = random.Random(3)
    number = lambda: rng.choice([None, 0.0, 0.5, -0.5, 0.325, 2.675, rng.random(), -rng.random()])
    names = ["cs_val", "spk_cred", "afl_cred", "ctx_cred", "len_norm", "a_cs_ratio", "a_speaker_cred", "a_affil_cred", "a_ctx_cred", "a_len_norm"]
    data = [(f"r{i}", rng.choice([None, True, False]), *(number() for _ in names)) for i in range(300)]
    df = spark.createDataFrame(data, f"row_key string, cs_known boolean, {', '.join(f'{n} double' for n in names)}")
    want = {(r["row_key"], r["rank"]): (r["feature"], r["score"], r["line"]) for r in evidence_lines(df, 0.4).collect()}
    got = {(r["row_key"], k): (r[f"ev{k}_feature"], r[f"ev{k}_score"], r[f"ev{k}_line"])
           for r in with_evidence(df, 0.4).collect() for k in (1, 2, 3) if r[f"ev{k}_feature"] is not None}
    assert got == want


def test_tokens_are_moved_once_and_as_numbers(spark):
    """Both readers of an order's pieces read one shuffle of the line numbers, without digests."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # reuse is planned, not found while it runs
    try:
        plan = plan_of(catalog._merged_f4(spark, SF0001))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning(l_orderkey") - plan.count("ReusedExchange [l_orderkey") <= 1
    lines = plan.split("\n")
    at = next(i for i, x in enumerate(lines) if "Exchange hashpartitioning(l_orderkey" in x and "Reused" not in x)
    assert "md5" not in "\n".join(lines[at:at + 4])
