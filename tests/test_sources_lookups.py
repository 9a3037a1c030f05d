import os
import tempfile

from pyspark.sql import functions as F

from credo.operators.features import feature_table
from credo.operators.lookups import all_lookups, lookup_stats, normalize_lookup
from credo.sources.statements import load_statements
from tests.conftest import rows


def test_csv_reader_names_labels_and_na(spark):
    d = tempfile.mkdtemp(prefix="credo-csv-")
    p = os.path.join(d, "s.csv")
    with open(p, "w") as f:
        f.write(' Row_Key ,Statement,LABEL,speaker_name\n'
                'r1,"multi\nline",  TRUE ,NA\n'
                'r2,x,false,null\n'
                'r3,,half-true,none\n')
    df = load_statements(spark, p)
    assert df.columns == ["row_key", "statement", "label", "speaker_name"]
    assert rows(df) == [("r1", "multi\nline", "true", None), ("r2", "x", "false", None),
                        ("r3", None, "half-true", "none")]


SCHEMA = "row_key string, statement string, label string, y int, speaker_name string, " \
         "speaker_affiliation string, statement_context string"


def test_collision_policies(spark):
    df = spark.createDataFrame([
        ("1", "a", "true", 1, "Jane Doe", "Dem", "tv"),
        ("2", "b", "false", 0, "jane doe", "dem", "TV"),
        ("3", "c", "false", 0, "jane doe", "dem", "tv"),
    ], SCHEMA)
    lk = all_lookups(df)
    merged = {(r["kind"], r["key"]): r["cred"] for r in normalize_lookup(lk, "merge").collect()}
    assert merged[("speaker", "jane-doe")] == 1 / 3
    last = {(r["kind"], r["key"]): r["cred"] for r in normalize_lookup(all_lookups(df, strip=False), "last").collect()}
    assert last[("speaker", "jane-doe")] == 0.0  # 'jane doe' > 'Jane Doe'


def test_hot_speaker_join_is_exact(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # force the shuffle join path
    try:
        data = [(f"h{i}", f"s{i}", "true" if i % 3 else "false", 1 if i % 3 else 0, "hot", "x", "c")
                for i in range(3000)]
        data += [(f"c{i}", f"t{i}", "false", 0, f"cold{i % 50}", "y", "c") for i in range(6000)]
        df = spark.createDataFrame(data, SCHEMA)
        lk = all_lookups(df)
        out = feature_table(df, lk, lookup_stats(lk))
        salted = feature_table(df, lk, lookup_stats(lk), salts=8)
        cols = ["row_key", "cs_ratio", "cs_known", "speaker_cred", "affil_cred", "ctx_cred", "len_norm"]
        assert rows(salted.select(*cols)) == rows(out.select(*cols))
        hot = out.filter(F.col("speaker_name") == "hot").select("speaker_cred", "cs_ratio").distinct().collect()
        assert len(hot) == 1
        assert abs(hot[0]["speaker_cred"] - 2000 / 3000) < 1e-12
        assert out.count() == 9000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cluster_conf_sizes_partitions():
    from credo.session import cluster_conf

    c = cluster_conf(100 * (1 << 40), 8000)
    assert int(c["spark.sql.shuffle.partitions"]) == 100 * (1 << 40) // (256 << 20) + 1
    assert int(cluster_conf(1 << 20, 8)["spark.sql.shuffle.partitions"]) == 16


def test_write_predictions_round_trip(spark):
    from credo.plans import fixtures as fx
    from credo.session import scratch_dir
    from credo.sources.sinks import predictions, write_predictions
    from tests.conftest import SF0001

    pred = predictions(fx.f3(spark, SF0001), 0.57)
    path = scratch_dir(spark, "t-pred")
    write_predictions(pred, path)
    back = spark.read.parquet(path)
    assert back.count() == 6000 and rows(back) == rows(pred)


def test_csv_without_key_keeps_first_in_file_order(spark):
    from credo.operators.dedup import deduplicate

    d = tempfile.mkdtemp(prefix="credo-csv-")
    p = os.path.join(d, "s.csv")
    with open(p, "w") as f:
        f.write("statement,label,speaker_name\n")
        for i in range(30):
            f.write(f"same,true,speaker{30 - i}\n")
        f.write("other,false,x\n")
    df = load_statements(spark, p)
    assert df.columns[0] == "row_key" and df.select("row_key").distinct().count() == 31
    kept = rows(deduplicate(df), "statement", "speaker_name")
    assert kept == [("other", "x"), ("same", "speaker30")]
