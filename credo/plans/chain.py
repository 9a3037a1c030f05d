"""The shared front of every flow, on the Spark side and as oracle SQL:

    statements -> normalised labels -> dedup -> binary label (unknown
    dropped) -> split -> training lookups -> features
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from credo.constants import (CS_DEFAULT, CS_UNKNOWN_HUNDREDTHS, CS_WEIGHT_HUNDREDTHS, DEFAULT_CRED_FALLBACK,
                             LABEL_MAP, LEN_STD_EPSILON)
from credo.functions.labels import binary_label, normalize_label
from credo.operators.dedup import deduplicate
from credo.operators.features import feature_table, find_hot
from credo.operators.lookups import all_lookups, lookup_stats
from credo.operators.split import split_hash, split_stratified
from credo.plans import fixtures as fx
from credo.session import scratch_dir
from credo.sources.statements import drop_unknown_observed


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (hash-compared outputs)."""
    # "+ 0.0" turns a rounded -0.0 into 0.0
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c)
                       for c, t in df.dtypes])


def labelled(df: DataFrame) -> DataFrame:
    """Normalised labels -> dedup -> y, unknown labels dropped."""
    d = deduplicate(df.withColumn("label", normalize_label("label")))
    return d.withColumn("y", binary_label("label")).filter(F.col("y").isNotNull())


def labelled_counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """``labelled``, and an observation of n_rows and n_dropped (unknown labels), counted while it is written."""
    d = deduplicate(df.withColumn("label", normalize_label("label"))).withColumn("y", binary_label("label"))
    return drop_unknown_observed(d)


def materialize(spark: SparkSession, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write to a fresh folder under the shared checkpoint dir and read back."""
    path = scratch_dir(spark, name)
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    # columns in their order, and the partition column as the string it was
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


#: Characters of text that a task splits into words.
TASK_CHARS = 4_000_000


def materialize_dealt(spark: SparkSession, df: DataFrame, name: str, text: str, key: str = "row_key") -> DataFrame:
    """``df`` written once, and read back dealt by ``key`` over as many tasks as its texts need.

    Words take some fifty times the memory of the compressed rows that tasks are
    sized by, so what splits texts would hold more the larger the table is.
    Words of a key stay in its task: grouping them moves nothing.
    """
    seen = Observation()
    out = materialize(spark, df.observe(seen, F.sum(F.length(text)).alias("chars")), name)
    return out.repartition(int((seen.get["chars"] or 0) // TASK_CHARS) + 1, key)


@dataclass
class Chain:
    spark: SparkSession
    sf_dir: str
    fixture: str = "f2"
    split: str = "hash"
    _cache: dict = field(default_factory=dict)

    def statements(self) -> DataFrame:
        return getattr(fx, self.fixture)(self.spark, self.sf_dir)

    def labelled(self) -> DataFrame:
        return labelled(self.statements())

    def splitted(self) -> DataFrame:
        if "split" not in self._cache:
            if self.split == "hash":
                self._cache["split"] = split_hash(self.labelled())
            else:
                # the split reads its rows more than once
                self._cache["split"] = split_stratified(materialize(self.spark, self.labelled(), "labelled"))
        return self._cache["split"]

    def train(self) -> DataFrame:
        return self.splitted().filter(F.col("split") == "train")

    def written(self) -> DataFrame:
        """The split table, written once into the shared checkpoint folder."""
        if "written" not in self._cache:
            self._cache["split"] = self._cache["written"] = materialize(self.spark, self.splitted(), "split", "split")
        return self._cache["written"]

    def materialized(self, name: str, df: DataFrame) -> DataFrame:
        return materialize(self.spark, df, name)

    def lookups(self) -> DataFrame:
        """Training lookups, computed once into the shared checkpoint folder.

        The split table is written first, so that the lookups and the rows
        they are joined to read files instead of running dedup + split twice;
        every join branch and the stats subquery read the small lookup table."""
        if "lk" not in self._cache:
            self.written()
            self._cache["lk"] = materialize(self.spark, all_lookups(self.train()), "lookups")
        return self._cache["lk"]

    def default_cred(self) -> DataFrame:
        """One row: the TRUE rate of the training split, without the lookups.

        If nothing else needs the split table, only the columns that decide a row's label and split are moved."""
        rate = F.avg(F.col("y").cast("double"))
        if self.split == "hash" and "split" not in self._cache:
            rows = split_hash(labelled(self.statements().select("row_key", "statement", "label"))).filter(F.col("split") == "train")
        else:
            rows = self.train()
        return rows.agg(F.coalesce(rate, F.lit(DEFAULT_CRED_FALLBACK)).alias("default_cred"))

    def stats(self) -> DataFrame:
        return lookup_stats(self.lookups())

    def hot(self, key_mode: str = "normalized") -> dict[str, list]:
        """Hot keys of the split table."""
        return find_hot(self.written(), key_mode)

    def features(self, key_mode: str = "normalized") -> DataFrame:
        return feature_table(self.written(), self.lookups(), self.stats(), key_mode=key_mode,
                             cs_default=CS_DEFAULT, hot=self.hot(key_mode))


# ---------------------------------------------------------------------------
# Oracle SQL (DuckDB / RE2 dialect)
# ---------------------------------------------------------------------------

WS = ("[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}"
      "\\x{202f}\\x{205f}\\x{3000}]")


def s_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def s_norm_speaker(x: str) -> str:
    return f"regexp_replace({s_strip(f'lower({x})')}, '{WS}+', '-', 'g')"


def s_norm_lower(x: str) -> str:
    return f"lower({s_strip(x)})"


def s_clean(x: str) -> str:
    t = f"coalesce(CAST({x} AS VARCHAR), '')"
    t = f"regexp_replace({t}, '[^\\x00-\\x7F]+', ' ', 'g')"
    t = f"regexp_replace({t}, 'http[^\\t-\\r\\x1c-\\x20]+', '', 'g')"
    t = f"regexp_replace({t}, '[\\t-\\r\\x1c-\\x20]+', ' ', 'g')"
    return f"trim({t})"


def s_y(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} = '{k}' THEN {v}" for k, v in LABEL_MAP.items()) + " END"


def s_w(x: str) -> str:
    return ("CASE " + " ".join(f"WHEN {x} = '{k}' THEN {v}" for k, v in CS_WEIGHT_HUNDREDTHS.items())
            + f" ELSE {CS_UNKNOWN_HUNDREDTHS} END")


def chain_ctes(fixture: str = "f2", split: str = "hash") -> list[tuple[str, str]]:
    """CTEs: norm, a (type A), b (type B), c (y), d (split)."""
    ctes = [
        ("norm", f"SELECT row_key, statement, {s_norm_lower('label')} AS label, speaker_name, "
                 f"speaker_affiliation, statement_context FROM {fixture}"),
        ("a", "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY statement, label "
              "ORDER BY row_key) rn FROM norm) t WHERE rn = 1"),
        ("b", "SELECT * EXCLUDE (lo, hi) FROM (SELECT *, min(label) OVER (PARTITION BY statement) lo, "
              "max(label) OVER (PARTITION BY statement) hi FROM a) t "
              "WHERE statement IS NULL OR lo IS NULL OR lo = hi"),
        ("c", f"SELECT * FROM (SELECT *, {s_y('label')} AS y FROM b) t WHERE y IS NOT NULL"),
    ]
    if split == "hash":
        ctes.append(("d", "SELECT * EXCLUDE (u), CASE WHEN u < '1999999a' THEN 'test' WHEN u < '33333333' "
                          "THEN 'val' ELSE 'train' END AS split FROM (SELECT *, substr(md5(row_key), 1, 8) u FROM c) t"))
    else:
        ctes += stratified_ctes("c", "d")
    return ctes


def stratified_ctes(src: str, out: str, test: float = 0.1, val: float = 0.1) -> list[tuple[str, str]]:
    r2 = repr(float(val) / (1.0 - float(test)))
    return [
        ("sc0", f"SELECT y AS cls, count(*) AS cnt FROM {src} GROUP BY y"),
        ("sc1", f"SELECT *, sum(cnt) OVER () AS total, CAST(ceil({float(test)!r} * sum(cnt) OVER ()) AS BIGINT) AS n_test_all FROM sc0"),
        ("sc2", "SELECT *, floor(cnt / total * (total - n_test_all)) AS fl, "
                "cnt / total * (total - n_test_all) - floor(cnt / total * (total - n_test_all)) AS rem FROM sc1"),
        ("sc3", "SELECT *, CAST(fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, cls) <= "
                "(total - n_test_all) - sum(fl) OVER () THEN 1 ELSE 0 END AS BIGINT) AS trval FROM sc2"),
        ("sc4", f"SELECT cls, trval, cnt - trval AS n_test, sum(trval) OVER () AS total2, "
                f"CAST(ceil({r2} * sum(trval) OVER ()) AS BIGINT) AS n_val_all FROM sc3"),
        ("sc5", "SELECT *, floor(trval / total2 * (total2 - n_val_all)) AS fl, "
                "trval / total2 * (total2 - n_val_all) - floor(trval / total2 * (total2 - n_val_all)) AS rem FROM sc4"),
        ("sc6", "SELECT cls, n_test, trval - CAST(fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, cls) <= "
                "(total2 - n_val_all) - sum(fl) OVER () THEN 1 ELSE 0 END AS BIGINT) AS n_val FROM sc5"),
        (out, f"SELECT * EXCLUDE (rk, cls, n_test, n_val), CASE WHEN rk <= n_test THEN 'test' "
              f"WHEN rk <= n_test + n_val THEN 'val' ELSE 'train' END AS split FROM "
              f"(SELECT s.*, row_number() OVER (PARTITION BY s.y ORDER BY md5(s.row_key), s.row_key) AS rk "
              f"FROM {src} s) r JOIN sc6 ON r.y = sc6.cls"),
    ]


def lookups_ctes(src: str = "d") -> list[tuple[str, str]]:
    """tr (train rows with stripped keys), lk (long lookup table), st (stats)."""
    lk_part = ("SELECT '{kind}' AS kind, {col} AS key, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_true, "
               "CAST(sum(w) AS BIGINT) AS w_sum, sum(y) / count(*) AS cred, sum(w) / (100.0E0 * count(*)) AS cs, "
               "CAST(NULL AS DOUBLE) AS len_mean, CAST(NULL AS DOUBLE) AS len_std FROM tr WHERE {col} IS NOT NULL GROUP BY {col}")
    lk = " UNION ALL ".join(lk_part.format(kind=k, col=c) for k, c in
                            (("speaker", "spk"), ("affiliation", "afl"), ("context", "ctx")))
    lk += (" UNION ALL SELECT 'all', NULL, count(*), CAST(sum(y) AS BIGINT), CAST(sum(w) AS BIGINT), "
           "sum(y) / count(*), sum(w) / (100.0E0 * count(*)), avg(len), "
           f"coalesce(stddev_samp(len), 0) + {LEN_STD_EPSILON!r} FROM tr")
    return [
        ("tr", f"SELECT {s_strip('speaker_name')} AS spk, {s_strip('speaker_affiliation')} AS afl, "
               f"{s_strip('statement_context')} AS ctx, y, {s_w('label')} AS w, "
               f"length(coalesce(statement, '')) AS len FROM {src} WHERE split = 'train'"),
        ("lk", lk),
        ("st", "SELECT n, n_true, cred AS default_cred, len_mean, len_std FROM lk WHERE kind = 'all'"),
    ]


def norm_lookup_cte(name: str = "nlk", src: str = "lk") -> tuple[str, str]:
    nk = (f"CASE kind WHEN 'speaker' THEN {s_norm_speaker('key')} WHEN 'affiliation' THEN {s_norm_lower('key')} "
          f"WHEN 'context' THEN {s_norm_lower('key')} ELSE key END")
    return (name, f"SELECT kind, key, n, n_true, w_sum, n_true / n AS cred, w_sum / (100.0E0 * n) AS cs, len_mean, len_std "
                  f"FROM (SELECT kind, {nk} AS key, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n_true) AS BIGINT) AS n_true, "
                  f"CAST(sum(w_sum) AS BIGINT) AS w_sum, max(len_mean) AS len_mean, max(len_std) AS len_std "
                  f"FROM {src} GROUP BY kind, {nk}) g")


def features_cte(name: str = "ft", src: str = "d", mode: str = "normalized",
                 lk: str = "lk", nlk: str = "nlk") -> tuple[str, str]:
    """Feature table SQL for the three key modes (len_norm from raw text)."""
    use = lk if mode == "raw" else nlk
    norm = mode == "normalized"
    cs_probe = s_norm_speaker("x.speaker_name") if mode != "raw" else s_strip("x.speaker_name")
    spk_probe = s_norm_speaker("x.speaker_name") if norm else s_strip("x.speaker_name")
    afl_probe = s_norm_lower("x.speaker_affiliation") if norm else s_strip("x.speaker_affiliation")
    ctx_probe = s_norm_lower("x.statement_context") if norm else s_strip("x.statement_context")
    sql = (f"SELECT x.*, coalesce(l1.cs, {CS_DEFAULT!r}) AS cs_ratio, l1.key IS NOT NULL AS cs_known, "
           f"coalesce(l2.cred, (SELECT default_cred FROM st)) AS speaker_cred, "
           f"coalesce(l3.cred, (SELECT default_cred FROM st)) AS affil_cred, "
           f"coalesce(l4.cred, (SELECT default_cred FROM st)) AS ctx_cred, "
           f"(length(coalesce(x.statement, '')) - (SELECT len_mean FROM st)) / (SELECT len_std FROM st) AS len_norm "
           f"FROM {src} x "
           f"LEFT JOIN (SELECT * FROM {use} WHERE kind = 'speaker') l1 ON {cs_probe} = l1.key "
           f"LEFT JOIN (SELECT * FROM {use} WHERE kind = 'speaker') l2 ON {spk_probe} = l2.key "
           f"LEFT JOIN (SELECT * FROM {use} WHERE kind = 'affiliation') l3 ON {afl_probe} = l3.key "
           f"LEFT JOIN (SELECT * FROM {use} WHERE kind = 'context') l4 ON {ctx_probe} = l4.key")
    return (name, sql)


def chain_sql(body: str, fixture: str = "f2", split: str = "hash", lookups: bool = False,
              normalized: bool = False, extra: list[tuple[str, str]] | None = None,
              fixtures: tuple[str, ...] = ()) -> str:
    ctes = chain_ctes(fixture, split)
    if lookups or normalized:
        ctes += lookups_ctes("d")
    if normalized:
        ctes.append(norm_lookup_cte())
    ctes += extra or []
    return fx.with_fixtures(body, fixture, *fixtures, extra=ctes)
