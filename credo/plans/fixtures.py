"""Input fixtures derived from the driver's tables (see FIXTURES.md).

Each fixture exists twice: as a DataFrame built with the DataFrame API (what
the engine runs) and as a SQL text (what the DuckDB oracle runs, inlined as
a CTE).  Both must give the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HEX = "0123456789abcdef"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _hexval(h, i: int):
    """Value 0..15 of the i-th (1-based) hex digit of a md5 string."""
    return F.instr(F.lit(HEX), F.substring(h, i, 1)) - 1


def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements with dirty keys, from documents + labels."""
    d = table(spark, sf_dir, "documents").alias("d")
    lab = table(spark, sf_dir, "labels").alias("l")
    j = d.join(lab, F.col("d.doc_id") == F.col("l.doc_id"))
    doc_id = F.col("d.doc_id")
    label = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0),
               F.when(doc_id % 3 == 0, F.lit(" True"))
               .when(doc_id % 3 == 1, F.lit("mostly-true"))
               .otherwise(F.lit("half-true")))
        .when(F.col("quality") == 1, F.lit("barely-true"))
        .when(F.col("toxic") == 0,
              F.when(doc_id % 11 == 0, F.lit("pants-fire")).otherwise(F.lit("FALSE")))
        .otherwise(F.lit("extremely-false"))
    )
    speaker = (
        F.when(doc_id % 13 == 0, F.lit(None).cast("string"))
        .when(doc_id % 3 == 0, F.replace(F.col("source"), F.lit("src"), F.lit("Source ")))
        .when(doc_id % 3 == 1, F.concat(F.lit(" "), F.replace(F.col("source"), F.lit("src"), F.lit("source-"))))
        .otherwise(F.replace(F.col("source"), F.lit("src"), F.lit("source-")))
    )
    affil = (F.when(doc_id % 17 == 0, F.lit(None).cast("string"))
             .when(doc_id % 2 == 0, F.upper(F.col("lang")))
             .otherwise(F.col("lang")))
    ctx = (F.when(F.col("n_chars") < 500, F.lit("A Short Note"))
           .when(F.col("n_chars") < 2000, F.lit("a press release"))
           .otherwise(F.lit("a campaign speech")))
    return j.select(
        F.concat(F.lit("d"), doc_id.cast("string")).alias("row_key"),
        F.col("text").alias("statement"),
        label.alias("label"),
        speaker.alias("speaker_name"),
        affil.alias("speaker_affiliation"),
        ctx.alias("statement_context"),
    )


def _lineitem_key():
    return F.concat_ws(
        "-",
        F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
        F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
        F.col("l_quantity").cast("int").cast("string"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"),
    )


def f2_from(lineitem: DataFrame, orders: DataFrame, supplier: DataFrame, nation: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """f2 over given (batch or streaming) lineitem and static dimension tables; columns named in ``keep`` are added."""
    j = (lineitem
         .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
         .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
         .join(nation, F.col("s_nationkey") == F.col("n_nationkey")))
    flag = F.concat(F.col("l_returnflag"), F.col("l_linestatus"))
    label = (F.when(flag == "AF", F.lit("true")).when(flag == "AO", F.lit("mostly-true"))
             .when(flag == "NF", F.lit("half-true")).when(flag == "NO", F.lit("barely-true"))
             .when(flag == "RF", F.lit("false")).otherwise(F.lit("extremely-false")))
    speaker = F.when(
        F.col("l_orderkey") % 97 == 0,
        F.concat(F.lit("guest-"), F.col("l_orderkey").cast("string"), F.lit("-"),
                 F.col("l_linenumber").cast("string")),
    ).otherwise(F.col("s_name"))
    return j.select(
        _lineitem_key().alias("row_key"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string"), F.lit(" qty "),
                 F.col("l_quantity").cast("int").cast("string")).alias("statement"),
        label.alias("label"),
        speaker.alias("speaker_name"),
        F.col("n_name").alias("speaker_affiliation"),
        F.col("o_orderpriority").alias("statement_context"),
        *keep,
    )


def f2(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Statements at scale, from lineitem x orders x supplier x nation."""
    return f2_from(
        table(spark, sf_dir, "lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
            "l_extendedprice", "l_returnflag", "l_linestatus"),
        table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"),
        table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"),
        table(spark, sf_dir, "nation").select("n_nationkey", "n_name"),
        keep,
    )


def f2h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f2 with three eighths of its rows on one speaker, and a sixteenth on none."""
    h = F.substring(F.md5(F.col("row_key")), 1, 1)
    speaker = F.when(h < "6", F.lit("The  Chair")).when(h != "6", F.col("speaker_name"))
    return f2(spark, sf_dir).withColumn("speaker_name", speaker)


def f3_from(f2df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Scored rows: probability, features and signed attributions per row; columns named in ``keep`` pass through."""
    h = F.md5(F.col("row_key"))
    y = F.when(F.col("label").isin("true", "mostly-true", "half-true"), F.lit(1)).otherwise(F.lit(0))
    base = f2df.select("row_key", y.alias("y"), h.alias("h"), *keep)
    hv = {i: _hexval(F.col("h"), i) for i in range(1, 12)}
    k = hv[1] * 62 + 4 * hv[2]
    h1, h2, h3, h4, h5, h6, h7, h8, h9 = (hv[i] for i in range(3, 12))
    return base.select(
        "row_key", "y",
        ((F.lit(10) * F.least(F.lit(999), k + 200 * F.col("y")) + 5) / F.lit(10000.0)).alias("prob"),
        (h9 > 3).alias("cs_known"),
        (h1 / F.lit(16.0)).alias("cs_val"),
        ((h2 + 1) / F.lit(20.0)).alias("spk_cred"),
        ((h3 + 1) / F.lit(20.0)).alias("afl_cred"),
        ((h4 + 1) / F.lit(20.0)).alias("ctx_cred"),
        ((h5 - 8) / F.lit(4.0)).alias("len_norm"),
        ((h6 - 7) / F.lit(100.0)).alias("a_cs_ratio"),
        ((h7 - 8) / F.lit(90.0)).alias("a_speaker_cred"),
        ((h8 - 6) / F.lit(80.0)).alias("a_affil_cred"),
        ((h1 - 8) / F.lit(70.0)).alias("a_ctx_cred"),
        ((h2 - 8) / F.lit(60.0)).alias("a_len_norm"),
        *keep,
    )


def f3_joined(f2df: DataFrame, column: str) -> DataFrame:
    """f3's rows joined by row_key with f2's ``column``, and their l_orderkey (give ``f2`` with it kept).

    A row key begins with its order's key, so rows that share one meet inside
    the order: rows stay where the join with the orders put them.
    """
    same = Window.partitionBy("l_orderkey", "row_key")
    rows = f2df.select("row_key", "label", "l_orderkey", F.collect_list(F.struct(column)).over(same).alias("_own"))
    rows = rows.select("row_key", "label", "l_orderkey", F.explode("_own").alias("_own"))
    return f3_from(rows.select("row_key", "label", "l_orderkey", F.col("_own")[column].alias(column)), ("l_orderkey", column))


def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f3_from(f2(spark, sf_dir))


def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-word token scores, one sequence per order (about 4 pieces each)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    # numbers are moved to their order, as digests can't be compressed
    a = li.repartition("l_orderkey").select("l_orderkey", F.md5(_lineitem_key()).alias("h"))
    w = Window.partitionBy("l_orderkey").orderBy("h")
    b = a.select(
        "l_orderkey", "h",
        F.row_number().over(w).cast("bigint").alias("pos"),
        F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")).alias("n"),
    )
    c = _hexval(F.col("h"), 1)
    pos, n = F.col("pos"), F.col("n")
    token = (F.when(pos == 1, F.lit("[CLS]")).when(pos == n, F.lit("[SEP]"))
             .when(c == 0, F.lit("[PAD]"))
             .when(c < 5, F.concat(F.lit("##"), F.substring("h", 4, 2)))
             .otherwise(F.concat(F.lit("w"), F.substring("h", 4, 3))))
    return b.select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("row_key"),
        pos.alias("pos"),
        token.alias("token"),
        ((F.instr(F.lit(HEX), F.substring("h", 2, 1)) - 8) / F.lit(100.0)).alias("score"),
        F.when((c == 0) & (pos > 1) & (pos < n), F.lit(0)).otherwise(F.lit(1)).alias("mask"),
    )


def f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precomputed text vectors (64-d) for the f1 statements."""
    e = table(spark, sf_dir, "embeddings")
    return (f1(spark, sf_dir).select("row_key")
            .join(e, F.col("row_key") == F.concat(F.lit("d"), F.col("vec_id").cast("string")))
            .select("row_key", F.col("embedding").alias("text_vec")))


# ---------------------------------------------------------------------------
# Oracle side: the same fixtures as SQL, to inline as CTEs.
# ---------------------------------------------------------------------------

F1_SQL = """SELECT concat('d', CAST(d.doc_id AS VARCHAR)) AS row_key, d.text AS statement,
  CASE WHEN l.quality = 1 AND l.toxic = 0 THEN
         CASE d.doc_id % 3 WHEN 0 THEN ' True' WHEN 1 THEN 'mostly-true' ELSE 'half-true' END
       WHEN l.quality = 1 THEN 'barely-true'
       WHEN l.toxic = 0 THEN CASE WHEN d.doc_id % 11 = 0 THEN 'pants-fire' ELSE 'FALSE' END
       ELSE 'extremely-false' END AS label,
  CASE WHEN d.doc_id % 13 = 0 THEN NULL
       WHEN d.doc_id % 3 = 0 THEN replace(d.source, 'src', 'Source ')
       WHEN d.doc_id % 3 = 1 THEN concat(' ', replace(d.source, 'src', 'source-'))
       ELSE replace(d.source, 'src', 'source-') END AS speaker_name,
  CASE WHEN d.doc_id % 17 = 0 THEN NULL WHEN d.doc_id % 2 = 0 THEN upper(d.lang) ELSE d.lang END AS speaker_affiliation,
  CASE WHEN d.n_chars < 500 THEN 'A Short Note' WHEN d.n_chars < 2000 THEN 'a press release' ELSE 'a campaign speech' END AS statement_context
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""

LINEITEM_KEY_SQL = ("concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), "
                    "CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), "
                    "CAST(CAST(l_quantity AS INT) AS VARCHAR), "
                    "CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR))")

F2_SQL = f"""SELECT {LINEITEM_KEY_SQL} AS row_key,
  concat('part ', CAST(l_partkey AS VARCHAR), ' qty ', CAST(CAST(l_quantity AS INT) AS VARCHAR)) AS statement,
  CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'true' WHEN 'AO' THEN 'mostly-true' WHEN 'NF' THEN 'half-true'
       WHEN 'NO' THEN 'barely-true' WHEN 'RF' THEN 'false' ELSE 'extremely-false' END AS label,
  CASE WHEN l_orderkey % 97 = 0 THEN concat('guest-', CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR)) ELSE s_name END AS speaker_name,
  n_name AS speaker_affiliation, o_orderpriority AS statement_context
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"""


def _hx(i: int) -> str:
    return f"(instr('{HEX}', substr(h, {i}, 1)) - 1)"


F3_SQL = f"""SELECT row_key, y, (10 * least(999, k + 200 * y) + 5) / 10000.0E0 AS prob, h9 > 3 AS cs_known, h1 / 16.0E0 AS cs_val,
  (h2 + 1) / 20.0E0 AS spk_cred, (h3 + 1) / 20.0E0 AS afl_cred, (h4 + 1) / 20.0E0 AS ctx_cred, (h5 - 8) / 4.0E0 AS len_norm,
  (h6 - 7) / 100.0E0 AS a_cs_ratio, (h7 - 8) / 90.0E0 AS a_speaker_cred, (h8 - 6) / 80.0E0 AS a_affil_cred,
  (h1 - 8) / 70.0E0 AS a_ctx_cred, (h2 - 8) / 60.0E0 AS a_len_norm
FROM (SELECT row_key, CASE WHEN label IN ('true', 'mostly-true', 'half-true') THEN 1 ELSE 0 END AS y,
  {_hx(1)} * 62 + 4 * {_hx(2)} AS k,
  {_hx(3)} AS h1, {_hx(4)} AS h2, {_hx(5)} AS h3, {_hx(6)} AS h4, {_hx(7)} AS h5,
  {_hx(8)} AS h6, {_hx(9)} AS h7, {_hx(10)} AS h8, {_hx(11)} AS h9
  FROM (SELECT row_key, label, md5(row_key) AS h FROM f2) s) t"""

F4_SQL = f"""SELECT row_key, pos, CASE WHEN pos = 1 THEN '[CLS]' WHEN pos = n THEN '[SEP]' WHEN c = 0 THEN '[PAD]'
    WHEN c < 5 THEN concat('##', substr(h, 4, 2)) ELSE concat('w', substr(h, 4, 3)) END AS token,
  (instr('{HEX}', substr(h, 2, 1)) - 8) / 100.0E0 AS score,
  CASE WHEN c = 0 AND pos > 1 AND pos < n THEN 0 ELSE 1 END AS mask
FROM (SELECT concat('o', CAST(l_orderkey AS VARCHAR)) AS row_key, pos, n, h, instr('{HEX}', substr(h, 1, 1)) - 1 AS c
  FROM (SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY md5(k)) AS BIGINT) AS pos,
               count(*) OVER (PARTITION BY l_orderkey) AS n, md5(k) AS h
    FROM (SELECT l_orderkey, {LINEITEM_KEY_SQL} AS k FROM lineitem) a) b) c"""

F5_SQL = ("SELECT f1.row_key, e.embedding AS text_vec FROM f1 JOIN embeddings e "
          "ON f1.row_key = concat('d', CAST(e.vec_id AS VARCHAR))")

F2H_SQL = ("SELECT * REPLACE (CASE WHEN substr(md5(row_key), 1, 1) < '6' THEN 'The  Chair' "
           "WHEN substr(md5(row_key), 1, 1) <> '6' THEN speaker_name END AS speaker_name) FROM f2")

FIXTURE_SQL = {"f1": F1_SQL, "f2": F2_SQL, "f2h": F2H_SQL, "f3": F3_SQL, "f4": F4_SQL, "f5": F5_SQL}
FIXTURE_DEPS = {"f1": [], "f2": [], "f2h": ["f2"], "f3": ["f2"], "f4": [], "f5": ["f1"]}


def with_fixtures(body: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with a WITH clause defining the named fixtures (and
    their dependencies) followed by any extra (name, sql) CTEs."""
    order: list[str] = []

    def add(n: str) -> None:
        for dep in FIXTURE_DEPS[n]:
            add(dep)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({FIXTURE_SQL[n]})" for n in order]
    ctes += [f"{n} AS ({sql})" for n, sql in (extra or [])]
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + "\n" + body


def register_fixture_views(spark: SparkSession, sf_dir: str) -> list[str]:
    """Temp views f1..f5 (and the driver's tables) for SQL users."""
    names = []
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
              "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        table(spark, sf_dir, t).createOrReplaceTempView(t)
        names.append(t)
    for n, fn in (("f1", f1), ("f2", f2), ("f3", f3), ("f4", f4), ("f5", f5)):
        fn(spark, sf_dir).createOrReplaceTempView(n)
        names.append(n)
    return names
