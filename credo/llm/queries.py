"""Registered queries of the training-data operators, and their SQL.

Each query reads its whole table, lets the operator of its module do the work
and derives the result columns from the operator's output.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credo.llm import ann, bpe, chat, infill, katz, manifest, merkle, minhash, mixing, pii, quality, repeats, token_count
from credo.llm.common import crc32_fold, text_or_empty

BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

#: The text of conversation -1.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and one with control strings; read them back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = [(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)]
    more = spark.createDataFrame(more, "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(turns.unionByName(more)))


def op2_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document by a model of nine tenths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return katz.score_texts(docs, crc32_fold(F.col("doc_id"), 10) == 0)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; one row for each row of documents."""
    docs = table(spark, sf_dir, "documents")
    both = docs.select("doc_id", bpe.round_trip(text_or_empty("text"), BPE_RANKS, public_tokenizers.PATTERN).alias("both"))
    return both.select(
        "doc_id",
        (F.octet_length("both.ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("both.ids", 256).alias("ids_sha256"),
        F.sha2(F.col("both.text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, group and fate of every document."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("same")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: what the base patterns find, and what contexts add."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows, base, spans = pii.with_spans(docs, ["doc_id"])
    counts = [F.size(pii.of_kind(base, kind)).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return rows.select("doc_id", *counts, F.sha2(pii.written(base).cast("binary"), 256).alias("base_sha256"), pii.written(spans).alias("spans"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, by a model that doesn't see a fifth of the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    held_out = crc32_fold(F.col("doc_id"), quality.FOLDS) == 0
    scored = docs.select("doc_id", held_out.alias("held_out"), quality.score(text_or_empty("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.KEEP_FROM).cast("int"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    rows = merkle.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count the tokens of every document; one row for each row of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty("text").alias("text"))
    counted = docs.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        token_count.count_tokens(F.col("text"), PIECES).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest other vectors of each hundredth one."""
    vectors = table(spark, sf_dir, "embeddings")
    index, centre, turn = ann.build_index(vectors)
    queries = ann.usable(vectors, "vec_id", "embedding").filter(F.col("id") % 100 == 0)
    found = ann.search(index, centre, turn, queries, 10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), F.col("distance").alias("score"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document; one row for each row of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows, names = mixing.repetitions(docs)
    times, size = F.col(names["times"]), F.col(names["size"])
    return rows.select("doc_id", size.alias("size"), F.col(names["source_size"]).alias("source_size"),
                       F.col(names["target"]).alias("target"), (times * size).alias("taken"))


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 400-byte strings that occur twice."""
    docs = repeats.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), "unique")
    spans = F.col("unique.spans")
    removed = F.aggregate(spans, F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["start"])
    return docs.select("doc_id", F.octet_length(text_or_empty("text")).cast("long").alias("n_bytes"), removed.alias("n_removed"),
                       F.size(spans).cast("long").alias("n_spans"), F.sha2("unique.kept", 256).alias("kept_sha256"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, cuts and output of every document, and the text restored from the output."""
    docs = infill.with_infill(table(spark, sf_dir, "documents").select("doc_id", "text"), "infill")
    output, form = F.col("infill.output"), F.col("infill.form")
    return docs.select(
        "doc_id", "infill.n", "infill.form", "infill.prefix_chars", "infill.middle_chars",
        F.sha2(output.cast("binary"), 256).alias("output_sha256"),
        F.sha2(infill.restore(output, form).cast("binary"), 256).alias("restored_sha256"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and verdict of every document; every second text (by crc32) claims to have no line breaks."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(crc32_fold(F.col("doc_id"), 2) == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = manifest.with_proofs(docs, tampered)
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", "").cast("binary"), 256).alias("proof_sha256"),
                       "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_katz_scores, op3_byte_bpe, op4_near_duplicates, op5_personal_data, op6_quality, op7_fingerprints, op8_token_counts, op9_nearest, op10_mix, op11_repeats, op12_fill_in_middle, op13_manifest)}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

#: Near duplicates by comparing all pairs that share a shingle.
SQL_OP4 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {SQL_WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * m >= 75 * (na.n + nb.n - m)
), g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT r.doc_id, g.b FROM r JOIN g ON g.a = r.c),
c AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, n.n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
"""


def _sql_tree(text: str) -> str:
    """List of (section hash, list of (line hash, list of pieces)), as merkle.tree builds it."""
    full = ("list_transform(regexp_extract_all(ln, '" + merkle.PIECES + "', 0), "
            "lambda p: concat(md5(p), lpad(lower(to_hex(length(p))), 2, '0')))")
    line = (f"{{'h': md5(array_to_string({full}, ',')), 'p': list_transform({full}, "
            "lambda f: concat(substr(f, 1, 10), substr(f, 33, 2)))}")
    lines = f"list_transform(string_split(sec, chr(10)), lambda ln: {line})"
    section = f"{{'h': md5(array_to_string(list_transform({lines}, lambda par: par.h), ',')), 'l': {lines}}}"
    return f"list_transform(string_split({text}, chr(10) || chr(10)), lambda sec: {section})"


def _sql_print(tree: str) -> str:
    lines = "array_to_string(list_transform(s.l, lambda par: concat(substr(par.h, 1, 16), '=', array_to_string(par.p, ','))), '|')"
    sections = f"array_to_string(list_transform({tree}, lambda s: concat(substr(s.h, 1, 16), '{{', {lines}, '}}')), '/')"
    return f"concat(sha256(array_to_string(list_transform({tree}, lambda s: s.h), ',')), ':', {sections})"


def _sql_pieces(tree: str) -> str:
    return f"list_distinct(flatten(flatten(list_transform({tree}, lambda s: list_transform(s.l, lambda par: par.p)))))"


def _sql_weight(pieces: str) -> str:
    digit = "(instr('0123456789abcdef', substr(p, {}, 1)) - 1)"
    return f"coalesce(list_sum(list_transform({pieces}, lambda p: 16 * {digit.format(11)} + {digit.format(12)})), 0)"


def _sql_likeness(a: str, b: str) -> str:
    both = f"({_sql_weight(a)} + {_sql_weight(b)})"
    return f"CASE WHEN {both} = 0 THEN 1.0E0 ELSE 2.0E0 * {_sql_weight(f'list_intersect({a}, {b})')} / {both} END"


SQL_OP7 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
x AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER o, first_value(t) OVER o) AS x FROM d
      WINDOW o AS (ORDER BY doc_id NULLS FIRST, t)),
y AS (SELECT *, concat(substr(t, 1, n - n // 2), substr(x, 1, n // 2)) AS e FROM x),
z AS (SELECT doc_id, n, e, {_sql_tree('t')} AS tt, {_sql_tree('e')} AS te, {_sql_tree('x')} AS tx FROM y),
p AS (SELECT doc_id, n, sha256(e) AS h, {_sql_print('tt')} AS f, {_sql_print('te')} AS fe,
      {_sql_pieces('tt')} AS pt, {_sql_pieces('te')} AS pe, {_sql_pieces('tx')} AS px FROM z)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, h AS edited_sha256, f AS fingerprint, fe AS edited_fingerprint,
  {_sql_likeness('pt', 'pe')} AS near_edited, {_sql_likeness('pt', 'px')} AS near_next FROM p
"""

#: The nearest by all distances.
SQL_OP9 = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
), u AS (
  SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1),
    lambda i: (c.e[i] - q.e[i]) * (c.e[i] - q.e[i])), lambda a, b: a + b)) AS score
  FROM u q JOIN u c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

#: Water-filling by sorted limits, and the seeded order as one window.
SQL_OP10 = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len({SQL_WORDS.format("coalesce(text, '')")}) AS BIGINT) AS size,
    md5(concat('{mixing.SEED}:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS draw FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS ss, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM d GROUP BY source
), w AS (SELECT source, ss, {mixing.MAX_EPOCHS} * ss AS lim, CASE k % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END AS w FROM s),
c AS (
  SELECT *, CAST((SELECT sum(ss) FROM w) - (sum(lim) OVER o - lim) AS DOUBLE) / (sum(w) OVER () - (sum(w) OVER o - w)) AS level
  FROM w WINDOW o AS (ORDER BY CAST(lim AS DOUBLE) / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), t AS (
  SELECT source, ss, least(CAST(lim AS DOUBLE), w * (SELECT level FROM c WHERE w * level <= lim ORDER BY CAST(lim AS DOUBLE) / w, source NULLS LAST LIMIT 1)) AS target FROM c
), f AS (SELECT *, CASE WHEN ss > 0 THEN floor(target / ss) ELSE 0 END AS whole FROM t),
x AS (
  SELECT d.doc_id, d.size, f.ss, f.target, f.whole, f.target - f.whole * f.ss AS want,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw) - sum(d.size) OVER (PARTITION BY d.source, d.draw) / 2 AS upto
  FROM d JOIN f ON f.source IS NOT DISTINCT FROM d.source
)
SELECT doc_id, size, ss AS source_size, target,
  CAST(size * (whole + CASE WHEN want > 0 AND upto <= want THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM x
"""

#: All windows of 400 bytes, counted; runs by gaps between windows.
SQL_OP11 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT r, p, md5_number(substr(x, 2 * p + 1, 800)) AS h FROM (SELECT r, x, unnest(range(0, strlen(x) // 2 - 399)) AS p FROM d)),
m AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY h) AS c FROM w) WHERE c > 1),
g AS (SELECT r, p, coalesce(p > lag(p) OVER o + 400, true) AS fresh FROM m WINDOW o AS (PARTITION BY r ORDER BY p)),
s AS (SELECT r, p, sum(CAST(fresh AS BIGINT)) OVER (PARTITION BY r ORDER BY p) AS k FROM g),
u AS (SELECT r, min(p) AS a, max(p) + 400 AS b FROM s GROUP BY r, k),
v AS (SELECT r, list({'a': a, 'b': b} ORDER BY a) AS spans FROM u GROUP BY r),
t AS (SELECT doc_id, x, strlen(x) // 2 AS n, coalesce(spans, []) AS spans FROM d LEFT JOIN v USING (r))
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(list_sum(list_transform(spans, lambda s: s.b - s.a)), 0) AS BIGINT) AS n_removed,
  CAST(len(spans) AS BIGINT) AS n_spans, sha256(unhex(array_to_string(list_transform(range(0, len(spans) + 1),
    lambda i: substr(x, 2 * CASE WHEN i = 0 THEN 0 ELSE spans[i].b END + 1,
      2 * (CASE WHEN i = len(spans) THEN n ELSE spans[i + 1].a END - CASE WHEN i = 0 THEN 0 ELSE spans[i].b END))), ''))) AS kept_sha256
FROM t
"""

#: Cuts by code points, with the draws from the id's digest.
SQL_OP12 = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256(concat('1:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS h FROM documents
), x AS (
  SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST(concat('0x', substr(h, 1, 8)) AS BIGINT) AS h1,
    CAST(concat('0x', substr(h, 9, 8)) AS BIGINT) AS h2, CAST(concat('0x', substr(h, 17, 8)) AS BIGINT) AS h3,
    CAST(concat('0x', substr(h, 25, 8)) AS BIGINT) AS h4 FROM d
), c AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x
), p AS (
  SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle)
    WHEN 'spm' THEN concat('<S>', suffix, '<P>', prefix, '<M>', middle) ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""


def _sql_leaf(text: str) -> str:
    fields = [f"coalesce(concat(strlen(CAST({f} AS VARCHAR)), ':', {f}), '-')" for f in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256(concat({', '.join(fields)}))"


def _sql_levels(name: str, leaves: str) -> str:
    """All nodes (tree, level, idx, h, n) over leaves, level by level."""
    return f"""{name} AS (
  SELECT tree, 0 AS level, idx, h, n FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM {name} WHERE n > 1
  GROUP BY tree, level, idx // 3, n
)"""


_CRC = ("list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: CAST(ascii(c) AS BIGINT))), "
        "lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), "
        "lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))")

#: Trees level by level, proofs and folds leaf by leaf; the lowest bit of crc32 is the complement of that of its register.
SQL_OP13 = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, source, {_sql_leaf('text')} AS leaf,
    CASE WHEN {_CRC} % 2 = 1 THEN {_sql_leaf("replace(text, chr(10), '')")} ELSE {_sql_leaf('text')} END AS claimed FROM documents
), l AS (
  SELECT r, doc_id, leaf AS h, claimed, coalesce(concat('s:', source), 'n') AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM d
), {_sql_levels('low', 'l')},
s AS (
  SELECT tree AS name, 'top' AS tree, h, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1
), {_sql_levels('top', 's')},
nodes AS (SELECT * FROM low UNION ALL SELECT * FROM top),
f AS (
  SELECT r, tree AS own, tree, 0 AS level, idx, n, claimed AS h, '' AS proof FROM l
  UNION ALL
  SELECT r, own, tree, level, idx, n, h, proof FROM (
    SELECT f.r, f.own, f.tree, f.level + 1 AS level, f.idx // 3 AS idx, (f.n + 2) // 3 AS n,
      sha256(string_agg(CASE WHEN x.idx = f.idx THEN f.h ELSE x.h END, '' ORDER BY x.idx)) AS h,
      concat(any_value(f.proof), coalesce(string_agg(x.h, '' ORDER BY x.idx) FILTER (x.idx <> f.idx), '')) AS proof
    FROM f JOIN nodes x ON x.tree = f.tree AND x.level = f.level AND x.idx // 3 = f.idx // 3 WHERE f.n > 1
    GROUP BY f.r, f.own, f.tree, f.level, f.idx, f.n
    UNION ALL
    SELECT f.r, f.own, 'top', 0, s.idx, s.n, f.h, f.proof FROM f JOIN s ON s.name = f.tree WHERE f.n = 1 AND f.tree <> 'top')
)
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, g.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = g.h AS verified
FROM l JOIN f ON f.r = l.r AND f.tree = 'top' AND f.n = 1 JOIN s ON s.name = l.tree JOIN (SELECT h FROM top WHERE n = 1) g ON true
"""

#: Models, tokenizers, greedy windows and bootstrapping are beyond SQL; tests/llm has plain versions.
ORACLE: dict[str, str] = {
    "op4_near_duplicates": SQL_OP4, "op7_fingerprints": SQL_OP7, "op9_nearest": SQL_OP9, "op10_mix": SQL_OP10,
    "op11_repeats": SQL_OP11, "op12_fill_in_middle": SQL_OP12, "op13_manifest": SQL_OP13,
}
