"""Evidence lines, prompt text and rule-based explanations, as columns.

The five numeric features of a row are ranked inside the row (an array of
five structs, sorted) -- no shuffle, whatever the table size.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credo.constants import EVIDENCE_LINES, FEATURE_NAMES, SPEAKER_CRED_SKIP_BAND
from credo.functions.scoring import confidence_pct, decide, length_bucket

# --- fixed values: sentence templates --------------------------------------
CS_LINE = "the speaker's falsehood score is %.2f/1.0 (%s)"
SPK_LINE = "this speaker has been truthful %.0f%% of the time historically (%s)"
AFL_LINE = "this speaker's political affiliation has a %.0f%% truthfulness rate (%s)"
CTX_LINE = "statements made in this context are true %.0f%% of the time (%s)"
LEN_LINE = "the statement is %s (%s)"
VERDICT = "This statement is likely %s (confidence: %s%%)."
WORDS = "The words most associated with this decision were: %s."
PROMPT_HEAD = (
    "You are explaining a political fact-checking decision. "
    "You ONLY have access to the evidence listed below. "
    "Do NOT use any external knowledge or verify the claim yourself.\n\n"
)
PROMPT_TAIL = (
    "\n\n"
    "Write a 2-3 sentence explanation for a general audience.\n"
    "Strict rules:\n"
    "- Plain text only. No Markdown, no headers, no bold, no bullet points.\n"
    "- Do NOT verify the statement or use any external knowledge.\n"
    "- ONLY explain what the evidence above suggests about why it is likely %s.\n"
    "- No technical terms (no 'model', 'AI', 'algorithm', 'attribution').\n"
    "- Be direct but acknowledge uncertainty where appropriate."
)
LINE_PREFIX = "   - "

# feature -> (value column, attribution column)
FEATURE_COLUMNS = {
    "cs_ratio": ("cs_val", "a_cs_ratio"),
    "speaker_cred": ("spk_cred", "a_speaker_cred"),
    "affil_cred": ("afl_cred", "a_affil_cred"),
    "ctx_cred": ("ctx_cred", "a_ctx_cred"),
    "len_norm": ("len_norm", "a_len_norm"),
}


def direction(score: Column) -> Column:
    return F.when(score > 0, F.lit("supports TRUE")).otherwise(F.lit("supports FALSE"))


def _rounded(v: Column, digits: int) -> Column:
    """``v`` rounded as printf does: by its exact binary value, half-even on true ties.

    ``bround`` decides by the shortest decimal form, in which 0.325 is a tie
    though its binary value lies above.  At such a form the exact distance
    from the tie decides: 2 * 10^digits * v is computed without error from
    two halves of v's bits.
    """
    if digits == 0:
        return F.bround(v, 0)
    half = 2.0 * 10 ** digits
    units = F.round(v * half)
    upper = v * 8193.0 - (v * 8193.0 - v)
    off = (upper * half - units) + (v - upper) * half
    tie = (F.pmod(units, F.lit(2.0)) == 1) & (F.abs(v * half - units) < 1e-9)
    return F.bround(F.when(tie & (off != 0), (units + F.signum(off)) / half).otherwise(v), digits)


def _fmt(spec: str, v: Column) -> Column:
    """'%.2f' / '%.0f' as printf writes them, '%s' as text (no Formatter)."""
    if spec == "%s":
        return v.cast("string")
    digits = int(spec[2:-1])
    return _rounded(v, digits).cast(f"decimal(24,{digits})").cast("string")


def fill(template: str, *values: Column) -> Column:
    """Fill a printf-style template (%s, %.Nf, %%) with columns, as one
    codegen-friendly ``concat``."""
    parts, vals, pos = [], list(values), 0
    for m in re.finditer(r"%%|%s|%\.\d+f", template):
        lit = template[pos:m.start()]
        if m.group() == "%%":
            parts.append(F.lit(lit + "%"))
        else:
            if lit:
                parts.append(F.lit(lit))
            parts.append(_fmt(m.group(), vals.pop(0)))
        pos = m.end()
    if template[pos:]:
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


LINES = dict(zip(FEATURE_NAMES, (CS_LINE, SPK_LINE, AFL_LINE, CTX_LINE, LEN_LINE)))


def _by_feature(at: Column, values) -> Column:
    """The value of the feature whose position is ``at``; NULL where that is NULL."""
    out = None
    for i, v in enumerate(values):
        out = F.when(at == i, v) if out is None else out.when(at == i, v)
    return out


def _pieces(template: str) -> list[str]:
    """The fixed texts around a template's placeholders."""
    return [x.replace("%%", "%") for x in re.split(r"%s|%\.\d+f", template)]


def _score_at(at: Column) -> Column:
    return _by_feature(at, (F.col(FEATURE_COLUMNS[f][1]) for f in FEATURE_NAMES))


def _line_at(at: Column, score: Column) -> Column:
    """The sentence of the feature at ``at``.

    Numbers are formatted once for all features that share a format: code with
    every sentence spelled out is too long for the JVM to compile."""
    val = {f: F.col(c) for f, (c, _) in FEATURE_COLUMNS.items()}
    shares = [n for n in FEATURE_NAMES if "%.0f" in LINES[n]]
    share = _fmt("%.0f", _by_feature(at, (val[n] if n in shares else F.lit(None).cast("double") for n in FEATURE_NAMES)) * 100)
    shown = F.when(at == FEATURE_NAMES.index("cs_ratio"), _fmt("%.2f", val["cs_ratio"])).when(
        at == FEATURE_NAMES.index("len_norm"), length_bucket(val["len_norm"])).otherwise(share)
    before, between, after = zip(*(_pieces(LINES[n]) for n in FEATURE_NAMES))
    return F.concat(_by_feature(at, map(F.lit, before)), shown, _by_feature(at, map(F.lit, between)), direction(score),
                    _by_feature(at, map(F.lit, after)))


def _skip(feature: str, default_cred) -> Column:
    dc = default_cred if isinstance(default_cred, Column) else F.lit(float(default_cred))
    if feature == "cs_ratio":
        return ~F.coalesce(F.col("cs_known"), F.lit(True))
    if feature == "speaker_cred":
        return F.abs(F.col("spk_cred") - dc) < F.lit(SPEAKER_CRED_SKIP_BAND)
    return F.lit(False)


def _ranks(default_cred) -> list[Column]:
    """Rank (1 = strongest |attribution|) of each kept feature, NULL when
    skipped; ties keep the feature order.  Plain comparisons, codegen'd."""
    kept = [~_skip(f, default_cred) for f in FEATURE_NAMES]
    mag = [F.abs(F.col(FEATURE_COLUMNS[f][1])) for f in FEATURE_NAMES]
    ranks = []
    for i in range(len(FEATURE_NAMES)):
        ahead = F.lit(1)
        for j in range(len(FEATURE_NAMES)):
            if j == i:
                continue
            before = (mag[j] > mag[i]) | ((mag[j] == mag[i]) & F.lit(j < i))
            ahead = ahead + F.when(kept[j] & before, 1).otherwise(0)
        ranks.append(F.when(kept[i], ahead))
    return ranks


def _picked(df: DataFrame, default_cred, k: int) -> DataFrame:
    """Add _f{r}, the position of the feature of rank r = 1..k (NULL when fewer
    than r features are kept).  The five ranks are computed once as columns."""
    names = [f"_rk{i}" for i in range(len(FEATURE_NAMES))]
    ranked = df.select("*", *[r.alias(n) for n, r in zip(names, _ranks(default_cred))])
    picks = []
    for r in range(1, k + 1):
        pick = None
        for i, n in enumerate(names):
            hit = F.col(n) == r
            pick = F.when(hit, F.lit(i)) if pick is None else pick.when(hit, F.lit(i))
        picks.append(pick.alias(f"_f{r}"))
    return ranked.select("*", *picks).drop(*names)


def _shown(feature: str) -> Column:
    """The value of a feature as its sentence shows it."""
    value = F.col(FEATURE_COLUMNS[feature][0])
    if feature == "len_norm":
        return length_bucket(value)
    return _fmt("%.0f", value * 100) if "%.0f" in LINES[feature] else _fmt("%.2f", value)


def with_evidence(df: DataFrame, default_cred, k: int = EVIDENCE_LINES) -> DataFrame:
    """Add ev{r}_feature, ev{r}_score, ev{r}_line for r = 1..k (NULL when
    fewer than r features are kept); only the chosen lines are ever built.

    A chosen feature's value and sentence are built once, under the feature, and
    then taken by its rank.  Whole-stage code puts steps in a row into one method,
    and the JVM leaves methods of more than 8,000 bytes uncompiled; the step with
    the lambda is not part of it, and has as many methods as it needs."""
    at = range(len(FEATURE_NAMES))
    rank = [F.col(f"_rk{i}") for i in at]
    out = df.select("*", *[r.alias(f"_rk{i}") for i, r in enumerate(_ranks(default_cred))])
    out = out.withColumns({"_shown": F.array(*[F.when(rank[i] <= k, _shown(f)) for i, f in enumerate(FEATURE_NAMES)]),
                           "_chosen": F.transform(F.array(*rank), lambda x: F.when(x <= k, x))})
    rank = [F.col("_chosen")[i] for i in at]
    lines = []
    for i, f in enumerate(FEATURE_NAMES):
        before, between, after = map(F.lit, _pieces(LINES[f]))
        lines.append(F.concat(before, F.col("_shown")[i], between, direction(F.col(FEATURE_COLUMNS[f][1])), after))
    out = out.withColumn("_lines", F.array(*lines))
    picked = {"feature": [F.lit(f) for f in FEATURE_NAMES], "score": [F.col(FEATURE_COLUMNS[f][1]) for f in FEATURE_NAMES],
              "line": [F.col("_lines")[i] for i in at]}
    cols = []
    for r in range(1, k + 1):
        for name, values in picked.items():
            pick = F.when(rank[0] == r, values[0])
            for i in at[1:]:
                pick = pick.when(rank[i] == r, values[i])
            cols.append(pick.alias(f"ev{r}_{name}"))
    return out.select("*", *cols).drop(*[f"_rk{i}" for i in at], "_shown", "_chosen", "_lines")


def evidence_lines(df: DataFrame, default_cred, k: int = EVIDENCE_LINES) -> DataFrame:
    """(row_key, rank, feature, score, line), rank 1..k, one row per line."""
    args = ", ".join(f"{r}, _f{r}" for r in range(1, k + 1))
    values = [c for pair in FEATURE_COLUMNS.values() for c in pair]
    long = _picked(df, default_cred, k).selectExpr("row_key", *dict.fromkeys(values), f"stack({k}, {args}) AS (rank, _f)")
    at = F.col("_f")
    long = long.filter(at.isNotNull()).select("row_key", "rank", at, _score_at(at).alias("score"), *dict.fromkeys(values))
    return long.select("row_key", "rank", _by_feature(at, map(F.lit, FEATURE_NAMES)).alias("feature"), "score",
                       _line_at(at, F.col("score")).alias("line"))


def evidence_joined(k: int = EVIDENCE_LINES) -> Column:
    """The ev{r}_line columns prefixed and joined with newlines."""
    lines = [F.col(f"ev{r}_line") for r in range(1, k + 1)]
    return F.concat_ws("\n", *[F.when(x.isNotNull(), F.concat(F.lit(LINE_PREFIX), x)) for x in lines])


def explanation_prompt(statement: Column, label: Column, confidence: Column, top_words: Column,
                       lines: Column) -> Column:
    """The full prompt text; ``lines`` is the evidence lines, each prefixed
    with '   - ' and joined with newlines."""
    body = F.concat(
        F.lit(PROMPT_HEAD),
        F.lit('Statement: "'), F.coalesce(statement, F.lit("")), F.lit('"\n'),
        F.lit("Classification: "), label, F.lit(" (confidence "), confidence.cast("string"), F.lit("%)\n\n"),
        F.lit("Evidence used:\n"),
        F.lit("1. Key words that influenced the decision: "), F.coalesce(top_words, F.lit("")), F.lit("\n"),
        F.lit("2. Speaker/context signals:\n"),
        F.coalesce(lines, F.lit("")),
    )
    return F.concat(body, fill(PROMPT_TAIL, label))


def rule_based_explanation(label: Column, confidence: Column, top_words: Column, first_line: Column) -> Column:
    """Verdict sentence, the key words (when any), the strongest evidence line
    with a capital first letter and a full stop."""
    s1 = fill(VERDICT, F.when(label == "TRUE", F.lit("true")).otherwise(F.lit("false")), confidence.cast("int"))
    s2 = F.when(F.coalesce(top_words, F.lit("")) != "", fill(WORDS, top_words))
    e = F.ltrim(F.trim(first_line), F.lit("- "))
    s3 = F.when(first_line.isNotNull() & (e != ""), F.concat(F.upper(F.substring(e, 1, 1)), F.substring(e, 2, 1 << 30),
                                                             F.when(e.endswith("."), F.lit("")).otherwise(F.lit("."))))
    return F.concat_ws(" ", s1, s2, s3)


def explain_rows(scored: DataFrame, words: DataFrame | None, threshold, default_cred,
                 statement_col: str | None = None, with_prompt: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Prediction, confidence and explanation for every scored row.

    scored: row_key, prob, the five feature values and a_* attributions
            (cs_known, cs_val, spk_cred, afl_cred, ctx_cred, len_norm);
    words:  (row_key, top_words) or None.  ``default_cred`` may be a
    number or a column; columns named in ``keep`` pass through."""
    label = decide("prob", threshold)
    out = scored.withColumn("prediction", label).withColumn("confidence", confidence_pct("prob", F.col("prediction")))
    if words is not None:
        out = out.join(words, "row_key", "left")
    elif "top_words" not in out.columns:
        out = out.withColumn("top_words", F.lit(None).cast("string"))
    out = with_evidence(out, default_cred)
    out = out.withColumn("explanation", rule_based_explanation(F.col("prediction"), F.col("confidence"),
                                                               F.col("top_words"), F.col("ev1_line")))
    cols = ["row_key", "prediction", "confidence", "top_words", "explanation", *keep]
    if with_prompt:
        stmt = F.col(statement_col) if statement_col else F.lit("")
        out = out.withColumn("prompt", explanation_prompt(stmt, F.col("prediction"), F.col("confidence"),
                                                          F.col("top_words"), evidence_joined()))
        cols.append("prompt")
    return out.select(*cols)
