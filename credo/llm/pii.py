"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are what the base patterns find and validate: e-mail addresses, IPv4
addresses, card numbers (Luhn) and international phone numbers.  Every run of
words with a digit or ``@`` is an instance; the words around its occurrences
make lexical patterns (the two words before; the word before and the word
after).  Patterns and instances form a graph that is scored in rounds until
no instance is new: a pattern's confidence for a kind is the share of its
distinct instances that belong to it (seeds surely, others by their score), an
instance's score is the chance that any of its trusted patterns is right.  Instances that no base
pattern finds, have the written form of the kind and a high score are
discovered; base spans always stay.

Spans are in code points, the end exclusive.  Null texts count as empty.  The
graph's rows are distinct (pattern, instance) pairs, so an instance that
occurs everywhere weighs no more than another.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credo.llm.common import fresh, stored, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Rounds of scoring at least; a pattern counts from so many instances of a kind
#: and this confidence on; an instance is discovered from this score on.
ROUNDS, SUPPORT, TRUSTED, DISCOVERED = 3, 3.0, 0.7, 0.8
#: Rounds end when no instance is new or scores so much more than in any before.
SETTLED = 0.001
#: Up to so many spans (100 bytes each) are broadcast to their rows.
SPANS_BROADCAST = 200_000

#: The base patterns.  Repetitions are possessive where nothing could be given
#: back, which keeps Java's matcher from recursing on long runs.
# only from where a run of name characters starts, or the last match ended: else every place of a long run is tried to its end
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Texts without a match of these can't hold a valid one.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9][\x20().0-9-]"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Runs of words with a digit or @, one blank between them.
INSTANCE = r"[^\s0-9@]*+[0-9@]\S*+(?:\x20[^\s0-9@]*+[0-9@]\S*+)*+"
#: How an instance of each kind may be written.
FORMS = {
    "email": r"^\S+@\S+$",
    "ip": r"^[0-9A-Fa-f]{0,4}(?:[.:][0-9A-Fa-f]{0,4}){3,7}$",
    "card": r"^[0-9](?:[\x20-]?[0-9]){11,18}$",
    "phone": r"^[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,14}$",
}


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + value(i))
    return total % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(match, r"[\x20-]", "")
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.regexp_replace(match, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def matches(text: Column, pattern: str, hint: str) -> tuple[Column, Column]:
    """Leftmost non-overlapping matches and the texts around them; empty where the hint fails."""
    none = F.array().cast("array<string>")
    if_any = text.contains(hint) if hint == "@" else text.rlike(hint)
    return (F.when(if_any, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none),
            F.when(if_any, F.split(text, pattern, -1)).otherwise(none))


def lengths(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda s, x: s + F.length(x))


def placed(found: str, around: str) -> Column:
    """(start, end, text, gap before, gap after) of each match."""

    def place(m: Column, i: Column) -> Column:
        start = lengths(F.slice(around, F.lit(1), i + 1)) + lengths(F.slice(found, F.lit(1), i))
        return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("text"),
                        F.get(F.col(around), i).alias("before"), F.get(F.col(around), i + 1).alias("after"))

    return F.transform(found, place)


def kept(kind: str, found: str, around: str) -> Column:
    """Spans (start, end, kind) of the valid matches."""
    good = F.filter(placed(found, around), lambda s: valid(kind, s["text"]))
    return F.transform(good, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(KINDS.index(kind)).alias("kind")))


def in_order(spans: Column) -> Column:
    """By start, then kind."""
    return F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"]))


def detected(docs: DataFrame, text: str, base: str, instances: str) -> DataFrame:
    """``docs`` with the base spans (start, end, kind) and the instances (start, end, value, patterns, kind)."""
    out = docs
    names = {}
    for kind, pattern in zip((*KINDS, "instance"), (EMAIL, IP, CARD, PHONE, INSTANCE)):
        found, around = (fresh(f"_{kind}_{x}", docs.columns) for x in ("found", "around"))
        names[kind] = found, around
        a, b = matches(text_or_empty(text), pattern, HINTS.get(kind, "[0-9@]"))
        out = out.withColumns({found: a, around: b})
    spans = [kept(kind, *names[kind]) for kind in KINDS]
    out = out.withColumn(base, in_order(F.concat(*spans)))

    def instance(s: Column) -> Column:
        core = F.regexp_replace(F.regexp_replace(s["text"], r"[.,;:!?)\]'\"]+$", ""), r"^[(\['\"]+(?![0-9]{1,4}\))", "")
        lead = F.length(s["text"]) - F.length(F.regexp_replace(s["text"], r"^[(\['\"]+(?![0-9]{1,4}\))", ""))
        before = F.lower(F.regexp_extract(F.right(s["before"], F.lit(80)), r"(\S+\s+\S+)\s*$", 1))
        last = F.lower(F.regexp_extract(F.right(s["before"], F.lit(80)), r"(\S+)\s*$", 1))
        after = F.lower(F.regexp_extract(F.left(s["after"], F.lit(80)), r"^\s*(\S+)", 1))
        patterns = F.array(
            F.when(before != "", F.concat(F.lit("1 "), F.regexp_replace(before, r"\s+", " "), F.lit(" _"))),
            F.when((last != "") & (after != ""), F.concat(F.lit("2 "), last, F.lit(" _ "), after)))
        start = s["start"] + lead
        end = start + F.length(core)
        kind = F.filter(base, lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"]))
        return F.struct(start.alias("start"), end.alias("end"), core.alias("value"),
                        F.array_compact(patterns).alias("patterns"), F.get(kind, F.lit(0))["kind"].alias("kind"))

    out = out.withColumn(instances, F.transform(placed(*names["instance"]), instance))
    return out.drop(*(n for pair in names.values() for n in pair))


def fits(n: int) -> Column:
    """Whether the instance of an edge is a seed of the kind, or may become one of its instances."""
    return F.when(F.col("kind").isNull(), F.col("value").rlike(FORMS[KINDS[n]])).otherwise(F.col("kind") == n)


def scored(edges: DataFrame) -> DataFrame:
    """value and kind of the discovered instances, from edges (pattern, value, kind of a seed or null).

    Rounds of: confidence of the patterns by their instances, discovered ones
    too; score of the instances by their trusted patterns.
    """
    # an instance is a seed of the kind under which it was found
    pairs = stored(edges.groupBy("pattern", "value").agg(F.min("kind").alias("kind")), "pii-pairs")
    # a score is at most 1, so a pattern's support is at most its instances that fit, in any round
    most = F.greatest(*(F.sum(fits(n).cast("int")) for n in range(len(KINDS))))
    patterns = pairs.groupBy("pattern").agg(F.count("*").alias("total"), most.alias("most"))
    patterns = patterns.filter((F.col("most") >= SUPPORT) & (F.col("most") / (F.col("total") + 1) >= TRUSTED)).drop("most")
    any_kind = F.lit(False)
    for n in range(len(KINDS)):
        any_kind = any_kind | fits(n)
    edges = stored(pairs.filter(any_kind).join(patterns, "pattern"), "pii-edges")
    forms = F.lit(False)
    for n, kind in enumerate(KINDS):
        forms = forms | ((F.col("kind") == n) & F.col("value").rlike(FORMS[kind]))
    guesses = best = None
    for at in count(1):
        rows = edges.filter("kind is not null").select("pattern", "total", "kind", F.lit(1.0).alias("score"))
        if guesses is not None:
            known = guesses.select("value", F.col("kind").alias("g"), "score")
            more = edges.filter("kind is null").join(known, "value")
            rows = rows.unionByName(more.select("pattern", "total", F.col("g").alias("kind"), "score"))
        trust = rows.groupBy("pattern", "kind").agg(F.max("total").alias("total"), F.sum("score").alias("support"))
        trust = trust.withColumn("trust", F.col("support") / (F.col("total") + 1))
        trust = trust.filter((F.col("support") >= SUPPORT) & (F.col("trust") >= TRUSTED)).select("pattern", "kind", "trust")
        miss = edges.filter("kind is null").select("pattern", "value").join(trust, "pattern").groupBy("value", "kind").agg(
            F.sum(F.log1p(-F.least(F.col("trust"), F.lit(0.999)))).alias("miss"))
        top = miss.filter(forms).groupBy("value").agg(F.max(F.struct((1 - F.exp("miss")).alias("score"), (-F.col("kind")).alias("k"))).alias("top"))
        guesses = stored(top.select("value", (-F.col("top.k")).alias("kind"), F.col("top.score").alias("score")), "pii-scores")
        if best is None:
            best, settled = guesses, guesses.isEmpty()
        else:
            old = best.withColumnRenamed("score", "old")
            risen = guesses.join(old, ["value", "kind"], "left").filter(F.col("old").isNull() | (F.col("score") > F.col("old") + SETTLED))
            settled = risen.isEmpty()
            if not settled:
                best = stored(best.unionByName(guesses).groupBy("value", "kind").agg(F.max("score").alias("score")), "pii-best")
        if guesses.isEmpty() or settled and at >= ROUNDS:
            break
    return guesses.filter(F.col("score") >= DISCOVERED).select("value", "kind")


def with_spans(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, str, str]:
    """``docs``' columns ``keep`` with base spans and all spans, and the names of those two columns."""
    base, spans, instances, row = (fresh(n, docs.columns) for n in ("base", "spans", "_instances", "_row"))
    found = stored(detected(docs, "text", base, instances).select(*keep, base, instances).withColumn(row, F.monotonically_increasing_id()), "pii")
    seen = found.filter(F.size(instances) > 0).select(F.col(row).alias("row"), F.explode(instances).alias("i")).select("row", "i.*")
    values = scored(seen.select(F.explode("patterns").alias("pattern"), "value", "kind"))
    new = seen.filter("kind is null").join(values.withColumnRenamed("kind", "new"), "value")
    new = stored(new.groupBy("row").agg(F.array_distinct(F.collect_list(F.struct("start", "end", F.col("new").alias("kind")))).alias("more")), "pii-new")
    if new.count() <= SPANS_BROADCAST:
        new = F.broadcast(new)
    more = fresh("_more", docs.columns)
    new = new.select(F.col("row").alias(fresh("_r", docs.columns)), F.col("more").alias(more))
    out = found.join(new, F.col(row) == F.col(new.columns[0]), "left")
    both = F.when(F.col(more).isNull(), F.col(base)).otherwise(in_order(F.concat(base, more)))
    return out.select(*keep, base, both.alias(spans)), base, spans


def of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))


def written(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its texts replaced by the kind in angle brackets; null texts stay null."""
    rows, _, spans = with_spans(docs, docs.columns)
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    text = F.col("text").cast("string")

    def add(state: Column, s: Column) -> Column:
        plain = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        more = F.when(s["start"] >= state["at"], F.concat(state["out"], plain, F.get(names, s["kind"]))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), more.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(spans, start, add, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return rows.withColumn("text", F.when(F.size(spans) > 0, whole).otherwise(text)).select(*docs.columns)
