"""Personal data: base spans against Python's matcher, discovery on a made corpus."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from credo.llm import pii
from credo.llm.queries import op5_personal_data
from tests.llm.cases import documents, with_extra, write_documents

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), n, m.end()))
    return [f"{pii.KINDS[n]}:{a}:{b}" for a, n, b in sorted(out)]


def run(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows, base, spans = pii.with_spans(docs, ["doc_id"])
    got = rows.select("doc_id", pii.written(base).alias("b"), pii.written(spans).alias("s")).collect()
    return {r["doc_id"]: (r["b"], r["s"]) for r in got}


def test_base_spans_of_random_texts(spark):
    rng = random.Random(2)
    bits = ["a@b.c", "x_y@e.f.g.", "_d@e-f.io", "@", "+1 (555) 555-0100", "+49 30 123456 7890 1234", "10.0.0.255", "1.2.3.4.5", "256.1.1.1", "4111 1111 1111 1111",
            "4111-1111-1111-1112", "378282246310005", "00000000000000", "é", "😀", " ", "\n", ".", "-", "+", "word", "0", "7", "(", ")", "汉", "1", "55"]
    texts = ["".join(rng.choice(bits) + rng.choice(("", " ", "")) for _ in range(rng.randrange(1, 30))) for _ in range(1500)]
    texts += [None, "", "a@" + "b." * 3000 + "c", "1" * 9000, "+1" + " " * 5000 + "2", "1 " * 5000, "a" * 20000 + "@b.c"]
    for i, (b, s) in run(spark, texts).items():
        want = base_spans(texts[i])
        assert b == ",".join(want), texts[i]
        assert set(want) <= set(s.split(",") if s else [])


def test_contexts_discover_unseen_identifiers(spark):
    """A trusted context finds numbers without a country code; a common one doesn't."""
    seen = [f"please call me at +1 (555) 555-{n:04d} today" for n in range(20)]
    unseen = ["please call me at 555 555 0199 today", "reach us: call me at 555-555-0142 today please"]
    plain = [f"chapter {n} of the book has {n * 3} pages and the total was 5551230{n}" for n in range(30)]
    texts = seen + unseen + plain
    found = run(spark, texts)
    for i, number in ((20, "555 555 0199"), (21, "555-555-0142")):
        at = texts[i].index(number)
        assert found[i] == ("", f"phone:{at}:{at + len(number)}")
    assert all(found[i] == ("", "") for i in range(22, len(texts)))
    assert all(found[i][0] == found[i][1] == ",".join(base_spans(texts[i])) for i in range(20))


def test_discovered_identifiers_induce_contexts(spark):
    """The second context holds no base match; what the first one discovers makes it trusted."""
    local = [f"555 555 {n:04d}" for n in range(9)]
    texts = [f"please call me at +1 (555) 555-{n:04d} today" for n in range(40)]
    texts += [f"please call me at {x} today" for x in local[:8]]
    texts += [f"otherwise ring us on {x} anytime" for x in local]
    found = run(spark, texts)
    for i in range(40, len(texts)):
        start = texts[i].index("555 555")
        assert found[i] == ("", f"phone:{start}:{start + 12}"), texts[i]


def test_contexts_induce_contexts_until_nothing_is_new(spark):
    """Each context is trusted only once the one before it has been, five times over."""
    seeds = [f"+1 (555) 555-{n:04d}" for n in range(21)]
    texts, before = [], []
    for hop, name in enumerate("abcde"):
        new = [f"555 {hop:03d} {n:04d}" for n in range(6)]
        held = seeds[:21 - len(before)] + before + new
        texts += [f"then{name} dial{name} {x} soon{name}" for x in held]
        before = new[:4]
    found = run(spark, texts)
    for i, text in enumerate(texts):
        number = text[text.index(" ", text.index("dial")) + 1:text.rindex(" ")]
        start = text.index(number)
        assert found[i][1] == f"phone:{start}:{start + len(number)}", text


def test_query_on_awkward_rows(spark, tmp_path):
    rows = op5_personal_data(spark, write_documents(spark, tmp_path)).collect()
    docs = documents(spark).collect()
    digest = lambda t: hashlib.sha256(",".join(base_spans(t)).encode()).hexdigest()
    assert sorted(((r["doc_id"], r["base_sha256"]) for r in rows), key=repr) == sorted(((r["doc_id"], digest(r["text"])) for r in docs), key=repr)
    for r in rows:
        if r["doc_id"] == 16:
            assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1)


def test_masked_keeps_rows_and_columns(spark):
    docs = with_extra(documents(spark))
    out = pii.masked(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == docs.count()
    by_id = {r["doc_id"]: r["text"] for r in rows}
    assert by_id[16] == "mail <EMAIL> or <PHONE>, host <IP>, card <CARD>."
    assert by_id[0] is None and by_id[1] == ""


def test_no_python_in_the_plan(spark):
    rows, _, _ = pii.with_spans(documents(spark), ["doc_id"])
    assert not re.search("Python|Pandas|Arrow", rows._jdf.queryExecution().executedPlan().toString())


def test_empty(spark, tmp_path):
    assert op5_personal_data(spark, write_documents(spark, tmp_path, empty=True)).count() == 0
    assert pii.masked(documents(spark, empty=True)).count() == 0


def test_long_runs_take_linear_time(spark):
    """A run of a million name characters, one that ends in an address, and addresses without a gap."""
    import time

    texts = ["x@y.z " + "a" * 1_000_000, "b" * 1_000_000 + "@c.d", "a@b.c" * 2000, "a@b.c%d@e.f_g@h.i", "a@" * 20_000, "@" + "a." * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    started = time.time()
    out = docs.select("doc_id", F.regexp_extract_all("text", F.lit(pii.EMAIL), F.lit(0)).alias("m"))
    found = {r["doc_id"]: r["m"] for r in out.collect()}
    assert time.time() - started < 10
    slow = {0: ["x@y.z"], 5: []}  # for Python's matcher
    assert found == {i: slow[i] if i in slow else [m.group() for m in BASE["email"].finditer(t)] for i, t in enumerate(texts)}
