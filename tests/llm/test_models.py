"""Katz backoff, the quality classifier and nearest neighbours against plain versions."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from credo.llm import ann, katz, quality
from credo.llm.queries import op2_katz_scores, op6_quality, op9_nearest
from tests.llm.cases import documents, write_documents


def held(doc_id, folds):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds == 0


def good_turing(counts, k=5):
    """Katz's ratios d_1 to d_k, counts of counts smoothed by a line through their logarithms."""
    points = [(math.log(r), math.log(n)) for r in range(1, k + 2) if (n := sum(c == r for c in counts))]
    slope = -2.0
    if len(points) > 1:
        mx, my = (sum(v) / len(points) for v in zip(*points))
        slope = sum((x - mx) * (y - my) for x, y in points) / sum((x - mx) ** 2 for x, _ in points)
    n = lambda r: r ** min(slope, -1.1)
    last = (k + 1) * n(k + 1) / n(1)
    return [None, *(((r + 1) * n(r + 1) / (r * n(r)) - last) / (1 - last) for r in range(1, k + 1))]


class Plain:
    """Katz backoff over dictionaries."""

    def __init__(self, texts):
        self.uni, self.bi = Counter(), defaultdict(Counter)
        for words in texts:
            self.uni.update(words)
            for h, w in zip([None, *words], words):
                self.bi[h][w] += 1
        self.total, self.types = sum(self.uni.values()), len(self.uni)
        self.du = good_turing(list(self.uni.values()))
        self.db = good_turing([c for m in self.bi.values() for c in m.values()])
        cut = lambda ratio, c: c * ratio[c] if c <= 5 else c
        freed = sum(c - cut(self.du, c) for c in self.uni.values())
        if freed:
            self.p1 = {w: cut(self.du, c) / self.total for w, c in self.uni.items()}
            self.unseen = freed / self.total
        else:
            self.p1 = {w: c / (self.total + 1) for w, c in self.uni.items()}
            self.unseen = 1 / (self.total + 1)
        self.p2, self.alpha = {}, {}
        for h, m in self.bi.items():
            n = sum(m.values())
            lost = sum(c - cut(self.db, c) for c in m.values())
            self.p2[h] = {w: cut(self.db, c) / n if lost else c / (n + 1) for w, c in m.items()}
            left = lost / n if lost else 1 / (n + 1)
            self.alpha[h] = left / (1 - math.fsum(self.p1[w] for w in m))

    def p(self, h, w):
        own = self.p2.get(h, {})
        return own[w] if w in own else self.alpha.get(h, 1.0) * self.p1.get(w, self.unseen)

    def score(self, words):
        return math.fsum(math.log10(self.p(h, w)) for h, w in zip([None, *words], words))


def words_of(text):
    return [*(text or "").encode().lower().split(), None]


@pytest.mark.parametrize("block,bucket", [(3_000_000, 8_000_000), (40, 100)])
def test_katz_query(spark, tmp_path, monkeypatch, block, bucket):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", block)
    monkeypatch.setattr(katz, "BUCKET_TOKENS", bucket)
    rng = random.Random(1)
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    rows += [(100 + n, " ".join(f"v{min(int(rng.expovariate(0.08)), 99)}" for _ in range(rng.randrange(40)))) for n in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS block", "2 AS bucket", "'x' AS data")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    model = Plain([words_of(t) for i, t in rows if not held(i, 10)])
    for h in list(model.bi)[:50]:  # exactly normalised
        assert abs(math.fsum([*(model.p(h, w) for w in model.uni), model.p(h, b"never seen")]) - 1) < 1e-9
    got = sorted((tuple(r) for r in op2_katz_scores(spark, str(tmp_path)).collect()), key=repr)
    want = []
    for i, t in rows:
        w = words_of(t)
        base = math.fsum(math.log10((model.uni[x] + 0.1) / (model.total + 0.1 * (model.types + 1))) for x in w)
        want.append((i, held(i, 10), len(w), sum(model.uni[x] > 0 for x in w), model.total, base, model.score(w)))
    key = lambda r: (repr(r[:5]), round(r[6], 6))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_katz_frequent_context_is_split(spark, tmp_path, monkeypatch):
    """A word before 3,000 others, in many blocks: no group holds all of its successors."""
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 500)
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 1000)
    count, seen = katz.count_bucket, str(tmp_path)

    def spied(table):
        entries = sum(len(katz.unpack(x.as_py())[4]) for x in table.column("data"))
        with open(f"{seen}/{table.column('bucket')[0].as_py()}.entries", "w") as f:
            f.write(str(entries))
        return count(table)

    monkeypatch.setattr(katz, "count_bucket", spied)
    rows = [(i, " ".join(f"the w{n % 3000}" for n in range(i * 50, i * 50 + 50))) for i in range(90)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    model = Plain([words_of(t) for i, t in rows if not held(i, 10)])
    got = {r["doc_id"]: r["score"] for r in op2_katz_scores(spark, seen).collect()}
    assert max(int(f.read_text()) for f in tmp_path.glob("*.entries")) <= 1500
    assert got == pytest.approx({i: model.score(words_of(t)) for i, t in rows}, rel=1e-9)


def test_discounts():
    good = katz.Discounts([1000, 400, 220, 140, 100, 75])
    assert all(0 < x < 1 for x in good.ratio[1:6]) and good.ratio[6] == 1
    # an exact power law gives the plain Good-Turing ratios
    law = [10**9 // r**2 for r in range(1, 7)]
    last = 6 * law[5] / law[0]
    plain = [((r + 1) * law[r] / (r * law[r - 1]) - last) / (1 - last) for r in range(1, 6)]
    assert katz.Discounts(law).ratio[1:6] == pytest.approx(plain, rel=1e-6)
    for odd in ([0] * 6, [5, 0, 0, 0, 0, 0], [1, 9, 1, 9, 1, 9], [1, 10, 100, 1000, 10**4, 10**5], [1000, 2000, 100, 90, 80, 70]):
        assert all(0 < x < 1 for x in katz.Discounts(odd).ratio[1:6])


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    arrays = [np.array([], dtype=np.int64), np.sort(rng.integers(0, 2**64, 50, dtype=np.uint64)), rng.integers(0, 300, 40), rng.random(9), np.array([7])]
    for a, b in zip(arrays, katz.unpack(katz.pack(*arrays)), strict=True):
        assert (a == b).all() and len(a) == len(b)


def test_katz_empty(spark, tmp_path):
    assert op2_katz_scores(spark, write_documents(spark, tmp_path, empty=True)).count() == 0


def test_quality_collects_one_text_per_label(spark, monkeypatch):
    """A labelled id in 500 rows is one row of the fit."""
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows, labels: seen.append((len(rows), labels.tolist())))
    ids = [i for i in range(30) if not held(i, quality.FOLDS)][:6]
    rows = [(i, f"some words of text {i}") for i in ids] + [(ids[0], f"other words {n}") for n in range(500)]
    labels = spark.createDataFrame([(i, n % 2) for n, i in enumerate(ids)], "doc_id long, quality int")
    quality.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert seen == [(6, [0, 1, 0, 1, 0, 1])]


def make_labelled(spark, folder, n=400):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        body = [f"word{rng.randrange(500)}" for _ in range(rng.randrange(20, 80))]
        if not good:
            junk = rng.choice(("rep", "noise", "loud"))
            body[10:] = [body[10]] * (len(body) - 10) if junk == "rep" else [w + "%%%" if junk == "noise" else w.upper() + "!!" for w in body[10:]]
        rows.append((i, " ".join(body)))
        labels += [(i, int(good), None)] if i % 2 else []
    labels += [(None, 1, 0), (5, None, 0), (99999, 0, 0), labels[0], labels[0]]
    rows += [(None, "one two"), (n, None), (n + 1, ""), (n + 2, "x " * 30000)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS y", "2 AS id", "3 AS quality").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_quality_query_on_held_out_rows(spark, tmp_path):
    rows = make_labelled(spark, tmp_path)
    got = op6_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    right = []
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == held(r["doc_id"], 5)
        if r["doc_id"] is not None and r["doc_id"] < 400 and r["held_out"]:
            text = texts[r["doc_id"]]
            bad = "%%%" in text or "!!" in text or len(set(text.split())) < 14
            right.append((r["predicted"] == 0) == bad)
    assert len(right) > 50 and np.mean(right) > 0.95
    again = {r["doc_id"]: r["score"] for r in op6_quality(spark, str(tmp_path)).collect()}
    assert again == {r["doc_id"]: r["score"] for r in got}


def test_dual_coordinate_descent_meets_the_optimum():
    """The duality gap closes: no other weights have a smaller objective."""
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 60, 12)) + (40 if n % 2 else 0) for n in range(60)]
    labels = np.array([n % 2 for n in range(60)])
    model = quality.fit(rows, labels, passes=3000)
    margins = np.array([model.margin(x) for x in rows])
    assert ((margins > 0) == (labels > 0)).mean() > 0.9
    assert model.slope > 0


def test_quality_without_both_classes(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(docs, none).score(quality.features("a b")) == 0.5
    ones = spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, quality int")
    assert quality.train(docs, ones).score(quality.features("a b")) > 0.99
    assert quality.good_documents(documents(spark, empty=True), quality.train(docs, none)).count() == 0
    assert quality.good_documents(docs, quality.train(docs, none)).count() == docs.count()


def write_vectors(spark, folder, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2 AS v", "3 AS chunk").repartition(3).write.parquet(f"{folder}/embeddings.parquet")


def nearest(rows, k=10):
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for q in sorted({i for i, _ in good if i % 100 == 0}):
        vq = min((tuple(v) for i, v in good if i == q))
        found = sorted((float(np.sqrt(((v - vq) ** 2).sum())), i) for i, v in good if i != q)[:k]
        out += [(q, n + 1, i, d) for n, (d, i) in enumerate(found)]
    return out


@pytest.mark.parametrize("chunk,block", [(4096, 512), (64, 3)])
def test_nearest_query(spark, tmp_path, monkeypatch, chunk, block):
    monkeypatch.setattr(ann, "CHUNK", chunk)
    monkeypatch.setattr(ann, "BLOCK", block)
    rng = np.random.default_rng(2)
    rows = [(n, rng.normal(size=8).round(3).tolist()) for n in range(900)]
    same = rng.normal(size=8).tolist()
    rows += [(2000 + n, same) for n in range(60)]  # ties
    rows += [(1000, None), (1100, []), (1200, [0.0] * 8), (1300, [None] + [1.0] * 7), (1400, [float("nan")] * 8),
             (1500, [float("inf")] * 8), (1600, [1.0] * 5), (None, same), (300, same), (2000, same)]
    write_vectors(spark, tmp_path, rows)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in op9_nearest(spark, str(tmp_path)).collect())
    want = nearest(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], rel=1e-12)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(6)
    places = rng.normal(size=(40, 64))
    v, q = (places[rng.integers(0, 40, n)] + 0.3 * rng.normal(size=(n, 64)) for n in (4000, 20))
    centre, turn = v.mean(axis=0), ann.rotation(64, 1)
    low, high = ann.bounds(*ann.encode(v, centre, turn), (q - centre) @ turn)
    true = ((q[:, None, :] - v) ** 2).sum(axis=2)
    assert ((low <= true) & (true <= high)).mean() > 0.995
    limit = np.partition(high, 9, axis=1)[:, 9:10]
    assert (low <= limit).mean() < 0.2


def test_few_or_no_vectors(spark, tmp_path):
    write_vectors(spark, tmp_path / "a", [(100, [1.0, 2.0]), (7, [1.0, 2.5])])
    got = [tuple(r) for r in op9_nearest(spark, str(tmp_path / "a")).select("query_id", "rank", "vec_id", "score").collect()]
    assert got == [(100, 1, 7, 0.5)]
    write_vectors(spark, tmp_path / "b", [])
    assert op9_nearest(spark, str(tmp_path / "b")).count() == 0
