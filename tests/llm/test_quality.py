import functools
import math
import re
import struct
from collections import Counter

import numpy as np
import xxhash

from genonet.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(zip(w, w[1:], w[2:]))
    inside = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed)


GOOD = " ".join(f"word{i} other{i % 7}" for i in range(60))
EDGE = [(1, None), (2, ""), (3, "a b c a b c"), (4, GOOD), (4, GOOD), (5, GOOD + "\n\n" + GOOD), (6, "x\ny\nx\n \nx"), (7, "#$ " * 70 + "|<>&%*"), (8, "😀 é " * 30 + GOOD), (9, " ".join(f"$$junk{i}$$" for i in range(300))), (10, "z " * 40000)]


def test_base_counts(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in EDGE], "doc_id long, text string, q int")
    labels = spark.createDataFrame([(4, 1, 0), (4, 1, 0), (None, 1, 0), (9, 0, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality.report(docs, labels).collect()
    assert sorted(tuple(r)[:7] for r in rows) == sorted((i, *brute(t)) for i, t in EDGE)
    assert {r.doc_id: r.kept for r in rows}[4]
    assert all(not r.kept for r in rows if r.base_failed)
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.kept)
    none = quality.report(docs, labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) for r in none)
    assert quality.report(docs.limit(0), labels).count() == 0


def test_scores_follow_the_formula(spark):
    docs = spark.createDataFrame([(i, t) for i, t in EDGE], "doc_id long, text string")
    model = quality.Ratio(docs, spark.createDataFrame([(4, 1)], "doc_id long, quality int"))
    hashed = {r.doc_id: r.b for r in docs.select("doc_id", quality.let(quality.word_array(docs.text, quality.SPACES), lambda w: quality.buckets(w, quality.pair_hashes(w))).alias("b")).collect()}
    for r in model.judged(docs).collect():
        b = hashed[r.doc_id]
        assert (r.q.score is None) == (not b)
        assert not b or abs(r.q.score - sum(model.weights[x] for x in b) / len(b)) < 1e-9


def test_held_out_accuracy(spark):
    """Half of the labels fit the model; it must tell the other half's quality."""
    at = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    seen = labels.where("doc_id % 2 = 0")
    rows = quality.report(docs, seen).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def xx(data, seed=42):
    """The session's 64-bit hash of a text or a long, as a signed number."""
    raw = data.encode() if isinstance(data, str) else struct.pack("<q", data)
    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(raw, seed % (1 << 64))))[0]


def test_verdicts_of_a_whole_table_from_plain_counts(spark):
    """Trusted documents, counts, weights, threshold and verdicts worked out here, text by text."""
    at = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}

    def grams(text):
        w = WORD.findall(text)
        return [xx(a) % (1 << 14) for a in w] + [xx(b, xx(a)) % (1 << 14) for a, b in zip(w, w[1:], strict=False)]

    own = {i: grams(t) for i, t in texts.items()}
    for bound in (20_000, 20):
        good = sorted({r.doc_id for r in labels.collect() if r.quality == 1}, key=lambda i: (xx(i), i))[:bound]
        fit, held = good[::2], good[1::2]
        raw, target = Counter(b for g in own.values() for b in g), Counter(b for i in fit if i in own for b in own[i])
        size = [sum(c.values()) + (1 << 14) for c in (target, raw)]
        weight = lambda b: math.log((target[b] + 1) / size[0]) - math.log((raw[b] + 1) / size[1])  # noqa: B023, E731
        score = {i: sum(map(weight, g)) / len(g) if g else None for i, g in own.items()}
        fine = [score[i] for i in held if i in own and not brute(texts[i])[-1]]
        threshold = np.quantile(fine, quality.QUANTILE) - quality.SLACK
        model = quality.Ratio(docs, labels, bound)
        assert abs(model.threshold - threshold) < 1e-9
        got = {r.doc_id: r.q for r in model.judged(docs).collect()}
        for i, q in got.items():
            assert (q.score is None) == (score[i] is None) and (q.score is None or abs(q.score - score[i]) < 1e-9)
            assert q.kept == (not brute(texts[i])[-1] and score[i] >= threshold), i
        assert 0 < sum(q.kept for q in got.values()) < len(got)


def test_every_trusted_document_counts(spark):
    """Of all documents with quality 1, whatever their number, each counts for the target and for the threshold."""
    n = 21_000
    body = lambda i: " ".join(f"w{(i + j) % 97}" for j in range(60))
    texts = {i: f"{body(i)} own{i % 40}" if i < n else body(i).replace("w", "v") for i in range(n + 300)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i < n)) for i in texts], "doc_id long, quality int")
    ids = {r.t_id: r.half for r in quality.trusted_ids(labels).collect()}
    assert ids == {i: xx(i) & 1 for i in range(n)}

    @functools.cache
    def grams(text):
        w = text.split(" ")
        return [xx(a) % (1 << 14) for a in w] + [xx(b, xx(a)) % (1 << 14) for a, b in zip(w, w[1:], strict=False)]

    own = {i: grams(t) for i, t in texts.items()}
    raw, halves = Counter(), (Counter(), Counter())
    for i, g in own.items():
        raw.update(g)
        if i in ids:
            halves[ids[i]].update(g)

    def weighed(target):
        size = [sum(c.values()) + (1 << 14) for c in (target, raw)]
        return {b: math.log((target[b] + 1) / size[0]) - math.log((raw[b] + 1) / size[1]) for b in range(1 << 14)}

    full, by_half = weighed(halves[0] + halves[1]), [weighed(h) for h in halves]
    held = [sum(by_half[1 - ids[i]][b] for b in own[i]) / len(own[i]) for i in ids]
    model = quality.Ratio(docs, labels)
    assert max(abs(model.weights[b] - full[b]) for b in full) < 1e-9
    assert abs(model.threshold - (np.quantile(held, quality.QUANTILE) - quality.SLACK)) < 1e-9
    rows = quality.report(docs, labels).collect()
    assert all(r.kept == (sum(full[b] for b in own[r.doc_id]) / len(own[r.doc_id]) >= model.threshold) for r in rows)
    assert len(rows) == len(texts) and {r.kept for r in rows} == {True, False}


def test_quantile_of_few_and_equal_values(spark):
    for values in ([], [3.0], [1.0, 2.0], [2.0, 2.0, 2.0], [float(i * i % 17) for i in range(60)]):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        for q in (0.0, 0.002, 0.3, 0.5, 1.0):
            got = quality.quantile_of(df, q)
            assert got is None if not values else abs(got - np.quantile(values, q)) < 1e-9


def test_halves_are_exact_behind_a_full_bitmap(spark, monkeypatch):
    """A bitmap that rules out few or none leaves the halves as they are; null and repeated ids keep their rows."""
    docs = spark.createDataFrame([(i if i % 50 else None, f"t{i}") for i in range(3000)] + [(7, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3 % 2) for i in range(4000)], "doc_id long, quality int")
    want = sorted([(f"t{i}", xx(i) & 1 if i % 50 and i % 3 == 1 else None) for i in range(3000)] + [("again", xx(7) & 1)])
    for bits in (quality.FILTER_BITS, 1 << 6, 1):
        monkeypatch.setattr(quality, "FILTER_BITS", bits)
        others, tried = quality.halved(docs, quality.trusted_ids(labels))
        assert sorted((r.text, r.half) for r in others.unionByName(tried).collect()) == want
        assert (others.count() == 60) == (bits < 1 << 15)
