import hashlib
import itertools
import time
import zlib
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from genonet.llm import runs


def brute_runs(t):
    """Every run: all stretches where words q apart are equal, with their smallest period."""
    found = {}
    for q in range(1, len(t) // 2 + 1):
        s = 0
        while s < len(t) - q:
            e = s
            while e < len(t) - q and t[e] == t[e + q]:
                e += 1
            if e - s >= q:
                found.setdefault((s, e - s + q), q)
            s = max(s + 1, e)
    return {(s, size, q) for (s, size), q in found.items()}


def brute_lyndon(t):
    nss = [next((j for j in range(i + 1, len(t)) if t[j:] < t[i:]), len(t)) for i in range(len(t))]
    agree = lambda i, j: next((k for k in range(len(t) - j) if t[i + k] != t[j + k]), len(t) - j)
    return nss, [agree(i, j) for i, j in enumerate(nss)]


def test_all_short_sequences():
    for letters, longest in ((2, 11), (3, 7)):
        for n in range(longest):
            for t in map(list, itertools.product(range(letters), repeat=n)):
                assert runs.lyndon(t) == brute_lyndon(t)
                assert runs.all_runs(t) == brute_runs(t)


pieces = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 6)), max_size=8).map(lambda ps: [x for p, k in ps for x in p * k])


@settings(max_examples=300, deadline=None)
@given(pieces)
def test_repetitive_sequences(t):
    want = brute_runs(t)
    assert runs.lyndon(t) == brute_lyndon(t) and runs.all_runs(t) == want
    for length, exponent in ((24, 3), (6, 2), (9, 4)):
        assert runs.long_runs(t, length, exponent) == sorted((r for r in want if r[1] >= max(length, exponent * r[2])), key=lambda r: (r[0], r[2]))


def test_time_is_linear():
    """Sequences on which comparisons from scratch would take quadratic time."""
    for make in (lambda n: [0] * n, lambda n: ([0] * 60 + [1]) * (n // 61), lambda n: [k % (n // 3) for k in range(n)], lambda n: sum(([0] * k + [1] for k in range(int((2 * n) ** 0.5))), [])):
        began = time.process_time()
        runs.all_runs(make(200_000))
        assert time.process_time() - began < 20


def brute_report(i, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    g = h // 10
    if h % 10 == 0 and w:
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(len(w))]
    found = sorted((r for r in brute_runs(w) if r[1] >= max(24, 3 * r[2])), key=lambda r: (r[0], r[2]))
    gone = {k for s, size, q in found for k in range(s + q, s + size)}
    top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    listed = "".join("%d,%d,%d\n" % r for r in found)
    return (i, len(found), *top, None if top[0] is None else 1000 * top[1] // top[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())


EDGE = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a " * 23), (5, "a " * 24), (6, "b " + "a " * 24 + "b"), (7, "x y z " * 8), (7, "x y z " * 8), (8, "x y z " * 7 + "x y"), (None, "é ê " * 40), (9, "a\x85b\xa0c " * 30), (10, "a b a b c " * 9 + "d " * 30),
    (11, " ".join(f"w{k % 700}" for k in range(2200))), (12, "x " * 3000), (13, "A a " * 20), (14, "p\x0bq\x0c" * 15 + "r " * 25),
]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, 9, "r") for i, t in EDGE], "doc_id long, text string, start int, runs string")
    assert sorted(repr(tuple(r)) for r in runs.report(runs.repeated(docs)).collect()) == sorted(repr(brute_report(i, t)) for i, t in EDGE)
    assert runs.report(docs.limit(0)).count() == 0
    kept = {r.doc_id: r for r in runs.collapse(docs).collect()}
    assert kept[7].text == "x y z" and [tuple(r) for r in kept[7].runs] == [(0, 24, 3)]
    assert kept[1].text == "" and kept[1].runs == [] and kept[4].text == "a " * 22 + "a"


def test_planted_repeats(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect() if len((r.text or "").split()) < 900]
    got = runs.report(runs.repeated(docs)).where("doc_id is not null").collect()
    want = dict((r[0], r) for r in (brute_report(i, t) for i, t in rows))
    assert sum(1 for r in want.values() if r[1]) >= 10
    assert all(tuple(r) == want[r.doc_id] for r in got if r.doc_id in want)
