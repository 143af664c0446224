import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np
import pyarrow as pa

from genonet.llm.decontaminate import Benchmark, _scan_texts, decontaminate, report, scan, suffix_array

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, item in items:
            q = words(item)
            n = min(window, len(q))
            gone = {tuple(q[i : i + n]) for i in range(len(q) - n + 1)} if q else ()
            for i in range(len(w) - n + 1) if q else ():
                if tuple(w[i : i + n]) in gone:
                    hit |= set(range(i, i + n))
                    found.add(str(item_id))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out)


def got(df):
    return sorted(tuple(r)[:6] for r in df.collect())


def test_suffix_array_orders_suffixes():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 400):
        ids = rng.integers(0, 3, n)
        order = suffix_array(ids, n)
        assert order.tolist() == sorted(range(n), key=lambda i: ids[i:].tolist())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("a b c É".split()), max_size=40), min_size=1, max_size=5), st.lists(st.lists(st.sampled_from("A b c é".split()), max_size=14), max_size=4))
def test_against_brute_force(texts, items):
    texts, items = [" ".join(t) for t in texts], list(enumerate(" ".join(t) for t in items))
    bench = Benchmark([str(i) for i, _ in items], [t for _, t in items], 4)
    rows = [(k, n, sum(r[1::2]) - sum(r[::2]), len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), bool(r)) for k, (n, r, f, _, _) in enumerate(_scan_texts(pa.array(texts), bench))]
    assert rows == brute(list(enumerate(texts)), items, 4)


def test_longest_match_and_place():
    bench = Benchmark(["1"], ["one two three four five six"], 10)
    assert _scan_texts(pa.array(["x one two three y two three four five z"]), bench) == [(10, [], [], 4, 5)]


EDGE = [(1, None), (2, ""), (3, "a b c d e f g h i j k l"), (3, "a b c d e f g h i j k l"), (4, "short item here"), (5, "!!! ,,,"), (6, "x " * 30000 + "A b C d e f g h i j"), (7, "a b c d e f g h i")]
ITEMS = [(10, "a b c d e f g h i j k"), (11, "a b c d e f g h i j k"), (12, None), (13, ""), (14, "Short, ITEM!"), (None, "a b c"), (9, "..")]


def test_edges_and_blocks(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in EDGE], "doc_id long, text string, hits string")
    items = spark.createDataFrame([(i, t, 0) for i, t in ITEMS], "item_id long, text string, n_words int")
    want = brute(EDGE, [x for x in ITEMS if x[0] is not None])
    assert got(report(scan(docs, items))) == want
    assert got(report(scan(docs, items, block_bytes=80))) == want
    assert sorted(r.doc_id for r in decontaminate(docs, items).collect()) == [1, 2, 5, 7]
    assert decontaminate(docs, items, block_bytes=80).columns == docs.columns
    assert got(report(scan(docs, items.limit(0)))) == brute(EDGE, [])
    assert scan(docs.limit(0), items).count() == 0
