import hashlib
from collections import Counter

from genonet.llm import exactdedup


def brute(rows):
    """doc_id, keep_id, group_size and digest of every row, and how many rows stay of each text."""
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(repr((i, top[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest())) for i, t in rows)


EDGE = [(5, None), (6, ""), (4, None), (7, "a"), (8, "A"), (9, "a "), (7, "a"), (None, "b"), (None, "b"), (None, "c"), (3, "c"), (10, "x" * 300_000), (11, "x" * 300_000), (12, "é"), (13, "é")]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, 1, b"k") for i, t in EDGE], "doc_id long, text string, row int, digest binary")
    out = exactdedup.report(docs).collect()
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in out) == brute(EDGE)
    stays = Counter(r.text_sha256 for r in out if r.kept)
    assert set(stays.values()) == {1} and len(stays) == len({t or "" for _, t in EDGE})
    assert all(r.doc_id == r.keep_id for r in out if r.kept)
    left = exactdedup.keep_one(docs)
    assert left.columns == docs.columns
    assert sorted((r.text or "", -1 if r.doc_id is None else r.doc_id) for r in left.collect()) == sorted((t, max(-1 if i is None else i for i, u in EDGE if (u or "") == t)) for t in {t or "" for _, t in EDGE})
    assert exactdedup.report(docs.limit(0)).count() == 0 and exactdedup.keep_one(docs.limit(0)).count() == 0


def test_frequent_digests_are_settled_apart(spark):
    """Few counters: groups of all sizes, some split off, give the same rows; none over the bound is missed."""
    rows = [(k, "hot" if k % 3 == 0 else f"group {k % 7}" if k % 3 == 1 else f"own {k}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for k, least in ((1, 1), (4, 1), (16, 1), (1024, 32)):
        out = exactdedup.report(docs, k, least).collect()
        assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in out) == brute(rows)
    digests = docs.select(exactdedup.digest().alias("digest"))
    found = {bytes(r.digest) for r in exactdedup.frequent(digests, 16, 1).collect()}
    assert len(found) <= 16
    assert {hashlib.sha256(t.encode()).digest() for t, n in Counter(t for _, t in rows).items() if n * 16 > 2 * len(rows)} <= found
    left = exactdedup.keep_one(docs, 4, 1).collect()
    assert sorted((r.doc_id, r.text) for r in left) == sorted({t: (i, t) for i, t in sorted(rows)}.values())


def test_summary_bounds():
    counts = Counter({k: 10 - k for k in range(8)})
    small = exactdedup.reduced(counts, 3)
    assert len(small) <= 3 and small == Counter({0: 3, 1: 2, 2: 1})
    assert exactdedup.reduced(Counter(a=1, b=1), 2) == Counter(a=1, b=1)
