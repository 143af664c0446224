import random
import re

import numpy as np
import pyarrow as pa

from genonet.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0d]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(FOLD))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    comp = {i: i for i, _ in rows}

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= 75 * len(sets[x] | sets[y]):
                a, b = sorted((top(rows[x][0]), top(rows[y][0])))
                comp[b] = a
    return sorted((i, len(s), top(i)) for (i, _), s in zip(rows, sets, strict=True))


def chains(seed, n):
    """Documents in chains of edits, so that components are wider than any link, with a passage that many share."""
    rng, out = random.Random(seed), []
    passage = [f"common{i}" for i in range(60)]
    base = []
    for i in range(n):
        if i % 9 == 0 or not base:
            base = [f"w{rng.randrange(400)}" for _ in range(rng.choice((3, 20, 60, 150, 300)))]
            if rng.random() < 0.5:
                base[len(base) // 2 : len(base) // 2] = passage
        base = list(base)
        for _ in range(rng.choice((0, 1, 1, 2, 3))):
            base[rng.randrange(len(base))] = f"W{rng.randrange(400)}"
        if rng.random() < 0.2:
            base += [f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 8))]
        out.append((i * 3 + 1, rng.choice((" ", "\n", "  ")).join(base)))
    rng.shuffle(out)
    return out


def test_against_brute_force(spark, monkeypatch):
    rows = chains(5, 220) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "One  TWO"), (1005, "one"), (1006, "a b c d e"), (1007, "A b c D e"), (1008, "x " * 30000)]
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, n long")
    assert sorted(map(tuple, jaccard.near_duplicates(docs).collect())) == brute(rows)
    monkeypatch.setattr(jaccard, "TILE", 3)
    monkeypatch.setattr(jaccard, "SMALL", 2)
    monkeypatch.setattr(jaccard, "KEYS", 0)  # no first round: the tiles find every link
    assert sorted(map(tuple, jaccard.near_duplicates(docs).collect())) == brute(rows)


def test_large_group_of_near_copies(spark):
    """Two thousand copies, each with one word of its own: one component, and far fewer pairs than its square."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for i in range(2000):
        words = list(base)
        words[rng.randrange(120)] = f"x{i}"  # two of them share 106 shingles of 126 at least; with two words of its own each, under 0.75
        rows.append((i, " ".join(words)))
    rows += [(3000 + i, " ".join(base[:60] + [f"y{i}-{k}" for k in range(60)])) for i in range(40)]  # half the text only
    handed = []
    links = jaccard._links
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    jaccard._links = lambda d, p: handed.append((p := jaccard.written(p)).count()) or links(d, p)
    try:
        got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    finally:
        jaccard._links = links
    small = brute(rows[:40] + rows[2000:])  # the group is one class of links; the brute-force way takes part of it
    assert {i: c for i, _, c in small if i >= 3000} == {i: c for i, c in got.items() if i >= 3000}
    assert {got[i] for i in range(2000)} == {0} and sum(handed) < 20 * len(rows)


def test_spanning_forest():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n = int(rng.integers(1, 60))
        group, a, b, rank = rng.integers(0, 3, n), rng.integers(0, 12, n), rng.integers(0, 12, n), rng.integers(0, 9, n)
        group, a, b, rank = (x[a != b] for x in (group, a, b, rank))
        some = jaccard.forest(group, a, b, rank)

        def parts(rows):
            up = {}
            top = lambda x: x if up.get(x, x) == x else top(up[x])
            joined = 0
            for k in rows:
                x, y = top((group[k], a[k])), top((group[k], b[k]))
                joined += x != y
                up[x] = y
            return joined, {(g, v): top((g, v)) for g, v in set(zip(group, a, strict=True)) | set(zip(group, b, strict=True))}

        joined, tops = parts(some)
        assert joined == len(some) == parts(range(len(a)))[0]
        assert all(tops[group[k], a[k]] == tops[group[k], b[k]] for k in range(len(a)))


def test_repeats_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (3, "q")], "doc_id long, text string")
    assert sorted(map(repr, map(tuple, jaccard.near_duplicates(docs).collect()))) == sorted(map(repr, [(1, 2, 1), (1, 2, 1), (None, 2, None), (2, 2, 1), (3, 1, 3)]))
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0
    assert sorted(map(repr, (r.doc_id for r in jaccard.keep_one(docs).collect()))) == sorted(["1", "1", "None", "3"])


def test_bitmaps_bound_overlaps():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a = np.unique(rng.integers(0, 900, rng.integers(1, 300))).astype(np.uint64)
        b = np.unique(rng.integers(0, 900, rng.integers(1, 300))).astype(np.uint64)
        both = len(np.intersect1d(a, b))
        got, _, like = jaccard._bound_pairs(np.zeros(2, int), np.array([1, 2]), np.array([1, 2]), np.array([len(a), len(b)]), [jaccard.signature(a), jaccard.signature(b)], np.array([3, 3]), np.array([True, False]))
        if 100 * both >= 75 * (len(a) + len(b) - both):
            assert len(got) == 1 and like[0] >= both / (len(a) + len(b) - both)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 70), (80, 80)], "a long, b long")
    assert {r.node: r.comp for r in jaccard.components(links).collect()} == {**{i: 1 for i in range(1, 41)}, 50: 50, 60: 50, 70: 50}


def test_repeated_ids_of_several_texts(spark, monkeypatch):
    """Id 5 has a copy of document 1 and a text of its own, id 7 copies of two documents."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, a), (5, a), (5, b), (9, f"{b} more"), (2, c), (3, d), (7, c), (7, d), (8, f"{d} more"), (10, "e f g h i j")]
    want = sorted(brute(rows))
    assert {i: top for i, _, top in want} == {1: 1, 5: 1, 9: 1, 2: 2, 3: 2, 7: 2, 8: 2, 10: 10}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.near_duplicates(docs).collect())) == want
    monkeypatch.setattr(jaccard, "KEYS", 0)  # no first round: links lie outside the first shingles
    assert sorted(map(tuple, jaccard.near_duplicates(docs).collect())) == want


def test_near_misses_do_not_hand_on_their_pairs(spark):
    """Four hundred texts any two of which share about 0.68: no link, and far fewer pairs for the exact step than their 79,800; a few true links among them are found."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(9000)}" for _ in range(340)]
    rows = []
    for i in range(400):
        words = list(base)
        for k in range(7):
            words[rng.randrange(40) + 5 + 47 * k] = f"x{i}-{k}"
        rows.append((i, " ".join(words)))
    for i in range(0, 400, 50):
        rows.append((1000 + i, rows[i][1].replace(f"x{i}-0", "other")))
    handed = []
    links = jaccard._links
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    jaccard._links = lambda d, p: handed.append((p := jaccard.written(p)).count()) or links(d, p)
    try:
        got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    finally:
        jaccard._links = links
    assert got == {i: top for i, _, top in brute(rows)}
    assert got[1050] == 50 and got[7] == 7
    assert sum(handed) < 20 * len(rows), handed


def test_runs_of_texts_are_hashed_at_once(monkeypatch):
    """Sets, orders and bitmaps of many texts are those of each by itself, by a number of calls that does not grow with the texts."""
    rng = random.Random(11)
    texts = [None, "", "  ", "a", "a b c d", "a b c d e", "a a a a a a a a"]
    texts += [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(5, 40))) for _ in range(300)]
    calls, mix, unique = [], jaccard.mix, np.unique
    monkeypatch.setattr(jaccard, "mix", lambda h: calls.append(1) or mix(h))
    monkeypatch.setattr(np, "unique", lambda *a, **b: calls.append(1) or unique(*a, **b))
    sets = list(jaccard.shingle_sets(pa.array(texts)))
    assert len(calls) < 20
    monkeypatch.undo()
    assert [len(s) for s in sets] == [n for _, n, _ in brute(list(enumerate(texts)))]
    for s, t in zip(sets, texts, strict=True):
        (own,) = jaccard.shingle_sets(pa.array([t], pa.string()))
        assert (np.diff(s.astype(object)) > 0).all() and s.tolist() == own.tolist()
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    rank = np.random.default_rng(1).permutation(jaccard.SKETCH).astype(np.uint64)
    flat = jaccard.ordered(np.concatenate(sets), at, rank)
    for k, s in enumerate(sets):
        assert flat[at[k] : at[k + 1]].tolist() == sorted(int(rank[int(x) % jaccard.SKETCH]) << 48 | int(x) >> 16 for x in s)
    bits = jaccard.signatures(mix(flat), at, 16, 1 << 17).to_pylist()
    for k, b in enumerate(bits):
        width, s = 8 * len(b), mix(flat[at[k] : at[k + 1]])
        assert width == (max(64, 1 << (16 * len(s) - 1).bit_length()) if len(s) else 0)
        assert int.from_bytes(b, "little") == sum(1 << x for x in {int(h) % width for h in s})


def test_lists_and_pairs_of_a_tile():
    lists = pa.array([[0], [3, 1], None, [], [5]], pa.list_(pa.int64())).slice(1)
    assert [None if x is None else x.tolist() for x in jaccard._each(lists)] == [[3, 1], None, [], [5]]
    assert jaccard._distinct(np.array([5, 1, 5, 2, 1]), np.array([1, 5, 2, 5, 0])).tolist() == [[0, 1], [1, 5], [2, 5]]
    assert jaccard._distinct(np.zeros(0, np.int64), np.zeros(0, np.int64)).shape == (0, 2)
