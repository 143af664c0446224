import re
from collections import Counter

import pyspark.sql.functions as F

from genonet.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top=200):
    rows = [(lang or "", source or "", TERM.findall((text or "").translate(FOLD))) for lang, source, text in rows]
    docs, counts = Counter(), Counter()
    for lang, source, terms in rows:
        docs.update({(lang, t) for t in terms})
        counts.update((lang, source, t) for t in terms)
    out = []
    for lang in {r[0] for r in rows}:
        kept = sorted(t for (x, t), n in docs.items() if x == lang and n >= 3)
        sources = sorted({s for x, s, _ in rows if x == lang})
        count = {s: {t: counts[lang, s, t] for t in kept} for s in sources}
        share = lambda c: {t: 1 + 10**9 * (n + 1) // (sum(c.values()) + len(kept)) for t, n in c.items()}
        p = {s: share(count[s]) for s in sources}
        q = share({t: sum(count[s][t] for s in sources) for t in kept})
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


def audited(spark, rows, **how):
    docs = spark.createDataFrame([(k, *r, "clash") for k, r in enumerate(rows)], "doc_id long, lang string, source string, text string, term string").repartition(5)
    return sorted(tuple(r) for r in divergence.audit(docs, **how).collect())


EDGE = [
    ("en", "a", "The the THE cat1cat_dog é"), ("en", "a", None), ("en", "b", ""), ("en", "b", "the Cat É dog the"), ("en", "c", "dog the é"), ("en", "d", "12 34 _ []"), ("en", "a", "the cat's é dog"),
    ("de", "a", "eins zwei"), ("de", "b", "zwei drei"), (None, None, "x y z"), (None, "", "x y"), (None, "q", "x X x"), ("", "r", "y Y"), ("fr", "solo", "le le la"), ("fr", "solo", "le la"), ("fr", "solo", "le la"), ("xx", "e1", None), ("xx", "e2", ""),
    ("en", "long", "word " * 40000 + "the"), ("en", "long", "x" * 100000), ("en", "é", "the É é"), ("en", "a", "The the THE cat1cat_dog é"),
]


def test_odd_rows(spark):
    assert audited(spark, EDGE) == brute(EDGE)
    assert audited(spark, []) == []
    assert audited(spark, [("a", "b", None)]) == []


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("lang", "source", "text").collect()]
    assert audited(spark, rows) == brute(rows)
    assert audited(spark, rows, top=3) == brute(rows, 3)


def test_blocks_and_small_tasks(spark):
    """Terms written out early, sources in several blocks, a sketch merged in several rounds."""
    rows = [(f"l{k % 2}", f"s{k % 23}", " ".join(f"w{chr(97 + k * j % 17)}" for j in range(k % 29))) for k in range(400)]
    want = brute(rows)
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(9)
    cells, groups = divergence.kept_counts(docs)
    for block in (3, 512):
        out = divergence.pair_part(cells, groups, block).unionByName(divergence.term_part(cells, groups))
        assert sorted(map(tuple, out.collect())) == want
    parts = divergence.counted(docs, flush=5)
    assert parts.count() > divergence.counted(docs).count()
    total = lambda df: sorted(map(tuple, df.where("term is not null").groupBy("lang", "source", "term").agg(F.sum("n"), F.sum("docs")).collect()))
    assert total(parts) == total(divergence.counted(docs))


def test_sketch_never_underestimates(spark):
    """Every key whose counts reach the bound passes, at any width and fan; a wide sketch lets few others through."""
    rows = spark.range(6000).select(F.xxhash64(F.col("id") % 4000).alias("h"), F.lit(1).cast("long").alias("docs"), "id").repartition(7)
    more = rows.unionByName(rows.where("id < 500")).repartition(7)
    true = {r.h for r in more.groupBy("h").agg(F.sum("docs").alias("n")).where("n >= 3").collect()}
    assert len(true) == 500
    for width in (1 << 8, 1 << 12, 1 << 18):
        got = {r.h for r in divergence.possible(more, width, 7).collect()}
        assert true <= got
    assert len(got) < 510
    merged = divergence.sketch(more, 1 << 18, 7, fan=2).collect()
    assert sorted((r.row, r.block, divergence.unpacked(bytes(r.cells)).sum()) for r in merged) == sorted((r.row, r.block, divergence.unpacked(bytes(r.cells)).sum()) for r in divergence.sketch(more, 1 << 18, 7).collect())
