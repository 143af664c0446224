import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from genonet.llm import quality

from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_jaccard import brute as brute_near
from tests.llm.test_pieces import brute as brute_pieces

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_lines(rows):
    first = {}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    for i, t in sorted(rows):
        for line in t.split("\n"):
            if len(key(line)) >= 10:
                first.setdefault(key(line), i)
    return [(i, "\n".join(x for x in t.split("\n") if first.get(key(x), i) == i)) for i, t in rows]


def test_names_and_columns():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard", "decontamination", "sentencepiece"]


def test_against_brute_force(spark):
    at = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    model = quality.Ratio(docs, spark.read.parquet(f"{at}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in model.judged(docs).where("q.kept").collect()]
    rows = brute_lines(rows)
    rows = [r for r, (i, _, c) in zip(sorted(rows), brute_near(rows), strict=True) if i == c]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()]
    clean = {h[0] for h in brute_hits(rows, items) if not h[5]}
    want = {i: t for i, t in rows if i in clean}
    got = corpus_pipeline.run(spark, at).collect()
    assert len(got) == len(want) and {r.doc_id for r in got} == set(want) and all(r.round_trip for r in got)
    assert {r.doc_id: r.n_bytes for r in got} == {i: len(t.encode()) for i, t in want.items()}
    for r in got:
        assert (r.n_pieces, r.ids_crc32) == (len(ids := brute_pieces(want[r.doc_id])), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_stages_keep_columns_and_take_empty_tables(spark):
    at = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{at}/documents.parquet").withColumn("hits", F.lit(1)).withColumn("q", F.lit(2)).withColumn("component_id", F.lit(3))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), at)
        assert out.columns == docs.columns and out.count() == 0
        assert stage(spark, docs.limit(30), at).columns == docs.columns
