import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from genonet.llm import tokencount, tokenorc

SP = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
HF = Tokenizer.from_file(P.path("word_bpe_49k.json"))
ODD = "abeEéß’' ,.!?()\n\t\r ́▁​中日😀<s></s><|endoftext|>0123$%&_-ŉİſΣς\x00\x1c\x85²½"
texts = st.one_of(st.text(max_size=60), st.text(alphabet=ODD, max_size=60), st.lists(st.sampled_from(["The", "thing", "isn't", "it's", "  ", "\n", "été", "über", "a.b", ",.", "İx", "ﬁ", "X²", "$$$", "12", "<|endoftext|>", "é", "<s>", "word,", "x.y"]), max_size=20).map(" ".join))


@settings(max_examples=400, deadline=None)
@given(texts)
def test_count_is_the_librarys(text):
    text = text.encode("utf-8", "ignore").decode()
    assert tokencount.counter(tokencount.model_path()).count(text) == len(SP.encode(text))


@settings(max_examples=400, deadline=None)
@given(texts)
def test_ids_are_the_librarys(text):
    text = text.encode("utf-8", "ignore").decode()
    own, want = tokenorc.encoder(tokenorc.vocabulary()), HF.encode(text, add_special_tokens=False).ids
    ids, sizes = own.column(pa.array([text, None, "", text]), 2)
    assert ids.tolist() == [*want, 2, 2, 2, *want, 2] and sizes.tolist() == [len(want) + 1, 1, 1, len(want) + 1]


EDGE = [(3, None), (1, ""), (2, "Hello world, it's été"), (9, "x" * 5000), (9, "again"), (7, "a " * 9000), (8, "<|endoftext|> <s>"), (4, " \n\t")]


def test_token_counts(spark):
    docs = spark.createDataFrame([(i, t, 5) for i, t in EDGE], "doc_id long, text string, n_tokens int")
    want = sorted((i, len((t or "").encode()), len(SP.encode(t or "")), len(SP.encode(t or "")) > 4096) for i, t in EDGE)
    assert sorted(map(tuple, tokencount.report(docs).collect())) == want
    assert tokencount.report(docs.limit(0)).count() == 0


def test_orc_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, 5) for i, t in EDGE], "doc_id long, text string, ids int").repartition(3)
    rows, at, want = sorted(EDGE, key=lambda r: (r[0], r[1] or "")), 0, {}
    for i, t in rows:
        ids = [*HF.encode(t or "", add_special_tokens=False).ids, 2]
        want.setdefault(i, []).append((at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = tokenorc.report(docs, out=str(tmp_path / "ids")).collect()
    assert len(got) == len(EDGE)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted((i, *x) for i, xs in want.items() for x in xs)
    files = tokenorc.read_ids(spark, str(tmp_path / "ids")).orderBy("part", "row").collect()
    stream = [i for r in files for i in r.ids]
    for r in got:  # each place is where the files hold these ids
        assert zlib.crc32(np.array(stream[r.start : r.start + r.n_tokens], "<u4").tobytes()) == r.ids_crc32
    back = tokenorc.read_ids(spark, str(tmp_path / "ids")).where("doc_id = 2").collect()
    assert back[0].ids == [*HF.encode(EDGE[2][1], add_special_tokens=False).ids, 2]
    assert tokenorc.report(docs.limit(0), out=str(tmp_path / "none")).count() == 0


def test_stripes_and_pruning(spark, tmp_path):
    """Files have several stripes with row indexes and Bloom filters, which tasks share and filters skip by."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        docs = spark.range(24_000).select((F.col("id") * 2).alias("doc_id"), F.concat(F.lit("words and more words "), F.sha2(F.col("id").cast("string"), 256)).alias("text"))
        out = str(tmp_path / "ids")
        tokenorc.write_ids(docs.coalesce(1), out, stripe_bytes=1 << 16)
        jvm, names = spark._jvm, [str(p) for p in (tmp_path / "ids").glob("*.orc")]
        stripes = 0
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(name)
            reader = jvm.org.apache.orc.OrcFile.createReader(path, jvm.org.apache.orc.OrcFile.readerOptions(spark.sparkContext._jsc.hadoopConfiguration()))
            rows = reader.rows()
            for s in reader.getStripes():
                kinds = {str(x.getKind()) for x in rows.readStripeFooter(s).getStreamsList()}
                assert "ROW_INDEX" in kinds and kinds & {"BLOOM_FILTER", "BLOOM_FILTER_UTF8"}
                stripes += 1
            rows.close()
        assert stripes > len(names)

        def read(where):
            found = tokenorc.read_ids(spark, out).where(where).select("doc_id")
            rows = found.collect()
            scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
            return len(rows), scan.metrics().apply("numOutputRows").value()

        assert read("doc_id >= 0") == (24_000, 24_000)
        n, seen = read("doc_id = 20000")  # the index rules out all other groups of rows
        assert n == 1 and seen <= 2 * tokenorc.INDEX_ROWS
        n, seen = read("doc_id = 20001")  # inside the range of one group: only its Bloom filter rules it out
        assert n == 0 and seen == 0
        spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 17)
        parts = tokenorc.read_ids(spark, out)
        assert parts.rdd.getNumPartitions() > len(names) and parts.count() == 24_000  # a file is read by several tasks
    finally:
        for key in ("spark.sql.adaptive.enabled", "spark.sql.files.maxPartitionBytes"):
            spark.conf.unset(key)


@pytest.mark.parametrize("name", ["documents"])
def test_whole_table(spark, name):
    docs = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in tokencount.report(docs).collect()} == {i: len(SP.encode(t)) for i, t in texts.items()}
    assert {r.doc_id: r.n_tokens for r in tokenorc.report(docs).collect()} == {i: len(HF.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}
