import os
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from genonet.llm import common, jaccard

AT = "/root/testdata/sf0.001"


def folders(spark):
    common.scratch_dir(spark)  # the first call settles where they lie
    return set(os.listdir(os.path.dirname(common.scratch_dir(spark).removeprefix("file:"))))


def test_stages_leave_no_more_than_one_table(spark):
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = folders(spark)
        docs = stage(spark, docs, AT)
        assert len(folders(spark) - before) <= 1, name
    assert docs.count() > 0


def test_pipeline_leaves_its_result_only(spark):
    before = folders(spark)
    out = corpus_pipeline.run(spark, AT)
    assert len(folders(spark) - before) == 1 and out.where("round_trip").count() == out.count() > 0


def test_passing_tables_go_after_a_failure_and_lasting_ones_stay(spark):
    before, kept = folders(spark), []
    with pytest.raises(ZeroDivisionError), common.passing(spark):
        common.written(spark.range(3))
        with common.passing(spark) as lasting:
            common.written(spark.range(4))
            kept.append(lasting(spark.range(5)))
        assert len(folders(spark) - before) == 2 and kept[0].count() == 5  # it stays as long as what the outer block wrote
        1 / 0
    assert folders(spark) == before


def test_written_tables_leave_no_shuffle_files(spark):
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: {f for d in manager.localDirsString() for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    before = files()
    assert common.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()).count() == 7
    # the count's own exchange is all that may be left
    assert len({f.split("_")[1] for f in files() - before}) <= 1


def test_bitmaps_travel_in_proportion_to_their_bits(spark):
    bits = np.random.default_rng(5).choice(jaccard.ID_BITS, 1000, replace=False)
    sent = pickle.dumps(jaccard._bitmap(spark.createDataFrame([(int(b),) for b in bits], "bit long")))
    assert len(sent) < 200_000
    back = pickle.loads(sent)
    assert back.has(bits).all() and back.has(np.arange(jaccard.ID_BITS)).sum() == 1000
