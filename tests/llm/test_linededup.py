import hashlib
import random

import pytest
from pyspark.sql import functions as F

from genonet.llm import linededup

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    """doc_id, lines, dropped lines and the digest of what stays, for every row."""
    first = {}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= 10:
                    first[key(line)] = min(i, first.get(key(line), i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or first.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(map(repr, out))


EDGE = [
    (5, None), (6, ""), (7, "\n\n"), (8, "short\nshort"), (9, "0123456789\n012345678"), (3, " \t0123456789\r\nABCDEFGHIJ"), (4, "abcdefghij\n\x0babcdefghij\x0c"), (3, "abcdefghij"), (3, "abcdefghij"),
    (None, "abcdefghij\nnull keeps its lines"), (None, None), (10, "null keeps its lines"), (11, "É0123456789\né0123456789\nÉ0123456789"), (12, "é0123456789 "), (13, "0123456789 " * 9000), (14, "x\n" * 20000 + "0123456789"),
]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in EDGE], "doc_id long, text string, n_lines int")
    assert sorted(repr(tuple(r)) for r in linededup.report(docs).collect()) == brute(EDGE)
    assert linededup.report(docs.limit(0)).count() == 0
    out = linededup.drop_lines(docs)
    assert out.columns == docs.columns and out.count() == len(EDGE)


def test_many_batches_and_merges(spark, monkeypatch):
    """More batches than the fan-out, so that runs are merged twice, and hot lines by the broadcast way too."""
    rng = random.Random(3)
    pool = [f"a line that comes again {k}" for k in range(300)]
    rows = [(k, "\n".join([*(rng.choice(pool) for _ in range(rng.randrange(6))), "the line in every document", f"own line number {k}"])) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (linededup.HOT, 20):
        monkeypatch.setattr(linededup, "HOT", hot)
        out = linededup.drop_lines(docs, batches=11, fanout=2, counts=("n", "d")).collect()
        assert sorted(repr((r.doc_id, r.n, r.d, hashlib.sha256(r.text.encode()).hexdigest())) for r in out) == brute(rows)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("run_")]


def test_levels_and_plan(spark):
    runs = linededup.LineRuns(spark, fanout=2)
    for k in range(5):
        rows = spark.createDataFrame([(j, j * 7, j) for j in range(k * 10, k * 10 + 10)], linededup.RUN)
        runs.add(rows)
    assert [len(x) for x in runs.levels] == [1, 0, 1] and runs.known().count() == 50
    keys = spark.createDataFrame([(3, 21), (44, 308), (3, 22)], "h1 long, h2 long")
    with linededup.sorted_scans(spark):
        found = runs.looked_up(keys)
        found._jdf.queryExecution().executedPlan()
    assert {(r.h1, r.h2): r.kept_doc for r in found.collect()} == {(3, 21): 3, (44, 308): 44, (3, 22): None}
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange hashpartitioning") == 1  # the keys' own; none over a run
    assert plan.count("Bucketed: true") == 2
    assert plan.count("Sort [") == 1  # the keys' own as well; the runs come sorted
    runs.close()


def test_a_failure_leaves_no_tables(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"some line number {k % 7}\nanother line") for k in range(60)], "doc_id long, text string")
    take, calls = linededup.LineRuns.take, []

    def failing(self, batch):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return take(self, batch)

    monkeypatch.setattr(linededup.LineRuns, "take", failing)
    with pytest.raises(RuntimeError, match="lost"):
        linededup.drop_lines(docs)
    assert not [d for d in spark.catalog.listDatabases() if d.name.startswith("genonet_runs")]
    assert spark.conf.get("spark.sql.legacy.bucketedTableScan.outputOrdering") == "false"


def test_texts_are_hashed_once(spark):
    """However many batches there are and whether or not lines are hot, every text is split and hashed in one pass."""
    seen = spark.sparkContext.accumulator(0)

    def read(text):
        seen.add(1)
        return text

    rows = [(k, f"own line number {k}\na line that comes again {k % 9}\nthe line in every document") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text", F.udf(read, "string")("text"))
    gone = linededup.dropped_lines(docs, batches=3)
    assert seen.value == 60
    assert sum(len(r.gone) for r in gone.collect()) == 51 + 59
