"""Exact dedup: equal texts by digest, with the frequent digests split off and settled without a shuffle.

One pass over the texts writes a narrow table of doc_id, row number and SHA-256 digest; all else
reads that. Each task sums up its digests in a Misra-Gries summary of ``COUNTERS`` counters. The
summaries' counts, added up by digest, fall short of the true ones by less than rows / COUNTERS, so that
at most COUNTERS digests reach rows / COUNTERS and none with twice as many rows is missed. For
these candidates a second pass verifies count and winner exactly (each task sends a row for each
candidate at most). The verified winners, COUNTERS rows at most, are broadcast: rows of frequent digests
are settled where they are read. All other digests, each with under 2 / COUNTERS of the rows, go
through an ordinary shuffle. So the largest group that meets in a task is bounded by that share,
whatever one text's share of the corpus; which digests count as frequent never changes the result.

Texts are equal when their UTF-8 bytes have the same SHA-256 digest; null counts as empty. Of
equal texts the row with the largest doc_id stays; a null doc_id is smaller than any other. Defined
results: rows that share text and doc_id are ties, of which one stays; every group keeps exactly one
row. Extra columns are ignored by report() and kept by keep_one(), also where they have the names
used here. An empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Counters of a summary: bounds the broadcast table's rows and the share of a group that is shuffled.
COUNTERS = 1024
#: Groups under so many rows are not worth splitting off.
LEAST = 32


def digest(column: str = "text"):
    return F.unhex(F.sha2(F.coalesce(F.col(column), F.lit("")), 256))


def reduced(counts: Counter, k: int) -> Counter:
    """At most k counters: all are lowered by the k+1st largest, and those that reach 0 go (Misra-Gries, many items at once)."""
    if len(counts) <= k:
        return counts
    cut = sorted(counts.values(), reverse=True)[k]
    return Counter({x: n - cut for x, n in counts.items() if n > cut})


def frequent(rows: DataFrame, k: int = COUNTERS, least: int = LEAST) -> DataFrame:
    """digest: at most k of them, among which is each that has over 2 / k of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            counts.update(batch.column(0).to_pylist())
            counts = reduced(counts, k)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["digest", "n"])

    total = rows.count()
    parts = rows.select("digest").mapInArrow(run, "digest binary, n long")
    # a row for each counter of a task, so a digest meets as many rows as there are tasks at most
    return parts.groupBy("digest").agg(F.sum("n").alias("n")).where((F.col("n") * k >= total) & (F.col("n") >= least)).select("digest")


def winners(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """digest, top (doc_id and row of the one that stays), size: counted over all rows of the candidates."""
    return rows.join(F.broadcast(candidates), "digest").groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count(F.lit(1)).alias("size"))


def assigned(docs: DataFrame, k: int = COUNTERS, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """doc_id, row, digest, top and size of every row; and the frequent digests' winners."""
    rows = written(docs.select("doc_id", digest().alias("digest"), F.monotonically_increasing_id().alias("row")))
    best = written(winners(rows, written(frequent(rows, k, least))))  # k rows at most
    heavy = rows.join(F.broadcast(best), "digest")
    group = Window.partitionBy("digest")
    light = rows.join(F.broadcast(best.select("digest")), "digest", "left_anti")
    light = light.withColumn("top", F.max(F.struct("doc_id", "row")).over(group)).withColumn("size", F.count(F.lit(1)).over(group))
    return heavy.unionByName(light), best


def report(docs: DataFrame, k: int = COUNTERS, least: int = LEAST) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    rows, _ = assigned(docs, k, least)
    return rows.select("doc_id", F.col("top.doc_id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("top.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame, k: int = COUNTERS, least: int = LEAST) -> DataFrame:
    """The rows that stay, with all their columns.

    Rows of frequent digests that do not win go before anything is shuffled. The others that go are
    found by an anti-join on doc_id and digest, a broadcast one where Spark finds them few.
    """
    rows, best = assigned(docs, k, least)
    same = F.struct("doc_id", "digest")
    rows = written(rows.where("size > 1").select(same.alias("key"), F.col("doc_id").eqNullSafe(F.col("top.doc_id")).alias("wins"), (F.col("row") == F.col("top.row")).alias("kept")))
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.struct("doc_id", digest().alias("digest")).alias("_key"))
    top = best.select(F.col("digest").alias("_digest"), F.col("top.doc_id").alias("_id"))
    whole = whole.join(F.broadcast(top), F.col("_key.digest") == F.col("_digest"), "left").where(F.col("_digest").isNull() | F.col("_key.doc_id").eqNullSafe(F.col("_id"))).select("_row", "_key")
    lost = rows.where("not wins").select(F.col("key").alias("_lost")).distinct()
    whole = whole.join(lost, F.col("_key").eqNullSafe(F.col("_lost")), "left_anti")
    ties = written(rows.where("wins and not kept").select(F.col("key").alias("_tie")).distinct())
    if not ties.isEmpty():  # rows equal in text and doc_id: one of each
        tied = whole.join(ties, F.col("_key").eqNullSafe(F.col("_tie")), "left_semi").dropDuplicates(["_key"])
        whole = whole.join(ties, F.col("_key").eqNullSafe(F.col("_tie")), "left_anti").unionByName(tied)
    return whole.select("_row.*")
