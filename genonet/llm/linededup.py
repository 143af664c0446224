"""Line deduplication over levelled sorted runs of line hashes.

The store of known lines is a set of runs, each a table of 128-bit line hashes and the document
that keeps the line, bucketed and sorted by hash, its files in the shared folder. Documents come in
batches of ascending doc_id. Texts are split and hashed once, into a table of line hashes that the
batches are cut from; texts are read again only to leave lines out. A batch's line hashes are merge-joined with the runs, which are read
as they lie, without an exchange or a sort; what no run holds becomes a new run of level 0. When a level has ``fanout`` runs they are merged into one of the
next level, so that a batch joins a number of runs that grows with the logarithm of the batches.
Runs never share a hash, as each holds only what the earlier ones lacked.

A line's key is the line without white space (space, tab to carriage return) at both ends, A-Z
lower-cased. Lines whose key has ``min_chars`` code points or more stay in the smallest doc_id
that holds the key, all of them, and go from every other document.

Defined results: null or empty text is one empty line, which stays. Rows that repeat a doc_id are
one document: neither drops the other's lines; a row with a null doc_id keeps all its lines and
takes none from others. Shorter keys always stay. Extra columns pass through drop_lines().
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, passing, scratch_dir, shuffles_dropped, written

MIN_CHARS = 10
BATCHES = 4
FANOUT = 3
HOT = 10_000

RUN = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("first_doc", T.LongType())])


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    edge = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    return ascii_lower(edge)


def keyed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, the row's text hash, line number from 0 and the 128-bit hash of every key that is long enough."""
    lines = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(split_lines(F.col("text"))).alias("line_no", "line"))
    keyed = lines.select("doc_id", "t", "line_no", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select("doc_id", "t", "line_no", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(77), F.col("key")).alias("h2"))


@contextlib.contextmanager
def sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Plans made inside take the order of a bucketed table's files, one for each bucket, as it is written; the session's own setting comes back after."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    own = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, own)


class LineRuns:
    """Levelled runs of line hashes. levels[k] names the tables of level k's runs, each bucketed and sorted by hash."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, root: str | None = None) -> None:
        self.spark, self.fanout, self.root = spark, fanout, root or scratch_dir(spark)
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}
        self.count = 0
        self.home = f"genonet_runs_{uuid.uuid4().hex}"  # a database of its own, so that no name meets the user's tables
        spark.sql(f"CREATE DATABASE {self.home} LOCATION '{self.root}/home'")

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def known(self) -> DataFrame:
        """h1, h2 and first_doc of all runs."""
        runs = [self.spark.table(name) for name in self.names()]
        return reduce(DataFrame.unionByName, runs) if runs else self.spark.createDataFrame([], RUN)

    def _write(self, run: DataFrame) -> str:
        """A table of one file for each bucket, so that joins read it as it lies: no exchange stands over a run."""
        name, self.count = f"{self.home}.run_{uuid.uuid4().hex}", self.count + 1
        rows = run.select(*[F.col(f.name) for f in RUN]).repartition(self.buckets, "h1", "h2")
        self.paths[name] = f"{self.root}/run-{self.count:05d}"
        with shuffles_dropped(self.spark):
            rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", self.paths[name]).saveAsTable(name)
        return name

    def add(self, run: DataFrame) -> None:
        """Adds a run of hashes that no run holds, and merges full levels."""
        self._place(self._write(run), 0)

    def _place(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            # read as plain files: taken as buckets, their union would be written in as many files a bucket as it has runs
            merged = self._write(self.spark.read.schema(RUN).parquet(*[self.paths.pop(x) for x in old]))
            self.levels[level] = []
            self._drop(old)
            self._place(merged, level + 1)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def close(self) -> None:
        """Takes the runs' names out of the session's catalog; their files stay in the scratch folder."""
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.home} CASCADE")
        self.levels = []

    def looked_up(self, keys: DataFrame) -> DataFrame:
        """keys (h1, h2, ...) with kept_doc from the run that holds the hash, else null: one merge join a run."""
        keys = keys.withColumn("kept_doc", F.lit(None).cast("long"))
        for name in self.names():
            run = self.spark.table(name).select("h1", "h2", F.col("first_doc").alias("found"))
            keys = keys.join(run.hint("merge"), ["h1", "h2"], "left").withColumn("kept_doc", F.coalesce("kept_doc", "found")).drop("found")
        return keys

    def take(self, batch: DataFrame) -> DataFrame:
        """Adds a batch of keyed lines; returns the lines of it that go: doc_id, t, line_no."""
        keys = batch.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count(F.lit(1)).alias("n"))
        with sorted_scans(self.spark):
            keys = written(self.looked_up(keys))
        self.add(keys.where("kept_doc is null"))
        shared = keys.where("kept_doc is not null or last_doc > first_doc").select("h1", "h2", F.coalesce("kept_doc", "first_doc").alias("kept_doc"), "n")
        return written(_met(batch, shared).where("doc_id <> kept_doc").select("doc_id", "t", "line_no"))


def _met(batch: DataFrame, shared: DataFrame) -> DataFrame:
    """batch joined to the shared keys. Keys of more than 1/HOT of the lines, under HOT of them, go out by broadcast, so that no task gets a line that most documents hold."""
    total = shared.agg(F.sum("n")).first()[0] or 0
    hot = shared.where(F.col("n") > total / HOT)
    if total <= HOT or hot.isEmpty():
        return batch.join(shared, ["h1", "h2"])
    hot = F.broadcast(hot.select(F.col("h1").alias("x1"), F.col("h2").alias("x2"), F.col("kept_doc").alias("hot_doc")))  # under HOT rows
    marked = batch.join(hot, (F.col("h1") == F.col("x1")) & (F.col("h2") == F.col("x2")), "left")
    columns = [*batch.columns, "kept_doc"]
    rest = marked.where("hot_doc is null").join(shared, ["h1", "h2"]).select(*columns)
    return marked.where("hot_doc is not null").withColumn("kept_doc", F.col("hot_doc")).select(*columns).unionByName(rest)


def _cuts(docs: DataFrame, batches: int) -> list[int]:
    """Upper doc_ids of all batches but the last."""
    at = docs.select(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000).alias("q")).first()[0] if batches > 1 else []
    return sorted(set(at or []))


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """doc_id, t (hash of the row's text) and gone, the sorted numbers of the lines that go."""
    with passing(docs.sparkSession) as lasting:
        lines = written(keyed_lines(docs, min_chars))  # once: a batch is read up to three times
        runs, cuts, found = LineRuns(docs.sparkSession, fanout), _cuts(docs, batches), None
        try:
            for low, high in zip([None, *cuts], [*cuts, None], strict=True):
                batch = lines
                if low is not None:
                    batch = batch.where(F.col("doc_id") > low)
                if high is not None:
                    batch = batch.where(F.col("doc_id") <= high)
                gone = runs.take(batch)
                found = gone if found is None else found.unionByName(gone)
        finally:
            runs.close()
        return lasting(found.groupBy("doc_id", "t").agg(F.array_sort(F.collect_set("line_no")).alias("gone")))


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT, counts: tuple[str, str] | None = None) -> DataFrame:
    """The documents with repeated lines taken out of ``text``; counts: names of columns to add for lines before and lines dropped."""
    gone = dropped_lines(docs.select("doc_id", "text"), min_chars, batches, fanout)
    gone = gone.select(F.col("doc_id").alias("g_doc"), F.col("t").alias("g_t"), F.col("gone").alias("g_gone"))
    text = F.col("d.text")
    joined = docs.alias("d").join(gone.alias("g"), (F.col("d.doc_id") == F.col("g.g_doc")) & (F.xxhash64(text) == F.col("g.g_t")), "left")
    lines = split_lines(text)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("g.g_gone"))
    new = F.when(F.col("g.g_gone").isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    out = [new.alias("text") if c == "text" else F.col(f"d.`{c}`") for c in docs.columns]
    if counts:
        out += [F.size(lines).cast("long").alias(counts[0]), F.coalesce(F.size("g.g_gone"), F.lit(0)).cast("long").alias(counts[1])]
    return joined.select(*out)


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of drop_lines()."""
    out = drop_lines(docs.select("doc_id", "text"), counts=("n_lines", "n_dropped"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
