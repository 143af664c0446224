"""Source divergence audit: which terms a source uses more than its language does, and how far sources of a language lie apart.

A term is a maximal run of ASCII letters and non-ASCII characters, A-Z lower-cased. One pass over the
texts writes, for each task, a row for each language, source and term with its occurrences and documents. A
count-min sketch of document frequencies by language and term is filled from these rows: each task
gives the cells that it touched, packed to two bits as the bound of 3 asks for no more, and the parts
are merged by 64 until there is one. A sketch never underestimates, so a term with a cell under the
bound cannot be kept, and its rows go before the shuffle. The survivors' document frequencies
are then counted exactly, and terms under the bound that the sketch let through go too.

Shares are integers: p = 1 + floor(10^9 (count + 1) / (N + V)), for V kept terms of the language and N
their occurrences in the group (a source, or the whole language). The distance of two shares is
f(p, q) = floor((p - q)^2 / q). Sums over all kept terms are sparse: what two sources that
both lack a term add is one constant, what one of them lacks hangs on the other's count alone and
comes from its histogram of counts, and only terms that both have are joined. Terms of very many
sources are dealt to blocks of sources, so that no key of the join holds more than BLOCK^2 pairs.

Bounds: the sketch has DEPTH rows of ``width`` cells, which follows the number of distinct terms up
to WIDEST; of it a bit a cell is broadcast. A task holds at most FLUSH terms before it writes them out, and
DEPTH * width bytes for its part of the sketch.

Defined results: null text, language or source counts as ''; every row is a document, also repeated
ones; a group without a kept term has pairs but no terms, and where a language keeps none its pairs
have value 0. Ties in value are ranked by the UTF-8 bytes of the item. Extra columns are ignored.
An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, mix, tidy, written

LEAST_DOCS = 3
TOP = 200
ONE = 1_000_000_000
DEPTH = 2
WIDEST = 1 << 26
#: Cells of a packed part of the sketch.
CELLS = 1 << 16
FAN = 64
FLUSH = 1_000_000
#: Sources of a block of the pair join.
BLOCK = 512

#: Bytes of terms stay, A-Z in lower case; all others become spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def counted(docs: DataFrame, flush: int = FLUSH) -> DataFrame:
    """lang, source, term, n, docs: counts by task. A row with a null term stands for each group that occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in groups.items():
                terms = [None, *n]
                sizes, seen = [0, *n.values()], [0, *map(docs.__getitem__, n)]
                for at in range(0, len(terms), 1 << 16):
                    part = pa.array(terms[at : at + (1 << 16)], pa.binary())
                    k = len(part)
                    yield pa.RecordBatch.from_arrays([pa.repeat(lang, k), pa.repeat(source, k), part.cast(pa.string()), pa.array(sizes[at : at + k], pa.int64()), pa.array(seen[at : at + k], pa.int64())], names=["lang", "source", "term", "n", "docs"])
            groups.clear()

        for batch in cut(batches):
            lang, source = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for key, text in zip(zip(lang, source, strict=True), batch.column(2).cast(pa.large_binary()).to_pylist(), strict=True):
                if (both := groups.get(key)) is None:
                    both = groups[key] = (Counter(), Counter())
                words, before = text.translate(_FOLD).split(), len(both[0])
                both[0].update(words)
                both[1].update(set(words))
                held += len(both[0]) - before + 1
                if held > flush:
                    yield from out()
                    held = 0
        yield from out()

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(blank("lang"), blank("source"), blank("text")).mapInArrow(tidy(run), "lang string, source string, term string, n long, docs long")


# ---- the sketch ----


def cells_of(h: np.ndarray, width: int) -> list[np.ndarray]:
    """The cell of each key in every row."""
    return [(mix(h.view(np.uint64) + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & np.uint64(width - 1)).astype(np.int64) for k in range(DEPTH)]


def packed(cells: np.ndarray) -> bytes:
    """Counters 0 to 3, four a byte, compressed."""
    c = cells.reshape(-1, 4)
    return zlib.compress((c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    b = np.frombuffer(zlib.decompress(data), np.uint8)
    return np.stack([b & 3, b >> 2 & 3, b >> 4 & 3, b >> 6], axis=1).ravel()


def sketch(terms: DataFrame, width: int, parts: int, fan: int = FAN) -> DataFrame:
    """row, block and cells of the merged sketch of ``terms`` (h, docs); parts: the tasks that read them."""
    block = min(CELLS, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = np.zeros((DEPTH, width), np.uint8)
        for batch in batches:
            h, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            n = np.minimum(n, LEAST_DOCS).astype(np.uint8)
            for k, at in enumerate(cells_of(h, width)):
                where, inverse = np.unique(at, return_inverse=True)
                more = np.minimum(np.bincount(inverse, n), LEAST_DOCS)
                rows[k, where] = np.minimum(rows[k, where] + more, LEAST_DOCS).astype(np.uint8)
        at = np.argwhere(rows.reshape(DEPTH, -1, block).any(axis=2))
        for some in np.array_split(at, max(1, len(at) // 256)):
            own = [packed(rows[k, b * block : (b + 1) * block]) for k, b in some.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(some[:, 0], pa.int32()), pa.array(some[:, 1], pa.int32()), pa.repeat(pa.scalar(TaskContext.get().partitionId(), pa.int32()), len(some)), pa.array(own, pa.binary())], names=["row", "block", "part", "cells"])

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        total = np.zeros(block, np.uint8)
        for data in rows.column("cells").to_pylist():
            total = np.minimum(total + unpacked(data), LEAST_DOCS).astype(np.uint8)
        return pa.table({"row": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "part": pa.array([key[2].as_py()], pa.int32()), "cells": pa.array([packed(total)], pa.binary())})

    kind = "row int, block int, part int, cells binary"
    out = terms.select("h", "docs").mapInArrow(tidy(run), kind)
    while True:
        out = out.withColumn("part", F.floor(F.col("part") / fan).cast("int")).groupBy("row", "block", "part").applyInArrow(merge, kind)
        parts = -(-parts // fan)
        if parts <= 1:
            return out.select("row", "block", "cells")


def possible(rows: DataFrame, width: int, parts: int) -> DataFrame:
    """rows (h, docs, ...) whose key may reach the bound by the sketch of all rows."""
    spark, block = rows.sparkSession, min(CELLS, width)
    bits = np.zeros((DEPTH, width // 8), np.uint8)
    for r in sketch(rows, width, parts).toLocalIterator():  # DEPTH * width / CELLS rows
        bits[r["row"], r["block"] * block // 8 : (r["block"] + 1) * block // 8] = np.packbits(unpacked(bytes(r["cells"])) >= LEAST_DOCS)
    sent = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def reaches(h: pd.Series) -> pd.Series:
        fine = np.ones(len(h), bool)
        for own, at in zip(sent.value, cells_of(h.to_numpy(), width), strict=True):
            fine &= (own[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return pd.Series(fine)

    return rows.where(reaches("h"))


# ---- exact counts ----


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (total + terms)), exact; 1 without terms."""
    whole = lambda c: c.cast("decimal(38,0)")
    under = F.when(total + terms > 0, total + terms).otherwise(F.lit(1))
    return F.when(terms == 0, F.lit(1).cast("long")).when(n < 9_000_000_000, 1 + _div(ONE * (n + 1), under)).otherwise(1 + _div(whole(F.lit(ONE)) * (n + 1).cast("decimal(19,0)"), whole(under)))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def distance(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def kept_counts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """cells (lang, source, term, n, and of the term n_lang and sources) and groups (lang, source, total, terms)."""
    rows = written(counted(docs))
    terms = rows.where(F.col("term").isNotNull()).withColumn("h", F.xxhash64("lang", "term"))
    found = terms.agg(F.approx_count_distinct("h", 0.05)).first()[0]
    width = min(WIDEST, max(1 << 12, 1 << (4 * found).bit_length()))
    likely = possible(terms, width, rows.rdd.getNumPartitions())
    # rows are summed up by task already: one shuffle by term serves the sources' sums and the term's
    each = likely.select("lang", "term", "source", "n", "docs").repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")  # a row for each source
    cells = each.select("lang", "source", "term", "n", F.sum("n").over(term).alias("n_lang"), F.count(F.lit(1)).over(term).alias("sources"), (F.row_number().over(term.orderBy("source")) == 1).alias("head"), F.sum("docs").over(term).alias("docs"))
    cells = written(cells.where(F.col("docs") >= LEAST_DOCS).drop("docs"))
    total = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("head").cast("long")).alias("heads"))
    size = total.groupBy("lang").agg(F.sum("heads").alias("terms"))
    groups = rows.where(F.col("term").isNull()).select("lang", "source").distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = written(groups.join(total, ["lang", "source"], "left").join(size, ["lang"], "left").select("lang", "source", zero("total"), zero("terms")))
    return cells.drop("head"), groups


def term_part(cells: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """The terms that a source uses more than its language, the ``top`` farthest of each."""
    whole = groups.groupBy("lang").agg(F.sum("total").alias("total_lang"))
    rows = cells.join(groups, ["lang", "source"]).join(whole, ["lang"])
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("n_lang"), F.col("total_lang"), F.col("terms"))
    rows = rows.select("lang", "source", "term", p.alias("p"), q.alias("q")).where("p > q")
    rows = rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    return _ranked(rows).where(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def pair_part(cells: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """The distance of every source to each other one of its language, over all kept terms."""
    c = F.col
    groups = groups.withColumn("p0", share(F.lit(0).cast("long"), c("total"), c("terms")))
    hist = cells.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("m")).join(groups.select("lang", "source", "total", "terms"), ["lang", "source"])
    hist = hist.groupBy("lang", "source").agg(F.collect_list(F.struct(share(c("n"), c("total"), c("terms")).alias("p"), "m")).alias("hist"))  # a cell for each count that occurs
    own = written(groups.join(hist, ["lang", "source"], "left").select("lang", "source", "terms", "p0", F.coalesce("hist", F.array().cast("array<struct<p:bigint,m:bigint>>")).alias("hist")))
    most = own.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    blocks = -(-most // block)
    side = lambda s: own.select("lang", *[c(x).alias(f"{x}_{s}") for x in ("source", "p0", "hist")], "terms")
    a = side("a").withColumn("b", F.pmod(F.xxhash64("source_a"), F.lit(max(1, blocks))).cast("int"))
    b = side("b").drop("terms").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(max(0, blocks - 1)))))
    both = a.join(b, ["lang", "b"]).where("source_a <> source_b")
    none = distance(c("p0_a"), c("p0_b"))
    over = lambda h, f: F.aggregate(h, F.lit(0).cast("long"), lambda t, x: t + x["m"] * f(x["p"]))
    alone = over(c("hist_a"), lambda p: distance(p, c("p0_b")) - none) + over(c("hist_b"), lambda q: distance(c("p0_a"), q) - none)
    base = both.select("lang", "source_a", "source_b", (c("terms") * none + alone).alias("base"))

    level = groups.select("lang", "source", "total", "terms", "p0")
    spread = F.ceil(c("sources") / block).cast("int")
    sized = cells.join(level, ["lang", "source"]).select("lang", "term", "source", share(c("n"), c("total"), c("terms")).alias("p"), "p0", spread.alias("k"))
    sized = written(sized)
    x = sized.select("lang", "term", *[c(s).alias(f"{s}_a") for s in ("source", "p", "p0")], F.pmod(F.xxhash64("source"), c("k")).cast("int").alias("b"))
    y = sized.select("lang", "term", *[c(s).alias(f"{s}_b") for s in ("source", "p", "p0")], F.explode(F.sequence(F.lit(0), c("k") - 1)).alias("b"))
    both = x.join(y, ["lang", "term", "b"]).where("source_a < source_b")
    more = lambda s, o: distance(c(f"p_{s}"), c(f"p_{o}")) - distance(c(f"p_{s}"), c(f"p0_{o}")) - distance(c(f"p0_{s}"), c(f"p_{o}")) + distance(c(f"p0_{s}"), c(f"p0_{o}"))
    met = both.groupBy("lang", "source_a", "source_b").agg(F.sum(more("a", "b")).alias("ab"), F.sum(more("b", "a")).alias("ba"))
    sides = F.explode(F.array(F.struct(c("source_a").alias("source_a"), c("source_b").alias("source_b"), c("ab").alias("more")), F.struct(c("source_b").alias("source_a"), c("source_a").alias("source_b"), c("ba").alias("more")))).alias("s")
    met = met.select("lang", sides).select("lang", "s.*")
    value = F.coalesce("base", F.lit(0)) + F.coalesce("more", F.lit(0))
    out = base.join(met, ["lang", "source_a", "source_b"], "left").select("lang", c("source_a").alias("source"), F.lit("pair").alias("part"), c("source_b").alias("item"), value.alias("value"))
    return _ranked(out)


def audit(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank of both parts."""
    cells, groups = kept_counts(docs)
    return pair_part(cells, groups).unionByName(term_part(cells, groups, top))
