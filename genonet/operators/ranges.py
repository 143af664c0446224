"""Range joins between loci and genes, by chromosome and coarse position bins.

Genes have id, chrom, start, end; loci have id, chrom, start, end and maybe by-columns such as
term. Bins turn a range condition into an equi-join, so that neither side is copied to all; Spark
broadcasts the gene side by itself only where its size is under the session's threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 100_000


class ZeroWindowError(ValueError):
    """Flanking genes were asked for with a window of 0."""


def _binned(df: DataFrame, low: Column, high: Column, size: int) -> DataFrame:
    return df.withColumn("_bin", F.explode(F.sequence(F.floor(low / size), F.floor(F.greatest(low, high) / size))))


def _genes(genes: DataFrame) -> DataFrame:
    return genes.select(F.col("id").alias("gene"), F.col("chrom").alias("g_chrom"), F.col("start").alias("g_start"), F.col("end").alias("g_end"))


def starts_in(loci: DataFrame, genes: DataFrame, low: Column, high: Column, bin_size: int = BIN) -> DataFrame:
    """Pairs where the gene's start lies in [low, high] of the locus, both inclusive."""
    left = _binned(loci.withColumn("_low", low).withColumn("_high", high), F.col("_low"), F.col("_high"), bin_size)
    right = _genes(genes).withColumn("_gbin", F.floor(F.col("g_start") / bin_size))
    on = (F.col("chrom") == F.col("g_chrom")) & (F.col("_bin") == F.col("_gbin")) & F.col("g_start").between(F.col("_low"), F.col("_high"))
    return left.join(right, on).drop("_bin", "_gbin", "_low", "_high", "g_chrom")


def encompassing_genes(loci: DataFrame, genes: DataFrame, bin_size: int = BIN) -> DataFrame:
    """Genes that hold the whole locus."""
    left = loci.withColumn("_bin", F.floor(F.col("start") / bin_size))
    right = _genes(genes).withColumn("_gbin", F.explode(F.sequence(F.floor(F.col("g_start") / bin_size), F.floor(F.col("g_end") / bin_size))))
    on = (F.col("chrom") == F.col("g_chrom")) & (F.col("_bin") == F.col("_gbin")) & (F.col("g_start") <= F.col("start")) & (F.col("g_end") >= F.col("end"))
    return left.join(right, on).drop("_bin", "_gbin", "g_chrom")


def genes_within(loci: DataFrame, genes: DataFrame) -> DataFrame:
    """Genes that start inside the locus, its window apart."""
    return starts_in(loci, genes, F.col("start"), F.col("end"))


def _side(loci: DataFrame, genes: DataFrame, window: int, limit: int, up: bool, by: list[str]) -> DataFrame:
    if window <= 0:
        raise ZeroWindowError("flanking genes need a window over 0")
    low, high = (F.col("start") - window, F.col("start") - 1) if up else (F.col("end") + 1, F.col("end") + window)
    near = F.col("g_start").desc() if up else F.col("g_start").asc()
    rank = F.row_number().over(Window.partitionBy(*by, "id").orderBy(near, F.col("gene")))
    return starts_in(loci, genes, low, high).withColumn("nth", rank).where(F.col("nth") <= limit)


def upstream_genes(loci: DataFrame, genes: DataFrame, window: int, limit: int = 1000, by: tuple[str, ...] = ()) -> DataFrame:
    """The ``limit`` genes nearest before each locus that start inside its window."""
    return _side(loci, genes, window, limit, True, list(by))


def downstream_genes(loci: DataFrame, genes: DataFrame, window: int, limit: int = 1000, by: tuple[str, ...] = ()) -> DataFrame:
    return _side(loci, genes, window, limit, False, list(by))


def flanking_genes(loci: DataFrame, genes: DataFrame, window: int, limit: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    return upstream_genes(loci, genes, window, limit, by).withColumn("side", F.lit("up")).unionByName(downstream_genes(loci, genes, window, limit, by).withColumn("side", F.lit("down")))


def candidate_genes(loci: DataFrame, genes: DataFrame, window: int, flank_limit: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """Genes inside each locus and up to ``flank_limit`` on either side inside the window, one row for each locus and gene.

    Columns: by, parent_locus, gene, chrom, start, end of the gene, side, num_siblings,
    snp_distance, intervening_rank (ties at their mean), num_intervening (from 0 on each side by
    distance; -1 where the windowed locus lies in the gene). One range join serves all three kinds.
    """
    return candidates_within(near_genes(loci, genes, window, flank_limit, by), window, flank_limit, by)


def near_genes(loci: DataFrame, genes: DataFrame, window: int, flank_limit: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """The genes that start inside each locus, and on either side the nearest inside the window, numbered ``nth`` up to the limit: what candidates_within() takes, for any smaller limit too."""
    if window <= 0 and flank_limit > 0:
        raise ZeroWindowError("flanking genes need a window over 0")
    keys = [*by, "id"]
    side = F.when(F.col("g_start") < F.col("start"), "up").when(F.col("g_start") > F.col("end"), "down").otherwise("within")
    found = starts_in(loci, genes, F.col("start") - window, F.col("end") + window).withColumn("side", side)
    nearest = Window.partitionBy(*keys, "side").orderBy(F.when(F.col("side") == "up", -F.col("g_start")).otherwise(F.col("g_start")), "gene")
    return found.withColumn("nth", F.row_number().over(nearest)).where((F.col("side") == "within") | (F.col("nth") <= flank_limit))


def candidates_within(near: DataFrame, window: int, flank_limit: int, by: tuple[str, ...] = ()) -> DataFrame:
    """candidate_genes() out of near_genes() of the same window and at least this limit."""
    keys = [*by, "id"]
    kept = near.where((F.col("side") == "within") | (F.col("nth") <= flank_limit))
    middle, own = (F.col("g_start") + F.col("g_end")) / 2, (F.col("start") + F.col("end")) / 2
    kept = kept.withColumn("snp_distance", F.abs(middle - own)).withColumn("_down", middle >= own)
    kept = kept.withColumn("_in", (F.col("start") - window >= F.col("g_start")) & (F.col("end") + window <= F.col("g_end")))
    locus = Window.partitionBy(*keys)
    by_distance = locus.orderBy("snp_distance")
    ties = Window.partitionBy(*keys, "snp_distance")
    each_side = Window.partitionBy(*keys, "_in", "_down").orderBy("snp_distance", "g_start", "gene")
    return kept.select(
        *by, F.col("id").alias("parent_locus"), "gene", "chrom", F.col("g_start").alias("start"), F.col("g_end").alias("end"), "side",
        F.count(F.lit(1)).over(locus).alias("num_siblings"), "snp_distance",
        (F.rank().over(by_distance) + (F.count(F.lit(1)).over(ties) - 1) / 2).alias("intervening_rank"),
        F.when(F.col("_in"), -1).otherwise(F.row_number().over(each_side) - 1).alias("num_intervening"),
    )


def chained(candidates: DataFrame, loci: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Each candidate gene once: its parent is the first locus in order of chromosome and start."""
    order = loci.select(*by, F.col("id").alias("parent_locus"), F.col("chrom").alias("l_chrom"), F.col("start").alias("l_start"))
    first = Window.partitionBy(*by, "gene").orderBy("l_chrom", "l_start", "parent_locus")
    rows = candidates.join(order, [*by, "parent_locus"]).withColumn("_n", F.row_number().over(first))
    return rows.where("_n = 1").drop("_n", "l_chrom", "l_start")


def with_parent_attrs(candidates: DataFrame, islands: DataFrame, loci: DataFrame, attrs: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Adds parent_<attr>: of a collapsed locus the largest value among the loci in it."""
    parts = islands.select(*by, F.col("id").alias("parent_locus"), F.explode("sub_ids").alias("_sub"))
    values = loci.select(*by, F.col("id").cast("string").alias("_sub"), *attrs)
    top = parts.join(values, [*by, "_sub"]).groupBy(*by, "parent_locus").agg(*[F.max(F.col(a).cast("double")).alias(f"parent_{a}") for a in attrs])
    return candidates.join(top, [*by, "parent_locus"], "left")


def edge_distance(chrom_a: Column, start_a: Column, end_a: Column, chrom_b: Column, start_b: Column, end_b: Column) -> Column:
    """Distance of a network edge: start to end, negative for genes that overlap, infinite across chromosomes."""
    same = F.when(start_a < start_b, start_b - end_a).otherwise(start_a - end_b).cast("double")
    return F.when(chrom_a == chrom_b, same).otherwise(F.lit(float("inf")))
