"""Overlap of gene sets with a network: bootstraps, z-scores, false discovery rates, result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genonet.functions.stats import dense_index
from genonet.operators import loci
from genonet.operators.coexpression import density_of, regressed, symmetric
from genonet.sources.shared import materialised

STEP = 0.25
KEY = ["cob", "ontology", "term", "gene", "window_size", "flank_limit", "snp2gene", "method"]


def gene_index(genes: DataFrame) -> DataFrame:
    """gene and idx, dense from 0 in order of ids."""
    return dense_index(genes.select("gene"), "gene")


def random_genes(genes: DataFrame, n: int, iterations: int, seed: int = 1) -> DataFrame:
    """iter and gene: n genes without replacement for each iteration, those whose digest with seed and iteration comes first: the same for the same seed, in any engine."""
    drawn = genes.select("gene").distinct().withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    order = Window.partitionBy("iter").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "iter", F.col("gene").cast("string"))), "gene")
    return drawn.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).select("iter", "gene")


def random_loci(chromosomes: DataFrame, n: int, length: int, seed: int = 1) -> DataFrame:
    """n random intervals; the chromosome is chosen uniformly, not by its length."""
    spark, count = chromosomes.sparkSession, chromosomes.count()
    numbered = dense_index(chromosomes.select("id", "length"), "id").withColumnRenamed("idx", "_c")
    picks = spark.range(n).select(F.col("id").alias("n"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(count)).alias("_c"), F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(1 << 30)).alias("_r"))
    start = (F.col("_r") / (1 << 30) * F.greatest(F.col("length") - length, F.lit(1))).cast("long")
    return picks.join(numbered, "_c").select("n", F.col("id").alias("chrom"), start.alias("start"), (start + length).alias("end"))


def bootstrap_candidates(sizes: DataFrame, genes: DataFrame, iterations: int, seed: int = 1, by: tuple[str, ...] = (), most: int = 50, first: int = 0) -> DataFrame:
    """Random stand-ins for candidate genes: for each iteration and locus (by, locus, n) the n genes right before a random gene of its chromosome.

    A gene with fewer before it is drawn again, and so is a block that shares a gene with one of
    an earlier locus of the iteration, so that a random set is as large as the real one. Each
    round draws only what failed, for all terms and iterations at once. After ``most`` rounds (a
    genome hardly larger than the set) a block that still shares genes keeps the rest of them.
    Iterations are numbered from ``first``.
    """
    index = materialised(dense_index(genes.select(F.col("id").alias("gene"), "chrom", "start"), "chrom", "start", "gene"))
    places = index.groupBy("chrom").agg(F.min("idx").alias("low"))
    index = materialised(index.join(places, "chrom").select("gene", "idx", (F.col("idx") - F.col("low")).alias("before")))
    total, keys = index.count(), [*by, "iter"]
    if not total:
        raise ValueError("no genes to draw from")
    open_ = sizes.where("n > 0").select(*by, "locus", "n", F.explode(F.sequence(F.lit(first), F.lit(first + iterations - 1))).alias("iter"))
    done: list[DataFrame] = []  # what each round adds; nothing is written twice
    for k in range(most):
        draw = F.pmod(F.xxhash64(F.lit(seed), F.lit(k), *by, "iter", "locus"), F.lit(total))
        drawn = open_.withColumn("idx", draw).join(index.select("idx", "before"), "idx")
        block = drawn.where(F.col("before") >= F.col("n")).select(*keys, "locus", "n", F.explode(F.sequence(F.col("idx") - F.col("n"), F.col("idx") - 1)).alias("g"))
        block = materialised(block)
        # a locus waits if a gene of its block is taken, by those done before or by an earlier locus of this round
        rival = block.groupBy(*keys, "g").agg(F.min("locus").alias("winner"))
        lost = block.join(rival, [*keys, "g"]).where("locus <> winner").select(*keys, "locus")
        if done:
            taken = reduce(DataFrame.unionByName, done).select(*keys, "g")
            lost = lost.union(block.join(taken, [*keys, "g"], "left_semi").select(*keys, "locus"))
        fine = block if k == most - 1 else block.join(lost.distinct(), [*keys, "locus"], "left_anti")
        done.append(materialised(fine))
        open_ = materialised(open_.join(done[-1].select(*keys, "locus").distinct(), [*keys, "locus"], "left_anti"))
        if open_.isEmpty():
            break
    one = Window.partitionBy(*keys, "g").orderBy("locus")
    return reduce(DataFrame.unionByName, done).withColumn("_n", F.row_number().over(one)).where("_n = 1").join(index.select(F.col("idx").alias("g"), "gene"), "g").select(*keys, F.col("locus").alias("parent_locus"), "gene")


def sets_subnetwork(edges: DataFrame, sets: DataFrame, by: list[str]) -> DataFrame:
    """Edges inside each gene set (by-columns, gene, maybe parent_locus); all sets in one job."""
    parent = ["parent_locus"] if "parent_locus" in sets.columns else []
    a = sets.select(*by, F.col("gene").alias("gene_a"), *[F.col(p).alias("parent_a") for p in parent])
    b = sets.select(*by, F.col("gene").alias("gene_b"), *[F.col(p).alias("parent_b") for p in parent])
    # edges that touch no set, or one with a single end, go before sets multiply the rest
    some = sets.select("gene").distinct()
    inside = edges.join(some.withColumnRenamed("gene", "gene_a"), "gene_a", "left_semi").join(some.withColumnRenamed("gene", "gene_b"), "gene_b", "left_semi")
    both = inside.join(a, "gene_a").join(b, ["gene_b", *by])
    return both.withColumn("trans", F.col("parent_a") != F.col("parent_b")) if parent else both


def set_density(edges: DataFrame, sets: DataFrame, by: list[str]) -> DataFrame:
    """Density of each gene set; over trans edges where sets have parent loci."""
    sub = sets_subnetwork(edges.select("gene_a", "gene_b", "score"), sets, by)
    if "trans" in sub.columns:
        sub = sub.where("trans")
    return sub.groupBy(*by).agg(density_of(F.col("score")).alias("density"), F.count(F.lit(1)).alias("num_edges"))


def set_gene_scores(edges: DataFrame, sets: DataFrame, by: list[str]) -> DataFrame:
    """Mean score of each gene's edges inside its set."""
    sub = sets_subnetwork(edges.select("gene_a", "gene_b", "score"), sets, by)
    if "trans" in sub.columns:
        sub = sub.where("trans")
    return symmetric(sub.select("gene_a", "gene_b", *by, "score")).groupBy(*by, "gene").agg(F.avg("score").alias("score"))


def set_locality(edges: DataFrame, degrees: DataFrame, sets: DataFrame, by: list[str]) -> DataFrame:
    """local, global, fitted and resid of each gene in each set.

    Where sets have parent loci, edges inside a locus count neither for the local nor for the global
    degree of a gene.
    """
    sub = sets_subnetwork(edges.where("significant").select("gene_a", "gene_b"), sets, by)
    trans = F.col("trans") if "trans" in sub.columns else F.lit(True)
    sub = sub.select("gene_a", "gene_b", *by, F.coalesce(trans, F.lit(False)).alias("trans"))
    counts = symmetric(sub).groupBy(*by, "gene").agg(F.sum(F.col("trans").cast("long")).alias("local"), F.sum((~F.col("trans")).cast("long")).alias("cis"))
    rows = sets.select(*by, "gene").distinct().join(counts, [*by, "gene"], "left").join(degrees.withColumnRenamed("degree", "whole"), "gene", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return regressed(rows.select(*by, "gene", zero("local").alias("local"), (zero("whole") - zero("cis")).alias("global")), by)


def empirical_pvalue(real: DataFrame, bootstraps: DataFrame) -> DataFrame:
    """Share of iterations whose mean score reaches the real mean: pvalue."""
    return term_pvalues(real.withColumn("term", F.lit("")), bootstraps.withColumn("term", F.lit(""))).select("pvalue", "iterations")


def term_pvalues(real: DataFrame, bootstraps: DataFrame) -> DataFrame:
    """term, pvalue and iterations of every term."""
    each = bootstraps.groupBy("term", "iter").agg(F.avg("score").alias("m"))
    mean = real.groupBy("term").agg(F.avg("score").alias("real"))
    reached = (F.col("m") >= F.col("real")).cast("double")
    return each.join(mean, "term").groupBy("term").agg((F.sum(reached) / F.count(F.lit(1))).alias("pvalue"), F.count(F.lit(1)).alias("iterations"))


def zscores(real: DataFrame, bootstraps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with zscore, by the mean and the population deviation of scores averaged over iterations; 0 without spread."""
    add = lambda df: term_zscores(df.withColumn("term", F.lit("")), bootstraps.withColumn("term", F.lit(""))).drop("term")
    return add(real), add(bootstraps)


def term_zscores(rows: DataFrame, bootstraps: DataFrame) -> DataFrame:
    """rows (term, score, ...) with zscore, bs_mean and bs_std of their term."""
    each = bootstraps.groupBy("term", "iter").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s"))
    spread = each.groupBy("term").agg(F.avg("m").alias("bs_mean"), F.avg("s").alias("bs_std"))
    return rows.join(spread, "term").withColumn("zscore", F.when(F.col("bs_std") != 0, (F.col("score") - F.col("bs_mean")) / F.col("bs_std")).otherwise(0.0))


def fdr_grid(real: DataFrame, bootstraps: DataFrame, iterations: int) -> DataFrame:
    """term_fdr() of one term."""
    return term_fdr(real.withColumn("term", F.lit("")), bootstraps.withColumn("term", F.lit("")), F.lit(iterations)).drop("term")


def term_fdr(real: DataFrame, bootstraps: DataFrame, iterations: Column) -> DataFrame:
    """real with num_real, num_random and fdr at the largest threshold of the grid (0, .25, ...) that its zscore reaches, by term.

    Thresholds under the largest real score's next whole number count. Suffix sums over the grid,
    which has a few rows for each unit of z, replace a loop of scans. Scores under 0 stay null.
    """
    level = F.floor(F.col("zscore") / STEP)
    own = real.where("zscore >= 0").groupBy("term", level.alias("t")).agg(F.count(F.lit(1)).alias("a"))
    rand = bootstraps.where("zscore >= 0").groupBy("term", level.alias("t")).agg(F.count(F.lit(1)).alias("b"))
    from_here = Window.partitionBy("term").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    grid = own.join(rand, ["term", "t"], "full").select("term", "t", F.sum(F.coalesce("a", F.lit(0))).over(from_here).alias("num_real"), (F.sum(F.coalesce("b", F.lit(0))).over(from_here) / iterations).alias("num_random"))
    fdr = F.when(F.col("num_real") == 0, 1.0).otherwise(F.col("num_random") / F.col("num_real"))
    # the real side has a row in the grid at each of its own levels, so a join on the level is enough
    rows = real.withColumn("t", F.when(F.col("zscore") >= 0, level))
    return rows.join(grid.withColumn("fdr", fdr), ["term", "t"], "left").drop("t")


def upsert(old: DataFrame, new: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Results with new rows in place of those with the same key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def keep_last(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def num_below_fdr(results: DataFrame, cutoff: float = 0.3, method: str | None = None) -> DataFrame:
    """Counts of genes under the cutoff by term, method and mapping."""
    own = results.where("fdr is not null") if method is None else results.where(F.col("method") == method).where("fdr is not null")
    return own.groupBy("term", "ontology", "method", "cob", "window_size", "flank_limit").agg(F.sum((F.col("fdr") <= cutoff).cast("long")).alias("n"))


def high_priority(results: DataFrame, cutoff: float = 0.3, min_obs: int = 2, original_only: bool = False) -> DataFrame:
    """Genes seen under the cutoff at several SNP-to-gene mappings, by network and method.

    Besides each network's own: cob "Any" by method, method "either", and genes found by both
    methods in the same network or in any.
    """
    seen = results.where((F.col("fdr").isNotNull()) & (F.col("fdr") <= cutoff))
    own = seen.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("cob", "term", "method", "gene"))).where(F.col("_n") >= min_obs).drop("_n")
    if original_only:
        return own
    both = lambda by: own.join(own.groupBy(*by).agg(F.countDistinct("method").alias("_m")).where("_m = 2").drop("_m"), by, "left_semi")
    parts = [
        own,
        own.withColumn("cob", F.lit("Any")).dropDuplicates(),
        own.withColumn("method", F.lit("either")).withColumn("cob", F.lit("Any")).dropDuplicates(),
        both(["cob", "term", "gene"]).withColumn("method", F.lit("both_same_net")),
        both(["term", "gene"]).withColumn("method", F.lit("both_any_net")).withColumn("cob", F.lit("Any")),
    ]
    return reduce(DataFrame.unionByName, parts)


def num_hpo(results: DataFrame, cutoff: float = 0.3, min_obs: int = 2) -> DataFrame:
    """Distinct high-priority genes by term, method and network, with a Total over the terms."""
    found = high_priority(results, cutoff, min_obs)
    by_term = found.groupBy("term", "method", "cob").agg(F.countDistinct("gene").alias("n"))
    total = found.groupBy("method", "cob").agg(F.countDistinct("gene").alias("n")).withColumn("term", F.lit("Total"))
    return by_term.unionByName(total)


def breakdown(results: DataFrame, snps: DataFrame | None = None) -> DataFrame:
    """For each term and mapping: mean number of loci, of collapsed loci, and distinct candidate genes. With the terms' loci, a Total of all of them as one term besides."""
    sizes = lambda rows, *by: rows.groupBy(*by, "window_size", "flank_limit").agg(F.avg("term_loci").alias("term_loci"), F.avg("term_collapsed_loci").alias("collapsed_loci"), F.countDistinct("gene").alias("candidate_genes"))
    parts = sizes(results, "term")
    if snps is None:
        return parts
    union = materialised(snps.select(F.lit("Total").alias("term"), F.concat_ws(":", "chrom", "start", "end").alias("id"), "chrom", "start", "end").distinct())
    windows = [r[0] for r in results.select("window_size").distinct().collect()]  # the windows that were tried
    islands = [loci.effective_loci(union, w).groupBy().agg(F.count(F.lit(1)).cast("double").alias("_i")).withColumn("_w", F.lit(w)) for w in windows]
    total = sizes(results).join(F.broadcast(reduce(DataFrame.unionByName, islands)), F.col("window_size") == F.col("_w"))  # a row for each window
    return parts.unionByName(total.select(F.lit("Total").alias("term"), "window_size", "flank_limit", F.lit(float(union.count())).alias("term_loci"), F.col("_i").alias("collapsed_loci"), "candidate_genes"))


def grouped_fdr(rows: DataFrame, by: list[str], cutoffs: tuple[float, ...] = (0.10, 0.35, 0.50)) -> DataFrame:
    """For each group the sum of num_real over all its rows (tot); and for each cutoff the largest num_real and the smallest zscore among rows at it or under, 0 for none."""
    def at(c: float) -> list[Column]:
        ok, name = F.col("fdr") <= c, f"fdr{round(c * 100)}"
        return [F.coalesce(F.max(F.when(ok, F.col("num_real"))), F.lit(0)).alias(name), F.coalesce(F.min(F.when(ok, F.col("zscore"))), F.lit(0.0)).alias(f"{name}_z")]

    return rows.groupBy(*by).agg(F.sum("num_real").alias("tot"), *[c for cut in cutoffs for c in at(cut)])


def wide(counts: DataFrame, rows: list[str], columns: list[str], value: str = "n") -> DataFrame:
    """Counts as a table: one row for each value of ``rows``, one column for each of ``columns`` (joined by /), 0 for none."""
    return counts.withColumn("_c", F.concat_ws("/", *columns)).groupBy(*rows).pivot("_c").agg(F.first(value)).na.fill(0).orderBy(*rows)


def simulated_terms(term_loci: DataFrame, genes: DataFrame, missing_rate: float = 0.0, false_rate: float = 0.0, seed: int = 1) -> DataFrame:
    """Terms with a share of genes dropped (two stay at least) and random genes added; rates in percent."""
    order = Window.partitionBy("term").orderBy(F.xxhash64(F.lit(seed), "term", "gene"))
    sized = term_loci.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("term"))).withColumn("_r", F.row_number().over(order))
    kept = sized.where(F.col("_r") <= F.greatest(F.lit(2), F.ceil(F.col("_n") * (1 - missing_rate / 100)))).select("term", "gene")
    more = sized.select("term", F.ceil(F.col("_n") * false_rate / 100).cast("int").alias("k")).distinct().where("k > 0")
    index = gene_index(genes.select(F.col("id").alias("gene")))
    total = index.count()
    drawn = more.select("term", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("i")).select("term", F.pmod(F.xxhash64(F.lit(seed), "term", "i"), F.lit(total)).alias("idx"))
    return kept.union(drawn.join(index, "idx").select("term", "gene")).distinct()


def empty_results(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "cob string, flank_limit int, method string, num_bootstraps int, ontology string, term string, term_collapsed_loci int, term_loci int, term_pvalue double, window_size int, snp2gene string, bs_mean double, bs_std double, fdr double, fitted double, gene string, global double, local double, num_random double, num_real double, score double, zscore double, num_trans_edges int")
