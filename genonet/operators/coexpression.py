"""Co-expression networks: all-pairs correlation, edge scores, and what is read from the network.

An edge table has gene_a < gene_b, score (null where too few values are shared), distance and
significant. It is the large table here; lists of genes come to it by semi-joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genonet.functions.stats import normal_cdf
from genonet.operators.ranges import edge_distance
from genonet.sources.shared import materialised

MIN_SHARED = 10
BLOCK = 1024
CLIP = 0.9999999


def correlate(a: np.ndarray, b: np.ndarray, min_shared: int = MIN_SHARED) -> np.ndarray:
    """Pearson correlations of the rows of a with those of b over the places where both have a value; NaN under min_shared places or without variance."""
    if not (np.isnan(a).any() or np.isnan(b).any()):
        x, y = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
        sx, sy = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
        with np.errstate(invalid="ignore", divide="ignore"):
            r = x @ y.T / sx[:, None] / sy[None, :]
        return np.where((a.shape[1] >= min_shared) & (sx[:, None] > 0) & (sy[None, :] > 0), r, np.nan)
    ma, mb = (~np.isnan(a)).astype(float), (~np.isnan(b)).astype(float)
    shift_a, shift_b = np.nanmean(np.where(ma.any(1, keepdims=True), a, 0.0), axis=1, keepdims=True), np.nanmean(np.where(mb.any(1, keepdims=True), b, 0.0), axis=1, keepdims=True)
    x, y = np.where(ma > 0, a - shift_a, 0.0), np.where(mb > 0, b - shift_b, 0.0)
    n, sx, sy = ma @ mb.T, x @ mb.T, ma @ y.T
    sxx, syy, sxy = (x * x) @ mb.T, ma @ (y * y).T, x @ y.T
    with np.errstate(invalid="ignore", divide="ignore"):
        vx, vy = sxx - sx * sx / n, syy - sy * sy / n
        r = (sxy - sx * sy / n) / np.sqrt(vx * vy)
    return np.where((n >= min_shared) & (vx > 1e-12) & (vy > 1e-12), r, np.nan)


def row_correlations(a: np.ndarray, b: np.ndarray, min_shared: int = MIN_SHARED) -> np.ndarray:
    """Of each row of a with the same row of b; NaN as in correlate()."""
    both = ~(np.isnan(a) | np.isnan(b))
    n = both.sum(1)
    with np.errstate(invalid="ignore", divide="ignore"):
        x = np.where(both, a - (np.where(both, a, 0).sum(1) / n)[:, None], 0)
        y = np.where(both, b - (np.where(both, b, 0).sum(1) / n)[:, None], 0)
        return np.where(n >= min_shared, (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1)), np.nan)


def pair_correlation(vectors: DataFrame, block: int = BLOCK, min_shared: int = MIN_SHARED) -> DataFrame:
    """gene_a, gene_b and r of every pair of genes, by blocks.

    Genes are dealt to blocks by a hash; each pair of blocks is a task's matrix product, so a
    task holds two blocks however many genes there are, and a gene's vector is sent once for each
    block.
    """
    blocks = max(1, math.ceil(vectors.count() / block))
    own = F.pmod(F.xxhash64("gene"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o")
    dealt = vectors.select(F.col("gene"), "values", own.alias("c"), other).select(F.least("c", "o").alias("b1"), F.greatest("c", "o").alias("b2"), "c", "gene", "values")
    kind = vectors.schema["gene"].dataType.simpleString()

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        b1, b2 = (k.as_py() for k in key)
        c = rows.column("c").to_numpy()
        genes = rows.column("gene").combine_chunks()
        matrix = np.array([[math.nan if v is None else v for v in x] for x in rows.column("values").to_pylist()], float)
        left, right = np.flatnonzero(c == b1), np.flatnonzero(c == b2)
        r = correlate(matrix[left], matrix[right], min_shared) if len(left) and len(right) else np.zeros((0, 0))
        if b1 == b2:
            i, j = np.triu_indices(len(left), 1)
        else:
            i, j = (x.ravel() for x in np.indices(r.shape))
        values = r[i, j]
        return pa.table({"x": genes.take(pa.array(left[i])), "y": genes.take(pa.array(right[j])), "r": pa.array(values, mask=np.isnan(values))})

    pairs = dealt.groupBy("b1", "b2").applyInArrow(run, f"x {kind}, y {kind}, r double")
    return pairs.select(F.least("x", "y").alias("gene_a"), F.greatest("x", "y").alias("gene_b"), "r")


def fisher(r: Column) -> Column:
    return F.atanh(F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), r)))


def score_edges(pairs: DataFrame, zscore_cutoff: float = 3.0) -> DataFrame:
    """Fisher-transformed r standardised over all pairs, and whether it reaches the cutoff."""
    pairs = materialised(pairs.withColumn("f", fisher(F.col("r"))))
    mean, std = pairs.agg(F.avg("f"), F.stddev_pop("f")).first()
    score = F.lit(None).cast("double") if not std else (F.col("f") - mean) / std
    return with_cutoff(pairs.withColumn("score", score).select("gene_a", "gene_b", "r", "score"), zscore_cutoff)


def with_cutoff(edges: DataFrame, zscore_cutoff: float) -> DataFrame:
    """The edges with ``significant`` for another cutoff; a view, nothing is rewritten."""
    return edges.withColumn("significant", F.coalesce(F.col("score") >= zscore_cutoff, F.lit(False)))


def with_distance(edges: DataFrame, genes: DataFrame) -> DataFrame:
    """Adds the distance between the genes; infinite across chromosomes."""
    side = lambda s: genes.select(F.col("id").alias(f"gene_{s}"), F.col("chrom").alias(f"c{s}"), F.col("start").alias(f"s{s}"), F.col("end").alias(f"e{s}"))
    both = edges.join(side("a"), "gene_a").join(side("b"), "gene_b")
    return both.withColumn("distance", edge_distance(F.col("ca"), F.col("sa"), F.col("ea"), F.col("cb"), F.col("sb"), F.col("eb"))).drop("ca", "sa", "ea", "cb", "sb", "eb")


def inverse_score(score: Column, mean: float, std: float) -> Column:
    return F.tanh(score * std + mean)


def symmetric(edges: DataFrame) -> DataFrame:
    """Each edge from both of its ends: gene, neighbor and the other columns. One pass: the ends are exploded."""
    rest = [c for c in edges.columns if c not in ("gene_a", "gene_b")]
    ends = F.explode(F.array(F.struct(F.col("gene_a").alias("gene"), F.col("gene_b").alias("neighbor")), F.struct(F.col("gene_b").alias("gene"), F.col("gene_a").alias("neighbor")))).alias("e")
    return edges.select(ends, *rest).select("e.gene", "e.neighbor", *rest)


def degree(edges: DataFrame, genes: DataFrame | None = None) -> DataFrame:
    """gene and degree over significant edges; with genes, those without an edge have 0."""
    counted = symmetric(edges.where("significant").select("gene_a", "gene_b")).groupBy("gene").agg(F.count(F.lit(1)).alias("degree"))
    if genes is None:
        return counted
    return genes.select("gene").distinct().join(counted, "gene", "left").select("gene", F.coalesce("degree", F.lit(0)).alias("degree"))


def subnetwork(edges: DataFrame, genes: DataFrame, sig_only: bool = True, min_distance: float | None = None) -> DataFrame:
    """Edges with both ends in ``genes`` (gene, and parent_locus where given, which adds ``trans``)."""
    if sig_only:
        edges = edges.where("significant")
    if min_distance is not None:
        edges = edges.where(F.col("distance") >= min_distance)
    located = "parent_locus" in genes.columns
    own = genes.select("gene", *(["parent_locus"] if located else [])).dropDuplicates(["gene"])
    for s in "ab":
        side = own.withColumnRenamed("gene", f"gene_{s}")
        edges = edges.join(side.withColumnRenamed("parent_locus", f"parent_{s}"), f"gene_{s}") if located else edges.join(side, f"gene_{s}", "left_semi")
    return edges.withColumn("trans", F.col("parent_a") != F.col("parent_b")) if located else edges


def coexpression(edges: DataFrame, a, b, mean: float | None = None, std: float | None = None) -> DataFrame:
    """The edge of two genes. A gene with itself is no edge: its row has distance 0, is not significant, and its score is that of r = 1, clipped as all r are, where mean and deviation of the network are given."""
    if a == b:
        known = edges.where((F.col("gene_a") == a) | (F.col("gene_b") == a)).limit(1)
        score = F.lit(None).cast("double") if mean is None or not std else F.lit((math.atanh(CLIP) - mean) / std)
        own = {"gene_a": F.lit(a), "gene_b": F.lit(a), "score": score, "distance": F.lit(0.0), "significant": F.lit(False), "r": F.lit(1.0)}
        return known.select(*[own[c].cast(known.schema[c].dataType).alias(c) if c in own else F.lit(None).cast(known.schema[c].dataType).alias(c) for c in known.columns])
    low, high = sorted((a, b))
    return edges.where((F.col("gene_a") == low) & (F.col("gene_b") == high))


def neighbors(edges: DataFrame, genes: DataFrame, sig_only: bool = True) -> DataFrame:
    """gene, neighbor and score of the edges of the listed genes."""
    own = edges.where("significant") if sig_only else edges
    return symmetric(own).join(genes.select("gene").distinct(), "gene", "left_semi")


def top_neighbors(edges: DataFrame, k: int = 10, sig_only: bool = True) -> DataFrame:
    """The k best neighbours of every gene."""
    rank = Window.partitionBy("gene").orderBy(F.desc("score"), "neighbor")
    return symmetric(edges.where("significant") if sig_only else edges).withColumn("nth", F.row_number().over(rank)).where(F.col("nth") <= k)


def neighborhood(edges: DataFrame, genes: DataFrame) -> DataFrame:
    """The listed genes and all significant neighbours; ``neighbor`` marks those that are not listed."""
    own = genes.select("gene").distinct()
    near = neighbors(edges, own).select(F.col("neighbor").alias("gene")).distinct()
    return own.withColumn("neighbor", F.lit(False)).unionByName(near.join(own, "gene", "left_anti").withColumn("neighbor", F.lit(True)))


def next_neighbors(edges: DataFrame, genes: DataFrame, n: int | None = None) -> DataFrame:
    """Neighbours by the sum of their significant scores with the listed genes, best first."""
    summed = neighbors(edges, genes).groupBy("neighbor").agg(F.sum("score").alias("score")).orderBy(F.desc("score"), "neighbor")
    return summed if n is None else summed.limit(n)


def density_of(scores: Column) -> Column:
    """mean * sqrt(number of edges); edges without a score count in the number."""
    return F.avg(scores) * F.sqrt(F.count(F.lit(1)).cast("double"))


def density(edges: DataFrame, genes: DataFrame, min_distance: float | None = None) -> DataFrame:
    sub = subnetwork(edges, genes, sig_only=False, min_distance=min_distance)
    return sub.agg(density_of(F.col("score")).alias("density"), F.count(F.lit(1)).alias("num_edges"))


def density_by_gene(edges: DataFrame, genes: DataFrame, min_distance: float | None = None) -> DataFrame:
    sub = subnetwork(edges, genes, sig_only=False, min_distance=min_distance)
    return symmetric(sub.select("gene_a", "gene_b", "score")).groupBy("gene").agg(F.avg("score").alias("score"))


def trans_density(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Density over the edges that join different parent loci."""
    sub = subnetwork(edges, candidates, sig_only=False, min_distance=0)
    return sub.where("trans").agg(density_of(F.col("score")).alias("density"), F.count(F.lit(1)).alias("num_trans_edges"))


def trans_density_by_gene(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Mean trans score of each gene; num_edges counts all edges among the candidates, num_trans_edges the trans ones."""
    sub = materialised(subnetwork(edges, candidates, sig_only=False, min_distance=0).select("gene_a", "gene_b", "score", "trans"))
    total, trans = sub.agg(F.count(F.lit(1)), F.sum(F.col("trans").cast("long"))).first()
    return symmetric(sub.where("trans").select("gene_a", "gene_b", "score")).groupBy("gene").agg(F.avg("score").alias("score")).withColumn("num_edges", F.lit(total)).withColumn("num_trans_edges", F.lit(trans or 0))


def local_degree(edges: DataFrame, genes: DataFrame, trans_only: bool = False) -> DataFrame:
    """Degree inside the listed genes' own network."""
    sub = subnetwork(edges, genes)
    return degree(sub.where("trans") if trans_only else sub, genes)


def cis_degree(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Significant edges inside one parent locus."""
    return degree(subnetwork(edges, candidates).where("not trans"), candidates)


def global_degree(degrees: DataFrame, genes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Degree in the whole network, 0 for genes outside; with edges, less the cis edges."""
    own = genes.select("gene").distinct().join(degrees, "gene", "left").select("gene", F.coalesce("degree", F.lit(0)).alias("degree"))
    if edges is None:
        return own
    cis = cis_degree(edges, genes).withColumnRenamed("degree", "cis")
    return own.join(cis, "gene").select("gene", (F.col("degree") - F.col("cis")).alias("degree"))


def regressed(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds fitted and resid of local on global through the origin, for each group of ``by``."""
    sums = rows.groupBy(*(by or [F.lit(0).alias("_all")])).agg(F.try_divide(F.sum(F.col("local") * F.col("global")).cast("double"), F.sum(F.col("global") * F.col("global"))).alias("_b"))
    if by:
        rows = rows.join(sums, by)
    else:
        b = sums.first()
        rows = rows.withColumn("_b", F.lit(b["_b"] if b else None).cast("double"))
    return rows.withColumn("fitted", F.col("_b") * F.col("global")).withColumn("resid", F.col("local") - F.col("fitted")).drop("_b")


def locality(edges: DataFrame, degrees: DataFrame, genes: DataFrame, trans: bool = False) -> DataFrame:
    """gene, local, global, fitted and resid."""
    local = local_degree(edges, genes, trans).withColumnRenamed("degree", "local")
    whole = global_degree(degrees, genes, edges if trans else None).withColumnRenamed("degree", "global")
    return regressed(local.join(whole, "gene"))


def edge_fdr(edges: DataFrame, zscore_cutoff: float = 3.0) -> DataFrame:
    """Expected share of significant edges under a normal score, over the share found."""
    return with_fdr(edges.agg(F.sum(F.col("significant").cast("long")).alias("n_sig"), F.count(F.lit(1)).alias("n_all")), zscore_cutoff)


def with_fdr(counts: DataFrame, zscore_cutoff: float = 3.0) -> DataFrame:
    """edge_fdr() out of the numbers of significant edges and of all (n_sig, n_all)."""
    return counts.withColumn("fdr", F.try_divide(F.lit(1 - normal_cdf(zscore_cutoff)), F.try_divide(F.col("n_sig"), F.col("n_all"))))


def compare_degree(a: DataFrame, b: DataFrame) -> DataFrame:
    """Correlation of two networks' degrees and the differences' mean and deviation, over genes in both."""
    both = a.select("gene", F.col("degree").alias("a")).join(b.select("gene", F.col("degree").alias("b")), "gene").where("a > 0 and b > 0")
    return both.agg(F.corr("a", "b").alias("pcc"), F.avg(F.col("a") - F.col("b")).alias("mean_diff"), F.stddev_samp(F.col("a") - F.col("b")).alias("std_diff"), F.count(F.lit(1)).alias("n"))


def degree_differences(a: DataFrame, b: DataFrame, n: int = 10, largest: bool = True) -> DataFrame:
    both = a.select("gene", F.col("degree").alias("a")).join(b.select("gene", F.col("degree").alias("b")), "gene").where("a > 0 and b > 0").withColumn("diff", F.col("a") - F.col("b"))
    return both.orderBy(F.desc("diff") if largest else F.asc("diff"), "gene").limit(n)


def concordance(vectors: DataFrame, edges: DataFrame, mean: float, std: float) -> DataFrame:
    """Stored and recomputed scores of edges, from the vectors of their genes."""
    side = lambda s: vectors.select(F.col("gene").alias(f"gene_{s}"), F.col("values").alias(f"v{s}"))
    both = edges.join(side("a"), "gene_a").join(side("b"), "gene_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.array([[math.nan if v is None else v for v in x] for x in batch.column(k).to_pylist()], float).reshape(batch.num_rows, -1) for k in (3, 4))
            again = (np.arctanh(np.clip(row_correlations(a, b), -CLIP, CLIP)) - mean) / std
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(again, mask=np.isnan(again))], names=["gene_a", "gene_b", "score", "again"])

    kind = edges.schema["gene_a"].dataType.simpleString()
    return both.select("gene_a", "gene_b", "score", "va", "vb").mapInArrow(run, f"gene_a {kind}, gene_b {kind}, score double, again double")


def cluster_expression(expr: DataFrame, clusters: DataFrame, min_size: int = 10, max_size: int | None = None, normalize: bool = True) -> DataFrame:
    """Mean expression of each cluster in each accession, standardised within the cluster."""
    size = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size)
    if max_size is not None:
        size = size.where(F.col("n") <= max_size)
    mean = expr.join(clusters, "gene").join(size.select("cluster"), "cluster", "left_semi").groupBy("cluster", "accession").agg(F.avg("value").alias("value"))
    if not normalize:
        return mean
    own = Window.partitionBy("cluster")
    return mean.withColumn("value", F.try_divide(F.col("value") - F.avg("value").over(own), F.stddev_samp("value").over(own)))


def cluster_ellipse(coordinates: DataFrame, clusters: DataFrame, nstd: float = 2.0) -> DataFrame:
    """Centre, half axes and angle of each cluster's points, from the 2 x 2 covariance in closed form."""
    s = coordinates.join(clusters, "gene").groupBy("cluster").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.var_samp("x").alias("xx"), F.var_samp("y").alias("yy"), F.covar_samp("x", "y").alias("xy"))
    half, gap = (F.col("xx") + F.col("yy")) / 2, F.sqrt(F.pow((F.col("xx") - F.col("yy")) / 2, 2) + F.pow(F.col("xy"), 2))
    return s.select("cluster", "x", "y", (nstd * F.sqrt(half + gap)).alias("major"), (nstd * F.sqrt(F.greatest(half - gap, F.lit(0.0)))).alias("minor"), F.degrees(F.atan2(half + gap - F.col("xx"), F.col("xy"))).alias("angle"))


def cis_trans(edges: DataFrame, cis_distance: float) -> DataFrame:
    """Scores with whether the edge is cis (within the distance) or trans (another chromosome)."""
    return edges.where((F.col("distance") <= cis_distance) | (F.col("distance") == float("inf"))).select("score", (F.col("distance") <= cis_distance).alias("cis"))
