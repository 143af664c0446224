"""Single-linkage hierarchies of spanning trees, by rounds of contraction.

Each round every part of the tree takes its nearest edge, and the parts that these edges join
become one. An edge taken in a round never lies between two others as the farthest of the three, so
those that go on keep their order in the hierarchy. Once an edge lies inside a part, it is compared
round by round with the nearest edge that leaves the part: the first one that is farther is the
merge under which it stands. All edges that come to stand under the same one from the same part form a
chain, each the child of the next, beside what hangs there: a gene, or a chain of an earlier
round. So sizes are prefix sums along chains, from the first round to the last, and places of
leaves follow from the last round to the first. No step needs a chain in one task: sums go by ranges.

A tree of n genes takes about log2(n) rounds, over tables that at least halve.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genonet.functions.stats import cumulative, dense_index
from genonet.sources.shared import materialised


def followed(pointers: DataFrame) -> DataFrame:
    """node and part, the end of the pointers (node, next) of a forest in which every node has one and whose only cycles are two nodes that point at each other; of these the smaller is the end.

    Pointers double their reach each round; those that have arrived drop out.
    """
    back = pointers.select(F.col("node").alias("next"), F.col("next").alias("after"))
    mutual = (F.col("after") == F.col("node")) & (F.col("node") < F.col("next"))
    open_ = materialised(pointers.join(back, "next").select("node", F.when(mutual, F.col("node")).otherwise(F.col("next")).alias("next")))
    known = open_.where("node = next")  # the ends
    done = [known.select("node", F.col("next").alias("part"))]
    open_ = open_.where("node <> next")
    while True:
        # a pointer has arrived if what it points at is an end or has arrived before
        settled = reduce(DataFrame.unionByName, done)
        step = open_.join(settled.select(F.col("node").alias("next"), "part"), "next", "left").join(open_.select(F.col("node").alias("next"), F.col("next").alias("after")), "next", "left")
        step = materialised(step.select("node", F.coalesce("after", "next").alias("next"), "part"))
        done.append(step.where("part is not null").select("node", "part"))
        open_ = step.where("part is null").select("node", "next")
        if open_.isEmpty():
            return materialised(reduce(DataFrame.unionByName, done))


def chains(tree: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Of edges (eid, x, y), where eid orders them: hanging genes (v, up), and for each round the edges (eid, v, up) that came to stand under the edge ``up`` from part v; null at a root."""
    live, inside, found, leaves = materialised(tree.select("eid", "x", "y")), None, [], None
    while True:
        ends = live.select("eid", F.col("x").alias("v"), F.col("y").alias("o")).union(live.select("eid", "y", "x"))
        best = materialised(ends.groupBy("v").agg(F.min(F.struct("eid", "o")).alias("b")).select("v", "b.eid", "b.o"))
        if inside is None:
            leaves = best.select("v", F.col("eid").alias("up"))
        else:
            met = materialised(inside.join(best.select("v", F.col("eid").alias("up")), "v", "left"))
            found.append(met.where("up is null or eid < up").select("eid", "v", "up"))
            inside = met.where("eid > up").select("eid", "v")
        if best.isEmpty():
            return leaves, found
        part = followed(best.select(F.col("v").alias("node"), F.col("o").alias("next")))
        named = lambda c, to: part.select(F.col("node").alias(c), F.col("part").alias(to))
        taken = best.groupBy("eid").agg(F.min("v").alias("v"))
        inside = taken if inside is None else inside.unionByName(taken)
        inside = materialised(inside.join(named("v", "p"), "v", "left").select("eid", F.coalesce("p", "v").alias("v")))
        rest = live.join(taken.select("eid"), "eid", "left_anti").join(named("x", "px"), "x").join(named("y", "py"), "y")
        live = materialised(rest.select("eid", F.col("px").alias("x"), F.col("py").alias("y")))


def dendrogram(tree: DataFrame, mean: float = 0.0, std: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """The single-linkage hierarchy of a spanning forest (gene_a, gene_b, w: a standardised score): merges and leaves.

    merges: step (from 0, nearest first; ties by genes), a and b (a gene of either side), height
    (1 - r) and size. leaves: gene and place, from 0, so that each merge's genes stand side by side.
    """
    rows = tree.select("gene_a", "gene_b", (F.lit(1.0) - F.tanh(F.col("w") * std + mean)).alias("height"))
    rows = materialised(dense_index(rows, "height", "gene_a", "gene_b").withColumnRenamed("idx", "eid"))
    leaves, levels = chains(rows.select("eid", F.col("gene_a").alias("x"), F.col("gene_b").alias("y")))
    # what hangs at an edge: a gene (level 0) or a chain; up, level, v, size
    hangs = [leaves.select("up", F.lit(0).alias("level"), "v", F.lit(1).cast("long").alias("size"))]
    sized, roots = [], []
    for k, chain in enumerate(levels, 1):
        own = reduce(DataFrame.unionByName, hangs).groupBy(F.col("up").alias("eid")).agg(F.sum("size").alias("own"))
        summed = cumulative(chain.join(own, "eid"), ["v", "eid"], "own", "through")
        ends = summed.groupBy("v").agg(F.min(F.col("through") - F.col("own")).alias("before"), F.max("through").alias("last"), F.max("up").alias("up"))
        ends = materialised(ends)
        sized.append(materialised(summed.join(ends.select("v", "before"), "v").select("eid", "v", "own", (F.col("through") - F.col("before")).alias("size"))))
        total = ends.select("up", F.lit(k).alias("level"), "v", (F.col("last") - F.col("before")).alias("size"))
        hangs.append(total.where("up is not null"))
        roots.append(total.where("up is null").select("level", "v", "size"))
    sizes = reduce(DataFrame.unionByName, sized) if sized else rows.select("eid", F.lit(0).alias("size"))
    merges = rows.join(sizes.select("eid", "size"), "eid").select(F.col("eid").alias("step"), F.col("gene_a").alias("a"), F.col("gene_b").alias("b"), "height", "size")
    if not roots:  # no edge at all
        return merges, rows.select(F.col("gene_a").alias("gene"), F.col("eid").alias("place"))
    pair = Window.partitionBy("up").orderBy(F.desc("level"), "v").rowsBetween(Window.unboundedPreceding, -1)  # two rows at most
    hang = materialised(reduce(DataFrame.unionByName, hangs).withColumn("offset", F.coalesce(F.sum("size").over(pair), F.lit(0))))
    starts = [cumulative(reduce(DataFrame.unionByName, roots), ["v"], "size", "end").select("level", "v", (F.col("end") - F.col("size")).alias("start"))]
    for k in range(len(levels), 0, -1):
        at = reduce(DataFrame.unionByName, starts).where(F.col("level") == k).select("v", "start")
        inner = sized[k - 1].join(at, "v").select(F.col("eid").alias("up"), (F.col("start") + F.col("size") - F.col("own")).alias("base"))
        starts.append(materialised(hang.join(inner, "up").select("level", "v", (F.col("base") + F.col("offset")).alias("start"))))
    places = reduce(DataFrame.unionByName, starts).where("level = 0").select(F.col("v").alias("gene"), F.col("start").alias("place"))
    return merges, places
