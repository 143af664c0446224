"""Force-directed layout of networks: attraction along edges, repulsion by cells.

Each iteration is two Spark jobs. The plane is cut into 2^k x 2^k cells on every level k up to LEVELS;
the first job counts and sums up the places of the nodes of each cell. The table of cells, whose number is
bounded by the levels and not by the nodes, is sent to the tasks. The second job joins the places to
the edges for the attraction, adds up the repulsion of each node from cells, and moves the node: on each
level the cells that are children of its cell's parent's neighbours, but no neighbours themselves, act as
one node at their centre each; on the last level the nine cells around it do, without the node itself.
No pairs of nodes are formed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genonet.operators import graph
from genonet.sources.shared import materialised

#: 4^LEVELS cells on the last level at most.
LEVELS = 8
NEAREST = 0.01


def pyramid(cells: list[tuple[int, int, int, float, float]], levels: int) -> list[np.ndarray]:
    """For each level an array by column and row of count and sums of x and y, from the rows of the last level."""
    last = np.zeros((1 << levels, 1 << levels, 3))
    for i, j, *sums in cells:
        last[i, j] = sums
    out = [last]
    while len(out[-1]) > 1:
        a = out[-1]
        out.append(a[::2, ::2] + a[1::2, ::2] + a[::2, 1::2] + a[1::2, 1::2])
    return out[::-1]


def repulsion(x: np.ndarray, y: np.ndarray, cells: list[np.ndarray], low: tuple[float, float], side: float) -> np.ndarray:
    """Sum over the other nodes of direction / distance^2, by cells."""
    force, levels = np.zeros((2, len(x))), len(cells) - 1

    def add(i: np.ndarray, j: np.ndarray, level: int, own: bool, skip: np.ndarray) -> None:
        inside = (i >= 0) & (j >= 0) & (i < 1 << level) & (j < 1 << level) & ~skip
        sums = np.where(inside[:, None], cells[level][np.where(inside, i, 0), np.where(inside, j, 0)], 0)
        n, sx, sy = sums.T - (np.array([np.ones(len(x)), x, y]) if own else 0)
        some = n > 0.5
        n = np.where(some, n, 1)
        dx, dy = x - sx / n, y - sy / n
        scale = np.where(some, n, 0) / np.maximum(dx * dx + dy * dy, NEAREST**2)
        force[0] += dx * scale
        force[1] += dy * scale

    for level in range(1, levels + 1):
        at = [np.clip(((v - o) / side * (1 << level)).astype(int), 0, (1 << level) - 1) for v, o in zip((x, y), low, strict=True)]
        for di in range(-2, 4):
            for dj in range(-2, 4):
                i, j = (at[0] >> 1) * 2 + di, (at[1] >> 1) * 2 + dj
                add(i, j, level, False, (abs(i - at[0]) <= 1) & (abs(j - at[1]) <= 1))
    for di in (-1, 0, 1):
        for dj in (-1, 0, 1):
            add(at[0] + di, at[1] + dj, levels, di == dj == 0, np.zeros(len(x), bool))
    return force


def layout(edges: DataFrame, iterations: int = 50, seed: int = 0, largest_only: bool = True, weight: str = "score", levels: int | None = None) -> DataFrame:
    """gene, x and y of the nodes of the largest component (or of all), from places drawn by a hash of the gene.

    The springs' length is k = 1 / sqrt(nodes): neighbours attract by weight * distance^2 / k, all nodes repel by k^2 /
    distance. A node moves along the sum, at most by a step that shrinks evenly to nothing.
    """
    pairs = materialised(edges.select("gene_a", "gene_b", F.col(weight).cast("double").alias("w")).where("gene_a <> gene_b"))
    nodes = graph.components(pairs)
    if largest_only:
        nodes = graph.largest_component(nodes)
    nodes = materialised(nodes.select(F.col("node").alias("gene")))
    if largest_only:
        pairs = materialised(pairs.join(nodes.select(F.col("gene").alias("gene_a")), "gene_a", "left_semi"))
    n = nodes.count()
    unit = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "gene"), F.lit(1 << 30)) / float(1 << 30)
    places = materialised(nodes.select("gene", unit("x").alias("x"), unit("y").alias("y")))
    if n < 2:
        return places
    k, kind = 1 / math.sqrt(n), nodes.schema["gene"].dataType.simpleString()
    levels = levels or min(LEVELS, max(2, math.ceil(math.log(n, 4)) + 1))
    x0, x1, y0, y1 = places.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    step = 0.1 * max(x1 - x0, y1 - y0)
    for t in [step * (1 - i / (iterations + 1)) for i in range(iterations)]:
        low, side = (x0, y0), max(x1 - x0, y1 - y0, 1e-9) * (1 + 1e-9)
        cell = lambda c, o: F.least(F.greatest(F.floor((F.col(c) - o) / side * (1 << levels)), F.lit(0)), F.lit((1 << levels) - 1)).cast("int")  # noqa: B023, E731
        rows = places.groupBy(cell("x", x0).alias("i"), cell("y", y0).alias("j")).agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy")).collect()  # 4^levels rows at most
        sent = places.sparkSession.sparkContext.broadcast(pyramid([tuple(r) for r in rows], levels))
        ends = pairs.join(places.select(F.col("gene").alias("gene_a"), F.col("x").alias("xa"), F.col("y").alias("ya")), "gene_a").join(places.select(F.col("gene").alias("gene_b"), F.col("x").alias("xb"), F.col("y").alias("yb")), "gene_b")
        dx, dy = F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya")
        pull = F.col("w") * F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(NEAREST)) / k
        toward = F.explode(F.array(F.struct(F.col("gene_a").alias("gene"), (dx * pull).alias("px"), (dy * pull).alias("py")), F.struct(F.col("gene_b").alias("gene"), (-dx * pull).alias("px"), (-dy * pull).alias("py")))).alias("e")
        places = materialised(_moved(ends.select(toward).select("e.*"), places, sent, low, side, k, t, kind))
        sent.unpersist()
        x0, x1, y0, y1 = x0 - t, x1 + t, y0 - t, y1 + t  # no node leaves this box
    return places


def _moved(ends: DataFrame, places: DataFrame, sent, low: tuple[float, float], side: float, k: float, t: float, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, px, py = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3, 4))
            fx, fy = repulsion(x, y, sent.value, low, side) * (k * k) + np.array([px, py])
            size = np.maximum(np.sqrt(fx * fx + fy * fy), NEAREST)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x + fx * t / size), pa.array(y + fy * t / size)], names=["gene", "x", "y"])

    pull = ends.groupBy("gene").agg(F.sum("px").alias("px"), F.sum("py").alias("py"))
    rows = places.join(pull, "gene", "left").select("gene", "x", "y", F.coalesce("px", F.lit(0.0)).alias("px"), F.coalesce("py", F.lit(0.0)).alias("py"))
    return rows.mapInArrow(run, f"gene {kind}, x double, y double")
