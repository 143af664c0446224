"""Statistical column functions built from Spark expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def log_factorials(spark: SparkSession, n: int) -> DataFrame:
    """One row: lf, an array with log(k!) at k = 0..n. n is bounded by the caller's universe."""
    values, total = [0.0], 0.0
    for k in range(1, n + 1):
        total += math.log(k)
        values.append(total)
    return spark.createDataFrame([(values,)], "lf array<double>")


def log_factorial(n: Column) -> Column:
    """log(n!) in closed form: exact up to 19, Stirling's series from there (under 1e-15 off)."""
    small = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(20)])
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(x * (2 * math.pi)) + F.lit(1.0) / (12 * x) - F.lit(1.0) / (360 * x * x * x) + F.lit(1.0) / (1260 * F.pow(x, 5)) - F.lit(1.0) / (1680 * F.pow(x, 7))
    return F.when(n < 20, F.get(small, n.cast("int"))).otherwise(series)


def hypergeom_sf(common: Column, universe: Column, marked: Column, drawn: Column, lf: Column | None = None) -> Column:
    """P(X >= common) when ``drawn`` are taken from ``universe`` of which ``marked`` count.

    lf is the log-factorial array; without it they come in closed form. Terms run only over values that can occur; none gives 0.
    """
    at = log_factorial if lf is None else lambda k: F.get(lf, k.cast("int"))
    choose = lambda n, k: at(n) - at(k) - at(n - k)
    low = F.greatest(common, marked + drawn - universe, F.lit(0)).cast("int")
    high = F.least(marked, drawn).cast("int")
    terms = F.aggregate(F.sequence(low, high), F.lit(0.0), lambda s, k: s + F.exp(choose(marked, k) + choose(universe - marked, drawn - k) - choose(universe, drawn)))
    return F.when(low > high, F.lit(0.0)).otherwise(F.least(terms, F.lit(1.0)))


def normal_cdf(z: float) -> float:
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def average_rank(order: Column, *by: str) -> Column:
    """Rank from 1 with ties at their mean."""
    ties = Window.partitionBy(*by, order)
    return F.rank().over(Window.partitionBy(*by).orderBy(order)) + (F.count(F.lit(1)).over(ties) - 1) / 2


def condensed_index(i: Column | int, j: Column | int, n: Column | int):
    """Place of pair i < j of n in the row-wise upper triangle."""
    if all(isinstance(x, int) for x in (i, j, n)):
        return i * n + j - (i + 1) * (i + 2) // 2
    i, j, n = (F.lit(x) if isinstance(x, int) else x for x in (i, j, n))
    return (i * n + j - (i + 1) * (i + 2) / 2).cast("long")


def mean_confidence(value: str) -> list[Column]:
    """Mean and half-width of the 95 % interval."""
    return [F.avg(value).alias("mean"), (1.96 * F.stddev_samp(value) / F.sqrt(F.count(value))).alias("interval")]


def bp_to_kb(bp: Column) -> Column:
    return F.concat(F.floor(bp / 1000).cast("string"), F.lit("KB"))


def mann_whitney(rows: DataFrame, group: str, value: str) -> DataFrame:
    """U of the rows where ``group`` is true against the rest, its normal score and two-sided p.

    Ranks come from the counts of distinct values: one pass of aggregation, and a running sum over
    ranges of values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.sum(F.col(group).cast("long")).alias("a"), F.count(F.lit(1)).alias("n"))
    ranked = running_total(counts, "v", "n", "below").withColumn("rank", F.col("below") - F.col("n") + (F.col("n") + 1) / 2)
    total = ranked.agg(F.sum("a").alias("n1"), (F.sum("n") - F.sum("a")).alias("n2"), F.sum(F.col("a") * F.col("rank")).alias("r1"))
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    z = (F.col("u") - F.col("n1") * F.col("n2") / 2) / F.sqrt(F.col("n1") * F.col("n2") * (F.col("n1") + F.col("n2") + 1) / 12.0)
    return total.withColumn("u", u).withColumn("z", z).select("n1", "n2", "u", "z")


def dense_index(rows: DataFrame, *order: str | Column) -> DataFrame:
    """rows with ``idx``, dense from 0 in the given order, by ranges: each range is numbered by itself, after the sizes of those before."""
    from genonet.sources.shared import materialised

    dealt = materialised(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # a row for each range
    base = sizes.select(F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("idx", inside).join(F.broadcast(base), F.col("_range") == F.col("_r")).withColumn("idx", F.col("idx") - 1 + F.col("_base")).drop("_range", "_r", "_base")


def cumulative(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """rows with the running sum of ``value`` in the given order, by ranges: each range is summed up by itself, after the sums of those before."""
    from genonet.sources.shared import materialised

    dealt = materialised(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy("_range").agg(F.sum(value).alias("_sum"))
    # a row for each range
    base = sums.select(F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = F.sum(value).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn(name, inside).join(F.broadcast(base), F.col("_range") == F.col("_r")).withColumn(name, F.col(name) + F.col("_base")).drop("_range", "_r", "_base")


def running_total(rows: DataFrame, order: str, value: str, name: str, cells: int = 64) -> DataFrame:
    """rows with the running sum of ``value`` by ``order``, without one window over everything.

    Rows are cut into ranges; each range has its own window, and the ranges' totals, as many as
    ``cells``, are added up before.
    """
    at = sorted(set(rows.agg(F.percentile_approx(order, [k / cells for k in range(1, cells)], 1000)).first()[0] or []))
    cell = sum(((F.col(order) > x).cast("int") for x in at), F.lit(0))
    dealt = rows.withColumn("_cell", cell)
    sums = dealt.groupBy("_cell").agg(F.sum(value).alias("_sum"))
    base = sums.select(F.col("_cell").alias("_c"), F.coalesce(F.sum("_sum").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumn(name, F.sum(value).over(inside)).join(F.broadcast(base), F.col("_cell") == F.col("_c"))  # at most ``cells`` rows
    return summed.withColumn(name, F.col(name) + F.col("_base")).drop("_cell", "_c", "_base")
