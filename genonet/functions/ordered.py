"""What looks at the rows before and after in an order, by ranges of rows instead of one window over everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genonet.functions.stats import dense_index
from genonet.sources.shared import materialised


def one_each(rows: DataFrame, key: list[str], order: str | None = None, last: bool = True) -> DataFrame:
    """One row for each key: the last (or first) by the column ``order``, else by all other columns, so that the result does not hang on how rows are dealt."""
    by = [order] if order else [c for c in rows.columns if c not in key]
    top = F.struct(*by, *[c for c in rows.columns if c not in key and c not in by], F.lit(0)).alias("_by")
    best = (F.max_by if last else F.min_by)(F.struct(*rows.columns), top)
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(best.alias("_row")).select("_row.*")


def with_previous(rows: DataFrame, order: list[str], columns: list[str], prefix: str = "previous_") -> DataFrame:
    """rows with the columns of the row before in the given order; null in the first.

    Ranges of the order are numbered one after the other, and each row meets the one numbered before it by an
    equi-join, so that the first of a range meets the last of the range before.
    """
    numbered = materialised(dense_index(rows, *order))
    before = numbered.select((F.col("idx") + 1).alias("idx"), *[F.col(c).alias(f"{prefix}{c}") for c in columns])
    return numbered.join(before, "idx", "left").drop("idx")


def nearest(rows: DataFrame, known: DataFrame, key: str, name: str = "nearest") -> DataFrame:
    """rows with the key of ``known`` that is nearest to their own, the smaller one of two that are equally near.

    Both tables' keys are cut into ranges together. Inside a range a running maximum carries the last
    known key on and a running minimum the next one back; the ranges' own first and last known keys,
    two for each, are carried across. Null keys, and all where nothing is known, get null.
    """
    kept = [c for c in rows.columns if c != key]
    mine = rows.select(F.col(key), F.struct(*kept).alias("_row") if kept else F.lit(None).alias("_row"), F.lit(None).cast(rows.schema[key].dataType).alias("_known"), F.lit(True).alias("_mine"))
    theirs = known.where(F.col(key).isNotNull()).select(F.col(key).cast(rows.schema[key].dataType)).distinct().select(key, F.lit(None).cast(mine.schema["_row"].dataType).alias("_row"), F.col(key).alias("_known"), F.lit(False).alias("_mine"))
    dealt = materialised(mine.unionByName(theirs).repartitionByRange(key).withColumn("_range", F.spark_partition_id()))
    ends = dealt.groupBy("_range").agg(F.min("_known").alias("_first"), F.max("_known").alias("_last"))
    order = Window.orderBy("_range")  # a row for each range
    carried = ends.select(F.col("_range").alias("_r"), F.max("_last").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_from_before"), F.min("_first").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_from_after"))
    inside, back = (Window.partitionBy("_range").orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.asc(key), F.desc(key)))
    # backwards, as a frame that ends with the partition is gone through again for every row
    last, later = F.max("_known").over(inside), F.min("_known").over(back)
    found = dealt.withColumns({"_last": last, "_next": later}).where("_mine").join(F.broadcast(carried), F.col("_range") == F.col("_r"))
    low, high = F.coalesce("_last", "_from_before"), F.coalesce("_next", "_from_after")
    best = F.when(low.isNull() | (high - F.col(key) < F.col(key) - low), high).otherwise(low)
    return found.select(F.col(key), *[F.col("_row")[c].alias(c) for c in kept], F.when(F.col(key).isNotNull(), best).alias(name)).select(*rows.columns, name)
