"""Incremental results: files of new rows are merged into a results table as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from genonet.functions.ordered import one_each
from genonet.operators.overlap import KEY, upsert
from genonet.sources.shared import drop_versions, latest, versions  # noqa: F401  latest() reads what merge_stream() writes

KEPT = 2


def merge_stream(new_rows: DataFrame, target: str, checkpoint: str, key: list[str] = KEY, order: str | None = None) -> StreamingQuery:
    """Starts a query that replaces rows of the same key in the Parquet table ``target`` by each batch's. Of equal keys in a batch the last by ``order`` stays, else by all columns.

    The table's versions lie side by side (target/v=N), so a batch that is run again after a lost
    driver writes the same version anew. The last KEPT versions stay, for readers under way.
    """
    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        out = one_each(batch, key, order)
        before = [v for v in versions(spark, target) if v < n]
        if before:
            out = upsert(spark.read.parquet(f"{target}/v={before[-1]}"), out, key)
        out.write.mode("overwrite").parquet(f"{target}/v={n}")
        drop_versions(spark, target, before[: max(0, len(before) + 1 - KEPT)])

    return new_rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
