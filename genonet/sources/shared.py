"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a local master takes a temporary folder, and a cluster raises."""
    if base := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return base
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own.setdefault("dir", tempfile.mkdtemp(prefix="genonet-"))


def materialised(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: worked out once, lineage cut, no copy on one executor only."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions (path/v=N) of a table, ascending."""
    context = spark.sparkContext
    root = context._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(context._jsc.hadoopConfiguration())
    names = [x.getPath() for x in fs.listStatus(root)] if fs.exists(root) else []
    done = lambda p: fs.exists(context._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted(int(p.getName()[2:]) for p in names if p.getName().startswith("v=") and done(p))


def drop_versions(spark: SparkSession, path: str, gone: list[int]) -> None:
    context = spark.sparkContext
    for v in gone:
        p = context._jvm.org.apache.hadoop.fs.Path(f"{path}/v={v}")
        p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)


def write_version(df: DataFrame, path: str, kept: int = 2) -> None:
    """Writes df as the next version of a table. Readers have the version before until the new one is complete; a run that is lost leaves it as it was."""
    spark = df.sparkSession
    before = versions(spark, path)
    df.write.mode("overwrite").parquet(f"{path}/v={before[-1] + 1 if before else 0}")
    drop_versions(spark, path, before[: max(0, len(before) + 1 - kept)])


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of a table."""
    return spark.read.parquet(f"{path}/v={versions(spark, path)[-1]}")
