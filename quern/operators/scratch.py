"""Tables that end a lineage, and global places in an order."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; unset only where they are one process, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back, so that its lineage ends there."""
    at = path(df.sparkSession, name)
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out.scratch_path = at
    return out


def discard(df: DataFrame) -> None:
    """Deletes what written() wrote, when no later step reads it."""
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def numbered(df: DataFrame, order: list[str], place: str) -> DataFrame:
    """df with each row's place from 0 in an order: sorted ranges, then the sizes of the ranges before. No task holds all rows."""
    ranged = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    total, before = 0, []
    for row in sorted(ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):  # one row a task
        before.append((row["part"], total))
        total += row["n"]
    offsets = df.sparkSession.createDataFrame(before, "_part long, _before long")
    out = ranged.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return out.withColumn(place, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_before")
