"""Written intermediate tables and numbering of rows, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="sieveline-")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset in local mode, a temporary folder of this process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = _local_dir()
    return at.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: its lineage is cut, and it survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, by: list[str], order: list[str], out: str = "at") -> DataFrame:
    """df with the place of each row, from 0, among the rows of its group in the given order.

    Rows are range-partitioned by group and order, so a group of any size is spread; a task's rows are numbered where
    they lie, and only the counts by group and task are summed up. Null group keys are a group. Ties get places in any
    order that stays the same for the written table."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order)
    d = written(d.withColumn("__id", F.monotonically_increasing_id()), "numbered").withColumn("__part", F.shiftright("__id", 33))
    counts = d.groupBy(*by, "__part").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    before = W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    keys = [F.col(c).alias(f"__k{k}") for k, c in enumerate(by)]
    counts = counts.select(*keys, F.col("__part").alias("__p"), "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    on = F.col("__part") == F.col("__p")
    for k, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"__k{k}"))
    return d.join(counts, on).withColumn(out, F.col("__base") + F.col("__id") - F.col("__first")).select(*df.columns, out)
