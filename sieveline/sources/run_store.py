"""Runs as a product: resolved by path, id or variant, mirrored into a store that can be replayed, frozen as a baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .tables import latest

KEYS = ["run_id", "question_id"]
LONGEST = 256  # characters of a run id's beginning; a longer ref is compared whole


def usable_runs(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Runs (run_id, ...) with `usable`: whether a result (run_id, error) has no error."""
    good = results.where("error is null").select("run_id").distinct().withColumn("usable", F.lit(True))
    return runs.join(good, "run_id", "left").withColumn("usable", F.coalesce("usable", F.lit(False)))


def resolved(asked: DataFrame, runs: DataFrame) -> DataFrame:
    """(ref, run_id, problem) of every distinct ref asked for, among runs (pos, run_id, variant, file, started_at, usable).

    A ref with a slash or ending in .jsonl is a file, known by its name. Any other is a run id or the beginning of one, the first
    in order of pos, else a variant, whose latest usable run counts (of equal times the first). problem is "unusable" for a run found
    without a good result, "unknown" if none is found; a null ref is unknown. Beginnings are joined on equality, cut to the lengths asked for."""
    a = asked.select("ref").distinct()
    path = F.col("ref").rlike("[/\\\\]") | F.col("ref").endswith(".jsonl")
    name = lambda c: F.regexp_extract(c, r"([^/\\]*)$", 1)
    files = runs.where("file is not null").select(name(F.col("file")).alias("key"), F.struct("pos", "run_id", "usable").alias("r")).groupBy("key").agg(F.min("r").alias("r"))
    by_path = a.where(path).withColumn("key", name(F.col("ref"))).join(files, "key").select("ref", F.lit(0).alias("way"), "r")
    plain = a.where(~path)
    sizes = [r[0] for r in plain.select(F.length("ref")).where(F.length("ref") <= LONGEST).distinct().collect()]  # at most LONGEST + 1 numbers
    cut = F.array_distinct(F.array(F.col("run_id"), *[F.substring("run_id", 1, n) for n in sizes]))
    heads = runs.select(F.explode(cut).alias("ref"), F.struct("pos", "run_id", "usable").alias("r"))
    by_id = heads.groupBy("ref").agg(F.min("r").alias("r")).join(plain, "ref").select("ref", F.lit(1).alias("way"), "r")
    newest = runs.where("usable").groupBy(F.col("variant").alias("ref")).agg(F.max_by(F.struct("pos", "run_id", "usable"), F.struct("started_at", -F.col("pos"))).alias("r"))
    by_variant = newest.join(plain, "ref").select("ref", F.lit(2).alias("way"), "r")
    best = by_path.unionByName(by_id).unionByName(by_variant).groupBy("ref").agg(F.min_by("r", "way").alias("r"))
    out = a.join(best, "ref", "left")
    problem = F.when(F.col("r").isNull(), "unknown").when(~F.col("r.usable"), "unusable")
    return out.select("ref", F.col("r.run_id").alias("run_id"), problem.alias("problem"))


def parents_first(items: DataFrame) -> DataFrame:
    """Items (id, parent, ...) as they may be written under a self-reference: a link to an item that is not there is null,
    `wave` 0 has no parent and goes before wave 1."""
    present = items.where("id is not null").select(F.col("id").alias("parent")).distinct().withColumn("__there", F.lit(True))
    linked = items.join(present, "parent", "left").withColumn("parent", F.when(F.col("__there"), F.col("parent"))).drop("__there")
    return linked.select(*items.columns, F.when(F.col("parent").isNull(), 0).otherwise(1).alias("wave"))


def backfilled(store: DataFrame, runs: DataFrame, results: DataFrame) -> DataFrame:
    """The store (run_id, question_id, ...) after the results of usable runs are written over it; a second time changes nothing."""
    good = results.join(usable_runs(runs, results).where("usable").select("run_id"), "run_id", "left_semi").select(*store.columns)
    both = store.withColumn("__seq", F.lit(0)).unionByName(good.withColumn("__seq", F.lit(1)))
    return latest(both, KEYS, ["__seq"]).drop("__seq")


def baseline(results: DataFrame) -> DataFrame:
    """(run_id, question_id, metrics, error): what a gate compares; answers and hits stay behind."""
    return results.select(*KEYS, "metrics", "error")


def append_stream(results: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch of a stream of results to its own folder of `path`; a batch that is replayed replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Results of append_stream: the last written row of each run and question, a resumed run's rows over its earlier ones."""
    rows = spark.read.schema(f"{schema}, batch long").option("basePath", path).parquet(path)
    return latest(rows, KEYS, ["batch"]).drop("batch")

