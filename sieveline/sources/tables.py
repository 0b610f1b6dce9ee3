"""Reading tables and line files; writing upserts and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 50) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped) pages of documents: lines act as pages, those with fewer than `least` trimmed characters are skipped."""
    p = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("page", "page_text")).withColumn("page", F.col("page") + 1)
    short = F.length(F.trim("page_text")) < least
    return p.where(~short), p.where(short).select(key, "page")


def jsonl(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(header, rows) of text lines (column value): # lines are the header, the rest is JSON; blank lines drop."""
    v = F.trim("value")
    return lines.where(v.startswith("#")), lines.where((v != "") & ~v.startswith("#")).select(F.from_json("value", schema).alias("r")).select("r.*")


def runs(lines: DataFrame, result_schema: str) -> tuple[DataFrame, DataFrame]:
    """(usable runs, results) of run files (file, line, value); lines that are no JSON are passed over.

    A file counts if its first line is a run header; a run is usable if a result has no error."""
    j = lines.withColumn("j", F.try_parse_json("value")).where(F.col("j").isNotNull())
    kind = F.try_variant_get("j", "$.type", "string")
    heads = j.where((F.col("line") == 0) & (kind == "run")).select("file", F.try_variant_get("j", "$.runId", "string").alias("run_id"), F.try_variant_get("j", "$.startedAt", "string").alias("started_at"))
    results = j.where(kind == "result").select("file", F.from_json("value", result_schema).alias("r")).join(heads.select("file", "run_id"), "file").select("run_id", "r.*")
    good = results.where(F.col("error").isNull()).select("run_id").distinct()
    return heads.join(good, "run_id", "left_semi"), results


def parse_vector(text: Column) -> Column:
    """Array of doubles of "[a,b]"; null if an element is not a finite number."""
    v = F.from_json(text, "array<double>")
    return F.when(F.size(v) > 0, F.when(F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), v))


def latest(rows: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """Upsert result: the last row of each key. max_by keeps partial aggregation, so a hot key is no bottleneck."""
    rest = [c for c in rows.columns if c not in keys]
    order = F.struct(*seq)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*").select(*rows.columns)


def atom_entries(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """(id, title, summary) of the entries of Atom feeds; entries without id or title are passed over."""
    e = feeds.select(F.explode(F.regexp_extract_all(xml, F.lit(r"(?s)<entry>(.*?)</entry>"), F.lit(1))).alias("e"))
    field = lambda t: F.trim(F.regexp_replace(F.regexp_extract("e", rf"(?s)<{t}[^>]*>(.*?)</{t}>", 1), r"\s+", " "))
    return e.select(*[field(t).alias(t) for t in ("id", "title", "summary")]).where("id <> '' and title <> ''")


def quarantine(rows: DataFrame, fine: Column) -> tuple[DataFrame, DataFrame]:
    """(valid, failed) rows: what a writer would try row by row."""
    ok = F.coalesce(fine, F.lit(False))
    return rows.where(ok), rows.where(~ok)


def cache_key(value: Column) -> Column:
    """Content address: SHA-256 of the JSON of a value."""
    return F.sha2(F.to_json(value), 256)


def with_cache(asked: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(hits with their values, misses to compute) of asked against a cache table (key, value)."""
    return asked.join(cache, key), asked.join(cache, key, "left_anti")


def replace_children(children: DataFrame, fresh: DataFrame, parent: str) -> DataFrame:
    """Children after those of the fresh rows' parents are deleted and the fresh ones inserted."""
    return children.join(fresh.select(parent).distinct(), parent, "left_anti").unionByName(fresh)


def cascade_delete(children: DataFrame, deleted: DataFrame, parent: str) -> DataFrame:
    return children.join(deleted.select(parent).distinct(), parent, "left_anti")


def assert_complete(loaded: DataFrame, expected: int) -> DataFrame:
    """One row; fails when the count differs from the authoritative one in either direction."""
    return loaded.agg(F.count("*").alias("n")).select("n", F.assert_true(F.col("n") == expected, F.lit("incomplete read")).alias("ok"))


def first_per(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
