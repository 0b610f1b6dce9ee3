"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, mixing, BPE.

Each stage takes the documents that its predecessor kept (written as Parquet and read again) and returns a
DataFrame; all but the last return the columns of documents.

Defined results: documents without words fail the quality rules; a document that loses all its words goes; an empty
table passes through every stage as one; other columns are carried along, whatever their names, up to the last stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm.bpe import encode, vocabulary
from sieveline.llm.common import materialise
from sieveline.llm.line_dedup import dedup_lines
from sieveline.llm.mixing import mixed_documents
from sieveline.llm.quality_rules import keep_good
from sieveline.llm.simhash_dedup import keep_one


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its repeated lines out of text; n_chars follows. One that loses all its words goes."""
    out = dedup_lines(docs)
    dropped = out.columns[-1]  # n_dropped, or a longer name where the documents have that column
    left = (F.col(dropped) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.where(left).select(*[F.when(F.col(dropped) > 0, F.length("text").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates."""
    return keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture by source: a row per document and epoch, with the words that the mix takes in it."""
    return mixed_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) of every row, with digests of ids and of their decoded text."""
    coded = encode(docs.select("doc_id", "lang", "source", "text"), vocabulary())
    digests = [F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")]
    return coded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", *digests)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_dedup", simhash_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: The multinomial draw, permutations and merges have no SQL form; the operators have brute-force tests of their own, the stages are tested for row counts and columns only.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{name}")
    return docs
