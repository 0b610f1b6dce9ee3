import corpus_pipeline
from sieveline.llm.common import components, materialise, prefix_offsets

from ..conftest import SF


def test_stages_on_odd_documents(spark, odd_docs):
    docs, counts = odd_docs.select("doc_id", "text", "lang", "source", "n_chars"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialise(stage(spark, docs, SF), name)
        counts.append(docs.count())
        assert docs.columns == columns or k == 4
    assert counts[0] >= counts[1] >= counts[2] > 0 and counts[3] == counts[4]


def test_stages_on_nothing(spark, no_docs):
    docs = no_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), name)
        assert docs.count() == 0


def test_run_ends_in_ids_of_the_mixture(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns) and out.count() > 50


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 180)] + [(-5, -9), (-9, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == -9 for k in [*range(1, 41), -5, -9]) and all(got[k] == 100 for k in range(100, 180)) and len(got) == 122


def test_offsets_equal_a_running_sum(spark):
    from pyspark.sql import functions as F

    rows = [(g, i, (i * 7) % 5) for g in ("a", None) for i in range(50)]
    d = prefix_offsets(spark.createDataFrame(rows, "g string, i long, n long"), ["g"], ["i"], F.floor(F.col("i") / 8), "n", "at")
    for r in d.collect():
        assert r["at"] == sum((k * 7) % 5 for k in range(r["i"]))
