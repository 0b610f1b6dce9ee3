from sieveline.sources import run_store as S

RUNS = "pos int, run_id string, variant string, file string, started_at string, usable boolean"


def test_runs_by_path_id_and_variant(spark):
    runs = spark.createDataFrame([(1, "abc1", "base", "x/1.jsonl", "2024-01-01", True), (2, "abd2", "base", "x/2.jsonl", "2024-02-01", True), (3, "ff", "base", "x/3.jsonl", "2024-03-01", False), (4, "abc9", "ab", None, "2024-02-01", True), (5, "e", "base", "y/2.jsonl", "2024-02-01", True), (6, None, None, None, None, False)], RUNS)
    want = {"ab": ("abc1", None), "abd": ("abd2", None), "ff": ("ff", "unusable"), "f": ("ff", "unusable"), "base": ("abd2", None), "other": (None, "unknown"), "z/2.jsonl": ("abd2", None), "3.jsonl": ("ff", "unusable"), "ab/": (None, "unknown"), "": ("abc1", None), "abc1x": (None, "unknown"), None: (None, "unknown"), "q" * 300: (None, "unknown")}
    asked = spark.createDataFrame([(k,) for k in want] + [("ab",)], "ref string")
    assert {r["ref"]: (r["run_id"], r["problem"]) for r in S.resolved(asked, runs).collect()} == want
    assert S.resolved(asked.limit(0), runs).count() == 0 and S.resolved(asked, runs.limit(0)).where("problem = 'unknown'").count() == len(want)


def test_links_to_what_is_not_there_are_dropped(spark):
    items = spark.createDataFrame([("a", None, 1), ("b", "a", 2), ("c", "z", 3), (None, "b", 4), ("d", "d", 5)], "id string, parent string, wave_no int")
    got = {r["wave_no"]: (r["id"], r["parent"], r["wave"]) for r in S.parents_first(items).collect()}
    assert got == {1: ("a", None, 0), 2: ("b", "a", 1), 3: ("c", None, 0), 4: (None, "b", 1), 5: ("d", "d", 1)}


def test_a_second_backfill_changes_nothing(spark):
    schema = "run_id string, question_id int, error string, score double"
    store = spark.createDataFrame([("r", 1, "old", 0.0), ("s", 1, "old", 0.0)], schema)
    results = spark.createDataFrame([("r", 1, None, 1.0), ("r", 2, "e", 2.0), ("s", 1, "e", 3.0), ("t", 1, None, 4.0)], schema)
    runs = spark.createDataFrame([("r",), ("s",)], "run_id string")
    once = S.backfilled(store, runs, results)
    assert sorted(map(tuple, once.collect())) == sorted([("r", 1, None, 1.0), ("r", 2, "e", 2.0), ("s", 1, "old", 0.0)])
    assert sorted(map(tuple, S.backfilled(once, runs, results).collect())) == sorted(map(tuple, once.collect()))
    assert S.backfilled(store, runs.limit(0), results).count() == 2


def test_replayed_batches_replace_themselves(spark, tmp_path):
    schema = "run_id string, question_id int, error string, metrics double"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("r", 1, "e", 0.5), ("r", 2, None, 0.25)], schema).coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    S.append_stream(stream(), out, str(tmp_path / "c1")).awaitTermination()
    S.append_stream(stream(), out, str(tmp_path / "c2")).awaitTermination()  # a lost checkpoint: batch 0 comes again
    assert spark.read.parquet(out).count() == 2
    spark.createDataFrame([("r", 1, None, 0.75)], schema).coalesce(1).write.mode("append").parquet(source)
    S.append_stream(stream(), out, str(tmp_path / "c2")).awaitTermination()
    got = S.stored(spark, out, schema)
    assert got.columns == ["run_id", "question_id", "error", "metrics"]
    assert sorted(tuple(r) for r in S.baseline(got).select("run_id", "question_id", "metrics", "error").collect()) == [("r", 1, 0.75, None), ("r", 2, 0.25, None)]
