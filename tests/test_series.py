import math
import random
from functools import reduce
from operator import add

import pytest
from pyspark.sql import functions as F

from sieveline.operators import metrics, mining, series, stats
from sieveline.plans import series as plans
from sieveline.sources.shared import numbered

from .compare import same
from .conftest import SF


@pytest.mark.parametrize("name", list(plans.CATALOG))
def test_query_equals_its_sql(spark, name):
    run, sql = plans.CATALOG[name]
    same(run(spark, SF), sql, SF)


def test_numbers_follow_the_order(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, *range(50)]), k) for k in range(600)]
    got = numbered(spark.createDataFrame(rows, "g string, v int, k int"), ["g"], ["v", "k"]).collect()
    for g in (None, "a", "b"):
        want = sorted(((v is not None, v or 0, k) for x, v, k in rows if x == g))
        assert [r["k"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["at"])] == [k for _, _, k in want]
        assert sorted(r["at"] for r in got if r["g"] == g) == list(range(len(want)))
    assert numbered(spark.createDataFrame([], "g string, v int"), [], ["v"]).count() == 0


def loop(values, iters, seed, spark):
    n = len(values)
    draws = iter([r["x"] for r in stats.prng(spark, seed, iters * n).orderBy("k").collect()])
    return [reduce(add, (values[int(next(draws) * n)] for _ in range(n)), 0.0) / n for _ in range(iters)]  # sum() compensates


def test_grouped_bootstrap_equals_a_loop_for_each_group(spark):
    rng = random.Random(4)
    data = {"a": [rng.random() for _ in range(37)], "b": [rng.random() for _ in range(5)], "c": [0.25]}
    d = spark.createDataFrame([(g, 10 * k, x) for g, xs in data.items() for k, x in enumerate(xs)], "g string, pos int, x double")
    for block in (65_536, 8, 1):
        got = stats.resampled_means(d, 60, 9, ["g"], block).orderBy("g", "i").collect()
        for g, xs in data.items():
            want = loop(xs, 60, 9, spark)
            mine = [r["m"] for r in got if r["g"] == g]
            assert mine == (want if block > 37 else pytest.approx(want, abs=1e-12))


def test_bootstrap_of_nothing(spark):
    none = spark.createDataFrame([], "pos int, x double, a double, b double")
    r = stats.bootstrap_ci(none.select("pos", "x"), 20).collect()
    assert len(r) == 1 and (r[0]["n"], r[0]["mean"], r[0]["lo"]) == (0, None, None)
    assert stats.paired_bootstrap(none.select(F.lit("g").alias("g"), "pos", "a", "b"), 20, by=["g"]).count() == 0


def test_ranks_of_groups(spark):
    rows = [(None, 1.0), (None, 3.0), ("x", 5.0), ("x", None), ("x", 7.0), ("x", 6.0), ("x", 8.0), ("y", None)]
    got = {r["g"]: tuple(r)[1:] for r in metrics.ranks(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"a": 0.5, "z": 0.0}, {"b": 0.5, "top": 1.0}).collect()}
    assert got == {None: (1.0, 1.0, 3.0, 3.0), "x": (6.0, 5.0, 7.0, 8.0)}


def greedy(rows, limit):
    es, ps, out = set(), set(), []
    for r in sorted(set(rows), key=lambda r: (-r[2], r[0], r[1])):
        if r[0] not in es and r[1] not in ps and len(out) < limit:
            es.add(r[0])
            ps.add(r[1])
            out.append(r)
    return out


@pytest.mark.parametrize("limit", [1, 7, 1000])
def test_diverse_equals_the_sequential_choice(spark, limit):
    rng = random.Random(limit)
    rows = [("hot" if rng.random() < 0.4 else f"e{rng.randint(0, 40)}", f"p{rng.randint(0, 40)}", float(rng.randint(0, 9))) for _ in range(700)]
    rows += rows[:20]
    chain = [(f"c{k // 2}", f"d{(k + 1) // 2}", 100.0 - k) for k in range(30)]  # each pair hangs on the one before
    d = spark.createDataFrame([*rows, *chain, (None, "p1", 500.0), ("e1", None, 500.0)], "e string, p string, s double")
    got = mining.diverse(d, "e", "p", [(-F.col("s")).alias("s")], limit).collect()
    assert [tuple(r) for r in got] == greedy(rows + chain, limit)
    assert mining.diverse(d.where("s > 1000"), "e", "p", [F.col("s")], limit).count() == 0


def test_series_pair_what_both_runs_have(spark):
    schema = "run string, id string, error string, metric string, value double"
    base = [("q1", None, "recall@1", 1.0), ("q2", None, "recall@1", float("nan")), ("q3", "boom", "recall@1", 0.0), ("q4", None, "recall@1", 0.5), ("q1", None, "old", 1.0), ("q4", None, "Recall@10", 0.1)]
    arm = [("q1", None, "recall@1", 0.5), ("q2", None, "recall@1", 1.0), ("q3", None, "recall@1", 1.0), ("q4", None, "recall@1", None), ("q5", None, "new", 1.0), ("q4", None, "Recall@10", 0.3), (None, None, "recall@1", 1.0)]
    b = spark.createDataFrame([("base", *r) for r in base], schema).drop("run")
    p = series.paired_series(b, spark.createDataFrame([("arm", *r) for r in arm], schema))
    assert sorted((r["metric"], r["id"], r["a"], r["b"]) for r in p.collect()) == [("Recall@10", "q4", 0.1, 0.3), ("recall@1", "q1", 1.0, 0.5)]


def test_metrics_are_read_in_order(spark):
    names = ["totalMs", "recall@10", "ndcg@3", "danglingCitations", "recall@2", "recall", "costUsd", "a@b@5", "x@y"]
    got = [r["m"] for r in spark.createDataFrame([(n,) for n in names], "m string").orderBy(series.metric_place(F.col("m"))).collect()]
    assert got == ["a@b@5", "ndcg@3", "recall", "recall@2", "recall@10", "x@y", "danglingCitations", "costUsd", "totalMs"]


def test_sweep_shows_what_survives(spark):
    rng = random.Random(1)
    rows = [(arm, m, f"q{k}", 0.0, rng.gauss(shift, 1)) for arm, shift in (("better", 2.0), ("same", 0.0)) for m in ("recall@5", "ndcg@5", "costUsd") for k in range(40)]
    d = spark.createDataFrame(rows, "run string, metric string, id string, a double, b double")
    got = {r["run"]: r for r in series.sweep(d, iters=400).collect()}
    assert got["better"]["survivors"] == 3 and got["same"]["survivors"] == 0 and {r["metric"] for r in got.values()} == {"recall@5"}
    assert got["better"]["delta"] > 1 and got["better"]["lo"] > 0
    shown = {r["run"]: r["metric"] for r in series.sweep(d.where("run = 'same' or metric <> 'costUsd'"), "costUsd", iters=50).collect()}
    assert shown == {"better": None, "same": "costUsd"}


def plain_split(items, quotas, pinned, first, key):
    fam = {}
    for root, id_, kind in items:
        if root is not None:
            fam.setdefault(root, []).append(kind)
    order = sorted(fam, key=lambda r: (key(r), r))
    need, taken = dict(quotas), set()
    for scarce in (True, False):
        for r in order:
            kinds = fam[r]
            if ((first in kinds) != scarce) or any(k in pinned or k not in quotas for k in kinds):
                continue
            if scarce and need[first] <= 0:
                break
            if all(kinds.count(t) <= need[t] for t in quotas):
                taken.add(r)
                for t in quotas:
                    need[t] -= kinds.count(t)
    return {(i, "holdout" if r in taken else "dev") for r, i, _ in items}, need


@pytest.mark.parametrize("seed", range(3))
def test_split_equals_the_sequential_fill(spark, seed):
    rng = random.Random(seed)
    items = []
    for root in range(120):
        kinds = ["factoid"] * rng.randint(1, 3) + ["paraphrase"] * rng.choice([0, 0, 1, 2, 5]) + ["aggregation"] * (rng.random() < 0.2) + [None] * (rng.random() < 0.05)
        items += [(root, root * 100 + k, t) for k, t in enumerate(kinds)]
    items += [(None, -1, "factoid")]
    quotas = {"factoid": 30 + seed, "paraphrase": 17, "multihop": 0}
    d = spark.createDataFrame(items, "root long, id long, type string")
    out, need = series.leak_free_split(d, quotas, ["aggregation"], "paraphrase", F.col("root") * 7919 % 101, strict=False)
    want, lack = plain_split(items, quotas, ["aggregation"], "paraphrase", lambda r: r * 7919 % 101)
    assert {(r["id"], r["split"]) for r in out.collect()} == want and need == lack
    both = out.groupBy("root").agg(F.count_distinct("split").alias("n")).where("root is not null and n > 1")
    assert both.count() == 0


def test_split_that_cannot_be_filled(spark):
    d = spark.createDataFrame([(1, 1, "factoid"), (1, 2, "factoid")], "root long, id long, type string")
    with pytest.raises(ValueError, match="1 factoid"):
        series.leak_free_split(d, {"factoid": 1}, [], None, F.col("root"))
    assert series.leak_free_split(d.limit(0), {"factoid": 0}, [], None, F.col("root"))[0].count() == 0


def test_resamples_never_travel_to_the_driver_and_nulls_add_nothing(spark):
    """the draws were rows of a join, broadcast whole once their size was guessed from what came before them."""
    d = spark.range(3000).select(F.col("id").alias("pos"), F.when(F.col("id") % 3 > 0, F.col("id") / 7).alias("x"))
    means = stats.resampled_means(d, 40, 42)
    plan = means._jdf.queryExecution().optimizedPlan().toString()
    assert "draws" not in plan and "MapInPandas" in plan
    xs = [r["x"] for r in d.orderBy("pos").collect()]
    draws = iter([r["x"] for r in stats.prng(spark, 42, 40 * 3000).orderBy("k").collect()])
    want = [reduce(add, (xs[p] for p in (int(next(draws) * 3000) for _ in range(3000)) if xs[p] is not None), 0.0) / 3000 for _ in range(40)]
    assert [r["m"] for r in means.orderBy("i").collect()] == want


def test_diverse_entity_pairs_equal_the_choice_among_all_pairs(spark, monkeypatch):
    """all pairs were made to choose a few; F10: a frequent entity was one task's."""
    rng = random.Random(8)
    names = [f"Name{chr(97 + k)}" for k in range(12)]
    rows = [(doc * 100 + line, doc, ". ".join(w for w in rng.choices(names, k=9))) for doc in range(60) for line in range(2)]
    d = spark.createDataFrame(rows, "id long, doc long, text string")
    pair = F.concat_ws("|", F.col("a").cast("string"), F.col("b").cast("string"))
    whole = mining.entity_pairs(d, True, 0.9).withColumn("pair", pair)
    order = [F.col("a"), F.col("b")]
    monkeypatch.setattr(mining, "PAIR_TILE", 7)
    assert sorted(map(tuple, mining.entity_pairs(d, True, 0.9).collect())) == sorted(map(tuple, whole.drop("pair").collect()))
    made = []
    paired = mining.paired_mentions
    monkeypatch.setattr(mining, "paired_mentions", lambda m, *more: made.append(m.count()) or paired(m, *more))
    for limit in (3, 12, 40):
        want = mining.diverse(whole, "entity", "pair", [(-F.col("score")).alias("s"), *order], limit)
        got = mining.diverse_entity_pairs(d, 0.9, order, limit)
        assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert made[0] < made[-1]


@pytest.mark.parametrize(("tile", "met", "leaving"), [(1 << 14, 1 << 19, 1 << 16), (7, 50, 10)])
def test_pairs_across_documents_are_not_sorted_or_shuffled(spark, monkeypatch, tile, met, leaving):
    """every pair went through an exchange and a window to find its best entity."""
    for name, size in (("CHUNK_TILE", tile), ("MET", met), ("LEAVING", leaving)):
        monkeypatch.setattr(mining, name, size)
    rng = random.Random(3)
    rows = [(doc * 100 + line, doc, e, rng.randint(2, 4)) for doc in range(30) for line in range(3) for e in rng.sample(["Ab", "Ac", "Zé", "Z日", "Q", "R", "S"], rng.randint(0, 5))]
    df = {e: len({d for _, d, x, _ in rows if x == e}) for e in {e for _, _, e, _ in rows}}
    idf = lambda e: 2.0 if e < "B" else math.log(30 / (1 + df[e])) + 1
    m = spark.createDataFrame([(i, d, e, tf, df[e], idf(e)) for i, d, e, tf in rows] + [(None, None, "Ab", 2, 1, 2.0)], "id long, doc long, entity string, tf long, df long, idf double")
    want = {}
    for i, d, e, t in rows:
        for j, c, x, v in rows:
            if i < j and d != c and e == x:
                best = (-round(idf(e) * min(t, v), 6), e.encode(), df[e], min(t, v))
                want[i, j] = min(want.get((i, j), best), best)
    got = mining.paired_mentions(m, True)
    assert sorted(map(tuple, got.collect())) == sorted((a, b, e.decode(), n, t, -s) for (a, b), (s, e, n, t) in want.items())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.lstrip().startswith("MapInArrow")
    assert mining.paired_mentions(m.limit(0), True).count() == 0
