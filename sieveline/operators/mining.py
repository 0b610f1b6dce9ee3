"""Corpus mining: terms, entities, pairs, near-duplicates, triage, samples and splits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import fnv1a
from ..functions.text import entity_mentions
from ..sources.shared import written
from .retrieval import best_pairs, explode_terms, idf, term_rows, term_vectors


def containment(questions: DataFrame, chunks: DataFrame, weights: DataFrame, n: int) -> DataFrame:
    """(query_id, id, overlap) for (query_id, id) pairs given with both texts: idf-weighted share of the question's terms.

    questions (query_id, id, text) names the chunk of each question; an equi join on (pair, term)."""
    import math

    q = term_rows(questions, ["query_id", "id"]).distinct()
    q = q.join(weights.select("term", "idf"), "term", "left").withColumn("w", F.coalesce("idf", F.lit(math.log(n or 1) + 1)))
    named = chunks.join(questions.select("id").distinct(), "id", "left_semi")  # no other chunk is cut into terms
    c = term_rows(named, ["id"]).distinct().withColumn("has", F.lit(1))
    j = q.join(c, ["id", "term"], "left")
    sums = j.groupBy("query_id", "id").agg(F.sum("w").alias("total"), F.sum(F.when(F.col("has") == 1, F.col("w")).otherwise(0.0)).alias("shared"))
    return sums.select("query_id", "id", F.round(F.coalesce(F.try_divide("shared", "total"), F.lit(0.0)), 6).alias("overlap"))


def similar_earlier(items: DataFrame, weights: DataFrame, n: int) -> DataFrame:
    """(query_id, nearest_id, similarity): best TF-IDF cosine to an item with a smaller pos; the earliest wins ties.

    A self-join on shared terms with prior.pos < pos, not a cross product."""
    v = term_vectors(items, "query_id", weights, n)
    p = items.select("query_id", "pos")
    mine, prior = v.join(p, "query_id"), v.join(p, "query_id").select(F.col("query_id").alias("nearest_id"), "term", F.col("w").alias("w2"), F.col("pos").alias("pos2"))
    pairs = mine.join(prior, "term").where("pos2 < pos").groupBy("query_id", "nearest_id", "pos2").agg(F.round(F.sum(F.col("w") * F.col("w2")), 6).alias("similarity"))
    best = pairs.groupBy("query_id").agg(F.max(F.struct("similarity", (-F.col("pos2")).alias("neg"), "nearest_id")).alias("b"))
    return best.select("query_id", "b.nearest_id", "b.similarity")


def triage(items: DataFrame, overlaps: DataFrame, weights: DataFrame, n: int, lexical: float = 0.5, duplicate: float = 0.9) -> DataFrame:
    """(query_id, flag, overlap, similarity): duplicate of an earlier question before lexical overlap with its source."""
    j = items.select("query_id").join(similar_earlier(items, weights, n), "query_id", "left").join(overlaps.select("query_id", "overlap"), "query_id", "left")
    sim, over = F.coalesce("similarity", F.lit(0.0)), F.coalesce("overlap", F.lit(0.0))
    flag = F.when(sim >= duplicate, "duplicate").when(over >= lexical, "lexical")
    return j.select("query_id", flag.alias("flag"), over.alias("overlap"), sim.alias("similarity"))


def near_duplicates(labelled: DataFrame, candidates: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(id, labelled_id, similarity, same_doc): unlabelled vectors whose best cosine to a labelled one passes the threshold.

    labelled (query_id, vector, doc), candidates (id, vector, doc)."""
    base = candidates.join(labelled.select(F.col("query_id").alias("id")), "id", "left_anti")
    one = F.lit(0).cast("long")
    pairs = best_pairs(labelled.withColumn("tag", one), base.withColumn("tag", one), 1, "id", threshold - 1e-6)
    best = pairs.groupBy("id").agg(F.max(F.struct("similarity", (-F.col("query_id")).alias("neg"))).alias("b"))
    best = best.select("id", (-F.col("b.neg")).alias("labelled_id"), "b.similarity").where(F.col("similarity") >= threshold)
    best = best.join(base.groupBy("id").agg(F.first("doc").alias("doc")), "id")
    return best.join(labelled.select(F.col("query_id").alias("labelled_id"), F.col("doc").alias("doc2")), "labelled_id").select("id", "labelled_id", "similarity", (F.col("doc") == F.col("doc2")).alias("same_doc"))


def mentions(chunks: DataFrame) -> DataFrame:
    """(id, doc, entity, tf) of chunks (id, doc, text)."""
    return explode_terms(chunks, ["id", "doc"], entity_mentions(F.col("text")), "entity").groupBy("id", "doc", "entity").agg(F.count("*").alias("tf"))


def entity_index(found: DataFrame) -> DataFrame:
    """(entity, df): distinct documents per entity."""
    return found.groupBy("entity").agg(F.count_distinct("doc").alias("df"))


#: Rows of an entity that meet as many others in one task.
PAIR_TILE = 512
#: Chunks of a tile that meets each other tile in one task, their mentions on average, and shared entities that are looked at together.
CHUNK_TILE, MENTIONS, MET = 1 << 14, 32, 1 << 19
#: Pairs that leave a task at once.
LEAVING = 1 << 16


def pair_mentions(chunks: DataFrame, cross: bool, fraction: float, least: int = 2) -> DataFrame:
    """(id, doc, entity, tf, df, idf) of the mentions that may make a pair: entities are cut by df, mentions by tf."""
    found = mentions(chunks)
    n = chunks.select("doc").distinct().count()
    most = max(2 if cross else 1, int(fraction * n))
    m = found.join(entity_index(found).where(F.col("df") <= most), "entity").where(F.col("tf") >= least)
    return m.select("id", "doc", "entity", "tf", "df", (F.log(F.lit(n) / (1 + F.col("df"))) + 1).alias("idf"))


def paired_mentions(m: DataFrame, cross: bool, distance: int = 5) -> DataFrame:
    """(a, b, entity, df, tf, score): pairs of mentions (see pair_mentions) with their best shared entity, across documents or within them."""
    return _across(m) if cross else _within(m, distance)


def _within(m: DataFrame, distance: int) -> DataFrame:
    """The mentions of an entity are dealt into tiles by document, so that a frequent entity is spread over many tasks."""
    m = written(m, "mentions")
    tiles = m.groupBy("entity").agg(F.ceil(F.count("*") / PAIR_TILE).cast("int").alias("tiles")).where("tiles > 1")
    m = m.join(tiles, "entity", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    m = m.withColumn("i", F.pmod(F.xxhash64("doc"), F.col("tiles")).cast("int"))
    x, y = m.alias("x"), m.alias("y")
    on = (F.col("x.entity") == F.col("y.entity")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.id") < F.col("y.id"))
    on = on & (F.col("x.doc") == F.col("y.doc")) & (F.abs(F.col("x.id") - F.col("y.id")) >= distance)
    tf = F.least("x.tf", "y.tf")
    pairs = x.join(y, on).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.entity").alias("entity"), F.col("x.df").alias("df"), tf.alias("tf"), F.round(F.col("x.idf") * tf, 6).alias("score"))
    w = W.partitionBy("a", "b").orderBy(F.desc("score"), "entity")
    return pairs.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def _across(m: DataFrame) -> DataFrame:
    """Chunks are dealt into tiles by id, and every two tiles meet in one task, which so has all that two chunks share and
    picks the best of it. Pairs leave as they are found: they are neither sorted nor shuffled, and a task holds two tiles and MET shared entities."""
    m = written(m.where("id is not null and doc is not null"), "mentions")
    names = m.groupBy("entity").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("entity")
    names = written(names.orderBy("entity").withColumn("no", F.monotonically_increasing_id()), "names")  # numbers in the order of names
    m = m.join(names, "entity").select("id", "doc", "no", "entity", "df", "tf", F.round(F.col("idf") * F.col("tf"), 6).alias("score"))
    size = m.agg(F.count_distinct("id").alias("chunks"), F.count("*").alias("rows")).first()
    parts = int(m.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = min(np.sqrt(2 * parts), size["chunks"] / 256)  # tiles for as many pairs of them as partitions
    tiles = int(np.ceil(max(1, size["chunks"] / CHUNK_TILE, size["rows"] / CHUNK_TILE / MENTIONS, spread)))
    mine, other = F.pmod(F.xxhash64("id"), F.lit(tiles)), F.col("other")
    d = m.withColumn("tile", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    d = d.withColumn("at", F.least("tile", other) * tiles + F.greatest("tile", other)).withColumn("right", F.col("tile") > other).drop("tile", "other")
    d = d.repartition(max(parts, tiles * (tiles + 1) // 2), "at").sortWithinPartitions("at")

    def run(batches):
        held, now = [], -1
        for batch in batches:
            at = batch.column("at").to_numpy()
            cuts = np.flatnonzero(np.diff(at)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
                if hi > lo and at[lo] != now:
                    if held:
                        yield from _met(pa.Table.from_batches(held), now // tiles == now % tiles)
                    held, now = [], int(at[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from _met(pa.Table.from_batches(held), now // tiles == now % tiles)

    return d.mapInArrow(run, "a long, b long, entity string, df long, tf long, score double")


def _met(rows: pa.Table, same: bool):
    """Batches of the pairs (a, b, entity, df, tf, score) between the mentions of two tiles, or within those of the same."""
    column = lambda c: rows.column(c).to_numpy()
    ids, doc, no, tf, score = (column(c) for c in ("id", "doc", "no", "tf", "score"))
    right = column("right")
    x, y = np.flatnonzero(~right), np.flatnonzero(~right if same else right)
    x, y = x[np.argsort(ids[x], kind="stable")], y[np.argsort(no[y], kind="stable")]
    others, place = np.unique(ids[y], return_inverse=True)
    first = np.searchsorted(no[y], no[x])
    n = np.searchsorted(no[y], no[x], side="right") - first
    new = np.diff(ids[x], prepend=ids[x][:1] - 1) != 0
    starts = np.flatnonzero(new)  # chunks of the left side
    before = np.append(np.cumsum(n) - n, n.sum())[np.append(starts, len(x))]
    cuts = starts[np.flatnonzero(np.diff(before[:-1] // MET, prepend=-1))] if len(starts) else starts
    chunk = np.cumsum(new)
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(x)]):
        m = n[lo:hi]
        u = np.repeat(np.arange(lo, hi), m)
        v = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m - first[lo:hi], m)
        i, j = x[u], y[v]
        fit = doc[i] != doc[j]
        if same:
            fit &= ids[i] < ids[j]
        i, j, pair = i[fit], j[fit], (((chunk[u] - chunk[lo]) * len(others) + place[v]) << 32)[fit]
        if not len(i):
            continue
        pair = np.sort(pair + np.arange(len(i)))
        order = pair & 0xFFFFFFFF
        i, j, pair = i[order], j[order], pair >> 32
        group = np.flatnonzero(np.diff(pair, prepend=-1))
        count = np.diff(np.append(group, len(i)))
        less = np.where(tf[i] <= tf[j], i, j)  # the mention whose score is the pair's
        # highest score, then first name
        best = score[less] == np.repeat(np.maximum.reduceat(score[less], group), count)
        name = np.where(best, no[i], np.iinfo(np.int64).max)
        best &= name == np.repeat(np.minimum.reduceat(name, group), count)
        take = np.flatnonzero(best)
        take = take[np.diff(pair[take], prepend=-1) != 0]
        i, j, less = ids[i[take]], ids[j[take]], less[take]
        for k in range(0, len(take), LEAVING):
            a, b, own = i[k : k + LEAVING], j[k : k + LEAVING], less[k : k + LEAVING]
            entity = rows.column("entity").take(pa.array(own)).combine_chunks()
            columns = [np.minimum(a, b), np.maximum(a, b), entity, column("df")[own], tf[own], score[own]]
            yield pa.RecordBatch.from_arrays([c if c is entity else pa.array(c) for c in columns], names=["a", "b", "entity", "df", "tf", "score"])


def entity_pairs(chunks: DataFrame, cross: bool, fraction: float, least: int = 2, distance: int = 5) -> DataFrame:
    """(a, b, entity, df, tf, score): chunk pairs with their best shared entity, across or within documents.

    Candidate entities are cut by df and tf first; `fraction` of the documents bounds the rows of an entity. The best of a pair is the highest idf * min tf, then entity name."""
    return paired_mentions(pair_mentions(chunks, cross, fraction, least), cross, distance)


def diverse_entity_pairs(chunks: DataFrame, fraction: float, order: list, limit: int, least: int = 2) -> DataFrame:
    """What `diverse` takes of entity_pairs across documents, by score and then `order`, without making all the pairs.

    No pair scores above the lesser weight (idf * tf) of its mentions, so pairs of a score of at least `floor` come from
    mentions of at least that weight, and they come first. The floor is what the best pair of the limit-th entity would
    score; where the choice stays short of `limit`, it is lowered to four times as many entities, in the end to all."""
    m = written(pair_mentions(chunks, True, fraction, least), "mentions")
    weight = F.round(F.col("idf") * F.col("tf"), 6)
    by_doc = m.groupBy("entity", "doc").agg(F.max(weight).alias("weight"))
    second = by_doc.withColumn("n", F.row_number().over(W.partitionBy("entity").orderBy(F.desc("weight")))).where("n = 2")
    best, k = written(second.select("weight"), "best"), limit
    while True:
        edge = best.orderBy(F.desc("weight")).limit(k).agg(F.count("*").alias("n"), F.min("weight").alias("floor")).first()
        whole = edge["n"] < k
        fit = m if whole else m.where((weight >= edge["floor"]) | (F.col("idf") <= 0))
        pairs = paired_mentions(fit, True)
        pairs = (pairs if whole else pairs.where(F.col("score") >= edge["floor"])).withColumn("pair", F.concat_ws("|", F.col("a").cast("string"), F.col("b").cast("string")))
        taken = written(diverse(pairs, "entity", "pair", [(-F.col("score")).alias("s"), *order], limit), "chosen")
        if whole or taken.count() >= limit:
            return taken
        k *= 4


def diverse(pairs: DataFrame, left: str, right: str, order: list, limit: int) -> DataFrame:
    """The rows that a sequential choice in the given order takes, each value of left and right once, `limit` at most.

    Rounds of local maxima: a row that comes first among the rows left both for its left and for its right value is
    one that the sequential choice takes, whatever the other rows; it is taken, and rows sharing a value with it
    go. Minima are pre-aggregated, so a hot value is no bottleneck, and joins are on keys that are unique on one side. Once `limit`
    rows are taken, rows after the limit-th of them in order cannot be among the first and go too. `order` holds
    columns that together set rows apart; rows equal in them and both values count once. Rows with a null value go."""
    first = F.struct(*order, F.col(left), F.col(right)).alias("__o")
    now = written(pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select("*", first).dropDuplicates(["__o"]), "pairs")
    taken = None
    while True:
        best = now.groupBy(left).agg(F.min("__o").alias("__o")).join(now.groupBy(right).agg(F.min("__o").alias("__o")), "__o")
        picks = now.join(best.select("__o"), "__o", "left_semi").select(*now.columns)
        taken = written(picks if taken is None else taken.unionByName(picks), "taken")
        rest = now.join(taken.select(left), left, "left_anti").join(taken.select(right), right, "left_anti").select(*now.columns)
        last = taken.select("__o").orderBy("__o").limit(limit).agg(F.count("*").alias("n"), F.max("__o").alias("o"))
        if last.first()["n"] >= limit:
            rest = rest.join(last.select(F.col("o").alias("__last")), F.col("__o") < F.col("__last")).select(*now.columns)
        now = written(rest, "pairs")
        if not now.head(1):
            return taken.orderBy("__o").limit(limit).drop("__o")


def aggregation_questions(chunks: DataFrame, limit: int, low: int = 3, high: int = 10) -> DataFrame:
    """(pos, entity, form, df, answer): entities in low..high documents, said twice somewhere, most mentions first."""
    found = mentions(chunks)
    e = found.groupBy("entity").agg(F.count_distinct("doc").alias("df"), F.sum("tf").alias("total"), F.max("tf").alias("peak"), F.sort_array(F.collect_set("doc")).alias("docs"))
    e = e.where(F.col("df").between(low, high) & (F.col("peak") >= 2)).orderBy(F.desc("total"), fnv1a(F.col("entity")), "entity").limit(limit)
    e = e.withColumn("pos", F.row_number().over(W.orderBy(F.desc("total"), fnv1a(F.col("entity")), "entity")) - 1)  # `limit` rows
    form = F.when(F.col("pos") % 2 == 0, "count").otherwise("list")
    answer = F.when(F.col("pos") % 2 == 0, F.col("df").cast("string")).otherwise(F.array_join(F.transform("docs", lambda d: d.cast("string")), "; "))
    return e.select("pos", "entity", form.alias("form"), "df", "total", answer.alias("answer"))


def stratified(rows: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """n rows of every stratum in the order of the key's md5."""
    w = W.partitionBy(by).orderBy(F.md5(F.col(key).cast("string")), key)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def families(items: DataFrame) -> DataFrame:
    """items (id, parent) with the root of their family."""
    return items.withColumn("root", F.coalesce("parent", "id"))


def split_problems(items: DataFrame) -> DataFrame:
    """(id, problem) of a split (id, parent, split): in both splits, apart from its family, or without parent."""
    both = items.groupBy("id").agg(F.count_distinct("split").alias("n")).where("n > 1").select("id", F.lit("in both splits").alias("problem"))
    p = items.select(F.col("id").alias("parent"), F.col("split").alias("parent_split")).distinct()
    j = items.where("parent is not null").join(p, "parent", "left")
    apart = j.where("parent_split <> split").select("id", F.lit("family apart").alias("problem"))
    orphan = j.where("parent_split is null").select("id", F.lit("orphan").alias("problem"))
    return both.unionByName(apart).unionByName(orphan).distinct()


def corpus_idf(docs: DataFrame) -> DataFrame:
    return idf(docs)
