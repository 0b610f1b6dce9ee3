"""SimHash near-duplicates by tiled exact comparison of 64-bit fingerprints.

Fingerprints: ASCII lower case, words, 4-word shingles (repeats included; fewer words: the whole sequence;
none: fingerprint zero), XXH64 with seed 42 of each; a bit is 1 if it is set in over half of the hashes.
Distinct fingerprints are cut by population count into bands as wide as the radius plus one and, where a band
is large, into salted tiles; only tiles of the same or the next band meet. Inside a pair of tiles numpy
compares sorted sub-tiles with exclusive-or and bit counts and skips those whose population counts differ by
more than the radius. A pair of tiles returns at most one edge per fingerprint (its local components), so a
large group of near copies never becomes a list of all its pairs. Exact copies meet once, as one fingerprint.

Defined results: null and empty texts have fingerprint zero and link like any other; repeated rows each get
a row; a null doc_id counts in no minimum, a component of null ids only has a null component_id; an empty
table gives an empty result; other columns are ignored (or kept by keep_one), whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, materialise, per_pair, star_edges, tile_pairs

NAME = "op4_simhash_dedup"
RADIUS, SHINGLE, SEED = 4, 4, 42
TILE = 65_536  # fingerprints in a tile that is shuffled: 0.5 MB
SUB = (64, 4096)  # fingerprints compared at once
HASHES = 1 << 16  # hashes whose bits are counted at once


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(SHINGLE, len(words))
    h = xxhash.xxh64_intdigest
    bits = np.zeros(64, np.int64)
    total = len(words) - k + 1
    a, b = starts.tolist(), ends[k - 1 :].tolist()
    for at in range(0, total, HASHES):
        got = np.array([h(joined[x:y], SEED) for x, y in zip(a[at : at + HASHES], b[at : at + HASHES])], dtype="<u8")
        bits += np.unpackbits(got.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, h, fp) per row: h is a hash of the text, fp the fingerprint as a signed long."""

    def run(frames):
        for pdf in frames:
            fp = np.array([fingerprint(t) for t in pdf["text"]], dtype=np.uint64).view(np.int64)
            yield pdf[["doc_id", "h"]].assign(fp=fp)

    d = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text")
    return d.mapInPandas(run, "doc_id long, h long, fp long")


def close_pairs(left: np.ndarray, right: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two arrays of uint64 (sorted by population count) with at most `radius` differing bits."""
    pl, pr = np.bitwise_count(left), np.bitwise_count(right)
    found_a, found_b = [], []
    for i in range(0, len(left), SUB[0]):
        block = left[i : i + SUB[0], None]
        low, high = int(pl[i]) - radius, int(pl[min(i + SUB[0], len(left)) - 1]) + radius
        first, last = np.searchsorted(pr, low), np.searchsorted(pr, high, side="right")
        for j in range(max(first, i) if same else first, last, SUB[1]):
            near = np.bitwise_count(block ^ right[None, j : min(j + SUB[1], last)]) <= radius
            if near.any():
                a, b = np.nonzero(near)
                found_a.append(a + i)
                found_b.append(b + j)
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    return (a[a < b], b[a < b]) if same else (a, b)


def fingerprint_components(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(node, root) for every distinct fingerprint (column fp) that has another within the radius."""
    width = radius + 1
    banded = distinct.select("fp", F.floor(F.bit_count("fp") / width).alias("band"))
    sizes = dict(banded.groupBy("band").count().collect())  # 64 / width + 1 rows at most
    first, layout = 0, {}
    tiles = {b: -(-n // TILE) for b, n in sorted(sizes.items())}
    at = {}
    for b, n in tiles.items():
        at[b] = first
        first += n
    for b, n in tiles.items():
        layout[b] = (at[b], n, at.get(b - 1, at[b]), at[b + 1] + tiles[b + 1] - 1 if b + 1 in tiles else at[b] + n - 1)

    def compare(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        def ordered(side):
            x = side["fp"].to_numpy().view(np.uint64)
            return x[np.lexsort((x, np.bitwise_count(x)))]

        x = ordered(left)
        y = x if same else ordered(right)
        a, b = close_pairs(x, y, same, radius)
        nodes = x if same else np.concatenate((x, y))
        u, v = star_edges(nodes, a, b if same else b + len(x))
        return pd.DataFrame({"a": u.view(np.int64), "b": v.view(np.int64)})

    sent = sum(n * (layout[b][3] - layout[b][2] + 1) for b, n in sizes.items())
    pairs = tile_pairs(banded, "band", F.xxhash64("fp"), layout).select("fp", "tile", "i", "j")
    return components(per_pair(pairs, compare, "a long, b long", sent))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, h, fp, component_id, keeper) per row of docs (doc_id, text).

    keeper (doc_id, h) names the row of each component that stays: the smallest doc_id, nulls first.
    The final join is on the fingerprint; a fingerprint with many copies is split by adaptive skew handling."""
    fps = materialise(fingerprints(docs), "fingerprints")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "h")).alias("who")), "distinct")
    roots = fingerprint_components(distinct, radius)
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp"))
    ends = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.min("who").alias("keeper"))
    table = rooted.select("fp", "root").join(ends, "root").drop("root")
    return fps.join(table, "fp").select("doc_id", "h", "fp", "component_id", "keeper")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The one document of each component that stays, with all columns; rows of one doc_id and text count once.

    Of those the one stays whose other columns, written as JSON, come first."""
    found = near_duplicates(docs, radius)
    keep = found.select(F.col("keeper.doc_id").alias("k_id"), F.col("keeper.h").alias("k_h")).distinct()
    d = docs.withColumn("__h", F.xxhash64("text"))
    kept = d.join(keep, d["doc_id"].cast("long").eqNullSafe(keep["k_id"]) & (d["__h"] == keep["k_h"]), "left_semi")
    others = F.to_json(F.struct(*[F.col(c) for c in docs.columns if c not in ("text", "doc_id")]), {"ignoreNullFields": "false"})
    row = F.struct(*[F.col(c) for c in docs.columns])
    return kept.groupBy("doc_id", "__h").agg(F.min_by(row, others).alias("__row")).select("__row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
