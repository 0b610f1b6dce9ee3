"""Embedding near-duplicates: int8 tile products with error bounds, full precision where they leave doubt.

Each distinct vector is scaled to length one, u = s * q + e with int8 codes q. For two vectors
|cos - s1*s2*(q1.q2)| <= |e1| + |s1*q1| * |e2|, as |u| = 1; the code product is exact in float32 up to
MAX_DIM components. Pairs whose upper bound is below the threshold are left out, pairs whose lower
bound is above it are links, and the rest are recomputed in double precision from the original components.
Copies of one vector meet once. A pair of tiles returns per vector its number of links and one edge to
its local component, never its pairs.

Defined results: a vector that is null, empty, zero or holds null or non-finite components links with
nothing (n_links 0, its own component); vectors of different length do not link; a repeated row, or a repeated
vec_id, is another vector, linked to its copies; component_id is the smallest non-null vec_id; an empty table
gives an empty result; labels and other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, materialise, per_pair, star_edges, tile_pairs

NAME = "op3_embedding_dedup"
THRESHOLD = 0.9
TILE, SUB = 8192, 1024
SLACK = 1e-5  # over the float32 rounding of scaled products
MAX_DIM = (1 << 24) // (127 * 127)


def quantise(x: np.ndarray):
    """Codes (as float32), scale, |s*q| and |e| of each row of x, which are finite and not zero."""
    u = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    u /= np.sqrt(np.einsum("ij,ij->i", u, u))[:, None]
    scale = np.abs(u).max(1) / 127
    codes = np.rint(u / scale[:, None]).astype(np.int8)
    near = codes * scale[:, None]
    size, error = np.sqrt(np.einsum("ij,ij->i", near, near)), np.sqrt(np.einsum("ij,ij->i", u - near, u - near))
    return codes, scale, size, error


def links(x: np.ndarray, y: np.ndarray, same: bool, threshold: float):
    """Index pairs of rows of x and y with cosine >= threshold (first index smaller where x is y)."""
    cx, sx, nx, ex = quantise(x)
    cy, sy, ny, ey = (cx, sx, nx, ex) if same else quantise(y)
    width = x.shape[1]
    kind = np.float32 if width <= MAX_DIM else np.float64
    fy, s32, e32 = cy.astype(kind), sy.astype(np.float32), ey.astype(np.float32)
    # largest component 1, a power of two taken out exactly, so that squares neither overflow nor vanish
    x, y = (np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1]) for v in (x, y))
    length_x, length_y = (np.sqrt(np.einsum("ij,ij->i", v, v)) for v in (x, y))
    found_a, found_b = [], []
    for i in range(0, len(x), SUB):
        fx = cx[i : i + SUB].astype(kind)
        for j in range(i if same else 0, len(y), SUB):
            near = (fx @ fy[j : j + SUB].T).astype(np.float32) * s32[j : j + SUB]
            near *= sx[i : i + SUB, None].astype(np.float32)
            doubt = ex[i : i + SUB, None].astype(np.float32) + nx[i : i + SUB, None].astype(np.float32) * e32[j : j + SUB] + np.float32(SLACK)
            a, b = np.nonzero(near + doubt >= threshold)
            if not len(a):
                continue
            sure = near[a, b] - doubt[a, b] >= threshold
            a, b = a + i, b + j
            keep = a < b if same else np.ones(len(a), bool)
            a, b, sure = a[keep], b[keep], sure[keep]
            unsure = np.flatnonzero(~sure)
            for k in range(0, len(unsure), 1 << 16):
                at = unsure[k : k + (1 << 16)]
                p, q = a[at], b[at]
                sure[at] = np.einsum("ij,ij->i", x[p], y[q]) / (length_x[p] * length_y[q]) >= threshold
            found_a.append(a[sure])
            found_b.append(b[sure])
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_a), np.concatenate(found_b)


def embedding_links(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors (vec_id, embedding)."""
    e = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.coalesce(F.forall(e, lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e"), fine.alias("fine"))
    # a vector is known by 128 bits of hash of its components; -0.0 counts as 0.0
    rows = rows.withColumn("e", F.transform("e", lambda v: v + F.lit(0.0)))
    rows = materialise(rows.withColumn("h1", F.xxhash64("e")).withColumn("h2", F.xxhash64(F.lit(7), F.reverse("e"))), "vectors")
    good = rows.where("fine")
    nodes = good.groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"), F.first("e").alias("e"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # written once, so ids stay
    n = nodes.count()
    tiles = max(1, -(-n // TILE))

    def compare(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        out = []
        dims = left["e"].map(len)
        for width in dims.unique():
            lo = left[dims == width]
            hi = lo if same else right[right["e"].map(len) == width]
            if not len(hi):
                continue
            x = np.stack(lo["e"].to_numpy()).astype(np.float64)
            y = x if same else np.stack(hi["e"].to_numpy()).astype(np.float64)
            a, b = links(x, y, same, threshold)
            if not same:
                b = b + len(x)
            node = lo["node"].to_numpy() if same else np.concatenate((lo["node"], hi["node"]))
            copies = lo["copies"].to_numpy() if same else np.concatenate((lo["copies"], hi["copies"]))
            linked = np.bincount(a, copies[b], len(node)) + np.bincount(b, copies[a], len(node))
            u, v = star_edges(node, a, b)
            root = dict(zip(u.tolist(), v.tolist()))
            at = np.flatnonzero(linked)
            out.append(pd.DataFrame({"node": node[at], "linked": linked[at].astype(np.int64), "root": [root.get(k, k) for k in node[at].tolist()]}))
        return pd.concat(out, ignore_index=True) if out else None

    pairs = tile_pairs(nodes.select(F.lit(0).alias("c"), "node", "copies", "e"), "c", F.xxhash64("node"), {0: (0, tiles, 0, tiles - 1)}).drop("c")
    got = materialise(per_pair(pairs, compare, "node long, linked long, root long", n * tiles, group_rows=2 * TILE), "links")
    roots = components(got.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = got.groupBy("node").agg(F.sum("linked").alias("linked"))
    known = nodes.select("h1", "h2", "copies", "first", "node").join(roots, "node", "left").join(counts, "node", "left")
    known = known.withColumn("root", F.coalesce("root", "node"))
    ends = known.groupBy("root").agg(F.min("first").alias("component"))
    known = known.join(ends, "root").select("h1", "h2", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n"), "component")
    linked = rows.where("fine").drop("e", "fine").join(known, ["h1", "h2"])
    alone = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.select("vec_id", F.col("n").cast("long").alias("n_links"), F.col("component").alias("component_id")).unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
"""
