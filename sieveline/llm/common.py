"""Shared pieces: materialised tables, tile pairs, components and word hashing."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="sieveline-")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: spark.checkpoint.dir, or a temporary one of this process where it is unset in local mode (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = _local_dir()
    return at.rstrip("/")


def materialise(df: DataFrame, tag: str, group: int | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, which cuts its lineage.

    Later stages read files that survive lost executors, see exact sizes and prune columns. group: bytes of a row group."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    (df.write.option("parquet.block.size", group) if group else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of rows that a task hands to Python at once where rows are texts or packed blocks.
HANDED = 1 << 19


@contextmanager
def small_batches(spark: SparkSession, size: int = HANDED):
    """Rows go to Python in Arrow batches of about `size` bytes while plans run in here.

    By default a batch is 10,000 rows, which is a task's whole share of the texts, held by the JVM and by Python at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def doc_fold(column: Column, n: int) -> Column:
    """crc32 of the id as text modulo n; null for a null id."""
    return F.crc32(column.cast("string").cast("binary")) % n


def words_of(text: Column) -> Column:
    """Array of the words of a text; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def prefix_offsets(df: DataFrame, group: list[str], order: list[str], chunk: Column, value: str, out: str) -> DataFrame:
    """Exclusive running sum of `value` inside each group, without one task per group.

    Rows of a group are ordered by (chunk, order). Each (group, chunk) is summed by its own window, then
    the few chunk totals of a group are summed, so a group with a third of all rows is spread over its chunks."""
    from pyspark.sql import Window as W

    d = df.withColumn("__chunk", chunk)
    keys = [F.coalesce(F.col(g).cast("string"), F.lit("\u0000")).alias(f"__g{i}") for i, g in enumerate(group)]
    d = d.select("*", *keys)
    names = [f"__g{i}" for i in range(len(group))]
    inner = W.partitionBy(*names, "__chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = d.withColumn("__local", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    outer = W.partitionBy(*names).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    totals = d.groupBy(*names, "__chunk").agg(F.sum(value).alias("__sum"))
    totals = totals.withColumn("__base", F.coalesce(F.sum("__sum").over(outer), F.lit(0))).drop("__sum")
    return local.join(totals, [*names, "__chunk"]).withColumn(out, F.col("__local") + F.col("__base")).drop(*names, "__chunk", "__local", "__base")


# --- tiles -------------------------------------------------------------------


def tile_pairs(df: DataFrame, cls: str, salt: Column, layout: dict[int, tuple[int, int, int, int]]) -> DataFrame:
    """Send every row to all tile pairs that its tile belongs to.

    layout: class -> (first tile, tiles, lowest partner tile, highest partner tile); its size is bounded by
    the number of classes. A class with many rows has many tiles, rows are salted over them. Adds
    `tile`, and `i` <= `j`, the pair; a row in tile t meets every row of its partners in exactly one pair."""
    spark = df.sparkSession
    table = spark.createDataFrame([(int(c), *map(int, v)) for c, v in layout.items()], "__c long, __first long, __n long, __lo long, __hi long")
    d = df.join(F.broadcast(table), df[cls].cast("long") == table["__c"])
    d = d.withColumn("tile", F.col("__first") + F.pmod(salt, F.col("__n")))
    d = d.withColumn("__p", F.explode(F.sequence("__lo", "__hi")))
    return d.withColumn("i", F.least("tile", "__p")).withColumn("j", F.greatest("tile", "__p")).drop("__c", "__first", "__n", "__lo", "__hi", "__p")


def per_pair(df: DataFrame, fn, schema: str, rows: int, group_rows: int = 200_000) -> DataFrame:
    """Apply fn(left, right, same) to the two sides of every tile pair; left is right on the diagonal.

    Pairs are packed by hash into groups of about group_rows rows, so a group is bounded by tile sizes."""
    import pandas as pd

    spark = df.sparkSession
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // group_rows))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (i, j), part in pdf.groupby(["i", "j"], sort=True):
            tile = part["tile"].to_numpy()
            left = part[tile == i].reset_index(drop=True)
            right = left if i == j else part[tile == j].reset_index(drop=True)
            if len(left) and len(right):
                got = fn(left, right, i == j)
                if got is not None and len(got):
                    out.append(got)
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

    keyed = df.withColumn("__g", F.pmod(F.xxhash64("i", "j"), F.lit(groups)))
    return keyed.groupBy("__g").applyInPandas(run, schema)


def slim_pairs(df: DataFrame) -> DataFrame:
    """tile, i and j of tile_pairs as one long `pair`: i, j and the row's side; for rows that are many and small."""
    side = (F.col("tile") != F.col("i")).cast("long")
    return df.withColumn("pair", F.shiftleft("i", 33) + F.shiftleft("j", 1) + side).drop("tile", "i", "j")


def per_slim_pair(df: DataFrame, fn, schema: str, rows: int, group_rows: int = 200_000, within: str | None = None) -> DataFrame:
    """per_pair for slim_pairs (of the same `within`): fn(i, left, right, same) gets dicts of arrays and returns arrays or None.

    For many small pairs: a group is sorted once and cut into slices, without a frame for each pair."""
    import pandas as pd

    spark = df.sparkSession
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // group_rows))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pair = pdf["pair"].to_numpy()
        first = pdf[within].to_numpy() if within else np.zeros(len(pair), np.int64)
        order = np.lexsort((pair, first))
        pair, first = pair[order], first[order]
        columns = {c: pdf[c].to_numpy()[order] for c in pdf.columns if c not in ("pair", "__g")}
        key = pair >> 1
        cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(first) != 0)) + 1
        out = []
        for a, b in zip(np.concatenate(([0], cuts)).tolist(), np.concatenate((cuts, [len(pair)])).tolist()):
            i, j = int(pair[a]) >> 33, int(pair[a]) >> 1 & 0xFFFFFFFF
            middle = b if i == j else a + int(np.searchsorted(pair[a:b] & 1, 1))
            if a == middle or i != j and middle == b or i == j and b - a < 2:
                continue
            left = {c: v[a:middle] for c, v in columns.items()}
            got = fn(i, left, left if i == j else {c: v[middle:b] for c, v in columns.items()}, i == j)
            if got is not None:
                out.append(got)
        parts = zip(*out) if out else [[] for _ in names]
        return pd.DataFrame({n: np.concatenate(p) if len(p) else np.zeros(0, np.int64) for n, p in zip(names, parts)})

    group = F.pmod(F.xxhash64(*([within] if within else []), F.shiftright("pair", 1)), F.lit(groups))
    return df.withColumn("__g", group).groupBy("__g").applyInPandas(run, schema)


# --- components --------------------------------------------------------------


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over edges a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def star_edges(nodes: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Edges (node, root) of the local components over index pairs a-b: no more than one per node."""
    label = local_components(len(nodes), a, b)
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of edges (a, b): root is the smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al. 2014). Each round is two grouped minima and
    joins, written to the shared folder; the driver sees only a row count and a checksum per round."""
    print_of = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first())
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc")
    seen = print_of(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        floor = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(floor, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(floor.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        now = materialise(small, "cc")
        got = print_of(now)
        if got == seen:
            break
        seen = got
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


# --- words -------------------------------------------------------------------

_RNG = np.random.RandomState(20240229)
_BYTE = _RNG.randint(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_M), -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 18)
        for k, base in (("up", _M), ("down", _INVERSE)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


class Words:
    """Words of a list of byte strings: buffer, start and end of each word, words per text, 64-bit word hashes."""

    def __init__(self, texts: list[bytes]):
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        space = (self.buf == 32) | ((self.buf >= 9) & (self.buf <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        stops = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        upto = np.searchsorted(self.start, stops)
        self.first = np.concatenate(([0], upto[:-1])).astype(np.int64)
        self.counts = upto - self.first

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: prefix sums of byte values times powers, so that its place does not count."""
        up, down = _powers(len(self.buf) + 1)
        run = np.empty(len(self.buf) + 1, dtype=np.uint64)
        run[0] = 0
        np.cumsum(_BYTE[self.buf] * up[: len(self.buf)], out=run[1:])
        return mix64((run[self.end] - run[self.start]) * down[self.start])


def byte_chunks(pdf, text: str, limit: int = 1 << 22):
    """Slices (from, to, list of UTF-8 texts) of a pandas frame with about `limit` bytes each; null is empty."""
    at, held, size = 0, [], 0
    for k, t in enumerate(pdf[text].to_numpy()):
        b = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        held.append(b)
        size += len(b)
        if size >= limit:
            yield at, k + 1, held
            at, held, size = k + 1, [], 0
    if held:
        yield at, at + len(held), held
