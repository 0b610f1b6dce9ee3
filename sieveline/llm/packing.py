"""Best-fit packing by exact complements over counts of lengths.

Documents are encoded and cut into pieces of at most `size` tokens. How pieces go together depends on their
lengths alone, so Spark counts the pieces of each length, and the plan is made from these at most `size` numbers.
The longest length left opens a sequence; its gap is looked up among single lengths, sums of pairs and sums of
triples that are still available; a combination that fills the gap exactly is consumed as often as counts allow.
Where none does, the best-fitting (longest possible) length goes in and the smaller gap is looked up again. The
plan is a list of patterns with their numbers, at most about size * ln(size) of them whatever the input: each
application leaves some length with fewer pieces than the pattern needs.

Pieces are numbered inside their length (running sums by length and task, so that a length with a third of all
pieces is spread), and a piece's number in its length says its pattern, sequence and place.

Defined results: null text is empty and has the end id alone; rows repeated with one doc_id are separate
documents; a null doc_id is kept; ties have no influence, as pieces of a length are interchangeable; texts are
encoded whole, however long; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import vocabulary
from .common import byte_chunks, materialise, prefix_offsets
from .phrases import Hasher, groups

NAME = "op12_packing"
SIZE, END = 4096, 1
REMEMBERED = 400_000  # pieces of text whose ids a worker remembers, twice
BATCH = 2 << 20  # bytes of text that are encoded together


class Complements:
    """Counts of available lengths, with an index of the sums that one, two or three of them make."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64)
        self.size = len(counts) - 1
        here = sum(1 << int(a) for a in np.flatnonzero(self.left))
        sums = 0
        for a in np.flatnonzero(self.left).tolist():
            sums |= here << a
        # sums of two lengths; lengths run out, so a set bit may be out of date and is cleared when found so
        self.two = np.array([sums >> s & 1 for s in range(self.size + 1)], dtype=bool)

    def pair(self, total: int, left: np.ndarray) -> tuple[int, int] | None:
        """Two lengths in `left` that make total, the longest possible first."""
        if total < 2:
            return None
        low = np.arange(1, total // 2 + 1)
        ok = (left[low] > 0) & (left[total - low] > 0)
        if total % 2 == 0:
            ok[-1] &= left[total // 2] > 1
        at = int(ok.argmax())
        return (total - at - 1, at + 1) if ok[at] else None

    def exact(self, gap: int, left: np.ndarray) -> list[int] | None:
        """One, two or three lengths in `left` that fill the gap exactly."""
        if left[gap]:
            return [gap]
        if self.two[gap]:
            found = self.pair(gap, left)
            if found:
                return [*found]
            self.two[gap] = self.pair(gap, self.left) is not None
        first = np.flatnonzero((left[1:gap] > 0) & self.two[gap - 1 : 0 : -1]) + 1
        for a in first[::-1].tolist():
            left[a] -= 1
            found = self.pair(gap - a, left)
            left[a] += 1
            if found:
                return [a, *found]
            self.two[gap - a] = self.pair(gap - a, self.left) is not None
        return None

    def pattern(self, first: int) -> list[int]:
        """Lengths of one sequence that opens with `first`."""
        left = self.left.copy()
        out, gap = [first], self.size - first
        left[first] -= 1
        while gap:
            more = self.exact(gap, left)
            if more is None:
                fits = np.flatnonzero(left[1 : gap + 1])
                if not len(fits):
                    break
                more = [int(fits[-1]) + 1]
            for x in more:
                left[x] -= 1
                gap -= x
            out += more
        return out


def plan(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, how many such sequences) that use up counts[length] pieces of every length."""
    index, out = Complements(counts), []
    for first in range(index.size, 0, -1):
        while index.left[first]:
            made = index.pattern(first)
            lengths, uses = np.unique(made, return_counts=True)
            times = int((index.left[lengths] // uses).min())
            index.left[lengths] -= times * uses
            out.append((made, times))
    return out


def ranges(patterns: list[tuple[list[int], int]]) -> np.ndarray:
    """(length, first number, pieces a sequence, first sequence, first offset) by length and number.

    A piece with number r in its length belongs to the last row of that length whose first number is at most r."""
    taken: dict[int, int] = {}
    sequence, out = 0, []
    for made, times in patterns:
        offset = 0
        for length, uses in zip(*np.unique(made, return_counts=True)):
            at = taken.get(int(length), 0)
            out.append((length, at, uses, sequence, offset))
            taken[int(length)] = at + int(uses) * times
            offset += int(length * uses)
        sequence += times
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 5)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ALNUM = np.array([chr(b).isascii() and chr(b).isalnum() for b in range(256)])
_MARK = np.zeros(256, dtype=bool)
_MARK[[*b".,;:!?"]] = True


def units(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the units of a buffer that begins and ends in white space: pieces between white space, which is in no
    token, cut where an ASCII letter or digit is followed by a mark, with which a token always begins."""
    space = _SPACE[buf]
    seam = np.zeros(len(buf), dtype=bool)  # a unit may begin here
    seam[1:] = space[:-1] | _ALNUM[buf[:-1]] & _MARK[buf[1:]]
    start = np.flatnonzero(seam & ~space)
    seam[1:] |= space[1:]
    end = np.flatnonzero(seam[1:] & ~space[:-1]) + 1
    return start, end


def distinct(buf: np.ndarray, start: np.ndarray, end: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one unit of each kind, kind of each unit); units of one hash are compared byte by byte."""
    size = end - start
    order, first, count = groups(ids, [ids, size])
    kind = np.empty(len(start), dtype=np.int64)
    kind[order] = np.repeat(np.arange(len(first)), count)
    one = order[first]
    at = np.flatnonzero(~_SPACE[buf])
    if (buf[at] == buf[at + np.repeat(start[one[kind]] - start, size)]).all():
        return one, kind
    found: dict = {}
    kind = np.array([found.setdefault(buf[a:b].tobytes(), (len(found), k))[0] for k, (a, b) in enumerate(zip(start.tolist(), end.tolist()))])
    return np.array([k for _, k in found.values()]), kind


class Encoder:
    """Ids of whole texts by the library; each distinct unit is encoded once while it is remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.hasher = Hasher(0)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        raw = b"\n" + b"\n".join(texts) + b"\n"
        buf = np.frombuffer(raw, dtype=np.uint8)
        start, end = units(buf)
        if not len(start):
            return [b""] * len(texts)
        one, kind = distinct(buf, start, end, self.hasher.ids(buf, start, end))
        coded = self.lookup([raw[a:b] for a, b in zip(start[one].tolist(), end[one].tolist())])
        flat = np.frombuffer(b"".join(coded), dtype="<u4")
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        source = (np.cumsum(size) - size)[kind]  # of each unit's ids in flat
        size = size[kind]
        upto = np.concatenate(([0], np.cumsum(size)))
        ids = flat[np.repeat(source - upto[:-1], size) + np.arange(upto[-1])]
        stops = np.cumsum([len(t) + 1 for t in texts]) + 1
        cuts = upto[np.searchsorted(start, np.concatenate(([0], stops)))].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]

    def lookup(self, pieces: list[bytes]) -> list[bytes]:
        known, older = self.known, self.older
        unseen = [p for p in pieces if p not in known and p not in older]
        coded = self.library.encode_batch_fast([p.decode("utf-8", "replace") for p in unseen], add_special_tokens=False)
        known.update([(p, array("I", e.ids).tobytes()) for p, e in zip(unseen, coded)])
        out = [known[p] if p in known else older[p] for p in pieces]
        if len(known) > REMEMBERED:  # stays for a while as the older half
            self.older, self.known = {p: v for p, v in known.items() if len(p) <= 64} | {p: v for p, v in zip(pieces, out) if len(p) <= 64}, {}
        return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


PIECES = "at long, doc_id string, piece int, start long, length long, ids_crc32 long, ids binary"


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """Pieces of every document: ids (little-endian unsigned 32-bit) with their checksum; `at` is a key of the row."""

    def run(frames):
        coder, at = _encoder(path), TaskContext.get().partitionId() << 33
        last = np.array([end], dtype="<u4").tobytes()
        for pdf in frames:
            for lo, hi, texts in byte_chunks(pdf, "text", BATCH):
                out = []
                for doc, ids in zip(pdf["doc_id"].iloc[lo:hi], coder.encode(texts)):
                    ids += last
                    for k in range(-(-len(ids) // (4 * size))):
                        part = ids[4 * size * k : 4 * size * (k + 1)]
                        out.append((at, doc if isinstance(doc, str) else None, k, size * k, len(part) // 4, zlib.crc32(part), part))
                        at += 1
                yield pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")]).astype({"doc_id": object})

    kind = docs.schema["doc_id"].dataType
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, PIECES).withColumn("doc_id", F.col("doc_id").cast(kind))


def placed(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """`cut` (a written table with at and length, and any other columns but ids) with sequence_id and offset."""
    counts = np.zeros(size + 1, dtype=np.int64)
    for r in cut.groupBy("length").count().collect():  # at most `size` rows
        counts[r["length"]] = r["count"]
    table = ranges(plan(counts))
    shared = cut.sparkSession.sparkContext.broadcast(table)  # at most some size * ln(size) patterns
    numbered = prefix_offsets(cut.withColumn("__one", F.lit(1)), ["length"], ["at"], F.shiftright("at", 33), "__one", "__number").drop("__one")
    names = [c for c in numbered.columns if c != "__number"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema if f.name != "__number")

    def run(frames):
        t = shared.value
        keys = (t[:, 0] << 50) + t[:, 1]
        for pdf in frames:
            length, number = pdf["length"].to_numpy(), pdf["__number"].to_numpy()
            r = t[np.searchsorted(keys, (length << 50) + number, side="right") - 1]
            n = number - r[:, 1]
            yield pdf[names].assign(sequence_id=r[:, 3] + n // r[:, 2], offset=r[:, 4] + n % r[:, 2] * length)

    return numbered.mapInPandas(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> tuple[DataFrame, DataFrame]:
    """(pieces with ids, the same without ids but with sequence_id and offset); both have the key `at`."""
    cut = materialise(pieces(docs, path, size, end), "pieces")
    return cut, placed(cut.drop("ids"), size)


def sequences(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """sequence_id, length, ids of every packed sequence, and its documents as an array of (doc_id, piece, offset, length)."""
    cut, places = pack(docs, path, size, end)
    d = cut.join(places.select("at", "sequence_id", "offset"), "at")
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids")))
    d = d.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("p"))
    whole = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return d.select("sequence_id", "length", whole.alias("ids"), F.transform("p", lambda x: F.struct(x["doc_id"], x["piece"], x["offset"], x["length"])).alias("documents"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, places = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
    return places.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
