"""Token ids as directly addressable codes (after Brisaboa, Ladra and Navarro 2013).

An id is cut into chunks of WIDTH bits, lowest first. Level 0 holds the first chunk of every id, level k + 1 the
next chunk of the ids that go on; a bitmap per level marks those, and a rank directory holds the number
of marks before every 512 bits. So id i is read at place i of level 0, rank(i) of level 1 and so on, without
decoding what lies before it.

File format: Parquet with one row per segment of whole documents in ascending doc_id order: part and seq (its
place), doc_ids, first (offset of each document's ids in the segment, and the end), n_ids and payload, the bytes
of the code (header, then chunks, bitmap and ranks per level). Spark's writer commits files whole, so a lost
executor leaves none behind, and any store that Spark reads will do.

Defined results: null text is empty and has the end id only; null doc_ids come first; rows repeated
under one doc_id are separate documents side by side; an empty table gives no segment and an empty result;
other columns are ignored; a document is never cut, so its ids must fit one row.
"""

from __future__ import annotations

import os
import struct
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, prefix_offsets

NAME = "op9_token_codes"
WIDTH, RANK_BITS, MAGIC = 8, 512, b"DAC1"
END_ID = 2
SEGMENT = 1 << 20  # ids after which a segment is closed
SMALL = 1_000_000  # segments whose places are broadcast
CACHE = 1_000_000  # pieces of at most 64 characters whose ids a worker remembers
BATCH = 1 << 21  # characters of texts that are encoded at once
LINES = 256  # pieces that go to the library as one text
TWO = ("  ", "\n\n", " \n", "\n ")
SCHEMA = "part long, seq long, doc_ids array<long>, first array<long>, n_ids long, payload binary"


# --- the code ----------------------------------------------------------------


def pack(ids: np.ndarray) -> bytes:
    """The code of an array of ids below 2**32."""
    rest, levels = ids.astype(np.uint32), []
    while True:
        chunk = (rest & ((1 << WIDTH) - 1)).astype(np.uint8)
        more = rest >> WIDTH
        goes_on = more > 0
        bitmap = np.packbits(goes_on, bitorder="little").tobytes()
        padded = np.zeros(-(-max(len(rest), 1) // RANK_BITS) * RANK_BITS, dtype=bool)
        padded[: len(rest)] = goes_on
        counts = padded.reshape(-1, RANK_BITS).sum(1)
        ranks = (np.cumsum(counts) - counts).astype("<u4").tobytes()
        levels.append((len(rest), chunk.tobytes(), bitmap, ranks))
        if not goes_on.any():
            break
        rest = more[goes_on]
    head = MAGIC + struct.pack("<BB", WIDTH, len(levels)) + b"".join(struct.pack("<QQQ", n, len(b), len(r)) for n, _, b, r in levels)
    return head + b"".join(c + b + r for _, c, b, r in levels)


class Codes:
    """Reader of a code: codes[i] and codes.slice(a, b), each without decoding what lies before."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a code of token ids")
        width, n_levels = struct.unpack_from("<BB", payload, 4)
        at = 6 + 24 * n_levels
        self.width, self.levels = width, []
        for k in range(n_levels):
            n, bits, ranks = struct.unpack_from("<QQQ", payload, 6 + 24 * k)
            chunk = np.frombuffer(payload, np.uint8, n, at)
            bitmap = np.frombuffer(payload, np.uint8, bits, at + n)
            rank = np.frombuffer(payload, "<u4", ranks // 4, at + n + bits)
            self.levels.append((chunk, bitmap, rank))
            at += n + bits + ranks
        self.n = len(self.levels[0][0])

    def __len__(self) -> int:
        return self.n

    def _rank(self, level: int, i: int) -> int:
        """Marks before place i of a level."""
        _, bitmap, rank = self.levels[level]
        start = i // RANK_BITS * (RANK_BITS // 8)
        whole = bitmap[start : i >> 3]
        tail = int(bitmap[i >> 3]) & ((1 << (i & 7)) - 1) if i & 7 else 0
        return int(rank[i // RANK_BITS]) + int(np.bitwise_count(whole).sum()) + tail.bit_count()

    def __getitem__(self, i: int) -> int:
        out = 0
        for k, (chunk, bitmap, _) in enumerate(self.levels):
            out |= int(chunk[i]) << (k * self.width)
            if not (bitmap[i >> 3] >> (i & 7)) & 1:
                return out
            i = self._rank(k, i)
        return out

    def slice(self, a: int, b: int) -> np.ndarray:
        """Ids a to b: on each level the marks of the stretch are one stretch of the next."""
        out = np.zeros(max(b - a, 0), dtype=np.uint32)
        where = np.arange(len(out))
        for k, (chunk, bitmap, _) in enumerate(self.levels):
            if b <= a:
                break
            out[where] |= chunk[a:b].astype(np.uint32) << np.uint32(k * self.width)
            marks = np.unpackbits(bitmap[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 :][: b - a].astype(bool)
            where = where[marks]
            if not len(where):
                break
            a = self._rank(k, a)
            b = a + len(where)
        return out


# --- encoding with the tokenizers library ------------------------------------


class Encoder:
    """Ids by the tokenizers library; each distinct piece is given to it once per worker.

    Texts are cut before single spaces and around single line ends, where the byte-level pattern always starts a
    new word; other texts go to the library whole. Pieces without white space go there as lines of longer texts,
    as the pattern keeps the line ends between them apart."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line_end = self._library(["\n"])[0]
        if len(self.line_end) != 1:
            raise ValueError("the vocabulary has no id of its own for a line end")
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # numbers of pieces, with the space before them
        self.flat, self.begin, self.size = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)  # their ids

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _lines(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces without white space but before them, one after the other, and the number of each piece's ids."""
        cuts = pa.array(np.append(np.arange(0, len(pieces), LINES), len(pieces)), pa.int32())
        coded = self._library(pc.binary_join(pa.ListArray.from_arrays(cuts, pieces.cast(pa.string())), "\n").to_pylist())
        ids = np.concatenate([x for c in coded for x in (c, self.line_end)] or [self.line_end[:0]])
        end = ids == self.line_end[0]
        return ids[~end], np.diff(np.flatnonzero(end) - np.arange(len(pieces)), prepend=0)

    def _numbers(self, pieces: pa.Array, plain: np.ndarray) -> np.ndarray:
        """The number of each of these distinct pieces in `begin` and `size`; new ones are encoded."""
        if len(self.known) > CACHE or len(self.flat) > 16 * CACHE:
            self._forget()
        keys = pieces.to_numpy(zero_copy_only=False)
        number = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = len(self.size) + np.arange(len(new))
            flat, begin, size = self._coded(pieces.take(pa.array(new)), plain[new])
            self.begin, self.size = np.concatenate((self.begin, begin + len(self.flat))), np.concatenate((self.size, size))
            self.flat = np.concatenate((self.flat, flat))
            self.known.update((p, k) for p, k in zip(keys[new].tolist(), number[new].tolist()) if len(p) <= 64)
        return number

    def _coded(self, pieces: pa.Array, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces, some after the other, where each piece's begin, and how many it has."""
        ids, n = self._lines(pieces.filter(pa.array(plain)))
        rest = self._library(pieces.filter(pa.array(~plain)).to_pylist())
        size = np.zeros(len(pieces), np.int64)
        size[plain], size[~plain] = n, [len(x) for x in rest]
        begin = np.zeros(len(pieces), np.int64)
        begin[plain], begin[~plain] = np.cumsum(n) - n, len(ids) + np.cumsum(size[~plain]) - size[~plain]
        return np.concatenate([ids, *rest]), begin, size

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        whole = np.array([t[:1] in " \n" or t[-1] in " \n" or any([x in t for x in TWO]) for t in texts], dtype=bool)
        lines = pc.replace_substring(pa.array([t for t, w in zip(texts, whole) if not w], pa.large_string()), "\n", " \n ")
        cut = pc.split_pattern(lines, " ")
        first, words = np.asarray(cut.offsets), cut.values.dictionary_encode()
        place, word = np.asarray(words.indices).astype(np.int64), words.dictionary
        plain = np.asarray(pc.utf8_is_printable(word))  # white space never is
        for t in self.added:
            plain = plain & ~np.asarray(pc.match_substring(word, t))
        ends = np.asarray(pc.equal(word, "\n"))
        # pieces that start a text or a line have no space before them
        end = ends[place]
        head = np.append(True, end[:-1])[: len(end)] | end
        head[first[:-1]] = True
        odd = ~plain[place] & ~end & (head | np.append(end[1:], False)[: len(end)])  # white space beside a line end
        held = np.flatnonzero(~whole)
        whole[held[np.add.reduceat(odd, first[:-1], dtype=np.int64) > 0] if len(held) else held] = True
        form = 2 * place + head
        used = np.flatnonzero(np.bincount(form, minlength=1))
        pieces = pc.binary_join_element_wise(pa.array(np.where(used & 1, "", " "), pa.large_string()), word.take(pa.array(used >> 1)), pa.scalar("", pa.large_string()))
        # each occurrence takes the ids of its piece
        number = np.zeros(2 * len(word), np.int64)
        number[used] = self._numbers(pieces, plain[used >> 1])
        at = number[form]
        n = self.size[at]
        upto = np.concatenate(([0], np.cumsum(n)))
        ids = self.flat[np.arange(upto[-1]) + np.repeat(self.begin[at] - upto[:-1], n)].tobytes()
        bounds = (4 * upto[first]).tolist()
        out: list = [None] * len(texts)
        for k, a, b in zip(held.tolist(), bounds, bounds[1:]):
            out[k] = ids[a:b]
        alone = np.flatnonzero(whole).tolist()
        for k, x in zip(alone, self._library([texts[k] for k in alone])):
            out[k] = x.tobytes()
        return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def segments(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Segments (SCHEMA) of the documents' ids in ascending doc_id order."""

    def run(frames):
        from pyspark import TaskContext

        coder, part, seq = _encoder(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u4").tobytes()
        ids, held, size = [], [], 0

        def close():
            counts = np.array([len(x) // 4 for x in held], dtype=np.int64)
            first = np.concatenate(([0], np.cumsum(counts)))
            flat = np.frombuffer(b"".join(held), dtype="<u4")
            return pd.DataFrame({"part": [part], "seq": [seq], "doc_ids": [ids], "first": [first], "n_ids": [len(flat)], "payload": [pack(flat)]})

        for pdf in frames:
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            before = np.cumsum([0, *map(len, texts)])  # characters
            cuts = np.flatnonzero(np.diff(before[:-1] // BATCH, prepend=-1)).tolist() if texts else []
            for at, to in zip(cuts, [*cuts[1:], len(texts)]):
                for d, coded in zip(pdf["doc_id"].iloc[at:to], coder.encode(texts[at:to])):
                    ids.append(None if pd.isna(d) else int(d))
                    held.append(coded + end)
                    size += len(held[-1]) // 4
                    if size >= SEGMENT:
                        yield close()
                        ids, held, size, seq = [], [], 0, seq + 1
        if held:
            yield close()

    # the text's hash deals out rows that repeat one doc_id
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("__h", F.xxhash64("text"))
    ordered = d.repartitionByRange("doc_id", "__h").sortWithinPartitions("doc_id", "__h").drop("__h")
    return ordered.mapInPandas(run, SCHEMA)


def write_codes(docs: DataFrame, path: str, folder: str) -> None:
    """Write the documents' ids in the file format into a folder."""
    segments(docs, path).write.parquet(folder)


def read_codes(coded: DataFrame) -> DataFrame:
    """doc_id, start, ids (binary, little-endian unsigned 32-bit) of every document of read segments."""
    starts = prefix_offsets(coded.select("part", "seq", "n_ids", F.lit(1).alias("one")), ["one"], ["seq"], F.col("part"), "n_ids", "start")
    starts = materialise(starts.select("part", "seq", "start"), "starts")
    if starts.count() <= SMALL:
        starts = F.broadcast(starts)  # 24 MB at most; beyond that the join shuffles the segments
    located = coded.join(starts, ["part", "seq"])

    def run(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                codes, first = Codes(r.payload), np.asarray(r.first)
                for at in range(0, len(r.doc_ids), 500):
                    span = range(at, min(at + 500, len(r.doc_ids)))
                    got = [codes.slice(int(first[k]), int(first[k + 1])).astype("<u4").tobytes() for k in span]
                    yield pd.DataFrame({"doc_id": pd.array([r.doc_ids[k] for k in span], dtype="Int64"), "start": [r.start + int(first[k]) for k in span], "ids": got})

    return located.select("doc_ids", "first", "payload", "start").mapInPandas(run, "doc_id long, start long, ids binary")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    coded = materialise(segments(docs, vocabulary()), "codes")  # written in the file format and read back
    found = read_codes(coded)
    return found.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
