"""BPE encoding by backtracking over longest matches, decoding by an offset table.

A word of base symbols is encoded from left to right: the longest vocabulary token at each place (found by one
Aho-Corasick pass) is taken if it is compatible with the token before it, that is, if merging the two tokens'
text gives just these two; else its next shorter prefix token is tried, else the last token is taken back.
Compatibility undoes merges from the seam: a merge over the seam that ranks before the merges that made
the two tokens would have won. Every place is marked dead at most once, so the work is linear.

White space never lies in a word, so a text is cut at ASCII white space, and each distinct piece is normalised,
split and merged once per worker (a table of at most CACHE pieces). The tokenizer file is a parameter.

Defined results: null text is empty and has no ids; an empty table gives an empty result; repeated rows each
get a row; very long texts and words are encoded whole; other columns are kept by encode, whatever their names.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAME = "op10_bpe"
CACHE = 600_000  # entries of at most 64 bytes, or pairs of tokens: some 100 MB a table
ROWS = 500  # rows of output sent at a time


def byte_letters() -> list[str]:
    """Letter of each byte in a byte-level vocabulary: printable bytes stand for themselves, the rest from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class BacktrackingBpe:
    """Encoder and decoder of a byte-level BPE with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab, merges = model["vocab"], model["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.letters = byte_letters()
        pre = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(pre)
        self.special_split = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        # base symbols: a letter, or the last letter of a word with its suffix; each is one character here
        self.symbol = {}
        for letter in self.letters:
            for end in {"", self.suffix}:
                if letter + end in vocab:
                    self.symbol[letter + end] = chr(0x4E00 + len(self.symbol))
        self.base = {c: vocab[s] for s, c in self.symbol.items()}
        text = {i: c for c, i in self.base.items()}
        self.pair, self.halves, self.rank = {}, {}, {}
        for r, (left, right) in enumerate(merges):
            a, b, made = vocab[left], vocab[right], vocab[left + right]
            self.pair[a, b] = made
            self.halves[made] = (a, b)
            self.rank[made] = r
            text[made] = text[a] + text[b]
        self.length = {i: len(t) for i, t in text.items()}
        self.trie = ahocorasick.Automaton()
        for i, t in text.items():
            self.trie.add_word(t, (i, len(t)))
        self.trie.make_automaton()
        self.known = {t: i for i, t in text.items()}
        self.text = text
        self.shorter: dict[int, int | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        # offset table: the strings of all ids in one buffer
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        strings = [names.get(i, "").encode() for i in range(max(names) + 1)]
        self.offset = np.concatenate(([0], np.cumsum([len(s) for s in strings])))
        self.buffer = np.frombuffer(b"".join(strings), dtype=np.uint8)
        self.inner = [self.symbol.get(x) for x in self.letters]
        self.final = [self.symbol.get(x + self.suffix) for x in self.letters]
        self.pieces: dict[bytes, bytes] = {}
        self.words: dict[str, list[int]] = {}

    def prefix(self, token: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        if token not in self.shorter:
            t = self.text[token]
            self.shorter[token] = next((self.known[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.known), None)
        return self.shorter[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the text of left and right together is encoded as just these two tokens."""
        got = self.fits.get((left, right))
        if got is None:
            if len(self.fits) >= CACHE:
                self.fits.clear()
            got = self.fits[left, right] = self._compatible(left, right)
        return got

    def _compatible(self, a: int, b: int) -> bool:
        # Undo the younger of the two seam tokens' merges step by step; at each step a merge across the seam
        # must not come before the merge just undone (ties go to the left one).
        rank, limit_a, limit_b = self.rank, np.inf, np.inf  # the merge that consumes a on the left, b on the right
        while True:
            made = self.pair.get((a, b))
            if made is not None:
                r = rank[made]
                # a is consumed at limit_a by its left neighbour, which is further left and wins a tie;
                # b is consumed at limit_b by its right neighbour, which is further right and loses a tie
                if r < limit_a and r <= limit_b:
                    return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb or (ra == rb and ra >= 0):
                limit_a, a = ra, self.halves[a][1]
            else:
                limit_b, b = rb, self.halves[b][0]

    def merge(self, symbols: str) -> list[int]:
        """Token ids of one word given as base symbols."""
        whole = self.known.get(symbols)
        if whole is not None:
            return [whole]
        n = len(symbols)
        longest: list[int | None] = [None] * n
        for end, (token, size) in self.trie.iter(symbols):
            longest[end + 1 - size] = token  # ends grow, so the last match of a place is its longest
        alive = bytearray(b"\x01" * (n + 1))
        out: list[int] = []
        length, fits = self.length, self.fits
        at, token, last = 0, longest[0], None
        while at < n:
            while token is not None:
                end = at + length[token]
                if alive[end] and (last is None or (fits[last, token] if (last, token) in fits else self.compatible(last, token))):
                    break
                token = self.prefix(token)
            if token is not None:
                out.append(token)
                at, last = end, token
                token = longest[at] if at < n else None
            else:
                alive[at] = 0
                token = self.prefix(out[-1])
                at -= length[out.pop()]
                last = out[-1] if out else None
        return out

    def _words(self, text: str, out: list[int]) -> None:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        inner, final, known = self.inner, self.final, self.words
        for word in self.split.findall(text.lower()):
            ids = known.get(word)
            if ids is None:
                raw = word.encode("utf-8", "surrogatepass")
                ids = self.merge("".join([inner[b] for b in raw[:-1]]) + final[raw[-1]])
                if len(known) > CACHE:
                    known.clear()
                if len(word) <= 64:
                    known[word] = ids
            out += ids

    def piece(self, raw: bytes) -> bytes:
        """Ids of a text without ASCII white space, as little-endian unsigned 32-bit integers."""
        text, out = raw.decode("utf-8", "replace"), []
        if self.special_split and self.special_split.search(text):
            for part in self.special_split.split(text):
                if part in self.special:
                    out.append(self.special[part])
                elif part:
                    self._words(part, out)
        else:
            self._words(text, out)
        return array("I", out).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        pieces = self.pieces
        parts = (text or "").encode("utf-8", "replace").split()
        try:
            return b"".join([pieces[p] for p in parts])
        except KeyError:
            if len(pieces) > CACHE:
                pieces.clear()
            kept = {}
            for p in parts:
                if p not in pieces and p not in kept:
                    kept[p] = self.piece(p)
            small = {p: v for p, v in kept.items() if len(p) <= 64}
            pieces.update(small)
            return b"".join([pieces[p] if p in pieces else kept[p] for p in parts])

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the ids' strings with a space between, gathered through the offset table."""
        if not len(ids):
            return b""
        begin, size = self.offset[ids], self.offset[ids + 1] - self.offset[ids]
        place = np.cumsum(size + 1) - (size + 1)  # one more byte each, for the space
        out = np.full(int(place[-1] + size[-1]), 32, dtype=np.uint8)
        source = np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)
        target = np.arange(int(size.sum())) + np.repeat(np.arange(len(ids)), size)
        out[target] = self.buffer[source]
        return out.tobytes()


@lru_cache(maxsize=2)
def _coder(path: str) -> BacktrackingBpe:
    return BacktrackingBpe(path)


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs with `ids` (binary, little-endian unsigned 32-bit) and `decoded` in place of the text column."""
    kept = [f for f in docs.schema.fields if f.name != text]
    names = [f.name for f in kept]
    ids, decoded = (n + "_" * sum(1 for x in names if x.rstrip("_") == n) for n in ("ids", "decoded"))
    schema = T.StructType([*kept, T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.StringType())])

    def run(frames):
        coder = _coder(path)
        for pdf in frames:
            for at in range(0, len(pdf), ROWS):
                part = pdf.iloc[at : at + ROWS]
                coded = [coder.encode(t if isinstance(t, str) else None) for t in part[text]]
                back = [coder.decode(np.frombuffer(c, dtype="<u4").astype(np.int64)).decode("utf-8", "replace") for c in coded]
                yield pd.DataFrame({**{n: part[n] for n in names}, ids: pd.Series(coded, index=part.index, dtype=object), decoded: pd.Series(back, index=part.index, dtype=object)})

    return docs.mapInPandas(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 per row."""
    coded = encode(docs.select("doc_id", "text"), path)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
