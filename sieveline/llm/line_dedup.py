"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity, one occurrence per group.

A line (cut at \\n) with a word is normalised: lower case, ASCII punctuation as space, single spaces. Equal normalised
lines are one node, however short. Nodes of at least MIN_WORDS words get a fingerprint in blocks: the words are dealt
into classes by their hash (or, in short lines, by place) and each block is the 64-bit SimHash of one class's distinct words, so
that a changed word touches one or two blocks only and k blocks have an untouched one after (k - 1) / 2 replaced words
(blocks of one SimHash over all words have no such bound: one word of ten moves 9 of its 64 bits). Lines of up to ten
words have a block for each one and two words left out instead. A class with fewer than TELLING words of LONG letters takes the next
class in, as blocks of "of the" tell nothing. Lines that share a block are compared, and those with
1 - edit distance / longer length >= SIMILARITY are linked; bounds that never refuse a similar pair come first (lengths,
trigram and letter counts), and pairs that links already connect need no check. A block shared by more than TILE lines is compared
in three steps: each tile of lines by itself, then one line of each group so found, then the lines outside the block's
largest group with all others; no link is lost and a group of n near copies costs about n checks. Of each
connected group the first occurrence in order of (doc_id, text hash, line number) stays, all its other occurrences go.

Defined results: lines without a word always stay; lines under MIN_WORDS words go only as exact copies; null text stays
null; rows repeated with one doc_id and text are one document logged twice and get the same text; a document may end up
empty; line ends stay \\n; an empty table gives an empty result; other columns are kept, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, components, materialise, mix64, star_edges

NAME = "op2_line_dedup"
MIN_WORDS, SIMILARITY = 5, 0.8
#: blocks by number of words (from, to): "leave" one or two words out, classes by "place" or by "class" of the word's hash.
#: Ranges overlap by a fifth, so that lines of similar lengths have one in common.
SCHEMES = [("leave", 5, 10, 1), ("place", 9, 23, 3), ("class", 9, 23, 4), ("class", 19, 47, 6), ("class", 39, 95, 8)]
SCHEMES += [("class", 79 << k, (192 << k) - 1, 12 << k) for k in range(20)]
ENDS = 4  # words in the first and the last block by place
LONG, TELLING = 4, 2
TILE, GROUP_ROWS = 1024, 20_000
GRAMS, LETTERS = 1024, 64  # buckets of a line's trigram and letter counts
STEPS = sorted(((d, e) for d in range(5) for e in range(5) if d + e), key=lambda s: (max(s), abs(s[0] - s[1])))  # words left in either line
COUNTED = 1 << 16  # characters of lines whose trigrams are counted at once
PAIRS = 1 << 21  # candidate pairs held at once
DIAGONALS, FEW = 1024, 32  # pairs whose beginnings are compared at once, and so few that each is compared alone
CHUNK = 1 << 20  # bytes of lines whose blocks are made at once
DEALT = 1 << 19  # rows of blocks that a task sorts, about
SMALL = 1_000_000  # rows of keys or line numbers (16 to 64 MB) up to which they are broadcast instead of shuffling texts

_TABLE = bytes(b if b >= 128 or b == 10 or chr(b).isalnum() else 32 for b in range(256))


def normal_lines(text: str) -> list[bytes]:
    """The normal form of each line of a text; empty for lines without a word."""
    b = text.lower().encode("utf-8", "surrogatepass").translate(_TABLE)
    while b"  " in b:
        b = b.replace(b"  ", b" ")
    return b.replace(b" \n", b"\n").replace(b"\n ", b"\n").strip(b" ").split(b"\n")


# --- fingerprints ------------------------------------------------------------


def majorities(cells: list[tuple[np.ndarray, np.ndarray, np.ndarray]], less: tuple[np.ndarray, ...] = ()) -> np.ndarray:
    """The SimHash of each cell: a 64-bit number with the bits that more than half of its hashes have.

    A cell's hashes are runs (hashes, first, count), one of each triple, and without those of `less`. How many hashes
    have a bit is counted for all 64 bits at once, in planes of binary digits."""
    n = sum(count for _, _, count in cells)
    order = np.argsort(-n, kind="stable")
    planes: list[np.ndarray] = [np.zeros(len(n), np.uint64) for _ in range(int(n.max(initial=0)).bit_length())]
    for hashes, first, count in cells:
        first, count = first[order], count[order]
        for k in range(int(count.max(initial=0))):
            on = np.flatnonzero(count > k)
            whole = len(on) == on[-1] + 1  # the first cells, as a rule
            at = slice(0, len(on)) if whole else on
            carry = hashes[first[at] + k]
            for p in planes:
                now = p[at]
                over = now & carry
                if whole:
                    now ^= carry
                else:
                    p[at] = now ^ carry
                carry = over
                if not carry.any():
                    break
    for x in less:
        borrow = x[order]
        for p in planes:
            now = p.copy()
            p ^= borrow
            borrow &= ~now
    # the digits are compared with half of the count, the highest first
    half = ((n - len(less)) // 2)[order].astype(np.uint64)
    more, level = np.zeros(len(n), np.uint64), np.full(len(n), ~np.uint64(0))
    for k in reversed(range(len(planes))):
        digit = np.uint64(0) - (half >> np.uint64(k) & np.uint64(1))
        more |= level & planes[k] & ~digit
        level &= ~(planes[k] ^ digit)
    out = np.empty(len(n), np.uint64)
    out[order] = more
    return out


def block_keys(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(line number, key) of all blocks of lines of at least one word, by line; a key is the hash of a block's SimHash, kind and word count."""
    w = Words(lines)
    line = np.repeat(np.arange(len(lines)), w.counts)
    # a word in 40 bits: whether it tells, and its hash
    words = (w.hashes() >> np.uint64(25)).astype(np.int64) + ((w.end - w.start >= LONG).astype(np.int64) << 39)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]

    def add(line, prints, counts, kind):
        found.append((line, mix64(prints + mix64((np.asarray(kind, np.uint64) << np.uint64(40)) + counts.astype(np.uint64)))))

    for number, (scheme, low, high, parts) in enumerate(SCHEMES):
        use = (w.counts >= low) & (w.counts <= high)
        mine = use[line]
        if not mine.any():
            continue
        own, ids, n = words[mine], np.flatnonzero(use), w.counts[use]
        row = np.repeat(np.arange(len(ids)), n)
        if scheme == "place":
            place = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            part = (place >= ENDS).astype(np.int64) + (place >= n[row] - ENDS)
        else:
            part = own >> 8
            part -= part // parts * parts
        # distinct words of each class: a repeated one would outvote the others
        own = np.sort(((row * parts + part) << 40) + own)
        own = own[np.diff(own, prepend=-1) != 0]
        cell, own = own >> 40, own & ((1 << 40) - 1)
        hashes = mix64(own.astype(np.uint64))
        counts = np.bincount(cell, minlength=len(ids) * parts)
        starts = np.cumsum(counts) - counts
        if scheme == "leave":
            add(ids, majorities([(hashes, starts, counts)]), counts, number)
            add(ids[cell], majorities([(hashes, starts[cell], counts[cell])], (hashes,)), counts[cell] - 1, number)
            for size in np.unique(counts[counts > 3]).tolist():
                u, v = np.triu_indices(size, 1)
                at = starts[counts == size]
                u, v = (at[:, None] + u).ravel(), (at[:, None] + v).ravel()
                of = cell[u]
                add(ids[of], majorities([(hashes, starts[of], counts[of])], (hashes[u], hashes[v])), counts[of] - 2, number)
            continue
        tell = np.bincount(cell, own >> 39, len(counts)).reshape(-1, parts)
        thin = tell < TELLING
        r, p = np.nonzero(np.where(thin, tell + np.roll(tell, -1, 1), tell) >= TELLING)
        here, after = r * parts + p, r * parts + (p + 1) % parts
        more = np.where(thin[r, p], counts[after], 0)
        add(ids[r], majorities([(hashes, starts[here], counts[here]), (hashes, starts[after], more)]), counts[here] + more, (number << 8) + p)
    line, key = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(key)
    order = order[np.argsort(line[order].astype(np.uint16 if len(lines) < 1 << 16 else np.int64), kind="stable")]
    line, key = line[order], key[order]
    new = (np.diff(line, prepend=-1) != 0) | (np.diff(key, prepend=np.uint64(0)) != 0)  # a line has a block once
    return line[new], key[new].view(np.int64)


LINES = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("line", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("keys", pa.list_(pa.int64()))])


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, h, line, a, b, keys): each line with a word, its normal form's 128-bit hash, and its blocks from MIN_WORDS words on."""

    def run(batches):
        for batch in batches:
            ids, hashes = batch.column("doc_id"), batch.column("h")
            held, own, at, size = [], [], [], 0

            def close():
                digests = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in held]), dtype="<i8").reshape(-1, 2)
                line, key = block_keys(held)
                offsets = np.concatenate(([0], np.cumsum(np.bincount(line, minlength=len(held))))).astype(np.int32)
                take = pa.array(own, pa.int64())
                columns = [ids.take(take), hashes.take(take), pa.array(at, pa.int32()), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(key))]
                return pa.RecordBatch.from_arrays(columns, schema=LINES)

            for k, text in enumerate(batch.column("text")):
                for number, norm in enumerate(normal_lines(text.as_py()) if text.is_valid else ()):
                    if norm:
                        held.append(norm)
                        own.append(k)
                        at.append(number)
                        size += len(norm)
                        if size > CHUNK:
                            yield close()
                            held, own, at, size = [], [], [], 0
            if held:
                yield close()

    return keyed(docs).select("doc_id", "h", "text").mapInArrow(run, "doc_id long, h long, line int, a long, b long, keys array<long>")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, h and text; null ids become -2**63 so that they compare and group like any other."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.xxhash64("text").alias("h"), "text")


# --- edit similarity ---------------------------------------------------------


def diagonal(a: str, b: str, most: int) -> int:
    """Edit distance of a and b, no longer than a, for len(a) - len(b) <= most (bit-parallel, after Myers 1999 and Hyyrö
    2003); some number above `most` where it is above.

    The last cell lies on a diagonal of the table along which values never fall, so that the diagonal alone is
    followed and left once it is above `most`."""
    where: dict[str, int] = {}
    bit = 1
    for c in a:
        where[c] = where.get(c, 0) | bit
        bit <<= 1
    value = len(a) - len(b)
    full, bit = bit - 1, 1 << value
    up, down = full, 0
    for c in b:
        eq = where.get(c, 0)
        equal = ((((eq & up) + up) ^ up) | eq | down) & full  # cells equal to their neighbour on the diagonal
        if not equal & bit:
            value += 1
            if value > most:
                break
        bit <<= 1
        right = (down | full & ~(equal | up)) << 1 | 1
        up, down = ((up & equal) << 1 | ~(equal | right)) & full, right & equal
    return value


def distance(a: str, b: str, most: int) -> int:
    """Edit distance; some number above `most` where it is above. Unlike texts are told by their beginnings."""
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    a, b = a[n:], b[n:]
    n = 0
    while n < min(len(a), len(b)) and a[-1 - n] == b[-1 - n]:
        n += 1
    a, b = a[: len(a) - n], b[: len(b) - n]
    if len(a) < len(b):
        a, b = b, a
    gap = len(a) - len(b)
    if not b or gap > most:
        return len(a)
    lead = 2 * most + 8  # the diagonal is the same over beginnings of both
    if len(b) > 2 * lead and diagonal(a[: lead + gap], b[:lead], most) > most:
        return most + 1
    return diagonal(a, b, most)


def anchored(a: str, b: str, most: int) -> int:
    """An upper bound of the edit distance: the texts are cut at words that occur once in each, in the same order."""
    x, y = a.split(" "), b.split(" ")
    if 2 * len(set(x) & set(y)) < len(set(x)):
        return max(len(a), len(b))  # too few words in common to be worth it
    cx, cy = Counter(x), Counter(y)
    places = {word: k for k, word in enumerate(y) if cy[word] == 1}
    met = [(k, places[word]) for k, word in enumerate(x) if cx[word] == 1 and word in places]
    tails, at, before = [], [], []  # longest increasing run of places in b
    for k, (_, j) in enumerate(met):
        p = bisect_left(tails, j)
        tails[p : p + 1], at[p : p + 1] = [j], [k]
        before.append(at[p - 1] if p else -1)
    k, chain = at[-1] if at else -1, [(len(x), len(y))]
    while k >= 0:
        chain.append(met[k])
        k = before[k]
    gaps, i, j = [], 0, 0
    for u, v in reversed(chain):
        if x[i:u] != y[j:v]:
            gaps.append((" ".join([*x[i:u], ""]), " ".join([*y[j:v], ""])))
        i, j = u + 1, v + 1
    total = sum([max(len(p), len(q)) for p, q in gaps])
    for p, q in gaps:
        if total <= most:
            break
        total += distance(p, q, len(p) + len(q)) - max(len(p), len(q))
    return total


def walked(a: str, b: str, most: int) -> int:
    """An upper bound of the edit distance: one walk over the words of both, which after a difference goes on at the
    nearest equal words; some number above `most` where it is above or no equal words are near."""
    x, y = a.split(" "), b.split(" ")
    i, j, total, n, m = 0, 0, 0, len(x), len(y)
    while i < n and j < m:
        if x[i] == y[j]:
            i += 1
            j += 1
            continue
        for d, e in STEPS:
            if i + d < n and j + e < m and x[i + d] == y[j + e]:
                break
        else:
            if n - i > 4 or m - j > 4:
                return most + 1
            break  # the ends differ
        total += max(sum(map(len, x[i : i + d])) + d, sum(map(len, y[j : j + e])) + e)
        if total > most:
            return total
        i += d
        j += e
    return total + max(sum(map(len, x[i:])) + n - i, sum(map(len, y[j:])) + m - j)


def edit_similar(a: str, b: str, least: float = SIMILARITY) -> bool:
    """Whether 1 - edit distance / longer length >= least."""
    most = int((1 - least) * max(len(a), len(b)) + 1e-9)
    if a == b or abs(len(a) - len(b)) > most:
        return a == b
    # a distance leaves texts that are unlike at their beginnings, so bounds that show likeness come first
    return walked(a, b, most) <= most or len(a) > 60 and anchored(a, b, most) <= most or distance(a, b, most) <= most


def unlike(pairs: list[tuple[str, str]], most: np.ndarray, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(whether the edit distance is above `most`, whether it was looked at) of each pair, by the diagonals of their beginnings
    only or of their whole texts: `diagonal` for many pairs at once, in columns of 64-bit words.

    Pairs of similar lengths go together; where they are few, or so long that each is as fast alone, they are left out.
    Gaps in length must not exceed `most`."""
    pairs = [(a, b) if len(a) >= len(b) else (b, a) for a, b in pairs]
    short = np.fromiter((len(b) for _, b in pairs), np.int64, len(pairs))
    gap = np.fromiter((len(a) for a, _ in pairs), np.int64, len(pairs)) - short
    steps = short if whole else np.minimum(2 * most + 8, short)
    out, done = np.zeros(len(pairs), bool), np.zeros(len(pairs), bool)
    order = np.argsort(steps + gap, kind="stable")
    rows, at = (steps + gap)[order], 0
    while at < len(order):
        own = order[at : min(at + DIAGONALS, int(np.searchsorted(rows, max(64, rows[at] * 5 // 4), side="right")))]
        words = int((most + 64)[own].max()) // 64  # of the band
        if len(own) * (20 - words) < 20 * FEW * (2 - whole):
            at += len(own)
            continue
        codes = [np.frombuffer("".join([pairs[k][side][:n] for k, n in zip(own.tolist(), size[own].tolist())]).encode("utf-32-le", "surrogatepass"), "<u4") for side, size in ((0, steps + gap), (1, steps))]
        known = np.zeros(max(int(c.max(initial=0)) for c in codes) + 1, bool)
        for c in codes:
            known[c] = True
        number, letters = np.cumsum(known) - 1, int(known.sum())
        own = own[: max(1, (1 << 22) // (letters * (int((steps + gap + most)[own].max()) // 64 + 3)))]  # tables of 32 MB
        a, b = (number[c[: int(size[own].sum())]] for c, size in zip(codes, (steps + gap, steps)))
        out[own], done[own] = _above(a, b, gap[own], steps[own], most[own], letters), True
        at += len(own)
    return out, done


def _above(a: np.ndarray, b: np.ndarray, gap: np.ndarray, steps: np.ndarray, most: np.ndarray, letters: int) -> np.ndarray:
    """Whether the diagonals of pairs of texts, whose letters' numbers follow each other in a and in b, get above `most`.

    Only diagonals that at most `most` edits lead to and back from are followed (the band of Hyyrö 2003), so a value
    above `most` may be too large, but none is too small."""
    n, one = len(gap), np.uint64(1)
    below = int((most - gap).max()) // 2 + 2  # diagonals below the first one
    words = (int((most + gap).max()) // 2 + below + 2 + 63) // 64
    place = lambda size: (np.repeat(np.arange(n), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
    pair, bit = place(steps + gap)
    bit += below
    high = max(int(bit.max(initial=0)), int(steps.max())) // 64 + words + 2
    where = np.zeros(high * n * letters, np.uint64)
    np.add.at(where, ((bit >> 6) * n + pair) * letters + a, one << (bit & 63).astype(np.uint64))
    pair, step = place(steps)
    text = np.zeros((int(steps.max()), n), np.int64)
    text[step, pair] = b
    text += np.arange(n) * letters
    layer = np.arange(high)[:, None] * (n * letters)
    value, who, above, spot = gap.copy(), np.arange(n), np.zeros(n, bool), gap + below
    up, down = np.full((words, n), ~np.uint64(0)), np.zeros((words, n), np.uint64)
    up[: below >> 6] = 0
    up[below >> 6] <<= np.uint64(below & 63)
    look, shift = (spot >> 6) * n + who, (spot & 63).astype(np.uint64)
    for t in range(len(text)):
        if not t % 16:  # pairs that have ended go
            above[who[value > most]] = True
            on = (value <= most) & (steps > t)
            if on.sum() < 0.8 * len(on):
                who, value, spot, steps, most, up, down = who[on], value[on], spot[on], steps[on], most[on], up.compress(on, 1), down.compress(on, 1)
                text = text.compress(on, 1)
                look, shift = (spot >> 6) * len(who) + np.arange(len(who)), (spot & 63).astype(np.uint64)
            if not len(who):
                break
        eq = where.take(text[t] + layer[t >> 6 : (t >> 6) + words + 1])
        if t & 63:
            first = eq[1:] << np.uint64(64 - (t & 63))
            eq >>= np.uint64(t & 63)
            eq[:-1] |= first
        eq = eq[:-1]
        equal = eq & up
        total = equal + up
        if words > 1:
            carry = (total < equal).astype(np.uint64)
            for w in range(1, words):
                total[w] += carry[w - 1]
                carry[w] |= total[w] < carry[w - 1]
        equal = total
        equal ^= up
        equal |= eq
        equal |= down
        value += (equal.take(look) >> shift & one == 0) & (steps > t)
        right = equal | up
        np.invert(right, out=right)
        right |= down
        up &= equal
        first = equal[1:] << np.uint64(63)
        equal >>= one
        equal[:-1] |= first
        up |= ~(equal | right)
        down = right
        down &= equal
    above[who[value > most]] = True
    return above


def gram_counts(texts) -> np.ndarray:
    """Counts of each text's trigrams in GRAMS buckets and of its letters in LETTERS more, 255 at most: an edit
    takes three trigrams and one letter at most from either text that the other has not."""
    out = np.zeros((len(texts), GRAMS + LETTERS), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    cuts = np.flatnonzero(np.diff((np.cumsum(size) - size) // COUNTED, prepend=-1)).tolist()
    for at, to in zip(cuts, [*cuts[1:], len(texts)]):
        c = np.frombuffer("".join(texts[at:to]).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        row = np.repeat(np.arange(to - at), size[at:to])
        g = (mix64(c[:-2] << np.uint64(42) ^ c[1:-1] << np.uint64(21) ^ c[2:]) % np.uint64(GRAMS)).astype(np.int64)
        grams = np.bincount((row[:-2] * GRAMS + g)[row[:-2] == row[2:]], minlength=(to - at) * GRAMS)
        letters = np.bincount(row * LETTERS + (c % np.uint64(LETTERS)).astype(np.int64), minlength=(to - at) * LETTERS)
        out[at:to, :GRAMS] = np.minimum(grams, 255).reshape(-1, GRAMS)
        out[at:to, GRAMS:] = np.minimum(letters, 255).reshape(-1, LETTERS)
    return out


class Links:
    """Verified links among the lines of one task, as a forest: pairs that links connect are not checked again."""

    def __init__(self, nodes: np.ndarray, texts: np.ndarray, known: np.ndarray):
        self.nodes, self.texts = nodes, texts
        self.size = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.limit = ((1 - SIMILARITY) * self.size + 1e-9).astype(np.int64)
        self.grams, self.counted = np.zeros((len(texts), GRAMS + LETTERS), np.uint8), np.zeros(len(texts), bool)
        self.words: list = [None] * len(texts)
        self.parent = np.unique(known, return_index=True, return_inverse=True)[1:]
        self.parent = self.parent[0][self.parent[1]].tolist()  # lines of one known group hang on its first
        self.a, self.b = [], []

    def find(self, k: int) -> int:
        parent = self.parent
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    def labels(self, at: np.ndarray) -> np.ndarray:
        return np.fromiter((self.find(k) for k in at.tolist()), np.int64, len(at))

    def link(self, i: int, j: int, u: int, v: int) -> None:
        self.parent[max(u, v)] = min(u, v)
        self.a.append(i)
        self.b.append(j)

    def aligned(self, i: int, j: int, most: int) -> bool:
        """Whether replacing the words that differ place by place is at most `most` edits."""
        for k in (i, j):
            if self.words[k] is None:
                self.words[k] = self.texts[k].split(" ")
        x, y = self.words[i], self.words[j]
        return len(x) == len(y) and sum([max(len(p), len(q)) for p, q in zip(x, y) if p != q]) <= most

    def check(self, a: np.ndarray, b: np.ndarray) -> None:
        """Link the similar ones of these index pairs."""
        most = np.maximum(self.limit[a], self.limit[b])
        fit = np.abs(self.size[a] - self.size[b]) <= most
        both = np.unique(np.minimum(a, b)[fit] * len(self.nodes) + np.maximum(a, b)[fit])
        held = []
        for at in range(0, len(both), 4096):
            a, b = np.divmod(both[at : at + 4096], len(self.nodes))
            most, open_ = np.maximum(self.limit[a], self.limit[b]), np.zeros(len(a), bool)
            for k, (i, j, m) in enumerate(zip(a.tolist(), b.tolist(), most.tolist())):
                u, v = self.find(i), self.find(j)
                if u != v:
                    if self.aligned(i, j, m):
                        self.link(i, j, u, v)
                    else:
                        open_[k] = True
            a, b, most = a[open_], b[open_], most[open_]
            new = np.unique(np.concatenate((a, b)))
            new = new[~self.counted[new]]
            self.grams[new], self.counted[new] = gram_counts(self.texts[new]), True
            x, y = self.grams[a], self.grams[b]
            apart = np.maximum(x, y) - np.minimum(x, y)
            gap = np.abs(self.size[a] - self.size[b])  # with it, twice what the longer has over the shorter
            near = apart[:, :GRAMS].sum(axis=1, dtype=np.int64) + gap <= 6 * most
            near &= apart[:, GRAMS:].sum(axis=1, dtype=np.int64) + gap <= 2 * most
            for i, j, m in zip(a[near].tolist(), b[near].tolist(), most[near].tolist()):
                u, v = self.find(i), self.find(j)
                if u != v:
                    x, y = self.texts[i], self.texts[j]
                    if walked(x, y, m) <= m or len(x) > 60 and anchored(x, y, m) <= m:
                        self.link(i, j, u, v)
                    else:
                        held.append((i, j, m))
            if len(held) >= 8 * DIAGONALS:
                self.settle(held)
                held = []
        self.settle(held)

    def settle(self, held: list[tuple[int, int, int]]) -> None:
        """Link those of the pairs (i, j, most edits) that are similar, though no walk over their words shows it."""
        for whole in (False, True):
            held = [x for x in held if self.find(x[0]) != self.find(x[1])]
            if len(held) > FEW:
                far, done = unlike([(self.texts[i], self.texts[j]) for i, j, _ in held], np.array([m for *_, m in held]), whole)
                if whole:
                    for k in np.flatnonzero(done & ~far).tolist():
                        self.join(*held[k][:2])
                held = [held[k] for k in np.flatnonzero(~(far | done) if whole else ~far).tolist()]
        for i, j, m in held:
            if self.find(i) != self.find(j) and distance(self.texts[i], self.texts[j], m) <= m:
                self.join(i, j)

    def join(self, i: int, j: int) -> None:
        u, v = self.find(i), self.find(j)
        if u != v:
            self.link(i, j, u, v)

    def star(self) -> pd.DataFrame:
        a, b = star_edges(self.nodes, np.array(self.a, dtype=np.int64), np.array(self.b, dtype=np.int64))
        return pd.DataFrame({"a": a, "b": b})


def similar_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links (a, b) between lines (node, norm, comp) that meet in a bucket (key, i, j): side 0 with side 1, or all where i = j."""
    node, first, at = np.unique(pdf["node"].to_numpy(), return_index=True, return_inverse=True)
    links = Links(node, pdf["norm"].to_numpy()[first], pdf["comp"].to_numpy()[first])
    key, i, j, side = (pdf[c].to_numpy() for c in ("key", "i", "j", "side"))
    order = np.lexsort((at, side, j, i, key))
    key, i, j, side, at = (v[order] for v in (key, i, j, side, at))
    starts = np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
    starts = np.concatenate(([0], starts)).astype(np.int64)
    sizes = np.diff(np.append(starts, len(at)))
    small = (sizes <= 16) & (i[starts] == j[starts])
    held, count = [], 0  # pairs of small buckets, checked together
    for size in np.unique(sizes[small]).tolist():
        u, v = np.triu_indices(size, 1)
        rows = starts[small & (sizes == size)]
        step = max(1, PAIRS // max(len(u), 1))
        for k in range(0, len(rows), step):
            held.append((at[rows[k : k + step, None] + u].ravel(), at[rows[k : k + step, None] + v].ravel()))
            count += len(held[-1][0])
            if count >= PAIRS:
                links.check(*map(np.concatenate, zip(*held)))
                held, count = [], 0
    if held:
        links.check(*map(np.concatenate, zip(*held)))
    for lo, n in zip(starts[~small].tolist(), sizes[~small].tolist()):
        mine, cross = at[lo : lo + n], i[lo] != j[lo]
        middle = int(np.searchsorted(side[lo : lo + n], 1)) if cross else n
        left, right = (mine[:middle], mine[middle:]) if cross else (mine, mine)
        if not len(left) or not len(right):
            continue
        links.check(np.full(len(right), left[0]), right)  # a group of copies is found by its first line
        of_left, of_right = links.labels(left), links.labels(right)
        if of_left.min() == of_left.max() == of_right.min() == of_right.max():
            continue
        step = max(1, PAIRS // len(right))
        for k in range(0, len(left), step):
            a, b = np.nonzero(of_left[k : k + step, None] != of_right[None, :])
            if not cross:
                a, b = a[a + k < b], b[a + k < b]
            links.check(left[a + k], right[b])
    return links.star()


# --- buckets -----------------------------------------------------------------


def buckets(distinct: DataFrame) -> DataFrame:
    """(key, node, n) for the blocks that n > 1 lines share; of blocks with equal lines one only.

    Most blocks are one line's: rows are dealt out by block once, packed by the hundreds, and sorted where they arrive; only
    shared ones go on."""
    tasks = -(-distinct.count() * 16 // DEALT) or 1
    slots = 8 * tasks  # so many that tasks get about as much each

    def pack(batches):
        held, size = [], 0

        def close():
            key, node = (np.concatenate(x) for x in zip(*held))
            slot = (mix64(key.view(np.uint64)) % np.uint64(slots)).astype(np.int32)
            order = np.argsort(slot.astype(np.uint16) if slots <= 1 << 16 else slot, kind="stable")
            key, node, slot = key[order], node[order], slot[order]
            starts = np.flatnonzero(np.diff(slot, prepend=-1))
            cuts = zip(starts.tolist(), [*starts[1:].tolist(), len(slot)])
            data = [key[i:j].tobytes() + node[i:j].tobytes() for i, j in cuts]
            return pa.RecordBatch.from_arrays([pa.array(slot[starts]), pa.array(data, pa.binary())], names=["slot", "data"])

        for b in batches:
            keys = b.column("keys")
            held.append((keys.flatten().to_numpy(), np.repeat(b.column("node").to_numpy(), np.diff(keys.offsets.to_numpy()))))
            size += len(held[-1][0])
            if size > DEALT:
                yield close()
                held, size = [], 0
        if size:
            yield close()

    rows = distinct.select("node", "keys").mapInArrow(pack, "slot int, data binary").repartition(tasks, "slot")

    def run(batches):
        held = [np.frombuffer(x.as_buffer(), np.int64).reshape(2, -1) for b in batches for x in b.column("data")]
        if not held:
            return
        key, node = np.concatenate(held, axis=1)
        del held
        order = np.argsort(key)
        key, node = key[order], node[order]
        starts = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0)
        n = np.diff(np.append(starts, len(key)))
        shared = np.repeat(n > 1, n)
        key, node, n = key[shared], node[shared], n[n > 1]
        starts = np.cumsum(n) - n
        hashes = [mix64(mix64(node.view(np.uint64) + np.uint64(k)) + np.uint64(k)) for k in (1, 2)]
        prints = [np.repeat(np.bitwise_xor.reduceat(h, starts), n).view(np.int64) for h in hashes] if len(n) else hashes
        columns = [key, node, np.repeat(n, n), *prints]
        for at in range(0, len(key), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in columns], names=["key", "node", "n", "s", "x"])

    shared = materialise(rows.mapInArrow(run, "key long, node long, n long, s long, x long"), "shared")
    one = shared.groupBy("n", "s", "x").agg(F.min("key").alias("key"))
    return shared.select("key", "node", "n").join(one.select("key"), "key", "left_semi")


def compared(rows: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(a, b): links of rows (key, node, comp, i, j, side), about n, with their texts."""
    groups = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // GROUP_ROWS))
    d = rows.join(texts, "node").withColumn("__g", F.pmod(F.xxhash64("key", "i", "j"), F.lit(groups)))
    return materialise(d.groupBy("__g").applyInPandas(similar_links, "a long, b long"), "links")


def paired(rows: DataFrame, tile: Column, first: Column, last: Column) -> DataFrame:
    """rows with each pair (i, j) of their tile and the tiles from first to last, and the side they are on."""
    d = rows.withColumn("tile", tile).withColumn("p", F.explode(F.sequence(first, last)))
    return d.select("key", "node", "comp", F.least("tile", "p").alias("i"), F.greatest("tile", "p").alias("j"), (F.col("tile") > F.col("p")).cast("int").alias("side"))


def tiles_of(n: Column) -> Column:
    return F.ceil(n / TILE).cast("long")


def fuzzy_groups(distinct: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, root) for the distinct lines (node, keys, first) that are linked to another."""
    rows = materialise(buckets(distinct), "buckets")
    lines = materialise(rows.select("node").distinct().join(distinct, "node").select("node", "first.doc_id", "first.h", "first.line"), "wanted")
    texts = materialise(line_texts(lines, docs), "line-texts")
    salt, zero = F.xxhash64("node"), F.lit(0).cast("long")
    alone = rows.withColumn("comp", F.col("node")).withColumn("tile", F.pmod(salt, tiles_of(F.col("n"))))
    links = compared(paired(alone, F.col("tile"), F.col("tile"), F.col("tile")), texts, rows.count())
    groups = components(links)
    large = rows.where(F.col("n") > TILE)
    if large.isEmpty():
        return groups

    def grouped():
        comp = groups.select(F.col("node").alias("g"), F.col("root").alias("comp"))
        return materialise(large.join(comp, F.col("node") == F.col("g"), "left").select("key", "node", F.coalesce("comp", "node").alias("comp")), "large")

    one = grouped().groupBy("key", "comp").agg(F.min("node").alias("node"))
    many = one.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    one = materialise(one.join(many, "key"), "one-each")
    last = tiles_of(F.col("m")) - 1
    links = links.unionByName(compared(paired(one, F.pmod(salt, last + 1), zero, last), texts, one.count()))
    groups = components(links)
    now = grouped()
    main = now.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("c"), F.sum("c").alias("m"), F.count("*").alias("k"))
    main = main.where("k > 1").select("key", "main", tiles_of(F.col("m") - F.col("c")).alias("minor"), tiles_of(F.col("c")).alias("major"))
    rest = materialise(now.join(main, "key"), "rest")
    if not rest.isEmpty():
        # tiles of lines outside the largest group meet all tiles, tiles of the largest group only those
        inside = F.col("comp") == F.col("main")
        tile = F.when(inside, F.col("minor") + F.pmod(salt, F.col("major"))).otherwise(F.pmod(salt, F.col("minor")))
        sent = paired(rest, tile, zero, F.when(inside, F.col("minor")).otherwise(F.col("minor") + F.col("major")) - 1)
        groups = components(links.unionByName(compared(sent, texts, rest.count())))
    return groups


def line_texts(lines: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, norm): the normal forms of lines (node, doc_id, h, line)."""
    asked = lines.groupBy("doc_id", "h").agg(F.collect_list(F.struct("line", "node")).alias("lines"))

    def texts(frames):
        for pdf in frames:
            got = []
            for text, asked in zip(pdf["text"], pdf["lines"]):
                lines = normal_lines(text)
                got += [(r["node"], lines[r["line"]].decode("utf-8", "replace")) for r in asked]
            yield pd.DataFrame(got, columns=["node", "norm"])

    if lines.count() <= SMALL:
        asked = F.broadcast(asked)
    # rows repeated under one key bring their lines twice; they are one node
    return keyed(docs).join(asked, ["doc_id", "h"]).select("text", "lines").mapInPandas(texts, "node long, norm string").dropDuplicates(["node"])


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, h, lines): numbers of the lines to drop, for every document that loses one."""
    lines = materialise(line_table(docs), "lines")
    distinct = lines.groupBy("a", "b").agg(F.min(F.struct("doc_id", "h", "line")).alias("first"), F.first("keys").alias("keys"), F.count("*").alias("times"))
    distinct = materialise(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct-lines")  # written once, so ids stay
    members = distinct.drop("keys").join(fuzzy_groups(distinct.where(F.size("keys") > 0), docs), "node", "left")
    stays = members.where("root is not null").groupBy("root").agg(F.min("first").alias("stay"))
    table = members.where("root is not null or times > 1").join(stays, "root", "left").select("a", "b", F.coalesce("stay", "first").alias("stay"))
    gone = lines.drop("keys").join(table, ["a", "b"]).where("struct(doc_id, h, line) <> stay").select("doc_id", "h", "line").distinct()
    return materialise(gone.groupBy("doc_id", "h").agg(F.collect_list("line").alias("lines")), "dropped")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the repeated lines out of text; n_lines and n_dropped are appended (with _ where taken)."""
    from pyspark.sql import types as T

    gone = dropped_lines(docs).select(F.col("doc_id").alias("__d"), F.col("h").alias("__h"), F.col("lines").alias("__lines"))
    if gone.agg(F.coalesce(F.sum(F.size("__lines") + 4), F.lit(0))).first()[0] <= 4 * SMALL:
        gone = F.broadcast(gone)  # 64 MB at most; beyond that the join shuffles
    key = F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63)))
    joined = docs.join(gone, (key == gone["__d"]) & (F.xxhash64(docs["text"]) == gone["__h"]), "left").drop("__d", "__h")
    names = docs.columns
    extra = [n + "_" * sum(1 for x in names if x.rstrip("_") == n) for n in ("n_lines", "n_dropped")]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T.LongType()) for n in extra]])

    def run(frames):
        for pdf in frames:
            texts, counts, drops = [], [], []
            for text, gone in zip(pdf["text"], pdf["__lines"]):
                lines = text.split("\n") if isinstance(text, str) else []
                out = set(gone) if gone is not None else ()
                texts.append("\n".join([x for k, x in enumerate(lines) if k not in out]) if len(out) else text)
                counts.append(len(lines))
                drops.append(len(out))
            pdf["text"] = pd.Series(texts, index=pdf.index, dtype=object)
            yield pdf[names].assign(**{extra[0]: counts, extra[1]: drops})

    return joined.mapInPandas(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_lines(docs.select("doc_id", "text"))
