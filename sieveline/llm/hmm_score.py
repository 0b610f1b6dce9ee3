"""Language model scoring with a hidden Markov model.

Latent states emit word classes and, in each state, a class emits its words. Classes are CLASSES hashes of a word
(whole if short, else of its last bytes and length) and one for the end of a text. Baum-Welch: each task runs scaled
forward and backward recursions over its texts, expected counts of starts, transitions and emissions are summed over
partitions by Spark, the driver renormalises, ITERATIONS times over all training texts. These rounds learn the bounded
parameters: start, moves and B[state, class]. A last round counts emissions of every word in every state, summed by word
in a table that grows with the corpus: P(w | class, state) = (1 - u) * (e + PRIOR * q) / (E + PRIOR) for a word seen,
with its expected count e in the state (its count times the states' shares in 255ths), E their sum over the class, q =
(c + 0.5) / (C + 0.5 * V) of its count c, the class's count C and number of words V; u = 0.5 / (C + 0.5 * (V + 1)) is
left for one unseen word, as in the base model. The score is the exact scaled forward likelihood in double precision.

Texts are packed once into blocks of about BLOCK words, with the block's distinct word hashes; counts are summed
by hash over all blocks, and each block gets its own words' counts back by a join, so that no task or driver holds
the vocabulary. Words are known by a 64-bit hash. Texts longer than SEGMENT words are cut for speed: products
of step matrices carry the recursion exactly over the cuts.

Defined results: null text is empty and has the end token only; a null doc_id is not held out; with no training
text every count is 0, base_score and score follow from the same formulas; repeated rows count each time; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, byte_chunks, doc_fold, materialise, mix64, small_batches

NAME = "op5_hmm_score"
STATES, ITERATIONS = 8, 5
CLASSES, SHORT, TAIL = 8192, 4, 4
END = CLASSES
BLOCK, BATCH, SEGMENT = 1_000_000, 500_000, 1024  # words
CHUNK = 1 << 19  # bytes of texts whose words are hashed at once
ROWS = 1 << 15  # words whose emissions are computed at once
SCALE = 8  # steps between scalings of matrix products
STAY = 0.95  # first probability that a state stays
PRIOR = 20.0  # words of a class that a state takes as seen before it has seen any
FOLDS, HELD_OUT = 5, 1
BLOCKS = "block long, doc_ids array<long>, held array<boolean>, sizes binary, words binary, vocab binary, classes binary, train binary"


# --- blocks of packed texts --------------------------------------------------


def word_classes(w: Words, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Class of the words at these places: their hash if SHORT, else length and last TAIL bytes."""
    size = (w.end - w.start)[at]
    end = w.end[at]
    tail = np.zeros(len(at), dtype=np.uint64)
    for k in range(TAIL):
        tail = (tail << np.uint64(8)) | w.buf[np.maximum(end - 1 - k, 0)].astype(np.uint64)
    tail = mix64(tail + (np.minimum(size, 12).astype(np.uint64) << np.uint64(40)))
    return (np.where(size <= SHORT, hashes[at], tail) % np.uint64(CLASSES)).astype(np.uint16)


def planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32 as four runs of bytes, lowest first: small numbers leave runs of zeros that compress."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def pack_texts(docs: DataFrame) -> DataFrame:
    """Blocks (BLOCKS) of docs (doc_id, text, held)."""

    def run(frames):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        ids, held, sizes, parts, total = [], [], [], [], 0

        def close():
            hashes = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.uint64)
            classes = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.uint16)
            parts.clear()
            vocab, first, words, often = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")  # frequent words get small numbers
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            vocab, first, words = vocab[order], first[order], place[words]
            n = np.concatenate(sizes)
            learn = np.repeat(~np.array(held, dtype=bool), n)
            train = np.bincount(words[learn], minlength=len(vocab)).astype("<u4")
            row = [number, ids, held, n.astype("<i4").tobytes(), planes(words), vocab.astype("<u8").tobytes(), classes[first].astype("<u2").tobytes(), train.tobytes()]
            return pd.DataFrame({c.split()[0]: [v] for c, v in zip(BLOCKS.split(", "), row)})

        for pdf in frames:
            for a, b, texts in byte_chunks(pdf, "text", CHUNK):
                w = Words([t.lower() for t in texts])
                h = w.hashes()
                some = pdf.iloc[a:b]
                ids += [None if pd.isna(d) else int(d) for d in some["doc_id"]]
                held += some["held"].tolist()
                sizes.append(w.counts)
                parts.append((h, word_classes(w, h, np.arange(len(h)))))
                total += len(h)
                if total >= BLOCK:
                    yield close()
                    number += 1
                    ids, held, sizes, parts, total = [], [], [], [], 0
        if ids:
            yield close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held").mapInPandas(run, BLOCKS)


def block_words(blocks: DataFrame) -> DataFrame:
    """(hash, block, at): the distinct words of each block with their number in it."""

    def run(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                vocab = np.frombuffer(r.vocab, "<i8")
                yield pd.DataFrame({"hash": vocab, "block": r.block, "at": np.arange(len(vocab), dtype=np.int32)})

    return blocks.select("block", "vocab").mapInPandas(run, "hash long, block long, at int")


# --- the model ---------------------------------------------------------------


def first_model(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, transition and emission (class, state) parameters around the corpus's class frequencies."""
    noise = np.exp(np.random.RandomState(5).normal(0, 0.5, (len(counts), STATES)))
    noise[END] = 1
    emit = (counts[:, None] + 0.5) * noise
    move = np.full((STATES, STATES), (1 - STAY) / (STATES - 1))
    np.fill_diagonal(move, STAY)
    return np.full(STATES, 1 / STATES), move, emit / emit.sum(0)


def next_model(start: np.ndarray, move: np.ndarray, emit: np.ndarray):
    """Parameters from expected counts."""
    start, move, emit = start + 0.1, move + 0.1, emit + 0.01
    return start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0)


def _lockstep(classes, begin, size, vector, move, emit, keep):
    """Scaled forward recursion over segments at once: the last vectors, log scale and, if keep, all vectors.

    Segments are sorted by size, longest first. vector (state, segment): weights before each segment's first
    word; emit (state, class). States come first, so that every step works along long rows."""
    alpha = vector.astype(emit.dtype)
    log = np.zeros(alpha.shape[1])
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(steps), side="left")  # segments longer than t
    store, scales, forward = [], [], np.ascontiguousarray(move.T)
    for t in range(steps):
        m = active[t]
        a = forward @ alpha[:, :m]
        a *= emit.take(classes[begin[:m] + t], axis=1)
        c = a.sum(0)
        a /= c
        alpha[:, :m] = a
        log[:m] += np.log(c)
        if keep:
            store.append(a)
            scales.append(c)
    return alpha, log, store, scales, active


class Batch:
    """Texts of one block as segments, with the symbol `end` after each text; symbols are classes or words of the block."""

    def __init__(self, classes: np.ndarray, sizes: np.ndarray, end: int = END, words: np.ndarray | None = None, words_end: int = 0):
        ends = np.cumsum(sizes)
        self.classes = np.insert(classes, ends, end)
        self.words = self.classes if words is None else np.insert(words, ends, words_end)  # what emissions are counted by
        self.total = sizes + 1
        self.first = np.cumsum(self.total) - self.total
        pieces = -(-self.total // SEGMENT)
        self.doc = np.repeat(np.arange(len(sizes)), pieces)
        self.piece = np.arange(len(self.doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = self.first[self.doc] + self.piece * SEGMENT
        size = np.minimum(SEGMENT, self.first[self.doc] + self.total[self.doc] - begin)
        self.long = np.flatnonzero(pieces > 1)
        order = np.argsort(-size, kind="stable")
        self.begin, self.size, self.doc, self.piece = begin[order], size[order], self.doc[order], self.piece[order]
        self.n_docs = len(sizes)
        at = np.flatnonzero(pieces[self.doc] > 1)
        self.cut = at[np.lexsort((self.piece[at], self.doc[at]))]  # segments of long texts, in reading order

    def matrices(self, move, emit):
        """For each segment of a long text the product of its step matrices, rows scaled, with log scales.

        All unit vectors of all segments step at once, as columns (segment, state); they are scaled at times."""
        k = len(move)
        order = np.argsort(-self.size[self.cut], kind="stable")
        at = self.cut[order]
        begin, size = self.begin[at], self.size[at]
        n = len(at)
        alpha = np.tile(np.eye(k), (1, n)).reshape(k, n, k)
        log, forward = np.zeros((n, k)), np.ascontiguousarray(move.T)
        active = np.searchsorted(-size, -np.arange(int(size[0])), side="left")
        for t, m in enumerate(active):
            a = (forward @ alpha[:, :m].reshape(k, m * k)).reshape(k, m, k)
            a *= emit.take(self.classes[begin[:m] + t], axis=1)[:, :, None]
            if t % SCALE == SCALE - 1:
                c = a.sum(0)
                a /= c
                log[:m] += np.log(c)
            alpha[:, :m] = a
        c = alpha.sum(0)
        log += np.log(c)
        out, logs = np.empty((n, k, k)), np.empty((n, k))
        out[order], logs[order] = (alpha / c).transpose(1, 2, 0), log
        return out, logs

    def chain(self, start, move, emit):
        """Per segment: state weights before it (scaled) and after it (scaled), and per text log likelihood so far."""
        k = len(move)
        before, after = np.repeat(start[:, None], len(self.doc), 1), np.ones((k, len(self.doc)))
        log = np.zeros(self.n_docs)
        if len(self.cut):
            product, logs = self.matrices(move, emit)
            docs = self.doc[self.cut]
            edges = np.flatnonzero(np.diff(docs)) + 1
            for run in np.split(np.arange(len(self.cut)), edges):
                v, total = start.copy(), 0.0
                for i in run:
                    before[:, self.cut[i]] = v
                    top = logs[i].max()
                    v = (v * np.exp(logs[i] - top)) @ product[i]
                    total += top + np.log(v.sum())
                    v /= v.sum()
                log[docs[run[0]]] = total
                b = np.ones(k)
                for i in run[::-1]:
                    after[:, self.cut[i]] = b
                    b = np.exp(logs[i] - logs[i].max()) * (product[i] @ b)
                    b /= b.max()
        return before, after, log

    def log_likelihood(self, model) -> np.ndarray:
        """Natural log of the likelihood of each text's classes, exact in double precision."""
        start, move, emit = model
        emit = np.ascontiguousarray(emit.T)
        before, _, log = self.chain(start, move, emit)
        single = np.ones(len(self.doc), bool)
        single[self.cut] = False
        at = np.flatnonzero(single)
        _, got, *_ = _lockstep(self.classes, self.begin[at], self.size[at], before[:, at], move, emit, False)
        log[self.doc[at]] = got
        return log

    def expected(self, model, out) -> None:
        """Add the expected counts of starts, transitions and emissions to out = [start, move, emit]."""
        start, move, emit = model
        emit = np.ascontiguousarray(emit.T)
        before, after, _ = self.chain(start, move, emit)
        e32, m32 = emit.astype(np.float32), move.astype(np.float32)
        _, _, store, scales, active = _lockstep(self.classes, self.begin, self.size, before, m32, e32, True)
        beta = after.astype(np.float32)
        labels = []
        for t in range(len(store) - 1, -1, -1):
            m = active[t]
            b, label = beta[:, :m], self.classes[self.begin[:m] + t]
            gamma = store[t] * b
            total = gamma.sum(0)
            gamma /= total
            labels.append(self.words[self.begin[:m] + t])
            right = e32.take(label, axis=1)
            right *= b
            right /= total * scales[t]
            left = store[t - 1][:, :m] if t else before[:, :m].astype(np.float32)
            out[1] += (left @ right.T) * move
            back = m32 @ right
            if t:
                beta[:, :m] = back * total
            else:
                begun = left * back
                out[0] += begun[:, self.piece[:m] == 0].sum(1)
            store[t] = None
            scales[t] = gamma
        if labels:
            label, gamma = np.concatenate(labels), np.concatenate(scales[::-1], axis=1)
            for s in range(len(gamma)):
                out[2][:, s] += np.bincount(label, gamma[s], len(out[2]))


def _batches(r, learn_only: bool, by: str = "classes"):
    """The block's texts (only those to learn from) as Batches of about BATCH words, in order.

    by: "classes" for class symbols, "words" for word symbols, "both" for classes with emissions counted by word."""
    sizes = np.frombuffer(r.sizes, "<i4").astype(np.int64)
    words, classes = unplaned(r.words), np.frombuffer(r.classes, "<u2")
    stops = np.concatenate(([0], np.cumsum(sizes)))
    use = ~np.array(r.held, dtype=bool) if learn_only else np.ones(len(sizes), bool)
    cuts = np.flatnonzero(np.diff(stops[:-1] // BATCH)) + 1
    for part in np.split(np.arange(len(sizes)), cuts):
        if len(part):
            n, chosen = sizes[part], use[part]
            got = words[stops[part[0]] : stops[part[-1] + 1]][np.repeat(chosen, n)].astype(np.int64)
            n = n[chosen]
            if by == "words":
                yield Batch(got, n, len(classes))
            else:
                yield Batch(classes[got].astype(np.int64), n, END, got if by == "both" else None, len(classes))


def baum_welch(blocks: DataFrame, class_counts: np.ndarray, iterations: int = ITERATIONS):
    """Model after `iterations` rounds; expected counts are summed over partitions by class."""
    spark = blocks.sparkSession
    model = first_model(class_counts)
    names = [f"s{k}" for k in range(STATES)]
    schema = "class int, " + ", ".join(f"{n} double" for n in names)
    used = blocks.select("held", "sizes", "words", "classes")
    for _ in range(iterations):
        shared = spark.sparkContext.broadcast(model)  # (CLASSES + 1) * STATES numbers

        def run(frames, shared=shared):
            out = [np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES + 1, STATES))]
            for pdf in frames:
                for r in pdf.itertuples(index=False):
                    for batch in _batches(r, True):
                        batch.expected(shared.value, out)
            # rows of one table: emissions by class, then transitions, then the start
            flat = np.concatenate((out[2], out[1], out[0][None, :]))
            at = np.flatnonzero(flat.any(1))
            yield pd.DataFrame(flat[at], columns=names).assign(**{"class": at.astype(np.int32)})[["class", *names]]

        with small_batches(spark):
            sums = used.mapInPandas(run, schema).groupBy("class").agg(*[F.sum(n).alias(n) for n in names]).toPandas()  # CLASSES + STATES + 2 rows at most
        flat = np.zeros((CLASSES + 2 + STATES, STATES))
        flat[sums["class"].to_numpy()] = sums[names].to_numpy()
        model = next_model(flat[-1], flat[CLASSES + 1 : -1], flat[: CLASSES + 1])
        shared.unpersist()
    return model


def pack_shares(shares: np.ndarray) -> np.ndarray:
    """Each row's STATES shares (of sum 1) in 255ths as the bytes of one long."""
    return np.rint(shares * 255).astype(np.uint8).view("<i8").ravel()


def unpack_shares(packed: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(packed, dtype="<i8").view(np.uint8).reshape(-1, STATES) / 255


def byte_of(packed, s: int):
    return F.shiftrightunsigned(packed, 8 * s).bitwiseAND(F.lit(255))


def emitted_words(blocks: DataFrame, model) -> DataFrame:
    """(hash, class, c, packed): every training word's count and the states' shares in emitting it, by one more round over all texts."""
    shared = blocks.sparkSession.sparkContext.broadcast(model)  # (CLASSES + 1) * STATES numbers

    def run(frames):
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                vocab, c = np.frombuffer(r.vocab, "<i8"), np.frombuffer(r.train, "<u4")
                out = [np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((len(vocab) + 1, STATES))]
                for batch in _batches(r, True, "both"):
                    batch.expected(shared.value, out)
                at = np.flatnonzero(c)
                e = out[2][at]
                yield pd.DataFrame({"hash": vocab[at], "class": np.frombuffer(r.classes, "<u2")[at].astype(np.int32), "c": c[at].astype(np.int64), "packed": pack_shares(e / e.sum(1, keepdims=True))})

    rows = blocks.select("held", "sizes", "words", "vocab", "classes", "train").mapInPandas(run, "hash long, class int, c long, packed long").repartition("hash")
    sums = [F.sum(F.col("c") * byte_of("packed", s)).alias(f"e{s}") for s in range(STATES)]
    total = rows.groupBy("hash").agg(F.first("class").alias("class"), F.sum("c").alias("c"), *sums)
    every = sum((F.col(f"e{s}") for s in range(1, STATES)), F.col("e0"))
    share = [F.shiftleft(F.rint(F.col(f"e{s}") * 255 / every).cast("long"), 8 * s) for s in range(STATES)]
    packed = share[0]
    for x in share[1:]:
        packed = packed.bitwiseOR(x)
    with small_batches(blocks.sparkSession):
        return materialise(total.select("hash", "class", "c", packed.alias("packed")), "emitted")


class Emissions:
    """Probability of each word of a block in each state."""

    def __init__(self, emit: np.ndarray, count: np.ndarray, number: np.ndarray, sums: np.ndarray):
        """emit, sums (class, state): class emissions and expected counts; count, number: words and distinct words of each class."""
        self.emit, self.count, self.number, self.sums = emit, count, number, sums

    def table(self, classes: np.ndarray, c: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """(word, state) for words of these classes, training counts and packed shares, and a last row for the end."""
        out = np.empty((len(classes) + 1, STATES))
        for at in range(0, len(classes), ROWS):  # ROWS words at once, as each step makes a table of that height
            some = slice(at, at + ROWS)
            out[some][: len(classes) - at] = self.rows(classes[some], c[some], packed[some])
        out[-1] = self.emit[END]
        return out

    def rows(self, classes: np.ndarray, c: np.ndarray, packed: np.ndarray) -> np.ndarray:
        unseen = (0.5 / (self.count + 0.5 * (self.number + 1)))[classes]
        e = c[:, None] * unpack_shares(packed)
        q = (c + 0.5) / np.maximum(self.count + 0.5 * self.number, 0.5)[classes]
        seen = (1 - unseen)[:, None] * (e + PRIOR * q[:, None]) / (self.sums[classes] + PRIOR)
        return self.emit[classes] * np.where(c[:, None] > 0, seen, unseen[:, None])


def scores(docs: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score per row of docs (doc_id, text, held)."""
    spark = docs.sparkSession
    with small_batches(spark):
        blocks = materialise(pack_texts(docs), "blocks")

    def by_class(frames):
        out = np.zeros(CLASSES)
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                out += np.bincount(np.frombuffer(r.classes, "<u2"), np.frombuffer(r.train, "<u4"), CLASSES)
        at = np.flatnonzero(out)
        yield pd.DataFrame({"class": at.astype(np.int32), "n": out[at].astype(np.int64)})

    with small_batches(spark):
        counted = blocks.select("classes", "train").mapInPandas(by_class, "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).toPandas()  # CLASSES rows at most
    texts = blocks.select(F.explode("held").alias("held")).where("not held").count()
    class_n, class_v, sums = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1), np.zeros((CLASSES + 1, STATES))
    class_n[counted["class"].to_numpy(int)] = counted["n"].to_numpy(float)
    class_n[END], class_v[END] = texts, texts > 0
    model = baum_welch(blocks, class_n, iterations)
    emitted = emitted_words(blocks, model)
    names = [f"e{s}" for s in range(STATES)]
    per_class = emitted.groupBy("class").agg(F.count("*").alias("v"), *[F.sum(F.col("c") * byte_of("packed", s)).alias(n) for s, n in enumerate(names)]).toPandas()  # CLASSES rows at most
    class_v[per_class["class"].to_numpy(int)] = per_class["v"].to_numpy(float)
    sums[per_class["class"].to_numpy(int)] = per_class[names].to_numpy(float) / 255
    n, v = float(class_n.sum()), float(class_v.sum())
    shared = spark.sparkContext.broadcast((model, Emissions(model[2], class_n, class_v, sums)))  # bounded by CLASSES
    answers = block_words(blocks).join(emitted.select("hash", "c", "packed"), "hash").select("block", "at", "c", "packed")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(key, mine: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        (start, move, _), emissions = shared.value
        out = []
        for r in mine.itertuples(index=False):
            words, classes = unplaned(r.words), np.frombuffer(r.classes, "<u2")
            c, packed = np.zeros(len(classes)), np.zeros(len(classes), np.int64)
            c[known["at"].to_numpy()], packed[known["at"].to_numpy()] = known["c"].to_numpy(), known["packed"].to_numpy()
            sizes = np.frombuffer(r.sizes, "<i4").astype(np.int64)
            text = np.repeat(np.arange(len(sizes)), sizes)
            total = lambda x: np.bincount(text, x[words], len(sizes))
            whole = np.log10(n + 0.5 * (v + 1))
            base = total(np.log10(c + 0.5) - whole) + np.log10(emissions.count[END] + 0.5) - whole
            emit = emissions.table(classes, c, packed)
            score = np.concatenate([x.log_likelihood((start, move, emit)) for x in _batches(r, False, "words")]) / np.log(10)
            seen = total((c > 0).astype(float)) + (emissions.count[END] > 0)
            out.append(pd.DataFrame({"doc_id": pd.array(list(r.doc_ids), dtype="Int64"), "held_out": list(r.held), "n_tokens": sizes + 1, "n_known": np.rint(seen).astype(np.int64), "train_tokens": int(n), "base_score": base, "score": score}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

    return blocks.drop("train", "vocab").groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(doc_fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scores(docs.select("doc_id", "text", held.alias("held")))
