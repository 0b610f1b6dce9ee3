import random

import numpy as np
import pytest
import xxhash

from sieveline.llm import embedding_dedup, line_dedup, simhash_dedup

from ..compare import same
from ..conftest import SF
from .conftest import reach, words


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(len(w) - 3, 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_all_pairs(spark, odd_docs, no_docs):
    rows = odd_docs.toPandas()
    fps = [plain_fingerprint(t) for t in rows["text"]]
    ids = [None if x != x else int(x) for x in rows["doc_id"]]
    n = len(fps)
    label = reach(range(n), [(i, j) for i in range(n) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    want = sorted((str(ids[i]), f"{fps[i]:016x}", min((ids[j] for j in range(n) if label[j] == label[i] and ids[j] is not None), default=None)) for i in range(n))
    got = simhash_dedup.near_duplicates(odd_docs).collect()
    assert sorted((str(r["doc_id"]), f"{r['fp'] & (2**64 - 1):016x}", r["component_id"]) for r in got) == want
    kept = simhash_dedup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len(set(label.values()))
    assert simhash_dedup.near_duplicates(no_docs).count() == 0


def test_kept_row_of_equal_ids_and_texts_is_the_first_by_its_other_columns(spark):
    rows = [(1, "a b c d e f", "fr", "x"), (1, "a b c d e f", "en", "y"), (1, "a b c d e f", "en", "b"), (2, None, None, None), (2, None, "en", None)]
    for order in (rows, rows[::-1]):
        kept = simhash_dedup.keep_one(spark.createDataFrame(order, "doc_id long, text string, lang string, h string").repartition(3))
        assert sorted(map(tuple, kept.collect())) == [(1, "a b c d e f", "en", "b"), (2, None, "en", None)]


def test_close_pairs_are_exact():
    rng = np.random.RandomState(1)
    x = rng.randint(0, 2**63, 700, dtype=np.uint64)
    y = x.copy()
    for _ in range(5):
        y ^= np.uint64(1) << rng.randint(0, 64, len(y)).astype(np.uint64)
    z = np.concatenate((x, y))
    z = z[np.argsort(np.bitwise_count(z), kind="stable")]
    a, b = simhash_dedup.close_pairs(z, z, True, 4)
    near = np.triu(np.bitwise_count(z[:, None] ^ z[None, :]) <= 4, 1)
    assert set(zip(a.tolist(), b.tolist())) == set(zip(*(v.tolist() for v in np.nonzero(near)))) and near.any()


@pytest.mark.parametrize("tile", [4, 8192])
def test_embeddings_against_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    rng = np.random.RandomState(2)
    centre = rng.normal(size=(6, 8))
    v = [(centre[k % 6] + rng.normal(size=8) * 0.22).astype(np.float32).astype(float).tolist() for k in range(36)]
    v[7], v[8] = v[1], [2 * x for x in v[2]]
    rows = [(k, x, k % 3) for k, x in enumerate(v)] + [(50, None, 1), (51, [0.0] * 8, 1), (52, [1.0, None] + [0.0] * 6, 1), (53, [float("nan")] * 8, 1), (54, [], 1), (55, v[0][:5], 1), (0, v[0], 1), (None, v[3], None)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node int")
    good = [i for i, r in enumerate(rows) if r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    cos = lambda a, b: np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)) if len(a) == len(b) else -1
    pairs = [(i, j) for i in good for j in good if j < i and cos(rows[i][1], rows[j][1]) >= 0.9]
    label = reach(range(len(rows)), pairs)
    want = sorted((str(rows[i][0]), sum(i in p for p in pairs), str(min((rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None), default=None))) for i in range(len(rows)))
    got = embedding_dedup.embedding_links(d).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got) == want and len(pairs) > 10
    assert embedding_dedup.embedding_links(d.limit(0)).count() == 0


def test_embedding_query_equals_sql(spark):
    same(embedding_dedup.query(spark, SF), embedding_dedup.SQL, SF)


@pytest.mark.parametrize("scale", [1e180, 1e-200])
def test_very_large_and_very_small_vectors(scale):
    rng = np.random.RandomState(4)
    x = rng.normal(size=(4, 6))[rng.randint(0, 4, 60)] + rng.normal(size=(60, 6)) * 0.2
    want = np.triu(np.corrcoef(np.hstack((x, -x))) >= 0.9, 1)
    a, b = embedding_dedup.links(x * scale, x * scale, True, 0.9)
    assert set(zip(a.tolist(), b.tolist())) == set(zip(*(v.tolist() for v in np.nonzero(want)))) and want.sum() > 50


def test_quantisation_bound_holds():
    rng = np.random.RandomState(3)
    x = rng.normal(size=(200, 64)) * rng.exponential(size=(200, 1))
    q, s, n, e = embedding_dedup.quantise(x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s[None, :]
    assert (np.abs(u @ u.T - near) <= e[:, None] + n[:, None] * e[None, :] + 1e-12).all()


def plain_normal(line):
    """A line's words in lower case without ASCII punctuation, joined by single spaces."""
    return " ".join("".join(c if ord(c) >= 128 or c.isalnum() else " " for c in line.lower()).split(" "))


def plain_distance(a, b):
    """Edit distance by the table, a row at a time."""
    y, steps = np.array([ord(c) for c in b]), np.arange(len(b) + 1)
    row = steps.copy()
    for k, c in enumerate(a):
        new = np.minimum(row + 1, np.concatenate(([k + 1], row[:-1] + (y != ord(c)))))
        row = np.minimum.accumulate(new - steps) + steps
    return int(row[-1])


def plain_similar(a, b):
    most = 0.2 * max(len(a), len(b)) + 1e-9
    return abs(len(a) - len(b)) <= most and plain_distance(a, b) <= most


def plain_dedup(rows):
    """Texts of (doc_id, text) rows after line dedup, by comparing all pairs of lines by edit distance alone."""
    key = lambda d: -(2**63) if d is None else d

    def signed(t):
        h = xxhash.xxh64_intdigest((t or "").encode(), 42)
        return h - ((h >= 2**63) << 64)

    first = {}
    for d, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            n = " ".join(plain_normal(line).split())
            if n:
                first.setdefault(n, set()).add((key(d), signed(t), k))
    names = list(first)
    long = [i for i, n in enumerate(names) if n.count(" ") >= 4]
    label = reach(range(len(names)), [(i, j) for i in long for j in long if j < i and plain_similar(names[i], names[j])])
    groups = {}
    for i, n in enumerate(names):
        groups.setdefault(label[i], set()).update(first[n])
    gone = {x for g in groups.values() for x in sorted(g)[1:]}
    return [(d, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (key(d), signed(t), k) not in gone)) for d, t in rows]


def test_lines_against_all_pairs(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    out = line_dedup.dedup_lines(odd_docs)
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(plain_dedup(rows), key=str) != sorted(rows, key=str)
    assert set(odd_docs.columns) < set(out.columns) and line_dedup.dedup_lines(no_docs).count() == 0


@pytest.mark.parametrize("tile", [4, 1024])
def test_many_groups_in_shared_blocks_against_all_pairs(spark, monkeypatch, tile):
    """Lines of one shared half and another half in groups of near copies: all meet in blocks, few are similar."""
    monkeypatch.setattr(line_dedup, "TILE", tile)
    rng = np.random.default_rng(3)
    word = lambda letters: "".join(rng.choice(list(letters), 6))
    common, texts = [word("abcdefgh") for _ in range(12)], []
    for _ in range(6):
        own = [word("ijklmnop") for _ in range(12)]
        for _ in range(9):
            line = [*common, *own]
            line[int(rng.integers(12, 24))] = word("qrstuvwxyz")
            texts.append(" ".join(line))
    texts += [" ".join([*common, *[word("klmnop") for _ in range(12)]]) for _ in range(7)]
    rng.shuffle(texts)
    rows = [(k, str(t)) for k, t in enumerate(texts)]
    want = plain_dedup(rows)
    got = [(r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == sorted(want) and sum(t != "" for _, t in want) == 13


def test_large_group_of_near_copies_is_tiled(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "TILE", 16)
    base = " ".join(f"w{k:03d}x" for k in range(120))
    rows = [(k, base + " " + "".join(chr(97 + (k // 26**p) % 26) for p in range(3))) for k in range(120)] + [(900, "a different line of some words")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in got.where("n_dropped = 0").collect()} == {0, 900}


def test_edit_similarity():
    assert line_dedup.edit_similar("abcdefghij", "abcdefghix", 0.9) and not line_dedup.edit_similar("abcdefghij", "abcdefghxy", 0.9)
    assert line_dedup.edit_similar("", "") and not line_dedup.edit_similar("", "abc")


def test_edit_similarity_against_the_table():
    rng = np.random.default_rng(8)
    for k in range(400):
        a = list(rng.choice(list("abcd  "), int(rng.integers(1, 500 if k % 4 == 0 else 60))))
        b = list(a)
        for _ in range(int(rng.integers(0, max(2, len(a) // 3)))):
            at = int(rng.integers(len(b) + 1))
            b[at : at + int(rng.integers(3))] = rng.choice(list("abxy "), int(rng.integers(3)))
        a, b = "".join(a), "".join(b)
        assert line_dedup.edit_similar(a, b) == plain_similar(a, b)
        d = plain_distance(a, b)
        assert line_dedup.distance(a, b, len(a) + len(b)) == d <= line_dedup.anchored(a, b, len(a) + len(b))


def test_very_long_near_copies(spark):
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdefghijk"), 5)) for _ in range(40_000)]
    other = list(words)
    for k in rng.integers(0, len(words), 300):
        other[k] = "zzzzzz"
    rng.shuffle(words_2 := list(words))
    rows = [(1, " ".join(words)), (2, "x\n" + " ".join(other)), (3, " ".join(words_2[:20_000]))]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "x", 3: rows[2][1]}


def test_figures_are_compared_as_they_are(spark):
    rows = [(1, "the total of items sold 12 34 56"), (2, "the total of items sold 99 71 20"), (3, "the total of items sold 12 34 57")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 3: ""}


def test_short_lines_go_as_exact_copies_only(spark):
    rows = [(1, "Home\nAbout us\n\n--\nhome page"), (2, "home!\nabout  us\n\n--\nhomes"), (3, "HOME\nread more about us"), (4, "Read more, about us\nread more about it")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "\n--\nhomes", 3: "read more about us", 4: "read more about it"}


@pytest.mark.parametrize("edits, least", [(1, 1.0), (2, 0.9)])
def test_recall_against_edit_similarity_alone(spark, edits, least):
    """Lines of 5 to 120 words with letters changed, words replaced, added or left out; the brute force knows no fingerprints."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(4, 9))))
    rows = []
    for k in range(160):
        line = [word() for _ in range([5, 7, 9, 10, 15, 20, 40, 120][k % 8])]
        other = list(line)
        for at in sorted(rng.choice(len(line), edits, replace=False).tolist(), reverse=True):
            other[at : at + 1] = [["z" + other[at][1:]], [word()], [other[at], word()], []][int(rng.integers(4))]
        rows += [(2 * k, " ".join(line)), (2 * k + 1, " ".join(other))]
    want = {d for d, t in plain_dedup(rows) if t == ""}
    got = {r["doc_id"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("n_dropped > 0").collect()}
    assert len(want) > 60 and got <= want and len(got) >= least * len(want)


def test_trigram_bound_never_refuses_a_similar_pair():
    rng = np.random.default_rng(6)
    for _ in range(300):
        a = list(rng.choice(list("abcde fgh"), int(rng.integers(3, 200))))
        b, edits = list(a), int(rng.integers(1, 9))
        for _ in range(edits):
            k = int(rng.integers(len(b) + 1))
            b[k : k + int(rng.integers(2))] = rng.choice(list("xyz"), int(rng.integers(2)))
        x, y = line_dedup.gram_counts(["".join(a), "".join(b)]).astype(int)
        apart, gap = np.abs(x - y), abs(len(a) - len(b))
        assert apart[: line_dedup.GRAMS].sum() + gap <= 6 * edits  # trigrams and letters have bounds of their own
        assert apart[line_dedup.GRAMS :].sum() + gap <= 2 * edits


def test_long_lines_have_blocks_of_all_their_words():
    """a line of 400 words had blocks of 12 of its 48 classes of words; changes in those alone hid its copies."""
    words = [f"word{k}letters" for k in range(400)]
    w = line_dedup.Words([" ".join(words).encode()])
    classes = (((w.hashes() >> np.uint64(25)) + np.uint64(1 << 39)) >> np.uint64(8)) % np.uint64(48)  # all are LONG
    spoilt = {int(np.flatnonzero(classes == c)[0]) for c in range(12)}
    other = " ".join(f"other{k}letters" if k in spoilt else x for k, x in enumerate(words))
    line, key = line_dedup.block_keys([" ".join(words).encode(), other.encode()])
    assert line_dedup.edit_similar(" ".join(words), other)
    assert len(set(key[line == 0]) & set(key[line == 1])) >= 20


def test_near_copies_need_no_edit_distance(monkeypatch):
    """Words left out, added and replaced are found by one walk over the words; the full table was filled before."""
    rng = random.Random(21)
    pairs = []
    for _ in range(60):
        a = words(rng, rng.randint(30, 60)).split()
        b = list(a)
        del b[rng.randrange(5, 12)]
        b.insert(rng.randrange(14, 20), "new")
        b[22] = "other"
        pairs.append((" ".join(a), " ".join(b)))
    want = [line_dedup.distance(a, b, 1000) for a, b in pairs]
    for (a, b), d in zip(pairs, want):
        assert d <= line_dedup.walked(a, b, 1000)
    monkeypatch.setattr(line_dedup, "diagonal", None)  # none may be followed
    assert all(line_dedup.edit_similar(a, b) for a, b in pairs)


def test_similarity_equals_a_plain_table():
    rng = random.Random(22)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
            row = new
        return row[-1]

    for _ in range(500):
        a = [rng.choice(["ab", "cde", "f", "ghij", "klm"]) for _ in range(rng.randint(1, 30))]
        b = list(a)
        for _ in range(rng.randint(0, 9)):
            b[rng.randrange(len(b)) : rng.randrange(len(b) + 1)] = [rng.choice(["ab", "zz", "f"])] * rng.randint(0, 2) or ["q"]
        a, b = " ".join(a), " ".join(b)
        assert line_dedup.edit_similar(a, b) == (plain(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)), (a, b)


def test_counts_of_many_lines_equal_those_of_each():
    texts = np.array(["", "a", "ab", "abc", "x" * 400, "中文字", "one two three"] * 30, dtype=object)
    got = line_dedup.gram_counts(texts)
    assert all((got[k] == line_dedup.gram_counts(texts[k : k + 1])[0]).all() for k in range(len(texts)))
    assert got[4].max() == 255 and got[3, : line_dedup.GRAMS].sum() == 1 and got[3, line_dedup.GRAMS :].sum() == 3


def test_many_pairs_at_once_equal_one_diagonal_each(monkeypatch):
    """unlike pairs were told apart one by one."""
    monkeypatch.setattr(line_dedup, "FEW", 0)
    rng = random.Random(4)
    pairs, most = [], []
    for k in range(1500):
        a = "".join(rng.choices("ab c" if k % 3 else "abcdefgé日 ", k=rng.randint(1, 500 if k % 9 else 1500)))
        b = list(a if k % 5 else "".join(rng.choices("ab c", k=len(a))))
        for _ in range(rng.randint(0, max(1, len(a) // 3))):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b "])
        b = "".join(b)
        m = int(0.2 * max(len(a), len(b)) + 1e-9)
        if abs(len(a) - len(b)) <= m:
            pairs.append((a, b))
            most.append(m)
    assert len(pairs) > 1000
    whole, looked = line_dedup.unlike(pairs, np.array(most), True)
    want = [line_dedup.diagonal(*sorted(p, key=len, reverse=True), m) > m for p, m in zip(pairs, most)]
    lead, also = line_dedup.unlike(pairs, np.array(most))
    assert looked.sum() > 1000 and whole[looked].tolist() == np.array(want)[looked].tolist() and not whole[~looked].any()
    begun = [line_dedup.diagonal(a[: 2 * m + 8 + len(a) - len(b)], b[: 2 * m + 8], m) > m for (a, b), m in zip([sorted(p, key=len, reverse=True) for p in pairs], most)]
    assert lead[also].tolist() == np.array(begun)[also].tolist()


def test_majorities_of_cells_equal_counting_bits():
    rng = np.random.RandomState(2)
    hashes, count, more = rng.randint(0, 2**63, 400).astype(np.uint64) * np.uint64(2), rng.randint(0, 40, 60), rng.randint(0, 5, 60)
    first, after = rng.randint(0, 300, 60), rng.randint(0, 300, 60)
    cells = [[*hashes[f : f + c].tolist(), *hashes[g : g + d].tolist()] for f, c, g, d in zip(first, count, after, more)]
    want = [sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in c) > len(c)) for c in cells]
    assert line_dedup.majorities([(hashes, first, count), (hashes, after, more)]).tolist() == want
    own = [(c, k, j) for c in range(60) for k in range(count[c]) for j in range(k)]
    of, u, v = (np.array(x) for x in zip(*own))
    left = [[*hashes[first[c] : first[c] + count[c]].tolist()] for c, _, _ in own]
    for x, (c, k, j) in zip(left, own):
        del x[k], x[j]
    want = [sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in c) > len(c)) for c in left[:2000]]
    got = line_dedup.majorities([(hashes, first[of], count[of])], (hashes[first[of] + u], hashes[first[of] + v]))
    assert got[:2000].tolist() == want


@pytest.mark.parametrize("dealt", [1 << 19, 50])
def test_buckets_are_the_shared_blocks(spark, monkeypatch, dealt):
    """every block of every line was dealt out twice as a row of its own and grouped."""
    monkeypatch.setattr(line_dedup, "DEALT", dealt)
    rng = random.Random(6)
    rows = [(n, sorted({rng.choice([rng.randint(0, 40), rng.randint(-(2**63), 2**63 - 1)]) for _ in range(rng.randint(0, 6))} | ({-7, -8} if n % 9 == 0 else set()))) for n in range(120)]
    lines = {}
    for n, keys in rows:
        for k in keys:
            lines.setdefault(k, set()).add(n)
    first = {}
    for k in sorted(lines):
        if len(lines[k]) > 1:
            first.setdefault(frozenset(lines[k]), k)
    d = spark.createDataFrame(rows, "node long, keys array<long>")
    assert sorted(map(tuple, line_dedup.buckets(d).collect())) == sorted((k, n, len(s)) for s, k in first.items() for n in s)
    assert line_dedup.buckets(d.limit(0)).count() == 0
