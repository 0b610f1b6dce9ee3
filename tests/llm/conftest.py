import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, ids string, tile int, size string, fp double"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, near copies, clashing extra columns."""
    rng = random.Random(11)
    base = [words(rng, rng.randint(20, 90)) for _ in range(24)]
    texts = [None, "", " \n\t ", "one", "two words\nhere"] + base + base[:6] + [b + " tail" for b in base[6:10]] + [words(rng, 20_000)]
    texts += ["\n".join([base[0], base[1], "Short.", base[2].upper() + "!"]), "ÉTÉ ΣΑΣ 中文 \u0000x", base[3].replace(" ", "  ")]
    rows = [(k, t, [None, "en", "fr"][k % 3], [None, "web", "book", "web"][k % 4], len(t or ""), "x", "y", k, "z", 0.5) for k, t in enumerate(texts)]
    rows += [rows[8], rows[8], (None, base[5], None, None, None, None, None, None, None, None), (rows[9][0], base[12], "en", "web", 1, "x", "y", 1, "z", 1.0)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def reach(nodes, links):
    """Smallest node reachable from each node."""
    label = {n: n for n in nodes}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                moved = True
    return label
