import hashlib
import random
import zlib

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sieveline.llm import bpe, token_codes

from ..conftest import SF

ODD = "aAéÉ́ΣσςİßÅ'sT'RE \n\t \x1c\x85 中文字한국12½²_-🙂‍\x00x  . "


def odd_texts(n, seed):
    rng = random.Random(seed)
    out = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    out += ["".join(rng.choice("abcdeinrst") for _ in range(rng.randint(1, 60))) for _ in range(n)]
    return out + ["", "a" * 5000, "ab" * 3000, "x <|endoftext|> y<|startoftext|>z", "it's I'LL 'S", "<|ENDOFTEXT|>", "a  b", " a", "a ", "a \n b", "\n\n x"]


def test_bpe_equals_the_library():
    path = bpe.vocabulary()
    own, lib = bpe.BacktrackingBpe(path), Tokenizer.from_file(path)
    for t in odd_texts(1500, 1):
        ids = lib.encode(t, add_special_tokens=False).ids
        got = np.frombuffer(own.encode(t), dtype="<u4")
        assert got.tolist() == ids, t
        assert own.decode(got.astype(np.int64)).decode() == lib.decode(ids, skip_special_tokens=False), t


def test_bpe_query(spark):
    lib = Tokenizer.from_file(bpe.vocabulary())
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    got = bpe.query(spark, SF).toPandas().set_index("doc_id")
    for d, t in zip(docs.doc_id, docs.text):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        r = got.loc[d]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_of_odd_documents(spark, odd_docs, no_docs):
    out = bpe.encode(odd_docs, bpe.vocabulary())
    assert out.count() == odd_docs.count() and "ids_" in out.columns and "decoded" in out.columns
    assert bpe.digests(odd_docs, bpe.vocabulary()).where("n_tokens = 0").count() >= 3
    assert bpe.digests(no_docs, bpe.vocabulary()).count() == 0


@pytest.mark.parametrize("most", [200, 300, 70_000, 2**32])
def test_codes_round_trip(most):
    rng = np.random.RandomState(most % 1000)
    for n in (0, 1, 511, 512, 513, 3000):
        x = rng.randint(0, most, n, dtype=np.int64).astype(np.uint32)
        c = token_codes.Codes(token_codes.pack(x))
        assert len(c) == n and (c.slice(0, n) == x).all()
        for i in rng.randint(0, n, 20) if n else ():
            j = rng.randint(i, n + 1)
            assert c[int(i)] == x[i] and (c.slice(int(i), int(j)) == x[i:j]).all()


def test_piece_encoder_equals_the_library():
    path = token_codes.vocabulary()
    own, lib = token_codes.Encoder(path), Tokenizer.from_file(path)
    texts = odd_texts(1500, 2)
    for t, got in zip(texts, own.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_pieces_go_to_the_library_as_lines(monkeypatch):
    own, lib = token_codes.Encoder(token_codes.vocabulary()), Tokenizer.from_file(token_codes.vocabulary())
    given, real = [], own._library
    monkeypatch.setattr(own, "_library", lambda texts: given.extend(texts) or real(texts))
    words = [f"w{k}x{k * k}" for k in range(3000)]
    texts = ["\n".join(" ".join(words[k : k + 50]) for k in range(a, a + 500, 50)) for a in range(0, 2500, 250)]
    for _ in range(2):  # one call for each of the 3000 words before
        for t, got in zip(texts, own.encode(texts)):
            assert np.frombuffer(got, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids
    assert len(given) < 30 and sum(t.count("w") for t in given) < 3100


def test_line_ends_and_odd_white_space(monkeypatch):
    monkeypatch.setattr(token_codes, "CACHE", 40)
    own, lib = token_codes.Encoder(token_codes.vocabulary()), Tokenizer.from_file(token_codes.vocabulary())
    rng = random.Random(8)
    parts = ["\n", " ", "\n", " ", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", "\u2028", "\u3000", "\u200b", "\ufeff", "a", "Be", "'s", ".", "1", "é", "<|endoftext|>", "<|", "中"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(6000)] + ["a\n\tb", "a\n\xa0", "a\t\nb c\nd", "\n", " ", "a" * 70 + "\nb"]
    for at in range(0, len(texts), 500):
        for t, got in zip(texts[at : at + 500], own.encode(texts[at : at + 500])):
            assert np.frombuffer(got, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)
    assert own.encode([]) == [] and own.encode([""]) == [b""]


def test_a_full_table_of_pairs_is_emptied(monkeypatch):
    from sieveline.llm import bpe

    monkeypatch.setattr(bpe, "CACHE", 50)
    own, lib = bpe.BacktrackingBpe(bpe.vocabulary()), Tokenizer.from_file(bpe.vocabulary())
    for t in odd_texts(300, 5):
        assert np.frombuffer(own.encode(t), "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t
    assert len(own.fits) <= 50


def test_codes_query(spark, monkeypatch):
    monkeypatch.setattr(token_codes, "SEGMENT", 5000)
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().sort_values("doc_id")
    got, start = token_codes.query(spark, SF).toPandas().set_index("doc_id"), 0
    for d, t in zip(docs.doc_id, docs.text):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        r = got.loc[d]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_codes_of_odd_documents(spark, odd_docs, no_docs, tmp_path):
    token_codes.write_codes(odd_docs, token_codes.vocabulary(), str(tmp_path / "codes"))
    got = token_codes.read_codes(spark.read.parquet(str(tmp_path / "codes"))).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n")).orderBy("start").collect()
    assert len(got) == odd_docs.count() and got[0]["doc_id"] is None and all(a["start"] + a["n"] == b["start"] for a, b in zip(got, got[1:]))
    ids = [r["doc_id"] for r in got[1:]]
    assert ids == sorted(ids)
    token_codes.write_codes(no_docs, token_codes.vocabulary(), str(tmp_path / "none"))
    assert token_codes.read_codes(spark.read.schema(token_codes.SCHEMA).parquet(str(tmp_path / "none"))).count() == 0
