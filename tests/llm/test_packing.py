import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from sieveline.llm import packing

from ..conftest import SF
from .test_tokens import odd_texts


def used(patterns, size):
    got = np.zeros(size + 1, dtype=np.int64)
    for made, times in patterns:
        assert 0 < sum(made) <= size and times > 0
        np.add.at(got, made, times)
    return got


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_in_few_sequences(seed):
    rng = np.random.default_rng(seed)
    size = 512
    lengths = [rng.integers(1, size + 1, 3000), np.clip(rng.lognormal(3, 1, 9000).astype(int), 1, size), rng.integers(1, 9, 5000), np.full(700, 171)][seed]
    counts = np.bincount(lengths, minlength=size + 1)
    patterns = packing.plan(counts)
    assert (used(patterns, size) == counts).all()
    bins, least = sum(t for _, t in patterns), max(-(-int(lengths.sum()) // size), int((lengths > size // 2).sum()))
    assert bins <= {0: least * 1.03, 1: least + 1, 2: least, 3: 350}[seed]


def test_exact_complements_come_first():
    counts = np.zeros(101, dtype=np.int64)
    counts[[70, 30, 60, 25, 15, 50, 20, 5]] = [5, 5, 3, 3, 3, 4, 2, 1]
    patterns = packing.plan(counts)
    assert sum(t for made, t in patterns if sum(made) == 100) == 10 and (used(patterns, 100) == counts).all()


def test_encoder_equals_the_library(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 200)
    path = packing.vocabulary()
    own, lib = packing.Encoder(path), Tokenizer.from_file(path)
    texts = [t + tail for t in odd_texts(800, 4) for tail in ("", ".", "!?", "…. a's, É. x×. 3; <|endoftext|>! ª. ")]
    for at in range(0, len(texts), 50):
        part = texts[at : at + 50]
        for t, got in zip(part, own.encode([t.encode() for t in part])):
            assert np.frombuffer(got, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_units_of_one_hash_are_told_apart():
    raw = b"\nab cd ab, cd. ab!? x.y \n"
    buf = np.frombuffer(raw, dtype=np.uint8)
    start, end = packing.units(buf)
    pieces = [raw[a:b] for a, b in zip(start, end)]
    assert pieces == [b"ab", b"cd", b"ab", b",", b"cd", b".", b"ab", b"!?", b"x", b".y"]
    for ids in (np.zeros(len(start), np.uint64), np.arange(len(start)).astype(np.uint64)[[0, 1, 0, 3, 1, 5, 0, 7, 8, 9]]):
        one, kind = packing.distinct(buf, start, end, ids)
        assert [pieces[one[k]] for k in kind] == pieces and len(one) == 7


def test_nothing_to_plan():
    assert packing.plan(np.zeros(10, dtype=np.int64)) == [] and len(packing.ranges([])) == 0


def whole(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_packing_query(spark):
    lib = Tokenizer.from_file(packing.vocabulary())
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got, total = packing.query(spark, SF).collect(), 0
    by = {(r["doc_id"], r["piece"]): r for r in got}
    assert len(by) == len(got)
    for d, t in docs.items():
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        for k in range(-(-len(ids) // 4096)):
            r, part = by.pop((d, k)), ids[4096 * k : 4096 * (k + 1)]
            assert (r["start"], r["length"], r["ids_crc32"]) == (4096 * k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert not by and whole(got, 4096) <= -(-total // 4096) + 1


def test_sequences_of_odd_documents(spark, odd_docs, no_docs):
    path, size = packing.vocabulary(), 64
    cut, places = packing.pack(odd_docs, path, size)
    rows = places.collect()
    assert len(rows) == cut.count() and sum(r["doc_id"] is None for r in rows) > 0 and whole(rows, size) > 10
    out = packing.sequences(odd_docs, path, size).collect()
    assert all(len(r["ids"]) == 4 * r["length"] == 4 * sum(d["length"] for d in r["documents"]) for r in out)
    assert sum(r["length"] for r in out) == sum(r["length"] for r in rows)
    tail = sum(np.frombuffer(r["ids"], "<u4").tolist().count(1) for r in out)
    assert tail >= odd_docs.count()
    assert packing.pack(no_docs, path)[1].count() == 0 and packing.sequences(no_docs, path).count() == 0
