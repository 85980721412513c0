"""Exact token ids, whole coverage, and the dynamic programme against brute force."""

import random
import zlib
from itertools import pairwise

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomgraph.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "It's A-B c.D!! <|endoftext|> <|ENDOFTEXT|>x. <|startoftext|>y", "İstanbul ΣΑΣ. ﬁ ½½ x²", "tab\there\x0bthere\x1cx", "Café. é!!", "don't. I'LL, 'S", "日本語。 あ", "a\u0301 b.", "ß. SS! 1234.5", "x.\r\n\ry", "'s.'t a.b.", "\u200b."]


def test_ids_are_those_of_the_tokenizer():
    encoder, tokenizer = packing.WordEncoder(PATH), Tokenizer.from_file(PATH)
    rng = random.Random(2)
    texts = ODD + [" ".join(rng.choice(ODD) for _ in range(20)) for _ in range(30)]
    for t in texts:
        assert encoder.encode([t])[0].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_plain_texts_and_clashing_hashes(monkeypatch):
    rng = random.Random(5)
    tokenizer = Tokenizer.from_file(PATH)
    words = ["The", "ÉTÉ", "straße", "naïve", "x9y", "12", "a.b", "1,5", ".", ",", "Ünited.", "a" * 40, "÷", "it's", "日本", "\n", ". ."]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "\n", ""]) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]

    def check():
        ids, counts, _ = packing.WordEncoder(PATH).encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want

    check()
    monkeypatch.setattr(packing, "mix", lambda x: x & np.uint64(3))  # nearly all words share a hash
    check()


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    encoder, tokenizer = packing.WordEncoder(PATH), Tokenizer.from_file(PATH)
    for t in ["one two three four", "five six seven eight nine ten eleven", "one two five"]:
        assert encoder.encode([t])[0].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def cost(cuts, fee, size):
    return sum(size - (b - a) for a, b in pairwise(cuts)) + sum(fee[c] for c in cuts[1:])


def test_cuts_cost_least():
    rng = random.Random(4)
    for _ in range(60):
        size, at, ends = 10, 0, []
        while len(ends) < 11:
            at += rng.randint(1, 6)
            ends.append(at)
        fee = {e: rng.choice([0, 2, 5]) for e in ends}
        found = packing.best_cuts(np.array(ends), np.array([fee[e] for e in ends]), size)
        options = []
        for mask in range(1 << (len(ends) - 1)):
            cuts = [0, *[e for k, e in enumerate(ends[:-1]) if mask >> k & 1], ends[-1]]
            if all(b - a <= size for a, b in pairwise(cuts)):
                options.append(cost(cuts, fee, size))
        assert found[0] == 0 and found[-1] == ends[-1] and all(b - a <= size for a, b in pairwise(found))
        assert cost(found, fee, size) == min(options)


def test_last_window():
    assert packing.last_cuts(10, 10 + 1536, 2048) == [10 + 1024, 10 + 1536]
    assert packing.last_cuts(0, 2047, 2048) == [2047]


@pytest.mark.parametrize("size", [64, 2048])
def test_every_id_lies_in_one_piece(spark, monkeypatch, size):
    rng = random.Random(size)
    texts = [" ".join(rng.choice(["alpha", "beta.", "Gamma!", "x", "long-winded", "9"]) for _ in range(rng.choice([0, 1, 5, 50, 900]))) for _ in range(60)]
    texts += [None, "", "word " * 9_000, "a. " * 3_000, *ODD]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)] + [(None, "no id", 1, 2)], "doc_id long, text string, offset int, start int")
    pieces = packing.pack(docs, PATH, size).collect()
    tokenizer = Tokenizer.from_file(PATH)
    windows = {}
    for p in pieces:
        windows.setdefault(p.sequence_id, []).append(p)
    for w in windows.values():
        at = 0
        for p in sorted(w, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= size
    for i, t in [*enumerate(texts), (None, "no id")]:
        ids, at = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for p in sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)


def test_little_padding(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice(["alpha", "beta.", "gamma", "delta"]) for _ in range(rng.randint(1, 800)))) for i in range(400)]
    pieces = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), PATH).collect()
    total, lengths = sum(p.length for p in pieces), {}
    for p in pieces:
        lengths[p.sequence_id] = lengths.get(p.sequence_id, 0) + p.length
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in lengths.values())
    assert padding < 0.02 * total


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_many_rows_without_id(spark):
    docs = spark.createDataFrame([(None, f"text {i} of many") for i in range(1000)] + [(5, f"other {i}") for i in range(1000)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pieces = packing.pack(docs.repartition(8), PATH).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for name in (None, 5):
        ranges = {p.sequence_id >> 40 for p in pieces if p.doc_id == name}
        assert len(ranges) > 1
    whole = Tokenizer.from_file(PATH)
    assert sum(p.length for p in pieces) == sum(len(whole.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.collect())


def test_pieces_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 50)
    data, offsets = packing.utf8_rows(packing.pa.array(["short", "one two three " * 40 + "z" * 300, "", None, "last one"]))
    parts = list(packing._cut_rows(data, offsets))
    assert b"".join(p[2].tobytes() for p in parts) == data.tobytes()
    assert sorted({p[0] + k for p in parts for k in range(p[1])}) == [0, 1, 2, 3, 4]
    assert all(p[2][0] in (32, 10) for q, p in zip(parts, parts[1:], strict=False) if p[0] == q[0] == 1)
