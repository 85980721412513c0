"""Repeated windows against brute force over all pairs of positions."""

import hashlib
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import suffix_dedup


def brute(texts: list[str | None], width: int) -> list[tuple[int, int, int, str]]:
    data = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for d in data:
        for i in range(len(d) - width + 1):
            seen[d[i : i + width]] = seen.get(d[i : i + width], 0) + 1
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - width + 1):
            if seen[d[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, texts, width, gram):
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(texts)], "doc_id long, text string, twin string, first int")
    out = suffix_dedup.remove_repeats(docs, width, gram)
    rows = out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("s")).orderBy("doc_id").collect()
    return [tuple(r)[1:] for r in rows]


@pytest.mark.parametrize("letters,width,gram,block", [("ab", 7, 3, 1 << 19), ("abé", 12, 5, 64), ("abcdefgh", 9, 4, 40), ("a", 5, 2, 32)])
def test_matches_brute_force(spark, monkeypatch, letters, width, gram, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rng = random.Random(width)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    passage = "".join(rng.choice(letters) for _ in range(3 * width))
    texts += [passage + t for t in texts[:10]] + [t + passage[2:] for t in texts[10:15]] + texts[20:24] + [None, "", "a" * width, letters * 60]
    assert run(spark, texts, width, gram) == brute(texts, width)


def test_production_width_and_long_text(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefghij é\n") for _ in range(30_000))
    texts = [base, base[5_000:5_400], base[100:299], "x" * 199 + base[200:399], base * 3]
    assert run(spark, texts, 200, 80) == brute(texts, 200)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.digest(docs).collect() == []


def test_rows_with_one_id(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(400))
    docs = spark.createDataFrame([(1, text), (1, text), (1, text[:150]), (None, text)], "doc_id long, text string")
    rows = sorted((r.n_bytes, r.n_removed) for r in suffix_dedup.digest(docs).collect())
    assert rows == [(150, 0), (400, 400), (400, 400), (400, 400)]


def test_cutting_needs_no_array_as_long_as_a_text():
    size, step = 8_000_000, 1000
    spans = [{"first": k, "past": k + 300} for k in range(0, size, step)] + [{"first": 200, "past": 400}, {"first": 400, "past": 450}]
    kind = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["x" * size, None]), pa.array([spans, None], kind)], ["doc_id", "text", "spans"])
    tracemalloc.start()
    rows = [r for b in suffix_dedup._cut_batches(iter([batch])) for r in b.drop_columns(["kept"]).to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == [{"doc_id": 1, "n_bytes": size, "n_removed": 300 * size // step + 150, "n_spans": size // step},
                    {"doc_id": 2, "n_bytes": 0, "n_removed": 0, "n_spans": 0}]
    assert peak < 3 * size
