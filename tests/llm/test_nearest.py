"""Recall against brute force, exact scores, equal vectors and rows that take no part."""

import math

import numpy as np

from loomgraph.llm import nearest


def test_recall_scores_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((700, 16)).astype(np.float32)
    x[100:160] = x[40]
    x[300] *= 5
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1020, [0.0] * 16), (1040, [None, *[1.0] * 15]), (1060, [math.nan, *[1.0] * 15]), (1080, [math.inf, *[1.0] * 15]), (1100, [1.0, 2.0]), (None, x[0].tolist()), (0, x[0].tolist())]
    out = nearest.neighbours(spark.createDataFrame([(i, v, 3, 0.5) for i, v in rows], "vec_id long, embedding array<float>, node int, score double"))
    found = {}
    for r in out.collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == set(range(0, 700, 20))
    hits = 0
    d = x.astype(float)
    for q, got in found.items():
        got.sort()
        scores = d @ d[q]
        want = sorted((i for i in range(700) if i != q), key=lambda i: (-round(scores[i], 9), i))[:20]
        hits += len(set(want) & {v for _, v, _ in got})
        assert [r for r, _, _ in got] == list(range(1, 21))
        assert all(abs(s - scores[v]) < 1e-9 for _, v, s in got) and [s for _, _, s in got] == sorted((s for _, _, s in got), reverse=True)
    assert hits / (20 * len(found)) >= 0.95
    # 61 equal vectors: 40 asks, and the smallest ids of the others answer.
    equal = [v for _, v, _ in found[40] if 100 <= v < 160]
    assert equal == list(range(100, 100 + len(equal)))


def test_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], schema)
    rows = sorted((r.query_id, r["rank"], r.vec_id) for r in nearest.neighbours(few).collect())
    assert rows == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 4)]
    assert nearest.neighbours(few.limit(0)).collect() == []
    assert nearest.neighbours(few.limit(1)).collect() == []


def recall(spark, x, every, k=20):
    """Share of the true neighbours that the query finds, against brute force in blocks of queries."""
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(8)
    found = {}
    for r in nearest.neighbours(rows, every, k).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    asked, hits, d = np.arange(0, len(x), every), 0, x.astype(float)
    for block in np.array_split(asked, -(-len(asked) // 500)):
        scores = d[block] @ d.T
        scores[np.arange(len(block)), block] = -np.inf
        top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        hits += sum(len(found[q] & set(t)) for q, t in zip(block.tolist(), top.tolist(), strict=True))
    return hits / (k * len(asked))


def test_one_long_vector_does_not_spoil_the_graph(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((20_000, 24)).astype(np.float32)
    x[777] *= 100
    assert recall(spark, x, 100) >= 0.9


def test_lengths_of_several_strata(spark):
    rng = np.random.default_rng(6)
    x = (rng.standard_normal((6_000, 16)) * 10 ** rng.uniform(-3, 1, (6_000, 1))).astype(np.float32)
    assert recall(spark, x, 20) >= 0.9


def test_no_job_for_each_round_and_hop(spark):
    """Graphs are built and walked inside tasks, so the number of Spark jobs does not follow rounds and hops."""
    x = np.random.default_rng(7).standard_normal((3_000, 16)).astype(np.float32)
    spark.sparkContext.setJobGroup("nearest", "")
    try:
        assert recall(spark, x, 60) >= 0.95
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.sparkContext.setLocalProperty("spark.job.description", None)
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("nearest")) <= 60


def test_shards_find_what_lies_in_other_shards(spark, monkeypatch):
    """Groups of 300 near copies are dealt over twelve shards; some vectors have no near copy."""
    monkeypatch.setattr(nearest, "LEAST", 500)
    rng = np.random.default_rng(8)
    x = np.concatenate([np.repeat(rng.standard_normal((15, 24)), 300, 0) + rng.standard_normal((4_500, 24)) * 0.02, rng.standard_normal((1_500, 24))])
    assert nearest.shards_of(len(x), 24) == 12
    assert recall(spark, rng.permutation(x).astype(np.float32), 30) >= 0.97


def test_near_copies_are_told_apart(spark):
    """Scores of near copies differ by less than single precision shows."""
    rng = np.random.default_rng(9)
    x = np.repeat(rng.standard_normal((3, 24)), 2_000, 0) + rng.standard_normal((6_000, 24)) * 1e-4
    assert recall(spark, (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32), 60) >= 0.8


def test_shards_are_bounded():
    assert [nearest.shards_of(n, 64) for n in (1, 8_192, 8_193, 100_000, 615_384, 1 << 20)] == [1, 1, 2, 12, 12, 16]
    assert nearest.shards_of(100_000, 4_095) == 25
