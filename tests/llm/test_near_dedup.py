"""Links and components against brute force over all pairs."""

import random

import pytest

from loomgraph.llm import near_dedup

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = (text or "").translate(LETTERS).replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    root = {i: i for i, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def edited(rng, words, share):
    return [rng.choice("abcdefgh") * 3 if rng.random() < share else w for w in words]


def corpus(seed, bases=6, copies=25):
    rng = random.Random(seed)
    docs, word = [], lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 6)))
    shared = [word() for _ in range(40)]
    for _ in range(bases):
        base = [word() for _ in range(rng.choice([3, 4, 5, 6, 40, 150]))]
        for _ in range(copies):
            docs.append(" ".join(edited(rng, base, rng.choice([0, 0.005, 0.02, 0.04, 0.08]))))
    docs += [" ".join(shared + [word() for _ in range(30)]) for _ in range(60)]
    docs += [None, "", " \n\t ", "one", "ONE", "one two", "One\ttwo\n", "x " * 400, "x " * 4000]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize(("group", "size"), [(2048, 1 << 23), (7, 1 << 23), (2048, 300)])
def test_matches_brute_force(spark, monkeypatch, group, size):
    monkeypatch.setattr(near_dedup, "GROUP", group)
    monkeypatch.setattr(near_dedup, "SHINGLES", size)
    for seed in (1, 2):
        docs = corpus(seed)
        frame = spark.createDataFrame([(i, t, 5, "x") for i, t in docs], "doc_id long, text string, n int, cls string")
        found = sorted(tuple(r)[:4] for r in near_dedup.link(frame).collect())
        assert found == brute(docs)


def test_a_look_alike_hides_no_link(spark):
    """Two components of a bucket look alike by one pair, whose sets differ, and are linked by another pair."""
    import numpy as np
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    one, other = (np.sort(rng.integers(0, 1 << 63, 100, dtype=np.uint64)) for _ in range(2))
    sets = {1: one, 2: one ^ np.uint64(1), 3: other, 4: np.sort(np.append(other[1:], np.uint64(5)))}
    alike, less = np.arange(64, dtype=np.uint32), np.arange(64, dtype=np.uint32)
    less[::4] += 1000
    signature = {1: alike, 2: alike, 3: less, 4: less + np.uint32(np.arange(64) % 8 == 1)}
    rest = spark.createDataFrame([(7, 0, c, 1 + (c + 1) % 2, 100) for c in sets], "bucket long, band int, cls long, root long, n long")
    bands = spark.createDataFrame([(c, bytes(s[:32].tobytes()), bytes(s[32:].tobytes())) for c, s in signature.items()], "cls long, s0 binary, s1 binary")
    full = spark.createDataFrame([(c, bytes(s.tobytes())) for c, s in sets.items()], "cls long, members binary")
    found = near_dedup.bucket_links(rest.withColumn("root", F.when(F.col("cls").isin(1, 3), 1).otherwise(2).cast("long")), bands, full)
    assert [tuple(r) for r in found.collect()] == [(3, 4)]


def test_ids(spark):
    docs = [(5, "a b c d e f"), (5, "g h i j k l"), (3, "G h i j k l"), (9, "a b c d e f"), (None, "a b c d e f"), (7, None), (7, None)]
    rows = near_dedup.link(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in rows) == sorted([(5, 3, False), (5, 3, False), (3, 3, True), (9, 3, False), (-1, None, True), (7, 7, True), (7, 7, True)])
    assert near_dedup.link(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_chain_of_links_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "x long, y long")
    found = {r.cls: r.root for r in near_dedup.components(links).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_bound_follows_the_posterior():
    # 24 of 32 matches is what similarity 0.75 predicts; a pair far below is pruned, a true pair nearly never.
    assert 8 < near_dedup.least_matches(32) < 16
    assert near_dedup.least_matches(160) > 80
