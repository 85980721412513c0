"""The trie against a plain one; one long conversation over many ranges; subtrees too big for a shard; slots."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from loomgraph.llm import prefix_trie
from loomgraph.llm.prefix_trie import BASES, PRIME, SlotTable, accumulate, multiply, power, running


def plain(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(turns.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:])
    members, ends = {}, {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
        ends.setdefault(seq, []).append(c)
    kids = {}
    for n in members:
        if n:
            kids.setdefault(n[:-1], []).append(n)
    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        own = kids.get(n, [])
        leaves[n] = sum(leaves[k] for k in own) or 1
        saved[n] = sum(saved[k] for k in own) + ((len(members[n]) - 1) * len(n[-1][1].encode()) if n else 0)
    sha = lambda n: hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest()
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), len(kids.get(n, [])), leaves[n], saved[n], sha(n)) for n, m in members.items())


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.select(*COLUMNS).collect())


def frame(spark, rows):
    rng = random.Random(1)
    rows = rows[:]
    rng.shuffle(rows)
    return spark.createDataFrame([(*r, "x", 5) for r in rows], "conv_id long, turn long, role string, text string, part string, depth int").repartition(6)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(13)
    out = []
    for c in [*range(-4, 90), 205, 206, 1234567890123]:
        if c % 7 == 3:
            continue
        for t in range(rng.choice([1, 1, 2, 5, 9, 14])):
            out.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "user", None]), rng.choice(["a", "b", "é日", "", None])))
    out += [(None, 1, "user", "lost"), (10, 3, "user", "a"), (10, 3, "user", "a")]
    return out + [(c, t, "user", "same") for c in range(300, 360) for t in range(10)]


@pytest.mark.parametrize("shard", [prefix_trie.SHARD, 40, 0])
def test_like_a_plain_trie(spark, rows, shard):
    assert found(prefix_trie.trie(frame(spark, rows), shard=shard)) == plain(rows)


def test_long_conversation_over_ranges(spark, rows):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small ranges would be put together
    try:
        long = [(7, t, "user", f"turn {t}") for t in range(3000)] + [(5, t, "user", f"start {t}") for t in range(3)] + [(9, 1, "user", "x"), (2, 1, "user", "y")]
        scanned = prefix_trie.positions(frame(spark, long))
        assert scanned.filter("conv_id = 7").select("part").distinct().count() > 2
        assert [r.place for r in scanned.filter("conv_id = 7").orderBy("place").collect()] == list(range(1, 3001))
        assert found(prefix_trie.trie(frame(spark, long))) == plain(long)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_empty_tables(spark, rows):
    df = prefix_trie.trie(frame(spark, rows).limit(0))
    assert df.columns == COLUMNS and df.count() == 0
    assert prefix_trie.trie(frame(spark, rows).filter("conv_id is null")).count() == 0


def test_only_turnless(spark):
    c = next(c for c in range(1, 999) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    assert found(prefix_trie.trie(frame(spark, [(c, 0, "user", "gone")]))) == plain([(c, 0, "user", "gone")])


def test_arithmetic():
    rng = random.Random(4)
    a, b = ([rng.choice([0, 1, PRIME - 1, rng.randrange(PRIME)]) for _ in range(500)] for _ in range(2))
    assert multiply(np.array(a, np.uint64), np.array(b, np.uint64)).tolist() == [x * y % PRIME for x, y in zip(a, b, strict=True)]
    assert power(BASES[0], np.array([0, 1, 2, 77, 12345])).tolist() == [pow(BASES[0], e, PRIME) for e in (0, 1, 2, 77, 12345)]
    total, sums = 0, []
    for x in a:
        total = (total + x) % PRIME
        sums.append(total)
    assert running(np.array(a, np.uint64)).tolist() == sums


def test_slots():
    keys = np.unique(np.random.default_rng(5).integers(0, 1 << 62, 5000).astype(np.uint64))
    table = SlotTable(keys)
    assert sorted(table.slots(keys).tolist()) == list(range(len(keys)))
    assert (table.slots(keys + np.uint64(1 << 63)) == -1).all()
    with pytest.raises(ValueError, match="repeat"):
        SlotTable(np.array([3, 3], np.uint64))
    assert [x.tolist() for x in accumulate(np.array([1, 2, 3, 4], np.uint64), np.array([9, 1, 1, 3], np.uint64), np.array([1, 2, 2, 3]), np.array([1, 1, 1, 1]))] == [[4, 1, 2, 1]]
