"""Ranked search against a plain computation: ties, copies, nulls, blocks of items, bags with and without vocabulary."""

import math
import random
import re

import numpy as np
import pytest

from loomgraph.llm import lexical
from loomgraph.llm.tokens import ASCII_LOWER, TERM, tokens

TERMS = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERMS.findall(lowered)


def plain(items, docs, top=10):
    bags = [(doc_id, terms_of(text)) for doc_id, text in docs]
    bags = [(d, t) for d, t in bags if t]
    n_docs, n_terms = len(bags), sum(len(t) for _, t in bags)
    df = {}
    for _, t in bags:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms_of(text))
    out = []
    for item, words in wanted.items():
        scored = []
        for d, t in bags:
            m = 10 + (90 * len(t) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * t.count(w)) // (1000 * t.count(w) + 8 * m)) for w in words if w in t)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(12)
    words = ["alpha", "Beta", "gamma", "delta", "Épsilon", "épsilon", "日本", "x1", "the", "of"]
    docs = [(i, " ".join(rng.choice(words) + rng.choice(["", ".", ",\n"]) for _ in range(rng.choice([1, 2, 5, 40])))) for i in range(150)]
    docs += [(1000 - i, "alpha, beta the same") for i in range(40)] + [(None, "alpha, beta the same"), (None, None), (7, "gamma"), (7, "gamma"), (500, ""), (501, "...")]
    docs += [(600, "word " * 300_000 + "x1"), (601, "a" * 400_000)]
    items = [(i, " ".join(rng.sample(words, rng.randint(1, 5)))) for i in range(12)] + [(50, None), (51, ""), (52, "nowhere"), (1, "the more"), (None, "alpha"), (3, None)]
    return items, docs


def frames(spark, tables):
    items, docs = tables
    return (spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int"),
            spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, rank int, terms string").repartition(5))


@pytest.mark.parametrize("limits", [{}, {"vocabulary_limit": 0}, {"pairs": 4}])
def test_like_a_plain_ranking(spark, tables, limits):
    found = [tuple(r) for r in lexical.search(*frames(spark, tables), **limits).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(found, key=repr) == plain(*tables)


def test_copies_are_one_class(spark, tables):
    _, docs = frames(spark, tables)
    bagged = lexical.bags(docs, None)
    rows = [r for r in lexical.classes(bagged, 190, 10**6, 10).collect() if len(r.terms) == 4 and len(r.members) == 10]
    assert [r.members for r in rows if r.members[0] == 961] == [list(range(961, 971))]


def test_empty_tables(spark, tables):
    items, docs = frames(spark, tables)
    assert lexical.search(items.limit(0), docs).count() == 0
    assert lexical.search(items, docs.limit(0)).count() == 0
    assert lexical.search(items, docs.filter("doc_id = 500")).schema.simpleString() == "struct<item_id:bigint,rank:int,doc_id:bigint,score:bigint>"


def test_pieces_do_not_matter():
    rng = random.Random(3)
    rows = ["".join(rng.choice("ab É.\n日") for _ in range(rng.randint(0, 60))) for _ in range(50)]
    raw = [r.encode() for r in rows]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    whole = list(tokens(data, offsets, TERM, ASCII_LOWER))[0]
    for step in (1, 7, 64):
        parts = list(tokens(data, offsets, TERM, ASCII_LOWER, step))
        for k in range(4):
            assert np.concatenate([p[k] for p in parts]).tolist() == whole[k].tolist()
    found = [bytes(data[a:b]).decode() for a, b in zip(whole.start, whole.end, strict=True)]
    assert found == [w for r in rows for w in re.findall("[ab日É]+", r)]
