"""Base counts against a plain version; the estimate on simulated votes."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from loomgraph.llm import quality_rules as q


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered.update((i, i + 1, i + 2))
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in q.SYMBOLS), dups, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_counts_match_a_plain_version(spark):
    rng = random.Random(3)
    words = ["a", "bé", "C#", "|", "日本", "x\u00a0y", "*", "the", "the"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "\n", "\t", "  ", "\n\n", "\x0b"]) for _ in range(rng.randint(0, 120))) for _ in range(120)]
    texts += [None, "", " ", "\n", "\n\n", "a", "a\n", "\na", "a b c " * 5_000, "z" * 3_000_000 + " q", "w " * 1_300_000]
    docs = spark.createDataFrame([(i, t, 1, True) for i, t in enumerate(texts)], "doc_id long, text string, n_words int, kept boolean")
    rows = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in q.judge(docs).collect()}
    assert rows == {i: plain(t) for i, t in enumerate(texts)}


def test_estimate_finds_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.8
    accuracies, votes = [0.95, 0.9, 0.8, 0.75], []
    for a in accuracies:
        right, cast = rng.random(len(truth)) < a, rng.random(len(truth)) < 0.7
        votes.append(np.where(cast, np.where(right == truth, q.GOOD, q.BAD), q.ABSTAIN))
    patterns = sorted(Counter(zip(*[v.tolist() for v in votes], strict=True)).items())
    good, found = q.estimate(patterns)
    assert np.all(np.diff(found) < 0) and abs(found[0] - accuracies[0]) < 0.05
    assert 0.5 < good < 0.85


def test_posterior_is_what_the_estimate_says(spark):
    right = np.array([0.9, 0.7])
    row = spark.range(1).select(q.posterior([F.lit(q.GOOD), F.lit(q.BAD)], 0.6, right).alias("p")).first()
    odds = 0.6 / 0.4 * 9 * (0.3 / 0.7)
    assert abs(row.p - odds / (1 + odds)) < 1e-12


def test_junk_goes_and_prose_stays(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 7)))
    good = [(i, " ".join(word() for _ in range(80))) for i in range(60)]
    junk = [(100 + i, " ".join(word() + "###" for _ in range(80))) for i in range(5)] + [(200 + i, " ".join(word().upper() + "!!" for _ in range(80))) for i in range(5)]
    docs = spark.createDataFrame(good + junk + [(300, None)], "doc_id long, text string")
    kept = {r.doc_id for r in q.keep_good(docs).collect()}
    assert kept == {i for i, _ in good}


def test_rows_without_id_and_texts_under_one_id_are_judged_each(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 7)))
    good = [(i, " ".join(word() for _ in range(80)), "x") for i in range(40)] + [(None, " ".join(word() for _ in range(80)), "x") for _ in range(5)]
    junk = [(i, " ".join(word() + "###" for _ in range(80)), "x") for i in (0, 1, None, None)] + [(2, None, "x"), (None, "", "x")]
    docs = spark.createDataFrame(good + junk + good[-1:], "doc_id long, text string, lang string")
    kept = q.keep_good(docs)
    assert kept.columns == docs.columns
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, kept.collect()), key=key) == sorted(good + good[-1:], key=key)


def test_empty_table(spark):
    assert q.judge(spark.createDataFrame([], "doc_id long, text string")).collect() == []
