"""The grammar against a plain reading of it, its factors, learned words, held-out accuracy, odd rows."""

import random
import re
import zlib

import numpy as np
import pytest

from loomgraph.llm import toxicity
from loomgraph.llm.common import table
from loomgraph.llm.toxicity import INSULTS, NEGATIONS, REACH, REPORTS, TARGETS, THREATS, find_clauses, lexicon


def arrays(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def plain(text):
    """Scores of the clauses of one text, word by word."""
    kinds = {w: k for k, words in (("T", TARGETS), ("N", NEGATIONS), ("R", REPORTS), ("H", THREATS), ("I", INSULTS)) for w in words}
    scores = []
    for clause in re.split(r"[.!?;:\n]", text):
        marks, number = [], 0
        for m in re.finditer(r"[0-9a-z'\u0080-\U0010ffff]+|\"", clause.lower()):
            if m.group() == '"':
                marks.append(("Q", None))
                continue
            number += 1
            if m.group() in kinds:
                marks.append((kinds[m.group()], number))
        if not any(k in "IH" for k, _ in marks):
            continue
        total = 0.0
        for at, (kind, n) in enumerate(marks):
            if kind not in "IH":
                continue
            negations = reported = 0
            last = None
            for k, m in marks[:at]:
                if m is not None:
                    if last is not None and m - last > REACH + 1:
                        negations = 0
                    last = m
                negations += k == "N"
                reported = 1 if k == "R" else 1 - reported if k == "Q" else reported
            if last is not None and n - last > REACH + 1:
                negations = 0

            def reaches(side):
                here = n
                for k, m in side:
                    if m is None:
                        continue
                    if abs(m - here) > REACH + 1:
                        return False
                    if k == "T":
                        return True
                    here = m
                return False

            aimed = reaches(marks[:at][::-1]) or reaches(marks[at + 1 :])
            weight = toxicity.SEED_WEIGHT if kind == "I" else toxicity.THREAT_WEIGHT
            weight *= toxicity.NEGATED if negations % 2 else 1
            weight *= toxicity.REPORTED if reported else 1
            total += weight * (1 if aimed else toxicity.UNAIMED if kind == "I" else toxicity.UNAIMED_THREAT)
        scores.append(round(total, 9))
    return scores


def test_like_a_plain_reading():
    rng = random.Random(11)
    words = ["idiot", "kill", "you", "not", "said", '"', "word", "word", "word", "word", ".", "\n", "dumm", "él", "!"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 4, 30, 200]))) for _ in range(400)]
    found, n_words = find_clauses(*arrays(texts), lexicon())
    for k, t in enumerate(texts):
        assert np.round(found.score[found.row == k], 9).tolist() == plain(t), t
        assert n_words[k] == len(re.findall(r"[a-zé]+", t))


def one(text):
    found, _ = find_clauses(*arrays([text]), lexicon())
    return round(float(found.score.sum()), 3)


def test_factors():
    assert one("You are an idiot.") == 3.0
    assert one("An idiot, really.") == 2.4
    assert one("You are not an idiot.") == 0.6
    assert one("She said you are an idiot.") == 0.9
    assert one('"idiot" is what you wrote') == 0.9
    assert one("“Idiot” you.") == 0.9
    assert one("I will kill you") == 1.5 and one("kill the process") == 0.15
    assert one("You. Idiot.") == 2.4
    assert one("DÉBILE, tu es") == 3.0
    assert one("nothing here; you said not") == 0.0
    assert one("") == 0.0


def test_pieces_of_a_long_text(monkeypatch):
    text = "you are an idiot and not a fool, " * 5_000 + "x" * 3_000_000 + " scum."
    whole = one(text)
    monkeypatch.setattr(toxicity, "tokens", lambda *a: __import__("loomgraph.llm.tokens", fromlist=["tokens"]).tokens(*a[:4], 5_000))
    assert one(text) == whole


@pytest.fixture(scope="module")
def sf01(spark):
    return table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")


def test_held_out_labels(sf01):
    docs, labels = sf01
    rated = toxicity.rate(docs, labels).toPandas()
    assert len(rated) == docs.count() and rated["score"].between(0, 1).all()
    assert (rated["predicted"] == (rated["score"] >= 0.5)).all()
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(rated["doc_id"], rated["held_out"], strict=True))
    known = rated[rated["held_out"]].merge(labels.toPandas(), on="doc_id")
    bad = known["toxic"] == 1
    assert known[bad]["predicted"].mean() >= 0.85 and known[~bad]["predicted"].mean() <= 0.005


def test_learned_words_and_odd_rows(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(300):
        toxic = i % 3 == 0
        words = [rng.choice(["red", "green", "blue", "grey", f"w{i}"]) for _ in range(30)]
        if toxic:
            words[5] = words[20] = rng.choice(["blurg", "Zonk"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    # A thousand copies of one toxic text must not make its innocent words telling.
    rows += [(1000 + i, "blurg orchid tulip daisy rose") for i in range(1000)]
    labels += [(1000 + i, 1) for i in range(1000)] + [(0, 0), (None, 1), (5, None)]
    rows += [(5000, "An orchid tulip daisy."), (5001, "You zonk!"), (5002, None), (5003, ""), (None, "you blurg"), (5001, "You zonk!"), (5004, "blurg " * 400_000)]
    docs = spark.createDataFrame([(i, t, 1, 0.5) for i, t in rows], "doc_id long, text string, toxic int, score double")
    rated = {}
    for r in toxicity.rate(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect():
        rated.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, rated.values())) == len(rows)
    assert [rated[k][0].predicted for k in (5000, 5001, 5002, 5003, None, 5004)] == [0, 1, 0, 0, 1, 1]
    assert len(rated[5001]) == 2 and rated[None][0].held_out is False and 0 <= rated[5002][0].score < 0.5
    found = toxicity.clauses(docs.filter("doc_id = 5001").limit(1), lexicon(toxicity.learn_words(toxicity.labelled(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))))).collect()
    assert [(r.at_byte, r.clause, r.matches) for r in found] == [(4, "zonk", 1)]


def test_without_labels_and_rows(spark, sf01):
    docs = spark.createDataFrame([(1, "You are an idiot, a pathetic loser and scum."), (2, "A fine day.")], "doc_id long, text string")
    none = sf01[1].limit(0)
    assert {r.doc_id: r.predicted for r in toxicity.rate(docs, none).collect()} == {1: 1, 2: 0}
    assert toxicity.rate(docs.limit(0), sf01[1]).columns == ["doc_id", "held_out", "score", "predicted", "n_clauses"]
    assert toxicity.rate(docs.limit(0), sf01[1]).count() == 0
