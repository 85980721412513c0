"""Language shares against a plain estimation, held-out accuracy; rates against their targets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import language_id as lid
from loomgraph.llm import mixing

SYLLABLES = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "er"], "cc": ["ción", "que", "ado"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_held_out_accuracy_and_odd_texts(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang := rng.choice("abc") * 2, rng.randint(3, 60)), lang, 0.5) for i in range(400)]
    odd = [(1000, None, "aa", 0.1), (1001, "", "aa", 0.1), (1002, "12 !? 3", "bb", 0.1), (1003, "ungschungerer", None, 0.1), (None, "kaloka mimi", "aa", 0.1), (1004, "é" * 200_000, None, 0.2)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score double")
    out = {r.doc_id: r for r in lid.identify(docs).collect()}
    assert len(out) == len(rows) + len(odd)
    held = [(out[i].lang_pred, lang) for i, _, lang, _ in rows if out[i].held_out]
    assert len(held) > 40 and np.mean([a == b for a, b in held]) > 0.97
    assert [out[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and out[1003].lang_pred == "bb" and not out[None].held_out
    assert all(0 <= r.score <= 1 for r in out.values())


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in lid.identify(docs).collect()] == [("und", 0.0)]
    assert lid.identify(docs.limit(0)).collect() == []


def test_mixture_matches_a_plain_estimation():
    rng = np.random.default_rng(3)
    table = np.log(rng.dirichlet(np.ones(lid.BUCKETS), 3))
    for shares in ([1, 0, 0], [0.5, 0.5, 0], [0.2, 0.3, 0.5]):
        drawn = np.concatenate([rng.choice(lid.BUCKETS, int(600 * s), p=np.exp(table[k])) for k, s in enumerate(shares)])
        found, p = np.zeros(3), np.full(3, 1 / 3)
        for _ in range(lid.ROUNDS):
            part = p * np.exp(table[:, drawn].T)
            p = (part / part.sum(1, keepdims=True)).mean(0)
        best, score, _ = lid.infer(*np.unique(drawn, return_counts=True), 1, table)
        assert best[0] == p.argmax() and abs(score[0] - p[best[0]]) < 1e-9


def plain_set(counts, density):
    """Shares within the chosen set of one text, language by language."""
    def estimate(p):
        for _ in range(lid.ROUNDS):
            new = [0.0] * len(p)
            for b, w in counts.items():
                mass = [p[k] * density[k][b] for k in range(len(p))]
                for k, m in enumerate(mass):
                    new[k] += w * m / sum(mass)
            p = [x / sum(counts.values()) for x in new]
        return p, sum(w * np.log(sum(p[k] * density[k][b] for k in range(len(p)))) for b, w in counts.items())

    n = len(density)
    price = lid.PRICE * np.log(sum(counts.values()) + 1)
    alone = [sum(w * np.log(d[b]) for b, w in counts.items()) for d in density]
    shares, fit = estimate([1 / n] * n)
    if fit - price <= max(alone):
        return [float(k == int(np.argmax(alone))) for k in range(n)]
    have = fit - n * price
    for size in range(n - 1, 0, -1):
        least = min((k for k in range(n) if shares[k] > 0), key=lambda k: shares[k])
        rest = [0 if k == least else x for k, x in enumerate(shares)]
        smaller, fit = estimate([x / sum(rest) for x in rest])
        if fit - size * price < have:
            break
        shares, have = smaller, fit - size * price
    return shares


def test_chosen_set_matches_a_plain_selection():
    rng = np.random.default_rng(8)
    density = rng.dirichlet(np.full(lid.BUCKETS, 0.3), 4) + 1e-9
    table = np.log(density / density.sum(1, keepdims=True))
    texts = []
    for shares in ([1, 0, 0, 0], [0.5, 0.5, 0, 0], [0, 0.1, 0.9, 0], [0.3, 0.3, 0, 0.4], [0.02, 0.98, 0, 0]):
        for size in (3, 40, 400):
            texts.append(np.concatenate([rng.choice(lid.BUCKETS, int(np.ceil(size * s)), p=np.exp(table[k])) for k, s in enumerate(shares)]))
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    _, _, within = lid.infer(*np.unique(row * lid.BUCKETS + np.concatenate(texts), return_counts=True), len(texts), table)
    for t, found in zip(texts, within):
        buckets, counts = np.unique(t, return_counts=True)
        want = plain_set(dict(zip(buckets.tolist(), counts.tolist())), np.exp(table).tolist())
        assert np.allclose(found, want, atol=1e-6) and np.array_equal(found > 1e-9, np.array(want) > 1e-9)


def test_two_languages_in_one_text(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, lang := rng.choice("abc") * 2, 60), lang) for i in range(300)]
    rows += [(900, prose(rng, "aa", 200) + "\n" + prose(rng, "bb", 200), None), (901, prose(rng, "cc", 300), None), (902, "7", None)]
    out = {r.doc_id: r for r in lid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert {x.lang for x in out[900].languages} == {"aa", "bb"} and min(x.share for x in out[900].languages) > 0.25
    assert [x.lang for x in out[901].languages] == ["cc"] and out[902].languages == []
    for r in out.values():
        assert r.lang_pred == (r.languages[0].lang if r.languages else "und")
        assert not r.languages or abs(sum(x.share for x in r.languages) - 1) < 1e-6


def test_stretches_count_like_whole_texts():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abÄß .,\n7İΣ") for _ in range(n)) for n in (0, 1, 5, 6, 7, 50, 333)] + ["." * 40, "q" * 41]
    for chars in (1, 2, 5, 7, 1000):
        bucket, row = lid.trigrams(texts)
        want = np.unique(row * lid.BUCKETS + bucket, return_counts=True)
        found = lid.entries(texts, chars)
        assert np.array_equal(found[0], want[0]) and np.array_equal(found[1], want[1])


def corpus(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(300):
        kind = ["clean", "clean", "clean", "low", "toxic"][i % 5]
        words = [rng.choice(SYLLABLES["aa"]) + rng.choice(SYLLABLES["bb"]) + rng.choice("xyz") for _ in range(60)]
        if kind == "low":
            words = [w + "%%%" for w in words]
        if kind == "toxic":
            words[5:40:7] = ["nastyword"] * 5
        rows.append((i, " ".join(words), "s", 9))
        if i % 2:
            labels.append((i, 0 if kind == "low" else 1, 1 if kind == "toxic" else 0))
    return spark.createDataFrame(rows, "doc_id long, text string, rate string, domain int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rates_meet_targets(spark):
    docs, labels = corpus(spark)
    weights = {"clean": 0.8, "low": 0.15, "toxic": 0.05}
    out = mixing.mix(docs, labels, weights)
    tokens = out.agg(*[F.sum(F.col("n_tokens") * F.col("rate") * F.col(f"p_{d}")).alias(d) for d in mixing.DOMAINS]).first()
    total = sum(tokens)
    assert all(abs(tokens[d] / total - w) < 0.01 for d, w in weights.items())
    rows = out.collect()
    assert len(rows) == 300 and all(r.rate >= 0 and r.copies >= 0 for r in rows)


def test_rate_expression_follows_the_steps(spark):
    steps = [[0.3, -0.2, 0.9], [-0.1, 0.4, 0.8], [0.05, 0, -3.0]]
    p = [0.2, 0.3, 0.5]
    rate = 1.0
    for s in steps:
        rate = min(4.0, max(0.0, rate - sum(a * b for a, b in zip(p, s, strict=True))))
    row = spark.createDataFrame([tuple(p)], "p_clean double, p_low double, p_toxic double").select(mixing.rate_of(steps, 4.0).alias("r")).first()
    assert abs(row.r - rate) < 1e-12


def test_mixing_stage_keeps_clean_and_drops_toxic(spark):
    docs, labels = corpus(spark)
    kept = {r.doc_id for r in mixing.keep_mixed(docs, labels).collect()}
    assert {i for i in range(300) if i % 5 < 3} <= kept and not {i for i in range(300) if i % 5 == 4} & kept


def test_odd_rows(spark):
    docs, labels = corpus(spark)
    odd = spark.createDataFrame([(900, None, "s", 1), (901, "", "s", 1), (None, "kaschx", "s", 1), (5, "twice", "s", 1)], docs.schema)
    both = spark.createDataFrame([(7, 1, 0), (7, 0, 0), (None, 1, 1), (8, None, None)], labels.schema)
    rows = mixing.mix(docs.union(odd), labels.union(both)).collect()
    assert len(rows) == 304 and all(r.copies is not None for r in rows)
    assert mixing.mix(docs.limit(0), labels.limit(0)).collect() == []


def test_rows_without_or_with_one_id_draw_apart(spark):
    docs, labels = corpus(spark)
    texts = {i % 5: r.text for i, r in enumerate(docs.orderBy("doc_id").limit(10).collect())}
    odd = [(None, texts[4] + f" n{i}", "s", 1) for i in range(5)] + [(None, texts[0] + f" n{i}", "s", 1) for i in range(5)]
    odd += [(700, texts[4] + " more", "s", 1), (700, texts[1] + " more", "s", 1)]
    rows = mixing.keep_mixed(docs.union(spark.createDataFrame(odd, docs.schema)), labels).collect()
    kept = [r.text for r in rows if r.doc_id is None or r.doc_id == 700]
    assert sorted(kept) == sorted(t for _, t, *_ in odd if "nastyword" not in t)


@pytest.mark.parametrize("whole_from", [0.9, 1.0])
def test_fit_like_a_plain_solver(spark, monkeypatch, whole_from):
    """The same least squares by plain projected gradient over arrays, with and without the rule for rates
    near 1."""
    monkeypatch.setattr(mixing, "WHOLE_FROM", whole_from)
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.5, 0.3, 0.2], 400)
    n = rng.integers(0, 300, 400)
    rows = spark.createDataFrame([(i, int(k), *map(float, q)) for i, (k, q) in enumerate(zip(n, p, strict=True))], "doc_id long, n_tokens long, p_clean double, p_low double, p_toxic double")
    weights = {"clean": 0.7, "low": 0.25, "toxic": 0.05}
    steps, targets, now, settled = mixing.fit(rows, weights, 4.0)
    have = n @ p
    assert np.allclose(targets, np.array([0.7, 0.25, 0.05]) * have[0] / 0.7, rtol=1e-6)
    rate = np.ones(400)
    for _ in range(len(steps)):
        used = np.where((rate >= mixing.WHOLE_FROM) & (rate <= 1), 1.0, rate)
        rate = np.clip(rate - p @ (((n * used) @ p - targets) / have), 0, 4.0)
    used = np.where((rate >= mixing.WHOLE_FROM) & (rate <= 1), 1.0, rate)
    assert np.allclose((n * used) @ p, now, rtol=1e-4) and isinstance(settled, bool)
    assert np.abs(np.array(now) / sum(now) - list(weights.values())).max() < 0.01


def test_residuals_say_what_the_rates_miss(spark):
    docs, labels = corpus(spark)
    out = mixing.mix(docs, labels, {"clean": 0.8, "low": 0.15, "toxic": 0.05})
    one = out.first()
    tokens = out.agg(*[F.sum(F.col("n_tokens") * F.col("rate") * F.col(f"p_{d}")).alias(d) for d in mixing.DOMAINS]).first()
    base = out.agg(F.sum(F.col("n_tokens") * F.col("p_clean"))).first()[0]
    for d, w in (("clean", 0.8), ("low", 0.15), ("toxic", 0.05)):
        assert abs(one[f"residual_{d}"] - (tokens[d] - w * base / 0.8) / sum(tokens)) < 1e-4
