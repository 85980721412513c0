"""Mixing to target weights with soft membership: a classifier learned from a labelled table gives each document a posterior
over domains, and nonnegative rates are fitted so that the expected tokens of every domain meet their targets.

The fit is projected-gradient least squares. A step depends on the documents only through one number per domain, so an
iteration is one aggregation, and the rates are an expression over the few numbers of all steps: no per-document state is
written. Sums are exact decimals, so runs do not differ by the order of tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import row_blocks, stored, utf8_rows, word_hashes

#: Hashed word features; how many of them the classifier keeps for each domain; smoothing of counts; labelled documents it
#: learns from at most (those with the smallest hashes of doc_id).
FEATURES, KEPT, SMOOTHING, SAMPLE = 1 << 16, 200, 1.0, 20_000
DOMAINS = ["clean", "low", "toxic"]
#: Production target weights. The total is what keeps all clean tokens.
WEIGHTS = {"clean": 0.97, "low": 0.03, "toxic": 0.0}
ROUNDS, TOLERANCE, MAX_RATE, WHOLE_FROM = 40, 1e-4, 4.0, 0.9
#: Features of shape beside words: (name, bins). They take the last numbers below FEATURES.
_SHAPES, _BINS = 4, 16


def labelled(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, domain) of at most ``sample`` labelled documents: toxic before low quality before clean. Of several labels the
    worst counts. The sample of labels is broadcast, so texts are not shuffled."""
    domain = F.when(F.coalesce("toxic", F.lit(0)) == 1, 2).when(F.coalesce("quality", F.lit(1)) == 0, 1).otherwise(0)
    of = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max(domain).alias("domain"))
    of = F.broadcast(of.orderBy(F.xxhash64("_id"), "_id").limit(sample))  # 16 bytes a row
    return documents.select("doc_id", "text").join(of, F.col("doc_id") == F.col("_id")).select("text", "domain")


def block_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens (words) per row, and the distinct features of each row as (row, feature)."""
    n = len(offsets) - 1
    words, row = word_hashes(data, offsets)
    tokens = np.bincount(row, minlength=n)
    room = FEATURES - _SHAPES * _BINS
    entry = np.unique(row * FEATURES + (words % np.uint64(room)).astype(np.int64))
    per_row = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    upper, lower = per_row((data >= 65) & (data <= 90)), per_row((data >= 97) & (data <= 122))
    symbols, spaces = per_row(np.isin(data, list(b"#*$%&|<>!"))), per_row((data == 32) | ((data >= 9) & (data <= 13)))
    some = np.maximum(tokens, 1)
    shapes = [upper / np.maximum(upper + lower, 1), symbols / some / 2, np.bincount(entry // FEATURES, minlength=n) / some, (np.diff(offsets) - spaces) / some / 12]
    bins = [np.minimum((s * _BINS).astype(np.int64), _BINS - 1) + room + k * _BINS for k, s in enumerate(shapes)]
    filled = np.flatnonzero(tokens)
    extra = np.concatenate([filled * FEATURES + b[filled] for b in bins]) if len(filled) else np.zeros(0, np.int64)
    entry = np.sort(np.concatenate([entry, extra]))
    return tokens, entry // FEATURES, entry % FEATURES


def _count_batches(domains: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs = np.zeros((domains, FEATURES), np.int64), np.zeros(domains, np.int64)
        for batch in batches:
            data, offsets = utf8_rows(batch.column("text"))
            domain = batch.column("domain").to_numpy(zero_copy_only=False)
            for a, b in row_blocks(offsets):
                tokens, row, feature = block_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                d = domain[a:b]
                counts += np.bincount(d[row] * FEATURES + feature, minlength=domains * FEATURES).reshape(domains, FEATURES)
                docs += np.bincount(d[tokens > 0], minlength=domains)
        d, f = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([d, np.arange(domains)]), pa.int32()), pa.array(np.concatenate([f, np.full(domains, -1)]), pa.int32()), pa.array(np.concatenate([counts[d, f], docs]), pa.int64())], ["domain", "feature", "n"])

    return run


def learn(rows: DataFrame, domains: int = len(DOMAINS), kept: int = KEPT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Naive Bayes over the presence of features, from counts over all labelled rows.

    Returns the kept features (those that tell a domain from the rest best, by chi-square), and per domain the log-odds
    base and the gain in log-likelihood of each feature's presence. The model's size is bounded by ``kept``.
    """
    counted = rows.mapInArrow(_count_batches(domains), "domain int, feature int, n long").groupBy("domain", "feature").agg(F.sum("n").alias("n")).toArrow()
    d, f, n = (counted[c].to_numpy() for c in ("domain", "feature", "n"))
    docs = np.zeros(domains)
    docs[d[f < 0]] = n[f < 0]
    seen = np.zeros((domains, FEATURES))
    seen[d[f >= 0], f[f >= 0]] = n[f >= 0]
    total, chosen = max(docs.sum(), 1.0), [np.zeros(0, np.int64)]
    rate = seen.sum(0) / total
    for k in range(domains):
        spread = (seen[k] - docs[k] * rate) ** 2 / np.maximum(docs[k] * rate * (1 - rate), 1e-9) * (total / max(total - docs[k], 1.0))
        order = np.argsort(-spread, kind="stable")[:kept]
        chosen.append(order[spread[order] > 10.83])
    features = np.unique(np.concatenate(chosen))
    p = (seen[:, features] + SMOOTHING * rate[features] + 1e-3) / (docs[:, None] + SMOOTHING + 2e-3)
    p = np.clip(p, 1e-6, 1 - 1e-6)
    prior = np.log((docs + 1) / (docs.sum() + domains))
    return features, prior + np.log1p(-p).sum(1), np.log(p) - np.log1p(-p)


def _scorer(model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, base, gain = model.value
        slot = np.full(FEATURES, -1)
        slot[features] = np.arange(len(features))
        for batch in batches:
            data, offsets = utf8_rows(batch.column("text"))
            tokens, scores = [np.zeros(0, np.int64)], [np.zeros((0, len(base)))]
            for a, b in row_blocks(offsets):
                n, row, feature = block_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                at = slot[feature]
                row, at = row[at >= 0], at[at >= 0]
                tokens.append(n)
                scores.append(np.stack([np.bincount(row, weights=g[at], minlength=b - a) for g in gain], 1) + base)
            s = np.concatenate(scores)
            s = np.exp(s - s.max(1, keepdims=True)) if len(s) else s
            s = s / s.sum(1, keepdims=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(np.concatenate(tokens), pa.int64()), *[pa.array(c, pa.float64()) for c in s.T]], ["doc_id", "key", "n_tokens", *[f"p_{x}" for x in DOMAINS]])

    return run


def posteriors(documents: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, key (a hash of doc_id and text), n_tokens and p_<domain> for every row; null text is empty and gets the domains'
    prior without features."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # at most KEPT features per domain
    schema = "doc_id long, key long, n_tokens long, " + ", ".join(f"p_{d} double" for d in DOMAINS)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), key_of().alias("key")).mapInArrow(_scorer(shared), schema)


def key_of() -> Column:
    """Tells rows apart by doc_id and text: many rows may have no doc_id, or the same one."""
    return F.xxhash64(F.lit(17), F.col("doc_id").cast("long"), F.col("text").cast("string"))


def rate_of(steps: list[list[float]], max_rate: float) -> Column:
    """Rate after the steps so far: 1, less the step of each domain in proportion to its posterior, kept within 0 and max_rate."""
    rate = F.lit(1.0)
    if not steps:
        return rate
    table = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])

    def step(r: Column, g: Column) -> Column:
        change = sum((F.col(f"p_{d}") * F.get(g, F.lit(k)) for k, d in enumerate(DOMAINS)), F.lit(0.0))
        return F.greatest(F.lit(0.0), F.least(F.lit(max_rate), r - change))

    return F.aggregate(table, rate, step)


def as_used(rate: Column) -> Column:
    """Rates from ``WHOLE_FROM`` to 1 are 1: a document of a wanted domain never goes for a shade of doubt."""
    return F.when(rate.between(WHOLE_FROM, 1.0), F.lit(1.0)).otherwise(rate)


def expected(rows: DataFrame, rate: Column) -> list[float]:
    """Expected tokens of each domain under the rates."""
    sums = [F.sum((F.col("n_tokens") * F.col(f"p_{d}") * rate).cast("decimal(30,6)")).alias(d) for d in DOMAINS]
    return [float(x or 0) for x in rows.agg(*sums).first()]


def fit(rows: DataFrame, weights: dict[str, float] = WEIGHTS, max_rate: float = MAX_RATE) -> tuple[list[list[float]], list[float], list[float], bool]:
    """Steps of the projected gradient, targets and expected tokens at the end, all at the rates as they are used.

    Minimises the sum over domains of (expected - target) ** 2 / (tokens of the domain), with steps in the metric in which a
    document weighs as its tokens; there the largest curvature is 1, so a unit step never diverges. Stops when no
    domain moves; the last value says whether that happened within ``ROUNDS`` steps.
    """
    have = expected(rows, F.lit(1.0))
    heaviest = max(weights, key=weights.get)
    total = have[DOMAINS.index(heaviest)] / weights[heaviest] if weights[heaviest] else 0.0
    targets = [weights.get(d, 0.0) * total for d in DOMAINS]
    steps: list[list[float]] = []
    now = have
    for _ in range(ROUNDS):
        steps.append([(e - t) / h if h else 0.0 for e, t, h in zip(now, targets, have, strict=True)])
        was, now = now, expected(rows, as_used(rate_of(steps, max_rate)))
        settled = max(abs(a - b) for a, b in zip(was, now, strict=True)) <= TOLERANCE * max(sum(have), 1.0) / len(have)
        if settled:
            break
    return steps, targets, now, settled


def mix(documents: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, max_rate: float = MAX_RATE) -> DataFrame:
    """doc_id, n_tokens, p_<domain>, rate, copies, residual_<domain> and settled, for every row of ``documents``.

    The rate is the one that is used; copies is the rate rounded up or down at random by a hash of doc_id and text, so that its
    expectation is the rate. residual_<domain> is the share of all tokens by which the fitted rates miss the domain's target
    (above 0: too many), settled whether the fit came to rest; both are the same in all rows. Repeated rows draw alike; rows
    without doc_id, or with one doc_id and different texts, draw apart. Without labels all domains are alike and the weights
    cannot bind. An empty table gives an empty table.
    """
    return _mixed(documents, labels, weights, max_rate).drop("key")


def _mixed(documents: DataFrame, labels: DataFrame, weights: dict[str, float], max_rate: float) -> DataFrame:
    rows = stored(posteriors(documents, learn(labelled(documents, labels))))
    steps, targets, now, settled = fit(rows, weights, max_rate)
    rated = rows.withColumn("rate", as_used(rate_of(steps, max_rate)))
    draw = F.pmod("key", F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")
    missed = [F.lit((e - t) / max(sum(now), 1.0)).alias(f"residual_{d}") for d, e, t in zip(DOMAINS, now, targets, strict=True)]
    return rated.select("*", copies.cast("long").alias("copies"), *missed, F.lit(settled).alias("settled"))


def keep_mixed(documents: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """The rows of ``documents`` that stay when no document may be taken more than once; rows are told apart by doc_id and text."""
    stay = _mixed(documents, labels, weights, max_rate=1.0).filter("copies > 0").select(F.col("key").alias("_stay")).distinct()
    return documents.join(stay, key_of() == F.col("_stay"), "left_semi")
