"""Language identification: each document is a mixture of languages, inferred from character trigrams.

Expectation-maximisation estimates the shares of all languages, then the set of languages is reduced as long as the
penalised likelihood does not fall. The model, one distribution over a fixed number of hashed trigrams per learned language,
comes from counts that tasks add up before they are shuffled; its size does not depend on the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hashed trigrams, rounds of estimation, price of one more language in units of log(trigrams), smoothing of counts.
BUCKETS, ROUNDS, PRICE, SMOOTHING = 1 << 14, 8, 2.0, 0.5
#: Characters that are turned into trigrams at a time, while counting and while predicting.
COUNTED, PREDICTED = 1 << 19, 1 << 17
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, languages array<struct<lang:string,share:double>>"
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram around a letter, and the text it is from. Everything but letters is one word boundary."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("\0".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
    codes = np.where(_is_letter()[codes], codes, 0).astype(np.uint64)
    solid = np.ones(len(codes), bool)
    solid[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    codes, row = codes[solid], row[solid]
    here = np.flatnonzero(codes)
    before = np.where(here > 0, codes[here - 1], 0)
    hashed = before * np.uint64(0x9E3779B97F4A7C15) + codes[here] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[here + 1] * np.uint64(0x165667B19E3779F9)
    hashed ^= hashed >> np.uint64(29)
    return ((hashed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), row[here]


def _blocks(texts: list[str], chars: int) -> Iterator[list[str]]:
    block, size = [], 0
    for t in texts:
        block.append(t)
        size += len(t)
        if size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def entries(texts: list[str], chars: int = PREDICTED) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of each text as row * BUCKETS + bucket, increasing, and how often they occur.

    A text of more than ``chars`` characters is counted in stretches with one more character at either end, so work arrays do
    not follow its length.
    """
    brief = ["" if len(t) > chars else t for t in texts]
    bucket, row = trigrams(brief)
    found = [np.unique(row * BUCKETS + bucket, return_counts=True)]
    for i, text in enumerate(texts):
        if len(text) <= chars:
            continue
        low, total = text.lower(), np.zeros(BUCKETS, np.int64)
        for a in range(0, len(low), chars):
            stretch = low[max(a - 1, 0) : a + chars + 1]
            bucket, _ = trigrams([stretch])
            first = int(a > 0 and stretch[0].isalpha())
            last = int(a + chars < len(low) and stretch[-1].isalpha())
            total += np.bincount(bucket[first : len(bucket) - last], minlength=BUCKETS)
        at = np.flatnonzero(total)
        found.append((i * BUCKETS + at, total[at]))
    entry, weight = (np.concatenate([f[k] for f in found]) for k in range(2))
    order = np.argsort(entry, kind="stable")
    return entry[order], weight[order]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        texts = [t or "" for t in batch.column("text").to_pylist()]
        lo = 0
        for block in _blocks(texts, COUNTED):
            entry, weight = entries(block, COUNTED)
            bucket, row = entry % BUCKETS, entry // BUCKETS
            of_row = langs[lo : lo + len(block)]
            lo += len(block)
            for lang in set(of_row):
                here = (of_row == lang)[row]
                counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                np.add.at(counts[lang], bucket[here], weight[here])
    for lang, n in counts.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages in ``lang`` of (text, lang) and log P(trigram | language)."""
    rows = labelled.filter(F.col("lang").isNotNull()).select(F.col("text").cast("string"), F.col("lang").cast("string"))
    counted = rows.mapInArrow(_count_batches, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counted["lang"].to_pylist()))
    table = np.full((len(langs), BUCKETS), SMOOTHING)
    if langs:
        at = np.searchsorted(np.array(langs, object), np.array(counted["lang"].to_pylist(), object))
        table[at, counted["bucket"].to_numpy()] += counted["n"].to_numpy()
    return langs, np.log(table / table.sum(1, keepdims=True))


def _fit(density: np.ndarray, weight: np.ndarray, doc: np.ndarray, shares: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares (documents x languages) after ``rounds`` of estimation, and the log-likelihood of each document.

    density: P(trigram | language) per distinct trigram of a document (entries x languages); weight: how often it occurs; doc:
    its document, increasing, each with an entry at least.
    """
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    total = np.add.reduceat(weight, starts)
    for _ in range(rounds):
        part = shares[doc] * density
        part *= (weight / part.sum(1))[:, None]
        shares = np.add.reduceat(part, starts, axis=0) / total[:, None]
    return shares, np.add.reduceat(weight * np.log((shares[doc] * density).sum(1)), starts)


def infer(entry: np.ndarray, weight: np.ndarray, n: int, log_table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For n texts with the trigrams of ``entries``: the most common language of the chosen set (-1 without letters), its share
    in the mixture of all languages, and the shares within the chosen set (texts x languages, 0 outside the set)."""
    langs = len(log_table)
    best, score, within = np.full(n, -1), np.zeros(n), np.zeros((n, langs))
    if not len(entry) or not langs:
        return best, score, within
    rows, doc = np.unique(entry // BUCKETS, return_inverse=True)
    logs = log_table.T[entry % BUCKETS]
    # Scaled by the largest density, so that rare trigrams do not underflow; likelihood differences stay the same.
    top = logs.max(1, keepdims=True)
    density, weight = np.exp(logs - top), weight.astype(float)
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    price = PRICE * np.log(np.add.reduceat(weight, starts) + 1)
    alone = np.add.reduceat(weight[:, None] * (logs - top), starts, axis=0)
    full, fit = _fit(density, weight, doc, np.full((len(rows), langs), 1 / langs), ROUNDS)
    first = alone.argmax(1)
    chosen = first.copy()
    within[rows, first] = 1
    # One language alone is best where even the full mixture does not pay for a second one.
    open_ = np.flatnonzero(fit - price > alone.max(1))
    if len(open_) and langs > 1:
        inside = np.isin(doc, open_)
        d, w, x = density[inside], weight[inside], np.searchsorted(open_, doc[inside])
        shares, have = full[open_], fit[open_] - langs * price[open_]
        active = np.ones(len(open_), bool)
        for size in range(langs - 1, 0, -1):
            smaller = shares.copy()
            rest = np.where(smaller > 0, smaller, np.inf)
            smaller[np.arange(len(open_)), rest.argmin(1)] = 0
            smaller /= np.maximum(smaller.sum(1, keepdims=True), 1e-300)
            smaller, fits = _fit(d, w, x, np.where(smaller > 0, smaller + 1e-12, 0), ROUNDS)
            better = active & (fits - size * price[open_] >= have)
            shares[better], have[better] = smaller[better], (fits - size * price[open_])[better]
            active &= better
        chosen[open_] = shares.argmax(1)
        within[rows[open_]] = shares
    best[rows] = chosen
    score[rows] = np.clip(full[np.arange(len(rows)), chosen], 0, 1)
    return best, score, within


def _lists(within: np.ndarray, names: np.ndarray) -> pa.Array:
    """The chosen languages of each row with their shares, largest share first."""
    order = np.argsort(-within, axis=1, kind="stable")
    shares = np.take_along_axis(within, order, 1)
    some = shares > 0
    offsets = pa.array(np.concatenate([[0], np.cumsum(some.sum(1))]), pa.int32())
    pairs = pa.StructArray.from_arrays([pa.array(names[order[some]], pa.string()), pa.array(shares[some], pa.float64())], ["lang", "share"])
    return pa.ListArray.from_arrays(offsets, pairs)


def _predictor(langs: list[str], model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.value
        names = np.array([*langs, UNKNOWN], object)
        for batch in batches:
            parts = [(np.zeros(0, int), np.zeros(0), np.zeros((0, len(langs))))]
            for block in _blocks([t or "" for t in batch.column("text").to_pylist()], PREDICTED):
                parts.append(infer(*entries(block), len(block), table))
            best, score, within = (np.concatenate(p) for p in zip(*parts, strict=True))
            columns = [batch.column(0), batch.column(1), pa.array(names[best], pa.string()), pa.array(score, pa.float64()), _lists(within, names)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score", "languages"])

    return predict


def predict(documents: DataFrame, langs: list[str], log_table: np.ndarray, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score and languages for every row.

    languages is the chosen set with its proportions (lang, share), largest first, and lang_pred the first of them; score is the
    share of lang_pred in the mixture of all languages. Text that is null or has no letter gets ``und``, 0 and an empty list; ties
    go to the language first in the alphabet. Repeated rows and null ids are predicted like any other.
    """
    model = documents.sparkSession.sparkContext.broadcast(log_table)  # languages x BUCKETS
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predictor(langs, model), SCHEMA)


def identify(documents: DataFrame) -> DataFrame:
    """Learns from four fifths of the ids, by crc32, and predicts all rows. Null ids are not learned from nor held out. Without
    anything to learn from, all predictions are ``und``."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    langs, table = learn(documents.filter(F.col("doc_id").isNotNull() & ~held_out).select("text", "lang"))
    return predict(documents, langs, table, held_out)
