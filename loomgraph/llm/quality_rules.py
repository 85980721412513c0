"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation estimates how far each can be
trusted, and the posterior probability of quality decides.

The corpus is reduced to counts of vote patterns (3 ** rules at most) by one aggregation; the estimation runs on those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import mix, row_blocks, stored, utf8_rows, word_hashes

SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_lines", "n_upper", "n_lower", "n_wide", "n_marks"]
BAD, ABSTAIN, GOOD = 0, 1, 2
#: Beliefs before the data are seen: how often a vote is right, the share of good documents.
PRIOR_RIGHT, PRIOR_GOOD, ROUNDS, MIN_POSTERIOR = 0.9, 0.5, 60, 0.5


def _line_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of each line with a word, and the number of lines of each row."""
    from loomgraph.llm.common import _IS_SPACE, powers, prefix_sums

    breaks = np.flatnonzero(data == 10)
    n_lines = np.diff(np.searchsorted(breaks, offsets)) + 1
    starts = np.sort(np.concatenate([breaks + 1, offsets[:-1]]), kind="stable")
    row = np.repeat(np.arange(len(offsets) - 1), n_lines)
    ends = np.concatenate([starts[1:], offsets[-1:]])
    # A line ends before its break; the last line of a row ends with the row.
    last = np.cumsum(n_lines) - 1
    ends[:-1] -= 1
    ends[last] = offsets[1:]
    filled = np.concatenate([[0], np.cumsum(~_IS_SPACE[data])])
    worded = filled[ends] > filled[starts]
    starts, ends, row = starts[worded], ends[worded], row[worded]
    sums = prefix_sums(data)
    return row, mix((sums[ends] - sums[starts]) * powers(len(data) + 1)[1][starts] + (ends - starts).astype(np.uint64)), n_lines


def _repeated(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: is there an equal one in its row, and is there an earlier one."""
    order = np.lexsort((key, row))  # stable: entries of one key stay in order
    same = (row[order][1:] == row[order][:-1]) & (key[order][1:] == key[order][:-1])
    later = np.concatenate([[False], same])
    any_, again = np.zeros(len(row), bool), np.zeros(len(row), bool)
    again[order] = later
    any_[order] = later | np.concatenate([same, [False]])
    return any_, again


def block_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of all rows of a block."""
    n = len(offsets) - 1
    per_row = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    words, row = word_hashes(data, offsets)
    n_words = np.bincount(row, minlength=n)
    spaces = (data == 32) | ((data >= 9) & (data <= 13))
    out = {"n_words": n_words, "word_chars": per_row(~spaces & ((data & 0xC0) != 0x80)), "n_symbols": per_row(np.isin(data, list(SYMBOLS.encode())))}
    if not len(data):
        return out | {c: np.zeros(n, np.int64) for c in ("n_dup_lines", "n_repeat_words", "n_upper", "n_lower", "n_wide", "n_marks")} | {"n_lines": np.ones(n, np.int64)}
    line_row, line_key, n_lines = _line_keys(data, offsets)
    out["n_dup_lines"] = np.bincount(line_row[_repeated(line_row, line_key)[1]], minlength=n)
    covered = np.zeros(len(words), bool)
    if len(words) > 2:
        inside = row[:-2] == row[2:]
        window = mix(words[:-2] * np.uint64(3) + mix(words[1:-1] * np.uint64(5) + mix(words[2:] * np.uint64(7))))
        at = np.flatnonzero(inside)
        at = at[_repeated(row[at], window[at])[0]]
        for k in range(3):
            covered[at + k] = True
    out["n_repeat_words"] = np.bincount(row[covered], minlength=n)
    return out | {"n_lines": n_lines, "n_upper": per_row((data >= 65) & (data <= 90)), "n_lower": per_row((data >= 97) & (data <= 122)), "n_wide": per_row(data >= 0xC0), "n_marks": per_row(data == 33)}


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8_rows(batch.column("text"))
        parts = [block_counts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in row_blocks(offsets)]
        columns = [pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64) if parts else [], pa.int64()) for c in COUNTS + EXTRA]
        others = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, others), *columns], [*others, *COUNTS, *EXTRA])


def text_key(text: Column) -> Column:
    """128 bits that tell texts apart; null is empty."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def counts(documents: DataFrame, keyed: bool = False) -> DataFrame:
    """doc_id, the base counts and what the rules look at besides, for every row; null text counts as empty. ``keyed`` adds text_key."""
    schema = "doc_id long, " + "text_key binary, " * keyed + ", ".join(f"{c} long" for c in COUNTS + EXTRA)
    keys = [text_key(F.col("text")).alias("text_key")] if keyed else []
    return documents.select(F.col("doc_id").cast("long"), *keys, F.col("text").cast("string")).mapInArrow(_count_batches, schema)


def votes() -> list[Column]:
    """One column per rule: BAD, ABSTAIN or GOOD. Rules without words abstain; most rules know only one side."""
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    cased, chars = F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1)), F.greatest("word_chars", F.lit(1))

    def rule(bad: Column, good: Column = F.lit(False)) -> Column:
        return F.when(F.col("n_words") == 0, ABSTAIN).when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)

    symbols, length, upper, marks = F.col("n_symbols") / words, F.col("word_chars") / words, F.col("n_upper") / cased, F.col("n_marks") / words
    letters = (F.col("n_upper") + F.col("n_lower") + F.col("n_wide")) / chars
    return [
        rule(symbols > 0.2),
        rule(F.col("n_repeat_words") / words > 0.4),
        rule(F.col("n_dup_lines") / lines > 0.35),
        rule((length < 3) | (length > 9)),
        rule(upper > 0.5),
        rule(marks > 0.3),
        rule(letters < 0.75, (letters >= 0.9) & (length >= 3.5) & (length <= 7.5)),
        rule(F.lit(False), (upper < 0.15) & (marks < 0.05) & (symbols < 0.05)),
    ]


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """Share of good documents and accuracy of each rule, by expectation-maximisation over counted vote patterns.

    A rule that votes is right with its accuracy, whatever the class; an abstention says nothing. The prior beliefs weigh
    as much as a rule's own votes, which fixes the good class and keeps rare rules from being overruled by frequent ones.
    """
    v, w = np.array([p for p, _ in patterns], int), np.array([n for _, n in patterns], float)
    good, right = PRIOR_GOOD, np.full(v.shape[1], PRIOR_RIGHT)
    cast = (v != ABSTAIN) * w[:, None]
    for _ in range(rounds):
        post = 1 / (1 + np.exp(-(np.log(good / (1 - good)) + np.sign(v - ABSTAIN) @ np.log(right / (1 - right)))))
        agree = np.where(v == GOOD, post[:, None], 1 - post[:, None])
        right = ((cast * agree).sum(0) + (cast.sum(0) + 1) * PRIOR_RIGHT) / (2 * cast.sum(0) + 1)
        right = np.clip(right, 0.01, 0.99)
        good = (post @ w + w.sum() * PRIOR_GOOD) / (2 * w.sum())
    return float(good), right


def posterior(columns: list[Column], good: float, right: np.ndarray) -> Column:
    """P(good | votes) as an expression over the vote columns."""
    log_odds = F.lit(float(np.log(good / (1 - good))))
    for c, r in zip(columns, right, strict=True):
        log_odds = log_odds + (c - ABSTAIN) * F.lit(float(np.log(r / (1 - r))))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-log_odds))


def judge(documents: DataFrame, keyed: bool = False) -> DataFrame:
    """One row per row of ``documents``: doc_id, the counts, base_failed, kept, quality (the posterior).

    A document fails the base with fewer than 50 words or more than half of its words in repeated windows. Null and
    empty texts have no words and fail. Repeated rows are judged alike. An empty table gives an empty table. ``keyed`` adds
    text_key behind doc_id.
    """
    seen, keys = stored(counts(documents, keyed)), ["doc_id", *["text_key"] * keyed]
    names = [f"v{j}" for j in range(len(votes()))]
    voted = seen.select("*", *[v.alias(n) for v, n in zip(votes(), names, strict=True)])
    table = [((*[r[n] for n in names],), r["n"]) for r in voted.groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).collect()]
    if not table:
        return seen.select(*keys, *COUNTS, F.lit(True).alias("base_failed"), F.lit(False).alias("kept"), F.lit(0.0).alias("quality"))
    quality = posterior([F.col(n) for n in names], *estimate(table))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.select(*keys, *COUNTS, failed.alias("base_failed"), (~failed & (quality >= MIN_POSTERIOR)).alias("kept"), quality.alias("quality"))


def keep_good(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that judge() keeps, whatever their doc_id: rows are known by doc_id, null as well, and text."""
    good = judge(documents, keyed=True).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    same = documents["doc_id"].cast("long").eqNullSafe(good["_id"]) & (text_key(documents["text"]) == good["_key"])
    return documents.join(good, same, "left_semi")
