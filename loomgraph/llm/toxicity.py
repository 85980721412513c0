"""Toxicity by a weighted grammar of finite-state transducers over clauses.

Words become symbols: insult or threat (with a weight), target, negation, reporting. Small transducers say what a symbol means
after what came before it in its clause: one drops the force of an insult behind a negation, one behind a reporting word or an
opening quote, one joins insults and threats with the target they are aimed at. Their composition is one table of states; it is
run over all clauses at once, from the left for what comes before and from the right for targets behind. A clause scores by the
patterns it matches; a document by its clauses, through a logistic model.

Seed words give the grammar its start. Weights of insults, also of words no seed names, are log-odds learned from labels.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import as_signed, row_blocks, stored, utf8_rows
from loomgraph.llm.tokens import Tokens, tokens

# Fixed seed words of English, German, French and Spanish.
INSULTS = """idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown imbecile dumb fool vermin
dumm idiotisch trottel abschaum versager widerlich blöd crétin imbécile débile ordure minable raclure estúpido imbécil basura
escoria inútil asqueroso payaso""".split()
THREATS = "kill hurt destroy burn shoot stab beat töten umbringen vernichten tuer frapper détruire matar golpear destruir".split()
TARGETS = """you your yours u he she they them this these those people du dich dir ihr euch sie diese dieser tu toi vous ils elles ce
cette ces tú ti usted ustedes ellos ellas este esta estos""".split()
NEGATIONS = "not no never nobody isn't aren't don't won't cannot can't nicht kein keine nie niemals pas jamais aucun nunca jamás ningún".split()
REPORTS = """said says say called calls claimed wrote quote quoted reported sagte sagen nannte schrieb berichtete dit disait appelé
écrit cité dijo dicen llamó escribió citó""".split()

#: Labelled documents that the words and the logistic model are learned from at most (smallest hashes of doc_id first); learned
#: words at most; a word needs this many documents and 2 * log-likelihood ratio above MARGIN * log(number of words).
SAMPLE, LEXICON, MIN_DOCS, MARGIN, SMOOTHING = 40_000, 20_000, 3, 2.0, 0.5
#: Weights of seed words before labels; words that a clause pattern can skip; factors of a negated or reported match, and of an
#: insult or threat without a target.
SEED_WEIGHT, THREAT_WEIGHT, REACH = 3.0, 1.5, 8
NEGATED, REPORTED, UNAIMED, UNAIMED_THREAT = 0.2, 0.3, 0.8, 0.1
#: Longer words are never looked up.
LONGEST = 64

# --- words -------------------------------------------------------------------------------------------------------------

WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[39] = WORD[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[list(b".!?;:\n")] = True


def folded(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with small letters for A-Z and À-Þ, dashes and quotes of general punctuation as blanks and ASCII quotes; and which
    bytes are quotes."""
    out = data.copy()
    second = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    out[second] += 32
    point = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] >= 0x80) & (data[1:-1] <= 0x81))
    if len(point):
        quotes = point[(data[point + 1] == 0x80) & (data[point + 2] >= 0x9C) & (data[point + 2] <= 0x9F)]
        apostrophes = point[(data[point + 1] == 0x80) & (data[point + 2] >= 0x98) & (data[point + 2] <= 0x99)]
        for k in range(3):
            out[point + k] = 32
        out[quotes], out[apostrophes + 2] = 34, 39
        out[apostrophes], out[apostrophes + 1] = 39, 39
    french = np.flatnonzero((data[:-1] == 0xC2) & ((data[1:] == 0xAB) | (data[1:] == 0xBB)))
    out[french], out[french + 1] = 34, 32
    return out, out == 34


def word_codes(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.cumsum([0, *map(len, raw)])
    found = list(tokens(folded(data)[0], offsets, WORD, _FOLD, max(len(data), 1)))
    return as_signed(found[0].code) if found else np.zeros(0, np.int64)


# --- transducers -------------------------------------------------------------------------------------------------------

#: Symbols that the machines read. A gap is a stretch of more than REACH other words; clauses end with the state.
INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, GAP = range(7)
SYMBOLS = range(7)


class Machine(NamedTuple):
    """(state, symbol) to (next state, marks): marks are bits that an insult or threat leaves with. State 0 is the start."""

    states: int
    step: dict[tuple[int, int], tuple[int, int]]


AFTER_NEGATION, AFTER_REPORT, AFTER_TARGET = 1, 2, 4


def _switch(on: set[int], toggle: set[int], mark: int, reset: set[int]) -> Machine:
    """Two states: a symbol of ``on`` sets the second, of ``toggle`` changes it, of ``reset`` clears it; insults and threats in the
    second state leave with ``mark``."""
    step = {}
    for state in (0, 1):
        for s in SYMBOLS:
            target = 1 if s in on else 1 - state if s in toggle else 0 if s in reset else state
            step[state, s] = (target, mark if state and s in (INSULT, THREAT) else 0)
    return Machine(2, step)


#: A second negation takes the first one back, a closing quote ends what was reported; neither reaches over a gap, reporting words do.
NEGATED_MACHINE = _switch(set(), {NEGATION}, AFTER_NEGATION, {GAP})
REPORTED_MACHINE = _switch({REPORT}, {QUOTE}, AFTER_REPORT, set())
AIMED_MACHINE = _switch({TARGET}, set(), AFTER_TARGET, {GAP})


def compose(a: Machine, b: Machine) -> Machine:
    """Both machines reading the same symbols, with the marks of both."""
    step = {}
    for i in range(a.states):
        for j in range(b.states):
            for s in SYMBOLS:
                (p, m), (q, n) = a.step[i, s], b.step[j, s]
                step[i * b.states + j, s] = (p * b.states + q, m | n)
    return Machine(a.states * b.states, step)


def table_of(machine: Machine) -> tuple[np.ndarray, np.ndarray]:
    after, marks = np.zeros((machine.states, 7), np.int64), np.zeros((machine.states, 7), np.int64)
    for (state, s), (target, mark) in machine.step.items():
        after[state, s], marks[state, s] = target, mark
    return after, marks


FORWARD = table_of(compose(compose(NEGATED_MACHINE, REPORTED_MACHINE), AIMED_MACHINE))
BACKWARD = table_of(AIMED_MACHINE)


def run_machine(machine: tuple[np.ndarray, np.ndarray], symbol: np.ndarray, start: np.ndarray, length: np.ndarray, backward: bool = False) -> np.ndarray:
    """Marks of every symbol; clause k is symbol[start[k] : start[k] + length[k]]. All clauses go one symbol at a time."""
    after, mark = machine
    out = np.zeros(len(symbol), np.int64)
    order = np.argsort(-length, kind="stable")
    first = start[order] + (length[order] - 1 if backward else 0)
    falling, state, step = -length[order], np.zeros(len(order), np.int64), -1 if backward else 1
    for k in range(int(length.max()) if len(length) else 0):
        n = int(np.searchsorted(falling, -k, "left"))
        at = first[:n] + step * k
        s = symbol[at]
        out[at] = mark[state[:n], s]
        state[:n] = after[state[:n], s]
    return out


# --- clauses -----------------------------------------------------------------------------------------------------------


class Lexicon(NamedTuple):
    """Sorted word hashes with the symbol and the weight of each."""

    code: np.ndarray
    symbol: np.ndarray
    weight: np.ndarray


def lexicon(learned: dict[int, float] | None = None) -> Lexicon:
    """Seed words, and learned words by their hash with their log-odds. Insults and threats take the learned weight where there is one."""
    entries: dict[int, tuple[int, float]] = {}
    for words, symbol, weight in ((TARGETS, TARGET, 0.0), (NEGATIONS, NEGATION, 0.0), (REPORTS, REPORT, 0.0), (THREATS, THREAT, THREAT_WEIGHT), (INSULTS, INSULT, SEED_WEIGHT)):
        entries |= dict.fromkeys(word_codes(words).tolist(), (symbol, weight))
    for code, weight in (learned or {}).items():
        symbol = entries.get(code, (INSULT, 0.0))[0]
        if symbol in (INSULT, THREAT):
            entries[code] = (symbol, weight)
    code = np.array(sorted(entries), np.int64)
    return Lexicon(code, np.array([entries[c][0] for c in code.tolist()], np.int64), np.array([entries[c][1] for c in code.tolist()]))


class Clauses(NamedTuple):
    """Matched clauses: row, bytes from the first to the last word of the match, score, number of matches, words that matched."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    score: np.ndarray
    matches: np.ndarray


def find_clauses(data: np.ndarray, offsets: np.ndarray, lex: Lexicon) -> tuple[Clauses, np.ndarray]:
    """Clauses of all rows with an insult or a threat, and the number of words of each row."""
    n_words = np.zeros(len(offsets) - 1, np.int64)
    text, is_quote = folded(data)
    # In half bytes, so that a row ends between two bytes.
    breaks = np.sort(np.concatenate([2 * np.flatnonzero(_BREAK[text]), 2 * offsets[:-1] - 1]))
    parts: list[tuple[np.ndarray, ...]] = []
    seen = 0
    for t in tokens(text, offsets, WORD, _FOLD):
        n_words += np.bincount(t.row, minlength=len(n_words))
        parts.append(_events(t, lex, seen))
        seen += len(t.start)
    quotes = np.flatnonzero(is_quote)
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 5
    start, end, number, symbol, which = columns
    # Quotes count only in clauses that something else is in; their word number is that of the word before them.
    clause = np.searchsorted(breaks, 2 * start, "right")
    hot = np.unique(clause[(symbol == INSULT) | (symbol == THREAT)])
    keep = np.isin(clause, hot)
    start, end, number, symbol, which, clause = (c[keep] for c in (start, end, number, symbol, which, clause))
    quote_clause = np.searchsorted(breaks, 2 * quotes, "right")
    inside = np.isin(quote_clause, hot)
    quotes, quote_clause = quotes[inside], quote_clause[inside]
    all_start, all_clause = np.concatenate([start, quotes]), np.concatenate([clause, quote_clause])
    order = np.argsort(all_start, kind="stable")
    all_symbol = np.concatenate([symbol, np.full(len(quotes), QUOTE)])[order]
    all_clause, source = all_clause[order], np.concatenate([np.arange(len(start)), np.full(len(quotes), -1)])[order]
    # A gap stands where more than REACH other words lie between two words of the grammar in one clause.
    is_word = np.flatnonzero(source >= 0)
    words_at = number[source[is_word]]
    far = np.flatnonzero((np.diff(words_at) > REACH + 1) & (np.diff(all_clause[is_word]) == 0)) + 1
    at = is_word[far]
    all_symbol, all_clause, source = np.insert(all_symbol, at, GAP), np.insert(all_clause, at, all_clause[at]), np.insert(source, at, -1)
    first = np.flatnonzero(np.diff(all_clause, prepend=-1)) if len(all_clause) else np.zeros(0, np.int64)
    length = np.diff(np.append(first, len(all_clause)))
    marks = run_machine(FORWARD, all_symbol, first, length) | run_machine(BACKWARD, all_symbol, first, length, backward=True)
    force = (all_symbol == INSULT) | (all_symbol == THREAT)
    factor = np.where(marks & AFTER_NEGATION, NEGATED, 1.0) * np.where(marks & AFTER_REPORT, REPORTED, 1.0)
    factor *= np.where(marks & AFTER_TARGET, 1.0, np.where(all_symbol == THREAT, UNAIMED_THREAT, UNAIMED))
    value = np.where(force, factor * lex.weight[which[source]], 0.0) if len(source) else np.zeros(0)
    if not len(first):
        return Clauses(*[np.zeros(0, np.int64)] * 3, np.zeros(0), np.zeros(0, np.int64)), n_words
    score, matches = np.add.reduceat(value, first), np.add.reduceat(force.astype(np.int64), first)
    heavy = np.flatnonzero(force)
    group = np.searchsorted(first, heavy, "right") - 1
    lead, tail = heavy[np.flatnonzero(np.diff(group, prepend=-1))], heavy[np.flatnonzero(np.diff(group, append=len(first)))]
    row = np.searchsorted(offsets, start[source[lead]], "right") - 1
    return Clauses(row, start[source[lead]], end[source[tail]], score, matches), n_words


def _events(t: Tokens, lex: Lexicon, seen: int) -> tuple[np.ndarray, ...]:
    code = as_signed(t.code)
    at = np.minimum(np.searchsorted(lex.code, code), len(lex.code) - 1)
    hit = np.flatnonzero((lex.code[at] == code) & (t.end - t.start <= LONGEST))
    return t.start[hit], t.end[hit], hit + seen, lex.symbol[at[hit]], at[hit]


FEATURES = ["clauses", "sum", "largest", "density"]


def features(found: Clauses, n_words: np.ndarray) -> np.ndarray:
    """Per row: log of 1 + matched clauses, of 1 + their scores, the largest score, and score per hundred words (root)."""
    n = len(n_words)
    number, total = np.bincount(found.row, minlength=n), np.maximum(np.bincount(found.row, found.score, minlength=n), 0)
    largest = np.zeros(n)
    np.maximum.at(largest, found.row, found.score)
    return np.stack([np.log1p(number), np.log1p(total), np.minimum(largest, 20.0) / 4, np.sqrt(100 * total / np.maximum(n_words, 20)) / 4], 1)


# --- learning ----------------------------------------------------------------------------------------------------------


def labelled(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic) of at most ``sample`` labelled documents. Of several labels of an id the worst counts. The sample of
    labels has a fixed size and is broadcast, so texts are not shuffled."""
    of = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    of = F.broadcast(of.orderBy(F.xxhash64("_id"), "_id").limit(sample))
    rows = documents.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("text"))
    return rows.join(of, F.col("_doc") == F.col("_id")).select(F.col("_doc").alias("doc_id"), "text", "toxic")


def _blocks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = utf8_rows(batch.column(column))
    for lo, hi in row_blocks(offsets):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def _word_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each text, and a sketch that near copies share: the smallest hash of three words in a row."""
    for batch in batches:
        for lo, hi, data, offsets in _blocks(batch, "text"):
            keys, names = [np.zeros(0, np.int64)], np.zeros(0, np.int64)
            sketch = np.full(hi - lo, np.iinfo(np.int64).max)
            for t in tokens(folded(data)[0], offsets, WORD, _FOLD):
                code = as_signed(t.code)
                three = np.flatnonzero(t.row[2:] == t.row[:-2])
                np.minimum.at(sketch, t.row[three], (code[three] * 3 + code[three + 1]) * 3 + code[three + 2])
                short = np.flatnonzero(t.end - t.start <= LONGEST)
                known, at = np.unique(np.concatenate([names, code[short]]), return_inverse=True)
                old = keys[0]
                moved = old // max(len(names), 1) * len(known) + at[: len(names)][old % max(len(names), 1)] if len(old) else old
                keys, names = [np.unique(np.concatenate([moved, t.row[short] * len(known) + at[len(names) :]]))], known
            row = keys[0] // max(len(names), 1)
            word = names[keys[0] % max(len(names), 1)] if len(names) else names
            starts = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
            out = [batch.column("doc_id").slice(lo, hi - lo), batch.column("toxic").slice(lo, hi - lo), pa.array(sketch), pa.ListArray.from_arrays(pa.array(starts), pa.array(word))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "toxic", "sketch", "words"])


def learn_words(rows: DataFrame, limit: int = LEXICON) -> dict[int, float]:
    """Words (by hash) that stand in toxic documents more often than chance over all words allows, with their log-odds.

    Copies say a thing once: of documents with one sketch and one label, the words of the one with the smallest id count.
    """
    listed = rows.mapInArrow(_word_lists, "doc_id long, toxic int, sketch long, words array<long>")
    once = listed.groupBy("sketch", "toxic").agg(F.min_by("words", F.struct("doc_id", F.size("words"), "words")).alias("words"))
    once = stored(once)
    totals = {r["toxic"]: r["n"] for r in once.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), sum(n for k, n in totals.items() if k != 1)
    if not bad or not good:
        return {}
    counts = once.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") != 1).alias("c"))
    counts = stored(counts)
    vocabulary = max(counts.count(), 3)
    t, c, n = F.col("t"), F.col("c"), F.col("t") + F.col("c")
    part = lambda x, whole: F.when(x > 0, x * F.ln(x * (bad + good) / (n * whole))).otherwise(0.0)
    evidence = 2 * (part(t, bad) + part(c, good))
    odds = F.ln((t + SMOOTHING) / (bad + 2 * SMOOTHING)) - F.ln((c + SMOOTHING) / (good + 2 * SMOOTHING))
    telling = counts.filter((n >= MIN_DOCS) & (t * good > c * bad)).select("word", evidence.alias("evidence"), odds.alias("odds"))
    telling = telling.filter(F.col("evidence") > MARGIN * math.log(vocabulary)).orderBy(F.desc("evidence"), "word").limit(limit)
    return {r["word"]: r["odds"] for r in telling.collect()}


def fit_logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Weights and intercept by Newton's method with a ridge, from rows that occur ``times`` times; without rows everything is
    unlikely."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    if not len(y):
        return np.concatenate([np.ones(x.shape[1] - 1), [-4.0]])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (times * (p - y)) + ridge * w
        step = np.linalg.solve((x * (times * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w = w - step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model(NamedTuple):
    lexicon: Lexicon
    weights: np.ndarray


def _feature_batches(lex) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in _blocks(batch, "text"):
                x = features(*find_clauses(data, offsets, lex.value))
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(lo, hi - lo), *[pa.array(c) for c in x.T]], ["toxic", *FEATURES])

    return run


def learn(rows: DataFrame) -> Model:
    """From (doc_id, text, toxic) of a bounded sample. Equal rows of features are counted together, so what the driver fits is small."""
    lex = lexicon(learn_words(rows))
    shared = rows.sparkSession.sparkContext.broadcast(lex)  # LEXICON words and the seeds
    made = rows.mapInArrow(_feature_batches(shared), "toxic int, " + ", ".join(f"{f} double" for f in FEATURES))
    made = made.groupBy("toxic", *FEATURES).agg(F.count("*").alias("times")).toArrow().sort_by([(c, "ascending") for c in ["toxic", *FEATURES]])
    x = np.stack([made[f].to_numpy() for f in FEATURES], 1)
    return Model(lex, fit_logistic(x, (made["toxic"].to_numpy() == 1).astype(float), made["times"].to_numpy()))


# --- scores ------------------------------------------------------------------------------------------------------------


def _score_batches(model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, w = model.value
        for batch in batches:
            for lo, hi, data, offsets in _blocks(batch, "text"):
                found, n_words = find_clauses(data, offsets, lex)
                score = 1 / (1 + np.exp(-np.clip(features(found, n_words) @ w[:-1] + w[-1], -30, 30)))
                out = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "held_out")]
                clauses = np.bincount(found.row, minlength=hi - lo)
                yield pa.RecordBatch.from_arrays([*out, pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(clauses)], ["doc_id", "held_out", "score", "predicted", "n_clauses"])

    return run


def score(documents: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """doc_id, held_out, score, predicted and n_clauses (clauses with a match) of every row. Null and empty texts have no clause."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score_batches(shared), "doc_id long, held_out boolean, score double, predicted int, n_clauses long")


def _clause_batches(lex) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in _blocks(batch, "text"):
                found, _ = find_clauses(data, offsets, lex.value)
                ids = batch.column("doc_id").slice(lo, hi - lo).take(pa.array(found.row))
                texts = [bytes(data[a:b]).decode(errors="replace") for a, b in zip(found.start.tolist(), found.end.tolist(), strict=True)]
                at = found.start - offsets[found.row]
                yield pa.RecordBatch.from_arrays([ids, pa.array(at), pa.array(texts, pa.string()), pa.array(found.matches), pa.array(found.score)], ["doc_id", "at_byte", "clause", "matches", "score"])

    return run


def clauses(documents: DataFrame, lex: Lexicon) -> DataFrame:
    """One row per matched clause: doc_id, the byte at which its first insult or threat starts, the text from there to its last one,
    matches, score."""
    shared = documents.sparkSession.sparkContext.broadcast(lex)
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_clause_batches(shared), "doc_id long, at_byte long, clause string, matches long, score double")


def rate(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from four fifths of the labelled ids, by crc32, and scores every row of ``documents``.

    Null ids are not learned from nor held out; repeated rows are scored each. Without labels the seed words and fixed weights
    decide. An empty table gives an empty table. Other columns are ignored.
    """
    fold = lambda c: F.crc32(c.cast("string").cast("binary")) % 5 == 0
    rows = stored(labelled(documents, labels.filter(~fold(F.col("doc_id"))).select("doc_id", "toxic")))
    return score(documents, learn(rows), F.coalesce(fold(F.col("doc_id").cast("long")), F.lit(False)))
