"""Ranked lexical search by way of equal bags: documents are cut down to the vocabulary of the items, those with the same term
counts and the same length factor are one class, a class is scored once, and its members follow in the order of doc_id.

A class keeps its ``top`` smallest doc_ids: with equal scores the smaller doc_id wins, so no other member can be among the best.
Items are dealt into blocks whose postings have a fixed size; each block is scored against all classes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import as_signed, row_blocks, stored, utf8_rows
from loomgraph.llm.tokens import ASCII_LOWER, TERM, tokens

#: Terms of all items that are sent to the tasks at most; beyond that bags keep all their terms. Postings of a block of items.
VOCABULARY, PAIRS = 4_000_000, 1_000_000
#: Entries of the score matrix and of the expanded postings that a task holds at a time.
CELLS, EXPANDED = 1 << 20, 1 << 21
_LAST = np.iinfo(np.int64).max


def _bag_batches(vocabulary) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if vocabulary is None else vocabulary.value
        for batch in batches:
            data, offsets = utf8_rows(batch.column(1))
            for lo, hi in row_blocks(offsets):
                yield _bags(batch.column(0).slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], known)

    return run


def _bags(ids: pa.Array, data: np.ndarray, offsets: np.ndarray, known: np.ndarray | None) -> pa.RecordBatch:
    n = np.zeros(len(ids), np.int64)
    rows, codes, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for t in tokens(data, offsets, TERM, ASCII_LOWER):
        n += np.bincount(t.row, minlength=len(n))
        code, row = as_signed(t.code), t.row
        if known is not None:
            if not len(known):
                continue
            at = np.minimum(np.searchsorted(known, code), len(known) - 1)
            hit = known[at] == code
            names, place, row = known, at[hit], row[hit]
        else:
            names, place = np.unique(code, return_inverse=True)
        key, times = np.unique(row * len(names) + place, return_counts=True)
        rows.append(key // max(len(names), 1))
        codes.append(names[key % max(len(names), 1)])
        counts.append(times)
    row, code, count = np.concatenate(rows), np.concatenate(codes), np.concatenate(counts)
    order = np.lexsort((code, row))
    row, code, count = row[order], code[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])])) if len(row) else np.zeros(0, np.int64)
    tf = np.add.reduceat(count, first) if len(first) else count
    at = np.searchsorted(row[first], np.arange(len(ids) + 1)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x, pa.int64())) for x in (code[first], tf)]
    return pa.RecordBatch.from_arrays([ids, pa.array(n), *lists], ["doc_id", "n", "terms", "tfs"])


def bags(documents: DataFrame, vocabulary: np.ndarray | None) -> DataFrame:
    """doc_id, n (terms with repeats), terms (sorted hashes) and tfs of every row; ``vocabulary``: sorted hashes, None keeps all."""
    shared = None if vocabulary is None else documents.sparkSession.sparkContext.broadcast(vocabulary)
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_bag_batches(shared), "doc_id long, n long, terms array<long>, tfs array<long>")


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term) of all items. Rows with one item_id are one item."""
    named = items.select(F.col("item_id").alias("doc_id"), "text")
    return bags(named, None).select(F.col("doc_id").alias("item_id"), F.explode("terms").alias("term")).distinct()


def classes(bagged: DataFrame, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """One row per distinct (terms, tfs, m) with its ``top`` smallest doc_ids in order (null last).

    The hash only decides where rows meet; the bags themselves are compared. Every task keeps ``top`` rows of a class before
    the shuffle, so thousands of copies weigh little.
    """
    m = F.expr(f"cast(10 + (90L * n * {n_docs}L) div {max(n_terms, 1)}L as bigint)")
    rows = bagged.filter(F.size("terms") > 0).select("doc_id", m.alias("m"), "terms", "tfs")
    rows = rows.withColumn("bag", F.xxhash64("m", "terms", "tfs"))
    key = ["bag", "m", "terms", "tfs"]
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(F.asc_nulls_last("doc_id")))).filter(F.col("place") <= top)
    members = F.transform(F.array_sort(F.collect_list(F.struct("place", "doc_id"))), lambda x: x["doc_id"])
    return rows.groupBy(*key).agg(members.alias("members")).select("members", "m", "terms", "tfs")


class Postings:
    """Items by term: the slice ``starts[t]:starts[t + 1]`` of ``items`` holds those with the term ``terms[t]``; ``ids``: their ids."""

    def __init__(self, item_id: pa.Array, term: np.ndarray, weight: np.ndarray):
        coded = item_id.cast(pa.int64()).dictionary_encode(null_encoding="encode")
        item, self.ids = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        order = np.lexsort((item, term))
        self.items, term = item[order], term[order]
        self.terms, first = np.unique(term, return_index=True)
        self.starts, self.weights = np.append(first, len(term)), weight[order][first]
        self.n_items = len(self.ids)


def score_rows(p: Postings, row: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray, n: int) -> np.ndarray:
    """Scores (n rows x items) of bags given as (row, term, tf) entries; m per row. 64-bit integers throughout."""
    scores = np.zeros(n * p.n_items, np.int64)
    at = np.minimum(np.searchsorted(p.terms, term), len(p.terms) - 1)
    hit = np.flatnonzero(p.terms[at] == term)
    at, row, tf = at[hit], row[hit], tf[hit]
    value = p.weights[at] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
    length = p.starts[at + 1] - p.starts[at]
    total = np.concatenate([[0], np.cumsum(length)])
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + EXPANDED, "right")) - 1)
        size = length[lo:hi]
        place = np.repeat(p.starts[at[lo:hi]] - (total[lo:hi] - total[lo]), size) + np.arange(total[hi] - total[lo])
        np.add.at(scores, np.repeat(row[lo:hi], size) * p.n_items + p.items[place], np.repeat(value[lo:hi], size))
        lo = hi
    return scores.reshape(n, p.n_items)


class Best:
    """The ``top`` best classes of every item so far, by score and then by smallest member."""

    def __init__(self, n_items: int, top: int):
        self.top, self.floor = top, np.zeros(n_items, np.int64)
        self.item, self.score, self.first = (np.zeros(0, np.int64) for _ in range(3))
        self.members: list[list[int | None]] = []

    def add(self, scores: np.ndarray, first: np.ndarray, members: list[list[int | None]]) -> None:
        row, item = np.nonzero((scores > 0) & (scores >= self.floor))
        if not len(row):
            return
        source = np.concatenate([np.arange(len(self.item)), len(self.item) + row])
        item, score, first = np.concatenate([self.item, item]), np.concatenate([self.score, scores[row, item]]), np.concatenate([self.first, first[row]])
        order = np.lexsort((first, -score, item))
        begin = np.searchsorted(item[order], item[order], "left")
        order = order[np.arange(len(order)) - begin < self.top]
        known = len(self.item)
        self.item, self.score, self.first = item[order], score[order], first[order]
        self.members = [self.members[k] if k < known else members[k - known] for k in source[order].tolist()]
        full = np.bincount(self.item, minlength=len(self.floor)) == self.top
        worst = np.zeros_like(self.floor)
        worst[self.item] = self.score  # in order of falling scores: the last one stays
        self.floor = np.where(full, worst, 0)


def _score_batches(shared, top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Postings = shared.value
        best, step = Best(p.n_items, top), max(1, CELLS // max(p.n_items, 1))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                n, members = part.num_rows, part.column(0).to_pylist()
                first = np.array([_LAST if x[0] is None else x[0] for x in members], np.int64)
                terms = part.column(2)
                row = np.repeat(np.arange(n), terms.value_lengths().to_numpy())
                best.add(score_rows(p, row, terms.flatten().to_numpy(), part.column(3).flatten().to_numpy(), part.column(1).to_numpy(), n), first, members)
        ids = p.ids.take(pa.array(best.item))
        yield pa.RecordBatch.from_arrays([ids, pa.array(best.score), pa.array(best.members, pa.list_(pa.int64()))], ["item_id", "score", "members"])

    return run


def search(items: DataFrame, documents: DataFrame, top: int = 10, vocabulary_limit: int = VOCABULARY, pairs: int = PAIRS) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` best documents with a score above 0 for each item.

    Null or empty texts have no terms: such documents count nowhere, such items get no rows. Rows of ``documents`` are
    documents of their own even when they repeat; among equal scores a null doc_id comes last. Rows with one item_id are one
    item whose terms are put together; a null item_id is one more item. Empty tables give an empty table. Other columns are
    ignored.
    """
    spark = documents.sparkSession
    wanted = stored(item_terms(items))
    names = wanted.select("term").distinct()
    n_names = names.count()
    vocabulary = np.sort(names.toArrow()["term"].to_numpy()) if n_names <= vocabulary_limit else None
    bagged = stored(bags(documents, vocabulary))
    n_docs, n_terms = bagged.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    counted = bagged.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    postings = stored(wanted.join(counted, "term").select("item_id", "term", "df"))
    blocks = max(1, math.ceil(postings.count() / pairs))
    groups = classes(bagged, n_docs, n_terms, top)
    groups = stored(groups) if blocks > 1 else groups
    found = []
    for block in range(blocks):
        here = postings.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toArrow()
        df = here["df"].to_numpy()
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        shared = spark.sparkContext.broadcast(Postings(here["item_id"].combine_chunks(), here["term"].to_numpy(), weight))
        if not len(df):
            continue
        scored = groups.mapInArrow(_score_batches(shared, top), "item_id long, score long, members array<long>")
        found.append(scored.select("item_id", "score", F.explode("members").alias("doc_id")))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rows = found[0]
    for other in found[1:]:
        rows = rows.unionByName(other)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


#: The same ranking from all postings, without classes.
ORACLE = r"""
WITH split AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS terms
  FROM documents),
lengths AS (SELECT row, doc_id, len(terms) AS n FROM split WHERE len(terms) > 0),
corpus AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM lengths),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term
  FROM benchmark),
tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM split) WHERE term IN (SELECT term FROM wanted) GROUP BY row, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM df, corpus),
part AS (
  SELECT tf.row, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // l))) AS part
  FROM tf JOIN lengths ON lengths.row = tf.row JOIN weight USING (term), corpus),
total AS (SELECT item_id, row, CAST(sum(part) AS BIGINT) AS score FROM wanted JOIN part USING (term) GROUP BY item_id, row),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
  FROM total JOIN lengths USING (row) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
