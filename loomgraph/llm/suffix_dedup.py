"""Exact substring dedup: a depth-limited radix sort of all suffixes of all texts, through the first ``width`` bytes only.

Equal groups at depth ``width`` are the repeated windows. The most significant digit of a window is its minimiser, the smallest
hash among its ``gram``-byte pieces, instead of its first bytes: equal windows have equal minimisers, and neighbouring windows
mostly share one, so a run of neighbours travels as one record. The passes are

1. by minimiser: runs whose minimiser occurs once hold no repeated window and leave (most of a corpus);
2. by the whole span of a run: equal spans mean that all their windows are repeated, and only one run of each stays;
3. by cell, for the runs that are left: the bytes that STRIDE neighbouring windows share, then their whole span as in 2;
4. by window, for the cells that occur again in another span: where a repeated passage begins or ends.

Every window is in exactly one run, so no repetition is missed; keys are 128 bits of hash. Counts are added up before they are
shuffled, and joins back to runs are plain equi joins that adaptive execution may split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import as_signed, discard, mix, powers, prefix_sums, row_blocks, stored, utf8_rows

WIDTH, GRAM, STRIDE = 200, 80, 15
#: Bytes of text that are hashed at one time, and kept bytes that a worker gives on together.
BLOCK, GIVEN = 1 << 17, 1 << 22
RUN = "doc_id long, twin long, first long, windows int, gram long, span long, loops boolean"


def _minima(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n neighbours."""
    padded = np.full(-(-len(values) // n) * n, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    rows = padded.reshape(-1, n)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: len(values) - n + 1], ahead[n - 1 : len(values)])


def runs_of(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> list[np.ndarray]:
    """Runs of neighbouring windows with one minimiser: row, first byte in the row, windows, gram, span, loops."""
    none = [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool)]
    if len(data) < width:
        return none
    ends = np.repeat(offsets[1:], np.diff(offsets))
    at = np.flatnonzero(np.arange(len(data)) + width <= ends)
    if not len(at):
        return none
    sums, down = prefix_sums(data), powers(len(data) + 1)[1]
    grams = mix((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])
    least = _minima(grams, width - gram + 1)[at]
    begin = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)]))
    count = np.diff(begin, append=len(at))
    first = at[begin]
    past = first + count - 1 + width
    span = mix((sums[past] - sums[first]) * down[first] + mix(count.astype(np.uint64)))
    # Two equal windows in one run: the minimiser of the first one starts before the last window of the run does.
    early = grams[at] == least
    early[begin + count - 1] = False
    row = np.searchsorted(offsets, first, "right") - 1
    return [row, first - offsets[row], count, least[begin], span, np.logical_or.reduceat(early, begin)]


def segments(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, byte of the row, data, offsets) of blocks of rows; a longer row comes in pieces that share no window."""
    for a, b in row_blocks(offsets, BLOCK):
        lo, hi = int(offsets[a]), int(offsets[b])
        if hi - lo <= 2 * BLOCK:
            yield a, 0, data[lo:hi], offsets[a : b + 1] - lo
            continue
        for begin in range(lo, hi, BLOCK):
            piece = data[begin : min(begin + BLOCK + width - 1, hi)]
            yield a, begin - lo, piece, np.array([0, len(piece)])


def _scan(width: int, gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_rows(batch.column("text"))
            for a, base, piece, at in segments(data, offsets, width):
                row, first, count, least, span, loops = runs_of(piece, at, width, gram)
                if len(row):
                    rows = pa.array(row + a)
                    columns = [batch.column("doc_id").take(rows), batch.column("twin").take(rows), pa.array(first + base), pa.array(count, pa.int32()), pa.array(as_signed(least)), pa.array(as_signed(span)), pa.array(loops)]
                    yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RUN.split(", ")])

    return run


def _groups(begins: np.ndarray, stops: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """Indices of byte ranges [begin, stop) in groups, each with the stretch of text that holds it."""
    order = np.argsort(begins, kind="stable")
    lo = 0
    while lo < len(order):
        start = int(begins[order[lo]])
        hi = max(lo + 1, int(np.searchsorted(begins[order], start + BLOCK)))
        yield order[lo:hi], start, int(stops[order[lo:hi]].max())
        lo = hi


def _ranges(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [begin, begin + count), and the range each is from."""
    owner = np.repeat(np.arange(len(count)), count)
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum()), owner


CELL = "doc_id long, twin long, gram long, key long, span long, first long, count int, alone boolean, sure boolean"


def _batch(batch: pa.RecordBatch, i: int, gram: np.ndarray, key: np.ndarray, span: np.ndarray, first: np.ndarray, count: np.ndarray, alone: np.ndarray, sure: bool = False) -> pa.RecordBatch:
    rows = pa.array(np.full(len(first), i))
    columns = [batch.column("doc_id").take(rows), batch.column("twin").take(rows), pa.array(gram, pa.int64()), pa.array(as_signed(key)), pa.array(as_signed(span)), pa.array(first, pa.int64()), pa.array(count, pa.int32()), pa.array(alone, pa.bool_()), pa.array(np.full(len(first), sure))]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in CELL.split(", ")])


def _cells(width: int, gram: int, stride: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keys of the cells of listed runs; with each, the windows it stands for: [first, first + count).

    A cell is width - stride + 1 bytes long and begins a multiple of ``stride`` bytes before or behind the first minimiser of the
    windows. Every window holds the cell that begins in its first ``stride`` bytes, so equal windows have an equal cell. Runs
    that loop have no single minimiser and give a cell for each byte in which one of their different windows can have it;
    windows that such a run repeats itself are ``sure``: they come as ranges that need no further pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_rows(batch.column("text"))
            for i, listed in enumerate(batch.column("runs")):
                first, windows, least, alone, loops = (listed.values.field(c).to_numpy(zero_copy_only=False) for c in ("first", "windows", "gram", "alone", "loops"))
                for group, start, stop in _groups(first, first + windows - 1 + width):
                    piece = data[offsets[i] + start : offsets[i] + stop]
                    sums, down = prefix_sums(piece), powers(len(piece) + 1)[1]
                    begin, n, value = first[group] - start, windows[group].astype(np.int64), least[group]
                    grams = mix((sums[gram:] - sums[:-gram]) * down[: len(piece) - gram + 1]).view(np.int64)
                    at, owner = _ranges(begin, n + width - gram)
                    place = np.where(grams[at] == value[owner], at, len(piece))
                    anchor = np.minimum.reduceat(place, np.concatenate([[0], np.cumsum(n + width - gram)[:-1]]))
                    wanted = np.zeros(len(piece) + stride, bool)
                    if loops[group].any():
                        loop = np.flatnonzero(loops[group])
                        at, owner = _ranges(begin[loop], n[loop])
                        key = mix((sums[at + width] - sums[at]) * down[at] + loop[owner].astype(np.uint64))
                        _, one, back, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                        for k in range(stride):
                            wanted[at[one] + k] = True
                        sure = (times[back] > 1) & alone[group][loop][owner]
                        if sure.any():
                            at, owner = at[sure], owner[sure]
                            head = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(owner) != 0)]))
                            count = np.diff(head, append=len(at))
                            of = loop[owner[head]]
                            nothing = np.zeros(len(head), np.uint64)
                            yield _batch(batch, i, value[of], nothing, nothing, at[head] + start, count, alone[group][of], True)
                    at, owner = _ranges(begin, n + stride - 1)
                    chosen = np.where(loops[group][owner], wanted[at], (at - anchor[owner]) % stride == 0)
                    at, owner = at[chosen], owner[chosen]
                    size = width - stride + 1
                    key = mix((sums[at + size] - sums[at]) * down[at] + np.uint64(size))
                    low, high = np.maximum(at - stride + 1, begin[owner]), np.minimum(at, begin[owner] + n[owner] - 1)
                    span = mix((sums[high + width] - sums[low]) * down[low] + mix((high - low).astype(np.uint64)))
                    yield _batch(batch, i, value[owner], key, span, low + start, high - low + 1, alone[group][owner])

    return run


def _windows(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keys of all windows of the ranges listed with each text, each window once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_rows(batch.column("text"))
            for i, listed in enumerate(batch.column("ranges")):
                first, count, least, alone = (listed.values.field(c).to_numpy(zero_copy_only=False) for c in ("first", "count", "gram", "alone"))
                done = -1
                for group, start, stop in _groups(first, first + count - 1 + width):
                    piece = data[offsets[i] + start : offsets[i] + stop]
                    sums, down = prefix_sums(piece), powers(len(piece) + 1)[1]
                    at, owner = _ranges(first[group] - start, count[group].astype(np.int64))
                    at, new = np.unique(at, return_index=True)
                    later = at + start > done
                    at, owner = at[later], owner[new][later]
                    if not len(at):
                        continue
                    done = int(at[-1]) + start
                    key = mix((sums[at + width] - sums[at]) * down[at] + np.uint64(width))
                    yield _batch(batch, i, least[group][owner], key, key, at + start, np.ones(len(at)), alone[group][owner])

    return run


def _rows(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("twin"), text.alias("text"))


def _twice(cells: DataFrame) -> DataFrame:
    return cells.groupBy("gram", "key").agg(F.count("*").alias("n")).filter("n > 1").select("gram", "key")


def repeated_spans(documents: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, twin, spans): byte ranges [first, past) whose union is all bytes in windows that also start elsewhere.

    ``twin`` is a hash of the text, so rows with one doc_id and different texts stay apart. Repeated rows are copies of each
    other, so all their windows are repeated. Texts shorter than ``width`` bytes have no window.
    """
    rows = _rows(documents)
    runs = rows.mapInArrow(_scan(width, gram), RUN)
    again = runs.groupBy("gram").agg(F.count("*").alias("n"), F.max("loops").alias("any")).filter((F.col("n") > 1) | F.col("any")).select("gram")
    left = stored(runs.join(again, "gram"))
    spans = left.groupBy("gram", "span").agg(F.count("*").alias("n"), F.max("loops").alias("loops"), F.min(F.struct("doc_id", "twin", "first", "windows")).alias("r"))
    spans = stored(spans)
    mixed = spans.groupBy("gram").agg(F.count("*").alias("k"), F.sum((F.col("n") == 1).cast("int")).alias("singles")).filter("k > 1 and singles > 0").select("gram", F.lit(True).alias("mixed"))
    open_ = spans.join(mixed, "gram", "left").filter(F.col("mixed") | (F.col("loops") & (F.col("n") == 1)))
    run = F.struct("first", "windows", "gram", "alone", "loops")
    listed = open_.select("gram", "loops", (F.col("n") == 1).alias("alone"), "r.*").groupBy("doc_id", "twin").agg(F.collect_list(run).alias("runs")).withColumnsRenamed({"doc_id": "_d", "twin": "_t"})
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("twin") == F.col("_t"))
    texts = stored(rows.join(listed, same).select("doc_id", "twin", "text", "runs"))
    cells = stored(texts.mapInArrow(_cells(width, gram, min(STRIDE, width - gram)), CELL))
    open_cells = cells.filter("NOT sure")
    of_span = stored(open_cells.groupBy("gram", "key", "span").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "twin", "first", "count", "alone")).alias("r")))
    mixed = of_span.groupBy("gram", "key").agg(F.count("*").alias("k"), F.sum((F.col("n") == 1).cast("int")).alias("singles")).filter("k > 1 and singles > 0").select("gram", "key")
    near = of_span.join(mixed, ["gram", "key"]).select("gram", "r.doc_id", "r.twin", "r.first", "r.count", (F.col("r.alone") & (F.col("n") == 1)).alias("alone"))
    ranges = near.groupBy("doc_id", "twin").agg(F.collect_list(F.struct("first", "count", "gram", "alone")).alias("ranges")).withColumnsRenamed({"doc_id": "_d", "twin": "_t"})
    same_span = open_cells.filter("alone").join(of_span.filter("n > 1").select("gram", "key", "span"), ["gram", "key", "span"])
    windows = stored(texts.select("doc_id", "twin", "text").join(ranges, same).select("doc_id", "twin", "text", "ranges").mapInArrow(_windows(width), CELL))
    discard(texts)
    repeated = cells.filter("sure").select("doc_id", "twin", "first", "count").union(same_span.select("doc_id", "twin", "first", "count")).select("doc_id", "twin", "first", (F.col("first") + F.col("count") - 1 + width).alias("past"))
    partly = windows.filter("alone").join(_twice(windows), ["gram", "key"]).select("doc_id", "twin", "first", (F.col("first") + width).alias("past"))
    whole = left.join(spans.filter("n > 1").select("gram", "span"), ["gram", "span"])
    every = whole.select("doc_id", "twin", "first", (F.col("first") + F.col("windows") - 1 + width).alias("past")).union(partly).union(repeated)
    found = stored(every.groupBy("doc_id", "twin").agg(F.collect_list(F.struct("first", "past")).alias("spans")))
    discard(left, spans, cells, of_span, windows)
    return found


def _union(first: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs that ranges [first, past) cover."""
    order = np.argsort(first, kind="stable")
    begin, reach = first[order], np.maximum.accumulate(past[order])
    head = np.flatnonzero(np.concatenate([[True], begin[1:] > reach[:-1]]))
    return begin[head], reach[np.append(head[1:], len(begin)) - 1]


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without their spans, about GIVEN kept bytes at a time; no work array is as long as a text."""
    for batch in batches:
        data, offsets = utf8_rows(batch.column("text"))
        removed, spans, kept, size = [], [], [], 0
        for i, listed in enumerate(batch.column("spans")):
            text = data[offsets[i] : offsets[i + 1]]
            if listed.is_valid and len(listed):
                begin, end = _union(*(listed.values.field(c).to_numpy(zero_copy_only=False) for c in ("first", "past")))
                kept.append(b"".join(text[lo:hi] for lo, hi in zip([0, *end.tolist()], [*begin.tolist(), len(text)], strict=True)))
                removed.append(len(text) - len(kept[-1]))
                spans.append(len(begin))
            else:
                kept.append(text.tobytes())
                removed.append(0)
                spans.append(0)
            size += len(kept[-1])
            if size >= GIVEN or i == len(batch) - 1:
                done = i + 1 - len(kept)
                columns = [batch.column("doc_id").slice(done, len(kept)), pa.array(np.diff(offsets[done : i + 2]), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
                removed, spans, kept, size = [], [], [], 0


def remove_repeats(documents: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes of every row. Null text is empty. What is left is bytes: a cut
    may fall within a character. An empty table gives an empty table."""
    listed = repeated_spans(documents, width, gram).withColumnsRenamed({"doc_id": "_d", "twin": "_t"})
    texts = _rows(documents).join(listed, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("twin") == F.col("_t")), "left")
    return texts.select("doc_id", "text", "spans").mapInArrow(_cut_batches, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(documents: DataFrame) -> DataFrame:
    out = remove_repeats(documents)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
