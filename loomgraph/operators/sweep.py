"""Which of many spans covers a span best, without listing the pairs.

Spans are dealt out by blocks of lines and sorted so that whatever can cover a span stands before it. Then "covers" is a matter
of position and end alone, and a merge over halves answers it for all spans at once: what stands in a left half covers those of
the right half whose ends are not larger. n spans of one block, be they all on one line, cost n * log(n) ** 2 array steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

BLOCK_LINES = 256
_OPEN = 1 << 40
KEY = ["group", "repo_url", "file_path", "line_block"]


def dominated(group: np.ndarray, end: np.ndarray, outer: np.ndarray, inner: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position: how many earlier outer positions of its group have an end not below its own, and the least rank of
    those (-1: none). Groups are contiguous; outer and inner are masks; ranks are at least 0."""
    n = len(end)
    count, best = np.zeros(n, np.int64), np.full(n, n + 1, np.int64)
    order = np.lexsort((end, group))
    # Equal ends of a group share the place of the first one, so "not below" is a range of places.
    place = np.empty(n, np.int64)
    fresh = np.concatenate([[True], (end[order][1:] != end[order][:-1]) | (group[order][1:] != group[order][:-1])]) if n else np.zeros(0, bool)
    place[order] = np.flatnonzero(fresh)[np.cumsum(fresh) - 1] if n else order
    group_end = np.searchsorted(group, group, "right")
    at = np.arange(n)
    for k in range(1, int(n - 1).bit_length() + 1 if n > 1 else 1):
        left = (at >> (k - 1)) & 1 == 0
        o, i = np.flatnonzero(left & outer), np.flatnonzero(~left & inner)
        if not len(o) or not len(i):
            continue
        key = (o >> k) * (n + 1) + place[o]
        by = np.argsort(key, kind="stable")
        o, key = o[by], key[by]
        lo = np.searchsorted(key, (i >> k) * (n + 1) + place[i], "left")
        hi = np.searchsorted(key, (i >> k) * (n + 1) + group_end[i], "left")
        # Least rank from here to the end of the half's group: segments get smaller numbers the later they are met backwards.
        segment = np.cumsum(np.concatenate([[0], ((o[1:] >> k) != (o[:-1] >> k)) | (group[o][1:] != group[o][:-1])]))
        least = np.minimum.accumulate((rank[o] + segment * (n + 2))[::-1])[::-1] - segment * (n + 2)
        some = lo < hi
        count[i] += hi - lo
        best[i[some]] = np.minimum(best[i[some]], least[lo[some]])
    return count, np.where(best > n, -1, best)


def _groups(t: pa.Table) -> np.ndarray:
    """Number of the group of each row; rows of a group follow each other."""
    new = np.zeros(len(t), bool)
    for c in KEY:
        column = t.column(c).combine_chunks()
        if len(column) > 1:
            differs = pc.fill_null(pc.not_equal(column[1:], column[:-1]), False)
            nulls = pc.not_equal(column[1:].is_null(), column[:-1].is_null())
            new[1:] |= pc.or_(differs, nulls).to_numpy(zero_copy_only=False)
    return np.cumsum(new)


def _rank(t: pa.Table, priority: list[str]) -> np.ndarray:
    rank = np.empty(len(t), np.int64)
    rank[pc.sort_indices(t, sort_keys=[(c, "ascending") for c in priority]).to_numpy()] = np.arange(len(t))
    return rank


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches cut so that a group stays together."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("group").to_numpy()
        cut = int(np.argmax(keys == keys[-1]))
        if cut or (rest and rest[-1].column("group")[0].as_py() != keys[0]):
            ready = pa.Table.from_batches([*rest, batch.slice(0, cut)])
            if len(ready):
                yield ready.combine_chunks()
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def _sweeper(kept: list[str], priority: list[str], result: list[str], kinds: list[str | None], counted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches):
            group, end = _groups(t), pc.fill_null(t.column("end_line").cast(pa.int64()), _OPEN).to_numpy()
            outer, inner = (t.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("is_outer", "is_inner"))
            # A span without a start or an end covers nothing and nothing covers it.
            outer = outer & (end < _OPEN) & pc.is_valid(t.column("start_line")).to_numpy(zero_copy_only=False)
            rank = _rank(t, priority)
            of_rank = np.argsort(rank)
            rows = np.flatnonzero(inner)
            columns, names = [t.column(c).take(pa.array(rows)).combine_chunks() for c in kept], list(kept)
            for kind in kinds:
                mask = outer if kind is None else outer & pc.fill_null(pc.equal(t.column("label"), kind), False).to_numpy(zero_copy_only=False)
                count, best = dominated(group, end, mask, inner, rank)
                found = pa.array(of_rank[best[rows]], mask=best[rows] < 0)
                for c in result:
                    columns.append(t.column(c).take(found).combine_chunks())
                    names.append(f"{kind or 'best'}_{c}")
                if counted:
                    columns.append(pa.array(count[rows]))
                    names.append(f"{kind or 'best'}_count")
            yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], names)

    return run


def _dealt(spans: DataFrame, block: Column) -> DataFrame:
    return spans.withColumn("line_block", block).withColumn("group", F.xxhash64("repo_url", "file_path", "line_block"))


def best_covering(inner: DataFrame, outer: DataFrame | None, kept: list[str], order: list[Column], priority: list[str], result: list[str],
                  kinds: list[str | None] | None = None, counted: bool = False) -> DataFrame:
    """For every row of ``inner`` (columns ``kept``) the ``result`` columns of the covering row of ``outer`` that is first by
    ``priority``, as best_<column> or, per value of ``label`` in ``kinds``, as <kind>_<column>; with ``counted`` the number of rows
    that cover it. Null where none does.

    Both tables have repo_url, file_path, start_line and end_line. Without ``outer``, the rows of ``inner`` cover each other: of
    equal spans the first by ``order`` covers the others. An outer span is listed once per block of lines that it touches.
    """
    first = F.floor(F.col("start_line") / BLOCK_LINES)
    touched = F.explode_outer(F.sequence(first, F.floor(F.col("end_line") / BLOCK_LINES)))
    if outer is None:
        rows = _dealt(inner, touched).withColumn("is_outer", F.lit(True)).withColumn("is_inner", F.col("line_block").eqNullSafe(first))
    else:
        rows = _dealt(inner, first).withColumn("is_outer", F.lit(False)).withColumn("is_inner", F.lit(True)).unionByName(
            _dealt(outer, touched).withColumn("is_outer", F.lit(True)).withColumn("is_inner", F.lit(False)), allowMissingColumns=True)
    # Rows that can cover a row stand before it: smaller start, then larger end, then the order of equal spans.
    ends = [F.desc("end_line"), *order] if outer is None else [F.desc("is_outer")]
    sorted_ = rows.repartition("group").sortWithinPartitions(*KEY, "start_line", *ends)
    fields = {f.name: f for f in rows.schema}
    named = [StructField(f"{k or 'best'}_{c}", fields[c].dataType) for k in kinds or [None] for c in result]
    if counted:
        step = len(result)
        named = [f for i, k in enumerate(kinds or [None]) for f in (*named[i * step : (i + 1) * step], StructField(f"{k or 'best'}_count", LongType()))]
    return sorted_.mapInArrow(_sweeper(kept, priority, result, kinds or [None], counted), StructType([fields[c] for c in kept] + named))
