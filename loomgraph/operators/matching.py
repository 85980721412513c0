"""Which of many needles stand in which texts: one pass over each text, with an automaton or with window hashes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

#: Characters of all needles that one automaton holds about; more needles make more passes over the texts.
SHARD = 8_000_000
#: Hits that a worker holds before it gives them on.
HITS = 100_000
#: Bytes that tell long needles from most of a text, and bits of the tables that know their starts and their hashes.
START, START_BITS, HASH_BITS = 8, 22, 26
#: Bytes of text that are hashed at one time.
SLICE = 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)

_built: dict[int, tuple[object, object]] = {}


def once_built(shared, make: Callable):  # noqa: ANN001, ANN201
    """What ``make`` builds of a broadcast value; built once in a worker, where the one of an earlier query goes."""
    key = id(shared.value)
    if key not in _built:
        made = make(shared.value)
        _built.clear()
        _built[key] = (shared.value, made)
    return _built[key][1]


class _Needles:
    """Automaton whose hits are needle numbers, and the rows of fields that each needle stands for."""

    def __init__(self, table: pa.Table, fields: list[str], owner: str | None):
        needles: dict[str, int] = {}
        rows: dict[tuple, int] = {}  # needle rows with equal fields are one
        first: list[int] = []
        pairs: list[tuple[int, int]] = []
        for k, (needle, *row) in enumerate(zip(*[table.column(c).to_pylist() for c in ["needle", *fields]], strict=True)):
            if tuple(row) not in rows:
                rows[tuple(row)] = len(rows)
                first.append(k)
            pairs.append((needles.setdefault(needle, len(needles)), rows[tuple(row)]))
        self.automaton = ahocorasick.Automaton()
        for needle, k in needles.items():
            self.automaton.add_word(needle, k)
        self.automaton.make_automaton()
        of, self.row = np.array(sorted(set(pairs)), dtype=np.int64).reshape(-1, 2).T
        self.start = np.searchsorted(of, np.arange(len(needles) + 1))
        self.single = len(self.row) == len(needles) == len(rows)
        self.n_rows = len(rows)
        kept = table.take(pa.array(first, pa.int64()))
        self.fields = [_whole(kept.column(c)) for c in fields]
        if owner:
            self.total = kept.column("total").to_numpy()
            lists = _whole(kept.column("owners"))
            entries = lists.flatten()
            self.names = {name: k for k, name in enumerate(pc.unique(entries.field(0)).to_pylist())}
            code = np.repeat(np.arange(len(kept)), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
            code = code * (len(self.names) + 1) + np.array([self.names[name] for name in entries.field(0).to_pylist()], dtype=np.int64)
            order = np.argsort(code)
            self.code, self.own = np.append(code[order], -1), np.append(entries.field(1).to_numpy(zero_copy_only=False)[order], 0)

    def of_others(self, row: np.ndarray, owners: list) -> np.ndarray:
        """Total of each row of fields without the part of the owner beside it."""
        code = row * (len(self.names) + 1) + np.array([self.names.get(x, len(self.names)) for x in owners], dtype=np.int64)
        at = np.searchsorted(self.code[:-1], code)
        return self.total[row] - np.where(self.code[at] == code, self.own[at], 0)

    def expand(self, text: np.ndarray, needle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, row of fields) of needle hits, ordered, each once."""
        if self.single:
            return text, self.row[needle]
        n = self.start[needle + 1] - self.start[needle]
        at = np.repeat(self.start[needle] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        both = np.unique(np.repeat(text, n) * self.n_rows + self.row[at])
        return both // self.n_rows, both % self.n_rows


def _whole(column: pa.ChunkedArray) -> pa.Array:
    made = column.combine_chunks()
    return made if isinstance(made, pa.Array) else made.chunk(0) if made.num_chunks else pa.array([], column.type)


def _found(automaton: ahocorasick.Automaton, texts: list) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(texts done, text number, needle number) of slices of the texts, about HITS hits each. A text may be a list of texts."""
    number = itemgetter(1)
    done, counts, hits = 0, [], []
    for k, text in enumerate(texts):
        found: set[int] = set()
        for part in [text] if isinstance(text, str) else text:
            found.update(map(number, automaton.iter(part)))
        counts.append(len(found))
        hits += found
        if len(hits) >= HITS or k == len(texts) - 1:
            yield k + 1, np.repeat(np.arange(done, k + 1), counts), np.array(hits, dtype=np.int64)
            done, counts, hits = k + 1, [], []


def _matcher(shared, ids: list[str], fields: list[str], owner: str | None, grouped: str | None, once: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        needles = once_built(shared, lambda table: _Needles(table, fields, owner))
        for batch in batches:
            held = batch.select(ids)
            if once:  # equal ids are one, named by their first row
                seen: dict[tuple, int] = {}
                first = np.array([seen.setdefault(tuple(r.values()), k) for k, r in enumerate(held.to_pylist())], dtype=np.int64)
                given: np.ndarray = np.empty(0, dtype=np.int64)
            owners = batch.column(ids.index(owner)).to_pylist() if owner else None
            begun = 0
            for done, text, needle in _found(needles.automaton, batch.column(len(ids)).to_pylist()):
                text, row = needles.expand(text, needle)
                if once:
                    new = np.setdiff1d(first[text] * needles.n_rows + row, given)
                    given = np.union1d(given, new)
                    text, row = new // needles.n_rows, new % needles.n_rows
                n = []
                if owner:
                    left = needles.of_others(row, [owners[k] for k in text])
                    text, row, n = text[left > 0], row[left > 0], [pa.array(left[left > 0], pa.int64())]
                columns = [c.take(pa.array(row)) for c in needles.fields]
                if grouped:
                    ends = np.searchsorted(text, np.arange(begun, done + 1)).astype(np.int32)
                    items = pa.StructArray.from_arrays(columns, fields)
                    some = np.flatnonzero(np.diff(ends)) + begun
                    lists = pa.ListArray.from_arrays(pa.array(np.append(ends[some - begun], ends[-1]).astype(np.int32)), items)
                    yield pa.RecordBatch.from_arrays([*held.take(pa.array(some)).columns, lists], [*ids, grouped])
                else:
                    yield pa.RecordBatch.from_arrays([*held.take(pa.array(text)).columns, *columns, *n], [*ids, *fields, *(["n"] if owner else [])])
                begun = done

    return run


def mentions(texts: DataFrame, needles: DataFrame, id_columns: list[str], fields: list[str], shard: int = SHARD,
             owner: str | None = None, grouped: str | None = None, once: bool = False) -> DataFrame:
    """(id columns, fields) for every text that contains a needle, letter for letter; each once per row of ``texts`` and automaton.

    ``fields`` are columns of ``needles``, which may name one needle several times. A text is read once for every ``shard``
    characters of needles, in time linear in its length and its hits, however long its words are. Texts are not shuffled;
    needles are dealt into automata of bounded size by a hash of the fields, so that equal fields meet. Null texts and needles
    without a visible character give nothing. The number of automata is read when the query is built. ``text`` may be an
    array of texts that count as one.

    ``owner`` names an id column; ``needles`` then tells of the fields a ``total`` and ``owners``, an array of (owner, count).
    Rows get ``n``, the total without the count of the text's own owner; those where nothing is left go. ``grouped`` makes one
    row of every text with an array of that name, of structs of the fields without ``n``. ``once`` gives equal ids each field once per batch.
    """
    extra = ["total", "owners"] if owner else []
    wanted = needles.select(*dict.fromkeys(["needle", *fields, *extra])).filter(F.col("needle").rlike(r"\S")).dropDuplicates(
        [*dict.fromkeys(["needle", *fields])])
    text = F.col("text") if isinstance(texts.schema["text"].dataType, ArrayType) else F.col("text").cast("string")
    rows = texts.select(*id_columns, text.alias("text")).filter("text IS NOT NULL")
    found_fields = [wanted.schema[c] for c in fields]
    schema = StructType([rows.schema[c] for c in id_columns] + (
        [StructField(grouped, ArrayType(StructType(found_fields)))] if grouped else found_fields + [StructField("n", LongType())] * bool(owner)))
    total = wanted.agg(F.sum(F.length("needle"))).first()[0] or 0
    shards = max(1, math.ceil(total / shard))
    parts = []
    for k in range(shards):
        part = wanted.filter(F.pmod(F.xxhash64(*fields), F.lit(shards)) == k).toArrow()
        if len(part):
            shared = texts.sparkSession.sparkContext.broadcast(part)
            parts.append(rows.mapInArrow(_matcher(shared, id_columns, fields, owner, grouped, once), schema))
    if not parts:
        return texts.sparkSession.createDataFrame([], schema)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    if grouped and len(parts) > 1:
        found = found.groupBy(*id_columns).agg(F.flatten(F.collect_list(grouped)).alias(grouped))
    return found


# --- many long needles -----------------------------------------------------------------------------------
def _windows(data: np.ndarray) -> np.ndarray:
    """The START bytes at every place of the data as a number."""
    return np.ndarray((max(0, len(data) - START + 1),), dtype="<u8", buffer=data, strides=(1,))


def _hashed(windows: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Number under HASH_BITS bits of the ``length`` bytes at each place."""
    h = np.full(len(at), length, dtype=np.uint64)
    for k in [*range(0, length - START, START), length - START]:
        h = (h ^ windows[at + k]) * _ODD
        h ^= h >> np.uint64(29)
    return (h * _ODD) >> np.uint64(64 - HASH_BITS)


def _started(windows: np.ndarray) -> np.ndarray:
    return (windows * _ODD) >> np.uint64(64 - START_BITS)


def _needle_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        start, hashed, length = [], [], []
        for needle in batch.column(0).to_pylist():
            w = _windows(np.frombuffer(needle.encode(), dtype=np.uint8))
            start.append(_started(w[:1])[0])
            hashed.append(_hashed(w, np.zeros(1, dtype=np.int64), len(w) + START - 1)[0])
            length.append(len(w) + START - 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(x, dtype=np.int64)) for x in (start, hashed, length)], ["start", "hashed", "length"])


def _bits(numbers: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(1 << bits, dtype=bool)
    out[numbers] = True
    return np.packbits(out, bitorder="little")


def _has(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    return (bits[numbers >> np.uint64(3)] >> (numbers & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _candidates(shared, ids: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:  # noqa: ANN001
    """Arrow function: pieces of the texts that start like a needle and have the length and the hash of one."""
    def pieces(texts: list[bytes]) -> tuple[list[int], list[str]]:
        starts, hashes, lengths = shared.value
        ends = np.cumsum([len(t) for t in texts])
        data = b"".join(texts)
        if len(data) < START:
            return [], []
        windows = _windows(np.frombuffer(data, dtype=np.uint8))
        at = np.flatnonzero(_has(starts, _started(windows)))
        text = np.searchsorted(ends, at, "right")
        found = set()
        for length in lengths:
            inside = at + length <= ends[text]
            p, t = at[inside], text[inside]
            hit = _has(hashes, _hashed(windows, p, length))
            found.update((k, data[a:a + length]) for k, a in zip(t[hit].tolist(), p[hit].tolist(), strict=True))
        rows, out = [], []
        for k, piece in found:
            try:
                out.append(piece.decode())
                rows.append(k)
            except UnicodeDecodeError:  # cut inside a letter: no needle
                pass
        return rows, out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, texts, first, n = batch.select(ids), [], 0, 0
            column = batch.column(len(ids)).cast(pa.binary())
            for k in range(len(batch)):
                texts.append(column[k].as_py())
                n += len(texts[-1])
                if n >= SLICE or k == len(batch) - 1:
                    rows, out = pieces(texts)
                    yield pa.RecordBatch.from_arrays(
                        [*held.take(pa.array(np.array(rows, dtype=np.int64) + first)).columns, pa.array(out, pa.string())], [*ids, "needle"])
                    texts, first, n = [], k + 1, 0

    return run


def text_mentions(texts: DataFrame, needles: DataFrame, id_columns: list[str], shard: int = SHARD) -> DataFrame:
    """Distinct (id columns, needle) for every text that contains the needle.

    Needles of at least START bytes need no automaton, so a text is read once however many they are: of all needles a worker
    holds two tables of bits (first bytes; hash of the whole) and the distinct lengths. Pieces of a text that pass both
    are joined with the needles, which leaves the true ones. Shorter needles go the way of ``mentions``.
    """
    wanted = needles.select(F.col("needle").cast("string").alias("needle")).filter(F.col("needle").rlike(r"\S")).distinct()
    rows = texts.select(*id_columns, F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    long = wanted.filter(F.octet_length("needle") >= START)
    short = mentions(rows, wanted.filter(F.octet_length("needle") < START), id_columns, ["needle"], shard).distinct()
    bits = long.mapInArrow(_needle_bits, "start long, hashed long, length long")
    sketch = bits.distinct().toArrow()  # numbers below 2 ** HASH_BITS, no text
    if not len(sketch):
        return short
    start, hashed, length = (sketch.column(c).to_numpy() for c in ("start", "hashed", "length"))
    shared = texts.sparkSession.sparkContext.broadcast((_bits(start, START_BITS), _bits(hashed, HASH_BITS), np.unique(length).tolist()))
    schema = StructType([rows.schema[c] for c in id_columns] + [wanted.schema["needle"]])
    found = rows.mapInArrow(_candidates(shared, id_columns), schema).distinct().join(long, "needle", "left_semi")
    return found.select(*id_columns, "needle").unionByName(short)
