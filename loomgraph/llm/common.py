"""Helpers of the operators: reading tables, tables kept in the shared folder, bytes and words of Arrow columns."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: [\x20\x09-\x0D]: what separates words and is stripped from lines.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. A local session without one gets a scratch folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        folder = tempfile.mkdtemp(prefix="loomgraph-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # Shuffle files go when the driver's JVM finds that nothing refers to them; big steps in a row would fill the disks first.
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    kept = spark.read.schema(df.schema).parquet(path)
    kept.stored_at = path
    return kept


def discard(*tables: DataFrame) -> None:
    """Remove stored tables that nothing will read again."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else. ``lower`` does the same on ASCII text and is faster there."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


# --- bytes and words of an Arrow string column ---------------------------------------------------------------------

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES.encode())] = True
_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_RANDOM = np.random.default_rng(20240601)
BYTE_CODES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64 for i < n."""
    if "up" not in _powers or len(_powers["up"]) < n:
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            steps = np.full(max(1 << (n - 1).bit_length(), 1 << 16), base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values, so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of code * BASE ** i; the hash of data[a:b] is (sums[b] - sums[a]) * BASE ** -a."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * powers(len(data))[0], out=sums[1:])
    return sums


def utf8_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def row_blocks(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes together, or one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and the row of each word."""
    inside = ~_IS_SPACE[data]
    first = np.ones(len(data) + 1, bool)
    first[1:-1] = ~inside[:-1]
    first[offsets] = True
    starts = np.flatnonzero(inside & first[:-1])
    last = np.ones(len(data) + 1, bool)
    last[:-1] = ~inside
    last[offsets] = True
    ends = np.flatnonzero(inside & last[1:]) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False, step: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all rows in order, and the row of each.

    The work arrays of a very long text stay small: it is cut behind a space about every ``step`` bytes.
    """
    if len(data) > step:
        cut = step
        while cut < len(data) and not _IS_SPACE[data[cut - 1]]:
            cut += 1
        if cut < len(data):
            parts = [word_hashes(data[:cut], np.clip(offsets, 0, cut), lower, step)]
            while cut < len(data):
                end = min(cut + step, len(data))
                while end < len(data) and not _IS_SPACE[data[end - 1]]:
                    end += 1
                at = np.clip(offsets, cut, end) - cut
                parts.append(word_hashes(data[cut:end], at, lower, end - cut + 1))
                cut = end
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = _TO_LOWER[data] if lower else data
    starts, ends, row = word_bounds(data, offsets)
    sums = prefix_sums(data)
    return mix((sums[ends] - sums[starts]) * powers(len(data) + 1)[1][starts] + (ends - starts).astype(np.uint64)), row


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Sorted batches cut so that the rows of a key stay together."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
        if not len(t):
            continue
        k = t.column(key).to_numpy()
        cut = int(np.searchsorted(k, k[-1], "left"))
        if cut:
            yield t.slice(0, cut).combine_chunks()
        rest = t.slice(cut)
    if rest is not None and len(rest):
        yield rest.combine_chunks()
