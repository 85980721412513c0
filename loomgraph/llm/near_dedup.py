"""Near-dedup: MinHash bands propose pairs, signature batches prune them by a Bayesian bound, full sets confirm the rest.

Documents with equal shingle sets are one class; only one document of each goes on. A band bucket is never expanded into all
its pairs at first: its members are compared with its smallest one, what is linked becomes one component, and only members of
different components are compared with each other, in blocks within a task that returns only pairs that join two components.
Within a component further links change nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import as_signed, mix, row_blocks, stored, utf8_rows, whole_groups, word_hashes

#: Words of a shingle; similarity in hundredths; rows of a band, bands (a pair at 0.75 shares no band with probability 3e-7);
#: hashes of a batch; probability with which a true pair may be pruned at a batch; classes and shingles of a block of a bucket.
WORDS, PERCENT, ROWS, BANDS, BATCH, MISS, GROUP, SHINGLES = 5, 75, 4, 40, 32, 1e-7, 2048, 1 << 23
HASHES = ROWS * BANDS
_rng = np.random.default_rng(7)
_A = (_rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of the distinct shingles of each row, sorted. Fewer words than a shingle has are one shingle."""
    words, row = word_hashes(data, offsets, lower=True)
    count = np.bincount(row, minlength=len(offsets) - 1)
    begin = np.cumsum(count) - count
    key = np.zeros(len(words), np.uint64)
    for k in range(WORDS):
        key[: len(words) - k] = mix(key[: len(words) - k] + words[k:] * np.uint64(2 * k + 3))
    here = np.flatnonzero(row[: len(words) - WORDS + 1] == row[WORDS - 1 :]) if len(words) >= WORDS else np.zeros(0, np.int64)
    owner, found = row[here], key[here]
    short = np.flatnonzero((count > 0) & (count < WORDS))
    if len(short):
        whole = np.array([mix(np.cumsum(mix(words[begin[i] : begin[i] + count[i]] + np.arange(count[i], dtype=np.uint64)))[-1:] + count[i].astype(np.uint64))[0] for i in short], np.uint64)
        owner, found = np.concatenate([owner, short]), np.concatenate([found, whole])
    order = np.lexsort((found, owner))
    owner, found = owner[order], found[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
    return owner[new], found[new]


def _binaries(matrix: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    width = matrix.shape[1] * matrix.itemsize
    offsets = pa.py_buffer(np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(width))
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, offsets, pa.py_buffer(np.ascontiguousarray(matrix).tobytes())])


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8_rows(batch.column("text"))
        for a, b in row_blocks(offsets):
            owner, found = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            n = np.bincount(owner, minlength=b - a)
            some = np.flatnonzero(n)
            one, two, signature = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64), np.zeros((b - a, HASHES), np.uint32)
            if len(some):
                starts, low = (np.cumsum(n) - n)[some], (found >> np.uint64(32)).astype(np.uint32)
                one[some] = np.add.reduceat(mix(found + np.uint64(11)), starts)
                two[some] = np.bitwise_xor.reduceat(mix(found * np.uint64(3) + np.uint64(5)), starts)
                for k in range(HASHES):
                    signature[some, k] = np.minimum.reduceat(low * _A[k] + _B[k], starts)
            parts = [_binaries(signature[:, k : k + BATCH]) for k in range(0, HASHES, BATCH)]
            columns = [batch.column("doc_id").slice(a, b - a), pa.array(n, pa.int64()), pa.array(as_signed(one)), pa.array(as_signed(two)), *parts]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "one", "two", *PARTS])


PARTS = [f"s{k}" for k in range(HASHES // BATCH)]


def sketches(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, size and fingerprint of its shingle set, and its signature in batches."""
    schema = "doc_id long, n long, one long, two long, " + ", ".join(f"{p} binary" for p in PARTS)
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_sketch_batches, schema)


def _matrix(column: pa.Array, dtype: type, width: int) -> np.ndarray:
    """The inverse of _binaries."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(dtype).reshape(-1, width) if len(column) else np.zeros((0, width), dtype)


def _band_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        signature = np.concatenate([_matrix(batch.column(p), np.uint32, BATCH) for p in PARTS], 1).astype(np.uint64)
        for k in range(BANDS):
            key = np.full(len(batch), k + 1, np.uint64)
            for j in range(ROWS):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, k * ROWS + j])
            yield pa.RecordBatch.from_arrays([pa.array(as_signed(key)), pa.array(np.full(len(batch), k), pa.int32()), batch.column("cls")], ["bucket", "band", "cls"])


@lru_cache
def least_matches(n: int, miss: float = MISS) -> int:
    """The fewest matches in n hashes at which P(similarity >= threshold), under an even prior, is not below ``miss``.

    With m of n matches that posterior is the probability of at most m successes in n + 1 draws at the threshold."""
    t, below = PERCENT / 100, 0.0
    for m in range(n + 1):
        below += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if below >= miss:
            return m
    return n


def _prune(parts: list[str], before: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs that survive the batches ``parts``; ``before``: hashes compared in earlier batches, with a count in ``same``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, seen = batch.column("same").to_numpy().copy(), before
            alive = np.arange(len(batch))
            for p in parts:
                a, b = (_matrix(batch.column(c + p), np.uint32, BATCH) for c in "xy")
                same[alive] += (a[alive] == b[alive]).sum(1)
                seen += BATCH
                alive = alive[same[alive] >= least_matches(seen)]
            rows = pa.array(alive)
            yield pa.RecordBatch.from_arrays([batch.column("x").take(rows), batch.column("y").take(rows), pa.array(same[alive])], ["x", "y", "same"])

    return run


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8_rows(batch.column("text"))
        for a, b in row_blocks(offsets):
            owner, found = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            at = np.searchsorted(owner, np.arange(b - a + 1))
            values = [found[at[i] : at[i + 1]] for i in range(b - a)]
            columns = [batch.column("cls").slice(a, b - a), pa.array([v.tobytes() for v in values], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["cls", "members"])


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the components of a bucket: as many as join them, not all.

    Two batches of hashes prune pairs by the bound; pairs of one component, pairs whose sizes exclude a link and pairs that an
    earlier band has in one bucket are left out. Survivors, most alike first, are held against each other's full sets; linked
    components are one from then on.
    """
    early = 2 * BATCH // ROWS
    for t in whole_groups(batches, "work"):
        work, cls, root, n, band, part = (t.column(c).to_numpy() for c in ("work", "cls", "root", "n", "band", "part"))
        both = t.column("both").to_numpy(zero_copy_only=False)
        column = lambda c: pa.concat_arrays(t.column(c).chunks)  # noqa: B023, E731
        signature = np.concatenate([_matrix(column(p), np.uint32, BATCH) for p in PARTS[:2]], 1)
        members = column("members")
        found: list[tuple[int, int]] = []
        cuts = [*np.flatnonzero(np.diff(work, prepend=work[0] - 1)), len(work)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            s, r, size, p = signature[lo:hi], root[lo:hi], n[lo:hi], part[lo:hi]
            sets = [np.frombuffer(members[k].as_buffer(), np.uint64) for k in range(lo, hi)]
            merged: dict[int, int] = {}

            def find(x: int) -> int:
                while x in merged:  # noqa: B023
                    x = merged[x]  # noqa: B023
                return x

            for a in range(0, hi - lo, 256):
                rows = slice(a, min(a + 256, hi - lo))
                fine = (r[rows, None] != r[None, a:]) & (100 * np.minimum(size[rows, None], size[None, a:]) >= PERCENT * np.maximum(size[rows, None], size[None, a:]))
                fine &= both[lo] | (p[rows, None] != p[None, a:])
                fine &= np.arange(rows.start, rows.stop)[:, None] < np.arange(a, hi - lo)[None, :]
                same = np.zeros(fine.shape, np.uint8)
                for k in range(BATCH):
                    same += s[rows, k][:, None] == s[None, a:, k]
                i, j = np.nonzero(fine & (same >= least_matches(BATCH)))
                i, j = i + a, j + a
                if not len(i):
                    continue
                equal = s[i] == s[j]
                first = equal.reshape(len(i), early, ROWS).all(2)[:, : min(int(band[lo]), early)].any(1)
                total = equal.sum(1)
                alive = np.flatnonzero(~first & (total >= least_matches(2 * BATCH)))
                for k in alive[np.argsort(-total[alive], kind="stable")]:
                    x, y = int(i[k]), int(j[k])
                    u, v = find(int(r[x])), find(int(r[y]))
                    if u == v:
                        continue
                    shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if 100 * shared >= PERCENT * (len(sets[x]) + len(sets[y]) - shared):
                        merged[max(u, v)] = min(u, v)
                        found.append((int(cls[lo + x]), int(cls[lo + y])))
        x, y = (np.array([f[k] for f in found], np.int64) for k in range(2))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["x", "y"])


def bucket_links(rest: DataFrame, signatures: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (x, y) that join the components of each bucket of ``rest`` (bucket, band, cls, root, n).

    A bucket is worked on in blocks of about ``GROUP`` classes or ``SHINGLES`` shingles, every two blocks together, so no task
    holds more.
    """
    blocks = F.ceil(F.greatest(F.count("*") / GROUP, F.sum("n") / SHINGLES)).cast("int")
    sized = rest.join(rest.groupBy("bucket").agg(blocks.alias("blocks")), "bucket")
    dealt = sized.withColumn("part", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    work = F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other"))
    # A block with itself is work of its own; with another one, both are there and only pairs across count.
    keyed = dealt.select("cls", "root", "n", "band", "part", work.alias("work"), (F.col("part") == F.col("other")).alias("both"))
    full = keyed.join(signatures.select("cls", *PARTS[:2]), "cls").join(sets, "cls")
    return full.repartition("work").sortWithinPartitions("work").mapInArrow(_bucket_links, "x long, y long").distinct()


def _confirm_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for i, (a, b) in enumerate(zip(batch.column("xs"), batch.column("ys"), strict=True)):
            p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (a, b))
            both = len(np.intersect1d(p, q, assume_unique=True))
            if 100 * both >= PERCENT * (len(p) + len(q) - both):
                good.append(i)
        rows = pa.array(good, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("x").take(rows), batch.column("y").take(rows)], ["x", "y"])


def confirmed(pairs: DataFrame, signatures: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (x, y) that are links. First one batch of hashes, then the others, then the full sets."""
    side = lambda c, cols: signatures.select(F.col("cls").alias(c), *[F.col(k).alias(c + k) for k in cols])
    sized = pairs.join(side("x", ["n", PARTS[0]]), "x").join(side("y", ["n", PARTS[0]]), "y")
    sized = sized.filter((100 * F.least("xn", "yn") >= PERCENT * F.greatest("xn", "yn"))).withColumn("same", F.lit(0).cast("long"))
    first = sized.select("x", "y", "same", "x" + PARTS[0], "y" + PARTS[0]).mapInArrow(_prune(PARTS[:1], 0), "x long, y long, same long")
    others = PARTS[1:]
    both = stored(first).join(side("x", others), "x").join(side("y", others), "y")
    alive = both.mapInArrow(_prune(others, BATCH), "x long, y long, same long").select("x", "y")
    return exact(alive, sets)


def exact(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (x, y) whose full sets are alike enough."""
    full = pairs.join(sets.select(F.col("cls").alias("x"), F.col("members").alias("xs")), "x").join(sets.select(F.col("cls").alias("y"), F.col("members").alias("ys")), "y")
    return full.mapInArrow(_confirm_batches, "x long, y long")


def components(links: DataFrame) -> DataFrame:
    """(cls, root): the smallest vertex that each vertex of ``links`` (x, y) reaches, by alternating star operations.

    Large star: the larger neighbours of a vertex move to its smallest neighbour; small star: so do the smaller ones. Every
    round at least halves the longest path; the edges end as stars around the roots.
    """
    edges = stored(links.filter("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    while True:
        before = edges
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(down, "u").filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        edges = stored(moved.union(down.select("u", F.col("m").alias("v"))).distinct())
        # Both sides are distinct, so equal numbers and no new edge mean that nothing moved.
        if edges.count() == before.count() and edges.join(before, ["u", "v"], "left_anti").isEmpty():
            return edges.select(F.col("u").alias("cls"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("cls"), F.col("v").alias("root")).distinct())


def link(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id for every row of ``documents``.

    component_id is the smallest doc_id reachable over links, kept tells whether the row has it. Null and empty texts have no
    shingles and are linked with nothing. A doc_id is one vertex however many rows it has. Rows with a null doc_id are kept
    and take no part (component_id is null). An empty table gives an empty table.
    """
    rows = stored(sketches(documents))
    named = rows.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = stored(named.groupBy("n", "one", "two").agg(F.min(F.struct("doc_id", *PARTS)).alias("r")).select("n", "one", "two", F.col("r.doc_id").alias("cls"), *[f"r.{p}" for p in PARTS]))
    member = named.select("doc_id", "n", "one", "two").join(classes.select("n", "one", "two", "cls"), ["n", "one", "two"]).select("doc_id", "cls")
    buckets = classes.select("cls", *PARTS).mapInArrow(_band_batches, "bucket long, band int, cls long")
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("k"), F.min("cls").alias("leader")).filter("k > 1")
    held = stored(buckets.join(shared.select("bucket", "leader"), "bucket"))
    involved = held.select("cls").distinct()
    # A class is compared by all texts of its smallest document; with one text per doc_id that is its own set.
    source = documents.select(F.col("doc_id").cast("long").alias("cls"), F.col("text").cast("string").alias("text")).join(involved, "cls")
    sets = stored(source.mapInArrow(_set_batches, "cls long, members binary"))
    stars = held.filter("cls <> leader").select(F.col("leader").alias("x"), F.col("cls").alias("y")).distinct()
    tried = stored(stars)
    twins = member.groupBy("doc_id").agg(F.collect_set("cls").alias("c")).filter("size(c) > 1").select(F.array_min("c").alias("x"), F.explode("c").alias("y"))
    links = stored(confirmed(tried, classes, sets).union(twins))
    joined = components(links)
    named_root = held.select("bucket", "band", "cls").join(joined, "cls", "left").select("bucket", "band", "cls", F.coalesce("root", "cls").alias("root"))
    open_ = named_root.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("bucket")
    rest = stored(named_root.join(open_, "bucket").join(classes.select("cls", "n"), "cls"))
    more = stored(bucket_links(rest, classes, sets))
    final = components(links.union(more)) if more.head(1) else joined
    of_doc = member.join(final, "cls", "left").groupBy("doc_id").agg(F.min(F.coalesce("root", "cls")).alias("component_id"), F.min("cls").alias("class_id")).withColumnRenamed("doc_id", "_d")
    out = rows.select("doc_id", F.col("n").alias("n_shingles")).join(of_doc, F.col("doc_id") == F.col("_d"), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_one(documents: DataFrame) -> DataFrame:
    """One document of each group: the rows of ``documents`` that link() keeps."""
    gone = link(documents).filter(~F.col("kept")).select("doc_id").distinct()
    return documents.join(gone, "doc_id", "left_anti")
