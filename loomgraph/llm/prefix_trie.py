"""Prefix trie of conversations: which first turns are shared, by whom, and how many bytes a shared cache would save.

A prefix of turns has a digest, a polynomial over two fields of 2 ** 61 - 1 elements. Digests of all prefixes are prefix sums:
turns are sorted into ranges, so that one very long conversation is many tasks, and the few sums at the borders of the ranges
are carried over. Nodes are distinct digests. Nodes of a single conversation have known values; the others are dealt out by
subtree into shards, get slots from a minimal perfect hash, and flat arrays are added up through the parents' slots, deepest
first. Nodes above subtrees that are too big for a shard form the top, which is added up last in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import mix, stored, whole_groups

PRIME = (1 << 61) - 1
_P, _LOW32, _LOW29 = np.uint64(PRIME), np.uint64(0xFFFFFFFF), np.uint64((1 << 29) - 1)
BASES = (1_537_228_672_809_129_301, 2_050_111_222_333_444_557)
#: Production rebuild rule: conversations in groups of GROUP share up to HEADS - 1 turns of the group's first one.
GROUP, HEADS = 5, 9
#: Turns below a node at most, over all its conversations, for its subtree to be one shard.
SHARD = 4_000_000


# --- arithmetic modulo 2 ** 61 - 1 ---------------------------------------------------------------------------------


def _reduce(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, for arrays of values below it."""
    a1, a0, b1, b0 = a >> np.uint64(32), a & _LOW32, b >> np.uint64(32), b & _LOW32
    middle = a1 * b0 + a0 * b1
    low = a0 * b0
    total = ((a1 * b1) << np.uint64(3)) + (middle >> np.uint64(29)) + ((middle & _LOW29) << np.uint64(32)) + (low & _P) + (low >> np.uint64(61))
    return _reduce(total)


def power(base: int, exponent: np.ndarray) -> np.ndarray:
    """base ** exponent modulo the prime, for an array of exponents of at least 0."""
    out, square, left = np.ones(len(exponent), np.uint64), base, exponent.astype(np.uint64)
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        out[odd] = multiply(out[odd], np.uint64(square))
        square, left = square * square % PRIME, left >> np.uint64(1)
    return out


def running(values: np.ndarray) -> np.ndarray:
    """Prefix sums modulo the prime."""
    high, low = np.cumsum(values >> np.uint64(32)), np.cumsum(values & _LOW32)
    return _reduce(multiply(_reduce(high), np.uint64(1 << 32)) + _reduce(low))


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _reduce(a + (_P - b))


def _u(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)


# --- positions and digests of all prefixes ---------------------------------------------------------------------------


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions and digests inside one range; batches come sorted by conversation and turn."""
    part = TaskContext.get().partitionId()
    conv, have, sums = None, 0, [0, 0]
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv_id").to_numpy()
        begin = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        run = np.repeat(begin, np.diff(np.append(begin, len(ids))))
        place = np.arange(len(ids)) - run + 1
        goes_on = conv is not None and ids[0] == conv
        first = run == 0
        if goes_on:
            place[first] += have
        columns = []
        for k, base in enumerate(BASES):
            terms = multiply(_u(batch.column(f"code{k + 1}")) % _P, power(base, place))
            total = running(terms)
            before = np.where(run > 0, total[np.maximum(run, 1) - 1], 0).astype(np.uint64)
            total = minus(total, before)
            if goes_on:
                total[first] = _reduce(total[first] + np.uint64(sums[k]))
            columns += [total, minus(total, terms)]
        conv, have, sums = ids[-1], int(place[-1]), [int(columns[0][-1]), int(columns[2][-1])]
        out = [batch.column("conv_id"), pa.array(np.full(len(ids), part)), pa.array(place), *[pa.array(c.view(np.int64)) for c in columns], batch.column("bytes"), batch.column("proof")]
        yield pa.RecordBatch.from_arrays(out, ["conv_id", "part", "place", "s1", "q1", "s2", "q2", "bytes", "proof"])


_SCANNED = "conv_id long, part long, place long, s1 long, q1 long, s2 long, q2 long, bytes long, proof long"


def _carries(ranges: list) -> dict[int, tuple[int, list[int]]]:
    """By range: turns and sums of its first conversation in the ranges before. One row per range."""
    carries: dict[int, tuple[int, list[int]]] = {}
    conv, have, sums = None, 0, [0, 0]
    for r in sorted(ranges, key=lambda r: r["part"]):
        first, last = r["first"], r["last"]
        if conv == ~first["c"]:
            carries[r["part"]] = (have, sums)
            joined = first["place"] + have, [(s + pow(b, have, PRIME) * first[f"s{k + 1}"]) % PRIME for k, (s, b) in enumerate(zip(sums, BASES, strict=True))]
        else:
            joined = first["place"], [first["s1"], first["s2"]]
        alone = ~first["c"] == last["c"]
        conv = last["c"]
        have, sums = joined if alone else (last["place"], [last["s1"], last["s2"]])
    return carries


def _carry(carries: dict[int, tuple[int, list[int]]], firsts: dict[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, part, place = (batch.column(c).to_numpy().copy() for c in ("conv_id", "part", "place"))
            columns = {c: _u(batch.column(c)).copy() for c in ("s1", "q1", "s2", "q2")}
            for p in np.unique(part).tolist():
                if p in carries:
                    have, sums = carries[p]
                    at = np.flatnonzero((part == p) & (ids == firsts[p]))
                    place[at] += have
                    for k, base in enumerate(BASES):
                        shift = np.uint64(pow(base, have, PRIME))
                        for c in (f"s{k + 1}", f"q{k + 1}"):
                            columns[c][at] = _reduce(multiply(columns[c][at], shift) + np.uint64(sums[k]))
            out = [batch.column("conv_id"), batch.column("part"), pa.array(place), *[pa.array(columns[c].view(np.int64)) for c in ("s1", "q1", "s2", "q2")], batch.column("bytes"), batch.column("proof")]
            yield pa.RecordBatch.from_arrays(out, batch.schema.names)

    return run


def positions(conversations: DataFrame) -> DataFrame:
    """Place (from 1) of every turn in its conversation, digest s1, s2 of the turns up to it and q1, q2 of those before it."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"))
    ordered = rows.repartitionByRange("conv_id", F.asc_nulls_first("turn"), "role", "text").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    proof = F.xxhash64(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    coded = ordered.select(
        "conv_id", F.xxhash64("role", "text").alias("code1"), F.xxhash64(F.lit(2), "text", F.lit(1), "role").alias("code2"), F.octet_length("text").cast("long").alias("bytes"), proof.alias("proof"),
    )
    scanned = stored(coded.mapInArrow(_scan, _SCANNED))
    end = lambda c: F.max(F.struct(c.alias("c"), "place", "s1", "s2"))
    ranges = scanned.groupBy("part").agg(end(F.bitwise_not("conv_id")).alias("first"), end(F.col("conv_id")).alias("last")).collect()
    carries = _carries(ranges)
    if not carries:
        return scanned
    return scanned.mapInArrow(_carry(carries, {r["part"]: ~r["first"]["c"] for r in ranges}), _SCANNED)


# --- rebuilt conversations -----------------------------------------------------------------------------------------


def _move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of own turns behind the borrowed ones: head + (s - own head) * base ** (borrowed - skipped)."""
    for batch in batches:
        shift = batch.column("shift").to_numpy()  # 0 to HEADS - 1, downwards
        out = {}
        for k, base in enumerate(BASES, 1):
            factor = np.array([pow(base, -i, PRIME) for i in range(int(shift.max()) + 1)] if len(shift) else [1], np.uint64)[shift]
            for new, old in ((f"d{k}", f"s{k}"), (f"p{k}", f"q{k}")):
                moved = multiply(minus(_u(batch.column(old)), _u(batch.column(f"own{k}"))), factor)
                out[new] = pa.array(_reduce(moved + _u(batch.column(f"head{k}"))).view(np.int64))
        yield pa.RecordBatch.from_arrays([*out.values(), *[batch.column(c) for c in _KEPT]], [*out, *_KEPT])


_KEPT = ["conv_id", "depth", "size", "bytes", "proof"]
_PATH = "d1 long, p1 long, d2 long, p2 long, conv_id long, depth long, size long, bytes long, proof long"


def rebuilt(turns: DataFrame, group: int = GROUP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Prefixes of all rebuilt conversations (digest d, digest p of the prefix before, depth, size of the conversation), and the
    conversations with their sizes."""
    opening = F.when(F.col("place") < heads, F.struct("place", "s1", "s2", "bytes", "proof"))
    firsts = turns.groupBy("conv_id").agg(F.max("place").alias("own"), F.array_sort(F.collect_list(opening)).alias("first"))
    base = firsts.select(F.col("conv_id").alias("base"), F.col("first").alias("head"), F.col("own").alias("base_size"))
    skipped = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads))
    convs = firsts.join(base, F.col("base") == F.col("conv_id") - F.col("conv_id") % group, "left").withColumn("skipped", skipped)
    convs = convs.withColumn("borrowed", F.least(F.col("skipped"), F.coalesce("base_size", F.lit(0))))
    convs = convs.withColumn("size", F.col("borrowed") + F.greatest(F.col("own") - F.col("skipped"), F.lit(0)))
    at = lambda a, i, f: F.coalesce(F.get(F.col(a), i.cast("int") - 1)[f], F.lit(0).cast("long"))
    convs = convs.select("conv_id", "size", "skipped", "borrowed", "head", *[at("head", F.col("borrowed"), f"s{k}").alias(f"head{k}") for k in (1, 2)],
                         *[at("first", F.least("skipped", "own"), f"s{k}").alias(f"own{k}") for k in (1, 2)])
    convs = stored(convs)
    step = F.explode(F.sequence(F.lit(1), F.col("borrowed").cast("int"))).alias("i")
    lent = convs.filter("borrowed > 0").select("conv_id", "size", "head", step)
    lent = lent.select(*[e for k in (1, 2) for e in (at("head", F.col("i"), f"s{k}").alias(f"d{k}"), at("head", F.col("i") - 1, f"s{k}").alias(f"p{k}"))],
                       "conv_id", F.col("i").cast("long").alias("depth"), "size", at("head", F.col("i"), "bytes").alias("bytes"), at("head", F.col("i"), "proof").alias("proof"))
    scalars = convs.select("conv_id", "size", "skipped", "borrowed", "head1", "head2", "own1", "own2")
    kept = turns.join(scalars, "conv_id").filter(F.col("place") > F.col("skipped"))
    kept = kept.withColumn("shift", F.col("skipped") - F.col("borrowed")).withColumn("depth", F.col("place") - F.col("shift"))
    return stored(lent.unionByName(kept.mapInArrow(_move, _PATH))), scalars


# --- node table ------------------------------------------------------------------------------------------------------


class SlotTable:
    """Minimal perfect hash: each of n distinct keys has a slot of its own in 0 .. n - 1; other keys are recognised and get -1.

    Keys that meet no other key at a level are placed there, the rest go on to the next level.
    """

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.keys, used, rest = np.zeros(len(keys), np.uint64), 0, keys
        while len(rest):
            at = self._at(rest, len(self.levels), 2 * len(rest))
            single = np.bincount(at, minlength=2 * len(rest)) == 1
            self.levels.append((single, used + np.cumsum(single) - 1))
            placed = single[at]
            self.keys[self.levels[-1][1][at[placed]]] = rest[placed]
            used, rest = used + int(placed.sum()), rest[~placed]
            if len(self.levels) > 200:
                raise ValueError("keys repeat")

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        found = np.full(len(keys), -1)
        for level, (single, rank) in enumerate(self.levels):
            left = np.flatnonzero(found < 0)
            at = self._at(keys[left], level, len(single))
            here = rank[at]
            good = single[at] & (self.keys[np.maximum(here, 0)] == keys[left])
            found[left[good]] = here[good]
        return found


def accumulate(key: np.ndarray, parent: np.ndarray, depth: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Sums of each value over the subtrees, in the order of the input. A parent that is not in the table ends there."""
    table = SlotTable(key)
    slot = table.slots(key)
    back = np.empty_like(slot)
    back[slot] = np.arange(len(slot))
    above, level = table.slots(parent)[back], depth[back]
    flat = [v[back].copy() for v in values]
    order = np.argsort(-level, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(level[order])) + 1):
        inner = part[above[part] >= 0]
        for v in flat:
            np.add.at(v, above[inner], v[inner])
    return [v[slot] for v in flat]


def _keys(t: pa.Table, a: str, b: str) -> np.ndarray:
    return mix(_u(t.column(a).combine_chunks()) + mix(_u(t.column(b).combine_chunks())))


_SUMS = "d1 long, d2 long, p1 long, p2 long, is_root boolean, leaves long, saved long"


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in whole_groups(batches, "root1"):
        number = {c: t.column(c).to_numpy() for c in ("depth", "leaves", "saved")}
        leaves, saved = accumulate(_keys(t, "d1", "d2"), _keys(t, "p1", "p2"), number["depth"], number["leaves"], number["saved"])
        out = [t.column(c).combine_chunks() for c in ("d1", "d2", "p1", "p2", "is_root")]
        yield pa.RecordBatch.from_arrays([*out, pa.array(leaves), pa.array(saved)], ["d1", "d2", "p1", "p2", "is_root", "leaves", "saved"])


def node_table(path: DataFrame, convs: DataFrame) -> DataFrame:
    """Nodes (digest, parent digest, depth, smallest member, members, ends, bytes of the last text, turns below). Two different
    prefixes with one digest would differ in parent, depth or the proof of their last turn, and end the job."""
    one = lambda c: (F.min(c) == F.max(c))
    verified = one("p1") & one("p2") & one("depth") & one("proof")
    nodes = path.groupBy("d1", "d2").agg(
        F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
        F.count_if(F.col("depth") == F.col("size")).alias("n_ends"), F.max("bytes").alias("bytes"), F.sum(F.col("size") - F.col("depth")).alias("below"), verified.alias("verified"),
    )
    nodes = nodes.withColumn("depth", F.when(F.col("verified"), F.col("depth")).otherwise(F.raise_error(F.lit("two prefixes have one digest")).cast("long"))).drop("verified")
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if(F.col("size") == 0).alias("n_ends"), F.sum("size").alias("below")).filter("n_convs > 0")
    root = root.select(zero.alias("d1"), zero.alias("d2"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), zero.alias("depth"), "conv_id", "n_convs", "n_ends", zero.alias("bytes"), "below")
    return stored(nodes.unionByName(root))


def subtree_sums(nodes: DataFrame, path: DataFrame, shard: int = SHARD) -> DataFrame:
    """(d1, d2, leaves, saved) of the nodes with several members and of the root. ``nodes`` has n_children and n_single."""
    own = nodes.withColumn("leaves", F.col("n_single") + (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes"))
    is_top = ((F.col("below") > shard) & (F.col("n_convs") > 1)) | (F.col("depth") == 0)
    # A conversation's shard starts below its deepest node of the top; nodes above a node of the top are in the top as well.
    tops = nodes.filter(is_top & (F.col("depth") > 0)).select("d1", "d2")
    deepest = path.join(tops, ["d1", "d2"]).groupBy("conv_id").agg(F.max("depth").alias("top"))
    starts = path.join(deepest, "conv_id", "left").filter(F.col("depth") == F.coalesce("top", F.lit(0)) + 1).select("conv_id", F.col("d1").alias("root1"), F.col("d2").alias("root2"))
    inner = own.filter(~is_top & (F.col("n_convs") > 1)).join(starts, "conv_id").withColumn("is_root", (F.col("d1") == F.col("root1")) & (F.col("d2") == F.col("root2")))
    fields = ["root1", "d1", "d2", "p1", "p2", "is_root", "depth", "leaves", "saved"]
    below = stored(inner.select(*fields).repartition("root1").sortWithinPartitions("root1").mapInArrow(_add_up, _SUMS))
    totals = below.filter("is_root").groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    top = own.filter(is_top).join(totals, ["d1", "d2"], "left")
    more = lambda c: (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c)
    zero = F.lit(0).cast("long")
    top = top.select(zero.alias("root1"), "d1", "d2", F.coalesce("p1", F.lit(-1)).alias("p1"), F.coalesce("p2", F.lit(-1)).alias("p2"), F.lit(False).alias("is_root"), "depth", more("leaves"), more("saved"))
    return below.unionByName(top.coalesce(1).mapInArrow(_add_up, _SUMS)).select("d1", "d2", "leaves", "saved")


def _write_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of one node that follow each other, as one text per batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        d1, d2, ids = (batch.column(c).to_numpy() for c in ("d1", "d2", "conv_id"))
        begin = np.flatnonzero(np.concatenate([[True], (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])]))
        end = np.append(begin[1:], len(ids))
        text = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(d1[begin]), pa.array(d2[begin]), pa.array(ids[begin]), pa.array(text)], ["d1", "d2", "first", "ids"])


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state, done = None, None, []
    for batch in batches:
        for a, b, text in zip(batch.column("d1").to_pylist(), batch.column("d2").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if (a, b) == now:
                state.update(b"," + text.encode())
            else:
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state = (a, b), hashlib.sha256(text.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["d1", "d2", "ends_sha256"])
            done = []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, state.hexdigest())], ["d1", "d2", "ends_sha256"])


def end_hashes(path: DataFrame, convs: DataFrame) -> DataFrame:
    """SHA-256 of the ids of the conversations that end at a node. Ids are sorted by ranges of (node, id) and joined to texts there;
    only those texts meet, and are hashed as a stream."""
    zero = F.lit(0).cast("long")
    ends = path.filter(F.col("depth") == F.col("size")).select("d1", "d2", "conv_id").unionByName(convs.filter("size = 0").select(zero.alias("d1"), zero.alias("d2"), "conv_id"))
    texts = ends.repartitionByRange("d1", "d2", "conv_id").sortWithinPartitions("d1", "d2", "conv_id").mapInArrow(_write_ids, "d1 long, d2 long, first long, ids string")
    return texts.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "first").mapInArrow(_hash_ids, "d1 long, d2 long, ends_sha256 string")


def trie(conversations: DataFrame, group: int = GROUP, heads: int = HEADS, shard: int = SHARD) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, the root included.

    ``conv_id % group`` has the sign of conv_id, as in SQL. Turns with equal numbers are ordered by role, then text; repeated rows are turns of their own; null roles and texts are
    empty. Rows without conv_id belong to no conversation and take no part. A table without conversations gives no rows, not
    even a root. Other columns are ignored.
    """
    path, convs = rebuilt(positions(conversations), group, heads)
    nodes = node_table(path, convs)
    children = nodes.filter("depth > 0").groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("n_single"))
    zero = F.lit(0).cast("long")
    nodes = stored(nodes.join(children, ["d1", "d2"], "left").withColumn("n_children", F.coalesce("n_children", zero)).withColumn("n_single", F.coalesce("n_single", zero)))
    sums = subtree_sums(nodes, path, shard)
    full = nodes.join(sums, ["d1", "d2"], "left").join(end_hashes(path, convs), ["d1", "d2"], "left")
    above = nodes.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    # The root is the parent of very many nodes, so its id is not joined.
    root_id = convs.agg(F.min("conv_id")).first()[0]
    upper = full.filter("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root_id).cast("long")))
    rows = upper.unionByName(full.filter("depth > 1").join(above, ["p1", "p2"]), allowMissingColumns=True)
    empty: Column = F.lit(hashlib.sha256(b"").hexdigest())
    return rows.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"),
        F.coalesce("saved", zero).alias("saved_tokens"), F.coalesce("ends_sha256", empty).alias("ends_sha256"),
    )


#: Prefixes as texts of hashes, subtrees by joining every node with the path of its smallest member. The crc is that of zlib, bit by bit.
ORACLE = r"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(text, '') AS text, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS code,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT c, max(i) AS k,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
           lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 9 AS h
  FROM turns GROUP BY c),
sized AS (SELECT a.*, least(a.h, coalesce(b.k, 0)) AS p FROM ids a LEFT JOIN ids b ON b.c = a.c - a.c % 5),
path AS (
  SELECT s.c, t.i AS d, t.code, t.text FROM sized s JOIN turns t ON t.c = s.c - s.c % 5 AND t.i <= s.p
  UNION ALL SELECT s.c, s.p + t.i - s.h, t.code, t.text FROM sized s JOIN turns t ON t.c = s.c AND t.i > s.h),
keyed AS (
  SELECT c, d, strlen(text) AS bytes, string_agg(code, '') OVER (PARTITION BY c ORDER BY d) AS key, d = max(d) OVER (PARTITION BY c) AS is_end FROM path
  UNION ALL SELECT c, 0, 0, '', c NOT IN (SELECT c FROM path) FROM ids),
node AS (
  SELECT key, min(c) AS conv_id, min(d) AS depth, count(*) AS n_convs, min(bytes) AS bytes,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE is_end), '')) AS ends_sha256
  FROM keyed GROUP BY key),
kids AS (SELECT left(key, 64 * (depth - 1)) AS key, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
summed AS (
  SELECT k.key, count(*) FILTER (WHERE kids.n IS NULL) AS n_leaves, sum((x.n_convs - 1) * x.bytes) AS saved
  FROM node x JOIN keyed k ON k.c = x.conv_id AND k.d <= x.depth LEFT JOIN kids ON kids.key = x.key GROUP BY k.key)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM node n JOIN summed s USING (key) LEFT JOIN kids USING (key)
LEFT JOIN node p ON n.depth > 0 AND p.key = left(n.key, 64 * (n.depth - 1))
"""
