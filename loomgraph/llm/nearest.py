"""Approximate nearest neighbours by largest inner product: NN-descent builds neighbour graphs, greedy search walks them.

Lengths may differ by any factor: nodes are dealt into strata of lengths within a factor of 4. Graph work uses single-precision
vectors scaled by the longest of their stratum, with one more component that turns largest inner product into nearest neighbour,
less the mean of a sample of the stratum. A stratum is dealt by hash into shards of bounded size, each with its own graph, which
one task builds and walks in memory: a vector is shuffled once to its shard, a query once to each shard that it enters, and no
edge leaves a task. A query enters every shard of every stratum, unless the longest vector of the stratum cannot reach the best
k + 1 nodes of the samples. Every row is indexed; equal vectors are one node.

A graph starts from blocks of random-projection trees and is refined by joining the neighbours of every node with each other:
who meets at a common neighbour and beats the worst neighbour so far becomes a neighbour. Only pairs with a new member are
compared. A query starts from the blocks where the trees would put it and from its own node; a search expands, for many queries
at once, the best nodes not expanded yet. What it remembers is scored on the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import discard, mix, stored

#: Neighbours of a node in the graph; of a node when neighbours meet (both directions of edges); random trees; rows of a block;
#: nodes a query expands in a round; nodes it remembers.
DEGREE, REACH, TREES, BLOCK, WIDTH, BEAM = 48, 96, 8, 512, 10, 64
#: The graph is refined until a round changes no more than this share of its edges.
SETTLED = 0.002
#: Ratio of lengths within a stratum; nodes of a stratum in the driver's sample.
RATIO, SAMPLE = 4.0, 256
#: A stratum has PARTS shards, fewer if they would have under LEAST nodes, more if they would have over MOST nodes or BYTES.
PARTS, LEAST, MOST, BYTES = 12, 1 << 13, 1 << 16, 1 << 26
#: Work arrays: similarities of neighbours that meet, pairs found before they enter the graph, rows of lists, queries that walk together.
MEETING, FOUND, ROWS, WALKERS = 1 << 19, 1 << 20, 1 << 12, 64


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part: not null or zero, no null, NaN or infinite component, and as long as most."""
    kind = vectors.schema["embedding"].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    v = F.col("embedding").cast("array<float>" if single else "array<double>")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = vectors.filter(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).filter(fine)
    common = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.filter(F.size("vector") == (common.d if common else 0))


def _dense(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length as a matrix."""
    return np.asarray(column.flatten()).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


@dataclass
class Strata:
    """Of each stratum the longest length, the mean of its sample, the sample and the number of shards; the first shard of each."""

    longest: np.ndarray
    means: np.ndarray
    samples: list[np.ndarray]
    parts: np.ndarray

    @property
    def first(self) -> np.ndarray:
        return np.cumsum(self.parts) - self.parts


def _lift(x: np.ndarray) -> np.ndarray:
    """Vectors of length 1 at most with the component that makes their length 1."""
    return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))], 1)


def by_length(groups: DataFrame) -> DataFrame:
    """(node, vector, length, stratum): lengths within a factor of RATIO, so that the median is in the middle of stratum 0."""
    vector = F.col("vector").cast("array<double>")
    big = F.array_max(F.transform(vector, F.abs))
    length = F.col("big") * F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + (x / F.col("big")) * (x / F.col("big"))))
    sized = groups.withColumn("big", big).select("node", "vector", length.alias("length"))
    median = sized.agg(F.percentile_approx("length", 0.5)).first()[0] or 1.0
    step = F.floor(F.log(F.col("length") / median) / float(np.log(RATIO)) + 0.5)
    return sized.withColumn("stratum", step.cast("int"))


def shards_of(nodes: int, width: int) -> int:
    """Number of shards of a stratum with so many nodes of so many components."""
    most = max(1, min(MOST, BYTES // (4 * (width + 1))))
    return max(-(-nodes // most), min(PARTS, -(-nodes // LEAST)), 1)


def strata_of(sized: DataFrame) -> tuple[list[int], Strata]:
    """Keys of the strata in order, and what tasks need to know of them: of each a bounded sample comes to the driver."""
    found = sized.groupBy("stratum").agg(F.max("length").alias("longest"), F.count("*").alias("n")).orderBy("stratum").collect()
    some = Window.partitionBy("stratum").orderBy(F.xxhash64("node"), "node")
    drawn: dict[int, list[list[float]]] = {f.stratum: [] for f in found}
    for row in sized.withColumn("r", F.row_number().over(some)).filter(F.col("r") <= SAMPLE).select("stratum", "vector").collect():
        drawn[row.stratum].append(row.vector)
    samples = [np.array(drawn[f.stratum], float) for f in found]
    means = np.array([_lift(x / f.longest).mean(0) for f, x in zip(found, samples, strict=True)])
    parts = np.array([shards_of(f.n, x.shape[1]) for f, x in zip(found, samples, strict=True)], np.int64)
    return [f.stratum for f in found], Strata(np.array([f.longest for f in found], float), means, samples, parts)


def _directions(q: np.ndarray) -> np.ndarray:
    q = q / np.abs(q).max(1, keepdims=True)
    return q / np.sqrt((q * q).sum(1, keepdims=True))


# --- a graph in memory; missing neighbours are -1 with similarity -inf ------------------------------------------------


def _distances(x: np.ndarray) -> np.ndarray:
    """Similarity of all pairs of rows: squared distance, negated."""
    own = (x * x).sum(1)
    return 2 * (x @ x.T) - own[:, None] - own[None, :]


def _codes(x: np.ndarray, trees: int) -> np.ndarray:
    """Of each tree the codes of the rows."""
    planes = np.random.default_rng(x.shape[1]).standard_normal((trees, x.shape[1], 24)).astype(np.float32)
    return np.stack([(x @ planes[t] > 0) @ (1 << np.arange(23, -1, -1)) for t in range(trees)])


def _top(sims: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest values of each row."""
    if k >= sims.shape[1]:
        return np.broadcast_to(np.arange(sims.shape[1]), sims.shape)
    return np.argpartition(-sims, k - 1, axis=1)[:, :k]


def _order(row: np.ndarray, sim: np.ndarray) -> np.ndarray:
    """Order by row, then by similarity, the largest first; similarities are 0 at most but for rounding."""
    return np.argsort(row.astype(np.int64) << 32 | (np.maximum(-sim, 0) + np.float32(0)).view(np.int32))


def _best(near: np.ndarray, sim: np.ndarray, fresh: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row, without repetitions; of equal ones the one that was known stays."""
    bits = near.shape[1].bit_length()
    key = ((near.astype(np.int64) << 1 | fresh) << bits) | np.arange(near.shape[1])
    key.sort(axis=1)
    place, near = key & ((1 << bits) - 1), key >> (bits + 1)
    sim = np.take_along_axis(sim, place, 1)
    sim[:, 1:][near[:, 1:] == near[:, :-1]] = -np.inf
    top = _top(sim, k)
    sim, near, place = (np.take_along_axis(a, top, 1) for a in (sim, near, place))
    none = sim == -np.inf
    near[none] = -1
    return near.astype(np.int32), sim, np.take_along_axis(fresh, place, 1) & ~none


class NeighbourGraph:
    """The neighbour graph of the rows of ``x``, of which the last component is not cut by the trees."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, reach: int = REACH, trees: int = TREES, block: int = BLOCK, settled: float = SETTLED):
        self.x, self.own, self.degree, self.reach, self.block = x, (x * x).sum(1), degree, reach, block
        codes = _codes(x[:, :-1], trees)
        self.orders = [np.argsort(code, kind="stable") for code in codes]
        self.codes = [code[order] for code, order in zip(codes, self.orders, strict=True)]
        self.near = np.full((len(x), degree), -1, np.int32)
        self.sim = np.full((len(x), degree), -np.inf, np.float32)
        self.fresh = np.zeros((len(x), degree), bool)
        for order in self.orders:
            for a in range(0, len(x), block):
                self._meet_block(order[a : a + block])
        # One block holds all pairs; otherwise rounds go on until the graph has settled.
        while len(x) > block and self._round() > settled * np.count_nonzero(self.near >= 0):
            pass
        self.roads = self._both_ways()[0]
        del self.near, self.sim, self.fresh

    def _meet_block(self, rows: np.ndarray) -> None:
        sims = _distances(self.x.take(rows, 0))
        np.fill_diagonal(sims, -np.inf)
        top = _top(sims, self.degree)
        near, sim = np.concatenate([self.near[rows], rows[top]], 1), np.concatenate([self.sim[rows], np.take_along_axis(sims, top, 1)], 1)
        fresh = np.ones(near.shape, bool)
        kept = _best(near, sim, fresh, self.degree)
        self.near[rows], self.sim[rows], self.fresh[rows] = (a[:, : self.degree] for a in kept)

    def _both_ways(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each node the ``reach`` best neighbours by edges of both directions, and which of them are new."""
        n = len(self.x)
        edge = np.flatnonzero(self.near.ravel() >= 0)
        dst = self.near.ravel()[edge]
        order = _order(dst, self.sim.ravel()[edge])
        dst, edge = dst[order], edge[order]
        place = np.arange(len(dst)) - np.searchsorted(dst, np.arange(n))[dst]
        dst, edge, place = (a[place < self.reach] for a in (dst, edge, place))
        cuts = np.searchsorted(dst, np.arange(0, n + ROWS, ROWS))
        lists, fresh = np.empty((n, self.reach), np.int32), np.empty((n, self.reach), bool)
        for a, lo, hi in zip(range(0, n, ROWS), cuts, cuts[1:], strict=False):
            rows = slice(a, min(a + ROWS, n))
            shape = rows.stop - a, self.reach
            near, sim, new = np.full(shape, -1, np.int32), np.full(shape, -np.inf, np.float32), np.zeros(shape, bool)
            at, e = (dst[lo:hi] - a, place[lo:hi]), edge[lo:hi]
            near[at], sim[at], new[at] = e // self.degree, self.sim.ravel()[e], self.fresh.ravel()[e]
            lists[rows], _, fresh[rows] = _best(*(np.concatenate(both, 1) for both in ((self.near[rows], near), (self.sim[rows], sim), (self.fresh[rows], new))), self.reach)
        return lists, fresh

    def _round(self) -> int:
        """Neighbours of every node meet if one of them is new to it; returns how many edges changed."""
        lists, new = self._both_ways()
        self.fresh[:] = False
        worst = self.sim.min(1)
        lists = np.take_along_axis(lists, np.argsort(~new, axis=1, kind="stable"), 1)
        count = new.sum(1)
        hubs = np.argsort(-count, kind="stable")
        hubs = hubs[: np.count_nonzero(count)]
        found: list[tuple[np.ndarray, ...]] = []
        at = size = 0
        while at < len(hubs):
            f = int(count[hubs[at]])  # the new ones come first in the lists, no hub of this step has more
            members = lists[hubs[at : at + max(1, MEETING // (self.reach * max(f, self.x.shape[1])))]]
            at += len(members)
            x, own, none = self.x.take(members, 0), self.own.take(members), members < 0
            sims = np.matmul(x[:, :f], x.transpose(0, 2, 1))
            sims *= 2
            sims -= own[:, :f, None]
            sims -= own[:, None, :]
            sims[:, np.arange(f), np.arange(f)] = -np.inf
            if none.any():
                sims[np.broadcast_to(none[:, :f, None] | none[:, None, :], sims.shape)] = -np.inf
            bar = worst.take(members)
            place = np.flatnonzero(sims > bar[:, :f, None])
            i, j = np.divmod(place, self.reach)
            i, g = i % f, i // f
            found.append((members[g, i], members[g, j], sims.ravel()[place]))
            size += len(g)
            g, i, j = np.nonzero(sims[:, :, f:] > bar[:, None, f:])
            found.append((members[g, j + f], members[g, i], sims[g, i, j + f]))
            size += len(g)
            if size > FOUND or at >= len(hubs):
                self._add(*(np.concatenate([part[k] for part in found]) for k in range(3)), worst)
                found, size = [], 0
        return int(self.fresh.sum())

    def _add(self, src: np.ndarray, dst: np.ndarray, sim: np.ndarray, worst: np.ndarray) -> None:
        """Edges enter the lists of their sources where they beat the worst; ``worst`` follows."""
        better = sim > worst[src]
        src, dst, sim = src[better], dst[better], sim[better]
        key = src.astype(np.int64) << 32 | dst
        order = np.argsort(key)
        key = key[order]
        order = order[np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]]
        src, dst, sim = src[order], dst[order], sim[order]
        unknown = np.empty(len(src), bool)
        for a in range(0, len(src), 8 * ROWS):
            part = slice(a, a + 8 * ROWS)
            unknown[part] = ~(self.near.take(src[part], 0) == dst[part, None]).any(1)
        src, dst, sim = src[unknown], dst[unknown], sim[unknown]
        order = _order(src, sim)
        src, dst, sim = src[order], dst[order], sim[order]
        place = np.arange(len(src)) - np.searchsorted(src, src)
        src, dst, sim, place = (a[place < self.degree] for a in (src, dst, sim, place))
        rows, at = np.unique(src, return_inverse=True)
        cuts = np.searchsorted(at, np.arange(0, len(rows) + ROWS, ROWS))
        for a, lo, hi in zip(range(0, len(rows), ROWS), cuts, cuts[1:], strict=False):
            r = rows[a : a + ROWS]
            shape = len(r), int(place[lo:hi].max()) + 1
            near, sims, where = np.full(shape, -1, np.int32), np.full(shape, -np.inf, np.float32), (at[lo:hi] - a, place[lo:hi])
            near[where], sims[where] = dst[lo:hi], sim[lo:hi]
            near, sims, new = np.concatenate([self.near[r], near], 1), np.concatenate([self.sim[r], sims], 1), np.concatenate([self.fresh[r], near >= 0], 1)
            top = _top(sims, self.degree)
            self.near[r], self.sim[r], self.fresh[r] = (np.take_along_axis(all_, top, 1) for all_ in (near, sims, new))
            worst[r] = self.sim[r].min(1)

    def _starts(self, q: np.ndarray, points: np.ndarray, own: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` best nodes of the blocks where the trees put the points, and scores; a query's own node is one of them."""
        ids, score = np.full((len(q), beam), -1, np.int32), np.full((len(q), beam), -np.inf, np.float32)
        ids[:, 0], score[own >= 0, 0] = own, np.inf
        q32 = q.astype(np.float32)
        blocks = -(-len(self.x) // self.block)
        for order, sorted_, code in zip(self.orders, self.codes, _codes(points, len(self.orders)), strict=True):
            block = np.minimum(np.searchsorted(sorted_, code) // self.block, blocks - 1)
            by = np.argsort(block, kind="stable")
            cuts = np.searchsorted(block[by], np.arange(blocks + 1))
            for b in np.flatnonzero(np.diff(cuts)):
                r, rows = by[cuts[b] : cuts[b + 1]], order[b * self.block : (b + 1) * self.block]
                sims = q32[r] @ self.x.take(rows, 0).T
                top = _top(sims, beam)
                near, sims = np.concatenate([ids[r], rows[top]], 1), np.concatenate([score[r], np.take_along_axis(sims, top, 1)], 1)
                known = np.arange(near.shape[1]) >= beam
                ids[r], score[r], _ = _best(near, sims, np.broadcast_to(known, near.shape), beam)
        exact = np.full(score.shape, -np.inf)
        for a in range(0, len(q), WALKERS):
            who, at = np.nonzero(ids[a : a + WALKERS] >= 0)
            exact[a + who, at] = np.einsum("ij,ij->i", self.x.take(ids[a + who, at], 0).astype(float), q[a + who])
        return ids, exact

    def _walk(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray, width: int) -> None:
        """Expands the ``width`` best nodes not expanded yet until all that are remembered are; updates ids and scores."""
        n, beam, open_ = len(self.x), ids.shape[1], ids >= 0
        seen = np.zeros((len(q), n + 1), bool)
        seen[:, n] = True
        seen[np.arange(len(q))[:, None], ids] = True  # -1 is the last column
        seen = seen.ravel()
        walking = np.arange(len(q))
        while len(walking := walking[open_[walking].any(1)]):
            row = walking[:, None]
            top = _top(np.where(open_[walking], score[walking], -np.inf), width)
            node = np.where(open_[row, top], ids[row, top], -1)
            open_[row, top] = False
            met = self.roads.take(node, 0)
            met[node < 0] = -1
            met = met.reshape(len(walking), -1)
            place = np.where(met < 0, n, met) + row * (n + 1)
            new = np.flatnonzero(~seen.take(place))
            place = np.sort(place.ravel().take(new))
            place = place[np.concatenate([[True], place[1:] != place[:-1]])[: len(place)]]
            seen[place] = True
            who, met = np.divmod(place, n + 1)
            who = np.searchsorted(walking, who)
            if not len(who):
                continue
            cuts = np.searchsorted(who, np.arange(len(walking) + 1))
            x = self.x.take(met, 0)
            ids_ = np.full((len(walking), beam + int(np.diff(cuts).max())), -1, np.int32)
            score_ = np.full(ids_.shape, -np.inf)
            ids_[:, :beam], score_[:, :beam] = ids[walking], score[walking]
            for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                ids_[i, beam : beam + hi - lo] = met[lo:hi]
                score_[i, beam : beam + hi - lo] = x[lo:hi].astype(float) @ q[walking[i]]
            opened = np.concatenate([open_[walking], ids_[:, beam:] >= 0], 1)
            top = _top(score_, beam)
            ids[walking], score[walking], open_[walking] = (np.take_along_axis(a, top, 1) for a in (ids_, score_, opened))

    def search(self, q: np.ndarray, points: np.ndarray, own: np.ndarray, width: int = WIDTH, beam: int = BEAM) -> np.ndarray:
        """Of each query the ``beam`` best nodes met on the walk, -1 where there are fewer.

        q: rows as wide as x, scored by inner product in double precision; points: where the trees look for them; own: their own nodes or -1.
        """
        ids, score = self._starts(q, points, own, beam)
        for a in range(0, len(q), WALKERS):
            some = slice(a, a + WALKERS)
            self._walk(q[some], ids[some], score[some], width)
        return ids


# --- shards -----------------------------------------------------------------------------------------------------------


def _calls(strata: Strata, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each shard that a query enters: those of strata that can reach the k + 1 best nodes of all samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            u = _directions(_dense(batch.column("vector")).astype(float))
            best = np.full((len(u), k + 1), -np.inf)
            for x in strata.samples:
                best = -np.partition(-np.concatenate([best, u @ x.T], 1), k, axis=1)[:, : k + 1]
            for s, longest in enumerate(strata.longest):
                some = batch.filter(pa.array(longest * (1 + 1e-5) >= best[:, k]))
                for shard in range(strata.first[s], strata.first[s] + strata.parts[s]) if len(some) else ():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), shard, np.int32)), *(some.column(c) for c in ("query_id", "node", "vector"))], ["shard", "query_id", "node", "vector"])

    return run


def _parts(strata: Strata) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The shard of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, node = batch.column("stratum").to_numpy(), batch.column("node")
            shard = strata.first[s] + (mix(node.to_numpy().view(np.uint64)) % strata.parts[s].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), node, batch.column("vector")], ["shard", "node", "vector"])

    return run


class Shard:
    """Nodes of a shard in ascending order, their vectors and their graph."""

    def __init__(self, node: np.ndarray, vector: np.ndarray, longest: float, mean: np.ndarray):
        order = np.argsort(node)
        self.node, self.vector, self.mean = node[order], vector[order], mean
        x = np.empty((len(node), len(mean)), np.float32)
        for a in range(0, len(node), ROWS):
            x[a : a + ROWS] = _lift(self.vector[a : a + ROWS].astype(float) / longest) - mean
        self.graph = NeighbourGraph(x)

    def answers(self, query: np.ndarray, own: np.ndarray, vector: np.ndarray, k: int) -> pa.RecordBatch:
        """query_id, node, score: of each query the k + 1 best nodes met, scored on the original vectors; ties go to smaller nodes."""
        q = vector.astype(float)
        u = _directions(q)
        at = np.minimum(np.searchsorted(self.node, own), len(self.node) - 1)
        met = self.graph.search(np.pad(u, ((0, 0), (0, 1))), (u - self.mean[:-1]).astype(np.float32), np.where(self.node[at] == own, at, -1))
        out: list[tuple[np.ndarray, ...]] = []
        for a in range(0, len(q), WALKERS):
            ids = met[a : a + WALKERS]
            ids = np.sort(np.where(ids < 0, len(self.node), ids), axis=1)
            there = ids < len(self.node)
            x = self.vector.take(np.where(there, ids, 0).ravel(), 0).astype(float)
            score = np.einsum("ij,ij->i", np.repeat(q[a : a + WALKERS], ids.shape[1], axis=0), x).reshape(ids.shape)
            score[~there] = -np.inf
            top = np.argsort(-score, axis=1, kind="stable")[:, : k + 1]
            ids, score, there = (np.take_along_axis(m, top, 1) for m in (ids, score, there))
            out.append((np.repeat(query[a : a + WALKERS], there.sum(1)), self.node[ids[there]], score[there]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out])) for i in range(3)], ["query_id", "node", "score"])


def _answers(strata: Strata, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches sorted by shard, in each the nodes (query_id null) before the queries that enter it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, shard = -1, [], None
        for batch in batches:
            key = batch.column("shard").to_numpy().astype(np.int64) * 2 + np.asarray(batch.column("query_id").is_valid())
            cuts = [*np.flatnonzero(np.diff(key, prepend=-1)), len(batch)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                rows, (k_, asks) = batch.slice(lo, hi - lo), divmod(int(key[lo]), 2)
                if k_ != now:
                    now, nodes, shard = k_, [], None
                node, vector = rows.column("node").to_numpy(), _dense(rows.column("vector"))
                if not asks:
                    nodes.append((node.copy(), vector.copy()))
                    continue
                if shard is None and nodes:
                    s = int(np.searchsorted(strata.first, now, "right")) - 1
                    shard, nodes = Shard(np.concatenate([n for n, _ in nodes]), np.concatenate([v for _, v in nodes]), strata.longest[s], strata.means[s]), []
                if shard is not None:  # a shard of few nodes may be empty
                    yield shard.answers(rows.column("query_id").to_numpy(), node, vector, k)

    return run


def search(queries: DataFrame, sized: DataFrame, k: int) -> DataFrame:
    """(query_id, node, score): the k + 1 best nodes found for each query. queries: (query_id, node, vector); sized: see by_length().

    Every shard is one task: it builds the graph of its nodes, then its queries walk it.
    """
    keys, strata = strata_of(sized)
    kind = queries.schema["vector"].dataType.simpleString()
    at = F.array_position(F.lit(keys).cast("array<int>"), F.col("stratum")) - 1
    dealt = sized.select("node", at.cast("int").alias("stratum"), "vector").mapInArrow(_parts(strata), f"shard int, node long, vector {kind}")
    calls = queries.mapInArrow(_calls(strata, k), f"shard int, query_id long, node long, vector {kind}")
    both = dealt.select("shard", F.lit(None).cast("long").alias("query_id"), "node", "vector").union(calls)
    shards = max(1, int(strata.parts.sum()))
    sorted_ = both.repartitionById(min(shards, 4096), F.col("shard") % min(shards, 4096)).sortWithinPartitions("shard", F.asc_nulls_first("query_id"))
    met = sorted_.mapInArrow(_answers(strata, k), "query_id long, node long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    return met.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r")


def neighbours(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row whose vec_id is divisible by ``every``.

    A query's own row is no candidate, rows with an equal vector are. Ties go to the smaller vec_id. Rows that take no part
    (see usable()) neither ask nor answer; of several vectors under one vec_id the smallest takes part. With fewer than k
    candidates all are returned. An empty table gives an empty table.
    """
    rows = stored(usable(vectors).groupBy("vec_id").agg(F.min("vector").alias("vector")))
    same = Window.partitionBy("node").orderBy("vec_id")
    groups = stored(rows.groupBy("vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")))
    # Most vectors come once: only rows of the others need a join to know their node.
    shared = stored(groups.filter("n > 1").select("vector", "node"))
    member = stored(groups.filter("n = 1").select(F.col("node").alias("vec_id"), "node").union(rows.join(shared, "vector").select("vec_id", "node")))
    asking = stored(rows.filter(F.col("vec_id") % every == 0).join(member, "vec_id").select(F.col("vec_id").alias("query_id"), "node", "vector"))
    discard(rows, shared)
    sized = stored(by_length(groups))
    discard(groups)
    # k + 1 nodes are enough, and k + 1 members of a node: one may be the query's own row.
    exact = stored(search(asking, sized, k))
    discard(sized, asking)
    first = member.withColumn("r", F.row_number().over(same)).filter(F.col("r") <= k + 1).select("node", "vec_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = exact.join(first, "node").filter(F.col("query_id") != F.col("vec_id")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
