"""Retrieval: vector top-k, documentation-aware re-ranking, topics, structure text, repository state."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import constants as K
from loomgraph.functions import derive as D
from loomgraph.operators import rollups as R
from loomgraph.operators.edges import union_all
from loomgraph.session import materialize
from loomgraph.sources.scan import directory_closure

QUESTION_BATCH = 1024
#: Rows of a block of vectors, and questions whose products with a block are held at one time.
BLOCK, QUESTION_ROWS = 4096, 64
HIT_SCHEMA = "query_id string, repo_url string, file_path string, start_line int, chunk_id string, score double"


def _batch_topk(ids: list[str], vectors: np.ndarray, ks: np.ndarray, per_repo: bool):
    """Arrow function: scores a batch against all questions and keeps the best k per question (and repository).

    Only those rows leave the task, so the pair matrix lives in one batch at a time.
    """
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    dim = unit.shape[1]

    def run(batches):
        for batch in batches:
            col = batch.column("embedding")
            keep = (col.is_valid().to_numpy(zero_copy_only=False)
                    & (pa.compute.list_value_length(col).fill_null(-1).to_numpy(zero_copy_only=False) == dim))
            if not keep.any():
                continue
            if not keep.all():
                batch = batch.filter(pa.array(keep))
                col = batch.column("embedding")
            m = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
            scores = np.round((1.0 + m @ unit.T) / 2.0, 6)
            n = len(m)
            paths, lines = batch.column("file_path").to_pandas(), batch.column("start_line").to_numpy()
            chunks = batch.column("chunk_id").to_pandas()
            repos = batch.column("repo_url").to_pandas()
            group = repos.factorize()[0] if per_repo else np.zeros(n, dtype=int)
            tie = np.empty(n, dtype=int)
            tie[np.lexsort((chunks.factorize(sort=True)[0], repos.factorize(sort=True)[0], lines,
                            paths.factorize(sort=True)[0]))] = np.arange(n)
            rows, which = [], []
            for q in range(scores.shape[1]):
                s, k = scores[:, q], int(ks[q])
                cand = np.arange(n)
                if not per_repo and n > k:
                    cand = np.flatnonzero(s >= np.partition(s, n - k)[n - k])
                order = cand[np.lexsort((tie[cand], -s[cand], group[cand]))]
                g = group[order]
                starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
                rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
                best = order[rank < k]
                rows.append(best)
                which.append(np.full(len(best), q))
            row, q = np.concatenate(rows), np.concatenate(which)
            taken = batch.select(["repo_url", "file_path", "start_line", "chunk_id"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in q], pa.string()), *taken.columns, pa.array(scores[row, q], pa.float64())],
                names=["query_id", "repo_url", "file_path", "start_line", "chunk_id", "score"])
    return run


def _packed(kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrow function: rows of one dimension as blocks of at most BLOCK unit vectors, with their columns as arrays."""
    others = {"q": {"query_id": pa.string(), "k": pa.int32()}, "c": {"repo_url": pa.string(), "tie": pa.int64()}}[kind]

    def block(dim: int, rows: list[tuple]) -> pa.RecordBatch:
        vectors, *rest = zip(*rows, strict=True)
        m = np.array(vectors, dtype=np.float64)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        return pa.RecordBatch.from_arrays(
            [pa.array([m.tobytes()], pa.binary()), pa.array([dim], pa.int32()),
             *[pa.array([list(x)], pa.list_(t)) for x, t in zip(rest, others.values(), strict=True)]], [f"{kind}_m", f"{kind}_dim", *others])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for vector, *rest in zip(*[batch.column(c).to_pylist() for c in ["embedding", *others]], strict=True):
                if vector is None or None in vector or not np.isfinite(vector).all():
                    continue
                rows = held.setdefault(len(vector), [])
                rows.append((vector, *rest))
                if len(rows) == BLOCK:
                    yield block(len(vector), held.pop(len(vector)))
        for dim, rows in held.items():
            yield block(dim, rows)

    return run


def _best(q: np.ndarray, c: np.ndarray, ks: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, candidate, score) of the best k candidates of every question.

    Products in single precision, with a margin for their error and the rounding, leave few candidates of each question; those
    get the exact score. The k-th largest of the largest of spans of candidates is at most the k-th largest of all.
    """
    k, n, out = int(ks.max()), len(c), []
    spans = min(n, max(8 * k, 64))
    width, margin = n // spans, 4e-6 + (c.shape[1] + 8) * 2.5e-7
    q32, c32 = q.astype(np.float32), np.ascontiguousarray(c.T, dtype=np.float32)
    for first in range(0, len(q), QUESTION_ROWS):
        s = q32[first:first + QUESTION_ROWS] @ c32
        if n > k:
            top = s[:, :spans * width].reshape(len(s), spans, width).max(axis=2)
            least = np.partition(top, spans - k, axis=1)[:, spans - k] - np.float32(margin)
            at = np.flatnonzero(s >= least[:, None])
        else:
            at = np.arange(s.size)
        who, which = at // n + first, at % n
        score = np.round((1.0 + np.einsum("ij,ij->i", q[who], c[which])) / 2.0, 6)
        order = np.lexsort((tie[which], -score, who))
        who, which, score = who[order], which[order], score[order]
        best = np.arange(len(who)) - np.searchsorted(who, who) < ks[who]
        out.append((who[best], which[best], score[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _block_topk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Best k candidates of a block, in each repository of it, for every question of a question block."""
    for batch in batches:
        for r in range(len(batch)):
            row = {c: batch.column(c)[r] for c in batch.schema.names}
            q, c = (np.frombuffer(row[f"{x}_m"].as_buffer(), dtype=np.float64).reshape(-1, row[f"{x}_dim"].as_py()) for x in "qc")
            ids, ks, tie = row["query_id"].values, row["k"].values.to_numpy(), row["tie"].values.to_numpy()
            repos = row["repo_url"].values.dictionary_encode()
            group = repos.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for g in np.unique(group):  # rows of a repository stand together
                own = np.flatnonzero(group == g)
                who, which, score = _best(q, c[own], ks, tie[own])
                repo = pa.array([repos.dictionary[int(g)].as_py() if g >= 0 else None], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(who)), repo.take(pa.array(np.zeros(len(who), dtype=np.int64))), pa.array(tie[own][which]), pa.array(score)],
                    ["query_id", "repo_url", "tie", "score"])


def _topk_by_blocks(slim: DataFrame, questions: DataFrame, per_repo: bool) -> DataFrame:
    """Best chunks for any number of questions: every block of questions meets every block of candidates in a task of Spark.

    The candidates are written once in the order that breaks ties and numbered along it. Blocks are bounded matrices, hits
    carry the numbers of their rows, and the columns of a row come back when the best are known. All pairs are scored, so
    time grows with both; memory and what is shuffled do not.
    """
    ordered = materialize(slim.orderBy("file_path", "start_line", "repo_url", "chunk_id").withColumn("tie", F.monotonically_increasing_id()))
    rows, n = ordered.select("embedding", "repo_url", "tie"), max(1, math.ceil(ordered.count() / BLOCK))
    rows = (rows.repartitionByRange(n, "repo_url", "tie").sortWithinPartitions("repo_url", "tie") if per_repo
            else rows.withColumn("repo_url", F.lit(None).cast("string")).repartition(n))
    c = materialize(rows.mapInArrow(_packed("c"), "c_m binary, c_dim int, repo_url array<string>, tie array<long>"))
    asked = questions.select("embedding", "query_id", F.col("k").cast("int").alias("k"))
    q = materialize(asked.repartition(max(1, math.ceil(asked.count() / BLOCK))).mapInArrow(
        _packed("q"), "q_m binary, q_dim int, query_id array<string>, k array<int>"))
    pairs = q.hint("shuffle_replicate_nl").crossJoin(c).filter("q_dim = c_dim")
    hits = pairs.mapInArrow(_block_topk, "query_id string, repo_url string, tie long, score double")
    w = Window.partitionBy(*["query_id", "repo_url"][:1 + per_repo]).orderBy(F.desc("score"), "tie")
    max_k = questions.agg(F.max("k")).scalar()
    ks = questions.select("query_id", F.col("k").alias("max_k"))
    best = hits.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= max_k).join(ks, "query_id").filter(F.col("rn") <= F.col("max_k"))
    return best.drop("repo_url").join(ordered.drop("embedding"), "tie").select(
        "query_id", "repo_url", "file_path", "start_line", "chunk_id", "score", "rn")


def vector_topk_many(candidates: DataFrame, questions: DataFrame, per_repo: bool = False) -> DataFrame:
    """Best chunks per question, optionally per question and repository.

    candidates: repo_url, file_path, start_line, chunk_id, embedding. questions: query_id, embedding, k. Up to QUESTION_BATCH
    questions go to the tasks as one matrix, in one pass over the candidates; more, or some without a vector or of another
    dimension, stay in the cluster and meet the candidates block by block. Score is (1 + cosine) / 2, rounded to 6 digits; ties are broken by path, line, id.
    """
    asked = questions.select("query_id", "embedding", "k").limit(QUESTION_BATCH + 1).collect()
    slim = candidates.select("repo_url", "file_path", F.col("start_line").cast("int"), "chunk_id", "embedding")
    if not asked:
        return candidates.sparkSession.createDataFrame([], HIT_SCHEMA + ", rn int")
    whole = all(r.embedding and None not in r.embedding for r in asked) and len({len(r.embedding) for r in asked}) == 1
    if len(asked) > QUESTION_BATCH or not whole:
        return _topk_by_blocks(slim, questions, per_repo)
    fn = _batch_topk([r.query_id for r in asked], np.array([r.embedding for r in asked], dtype=np.float64), np.array([r.k for r in asked]), per_repo)
    scope = ["query_id", "repo_url"] if per_repo else ["query_id"]
    w = Window.partitionBy(*scope).orderBy(F.desc("score"), "file_path", "start_line", "repo_url", "chunk_id")
    ks = questions.select("query_id", F.col("k").alias("max_k"))
    return (
        # The largest k as a literal is a limit Spark applies in every task before the shuffle; each question's own k follows.
        slim.mapInArrow(fn, HIT_SCHEMA).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= max(r.k for r in asked)).join(ks, "query_id")
        .filter(F.col("rn") <= F.col("max_k")).drop("max_k")
    )


def attach_text(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    return hits.join(chunks.select("repo_url", "chunk_id", F.col("content").alias("text")), ["repo_url", "chunk_id"])


def vector_topk(candidates: DataFrame, question: DataFrame, repo_url: str | None = None) -> DataFrame:
    """Top-k of one question (one row: query_id, embedding, k), in one repository or in all."""
    scoped = candidates if repo_url is None else candidates.filter(F.col("repo_url") == repo_url)
    return vector_topk_many(scoped, question)


def boost_hits(hits: DataFrame, files: DataFrame, scope: list[str]) -> DataFrame:
    """Boost documentation, drop low scores and rank anew inside the scope."""
    docs = files.select("repo_url", F.col("path").alias("file_path"), "is_documentation")
    boosted = hits.drop("rn").join(docs, ["repo_url", "file_path"]).withColumn(
        "score", F.round(D.doc_boost(F.col("file_path"), F.col("is_documentation"), F.col("score")), 6)) \
        .drop("is_documentation").filter(F.col("score") > K.SCORE_THRESHOLD)
    w = Window.partitionBy(*scope).orderBy(F.desc("score"), "file_path", "start_line", "repo_url", "chunk_id")
    return boosted.withColumn("rn", F.row_number().over(w))


def readme_first(chunks: DataFrame, files: DataFrame, k: int, repo_url: str | None = None) -> DataFrame:
    """Documentation chunks that have a vector, at a fixed high score."""
    path = F.col("path")
    docs = files.filter(path.contains("README") | F.col("is_documentation")).select(
        "repo_url", F.col("path").alias("file_path"))
    scoped = chunks if repo_url is None else chunks.filter(F.col("repo_url") == repo_url)
    return (
        scoped.filter("embedding IS NOT NULL").join(docs, ["repo_url", "file_path"], "left_semi")
        .select("repo_url", "chunk_id", F.col("content").alias("text"), F.col("file_path").alias("path"), "start_line",
                F.lit(K.README_FIXED_SCORE).alias("score"))
        .orderBy("path", "start_line", "repo_url", "chunk_id").limit(k)
    )


def topic_chunks(chunks: DataFrame, topic: str, repo_url: str | None = None, k: int = K.TOPIC_LIMIT) -> DataFrame:
    """Top chunks of a topic, README and docs first."""
    text, path = F.col("content"), F.col("file_path")
    if topic in ("microservices", "services"):
        hit = D.contains_any(text, K.TOPIC_WORDS["microservices"])
    elif topic in ("architecture", "structure"):
        hit = D.contains_any(text, K.TOPIC_WORDS["architecture"])
    elif topic in ("overview", "about"):
        hit = path.contains("README.md") | path.contains("/docs/") | path.endswith(".md")
    else:
        hit = text.contains(topic)
    return top_by_priority(chunks, hit, topic, repo_url, k)


def top_by_priority(chunks: DataFrame, hit: Column, topic: str, repo_url: str | None, k: int) -> DataFrame:
    scoped = chunks if repo_url is None else chunks.filter(F.col("repo_url") == repo_url)
    path = F.col("file_path")
    return (
        scoped.filter(hit)
        .select(F.lit(topic).alias("topic"), "repo_url", "chunk_id", F.col("content").alias("text"), path.alias("path"),
                "start_line", D.priority_rank(path).alias("priority"))
        .orderBy(F.desc("priority"), "path", "start_line", "repo_url", "chunk_id").limit(k)
    )


def project_structure(chunks: DataFrame, files: DataFrame, words: list[str] | None = None) -> DataFrame:
    """Distinct union of README chunks, docs chunks, directory counts and documentation chunks with structure words.

    The limit belongs to the last branch only. ``words`` replaces the structure words.
    """
    text, path = F.col("content"), F.col("file_path")
    shape = lambda df, p: df.select("repo_url", text.alias("text"), path.alias("path"), F.col("start_line").cast("long").alias(
        "start_line"), F.lit(p).alias("priority"))
    readme = path.contains("README.md") | path.endswith("/README") | path.endswith("/README.txt")
    in_docs = path.contains("/docs/") & (path.endswith(".md") | path.endswith(".txt"))
    dirs = R.top_dirs(files, 15).select(
        F.lit("").alias("repo_url"), F.concat(F.lit("Top-level directory: "), "top_dir", F.lit(" (contains "), F.col("file_count").cast("string"),
                 F.lit(" files)")).alias("text"),
        F.lit("directory_structure").alias("path"), F.lit(0).cast("long").alias("start_line"),
        F.lit(2.0).alias("priority"))
    worded = (
        chunks.filter((F.col("is_documentation") | path.endswith(".md"))
                      & D.contains_any(text, words or K.TOPIC_WORDS["project_structure"]))
        .orderBy("file_path", "start_line", "repo_url", "chunk_id").limit(30)
    )
    return union_all([shape(chunks.filter(readme), 4.0), shape(chunks.filter(in_docs), 3.0), dirs,
                      shape(worded, 1.0)]).distinct()


def readme_hits(asked: DataFrame, candidates: DataFrame, files: DataFrame, active_repo: str) -> DataFrame:
    """For questions about the structure of a repository: its README and documentation chunks at a fixed high score.

    asked: query_id, question, k. The questions are those of one time and become one array; per repository the first
    k rows leave a task (five of a connected repository).
    """
    wanting = asked.filter(D.wants_readme_first(F.col("question"))).agg(F.collect_list(F.struct("query_id", "k"))).scalar()
    docs = files.filter(F.col("path").contains("README") | F.col("is_documentation")).select("repo_url", F.col("path").alias("file_path"))
    most = max(K.K_HIGH_LEVEL, K.K_NORMAL)
    w = Window.partitionBy("repo_url").orderBy("file_path", "start_line", "chunk_id")
    first = candidates.filter("embedding IS NOT NULL").join(docs, ["repo_url", "file_path"], "left_semi").select(
        "repo_url", "file_path", F.col("start_line").cast("int").alias("start_line"), "chunk_id").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most)
    limit = F.when(F.col("repo_url") == active_repo, F.col("k")).otherwise(K.K_SECONDARY)
    return first.select("*", F.inline(wanting)).filter(F.col("rn") <= limit).select(
        "query_id", "repo_url", "file_path", "start_line", "chunk_id", F.lit(K.README_FIXED_SCORE).alias("score"), "rn")


def services_shortcut(questions: DataFrame, service_topic: DataFrame) -> DataFrame:
    """(query_id, rows): the topical rows for every question that mentions services, where there are at least two of them.

    The topical rows are one top-k result, the same for all questions: one small array.
    """
    topic_rows = service_topic.agg(F.array_sort(F.collect_list(F.struct(
        "repo_url", "chunk_id", F.col("path").alias("source"), "start_line", "text"))).alias("rows")).scalar()
    return questions.filter(D.contains_any(F.lower("question"), ["services"])).select(
        "query_id", topic_rows.alias("rows")).filter(F.size("rows") >= 2)


def retrieve_context(questions: DataFrame, candidates: DataFrame, chunks: DataFrame, files: DataFrame,
                     connected: DataFrame, active_repo: str, service_topic: DataFrame) -> DataFrame:
    """Ranked context for each question (query_id, question, embedding).

    Questions that mention services get the topical rows (``service_topic``) when there are at least two of them. The
    others get the boosted vector hits of the active repository and, when those are fewer than three, up to five of each
    connected repository at a lower score. A question about structure takes the README and documentation chunks of a
    repository that has any instead of its vector hits. README hits count more for high-level questions.
    """
    q = F.col("question")
    asked = questions.select("query_id", "question", D.is_high_level(q).alias("is_high_level"), "embedding",
                             F.when(D.is_high_level(q), K.K_HIGH_LEVEL).otherwise(K.K_NORMAL).alias("k"))
    in_scope = candidates.join(
        connected.select("repo_url").unionByName(
            candidates.sparkSession.range(1).select(F.lit(active_repo).alias("repo_url"))).distinct(),
        "repo_url", "left_semi")
    hits = vector_topk_many(in_scope, asked, per_repo=True)
    is_active = F.col("repo_url") == active_repo
    limited = hits.filter(is_active | (F.col("rn") <= K.K_SECONDARY))
    readme = readme_hits(asked, in_scope, files, active_repo)
    boosted = boost_hits(limited, files, ["query_id", "repo_url"]).join(
        readme.select("query_id", "repo_url").distinct(), ["query_id", "repo_url"], "left_anti")
    ranked = union_all([t.select("query_id", "repo_url", "file_path", "start_line", "chunk_id", "score") for t in (boosted, readme)])
    # A window, not a second branch: the scan behind the hits runs once.
    n_primary = F.count_if(is_active).over(Window.partitionBy("query_id"))
    short = services_shortcut(questions, service_topic)
    flags = asked.select("query_id", "is_high_level").join(short.select("query_id"), "query_id", "left_anti")
    searched = (
        ranked.withColumn("n_primary", n_primary).join(flags, "query_id")
        .filter(is_active | (F.col("n_primary") < K.MIN_PRIMARY_HITS))
        .withColumn("secondary_repo", ~is_active)
        .withColumn("score", F.round(
            F.col("score")
            * F.when(F.col("is_high_level") & (F.col("file_path").contains("README") | F.col("file_path").contains("readme")),
                     K.HIGH_LEVEL_README_BOOST).otherwise(1.0)
            * F.when(~is_active, K.SECONDARY_FACTOR).otherwise(1.0), 6))
    )
    vector_rows = attach_text(searched, chunks).select(
        "query_id", "repo_url", "chunk_id", F.col("file_path").alias("source"), "start_line", "score", "secondary_repo",
        "text")
    topical = short.select("query_id", F.inline("rows")).select(
        "query_id", "repo_url", "chunk_id", "source", "start_line", F.lit(1.0).alias("score"),
        F.lit(False).alias("secondary_repo"), "text")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "source", "start_line", "repo_url", "chunk_id")
    return vector_rows.unionByName(topical).withColumn("rn", F.row_number().over(w))


# --- listings --------------------------------------------------------------------------------------------

def interface_analysis(classes: DataFrame, k: int = 20) -> DataFrame:
    from loomgraph.functions.predicates import interface_name

    return classes.filter(interface_name(F.col("name"))).select(
        F.col("file_path").alias("file"), F.col("name").alias("interface"), F.col("start_line").alias("line"),
        "repo_url").orderBy("file", "line", "interface", "repo_url").limit(k)


def first_rows(rows: DataFrame, columns: list[str], order: list[str], k: int) -> DataFrame:
    """First k rows in a total order."""
    return rows.orderBy(*order).limit(k).select(*columns)


def directories(graph) -> DataFrame:
    return directory_closure(graph.files)


def directory_listing(files: DataFrame) -> DataFrame:
    """Tree rows (depth, parent, name, kind) of every directory and file."""
    p = F.col("path")
    dirs = directory_closure(files).select(
        "repo_url", F.col("dir_path").alias("path"), F.lit("directory").alias("kind"))
    return files.select("repo_url", "path", F.lit("file").alias("kind")).unionByName(dirs).select(
        "repo_url", "path", D.depth(p).cast("long").alias("depth"), D.dirname(p).alias("parent"),
        D.basename(p).alias("name"), "kind")


def readme_bundle(chunks: DataFrame, files: DataFrame, fallback_limit: int = 20) -> DataFrame:
    """Text of the README files of each repository, or of up to ``fallback_limit`` documentation chunks where none is.

    Rows are one per file; the group that is joined to a text is one file.
    """
    path = F.col("file_path")
    slim = chunks.select("repo_url", "file_path", "start_line", "content", "is_documentation")
    readme = path.contains("README") | path.contains("readme")
    own = slim.filter(readme)
    has = own.select("repo_url").distinct()
    rank = F.when(path.contains("README"), 0).when(path.contains("/docs/"), 1).otherwise(2)
    w = Window.partitionBy("repo_url").orderBy(rank, "file_path", "start_line")
    other = (
        slim.filter(F.col("is_documentation") | path.endswith(".md")).join(has, "repo_url", "left_anti")
        .withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= fallback_limit).drop("rn")
    )
    items = F.array_sort(F.collect_list(F.struct("start_line", "content")))
    return own.unionByName(other).groupBy("repo_url", "file_path").agg(
        F.array_join(F.transform(items, lambda x: x["content"]), "\n").alias("content")).withColumn(
        "position", F.when((D.depth(path) <= 1) & path.contains("README"), 0).otherwise(1))


# --- repositories ----------------------------------------------------------------------------------------

def repository_rows(repositories: DataFrame, active_url: str | None) -> DataFrame:
    active = F.lit(False) if active_url is None else F.col("url") == active_url
    return repositories.select("url", "service_name", "description",
                               F.coalesce("last_indexed_commit_sha", F.lit("")).alias("last_commit"),
                               F.lit(None).cast("string").alias("last_indexed"), active.alias("is_active"))


def active_repository(repositories: DataFrame) -> DataFrame:
    """The active repository, else the first by url."""
    return repositories.orderBy(F.desc("is_active"), "url").limit(1)


def set_active_repository(repositories: DataFrame, url: str) -> DataFrame:
    """All rows with the flag moved to ``url``; unchanged flags when there is no such repository."""
    found = repositories.agg(F.bool_or(F.col("url") == url).alias("found")).scalar()
    return repositories.withColumn("is_active", F.when(found, F.col("url") == url).otherwise(F.col("is_active")))


def changed_repositories(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Repositories to ingest: forced, never stored, or with another commit than the stored one."""
    return current.join(stored, "url", "left").filter(
        F.col("force") | ~F.col("last_indexed_commit_sha").eqNullSafe(F.col("current_sha")))


def concat_results(*frames: DataFrame) -> DataFrame:
    return union_all(list(frames))


def dedup_keep_first(frames: list[DataFrame], key: str, order: list[str]) -> DataFrame:
    """Union of ordered sources; of equal keys the row of the earliest source stays."""
    tagged = union_all([f.withColumn("source_no", F.lit(i)) for i, f in enumerate(frames)])
    w = Window.partitionBy(key).orderBy("source_no", *order)
    return tagged.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def missing_rows(scanned: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    return scanned.join(stored.select(*keys), keys, "left_anti")
