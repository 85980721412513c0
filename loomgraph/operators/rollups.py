"""Structural roll-ups.

Counts are taken before joins wherever a join only adds a label, and lists are collected only after a top-k or a
per-parent limit has bounded them, or where a group is one file or one repository's few languages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import constants as K
from loomgraph.functions import derive as D
from loomgraph.operators.edges import union_all

def row_count() -> Column:
    return F.count(F.lit(1))


def service_functions(functions: DataFrame, words: list[str], k: int = 20) -> DataFrame:
    """Files with the most functions named after a service, and those names."""
    hits = functions.filter(D.contains_any(F.col("name"), words)).select("repo_url", "file_path", "name")
    top = (
        hits.groupBy("repo_url", "file_path").agg(row_count().alias("function_count"))
        .orderBy(F.desc("function_count"), "file_path", "repo_url").limit(k)
    )
    # Names are collected for the k chosen files only.
    return (
        hits.join(top, ["repo_url", "file_path"])
        .groupBy("repo_url", F.col("file_path").alias("service_file"), "function_count")
        .agg(F.sort_array(F.collect_list("name")).alias("functions"))
    )


def language_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("repo_url", "language").agg(row_count().alias("n"))


def language_breakdown(files: DataFrame) -> DataFrame:
    """Per repository: languages with counts, most frequent first, and the total."""
    item = F.struct((-F.col("n")).alias("o"), "language", "n")
    return (
        language_counts(files).groupBy("repo_url")
        .agg(F.sort_array(F.collect_list(item)).alias("items"), F.sum("n").alias("total_files"))
        .select(F.col("repo_url").alias("repository"),
                F.transform("items", lambda x: F.struct(x["language"].alias("language"), x["n"].alias("count")))
                .alias("language_breakdown"), "total_files")
    )


def language_share(files: DataFrame, k: int = 10) -> DataFrame:
    """Per repository the k most frequent languages with their percentage of files."""
    by_repo = Window.partitionBy("repo_url")
    ranked = by_repo.orderBy(F.desc("n"), "language")
    return (
        language_counts(files)
        .withColumn("total", F.sum("n").over(by_repo)).withColumn("rn", F.row_number().over(ranked))
        .filter(F.col("rn") <= k)
        .select("repo_url", "language", F.col("n").alias("file_count"),
                F.round(F.col("n") / F.col("total") * 100, 4).alias("pct"))
    )


def busy_files(functions: DataFrame, more_than: int = 3, k: int = 20) -> DataFrame:
    return (
        functions.groupBy("repo_url", "file_path").agg(row_count().alias("function_count"))
        .filter(F.col("function_count") > more_than)
        .orderBy(F.desc("function_count"), "file_path", "repo_url").limit(k)
    )


def node_counts(tables: dict[str, DataFrame], by: list[str] | None = None) -> DataFrame:
    """Rows per node label, over all or per column (every table must have it)."""
    parts = [t.groupBy(*(by or [])).agg(row_count().alias("n")).withColumn("type", F.lit(label)) for label, t in tables.items()]
    return union_all(parts)


def relationship_counts(edges: DataFrame, repo_url: str | None = None, undirected: bool = False) -> DataFrame:
    """Edges per type; ``undirected`` counts every edge from both of its ends."""
    scoped = edges if repo_url is None else edges.filter(F.col("repo_url") == repo_url)
    return scoped.groupBy("rel").agg((row_count() * (2 if undirected else 1)).alias("n"))


def files_by(files: DataFrame, column: str) -> DataFrame:
    """Files per value of a column, with the grand total as a row of its own (value '(total)')."""
    counted = files.groupBy(column).agg(row_count().alias("n"))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("(total)").alias(column), "n")
    return counted.unionByName(total)


def chunks_per_file(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("repo_url", F.col("file_path").alias("path")).agg(row_count().alias("n"))


def chunks_by_file_type(chunks: DataFrame, files: DataFrame) -> DataFrame:
    return (
        chunks_per_file(chunks).join(files.select("repo_url", "path", "file_type"), ["repo_url", "path"])
        .groupBy("file_type").agg(F.sum("n").alias("n"))
    )


def doc_chunk_counts(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Chunks per documentation file (0 when none) and their total."""
    docs = files.filter("is_documentation").select("repo_url", "path")
    counted = docs.join(chunks_per_file(chunks), ["repo_url", "path"], "left").select(
        "repo_url", "path", F.coalesce("n", F.lit(0)).alias("n"))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return counted.unionByName(total.select(F.lit("").alias("repo_url"), F.lit("(total)").alias("path"), "n"))


def repo_structure(files: DataFrame) -> DataFrame:
    """File count and languages per repository."""
    return language_counts(files).groupBy("repo_url").agg(
        F.sum("n").alias("file_count"), F.sort_array(F.collect_list("language")).alias("languages"))


def top_dirs(files: DataFrame, k: int = 10, part: int = 0) -> DataFrame:
    """Directories by number of files, nested paths only."""
    return (
        files.filter(F.col("path").contains("/")).groupBy(D.path_part(F.col("path"), part).alias("top_dir"))
        .agg(row_count().alias("file_count")).orderBy(F.desc("file_count"), "top_dir").limit(k)
    )


def imports_by_language(import_edges: DataFrame) -> DataFrame:
    """Importing files and import edges per language family."""
    per_file = import_edges.groupBy("repo_url", "source_path").agg(row_count().alias("n"))
    return per_file.groupBy(D.import_family(F.col("source_path")).alias("language")).agg(
        row_count().alias("files"), F.sum("n").alias("imports"))


def chunks_by_parent_type(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("parent_type").agg(row_count().alias("n"))


def accumulate_weights(hits: DataFrame, stored: DataFrame) -> DataFrame:
    """Add new hits (src, dst, at) to stored weights (src, dst, n, first_detected, last_updated)."""
    fresh = hits.groupBy("src", "dst").agg(
        row_count().alias("fresh_n"), F.min("at").alias("fresh_first"), F.max("at").alias("fresh_last"))
    return stored.join(fresh, ["src", "dst"], "full_outer").select(
        "src", "dst", (F.coalesce("n", F.lit(0)) + F.coalesce("fresh_n", F.lit(0))).alias("n"),
        F.coalesce("first_detected", "fresh_first").alias("first_detected"),
        F.coalesce("fresh_last", "last_updated").alias("last_updated"))


def primary_language(files: DataFrame, service: list[str]) -> DataFrame:
    """Language with the most code files per service; on a tie the first by name."""
    table = F.create_map(*[F.lit(x) for pair in K.SERVICE_CODE_EXTENSIONS.items() for x in pair])
    counted = (
        files.withColumn("language", table[D.extension(F.col("path"))]).filter("language IS NOT NULL")
        .groupBy(*service, "language").agg(row_count().alias("n"))
    )
    return counted.groupBy(*service).agg(
        F.min_by("language", F.struct((-F.col("n")).alias("o"), "language")).alias("language"))


def discover_services(files: DataFrame) -> DataFrame:
    """Child directories of ``src/`` (of the root where a repository has none) that hold a code file."""
    path = F.col("path")
    code = D.any_of([path.endswith(e) for e in K.SERVICE_CODE_EXTENSIONS])
    flagged = files.select(
        "repo_url", D.path_part(path, 0).alias("p0"), D.path_part(path, 1).alias("p1"), D.depth(path).alias("d"),
        path.startswith("src/").alias("in_src"), code.alias("code"))
    dirs = (
        flagged.groupBy("repo_url", "in_src", F.when(F.col("in_src"), F.when(F.col("d") >= 2, F.col("p1")))
                        .otherwise(F.when(F.col("d") >= 1, F.col("p0"))).alias("service"))
        .agg(F.bool_or("code").alias("code"))
    )
    has_src = dirs.groupBy("repo_url").agg(F.bool_or("in_src").alias("has_src"))
    return (
        dirs.join(has_src, "repo_url")
        .filter("code AND service IS NOT NULL AND in_src = has_src").select("repo_url", "service")
    )


def merge_service_relationships(records: DataFrame, kinds: list[str]) -> DataFrame:
    """Per service and kind the items of all its per-file arrays, one row per distinct item with its count."""
    return union_all([
        records.select("service_name", F.lit(kind).alias("kind"), F.explode(kind).alias("item"))
        .groupBy("service_name", "kind", "item").agg(row_count().alias("n"))
        for kind in kinds
    ])


def listing_with_count(rows: DataFrame, columns: list[str], repo_url: str | None = None) -> DataFrame:
    """Distinct rows of a repository with how often each occurs."""
    scoped = rows if repo_url is None else rows.filter(F.col("repo_url") == repo_url)
    return scoped.groupBy(*columns).agg(row_count().alias("n"))


def inheritance_listing(inherits: DataFrame, implements: DataFrame) -> DataFrame:
    """Name pairs of both relations with their number of edges."""
    return union_all([
        t.groupBy(F.lit(rel).alias("rel"), "source_name", "target_name").agg(F.sum("n_edges").alias("n"))
        for rel, t in (("INHERITS_FROM", inherits), ("IMPLEMENTS", implements))
    ])


def import_listing(import_edges: DataFrame, k: int = 20) -> DataFrame:
    cols = ["repo_url", "source_path", "target_path", "import_name", "line"]
    return import_edges.select(*cols).orderBy(*cols).limit(k)


def files_per_service_dir(files: DataFrame) -> DataFrame:
    """Files per fourth path part, and per second-to-last part below ``src/``."""
    path = F.col("path")
    fourth = files.groupBy(D.path_part(path, 3).alias("part")).agg(row_count().alias("n")).filter("part IS NOT NULL")
    below = files.filter(path.contains("src/")).groupBy(D.path_part(path, -2).alias("part")).agg(row_count().alias("n"))
    return fourth.select(F.lit("fourth").alias("kind"), "part", "n").unionByName(
        below.filter("part IS NOT NULL").select(F.lit("service").alias("kind"), "part", "n"))


def repo_node_total(tables: dict[str, DataFrame], repositories: DataFrame, pattern: str) -> DataFrame:
    """All nodes of repositories whose url holds the pattern, with the stored commit."""
    per_repo = node_counts(tables, ["repo_url"]).groupBy("repo_url").agg(F.sum("n").alias("nodes"))
    chosen = repositories.filter(F.col("url").contains(pattern)).select(
        F.col("url").alias("repo_url"), "last_indexed_commit_sha")
    return chosen.join(per_repo, "repo_url", "left").select(
        "repo_url", F.coalesce("nodes", F.lit(0)).alias("nodes"), "last_indexed_commit_sha")


def graph_totals(files: DataFrame, functions: DataFrame, classes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Distinct files, functions, classes and chunks per repository, one row each."""
    keys = {"file_count": (files, "path"), "function_count": (functions, "unique_id"),
            "class_count": (classes, "unique_id"), "chunk_count": (chunks, "chunk_id")}
    long = union_all([t.select("repo_url", key).distinct().groupBy("repo_url").agg(row_count().alias("n"))
                      .withColumn("metric", F.lit(name)) for name, (t, key) in keys.items()])
    return long.groupBy("repo_url").agg(*[
        F.coalesce(F.max(F.when(F.col("metric") == name, F.col("n"))), F.lit(0)).alias(name) for name in keys])


def ingestion_summary(tables: dict[str, DataFrame], edges: DataFrame, embedded_chunks: DataFrame) -> DataFrame:
    """One row per metric: nodes per label, chunks with a vector, edges per type, all edges."""
    nodes = node_counts(tables).select(F.concat(F.lit("nodes:"), "type").alias("metric"), F.col("n").alias("value"))
    vectors = embedded_chunks.filter("embedding IS NOT NULL").agg(row_count().alias("value")).select(
        F.lit("chunks_with_embedding").alias("metric"), "value")
    per_rel = relationship_counts(edges)
    rels = per_rel.select(F.concat(F.lit("edges:"), "rel").alias("metric"), F.col("n").alias("value"))
    return union_all([nodes, vectors, rels])


def message_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("chat_id").agg(row_count().alias("messages"))


def group_text_by_path(rows: DataFrame) -> DataFrame:
    """Texts of (repo_url, path, start_line, text) joined per file, with the section a path belongs to.

    A group is one file of one repository, so a joined text is about as long as the file it came from.
    """
    path = F.col("path")
    bucket = (
        F.when(path == "directory_structure", 1).when(path.contains("README"), 2)
        .when(path.contains("/docs/") | path.endswith(".md"), 3).otherwise(4)
    )
    items = F.array_sort(F.collect_list(F.struct("start_line", "text")))
    return rows.groupBy("repo_url", "path").agg(
        F.array_join(F.transform(items, lambda x: x["text"]), "\n").alias("text")).withColumn("bucket", bucket)


def top_functions_per_file(functions: DataFrame, k: int = 5) -> DataFrame:
    """First k function names per file."""
    w = Window.partitionBy("repo_url", "file_path").orderBy("name", "unique_id")
    return (
        functions.select("repo_url", "file_path", "name", "unique_id").withColumn("rn", F.row_number().over(w))
        .filter(F.col("rn") <= k).groupBy("repo_url", "file_path")
        .agg(F.sort_array(F.collect_list("name")).alias("functions"))
    )


def combined_topic_text(top_rows: DataFrame) -> DataFrame:
    """Texts of a topic's top rows as one text, best first. The input is a top-k result."""
    items = F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("o"), "path", "start_line", "text")))
    return top_rows.groupBy("topic").agg(
        F.array_join(F.transform(items, lambda x: x["text"]), "\n\n").alias("text"))


def proto_word_counts(files: DataFrame, suffix: str, words: list[str]) -> DataFrame:
    """Files with the suffix and how often each word occurs in them."""
    counts = [F.regexp_count("content", F.lit(w)).cast("long").alias(w.strip()) for w in words]
    return files.filter(F.col("path").endswith(suffix)).select("repo_url", "path", *counts)


def suffix_counts(files: DataFrame, suffixes: list[str]) -> DataFrame:
    """Files per path suffix, 0 included. One pass: a column per suffix, then turned to rows."""
    sums = files.agg(*[F.count_if(F.col("path").endswith(s)).alias(f"c{i}") for i, s in enumerate(suffixes)])
    pairs = F.array(*[F.struct(F.lit(s).alias("suffix"), F.col(f"c{i}").alias("n")) for i, s in enumerate(suffixes)])
    return sums.select(F.inline(pairs))
