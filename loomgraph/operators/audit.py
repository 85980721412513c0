"""Coverage and key audits. One pass over the containment edges gives every chunk its kinds of parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import derive as D
from loomgraph.operators.containment import methods_of_class
from loomgraph.operators.edges import union_all

PARENTS = ["File", "Function", "Class", "Repository"]


def chunk_parents(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """Per chunk a flag for each kind of parent."""
    held = (
        edges.filter("rel = 'CONTAINS' AND dst_label = 'CodeChunk'")
        .groupBy("repo_url", F.col("dst_id").alias("chunk_id"))
        .agg(*[F.bool_or(F.col("src_label") == p).alias(f"in_{p.lower()}") for p in PARENTS])
    )
    flags = [F.coalesce(f"in_{p.lower()}", F.lit(False)).alias(f"in_{p.lower()}") for p in PARENTS]
    return chunks.select("repo_url", "chunk_id", "file_path").join(held, ["repo_url", "chunk_id"], "left").select(
        "repo_url", "chunk_id", "file_path", *flags)


def orphan_chunks(parents: DataFrame) -> DataFrame:
    return parents.filter("NOT in_file AND NOT in_function AND NOT in_class")


def direct_file_chunks(parents: DataFrame) -> DataFrame:
    return parents.filter("in_file AND NOT in_function AND NOT in_class")


def _pct(part: Column, total: Column) -> Column:
    return F.round(F.when(total > 0, part / total * 100).otherwise(0.0), 4)


def ontology_report(repositories: DataFrame, functions: DataFrame, classes: DataFrame, chunks: DataFrame,
                    edges: DataFrame) -> DataFrame:
    """One row per repository: 7 connection counts, node counts and 6 coverage percentages."""
    n_of = lambda t, name: t.groupBy("repo_url").agg(F.count("*").alias(name))
    files = n_of(edges.filter("src_label = 'File' AND rel = 'BELONGS_TO' AND dst_label = 'Repository'"),
                 "repository_file_count")
    held = (
        edges.filter("src_label = 'File' AND rel = 'CONTAINS' AND dst_label IN ('Function', 'Class')")
        .select("repo_url", "dst_label", "dst_id").distinct().groupBy("repo_url")
        .agg(F.count_if(F.col("dst_label") == "Function").alias("file_function_count"),
             F.count_if(F.col("dst_label") == "Class").alias("file_class_count"))
    )
    per_chunk = chunk_parents(chunks, edges).groupBy("repo_url").agg(
        F.count_if("in_function").alias("function_chunk_count"), F.count_if("in_class").alias("class_chunk_count"),
        F.count_if(F.col("in_file") & ~F.col("in_function") & ~F.col("in_class")).alias("file_direct_chunk_count"),
        F.count_if(~F.col("in_file") & ~F.col("in_function") & ~F.col("in_class")).alias("orphaned_chunk_count"),
        F.count("*").alias("chunks"))
    out = repositories.select(F.col("url").alias("repo_url"))
    for t in (files, held, per_chunk, n_of(functions, "functions"), n_of(classes, "classes")):
        out = out.join(t, "repo_url", "left")
    counts = [c for c in out.columns if c != "repo_url"]
    out = out.select("repo_url", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
    c = F.col
    return out.select(
        "repo_url", *counts,
        _pct(c("file_function_count"), c("functions")).alias("function_file_pct"),
        _pct(c("file_class_count"), c("classes")).alias("class_file_pct"),
        _pct(c("function_chunk_count"), c("chunks")).alias("function_chunk_pct"),
        _pct(c("class_chunk_count"), c("chunks")).alias("class_chunk_pct"),
        _pct(c("file_direct_chunk_count"), c("chunks")).alias("direct_file_chunk_pct"),
        _pct(c("orphaned_chunk_count"), c("chunks")).alias("orphaned_chunk_pct"))


def ontology_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.withColumn("stage", F.lit("before")).unionByName(after.withColumn("stage", F.lit("after")))


def fallback_report(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """Per repository and scope (all chunks, protobuf chunks): attached counts and the repository-only share."""
    parents = chunk_parents(chunks, edges)
    scoped = parents.withColumn("scope", F.explode(F.when(
        F.col("file_path").endswith(".proto"), F.array(F.lit("all"), F.lit("proto"))).otherwise(F.array(F.lit("all")))))
    only_repo = F.col("in_repository") & ~F.col("in_file") & ~F.col("in_function") & ~F.col("in_class")
    return scoped.groupBy("repo_url", "scope").agg(
        F.count("*").alias("total"), F.count_if("in_file").alias("file_connected"),
        F.count_if("in_function").alias("function_connected"), F.count_if("in_class").alias("class_connected"),
        F.count_if("in_repository").alias("repo_connected"), F.count_if(only_repo).alias("fallback_count")
    ).withColumn("fallback_pct", _pct(F.col("fallback_count"), F.col("total")))


def readme_presence(files: DataFrame, edges: DataFrame) -> DataFrame:
    """README files per repository, with and without chunks."""
    chunked = edges.filter("src_label = 'File' AND dst_label = 'CodeChunk'").select(
        "repo_url", F.col("src_id").alias("path")).distinct().withColumn("has", F.lit(True))
    readmes = files.filter(F.upper("path").contains("README")).select("repo_url", "path")
    return readmes.join(chunked, ["repo_url", "path"], "left").groupBy("repo_url").agg(
        F.count("*").alias("readmes"), F.count("has").alias("with_chunks"),
        (F.count("*") - F.count("has")).alias("without_chunks"))


def property_profile(rows: DataFrame) -> DataFrame:
    """Filled values per column."""
    counted = rows.agg(F.count("*").alias("__all"), *[F.count(c).alias(c) for c in rows.columns])
    items = F.array(*[F.struct(F.lit(c).alias("property"), F.col(c).alias("filled"), F.col("__all").alias("total"))
                      for c in rows.columns])
    return counted.select(F.inline(items))


def doc_flag_profile(files: DataFrame) -> DataFrame:
    return files.groupBy("is_documentation", D.extension(F.col("path")).alias("extension")).agg(F.count("*").alias("n"))


def ingestion_assertions(node_counts: DataFrame, rel_counts: DataFrame, n_vectors: DataFrame) -> DataFrame:
    """Existence checks as pass / fail rows."""
    n = lambda label: F.coalesce(F.sum(F.when((F.col("kind") == "node") & (F.col("name") == label), F.col("n"))), F.lit(0))
    rel = lambda name: F.coalesce(F.sum(F.when((F.col("kind") == "rel") & (F.col("name") == name), F.col("n"))), F.lit(0))
    facts = union_all([
        node_counts.select(F.lit("node").alias("kind"), F.col("type").alias("name"), "n"),
        rel_counts.select(F.lit("rel").alias("kind"), F.col("rel").alias("name"), "n"),
        n_vectors.select(F.lit("rel").alias("kind"), F.lit("embedding").alias("name"), "n"),
    ])
    rules = [("repositories", n("Repository")), ("services", n("Service")), ("files", n("File")),
             ("chunks", n("CodeChunk")), ("embeddings", rel("embedding")), ("contains", rel("CONTAINS")),
             ("imports", rel("IMPORTS"))]
    wide = facts.agg(*[v.alias(k) for k, v in rules])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("rule"), F.col(k).alias("observed"), (F.col(k) > 0).alias("passed")) for k, _ in rules])))


def limit_per_parent(rows: DataFrame, parent: list[str], order: list[str], k: int) -> DataFrame:
    """First k rows of every parent. Spark keeps only k rows per parent and task before the shuffle."""
    w = Window.partitionBy(*parent).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)


def hierarchy_sample(files: DataFrame, symbols: DataFrame, chunks: DataFrame, edges: DataFrame, k: int = 5,
                     per_symbol: int = 2) -> DataFrame:
    """Per repository k files; per file k functions and k classes; per symbol and per file two chunks."""
    level_1 = limit_per_parent(files.select("repo_url", F.col("path").alias("id")), ["repo_url"], ["id"], k)
    chosen = level_1.select("repo_url", F.col("id").alias("file_path"))
    level_2 = limit_per_parent(
        symbols.select("repo_url", "file_path", "label", F.col("unique_id").alias("id"), "start_line")
        .join(chosen, ["repo_url", "file_path"], "left_semi"),
        ["repo_url", "file_path", "label"], ["start_line", "id"], k)
    # Only the chosen files' chunks and edges go on.
    own_chunks = chunks.select("repo_url", "file_path", "chunk_id", "start_line").join(
        chosen, ["repo_url", "file_path"], "left_semi")
    own_edges = edges.filter("rel = 'CONTAINS' AND dst_label = 'CodeChunk'").join(
        own_chunks.select("repo_url", F.col("chunk_id").alias("dst_id")), ["repo_url", "dst_id"], "left_semi")
    held = own_edges.select("repo_url", "src_label", F.col("src_id").alias("parent"), F.col("dst_id").alias("chunk_id"))
    lines = own_chunks.select("repo_url", "chunk_id", "start_line")
    of_symbols = held.filter("src_label <> 'File'").join(
        level_2.select("repo_url", F.col("id").alias("parent")), ["repo_url", "parent"], "left_semi")
    direct = direct_file_chunks(chunk_parents(own_chunks, own_edges)).select(
        "repo_url", F.lit("File").alias("src_label"), F.col("file_path").alias("parent"), "chunk_id")
    level_3 = limit_per_parent(of_symbols.unionByName(direct).join(lines, ["repo_url", "chunk_id"]),
                               ["repo_url", "src_label", "parent"], ["start_line", "chunk_id"], per_symbol)
    row = lambda t, level, parent, name: t.select(
        "repo_url", F.lit(level).alias("level"), F.col(parent).alias("parent"), F.col(name).alias("name"), "rn")
    return union_all([row(level_1, "file", "repo_url", "id"), row(level_2, "symbol", "file_path", "id"),
                      row(level_3, "chunk", "parent", "chunk_id")])


def file_hierarchy(classes: DataFrame, functions: DataFrame, chunks: DataFrame, edges: DataFrame,
                   path_suffix: str, k: int = 3) -> DataFrame:
    """Classes of matching files by line, their methods, and the first chunks of each class."""
    own = classes.filter(F.col("file_path").endswith(path_suffix))
    fns = functions.filter(F.col("file_path").endswith(path_suffix))
    methods = methods_of_class(own, fns)
    held = edges.filter("src_label = 'Class' AND dst_label = 'CodeChunk'").select(
        "repo_url", F.col("src_id").alias("unique_id"), F.col("dst_id").alias("chunk_id"))
    firsts = limit_per_parent(
        held.join(own.select("repo_url", "unique_id"), ["repo_url", "unique_id"], "left_semi")
        .join(chunks.select("repo_url", "chunk_id", "start_line"), ["repo_url", "chunk_id"]),
        ["repo_url", "unique_id"], ["start_line", "chunk_id"], k)
    return union_all([
        own.select("repo_url", F.lit("class").alias("level"), F.col("file_path").alias("parent"),
                   F.col("unique_id").alias("name"), "start_line"),
        methods.select("repo_url", F.lit("method").alias("level"), F.col("class_id").alias("parent"),
                       F.col("function_id").alias("name"), "start_line"),
        firsts.select("repo_url", F.lit("chunk").alias("level"), F.col("unique_id").alias("parent"),
                      F.col("chunk_id").alias("name"), "start_line"),
    ])


def service_edges(pairs: dict[str, DataFrame], k: int = 10) -> DataFrame:
    """Service -> service relations, first k."""
    rows = union_all([t.select("src", "dst", F.lit(rel).alias("rel")) for rel, t in pairs.items()])
    return rows.distinct().orderBy("src", "dst", "rel").limit(k)


def key_uniqueness(keys: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Duplicate keys and null keys per table. A key is shown as a JSON list of its parts, so no separator can blur it."""
    parts = []
    for name, (rows, cols) in keys.items():
        null = D.any_of([F.col(c).isNull() for c in cols])
        text = F.to_json(F.array(*[F.col(c).cast("string") for c in cols]))
        found = rows.groupBy(*cols).agg(F.count("*").alias("n")).withColumn("has_null", null).filter("n > 1 OR has_null")
        parts.append(found.select(text.alias("key"), "has_null", "n", F.lit(name).alias("table")))
    return union_all(parts)
