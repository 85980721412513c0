"""Edge repair: candidate edges that the store lacks. Each job returns the edges to add; running it twice adds none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import derive as D
from loomgraph.operators.containment import covering_pairs
from loomgraph.operators.edges import EDGE_KEY, edge, union_all

SYMBOLS = ["Function", "Class"]


def missing_edges(candidates: DataFrame, stored: DataFrame, rel: str, src: list[str], dst: list[str]) -> DataFrame:
    """Candidates the store lacks. Only stored edges of the same kind are read: ``rel`` is the partition column."""
    same_kind = stored.filter((F.col("rel") == rel) & F.col("src_label").isin(src) & F.col("dst_label").isin(dst))
    return candidates.select(*EDGE_KEY).distinct().join(same_kind.select(*EDGE_KEY), EDGE_KEY, "left_anti")


def add_edges(stored: DataFrame, *fixes: DataFrame) -> DataFrame:
    return union_all([stored.select(*EDGE_KEY), *[f.select(*EDGE_KEY) for f in fixes]]).dropDuplicates(EDGE_KEY)


def to_repository(rows: DataFrame, label, id_column: str, repositories: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of a label -> their repository (files, directories, chunks, symbols)."""
    known = rows.join(repositories.select(F.col("url").alias("repo_url")), "repo_url", "left_semi")
    return missing_edges(edge(known, label, id_column, "BELONGS_TO", "Repository", "repo_url"), stored,
                         "BELONGS_TO", [label] if isinstance(label, str) else SYMBOLS, ["Repository"])


def dir_to_file(directories: DataFrame, files: DataFrame, stored: DataFrame) -> DataFrame:
    parents = files.select("repo_url", "path", D.dirname(F.col("path")).alias("dir_path")).join(
        directories.select("repo_url", "dir_path"), ["repo_url", "dir_path"], "left_semi")
    return missing_edges(edge(parents, "Directory", "dir_path", "CONTAINS", "File", "path"), stored,
                         "CONTAINS", ["Directory"], ["File"])


def dir_to_dir(directories: DataFrame, stored: DataFrame) -> DataFrame:
    children = directories.select("repo_url", F.col("dir_path").alias("child"),
                                  D.dirname(F.col("dir_path")).alias("dir_path")).filter("dir_path <> ''").join(
        directories.select("repo_url", "dir_path"), ["repo_url", "dir_path"], "left_semi")
    return missing_edges(edge(children, "Directory", "dir_path", "CONTAINS", "Directory", "child"), stored,
                         "CONTAINS", ["Directory"], ["Directory"])


def backfill_symbol_path(symbols: DataFrame, chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Symbols with a missing file_path take the path of an attached chunk."""
    attached = stored.filter("dst_label = 'CodeChunk' AND rel = 'CONTAINS' AND src_label <> 'File'").select(
        "repo_url", F.col("src_id").alias("unique_id"), F.col("dst_id").alias("chunk_id"))
    paths = attached.join(chunks.select("repo_url", "chunk_id", F.col("file_path").alias("chunk_path")),
                          ["repo_url", "chunk_id"]).groupBy("repo_url", "unique_id").agg(
        F.min("chunk_path").alias("chunk_path"))
    return symbols.join(paths, ["repo_url", "unique_id"], "left").withColumn(
        "file_path", F.coalesce("file_path", "chunk_path")).drop("chunk_path")


def file_to_symbol(files: DataFrame, symbols: DataFrame, stored: DataFrame) -> DataFrame:
    known = symbols.join(files.select("repo_url", F.col("path").alias("file_path")), ["repo_url", "file_path"],
                         "left_semi")
    return missing_edges(edge(known, "File", "file_path", "CONTAINS", F.col("label"), "unique_id"), stored,
                         "CONTAINS", ["File"], SYMBOLS)


def file_to_chunk(files: DataFrame, chunks: DataFrame, stored: DataFrame) -> DataFrame:
    known = chunks.join(files.select("repo_url", F.col("path").alias("file_path")), ["repo_url", "file_path"],
                        "left_semi")
    return missing_edges(edge(known, "File", "file_path", "CONTAINS", "CodeChunk", "chunk_id"), stored,
                         "CONTAINS", ["File"], ["CodeChunk"])


def parents_naming_symbols(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(repo_url, parent_id, label, unique_id) where the parent id of a chunk contains the id of a symbol.

    A symbol id is ``path::rest``. A text contains it exactly when, at one of its ``::`` marks, the part before ends
    with the path and the text behind starts with the rest. Endings are listed once per distinct part (about one per
    file), beginnings once per distinct parent id, and both steps are equi joins.
    """
    marks = _marks(chunks)
    ids = symbols.select("repo_url", "label", "unique_id",
                         F.substring_index("unique_id", "::", 1).alias("sym_path"),
                         F.expr("substring(unique_id, instr(unique_id, '::') + 2)").alias("rest"))
    parts = marks.select("repo_url", "part").distinct().withColumn("sym_path", F.explode(F.expr(
        "transform(sequence(1, length(part)), k -> substring(part, k))")))
    path_of_part = parts.join(ids.select("repo_url", "sym_path").distinct(), ["repo_url", "sym_path"])
    begins = marks.join(path_of_part, ["repo_url", "part"]).withColumn("rest", F.explode(F.expr(
        "transform(sequence(1, length(behind)), k -> substring(behind, 1, k))")))
    return begins.join(ids, ["repo_url", "sym_path", "rest"]).select(
        "repo_url", "parent_id", "label", "unique_id").distinct()


def _marks(chunks: DataFrame) -> DataFrame:
    """One row per ``::`` of each distinct parent id: the part before it and everything behind it."""
    split = F.split("parent_id", "::")
    return (
        chunks.select("repo_url", "parent_id").distinct().filter(F.col("parent_id").contains("::"))
        .select("repo_url", "parent_id", split.alias("s"))
        .select("repo_url", "parent_id", "s", F.explode(F.sequence(F.lit(1), F.size("s") - 1)).alias("k"))
        .select("repo_url", "parent_id", F.element_at("s", F.col("k")).alias("part"),
                F.array_join(F.slice("s", F.col("k") + 1, F.size("s")), "::").alias("behind"))
        .filter("part <> '' AND behind <> ''")
    )


def file_to_symbol_via_chunk(symbols: DataFrame, chunks: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """File -> symbol for symbols without a path, by a chunk whose parent id names the symbol; also the found paths."""
    lost = symbols.filter("file_path IS NULL")
    named = parents_naming_symbols(chunks, lost)
    found = named.join(chunks.select("repo_url", "parent_id", "file_path").distinct(), ["repo_url", "parent_id"])
    new_edges = missing_edges(edge(found, "File", "file_path", "CONTAINS", F.col("label"), "unique_id"), stored,
                         "CONTAINS", ["File"], SYMBOLS)
    paths = found.groupBy("repo_url", "label", "unique_id").agg(F.min("file_path").alias("file_path"))
    return new_edges, paths


def symbol_to_chunk_by_id(symbols: DataFrame, chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Symbol -> chunk where the chunk's parent id contains the symbol's id (longer names match too)."""
    named = parents_naming_symbols(chunks, symbols)
    hit = named.join(chunks.select("repo_url", "parent_id", "chunk_id"), ["repo_url", "parent_id"])
    return missing_edges(edge(hit, F.col("label"), "unique_id", "CONTAINS", "CodeChunk", "chunk_id"), stored,
                         "CONTAINS", SYMBOLS, ["CodeChunk"])


def ambiguous_chunks(symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks whose parent id contains the ids of more than one symbol, with how many."""
    per_parent = parents_naming_symbols(chunks, symbols).groupBy("repo_url", "parent_id").agg(
        F.count("*").alias("n_symbols")).filter("n_symbols > 1")
    return chunks.select("repo_url", "parent_id", "chunk_id").join(per_parent, ["repo_url", "parent_id"]).select(
        "repo_url", "chunk_id", "n_symbols")


def symbol_to_chunk_by_range(symbols: DataFrame, chunks: DataFrame, stored: DataFrame, label: str) -> DataFrame:
    """Symbols of one kind -> chunks inside their span that no symbol of the other kind holds."""
    other = "Function" if label == "Class" else "Class"
    taken = stored.filter((F.col("dst_label") == "CodeChunk") & (F.col("rel") == "CONTAINS")
                          & (F.col("src_label") == other)).select("repo_url", F.col("dst_id").alias("chunk_id"))
    free = chunks.select("repo_url", "file_path", "chunk_id", "start_line", "end_line").join(
        taken, ["repo_url", "chunk_id"], "left_anti")
    outer = symbols.filter(F.col("label") == label).select("repo_url", "file_path", "unique_id", "start_line", "end_line")
    pairs = covering_pairs(free, outer)
    return missing_edges(edge(pairs, label, "o_unique_id", "CONTAINS", "CodeChunk", "chunk_id"), stored,
                         "CONTAINS", [label], ["CodeChunk"])


def canonicalise_repo_url(tables: dict[str, DataFrame], pattern: str, target: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every repo url that holds the pattern is rewritten to the target; counts of changed rows per label and old url."""
    old = F.col("repo_url").contains(pattern) & (F.col("repo_url") != target)
    fixed = {k: t.withColumn("repo_url", F.when(old, target).otherwise(F.col("repo_url"))) for k, t in tables.items()}
    counts = union_all([t.filter(old).groupBy("repo_url").agg(F.count("*").alias("n")).withColumn("type", F.lit(k))
                        for k, t in tables.items()])
    return fixed, counts


def mark_documentation(files: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documentation flag set by path, and the README files without any chunk."""
    path = F.col("path")
    flag = D.is_documentation(path, F.substring_index(path, ".", -1))
    marked = files.withColumn("is_documentation", F.coalesce("is_documentation", F.lit(False)) | flag)
    chunked = stored.filter("src_label = 'File' AND dst_label = 'CodeChunk'").select(
        "repo_url", F.col("src_id").alias("path")).distinct()
    readmes = files.filter(F.upper(path).contains("README")).select("repo_url", "path")
    return marked, readmes.join(chunked, ["repo_url", "path"], "left_anti")


def fixed_counts(fixes: dict[str, DataFrame]) -> DataFrame:
    """Edges each job adds, 0 included."""
    return union_all([f.agg(F.count("*").alias("fixed_count")).withColumn("job", F.lit(name))
                      for name, f in fixes.items()])
