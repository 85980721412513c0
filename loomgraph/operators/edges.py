"""Edge building by keys. An edge row is (repo_url, src_label, src_id, rel, dst_label, dst_id).

No join carries a broadcast hint: Spark broadcasts a side when its measured size is under the session's threshold and
shuffles otherwise, and adaptive execution splits a hot repository on the large side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import derive as D

EDGE_COLUMNS = ["repo_url", "src_label", "src_id", "rel", "dst_label", "dst_id"]
EDGE_KEY = EDGE_COLUMNS


def edge(rows: DataFrame, src_label, src, rel: str, dst_label, dst) -> DataFrame:
    """Project rows to edges; labels may be literals or Columns, ids column names or Columns."""
    as_lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    as_col = lambda x: x if isinstance(x, Column) else F.col(x)
    return rows.select(
        "repo_url", as_lit(src_label).alias("src_label"), as_col(src).cast("string").alias("src_id"),
        F.lit(rel).alias("rel"), as_lit(dst_label).alias("dst_label"), as_col(dst).cast("string").alias("dst_id"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def file_belongs_to(files: DataFrame, repositories: DataFrame, services: DataFrame) -> DataFrame:
    """File -> Repository by url, and File -> Service by name."""
    repo_ids = repositories.select(F.col("url").alias("repo_url"))
    service_ids = services.select(F.col("name").alias("service_name"), "repo_url")
    slim = files.select("repo_url", "service_name", "path")
    return union_all([
        edge(slim.join(repo_ids, "repo_url"), "File", "path", "BELONGS_TO", "Repository", "repo_url"),
        edge(slim.join(service_ids, ["repo_url", "service_name"]), "File", "path", "BELONGS_TO", "Service",
             "service_name"),
    ])


def service_belongs_to(services: DataFrame, repositories: DataFrame) -> DataFrame:
    hit = services.join(repositories.select(F.col("url").alias("repo_url")), "repo_url")
    return edge(hit, "Service", "name", "BELONGS_TO", "Repository", "repo_url")


def file_contains_symbol(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """File -> Function / Class by repository and path."""
    keys = files.select("repo_url", F.col("path").alias("file_path"))
    hit = symbols.select("repo_url", "file_path", "label", "unique_id").join(keys, ["repo_url", "file_path"])
    return edge(hit, "File", "file_path", "CONTAINS", F.col("label"), "unique_id")


def proto_multi_path(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols of a .proto file and all files of the repository that carry the same file name.

    The rows are memberships of a group keyed by (repo_url, file name): kind ``symbol`` or ``file``. Every symbol of a
    group is contained in every file of it. Memberships grow with the data even when one name has very many copies,
    which the pair list would not. ``expand_proto_paths`` gives the pairs of chosen symbols.
    """
    wanted = (
        symbols.filter(F.col("file_path").endswith(".proto"))
        .select("repo_url", D.basename(F.col("file_path")).alias("file_name"), "unique_id")
    )
    names = wanted.select("repo_url", "file_name").distinct()
    # A path that ends with the name ends with it inside its own last part, so the suffixes of that part are the keys.
    suffixes = (
        files.filter(F.col("path").endswith(".proto"))
        .select("repo_url", "path", F.explode(F.expr(
            "transform(sequence(1, length(substring_index(path, '/', -1))), "
            "k -> substring(substring_index(path, '/', -1), k))")).alias("file_name"))
    )
    in_group = suffixes.join(names, ["repo_url", "file_name"], "left_semi")
    return union_all([
        wanted.select("repo_url", "file_name", F.lit("symbol").alias("kind"), F.col("unique_id").alias("member")),
        in_group.select("repo_url", "file_name", F.lit("file").alias("kind"), F.col("path").alias("member")),
    ])


def expand_proto_paths(groups: DataFrame, chosen: DataFrame) -> DataFrame:
    """File paths of chosen symbols (repo_url, unique_id) out of the memberships."""
    members = (
        groups.filter("kind = 'symbol'").withColumnRenamed("member", "unique_id")
        .join(chosen.select("repo_url", "unique_id"), ["repo_url", "unique_id"], "left_semi"))
    paths = groups.filter("kind = 'file'").select("repo_url", "file_name", F.col("member").alias("path"))
    return members.join(paths, ["repo_url", "file_name"]).select("repo_url", "unique_id", "path")


def chunk_parent_by_id(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Function / Class -> CodeChunk where the chunk's parent_id is the symbol's id."""
    keys = symbols.select("repo_url", "label", F.col("unique_id").alias("parent_id"))
    hit = chunks.select("repo_url", "chunk_id", "parent_id").join(keys, ["repo_url", "parent_id"])
    return edge(hit, F.col("label"), "parent_id", "CONTAINS", "CodeChunk", "chunk_id")


def ensure_file(files: DataFrame, references: DataFrame) -> DataFrame:
    """Rows for referenced (repo_url, service_name, path) that no file has yet."""
    path = F.col("path")
    language = D.detect_language(path)
    return (
        references.filter("path <> ''")
        .withColumn("path", D.normalize_path(path, F.col("repo_url")))
        .select("repo_url", "service_name", "path").distinct()
        .join(files.select("repo_url", "path"), ["repo_url", "path"], "left_anti")
        .select("repo_url", "service_name", "path", D.basename(path).alias("name"), language.alias("language"),
                language.alias("file_type"), D.is_documentation(path, language).alias("is_documentation"))
    )


def chunk_belongs_to(chunks: DataFrame, repositories: DataFrame, services: DataFrame) -> DataFrame:
    repo_ids = repositories.select(F.col("url").alias("repo_url"))
    service_ids = services.select(F.col("name").alias("service_name"), "repo_url")
    slim = chunks.select("repo_url", "service_name", "chunk_id")
    return union_all([
        edge(slim.join(repo_ids, "repo_url"), "CodeChunk", "chunk_id", "BELONGS_TO", "Repository", "repo_url"),
        edge(slim.join(service_ids, ["repo_url", "service_name"]), "CodeChunk", "chunk_id", "BELONGS_TO", "Service",
             "service_name"),
    ])


def named_class_edges(classes: DataFrame, array_column: str) -> DataFrame:
    """Class -> Class edges through a name list (superclasses or interfaces), kept at name level.

    One row stands for ``n_source * n_target`` edges: every class named ``source_name`` points to every class named
    ``target_name`` in its repository. Both sides are counted before the join, so a name that very many classes share
    costs one row. ``expand_named_edges`` lists the class pairs of chosen classes.
    """
    sources = (
        classes.select("repo_url", F.col("name").alias("source_name"), F.explode(array_column).alias("target_name"))
        .groupBy("repo_url", "source_name", "target_name").agg(F.count("*").alias("n_source"))
    )
    targets = (
        classes.groupBy("repo_url", F.col("name").alias("target_name")).agg(F.count("*").alias("n_target"))
    )
    return sources.join(targets, ["repo_url", "target_name"]).select(
        "repo_url", "source_name", "target_name", "n_source", "n_target",
        (F.col("n_source") * F.col("n_target")).alias("n_edges"))


def expand_named_edges(classes: DataFrame, array_column: str, chosen: DataFrame) -> DataFrame:
    """Class pairs for chosen source classes (repo_url, unique_id)."""
    sources = (
        classes.join(chosen.select("repo_url", "unique_id"), ["repo_url", "unique_id"], "left_semi")
        .select("repo_url", F.col("unique_id").alias("src_id"), F.explode(array_column).alias("name")))
    targets = classes.select("repo_url", "name", F.col("unique_id").alias("dst_id"))
    return sources.join(targets, ["repo_url", "name"]).select("repo_url", "src_id", "dst_id").distinct()


def function_call_edges(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Function -> Function by name pair, at name level as in ``named_class_edges``; with call count and first line."""
    names = functions.groupBy("repo_url", "name").agg(F.count("*").alias("n"))
    pairs = calls.groupBy("repo_url", "source_name", "target_name").agg(
        F.count("*").alias("n_calls"), F.min("line").alias("first_line"))
    sources = names.select("repo_url", F.col("name").alias("source_name"), F.col("n").alias("n_source"))
    targets = names.select("repo_url", F.col("name").alias("target_name"), F.col("n").alias("n_target"))
    return (
        pairs.join(sources, ["repo_url", "source_name"]).join(targets, ["repo_url", "target_name"])
        .select("repo_url", "source_name", "target_name", "n_calls", "first_line", "n_source", "n_target")
    )


def endpoint_edges(endpoints: DataFrame, services: DataFrame, repositories: DataFrame,
                   files: DataFrame | None = None) -> DataFrame:
    """Service EXPOSES endpoint, endpoint BELONGS_TO repository and, where a file path is known, File CONTAINS it."""
    service_ids = services.select(F.col("name").alias("service_name"), "repo_url")
    repo_ids = repositories.select(F.col("url").alias("repo_url"))
    out = [
        edge(endpoints.join(service_ids, ["repo_url", "service_name"]), "Service", "service_name", "EXPOSES",
             "ApiEndpoint", "endpoint_id"),
        edge(endpoints.join(repo_ids, "repo_url"), "ApiEndpoint", "endpoint_id", "BELONGS_TO", "Repository",
             "repo_url"),
    ]
    if files is not None:
        keys = files.select("repo_url", F.col("path").alias("file_path"))
        out.append(edge(endpoints.join(keys, ["repo_url", "file_path"]), "File", "file_path", "CONTAINS",
                        "ApiEndpoint", "endpoint_id"))
    return union_all(out)


def data_model_edges(models: DataFrame, services: DataFrame, repositories: DataFrame,
                     files: DataFrame | None = None) -> DataFrame:
    """Service USES_MODEL model, model BELONGS_TO repository and, where a file path is known, File CONTAINS it."""
    service_ids = services.select(F.col("name").alias("service_name"), "repo_url")
    repo_ids = repositories.select(F.col("url").alias("repo_url"))
    out = [
        edge(models.join(service_ids, ["repo_url", "service_name"]), "Service", "service_name", "USES_MODEL",
             "DataModel", "model_id"),
        edge(models.join(repo_ids, "repo_url"), "DataModel", "model_id", "BELONGS_TO", "Repository", "repo_url"),
    ]
    if files is not None:
        keys = files.select("repo_url", F.col("path").alias("file_path"))
        out.append(edge(models.join(keys, ["repo_url", "file_path"]), "File", "file_path", "CONTAINS", "DataModel",
                        "model_id"))
    return union_all(out)


def service_topology(records: DataFrame, services: DataFrame) -> DataFrame:
    """Typed edges out of nested service records.

    Record: service_name, repo_url, calls array<struct<target,type,protocol,is_async>>, apis, models, configs and
    interfaces array<string>. A call is kept when its target is a known service.
    """
    def exploded(column: str) -> DataFrame:
        return records.select("repo_url", "service_name", F.explode(column).alias("item"))

    known = services.select(F.col("name").alias("target")).distinct()
    calls = exploded("calls").select("repo_url", "service_name", "item.*").join(known, "target")
    typed = [
        calls.select("repo_url", F.lit("Service").alias("src_label"), F.col("service_name").alias("src_id"),
                     F.lit("CALLS").alias("rel"), F.lit("Service").alias("dst_label"),
                     F.col("target").alias("dst_id"),
                     F.concat_ws("/", "type", "protocol", F.col("is_async").cast("string")).alias("detail"))
    ]
    for column, rel, label in [("apis", "EXPOSES", "ApiEndpoint"), ("models", "USES_MODEL", "DataModel"),
                               ("configs", "REQUIRES_CONFIG", "Configuration"),
                               ("interfaces", "IMPLEMENTS", "ServiceInterface")]:
        typed.append(edge(exploded(column), "Service", "service_name", rel, label, "item")
                     .withColumn("detail", F.lit("")))
    return union_all(typed).distinct()


def directory_edges(directories: DataFrame, files: DataFrame, repositories: DataFrame) -> DataFrame:
    """Directory -> Directory, Directory -> File and Directory -> Repository."""
    dirs = directories.select("repo_url", F.col("dir_path").alias("parent"))
    children = directories.select("repo_url", "dir_path", D.dirname(F.col("dir_path")).alias("parent")) \
        .filter("parent <> ''")
    in_files = files.select("repo_url", "path", D.dirname(F.col("path")).alias("parent"))
    repo_ids = repositories.select(F.col("url").alias("repo_url"))
    return union_all([
        edge(children.join(dirs, ["repo_url", "parent"]), "Directory", "parent", "CONTAINS", "Directory", "dir_path"),
        edge(in_files.join(dirs, ["repo_url", "parent"]), "Directory", "parent", "CONTAINS", "File", "path"),
        edge(directories.join(repo_ids, "repo_url"), "Directory", "dir_path", "BELONGS_TO", "Repository", "repo_url"),
    ])


def proto_direct_load(messages: DataFrame, services: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Class rows of parsed proto messages and services, and File CONTAINS Class edges."""
    cols = ["repo_url", "path", "name", "start_line", "end_line"]
    both = messages.select(*cols, F.lit(False).alias("is_api"), F.lit(True).alias("is_data_model")).unionByName(
        services.select(*cols, F.lit(True).alias("is_api"), F.lit(False).alias("is_data_model")))
    unique_id = D.symbol_id(F.col("path"), F.col("name"))
    kind = D.class_kind(F.col("path"), unique_id, F.col("is_api"), F.col("is_data_model"))
    classes = both.withColumn("kind", kind).select(
        "repo_url", F.col("path").alias("file_path"), unique_id.alias("unique_id"), "name", "start_line", "end_line",
        "kind.is_api", "kind.is_data_model", "kind.type", "kind.framework")
    return classes, file_contains_symbol(files, classes.withColumn("label", F.lit("Class")))


def service_metadata(services: DataFrame, metadata: DataFrame) -> DataFrame:
    """Services with the manifest metadata of the same name attached."""
    return services.join(metadata.withColumnRenamed("service_name", "name"), "name", "left")


def base_edges(graph) -> DataFrame:
    """All key, containment and import edges of a projected graph."""
    from loomgraph.operators.containment import chunk_parent_by_range
    from loomgraph.operators.imports import resolve_imports
    from loomgraph.sources.scan import directory_closure

    g = graph
    dirs = directory_closure(g.files)
    resolved = resolve_imports(g.imports, g.files)
    in_symbol = chunk_parent_by_range(g.chunks, g.symbols).filter("parent_id IS NOT NULL")
    return union_all([
        service_belongs_to(g.services, g.repositories),
        file_belongs_to(g.files, g.repositories, g.services),
        file_contains_symbol(g.files, g.symbols),
        edge(in_symbol, F.col("parent_label"), "parent_id", "CONTAINS", "CodeChunk", "chunk_id"),
        edge(g.chunks, "File", "file_path", "CONTAINS", "CodeChunk", "chunk_id"),
        chunk_belongs_to(g.chunks, g.repositories, g.services),
        edge(g.symbols, F.col("label"), "unique_id", "BELONGS_TO", "Repository", "repo_url"),
        edge(resolved, "File", "source_path", "IMPORTS", "File", "target_path").distinct(),
        endpoint_edges(g.endpoints, g.services, g.repositories),
        data_model_edges(g.data_models, g.services, g.repositories),
        directory_edges(dirs, g.files, g.repositories),
    ])
