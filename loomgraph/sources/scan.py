"""Scans: repository folders, ignore rules, READMEs, directories and service manifests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import derive as D


def ignore_patterns(lines: DataFrame) -> DataFrame:
    """Ignore-file lines (column ``value``) to unanchored regular expressions; blanks and comments dropped."""
    line = F.trim("value")
    return lines.filter((line != "") & ~line.startswith("#")).select(
        F.regexp_replace(F.regexp_replace(line, r"\.", r"\\."), r"\*", ".*").alias("pattern")).distinct()


def drop_ignored(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """Files whose path matches no pattern. The patterns of one ignore file form one alternation per repository."""
    joined = patterns.groupBy("repo_url").agg(
        F.array_join(F.transform(F.sort_array(F.collect_set("pattern")), lambda p: F.concat(F.lit("("), p, F.lit(")"))),
                     "|").alias("ignore_regex"))
    return (
        files.join(joined, "repo_url", "left")
        .filter(F.col("ignore_regex").isNull() | ~F.rlike(F.col("path"), F.col("ignore_regex")))
        .drop("ignore_regex")
    )


def scan_repo_files(roots: DataFrame, extensions: list[str], partitions: int | None = None) -> DataFrame:
    """Files of repository folders (repo_url, root) with one of the extensions, as (repo_url, path, content).

    Folders whose path holds ``.git`` are skipped, patterns of a root's ignore file are applied, and bytes that are no
    UTF-8 are replaced. Spark's own file sources leave out names that start with ``_`` or ``.``, among them
    ``__init__.py``, so tasks list the folders, the names are dealt out evenly, and tasks read the files.
    """
    spark = roots.sparkSession
    listed = roots.select("repo_url", "root").mapInPandas(_list_folder, "repo_url string, root string, path string")
    wanted = D.any_of([F.col("path").endswith(e) for e in extensions])
    kept = listed.filter(wanted & ~D.dirname(F.col("path")).contains(".git"))
    n = partitions or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ignore = listed.filter("path = '.gitignore'").mapInPandas(_read_files, _READ_SCHEMA).select(
        "repo_url", F.explode(F.split("content", "\n")).alias("value"))
    chosen = drop_ignored(kept, ignore.transform(_patterns_by_repo))
    return chosen.select("repo_url", "root", "path").repartition(n).mapInPandas(_read_files, _READ_SCHEMA)


_READ_SCHEMA = "repo_url string, path string, content string"


def _list_folder(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for row in frame.itertuples():
            fs, base = FileSystem.from_uri(row.root)
            infos = fs.get_file_info(FileSelector(base, recursive=True))
            paths = [i.path[len(base.rstrip("/")) + 1:] for i in infos if i.type == FileType.File]
            yield pd.DataFrame({"repo_url": row.repo_url, "root": row.root, "path": paths})


def _read_files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for row in frame.itertuples():
            fs, base = FileSystem.from_uri(row.root)
            with fs.open_input_stream(f"{base.rstrip('/')}/{row.path}") as stream:
                text = stream.read().decode("utf-8", errors="replace")
            yield pd.DataFrame({"repo_url": [row.repo_url], "path": [row.path], "content": [text]})


def _patterns_by_repo(lines: DataFrame) -> DataFrame:
    line = F.trim("value")
    return lines.filter((line != "") & ~line.startswith("#")).select(
        "repo_url", F.regexp_replace(F.regexp_replace(line, r"\.", r"\\."), r"\*", ".*").alias("pattern"))


def scan_readmes(files: DataFrame) -> DataFrame:
    return files.filter(D.is_readme_name(D.basename(F.col("path"))))


def directory_closure(files: DataFrame) -> DataFrame:
    """Every ancestor directory of every file."""
    ancestors = F.expr("transform(sequence(1, size(split(path, '/')) - 1), "
                       "k -> array_join(slice(split(path, '/'), 1, k), '/'))")
    nested = files.filter(F.col("path").contains("/"))
    # Distinct directories of files first: ancestors are then listed once per directory, not once per file.
    own = nested.select("repo_url", D.dirname(F.col("path")).alias("d")).distinct().select(
        "repo_url", F.concat("d", F.lit("/x")).alias("path"))
    p = F.col("dir_path")
    return own.select("repo_url", F.explode(ancestors).alias("dir_path")).distinct().select(
        "repo_url", "dir_path", D.dirname(p).alias("parent_path"), D.basename(p).alias("name"))


def scan_service_manifests(manifests: DataFrame) -> DataFrame:
    """Service metadata of manifest files (repo_url, path, content).

    Kubernetes ``Deployment`` documents win; compose services are used only for repositories without a Kubernetes
    manifest folder. Lists come back as the raw text of their YAML block.
    """
    in_k8s = F.col("path").rlike(r"(^|/)kubernetes-manifests/[^/]*\.ya?ml$")
    docs = manifests.filter(in_k8s).select(
        "repo_url", F.explode(F.split("content", r"\n---[^\n]*")).alias("doc"))
    deployments = docs.filter(F.col("doc").rlike(r"(?m)^kind:\s*Deployment\s*$")).select(
        "repo_url",
        F.regexp_extract("doc", r"(?m)^metadata:\s*\n(?:  .*\n)*?  name:\s*([^\s]+)", 1).alias("service_name"),
        F.trim(F.regexp_extract("doc", r"(?m)^ +containers:\s*\n((?: +.*\n?)*)", 1)).alias("containers"),
        F.trim(F.regexp_extract("doc", r"(?m)^  labels:\s*\n((?:    .*\n?)*)", 1)).alias("labels"),
        F.trim(F.regexp_extract("doc", r"(?m)^  annotations:\s*\n((?:    .*\n?)*)", 1)).alias("annotations"),
        F.lit("kubernetes").alias("origin"))
    has_k8s = manifests.filter(in_k8s).select("repo_url").distinct()
    compose = manifests.filter(F.col("path").rlike(r"(^|/)docker-compose\.ya?ml$")).join(
        has_k8s, "repo_url", "left_anti")
    body = F.regexp_extract("content", r"(?m)^services:\s*\n((?:(?: .*)?\n?)*)", 1)
    entries = compose.select("repo_url", F.explode(F.regexp_extract_all(
        body, F.lit(r"(?m)^  ([A-Za-z0-9_.-]+):\s*\n((?:    .*\n?)*)"), F.lit(0))).alias("entry"))
    composed = entries.select(
        "repo_url", F.regexp_extract("entry", r"^  ([A-Za-z0-9_.-]+):", 1).alias("service_name"),
        F.trim(F.regexp_extract("entry", r"\n([\s\S]*)", 1)).alias("containers"),
        F.lit("").alias("labels"), F.lit("").alias("annotations"), F.lit("compose").alias("origin"))
    return deployments.unionByName(composed)
