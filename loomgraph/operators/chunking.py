"""Cutting files into chunks and locating chunks in files. A file is cut inside its own row, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import constants as K
from loomgraph.functions import derive as D

# Line patterns at which a new block of a language starts. Users add a language by adding an entry.
BOUNDARIES = {
    "python": r"^(?:class\s|def\s|async\s|@)",
    "go": r"^(?:func|type|var|const)\s",
    "java": r"^\s{0,4}(?:public|private|protected|class|interface|enum)\s",
    "csharp": r"^\s{0,4}(?:public|private|protected|internal|class|interface|namespace)\s",
    "javascript": r"^(?:export|function|class|const|let|var)\s",
    "typescript": r"^(?:export|function|class|interface|type|const|let|var)\s",
    "markdown": r"^#{1,6}\s",
    "yaml": r"^---",
    "protobuf": r"^(?:message|service|enum)\s",
}


def chunk_by_line_window(files: DataFrame, lines_per_chunk: int) -> DataFrame:
    """Fixed number of lines per chunk."""
    k = lines_per_chunk
    return files.withColumn("lines", F.split("content", "\n")).selectExpr(
        "repo_url", "path", f"""inline(transform(sequence(0, floor((size(lines) - 1) / {k})), n -> named_struct(
            'n', n, 'start_line', cast(n * {k} + 1 as int), 'end_line', cast(least(n * {k} + {k}, size(lines)) as int),
            'content', array_join(slice(lines, cast(n * {k} + 1 as int), {k}), chr(10)))))""")


def _pieces(size: int) -> Column:
    """Lines of a file as (line number, text), lines longer than the chunk size cut into pieces of it."""
    cut = lambda l: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length(l) - 1, F.lit(0)) / size).cast("int")),
                                lambda j: F.substring(l, j * size + 1, F.lit(size)))
    return F.flatten(F.transform(F.split("content", "\n"), lambda l, i: F.transform(
        cut(l), lambda t: F.struct((i + 1).alias("line"), t.alias("text")))))


def chunk_by_size(files: DataFrame, size: int = K.CHUNK_SIZE, overlap: int = K.CHUNK_OVERLAP,
                  boundaries: dict[str, str] | None = None) -> DataFrame:
    """Chunks of about ``size`` characters that overlap by up to ``overlap`` and never cross a block boundary.

    A block starts at a boundary line. Chunk n of a block holds the lines that start at offsets
    [n * step, n * step + size) of the block, with step = size - overlap, so every line is in one or two chunks.
    Offsets and block numbers are running sums over the lines of one file.
    """
    bounds = BOUNDARIES if boundaries is None else boundaries
    starts_block = F.lit(False)
    for language, pattern in bounds.items():
        starts_block = F.when(F.col("language") == language, F.col("text").rlike(pattern)).otherwise(starts_block)
    step = size - overlap
    rows = (
        files.select("repo_url", "path", "language", F.posexplode(_pieces(size)).alias("i", "p"))
        .select("repo_url", "path", "language", "i", "p.line", "p.text")
    )
    in_file = Window.partitionBy("repo_url", "path").orderBy("i")
    in_block = Window.partitionBy("repo_url", "path", "block").orderBy("i")
    before = in_block.rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.withColumn("block", F.sum(starts_block.cast("int")).over(in_file))
        .withColumn("offset", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)))
    )
    n = F.floor(F.col("offset") / step)
    both = (n > 0) & (F.col("offset") - n * step < overlap)
    listed = placed.withColumn("n", F.explode(F.when(both, F.array(n - 1, n)).otherwise(F.array(n))))
    # A group is a chunk: at most about ``size`` characters plus one line.
    items = F.array_sort(F.collect_list(F.struct("i", "line", "text")))
    texts = F.aggregate("items", F.lit(None).cast("struct<line:int,text:string>"), lambda acc, x: F.struct(
        x["line"].alias("line"),
        F.when(acc.isNull(), x["text"]).when(acc["line"] == x["line"], F.concat(acc["text"], x["text"]))
        .otherwise(F.concat(acc["text"], F.lit("\n"), x["text"])).alias("text")))
    return (
        listed.groupBy("repo_url", "path", "block", "n")
        .agg(items.alias("items"), F.min("line").alias("start_line"), F.max("line").alias("end_line"))
        .select("repo_url", "path", "block", "n", "start_line", "end_line", texts["text"].alias("content"))
    )


def chunk_file_level(files: DataFrame) -> DataFrame:
    """Size-bounded chunks with file parents and an index per file."""
    w = Window.partitionBy("repo_url", "path").orderBy("block", "n")
    p = F.col("path")
    return chunk_by_size(files).withColumn("idx", F.row_number().over(w) - 1).select(
        "repo_url", F.col("path").alias("file_path"), D.chunk_id(D.file_parent_id(p), F.col("idx")).alias("chunk_id"),
        D.file_parent_id(p).alias("parent_id"), F.lit("File").alias("parent_type"), D.basename(p).alias("parent_name"),
        "start_line", "end_line", "content")


def chunk_readmes(files: DataFrame, chunked: DataFrame) -> DataFrame:
    """Chunks for README files that have none yet (``chunked``: repo_url, path); lines are approximate."""
    todo = files.filter(F.upper("name").isin("README.MD", "README")).join(
        chunked.select("repo_url", "path").distinct(), ["repo_url", "path"], "left_anti")
    w = Window.partitionBy("repo_url", "path").orderBy("block", "n")
    return chunk_by_size(todo, K.README_CHUNK_SIZE, K.README_CHUNK_OVERLAP).withColumn(
        "idx", F.row_number().over(w) - 1).select(
        "repo_url", "path", D.readme_chunk_id(F.col("repo_url"), F.col("path"), F.col("idx")).alias("chunk_id"),
        (F.col("idx") * 10).alias("start_line"),
        (F.col("idx") * 10 + F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1).alias("end_line"),
        "content", F.lit(True).alias("is_readme"))


def _line_of(full: Column, pos: Column) -> Column:
    head = F.substring(full, F.lit(1), pos - 1)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))


def chunk_line_span(pairs: DataFrame) -> DataFrame:
    """Line range of ``chunk`` in ``full`` (from ``start_line``), with the rule that found it.

    Rules in order: exact text; for chunks of more than three lines a place of the first line with more than 0.8 of the
    chunk's words around it, else the places of the first and last three lines; else the start line.
    """
    chunk, full, start = F.col("chunk"), F.col("full"), F.col("start_line")
    n_lines = F.size(F.split(chunk, "\n"))
    at = F.expr("locate(chunk, full)")
    lines = F.split(chunk, "\n")
    first = F.trim(F.get(lines, F.lit(0)))
    words = lambda t: F.array_distinct(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    long = (n_lines > 3) & (first != "")
    # Places of the first line: the text is cut at it, so the k-th cut gives the k-th position.
    parts = F.when(long, F.split(full, F.concat(F.lit("\\Q"), first, F.lit("\\E"))))
    lens = F.transform(parts, F.length)
    places = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.aggregate(
        F.slice(lens, F.lit(1), k), F.lit(1), lambda a, x: a + x) + (k - 1) * F.length(first))
    share = lambda pos: F.size(F.array_intersect(words(chunk), words(F.substring(
        full, F.greatest(pos - 100, F.lit(1)), F.length(chunk) + 100 + F.least(pos - 1, F.lit(100)))))) / F.size(words(chunk))
    fit = F.get(F.filter(F.when(F.size(parts) > 1, places), lambda p: share(p) > 0.8), F.lit(0))
    head = F.array_join(F.slice(lines, F.lit(1), F.lit(3)), "\n")
    tail = F.array_join(F.slice(lines, F.greatest(n_lines - 2, F.lit(1)), F.lit(3)), "\n")
    out = (
        pairs.withColumn("at", at).withColumn("nl", n_lines)
        .withColumn("fit", F.when((F.col("at") == 0) & long, fit)).withColumn("head", head).withColumn("tail", tail)
        .withColumn("head_at", F.when(F.col("nl") > 3, F.expr("locate(head, full)")))
        .withColumn("tail_at", F.when(F.col("nl") > 3, F.expr("locate(tail, full)")))
    )
    ends = (F.col("head_at") > 0) & (F.col("tail_at") > 0)
    rule = F.when(F.col("at") > 0, "exact").when(F.col("fit").isNotNull(), "first_line").when(ends, "ends").otherwise("default")
    first_line = (
        F.when(F.col("at") > 0, start + _line_of(full, F.col("at")))
        .when(F.col("fit").isNotNull(), start + _line_of(full, F.col("fit")))
        .when(ends, start + _line_of(full, F.col("head_at"))).otherwise(start)
    )
    last = F.when((F.col("at") == 0) & F.col("fit").isNull() & ends,
                  start + _line_of(full, F.col("tail_at") + F.length("tail"))).otherwise(F.col("first") + F.col("nl") - 1)
    return out.withColumn("rule", rule).withColumn("first", first_line).withColumn("last", last).select(
        *[c for c in pairs.columns if c not in ("chunk", "full", "start_line")], "first", "last", "rule")
