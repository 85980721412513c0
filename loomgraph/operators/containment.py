"""Which symbol covers a chunk or another symbol.

Where one cover is wanted, spans are swept (``sweep``) and no pairs arise. Where all pairs are the result they are joined: a plain range join inside a file is quadratic in the length of the file. Here every outer span is listed once per block
of lines it touches, the inner span carries the block of its first line, and the join is an equi join on
(repo_url, file_path, block) with the exact range test on top. The work is linear in the lines of a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph import constants as K
from loomgraph.functions import derive as D
from loomgraph.operators.edges import union_all
from loomgraph.operators.sweep import BLOCK_LINES, best_covering

FILE_BLOCK = ["repo_url", "file_path", "line_block"]


def covering_pairs(inner: DataFrame, outer: DataFrame, how: str = "inner") -> DataFrame:
    """Join inner spans to the outer spans that contain them.

    Both have repo_url, file_path, start_line, end_line. The outer columns come back with prefix ``o_``.
    """
    spread = (
        outer.select(*[F.col(c).alias(c if c in ("repo_url", "file_path") else f"o_{c}") for c in outer.columns])
        .withColumn("line_block", F.explode(F.sequence(
            F.floor(F.col("o_start_line") / BLOCK_LINES), F.floor(F.col("o_end_line") / BLOCK_LINES))))
    )
    keyed = inner.withColumn("line_block", F.floor(F.col("start_line") / BLOCK_LINES))
    i, o = keyed.alias("i"), spread.alias("o")
    on = [F.col(f"i.{k}") == F.col(f"o.{k}") for k in FILE_BLOCK]
    on += [F.col("o_start_line") <= F.col("i.start_line"), F.col("o_end_line") >= F.col("i.end_line")]
    return i.join(o, on, how).select("i.*", *[c for c in spread.columns if c.startswith("o_")])


def chunk_parent_by_range(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Smallest symbol of the same file that covers the chunk; null parent when none does."""
    inner = chunks.select("repo_url", "file_path", "chunk_id", "start_line", "end_line")
    outer = symbols.select("repo_url", "file_path", "label", "unique_id", "start_line", "end_line",
                           (F.col("end_line") - F.col("start_line")).alias("span"))
    found = best_covering(inner, outer, ["repo_url", "file_path", "chunk_id"], [], ["span", "start_line", "unique_id"], ["label", "unique_id"])
    return found.select("repo_url", "file_path", "chunk_id", F.col("best_label").alias("parent_label"), F.col("best_unique_id").alias("parent_id"))


def methods_of_class(classes: DataFrame, functions: DataFrame) -> DataFrame:
    """Functions inside the span of each class."""
    inner = functions.select("repo_url", "file_path", "unique_id", "name", "start_line", "end_line")
    outer = classes.select("repo_url", "file_path", "unique_id", "name", "start_line", "end_line")
    return covering_pairs(inner, outer).select(
        "repo_url", "file_path", F.col("o_unique_id").alias("class_id"), F.col("o_name").alias("class_name"),
        F.col("unique_id").alias("function_id"), F.col("name").alias("function_name"), "start_line", "end_line")


def entity_nesting(symbols: DataFrame) -> DataFrame:
    """Smallest other symbol that contains each symbol, and how many do (its nesting level).

    Of two identical spans the one that is first by (label descending, name, id) contains the other, so a class contains
    a function of the same span only when it precedes it in that order.
    """
    cols = ["repo_url", "file_path", "label", "unique_id", "name", "start_line", "end_line"]
    spans = symbols.select(*cols, (F.col("end_line") - F.col("start_line")).alias("span"))
    order = [F.col(c) for c in ("label", "name", "unique_id")]
    found = best_covering(spans, None, cols, order, ["span", "unique_id"], ["unique_id"], counted=True)
    return found.select(*cols, F.col("best_unique_id").alias("parent_id"), F.col("best_count").alias("nesting_level"))


def chunk_file_cascade(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """File of each chunk: own path, then proto path variants, then any file with that name ending, then a new file.

    Works on the distinct (repo_url, path) of the chunks, which is small next to the chunks, and joins back once.
    """
    refs = chunks.select("repo_url", "file_path").distinct()
    path, proto = F.col("file_path"), F.col("file_path").endswith(".proto")
    variants = F.array(
        F.struct(F.lit(1).alias("rank"), path.alias("path")),
        F.struct(F.when(proto, 2).alias("rank"), D.basename(path).alias("path")),
        F.struct(F.when(proto, 3).alias("rank"), F.replace(path, F.lit("proto/"), F.lit("protos/")).alias("path")),
        F.struct(F.when(proto, 4).alias("rank"), F.replace(path, F.lit("protos/"), F.lit("proto/")).alias("path")),
    )
    exact = (
        refs.select("repo_url", "file_path", F.inline(variants)).filter("rank IS NOT NULL")
        .join(files.select("repo_url", "path"), ["repo_url", "path"])
        .select("repo_url", "file_path", "rank", "path")
    )
    names = refs.select("repo_url", D.basename(path).alias("file_name")).distinct()
    by_suffix = (
        files.select("repo_url", "path", F.explode(F.expr(
            "transform(sequence(1, length(substring_index(path, '/', -1))), "
            "k -> substring(substring_index(path, '/', -1), k))")).alias("file_name"))
        .join(names, ["repo_url", "file_name"], "left_semi")
        .groupBy("repo_url", "file_name").agg(F.min("path").alias("path"))
    )
    fuzzy = (
        refs.withColumn("file_name", D.basename(path)).join(by_suffix, ["repo_url", "file_name"])
        .select("repo_url", "file_path", F.lit(5).alias("rank"), "path")
    )
    created = refs.select("repo_url", "file_path", F.lit(6).alias("rank"), path.alias("path"))
    chosen = (
        union_all([exact, fuzzy, created]).groupBy("repo_url", "file_path")
        .agg(F.min(F.struct("rank", "path")).alias("best"))
    )
    rule = F.create_map(*[F.lit(x) for kv in {1: "path", 2: "basename", 3: "protos", 4: "proto", 5: "suffix",
                                               6: "created"}.items() for x in kv])
    return (
        chunks.select("repo_url", "file_path", "chunk_id").join(chosen, ["repo_url", "file_path"])
        .select("repo_url", "chunk_id", F.lit("File").alias("parent_label"), F.col("best.path").alias("parent_id"),
                rule[F.col("best.rank")].alias("rule"))
    )


def signature_flags(chunks: DataFrame) -> DataFrame:
    """Does a chunk hold a function or class signature, and of which name."""
    text = F.col("content")
    is_function = D.signature_match(text, K.FUNCTION_SIGNATURES)
    is_class = D.signature_match(text, K.CLASS_SIGNATURES)
    return (
        chunks.withColumn("is_function_signature", is_function).withColumn("is_class_signature", is_class)
        .withColumn("function_name", F.when(F.col("is_function_signature"),
                                            D.signature_name(text, K.FUNCTION_NAME_PATTERNS)))
        .withColumn("class_name", F.when(F.col("is_class_signature"), D.signature_name(text, K.CLASS_NAME_PATTERNS)))
    )


def assign_chunks(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Best parent of each chunk: covering symbol, else symbol named in its signature, else symbol mentioned nearby.

    Covering symbols are ranked by nesting level, then by whether the chunk holds a signature of their kind. The text of
    a chunk is matched against the signature patterns once; the three kinds of candidates meet in one aggregation.
    """
    key = ["repo_url", "file_path", "chunk_id"]
    spans = chunks.select(*key, "start_line", "end_line")

    # Signatures, with the first declaration of the name in the file.
    is_fn, is_cl = F.col("is_function_signature"), F.col("is_class_signature")
    first_decl = symbols.groupBy("repo_url", "file_path", "label", "name").agg(
        F.min(F.struct("start_line", "unique_id")).alias("decl"))
    signed = (
        signature_flags(chunks.select(*key, "content")).drop("content")
        .withColumn("label", F.when(is_fn, "Function").when(is_cl, "Class"))
        .withColumn("name", F.when(is_fn, F.col("function_name")).when(is_cl, F.col("class_name")))
        .join(first_decl, ["repo_url", "file_path", "label", "name"], "left")
        .select(*key, is_fn.alias("is_fn"), is_cl.alias("is_cl"), F.col("decl.unique_id").alias("named"))
    )

    # Covering symbols: the best of each kind, as the kind's bonus is the same for all of them.
    depths = entity_nesting(symbols).select("repo_url", "file_path", "label", "unique_id", "start_line", "end_line",
                                            (-F.col("nesting_level")).alias("depth"))
    found = best_covering(spans, depths, key, [], ["depth", "start_line", "unique_id"], ["depth", "start_line", "unique_id"], ["Function", "Class"])
    of = lambda kind: F.when(F.col(f"{kind}_unique_id").isNotNull(), F.struct(
        F.col(f"{kind}_depth").alias("depth"), F.col(f"{kind}_start_line").alias("o_start_line"), F.col(f"{kind}_unique_id").alias("o_unique_id")))
    covering = found.select(*key, of("Function").alias("fn"), of("Class").alias("cl"))

    # Mentions: symbols are listed in three line blocks each, so that chunks and their texts are not repeated.
    # Of several, the one that begins first counts, the longer one at equal starts.
    places = symbols.select("repo_url", "file_path", "label", "unique_id", "name", F.col("start_line").alias("at"),
                            (-F.col("end_line")).alias("end"),
                            F.explode(F.array(*[F.floor(F.col("start_line") / 10) + d for d in (-1, 0, 1)])).alias("line_block"))
    mentioned = (
        chunks.select(*key, "content", "start_line", F.floor(F.col("start_line") / 10).alias("line_block"))
        .join(places, FILE_BLOCK)
        .filter((F.abs(F.col("at") - F.col("start_line")) < 10) & F.col("content").contains(F.col("name")))
        .groupBy(*FILE_BLOCK, "chunk_id")
        .agg(F.min(F.struct("at", "end", F.when(F.col("label") == "Function", 0).otherwise(1).alias("kind"), "label",
                            "unique_id")).alias("mention")).drop("line_block")
    )
    merged = (
        signed.unionByName(covering, allowMissingColumns=True).unionByName(mentioned, allowMissingColumns=True)
        .groupBy(*key).agg(F.bool_or("is_fn").alias("is_fn"), F.bool_or("is_cl").alias("is_cl"),
                           F.max("named").alias("named"), F.max("fn").alias("fn"), F.max("cl").alias("cl"),
                           F.max("mention").alias("mention"))
    )
    fn, cl, is_fn, is_cl = F.col("fn"), F.col("cl"), F.col("is_fn"), F.col("is_cl")
    # Equal depth: a signature of the own kind decides, functions first; else the deeper symbol.
    fn_first = fn.isNotNull() & (cl.isNull() | (fn["depth"] < cl["depth"])
                                 | ((fn["depth"] == cl["depth"]) & (is_fn | ~is_cl)))
    by_mention = F.col("mention").isNotNull() & ~is_fn & ~is_cl
    parent = (
        F.when(fn_first, F.struct(fn["o_unique_id"].alias("id"), F.lit("Function").alias("type"), F.lit("span").alias("rule")))
        .when(cl.isNotNull(), F.struct(cl["o_unique_id"].alias("id"), F.lit("Class").alias("type"), F.lit("span").alias("rule")))
        .when(F.col("named").isNotNull(), F.struct(
            F.col("named").alias("id"), F.when(is_fn, "Function").otherwise("Class").alias("type"), F.lit("signature").alias("rule")))
        .when(by_mention, F.struct(F.col("mention.unique_id").alias("id"), F.col("mention.label").alias("type"),
                                   F.lit("mention").alias("rule")))
        .otherwise(F.struct(D.file_parent_id(F.col("file_path")).alias("id"), F.lit("File").alias("type"),
                            F.lit("file").alias("rule")))
    )
    return merged.withColumn("p", parent).select(
        *key, F.col("p.id").alias("parent_id"), F.col("p.type").alias("parent_type"), F.col("p.rule").alias("rule"))
