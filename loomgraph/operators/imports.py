"""Import resolution: ranked candidate paths and one equi join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import derive as D

JS_EXTENSIONS = [".js", ".jsx", ".ts", ".tsx"]


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """File each import points to, by the first rule that finds one.

    imports: repo_url, source_path, target_text, import_name, line. Order of rules: the text is a path; relative form;
    Python module or package; Go path component; JavaScript extension or index; Java and C# dotted path.
    Candidates are listed per distinct import text of a source, so a text repeated in a file is resolved once.
    """
    src, target = F.col("source_path"), F.col("target_text")
    is_js = src.rlike(r"\.(js|jsx|ts|tsx)$")
    dots = F.length(F.regexp_extract(target, r"^\.+", 0))
    dirs = F.split(D.dirname(src), "/")
    up = F.greatest(F.size(dirs) - (dots - 1), F.lit(0))
    base = F.array_join(F.slice(dirs, F.lit(1), up), "/")
    rest = F.regexp_replace(F.substring(target, dots + 1, F.length(target)), "^/", "")
    texts = imports.select("repo_url", "source_path", "target_text", "import_name").distinct()
    # Columns of their own, so that each text is taken apart once.
    parsed = (
        texts.withColumn("base", base).withColumn("rest", rest).withColumn("dotted", F.translate(target, ".", "/"))
        .withColumn("relative", F.when(target.startswith("."), F.when(F.col("base") == "", F.col("rest")).otherwise(
            F.concat("base", F.lit("/"), "rest"))))
    )
    rel, dotted = F.col("relative"), F.col("dotted")

    def cands(*ranked):
        return F.array(*[F.struct(F.lit(rank).alias("rank"), path.alias("path")) for rank, path in ranked])

    with_ext = lambda path, ext: F.concat(path, F.lit(ext))
    js = [c for k, ext in enumerate(JS_EXTENSIONS) for c in (
        (31 + k, with_ext(target, ext)), (35 + k, with_ext(rel, ext)),
        (41 + k, with_ext(target, "/index" + ext)), (45 + k, with_ext(rel, "/index" + ext)))]
    nothing = F.array().cast("array<struct<rank:int,path:string>>")
    by_language = (
        F.when(src.endswith(".py"), cands((11, with_ext(target, ".py")), (12, with_ext(dotted, ".py")),
                                          (13, with_ext(dotted, "/__init__.py"))))
        .when(is_js, cands(*js))
        .when(src.endswith(".java"), cands((51, with_ext(dotted, ".java"))))
        .when(src.endswith(".cs"), cands((52, with_ext(dotted, ".cs")))).otherwise(nothing)
    )
    listed = parsed.select("repo_url", "source_path", "target_text", "import_name", F.inline(F.concat(
        cands((1, target)), F.when(rel.isNotNull(), cands((2, rel), (3, with_ext(rel, ".py")))).otherwise(nothing),
        by_language)))
    known = files.select("repo_url", "path")
    exact = listed.filter("path IS NOT NULL").join(known, ["repo_url", "path"])
    go_parts = (
        known.filter(F.col("path").endswith(".go"))
        .select("repo_url", "path", F.explode(F.array_distinct(F.split("path", "/"))).alias("import_name"))
        .groupBy("repo_url", "import_name").agg(F.min("path").alias("path"))
    )
    go = (
        texts.filter(src.endswith(".go") & (F.col("import_name") != "")).join(go_parts, ["repo_url", "import_name"])
        .withColumn("rank", F.lit(21))
    )
    keys = ["repo_url", "source_path", "target_text", "import_name"]
    best = (
        exact.select(*keys, "rank", "path").unionByName(go.select(*keys, "rank", "path"))
        .groupBy(*keys).agg(F.min(F.struct("rank", "path")).alias("best"))
    )
    r = F.col("best.rank")
    rule = (
        F.when(r == 1, "exact").when(r < 10, "relative").when(r < 20, "python").when(r < 30, "go")
        .when(r < 50, "javascript").when(r == 51, "java").otherwise("csharp")
    )
    return imports.join(best, keys).select(
        "repo_url", "source_path", F.col("best.path").alias("target_path"), "import_name", "line", rule.alias("rule"))
