"""Import statements of source files, line by line.

Input: files(repo_url, path, language, content). Only lines that can be an import leave the first step; nothing but the
Go block state needs a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Forms of import statements.
PY_IMPORT = r"^\s*import\s+([a-zA-Z0-9_.,\s]+)"
PY_FROM = r"^\s*from\s+([a-zA-Z0-9_.]+)\s+import\s+([a-zA-Z0-9_.,\s*]+)"
GO_OPEN = r"^\s*import\s+\(\s*(?://[^\n]*)?$"
GO_CLOSE = r"^\s*\)\s*(?://[^\n]*)?$"
GO_IN_BLOCK = r'^\s*(?:([a-zA-Z0-9_]+)\s+)?"([^"]+)"'
GO_SINGLE = r'^\s*import\s+(?:([a-zA-Z0-9_]+)\s+)?"([^"]+)"'
JS_FORMS = [
    ("default", r"""^\s*import\s+([a-zA-Z0-9_]+)\s+from\s+['"]([^'"]+)['"]"""),
    ("named", r"""^\s*import\s+\{\s*([^}]+)\s*\}\s+from\s+['"]([^'"]+)['"]"""),
    ("namespace", r"""^\s*import\s+\*\s+as\s+([a-zA-Z0-9_]+)\s+from\s+['"]([^'"]+)['"]"""),
    ("side_effect", r"""^\s*import\s+()['"]([^'"]+)['"]"""),
    ("require", r"""^\s*(?:const|var|let)\s+([a-zA-Z0-9_]+)\s+=\s+require\(['"]([^'"]+)['"]\)"""),
    ("bare_require", r"""^\s*()require\(['"]([^'"]+)['"]\)"""),
]
JAVA_IMPORT = r"^\s*import\s+(?:static\s+)?([a-zA-Z0-9_.]+(?:\.[*])?);\s*(?://[^\n]*)?$"
CS_USING = r"^\s*using\s+(?:static\s+)?([a-zA-Z0-9_.]+)(?:\s+=\s+([a-zA-Z0-9_.]+))?;\s*(?://[^\n]*)?$"

COLUMNS = ["repo_url", "path", "line", "kind", "name", "target", "alias"]


def lines_of(files: DataFrame, languages: list[str]) -> DataFrame:
    return files.filter(F.col("language").isin(languages)).select(
        "repo_url", "path", F.posexplode(F.split("content", "\n")).alias("i", "text")).withColumn("line", F.col("i") + 1)


def _group(pattern: str, k: int, column: str = "text"):
    return F.regexp_extract(column, pattern, k)


def _trimmed(column):
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def python_imports(files: DataFrame) -> DataFrame:
    """``import a, b`` gives a row per module, ``from m import x, y`` a row per item."""
    lines = lines_of(files, ["python"]).filter(F.col("text").rlike(PY_IMPORT) | F.col("text").rlike(PY_FROM))
    is_from = F.col("text").rlike(PY_FROM)
    items = F.split(F.when(is_from, _group(PY_FROM, 2)).otherwise(_group(PY_IMPORT, 1)), ",")
    module = _group(PY_FROM, 1)
    item = F.col("item")
    return (
        lines.withColumn("is_from", is_from).withColumn("module", module)
        .withColumn("item", F.explode(F.transform(items, _trimmed)))
        .select("repo_url", "path", "line", F.when(F.col("is_from"), "from").otherwise("import").alias("kind"),
                F.when(F.col("is_from") & (item == "*"), F.concat("module", F.lit(".*"))).otherwise(item).alias("name"),
                F.when(F.col("is_from"), F.col("module")).otherwise(item).alias("target"),
                F.when(F.col("is_from") & (item != "*"), F.concat_ws(".", "module", item)).alias("alias"))
    )


def go_imports(files: DataFrame) -> DataFrame:
    """Single and block imports. A line is inside a block when the last opening or closing line above it opens."""
    text = F.col("text")
    opens, closes = text.rlike(GO_OPEN), text.rlike(GO_CLOSE)
    # Only opening, closing and quoted lines can matter, so only they are shuffled to their file.
    lines = lines_of(files, ["go"]).filter(opens | closes | text.contains('"'))
    above = Window.partitionBy("repo_url", "path").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    event = F.when(opens, True).when(closes, False)
    inside = F.coalesce(F.last(event, ignorenulls=True).over(above), F.lit(False))
    pattern_hit = F.when(F.col("inside"), text.rlike(GO_IN_BLOCK)).otherwise(text.rlike(GO_SINGLE))
    pick = lambda k: F.when(F.col("inside"), _group(GO_IN_BLOCK, k)).otherwise(_group(GO_SINGLE, k))
    alias, target = F.nullif(pick(1), F.lit("")), pick(2)
    return (
        lines.withColumn("inside", inside).filter(pattern_hit)
        .select("repo_url", "path", "line", F.when(F.col("inside"), "block").otherwise("single").alias("kind"),
                F.coalesce(alias, F.substring_index(target, "/", -1)).alias("name"), target.alias("target"),
                alias.alias("alias"))
    )


def js_imports(files: DataFrame) -> DataFrame:
    """Six forms, the first that fits a line decides; braces give a row per name, ``a as b`` is named b."""
    text = F.col("text")
    kind = F.lit(None).cast("string")
    name, target = F.lit(None).cast("string"), F.lit(None).cast("string")
    for form, pattern in reversed(JS_FORMS):
        hit = text.rlike(pattern)
        kind = F.when(hit, form).otherwise(kind)
        name = F.when(hit, _group(pattern, 1)).otherwise(name)
        target = F.when(hit, _group(pattern, 2)).otherwise(target)
    candidates = lines_of(files, ["javascript", "typescript"]).filter(text.contains("import") | text.contains("require"))
    found = candidates.select("repo_url", "path", "line", kind.alias("kind"), name.alias("raw"), target.alias("target")) \
        .filter("kind IS NOT NULL")
    items = F.when(F.col("kind") == "named", F.split("raw", ",")).otherwise(F.array("raw"))
    item = F.col("item")
    parts = F.split(item, " as ")
    renamed = (F.col("kind") == "named") & item.contains(" as ")
    own = F.when(F.col("raw") == "", F.substring_index("target", "/", -1)).otherwise(item)
    return found.withColumn("item", F.explode(F.transform(items, _trimmed))).select(
        "repo_url", "path", "line", "kind",
        F.when(renamed, _trimmed(F.get(parts, F.lit(1)))).otherwise(own).alias("name"), "target",
        F.when(renamed, _trimmed(F.get(parts, F.lit(0)))).alias("alias"))


def java_imports(files: DataFrame) -> DataFrame:
    full = _group(JAVA_IMPORT, 1)
    wildcard = full.endswith(".*")
    package = F.regexp_replace(full, r"\.\*$", "")
    return lines_of(files, ["java"]).filter(F.col("text").rlike(JAVA_IMPORT)).select(
        "repo_url", "path", "line", F.when(wildcard, "wildcard").otherwise("class").alias("kind"),
        F.when(wildcard, full).otherwise(F.substring_index(full, ".", -1)).alias("name"),
        F.when(wildcard, package).otherwise(full).alias("target"),
        F.when(~wildcard & full.contains("."), F.regexp_replace(full, r"\.[^.]*$", "")).when(~wildcard, "").alias("alias"))


def csharp_usings(files: DataFrame) -> DataFrame:
    first, second = _group(CS_USING, 1), _group(CS_USING, 2)
    aliased = second != ""
    return lines_of(files, ["csharp"]).filter(F.col("text").rlike(CS_USING)).select(
        "repo_url", "path", "line", F.when(aliased, "alias").otherwise("namespace").alias("kind"),
        F.when(aliased, first).otherwise(F.substring_index(first, ".", -1)).alias("name"),
        F.when(aliased, second).otherwise(first).alias("target"), F.when(aliased, first).alias("alias"))
