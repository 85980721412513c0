"""URL filter: explicit rules first, then a tree of path templates per host, learned from labelled pages.

Level by level, a segment keeps a branch only where it is frequent and its labelled purity differs from that of its parent
by a proportion test; all other branches of the node are merged into one wildcard. Kept branches on one side of the parent
that do not differ from their pooled purity are merged with each other, so small ones share their labels. Levels go on for
as long as some host with labels of both kinds has enough pages that deep; beyond, nothing can split. Templates with a low
smoothed purity are rejected. Counts are added up before they are shuffled, and only kept branches are joined back, so a
host with a third of all pages is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import LOWER, UPPER, stored

#: (host, path, verdict); the longest rule that fits wins, ties go to the smaller string.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: A branch needs so many pages; chi-square of the test; pseudo-labels at the rate of all labels; purity below which a
#: template is rejected.
MIN_PAGES, CHI2, PSEUDO, MIN_PURITY = 20, 6.635, 8.0, 0.6
#: Names of the branches merged below and above their parent; ``*`` in a segment is written ``%2A``, so none is like them.
LOW, HIGH = "*low", "*high"
URL_FORM = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null or without ``://``."""
    host = F.translate(F.regexp_extract(url, URL_FORM, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, URL_FORM, 2), F.lit(""))


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict. ``rules`` is a short list of a configuration, not data."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, what in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]), reverse=True):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def labels_by_page(labels: DataFrame) -> DataFrame:
    """(label_id, good): a labelled document is good with quality 1 and toxic 0; of several labels the worst counts."""
    good = (F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    return known.groupBy(F.col("doc_id").alias("label_id")).agg(F.min(good.cast("int")).alias("good"))


def _depth(base: DataFrame, min_pages: int) -> int:
    """The deepest level at which a branch can be kept: some host with labels of both kinds has ``min_pages`` pages that deep."""
    mixed = base.groupBy("host").agg(F.min("good").alias("least"), F.max("good").alias("most")).filter("least < most").select("host")
    sizes = base.groupBy("host", F.size("segments").alias("size")).agg(F.count("*").alias("n")).join(mixed, "host")
    deeper = F.sum("n").over(Window.partitionBy("host").orderBy(F.desc("size")))
    return sizes.withColumn("deeper", deeper).filter(F.col("deeper") >= min_pages).agg(F.max("size")).first()[0] or 0


def _kept(here: DataFrame, min_pages: int, chi2: float) -> DataFrame:
    """(host, template, segment, branch) of the branches of one level that do not fall into the wildcard."""
    node, p, q = ["host", "template"], F.col("pg") / F.col("pm"), F.col("g") / F.col("m")
    differs = lambda p: (q - p) * (q - p) * F.col("m") > F.lit(chi2) * p * (F.lit(1.0) - p)
    branch = here.filter(F.col("segment").isNotNull()).groupBy(*node, "segment").agg(
        F.count("*").alias("n"), F.count("good").alias("m"), F.coalesce(F.sum("good"), F.lit(0)).alias("g"))
    parent = branch.groupBy(*node).agg(F.sum("m").alias("pm"), F.sum("g").alias("pg"))
    apart = branch.filter((F.col("n") >= min_pages) & (F.col("m") > 0)).join(parent, node).filter(differs(p)).withColumn("side", F.when(q < p, LOW).otherwise(HIGH))
    pool = apart.groupBy(*node, "side").agg(F.count("*").alias("branches"), F.sum("m").alias("sm"), F.sum("g").alias("sg"))
    alike = (F.col("branches") > 1) & ~differs(F.col("sg") / F.col("sm"))
    name = F.when(alike, F.col("side")).otherwise(F.replace("segment", F.lit("*"), F.lit("%2A")))
    return apart.join(pool, [*node, "side"]).select(*node, "segment", name.alias("branch"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES, min_pages: int = MIN_PAGES, chi2: float = CHI2, pseudo: float = PSEUDO, min_purity: float = MIN_PURITY) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, n_labelled) for every row of ``pages``.

    ``pages`` has page_id and url; the last number of a path names the labelled document it shows. ``labels`` has
    (label_id, good). Repeated rows are judged alike and count each. A null url has empty parts and the template of the
    empty host. Without labels nothing is rejected. Null page_id stays null. Other columns are ignored. Paths have any
    number of segments; there is one job for each level that can still split.
    """
    host, path = parts(F.col("url"))
    split = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    split = split.withColumn("label_id", F.expr("try_cast(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) AS bigint)"))
    segments = F.split(F.regexp_replace("path", "^/", ""), "/")
    known = split.join(labels.select("label_id", "good"), "label_id", "left").select("page_id", "host", "path", "good", segments.alias("segments"))
    base = stored(known)
    totals = base.agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("g")).first()
    rate = totals.g / totals.n if totals.n else 1.0
    node, levels = base.select("*", F.lit("").alias("template")), _depth(base, min_pages)
    for level in range(levels):
        here = node.withColumn("segment", F.get("segments", F.lit(level)))
        kept = stored(_kept(here, min_pages, chi2))
        name = F.concat("template", F.lit("/"), F.coalesce("branch", F.lit("*")))
        node = here.join(kept, ["host", "template", "segment"], "left").select("page_id", "host", "path", "good", "segments", F.when(F.col("segment").isNull(), F.col("template")).otherwise(name).alias("template"))
    rest = F.repeat(F.lit("/*"), F.greatest(F.size("segments") - F.lit(levels), F.lit(0)))
    node = node.withColumn("template", F.concat("template", rest))
    purity = node.groupBy("host", "template").agg(F.count("good").alias("n_labelled"), F.coalesce(F.sum("good"), F.lit(0)).alias("g"))
    low = (F.col("g") + F.lit(pseudo) * F.lit(rate)) / (F.col("n_labelled") + F.lit(pseudo)) < min_purity
    purity = stored(purity.select("host", "template", "n_labelled", low.alias("low")))
    rule, ruled = rule_columns(F.col("host"), F.col("path"), rules)
    judged = node.join(purity, ["host", "template"])
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(ruled, F.when(F.col("low"), "block").otherwise("allow")).alias("verdict"), "template", "n_labelled")


def _oracle() -> str:
    """DuckDB SQL of judge() with the production parameters; a recursion over the levels, to the last segment of every path."""
    longest = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in longest]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r}'" for f, r, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in fits) + " WHEN low THEN 'block' ELSE 'allow' END"
    differs = f"(g / m - {{0}}) * (g / m - {{0}}) * m > {CHI2}::DOUBLE * ({{0}}) * (1.0::DOUBLE - {{0}})"
    return f"""
WITH RECURSIVE lab AS (
  SELECT doc_id AS label_id, min(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good
  FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
raw AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split0 AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM raw),
split1 AS (
  SELECT *, string_split(CASE WHEN starts_with(path, '/') THEN substr(path, 2) ELSE path END, '/') AS segments,
         TRY_CAST(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) AS BIGINT) AS label_id FROM split0),
node AS (
  SELECT row_number() OVER () AS r, 0 AS level, page_id, host, path, good, segments, '' AS template FROM split1 LEFT JOIN lab USING (label_id)
  UNION ALL
  SELECT r, level + 1, page_id, host, path, good, segments, template || '/' || CASE
           WHEN side IS NULL THEN '*'
           WHEN count(DISTINCT CASE WHEN side IS NOT NULL THEN segment END) OVER pool > 1
             AND NOT {differs.format("(sum(good) OVER pool / count(good) OVER pool)")} THEN side
           ELSE replace(segment, '*', '%2A') END
  FROM (
    SELECT *, CASE WHEN n >= {MIN_PAGES} AND m > 0 AND {differs.format("(pg / pm)")}
                   THEN CASE WHEN g / m < pg / pm THEN '{LOW}' ELSE '{HIGH}' END END AS side
    FROM (
      SELECT *, segments[level + 1] AS segment, count(*) OVER branch AS n, count(good) OVER branch AS m, coalesce(sum(good) OVER branch, 0) AS g,
             count(good) OVER parent AS pm, sum(good) OVER parent AS pg
      FROM node WHERE level < len(segments)
      WINDOW branch AS (PARTITION BY host, template, segments[level + 1]), parent AS (PARTITION BY host, template)))
  WINDOW pool AS (PARTITION BY host, template, side)),
final AS (SELECT * FROM node WHERE level = len(segments)),
rate AS (SELECT coalesce(sum(good) / count(good), 1.0) AS r FROM final),
purity AS (
  SELECT host, template, count(good) AS n_labelled,
         (coalesce(sum(good), 0) + {PSEUDO}::DOUBLE * any_value(rate.r)) / (count(good) + {PSEUDO}::DOUBLE) < {MIN_PURITY}::DOUBLE AS low
  FROM final, rate GROUP BY host, template)
SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict, template, n_labelled
FROM final JOIN purity USING (host, template)
"""


ORACLE = _oracle()
