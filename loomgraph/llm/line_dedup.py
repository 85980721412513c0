"""Line dedup: lines that many documents hold stay only in the last of them.

Lines become 128-bit hashes, dealt out by ranges of (hash, document) and sorted by hash, document and position, so a task
streams the first occurrence of each hash in each document; a hash that fills many documents is spread over many ranges.
What the ranges found is added up per hash, and the answer is a run-length coded keep bitmap per document: text is moved
only once, when bitmaps are applied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import SPACES, lower_ascii

RUNS = "array<struct<first:int,past:int>>"


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z in lower case."""
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def _rows(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents.select(F.col("doc_id").alias("_doc"), F.xxhash64(text).alias("_twin"), text.alias("_text"))


def keep_bitmaps(documents: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(_doc, _twin, _drops): the dropped lines of each document that loses any, as runs [first, past) of line numbers.

    A key of at least ``min_chars`` code points in at least ``min_docs`` documents stays in the largest doc_id alone (all its
    lines there). A null doc_id is one document below all others. Null text is one empty line. Rows with the same doc_id
    are one document; ``_twin`` tells their texts apart.
    """
    line = _rows(documents).select("_doc", "_twin", F.posexplode(F.split("_text", "\n", -1)).alias("pos", "line"))
    keyed = line.select("_doc", "_twin", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    hashed = keyed.select("_doc", "_twin", "pos", F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2"))
    ranged = hashed.repartitionByRange("h1", "h2", "_doc").sortWithinPartitions("h1", "h2", "_doc", "pos")
    # Both uses of ``ranged`` need the same columns: then its shuffle happens once.
    held = ranged.groupBy("h1", "h2", "_doc").agg(F.min(F.struct("pos", "_twin")).alias("first"))
    last = F.max(F.struct("_doc", "first"))
    shared = held.groupBy("h1", "h2").agg(F.count("*").alias("docs"), last.alias("last")).filter(F.col("docs") >= min_docs).select("h1", "h2", F.col("last._doc").alias("keeper"))
    drops = ranged.join(shared, ["h1", "h2"]).filter(~F.col("_doc").eqNullSafe(F.col("keeper")))
    runs = drops.groupBy("_doc", "_twin").agg(F.sort_array(F.collect_set("pos")).alias("p"))
    p = F.col("p")
    firsts = F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1) != x - 1))
    lasts = F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1) != x + 1))
    return runs.select("_doc", "_twin", F.arrays_zip(firsts.alias("first"), F.transform(lasts, lambda x: x + 1).alias("past")).cast(RUNS).alias("_drops"))


def apply_bitmaps(documents: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The rows of ``documents`` with ``text`` without its dropped lines, and n_lines and n_dropped."""
    names = [c for c in documents.columns if c not in ("text", "n_lines", "n_dropped")]
    text = F.coalesce("text", F.lit(""))
    marked = documents.select(*names, "text", F.xxhash64(text).alias("_key"))
    found = marked.join(bitmaps, marked["doc_id"].eqNullSafe(bitmaps["_doc"]) & (marked["_key"] == bitmaps["_twin"]), "left")
    lines = found.select(*names, "text", F.split(text, "\n", -1).alias("_lines"), F.coalesce("_drops", F.array().cast(RUNS)).alias("_drops"))
    drops, every = F.col("_drops"), F.col("_lines")

    def kept(i: Column) -> Column:
        begin = F.when(i == 0, 0).otherwise(F.get(drops, i - 1)["past"])
        end = F.when(i == F.size(drops), F.size(every)).otherwise(F.get(drops, i)["first"])
        return F.slice(every, begin + 1, end - begin)

    whole = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(drops)), kept)), "\n")
    return lines.select(
        *names,
        F.when(F.size(drops) == 0, F.col("text")).otherwise(whole).alias("text"),
        F.size(every).cast("long").alias("n_lines"),
        F.aggregate(drops, F.lit(0).cast("long"), lambda n, r: n + r["past"] - r["first"]).alias("n_dropped"),
    )


def drop_shared_lines(documents: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Both steps. Texts that lose nothing come back as they are (null stays null); other columns are untouched, but columns
    named n_lines and n_dropped are replaced. An empty table gives an empty table."""
    return apply_bitmaps(documents, keep_bitmaps(documents, min_chars, min_docs))


def digest(documents: DataFrame) -> DataFrame:
    out = drop_shared_lines(documents.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = """
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM line),
shared AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT x.doc_id, x.pos, x.line, s.k IS NOT NULL AND x.doc_id <> s.keeper AS lost FROM keyed x LEFT JOIN shared s ON x.k = s.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
