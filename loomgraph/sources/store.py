"""Upserts, deletes, report sinks and chat files. The table functions are pure; writers put a new version beside the old."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.edges import EDGE_KEY, union_all
from loomgraph.session import materialize

CHAT_PAYLOAD = ("id string, title string, createdAt string, userId string, path string, sharePath string, "
                "messages array<struct<id:string,role:string,content:string>>")
CHAT_ROW = f"{CHAT_PAYLOAD}, payload struct<{CHAT_PAYLOAD.replace(' string', ':string').replace('messages array', 'messages:array')}>"


def upsert_nodes(stored: DataFrame, incoming: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """Stored rows with incoming values laid over them. A null never overwrites, rows without a full key or value are skipped.

    Of several incoming rows with one key the last by ``order`` counts, as a whole; without an order, or at equal places,
    the one with the greatest values. Order columns are not stored.
    """
    values = [c for c in incoming.columns if c not in key and c not in (order or [])]
    filled = incoming.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in key)).filter(
        " OR ".join(f"`{c}` IS NOT NULL" for c in values))
    last = F.max(F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order or [])], *values)).alias("last")
    fresh = filled.groupBy(*key).agg(last).select(*key, *[F.col(f"last.{c}").alias(f"new_{c}") for c in values])
    joined = stored.join(fresh, key, "full_outer")
    return joined.select(*[
        F.coalesce(f"new_{c}", c).alias(c) if c in values else F.col(c) for c in stored.columns])


def upsert_edges(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Edges of both, each once; rows without an end are dropped."""
    complete = incoming.filter("src_id IS NOT NULL AND dst_id IS NOT NULL")
    return union_all([stored.select(*EDGE_KEY), complete.select(*EDGE_KEY)]).dropDuplicates(EDGE_KEY)


def delete_repo_cascade(nodes: DataFrame, edges: DataFrame, repo_url: str, hops: int = 3) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without a repository and all nodes that reach it over BELONGS_TO.

    nodes: repo_url, label, id. The longest BELONGS_TO path of the model has three hops. The rows of each hop are written
    to the checkpoint folder, so that a later hop does not repeat the earlier ones.
    """
    key = ["repo_url", "label", "id"]
    belongs = edges.filter("rel = 'BELONGS_TO'").filter(F.col("repo_url") == repo_url)
    # Each hop extends only the rows the hop before found; the model has no BELONGS_TO cycle.
    frontier = nodes.filter((F.col("label") == "Repository") & (F.col("id") == repo_url)).select(*key)
    found = [frontier]
    for _ in range(hops):
        targets = frontier.select("repo_url", F.col("label").alias("dst_label"), F.col("id").alias("dst_id"))
        frontier = materialize(belongs.join(targets, ["repo_url", "dst_label", "dst_id"], "left_semi").select(
            "repo_url", F.col("src_label").alias("label"), F.col("src_id").alias("id")).distinct())
        found.append(frontier)
    reached = union_all(found).distinct()
    gone = lambda side: reached.select("repo_url", F.col("label").alias(f"{side}_label"), F.col("id").alias(f"{side}_id"))
    return (nodes.join(reached, key, "left_anti"),
            edges.join(gone("src"), ["repo_url", "src_label", "src_id"], "left_anti")
            .join(gone("dst"), ["repo_url", "dst_label", "dst_id"], "left_anti").select(*EDGE_KEY))


def delete_repo_by_property(nodes: DataFrame, edges: DataFrame, repo_url: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without everything stamped with the repository's url."""
    hit = (F.col("repo_url") == repo_url) | ((F.col("label") == "Repository") & (F.col("id") == repo_url))
    return nodes.filter(~F.coalesce(hit, F.lit(False))), edges.filter(
        ~F.coalesce((F.col("repo_url") == repo_url) | (F.col("dst_id") == repo_url) | (F.col("src_id") == repo_url), F.lit(False)))


def write_version(df: DataFrame, folder: str, version: str, partition_by: list[str] | None = None) -> str:
    """Write a table as a new version folder; the path it returns is what readers switch to."""
    path = f"{folder.rstrip('/')}/version={version}"
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)
    return path


def report_json(report: DataFrame) -> DataFrame:
    return report.select(F.to_json(F.struct("*")).alias("value"))


def report_sink(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def chats_of_rows(rows: DataFrame, user_id: str) -> DataFrame:
    """Chats of parsed rows: the payload where there is one, else the row; rows without an id are dropped, the user is forced."""
    own = F.struct(*[c for c in rows.columns if c != "payload"])
    return rows.select(F.coalesce("payload", own).alias("p")).select("p.*").filter("id IS NOT NULL").withColumn(
        "userId", F.lit(user_id))


def import_chats_json(spark: SparkSession, path: str, user_id: str) -> DataFrame:
    """Chats of JSON array files."""
    return chats_of_rows(spark.read.schema(CHAT_ROW).option("multiLine", True).json(path), user_id)


def chats_sample(chats: DataFrame, n: int = 10) -> DataFrame:
    return chats.orderBy(F.desc("created_at"), "id").limit(n)


def export_chats_sample(chats: DataFrame, path: str, n: int = 10) -> None:
    chats_sample(chats, n).write.mode("overwrite").json(path)
