"""Streaming jobs: change feed, debounced save, throttled refresh, incremental ingest and the request queue.

The window jobs take a streaming or a batch DataFrame, so a stream's result can be compared with the batch's.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.search import changed_repositories
from loomgraph.session import shared_folder

OPERATION = {"signup": "insert", "purchase": "update", "click": "update", "error": "delete", "view": "read"}


def work_folder(spark: SparkSession) -> str:
    """A new folder below the shared folder."""
    return f"{shared_folder(spark)}/loomgraph-{uuid.uuid4().hex}"


def change_feed(events: DataFrame) -> DataFrame:
    """Events as chat changes; reads are no change. The time becomes an instant in UTC."""
    table = F.create_map(*[F.lit(x) for kv in OPERATION.items() for x in kv])
    return events.select(
        "event_id", F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()).alias("ts"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"),
        F.col("user_id").alias("chat_id"), table[F.col("event_type")].alias("op"), "value").filter("op <> 'read'")


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def read_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_feed(read_events(spark, sf_dir))


def latest_changes(changes: DataFrame) -> DataFrame:
    """Last change of each chat, by time and event."""
    return changes.groupBy("chat_id").agg(F.max(F.struct("at", "event_id", "op", "value")).alias("m")).select(
        "chat_id", "m.at", "m.event_id", "m.op", "m.value")


def debounced_saves(changes: DataFrame, gap: str = "1 second", watermark: str = "1 hour") -> DataFrame:
    """One save per burst of changes of a chat: the last change of each session with no gap longer than ``gap``."""
    return (
        changes.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap).alias("w"), "chat_id")
        .agg(F.max(F.struct("at", "event_id", "value")).alias("m"), F.count("*").alias("changes"))
        .select("chat_id", "m.at", "m.event_id", "m.value", "changes")
    )


def throttled_refreshes(changes: DataFrame, every: str = "1 second", watermark: str = "1 hour") -> DataFrame:
    """At most one refresh per chat and interval: the first change of each."""
    return (
        changes.withWatermark("ts", watermark).groupBy(F.window("ts", every).alias("w"), "chat_id")
        .agg(F.min(F.struct("at", "event_id")).alias("m"), F.count("*").alias("changes"))
        .select("chat_id", "m.at", "m.event_id", "changes")
    )


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], mode: str, checkpoint: str) -> None:
    """Process what is there now, batch by batch, and stop."""
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()
    query.awaitTermination()


def materialize_stream(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Result table of a stream over the files that are there now. In complete mode every batch is a full new version."""
    spark = stream.sparkSession
    folder = work_folder(spark)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")

    run_available(stream, write, mode, f"{folder}/checkpoint")
    out = spark.read.schema(stream.schema).parquet(f"{folder}/out/*")
    if mode != "complete":
        return out
    versions = spark.read.parquet(f"{folder}/out")
    newest = versions.agg(F.max("epoch").alias("e")).scalar()
    return versions.filter(F.col("epoch") == newest).drop("epoch")


def follow_changes(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Latest-state table of a change feed: each batch is merged into the stored state and written as a new version.

    A batch that is run again reads the same older version and writes the same result.
    """
    folder = work_folder(spark)

    def merge(batch: DataFrame, epoch: int) -> None:
        state = latest_changes(batch)
        if epoch > 0:
            stored = batch.sparkSession.read.parquet(f"{folder}/state/epoch={epoch - 1}")
            state = latest_changes(state.unionByName(stored))
        state.write.mode("overwrite").parquet(f"{folder}/state/epoch={epoch}")

    run_available(stream, merge, "append", f"{folder}/checkpoint")
    versions = spark.read.parquet(f"{folder}/state")
    newest = versions.agg(F.max("epoch").alias("e")).scalar()
    return versions.filter(F.col("epoch") == newest).drop("epoch")


def ingest_changed(current: DataFrame, stored: DataFrame, scanned: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reload the nodes of changed repositories and stamp their commit; the rest stays as it is.

    current: url, current_sha, force. stored: url, last_indexed_commit_sha. Running it again with the same commits
    changes nothing.
    """
    todo = changed_repositories(current, stored).select(F.col("url").alias("repo_url"), "current_sha")
    kept = nodes.join(todo, "repo_url", "left_anti")
    loaded = scanned.join(todo, "repo_url", "left_semi")
    status = stored.join(todo.withColumnRenamed("repo_url", "url"), "url", "full_outer").select(
        "url", F.coalesce("current_sha", "last_indexed_commit_sha").alias("last_indexed_commit_sha"),
        F.col("current_sha").isNotNull().alias("reloaded"))
    return kept.unionByName(loaded), status


def accepted_requests(requests: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Ingest requests (url, commit, requested_at), each url once inside the watermark."""
    return requests.withWatermark("requested_at", watermark).dropDuplicatesWithinWatermark(["url"])


def ingest_queue(requests: DataFrame, ingest: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand accepted requests to ``ingest`` batch by batch."""
    run_available(accepted_requests(requests), ingest, "append", checkpoint)
