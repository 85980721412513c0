"""Chat store. Headers and messages are two tables, so a chat of any length stays spread over rows.

chats: id, user_id, title, created_at, share_path, payload_id, path. messages: chat_id, turn, role, content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import derive as D


def first_user_message(messages: DataFrame) -> DataFrame:
    return messages.filter("role = 'user'").groupBy(F.col("chat_id").alias("id")).agg(
        F.min_by("content", "turn").alias("first_user"))


def retitle(chats: DataFrame, messages: DataFrame) -> DataFrame:
    """Chats without a title of their own get the start of their first user message."""
    title = F.when(D.needs_title(F.col("title")) & F.col("first_user").isNotNull(),
                   D.title_from_message(F.col("first_user"))).otherwise(F.col("title"))
    return chats.join(first_user_message(messages), "id", "left").withColumn("title", title).drop("first_user")


def chats_by_user(chats: DataFrame, user_id: int) -> DataFrame:
    """Chats of one user, newest first, with the payload id defaulted to the row id."""
    return chats.filter(F.col("user_id") == user_id).withColumn(
        "payload_id", F.coalesce("payload_id", "id")).orderBy(F.desc("created_at"), "id")


def chat_by_id(chats: DataFrame, requests: DataFrame) -> DataFrame:
    """One answer per request (req_id, user_id): the row with that id, else the user's chat with that payload id.

    The columns of the answer follow req_id and req_user.
    """
    asked = requests.select("req_id", F.col("user_id").alias("req_user")).distinct()
    by_row = asked.join(chats, F.col("req_id") == F.col("id")).withColumn("rank", F.lit(1))
    by_payload = asked.join(chats, (F.col("req_id") == F.col("payload_id")) & (F.col("req_user") == F.col("user_id"))) \
        .withColumn("rank", F.lit(2))
    w = Window.partitionBy("req_id", "req_user").orderBy("rank", "id")
    return by_row.unionByName(by_payload).withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def apply_inserts(chats: DataFrame, messages: DataFrame, new_chats: DataFrame,
                  new_messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add chats whose id is unknown, titled by their first user message, together with their messages."""
    fresh = new_chats.join(chats.select("id"), "id", "left_anti")
    fresh_messages = new_messages.join(fresh.select(F.col("id").alias("chat_id")), "chat_id", "left_semi")
    return chats.unionByName(retitle(fresh, fresh_messages)), messages.unionByName(fresh_messages)


def changed_chats(messages: DataFrame, new_messages: DataFrame) -> DataFrame:
    """Ids of chats in ``new_messages`` whose message list differs from the stored one."""
    old = messages.join(new_messages.select("chat_id").distinct(), "chat_id", "left_semi")
    tagged = old.withColumn("side", F.lit(1)).unionByName(new_messages.withColumn("side", F.lit(-1)))
    return (
        tagged.groupBy("chat_id", "turn", "role", "content").agg(F.sum("side").alias("d")).filter("d <> 0")
        .select("chat_id").distinct()
    )


def apply_updates(chats: DataFrame, messages: DataFrame, new_messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Replace the messages of chats; returns chats, messages and the ids of chats that were written.

    A chat is written when its messages or its title changed.
    """
    known = new_messages.join(chats.select(F.col("id").alias("chat_id")), "chat_id", "left_semi")
    changed = changed_chats(messages, known)
    touched = known.select(F.col("chat_id").alias("id")).distinct()
    retitled = retitle(chats.join(touched, "id", "left_semi"), known)
    renamed = retitled.join(chats.select("id", F.col("title").alias("old_title")), "id").filter(
        ~F.col("title").eqNullSafe(F.col("old_title"))).select("id")
    kept_chats = chats.join(touched, "id", "left_anti")
    kept_messages = messages.join(changed, "chat_id", "left_anti")
    replaced = known.join(changed, "chat_id", "left_semi")
    written = changed.select(F.col("chat_id").alias("id")).unionByName(renamed).distinct()
    return kept_chats.unionByName(retitled.select(*chats.columns)), kept_messages.unionByName(replaced), written


def apply_deletes(chats: DataFrame, deletes: DataFrame) -> DataFrame:
    """Remove chats by (kind 'id', value) and all chats of users by (kind 'user', value)."""
    ids = deletes.filter("kind = 'id'").select(F.col("value").alias("id"))
    users = deletes.filter("kind = 'user'").select(F.col("value").alias("user_id"))
    return chats.join(ids, "id", "left_anti").join(users, "user_id", "left_anti")


def shared_chats(chats: DataFrame) -> DataFrame:
    return chats.filter("share_path IS NOT NULL")


def share(chats: DataFrame, ids: DataFrame) -> DataFrame:
    """Give a batch of chats their share path."""
    marked = chats.join(ids.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left")
    path = F.when(F.col("hit"), F.concat(F.lit("/share/"), "id")).otherwise(F.col("share_path"))
    return marked.withColumn("share_path", path).drop("hit")


def search_chats(chats: DataFrame, messages: DataFrame, q: str, substring: bool = False) -> DataFrame:
    """Chats whose title holds ``q`` (any case), then chats with a message equal to ``q``; a chat appears once."""
    from loomgraph.operators.search import dedup_keep_first

    by_title = chats.filter(F.contains(F.lower("title"), F.lower(F.lit(q))))
    said = F.contains(F.lower("content"), F.lower(F.lit(q))) if substring else F.col("content") == q
    ids = messages.filter(said).select(F.col("chat_id").alias("id"))
    by_message = chats.join(ids, "id", "left_semi")
    return dedup_keep_first([by_title, by_message], "id", [])


def conversation_history(messages: DataFrame) -> DataFrame:
    """All messages of a chat but the last, as speaker lines in order."""
    last = messages.groupBy("chat_id").agg(F.max("turn").alias("last_turn"))
    speaker = F.when(F.col("role") == "user", "User: ").otherwise("Assistant: ")
    return messages.join(last, "chat_id").filter(F.col("turn") < F.col("last_turn")).select(
        "chat_id", "turn", F.concat(speaker, "content").alias("line"))


def last_message(messages: DataFrame) -> DataFrame:
    return messages.groupBy("chat_id").agg(F.max_by("role", "turn").alias("role"))


def unanswered_chats(messages: DataFrame) -> DataFrame:
    return last_message(messages).filter("role = 'user'").select("chat_id")


def already_answered(messages: DataFrame, questions: DataFrame) -> DataFrame:
    """Chats (chat_id, q) whose last two messages are the user's q and an assistant's answer."""
    w = Window.partitionBy("chat_id").orderBy(F.desc("turn"))
    last_two = messages.withColumn("rn", F.row_number().over(w)).filter("rn <= 2")
    pair = last_two.groupBy("chat_id").agg(
        F.max(F.when(F.col("rn") == 1, F.col("role"))).alias("role_1"),
        F.max(F.when(F.col("rn") == 2, F.col("role"))).alias("role_2"),
        F.max(F.when(F.col("rn") == 2, F.col("content"))).alias("asked"))
    return pair.filter("role_1 = 'assistant' AND role_2 = 'user'").join(questions, "chat_id").filter(
        F.col("asked") == F.col("q")).select("chat_id")


def drop_empty_assistant(messages: DataFrame) -> DataFrame:
    return messages.filter(~((F.col("role") == "assistant") & (F.trim(F.coalesce("content", F.lit(""))) == "")))


def verify_chat_ids(ids: DataFrame, chats: DataFrame, messages: DataFrame) -> DataFrame:
    """For each id: found or not, title and message count."""
    counts = messages.groupBy(F.col("chat_id").alias("id")).agg(F.count("*").alias("messages"))
    return ids.join(chats.select("id", "title"), "id", "left").join(counts, "id", "left").select(
        "id", F.col("title").isNotNull().alias("found"), "title", F.coalesce("messages", F.lit(0)).alias("messages"))


def create_missing(ids: DataFrame, chats: DataFrame, user_id: int) -> DataFrame:
    """Chats plus an empty chat for every id that is missing."""
    rows = ids.select("id").distinct().join(chats.select("id"), "id", "left_anti")
    blanks = rows.select("id", F.lit(user_id).cast("long").alias("user_id"), F.lit("New Chat").alias("title"))
    return chats.unionByName(blanks, allowMissingColumns=True)


def repair_payload(chats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Payload id and path forced to match the row; also the ids of changed rows."""
    path = F.concat(F.lit("/chat/"), "id")
    fixed = chats.withColumn("new_payload_id", F.col("id")).withColumn("new_path", F.coalesce("path", path))
    differs = ~F.col("payload_id").eqNullSafe(F.col("new_payload_id")) | ~F.col("path").eqNullSafe(F.col("new_path"))
    changed = fixed.filter(differs).select("id")
    out = fixed.withColumn("payload_id", F.col("new_payload_id")).withColumn("path", F.col("new_path"))
    return out.select(*chats.columns), changed
