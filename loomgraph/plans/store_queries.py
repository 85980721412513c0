"""Upserts and deletes (rest of group A), chats (group M) and streams (group N)."""

from pyspark.sql import functions as F

from loomgraph.operators import audit
from loomgraph.operators import chats as M
from loomgraph.operators.edges import union_all
from loomgraph.plans.oracle_tables import register
from loomgraph.plans.registry import query
from loomgraph.plans.report_queries import node_tables
from loomgraph.projection import ACTIVE_REPO
from loomgraph.sources import store as S
from loomgraph.sources.scan import directory_closure
from loomgraph.streaming import feeds as N

EDGES = "repo_url, src_label, src_id, rel, dst_label, dst_id"
CHAT = "id, user_id, title, created_at, share_path, payload_id, path"
KEY = {"Repository": "url", "Service": "name", "File": "path", "Function": "unique_id", "Class": "unique_id",
       "CodeChunk": "chunk_id", "ApiEndpoint": "endpoint_id", "DataModel": "model_id"}


def nodes(g):
    return union_all([t.select("repo_url", F.lit(label).alias("label"), F.col(KEY[label]).cast("string").alias("id"))
                      for label, t in node_tables(g).items()])


def with_directories(g):
    return nodes(g).unionByName(directory_closure(g.files).select("repo_url", F.lit("Directory").alias("label"), F.col("dir_path").alias("id")))


query("a07_upsert_nodes", """
    SELECT coalesce(s.path, n.path) AS path, coalesce(n.language, s.language) AS language, coalesce(n.size, s.size) AS size FROM (
      SELECT path, language, size FROM files WHERE doc_id % 3 <> 0) s FULL JOIN (
      SELECT path, CASE WHEN doc_id % 2 = 0 THEN upper(language) END AS language, CASE WHEN doc_id % 5 = 0 THEN size * 2 END AS size FROM files
      WHERE doc_id % 4 <> 1 AND (doc_id % 2 = 0 OR doc_id % 5 = 0)) n ON n.path = s.path""")(
    lambda g: S.upsert_nodes(
        g.files.filter("doc_id % 3 <> 0").select("path", "language", "size"),
        g.files.filter("doc_id % 4 <> 1").select(
            "path", F.when(F.col("doc_id") % 2 == 0, F.upper("language")).alias("language"),
            F.when(F.col("doc_id") % 5 == 0, F.col("size") * 2).alias("size")), ["path"]))
query("a08_upsert_edges", f"SELECT DISTINCT {EDGES} FROM edges")(lambda g: S.upsert_edges(g.stored_edges, g.edges))
query("a09_delete_repo_cascade", f"SELECT repo_url, type AS label, id FROM nodes WHERE repo_url <> '{ACTIVE_REPO}'")(
    lambda g: S.delete_repo_cascade(nodes(g), g.edge_table, ACTIVE_REPO)[0])
query("a09_delete_repo_edges", f"SELECT {EDGES} FROM edges WHERE repo_url <> '{ACTIVE_REPO}'")(
    lambda g: S.delete_repo_cascade(with_directories(g), g.edge_table, ACTIVE_REPO)[1])
query("a10_delete_repo_by_property", f"SELECT repo_url, type AS label, id FROM nodes WHERE repo_url <> '{ACTIVE_REPO}'")(
    lambda g: S.delete_repo_by_property(nodes(g), g.edges, ACTIVE_REPO)[0])
query("a12_report_sink")(lambda g: S.report_json(audit.fallback_report(g.chunks, g.stored_edges)))
query("a13_import_chats_json", """
    SELECT chat_id::VARCHAR || '-' || turn AS id, 'New ' || role AS title, 'me' AS "userId", 1 AS n_messages, content FROM messages WHERE turn % 3 <> 2""")(
    lambda g: _imported(g))


def _imported(g):
    """Message rows written as JSON chat rows: some with a payload, some bare, some without an id."""
    mid = F.concat_ws("-", "chat_id", "turn")
    body = F.struct(F.when(F.col("turn") % 3 != 2, mid).alias("id"), F.concat(F.lit("New "), "role").alias("title"),
                    F.array(F.struct("role", "content")).alias("messages"))
    text = F.when(F.col("turn") % 3 == 0, F.to_json(F.struct(F.lit("row").alias("id"), body.alias("payload")))).otherwise(F.to_json(body))
    rows = g.messages.select(F.from_json(text, S.CHAT_ROW).alias("r")).select("r.*")
    return S.chats_of_rows(rows, "me").select("id", "title", "userId", F.size("messages").alias("n_messages"),
                                              F.col("messages")[0]["content"].alias("content"))


query("a14_chats_sample_export", "SELECT id, title, created_at FROM chats ORDER BY created_at DESC, id LIMIT 10")(
    lambda g: S.chats_sample(g.chats).select("id", "title", "created_at"))

# --- chats -----------------------------------------------------------------------------------------------
query("m01_chats_by_user", "SELECT id, title, created_at, payload_id FROM chats WHERE user_id = 4")(
    lambda g: M.chats_by_user(g.chats, 4).select("id", "title", "created_at", "payload_id"))
query("m02_chat_by_id", """
    SELECT req_id, req_user, id, title FROM (SELECT r.req_id, r.user_id AS req_user, c.id, c.title,
        row_number() OVER (PARTITION BY r.req_id, r.user_id ORDER BY CASE WHEN c.id = r.req_id THEN 1 ELSE 2 END, c.id) AS rn
      FROM (SELECT id * 2 AS req_id, user_id FROM chats UNION SELECT id * 2, user_id + 1 FROM chats UNION SELECT payload_id, user_id FROM chats) r JOIN chats c ON c.id = r.req_id OR (c.payload_id = r.req_id AND c.user_id = r.user_id)) WHERE rn = 1""")(
    lambda g: M.chat_by_id(g.chats, _chat_requests(g)).select("req_id", "req_user", "id", "title"))


def _chat_requests(g):
    """Every second id, asked for by two users, and every payload id."""
    twice = g.chats.select((F.col("id") * 2).alias("req_id"), F.explode(F.array("user_id", F.col("user_id") + 1)).alias("user_id"))
    return twice.union(g.chats.select("payload_id", "user_id"))


register("new_chats", """
    SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN id ELSE id + 1000000 END AS id, 'New Chat' AS title) FROM chats""")


def new_chats(g):
    new_id = lambda c: F.when(F.col(c) % 3 == 0, F.col(c)).otherwise(F.col(c) + 1000000)
    return (g.chats.withColumn("id", new_id("id")).withColumn("title", F.lit("New Chat")),
            g.messages.withColumn("chat_id", new_id("chat_id")))


query("m03_apply_chat_inserts", f"""
    SELECT id, title FROM chats UNION ALL
    SELECT c.id + 1000000, coalesce(CASE WHEN length(f) > 30 THEN substring(f, 1, 30) || '...' ELSE f END, 'New Chat') FROM chats c LEFT JOIN (
      SELECT chat_id, arg_min(content, turn) AS f FROM messages WHERE role = 'user' GROUP BY ALL) m ON m.chat_id = c.id WHERE c.id % 3 <> 0""")(
    lambda g: M.apply_inserts(g.chats, g.messages, *new_chats(g))[0].select("id", "title"))
query("m03_inserted_messages", """
    SELECT chat_id, turn, role FROM messages UNION ALL SELECT chat_id + 1000000, turn, role FROM messages WHERE chat_id % 3 <> 0""")(
    lambda g: M.apply_inserts(g.chats, g.messages, *new_chats(g))[1].select("chat_id", "turn", "role"))


def updates(g):
    """New message lists for every second chat; half of them say something new."""
    return g.messages.filter("chat_id % 2 = 0").withColumn(
        "content", F.when(F.col("chat_id") % 4 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))


query("m04_apply_chat_updates", """
    SELECT c.id, CASE WHEN c.title = 'New Chat' AND c.id % 2 = 0 THEN coalesce(CASE WHEN length(f) > 30 THEN substring(f, 1, 30) || '...' ELSE f END, c.title) ELSE c.title END AS title
    FROM chats c LEFT JOIN (SELECT chat_id, arg_min(content || CASE WHEN chat_id % 4 = 0 THEN '!' ELSE '' END, turn) AS f FROM messages WHERE role = 'user' GROUP BY ALL) m ON m.chat_id = c.id""")(
    lambda g: M.apply_updates(g.chats, g.messages, updates(g))[0].select("id", "title"))
query("m04_updated_messages", """
    SELECT chat_id, turn, role, content || CASE WHEN chat_id % 4 = 0 THEN '!' ELSE '' END AS content FROM messages""")(
    lambda g: M.apply_updates(g.chats, g.messages, updates(g))[1].select("chat_id", "turn", "role", "content"))
query("m04_written_chats", """
    SELECT id FROM chats c WHERE id % 4 = 0 OR (id % 2 = 0 AND title = 'New Chat' AND EXISTS (SELECT 1 FROM messages m WHERE m.chat_id = c.id AND role = 'user'
      AND content <> 'New Chat'))""")(lambda g: M.apply_updates(g.chats, g.messages, updates(g))[2])
query("m05_apply_chat_deletes", "SELECT id FROM chats WHERE id % 7 <> 3 AND user_id <> 6")(
    lambda g: M.apply_deletes(g.chats, g.chats.filter("id % 7 = 3").select(F.lit("id").alias("kind"), F.col("id").alias("value")).unionByName(
        g.chats.filter("user_id = 6").select(F.lit("user").alias("kind"), F.col("user_id").alias("value")))).select("id"))
query("m06_shared_chats", "SELECT id, share_path FROM chats WHERE share_path IS NOT NULL")(
    lambda g: M.shared_chats(g.chats).select("id", "share_path"))
query("m06_share", "SELECT id, CASE WHEN id % 3 = 0 THEN '/share/' || id ELSE share_path END AS share_path FROM chats")(
    lambda g: M.share(g.chats, g.chats.filter("id % 3 = 0").select("id")).select("id", "share_path"))
query("m07_search_chats", """
    SELECT id, CASE WHEN contains(lower(title), 'ti') THEN 0 ELSE 1 END AS source_no FROM chats c WHERE contains(lower(title), 'ti')
      OR EXISTS (SELECT 1 FROM messages m WHERE m.chat_id = c.id AND m.content = 'TI')""")(
    lambda g: M.search_chats(g.chats, g.messages, "TI").select("id", "source_no"))
query("m07_search_chats_substring", """
    SELECT id, CASE WHEN contains(lower(title), 'tion') THEN 0 ELSE 1 END AS source_no FROM chats c WHERE contains(lower(title), 'tion')
      OR EXISTS (SELECT 1 FROM messages m WHERE m.chat_id = c.id AND contains(lower(m.content), 'tion'))""")(
    lambda g: M.search_chats(g.chats, g.messages, "tion", substring=True).select("id", "source_no"))
query("m08_conversation_history", """
    SELECT chat_id, turn, CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || content AS line FROM messages m
    WHERE turn < (SELECT max(turn) FROM messages x WHERE x.chat_id = m.chat_id)""")(lambda g: M.conversation_history(g.messages))
query("m09_unanswered_chats", "SELECT chat_id FROM messages GROUP BY chat_id HAVING arg_max(role, turn) = 'user'")(
    lambda g: M.unanswered_chats(g.messages))
query("m10_already_answered", """
    SELECT a.chat_id FROM messages a JOIN messages b ON b.chat_id = a.chat_id AND b.turn = a.turn + 1
    WHERE a.role = 'user' AND b.role = 'assistant' AND b.turn = (SELECT max(turn) FROM messages x WHERE x.chat_id = a.chat_id)""")(
    lambda g: M.already_answered(g.messages, g.messages.filter("role = 'user'").select("chat_id", F.col("content").alias("q"))).distinct())
query("m11_drop_empty_assistant", """
    SELECT chat_id, turn, role, CASE WHEN turn % 4 = 1 THEN '  ' ELSE content END AS content FROM messages WHERE NOT (role = 'assistant' AND turn % 4 = 1)""")(
    lambda g: M.drop_empty_assistant(g.messages.withColumn("content", F.when(F.col("turn") % 4 == 1, "  ").otherwise(F.col("content")))))
query("m12_verify_chat_ids", """
    SELECT i.id, c.id IS NOT NULL AS found, c.title, coalesce(c.n_messages, 0) AS messages FROM (SELECT id * 2 AS id FROM chats) i LEFT JOIN chats c USING (id)""")(
    lambda g: M.verify_chat_ids(g.chats.select((F.col("id") * 2).alias("id")), g.chats, g.messages))
query("m12_create_missing", """
    SELECT id, user_id, title FROM chats UNION ALL SELECT id * 2, 77, 'New Chat' FROM chats WHERE id * 2 NOT IN (SELECT id FROM chats)""")(
    lambda g: M.create_missing(g.chats.select((F.col("id") * 2).alias("id")), g.chats, 77).select("id", "user_id", "title"))

# --- streams ---------------------------------------------------------------------------------------------
register("changes", """
    SELECT event_id, ts, user_id AS chat_id, value, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS op
    FROM events WHERE event_type <> 'view'""")
AT = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"
query("n01_chat_change_feed", f"""
    SELECT chat_id, {AT} AS at, event_id, op, value FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY ts DESC, event_id DESC) AS rn FROM changes) WHERE rn = 1""")(
    lambda g: N.follow_changes(g.spark, N.read_changes(g.spark, g.sf_dir)))
query("n02_debounced_save", f"""
    SELECT chat_id, arg_max({AT}, (ts, event_id)) AS at, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value, count(*) AS changes FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY chat_id ORDER BY ts, event_id) AS session FROM (
        SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY chat_id ORDER BY ts, event_id) + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM changes))
    GROUP BY chat_id, session""")(
    lambda g: N.materialize_stream(N.debounced_saves(N.read_changes(g.spark, g.sf_dir), "10 minutes")))
query("n03_throttled_refresh", f"""
    SELECT chat_id, arg_min({AT}, (ts, event_id)) AS at, arg_min(event_id, (ts, event_id)) AS event_id, count(*) AS changes
    FROM changes GROUP BY chat_id, time_bucket(INTERVAL 1 HOUR, ts)""")(
    lambda g: N.materialize_stream(N.throttled_refreshes(N.read_changes(g.spark, g.sf_dir), "1 hour")))
query("n05_background_ingest_queue", "SELECT DISTINCT 'repo' || user_id AS url FROM events")(lambda g: _accepted(g))


def _accepted(g):
    """Every event asks for a repository; within the watermark each repository is accepted once."""
    requests = N.read_events(g.spark, g.sf_dir).select(
        F.concat(F.lit("repo"), "user_id").alias("url"), F.col("ts").cast("timestamp").alias("requested_at"))
    return N.materialize_stream(N.accepted_requests(requests, "400 days").select("url"), "append")


query("n04_incremental_ingest_status", """
    SELECT url, CASE WHEN last_indexed_commit_sha <> current_sha OR is_active THEN current_sha ELSE last_indexed_commit_sha END AS last_indexed_commit_sha,
           last_indexed_commit_sha <> current_sha OR is_active AS reloaded FROM repositories""")(lambda g: _ingested(g)[1])
query("n04_incremental_ingest_files", """
    SELECT f.repo_url, f.path, CASE WHEN r.last_indexed_commit_sha <> r.current_sha OR r.is_active THEN f.content_hash ELSE 'old' END AS content_hash
    FROM files f JOIN repositories r ON r.url = f.repo_url""")(lambda g: _ingested(g)[0])


def _ingested(g):
    scanned = g.files.select("repo_url", "path", "content_hash")
    return N.ingest_changed(g.repositories.select("url", "current_sha", F.col("is_active").alias("force")),
                            g.repositories.select("url", "last_indexed_commit_sha"), scanned,
                            scanned.withColumn("content_hash", F.lit("old")))
