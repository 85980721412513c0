"""Service and repository connections (rest of group D), and edge repair (group E)."""

from pyspark.sql import functions as F

from loomgraph.functions import derive as D
from loomgraph.operators import cross_service as X
from loomgraph.operators import edges as E
from loomgraph.operators import repair as R
from loomgraph.operators import rollups
from loomgraph.plans.oracle_tables import contains_any_sql, is_doc_sql, register
from loomgraph.plans.registry import query
from loomgraph.projection import ACTIVE_REPO
from loomgraph.sources import scan as S

# The prose of the given tables holds no HTTP client word, so common words of its languages stand in for them.
CLIENT_WORDS = ["the", "der", "que", "la"]
OTHER_REPO = "https://git.example.org/src1.git"

register("endpoint_hits", f"""
    SELECT f.repo_url, f.service_name, f.unique_id, e.endpoint_id, e.name, e.path, e.service_name AS service,
           (e.name <> '' AND contains(f.text, e.name)) OR (e.name <> '' AND contains(f.text, replace(e.name, '_', '-'))) AS by_name,
           e.path <> '' AND contains(f.text, e.path) AS by_path, e.service_name <> '' AND contains(f.text, e.service_name) AS by_service
    FROM (SELECT repo_url, service_name, unique_id, lower(text) AS text FROM functions) f
    JOIN endpoints e ON e.service_name <> f.service_name
    WHERE {contains_any_sql('f.text', CLIENT_WORDS)}""")
register("may_call", """
    SELECT repo_url, service_name, unique_id, rule, key, count(*) AS n_endpoints FROM (
      SELECT *, 'name' AS rule, name AS key FROM endpoint_hits WHERE by_name
      UNION ALL SELECT *, 'path', path FROM endpoint_hits WHERE by_path
      UNION ALL SELECT *, 'service', service FROM endpoint_hits WHERE by_service) GROUP BY ALL""")
register("cross_imports", """
    SELECT f.repo_url AS source_repo, f.path AS source_path, t.repo_url AS target_repo, t.path AS target_path
    FROM lines l JOIN files f USING (repo_url, path) JOIN files t ON t.doc_id = (f.doc_id * 7 + l.i) % (SELECT count(*) FROM documents)""")
register("communicates", """
    SELECT DISTINCT a.service_name AS src, b.service_name AS dst, 'api_call' AS type
    FROM cross_imports i JOIN files a ON a.repo_url = i.source_repo AND a.path = i.source_path
    JOIN files b ON b.repo_url = i.target_repo AND b.path = i.target_path
    WHERE a.service_name <> b.service_name AND b.service_name IN (SELECT service_name FROM endpoints)""")
register("shares_model", """
    SELECT a.service_name AS src, b.service_name AS dst, count(*) AS n FROM data_models a JOIN data_models b USING (name)
    WHERE a.service_name <> b.service_name GROUP BY ALL""")
register("repo_pairs", """
    SELECT DISTINCT 'https://git.example.org/' || src || '.git' AS source_url, 'https://git.example.org/' || dst || '.git' AS target_url, rel AS connection_type
    FROM (SELECT src, dst, 'COMMUNICATES_WITH' AS rel FROM communicates UNION ALL SELECT src, dst, 'SHARES_MODEL_WITH' FROM shares_model)
    WHERE src IN (SELECT name FROM services) AND dst IN (SELECT name FROM services)""")
register("connected", f"""
    SELECT DISTINCT repo_url FROM (
      SELECT m.repo_url FROM may_call m JOIN endpoints e ON e.repo_url = '{ACTIVE_REPO}' AND
        ((m.rule = 'name' AND m.key = e.name) OR (m.rule = 'path' AND m.key = e.path) OR (m.rule = 'service' AND m.key = e.service_name))
      UNION ALL SELECT b.repo_url FROM data_models a JOIN data_models b USING (name) WHERE a.repo_url = '{ACTIVE_REPO}'
      UNION ALL SELECT m.repo_url FROM endpoints e JOIN data_models m ON m.model_id = e.endpoint_id WHERE e.repo_url = '{ACTIVE_REPO}')
    WHERE repo_url <> '{ACTIVE_REPO}'""")


def callers(g, of_repo=None, to_repo=None, **kind):
    """Callers of endpoints; only those of one repository, or of endpoints of one repository, where asked. ``kind``: of may_call."""
    functions = g.functions if of_repo is None else g.functions.filter(F.col("repo_url") == of_repo)
    endpoints = g.endpoints if to_repo is None else g.endpoints.filter(F.col("repo_url") == to_repo)
    return X.may_call(functions.withColumn("text", F.lower("text")), endpoints, CLIENT_WORDS, **kind)


def cross_imports(g):
    n_docs = g.table("documents").agg(F.count("*")).scalar()
    t = g.files.select(F.col("doc_id").alias("t"), F.col("repo_url").alias("target_repo"), F.col("path").alias("target_path"))
    return (
        g.files.select("doc_id", F.col("repo_url").alias("source_repo"), F.col("path").alias("source_path"),
                       F.posexplode(F.split("content", "\n")).alias("i", "l"))
        .withColumn("t", (F.col("doc_id") * 7 + F.col("i")) % n_docs).join(t, "t")
        .select("source_repo", "source_path", "target_repo", "target_path"))


def communicates(g):
    return X.communicates_with(cross_imports(g), g.files, g.endpoints)


def endpoint_models(g):
    return g.endpoints.select("endpoint_id", F.col("endpoint_id").alias("model_id"))


def connected(g, repo_url=ACTIVE_REPO):
    return X.connected_repositories(g.repositories, callers(g, to_repo=repo_url, ids=["repo_url", "service_name"]), g.endpoints,
                                    g.data_models, endpoint_models(g), repo_url)


def repo_edges(g):
    return X.repository_edges({"COMMUNICATES_WITH": communicates(g), "SHARES_MODEL_WITH": X.shares_model_with(g.data_models)},
                              g.services)


query("d17_may_call_edges", "SELECT repo_url, service_name, unique_id, rule, key, n_endpoints FROM may_call")(callers)
query("d18_similar_models", """
    SELECT name, service_name, n_models, total - n_models AS n_similar, n_services FROM (
      SELECT name, service_name, count(*) AS n_models FROM data_models GROUP BY ALL)
    JOIN (SELECT name, count(*) AS total, count(DISTINCT service_name) AS n_services FROM data_models GROUP BY ALL) USING (name)
    WHERE n_services > 1""")(lambda g: X.similar_models(g.data_models))
query("d19_communicates_with", "SELECT src, dst, type FROM communicates")(communicates)
query("d20_connected_repositories", """
    SELECT url, service_name, description FROM repositories WHERE url IN (SELECT repo_url FROM connected)""")(connected)
query("d21_repo_connections", """
    SELECT source_url, a.service_name AS source_name, target_url, b.service_name AS target_name, connection_type, 1 AS strength
    FROM repo_pairs JOIN repositories a ON a.url = source_url JOIN repositories b ON b.url = target_url""")(
    lambda g: X.repo_connections(repo_edges(g), g.repositories))
query("d22_connection_details", f"""
    SELECT 'api_call' AS kind, unique_id AS source_item, m.key AS target_item, 1 AS n_source, count(*) AS n_target
    FROM may_call m JOIN endpoints e ON e.repo_url = '{OTHER_REPO}' AND
      ((m.rule = 'name' AND m.key = e.name) OR (m.rule = 'path' AND m.key = e.path) OR (m.rule = 'service' AND m.key = e.service_name))
    WHERE m.repo_url = '{ACTIVE_REPO}' GROUP BY ALL
    UNION ALL
    SELECT 'shared_model', name, name, a.n, b.n FROM (SELECT name, count(*) AS n FROM data_models WHERE repo_url = '{ACTIVE_REPO}' GROUP BY ALL) a
    JOIN (SELECT name, count(*) AS n FROM data_models WHERE repo_url = '{OTHER_REPO}' GROUP BY ALL) b USING (name)""")(
    lambda g: X.connection_details(callers(g, ACTIVE_REPO, OTHER_REPO), g.endpoints, g.data_models, ACTIVE_REPO, OTHER_REPO))
query("d23_dependency_mentions", """
    WITH mention AS (
      SELECT c.repo_url, c.file_path AS a, f.path AS b, count(*) AS m FROM code_chunks c JOIN files f
        ON f.repo_url = c.repo_url AND f.path <> c.file_path AND contains(c.content, f.path) GROUP BY ALL),
    pair AS (SELECT repo_url, a AS source, b AS target FROM mention UNION SELECT repo_url, b, a FROM mention),
    held AS (SELECT repo_url, file_path, count(*) AS n FROM code_chunks GROUP BY ALL)
    SELECT p.repo_url, p.source, p.target,
           (coalesce(x.m, 0) * h2.n + coalesce(y.m, 0) * h1.n - coalesce(x.m, 0) * coalesce(y.m, 0))::BIGINT AS strength
    FROM pair p JOIN held h1 ON h1.repo_url = p.repo_url AND h1.file_path = p.source JOIN held h2 ON h2.repo_url = p.repo_url AND h2.file_path = p.target
    LEFT JOIN mention x ON x.repo_url = p.repo_url AND x.a = p.source AND x.b = p.target
    LEFT JOIN mention y ON y.repo_url = p.repo_url AND y.a = p.target AND y.b = p.source
    ORDER BY strength DESC, 1, 2, 3 LIMIT 25""")(
    lambda g: X.dependency_mentions(g.code_chunks, g.files))
query("d24_keyword_scoped_query", f"""
    SELECT repo_url, path FROM files f WHERE EXISTS (SELECT 1 FROM chunks c WHERE c.repo_url = f.repo_url AND c.file_path = f.path
      AND {contains_any_sql('c.content', ['whst', 'ouè'])})""")(
    lambda g: X.keyword_scoped(g.files, g.chunks, ["whst", "ouè"]).select("repo_url", "path"))
query("d29_repo_list_active", "SELECT url, service_name, description, is_active FROM repositories")(
    lambda g: X.repo_list_active(g.repositories))
query("f14_calls_service_weight", """
    SELECT service_name AS src, service AS dst, count(*) AS n FROM endpoint_hits WHERE by_name OR by_path OR by_service
    GROUP BY ALL""")(lambda g: X.calls_service(callers(g, grouped=True), g.endpoints))
query("f14_shares_model_weight", "SELECT src, dst, n FROM shares_model")(lambda g: X.shares_model_with(g.data_models))
query("f14_accumulate_weights", """
    SELECT 'u' || user_id AS src, event_type AS dst, count(*) AS n,
           strftime(coalesce(min(ts) FILTER (WHERE event_id % 2 = 1), min(ts)), '%Y-%m-%d %H:%M:%S') AS first_detected,
           strftime(coalesce(max(ts) FILTER (WHERE event_id % 2 = 0), max(ts)), '%Y-%m-%d %H:%M:%S') AS last_updated
    FROM events GROUP BY ALL""")(lambda g: _accumulated(g))


def _accumulated(g):
    e = g.table("events").select("event_id", F.concat(F.lit("u"), "user_id").alias("src"), F.col("event_type").alias("dst"),
                                 F.col("ts").alias("at"))
    stored = e.filter("event_id % 2 = 1").groupBy("src", "dst").agg(
        F.count("*").alias("n"), F.min("at").alias("first_detected"), F.max("at").alias("last_updated"))
    out = rollups.accumulate_weights(e.filter("event_id % 2 = 0"), stored)
    fmt = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("src", "dst", "n", fmt("first_detected"), fmt("last_updated"))


# --- repair ----------------------------------------------------------------------------------------------
COLS = "repo_url, src_label, src_id, rel, dst_label, dst_id"


def _lost(where: str) -> str:
    """Edges of the whole graph that the damaged store lacks, of one kind."""
    return f"SELECT {COLS} FROM edges WHERE substring(md5(src_id || dst_id), 1, 1) <= '3' AND {where}"


def _fix(name: str, where: str, fn) -> None:
    query(name, _lost(where))(fn)


_fix("e01_repair_file_repo", "src_label = 'File' AND dst_label = 'Repository'",
     lambda g: R.to_repository(g.files, "File", "path", g.repositories, g.stored_edges))
_fix("e02_repair_dir_repo", "src_label = 'Directory' AND dst_label = 'Repository'",
     lambda g: R.to_repository(S.directory_closure(g.files), "Directory", "dir_path", g.repositories, g.stored_edges))
_fix("e03_repair_dir_file", "src_label = 'Directory' AND dst_label = 'File'",
     lambda g: R.dir_to_file(S.directory_closure(g.files), g.files, g.stored_edges))
_fix("e04_repair_dir_dir", "src_label = 'Directory' AND dst_label = 'Directory'",
     lambda g: R.dir_to_dir(S.directory_closure(g.files), g.stored_edges))
_fix("e06_repair_symbol_file", "src_label = 'File' AND dst_label IN ('Function', 'Class')",
     lambda g: R.file_to_symbol(g.files, g.symbols, g.stored_edges))
_fix("e08_repair_chunk_file", "src_label = 'File' AND dst_label = 'CodeChunk'",
     lambda g: R.file_to_chunk(g.files, g.chunks, g.stored_edges))
_fix("e09_repair_chunk_repo", "src_label = 'CodeChunk' AND dst_label = 'Repository'",
     lambda g: R.to_repository(g.chunks, "CodeChunk", "chunk_id", g.repositories, g.stored_edges))
_fix("e12_repair_symbol_repo", "src_label IN ('Function', 'Class') AND dst_label = 'Repository'",
     lambda g: R.to_repository(g.symbols, F.col("label"), "unique_id", g.repositories, g.stored_edges))

register("lost_symbols", """
    SELECT * REPLACE (CASE WHEN substring(md5(unique_id), 1, 1) <= '7' THEN NULL ELSE file_path END AS file_path) FROM symbols""")


def lost_symbols(g):
    return g.symbols.withColumn("file_path", F.when(F.substring(F.md5("unique_id"), 1, 1) > "7", F.col("file_path")))


query("e05_backfill_symbol_path", """
    SELECT s.repo_url, s.label, s.unique_id, coalesce(s.file_path, p.file_path) AS file_path FROM lost_symbols s LEFT JOIN (
      SELECT e.repo_url, e.src_id AS unique_id, min(c.file_path) AS file_path FROM stored_edges e JOIN chunks c ON c.repo_url = e.repo_url AND c.chunk_id = e.dst_id
      WHERE e.dst_label = 'CodeChunk' AND e.rel = 'CONTAINS' AND e.src_label <> 'File' GROUP BY ALL) p USING (repo_url, unique_id)""")(
    lambda g: R.backfill_symbol_path(lost_symbols(g), g.chunks, g.stored_edges).select("repo_url", "label", "unique_id", "file_path"))
query("e07_repair_symbol_file_via_chunk", f"""
    SELECT DISTINCT s.repo_url, 'File' AS src_label, c.file_path AS src_id, 'CONTAINS' AS rel, s.label AS dst_label, s.unique_id AS dst_id
    FROM lost_symbols s JOIN chunks c ON c.repo_url = s.repo_url AND contains(c.parent_id, s.unique_id)
    WHERE s.file_path IS NULL EXCEPT SELECT {COLS} FROM stored_edges""")(
    lambda g: R.file_to_symbol_via_chunk(lost_symbols(g), g.chunks, g.stored_edges)[0])
query("e10_repair_symbol_chunk_by_id", f"""
    SELECT DISTINCT s.repo_url, s.label AS src_label, s.unique_id AS src_id, 'CONTAINS' AS rel, 'CodeChunk' AS dst_label, c.chunk_id AS dst_id
    FROM symbols s JOIN chunks c ON c.repo_url = s.repo_url AND contains(c.parent_id, s.unique_id)
    EXCEPT SELECT {COLS} FROM stored_edges""")(
    lambda g: R.symbol_to_chunk_by_id(g.symbols, g.chunks, g.stored_edges))
query("e10_ambiguous_chunks", """
    SELECT c.repo_url, c.chunk_id, count(*) AS n_symbols FROM symbols s JOIN chunks c
      ON c.repo_url = s.repo_url AND contains(c.parent_id, s.unique_id) GROUP BY ALL HAVING count(*) > 1""")(
    lambda g: R.ambiguous_chunks(g.symbols, g.chunks))
for _label, _other in (("Class", "Function"), ("Function", "Class")):
    query(f"e11_repair_{_label.lower()}_chunk_by_range", f"""
        SELECT DISTINCT s.repo_url, s.label AS src_label, s.unique_id AS src_id, 'CONTAINS' AS rel, 'CodeChunk' AS dst_label, c.chunk_id AS dst_id
        FROM symbols s JOIN chunks c ON c.repo_url = s.repo_url AND c.file_path = s.file_path
          AND s.start_line <= c.start_line AND s.end_line >= c.end_line
        WHERE s.label = '{_label}' AND NOT EXISTS (SELECT 1 FROM stored_edges e WHERE e.repo_url = c.repo_url AND e.dst_id = c.chunk_id
          AND e.dst_label = 'CodeChunk' AND e.rel = 'CONTAINS' AND e.src_label = '{_other}')
        EXCEPT SELECT {COLS} FROM stored_edges""")(
        lambda g, label=_label: R.symbol_to_chunk_by_range(g.symbols, g.chunks, g.stored_edges, label))
query("e13_canonicalise_repo_url", """
    SELECT repo_url, count(*) AS n, 'File' AS type FROM files WHERE contains(repo_url, 'src1') AND repo_url <> 'https://git.example.org/src1.git' GROUP BY ALL
    UNION ALL SELECT repo_url, count(*), 'CodeChunk' FROM chunks WHERE contains(repo_url, 'src1') AND repo_url <> 'https://git.example.org/src1.git' GROUP BY ALL
    UNION ALL SELECT url, count(*), 'Repository' FROM repositories WHERE contains(url, 'src1') AND url <> 'https://git.example.org/src1.git' GROUP BY ALL""")(
    lambda g: R.canonicalise_repo_url({"File": g.files, "CodeChunk": g.chunks,
                                       "Repository": g.repositories.withColumnRenamed("url", "repo_url")},
                                      "src1", OTHER_REPO)[1])
query("e13_rewritten_files", """
    SELECT path, CASE WHEN contains(repo_url, 'src1') THEN 'https://git.example.org/src1.git' ELSE repo_url END AS repo_url FROM files""")(
    lambda g: R.canonicalise_repo_url({"File": g.files}, "src1", OTHER_REPO)[0]["File"].select("path", "repo_url"))
query("e14_mark_documentation", f"""
    SELECT repo_url, path, {is_doc_sql('path', "regexp_extract(path, '[^.]*$')")} AS is_documentation FROM files""")(
    lambda g: R.mark_documentation(g.files.withColumn("is_documentation", F.lit(None).cast("boolean")), g.stored_edges)[0]
    .select("repo_url", "path", "is_documentation"))
query("e14_unchunked_readmes", """
    SELECT repo_url, path FROM files f WHERE contains(upper(path), 'README') AND NOT EXISTS (
      SELECT 1 FROM stored_edges e WHERE e.src_label = 'File' AND e.dst_label = 'CodeChunk' AND e.repo_url = f.repo_url AND e.src_id = f.path)""")(
    lambda g: R.mark_documentation(g.files, g.stored_edges)[1])
query("e15_repair_chat_payload", """
    SELECT id, id AS payload_id, coalesce(path, '/chat/' || id) AS path,
           payload_id IS DISTINCT FROM id OR path IS NULL AS changed FROM chats""")(lambda g: _payload(g))
query("e_fixed_counts", """
    SELECT job, count(dst_id) AS fixed_count FROM (VALUES ('file_repo'), ('dir_file'), ('chunk_file')) j(job)
    LEFT JOIN (SELECT CASE WHEN src_label = 'File' AND dst_label = 'Repository' THEN 'file_repo' WHEN src_label = 'Directory' AND dst_label = 'File' THEN 'dir_file'
      WHEN src_label = 'File' AND dst_label = 'CodeChunk' THEN 'chunk_file' END AS job, dst_id FROM edges WHERE substring(md5(src_id || dst_id), 1, 1) <= '3') USING (job)
    GROUP BY ALL""")(lambda g: R.fixed_counts({
        "file_repo": R.to_repository(g.files, "File", "path", g.repositories, g.stored_edges),
        "dir_file": R.dir_to_file(S.directory_closure(g.files), g.files, g.stored_edges),
        "chunk_file": R.file_to_chunk(g.files, g.chunks, g.stored_edges)}))


def _payload(g):
    from loomgraph.operators.chats import repair_payload

    fixed, changed = repair_payload(g.chats)
    return fixed.join(changed.withColumn("c", F.lit(True)), "id", "left").select(
        "id", "payload_id", "path", F.coalesce("c", F.lit(False)).alias("changed"))
