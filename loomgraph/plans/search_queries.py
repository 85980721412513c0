"""Retrieval and set operations (groups H and I, and the text roll-ups F27 and F30)."""

from pyspark.sql import functions as F

from loomgraph import constants as K
from loomgraph.constants import TOPIC_WORDS as _TW
from loomgraph.functions import derive as D
from loomgraph.operators import rollups as R
from loomgraph.operators import search as H
from loomgraph.operators.edges import union_all
from loomgraph.plans.connection_queries import connected
from loomgraph.plans.oracle_tables import contains_any_sql, doc_boost_sql, priority_sql, register
from loomgraph.plans.registry import query
from loomgraph.projection import ACTIVE_REPO

# Questions of the flagship query; each takes the vector of the same number as its embedding.
QUESTIONS = ["overview of the services", "project structure", "what is this about", "dependency graph",
             "how does en m3 work"]
# The prose of the given tables holds few of the topic words, so topical queries use these.
TOPICS = {"first": ["tion", "eren"], "second": ["hat ", "ouè"]}


def questions(g):
    texts = F.array(*map(F.lit, QUESTIONS))
    return g.table("embeddings").filter(F.col("vec_id") < len(QUESTIONS)).select(
        F.concat(F.lit("q"), "vec_id").alias("query_id"),
        F.element_at(texts, (F.col("vec_id") + 1).cast("int")).alias("question"), "embedding")


def many_questions(g, k=10):
    """One question per labelled vector: every vector of the table asks."""
    return g.table("embeddings").select(F.concat(F.lit("v"), "vec_id").alias("query_id"), "embedding", F.lit(k).alias("k"))


def one_question(g, k):
    return questions(g).filter("query_id = 'q0'").select("query_id", "embedding", F.lit(k).alias("k"))


COSINE = "(1 + list_cosine_similarity(list_transform(c.embedding, lambda x: x::DOUBLE), list_transform(q.embedding, lambda x: x::DOUBLE))) / 2"
register("questions", "SELECT 'q' || vec_id AS query_id, ([" + ", ".join(f"'{t}'" for t in QUESTIONS)
         + f"])[vec_id + 1] AS question, embedding FROM embeddings WHERE vec_id < {len(QUESTIONS)}")
register("scored", f"""
    SELECT q.query_id, c.repo_url, c.file_path, c.start_line, c.chunk_id, c.is_documentation, round({COSINE}, 6) AS score
    FROM embedded_chunks c JOIN questions q ON true""")
register("top_one", """
    SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC, file_path, start_line, repo_url, chunk_id) AS rn FROM scored WHERE query_id = 'q0') WHERE rn <= 10""")
HIT = "query_id, repo_url, file_path, start_line, chunk_id, score, rn"

query("h01_vector_topk", "SELECT t.query_id, t.repo_url, t.file_path AS path, t.start_line, t.score, c.content AS text FROM top_one t JOIN embedded_chunks c USING (repo_url, chunk_id)")(
    lambda g: H.attach_text(H.vector_topk(g.embedded_chunks, one_question(g, 10)), g.embedded_chunks).select(
        "query_id", "repo_url", F.col("file_path").alias("path"), "start_line", "score", "text"))
query("h01_vector_topk_in_repo", f"""
    SELECT {HIT} FROM (SELECT *, row_number() OVER (ORDER BY score DESC, file_path, start_line, repo_url, chunk_id) AS rn FROM scored
      WHERE query_id = 'q0' AND repo_url = '{ACTIVE_REPO}') WHERE rn <= 5""")(
    lambda g: H.vector_topk(g.embedded_chunks, one_question(g, 5), ACTIVE_REPO).select(*HIT.split(", ")))
query("h02_boosted_vector_topk", f"""
    SELECT query_id, repo_url, file_path, start_line, chunk_id, score, row_number() OVER (ORDER BY score DESC, file_path, start_line, repo_url, chunk_id) AS rn
    FROM (SELECT * REPLACE (round({doc_boost_sql('file_path', 'is_documentation', 'score')}, 6) AS score) FROM top_one) WHERE score > 0.4""")(
    lambda g: H.boost_hits(H.vector_topk(g.embedded_chunks, one_question(g, 10)), g.files, ["query_id"]).select(*HIT.split(", ")))
query("h03_vector_topk_many", f"""
    SELECT {HIT} FROM (SELECT *, row_number() OVER (PARTITION BY query_id, repo_url ORDER BY score DESC, file_path, start_line, chunk_id) AS rn FROM (
      SELECT 'v' || q.vec_id AS query_id, c.repo_url, c.file_path, c.start_line, c.chunk_id, round({COSINE}, 6) AS score FROM embedded_chunks c JOIN embeddings q ON true))
    WHERE rn <= 3""")(
    lambda g: H.vector_topk_many(g.embedded_chunks, many_questions(g, 3), per_repo=True).select(*HIT.split(", ")))
query("h03_vector_topk_all_repos", f"""
    SELECT {HIT} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_path, start_line, repo_url, chunk_id) AS rn FROM (
      SELECT 'v' || q.vec_id AS query_id, c.repo_url, c.file_path, c.start_line, c.chunk_id, round({COSINE}, 6) AS score FROM embedded_chunks c JOIN embeddings q ON true))
    WHERE rn <= 10""")(
    lambda g: H.vector_topk_many(g.embedded_chunks, many_questions(g)).select(*HIT.split(", ")))
query("h04_readme_first", """
    SELECT repo_url, chunk_id, content AS text, file_path AS path, start_line, 0.95 AS score FROM embedded_chunks
    WHERE is_documentation OR contains(file_path, 'README') ORDER BY path, start_line, repo_url, chunk_id LIMIT 20""")(
    lambda g: H.readme_first(g.embedded_chunks, g.files, 20))

register("service_topic", f"""
    SELECT repo_url, chunk_id, content AS text, file_path AS path, start_line, {priority_sql('file_path')} AS priority FROM chunks
    WHERE {contains_any_sql('content', TOPICS['first'])} ORDER BY priority DESC, path, start_line, repo_url, chunk_id LIMIT 15""")
register("context_hits", f"""
    SELECT *, count(*) FILTER (WHERE repo_url = '{ACTIVE_REPO}') OVER (PARTITION BY query_id) AS n_primary FROM (
      SELECT s.query_id, s.repo_url, s.chunk_id, s.file_path, s.start_line, round({doc_boost_sql('file_path', 'is_documentation', 'score')}, 6) AS boosted, high
      FROM (SELECT *, row_number() OVER (PARTITION BY query_id, repo_url ORDER BY score DESC, file_path, start_line, chunk_id) AS rn FROM scored) s
      JOIN asked_now a USING (query_id)
      WHERE NOT EXISTS (SELECT 1 FROM readme_hits r WHERE r.query_id = s.query_id AND r.repo_url = s.repo_url) AND rn <= CASE WHEN repo_url = '{ACTIVE_REPO}' THEN CASE WHEN high THEN 20 ELSE 10 END ELSE 5 END
        AND (repo_url = '{ACTIVE_REPO}' OR repo_url IN (SELECT repo_url FROM connected))
      UNION ALL SELECT query_id, repo_url, chunk_id, file_path, start_line, 0.95, high FROM readme_hits) WHERE boosted > 0.4""")
register("readme_hits", f"""
    SELECT query_id, repo_url, chunk_id, file_path, start_line, high FROM (
      SELECT a.query_id, a.high, e.repo_url, e.chunk_id, e.file_path, e.start_line, row_number() OVER (PARTITION BY a.query_id, e.repo_url ORDER BY e.file_path, e.start_line, e.chunk_id) AS rn
      FROM asked_now a JOIN embedded_chunks e ON a.readme
      WHERE (e.is_documentation OR contains(e.file_path, 'README')) AND (e.repo_url = '{ACTIVE_REPO}' OR e.repo_url IN (SELECT repo_url FROM connected)))
    WHERE rn <= CASE WHEN repo_url = '{ACTIVE_REPO}' THEN CASE WHEN high THEN 20 ELSE 10 END ELSE 5 END""")
register("asked_now", """
    SELECT query_id, contains(lower(question), 'services') AS svc, contains(lower(question), 'overview') OR contains(lower(question), 'about')
           OR contains(lower(question), 'what is') OR contains(lower(question), 'services') AS high,
           """ + contains_any_sql("lower(question)", K.README_FIRST_TERMS) + " AS readme FROM questions")
query("h05_retrieve_context", f"""
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, start_line, repo_url, chunk_id) AS rn FROM (
      SELECT h.query_id, h.repo_url, h.chunk_id, h.file_path AS source, h.start_line, round(h.boosted
             * CASE WHEN h.high AND (contains(h.file_path, 'README') OR contains(h.file_path, 'readme')) THEN 1.5 ELSE 1.0 END::DOUBLE
             * CASE WHEN h.repo_url = '{ACTIVE_REPO}' THEN 1.0 ELSE 0.8 END::DOUBLE, 6) AS score, h.repo_url <> '{ACTIVE_REPO}' AS secondary_repo, c.content AS text
      FROM context_hits h JOIN asked_now a USING (query_id) JOIN embedded_chunks c ON c.repo_url = h.repo_url AND c.chunk_id = h.chunk_id
      WHERE NOT (a.svc AND (SELECT count(*) FROM service_topic) >= 2) AND (h.repo_url = '{ACTIVE_REPO}' OR h.n_primary < 3)
      UNION ALL
      SELECT a.query_id, t.repo_url, t.chunk_id, t.path, t.start_line, 1.0, false, t.text FROM asked_now a JOIN service_topic t ON true
      WHERE a.svc AND (SELECT count(*) FROM service_topic) >= 2)""")(lambda g: context(g))


def service_topic(g):
    """Topical chunks that answer questions about services."""
    return H.top_by_priority(g.chunks, D.contains_any(F.col("content"), TOPICS["first"]), "microservices", None, 15)


def context(g):
    return H.retrieve_context(questions(g), g.embedded_chunks, g.embedded_chunks, g.files,
                              connected(g).select(F.col("url").alias("repo_url")), ACTIVE_REPO, service_topic(g))


query("h06_services_shortcut", """
    SELECT a.query_id, t.repo_url, t.chunk_id, t.path AS source, 1.0 AS score FROM asked_now a JOIN service_topic t ON true
    WHERE a.svc AND (SELECT count(*) FROM service_topic) >= 2""")(
    lambda g: H.services_shortcut(questions(g), service_topic(g)).select("query_id", F.inline("rows")).select(
        "query_id", "repo_url", "chunk_id", "source", F.lit(1.0).alias("score")))


def _topic_sql(where: str, topic: str, repo: str = "") -> str:
    return f"""
    SELECT '{topic}' AS topic, repo_url, chunk_id, content AS text, file_path AS path, start_line, {priority_sql('file_path')} AS priority
    FROM chunks WHERE {where}{repo} ORDER BY priority DESC, path, start_line, repo_url, chunk_id LIMIT 15"""


for _key, _topic in (("h07_topic_microservices", "microservices"), ("h08_topic_architecture", "architecture")):
    query(_key, _topic_sql(contains_any_sql("content", _TW[_topic]), _topic).replace("FROM chunks", "FROM code_chunks"))(
        lambda g, t=_topic: H.topic_chunks(g.code_chunks, t))
query("h07_topic_words", _topic_sql(contains_any_sql("content", TOPICS["second"]), "second", f" AND repo_url = '{ACTIVE_REPO}'"))(
    lambda g: H.top_by_priority(g.chunks, D.contains_any(F.col("content"), TOPICS["second"]), "second", ACTIVE_REPO, 15))
query("h09_topic_overview", _topic_sql("(contains(file_path, 'README.md') OR contains(file_path, '/docs/') OR ends_with(file_path, '.md'))", "overview"))(
    lambda g: H.topic_chunks(g.chunks, "overview"))
query("h10_topic_generic", _topic_sql("contains(content, 'lytion')", "lytion"))(lambda g: H.topic_chunks(g.chunks, "lytion"))
query("h11_interface_analysis", """
    SELECT file_path AS file, name AS interface, start_line AS line, repo_url FROM classes
    WHERE contains(name, 'Interface') OR (starts_with(name, 'I') AND length(name) > 1) ORDER BY file, line, interface, repo_url LIMIT 20""")(
    lambda g: H.interface_analysis(g.classes))
query("h12_list_repositories", f"""
    SELECT url, service_name, description, last_indexed_commit_sha AS last_commit, CAST(NULL AS VARCHAR) AS last_indexed, is_active FROM repositories""")(
    lambda g: H.repository_rows(g.repositories, ACTIVE_REPO).orderBy("url"))
query("h13_active_repository", "SELECT url, is_active FROM repositories WHERE is_active")(
    lambda g: H.active_repository(g.repositories).select("url", "is_active"))
query("h14_set_active_repository", "SELECT url, url = 'https://git.example.org/src7.git' AS is_active FROM repositories")(
    lambda g: H.set_active_repository(g.repositories, "https://git.example.org/src7.git").select("url", "is_active"))
query("h14_set_active_missing", "SELECT url, is_active FROM repositories")(
    lambda g: H.set_active_repository(g.repositories, "https://git.example.org/none.git").select("url", "is_active"))
query("h15_directory_listing", """
    SELECT repo_url, path, len(string_split(path, '/')) - 1 AS depth, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent,
           regexp_extract(path, '[^/]*$') AS name, kind
    FROM (SELECT repo_url, path, 'file' AS kind FROM files UNION ALL SELECT repo_url, dir_path, 'directory' FROM directories)""")(
    lambda g: H.directory_listing(g.files))
query("h16_readme_bundle", """
    SELECT repo_url, file_path, string_agg(content, chr(10) ORDER BY start_line) AS content, 1 AS position FROM (
      SELECT repo_url, file_path, start_line, content FROM chunks WHERE contains(file_path, 'README') OR contains(file_path, 'readme')
      UNION ALL SELECT repo_url, file_path, start_line, content FROM (
        SELECT c.*, row_number() OVER (PARTITION BY repo_url ORDER BY CASE WHEN contains(file_path, 'README') THEN 0 WHEN contains(file_path, '/docs/') THEN 1 ELSE 2 END, file_path, start_line) AS rn
        FROM chunks c WHERE (is_documentation OR ends_with(file_path, '.md')) AND NOT EXISTS (
          SELECT 1 FROM chunks x WHERE x.repo_url = c.repo_url AND (contains(x.file_path, 'README') OR contains(x.file_path, 'readme')))) WHERE rn <= 20)
    GROUP BY repo_url, file_path""")(lambda g: H.readme_bundle(g.chunks, g.files))
query("h17_chunk_preview", """
    SELECT file_path, content FROM chunks WHERE contains(content, 'tion') ORDER BY file_path, start_line, repo_url LIMIT 15""")(
    lambda g: H.first_rows(g.chunks.filter(F.col("content").contains("tion")), ["file_path", "content"], ["file_path", "start_line", "repo_url"], 15))
query("h17_readme_preview", """
    SELECT file_path, content FROM chunks WHERE contains(file_path, 'README') ORDER BY file_path, start_line, repo_url LIMIT 5""")(
    lambda g: H.first_rows(g.chunks.filter(F.col("file_path").contains("README")), ["file_path", "content"], ["file_path", "start_line", "repo_url"], 5))
query("h18_file_listing", "SELECT path, language FROM files ORDER BY path, repo_url LIMIT 20")(
    lambda g: H.first_rows(g.files, ["path", "language"], ["path", "repo_url"], 20))
query("h19_record_samples", f"""
    (SELECT 'readme' AS kind, path AS item FROM files WHERE contains(path, 'README') ORDER BY path, repo_url LIMIT 5)
    UNION ALL (SELECT 'file', path FROM files WHERE repo_url = '{ACTIVE_REPO}' ORDER BY path LIMIT 5)
    UNION ALL (SELECT 'chunk', chunk_id FROM chunks ORDER BY chunk_id, repo_url LIMIT 5)
    UNION ALL (SELECT 'repository', url FROM repositories ORDER BY url LIMIT 5)""")(lambda g: union_all([
        H.first_rows(t.select(F.lit(kind).alias("kind"), F.col(c).alias("item"), *extra), ["kind", "item"], ["item", *extra], 5)
        for kind, t, c, extra in (("readme", g.files.filter(F.col("path").contains("README")), "path", ["repo_url"]),
                                  ("file", g.files.filter(F.col("repo_url") == ACTIVE_REPO), "path", []),
                                  ("chunk", g.chunks, "chunk_id", ["repo_url"]), ("repository", g.repositories, "url", []))]))

# --- set operations --------------------------------------------------------------------------------------
STRUCTURE_WORDS = ["tion", "hat"]
register("project_structure", f"""
    SELECT DISTINCT * FROM (
      SELECT repo_url, content AS text, file_path AS path, start_line::BIGINT AS start_line, 4.0::DOUBLE AS priority FROM chunks
      WHERE contains(file_path, 'README.md') OR ends_with(file_path, '/README') OR ends_with(file_path, '/README.txt')
      UNION ALL SELECT repo_url, content, file_path, start_line, 3.0 FROM chunks WHERE contains(file_path, '/docs/') AND (ends_with(file_path, '.md') OR ends_with(file_path, '.txt'))
      UNION ALL SELECT '', 'Top-level directory: ' || top_dir || ' (contains ' || n || ' files)', 'directory_structure', 0, 2.0 FROM (
        SELECT string_split(path, '/')[1] AS top_dir, count(*) AS n FROM files WHERE contains(path, '/') GROUP BY ALL ORDER BY n DESC, top_dir LIMIT 15)
      UNION ALL (SELECT repo_url, content, file_path, start_line, 1.0 FROM chunks WHERE (is_documentation OR ends_with(file_path, '.md')) AND {contains_any_sql('content', STRUCTURE_WORDS)}
        ORDER BY file_path, start_line, repo_url, chunk_id LIMIT 30))""")


def structure(g):
    return H.project_structure(g.chunks, g.files, STRUCTURE_WORDS)


query("i01_project_structure", "SELECT repo_url, text, path, start_line, priority FROM project_structure")(structure)
query("f27_group_text_by_path", """
    SELECT repo_url, path, string_agg(text, chr(10) ORDER BY start_line, text) AS text, CASE WHEN path = 'directory_structure' THEN 1 WHEN contains(path, 'README') THEN 2
           WHEN contains(path, '/docs/') OR ends_with(path, '.md') THEN 3 ELSE 4 END AS bucket FROM project_structure GROUP BY repo_url, path""")(
    lambda g: R.group_text_by_path(structure(g)))
query("f30_combined_topic_text", f"""
    SELECT topic, string_agg(text, chr(10) || chr(10) ORDER BY priority DESC, path, start_line, text) AS text FROM ({_topic_sql("contains(content, 'lytion')", "lytion")}) GROUP BY topic""")(
    lambda g: R.combined_topic_text(H.topic_chunks(g.chunks, "lytion")))
query("i02_union_distinct_repos", "SELECT repo_url FROM connected")(lambda g: connected(g).select(F.col("url").alias("repo_url")))
query("i03_concat_results", """
    SELECT path, 'a' AS part FROM files WHERE is_documentation UNION ALL SELECT path, 'b' FROM files WHERE language = 'python'""")(
    lambda g: H.concat_results(g.files.filter("is_documentation").select("path", F.lit("a").alias("part")),
                               g.files.filter("language = 'python'").select("path", F.lit("b").alias("part"))))
query("i04_dedup_keep_first", """
    SELECT path, CASE WHEN is_documentation THEN 0 ELSE 1 END AS source_no FROM files WHERE is_documentation OR language = 'markdown' OR language = 'go'""")(
    lambda g: H.dedup_keep_first([g.files.filter("is_documentation").select("path"),
                                  g.files.filter("language IN ('markdown', 'go')").select("path")], "path", []))
query("i05_new_paths", """
    SELECT repo_url, path FROM files f WHERE NOT EXISTS (SELECT 1 FROM stored_edges e WHERE e.src_label = 'File' AND e.dst_label = 'Repository'
      AND e.repo_url = f.repo_url AND e.src_id = f.path)""")(
    lambda g: H.missing_rows(g.files.select("repo_url", "path"), g.stored_edges.filter(
        "src_label = 'File' AND dst_label = 'Repository'").withColumnRenamed("src_id", "path"), ["repo_url", "path"]))
