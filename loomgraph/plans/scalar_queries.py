"""Scalar derivations and predicates over the projected tables (groups B and C)."""

from pyspark.sql import functions as F

from loomgraph import constants as K
from loomgraph.functions import derive as D
from loomgraph.functions import predicates as P
from loomgraph.operators import rollups as R
from loomgraph.operators import search
from loomgraph.plans.oracle_tables import (contains_any_sql, doc_boost_sql, is_doc_sql, language_sql, priority_sql,
                                           register, sql_list)
from loomgraph.plans.registry import query
from loomgraph.projection import ACTIVE_REPO

register("urls", """
    SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'https://git.example.org/team/' || source || '.git'
      WHEN 1 THEN 'https://git.example.org/team/' || source || '-' || doc_id || '/' WHEN 2 THEN 'local://' || source || '_x'
      WHEN 3 THEN 'git@git.example.org:team/' || source || '.v' || doc_id || '.git' WHEN 4 THEN ''
      WHEN 5 THEN 'https://git.example.org/widgit' || doc_id || '/digit.git' ELSE 'https://git.example.org/' || lang || '.tig' END AS url
    FROM documents""")


def urls(g):
    d = F.col("doc_id")
    c = F.concat
    return g.table("documents").select("doc_id", F.when(d % 7 == 0, c(F.lit("https://git.example.org/team/"), "source", F.lit(".git")))
        .when(d % 7 == 1, c(F.lit("https://git.example.org/team/"), "source", F.lit("-"), "doc_id", F.lit("/")))
        .when(d % 7 == 2, c(F.lit("local://"), "source", F.lit("_x")))
        .when(d % 7 == 3, c(F.lit("git@git.example.org:team/"), "source", F.lit(".v"), "doc_id", F.lit(".git")))
        .when(d % 7 == 4, F.lit(""))
        .when(d % 7 == 5, c(F.lit("https://git.example.org/widgit"), "doc_id", F.lit("/digit.git")))
        .otherwise(c(F.lit("https://git.example.org/"), "lang", F.lit(".tig"))).alias("url"))


TRIMMED = "regexp_extract(rtrim(rtrim(url, '/'), '.git'), '[^/]*$')"
CLEAN_NAME = r"""CASE WHEN url = '' THEN 'unknown_repo' WHEN starts_with(url, 'local://') THEN replace(url, 'local://', '')
    ELSE regexp_replace(regexp_extract(regexp_replace(regexp_replace(url, '/+$', ''), '[.]git$', ''), '[^/]*$'), '[^a-zA-Z0-9_]', '_', 'g') END"""

query("b01_repo_name", f"SELECT doc_id, url, {CLEAN_NAME} AS repo_name FROM urls")(
    lambda g: urls(g).withColumn("repo_name", D.repo_name(F.col("url"))))
query("b02_repo_name_loader", f"SELECT doc_id, url, translate({TRIMMED}, '.-', '__') AS repo_name FROM urls")(
    lambda g: urls(g).withColumn("repo_name", D.repo_name_loader(F.col("url"))))
query("b03_service_name", f"""
    SELECT doc_id, url, CASE WHEN url = '' THEN 'unknown-service' ELSE {TRIMMED} END AS service_name FROM urls""")(
    lambda g: urls(g).withColumn("service_name", D.service_name(F.col("url"))))
query("b04_display_name", "SELECT doc_id, url, replace(regexp_extract(url, '[^/]*$'), '.git', '') AS display_name FROM urls")(
    lambda g: urls(g).withColumn("display_name", D.display_name(F.col("url"))))
query("b05_normalize_path", """
    SELECT path, CASE WHEN doc_id % 2 = 0 THEN path ELSE 'src1' || '/' || path END AS raw_path,
           CASE WHEN doc_id % 2 = 1 AND service_name = 'src1' THEN path
                WHEN doc_id % 2 = 1 THEN 'src1/' || path ELSE path END AS normal_path FROM files""")(
    lambda g: g.files.withColumn("raw_path", F.when(F.col("doc_id") % 2 == 0, F.col("path"))
                                 .otherwise(F.concat(F.lit("src1/"), "path")))
    .select("path", "raw_path", D.normalize_path(F.col("raw_path"), F.col("repo_url")).alias("normal_path")))

register("odd_paths", f"""
    SELECT doc_id, CASE WHEN doc_id % 9 = 8 THEN dir || '/.bashrc' WHEN doc_id % 9 = 7 THEN dir || '/Makefile' ELSE
           dir || '/f_' || doc_id || (['{"', '".join(K.LANGUAGE_BY_EXTENSION)}'])[doc_id % {len(K.LANGUAGE_BY_EXTENSION)} + 1] END AS path
    FROM docs""")


def odd_paths(g):
    d = F.col("doc_id")
    ext = F.element_at(F.array(*map(F.lit, K.LANGUAGE_BY_EXTENSION)), (d % len(K.LANGUAGE_BY_EXTENSION) + 1).cast("int"))
    return g.docs.select("doc_id", F.when(d % 9 == 8, F.concat("dir", F.lit("/.bashrc"))).when(
        d % 9 == 7, F.concat("dir", F.lit("/Makefile"))).otherwise(F.concat("dir", F.lit("/f_"), "doc_id", ext)).alias("path"))


query("b06_detect_language", f"SELECT doc_id, path, {language_sql('path')} AS language FROM odd_paths")(
    lambda g: odd_paths(g).withColumn("language", D.detect_language(F.col("path"))))
query("b07_is_documentation", f"SELECT path, {is_doc_sql('path', 'file_type')} AS is_documentation FROM files")(
    lambda g: g.files.select("path", D.is_documentation(F.col("path"), F.col("file_type")).alias("is_documentation")))
query("b08_content_hash", "SELECT path, CASE WHEN content = '' THEN '' ELSE md5(content) END AS content_hash FROM files")(
    lambda g: g.files.select("path", D.content_hash(F.col("content")).alias("content_hash")))

register("parent_forms", """
    SELECT chunk_id || CASE n % 5 WHEN 1 THEN '_class_x' WHEN 2 THEN '::func' ELSE '' END AS chunk_id,
           CASE n % 6 WHEN 0 THEN parent_id WHEN 1 THEN file_path || '::class::X' WHEN 2 THEN 'file::' || file_path || '::function::f'
           WHEN 3 THEN file_path || '::Upper' WHEN 4 THEN file_path ELSE file_path || '::lower' END AS parent_id
    FROM chunks""")


def parent_forms(g):
    n, p = F.col("n"), F.col("file_path")
    return g.chunks.select(
        F.concat("chunk_id", F.when(n % 5 == 1, "_class_x").when(n % 5 == 2, "::func").otherwise("")).alias("chunk_id"),
        F.when(n % 6 == 0, F.col("parent_id")).when(n % 6 == 1, F.concat(p, F.lit("::class::X")))
        .when(n % 6 == 2, F.concat(F.lit("file::"), p, F.lit("::function::f"))).when(n % 6 == 3, F.concat(p, F.lit("::Upper")))
        .when(n % 6 == 4, p).otherwise(F.concat(p, F.lit("::lower"))).alias("parent_id"))


query("b09_chunk_parent_type", """
    SELECT chunk_id, parent_id, CASE
      WHEN contains(lower(parent_id), '::class::') THEN 'Class'
      WHEN starts_with(parent_id, 'file::') AND contains(lower(parent_id), '::function::') THEN 'Function'
      WHEN starts_with(parent_id, 'file::') THEN 'File'
      WHEN contains(lower(chunk_id), '_class_') OR contains(lower(chunk_id), '::class') THEN 'Class'
      WHEN contains(lower(parent_id), '::function::') OR contains(lower(chunk_id), '_function_') OR contains(lower(chunk_id), '::func') THEN 'Function'
      WHEN NOT contains(parent_id, '::') THEN 'File'
      WHEN regexp_matches(string_split(parent_id, '::')[2], '^[A-Z]') THEN 'Class' ELSE 'Function' END AS parent_type
    FROM parent_forms""")(
    lambda g: parent_forms(g).withColumn("parent_type", D.chunk_parent_type(F.col("parent_id"), F.col("chunk_id"))))
query("b10_entity_ids", r"""
    SELECT path, path || '::' || name AS symbol_id, 'file::' || path AS file_id, 'file::' || path || '_chunk_' || doc_id AS chunk_id,
           'readme::' || service_name || '::' || path || '::' || doc_id AS readme_id,
           'section_' || replace(lower(substring(content, 1, 20)), ' ', '_') || '_chunk_' || doc_id AS section_id,
           'json_key::' || name AS key_id FROM files""")(
    lambda g: g.files.select(
        "path", D.symbol_id(F.col("path"), F.col("name")).alias("symbol_id"), D.file_parent_id(F.col("path")).alias("file_id"),
        D.chunk_id(D.file_parent_id(F.col("path")), F.col("doc_id")).alias("chunk_id"),
        D.readme_chunk_id(F.col("repo_url"), F.col("path"), F.col("doc_id")).alias("readme_id"),
        D.section_id(F.substring("content", 1, 20), F.col("doc_id")).alias("section_id"),
        D.json_key_id(F.col("name")).alias("key_id")))
query("b11_path_parts", """
    SELECT path, regexp_extract(path, '[^/]*$') AS basename, regexp_replace(path, '/[^/]*$', '') AS dirname,
           len(string_split(path, '/')) - 1 AS depth, string_split(path, '/')[1] AS part_0, string_split(path, '/')[4] AS part_3,
           string_split(path, '/')[-2] AS part_before_last FROM files""")(
    lambda g: g.files.select(
        "path", D.basename(F.col("path")).alias("basename"), D.dirname(F.col("path")).alias("dirname"),
        D.depth(F.col("path")).cast("long").alias("depth"), D.path_part(F.col("path"), 0).alias("part_0"),
        D.path_part(F.col("path"), 3).alias("part_3"), D.path_part(F.col("path"), -2).alias("part_before_last")))
query("b12_class_kind", """
    SELECT unique_id, is_api OR service AS is_api, is_data_model OR message AS is_data_model,
           CASE WHEN service THEN 'service' WHEN message THEN 'message' ELSE 'class' END AS type,
           CASE WHEN service THEN 'gRPC' ELSE 'Unknown' END AS framework
    FROM (SELECT *, proto AND NOT service AND (is_data_model OR contains(lower(unique_id), 'message')) AS message FROM (
          SELECT *, proto AND (is_api OR contains(lower(unique_id), 'service')) AS service FROM (
          SELECT unique_id || CASE start_line % 4 WHEN 1 THEN '_Message' ELSE 'Service' END AS unique_id,
                 ends_with(file_path, '.proto') AS proto, length(name) % 5 = 0 AS is_api, length(name) % 3 = 0 AS is_data_model FROM classes)))""")(
    lambda g: g.classes.select(
        F.concat("unique_id", F.when(F.col("start_line") % 4 == 1, "_Message").otherwise("Service")).alias("unique_id"),
        "file_path", (F.length("name") % 5 == 0).alias("a"), (F.length("name") % 3 == 0).alias("m"))
    .select("unique_id", D.class_kind(F.col("file_path"), F.col("unique_id"), F.col("a"), F.col("m")).alias("k"))
    .select("unique_id", "k.*"))
query("b13_doc_boost", f"""
    SELECT path, round({doc_boost_sql('path', 'is_documentation', '((size % 100)::DOUBLE / 100)')}, 6) AS score FROM files""")(
    lambda g: g.files.select("path", F.round(D.doc_boost(
        F.col("path"), F.col("is_documentation"), (F.col("size") % 100).cast("double") / 100), 6).alias("score")))
query("b14_priority_rank", f"SELECT path, {priority_sql('path')} AS priority FROM files")(
    lambda g: g.files.select("path", D.priority_rank(F.col("path")).alias("priority")))


QUESTION_WORDS = ["about the overview", "how many services", "project structure please", "a graph of it", "code layout",
                  "nothing", "the architecture", "what is this", "depends on what", "organization"]
register("asked", f"""
    SELECT chat_id, turn, (['{"', '".join(QUESTION_WORDS)}'])[(chat_id + turn) % {len(QUESTION_WORDS)} + 1] || ' ' || content AS q FROM messages""")


def asked(g):
    words = F.array(*map(F.lit, QUESTION_WORDS))
    at = ((F.col("chat_id") + F.col("turn")) % len(QUESTION_WORDS) + 1).cast("int")
    return g.messages.select("chat_id", "turn", F.concat(F.element_at(words, at), F.lit(" "), "content").alias("q"))


query("b15_query_intent", f"""
    SELECT chat_id, turn, {contains_any_sql('lower(q)', K.HIGH_LEVEL_TERMS)} AS is_high_level,
           {contains_any_sql('lower(q)', K.PROJECT_STRUCTURE_TERMS)} AS is_structure,
           {contains_any_sql('lower(q)', K.GRAPH_TERMS)} AS is_graph,
           CASE WHEN contains(lower(q), 'service') THEN 'microservices' WHEN contains(lower(q), 'architecture') THEN 'architecture'
                WHEN {contains_any_sql('lower(q)', ['structure', 'organization', 'layout'])} THEN 'project_structure' ELSE 'overview' END AS topic
    FROM asked""")(
    lambda g: asked(g).select("chat_id", "turn", D.is_high_level(F.col("q")).alias("is_high_level"),
                              D.is_structure_question(F.col("q")).alias("is_structure"),
                              D.is_graph_question(F.col("q")).alias("is_graph"), D.question_topic(F.col("q")).alias("topic")))
query("b16_chat_title", """
    SELECT c.id, CASE WHEN c.title IN ('', 'New Chat') AND m.first_user IS NOT NULL THEN CASE WHEN length(m.first_user) > 30
           THEN substring(m.first_user, 1, 30) || '...' ELSE m.first_user END ELSE c.title END AS title, substring(
           CASE WHEN c.title IN ('', 'New Chat') AND m.first_user IS NOT NULL THEN CASE WHEN length(m.first_user) > 30
           THEN substring(m.first_user, 1, 30) || '...' ELSE m.first_user END ELSE c.title END, 1, 50) AS share_title
    FROM chats c LEFT JOIN (SELECT chat_id, arg_min(content, turn) AS first_user FROM messages WHERE role = 'user' GROUP BY ALL) m
      ON m.chat_id = c.id""")(lambda g: _titles(g))


def _titles(g):
    from loomgraph.operators.chats import retitle

    t = retitle(g.chats, g.messages)
    return t.select("id", "title", D.share_title(F.col("title")).alias("share_title"))


def _snippet_sql() -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(content, '(?i){p}') THEN '{lang}'" for lang, p in K.SNIPPET_PATTERNS) + " END"


query("b18_snippet_language", f"SELECT {_snippet_sql()} AS detected_language, count(*) AS n FROM code_chunks GROUP BY ALL")(
    lambda g: g.code_chunks.groupBy(D.snippet_language(F.col("content")).alias("detected_language")).agg(F.count("*").alias("n")))
query("b19_zero_vector", """
    SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 0.0 ELSE round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 4) END AS l1
    FROM embeddings""")(
    lambda g: g.table("embeddings").select("vec_id", D.zero_vector_if_blank(
        F.when(F.col("vec_id") % 4 == 0, "").otherwise("text"), F.col("embedding"), 64).alias("v"))
    .select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double"))), 4).alias("l1")))
query("b20_nested_to_json", """
    SELECT unique_id, '{"superclasses":[' || CASE WHEN len(superclasses) = 0 THEN '' ELSE '"' || superclasses[1] || '"' END
           || '],"start_line":' || start_line || '}' AS fields FROM classes""")(
    lambda g: g.classes.select("unique_id", D.nested_to_json(F.struct("superclasses", "start_line")).alias("fields")))
query("b21_import_language", """
    SELECT source_path, line, CASE WHEN ends_with(source_path, '.py') THEN 'Python' WHEN ends_with(source_path, '.go') THEN 'Go'
      WHEN ends_with(source_path, '.js') OR ends_with(source_path, '.jsx') THEN 'JavaScript'
      WHEN ends_with(source_path, '.ts') OR ends_with(source_path, '.tsx') THEN 'TypeScript'
      WHEN ends_with(source_path, '.java') THEN 'Java' WHEN ends_with(source_path, '.cs') THEN 'C#' ELSE 'Other' END AS language FROM imports""")(
    lambda g: g.imports.select("source_path", "line", D.import_family(F.col("source_path")).alias("language")))
query("b22_null_safe_repo", f"""
    SELECT url, coalesce(CASE WHEN is_active THEN NULL ELSE last_indexed_commit_sha END, '') AS last_commit,
           CAST(NULL AS VARCHAR) AS last_indexed, url = '{ACTIVE_REPO}' AS is_active FROM repositories""")(
    lambda g: search.repository_rows(g.repositories.withColumn(
        "last_indexed_commit_sha", F.when(~F.col("is_active"), F.col("last_indexed_commit_sha"))), ACTIVE_REPO)
    .select("url", "last_commit", "last_indexed", "is_active"))

# --- predicates ------------------------------------------------------------------------------------------
WORDS = ["tion", "eren", "der "]
TOPIC = "hat"
query("c01_keyword_chunks", f"SELECT chunk_id FROM chunks WHERE {contains_any_sql('content', WORDS)}")(
    lambda g: g.chunks.filter(P.keyword_match(F.col("content"), WORDS)).select("chunk_id"))
query("c02_topic_chunks", f"SELECT chunk_id FROM chunks WHERE contains(content, '{TOPIC}')")(
    lambda g: g.chunks.filter(P.topic_match(F.col("content"), TOPIC)).select("chunk_id"))
query("c03_doc_files", """
    SELECT path FROM files WHERE is_documentation OR contains(upper(name), 'README') OR contains(upper(name), 'LICENSE')
      OR ends_with(lower(path), '.md')""")(
    lambda g: g.files.filter(P.documentation_file(F.col("path"), F.col("name"), F.col("is_documentation"))).select("path"))
query("c04_interface_names", """
    SELECT unique_id, name FROM classes WHERE contains(name, 'Interface') OR (starts_with(name, 'I') AND length(name) > 1)""")(
    lambda g: g.classes.filter(P.interface_name(F.col("name"))).select("unique_id", "name"))
query("c05_skip_large_or_binary", """
    SELECT path, CASE WHEN length(content) > 1000000 THEN 'large' WHEN instr(content, chr(0)) > 0 THEN 'binary' ELSE 'text' END AS size_class
    FROM files""")(
    lambda g: g.files.select("path", P.size_class(F.col("content")).alias("size_class")))
query("c06_skip_empty_or_error", """
    SELECT path FROM files WHERE NOT (size % 11 = 0) AND regexp_replace(content, '\\s', '', 'g') <> ''""")(
    lambda g: g.files.filter(P.parsed_and_not_blank(F.col("content"), F.col("size") % 11 == 0)).select("path"))
query("c07_proto_entities", """
    SELECT unique_id FROM classes WHERE ends_with(file_path, '.proto') OR (language = 'protobuf' AND length(name) % 2 = 0)""")(
    lambda g: g.classes.withColumn("kind", F.when(F.length("name") % 2 == 0, "message").otherwise("class"))
    .filter(P.proto_entity(F.col("file_path"), F.col("language"), F.col("kind"))).select("unique_id"))
query("c08_score_threshold", f"""
    SELECT path, round({doc_boost_sql('path', 'is_documentation', '((size % 100)::DOUBLE / 100)')}, 6) AS score FROM files
    WHERE {doc_boost_sql('path', 'is_documentation', '((size % 100)::DOUBLE / 100)')} > 0.4""")(
    lambda g: g.files.withColumn("score", D.doc_boost(F.col("path"), F.col("is_documentation"), (F.col("size") % 100).cast("double") / 100))
    .filter(P.above_threshold(F.col("score"))).select("path", F.round("score", 6).alias("score")))
query("c09_commit_changed", """
    SELECT r.url FROM repositories r WHERE r.last_indexed_commit_sha IS DISTINCT FROM r.current_sha OR r.is_active""")(
    lambda g: search.changed_repositories(
        g.repositories.select("url", "current_sha", F.col("is_active").alias("force")),
        g.repositories.select("url", "last_indexed_commit_sha")).select("url"))
query("c10_extension_count_filter", """
    SELECT s.suffix, count(f.path) AS n FROM (VALUES ('.py'), ('.md'), ('.proto'), ('.rb'), ('son')) s(suffix)
    LEFT JOIN files f ON ends_with(f.path, s.suffix) GROUP BY ALL""")(
    lambda g: R.suffix_counts(g.files, [".py", ".md", ".proto", ".rb", "son"]))
query("c11_top_level_dirs", "SELECT repo_url, dir_path FROM directories WHERE dir_path = '' OR NOT contains(dir_path, '/')")(
    lambda g: search.directories(g).filter(P.top_level_dir(F.col("dir_path"))).select("repo_url", "dir_path"))
query("c12_owner_row_filter", "SELECT id FROM chats WHERE user_id = 3 OR share_path IS NOT NULL")(
    lambda g: g.chats.filter(P.owned_or_shared(F.col("user_id"), F.col("share_path"), 3)).select("id"))
