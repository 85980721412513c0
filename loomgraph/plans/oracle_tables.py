"""SQL twins of the projected tables, and the helper that puts the needed ones in front of a query."""

from __future__ import annotations

import re

from loomgraph import constants as K
from loomgraph.projection import ACTIVE_REPO, EXTENSIONS, render_sql

BIG = 1_000_000


def sql_list(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def contains_any_sql(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def doc_boost_sql(path: str, is_doc: str, score: str) -> str:
    return (f"({score} * CASE WHEN contains({path}, 'README.md') THEN 1.5 WHEN contains({path}, 'README') THEN 1.4 "
            f"WHEN {is_doc} THEN 1.3 WHEN contains({path}, '/docs/') THEN 1.2 ELSE 1.0 END::DOUBLE)")


def priority_sql(path: str) -> str:
    return (f"(CASE WHEN contains({path}, 'README.md') THEN 2.0 WHEN contains({path}, '/docs/') THEN 1.5 "
            f"ELSE 1.0 END)::DOUBLE")


def is_doc_sql(path: str, file_type: str) -> str:
    return (f"(contains(upper({path}), 'README') OR lower({file_type}) IN {sql_list(K.DOC_FILE_TYPES)} "
            f"OR contains({path}, '/docs/') OR contains({path}, '/documentation/') OR ends_with(lower({path}), '.md'))")


def language_sql(path: str) -> str:
    ext = f"lower(regexp_extract(regexp_extract({path}, '[^/]*$'), '[^.](\\.[^.]*)$', 1))"
    cases = " ".join(f"WHEN '{e}' THEN '{lang}'" for e, lang in K.LANGUAGE_BY_EXTENSION.items())
    return f"(CASE {ext} {cases} ELSE 'unknown' END)"


def _chunks_sql(files: str) -> str:
    return f"""
    SELECT repo_url, service_name, path AS file_path, language, doc_id, is_documentation, n, start_line, end_line,
           array_to_string(list_slice(ls, start_line, end_line), chr(10)) AS content,
           'file::' || path || '_chunk_' || n AS chunk_id,
           CASE WHEN (end_line - 1) // 5 = (n * 3) // 5
                THEN path || '::f' || ((n * 3) // 5 * 5 + 1) || '_'
                     || lower(regexp_extract(prose[(n * 3) // 5 * 5 + 1], '[A-Za-z]+'))
                ELSE 'file::' || path END AS parent_id
    FROM (SELECT *, n * 3 + 1 AS start_line, least(n * 3 + 3, len(ls)) AS end_line
          FROM (SELECT *, unnest(range(0, (len(ls) + 2) // 3)) AS n
                FROM (SELECT c.*, string_split(c.content, chr(10)) AS ls, string_split(f.content, chr(10)) AS prose
                      FROM {files} c JOIN files f USING (repo_url, path))))"""


_WORDS = "regexp_extract_all(l, '[A-Za-z]+')"

TABLES: dict[str, str] = {
    "docs": "SELECT doc_id, text, lang, source, 'src/' || lang || '/m' || (doc_id % 7) AS dir FROM documents",
    "files": f"""
    SELECT doc_id, lang, ext, 'https://git.example.org/' || source || '.git' AS repo_url, source AS service_name, path,
           regexp_extract(path, '[^/]*$') AS name, {language_sql('path')} AS language, ext AS file_type,
           length(text)::BIGINT AS size, CASE WHEN text = '' THEN '' ELSE md5(text) END AS content_hash,
           {is_doc_sql('path', 'ext')} AS is_documentation, text AS content
    FROM (SELECT *, regexp_extract(path, '[^.]*$') AS ext FROM (
          SELECT *, CASE WHEN doc_id % 23 = 0 THEN dir || '/d' || doc_id || '/README.md'
                         WHEN doc_id % 29 = 0 THEN dir || '/docs/page_' || doc_id || '.md'
                         ELSE dir || '/doc_' || doc_id || '.' || (['{"','".join(EXTENSIONS)}'])[doc_id % 8 + 1] END AS path
          FROM docs))""",
    "lines": """
    SELECT repo_url, path, language, unnest(range(0, len(ls))) AS i, unnest(ls) AS line
    FROM (SELECT *, string_split(content, chr(10)) AS ls FROM files)""",
    "code_files": f"""
    SELECT * EXCLUDE (content, prose), array_to_string(list_transform(word_rows, lambda w, j: (
           SELECT_CASE)), chr(10)) AS content
    FROM (SELECT *, string_split(content, chr(10)) AS prose,
                 list_transform(string_split(content, chr(10)), lambda l: {_WORDS}) AS word_rows FROM files)""",
    "code_lines": """
    SELECT repo_url, path, language, ext, doc_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS line
    FROM (SELECT *, string_split(content, chr(10)) AS ls FROM code_files)""",
    "chunks": _chunks_sql("files"),
    "code_chunks": _chunks_sql("code_files"),
    "functions": """
    SELECT repo_url, service_name, path AS file_path, language, path || '::f' || start_line || '_' || name AS unique_id,
           name, start_line, end_line, array_to_string(list_slice(ls, start_line, end_line), chr(10)) AS text
    FROM (SELECT * EXCLUDE (name), lower(regexp_extract(ls[b * 5 + 1], '[A-Za-z]+')) AS name, b * 5 + 1 AS start_line,
                 least(b * 5 + 5, len(ls)) AS end_line
          FROM (SELECT *, unnest(range(0, (len(ls) + 4) // 5)) AS b
                FROM (SELECT *, string_split(content, chr(10)) AS ls FROM files)))""",
    "classes": """
    SELECT repo_url, service_name, path AS file_path, language, path || '::c' || start_line || '_' || name AS unique_id,
           name, start_line, end_line, list_slice(ws, 2, 2) AS superclasses, list_slice(ws, 3, 3) AS interfaces
    FROM (SELECT * EXCLUDE (name), coalesce(ws[1], '') AS name FROM (
          SELECT *, list_transform(regexp_extract_all(ls[b * 15 + 1], '[A-Za-z]+'),
                        lambda w: upper(w[1:1]) || lower(w[2:])) AS ws, b * 15 + 1 AS start_line,
                 least(b * 15 + 15, len(ls)) AS end_line
          FROM (SELECT *, unnest(range(0, (len(ls) + 14) // 15)) AS b
                FROM (SELECT *, string_split(content, chr(10)) AS ls FROM files))))""",
    "symbols": """
    SELECT 'Function' AS label, repo_url, service_name, file_path, language, unique_id, name, start_line, end_line
    FROM functions UNION ALL
    SELECT 'Class', repo_url, service_name, file_path, language, unique_id, name, start_line, end_line FROM classes""",
    "repositories": f"""
    SELECT 'https://git.example.org/' || source || '.git' AS url, source AS name, source AS service_name,
           'repository ' || source AS description, md5(source) AS last_indexed_commit_sha,
           CASE WHEN regexp_extract(source, '[0-9]+')::INT % 2 = 0 THEN md5(source) ELSE md5(source || 'x') END AS current_sha,
           ('https://git.example.org/' || source || '.git') = '{ACTIVE_REPO}' AS is_active
    FROM (SELECT DISTINCT source FROM documents)""",
    "services": f"""
    SELECT service_name AS name, repo_url, arg_max(language, (c, -(ascii(language[1:1]) * 256 + ascii(language[2:2])))) AS language
    FROM (SELECT repo_url, service_name, language, count(*) AS c FROM files
          WHERE ext IN ('py', 'go', 'cs', 'java', 'js', 'ts') GROUP BY ALL) GROUP BY ALL""",
    "imports": """
    SELECT repo_url, source_path, line, import_name,
           CASE WHEN ext = 'go' THEN target_dir
                WHEN ext IN ('js', 'ts') THEN CASE WHEN i % 2 = 0 THEN stem ELSE './doc_' || target_doc END
                WHEN ext = 'py' AND i % 3 = 0 THEN '.doc_' || target_doc
                ELSE replace(stem, '/', '.') END AS target_text
    FROM (SELECT l.repo_url, l.path AS source_path, l.i + 1 AS line, l.i, f.ext, t.doc_id AS target_doc, t.dir AS target_dir,
                 t.dir || '/doc_' || t.doc_id AS stem,
                 CASE WHEN f.ext = 'go' THEN regexp_extract(t.dir, '[^/]*$') ELSE 'doc_' || t.doc_id END AS import_name
          FROM lines l JOIN files f USING (repo_url, path)
          JOIN docs t ON t.doc_id = (f.doc_id + 20 * (1 + l.i % 7)) % (SELECT count(*) FROM documents))""",
    "endpoints": """
    SELECT page_id AS endpoint_id, 'https://git.example.org/src' || (page_id % 20) || '.git' AS repo_url,
           'src' || (page_id % 20) AS service_name,
           lower(regexp_extract(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '[A-Za-z]+')) AS name,
           regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
           (['GET', 'POST', 'PUT', 'DELETE'])[page_id % 4 + 1] AS method
    FROM pages""",
    "data_models": """
    SELECT p_partkey AS model_id, p_name AS name, p_type AS type,
           'src' || (regexp_extract(p_brand, '[0-9]+')::INT % 20) AS service_name,
           'https://git.example.org/src' || (regexp_extract(p_brand, '[0-9]+')::INT % 20) || '.git' AS repo_url
    FROM part""",
    "embedded_chunks": """
    SELECT repo_url, service_name, path AS file_path, language, doc_id, is_documentation, 0 AS n, 1 AS start_line,
           len(string_split(content, chr(10))) AS end_line, content, 'file::' || path || '_chunk_0' AS chunk_id,
           'file::' || path AS parent_id, e.embedding
    FROM files JOIN embeddings e ON e.vec_id = doc_id""",
    "messages": "SELECT conv_id AS chat_id, turn::BIGINT AS turn, role, text AS content FROM conversations",
    "chats": """
    SELECT chat_id AS id, chat_id % 10 AS user_id,
           CASE WHEN chat_id % 5 = 0 THEN 'New Chat' ELSE coalesce(CASE WHEN length(first_user) > 30
                THEN substring(first_user, 1, 30) || '...' ELSE first_user END, 'New Chat') END AS title,
           strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(chat_id), '%Y-%m-%d %H:%M:%S') AS created_at,
           CASE WHEN chat_id % 4 = 0 THEN '/share/' || chat_id END AS share_path,
           CASE WHEN chat_id % 9 = 0 THEN chat_id + 1 ELSE chat_id END AS payload_id,
           CASE WHEN chat_id % 7 = 0 THEN NULL ELSE '/chat/' || chat_id END AS path, n_messages
    FROM (SELECT chat_id, arg_min(content, turn) FILTER (WHERE role = 'user') AS first_user, count(*) AS n_messages
          FROM messages GROUP BY chat_id)""",
}
TABLES["code_files"] = TABLES["code_files"].replace(
    "SELECT_CASE", render_sql(lambda k: f"w[{k}]", "prose[j]", "(j - 1)"))


def register(name: str, sql: str) -> None:
    """Add a derived table that later queries may name."""
    TABLES[name] = sql


def with_tables(body: str) -> str:
    """The query with every projected table it names, directly or not, as a leading CTE."""
    local: list[str] = []
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in TABLES:
            if re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql, re.IGNORECASE) and name not in needed:
                visit(TABLES[name])
                if name not in needed:
                    needed.append(name)

    body = body.strip()
    visit(body)
    head = ",\n".join(f"{n} AS MATERIALIZED ({TABLES[n]})" for n in needed)
    if not head:
        return body
    if re.match(r"WITH\b", body, re.IGNORECASE):
        return f"WITH {head},\n{body[4:]}"
    return f"WITH {head}\n{body}"
