"""Scans, edge building, containment and import resolution (groups A and D)."""

from pyspark.sql import functions as F

from loomgraph.functions import derive as D
from loomgraph.operators import containment as C
from loomgraph.operators import edges as E
from loomgraph.operators import imports as I
from loomgraph.plans.oracle_tables import is_doc_sql, language_sql, register
from loomgraph.plans.registry import query
from loomgraph.sources import scan as S

register("directories", """
    SELECT DISTINCT repo_url, array_to_string(list_slice(parts, 1, k), '/') AS dir_path,
           array_to_string(list_slice(parts, 1, k - 1), '/') AS parent_path, parts[k] AS name
    FROM (SELECT repo_url, parts, unnest(range(1, len(parts))) AS k
          FROM (SELECT repo_url, string_split(path, '/') AS parts FROM files))""")
register("resolved", """
    SELECT i.repo_url, i.source_path, i.import_name, i.line, c.path AS target_path, c.rule
    FROM imports i JOIN (
      SELECT repo_url, source_path, target_text, import_name, arg_min(path, (rank, path)) AS path,
             arg_min(rule, (rank, path)) AS rule
      FROM (SELECT x.*, 1 AS rank, 'exact' AS rule, f.path FROM ix x JOIN files f ON f.repo_url = x.repo_url AND f.path = x.target_text
            UNION ALL
            SELECT x.*, 2, 'relative', f.path FROM ix x JOIN files f ON f.repo_url = x.repo_url
              AND starts_with(x.target_text, '.') AND f.path = x.rel
            UNION ALL
            SELECT x.*, 3, 'relative', f.path FROM ix x JOIN files f ON f.repo_url = x.repo_url
              AND starts_with(x.target_text, '.') AND f.path = x.rel || '.py'
            UNION ALL
            SELECT x.*, 12, 'python', f.path FROM ix x JOIN files f ON f.repo_url = x.repo_url AND ends_with(x.source_path, '.py')
              AND f.path IN (x.target_text || '.py', replace(x.target_text, '.', '/') || '.py')
            UNION ALL
            SELECT x.*, 21, 'go', f.path FROM ix x JOIN files f ON f.repo_url = x.repo_url AND ends_with(x.source_path, '.go')
              AND ends_with(f.path, '.go') AND list_contains(string_split(f.path, '/'), x.import_name)
            UNION ALL
            SELECT x.*, 31 + e.k, 'javascript', f.path FROM ix x, (VALUES (0, '.js'), (1, '.jsx'), (2, '.ts'), (3, '.tsx')) e(k, ext),
              files f WHERE f.repo_url = x.repo_url AND regexp_matches(x.source_path, '[.](js|jsx|ts|tsx)$')
              AND f.path = x.target_text || e.ext
            UNION ALL
            SELECT x.*, 35 + e.k, 'javascript', f.path FROM ix x, (VALUES (0, '.js'), (1, '.jsx'), (2, '.ts'), (3, '.tsx')) e(k, ext),
              files f WHERE f.repo_url = x.repo_url AND regexp_matches(x.source_path, '[.](js|jsx|ts|tsx)$')
              AND starts_with(x.target_text, '.') AND f.path = x.rel || e.ext
            UNION ALL
            SELECT x.*, 51, 'java', f.path FROM ix x JOIN files f ON f.repo_url = x.repo_url AND ends_with(x.source_path, '.java')
              AND f.path = replace(x.target_text, '.', '/') || '.java'
            UNION ALL
            SELECT x.*, 52, 'csharp', f.path FROM ix x JOIN files f ON f.repo_url = x.repo_url AND ends_with(x.source_path, '.cs')
              AND f.path = replace(x.target_text, '.', '/') || '.cs')
      GROUP BY repo_url, source_path, target_text, import_name) c USING (repo_url, source_path, target_text, import_name)""")
register("ix", """
    SELECT DISTINCT repo_url, source_path, target_text, import_name,
           regexp_replace(source_path, '/[^/]*$', '') || '/' || regexp_replace(target_text, '^[.]/?', '') AS rel
    FROM imports""")
register("parent_by_range", """
    SELECT c.repo_url, c.file_path, c.chunk_id, arg_min(s.label, (s.end_line - s.start_line, s.start_line, s.unique_id)) AS parent_label,
           arg_min(s.unique_id, (s.end_line - s.start_line, s.start_line, s.unique_id)) AS parent_id
    FROM chunks c LEFT JOIN symbols s ON s.repo_url = c.repo_url AND s.file_path = c.file_path
         AND s.start_line <= c.start_line AND s.end_line >= c.end_line
    GROUP BY ALL""")
register("edges", """
    SELECT s.repo_url, 'Service' AS src_label, s.name AS src_id, 'BELONGS_TO' AS rel, 'Repository' AS dst_label, s.repo_url AS dst_id
    FROM services s
    UNION ALL SELECT repo_url, 'File', path, 'BELONGS_TO', 'Repository', repo_url FROM files
    UNION ALL SELECT f.repo_url, 'File', path, 'BELONGS_TO', 'Service', service_name FROM files f
      JOIN services s ON s.name = f.service_name AND s.repo_url = f.repo_url
    UNION ALL SELECT repo_url, 'File', file_path, 'CONTAINS', label, unique_id FROM symbols
    UNION ALL SELECT repo_url, parent_label, parent_id, 'CONTAINS', 'CodeChunk', chunk_id FROM parent_by_range WHERE parent_id IS NOT NULL
    UNION ALL SELECT repo_url, 'File', file_path, 'CONTAINS', 'CodeChunk', chunk_id FROM chunks
    UNION ALL SELECT repo_url, 'CodeChunk', chunk_id, 'BELONGS_TO', 'Repository', repo_url FROM chunks
    UNION ALL SELECT c.repo_url, 'CodeChunk', chunk_id, 'BELONGS_TO', 'Service', service_name FROM chunks c
      JOIN services s ON s.name = c.service_name AND s.repo_url = c.repo_url
    UNION ALL SELECT repo_url, label, unique_id, 'BELONGS_TO', 'Repository', repo_url FROM symbols
    UNION ALL (SELECT DISTINCT repo_url, 'File', source_path, 'IMPORTS', 'File', target_path FROM resolved)
    UNION ALL SELECT e.repo_url, 'Service', service_name, 'EXPOSES', 'ApiEndpoint', endpoint_id::VARCHAR FROM endpoints e
      JOIN services s ON s.name = e.service_name AND s.repo_url = e.repo_url
    UNION ALL SELECT e.repo_url, 'ApiEndpoint', endpoint_id::VARCHAR, 'BELONGS_TO', 'Repository', repo_url FROM endpoints e
      JOIN repositories r ON r.url = e.repo_url
    UNION ALL SELECT m.repo_url, 'Service', service_name, 'USES_MODEL', 'DataModel', model_id::VARCHAR FROM data_models m
      JOIN services s ON s.name = m.service_name AND s.repo_url = m.repo_url
    UNION ALL SELECT m.repo_url, 'DataModel', model_id::VARCHAR, 'BELONGS_TO', 'Repository', repo_url FROM data_models m
      JOIN repositories r ON r.url = m.repo_url
    UNION ALL SELECT repo_url, 'Directory', parent_path, 'CONTAINS', 'Directory', dir_path FROM directories WHERE parent_path <> ''
    UNION ALL SELECT repo_url, 'Directory', regexp_replace(path, '/[^/]*$', ''), 'CONTAINS', 'File', path FROM files
    UNION ALL SELECT repo_url, 'Directory', dir_path, 'BELONGS_TO', 'Repository', repo_url FROM directories""")
register("stored_edges", "SELECT * FROM edges WHERE substring(md5(src_id || dst_id), 1, 1) > '3'")
register("calls", """
    SELECT repo_url, name AS source_name, lower(regexp_extract(ls[2], '[A-Za-z]+')) AS target_name, start_line + 1 AS line
    FROM (SELECT *, string_split(text, chr(10)) AS ls FROM functions) WHERE len(ls) > 1""")
register("stray_chunks", """
    SELECT repo_url, service_name, chunk_id, CASE n % 4 WHEN 0 THEN file_path
           WHEN 1 THEN CASE WHEN ends_with(file_path, '.proto') THEN 'proto/' || file_path ELSE 'x/' || file_path END
           WHEN 2 THEN 'moved/' || regexp_extract(file_path, '[^/]*$') ELSE 'gone/' || doc_id || '.zz' END AS file_path
    FROM chunks""")
register("service_records", """
    SELECT repo_url, service_name, 'src' || ((endpoint_id * 3 + 1) % 25) AS target, CASE WHEN endpoint_id % 2 = 0 THEN 'sync' ELSE 'queue' END AS type,
           CASE WHEN endpoint_id % 3 = 0 THEN 'grpc' ELSE 'http' END AS protocol, endpoint_id % 2 = 1 AS is_async,
           name AS api, 'model_' || method AS model, 'cfg_' || (endpoint_id % 4) AS config, 'I' || name AS interface
    FROM endpoints""")

EDGE_SELECT = "repo_url, src_label, src_id, rel, dst_label, dst_id"


def calls_of(g):
    second = F.get(F.split("text", "\n"), F.lit(1))
    return g.functions.filter(second.isNotNull()).select(
        "repo_url", F.col("name").alias("source_name"),
        F.lower(F.regexp_extract(second, "[A-Za-z]+", 0)).alias("target_name"), (F.col("start_line") + 1).alias("line"))


def stray_chunks(g):
    n, p = F.col("n") % 4, F.col("file_path")
    return g.chunks.withColumn("file_path", F.when(n == 0, p).when(
        n == 1, F.concat(F.when(p.endswith(".proto"), "proto/").otherwise("x/"), p)).when(
        n == 2, F.concat(F.lit("moved/"), D.basename(p))).otherwise(F.concat(F.lit("gone/"), "doc_id", F.lit(".zz"))))


def service_records(g):
    e = F.col("endpoint_id")
    call = F.struct(
        F.concat(F.lit("src"), (e * 3 + 1) % 25).alias("target"), F.when(e % 2 == 0, "sync").otherwise("queue").alias("type"),
        F.when(e % 3 == 0, "grpc").otherwise("http").alias("protocol"), (e % 2 == 1).alias("is_async"))
    return g.endpoints.select(
        "repo_url", "service_name", F.array(call).alias("calls"), F.array("name").alias("apis"),
        F.array(F.concat(F.lit("model_"), "method")).alias("models"),
        F.array(F.concat(F.lit("cfg_"), e % 4)).alias("configs"), F.array(F.concat(F.lit("I"), "name")).alias("interfaces"))


@query("a02_ignore_patterns", r"""
    SELECT DISTINCT replace(replace(trim(line), '.', '\.'), '*', '.*') AS pattern FROM lines
    WHERE trim(line) <> '' AND NOT starts_with(trim(line), '#')""")
def _(g):
    return S.ignore_patterns(g.lines.select(F.col("line").alias("value")))


@query("a02_drop_ignored", """
    SELECT repo_url, path FROM files WHERE NOT regexp_matches(path, '(src/es/.*)|(.*[.]json)')""")
def _(g):
    # One ignore file per repository with two patterns, as the repository rows give them.
    lines = g.repositories.select(F.col("url").alias("repo_url"), F.explode(F.array(
        F.lit("# generated"), F.lit("src/es/*"), F.lit("*.json"), F.lit(""))).alias("value"))
    return S.drop_ignored(g.files, S._patterns_by_repo(lines)).select("repo_url", "path")


query("a03_scan_readmes", "SELECT repo_url, path FROM files WHERE lower(name) IN ('readme.md', 'readme.txt', 'readme')")(
    lambda g: S.scan_readmes(g.files).select("repo_url", "path"))
query("a04_directory_closure", "SELECT repo_url, dir_path, parent_path, name FROM directories")(
    lambda g: S.directory_closure(g.files))

query("d01_file_belongs_to", f"""
    SELECT {EDGE_SELECT} FROM edges WHERE src_label = 'File' AND rel = 'BELONGS_TO'""")(
    lambda g: E.file_belongs_to(g.files, g.repositories, g.services))
query("d02_service_belongs_to", f"""
    SELECT {EDGE_SELECT} FROM edges WHERE src_label = 'Service' AND dst_label = 'Repository'""")(
    lambda g: E.service_belongs_to(g.services, g.repositories))
query("d03_file_contains_symbol", f"""
    SELECT {EDGE_SELECT} FROM edges WHERE src_label = 'File' AND dst_label IN ('Function', 'Class')""")(
    lambda g: E.file_contains_symbol(g.files, g.symbols))
query("d04_proto_multi_path", """
    SELECT repo_url, regexp_extract(file_path, '[^/]*$') AS file_name, 'symbol' AS kind, unique_id AS member
    FROM symbols WHERE ends_with(file_path, '.proto')
    UNION ALL
    SELECT f.repo_url, w.file_name, 'file', f.path FROM files f JOIN (
      SELECT DISTINCT repo_url, regexp_extract(file_path, '[^/]*$') AS file_name FROM symbols WHERE ends_with(file_path, '.proto')) w
      ON w.repo_url = f.repo_url AND ends_with(f.path, w.file_name)""")(
    lambda g: E.proto_multi_path(g.files, g.symbols))
query("d05_chunk_parent_by_id", """
    SELECT c.repo_url, label AS src_label, unique_id AS src_id, 'CONTAINS' AS rel, 'CodeChunk' AS dst_label, chunk_id AS dst_id
    FROM chunks c JOIN symbols s ON s.repo_url = c.repo_url AND s.unique_id = c.parent_id""")(
    lambda g: E.chunk_parent_by_id(g.chunks, g.symbols))
query("d06_chunk_parent_by_range", "SELECT repo_url, file_path, chunk_id, parent_label, parent_id FROM parent_by_range")(
    lambda g: C.chunk_parent_by_range(g.chunks, g.symbols))
query("d07_chunk_file_cascade", """
    SELECT c.repo_url, c.chunk_id, 'File' AS parent_label, best.path AS parent_id, best.rule AS rule
    FROM stray_chunks c JOIN (
      SELECT repo_url, file_path, arg_min({'path': path, 'rule': rule}, (rank, path)) AS best FROM (
        SELECT r.*, 1 AS rank, 'path' AS rule, f.path FROM refs r JOIN files f ON f.repo_url = r.repo_url AND f.path = r.file_path
        UNION ALL SELECT r.*, 2, 'basename', f.path FROM refs r JOIN files f ON f.repo_url = r.repo_url
          AND ends_with(file_path, '.proto') AND f.path = regexp_extract(file_path, '[^/]*$')
        UNION ALL SELECT r.*, 5, 'suffix', f.path FROM refs r JOIN files f ON f.repo_url = r.repo_url
          AND ends_with(f.path, regexp_extract(file_path, '[^/]*$'))
        UNION ALL SELECT r.*, 6, 'created', file_path FROM refs r) GROUP BY ALL) USING (repo_url, file_path)""".replace(
    "FROM refs r", "FROM (SELECT DISTINCT repo_url, file_path FROM stray_chunks) r"))(
    lambda g: C.chunk_file_cascade(stray_chunks(g), g.files))
query("d08_ensure_file", f"""
    SELECT DISTINCT repo_url, service_name, file_path AS path, regexp_extract(file_path, '[^/]*$') AS name,
           {language_sql('file_path')} AS language, {language_sql('file_path')} AS file_type,
           {is_doc_sql('file_path', language_sql('file_path'))} AS is_documentation
    FROM stray_chunks c WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.repo_url = c.repo_url AND f.path = c.file_path)""")(
    lambda g: E.ensure_file(g.files, stray_chunks(g).select("repo_url", "service_name", F.col("file_path").alias("path"))))
query("d09_chunk_belongs_to", f"""
    SELECT {EDGE_SELECT} FROM edges WHERE src_label = 'CodeChunk' AND rel = 'BELONGS_TO'""")(
    lambda g: E.chunk_belongs_to(g.chunks, g.repositories, g.services))
query("d10_resolve_imports", "SELECT repo_url, source_path, target_path, import_name, line, rule FROM resolved")(
    lambda g: I.resolve_imports(g.imports, g.files))


def _named_sql(column: str) -> str:
    return f"""
    SELECT a.repo_url, a.source_name, a.target_name, a.n AS n_source, b.n AS n_target, a.n * b.n AS n_edges
    FROM (SELECT repo_url, name AS source_name, target_name, count(*) AS n
          FROM (SELECT repo_url, name, unnest({column}) AS target_name FROM classes) GROUP BY ALL) a
    JOIN (SELECT repo_url, name AS target_name, count(*) AS n FROM classes GROUP BY ALL) b USING (repo_url, target_name)"""


query("d11_inherits_edges", _named_sql("superclasses"))(lambda g: E.named_class_edges(g.classes, "superclasses"))
query("d12_implements_edges", _named_sql("interfaces"))(lambda g: E.named_class_edges(g.classes, "interfaces"))
query("d13_function_call_edges", """
    SELECT c.repo_url, c.source_name, c.target_name, c.n_calls, c.first_line, s.n AS n_source, t.n AS n_target
    FROM (SELECT repo_url, source_name, target_name, count(*) AS n_calls, min(line) AS first_line FROM calls GROUP BY ALL) c
    JOIN (SELECT repo_url, name, count(*) AS n FROM functions GROUP BY ALL) s ON s.repo_url = c.repo_url AND s.name = c.source_name
    JOIN (SELECT repo_url, name, count(*) AS n FROM functions GROUP BY ALL) t ON t.repo_url = c.repo_url AND t.name = c.target_name""")(
    lambda g: E.function_call_edges(calls_of(g), g.functions))
query("d14_endpoint_edges", f"SELECT {EDGE_SELECT} FROM edges WHERE 'ApiEndpoint' IN (src_label, dst_label)")(
    lambda g: E.endpoint_edges(g.endpoints, g.services, g.repositories))
query("d15_data_model_edges", f"SELECT {EDGE_SELECT} FROM edges WHERE 'DataModel' IN (src_label, dst_label)")(
    lambda g: E.data_model_edges(g.data_models, g.services, g.repositories))
query("d16_service_topology", """
    SELECT DISTINCT repo_url, 'Service' AS src_label, service_name AS src_id, rel, dst_label, dst_id, detail FROM (
      SELECT repo_url, service_name, 'CALLS' AS rel, 'Service' AS dst_label, target AS dst_id,
             type || '/' || protocol || '/' || is_async AS detail FROM service_records
      WHERE target IN (SELECT name FROM services)
      UNION ALL SELECT repo_url, service_name, 'EXPOSES', 'ApiEndpoint', api, '' FROM service_records
      UNION ALL SELECT repo_url, service_name, 'USES_MODEL', 'DataModel', model, '' FROM service_records
      UNION ALL SELECT repo_url, service_name, 'REQUIRES_CONFIG', 'Configuration', config, '' FROM service_records
      UNION ALL SELECT repo_url, service_name, 'IMPLEMENTS', 'ServiceInterface', interface, '' FROM service_records)""")(
    lambda g: E.service_topology(service_records(g), g.services))
query("d25_directory_edges", f"""
    SELECT {EDGE_SELECT} FROM edges WHERE src_label = 'Directory'""")(
    lambda g: E.directory_edges(S.directory_closure(g.files), g.files, g.repositories))
query("d26_methods_of_class", """
    SELECT c.repo_url, c.file_path, c.unique_id AS class_id, c.name AS class_name, f.unique_id AS function_id,
           f.name AS function_name, f.start_line, f.end_line
    FROM classes c JOIN functions f ON f.repo_url = c.repo_url AND f.file_path = c.file_path
         AND f.start_line >= c.start_line AND f.end_line <= c.end_line""")(
    lambda g: C.methods_of_class(g.classes, g.functions))

register("nesting", """
    SELECT s.repo_url, s.file_path, s.label, s.unique_id, s.name, s.start_line, s.end_line,
           arg_min(o.unique_id, (o.end_line - o.start_line, o.unique_id)) AS parent_id, count(o.unique_id) AS nesting_level
    FROM symbols s LEFT JOIN symbols o ON o.repo_url = s.repo_url AND o.file_path = s.file_path
         AND o.start_line <= s.start_line AND o.end_line >= s.end_line
         AND (o.start_line <> s.start_line OR o.end_line <> s.end_line
              OR (o.label, o.name, o.unique_id) < (s.label, s.name, s.unique_id))
    GROUP BY ALL""")
query("d27_entity_nesting", """
    SELECT repo_url, file_path, label, unique_id, name, start_line, end_line, parent_id, nesting_level FROM nesting""")(
    lambda g: C.entity_nesting(g.symbols))
query("all_edges", f"SELECT {EDGE_SELECT} FROM edges")(lambda g: g.edges)
