"""Roll-ups and audits (groups F and G)."""

from pyspark.sql import functions as F

from loomgraph.functions import derive as D
from loomgraph.operators import audit as A
from loomgraph.operators import containment as C
from loomgraph.operators import edges as E
from loomgraph.operators import repair
from loomgraph.operators import rollups as R
from loomgraph.operators import search as H
from loomgraph.operators import cross_service as X
from loomgraph.plans import connection_queries as Q
from loomgraph.plans.oracle_tables import contains_any_sql, language_sql, register
from loomgraph.plans.registry import query
from loomgraph.session import materialize

SERVICE_WORDS = ["tion", "er"]


def joined(column, sep=","):
    return F.array_join(column, sep)


def node_tables(g):
    return {
        "Repository": g.repositories.withColumn("repo_url", F.col("url")), "Service": g.services, "File": g.files,
        "Function": g.functions, "Class": g.classes, "CodeChunk": g.chunks, "ApiEndpoint": g.endpoints,
        "DataModel": g.data_models,
    }


register("nodes", """
    SELECT 'Repository' AS type, url AS repo_url, url AS id FROM repositories UNION ALL SELECT 'Service', repo_url, name FROM services
    UNION ALL SELECT 'File', repo_url, path FROM files UNION ALL SELECT label, repo_url, unique_id FROM symbols
    UNION ALL SELECT 'CodeChunk', repo_url, chunk_id FROM chunks UNION ALL SELECT 'ApiEndpoint', repo_url, endpoint_id::VARCHAR FROM endpoints
    UNION ALL SELECT 'DataModel', repo_url, model_id::VARCHAR FROM data_models""")

query("f01_service_functions", f"""
    SELECT repo_url, file_path AS service_file, count(*) AS function_count, string_agg(name, ',' ORDER BY name) AS functions
    FROM functions WHERE {contains_any_sql('name', SERVICE_WORDS)} GROUP BY ALL
    ORDER BY function_count DESC, service_file, repo_url LIMIT 20""")(
    lambda g: R.service_functions(g.functions, SERVICE_WORDS).withColumn("functions", joined("functions")))
query("f02_language_breakdown", """
    SELECT repo_url AS repository, string_agg(language || ':' || n, ',' ORDER BY n DESC, language) AS language_breakdown,
           sum(n)::BIGINT AS total_files FROM (SELECT repo_url, language, count(*) AS n FROM files GROUP BY ALL) GROUP BY ALL""")(
    lambda g: R.language_breakdown(g.files).withColumn("language_breakdown", joined(F.transform(
        "language_breakdown", lambda x: F.concat_ws(":", x["language"], x["count"].cast("string"))))))
query("f03_busy_files", """
    SELECT repo_url, file_path, count(*) AS function_count FROM functions GROUP BY ALL HAVING count(*) > 3
    ORDER BY function_count DESC, file_path, repo_url LIMIT 20""")(lambda g: R.busy_files(g.functions))
query("f04_node_counts", "SELECT type, count(*) AS n FROM nodes GROUP BY ALL")(lambda g: R.node_counts(node_tables(g)))
query("f04_node_counts_by_repo", "SELECT type, repo_url, count(*) AS n FROM nodes GROUP BY ALL")(
    lambda g: R.node_counts(node_tables(g), ["repo_url"]))
query("f05_relationship_counts", "SELECT rel, count(*) AS n FROM edges GROUP BY ALL")(lambda g: R.relationship_counts(g.edges))
query("f05_relationship_counts_undirected", "SELECT rel, count(*) * 2 AS n FROM edges WHERE repo_url = 'https://git.example.org/src0.git' GROUP BY ALL")(
    lambda g: R.relationship_counts(g.edges, "https://git.example.org/src0.git", undirected=True))
query("f06_files_by_language", """
    SELECT language, count(*) AS n FROM files GROUP BY ALL UNION ALL SELECT '(total)', count(*) FROM files""")(
    lambda g: R.files_by(g.files, "language"))
query("f07_files_by_type", """
    SELECT file_type, count(*) AS n FROM files GROUP BY ALL UNION ALL SELECT '(total)', count(*) FROM files""")(
    lambda g: R.files_by(g.files, "file_type"))
query("f08_chunks_by_file_type", """
    SELECT file_type, count(*) AS n FROM chunks c JOIN files f ON f.repo_url = c.repo_url AND f.path = c.file_path GROUP BY ALL""")(
    lambda g: R.chunks_by_file_type(g.chunks, g.files))
query("f09_doc_chunk_counts", """
    SELECT f.repo_url, f.path, count(c.chunk_id) AS n FROM files f LEFT JOIN chunks c ON f.repo_url = c.repo_url AND f.path = c.file_path
    WHERE f.is_documentation GROUP BY ALL
    UNION ALL SELECT '', '(total)', count(*) FROM chunks WHERE is_documentation""")(
    lambda g: R.doc_chunk_counts(g.chunks, g.files))
query("f10_repo_structure", """
    SELECT repo_url, count(*) AS file_count, array_to_string(list_sort(list(DISTINCT language)), ',') AS languages FROM files GROUP BY ALL""")(
    lambda g: R.repo_structure(g.files).withColumn("languages", joined("languages")))
for _part, _k in ((1, 10), (2, 15)):
    query(f"f11_top_dirs_part{_part}", f"""
        SELECT string_split(path, '/')[{_part + 1}] AS top_dir, count(*) AS file_count FROM files WHERE contains(path, '/')
        GROUP BY ALL ORDER BY file_count DESC, top_dir LIMIT {_k}""")(
        lambda g, p=_part, k=_k: R.top_dirs(g.files, k, p))
query("f12_imports_by_language", """
    SELECT CASE WHEN ends_with(source_path, '.py') THEN 'Python' WHEN ends_with(source_path, '.go') THEN 'Go'
      WHEN ends_with(source_path, '.js') THEN 'JavaScript' WHEN ends_with(source_path, '.ts') THEN 'TypeScript'
      WHEN ends_with(source_path, '.java') THEN 'Java' WHEN ends_with(source_path, '.cs') THEN 'C#' ELSE 'Other' END AS language,
      count(DISTINCT source_path) AS files, count(*) AS imports FROM resolved GROUP BY ALL""")(
    lambda g: R.imports_by_language(_resolved(g)))


def _resolved(g):
    from loomgraph.operators.imports import resolve_imports

    return resolve_imports(g.imports, g.files)


query("f13_chunks_by_parent_type", """
    SELECT coalesce(parent_label, 'File') AS parent_type, count(*) AS n FROM parent_by_range GROUP BY ALL""")(
    lambda g: R.chunks_by_parent_type(C.chunk_parent_by_range(g.chunks, g.symbols).select(
        F.coalesce("parent_label", F.lit("File")).alias("parent_type"))))
query("f13_chunks_by_contains_label", """
    SELECT src_label AS parent_type, count(*) AS n FROM edges WHERE rel = 'CONTAINS' AND dst_label = 'CodeChunk' GROUP BY ALL""")(
    lambda g: R.chunks_by_parent_type(g.edges.filter("rel = 'CONTAINS' AND dst_label = 'CodeChunk'").withColumnRenamed(
        "src_label", "parent_type")))
query("f15_primary_language", "SELECT name AS service_name, repo_url, language FROM services")(
    lambda g: R.primary_language(g.files, ["repo_url", "service_name"]))
query("f16_discover_services", """
    SELECT DISTINCT repo_url, string_split(path, '/')[2] AS service FROM files
    WHERE ext IN ('py', 'go', 'cs', 'java', 'js', 'ts') AND starts_with(path, 'src/') AND len(string_split(path, '/')) > 2""")(
    lambda g: R.discover_services(g.files))
query("f17_merge_service_relationships", """
    SELECT service_name, kind, item, count(*) AS n FROM (
      SELECT service_name, 'apis' AS kind, api AS item FROM service_records UNION ALL SELECT service_name, 'models', model FROM service_records
      UNION ALL SELECT service_name, 'configs', config FROM service_records UNION ALL SELECT service_name, 'interfaces', interface FROM service_records)
    GROUP BY ALL""")(lambda g: _merged(g))


def _merged(g):
    from loomgraph.plans.edge_queries import service_records

    return R.merge_service_relationships(service_records(g), ["apis", "models", "configs", "interfaces"])


query("f18_endpoint_listing", "SELECT repo_url, name, path, method, count(*) AS n FROM endpoints GROUP BY ALL")(
    lambda g: R.listing_with_count(g.endpoints, ["repo_url", "name", "path", "method"]))
query("f19_model_listing", "SELECT name, type, count(*) AS n FROM data_models WHERE repo_url = 'https://git.example.org/src0.git' GROUP BY ALL")(
    lambda g: R.listing_with_count(g.data_models, ["name", "type"], "https://git.example.org/src0.git"))


def _pairs_sql(rel: str, column: str) -> str:
    return f"""SELECT '{rel}' AS rel, a.name AS source_name, b.name AS target_name, count(*) AS n
      FROM (SELECT repo_url, name, unnest({column}) AS target FROM classes) a JOIN classes b ON b.repo_url = a.repo_url AND b.name = a.target GROUP BY ALL"""


query("f20_inheritance_listing", _pairs_sql("INHERITS_FROM", "superclasses") + " UNION ALL " + _pairs_sql("IMPLEMENTS", "interfaces"))(
    lambda g: R.inheritance_listing(E.named_class_edges(g.classes, "superclasses"), E.named_class_edges(g.classes, "interfaces")))
query("f21_import_listing", """
    SELECT repo_url, source_path, target_path, import_name, line FROM resolved ORDER BY ALL LIMIT 20""")(
    lambda g: R.import_listing(_resolved(g)))
query("f22_files_per_service_dir", """
    SELECT 'fourth' AS kind, string_split(path, '/')[4] AS part, count(*) AS n FROM files WHERE len(string_split(path, '/')) >= 4 GROUP BY ALL
    UNION ALL SELECT 'service', string_split(path, '/')[-2], count(*) FROM files WHERE contains(path, 'src/') GROUP BY ALL""")(
    lambda g: R.files_per_service_dir(g.files))
query("f23_repo_node_total", """
    SELECT r.url AS repo_url, count(n.id) AS nodes, r.last_indexed_commit_sha FROM repositories r LEFT JOIN nodes n ON n.repo_url = r.url
    WHERE contains(r.url, 'src1') GROUP BY ALL""")(
    lambda g: R.repo_node_total(node_tables(g), g.repositories, "src1"))
query("f24_graph_totals", """
    SELECT repo_url, count(DISTINCT CASE WHEN type = 'File' THEN id END) AS file_count, count(DISTINCT CASE WHEN type = 'Function' THEN id END) AS function_count,
           count(DISTINCT CASE WHEN type = 'Class' THEN id END) AS class_count, count(DISTINCT CASE WHEN type = 'CodeChunk' THEN id END) AS chunk_count
    FROM nodes GROUP BY ALL""")(
    lambda g: R.graph_totals(g.files, g.functions, g.classes, g.chunks))
query("f25_ingestion_summary", """
    SELECT 'nodes:' || type AS metric, count(*) AS value FROM nodes GROUP BY ALL
    UNION ALL SELECT 'chunks_with_embedding', count(*) FROM embedded_chunks
    UNION ALL SELECT 'edges:' || rel, count(*) FROM edges GROUP BY ALL""")(
    lambda g: R.ingestion_summary(node_tables(g), g.edges, g.embedded_chunks))
query("f26_message_counts", "SELECT chat_id, count(*) AS messages FROM messages GROUP BY ALL")(lambda g: R.message_counts(g.messages))
query("f28_language_share", """
    SELECT repo_url, language, n AS file_count, round(n / total * 100, 4) AS pct FROM (
      SELECT repo_url, language, count(*) AS n, sum(count(*)) OVER (PARTITION BY repo_url) AS total,
             row_number() OVER (PARTITION BY repo_url ORDER BY count(*) DESC, language) AS rn FROM files GROUP BY repo_url, language) WHERE rn <= 10""")(
    lambda g: R.language_share(g.files))
query("f29_top_functions_per_service", """
    SELECT repo_url, file_path, array_to_string(list_sort(list(name))[1:5], ',') AS functions FROM functions GROUP BY ALL""")(
    lambda g: R.top_functions_per_file(g.functions).withColumn("functions", joined("functions")))
query("f31_proto_word_counts", r"""
    SELECT repo_url, path, len(regexp_extract_all(content, 'message ')) AS message, len(regexp_extract_all(content, 'service ')) AS service
    FROM code_files WHERE ends_with(path, '.proto')""")(
    lambda g: R.proto_word_counts(g.code_files, ".proto", ["message ", "service "]))

# --- audits ----------------------------------------------------------------------------------------------
register("chunk_flags", """
    SELECT c.repo_url, c.chunk_id, c.file_path, coalesce(bool_or(e.src_label = 'File'), false) AS in_file,
           coalesce(bool_or(e.src_label = 'Function'), false) AS in_function, coalesce(bool_or(e.src_label = 'Class'), false) AS in_class,
           coalesce(bool_or(e.src_label = 'Repository'), false) AS in_repository
    FROM chunks c LEFT JOIN (SELECT * FROM stored_edges WHERE rel = 'CONTAINS' AND dst_label = 'CodeChunk') e
      ON e.repo_url = c.repo_url AND e.dst_id = c.chunk_id GROUP BY ALL""")


def _ontology_sql(edges: str, flags: str) -> str:
    return f"""
    SELECT *, round(CASE WHEN functions > 0 THEN file_function_count / functions * 100 ELSE 0 END, 4) AS function_file_pct,
           round(CASE WHEN classes > 0 THEN file_class_count / classes * 100 ELSE 0 END, 4) AS class_file_pct,
           round(CASE WHEN chunks > 0 THEN function_chunk_count / chunks * 100 ELSE 0 END, 4) AS function_chunk_pct,
           round(CASE WHEN chunks > 0 THEN class_chunk_count / chunks * 100 ELSE 0 END, 4) AS class_chunk_pct,
           round(CASE WHEN chunks > 0 THEN file_direct_chunk_count / chunks * 100 ELSE 0 END, 4) AS direct_file_chunk_pct,
           round(CASE WHEN chunks > 0 THEN orphaned_chunk_count / chunks * 100 ELSE 0 END, 4) AS orphaned_chunk_pct
    FROM (SELECT r.url AS repo_url,
      (SELECT count(*) FROM {edges} e WHERE e.repo_url = r.url AND src_label = 'File' AND rel = 'BELONGS_TO' AND dst_label = 'Repository') AS repository_file_count,
      (SELECT count(DISTINCT dst_id) FROM {edges} e WHERE e.repo_url = r.url AND src_label = 'File' AND dst_label = 'Function') AS file_function_count,
      (SELECT count(DISTINCT dst_id) FROM {edges} e WHERE e.repo_url = r.url AND src_label = 'File' AND dst_label = 'Class') AS file_class_count,
      (SELECT count(*) FROM {flags} c WHERE c.repo_url = r.url AND in_function) AS function_chunk_count,
      (SELECT count(*) FROM {flags} c WHERE c.repo_url = r.url AND in_class) AS class_chunk_count,
      (SELECT count(*) FROM {flags} c WHERE c.repo_url = r.url AND in_file AND NOT in_function AND NOT in_class) AS file_direct_chunk_count,
      (SELECT count(*) FROM {flags} c WHERE c.repo_url = r.url AND NOT in_file AND NOT in_function AND NOT in_class) AS orphaned_chunk_count,
      (SELECT count(*) FROM chunks c WHERE c.repo_url = r.url) AS chunks,
      (SELECT count(*) FROM functions f WHERE f.repo_url = r.url) AS functions,
      (SELECT count(*) FROM classes k WHERE k.repo_url = r.url) AS classes
    FROM repositories r)"""


register("repaired_edges", """
    SELECT * FROM stored_edges UNION ALL SELECT * FROM edges WHERE substring(md5(src_id || dst_id), 1, 1) <= '3'
      AND src_label = 'File' AND rel = 'CONTAINS'""")
register("repaired_flags", """
    SELECT c.repo_url, c.chunk_id, c.file_path, coalesce(bool_or(e.src_label = 'File'), false) AS in_file,
           coalesce(bool_or(e.src_label = 'Function'), false) AS in_function, coalesce(bool_or(e.src_label = 'Class'), false) AS in_class
    FROM chunks c LEFT JOIN (SELECT * FROM repaired_edges WHERE rel = 'CONTAINS' AND dst_label = 'CodeChunk') e
      ON e.repo_url = c.repo_url AND e.dst_id = c.chunk_id GROUP BY ALL""")


def report(g, edges):
    return A.ontology_report(g.repositories, g.functions, g.classes, g.chunks, edges)


def repaired(g):
    """The damaged store after the file -> symbol and file -> chunk repairs."""
    stored = g.stored_edge_table
    return materialize(repair.add_edges(stored, repair.file_to_symbol(g.files, g.symbols, stored),
                                        repair.file_to_chunk(g.files, g.chunks, stored)))


query("g01_ontology_report", _ontology_sql("stored_edges", "chunk_flags"))(lambda g: report(g, g.stored_edge_table))
query("g02_ontology_delta", f"""
    SELECT *, 'before' AS stage FROM ({_ontology_sql('stored_edges', 'chunk_flags')})
    UNION ALL SELECT *, 'after' FROM ({_ontology_sql('repaired_edges', 'repaired_flags')})""")(
    lambda g: A.ontology_delta(report(g, g.stored_edge_table), report(g, repaired(g))))
query("g03_fallback_report", """
    SELECT repo_url, scope, count(*) AS total, count_if(in_file) AS file_connected, count_if(in_function) AS function_connected,
           count_if(in_class) AS class_connected, count_if(in_repository) AS repo_connected,
           count_if(in_repository AND NOT in_file AND NOT in_function AND NOT in_class) AS fallback_count,
           round(count_if(in_repository AND NOT in_file AND NOT in_function AND NOT in_class) / count(*) * 100, 4) AS fallback_pct
    FROM (SELECT *, 'all' AS scope FROM chunk_flags2 UNION ALL SELECT *, 'proto' FROM chunk_flags2 WHERE ends_with(file_path, '.proto'))
    GROUP BY ALL""")(lambda g: A.fallback_report(g.chunks, with_repo_fallback(g)))
register("fallback_edges", """
    SELECT * FROM stored_edges UNION ALL
    SELECT repo_url, 'Repository', repo_url, 'CONTAINS', 'CodeChunk', chunk_id FROM chunks WHERE n % 2 = 0""")
register("chunk_flags2", """
    SELECT c.repo_url, c.chunk_id, c.file_path, coalesce(bool_or(e.src_label = 'File'), false) AS in_file,
           coalesce(bool_or(e.src_label = 'Function'), false) AS in_function, coalesce(bool_or(e.src_label = 'Class'), false) AS in_class,
           coalesce(bool_or(e.src_label = 'Repository'), false) AS in_repository
    FROM chunks c LEFT JOIN (SELECT * FROM fallback_edges WHERE rel = 'CONTAINS' AND dst_label = 'CodeChunk') e
      ON e.repo_url = c.repo_url AND e.dst_id = c.chunk_id GROUP BY ALL""")


def with_repo_fallback(g):
    """A store in which every second chunk also hangs on its repository."""
    return g.stored_edges.unionByName(E.edge(g.chunks.filter("n % 2 = 0"), "Repository", "repo_url", "CONTAINS", "CodeChunk", "chunk_id"))


def flags(g):
    return A.chunk_parents(g.chunks, g.stored_edges)


query("g04_orphan_chunks", "SELECT repo_url, chunk_id FROM chunk_flags WHERE NOT in_file AND NOT in_function AND NOT in_class")(
    lambda g: A.orphan_chunks(flags(g)).select("repo_url", "chunk_id"))
query("g05_direct_file_chunks", "SELECT repo_url, chunk_id FROM chunk_flags WHERE in_file AND NOT in_function AND NOT in_class")(
    lambda g: A.direct_file_chunks(flags(g)).select("repo_url", "chunk_id"))
query("g06_readme_presence", """
    SELECT repo_url, count(*) AS readmes, count_if(has) AS with_chunks, count_if(NOT has) AS without_chunks FROM (
      SELECT f.repo_url, f.path, EXISTS (SELECT 1 FROM stored_edges e WHERE e.repo_url = f.repo_url AND e.src_id = f.path AND e.src_label = 'File'
        AND e.dst_label = 'CodeChunk') AS has FROM files f WHERE contains(upper(f.path), 'README')) GROUP BY ALL""")(
    lambda g: A.readme_presence(g.files, g.stored_edges))
query("g07_property_profile", """
    SELECT 'chunk_id' AS property, count(chunk_id) AS filled, count(*) AS total FROM chunks
    UNION ALL SELECT 'content', count(content), count(*) FROM chunks
    UNION ALL SELECT 'embedding', (SELECT count(*) FROM embedded_chunks), count(*) FROM chunks""")(
    lambda g: A.property_profile(g.chunks.select("chunk_id", "content").join(
        g.embedded_chunks.select("chunk_id", "embedding"), "chunk_id", "left")))
query("g08_doc_flag_profile", """
    SELECT is_documentation, '.' || file_type AS extension, count(*) AS n FROM files GROUP BY ALL""")(
    lambda g: A.doc_flag_profile(g.files))
query("g09_ingestion_assertions", """
    SELECT rule, observed, observed > 0 AS passed FROM (
      SELECT 'repositories' AS rule, count(*) AS observed FROM repositories UNION ALL SELECT 'services', count(*) FROM services
      UNION ALL SELECT 'files', count(*) FROM files UNION ALL SELECT 'chunks', count(*) FROM chunks
      UNION ALL SELECT 'embeddings', count(*) FROM embedded_chunks
      UNION ALL SELECT 'contains', count(*) FROM edges WHERE rel = 'CONTAINS' UNION ALL SELECT 'imports', count(*) FROM edges WHERE rel = 'IMPORTS')""")(
    lambda g: A.ingestion_assertions(R.node_counts(node_tables(g)), R.relationship_counts(g.edges),
                                     g.embedded_chunks.agg(F.count("*").alias("n"))))
register("top_files", """
    SELECT repo_url, path, rn FROM (SELECT repo_url, path, row_number() OVER (PARTITION BY repo_url ORDER BY path) AS rn FROM files) WHERE rn <= 5""")
register("top_symbols", """
    SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY s.repo_url, file_path, label ORDER BY start_line, unique_id) AS rn
      FROM symbols s JOIN top_files t ON t.repo_url = s.repo_url AND t.path = s.file_path) WHERE rn <= 5""")
query("g10_hierarchy_sample", """
    SELECT repo_url, 'file' AS level, repo_url AS parent, path AS name, rn FROM top_files
    UNION ALL SELECT repo_url, 'symbol', file_path, unique_id, rn FROM top_symbols
    UNION ALL SELECT repo_url, 'chunk', parent, chunk_id, rn FROM (
      SELECT h.*, row_number() OVER (PARTITION BY h.repo_url, src_label, parent ORDER BY c.start_line, h.chunk_id) AS rn FROM (
        SELECT e.repo_url, e.src_label, e.src_id AS parent, e.dst_id AS chunk_id FROM stored_edges e JOIN top_symbols s ON s.repo_url = e.repo_url AND s.unique_id = e.src_id
        WHERE e.rel = 'CONTAINS' AND e.dst_label = 'CodeChunk' AND e.src_label <> 'File'
        UNION ALL SELECT f.repo_url, 'File', f.file_path, f.chunk_id FROM chunk_flags f JOIN top_files t ON t.repo_url = f.repo_url AND t.path = f.file_path
        WHERE in_file AND NOT in_function AND NOT in_class) h JOIN chunks c ON c.repo_url = h.repo_url AND c.chunk_id = h.chunk_id) WHERE rn <= 2""")(
    lambda g: A.hierarchy_sample(g.files, g.symbols, g.chunks, g.stored_edge_table))
query("g11_file_hierarchy", """
    SELECT repo_url, 'class' AS level, file_path AS parent, unique_id AS name, start_line FROM classes WHERE ends_with(file_path, '.java')
    UNION ALL SELECT c.repo_url, 'method', c.unique_id, f.unique_id, f.start_line FROM classes c JOIN functions f ON f.repo_url = c.repo_url
      AND f.file_path = c.file_path AND f.start_line >= c.start_line AND f.end_line <= c.end_line WHERE ends_with(c.file_path, '.java')
    UNION ALL SELECT repo_url, 'chunk', src_id, dst_id, start_line FROM (
      SELECT e.*, c.start_line, row_number() OVER (PARTITION BY e.repo_url, e.src_id ORDER BY c.start_line, c.chunk_id) AS rn
      FROM edges e JOIN chunks c ON c.repo_url = e.repo_url AND c.chunk_id = e.dst_id
      WHERE e.src_label = 'Class' AND e.dst_label = 'CodeChunk' AND ends_with(c.file_path, '.java')) WHERE rn <= 3""")(
    lambda g: A.file_hierarchy(g.classes, g.functions, g.chunks, g.edges, ".java"))
query("g12_service_edges", """
    SELECT src, dst, rel FROM (SELECT src, dst, 'COMMUNICATES_WITH' AS rel FROM communicates UNION ALL SELECT src, dst, 'SHARES_MODEL_WITH' FROM shares_model)
    ORDER BY src, dst, rel LIMIT 10""")(
    lambda g: A.service_edges({"COMMUNICATES_WITH": Q.communicates(g), "SHARES_MODEL_WITH": X.shares_model_with(g.data_models)}))
query("g13_sample_by_predicate", """
    (SELECT 'docs' AS kind, path AS item FROM files WHERE is_documentation ORDER BY path LIMIT 10)
    UNION ALL (SELECT 'protos', path FROM files WHERE ends_with(path, '.proto') ORDER BY path LIMIT 10)
    UNION ALL (SELECT 'models', name || '#' || model_id FROM data_models ORDER BY name, model_id LIMIT 10)
    UNION ALL (SELECT 'endpoints', path || '#' || endpoint_id FROM endpoints ORDER BY path, endpoint_id LIMIT 10)""")(
    lambda g: E.union_all([
        H.first_rows(g.files.filter("is_documentation").select(F.lit("docs").alias("kind"), F.col("path").alias("item")), ["kind", "item"], ["item"], 10),
        H.first_rows(g.files.filter(F.col("path").endswith(".proto")).select(F.lit("protos").alias("kind"), F.col("path").alias("item")), ["kind", "item"], ["item"], 10),
        H.first_rows(g.data_models.select(F.lit("models").alias("kind"), F.concat_ws("#", "name", "model_id").alias("item"), "name", "model_id"), ["kind", "item"], ["name", "model_id"], 10),
        H.first_rows(g.endpoints.select(F.lit("endpoints").alias("kind"), F.concat_ws("#", "path", "endpoint_id").alias("item"), "path", "endpoint_id"), ["kind", "item"], ["path", "endpoint_id"], 10)]))
query("g14_key_uniqueness", """
    SELECT 'files' AS "table", to_json([repo_url, path])::VARCHAR AS key, false AS has_null, count(*) AS n FROM files GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT 'functions', to_json([name])::VARCHAR, false, count(*) FROM functions GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT 'endpoints', to_json([name, repo_url])::VARCHAR, false, count(*) FROM endpoints GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT 'data_models', to_json([name, repo_url])::VARCHAR, false, count(*) FROM data_models GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT 'chats', to_json([path])::VARCHAR, path IS NULL, count(*) FROM chats GROUP BY ALL HAVING count(*) > 1 OR path IS NULL""")(
    lambda g: A.key_uniqueness({"files": (g.files, ["repo_url", "path"]), "functions": (g.functions, ["name"]),
                                "endpoints": (g.endpoints, ["name", "repo_url"]), "data_models": (g.data_models, ["name", "repo_url"]),
                                "chats": (g.chats, ["path"])}))
