"""Text to tables (group K), chunking and embedding (group L), and chunk assignment (D28, D30, D31, A5)."""

from pyspark.sql import functions as F

from loomgraph import constants as K
from loomgraph.extract import imports as KI
from loomgraph.extract import structure as KS
from loomgraph.extract import web as KW
from loomgraph.operators import chunking as L
from loomgraph.operators import containment as C
from loomgraph.operators import edges as E
from loomgraph.operators import embedding as V
from loomgraph.plans.oracle_tables import contains_any_sql, register
from loomgraph.plans.registry import ORACLES, query
from loomgraph.sources import scan as S

TRIM = "trim({}, chr(32) || chr(9) || chr(10) || chr(13))"
Q = "[''\"]"
NQ = "[^''\"]"

register("py_lines", "SELECT repo_url, path, i + 1 AS line, line AS text FROM code_lines WHERE language = 'python'")
query("k01_python_imports", rf"""
    SELECT repo_url, path, line, kind, CASE WHEN kind = 'from' AND item = '*' THEN module || '.*' ELSE item END AS name,
           CASE WHEN kind = 'from' THEN module ELSE item END AS target, CASE WHEN kind = 'from' AND item <> '*' THEN module || '.' || item END AS alias
    FROM (SELECT repo_url, path, line, kind, module, {TRIM.format('unnest(string_split(items, chr(44)))')} AS item FROM (
      SELECT *, 'from' AS kind, regexp_extract(text, '^\s*from\s+([a-zA-Z0-9_.]+)\s+import\s+([a-zA-Z0-9_.,\s*]+)', 1) AS module,
             regexp_extract(text, '^\s*from\s+([a-zA-Z0-9_.]+)\s+import\s+([a-zA-Z0-9_.,\s*]+)', 2) AS items
      FROM py_lines WHERE regexp_matches(text, '^\s*from\s+([a-zA-Z0-9_.]+)\s+import\s+([a-zA-Z0-9_.,\s*]+)')
      UNION ALL SELECT *, 'import', '', regexp_extract(text, '^\s*import\s+([a-zA-Z0-9_.,\s]+)', 1) FROM py_lines
      WHERE regexp_matches(text, '^\s*import\s+([a-zA-Z0-9_.,\s]+)')))""")(lambda g: KI.python_imports(g.code_files))
register("go_imports", r"""
    SELECT repo_url, path, line, CASE WHEN inside THEN 'block' ELSE 'single' END AS kind,
           CASE WHEN alias <> '' THEN alias ELSE regexp_extract(target, '[^/]*$') END AS name, target, nullif(alias, '') AS alias
    FROM (SELECT *, CASE WHEN inside THEN regexp_extract(text, '^\s*(?:([a-zA-Z0-9_]+)\s+)?"([^"]+)"', 1) ELSE regexp_extract(text, '^\s*import\s+(?:([a-zA-Z0-9_]+)\s+)?"([^"]+)"', 1) END AS alias,
                 CASE WHEN inside THEN regexp_extract(text, '^\s*(?:([a-zA-Z0-9_]+)\s+)?"([^"]+)"', 2) ELSE regexp_extract(text, '^\s*import\s+(?:([a-zA-Z0-9_]+)\s+)?"([^"]+)"', 2) END AS target
      FROM (SELECT repo_url, path, i + 1 AS line, line AS text, coalesce(last_value(CASE WHEN regexp_matches(line, '^\s*import\s+\(\s*(?://[^\n]*)?$') THEN true
              WHEN regexp_matches(line, '^\s*\)\s*(?://[^\n]*)?$') THEN false END IGNORE NULLS) OVER (PARTITION BY repo_url, path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS inside
            FROM code_lines WHERE language = 'go'))
    WHERE target <> ''""")
query("k02_go_imports", "SELECT repo_url, path, line, kind, name, target, alias FROM go_imports")(lambda g: KI.go_imports(g.code_files))


def _js_sql() -> str:
    forms = [(k, p.replace("'", "''")) for k, p in KI.JS_FORMS]
    case = lambda what: "CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN {what(k, p)}" for k, p in forms) + " END"
    return rf"""
    SELECT repo_url, path, line, kind, CASE WHEN kind = 'named' AND contains(item, ' as ') THEN {TRIM.format("string_split(item, ' as ')[2]")}
             WHEN raw = '' THEN regexp_extract(target, '[^/]*$') ELSE item END AS name, target,
           CASE WHEN kind = 'named' AND contains(item, ' as ') THEN {TRIM.format("string_split(item, ' as ')[1]")} END AS alias
    FROM (SELECT *, {TRIM.format("unnest(CASE WHEN kind = 'named' THEN string_split(raw, ',') ELSE [raw] END)")} AS item FROM (
      SELECT repo_url, path, i + 1 AS line, {case(lambda k, p: f"'{k}'")} AS kind, {case(lambda k, p: f"regexp_extract(line, '{p}', 1)")} AS raw,
             {case(lambda k, p: f"regexp_extract(line, '{p}', 2)")} AS target
      FROM code_lines WHERE language IN ('javascript', 'typescript')) WHERE kind IS NOT NULL)"""


query("k03_js_imports", _js_sql())(lambda g: KI.js_imports(g.code_files))
query("k04_java_imports", r"""
    SELECT repo_url, path, line, CASE WHEN ends_with(f, '.*') THEN 'wildcard' ELSE 'class' END AS kind,
           CASE WHEN ends_with(f, '.*') THEN f ELSE regexp_extract(f, '[^.]*$') END AS name, regexp_replace(f, '[.][*]$', '') AS target,
           CASE WHEN ends_with(f, '.*') THEN NULL WHEN contains(f, '.') THEN regexp_replace(f, '[.][^.]*$', '') ELSE '' END AS alias
    FROM (SELECT repo_url, path, i + 1 AS line, regexp_extract(line, '^\s*import\s+(?:static\s+)?([a-zA-Z0-9_.]+(?:\.[*])?);\s*(?://[^\n]*)?$', 1) AS f
          FROM code_lines WHERE language = 'java' AND regexp_matches(line, '^\s*import\s+(?:static\s+)?([a-zA-Z0-9_.]+(?:\.[*])?);\s*(?://[^\n]*)?$'))""")(
    lambda g: KI.java_imports(g.code_files))
_USING = r"^\s*using\s+(?:static\s+)?([a-zA-Z0-9_.]+)(?:\s+=\s+([a-zA-Z0-9_.]+))?;\s*(?://[^\n]*)?$"
query("k05_csharp_usings", rf"""
    SELECT repo_url, path, line, CASE WHEN b <> '' THEN 'alias' ELSE 'namespace' END AS kind, CASE WHEN b <> '' THEN a ELSE regexp_extract(a, '[^.]*$') END AS name,
           CASE WHEN b <> '' THEN b ELSE a END AS target, CASE WHEN b <> '' THEN a END AS alias
    FROM (SELECT repo_url, path, i + 1 AS line, regexp_extract(line, '{_USING}', 1) AS a, regexp_extract(line, '{_USING}', 2) AS b
          FROM code_lines WHERE language = 'csharp' AND regexp_matches(line, '{_USING}'))""")(lambda g: KI.csharp_usings(g.code_files))
# The rendered declarations: (language, lines in a cycle, line in the cycle, kind, name pattern, lines of the block).
FORMS = [
    ("python", 16, 4, "class", r"^class (\w+)\(", 6), ("python", 16, 8, "function", r"def (\w+)\(", 2),
    ("python", 16, 11, "function", r"def (\w+)\(", 2), ("python", 16, 14, "function", r"def (\w+)\(", 2),
    ("go", 14, 5, "struct", r"^type (\w+)", 3), ("go", 14, 8, "function", r"^func (\w+)", 5),
    ("java", 14, 5, "class", r"class (\w+)", 6), ("java", 14, 7, "function", r"String (\w+)\(", 3), ("java", 14, 11, "class", r"class (\w+)", 3),
    ("csharp", 14, 5, "class", r"class (\w+)", 6), ("csharp", 14, 7, "function", r"string (\w+)\(", 3), ("csharp", 14, 11, "class", r"class (\w+)", 3),
    ("javascript", 13, 6, "function", r"^function (\w+)", 4), ("javascript", 13, 10, "class", r"^class (\w+)", 3),
    ("javascript", 13, 11, "function", r"^  (\w+)\(", 1),
    ("typescript", 10, 1, "interface", r"interface (\w+)", 4), ("typescript", 10, 6, "function", r"function (\w+)", 3),
]
register("code_window", """
    SELECT *, lag(line, 1) OVER w AS up1, lag(line, 3) OVER w AS up3, lead(line, 1) OVER w AS down1, lead(line, 2) OVER w AS down2, lead(line, 3) OVER w AS down3,
           count(*) OVER (PARTITION BY repo_url, path) AS total FROM code_lines WINDOW w AS (PARTITION BY repo_url, path ORDER BY i)""")
_case = lambda k: "CASE " + " ".join(f"WHEN language = '{f[0]}' AND i % {f[1]} = {f[2]} THEN {k(f)}" for f in FORMS) + " END"
_kind, _name, _size = _case(lambda f: f"'{f[3]}'"), _case(lambda f: f"regexp_extract(line, '{f[4]}', 1)"), _case(lambda f: f[5])
query("k06_symbols", f"""
    SELECT d.repo_url, d.path AS file_path, d.language, kind, d.name, d.path || '::' || d.name AS unique_id, start_line, end_line,
           array_to_string(list_slice(string_split(f.content, chr(10)), start_line, end_line), chr(10)) AS text
    FROM (SELECT repo_url, path, language, {_kind} AS kind, {_name} AS name, i + 1 AS start_line, least(i + {_size}, total) AS end_line FROM code_window) d
    JOIN code_files f ON f.repo_url = d.repo_url AND f.path = d.path WHERE kind IS NOT NULL""")(lambda g: KS.symbols(g.code_files).drop("decorators"))
query("k07_markdown_sections", r"""
    SELECT s.repo_url, s.path, s.title, s.level, s.start_line, s.end_line, 'section_' || replace(lower(title), ' ', '_') || '_chunk_' || n AS unique_id,
           array_to_string(list_slice(string_split(f.content, chr(10)), s.start_line + 1, s.end_line), chr(10)) AS content
    FROM (SELECT repo_url, path, i + 1 AS start_line, length(regexp_extract(line, '^(#+)\s+(.+)$', 1)) AS level, trim(regexp_extract(line, '^(#+)\s+(.+)$', 2)) AS title,
            row_number() OVER w - 1 AS n, coalesce(lead(i) OVER w, total) AS end_line
          FROM (SELECT *, max(i + 1) OVER (PARTITION BY repo_url, path) AS total FROM code_lines WHERE language = 'markdown')
          WHERE regexp_matches(line, '^(#+)\s+(.+)$') WINDOW w AS (PARTITION BY repo_url, path ORDER BY i)) s
    JOIN code_files f USING (repo_url, path)""")(lambda g: KS.markdown_sections(g.code_files))


def _block_sql(word: str) -> str:
    p = KS.PROTO_BLOCK.format(word=word)
    nl = lambda pos: f"(len(string_split(substring(content, 1, ({pos}) - 1), chr(10))) - 1)"
    return f"""
    SELECT repo_url, path, name, path || '::' || name AS unique_id, {nl('at_')} + 1 AS start_line, {nl('close_ + 1')} + 1 AS end_line, body
    FROM (SELECT *, at_ - 1 + instr(substring(content, at_), '}}') AS close_ FROM (
      SELECT *, instr(content, '{word} ' || name) AS at_ FROM (
        SELECT repo_url, path, content, unnest(regexp_extract_all(content, '{p}', 1)) AS name, unnest(regexp_extract_all(content, '{p}', 2)) AS body
        FROM code_files WHERE language = 'protobuf')))"""


register("proto_messages", _block_sql("message"))
register("proto_services", _block_sql("service"))
query("k08_proto_messages", "SELECT repo_url, path, name, unique_id, start_line, end_line FROM proto_messages")(
    lambda g: KS.proto_messages(g.code_files).drop("body"))
_F = KS.PROTO_FIELD
query("k08_proto_fields", f"""
    SELECT repo_url, path, message, name, type, CASE WHEN coalesce(modifier, '') = '' THEN 'optional' ELSE modifier END AS modifier, number FROM (
      SELECT repo_url, path, name AS message, unnest(regexp_extract_all(body, '{_F}', 1)) AS modifier, unnest(regexp_extract_all(body, '{_F}', 2)) AS type,
             unnest(regexp_extract_all(body, '{_F}', 3)) AS name, unnest(regexp_extract_all(body, '{_F}', 4)) AS number FROM proto_messages)""")(
    lambda g: KS.proto_fields(KS.proto_messages(g.code_files)))
query("k09_proto_services", "SELECT repo_url, path, name, unique_id, start_line, end_line FROM proto_services")(
    lambda g: KS.proto_services(g.code_files).drop("body"))
_M = KS.PROTO_METHOD
query("k09_proto_methods", f"""
    SELECT repo_url, path, name AS service, unnest(regexp_extract_all(body, '{_M}', 1)) AS name, unnest(regexp_extract_all(body, '{_M}', 2)) AS request_type,
           unnest(regexp_extract_all(body, '{_M}', 3)) AS response_type FROM proto_services""")(
    lambda g: KS.proto_methods(KS.proto_services(g.code_files)))
query("k10_proto_imports", """
    SELECT repo_url, path, target, regexp_extract(target, '[^/]*$') AS name, starts_with(target, 'google/') AS is_system FROM (
      SELECT repo_url, path, unnest(regexp_extract_all(content, 'import\\s+"([^"]+)";', 1)) AS target FROM code_files WHERE language = 'protobuf')""")(
    lambda g: KS.proto_imports(g.code_files))
query("k11_json_keys", r"""
    SELECT repo_url, path, n, name, 'json_key::' || name AS unique_id, s AS start_line, s + 1 AS end_line FROM (
      SELECT repo_url, path, n, name, len(string_split(substring(content, 1, instr(content, '"' || name || '"') - 1), chr(10))) AS s FROM (
        SELECT repo_url, path, content, unnest(range(0, len(ks))) AS n, unnest(ks) AS name FROM (
          SELECT *, regexp_extract_all(content, '"([^"]+)"\s*:', 1) AS ks FROM code_files WHERE language = 'json')))""")(
    lambda g: KS.json_keys(g.code_files))
query("k12_config_flags", f"""
    SELECT repo_url, path, language IN ('yaml', 'json') AS is_config, language = 'markdown' AS is_markdown,
           language = 'protobuf' AND regexp_matches(content, '{KS.PROTO_BLOCK.format(word="message")}') AS is_data_model,
           language = 'protobuf' AND regexp_matches(content, '{KS.PROTO_BLOCK.format(word="service")}') AS is_api FROM code_files""")(
    lambda g: KS.config_flags(g.code_files))
_PC, _JC = KW.PY_CLASS, KW.JAVA_CLASS
query("k13_inheritance", f"""
    SELECT repo_url, path, name, array_to_string(arg_max(sup, n), '|') AS superclasses, array_to_string(arg_max(faces, n), '|') AS interfaces FROM (
      SELECT repo_url, path, n, name, list_filter(list_transform(string_split(b, ','), lambda x: {TRIM.format('x')}), lambda x: x <> '') AS sup, []::VARCHAR[] AS faces FROM (
        SELECT repo_url, path, unnest(regexp_extract_all(content, '{_PC}', 1)) AS name, unnest(regexp_extract_all(content, '{_PC}', 2)) AS b,
               unnest(range(0, len(regexp_extract_all(content, '{_PC}')))) AS n FROM code_files WHERE language = 'python')
      UNION ALL
      SELECT repo_url, path, n, name, list_filter([coalesce(b, '')], lambda x: x <> ''), list_filter(list_transform(string_split(coalesce(f, ''), ','), lambda x: {TRIM.format('x')}), lambda x: x <> '') FROM (
        SELECT repo_url, path, unnest(regexp_extract_all(content, '{_JC}', 1)) AS name, unnest(regexp_extract_all(content, '{_JC}', 2)) AS b,
               unnest(regexp_extract_all(content, '{_JC}', 3)) AS f, unnest(range(0, len(regexp_extract_all(content, '{_JC}')))) AS n FROM code_files WHERE language = 'java'))
    GROUP BY repo_url, path, name""")(
    lambda g: KW.inheritance(g.code_files).withColumn("superclasses", F.array_join("superclasses", "|"))
    .withColumn("interfaces", F.array_join("interfaces", "|")))


def _decorated_sql(mark: str, where: str) -> str:
    return rf"""
    (SELECT repo_url, path, content, piece, list_filter(list_slice(defs, n, len(defs)), lambda d: d <> '')[1] AS func FROM (
      SELECT repo_url, path, content, defs, unnest(pieces) AS piece, unnest(range(1, len(pieces) + 1)) AS n FROM (
        SELECT *, list_transform(pieces, lambda p: regexp_extract(p, 'def\s+([A-Za-z0-9_]+)', 1)) AS defs FROM (
          SELECT *, regexp_split_to_array(content, '{mark}') AS pieces FROM code_files WHERE language = 'python' AND {where}))) WHERE n > 1)"""


_FA = KW.FLASK_ARGS.replace("'", "''")
query("k14_flask_routes", rf"""
    SELECT repo_url, path, func AS name, regexp_extract(piece, '{_FA}', 1) AS route,
           trim(unnest(string_split(CASE WHEN m = '' THEN '''GET''' ELSE m END, ',')), ' ''"') AS method, 'Flask' AS framework
    FROM (SELECT *, regexp_extract(piece, '{_FA}', 2) AS m FROM {_decorated_sql(KW.FLASK_MARK, 'true')})
    WHERE regexp_matches(piece, '{_FA}') AND func IS NOT NULL""")(lambda g: KW.flask_routes(g.code_files))
query("k15_sqlalchemy_models", r"""
    SELECT repo_url, path, regexp_extract(line, '^class (\w+)', 1) AS name, nullif(regexp_extract(down1, '__tablename__ = .(\w+)', 1), '') AS table_name,
           CASE WHEN down2 IS NULL THEN '[]' ELSE '[{"name":"' || regexp_extract(down2, '^ +(\w+) = Column', 1) || '","type":"String","constraints":["NOT NULL"]}]' END AS fields
    FROM code_window WHERE language = 'python' AND i % 16 = 4 AND (down1 IS NOT NULL OR regexp_matches(line, '[( ]Base[,)]'))""")(lambda g: KW.sqlalchemy_models(KS.symbols(g.code_files)).withColumn("fields", F.to_json("fields")))
_VA, _RA, _PM = (x.replace("'", "''") for x in (KW.PY_VERB_ARGS, KW.PY_ROUTE_ARGS, KW.PY_METHODS))
_mod = lambda m: rf"regexp_matches(content, '(?m)^\s*(?:import\s+(?:[\w., ]*[ ,])?{m}\b|from\s+{m}[.\w]*\s+import\b)')"
query("k16_python_endpoints", rf"""
    SELECT repo_url, path, func AS name, regexp_extract(piece, '{_VA}', 2) AS route, upper(regexp_extract(piece, '{_VA}', 1)) AS method, 'FastAPI' AS framework
    FROM {_decorated_sql('@app[.]', _mod('fastapi'))} WHERE regexp_matches(piece, '{_VA}') AND func IS NOT NULL
    UNION ALL
    SELECT repo_url, path, func, regexp_extract(piece, '{_RA}', 1), CASE WHEN regexp_extract(string_split(piece, chr(10))[1], '{_PM}', 1) = '' THEN 'GET'
           ELSE regexp_extract(string_split(piece, chr(10))[1], '{_PM}', 1) END, 'Flask'
    FROM {_decorated_sql('@app[.]', f"NOT {_mod('fastapi')} AND {_mod('flask')}")} WHERE regexp_matches(piece, '{_RA}') AND func IS NOT NULL""")(
    lambda g: KW.python_endpoints(g.code_files))
query("k17_python_models", r"""
    SELECT repo_url, path, regexp_extract(line, '^class (\w+)', 1) AS name, 'Dataclass' AS type, CASE WHEN down3 IS NULL THEN '[]' ELSE
           '[{"name":"' || regexp_extract(down3, '^ +(\w+): int', 1) || '","type":"int","default":"None","required":false}]' END AS fields
    FROM code_window WHERE language = 'python' AND i % 16 = 4""")(lambda g: KW.python_models(KS.symbols(g.code_files)).withColumn("fields", F.to_json("fields")))


def _verb_sql(source: str, pattern: str, framework: str, where: str) -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT repo_url, path, upper(v) || '_' || replace(route, '/', '_') AS name, route, upper(v) AS method, '{framework}' AS framework FROM (
      SELECT repo_url, path, unnest(regexp_extract_all(content, '{p}', 1)) AS v, unnest(regexp_extract_all(content, '{p}', 2)) AS route FROM {source} WHERE {where})"""


query("k18_js_endpoints", _verb_sql("code_files", KW.EXPRESS_ROUTE, "Express", r"""language IN ('javascript', 'typescript')
    AND regexp_matches(content, '(?:from\s+|require\(\s*)[''"]express[''"]')"""))(lambda g: KW.js_endpoints(g.code_files))
query("k19_ts_models", r"""
    SELECT repo_url, path, regexp_extract(line, 'interface (\w+)', 1) AS name, 'Interface' AS type, '[{"name":"' || regexp_extract(down1, '(\w+):', 1)
           || '","type":"string","required":true},{"name":"' || regexp_extract(down2, '(\w+)[?]:', 1) || '","type":"number","required":false}]' AS fields
    FROM code_window WHERE language = 'typescript' AND i % 10 = 1 AND down3 IS NOT NULL
    UNION ALL SELECT repo_url, path, regexp_extract(line, 'type (\w+)', 1), 'Type', '[]' FROM code_window WHERE language = 'typescript' AND i % 10 = 5""")(lambda g: KW.ts_models(g.code_files).withColumn("fields", F.to_json("fields")))
query("k20_spring_endpoints", r"""
    SELECT repo_url, path, regexp_extract(line, 'String (\w+)\(', 1) AS name, regexp_extract(up3, '"([^"]*)"', 1) || regexp_extract(up1, '"([^"]*)"', 1) AS route,
           'GET' AS method, 'Spring' AS framework FROM code_window WHERE language = 'java' AND i % 14 = 7""")(lambda g: KW.spring_endpoints(g.code_files))
query("k21_java_models", r"""
    SELECT repo_url, path, name, 'JavaBean' AS type, CASE WHEN i % 14 = 11 AND down1 IS NOT NULL THEN
           '[{"name":"' || regexp_extract(down1, 'String (\w+);', 1) || '","type":"String"}]' ELSE '[]' END AS fields
    FROM (SELECT *, regexp_extract(line, 'class (\w+)', 1) AS name FROM code_window WHERE language = 'java' AND i % 14 IN (5, 11))
    WHERE regexp_matches(name, '(DTO|Entity|Model|Request|Response|Payload)$')""")(
    lambda g: KW.java_models(g.code_files).withColumn("fields", F.to_json("fields")))
_GM = KW.GORILLA_METHOD.replace("'", "''")
_GR = KW.GORILLA_ROUTE.replace("'", "''")
register("go_flags", """
    SELECT f.*, gin, echo, mux FROM code_files f JOIN (SELECT repo_url, path, bool_or(contains(target, 'gin')) AS gin,
      bool_or(contains(target, 'echo') AND NOT contains(target, 'gin')) AS echo, bool_or(contains(target, 'gorilla/mux')) AS mux FROM go_imports GROUP BY ALL) USING (repo_url, path)""")
query("k22_go_endpoints", f"""
    {_verb_sql('go_flags', KW.GIN_ROUTE, 'Gin', 'gin')} UNION ALL {_verb_sql('go_flags', KW.ECHO_ROUTE, 'Echo', 'NOT gin AND echo')}
    UNION ALL SELECT repo_url, path, m || '_' || replace(route, '/', '_'), route, m, 'GorillaMux' FROM (
      SELECT repo_url, path, CASE WHEN regexp_extract(content, '{_GM}', 1) = '' THEN 'GET' ELSE regexp_extract(content, '{_GM}', 1) END AS m,
             unnest(regexp_extract_all(content, '{_GR}', 1)) AS route FROM go_flags WHERE NOT gin AND NOT echo AND mux)""")(
    lambda g: KW.go_endpoints(g.code_files, KI.go_imports(g.code_files)))
query("k23_go_models", r"""
    SELECT repo_url, path, regexp_extract(line, '^type (\w+)', 1) AS name, 'Struct' AS type,
           '[{"name":"' || regexp_extract(down1, '(\w+) string', 1) || '","type":"string","tags":""}]' AS fields
    FROM code_window WHERE language = 'go' AND i % 14 = 5 AND down2 IS NOT NULL""")(lambda g: KW.go_models(g.code_files).withColumn("fields", F.to_json("fields")))
query("k24_aspnet_endpoints", r"""
    SELECT repo_url, path, regexp_extract(line, 'string (\w+)\(', 1) AS name, regexp_extract(up3, '"([^"]*)"', 1) || '/' || regexp_extract(up1, '"([^"]*)"', 1) AS route,
           'GET' AS method, 'ASP.NET Core' AS framework FROM code_window WHERE language = 'csharp' AND i % 14 = 7""")(lambda g: KW.aspnet_endpoints(g.code_files))
query("k25_csharp_models", r"""
    SELECT repo_url, path, regexp_extract(line, 'class (\w+)', 1) AS name, 'Class' AS type, CASE WHEN down1 IS NULL THEN '[]' ELSE
           '[{"name":"' || regexp_extract(down1, 'string (\w+)', 1) || '","type":"string"}]' END AS fields
    FROM code_window WHERE language = 'csharp' AND i % 14 = 11""")(lambda g: KW.csharp_models(g.code_files).withColumn("fields", F.to_json("fields")))
_all = lambda *names: " UNION ALL BY NAME ".join(f"SELECT * FROM ({ORACLES[n]})" for n in names)
query("k26_dispatch_endpoints", _all("k16_python_endpoints", "k18_js_endpoints", "k20_spring_endpoints", "k22_go_endpoints", "k24_aspnet_endpoints"))(lambda g: KW.all_endpoints(g.code_files, KI.go_imports(g.code_files)))
query("k26_dispatch_models", _all("k17_python_models", "k19_ts_models", "k21_java_models", "k23_go_models", "k25_csharp_models"))(lambda g: KW.all_models(g.code_files, KS.symbols(g.code_files)))
query("k27_parse_status", """
    SELECT repo_url, path, content IS NULL OR contains(content, chr(0)) OR contains(content, chr(65533)) AS parse_error FROM files""")(
    lambda g: KS.parse_status(g.files).select("repo_url", "path", "parse_error"))

# --- chunking and embedding ------------------------------------------------------------------------------
register("size_lines", """
    SELECT repo_url, path, language, line_no AS line, text, row_number() OVER (PARTITION BY repo_url, path ORDER BY line_no, j) - 1 AS i FROM (
      SELECT repo_url, path, language, line_no, j, substring(line, j * 1000 + 1, 1000) AS text FROM (
        SELECT repo_url, path, language, i + 1 AS line_no, line, unnest(range(0, (greatest(length(line) - 1, 0)) // 1000 + 1)) AS j FROM lines))""")


def _boundary_sql() -> str:
    cases = " ".join(f"WHEN language = '{k}' THEN regexp_matches(text, '{p}')" for k, p in L.BOUNDARIES.items())
    return f"CASE {cases} ELSE false END"


def _size_sql(source: str, size: int, step: int) -> str:
    return f"""
    SELECT repo_url, path, block, n, min(line) AS start_line, max(line) AS end_line, string_agg(piece, '' ORDER BY i) AS content FROM (
      SELECT *, CASE WHEN row_number() OVER w = 1 THEN '' WHEN lag(line) OVER w = line THEN '' ELSE chr(10) END || text AS piece FROM (
        SELECT *, unnest(CASE WHEN off // {step} > 0 AND off % {step} < {size - step} THEN [off // {step} - 1, off // {step}] ELSE [off // {step}] END) AS n FROM (
          SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY repo_url, path, block ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM (
            SELECT *, sum(({_boundary_sql()})::INT) OVER (PARTITION BY repo_url, path ORDER BY i)::BIGINT AS block FROM {source})))
      WINDOW w AS (PARTITION BY repo_url, path, block, n ORDER BY i)) GROUP BY ALL"""


register("sized", _size_sql("size_lines", 1000, 800))
query("l01_chunk_by_size", "SELECT repo_url, path, block, n, start_line, end_line, content FROM sized")(lambda g: L.chunk_by_size(g.files))
register("sized_code", _size_sql("code_size_lines", 1000, 800))
register("code_size_lines", """
    SELECT repo_url, path, language, line_no AS line, text, row_number() OVER (PARTITION BY repo_url, path ORDER BY line_no, j) - 1 AS i FROM (
      SELECT repo_url, path, language, line_no, j, substring(line, j * 1000 + 1, 1000) AS text FROM (
        SELECT repo_url, path, language, i + 1 AS line_no, line, unnest(range(0, (greatest(length(line) - 1, 0)) // 1000 + 1)) AS j FROM code_lines))""")
query("l01_chunk_code_by_size", "SELECT repo_url, path, block, n, start_line, end_line, content FROM sized_code")(
    lambda g: L.chunk_by_size(g.code_files))
query("l02_chunk_file_level", """
    SELECT repo_url, path AS file_path, 'file::' || path || '_chunk_' || idx AS chunk_id, 'file::' || path AS parent_id, 'File' AS parent_type,
           regexp_extract(path, '[^/]*$') AS parent_name, start_line, end_line, content
    FROM (SELECT *, row_number() OVER (PARTITION BY repo_url, path ORDER BY block, n) - 1 AS idx FROM sized)""")(
    lambda g: L.chunk_file_level(g.files))
query("l03_chunk_readme", """
    SELECT repo_url, path, 'readme::' || regexp_extract(repo_url, '([^/]*)[.]git$', 1) || '::' || path || '::' || idx AS chunk_id, idx * 10 AS start_line,
           idx * 10 + len(string_split(content, chr(10))) AS end_line, content, true AS is_readme
    FROM (SELECT *, row_number() OVER (PARTITION BY repo_url, path ORDER BY block, n) - 1 AS idx FROM sized_readme)""")(
    lambda g: L.chunk_readmes(g.files, g.files.filter("doc_id % 2 = 1").select("repo_url", "path")))
register("readme_lines", "SELECT s.* FROM size_lines s JOIN files f USING (repo_url, path) WHERE upper(f.name) IN ('README.MD', 'README') AND f.doc_id % 2 = 0")
register("sized_readme", _size_sql("readme_lines", 1000, 900))


def span_pairs(g):
    """Every three-line chunk next to its file; each third one is altered so that later rules are needed."""
    full = g.files.select("repo_url", F.col("path").alias("file_path"), F.col("content").alias("full"))
    n = F.col("n") % 3
    changed = F.when(n == 1, F.concat("content", F.lit("\nadded line\nand one more"))).when(
        n == 2, F.concat(F.lit("new first line\n"), "content")).otherwise(F.col("content"))
    return g.chunks.select("repo_url", "file_path", "chunk_id", changed.alias("chunk"), F.lit(1).alias("start_line")).join(
        full, ["repo_url", "file_path"])


query("l04_chunk_line_span", """
    SELECT c.repo_url, c.file_path, c.chunk_id, p.first_, p.first_ + len(string_split(c.content, chr(10))) - 1 AS last_ FROM chunks c JOIN (
      SELECT c.repo_url, c.chunk_id, len(string_split(substring(f.content, 1, instr(f.content, c.content) - 1), chr(10))) AS first_
      FROM chunks c JOIN files f ON f.repo_url = c.repo_url AND f.path = c.file_path) p USING (repo_url, chunk_id)""")(
    lambda g: L.chunk_line_span(g.chunks.select("repo_url", "file_path", "chunk_id", F.col("content").alias("chunk"), F.lit(1).alias("start_line")).join(
        g.files.select("repo_url", F.col("path").alias("file_path"), F.col("content").alias("full")), ["repo_url", "file_path"]))
    .drop("rule").withColumnsRenamed({"first": "first_", "last": "last_"}))
query("l04_chunk_line_span_rules")(lambda g: L.chunk_line_span(span_pairs(g)))
query("l05_chunk_line_window", """
    SELECT repo_url, path, n, n * 40 + 1 AS start_line, least(n * 40 + 40, len(ls)) AS end_line, array_to_string(list_slice(ls, n * 40 + 1, n * 40 + 40), chr(10)) AS content
    FROM (SELECT *, unnest(range(0, (len(ls) + 39) // 40)) AS n FROM (SELECT *, string_split(content, chr(10)) AS ls FROM files))""")(
    lambda g: L.chunk_by_line_window(g.files, 40))


def _any_sig(patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches(content, '(?m){p}')" for p in patterns) + ")"


def _sig_name(patterns) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(content, '(?m){p}', {g}), '')" for p, g in patterns) + ")"


register("sig", f"""
    SELECT repo_url, file_path, chunk_id, start_line, end_line, content, is_f AS is_function_signature, is_c AS is_class_signature,
           CASE WHEN is_f THEN {_sig_name(K.FUNCTION_NAME_PATTERNS)} END AS function_name, CASE WHEN is_c THEN {_sig_name(K.CLASS_NAME_PATTERNS)} END AS class_name
    FROM (SELECT *, {_any_sig(K.FUNCTION_SIGNATURES)} AS is_f, {_any_sig(K.CLASS_SIGNATURES)} AS is_c FROM code_chunks)""")
query("l06_signature_flags", "SELECT chunk_id, is_function_signature, is_class_signature, function_name, class_name FROM sig")(
    lambda g: C.signature_flags(g.code_chunks).select("chunk_id", "is_function_signature", "is_class_signature", "function_name", "class_name"))
query("l07_embed_chunks", """
    SELECT chunk_id, d, round(count(*) / any_value(norm), 4) AS weight FROM (
      SELECT chunk_id, d, sqrt(sum(c) OVER (PARTITION BY chunk_id)) AS norm FROM (
        SELECT chunk_id, d, cnt, cnt * 1.0 AS c FROM (
          SELECT chunk_id, d, count(*) OVER (PARTITION BY chunk_id, d) AS cnt FROM (
            SELECT chunk_id, ('0x' || substring(md5(w), 1, 4))::INT % 64 AS d FROM (
              SELECT chunk_id, unnest(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda x: x <> '')) AS w FROM chunks)))))
    GROUP BY chunk_id, d""")(
    lambda g: V.embed_chunks(g.chunks.select("chunk_id", "content")).select("chunk_id", F.posexplode("embedding").alias("d", "w"))
    .filter("w > 0").select("chunk_id", "d", F.round(F.col("w").cast("double"), 4).alias("weight")))
query("l08_missing_embeddings", """
    SELECT (SELECT count(*) FROM chunks) AS total, (SELECT count(*) FROM embedded_chunks) AS with_embedding,
           round((SELECT count(*) FROM embedded_chunks) / (SELECT count(*) FROM chunks) * 100, 4) AS pct""")(
    lambda g: V.embedding_counts(g.chunks, g.embedded_chunks))

# --- chunk assignment ------------------------------------------------------------------------------------
query("d28_assign_chunks", f"""
    WITH covering AS (
      SELECT c.repo_url, c.file_path, c.chunk_id, 1 AS level, -s.nesting_level AS r1, -CASE WHEN s.label = 'Function' AND c.is_function_signature THEN 4
             WHEN s.label = 'Class' AND c.is_class_signature THEN 3 WHEN s.label = 'Function' THEN 2 ELSE 1 END AS r2, s.start_line AS r3, s.label, s.unique_id
      FROM sig c JOIN nesting s ON s.repo_url = c.repo_url AND s.file_path = c.file_path AND s.start_line <= c.start_line AND s.end_line >= c.end_line),
    decl AS (SELECT repo_url, file_path, label, name, arg_min(unique_id, (start_line, unique_id)) AS unique_id, min(start_line) AS decl_line FROM symbols GROUP BY ALL),
    named AS (SELECT c.repo_url, c.file_path, c.chunk_id, 2 AS level, 0 AS r1, 0 AS r2, d.decl_line AS r3, d.label, d.unique_id FROM sig c JOIN decl d
      ON d.repo_url = c.repo_url AND d.file_path = c.file_path AND ((c.is_function_signature AND d.label = 'Function' AND d.name = c.function_name)
         OR (NOT c.is_function_signature AND c.is_class_signature AND d.label = 'Class' AND d.name = c.class_name))),
    mentioned AS (SELECT c.repo_url, c.file_path, c.chunk_id, 3 AS level, s.start_line AS r1, -s.end_line AS r2, CASE WHEN s.label = 'Function' THEN 0 ELSE 1 END AS r3, s.label, s.unique_id
      FROM sig c JOIN symbols s ON s.repo_url = c.repo_url AND s.file_path = c.file_path AND abs(c.start_line - s.start_line) < 10 AND contains(c.content, s.name)
      WHERE NOT c.is_function_signature AND NOT c.is_class_signature),
    own AS (SELECT repo_url, file_path, chunk_id, 4 AS level, 0 AS r1, 0 AS r2, 0 AS r3, 'File' AS label, 'file::' || file_path AS unique_id FROM sig)
    SELECT repo_url, file_path, chunk_id, unique_id AS parent_id, label AS parent_type, (['span', 'signature', 'mention', 'file'])[level] AS rule FROM (
      SELECT *, row_number() OVER (PARTITION BY repo_url, file_path, chunk_id ORDER BY level, r1, r2, r3, label, unique_id) AS rn FROM (
        SELECT * FROM covering UNION ALL SELECT * FROM named UNION ALL SELECT * FROM mentioned UNION ALL SELECT * FROM own)) WHERE rn = 1""")(
    lambda g: C.assign_chunks(g.code_chunks, g.symbols))
query("d30_proto_direct_load", """
    SELECT repo_url, path AS file_path, unique_id, name, start_line, end_line, false AS is_api, true AS is_data_model, 'message' AS type, 'Unknown' AS framework
    FROM proto_messages WHERE NOT contains(lower(unique_id), 'service')
    UNION ALL SELECT repo_url, path, unique_id, name, start_line, end_line, true, true, 'service', 'gRPC' FROM proto_messages WHERE contains(lower(unique_id), 'service')
    UNION ALL SELECT repo_url, path, unique_id, name, start_line, end_line, true, false, 'service', 'gRPC' FROM proto_services""")(
    lambda g: E.proto_direct_load(KS.proto_messages(g.code_files), KS.proto_services(g.code_files), g.files)[0])
query("d30_proto_file_edges", """
    SELECT repo_url, 'File' AS src_label, path AS src_id, 'CONTAINS' AS rel, 'Class' AS dst_label, unique_id AS dst_id FROM proto_messages
    UNION ALL SELECT repo_url, 'File', path, 'CONTAINS', 'Class', unique_id FROM proto_services""")(
    lambda g: E.proto_direct_load(KS.proto_messages(g.code_files), KS.proto_services(g.code_files), g.files)[1])

register("manifests", r"""
    SELECT repo_url, CASE WHEN endpoint_id % 20 < 15 THEN 'kubernetes-manifests/' || name || endpoint_id || '.yaml' ELSE 'docker-compose.yaml' END AS path, endpoint_id, name, service_name, method
    FROM endpoints""")


def manifests(g):
    """Manifest files rendered from the endpoints: Kubernetes documents for most repositories, compose files for the rest."""
    e = F.col("endpoint_id")
    k8s = F.concat(
        F.lit("apiVersion: apps/v1\nkind: Deployment\nmetadata:\n  name: "), "service_name", F.lit("\n  labels:\n    app: "), "name",
        F.lit("\n    verb: "), "method", F.lit("\nspec:\n  template:\n    spec:\n      containers:\n      - name: "), "name",
        F.lit("\n        image: img/"), "name", F.lit("\n---\napiVersion: v1\nkind: Service\nmetadata:\n  name: "), "name", F.lit("\n"))
    compose = F.concat(F.lit("version: 3\nservices:\n  svc_"), "name", F.lit(":\n    image: img/"), "method", F.lit("\n  db"), e.cast("string"),
                       F.lit(":\n    image: pg\n"))
    in_k8s = e % 20 < 15
    return g.endpoints.select(
        "repo_url", F.when(in_k8s, F.concat(F.lit("kubernetes-manifests/"), "name", e.cast("string"), F.lit(".yaml"))).otherwise(
            "docker-compose.yaml").alias("path"), F.when(in_k8s, k8s).otherwise(compose).alias("content"))


query("a05_scan_service_manifests", r"""
    SELECT repo_url, service_name, '- name: ' || name || chr(10) || '        image: img/' || name AS containers, 'app: ' || name || chr(10) || '    verb: ' || method AS labels,
           '' AS annotations, 'kubernetes' AS origin FROM manifests WHERE endpoint_id % 20 < 15
    UNION ALL SELECT repo_url, 'svc_' || name, 'image: img/' || method, '', '', 'compose' FROM manifests WHERE endpoint_id % 20 >= 15
    UNION ALL SELECT repo_url, 'db' || endpoint_id, 'image: pg', '', '', 'compose' FROM manifests WHERE endpoint_id % 20 >= 15""")(
    lambda g: S.scan_service_manifests(manifests(g)).select("repo_url", "service_name", F.regexp_replace("containers", r"\s+$", "").alias("containers"),
                                                            F.regexp_replace("labels", r"\s+$", "").alias("labels"), "annotations", "origin"))
query("d31_service_metadata", """
    SELECT s.name, s.repo_url, s.language, m.containers IS NOT NULL AS has_metadata, count(*) AS n FROM services s LEFT JOIN (
      SELECT service_name, name AS containers FROM manifests WHERE endpoint_id % 20 < 15) m ON m.service_name = s.name GROUP BY ALL""")(
    lambda g: E.service_metadata(g.services, S.scan_service_manifests(manifests(g)).drop("repo_url")).groupBy(
        "name", "repo_url", "language", F.col("containers").isNotNull().alias("has_metadata")).agg(F.count("*").alias("n")))
