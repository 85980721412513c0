"""Inheritance, HTTP endpoints and data models. Texts are cut by regular expressions inside the row of their file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import constants as K
from loomgraph.extract.members import blocks, statements
from loomgraph.extract.structure import _groups
from loomgraph.functions import derive as D
from loomgraph.operators.edges import union_all

# Class heads with their bases.
PY_CLASS = r"class\s+([A-Za-z0-9_]+)\s*\(([^)]*)\):"
JAVA_CLASS = r"class\s+([A-Za-z0-9_]+)(?:\s+extends\s+([A-Za-z0-9_]+))?(?:\s+implements\s+([^{]+))?"
# Route forms of the supported web frameworks.
FLASK_MARK = r"@(?:app|blueprint)\.route"
FLASK_ARGS = r"""^\(['"]([^'"]+)['"](?:,\s*methods=\[([^\]]+)\])?\)"""
PY_VERB_ARGS = r"""^(get|post|put|delete|patch)\(['"]([^'"]+)['"]"""
PY_ROUTE_ARGS = r"""^(?:route|get|post|put|delete)\(['"]([^'"]+)['"]"""
PY_METHODS = r"""methods=\[['"](GET|POST|PUT|DELETE|PATCH)['"]"""
EXPRESS_ROUTE = r"""(?:app|router)\.(get|post|put|delete|patch)\(['"]([^'"]+)['"]"""
GIN_ROUTE = r"""(?:r|router|g|gin|e|engine)\.(GET|POST|PUT|DELETE|PATCH|HEAD)\(['"]([^'"]+)['"]"""
ECHO_ROUTE = r"""(?:e|echo)\.(GET|POST|PUT|DELETE|PATCH|HEAD)\(['"]([^'"]+)['"]"""
GORILLA_ROUTE = r"""(?:r|router)\.HandleFunc\(['"]([^'"]+)['"]"""
GORILLA_METHOD = r"""Methods\(['"]([A-Z]+)['"]"""
# Table mapping forms and field types.
TABLE_NAME = r"""__tablename__\s*=\s*['"]([^'"]+)['"]"""
# Statements with a colon that annotate nothing, members of interfaces (name, ``?``, type or signature) and fields of structs.
NO_ATTRIBUTE = r"^(?:else|try|finally|except)\s*:"
TS_MEMBER = r"""(?s)^(?:readonly\s+)?(?!new\b\s*[(<])([\w$]+|"[^"]*"|'[^']*'|\[[^\]]*\])\s*(\?)?\s*(?::\s*(.*)|([(<].*)|)$"""
GO_FIELD = r"(?s)^(\w+(?:\s*,\s*\w+)*)[ \t]+([^`]+?)\s*(`[^`]*`)?$"
COLUMN_TYPES = ["Integer", "String", "Boolean", "DateTime", "Float"]

ENDPOINT = ["repo_url", "path", "name", "route", "method", "framework"]
MODEL = ["repo_url", "path", "name", "type", "fields"]


def _comma_list(text: Column) -> Column:
    parts = F.transform(F.split(text, ","), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda p: p != "")


def inheritance(files: DataFrame) -> DataFrame:
    """Class -> superclasses and interfaces; of several heads with one name in a file the last counts."""
    py = files.filter("language = 'python'").select(
        "repo_url", "path", F.posexplode(_groups("content", PY_CLASS, ["name", "bases"])).alias("n", "m")).select(
        "repo_url", "path", "n", "m.name", _comma_list(F.col("m.bases")).alias("superclasses"),
        F.array().cast("array<string>").alias("interfaces"))
    java = files.filter("language = 'java'").select(
        "repo_url", "path", F.posexplode(_groups("content", JAVA_CLASS, ["name", "base", "faces"])).alias("n", "m")).select(
        "repo_url", "path", "n", "m.name", F.filter(F.array("m.base"), lambda b: b != "").alias("superclasses"),
        _comma_list(F.col("m.faces")).alias("interfaces"))
    return py.unionByName(java).groupBy("repo_url", "path", "name").agg(
        F.max_by(F.struct("superclasses", "interfaces"), "n").alias("b")).select(
        "repo_url", "path", "name", "b.superclasses", "b.interfaces")


def _decorated(files: DataFrame, mark: str) -> DataFrame:
    """Text behind each mark up to the next one, with the name of the next ``def`` at or after it."""
    return (
        files.withColumn("pieces", F.split("content", mark))
        .withColumn("defs", F.transform("pieces", lambda p: F.nullif(F.regexp_extract(p, r"def\s+([A-Za-z0-9_]+)", 1), F.lit(""))))
        .filter(F.size("pieces") > 1)
        .select("repo_url", "path", "content", "defs", F.posexplode("pieces").alias("n", "piece")).filter("n > 0")
        .withColumn("function", F.get(F.filter(F.slice("defs", F.col("n") + 1, F.size("defs")),
                                               lambda d: d.isNotNull()), F.lit(0)))
        .drop("defs")
    )


def flask_routes(files: DataFrame) -> DataFrame:
    """One row per route and method; the function is the next one defined."""
    piece = F.col("piece")
    methods = F.regexp_extract(piece, FLASK_ARGS, 2)
    rows = _decorated(files.filter("language = 'python'"), FLASK_MARK).filter(
        piece.rlike(FLASK_ARGS) & F.col("function").isNotNull())
    return rows.select(
        "repo_url", "path", F.col("function").alias("name"), F.regexp_extract(piece, FLASK_ARGS, 1).alias("route"),
        F.explode(F.transform(F.split(F.when(methods == "", "'GET'").otherwise(methods), ","),
                              lambda m: F.regexp_replace(m, r"""^[\s'"]+|[\s'"]+$""", ""))).alias("method"),
        F.lit("Flask").alias("framework"))


def _imports_module(content: Column, module: str) -> Column:
    return content.rlike(rf"(?m)^\s*(?:import\s+(?:[\w., ]*[ ,])?{module}\b|from\s+{module}[.\w]*\s+import\b)")


def python_endpoints(files: DataFrame) -> DataFrame:
    """FastAPI verb routes, or Flask routes and shortcuts, by what the file imports (FastAPI first)."""
    content, piece = F.col("content"), F.col("piece")
    is_fastapi = _imports_module(content, "fastapi")
    is_flask = ~is_fastapi & _imports_module(content, "flask")
    rows = _decorated(files.filter("language = 'python'").filter(is_fastapi | is_flask), r"@app\.").filter(
        "function IS NOT NULL")
    # A decorator ends with its line.
    head = F.substring_index(piece, "\n", 1)
    fast = rows.filter(is_fastapi & piece.rlike(PY_VERB_ARGS)).select(
        "repo_url", "path", F.col("function").alias("name"), F.regexp_extract(piece, PY_VERB_ARGS, 2).alias("route"),
        F.upper(F.regexp_extract(piece, PY_VERB_ARGS, 1)).alias("method"), F.lit("FastAPI").alias("framework"))
    method = F.regexp_extract(head, PY_METHODS, 1)
    flask = rows.filter(is_flask & piece.rlike(PY_ROUTE_ARGS)).select(
        "repo_url", "path", F.col("function").alias("name"), F.regexp_extract(piece, PY_ROUTE_ARGS, 1).alias("route"),
        F.when(method == "", "GET").otherwise(method).alias("method"), F.lit("Flask").alias("framework"))
    return fast.unionByName(flask)


def sqlalchemy_models(symbols: DataFrame) -> DataFrame:
    """Mapped classes with table name, typed columns with constraints, and relationships.

    Fields are statements of the class body itself; what methods and inner classes assign is none.
    """
    text = F.col("text")
    mapped = (D.contains_any(text, ["__tablename__", "Column(", "relationship(", "ForeignKey("])
              | F.array_contains(_comma_list(F.regexp_extract(text, PY_CLASS, 2)), "Base"))
    name = lambda s: F.regexp_extract(s["target"], r"^(\w+)", 1)

    def column(s: Column) -> Column:
        d = s["value"]
        kind = F.lit("Unknown")
        for t in reversed(COLUMN_TYPES):
            kind = F.when(d.contains(t), t).otherwise(kind)
        target = F.regexp_extract(d, r"""ForeignKey\(['"]([^'"]+)['"]""", 1)
        return F.struct(name(s).alias("name"), kind.alias("type"), F.array_compact(F.array(
            F.when(d.contains("primary_key=True"), "PRIMARY KEY"), F.when(d.contains("unique=True"), "UNIQUE"),
            F.when(d.contains("nullable=False"), "NOT NULL"),
            F.when(target != "", F.concat(F.lit("FOREIGN KEY ("), target, F.lit(")"))))).alias("constraints"))

    def relation(s: Column) -> Column:
        related = F.regexp_extract(s["value"], r"""['"]([^'"]+)['"]""", 1)
        kind = F.concat(F.lit("Relationship<"), F.when(related == "", "Unknown").otherwise(related), F.lit(">"))
        return F.struct(name(s).alias("name"), kind.alias("type"), F.array().cast("array<string>").alias("constraints"))

    calls = lambda word: F.filter("body", lambda s: s["target"].rlike(r"^\w+\s*(?::|$)") & s["value"].rlike(rf"^(?:\w+\.)*{word}\s*\("))
    return symbols.filter((F.col("language") == "python") & (F.col("kind") == "class") & mapped).withColumn(
        "body", statements("text")).select(
        "repo_url", F.col("file_path").alias("path"), "name",
        F.nullif(F.regexp_extract(text, TABLE_NAME, 1), F.lit("")).alias("table_name"),
        F.concat(F.transform(calls("Column"), column), F.transform(calls("relationship"), relation)).alias("fields"))


def python_models(symbols: DataFrame) -> DataFrame:
    """Pydantic models and dataclasses with name, type, default and required flag of each attribute of the class body."""
    text, annotated = F.col("text"), r"(?s)^(\w+)\s*:\s*(.+)$"
    pydantic = F.regexp_extract(text, PY_CLASS, 2).contains("BaseModel")
    dataclass = F.col("decorators").rlike(r"(?m)^\s*@dataclass")
    fields = F.transform(F.filter("body", lambda s: s["target"].rlike(annotated) & ~s["target"].rlike(NO_ATTRIBUTE)), lambda s: F.struct(
        F.regexp_extract(s["target"], annotated, 1).alias("name"), F.regexp_extract(s["target"], annotated, 2).alias("type"),
        F.coalesce(s["value"], F.lit("")).alias("default"),
        (~F.coalesce(s["value"], F.lit("")).startswith("None")).alias("required")))
    return symbols.filter((F.col("language") == "python") & (F.col("kind") == "class") & (pydantic | dataclass)).withColumn(
        "body", statements("text")).select(
        "repo_url", F.col("file_path").alias("path"), "name",
        F.when(pydantic, "Pydantic").otherwise("Dataclass").alias("type"), fields.alias("fields"))


def _route_name(method: Column, route: Column) -> Column:
    return F.concat(method, F.lit("_"), F.replace(route, F.lit("/"), F.lit("_")))


def _verb_routes(rows: DataFrame, pattern: str, framework: str) -> DataFrame:
    found = rows.select("repo_url", "path", F.inline(_groups("content", pattern, ["verb", "route"])))
    method = F.upper("verb")
    return found.select("repo_url", "path", _route_name(method, F.col("route")).alias("name"), "route",
                        method.alias("method"), F.lit(framework).alias("framework"))


def js_endpoints(files: DataFrame) -> DataFrame:
    """Express routes of files that import express; else Next.js API files, one route per file for any method."""
    js = files.filter(F.col("language").isin("javascript", "typescript"))
    express = F.col("content").rlike(r"""(?:from\s+|require\(\s*)['"]express['"]""")
    routes = _verb_routes(js.filter(express), EXPRESS_ROUTE, "Express")
    p = F.col("path")
    handler = F.col("content").rlike(r"\bfunction\s+handler\b|export\s+default\b")
    pages = js.filter(~express & F.concat(F.lit("/"), p).contains("/pages/api/") & handler).select(
        "repo_url", "path", F.lit("handler").alias("name"),
        F.substring_index(F.regexp_extract(p, r"pages(/api/.*)$", 1), ".", 1).alias("route"), F.lit("ANY").alias("method"),
        F.lit("Next.js").alias("framework"))
    return routes.unionByName(pages)


def ts_models(files: DataFrame) -> DataFrame:
    """Interfaces with members (required without ``?``), and type aliases.

    Members are properties, methods (their type is the signature), index signatures and quoted names (without quotes).
    Call and construct signatures have no name and are no members. Types keep every inner level.
    """
    ts = files.filter(F.col("path").endswith(".ts") | F.col("path").endswith(".tsx"))
    fields = F.transform(F.filter("members", lambda m: m.rlike(TS_MEMBER)), lambda m: F.struct(
        F.regexp_replace(F.regexp_extract(m, TS_MEMBER, 1), r"""^['"]|['"]$""", "").alias("name"),
        F.concat(F.regexp_extract(m, TS_MEMBER, 3), F.regexp_extract(m, TS_MEMBER, 4)).alias("type"), (F.regexp_extract(m, TS_MEMBER, 2) == "").alias("required")))
    interfaces = ts.select("repo_url", "path", F.inline(blocks("content", r"\binterface\s+(\w+)", ";,\n", True))).select(
        "repo_url", "path", "name", F.lit("Interface").alias("type"), fields.alias("fields"))
    aliases = ts.select("repo_url", "path", F.explode(F.regexp_extract_all(
        "content", F.lit(r"(?m)^\s*(?:export\s+)?type\s+(\w+)[^=\n]*="), F.lit(1))).alias("name")).select(
        "repo_url", "path", "name", F.lit("Type").alias("type"),
        F.array().cast("array<struct<name:string,type:string,required:boolean>>").alias("fields"))
    return interfaces.unionByName(aliases)


def _class_blocks(files: DataFrame, language: str, annotation: str) -> DataFrame:
    """Classes with the annotations above them and their text up to the head of the next class."""
    head = (rf"((?:[ \t]*{annotation}[^\n]*\n)*)[ \t]*((?:(?:public|private|protected|internal|final|abstract|static|sealed|"
            r"partial)\s+)*class\s+(\w+)")
    block = rf"(?m)^{head}[\s\S]*?)(?=^(?:[ \t]*{annotation}[^\n]*\n)*[ \t]*(?:\w+[ \t]+)*class\s+\w|\z)"
    return files.filter(F.col("language") == language).select(
        "repo_url", "path", F.inline(_groups("content", block, ["annotations", "body", "class_name"])))


def _joined_route(base: Column, route: Column) -> Column:
    slash = (base != "") & ~base.endswith("/") & (route != "") & ~route.startswith("/")
    return F.concat(base, F.when(slash, "/").otherwise(""), route)


def _annotated_methods(blocks: DataFrame, annotation: str) -> DataFrame:
    method = (rf"(?m)^((?:[ \t]*{annotation}[^\n]*\n)+)[ \t]*(?:[\w<>\[\],.?]+\s+)+(\w+)\s*\(")
    keys = [c for c in blocks.columns if c != "body"]
    return blocks.select(*keys, F.inline(_groups("body", method, ["marks", "name"])))


def spring_endpoints(files: DataFrame) -> DataFrame:
    """Mapped methods of Spring controllers; the class path and the method path are joined with one slash."""
    blocks = _class_blocks(files, "java", r"@\w+")
    notes = F.col("annotations")
    controllers = blocks.filter(D.contains_any(notes, ["@RestController", "@Controller", "@RequestMapping"])).withColumn(
        "base", F.regexp_extract(notes, r"""@RequestMapping\(['"]([^'"]+)['"]""", 1))
    marks = F.col("marks")
    method, route = F.lit("GET"), F.lit("")
    request = marks.contains("@RequestMapping")
    named = F.regexp_extract(marks, r"method\s*=\s*RequestMethod\.([A-Z]+)", 1)
    method = F.when(request & (named != ""), named).otherwise("GET")
    route = F.when(request, F.regexp_extract(marks, r"""@RequestMapping\(.*?value\s*=\s*['"]([^'"]+)['"]""", 1)).otherwise("")
    for verb in ("Delete", "Put", "Post", "Get"):
        hit = marks.contains(f"@{verb}Mapping")
        method = F.when(hit, verb.upper()).otherwise(method)
        route = F.when(hit, F.regexp_extract(marks, rf"""@{verb}Mapping\((?:value\s*=\s*)?['"]([^'"]+)['"]""", 1)).otherwise(route)
    return _annotated_methods(controllers, r"@\w+").withColumn("own", route).filter("own <> ''").select(
        "repo_url", "path", "name", _joined_route(F.col("base"), F.col("own")).alias("route"), method.alias("method"),
        F.lit("Spring").alias("framework"))


def java_models(files: DataFrame) -> DataFrame:
    """Classes with a data annotation or a model name ending."""
    name = F.col("class_name")
    noted = D.contains_any(F.col("annotations"), ["@Entity", "@Data", "@Lombok", "@JsonIgnoreProperties"])
    named = D.any_of([name.endswith(s) for s in K.JAVA_MODEL_SUFFIXES])
    form = r"(?m)^[ \t]+(?:private|protected|public)\s+(?:(?:static|final)\s+)*([\w<>\[\],.?]+)\s+(\w+)\s*(?:=[^;]*)?;"
    fields = F.transform(_groups("body", form, ["type", "name"]), lambda f: F.struct(
        f["name"].alias("name"), f["type"].alias("type")))
    return _class_blocks(files, "java", r"@\w+").filter(noted | named).select(
        "repo_url", "path", name.alias("name"), F.lit("JavaBean").alias("type"), fields.alias("fields"))


def go_endpoints(files: DataFrame, go_imports: DataFrame) -> DataFrame:
    """Gin, else Echo, else Gorilla routes, by the import paths of the file."""
    t = F.col("target")
    frameworks = go_imports.groupBy("repo_url", "path").agg(
        F.bool_or(t.contains("gin")).alias("gin"), F.bool_or(t.contains("echo") & ~t.contains("gin")).alias("echo"),
        F.bool_or(t.contains("gorilla/mux")).alias("mux"))
    go = files.filter("language = 'go'").select("repo_url", "path", "content").join(frameworks, ["repo_url", "path"])
    gin = _verb_routes(go.filter("gin"), GIN_ROUTE, "Gin")
    echo = _verb_routes(go.filter("NOT gin AND echo"), ECHO_ROUTE, "Echo")
    first = F.regexp_extract("content", GORILLA_METHOD, 1)
    mux = go.filter("NOT gin AND NOT echo AND mux").select(
        "repo_url", "path", F.when(first == "", "GET").otherwise(first).alias("method"),
        F.explode(F.regexp_extract_all("content", F.lit(GORILLA_ROUTE), F.lit(1))).alias("route")).select(
        "repo_url", "path", _route_name(F.col("method"), F.col("route")).alias("name"), "route", "method",
        F.lit("GorillaMux").alias("framework"))
    return union_all([gin, echo, mux])


def go_models(files: DataFrame) -> DataFrame:
    """Structs with fields and tags; names that share a type are fields of their own, embedded types are none."""
    listed = F.filter("members", lambda m: m.rlike(GO_FIELD))
    fields = F.flatten(F.transform(listed, lambda m: F.transform(
        F.split(F.regexp_extract(m, GO_FIELD, 1), r"\s*,\s*"), lambda n: F.struct(
            n.alias("name"), F.regexp_extract(m, GO_FIELD, 2).alias("type"), F.regexp_extract(m, GO_FIELD, 3).alias("tags")))))
    return files.filter("language = 'go'").select("repo_url", "path", F.inline(blocks(
        "content", r"\btype\s+(\w+)\s*(?:\[[^\]{}\n]*\]\s*)?struct(?=\s*\{)", ";\n", False))).select(
        "repo_url", "path", "name", F.lit("Struct").alias("type"), fields.alias("fields"))


CS_ATTRIBUTE = r"\[[A-Z]\w*"


def aspnet_endpoints(files: DataFrame) -> DataFrame:
    """Methods of controllers (by attribute or name ending) with their verb; routes are joined with one slash."""
    notes, marks = F.col("annotations"), F.col("marks")
    controllers = _class_blocks(files, "csharp", CS_ATTRIBUTE).filter(
        D.contains_any(notes, ["[ApiController]", "[Controller]"]) | F.col("class_name").endswith("Controller")).withColumn(
        "base", F.regexp_extract(notes, r"""\[Route\(['"]([^'"]+)['"]""", 1))
    method = F.lit("GET")
    route = F.regexp_extract(marks, r"""\[Route\(['"]([^'"]+)['"]""", 1)
    for verb in ("Delete", "Put", "Post", "Get"):
        hit = marks.contains(f"[Http{verb}")
        own = F.regexp_extract(marks, rf"""\[Http{verb}\(['"]([^'"]+)['"]""", 1)
        method = F.when(hit, verb.upper()).otherwise(method)
        route = F.when(hit & (own != ""), own).otherwise(route)
    return _annotated_methods(controllers, CS_ATTRIBUTE).withColumn("own", route).filter("own <> '' OR base <> ''").select(
        "repo_url", "path", "name", _joined_route(F.col("base"), F.col("own")).alias("route"), method.alias("method"),
        F.lit("ASP.NET Core").alias("framework"))


def csharp_models(files: DataFrame) -> DataFrame:
    """Classes with a data attribute, a model name ending, or more properties than methods; controllers are left out."""
    name = F.col("class_name")
    prop = r"(?m)^[ \t]*(?:public|protected|internal|private)\s+(?:(?:static|virtual|required)\s+)*([\w<>\[\],.?]+)\s+(\w+)\s*\{\s*get"
    call = r"(?m)^[ \t]*(?:public|protected|internal|private)\s+(?:\w+\s+)*[\w<>\[\],.?]+\s+\w+\s*\("
    n_props, n_methods = F.regexp_count("body", F.lit(prop)), F.regexp_count("body", F.lit(call))
    noted = D.contains_any(F.col("annotations"), ["[Table", "[DataContract", "[Serializable"])
    named = D.any_of([name.endswith(s) for s in K.CSHARP_MODEL_SUFFIXES])
    fields = F.transform(_groups("body", prop, ["type", "name"]), lambda f: F.struct(
        f["name"].alias("name"), f["type"].alias("type")))
    return _class_blocks(files, "csharp", CS_ATTRIBUTE).filter(
        ~name.endswith("Controller") & (noted | named | ((n_props > 0) & (n_props > n_methods)))).select(
        "repo_url", "path", name.alias("name"), F.lit("Class").alias("type"), fields.alias("fields"))


def all_endpoints(files: DataFrame, go_imports: DataFrame) -> DataFrame:
    """Endpoints of every language, one pass per language over its own files."""
    return union_all([t.select(*ENDPOINT) for t in (
        python_endpoints(files), js_endpoints(files), spring_endpoints(files), go_endpoints(files, go_imports),
        aspnet_endpoints(files))])


def all_models(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Data models of every language with their fields as JSON text."""
    return union_all([t.select("repo_url", "path", "name", "type", F.to_json("fields").alias("fields")) for t in (
        python_models(symbols), ts_models(files), java_models(files), go_models(files), csharp_models(files))])
