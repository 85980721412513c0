"""Projection of the given tables into the tables of a code graph.

Everything that belongs to one file is built from that file's own text with array expressions, so files, lines,
chunks, functions, classes and rendered source need no shuffle. The same formulas exist as SQL in
``plans/oracle_tables.py``.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import constants as K
from loomgraph.functions import derive as D
from loomgraph.session import materialize, spread

EXTENSIONS = ["py", "go", "java", "cs", "js", "ts", "proto", "json"]
ACTIVE_REPO = "https://git.example.org/src0.git"

# Source line templates per file type. Words w1..w3 are the first words of the prose line (capital: W1..W3),
# ref is the path of an earlier file of the same repository, text the prose line itself. A line whose template does not
# hold the prose line carries it behind a comment sign (Markdown: a blank), so no text is lost.
TEMPLATES = {
    "py": [
        "import {w1}, {w2}",
        "from {w1}.{w2} import {w3}, {w1}",
        "# see {ref}",
        "@dataclass",
        "class {W1}({W2}, {W3}):",
        "    __tablename__ = '{w1}'",
        "    {w1} = Column(String, nullable=False)",
        "    {w2}: int = None",
        "    def {w1}_{w2}(self, {w3}):",
        "        return requests.get(\"/{w1}/{w2}\")",
        "@app.route('/{w1}/{w2}', methods=['GET', 'POST'])",
        "def {w1}_view({w2}):",
        "    return {w1}",
        "@app.get(\"/{w2}/{w3}\")",
        "def {w2}_api():",
        "    return \"{w1}\"",
    ],
    "go": [
        "import (",
        "\t{w1} \"example.org/{w2}/{w3}\"",
        "\t\"example.org/{w1}/{w2}\"",
        ")",
        "import {w3} \"example.org/{w1}\"",
        "type {W1} struct {",
        "\t{W2} string",
        "}",
        "func {w1}_{w2}(r *gin.Engine) {",
        "\tr.GET(\"/{w1}/{w2}\", {w3})",
        "\tr.HandleFunc(\"/{w2}\", {w1}).Methods(\"POST\")",
        "\te.POST(\"/{w3}\", {w1})",
        "}",
        "// see {ref}",
    ],
    "java": [
        "import java.util.{W1};",
        "import static org.{w1}.{W2}.*;",
        "import org.{w2}.*;",
        "@RestController",
        "@RequestMapping(\"/{w1}\")",
        "public class {W1} extends {W2} implements {W3}, {W1} {",
        "    @GetMapping(\"/{w2}\")",
        "    public String {w1}(String {w2}) {",
        "        return restTemplate.fetch(\"{w3}\");",
        "    }",
        "}",
        "class {W2}DTO {",
        "    private String {w1};",
        "}",
    ],
    "cs": [
        "using System.{W1};",
        "using static {W1}.{W2};",
        "using {W3} = {W1}.{W2};",
        "[ApiController]",
        "[Route(\"api/{w1}\")]",
        "public class {W1}Controller : {W2} {",
        "    [HttpGet(\"{w2}\")]",
        "    public string {W2}(string {w3}) {",
        "        return http.request(\"{w1}\");",
        "    }",
        "}",
        "public class {W2}Dto {",
        "    public string {W3} { get; set; }",
        "}",
    ],
    "js": [
        "import {w1} from './{w2}';",
        "import { {w1}, {w2} as {w3} } from '../{w1}';",
        "import * as {w1} from \"{w2}\";",
        "import '{w1}/{w2}';",
        "const {w1} = require('{w2}/{w3}');",
        "require(\"{w1}\");",
        "function {w1}_{w2}({w3}) {",
        "  app.get('/{w1}/{w2}', {w3});",
        "  router.post(\"/{w2}\", {w1});",
        "}",
        "class {W1} extends {W2} {",
        "  {w1}() { return fetch(\"{w2}\"); }",
        "}",
    ],
    "ts": [
        "import { {w1} } from '../{w2}';",
        "export interface {W1} {",
        "  {w1}: string;",
        "  {w2}?: number;",
        "}",
        "type {W2} = { {w3}: string };",
        "export function {w1}({w2}) {",
        "  router.get('/{w1}', {w2});",
        "}",
        "import {w2} from \"{w3}\";",
    ],
    "proto": [
        "syntax = \"proto3\";",
        "import \"google/{w1}.proto\";",
        "import \"{w1}/{w2}.proto\";",
        "message {W1} {",
        "  repeated string {w1} = 1;",
        "  int32 {w2} = 2;",
        "}",
        "service {W2}Service {",
        "  rpc {W1} ({W2}) returns ({W3});",
        "}",
    ],
    "json": ["{", "  \"{w1}\": \"{w2}\",", "  \"{w2}\": {\"{w3}\": 1},", "  \"{w1}_{w3}\" : [],", "}"],
    "md": ["# {W1} {w2}", "{text}", "see {ref}", "## {W2} architecture {w3}", "The {w1} service and its workflow", "{text}",
           "### {w1}"],
}
COMMENTS = {"py": " # ", "md": " "}
# First line of a file, by doc_id: the web framework its routes belong to.
HEADERS = {
    "py": ["from fastapi import FastAPI", "from flask import Flask"],
    "go": ["import \"github.com/gin-gonic/gin\"", "import \"github.com/labstack/echo\"",
           "import \"github.com/gorilla/mux\""],
    "js": ["import express from \"express\";", "import next from 'next';"],
    "ts": ["import express from \"express\";"],
}


def _concat_sql(template: str) -> str:
    """SQL ``concat`` of a template; quotes and tabs become ``chr`` so every dialect reads it alike."""
    parts = []
    for piece in re.split(r"(\{(?:w[123]|W[123]|ref|text)\}|'|\t)", template):
        if piece == "":
            continue
        if piece == "'":
            parts.append("chr(39)")
        elif piece == "\t":
            parts.append("chr(9)")
        elif re.fullmatch(r"\{(w[123]|W[123]|ref|text)\}", piece):
            parts.append(piece[1:-1].replace("W", "cap_").replace("w", "low_"))
        else:
            parts.append(f"'{piece}'")
    return f"concat({', '.join(parts)})"


def render_sql(word, text: str, i: str) -> str:
    """CASE expression that renders source line ``i`` of a file. ``word(k)`` gives the SQL of word k (1-based)."""
    def bind(sql: str) -> str:
        for k in (1, 2, 3):
            w = f"coalesce({word(k)}, 'x{k}')"
            sql = sql.replace(f"low_{k}", f"lower({w})")
            sql = sql.replace(f"cap_{k}", f"concat(upper(substring({w}, 1, 1)), lower(substring({w}, 2)))")
        near = f"greatest(doc_id - 20 * (1 + {i} % 3), 0)"
        ref = f"concat('src/', lang, '/m', {near} % 7, '/doc_', {near}, '.', ext)"
        return re.sub(r"\bref\b", ref, re.sub(r"\btext\b", text, sql))

    branches = []
    for ext, lines in TEMPLATES.items():
        head, sign = HEADERS.get(ext, []), COMMENTS.get(ext, " // ")
        head, lines = ([t if "{text}" in t else f"{t}{sign}{{text}}" for t in ts] for ts in (head, lines))
        cases = [f"WHEN {i} = 0 AND doc_id % {len(head) + 1} = {k} THEN {bind(_concat_sql(h))}" for k, h in enumerate(head)]
        cases += [f"WHEN {i} % {len(lines)} = {k} THEN {bind(_concat_sql(t))}" for k, t in enumerate(lines)]
        branches.append(f"WHEN ext = '{ext}' THEN CASE {' '.join(cases)} END")
    return f"CASE {' '.join(branches)} END"


class Graph:
    """The code graph projected from one folder of given tables. Every attribute is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def docs(self) -> DataFrame:
        return spread(self.table("documents")).select(
            "doc_id", "text", "lang", "source",
            F.concat(F.lit("src/"), "lang", F.lit("/m"), F.col("doc_id") % 7).alias("dir"),
        )

    @cached_property
    def files(self) -> DataFrame:
        ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 8 + 1).cast("int"))
        path = (
            F.when(F.col("doc_id") % 23 == 0, F.concat("dir", F.lit("/d"), "doc_id", F.lit("/README.md")))
            .when(F.col("doc_id") % 29 == 0, F.concat("dir", F.lit("/docs/page_"), "doc_id", F.lit(".md")))
            .otherwise(F.concat("dir", F.lit("/doc_"), "doc_id", F.lit("."), ext))
        )
        p = F.col("path")
        return (
            self.docs.withColumn("path", path)
            .withColumn("ext", F.substring_index("path", ".", -1))
            .select(
                "doc_id", "lang", "ext",
                F.concat(F.lit("https://git.example.org/"), "source", F.lit(".git")).alias("repo_url"),
                F.col("source").alias("service_name"),
                "path",
                D.basename(p).alias("name"),
                D.detect_language(p).alias("language"),
                F.col("ext").alias("file_type"),
                F.length("text").cast("long").alias("size"),
                D.content_hash(F.col("text")).alias("content_hash"),
                D.is_documentation(p, F.col("ext")).alias("is_documentation"),
                F.col("text").alias("content"),
            )
        )

    @cached_property
    def file_lines(self) -> DataFrame:
        """Files with their text as an array of lines."""
        return self.files.withColumn("lines", F.split("content", "\n"))

    @cached_property
    def code_files(self) -> DataFrame:
        """Files whose text is rendered as source code of their type, line by line from the prose, whole lines."""
        words = "transform(split(content, chr(10)), l -> regexp_extract_all(l, '[A-Za-z]+', 0))"
        line = render_sql(lambda k: f"get(w, {k - 1})", "get(prose, i)", "i")
        return (
            self.files.withColumn("prose", F.split("content", "\n"))
            .withColumn("word_rows", F.expr(words))
            .withColumn("content", F.expr(f"array_join(transform(word_rows, (w, i) -> {line}), chr(10))"))
            .drop("word_rows")
        )

    @cached_property
    def lines(self) -> DataFrame:
        return self.files.select("repo_url", "path", "language",
                                 F.posexplode(F.split("content", "\n")).alias("i", "line"))

    @cached_property
    def chunks(self) -> DataFrame:
        return _three_line_chunks(self.files)

    @cached_property
    def code_chunks(self) -> DataFrame:
        return _three_line_chunks(self.code_files)

    @cached_property
    def functions(self) -> DataFrame:
        spans = """inline(transform(sequence(0, floor((size(lines) - 1) / 5)), b -> named_struct(
            'b', b, 'first_line', get(lines, cast(b * 5 as int)),
            'start_line', cast(b * 5 + 1 as int), 'end_line', cast(least(b * 5 + 5, size(lines)) as int),
            'text', array_join(slice(lines, cast(b * 5 + 1 as int), 5), chr(10)))))"""
        return (
            self.file_lines.selectExpr("repo_url", "service_name", "path as file_path", "language", spans)
            .withColumn("name", F.lower(F.regexp_extract("first_line", "[A-Za-z]+", 0)))
            .select(
                "repo_url", "service_name", "file_path", "language",
                F.concat("file_path", F.lit("::f"), "start_line", F.lit("_"), "name").alias("unique_id"),
                "name", "start_line", "end_line", "text",
            )
        )

    @cached_property
    def classes(self) -> DataFrame:
        spans = """inline(transform(sequence(0, floor((size(lines) - 1) / 15)), b -> named_struct(
            'words', slice(regexp_extract_all(get(lines, cast(b * 15 as int)), '[A-Za-z]+', 0), 1, 3),
            'start_line', cast(b * 15 + 1 as int), 'end_line', cast(least(b * 15 + 15, size(lines)) as int))))"""

        def cap(k: int):
            w = F.get("words", F.lit(k))
            return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000)))

        return (
            self.file_lines.selectExpr("repo_url", "service_name", "path as file_path", "language", spans)
            .withColumn("name", F.coalesce(cap(0), F.lit("")))
            .select(
                "repo_url", "service_name", "file_path", "language",
                F.concat("file_path", F.lit("::c"), "start_line", F.lit("_"), "name").alias("unique_id"),
                "name", "start_line", "end_line",
                F.array_compact(F.array(cap(1))).alias("superclasses"),
                F.array_compact(F.array(cap(2))).alias("interfaces"),
            )
        )

    @cached_property
    def symbols(self) -> DataFrame:
        cols = ["repo_url", "service_name", "file_path", "language", "unique_id", "name", "start_line", "end_line"]
        return self.functions.select(F.lit("Function").alias("label"), *cols).unionByName(
            self.classes.select(F.lit("Class").alias("label"), *cols))

    @cached_property
    def repositories(self) -> DataFrame:
        even = F.regexp_extract("source", "[0-9]+", 0).cast("int") % 2 == 0
        url = F.concat(F.lit("https://git.example.org/"), "source", F.lit(".git"))
        return (
            self.table("documents").select("source").distinct()
            .select(
                url.alias("url"), F.col("source").alias("name"), F.col("source").alias("service_name"),
                F.concat(F.lit("repository "), "source").alias("description"),
                F.md5("source").alias("last_indexed_commit_sha"),
                F.when(even, F.md5("source")).otherwise(F.md5(F.concat("source", F.lit("x")))).alias("current_sha"),
                (url == ACTIVE_REPO).alias("is_active"),
            )
        )

    @cached_property
    def services(self) -> DataFrame:
        from loomgraph.operators.rollups import primary_language

        return primary_language(self.files, ["repo_url", "service_name"]).select(
            F.col("service_name").alias("name"), "repo_url", "language")

    @cached_property
    def imports(self) -> DataFrame:
        """One import per line, aimed at another document of the same source."""
        n_docs = self.table("documents").agg(F.count("*")).scalar()
        target = self.docs.select(
            F.col("doc_id").alias("target_doc"), F.concat("dir", F.lit("/doc_"), "doc_id").alias("stem"),
            F.col("dir").alias("target_dir"))
        i, ext = F.col("i"), F.col("ext")
        text = (
            F.when(ext == "go", F.col("target_dir"))
            .when(ext.isin("js", "ts"), F.when(i % 2 == 0, F.col("stem")).otherwise(
                F.concat(F.lit("./doc_"), "target_doc")))
            .when((ext == "py") & (i % 3 == 0), F.concat(F.lit(".doc_"), "target_doc"))
            .otherwise(F.translate("stem", "/", "."))
        )
        return (
            self.files.select("doc_id", "repo_url", "path", "ext", F.posexplode(F.split("content", "\n")).alias("i", "l"))
            .withColumn("target_doc", (F.col("doc_id") + 20 * (1 + i % 7)) % n_docs)
            .join(target, "target_doc")
            .select(
                "repo_url", F.col("path").alias("source_path"), (i + 1).alias("line"),
                text.alias("target_text"),
                F.when(ext == "go", D.basename(F.col("target_dir")))
                .otherwise(F.concat(F.lit("doc_"), "target_doc")).alias("import_name"),
            )
        )

    @cached_property
    def endpoints(self) -> DataFrame:
        page = F.col("page_id")
        source = F.concat(F.lit("src"), page % 20)
        return self.table("pages").select(
            page.alias("endpoint_id"),
            F.concat(F.lit("https://git.example.org/"), source, F.lit(".git")).alias("repo_url"),
            source.alias("service_name"),
            F.lower(F.regexp_extract(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), "[A-Za-z]+", 0)).alias("name"),
            F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"),
            F.element_at(F.array(*map(F.lit, ["GET", "POST", "PUT", "DELETE"])), (page % 4 + 1).cast("int"))
            .alias("method"),
        )

    @cached_property
    def data_models(self) -> DataFrame:
        source = F.concat(F.lit("src"), F.regexp_extract("p_brand", "[0-9]+", 0).cast("int") % 20)
        return self.table("part").select(
            F.col("p_partkey").alias("model_id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"),
            source.alias("service_name"),
            F.concat(F.lit("https://git.example.org/"), source, F.lit(".git")).alias("repo_url"),
        )

    @cached_property
    def embedded_chunks(self) -> DataFrame:
        """One chunk with the whole text of each document that has a vector."""
        vectors = self.table("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
        file_id = D.file_parent_id(F.col("path"))
        whole = self.files.select(
            "doc_id", "repo_url", "service_name", F.col("path").alias("file_path"), "language", "is_documentation",
            F.lit(0).cast("long").alias("n"), F.lit(1).alias("start_line"), F.size(F.split("content", "\n")).alias("end_line"),
            "content", D.chunk_id(file_id, F.lit(0)).alias("chunk_id"), file_id.alias("parent_id"))
        return whole.join(vectors, "doc_id")

    @cached_property
    def messages(self) -> DataFrame:
        return self.table("conversations").select(
            F.col("conv_id").alias("chat_id"), F.col("turn").cast("long").alias("turn"), "role",
            F.col("text").alias("content"))

    @cached_property
    def chats(self) -> DataFrame:
        """Chat headers; the messages stay rows of their own, so no chat is ever collected into one value."""
        cid = F.col("chat_id")
        created = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=cid.cast("int"))
        return (
            self.messages.groupBy("chat_id")
            .agg(F.max_by("content", F.when(F.col("role") == "user", -F.col("turn"))).alias("first_user"),
                 F.count("*").alias("n_messages"))
            .select(
                cid.alias("id"), (cid % 10).alias("user_id"),
                F.when(cid % 5 == 0, "New Chat")
                .otherwise(F.coalesce(D.title_from_message(F.col("first_user")), F.lit("New Chat"))).alias("title"),
                F.date_format(created, "yyyy-MM-dd HH:mm:ss").alias("created_at"),
                F.when(cid % 4 == 0, F.concat(F.lit("/share/"), cid)).alias("share_path"),
                F.when(cid % 9 == 0, cid + 1).otherwise(cid).alias("payload_id"),
                F.when(cid % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("/chat/"), cid)).alias("path"),
                "n_messages",
            )
        )

    @cached_property
    def edges(self) -> DataFrame:
        from loomgraph.operators.edges import base_edges

        return base_edges(self)

    @cached_property
    def edge_table(self) -> DataFrame:
        """The edges as a written table, for jobs that read them several times."""
        return materialize(self.edges)

    @cached_property
    def stored_edge_table(self) -> DataFrame:
        return materialize(self.stored_edges)

    @cached_property
    def stored_edges(self) -> DataFrame:
        """The edges of a damaged store: about a quarter is missing."""
        return self.edges.filter(F.substring(F.md5(F.concat("src_id", "dst_id")), 1, 1) > "3")


def _three_line_chunks(files: DataFrame) -> DataFrame:
    spans = """inline(transform(sequence(0, floor((size(lines) - 1) / 3)), n -> named_struct(
        'n', n, 'start_line', cast(n * 3 + 1 as int), 'end_line', cast(least(n * 3 + 3, size(lines)) as int),
        'block', floor(n * 3 / 5), 'head', get(prose, cast(floor(n * 3 / 5) * 5 as int)),
        'content', array_join(slice(lines, cast(n * 3 + 1 as int), 3), chr(10)))))"""
    prose = F.col("prose") if "prose" in files.columns else F.split("content", "\n")
    inside = F.floor((F.col("end_line") - 1) / 5) == F.col("block")
    function_id = F.concat("path", F.lit("::f"), F.col("block") * 5 + 1, F.lit("_"),
                           F.lower(F.regexp_extract("head", "[A-Za-z]+", 0)))
    return (
        files.withColumn("lines", F.split("content", "\n")).withColumn("prose", prose)
        .selectExpr("repo_url", "service_name", "path", "language", "doc_id", "is_documentation", spans)
        .select(
            "repo_url", "service_name", F.col("path").alias("file_path"), "language", "doc_id", "is_documentation", "n",
            "start_line", "end_line", "content",
            D.chunk_id(D.file_parent_id(F.col("path")), F.col("n")).alias("chunk_id"),
            F.when(inside, function_id).otherwise(D.file_parent_id(F.col("path"))).alias("parent_id"),
        )
    )
