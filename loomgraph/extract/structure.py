"""Declarations, Markdown sections, protobuf entities and JSON keys. Every table is built inside the row of its file."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.functions import derive as D

BRACE_LANGUAGES = ["go", "java", "csharp", "javascript", "typescript"]
_MODIFIERS = (r"(?:public|private|protected|internal|static|final|abstract|sealed|partial|async|override|virtual|"
              r"synchronized|readonly|export|default)")
_NOT_CALLS = r"(?!(?:if|for|while|switch|catch|return|new|else|function|do|throw|await|using|lock)\b)"

# Declaration forms per language: (kind, pattern); group 1 is the name.
DECLARATIONS = {
    "python": [("function", r"^\s*(?:async\s+)?def\s+(\w+)"), ("class", r"^\s*class\s+(\w+)")],
    "go": [("function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*[(\[]"), ("struct", r"^type\s+(\w+)\s+struct\b"),
           ("interface", r"^type\s+(\w+)\s+interface\b")],
    "java": [("class", rf"^\s*(?:{_MODIFIERS}\s+)*class\s+(\w+)"), ("interface", rf"^\s*(?:{_MODIFIERS}\s+)*interface\s+(\w+)"),
             ("enum", rf"^\s*(?:{_MODIFIERS}\s+)*enum\s+(\w+)"),
             ("function", rf"^\s*(?:{_MODIFIERS}\s+)*{_NOT_CALLS}[\w<>\[\],.?]+\s+{_NOT_CALLS}(\w+)\s*\([^;]*?(?://[^\n]*)?$")],
    "csharp": [("class", rf"^\s*(?:{_MODIFIERS}\s+)*class\s+(\w+)"), ("interface", rf"^\s*(?:{_MODIFIERS}\s+)*interface\s+(\w+)"),
               ("enum", rf"^\s*(?:{_MODIFIERS}\s+)*enum\s+(\w+)"), ("struct", rf"^\s*(?:{_MODIFIERS}\s+)*struct\s+(\w+)"),
               ("function", rf"^\s*(?:{_MODIFIERS}\s+)+{_NOT_CALLS}[\w<>\[\],.?]+\s+(\w+)\s*\([^;]*?(?://[^\n]*)?$")],
    "javascript": [("class", rf"^\s*(?:{_MODIFIERS}\s+)*class\s+(\w+)"), ("interface", rf"^\s*(?:{_MODIFIERS}\s+)*interface\s+(\w+)"),
                   ("enum", rf"^\s*(?:{_MODIFIERS}\s+)*enum\s+(\w+)"),
                   ("function", rf"^\s*(?:{_MODIFIERS}\s+)*function\s*\*?\s*(\w+)"),
                   ("function", rf"^\s*(?:{_MODIFIERS}\s+)*(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>"),
                   ("function", rf"^\s+(?:{_MODIFIERS}\s+)*{_NOT_CALLS}(\w+)\s*\([^)]*\)\s*(?::\s*[\w<>\[\]]+\s*)?\{{")],
}
DECLARATIONS["typescript"] = DECLARATIONS["javascript"]


# What is no code: comments and literals, some of them over several lines. The longer quotes come first.
_QUOTED = r""" "(?:\\.|[^"\\\n])*" | '(?:\\.|[^'\\\n])*' """
_LONG = r""" "{3}.*?(?:"{3}|\Z) """
_NO_CODE = {
    "python": re.compile(rf""" \#[^\n]* | {_LONG} | '{{3}}.*?(?:'{{3}}|\Z) | {_QUOTED} """, re.S | re.X),
    "brace": re.compile(rf""" //[^\n]* | /\*.*?(?:\*/|\Z) | {_LONG} | {_QUOTED} | `(?:\\.|[^`\\])*` """, re.S | re.X),
}
_MARK = re.compile(r"[{}()\[\];]")
_ARROW = re.compile(r"=>\s*(?=\S)")


def _blank(text: str, language: str) -> str:
    """The text with comments and literals as spaces; line ends stay, and a literal stays one quote wide at its ends."""
    kind = "python" if language == "python" else "brace"
    return _NO_CODE[kind].sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][0] in "#/" else '"' + re.sub(r"[^\n]", " ", m[0][1:-1]) + '"', text)


def _ends_by_indent(text: str, starts: list[int]) -> list[tuple[int, int]]:
    """First decorator line (0-based) and last line of the block each start opens: before the next filled line that is not
    indented deeper.

    Lines that continue brackets or a literal belong to the line before them, whatever their indentation. Blank lines and
    comments may stand between decorators.
    """
    bare = _blank(text, "python")
    lines, at, depth, indent = bare.split("\n"), 0, 0, []
    inside = np.zeros(len(bare) + 1, bool)
    for m in _NO_CODE["python"].finditer(text):
        inside[m.start() + 1:m.end()] = True
    for line in lines:
        # -2: continues the line before; -1: blank or a comment.
        indent.append(-2 if depth > 0 or inside[at] else -1 if not line.strip() else len(line) - len(line.lstrip()))
        depth = max(0, depth + sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}"))
        at += len(line) + 1
    nxt, stack = [len(lines)] * len(lines), []
    for i, d in enumerate(indent):
        if d < 0:
            continue
        while stack and indent[stack[-1]] >= d:
            nxt[stack.pop()] = i
        stack.append(i)
    out = []
    for s in starts:
        e = nxt[s]
        while e - 1 > s and indent[e - 1] == -1:
            e -= 1
        first, above = s, s - 1
        while above >= 0 and (indent[above] < 0 or lines[above].lstrip().startswith("@")):
            if indent[above] >= 0:
                first = above
            above -= 1
        out.append((first, e))
    return out


def _ends_by_brace(text: str, language: str, starts: list[int]) -> list[int]:
    """Last line of each declaration: the brace that closes its first block, or the semicolon that ends it before one.

    The block may open any number of lines below. A declaration without either ends on its own line, an arrow function
    without a block where its expression ends.
    """
    bare = _blank(text, language)
    line_at = np.cumsum([0, *(len(x) + 1 for x in bare.split("\n"))])
    marks = [(m.start(), m[0]) for m in _MARK.finditer(bare)]
    places = np.array([at for at, _ in marks], dtype=int)
    closes, stack = {}, []
    for at, c in marks:
        if c == "{":
            stack.append(at)
        elif c == "}" and stack:
            closes[stack.pop()] = at
    line_of = lambda at: int(np.searchsorted(line_at, at, "right"))
    out = []
    for s in starts:
        begin, end = int(line_at[s]), s + 1
        arrow = _ARROW.search(bare, begin, int(line_at[s + 1]) - 1)
        expression = arrow is not None and bare[arrow.end()] != "{"
        depth, last = 0, begin
        for at, c in marks[int(np.searchsorted(places, begin)):]:
            if expression and depth == 0 and "\n" in bare[max(last, arrow.end()):at]:
                break
            last = at
            if c in "([" or (c == "{" and (depth or expression)):
                depth += 1
            elif c in ")]" or (c == "}" and (depth or expression)):
                depth -= 1
                end = line_of(at) if expression else end
                if depth < 0:
                    break
            elif c == "{":
                end = line_of(closes.get(at, len(bare)))
                break
            elif c == ";" and depth == 0:
                end = line_of(at)
                break
            elif c == "}":
                break
        out.append(max(end, s + 1))
    return out


@F.pandas_udf(T.ArrayType(T.StructType().add("first", "integer").add("last", "integer")))
def spans(language: pd.Series, content: pd.Series, starts: pd.Series) -> pd.Series:
    """First decorator line (0-based) and end line (1-based) for the 0-based start lines of a file's declarations."""
    out = []
    for lang, text, s in zip(language, content, starts):
        begins = [int(x) for x in s]
        found = [] if not begins else _ends_by_indent(text, begins) if lang == "python" else zip(
            begins, _ends_by_brace(text, lang, begins))
        out.append([{"first": a, "last": b} for a, b in found])
    return pd.Series(out)


def symbols(files: DataFrame) -> DataFrame:
    """Functions, classes, structs, interfaces and enums with their spans, text and, in Python, the decorators above."""
    def at(l: Column, i: Column) -> Column:
        kind, name = F.lit(None).cast("string"), F.lit(None).cast("string")
        for language, forms in reversed(DECLARATIONS.items()):
            k, n = F.lit(None).cast("string"), F.lit(None).cast("string")
            for form, pattern in reversed(forms):
                hit = l.rlike(pattern)
                k = F.when(hit, form).otherwise(k)
                n = F.when(hit, F.regexp_extract(l, pattern, 1)).otherwise(n)
            kind = F.when(F.col("language") == language, k).otherwise(kind)
            name = F.when(F.col("language") == language, n).otherwise(name)
        return F.struct(i.alias("i"), kind.alias("kind"), name.alias("name"))

    prepared = (
        files.filter(F.col("language").isin(list(DECLARATIONS)))
        .withColumn("lines", F.split("content", "\n"))
        .withColumn("decl", F.filter(F.transform("lines", at), lambda d: d["kind"].isNotNull()))
        .withColumn("span", spans("language", "content", F.transform("decl", lambda d: d["i"])))
    )
    return (
        prepared.select("repo_url", "path", "language", "lines", F.inline(F.arrays_zip("decl", "span")))
        .select("repo_url", F.col("path").alias("file_path"), "language", F.col("decl.kind").alias("kind"),
                F.col("decl.name").alias("name"), D.symbol_id(F.col("path"), F.col("decl.name")).alias("unique_id"),
                (F.col("decl.i") + 1).alias("start_line"), F.col("span.last").alias("end_line"),
                F.array_join(F.slice("lines", F.col("decl.i") + 1, F.col("span.last") - F.col("decl.i")), "\n").alias("text"),
                F.array_join(F.slice("lines", F.col("span.first") + 1, F.col("decl.i") - F.col("span.first")), "\n").alias("decorators"))
    )


def markdown_sections(files: DataFrame) -> DataFrame:
    """Header lines with level, title, span up to the next header, and the text between."""
    header = r"^(#+)\s+(.+)$"
    md = (
        files.filter("language = 'markdown'").withColumn("lines", F.split("content", "\n"))
        .withColumn("at", F.filter(F.transform("lines", lambda l, i: F.when(l.rlike(header), i)), lambda i: i.isNotNull()))
    )
    rows = md.select("repo_url", "path", "lines", "at", F.posexplode("at").alias("n", "i"))
    title_line = F.get("lines", F.col("i"))
    end = F.coalesce(F.get("at", F.col("n") + 1), F.size("lines"))
    title = F.trim(F.regexp_extract(title_line, header, 2))
    return rows.select(
        "repo_url", "path", title.alias("title"), F.length(F.regexp_extract(title_line, header, 1)).alias("level"),
        (F.col("i") + 1).alias("start_line"), end.alias("end_line"), D.section_id(title, F.col("n")).alias("unique_id"),
        F.array_join(F.slice("lines", F.col("i") + 2, end - F.col("i") - 1), "\n").alias("content"))


def _newlines_before(content: Column, pos: Column) -> Column:
    head = F.substring(content, F.lit(1), pos - 1)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))


# Forms of protobuf and JSON text.
PROTO_BLOCK = r"{word}\s+(\w+)\s*\{{([^{{}}]*(?:\{{[^{{}}]*\}}[^{{}}]*)*)\}}"
PROTO_FIELD = r"\s*(repeated|optional|required)?\s*(\w+)\s+(\w+)\s*=\s*(\d+)"
PROTO_METHOD = r"\s*rpc\s+(\w+)\s*\(\s*(\w+)\s*\)\s*returns\s*\(\s*(\w+)\s*\)"
PROTO_IMPORT = r'import\s+"([^"]+)";'
JSON_KEY = r'"([^"]+)"\s*:'


def _groups(text: str, pattern: str, names: list[str], first: int = 1) -> Column:
    """Array of structs with the groups of every match."""
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(k + first)).alias(n)
                          for k, n in enumerate(names)])


def proto_blocks(files: DataFrame, word: str) -> DataFrame:
    """``message`` or ``service`` blocks. A block starts at the first text ``word name`` and ends at the next brace."""
    rows = files.filter("language = 'protobuf'").select(
        "repo_url", "path", "content", F.inline(_groups("content", PROTO_BLOCK.format(word=word), ["name", "body"])))
    return (
        rows.withColumn("at", F.expr(f"locate(concat('{word} ', name), content)"))
        .withColumn("close", F.expr("locate('}', content, greatest(at, 1))"))
        .select("repo_url", "path", "name", D.symbol_id(F.col("path"), F.col("name")).alias("unique_id"),
                (_newlines_before(F.col("content"), F.col("at")) + 1).alias("start_line"),
                (_newlines_before(F.col("content"), F.col("close") + 1) + 1).alias("end_line"), "body")
    )


def proto_messages(files: DataFrame) -> DataFrame:
    return proto_blocks(files, "message")


def proto_fields(messages: DataFrame) -> DataFrame:
    return messages.select("repo_url", "path", F.col("name").alias("message"), F.inline(
        _groups("body", PROTO_FIELD, ["modifier", "type", "name", "number"]))).select(
        "repo_url", "path", "message", "name", "type",
        F.when(F.col("modifier") == "", "optional").otherwise(F.col("modifier")).alias("modifier"), "number")


def proto_services(files: DataFrame) -> DataFrame:
    return proto_blocks(files, "service")


def proto_methods(services: DataFrame) -> DataFrame:
    return services.select("repo_url", "path", F.col("name").alias("service"), F.inline(
        _groups("body", PROTO_METHOD, ["name", "request_type", "response_type"])))


def proto_imports(files: DataFrame) -> DataFrame:
    target = F.col("target")
    return files.filter("language = 'protobuf'").select(
        "repo_url", "path", F.explode(F.regexp_extract_all("content", F.lit(PROTO_IMPORT), F.lit(1))).alias("target")).select(
        "repo_url", "path", "target", F.substring_index(target, "/", -1).alias("name"),
        target.startswith("google/").alias("is_system"))


def json_keys(files: DataFrame) -> DataFrame:
    """Every quoted key; its line is that of the first place the quoted text occurs at."""
    rows = files.filter("language = 'json'").select(
        "repo_url", "path", "content", F.posexplode(F.regexp_extract_all("content", F.lit(JSON_KEY), F.lit(1))).alias("n", "name"))
    start = _newlines_before(F.col("content"), F.expr("locate(concat('\"', name, '\"'), content)")) + 1
    return rows.select("repo_url", "path", "n", "name", D.json_key_id(F.col("name")).alias("unique_id"),
                       start.alias("start_line"), (start + 1).alias("end_line"))


def config_flags(files: DataFrame) -> DataFrame:
    """What kind of document a file is, by language and, for protobuf, by its blocks."""
    language = F.col("language")
    has = lambda word: (language == "protobuf") & F.col("content").rlike(PROTO_BLOCK.format(word=word))
    return files.select("repo_url", "path", language.isin("yaml", "json").alias("is_config"),
                        (language == "markdown").alias("is_markdown"), has("message").alias("is_data_model"),
                        has("service").alias("is_api"))


def parse_status(files: DataFrame) -> DataFrame:
    """Files with a flag for text that cannot be parsed: absent, with NUL, or with bytes that were no UTF-8."""
    text = F.col("content")
    bad = text.isNull() | text.contains("\x00") | text.contains("�")
    return files.withColumn("parse_error", bad)
