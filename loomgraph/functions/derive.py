"""Scalar derivations. Every function takes and returns Columns, so they stay inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph import constants as K


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(text: Column, words: list[str]) -> Column:
    """True when the text contains one of the words, case-sensitive."""
    return any_of([text.contains(w) for w in words])


# --- repository urls -------------------------------------------------------------------------------------

def repo_name(url: Column) -> Column:
    """Folder-safe repository name."""
    bare = F.regexp_replace(F.regexp_replace(url, "/+$", ""), r"\.git$", "")
    safe = F.regexp_replace(F.substring_index(bare, "/", -1), "[^a-zA-Z0-9_]", "_")
    return (
        F.when(F.coalesce(url, F.lit("")) == "", "unknown_repo")
        .when(url.startswith("local://"), F.replace(url, F.lit("local://"), F.lit("")))
        .otherwise(safe)
    )


def _last_segment_set_trimmed(url: Column) -> Column:
    # The trim works on a set of characters, so "widgit" becomes "wid".
    return F.substring_index(F.rtrim(F.rtrim(url, F.lit("/")), F.lit(".git")), "/", -1)


def repo_name_loader(url: Column) -> Column:
    return F.translate(_last_segment_set_trimmed(url), ".-", "__")


def service_name(url: Column) -> Column:
    return F.when(F.coalesce(url, F.lit("")) == "", "unknown-service").otherwise(_last_segment_set_trimmed(url))


def display_name(url: Column) -> Column:
    return F.replace(F.substring_index(url, "/", -1), F.lit(".git"), F.lit(""))


def normalize_path(path: Column, url: Column) -> Column:
    """Drop a leading repository folder."""
    prefix = F.concat(repo_name(url), F.lit("/"))
    return F.when(F.startswith(path, prefix), F.substring(path, F.length(prefix) + 1, F.length(path))).otherwise(path)


# --- paths -----------------------------------------------------------------------------------------------

def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, or '' (a leading dot of a name is no extension)."""
    return F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]*)$", 1))


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def path_part(path: Column, index: int) -> Column:
    """Path component by zero-based index; negative counts from the end. Null when absent."""
    return F.try_element_at(F.split(path, "/"), F.lit(index + 1 if index >= 0 else index))


def detect_language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in K.LANGUAGE_BY_EXTENSION.items() for x in pair])
    return F.coalesce(table[extension(path)], F.lit("unknown"))


def is_documentation(path: Column, file_type: Column) -> Column:
    return (
        F.upper(path).contains("README")
        | F.lower(file_type).isin(K.DOC_FILE_TYPES)
        | path.contains("/docs/")
        | path.contains("/documentation/")
        | F.lower(path).endswith(".md")
    )


def is_readme_name(name: Column) -> Column:
    return F.lower(name).isin(K.README_NAMES)


def import_family(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for suffix, family in K.IMPORT_FAMILY.items():
        out = F.when(path.endswith(suffix), family).otherwise(out)
    return F.coalesce(out, F.lit("Other"))


# --- content ---------------------------------------------------------------------------------------------

def content_hash(content: Column) -> Column:
    return F.when(F.coalesce(content, F.lit("")) == "", "").otherwise(F.md5(content))


def snippet_language(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for language, pattern in reversed(K.SNIPPET_PATTERNS):
        out = F.when(text.rlike("(?id)" + pattern), language).otherwise(out)
    return out


def signature_match(text: Column, patterns: list[str]) -> Column:
    return any_of([text.rlike("(?md)" + p) for p in patterns])


def signature_name(text: Column, patterns: list[tuple[str, int]]) -> Column:
    """First non-empty capture among ordered patterns."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, "(?md)" + p, g), F.lit("")) for p, g in patterns])


def zero_vector_if_blank(text: Column, vector: Column, dim: int) -> Column:
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return F.when(F.coalesce(text, F.lit("")) == "", zeros).otherwise(vector)


def nested_to_json(value: Column) -> Column:
    return F.to_json(value)


# --- graph ids -------------------------------------------------------------------------------------------

def symbol_id(path: Column, name: Column) -> Column:
    return F.concat_ws("::", path, name)


def file_parent_id(path: Column) -> Column:
    return F.concat(F.lit("file::"), path)


def chunk_id(parent_id: Column, n: Column) -> Column:
    return F.concat(parent_id, F.lit("_chunk_"), n.cast("string"))


def readme_chunk_id(url: Column, path: Column, n: Column) -> Column:
    return F.concat_ws("::", F.lit("readme"), repo_name(url), path, n.cast("string"))


def section_id(title: Column, n: Column) -> Column:
    slug = F.replace(F.lower(title), F.lit(" "), F.lit("_"))
    return F.concat(F.lit("section_"), slug, F.lit("_chunk_"), n.cast("string"))


def json_key_id(key: Column) -> Column:
    return F.concat(F.lit("json_key::"), key)


def chunk_parent_type(parent_id: Column, chunk: Column) -> Column:
    """Kind of parent that the ids of a chunk point to."""
    parent, own = F.lower(parent_id), F.lower(chunk)
    second = F.coalesce(F.try_element_at(F.split(parent_id, "::"), F.lit(2)), F.lit(""))
    is_file = parent_id.startswith("file::")
    return (
        F.when(parent.contains("::class::"), "Class")
        .when(is_file & parent.contains("::function::"), "Function")
        .when(is_file, "File")
        .when(own.contains("_class_") | own.contains("::class"), "Class")
        .when(parent.contains("::function::") | own.contains("_function_") | own.contains("::func"), "Function")
        .when(~parent_id.contains("::"), "File")
        .when(second.rlike("^[A-Z]"), "Class")
        .otherwise("Function")
    )


def class_kind(path: Column, unique_id: Column, is_api: Column, is_data_model: Column) -> Column:
    """Struct (is_api, is_data_model, type, framework) of a class; protobuf entities are told apart by id."""
    uid, proto = F.lower(unique_id), path.endswith(".proto")
    service = proto & (is_api | uid.contains("service"))
    message = proto & ~service & (is_data_model | uid.contains("message"))
    return F.struct(
        (is_api | service).alias("is_api"),
        (is_data_model | message).alias("is_data_model"),
        F.when(service, "service").when(message, "message").otherwise("class").alias("type"),
        F.when(service, "gRPC").otherwise("Unknown").alias("framework"),
    )


# --- ranking ---------------------------------------------------------------------------------------------

def doc_boost(path: Column, is_doc: Column, score: Column) -> Column:
    factor = (
        F.when(path.contains("README.md"), K.BOOST_README_MD)
        .when(path.contains("README"), K.BOOST_README)
        .when(is_doc, K.BOOST_DOCUMENTATION)
        .when(path.contains("/docs/"), K.BOOST_DOCS_DIR)
        .otherwise(1.0)
    )
    return score * factor


def priority_rank(path: Column) -> Column:
    return (
        F.when(path.contains("README.md"), K.PRIORITY_README_MD)
        .when(path.contains("/docs/"), K.PRIORITY_DOCS_DIR)
        .otherwise(K.PRIORITY_OTHER)
    )


def is_high_level(question: Column) -> Column:
    return contains_any(F.lower(question), K.HIGH_LEVEL_TERMS)


def is_structure_question(question: Column) -> Column:
    return contains_any(F.lower(question), K.PROJECT_STRUCTURE_TERMS)


def is_graph_question(question: Column) -> Column:
    return contains_any(F.lower(question), K.GRAPH_TERMS)


def wants_readme_first(question: Column) -> Column:
    return contains_any(F.lower(question), K.README_FIRST_TERMS)


def question_topic(question: Column) -> Column:
    q = F.lower(question)
    return (
        F.when(q.contains("microservice") | q.contains("service"), "microservices")
        .when(q.contains("architecture"), "architecture")
        .when(contains_any(q, ["structure", "organization", "layout"]), "project_structure")
        .otherwise("overview")
    )


# --- chats -----------------------------------------------------------------------------------------------

def title_from_message(content: Column) -> Column:
    return F.when(F.length(content) > 30, F.concat(F.substring(content, 1, 30), F.lit("..."))).otherwise(content)


def needs_title(title: Column) -> Column:
    return (F.coalesce(title, F.lit("")) == "") | (title == "New Chat")


def share_title(title: Column) -> Column:
    return F.substring(title, 1, 50)
