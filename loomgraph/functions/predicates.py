"""Named row predicates, each a boolean Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph import constants as K
from loomgraph.functions.derive import contains_any


def keyword_match(content: Column, words: list[str]) -> Column:
    return contains_any(content, words)


def topic_match(content: Column, topic: str) -> Column:
    return content.contains(topic)


def documentation_file(path: Column, name: Column, is_doc: Column) -> Column:
    upper = F.upper(name)
    return is_doc | upper.contains("README") | upper.contains("LICENSE") | F.lower(path).endswith(".md")


def interface_name(name: Column) -> Column:
    return name.contains("Interface") | (name.startswith("I") & (F.length(name) > 1))


def size_class(content: Column) -> Column:
    """``large`` beyond the size guard, ``binary`` with a zero byte, else ``text``. Nothing is dropped; callers choose."""
    return F.when(F.length(content) > K.MAX_FILE_CHARS, "large").when(F.instr(content, "\x00") > 0, "binary").otherwise("text")


def parsed_and_not_blank(content: Column, parse_error: Column) -> Column:
    return ~parse_error & (F.regexp_replace(content, r"\s", "") != "")


def proto_file(path: Column, language: Column) -> Column:
    return path.endswith(".proto") | (language == "protobuf")


def proto_entity(path: Column, language: Column, kind: Column) -> Column:
    """Kind test binds to the language side only, as AND binds before OR."""
    return path.endswith(".proto") | ((language == "protobuf") & kind.isin("message", "service"))


def above_threshold(score: Column) -> Column:
    return score > K.SCORE_THRESHOLD


def top_level_dir(path: Column) -> Column:
    return (path == "") | ~path.contains("/")


def owned_or_shared(user_id: Column, share_path: Column, me: int) -> Column:
    return (user_id == me) | share_path.isNotNull()


def http_client_call(text: Column) -> Column:
    return contains_any(text, K.HTTP_CLIENT_WORDS)
