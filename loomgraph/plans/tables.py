"""The projected tables themselves, checked row by row."""

from loomgraph.plans.registry import query


def _same(name: str, columns: str) -> None:
    query(f"t_{name}", f"SELECT {columns} FROM {name}")(
        lambda g, name=name, columns=columns: getattr(g, name).select(*[c.strip() for c in columns.split(",")]))


_same("files", "doc_id, repo_url, service_name, path, name, language, file_type, size, content_hash, is_documentation")
_same("lines", "repo_url, path, i, line")
_same("code_files", "repo_url, path, content")
_same("chunks", "repo_url, file_path, n, start_line, end_line, content, chunk_id, parent_id")
_same("code_chunks", "repo_url, file_path, n, content, chunk_id, parent_id")
_same("functions", "repo_url, file_path, unique_id, name, start_line, end_line, text")
_same("classes", "repo_url, file_path, unique_id, name, start_line, end_line, superclasses, interfaces")
_same("repositories", "url, name, description, last_indexed_commit_sha, current_sha, is_active")
_same("services", "name, repo_url, language")
_same("imports", "repo_url, source_path, line, target_text, import_name")
_same("endpoints", "endpoint_id, repo_url, service_name, name, path, method")
_same("data_models", "model_id, name, type, service_name, repo_url")
_same("chats", "id, user_id, title, created_at, share_path, payload_id, path, n_messages")
