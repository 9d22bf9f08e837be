"""Fixed schemas of the engine's tables; absent strings are '', unknown times 0."""

VERSION = 2

SOURCES = "source_key string, harness string, path string, version string, indexed_at bigint"
SESSIONS = (
    "session_key string, harness string, native_id string, parent_id string, name string, cwd string, source_key string, source_path string, "
    "started_at bigint, updated_at bigint, git_branch string, git_remote string, generation bigint, cwd_key string"
)
CHUNKS = (
    "chunk_key string, session_key string, source_key string, entry_key string, entry_native_id string, entry_parent_id string, kind string, part int, role string, "
    "timestamp bigint, text string, text_hash string, tokens array<string>, grams array<string>, embedding array<float>, embedding_fingerprint string, generation bigint"
)
PARSER_ERRORS = "source_key string, harness string, path string, error string, created_at bigint"
MEMORIES = (
    "id string, canonical_path string, content_hash string, current_revision int, content string, scope string, project_key string, project_remote string, "
    "project_name string, source string, created_at bigint, updated_at bigint, archived_at bigint, tokens array<string>, grams array<string>, "
    "embedding array<float>, embedding_fingerprint string, indexed_at bigint"
)

#: What every log reader gives: one row a record, warning or failed file.
EVENTS = (
    "source_key string, path string, ord bigint, kind string, message string, ts bigint, session_id string, cwd string, name string, branch string, remote string, "
    "entry_id string, entry_parent string, role string, entry_kind string, counts boolean, text string"
)

TABLES = {"sources": SOURCES, "sessions": SESSIONS, "chunks": CHUNKS, "parser_errors": PARSER_ERRORS, "memories": MEMORIES}


def names(ddl: str) -> list[str]:
    return [f.split()[0] for f in ddl.split(", ")]
