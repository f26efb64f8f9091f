"""Row types and state names of runs, jobs, documents and archives."""

from __future__ import annotations

LEASE_SECONDS = 120
DEFAULT_MAX_ATTEMPTS = 3
#: Longest error text that a job or run keeps, in code points.
ERROR_LIMIT = 4000

PENDING, LEASED, DONE, FAILED = "pending", "leased", "done", "failed"
JOB_STATES = (DONE, LEASED, FAILED, PENDING)
RUNNING, COMPLETED = "running", "completed"

CONFIG_FIELDS = {"backend": "string", "glossary_path": "string", "max_attempts": "int", "model": "string", "output_path": "string", "selected_paths": "array<string>", "target_language": "string", "target_language_code": "string", "thinking": "string", "workers": "int"}
CONFIG = f"struct<{', '.join(f'{k}: {v}' for k, v in CONFIG_FIELDS.items())}>"
RUNS = f"run_id string, config {CONFIG}, state string, cancel_requested boolean, merge_state string, merge_worker_id string, started_at bigint, updated_at bigint, output_path string, error string"
JOBS = "run_id string, id bigint, xhtml_path string, locator array<int>, source string, result string, state string, worker_id string, lease_token string, lease_until bigint, attempts int, error string"
MEMBERS = "book string, member string, ordinal int, stored boolean, content binary"
DOCUMENTS = "book string, pos int, path string, in_spine boolean, is_nav boolean, properties array<string>, epub_types array<string>, title string, sample string"

#: Fields of a run that an update may set.
UPDATABLE = ("state", "merge_state", "merge_worker_id", "output_path", "error", "cancel_requested")
