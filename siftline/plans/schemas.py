"""Column contracts of the engine's tables, as DDL."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT = T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


# Built from types, not DDL: workers have no JVM to parse DDL with.
DOCUMENT = _struct(
    page_text=_TEXT,
    json_ld=T.ArrayType(_TEXT),
    open_graph=T.MapType(_TEXT, _TEXT),
    tables=T.ArrayType(_struct(headers=T.ArrayType(_TEXT), rows=T.ArrayType(T.ArrayType(_TEXT)))),
    blocks=T.ArrayType(_struct(tag=_TEXT, text=_TEXT, href=_TEXT, image_url=_TEXT)),
    truncated=T.BooleanType(),
)
SIGNALS = T.ArrayType(_struct(href=_TEXT, text=_TEXT, rel=_TEXT, aria_label=_TEXT))
PARSED = _struct(title=_TEXT, signals=SIGNALS, document=DOCUMENT)

TABLES = {
    "users": "id string, email string, auth_subject string, status string, created_at timestamp, updated_at timestamp",
    "projects": "id string, owner_id string, name string, status string, created_at timestamp, updated_at timestamp",
    "sources": "id string, project_id string, canonical_url string, domain string, created_at timestamp, updated_at timestamp",
    "extraction_jobs": "id string, project_id string, source_id string, status string, status_version int, task_description string, "
    "requested_fields array<string>, options struct<max_pages:int, max_records:int, follow_pagination:boolean, "
    "follow_relevant_links:boolean, extract_images:boolean, deduplicate:boolean, validate:boolean>, output_formats array<string>, "
    "progress_percent int, pages_discovered int, pages_processed int, records_found int, records_valid int, last_error_code string, "
    "last_error_message string, retryable boolean, attempt int, max_attempts int, cancel_requested_at timestamp, cancelled_by string, "
    "correlation_id string, lease_owner string, lease_expires_at timestamp, created_at timestamp, started_at timestamp, "
    "completed_at timestamp, updated_at timestamp",
    "extraction_plans": "id string, job_id string, version int, plan string, model_name string, provider_name string, "
    "schema_version string, prompt_version string, plan_hash string, status string, created_at timestamp",
    "pages": "id string, job_id string, url string, canonical_url string, status string, snapshot_key string, content_hash string, "
    "discovered_at timestamp, captured_at timestamp, final_url string, http_status int, content_type string, title string, "
    "viewport struct<width:int, height:int>, navigation_time_ms int, redirect_count int, browser_metadata string, "
    "discovered_via string, depth int, parent_page_id string, deduplication_key string, policy_decision string, "
    "relevance_score double, relevance_reason string, discovery_metadata string, visited_at timestamp, extraction_status string, "
    "extraction_metadata string, extraction_started_at timestamp, extraction_completed_at timestamp",
    "browser_artifacts": "id string, job_id string, page_id string, artifact_type string, storage_key string, media_type string, "
    "byte_size long, checksum string, expires_at timestamp, created_at timestamp",
    "records": "id string, job_id string, page_id string, payload string, content_hash string, confidence double, "
    "record_identity string, plan_version int, strategy string, provenance map<string,string>, extraction_metadata string, "
    "created_at timestamp",
    "validation_results": "id string, job_id string, record_id string, validation_run_id string, status string, findings string, "
    "schema_version string, ruleset_version string, plan_version int, quality string, "
    "summary struct<pass:int, fail:int, warn:int, unresolved:int>, created_at timestamp",
    "validation_runs": "id string, job_id string, run_number int, operation_key string, status string, schema_version string, "
    "ruleset_version string, plan_version int, summary string, started_at timestamp, completed_at timestamp, created_at timestamp",
    "export_jobs": "id string, job_id string, validation_run_id string, format string, request_key string, options string, "
    "status string, error_code string, error_message string, attempt int, started_at timestamp, created_at timestamp, "
    "completed_at timestamp",
    "generated_files": "id string, export_job_id string, filename string, storage_key string, media_type string, byte_size long, "
    "checksum string, expires_at timestamp, created_at timestamp",
    "progress_events": "id string, job_id string, sequence_no long, event_type string, payload string, correlation_id string, "
    "occurred_at timestamp",
    "idempotency_keys": "id string, project_id string, key string, request_hash string, job_id string, created_at timestamp",
    "work_outbox": "id string, job_id string, project_id string, command_type string, operation_key string, payload string, "
    "attempt int, available_at timestamp, published_at timestamp, created_at timestamp",
}

#: Keys that a table holds once; Parquet doesn't enforce them, append_unique does.
UNIQUE = {
    "users": [["email"], ["auth_subject"]],
    "sources": [["project_id", "canonical_url"]],
    "extraction_plans": [["job_id", "version"]],
    "pages": [["job_id", "canonical_url"]],
    "browser_artifacts": [["storage_key"]],
    "records": [["job_id", "record_identity"]],
    "validation_results": [["validation_run_id", "record_id"]],
    "validation_runs": [["operation_key"], ["job_id", "run_number"]],
    "export_jobs": [["job_id", "format", "request_key"]],
    "generated_files": [["storage_key"]],
    "progress_events": [["job_id", "sequence_no"]],
    "idempotency_keys": [["project_id", "key"]],
    "work_outbox": [["operation_key"]],
}


def schema(table: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[table])
