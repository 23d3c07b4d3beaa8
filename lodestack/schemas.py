"""Table schemas. Fixed, never inferred; SCHEMA_VERSION stamps a written catalogue."""

SCHEMA_VERSION = 2

TABLES = {
    "departments": "id long, name string",
    "courses": "id long, code string, name string, department_id long",
    "course_aliases": "alias_norm string, alias string, course_id long, verified boolean",
    "sources": "id long, department_id long, label string, drive_folder_id string, last_synced_at timestamp",
    "raw_files": "id long, source_id long, drive_file_id string, path string, name string, extension string, mime_type string, modified_on date, url string, is_indexable boolean, first_seen_at timestamp, last_seen_at timestamp",
    "documents": "id long, raw_file_id long, course_id long, title string, drive_url string, mime_type string, academic_year int, semester int, instructor string, exam_type string, exam_number int, doc_type string, is_makeup boolean, has_solution boolean, syllabus_scope string, content_hash string, link_status string, extraction_method string, extraction_confidence double, extraction_notes string, reviewed boolean, created_at timestamp",
    "review_queue": "id long, document_id long, reason string, status string, created_at timestamp, resolved_at timestamp",
    "document_text": "document_id long, method string, quality double, pages int, text string, source_modified date, created_at timestamp",
    "llm_usage": "day date, requests int",
    "search_logs": "id long, user_hash string, query string, filters string, result_count int, clicked_document_id long, created_at timestamp",
    "reports": "id long, document_id long, type string, note string, created_at timestamp",
}
#: Tables that may have several parts, and the key by which later parts replace rows of earlier ones.
KEYS = {"document_text": "document_id"}
#: Tables of people's activity, which an exported snapshot leaves empty.
ACTIVITY = ["search_logs", "reports", "llm_usage"]

RAW_FILE = "drive_file_id string, path string, name string, extension string, mime_type string, modified_on date, url string, is_indexable boolean"
DOCUMENT_VIEW = "drive_file_id string, path string, name string, url string, doc_type string, exam_type string, exam_number int, academic_year int, is_makeup boolean, has_solution boolean, confidence double, method string, course_code string, course_name string, semester int, instructor string, syllabus_scope string"
