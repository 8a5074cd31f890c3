"""Schemas of the tables and of the nested payloads, as DDL (which needs no session to be written down)."""

from __future__ import annotations

WORK_TYPES = ("wfo", "wfh", "hybrid")
PRIORITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
MEMBER_STATUSES = ("active", "inactive", "terminated")
AUTH_TYPES = ("OAUTH", "API_KEY", "SAML")

TABLES: dict[str, str] = {
    "auth_clients": "id smallint, client_name string, client_code string, client_secret_hash string, auth_type string, is_active boolean, created_at timestamp",
    "auth_access_tokens": "id int, auth_client_id smallint, access_token string, expires_at timestamp, is_revoked boolean, issued_at timestamp",
    "requisition_status_master": "status_id smallint, status_key string, status_message string",
    "requisition_requests": "id int, request_id string, auth_client_id smallint, status smallint, client_name string, correlation_id string, received_at timestamp, completed_at timestamp",
    "requisition_detail": "id int, requisition_request_id int, payload_json string, payload_hash string, created_at timestamp",
    "category_master": "category_id smallint, category_name string, created_at timestamp",
    "skill_master": "skill_id string, skill_name string, category_id smallint, created_at timestamp",
    "team_member": "team_member_id string, designation string, profile_type string, is_active boolean, experience_in_months int, base_location string, work_type string, profile_url string, created_at timestamp",
    "team_member_allocation": "team_member_id string, project_id string, allocation_percentage decimal(5,2), start_date date, end_date date, billable boolean, is_deleted boolean",
    "team_member_skill": "team_member_id string, skill_id string, rating int, experience_in_months int, is_deleted boolean",
    "skill_certification": "id int, certification_id string, team_member_id string, skill_id string, certificate string, issuer string, issued_date date, valid_till date",
    "checkpoints": "id int, request_id string, node_name string, state_json string, token_count int, created_at timestamp",
}

#: Columns that name a row, and the columns that point to other tables.
KEYS = {
    "auth_clients": ["id"], "auth_access_tokens": ["id"], "requisition_status_master": ["status_id"], "requisition_requests": ["request_id"], "requisition_detail": ["requisition_request_id"], "category_master": ["category_id"],
    "skill_master": ["skill_id"], "team_member": ["team_member_id"], "team_member_allocation": ["team_member_id", "project_id"], "team_member_skill": ["team_member_id", "skill_id"], "skill_certification": ["id"], "checkpoints": ["id"],
}
FOREIGN_KEYS = [
    ("auth_access_tokens", ["auth_client_id"], "auth_clients", ["id"]), ("requisition_requests", ["auth_client_id"], "auth_clients", ["id"]), ("requisition_requests", ["status"], "requisition_status_master", ["status_id"]),
    ("requisition_detail", ["requisition_request_id"], "requisition_requests", ["id"]), ("checkpoints", ["request_id"], "requisition_requests", ["request_id"]), ("skill_master", ["category_id"], "category_master", ["category_id"]),
    ("team_member_skill", ["skill_id"], "skill_master", ["skill_id"]), ("team_member_skill", ["team_member_id"], "team_member", ["team_member_id"]), ("team_member_allocation", ["team_member_id"], "team_member", ["team_member_id"]),
    ("skill_certification", ["team_member_id", "skill_id"], "team_member_skill", ["team_member_id", "skill_id"]),
]
#: The status table's seed.
STATUS_SEED = [(1, "RECEIVED"), (2, "PROCESSING"), (3, "COMPLETED"), (4, "FAILED"), (5, "CANCELLED")]

EXPERIENCE = "struct<min_months: int, max_months: int>"
JOB = f"struct<client_name: string, title: string, role: string, jd_text: string, requisition_duration_month: int, expected_start_date: date, priority: string, location: array<string>, work_mode: array<string>, experience: {EXPERIENCE}, mandatory_skills: array<string>, preferred_skills: array<string>>"
JOB_FIELDS = ["client_name", "title", "role", "jd_text", "requisition_duration_month", "expected_start_date", "priority", "location", "work_mode", "experience", "mandatory_skills", "preferred_skills"]
_JOB_1_1 = "struct<client_name: string, title: string, role: string, jd_text: string, requisition_duration_month: int, expected_start_date: date, priority: string, location: array<string>, work_mode: array<string>, min_experience_months: int, max_experience_months: int, skills: array<struct<name: string, required: boolean>>>"
REQUISITION_COLUMNS = ["request_id", "schema_version", "source_system", "client_name", "job_description", "metadata"]
REQUISITION = (
    f"request_id string, schema_version string, source_system string, client_name string, job_description {JOB}, metadata struct<submitted_by: string, submitted_at: timestamp, department: string>"
)

#: A later minor version of the payload, read into the same table.
REQUISITION_1_1 = f"request_id string, schema_version string, source_system string, client_name string, job_description {_JOB_1_1}, metadata struct<submitted_by: string, submitted_at: timestamp, department: string>"

_CERT = "struct<certification_id: string, certificate: string, issuer: string, issued_date: date, valid_till: date>"
_SKILL = f"struct<skill_id: string, skill_name: string, rating: int, experience_in_months: int, category: string, is_deleted: boolean, certifications: array<{_CERT}>>"
_ALLOCATION = "struct<project_id: string, allocation_percentage: double, start_date: date, end_date: date, billable: boolean, is_deleted: boolean>"
MEMBER = f"struct<team_member_id: string, team_member_status: string, experience_in_months: int, full_name: string, designation: string, profile_type: string, base_location: string, work_type: string, profile_url: string, allocations: array<{_ALLOCATION}>, skills: array<{_SKILL}>>"
BATCH = (
    f"metadata struct<batch_id: string, timestamp: timestamp, total_records: int, batch_number: int, total_batches: int, records_in_batch: int, source_system: string, schema_version: string, status: struct<code: int, key: string, message: string>>, team_members array<{MEMBER}>"
)
