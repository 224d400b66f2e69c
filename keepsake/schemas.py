"""Explicit schemas. Inference fails on empty arrays and all-null columns, so it is never used."""

# The first fourteen field names are those of manifests in existing backups.
MANIFEST = (
    "backup_id string, backup_timestamp string, source_lakehouse_name string, "
    "source_workspace_id string, backup_type string, tables array<string>, files_count bigint, "
    "backup_size_bytes bigint, include_delta_logs boolean, compressed boolean, start_time string, "
    "end_time string, duration_seconds double, fabric_version string, verification_passed boolean, "
    "backup_mode string, parent_folder string, chain array<string>, high_water_marks map<string,string>, "
    "failed_tables array<string>, "
    "copies array<struct<table_name:string,kind:string,low:string,high:string,rows:bigint,total_rows:bigint,checksum:string,total_checksum:string>>"
)

TABLE_METADATA = "table_name string, schema_json string, format string, source_path string"

LISTING = "location string, folder_name string, path string, length bigint, is_dir boolean, open boolean, error string"

LOG = "ts timestamp_ntz, level string, message string"

RUN_EVENT = (
    "eventType string, pipelineName string, executionId string, correlationId string, "
    "environment string, timestamp string, "
    "parameters struct<sourceLakehouse:string,backupLocation:string,backupMode:string>"
)
