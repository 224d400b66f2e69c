"""Typed parameters, checked before any job starts."""

from __future__ import annotations

from dataclasses import dataclass, field

MODES = ("age_based", "count_based", "size_based", "advanced")
POLICIES = ("none", "daily", "weekly", "monthly")
BACKUP_MODES = ("full", "incremental", "differential")
GIB = 1024**3

# The preservation counts used when none, or a bad one, is given.
DEFAULT_PRESERVE = (7, 4, 12)


def _require(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(message)


@dataclass(frozen=True)
class PreserveOptions:
    """Which newest-per-period backups are never deleted. ``daily`` < ``weekly`` < ``monthly``."""

    policy: str = "none"
    daily: int = DEFAULT_PRESERVE[0]
    weekly: int = DEFAULT_PRESERVE[1]
    monthly: int = DEFAULT_PRESERVE[2]

    def __post_init__(self):
        _require(self.policy in POLICIES, f"unknown preservation policy {self.policy!r}")
        _require(min(self.daily, self.weekly, self.monthly) >= 0, "preservation counts must be >= 0")

    @classmethod
    def from_text(cls, policy: str, daily: str, weekly: str, monthly: str) -> tuple["PreserveOptions", list[str]]:
        """Counts given as text; one bad count resets all three, with a warning."""
        try:
            return cls(policy, int(daily), int(weekly), int(monthly)), []
        except ValueError as exc:
            if policy not in POLICIES:
                raise
            return cls(policy), [f"preservation counts reset to {DEFAULT_PRESERVE}: {exc}"]


@dataclass(frozen=True)
class RetentionOptions:
    mode: str = "age_based"
    retention_days: int = 30
    max_count: int = 10
    max_size_bytes: int = 100 * GIB
    preserve: PreserveOptions = field(default_factory=PreserveOptions)

    def __post_init__(self):
        _require(self.mode in MODES, f"unknown cleanup mode {self.mode!r}")
        if self.mode in ("age_based", "advanced"):
            _require(self.retention_days > 0, "retention_days must be positive")
        if self.mode in ("count_based", "advanced"):
            _require(self.max_count > 0, "max_count must be positive")
        if self.mode in ("size_based", "advanced"):
            _require(self.max_size_bytes > 0, "max_size_bytes must be positive")


@dataclass(frozen=True)
class CleanupOptions:
    retention: RetentionOptions = field(default_factory=RetentionOptions)
    include_patterns: str = "backup_*"
    exclude_patterns: str = ""
    dry_run: bool = True
    write_report: bool = True


@dataclass(frozen=True)
class BackupOptions:
    source_name: str
    destination: str
    source_workspace_id: str = ""
    backup_type: str = "storage_account"
    backup_folder: str = ""
    mode: str = "full"
    fmt: str = "parquet"
    table_filter: str = "*"
    partition_filter: str = ""
    # tables the filter is for; none: all, and a table it does not apply to fails
    partition_filter_tables: tuple = ()
    compress: bool = True
    include_logs: bool = True
    verify: bool = True
    content_check: bool = False
    retention_days: int = 30
    parallel_tables: int = 4
    # table name -> increasing column, for incremental and differential copies
    high_water_columns: dict = field(default_factory=dict)
    # table name -> partition columns to keep in the copy's layout
    partition_columns: dict = field(default_factory=dict)

    def __post_init__(self):
        _require(bool(self.source_name.strip()), "source name is required")
        _require(bool(self.destination.strip()), "destination is required")
        _require(self.backup_type in ("storage_account", "lakehouse", "adls"),
                 f"unknown backup type {self.backup_type!r}")
        _require(self.mode in BACKUP_MODES, f"unknown backup mode {self.mode!r}")
        _require(self.parallel_tables > 0, "parallel_tables must be positive")


@dataclass(frozen=True)
class RestoreOptions:
    source: str
    target: str
    tables: str = ""
    overwrite: bool = True
    include_logs: bool = True
    validate_before: bool = True
    verify_after: bool = True
    fmt: str = "parquet"
    parallel_tables: int = 4

    def __post_init__(self):
        _require(bool(self.source.strip()), "restore source is required")
        _require(bool(self.target.strip()), "restore target is required")
        _require(self.source.rstrip("/") != self.target.rstrip("/"), "source and target must differ")


# Settings per environment.
ENVIRONMENTS = {
    "development": {"backupMode": "incremental", "retentionDays": 7, "cleanupEnabled": True, "preservePolicy": "daily"},
    "staging": {"backupMode": "full", "retentionDays": 14, "cleanupEnabled": True, "preservePolicy": "weekly"},
    "production": {"backupMode": "full", "retentionDays": 90, "cleanupEnabled": True, "preservePolicy": "monthly"},
}

# Retention presets per environment.
RETENTION_PRESETS = {
    "development": RetentionOptions("age_based", retention_days=7, max_count=5,
                                    preserve=PreserveOptions("daily", daily=3)),
    "staging": RetentionOptions("count_based", retention_days=14, max_count=10,
                                preserve=PreserveOptions("weekly")),
    "production": RetentionOptions("advanced", retention_days=90, max_count=20, max_size_bytes=500 * GIB,
                                   preserve=PreserveOptions("monthly")),
}
