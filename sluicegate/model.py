"""Types, registry schemas and template configuration."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# They define the data model and must stay as they are.
# ---------------------------------------------------------------------------

DATA_TYPES = ("STRING", "INTEGER", "LONG", "BIGINT", "DOUBLE", "DECIMAL", "BOOLEAN", "DATE", "TIMESTAMP")
FILE_FORMATS = ("csv", "xlsx")
WRITE_MODES = ("append", "overwrite")
BAD_ROW_ACTIONS = ("fail", "drop")
REVIEWER_TYPES = ("required", "optional")
APPROVAL_ACTIONS = ("approved", "rejected")
DECISIONS = ("approve", "reject")

TEMPLATE_STATUSES = (
    "Draft",
    "Pending Approval",
    "Pending DDL",
    "Approved",
    "Rejected",
    "DDL Failed",
    "Deprecated",
)
UPLOAD_STATUSES = (
    "in_progress",
    "file_uploaded",
    "schema_validated",
    "constraints_checked",
    "writing_to_catalog",
    "completed",
    "failed",
    "partial",
)
FINISHED_UPLOAD_STATUSES = ("completed", "failed", "partial")
ERROR_TYPES = ("NOT_NULL", "UNIQUE", "TYPE_MISMATCH", "SCHEMA_MISMATCH", "ENCODING_ERROR")

IDENTIFIER_PATTERN = "^[a-z][a-z0-9_]*$"
TOKEN_EXPIRY_DAYS = 30
REMINDER_DAYS = 3
MAX_UPLOAD_BYTES = 100 * 1024 * 1024
AUDIT_COLUMNS = (("uploaded_by", "STRING"), ("uploaded_at", "TIMESTAMP"), ("source_file", "STRING"))
PII_COMMENT = "PII - masked"
MASK_WIDTH = 8

# Legal status changes of a template, from -> to.
LEGAL_TRANSITIONS = (
    ("Draft", "Pending Approval"),
    ("Pending Approval", "Pending DDL"),
    ("Pending Approval", "Draft"),
    ("Pending DDL", "Approved"),
    ("Pending DDL", "DDL Failed"),
    ("Approved", "Deprecated"),
)

# ---------------------------------------------------------------------------
# Types
# ---------------------------------------------------------------------------

_SIMPLE_TYPES: dict[str, T.DataType] = {
    "STRING": T.StringType(),
    "INTEGER": T.IntegerType(),
    "LONG": T.LongType(),
    "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(),
    "TIMESTAMP": T.TimestampType(),
}
_DECIMAL = re.compile(r"DECIMAL\s*(?:\(\s*(\d+)\s*,\s*(\d+)\s*\))?", re.IGNORECASE)


def spark_type(data_type: str) -> T.DataType:
    """Spark type of a template column type; a bare DECIMAL is DECIMAL(10,0)."""
    simple = _SIMPLE_TYPES.get(data_type.strip().upper())
    if simple is not None:
        return simple
    found = _DECIMAL.fullmatch(data_type.strip())
    if found is None:
        raise ValueError(f"unsupported column type: {data_type!r}")
    if found.group(1) is None:
        return T.DecimalType(10, 0)
    return T.DecimalType(int(found.group(1)), int(found.group(2)))


# ---------------------------------------------------------------------------
# Template configuration (one template's settings, driver side)
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class ColumnConfig:
    column_name: str
    data_type: str = "STRING"
    description: str | None = None
    is_included: bool = True
    is_pii: bool = False
    is_nullable: bool = True
    is_unique: bool = False
    column_order: int = 0

    @property
    def type(self) -> T.DataType:
        return spark_type(self.data_type)

    @property
    def comment(self) -> str:
        """Column comment: the PII flag, the description, or both."""
        parts = ([PII_COMMENT] if self.is_pii else []) + ([self.description] if self.description else [])
        return " | ".join(parts)


@dataclass(frozen=True)
class TemplateConfig:
    columns: tuple[ColumnConfig, ...]
    template_id: Any = None
    fully_qualified_name: str = ""
    description: str = ""
    delimiter: str = ","
    encoding: str = "UTF-8"
    file_format: str = "csv"
    multi_line: bool = False  # quoted cells may hold line breaks
    write_mode: str = "append"
    bad_row_threshold: Any = "5.00"
    bad_row_action: str = "drop"
    reader_group: str | None = None
    extra: Mapping[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        ordered = tuple(sorted(self.columns, key=lambda c: c.column_order))
        names = [c.column_name for c in ordered]
        if len(set(names)) != len(names):
            raise ValueError(f"duplicate column names: {sorted({n for n in names if names.count(n) > 1})}")
        if self.write_mode not in WRITE_MODES:
            raise ValueError(f"unknown write mode: {self.write_mode!r}")
        if self.bad_row_action not in BAD_ROW_ACTIONS:
            raise ValueError(f"unknown bad row action: {self.bad_row_action!r}")
        object.__setattr__(self, "columns", ordered)

    @property
    def included(self) -> tuple[ColumnConfig, ...]:
        return tuple(c for c in self.columns if c.is_included)

    @property
    def unique(self) -> tuple[ColumnConfig, ...]:
        return tuple(c for c in self.included if c.is_unique)

    @classmethod
    def from_rows(cls, columns: Iterable[Any], **settings: Any) -> TemplateConfig:
        """Build a config from template_columns rows (Row, dict or ColumnConfig)."""
        known = ColumnConfig.__dataclass_fields__
        parsed = []
        for c in columns:
            if isinstance(c, ColumnConfig):
                parsed.append(c)
                continue
            values = c if isinstance(c, Mapping) else c.asDict()
            parsed.append(ColumnConfig(**{k: v for k, v in values.items() if k in known}))
        return cls(columns=tuple(parsed), **settings)


# ---------------------------------------------------------------------------
# Registry schemas: fixed values, names and types of the registry tables
# ---------------------------------------------------------------------------

_S, _I, _L, _B, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.TimestampType()


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


REGISTRY_SCHEMAS: dict[str, T.StructType] = {
    "domains": _struct(
        ("id", _S, False),
        ("name", _S, False),
        ("uc_schema_name", _S, False),
        ("description", _S, True),
        ("created_at", _TS, False),
        ("updated_at", _TS, False),
        ("created_by", _S, True),
    ),
    "templates": _struct(
        ("id", _S, False),
        ("name", _S, False),
        ("display_name", _S, False),
        ("description", _S, True),
        ("domain_id", _S, False),
        ("uc_table_name", _S, False),
        ("fully_qualified_name", _S, False),
        ("file_format", _S, False),
        ("delimiter", _S, False),
        ("encoding", _S, False),
        ("write_mode", _S, False),
        ("bad_row_threshold", T.DecimalType(5, 2), False),
        ("bad_row_action", _S, False),
        ("storage_path", _S, True),
        ("reader_group", _S, True),
        ("status", _S, False),
        ("version", _I, False),
        ("parent_template_id", _S, True),
        ("created_by", _S, False),
        ("created_at", _TS, False),
        ("updated_at", _TS, False),
        ("approved_at", _TS, True),
        ("databricks_ddl_run_id", _S, True),
    ),
    "template_columns": _struct(
        ("id", _S, False),
        ("template_id", _S, False),
        ("column_name", _S, False),
        ("display_name", _S, True),
        ("data_type", _S, False),
        ("description", _S, True),
        ("is_included", _B, False),
        ("is_pii", _B, False),
        ("is_nullable", _B, False),
        ("is_unique", _B, False),
        ("column_order", _I, False),
        ("created_at", _TS, False),
    ),
    "template_reviewers": _struct(
        ("id", _S, False),
        ("template_id", _S, False),
        ("reviewer_email", _S, False),
        ("reviewer_name", _S, True),
        ("reviewer_type", _S, False),
        ("created_at", _TS, False),
    ),
    "template_approvals": _struct(
        ("id", _S, False),
        ("template_id", _S, False),
        ("reviewer_email", _S, False),
        ("reviewer_name", _S, True),
        ("action", _S, True),
        ("comment", _S, True),
        ("approval_token", _S, False),
        ("token_used", _B, False),
        ("token_expires_at", _TS, False),
        ("actioned_at", _TS, True),
        ("created_at", _TS, False),
    ),
    "upload_history": _struct(
        ("id", _S, False),
        ("template_id", _S, False),
        ("uploaded_by", _S, False),
        ("uploaded_at", _TS, False),
        ("updated_at", _TS, False),
        ("original_filename", _S, False),
        ("stored_filename", _S, True),
        ("storage_path", _S, True),
        ("file_size_bytes", _L, True),
        ("total_rows", _L, True),
        ("valid_rows", _L, True),
        ("invalid_rows", _L, True),
        ("dropped_rows", _L, True),
        ("status", _S, False),
        ("error_summary", _S, True),
        ("databricks_run_id", _S, True),
        ("dlt_rows_written", _L, True),
        ("dlt_rows_dropped", _L, True),
        ("dlt_event_log_path", _S, True),
        ("completed_at", _TS, True),
    ),
    "upload_validation_errors": _struct(
        ("upload_id", _S, False),
        ("row_number", _L, False),
        ("column_name", _S, False),
        ("error_type", _S, False),
        ("error_message", _S, False),
        ("raw_value", _S, True),
    ),
}

# Child table, child column, parent table, delete rule
FOREIGN_KEYS = (
    ("templates", "domain_id", "domains", "restrict"),
    ("templates", "parent_template_id", "templates", "restrict"),
    ("template_columns", "template_id", "templates", "cascade"),
    ("template_reviewers", "template_id", "templates", "cascade"),
    ("template_approvals", "template_id", "templates", "cascade"),
    ("upload_history", "template_id", "templates", "restrict"),
    ("upload_validation_errors", "upload_id", "upload_history", "cascade"),
)
UNIQUE_KEYS = (
    ("domains", ("name",)),
    ("domains", ("uc_schema_name",)),
    ("templates", ("fully_qualified_name",)),
    ("template_columns", ("template_id", "column_name")),
    ("template_reviewers", ("template_id", "reviewer_email")),
    ("template_approvals", ("approval_token",)),
)

# The domains every new registry starts with.
SEED_DOMAINS = (
    ("Finance", "finance", "Financial data including cost centers, GL codes and budget mappings"),
    ("Human Resources", "human_resources", "HR data including employee mappings, org structures and job codes"),
    ("Supply Chain", "supply_chain", "Supply chain data including vendor mappings, product codes and logistics"),
    ("Sales", "sales", "Sales data including territory mappings, customer segments and product hierarchies"),
    (
        "Operations",
        "operations",
        "Operational data including plant codes, cost center mappings and process classifications",
    ),
)
