"""Column functions; all of them compile to built-in Spark expressions."""

from sluicegate.functions.cells import castable, is_blank, typed
from sluicegate.functions.paths import parse_stored_path, stored_path
from sluicegate.functions.text import html_to_text, mask_pii, schema_name, sql_quote

__all__ = [
    "castable",
    "html_to_text",
    "is_blank",
    "mask_pii",
    "parse_stored_path",
    "schema_name",
    "sql_quote",
    "stored_path",
    "typed",
]
