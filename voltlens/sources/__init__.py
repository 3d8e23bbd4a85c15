"""Reading raw CSV tables, writing results, and the raw schemas."""

from voltlens.sources.readers import (
    RAW_TABLES,
    read_inferred_csv,
    read_part_csv,
    read_raw,
    read_typed_table,
)
from voltlens.sources.schemas import RAW_COLUMNS, raw_schema
from voltlens.sources.writers import import_csv, write_table

__all__ = [
    "RAW_COLUMNS", "RAW_TABLES", "import_csv", "raw_schema",
    "read_inferred_csv", "read_part_csv", "read_raw", "read_typed_table", "write_table",
]
