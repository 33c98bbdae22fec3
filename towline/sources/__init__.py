"""Readers, writers, staging and the declared survey schemas."""

from towline.sources import schemas
from towline.sources.tables import (
    read_lookup,
    read_table,
    read_t_table,
    stage,
    write_table,
)

__all__ = [
    "schemas",
    "read_lookup",
    "read_table",
    "read_t_table",
    "stage",
    "write_table",
]
