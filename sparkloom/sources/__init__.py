"""Readers and writers."""

from .delimited import NA_TOKENS, probe, scan_csv
from .objects import object_name, object_size, read_object, write_object

__all__ = ["NA_TOKENS", "object_name", "object_size", "probe", "read_object", "scan_csv", "write_object"]
