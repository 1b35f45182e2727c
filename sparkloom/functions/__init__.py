"""Column expressions and small DataFrame functions."""

from .checks import is_sorted, partition_counts
from .generate import RandomBytes, random_strings
from .partitioning import hash_bucket, segment_bounds, segment_bounds_expr, segment_id

__all__ = ["RandomBytes", "hash_bucket", "is_sorted", "partition_counts", "random_strings", "segment_bounds", "segment_bounds_expr", "segment_id"]
